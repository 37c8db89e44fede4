"""Exact nearest points on the sphere for many query rows, without crossing rows with points.

Places and points are unit vectors in space, so neither poles nor the date line are special, and
the straight distance orders points as the distance over ground does. Both sides are tiled by a
tree of cubes whose edges shrink four times a level; a tile knows the box of what it holds. The
tree of the points ends where its fullest tile holds few.

The search descends both trees at once, level by level: a pair of tiles splits into pairs of their
children, the boxes bound every distance in a pair from below and above, and a pair goes on only
if it can hold one of the ``k`` nearest points of some place in its tile. Far clusters are thinned
that way before a single point is met. Points come last, bounded against the tile once more, and
the rows of a tile meet the few that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..session import cut

BITS = 20
STEP = 2
LEVELS = BITS // STEP
LEAF = 4
CHUNK = 64
AXES = ("x", "y", "z")
SLACK = 2e-9  # of the earth's radius, about a centimetre: rounding never decides


def _located(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Adds the unit vector and the cube numbers of rows with a finite position; others go."""
    finite = (F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) < float("inf"))
    phi, theta = F.radians(F.col(lat)), F.radians(F.col(lon))
    vector = {"_x": F.cos(phi) * F.cos(theta), "_y": F.cos(phi) * F.sin(theta), "_z": F.sin(phi)}
    most = F.lit(2**BITS - 1)
    cubes = {f"_i{a}": F.least(most, F.greatest(F.lit(0), F.floor((F.col(f"_{a}") + 1) * (2 ** (BITS - 1))))).cast("long") for a in AXES}
    return df.where(F.coalesce(finite, F.lit(False))).withColumns(vector).withColumns(cubes)


def _tile(level: int) -> Column:
    """The number of the tile of a level, from the cube numbers."""
    x, y, z = (F.shiftright(f"_i{a}", BITS - STEP * level) for a in AXES)
    return F.shiftleft(x, 2 * (BITS + 1)) + F.shiftleft(y, BITS + 1) + z


def _boxes(rows: DataFrame, level: int, side: str, *sums: Column) -> DataFrame:
    """Tiles of a level under their parents, with the boxes of what they hold."""
    box = [f(c).alias(f"_{side}{n}{a}") for a in AXES for n, f, c in (("lo", F.min, f"_lo{a}"), ("hi", F.max, f"_hi{a}"))]
    return rows.groupBy("_tag", _tile(level).alias(f"_{side}")).agg(
        F.first(_tile(level - 1)).alias(f"_{side}up"), *sums, *box)


def _apart(low: str, high: str) -> tuple[Column, Column]:
    """Squares of the least and the largest distance of two boxes, by the names of their sides."""
    near, far = F.lit(0.0), F.lit(0.0)
    for a in AXES:
        one, two = F.col(f"{low}hi{a}"), F.col(f"{high}hi{a}")
        below, above = F.col(f"{low}lo{a}") - two, F.col(f"{high}lo{a}") - one
        gap = F.greatest(below, above, F.lit(0.0))
        reach = F.greatest(F.abs(below), F.abs(above))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def _close(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of a query tile that can hold one of its ``k`` nearest, by ``_near``, ``_far`` and ``_n``."""
    tile = Window.partitionBy("_tag", "_q")
    if k == 1:
        bound = F.min("_far").over(tile)
    else:
        seen = pairs.withColumn("_seen", F.sum("_n").over(tile.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)))
        pairs, bound = seen, F.min(F.when(F.col("_seen") >= k, F.col("_far"))).over(tile)
    reach = F.sqrt(F.coalesce("_bound", F.lit(16.0))) + SLACK
    return pairs.withColumn("_bound", bound).where(F.col("_near") <= reach * reach)


def _depth(points: DataFrame) -> int:
    """The first level whose fullest tile holds at most ``LEAF`` points: one row a level comes back."""
    every = reduce(DataFrame.unionByName, [
        points.groupBy("_tag", _tile(level).alias("_p")).count().agg(F.max("count").alias("most")).withColumn("level", F.lit(level))
        for level in range(1, LEVELS + 1)])
    return min([r["level"] for r in every.collect() if (r["most"] or 0) <= LEAF], default=LEVELS)


def nearest_by_place(places: DataFrame, points: DataFrame, keep: list[str], point_id: str = "poi_id", k: int = 1,
                     tags: list[str] | None = None) -> DataFrame:
    """(_qlat, _qlon, _best) with _best = (km, pid, props) for distinct places; for ``k`` above 1 the
    array of the ``k`` nearest, nearest first.

    With ``tags`` the points carry ``_tag``; each tag is searched by itself, in the same pass, and the
    result has ``_tag`` too.
    """
    own = Window.partitionBy("_tag", "lat", "lon").orderBy("_pid")
    tag = F.col("_tag") if tags else F.lit("")
    what = points.select(tag.alias("_tag"), "lat", "lon", F.col(point_id).alias("_pid"), F.struct(*keep).alias("_props"))
    # of the points at one place the smallest ids stand for all, so copies never multiply rows
    if k == 1:
        folded = what.groupBy("_tag", "lat", "lon").agg(F.min_by(F.struct("_pid", "_props"), "_pid").alias("_point"))
    else:
        folded = what.withColumn("_nth", F.row_number().over(own)).where(F.col("_nth") <= k).select(
            "_tag", "lat", "lon", F.struct("_pid", "_props").alias("_point"))
    pts = cut(_located(folded.withColumnsRenamed({"lat": "_plat", "lon": "_plon"}), "_plat", "_plon"))
    asked = places.withColumn("_tag", F.explode(F.array(*[F.lit(t) for t in (tags or [""])])))
    located = _located(asked.select("_tag", "_qlat", "_qlon"), "_qlat", "_qlon")
    depth = _depth(pts)
    as_box = {f"_{n}{a}": F.col(f"_{a}") for a in AXES for n in ("lo", "hi")}
    located = located.withColumn("_q", _tile(depth))
    # tiles of all places: few beside the rows, written once for all levels
    places_at = cut(located.withColumns(as_box).groupBy("_tag", "_q").agg(
        *[F.first(f"_i{a}").alias(f"_i{a}") for a in AXES], *[f(f"_{n}{a}").alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]))
    points_at = pts.withColumns(as_box)

    pairs = None
    for level in range(1, depth + 1):
        queries = _boxes(places_at, level, "q")
        targets = _boxes(points_at, level, "p", F.count("*").alias("_n"))
        if pairs is None:
            met = queries.join(targets, "_tag")
        else:
            above = pairs.select("_tag", F.col("_q").alias("_qup"), F.col("_p").alias("_pup"))
            met = above.join(queries, ["_tag", "_qup"]).join(targets, ["_tag", "_pup"])
        near, far = _apart("_q", "_p")
        pairs = _close(met.withColumns({"_near": near, "_far": far}), k)
    tile_box = [f"_q{n}{a}" for a in AXES for n in ("lo", "hi")]
    inside = points_at.withColumn("_p", _tile(depth)).select(
        "_tag", "_p", "_plat", "_plon", "_point", *[F.col(f"_{n}{a}").alias(f"_o{n}{a}") for a in AXES for n in ("lo", "hi")])
    near, far = _apart("_q", "_o")
    useful = _close(
        pairs.select("_tag", "_q", "_p", *tile_box).join(inside, ["_tag", "_p"])
        .select("_tag", "_q", "_plat", "_plon", "_point", near.alias("_near"), far.alias("_far"), F.lit(1).alias("_n")), k)
    # candidates travel in short arrays: usually one per tile, more where points are dense
    place = F.row_number().over(Window.partitionBy("_tag", "_q").orderBy("_plat", "_plon", "_point._pid"))
    chunks = useful.withColumn("_chunk", F.floor(place / CHUNK)).groupBy("_tag", "_q", "_chunk").agg(
        F.collect_list(F.struct("_plat", "_plon", "_point")).alias("_points"))
    each = F.transform("_points", lambda p: F.struct(
        F.round(haversine_km("_qlat", "_qlon", p["_plat"], p["_plon"]), 6).alias("km"),
        p["_point"]["_pid"].alias("pid"), p["_point"]["_props"].alias("props")))
    joined = located.select("_tag", "_q", "_qlat", "_qlon").join(chunks, ["_tag", "_q"])
    keys = ["_qlat", "_qlon", *(["_tag"] if tags else [])]
    if k == 1:
        return joined.select(*keys, F.array_min(each).alias("_best")).groupBy(*keys).agg(F.min("_best").alias("_best"))
    first = joined.select(*keys, F.slice(F.array_sort(each), 1, k).alias("_some"))
    return first.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_some"))), 1, k).alias("_best"))


def _with_best(rows: DataFrame, best: DataFrame, lat: str, lon: str) -> DataFrame:
    return rows.join(best, (rows[lat] == best["_qlat"]) & (rows[lon] == best["_qlon"]), "left")


def nearest_point(
    rows: DataFrame, points: DataFrame, keep: list[str], prefix: str = "nearest_",
    lat: str = "lat", lon: str = "lon", point_id: str = "poi_id",
) -> DataFrame:
    """Adds the nearest point's ``keep`` columns and ``<prefix>km`` (ties: smallest id).

    Rows at one place share one answer, so hot places meet the candidates once. ``points``
    needs its id, lat and lon. With no points, and for rows without a position on the sphere, all
    added columns are NULL.
    """
    places = rows.select(F.col(lat).alias("_qlat"), F.col(lon).alias("_qlon")).distinct()
    out = _with_best(rows, nearest_by_place(places, points, keep, point_id), lat, lon)
    return out.select(
        *[rows[c] for c in rows.columns],
        F.col("_best.km").alias(f"{prefix}km"),
        *[F.col(f"_best.props.{c}").alias(f"{prefix}{c}") for c in keep],
    )


def nearest_points(
    rows: DataFrame, points: DataFrame, keep: list[str], k: int, prefix: str = "nearest_",
    lat: str = "lat", lon: str = "lon", point_id: str = "poi_id",
) -> DataFrame:
    """A row for each of the ``k`` nearest points of every row, with ``<prefix>rank`` from 1 (ties:
    smallest id); all points where there are fewer. Rows without a position have none."""
    if k < 2:
        return nearest_point(rows, points, keep, prefix, lat, lon, point_id).where(F.col(f"{prefix}km").isNotNull()).withColumn(f"{prefix}rank", F.lit(1))
    places = rows.select(F.col(lat).alias("_qlat"), F.col(lon).alias("_qlon")).distinct()
    out = _with_best(rows, nearest_by_place(places, points, keep, point_id, k), lat, lon)
    each = out.select(*[rows[c] for c in rows.columns], F.posexplode("_best").alias("_at", "_one"))
    return each.select(
        *rows.columns, (F.col("_at") + 1).alias(f"{prefix}rank"), F.col("_one.km").alias(f"{prefix}km"),
        *[F.col(f"_one.props.{c}").alias(f"{prefix}{c}") for c in keep])
