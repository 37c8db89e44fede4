"""Exact ranks, running sums and quantiles over groups of any size.

A plain window sends a whole group to one task. Here a group is cut into value-ordered
buckets first: global quantiles of the sort key bound every bucket to a small share of all
rows, whatever the group sizes are. Values that repeat so often that they appear as a cut
get a bucket of their own, split further by the tie-break key. Ranks are computed inside
each bucket and shifted by the row counts of the buckets before it. The cuts only decide
where rows travel, so the results are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col
from ..session import small_side

MAX_BUCKETS = 2048
#: narrowing of ranges: buckets a pass, rows that need no more of it, passes at most
RANGE_BUCKETS, FEW_ROWS, NARROWINGS = 4096, 100_000, 8
INF = float("inf")


@dataclass(frozen=True)
class Cuts:
    """Ascending cut points of the sort key and of its tie-break (at most MAX_BUCKETS)."""

    key: tuple[float, ...]
    tie: tuple[float, ...]


def bucket_count(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(2 * partitions, MAX_BUCKETS))


def find_cuts(df: DataFrame, keys: list[str], tie: str | None) -> dict[str, Cuts]:
    """One map-side-combined pass for all keys; brings back bounded arrays."""
    n = bucket_count(df)
    shares = [i / n for i in range(1, n)]
    columns = list(dict.fromkeys([*keys, *([tie] if tie else [])]))
    row = df.agg(*[
        F.percentile_approx(F.col(c).cast("double"), shares, 10 * n).alias(c) for c in columns
    ]).first()
    found = {c: tuple(sorted({float(v) for v in row[c] or ()})) for c in columns}
    return {k: Cuts(found[k], found[tie] if tie else ()) for k in keys}


def _bucketize(df: DataFrame, source: str, target: str, cuts: tuple[float, ...]) -> DataFrame:
    if not cuts:
        return df.withColumn(target, F.lit(0))
    tool = Bucketizer(
        splits=[-INF, *cuts, INF], inputCol=source, outputCol=target, handleInvalid="keep"
    )
    return tool.transform(df).withColumn(target, F.col(target).cast("int"))


def _with_order(df: DataFrame, key: Column | str, tie: Column | str | None, descending: bool) -> DataFrame:
    value = col(key).cast("double")
    return df.withColumns({
        "_k": -value if descending else value, "_t": F.lit(0) if tie is None else col(tie)
    })


def _route(rows: DataFrame, cuts: Cuts) -> DataFrame:
    rows = _bucketize(rows, "_k", "_slot", cuts.key)
    rows = _bucketize(rows.withColumn("_td", F.col("_t").cast("double")), "_td", "_tslot", cuts.tie)
    # slot i starts at cut i-1: rows equal to that cut form the even bucket, the rest the odd one
    starts = F.array(*[F.lit(v) for v in (-INF, *cuts.key)])
    known = F.col("_k").isNotNull()
    at_cut = known & (F.col("_k") == F.try_element_at(starts, F.col("_slot") + 1))
    value_bucket = F.when(known, 2 * F.col("_slot") + F.when(at_cut, 0).otherwise(1)).otherwise(-1)
    rows = rows.withColumn("_b1", value_bucket)
    rows = rows.withColumn("_b2", F.when(at_cut | ~known, F.col("_tslot")).otherwise(0))
    return rows.drop("_slot", "_tslot", "_td")


@dataclass
class Ranked:
    """Rows with their bucket, and one offset row per (group, bucket)."""

    rows: DataFrame
    offsets: DataFrame
    groups: list[str]

    @property
    def bucket(self) -> list[str]:
        return [*self.groups, "_b1", "_b2"]

    def window(self, *more: str):
        return Window.partitionBy(*self.bucket, *more)

    def with_offsets(self, rows: DataFrame | None = None) -> DataFrame:
        return (self.rows if rows is None else rows).join(self.offsets, self.bucket, "left")


def bucketed(
    df: DataFrame,
    groups: list[str],
    key: Column | str,
    tie: Column | str | None = None,
    *,
    descending: bool = False,
    sums: dict[str, Column] | None = None,
    cuts: Cuts | None = None,
    base: DataFrame | None = None,
) -> Ranked:
    """Cut rows into ordered buckets. ``groups`` must hold no NULL.

    ``_k`` and ``_t`` are the ascending sort columns. Offsets per bucket: ``_off`` rows of the
    group before it, ``_n`` rows in it, ``_off1``/``_n1`` the same for all rows of its value
    range, ``_total``, ``_low``, ``_high`` for the group, and per entry of ``sums`` the sum
    before the bucket (``_off_x``), in it (``_in_x``), and over the group (``_all_x``). Rows
    with a NULL key are spread over buckets of their own (``_b1`` = -1) that have no offsets.
    ``base`` is a cheaper frame with the same rows to count on, when ``df`` is a long plan.
    """
    sums = sums or {}
    source = df if base is None else base
    if cuts is None:
        keyed = _with_order(source, key, tie, descending)
        cuts = find_cuts(keyed, ["_k"], "_t" if tie is not None else None)["_k"]
    rows = _route(_with_order(df, key, tie, descending), cuts)
    counted = rows if base is None else _route(_with_order(base, key, tie, descending), cuts)
    sizes = counted.where(F.col("_b1") >= 0).groupBy(*groups, "_b1", "_b2").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_k").alias("_low"),
        F.max("_k").alias("_high"),
        *[F.sum(expr).alias(f"_in_{name}") for name, expr in sums.items()],
    )
    everything = Window.partitionBy(*groups)
    ordered = everything.orderBy("_b1", "_b2")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    value_before = everything.orderBy("_b1").rangeBetween(Window.unboundedPreceding, -1)
    same_value = Window.partitionBy(*groups, "_b1")
    zero = F.lit(0)
    offsets = sizes.withColumns({
        "_off": F.coalesce(F.sum("_n").over(before), zero),
        "_off1": F.coalesce(F.sum("_n").over(value_before), zero),
        "_n1": F.sum("_n").over(same_value),
        "_total": F.sum("_n").over(everything),
        "_low": F.min("_low").over(everything),
        "_high": F.max("_high").over(everything),
        **{f"_off_{x}": F.coalesce(F.sum(f"_in_{x}").over(before), zero) for x in sums},
        **{f"_all_{x}": F.sum(f"_in_{x}").over(everything) for x in sums},
    })
    return Ranked(rows, offsets, groups)


def row_ranks(
    df: DataFrame,
    groups: list[str],
    key: Column | str,
    tie: Column | str,
    *,
    descending: bool = False,
    rank: str = "rank",
    total: str = "total",
    cuts: Cuts | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Adds 1-based ``rank`` by (key, tie) and ``total`` ranked rows; both NULL for a NULL key."""
    ranked = bucketed(df, groups, key, tie, descending=descending, cuts=cuts, base=base)
    inside = F.row_number().over(ranked.window().orderBy("_k", "_t"))
    out = ranked.with_offsets(ranked.rows.withColumn("_rn", inside))
    return out.select(
        *df.columns,
        (F.col("_off") + F.col("_rn")).alias(rank),
        F.col("_total").alias(total),
        F.col("_low").alias("_low"),
        F.col("_high").alias("_high"),
    )


def relative_score(
    df: DataFrame, groups: list[str], score: str, tie: str, out: str, flat: float = 1e-9
) -> DataFrame:
    """0-based rank / (n-1) * 100; a constant group gets 50."""
    ranked = row_ranks(df, groups, score, tie, rank="_rank", total="_count")
    value = (F.col("_rank") - 1) / F.greatest(F.col("_count") - 1, F.lit(1)) * 100
    value = F.when(F.col("_high") - F.col("_low") < flat, 50.0).otherwise(value)
    return ranked.select(*df.columns, value.alias(out))


def first_rank_percentile(
    df: DataFrame, groups: list[str], score: str, tie: str, out: str, flat: float = 1e-12,
    cuts: Cuts | None = None, base: DataFrame | None = None,
) -> DataFrame:
    """1-based rank / n * 100; a constant group gets 50."""
    ranked = row_ranks(df, groups, score, tie, rank="_rank", total="_count", cuts=cuts, base=base)
    value = F.col("_rank") / F.col("_count") * 100
    value = F.when(F.col("_high") - F.col("_low") < flat, 50.0).otherwise(value)
    return ranked.select(*df.columns, value.alias(out))


def average_rank_percentile(
    df: DataFrame, groups: list[str], score: str, out: str, spread: str
) -> DataFrame:
    """Average rank of ties / n * 100. ``spread`` is a numeric id that splits heavy ties."""
    ranked = bucketed(df, groups, score, spread)
    shared = F.rank().over(ranked.window().orderBy("_k"))
    peers = F.count(F.lit(1)).over(ranked.window("_k"))
    rows = ranked.rows.withColumns({"_r": shared, "_peers": peers})
    pure = F.col("_b1") % 2 == 0  # one value only: its average rank follows from the counts
    average = F.when(pure, F.col("_off1") + (F.col("_n1") + 1) / 2).otherwise(
        F.col("_off") + F.col("_r") + (F.col("_peers") - 1) / 2
    )
    value = average / F.col("_total") * 100
    return ranked.with_offsets(rows).select(*df.columns, value.alias(out))


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, shares: dict[str, float], tie: str
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``shares``.

    Only rows of the buckets that hold a wanted position are shuffled.
    """
    ranked = bucketed(df, groups, value, tie)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_total") - 1)).alias("at"))
        for name, p in shares.items()
    ])
    places = (
        ranked.offsets.withColumn("_want", F.explode(wanted))
        .select(
            *ranked.bucket, "_off", "_n",
            F.col("_want.name").alias("_name"),
            F.floor("_want.at").alias("_lo"),
            F.ceil("_want.at").alias("_hi"),
            (F.col("_want.at") - F.floor("_want.at")).alias("_part"),
        )
    )

    def inside(place: str) -> Column:
        return (F.col(place) >= F.col("_off")) & (F.col(place) < F.col("_off") + F.col("_n"))

    places = places.where(inside("_lo") | inside("_hi"))
    buckets = places.select(*ranked.bucket).distinct()
    position = F.row_number().over(ranked.window().orderBy("_k", "_t")) - 1
    rows = (
        ranked.rows.select(*ranked.bucket, "_k", "_t")
        .join(buckets, ranked.bucket, "left_semi")
        .withColumn("_pos", position)
    )
    at = F.col("_off") + F.col("_pos")
    hits = places.join(rows, ranked.bucket).where((at == F.col("_lo")) | (at == F.col("_hi")))
    low = F.max(F.when(at == F.col("_lo"), F.col("_k")))
    high = F.max(F.when(at == F.col("_hi"), F.col("_k")))
    points = hits.groupBy(*groups, "_name").agg(
        (low + (high - low) * F.max("_part")).alias("_v")
    )
    return points.groupBy(*groups).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares
    ])


def column_quantiles(df: DataFrame, groups: list[str], columns: list[str], share: float = 0.5) -> DataFrame:
    """``groups``, column (a place in ``columns``) and value: the linearly interpolated quantile of
    every column and group, in the same passes.

    The range of each column is narrowed to the bucket that holds the wanted positions, from counts
    alone, until it holds few rows; only those are ranked. NULL values take no part.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    long = df.select(*groups, each.alias("e")).select(*groups, "e.*").where(F.col("v").isNotNull())
    keys = [*groups, "column"]
    first = long.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("*").alias("_n"))
    place = F.lit(share) * (F.col("_n") - 1)
    state = first.withColumns({"_a": F.floor(place), "_z": F.ceil(place), "_before": F.lit(0).cast("long"), "_in": F.col("_n")})
    for _ in range(NARROWINGS):
        state = small_side(state)
        if state.where((F.col("_in") > FEW_ROWS) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            break
        share_of = (F.col("v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        bucket = F.least(F.lit(RANGE_BUCKETS - 1), F.floor(F.coalesce(share_of, F.lit(0.0)) * RANGE_BUCKETS)).cast("int")
        inside = null_safe_join(long, state, keys).where(F.col("v").between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy(*keys, "_n", "_a", "_z", "_before", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("v").alias("_v0"), F.max("v").alias("_v1"))
        upto = Window.partitionBy(*keys).orderBy("_b")
        ranked = counts.withColumn("_from", F.col("_before") + F.sum("_c").over(upto) - F.col("_c"))
        held = (F.col("_from") <= F.col("_z")) & (F.col("_from") + F.col("_c") > F.col("_a"))
        state = ranked.where(held).groupBy(*keys, "_n", "_a", "_z").agg(
            F.min("_v0").alias("_lo"), F.max("_v1").alias("_hi"), F.min("_from").alias("_before"), F.sum("_c").alias("_in"))
    few = null_safe_join(long, state, keys).where(F.col("v").between(F.col("_lo"), F.col("_hi")))
    values = few.groupBy(*keys, "_n", "_a", "_z", "_before", "v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("v")
    placed = values.withColumn("_end", F.col("_before") + F.sum("_c").over(upto)).withColumn("_from", F.col("_end") - F.col("_c"))
    at = lambda p: F.max(F.when((F.col("_from") <= F.col(p)) & (F.col("_end") > F.col(p)), F.col("v")))
    found = placed.groupBy(*keys, "_n", "_a").agg(at("_a").alias("_x"), at("_z").alias("_y"))
    return found.select(*keys, (F.col("_x") + (F.col("_y") - F.col("_x")) * (place - F.col("_a"))).alias("value"))


def hash_key(*parts: Column | str, seed: int | str = 42) -> Column:
    """Repeatable pseudo-random order: the same on every cluster and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def hash_ranks(df: DataFrame, groups: list[str], order: Column, rank: str, total: str) -> DataFrame:
    """1-based rank by an md5 text. The prefix is uniform, so the cuts need no pass."""
    n = bucket_count(df)
    prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(2**32)
    rows = df.withColumn("_h", order).withColumn("_b", F.floor(prefix * n).cast("int"))
    sizes = rows.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(*groups)
    before = everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(everything).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h"))
    ranked = null_safe_join(rows.withColumn("_rn", inside), offsets, [*groups, "_b"])
    return ranked.select(*df.columns, (F.col("_off") + F.col("_rn")).alias(rank), total)


def hash_firsts(df: DataFrame, groups: list[str], order: Column, limited: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of every group that come first by an md5 text, as many as its limit.

    ``limited`` gets a table with ``groups`` and ``_size``, the rows of the group, and adds ``_limit``.
    Counts by hash prefix tell the one bucket of a group that the limit cuts: only its rows are
    ranked, those before it are all kept and those behind it go, and neither is shuffled.
    """
    prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(2**32)
    rows = df.withColumn("_h", order).withColumn("_b", F.floor(prefix * MAX_BUCKETS).cast("int"))
    everything = Window.partitionBy(*groups)
    before = everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(everything)})
    reached = limited(sizes).where("_off < _limit")
    edge = small_side(reached.groupBy(*groups, "_limit").agg(F.max("_b").alias("_edge"), F.max("_off").alias("_before")))
    near = null_safe_join(rows, edge, groups)
    cut = near.where("_b = _edge").withColumn("_rn", F.row_number().over(everything.orderBy("_h")))
    return near.where("_b < _edge").select(*df.columns).unionByName(cut.where("_rn <= _limit - _before").select(*df.columns))


def null_safe_join(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL meets NULL; the keys of ``df`` stay."""
    other = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
    same = [df[k].eqNullSafe(other[f"_side_{k}"]) for k in keys]
    return df.join(other, same).drop(*[f"_side_{k}" for k in keys])


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group, ranked.

    Rows are first reduced to ``n`` per salted slice of the group, so a hot group is cut down
    on many tasks before its survivors meet.
    """
    salts = bucket_count(df)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    local = Window.partitionBy(*groups, "_salt").orderBy(*order)
    few = salted.withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= n)
    final = Window.partitionBy(*groups).orderBy(*order)
    out = few.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= n)
    return out.select(*df.columns, F.col(rank).cast("long").alias(rank))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``: a combinable aggregate, so hot keys shrink map-side."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(first).select("_row.*")
