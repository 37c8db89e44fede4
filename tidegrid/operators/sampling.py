"""Repeatable background sampling and train / validation / test splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    BACKGROUND_RATIO,
    BACKGROUND_RATIOS,
    BACKGROUND_STRATEGIES,
    DEFAULT_MIN_DEPTH_M,
    MIN_DEPTH_M,
    STRATUM_DEPTH_BINS,
    STRATUM_SHELF_BINS,
    TRAIN_UNTIL,
    VALIDATION_UNTIL,
)
from ..functions.numbers import bin_index
from ..session import small_side
from .alignment import buffered_background, without_presence_cells
from .ranking import hash_firsts, hash_key, hash_ranks, null_safe_join

#: presences a hash bucket holds on average, where prefixes of the hash order are drawn
BUCKET_ROWS = 1000


def by_species(values: dict[str, float], default: float, species: str = "species_id") -> Column:
    """A small per-species constant as a CASE."""
    chain = reduce(lambda acc, kv: acc.when(F.col(species) == kv[0], kv[1]), values.items(), F)
    return chain.otherwise(default)


def min_depth(species: str = "species_id") -> Column:
    return by_species(MIN_DEPTH_M, DEFAULT_MIN_DEPTH_M, species)


def offshore(depth: str = "depth_m", mask: str | None = "ocean_mask") -> Column:
    """Deep enough for the species and, where a mask is given, in the ocean."""
    deep = F.coalesce(F.col(depth), F.lit(-999.0)) >= min_depth()
    return deep & F.coalesce(F.col(mask), F.lit(False)) if mask else deep


def background_need(presence: DataFrame, ratio: int) -> DataFrame:
    """Rows to draw per (species, date): ratio x presences."""
    return presence.groupBy("species_id", "date").agg((F.count(F.lit(1)) * ratio).alias("need"))


def same_day_background(
    presence: DataFrame, grid: DataFrame, ratio: int = BACKGROUND_RATIO,
    cap: int | None = None, seed: int = 42,
) -> DataFrame:
    """Draw background cells for every species and day.

    ``cap``, where given, keeps so many draws per species, spread by hash over all days.

    Candidates are the day's ocean cells with a temperature and no presence of the species.
    Where they are too few the draw is repeated with replacement: pick k takes candidate
    k mod n. Days without a candidate drop out.
    """
    open_cells = grid.where(
        F.col("sst_c").isNotNull() & F.coalesce(F.col("ocean_mask"), F.lit(True))
    ).select("date", "grid_id")
    need = small_side(background_need(presence, ratio))
    pool = without_presence_cells(
        open_cells.join(need, "date"), presence, ["species_id", "date", "grid_id"]
    )
    draw = hash_key("species_id", "date", "grid_id", seed=seed)
    ranked = hash_ranks(pool, ["species_id", "date"], draw, "_rank", "_size")
    # candidate r serves picks r, r + n, r + 2n, ... below the need
    picks = F.explode(F.sequence(F.col("_rank") - 1, F.col("need") - 1, F.col("_size")))
    drawn = ranked.where(F.col("_rank") <= F.col("need")).select(
        "species_id", "date", "grid_id", picks.alias("pick"),
        (F.col("need") > F.col("_size")).alias("short_of_cells"),
    )
    if cap is not None:
        spread = hash_key("species_id", "date", "grid_id", "pick", seed=seed)
        drawn = hash_ranks(drawn, ["species_id"], spread, "_place", "_all").where(F.col("_place") <= cap).drop("_place", "_all")
    return drawn.withColumns({
        "label": F.lit(0).cast("long"),
        "sample_type": F.lit("background"),
        "background_strategy": F.lit("same_date_random_ocean"),
    })


def downsample_background(
    data: DataFrame, ratio: int, groups: list[str], row_id: str, seed: int = 42
) -> DataFrame:
    """All presences and at most ratio x presences background rows per group."""
    presences = data.groupBy(*groups).agg(F.count_if(F.col("label") == 1).alias("_p"))
    background = data.where(F.col("label") == 0)
    ranked = hash_ranks(background, groups, hash_key(row_id, seed=seed), "_rank", "_size")
    # a group without presences keeps its background, as there is nothing to balance
    kept = null_safe_join(ranked, small_side(presences), groups).where(
        (F.col("_rank") <= F.col("_p") * ratio) | (F.col("_p") == 0)
    )
    return data.where(F.col("label") == 1).unionByName(kept.select(*data.columns))


def downsample_unshuffled(data: DataFrame, ratio: int, groups: list[str], row_id: str, seed: int = 42) -> DataFrame:
    """The rows of ``downsample_background`` in another order: only those where the limit cuts are ranked."""
    presences = data.groupBy(*groups).agg(F.count_if(F.col("label") == 1).alias("_p"))
    limit = F.when(F.col("_p") == 0, F.col("_size")).otherwise(F.col("_p") * ratio)
    kept = hash_firsts(
        data.where(F.col("label") == 0), groups, hash_key(row_id, seed=seed),
        lambda sizes: null_safe_join(sizes, small_side(presences), groups).withColumn("_limit", limit),
    )
    return data.where(F.col("label") == 1).unionByName(kept)


def strata(df: DataFrame) -> DataFrame:
    """Depth and shelf bins; an unknown value is a bin of its own (-1)."""
    unknown = F.lit(-1).cast("long")
    return df.withColumns({
        "_depth_bin": F.coalesce(bin_index("depth_m", STRATUM_DEPTH_BINS), unknown),
        "_shelf_bin": F.coalesce(bin_index("distance_to_shelf_break", STRATUM_SHELF_BINS), unknown),
    })


def _deep(data: DataFrame) -> Column:
    return offshore(mask="ocean_mask" if "ocean_mask" in data.columns else None)


def without_others(data: DataFrame) -> DataFrame:
    """species_id of the species that are the only ones with presences, or all where none has."""
    known = data.where(F.col("label") == 1).agg(F.min("species_id").alias("_a"), F.max("species_id").alias("_b"))
    alone = F.col("_a").isNull() | ((F.col("_a") == F.col("_b")) & (F.col("species_id") == F.col("_a")))
    # one row beside all
    return data.select("species_id").distinct().join(F.broadcast(known)).where(alone).select("species_id")


def target_group_pool(data: DataFrame) -> DataFrame:
    """The whole target-group pool: for each species the deep presences of all others, or its own
    deep background where there are none.

    The pool itself has a row per species and presence. ``target_group_samples`` draws from it
    without making it.
    """
    presence = data.where((F.col("label") == 1) & F.col("species_id").isNotNull())
    every = data.agg(F.collect_set("species_id").alias("_species"))
    others = presence.join(F.broadcast(every)).withColumn("_of", F.explode(F.array_except("_species", F.array("species_id"))))
    effort = others.withColumn("species_id", F.col("_of")).where(_deep(data)).select(*data.columns)
    fallback = data.where(F.col("label") == 0).where(_deep(data)).join(without_others(data), "species_id", "left_semi")
    return effort.unionByName(fallback.select(*data.columns))


def target_group_samples(data: DataFrame, ratios: tuple[int, ...], row_id: str) -> DataFrame:
    """audit_background_ratio x presences rows of each species' target-group pool, by hash order.

    The hash order of presences is the same for all species, so a species draws from a prefix of
    it. Presences are cut into hash buckets; from their counts per depth limit follows how many
    buckets hold as many deep rows as the species wants and owns, whatever share of them is its
    own. Rows meet only the species whose prefix reaches their bucket, so what is made is in
    proportion to what is drawn, without a list of species.
    """
    presence = data.where((F.col("label") == 1) & F.col("species_id").isNotNull())
    each_ratio = F.explode(F.array(*[F.lit(r) for r in ratios]))
    rows = presence.withColumn("audit_background_ratio", each_ratio).withColumn("_draw", ratio_draw(row_id))
    buckets = max(1, presence.count() // BUCKET_ROWS)
    share = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / float(2**32)
    rows = rows.withColumn("_bucket", F.floor(share * buckets).cast("int"))
    masked = F.coalesce(F.col("ocean_mask"), F.lit(False)) if "ocean_mask" in data.columns else F.lit(True)
    # the few depth limits that species have
    limits = F.array(*[F.lit(float(v)) for v in sorted({*MIN_DEPTH_M.values(), DEFAULT_MIN_DEPTH_M})])
    open_to = F.filter(limits, lambda v: (F.coalesce("depth_m", F.lit(-999.0)) >= v) & masked)
    counts = rows.withColumn("_limit", F.explode(open_to)).groupBy("audit_background_ratio", "_limit", "_bucket").agg(F.count("*").alias("_n"))
    wants = presence.groupBy("species_id").agg(F.count("*").alias("_p")).withColumn("_limit", min_depth().cast("double")).withColumn(
        "audit_background_ratio", each_ratio).withColumn("_reach", F.col("_p") * (F.col("audit_background_ratio") + 1))
    # counts and wishes in one order: the first bucket behind a wish is its last one
    line = ["audit_background_ratio", "_limit"]
    upto = Window.partitionBy(*line).orderBy("_bucket")
    ends = counts.select(*line, F.sum("_n").over(upto).alias("_at"), F.col("_bucket").alias("_end"), F.lit(None).cast("string").alias("species_id"), F.lit(0).alias("_kind"))
    both = ends.unionByName(wants.select(*line, F.col("_reach").alias("_at"), F.lit(None).cast("int").alias("_end"), "species_id", F.lit(-1).alias("_kind")))
    ahead = Window.partitionBy(*line).orderBy("_at", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach = both.withColumn("_last", F.coalesce(F.first("_end", True).over(ahead), F.lit(buckets - 1))).where("_kind = -1")
    met = reach.select("audit_background_ratio", "_limit", F.col("species_id").alias("_of"), F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_bucket"))
    pool = rows.join(met, ["audit_background_ratio", "_bucket"]).where(
        (F.col("species_id") != F.col("_of")) & (F.coalesce("depth_m", F.lit(-999.0)) >= F.col("_limit")) & masked)
    drawn = pool.withColumn("species_id", F.col("_of")).select(*data.columns, "audit_background_ratio")
    lonely = data.where(F.col("label") == 0).where(_deep(data)).join(without_others(data), "species_id", "left_semi")
    return drawn.unionByName(lonely.select(*data.columns).withColumn("audit_background_ratio", each_ratio)).withColumn(
        "audit_background_strategy", F.lit("target_group_background"))


def ratio_draw(row_id: str) -> Column:
    """The hash order in which background rows of a ratio are drawn."""
    return hash_key((100 + F.col("audit_background_ratio")).cast("string"), row_id, seed="ratio")


def strategy_pools(data: DataFrame, row_id: str = "row_id", seed: int = 42, target_group: bool = True) -> DataFrame:
    """Background pools of the strategies, keyed (species_id, audit_background_strategy).

    ``target_group`` asks for the pool of that strategy too (see ``target_group_pool``).
    """
    presence = data.where(F.col("label") == 1)
    background = data.where(F.col("label") == 0)
    deep = _deep(data)

    def tagged(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*data.columns).withColumn("audit_background_strategy", F.lit(name))

    binned = strata(background)
    bins = binned.groupBy("species_id").agg(
        F.count_distinct("_depth_bin", "_shelf_bin").alias("_bins")
    )
    presences = data.groupBy("species_id").agg(F.count_if(F.col("label") == 1).alias("_p"))
    quota = bins.join(presences, "species_id").select(
        "species_id", F.greatest(F.lit(1), F.floor(F.col("_p") / F.col("_bins"))).alias("_quota")
    )
    ranked = hash_ranks(
        binned, ["species_id", "_depth_bin", "_shelf_bin"], hash_key(row_id, seed=seed), "_rank", "_size"
    )
    stratified = ranked.join(small_side(quota), "species_id").where(F.col("_rank") <= F.col("_quota"))

    pools = [
        tagged(background, "random_ocean_background"),
        tagged(background.where(deep), "offshore_constrained_background"),
        *([tagged(target_group_pool(data), "target_group_background")] if target_group else []),
        tagged(stratified, "environment_stratified_background"),
        tagged(buffered_background(background, presence), "spatial_buffered_background"),
    ]
    return reduce(DataFrame.unionByName, pools).withColumn("label", F.lit(0))


def strategy_samples(
    data: DataFrame, ratios: tuple[int, ...] = BACKGROUND_RATIOS, row_id: str = "row_id"
) -> DataFrame:
    """Presences plus sampled background per (species, strategy, ratio) in one table.

    A pool row is ranked once per ratio seed by exploding the ratios; the target-group pool is
    never made (``target_group_samples``).
    """
    pools = strategy_pools(data, row_id, target_group=False)
    with_ratio = pools.withColumn(
        "audit_background_ratio", F.explode(F.array(*[F.lit(r) for r in ratios]))
    ).unionByName(target_group_samples(data, ratios, row_id).withColumn("label", F.lit(0)))
    draw = ratio_draw(row_id)
    keys = ["species_id", "audit_background_strategy", "audit_background_ratio"]
    ranked = hash_ranks(with_ratio, keys, draw, "_rank", "_size")
    presences = data.where(F.col("label") == 1)
    counts = presences.groupBy("species_id").agg(F.count(F.lit(1)).alias("_p"))
    sampled = ranked.join(small_side(counts), "species_id").where(
        F.col("_rank") <= F.col("_p") * F.col("audit_background_ratio")
    )
    repeated = presences.withColumn(
        "audit_background_strategy", F.explode(F.array(*[F.lit(s) for s in BACKGROUND_STRATEGIES]))
    ).withColumn("audit_background_ratio", F.explode(F.array(*[F.lit(r) for r in ratios])))
    columns = [*data.columns, *keys[1:]]
    return repeated.select(*columns).unionByName(sampled.select(*columns))


def temporal_part(day: str = "date", train_until: str = TRAIN_UNTIL, validation_until: str = VALIDATION_UNTIL) -> Column:
    d = F.col(day)
    return (
        F.when(d <= F.to_date(F.lit(train_until)), "train")
        .when(d <= F.to_date(F.lit(validation_until)), "validation")
        .when(d.isNotNull(), "test")
    )


def random_part(data: DataFrame, row_id: str, groups: list[str], seed: int = 42, group_by: str | None = None) -> DataFrame:
    """Stratified 70 / 15 / 15 by hash order within the label.

    With ``group_by`` (a date) whole days move together, so one day never straddles splits.
    """
    if group_by:
        units = data.select(*groups, group_by).distinct()
        ranked = hash_ranks(units, groups, hash_key(*groups, group_by, seed=seed), "_rank", "_size")
        share = (F.col("_rank") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
        parts = ranked.withColumn("_part", _share_part(share)).drop("_rank", "_size")
        return data.join(parts, [*groups, group_by]).withColumnRenamed("_part", "split")
    keys = [*groups, "label"]
    ranked = hash_ranks(data, keys, hash_key(row_id, seed=seed), "_rank", "_size")
    share = (F.col("_rank") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
    return ranked.withColumn("split", _share_part(share)).drop("_rank", "_size")


def _share_part(share: Column) -> Column:
    return F.when(share < 0.70, "train").when(share < 0.85, "validation").otherwise("test")


def class_table(data: DataFrame, row: str, groups: list[str]) -> DataFrame:
    """Counts of both labels per value of ``row``."""
    return data.groupBy(*groups, row).agg(
        F.count_if(F.col("label") == 0).alias("background"),
        F.count_if(F.col("label") == 1).alias("presence"),
    )


def assign_splits(
    data: DataFrame, row_id: str, groups: list[str] | None = None, day: str = "date",
    train_until: str = TRAIN_UNTIL, validation_until: str = VALIDATION_UNTIL,
    group_by: str | None = None,
) -> DataFrame:
    """Time split where all three parts hold both labels, else the stratified random split.

    Groups with one label or fewer than ten rows, or fewer than two of a label, stay train.
    """
    groups = groups or ["species_id"]
    timed = data.withColumn("_time", temporal_part(day, train_until, validation_until))
    # rows without a day train
    timed = timed.withColumn("_time", F.coalesce("_time", F.lit("train")))
    cell = timed.groupBy(*groups, "_time").agg(
        F.count_if(F.col("label") == 0).alias("_b"), F.count_if(F.col("label") == 1).alias("_p")
    )
    facts = cell.groupBy(*groups).agg(
        F.count_if((F.col("_b") > 0) & (F.col("_p") > 0)).alias("_full"),
        F.sum("_b").alias("_nb"), F.sum("_p").alias("_np"),
    )
    fewest = F.least("_nb", "_np")
    strategy = (
        F.when(F.col("_full") == 3, "time_split")
        .when((fewest == 0) | (F.col("_nb") + F.col("_np") < 10), "insufficient_for_split")
        .when(fewest < 2, "insufficient_for_stratified_split")
        .otherwise("stratified_random_low_data")
    )
    decided = small_side(facts.select(*groups, strategy.alias("split_strategy")))
    chosen = null_safe_join(timed, decided, groups)
    low = random_part(
        chosen.where(F.col("split_strategy") == "stratified_random_low_data"), row_id, groups,
        group_by=group_by,
    )
    rest = chosen.where(F.col("split_strategy") != "stratified_random_low_data").withColumn(
        "split", F.when(F.col("split_strategy") == "time_split", F.col("_time")).otherwise("train")
    )
    return rest.unionByName(low).drop("_time")


def block_name(lat: str = "grid_lat", lon: str = "grid_lon") -> Column:
    """One-degree block as text; the order of blocks is the order of this text."""
    return F.format_string("%.1f_%.1f", F.floor(lat).cast("double"), F.floor(lon).cast("double"))


def spatial_block_split(data: DataFrame, groups: list[str] | None = None, out: str = "spatial_split") -> DataFrame:
    """Every fifth block validates, every fifth from the third tests; under 3 blocks: NULL.

    Blocks are ranked on their distinct list (at most one per degree square), then joined back.
    """
    groups = groups or ["species_id"]
    named = data.withColumn("block_id", block_name())
    blocks = named.select(*groups, "block_id").where(F.col("block_id").isNotNull()).distinct()
    w = Window.partitionBy(*groups)
    place = (F.row_number().over(w.orderBy("block_id")) - 1) % 5
    n = F.count(F.lit(1)).over(w)
    ranked = blocks.withColumns({"_place": place, "_n": n}).select(
        *groups, "block_id",
        F.when(F.col("_n") >= 3, F.when(F.col("_place") == 0, "validation")
               .when(F.col("_place") == 2, "test").otherwise("train")).alias(out),
    )
    return named.join(small_side(ranked), [*groups, "block_id"], "left")


def spatial_temporal_part(spatial: str, temporal: str) -> Column:
    """Rows whose block split and time split agree; the others are unused (NULL)."""
    return F.when(F.col(spatial) == F.col(temporal), F.col(spatial))


def candidate_cells(
    cells: DataFrame, presence: DataFrame, per_day: int, seed: int = 42,
    keys: tuple[str, ...] = ("date", "grid_id"), east_of: float | None = None,
) -> DataFrame:
    """Presence cells plus hash-ordered other cells up to ``per_day`` rows a day.

    ``cells`` holds (date, grid_id, ...). ``east_of`` drops other cells west of a longitude.
    """
    held = presence.select(*keys).distinct()
    kept = cells.join(held, list(keys), "left_semi").withColumn("is_presence_cell", F.lit(True))
    others = cells.join(held, list(keys), "left_anti")
    if east_of is not None:
        others = others.where(F.col("lon") > east_of)
    taken = kept.groupBy("date").agg(F.count(F.lit(1)).alias("_held"))
    ranked = hash_ranks(others, ["date"], hash_key(*keys, seed=seed), "_rank", "_size")
    room = F.lit(per_day) - F.coalesce(F.col("_held"), F.lit(0))
    # one row per day: bounded by the calendar
    extra = ranked.join(F.broadcast(taken), "date", "left").where(F.col("_rank") <= room)
    return kept.unionByName(
        extra.select(*cells.columns).withColumn("is_presence_cell", F.lit(False))
    )
