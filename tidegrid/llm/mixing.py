"""Mixing sources to target weights: pivotal dependent rounding over a reduction tree.

Every source has a target number of words. Its documents get the same expected number of
copies, ``target / source size``; the whole part is certain and the fraction is rounded.

Rounding is pivotal. Two items with open fractions meet: word mass moves from one to the
other, in a randomly drawn direction whose odds keep both expectations, until one fraction is
0 or 1. That item is decided; the other goes on to the next. Mass is counted in words, so the
words of the mix stay on target to within one document, whatever the lengths are.

The pairs form a tree. Documents are dealt by hash into small buckets of their source; each
bucket decides all its items but one at most, and the residuals are dealt into buckets again
until every source has one, which is drawn on its own. Bucket numbers follow from the counted
items of a source, so buckets are alike for small and hot sources, and each level leaves at
most one item per bucket.

Targets: sources stand in code point order (NULL last) with weights that repeat, share the
words of all, and stop at ``most`` times their own size; the excess is shared again by weight.
The water level is found in closed form from running sums over sources ordered by the level
at which they fill up; that table has one row per source.

Defined cases: a NULL text has size 0; items of size 0 are decided at random alone, and count
for nothing; equal rows (same id, source and text) are one item with more copies to give, spread
evenly over the rows; NULL sources are a source; when no text has words, all targets are 0 and
nothing is taken; an empty table gives an empty result. Draws come from hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, held, table, unit_draw, word_count

BUCKET_ITEMS = 64
MOST = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    level = (
        sizes.withColumn("n", F.row_number().over(in_order) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("n") % len(weights) + 1).cast("int")))
        .withColumn("full_at", most * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(onward))
        # the first source that stays below its cap gives the water level
        .withColumn("open_level", F.when(F.col("level") <= F.col("full_at"), F.struct(F.row_number().over(filled).alias("k"), "level")))
        .withColumn("water", F.min("open_level").over(Window.partitionBy())["level"])
    )
    target = F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("water"))
    return level.select("source", "source_size", F.coalesce(target, most * F.col("source_size").cast("double")).alias("target"))


def _pivotal(items: Column, item_type: str) -> Column:
    """One pass of pivotal rounding over an array of items (size, p, u, ...).

    Gives (open, done): the items decided, and the one at most whose p is still a fraction.
    """

    def meet(state: Column, item: Column) -> Column:
        carried, done = state["open"], state["done"]
        words, room = carried["size"] * carried["p"], carried["size"] * (1 - carried["p"])
        its_words, its_room = item["size"] * item["p"], item["size"] * (1 - item["p"])
        gives, takes = F.least(words, its_room), F.least(its_words, room)
        # expectations stay: the odds of a direction are the mass that the other one would move
        onward = item["u"] * (gives + takes) < takes
        p = F.when(onward, F.when(words <= its_room, 0.0).otherwise(carried["p"] - gives / carried["size"])).otherwise(
            F.when(room <= its_words, 1.0).otherwise(carried["p"] + takes / carried["size"]))
        its_p = F.when(onward, F.when(its_room <= words, 1.0).otherwise(item["p"] + gives / item["size"])).otherwise(
            F.when(its_words <= room, 0.0).otherwise(item["p"] - takes / item["size"]))
        first, second = carried.withField("p", p), item.withField("p", its_p)
        p_set, its_p_set = (p <= 0) | (p >= 1), (its_p <= 0) | (its_p >= 1)
        return (
            F.when(carried.isNull(), F.struct(item.alias("open"), done.alias("done")))
            .when(p_set & its_p_set, F.struct(F.lit(None).cast(item_type).alias("open"), F.concat(done, F.array(first, second)).alias("done")))
            .when(p_set, F.struct(second.alias("open"), F.concat(done, F.array(first)).alias("done")))
            .otherwise(F.struct(first.alias("open"), F.concat(done, F.array(second)).alias("done")))
        )

    start = F.struct(F.lit(None).cast(item_type).alias("open"), F.array().cast(f"array<{item_type}>").alias("done"))
    return F.aggregate(items, start, meet)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 0,
        bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """One row per distinct (id, source, text): id, source, digest, size, rows, source_size, target, copies.

    ``rows`` counts the equal input rows and ``copies`` what the mix takes of them together.
    """
    items = held(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_digest(F.col(text_col)).alias("digest"),
            word_count(F.col(text_col)).alias("size"),
        ).groupBy("id", "source", "digest", "size").agg(F.count("*").alias("rows")),
        "mix-items",
    )
    per_source = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("items"))
    targets = source_targets(per_source.select("source", "source_size"), weights=weights, most=most)
    sources = held(
        targets.join(per_source.select(F.col("source").alias("s"), "items"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))),
        "mix-sources",
    )
    largest = sources.agg(F.max("items")).first()[0] or 0
    expected = items.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn(
        "p", F.col("rows") * F.col("rate")).withColumn("whole", F.floor("p")).withColumn("p", F.col("p") - F.col("whole"))
    plain = expected.where("size = 0 or p = 0").withColumn(
        "p", (unit_draw("id", "source", "digest", seed=seed) < F.col("p")).cast("double"))
    kept = ("id", "digest", "size", "rows", "whole", "p")
    going = expected.where("size > 0 and p > 0").select("source", "source_size", "target", "items", *kept)
    decided = [plain.select("source", "source_size", "target", *kept)]
    left, level = largest, 0
    while True:
        buckets = F.ceil(F.col("items") / F.lit(float(bucket_items) ** (level + 1)))
        # long documents meet first, so that what is left over is short
        item = F.struct((-F.col("size")).alias("order"), unit_draw(F.lit("order"), "id", "source", "digest", seed=seed + level).alias("u"), *kept)
        met = (
            going.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id", "digest"), buckets.cast("long")))
            .withColumn("item", item)
            .groupBy("source", "source_size", "target", "items", "bucket").agg(F.sort_array(F.collect_list("item")).alias("all"))
        )
        item_type = met.schema["all"].dataType.elementType.simpleString()
        level_out = held(
            met.withColumn("state", _pivotal(F.col("all"), item_type))
            .select("source", "source_size", "target", "items", F.inline(F.concat(
                F.transform("state.done", lambda x: F.struct(F.lit(False).alias("is_open"), x.alias("item"))),
                F.filter(F.array(F.struct(F.lit(True).alias("is_open"), F.col("state.open").alias("item"))), lambda x: x["item"].isNotNull()),
            )))
            .select("source", "source_size", "target", "items", "is_open", "item.*"),
            "mix-level",
        )
        decided.append(level_out.where("not is_open").select("source", "source_size", "target", *kept))
        going = level_out.where("is_open").select("source", "source_size", "target", "items", *kept)
        left, level = math.ceil(left / bucket_items), level + 1
        if left <= 1:
            break
    last = going.withColumn("p", (unit_draw(F.lit("last"), "id", "source", "digest", seed=seed) < F.col("p")).cast("double"))
    decided.append(last.select("source", "source_size", "target", *kept))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select(
        "id", "source", "digest", "size", "rows", "source_size", "target",
        (F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0)).cast("long").alias("copies"),
    )


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.lit(7), text, F.length(text))


def row_share(ordinal: Column) -> Column:
    """Copies of the ``ordinal``-th (from 0) of equal rows: the shares differ by one at most."""
    return F.floor(F.col("copies") / F.col("rows")) + F.when(ordinal < F.col("copies") % F.col("rows"), 1).otherwise(0)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    digest, alias = free_name(docs, "mix_digest"), "mix_"
    marked = docs.withColumn(digest, text_digest(F.col(text_col)))
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    names = {c: free_name(marked, alias + c) for c in ("id", "source", "digest", "rows", "copies")}
    side = plan.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = marked.join(side, (
        marked[id_col].eqNullSafe(side[names["id"]]) & marked[source_col].eqNullSafe(side[names["source"]])
        & (marked[digest] == side[names["digest"]])
    ))
    ordinal = free_name(joined, "mix_ordinal")
    equal = Window.partitionBy(id_col, source_col, digest).orderBy(digest)
    share = F.floor(F.col(names["copies"]) / F.col(names["rows"])) + F.when(
        F.col(ordinal) <= F.col(names["copies"]) % F.col(names["rows"]), 1).otherwise(0)
    return (
        joined.withColumn(ordinal, F.row_number().over(equal))
        .withColumn(ordinal, F.explode(F.array_repeat(F.lit(0), share.cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"))
    return plan.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * row_share(F.col("ordinal"))).cast("long").alias("taken"),
    )
