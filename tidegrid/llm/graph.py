"""Connected groups of linked items, and links searched bucket by bucket without all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import drop_held, held

STAR_ROUNDS = 1
TASK_EDGES, LEAST_TASKS = 50_000, 6


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (a, b).

    Large-star and small-star steps in turn, until nothing changes: every node hangs on the
    least of its neighbourhood. Each round is written to the shared folder.
    """
    now = held(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        # edges never grow in number: tasks of a fixed size, however many partitions are set
        tasks = max(LEAST_TASKS, -(-state[0] // TASK_EDGES))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").coalesce(tasks).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(low, "a").coalesce(tasks).select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = held(small.select("e.*").where("a <> b").distinct().coalesce(tasks), "edges")
        drop_held(now)
        now, seen = after, state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def connect(buckets: DataFrame, nodes: DataFrame, closeness: Callable[[str, str], Column], bound: float,
            confirm: Callable[[DataFrame], DataFrame], *, finer: Callable[[str, str], Column] | None = None,
            late: tuple[str, ...] = (), star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """Edges (a, b) that join whatever is linked among nodes that share a bucket.

    ``buckets`` (key, node) names the candidates, ``nodes`` (node, further columns) what is
    known of each. ``closeness(a, b)``, from the columns of two nodes with these prefixes, must
    reach ``bound`` for every link (NULL: no link); ``confirm`` keeps the pairs that are links.
    ``finer`` is a sharper necessary condition for the last step, where the columns ``late`` of
    ``nodes`` come in.

    In a star round each bucket compares its members with one of them, drawn by hash; every
    component then tries its closest pair. Groups of copies grow together that way at one pair
    a round and component. What stays unknown is whether members of *different* components of a
    bucket are linked. At the end just those pairs are tried, in every bucket whose members lie in
    different components: only pairs that are close enough leave the join, each in the first of
    these buckets that it shares. So no two linked nodes that share a bucket stay apart, and no
    pairs are made inside a component.
    """
    facts = [c for c in nodes.columns if c not in ("node", *late)]
    light = nodes.drop(*late)
    members = held(buckets.join(light, "node"), "members")
    live, edges = members.withColumn("component", F.col("node")), None
    for turn in range(star_rounds):
        cols = ["node", "component", *facts]
        left = live.select("key", *[F.col(c).alias(f"a_{c}") for c in cols])
        draw = F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), *cols)
        first = live.groupBy("key").agg(F.min(draw).alias("f")).select("key", *[F.col(f"f.{c}").alias(f"b_{c}") for c in cols])
        tried = left.join(first, "key").where("a_component <> b_component").select(
            "a_component", "a_node", "b_node", closeness("a_", "b_").alias("close")).where(F.col("close") >= bound)
        best = tried.groupBy("a_component").agg(F.max(F.struct("close", "a_node", "b_node")).alias("p"))
        pairs = best.select(
            F.least("p.a_node", "p.b_node").alias("a"), F.greatest("p.a_node", "p.b_node").alias("b")).distinct()
        found = held(confirm(pairs), "links")
        edges = found if edges is None else edges.unionByName(found)
        marked = members.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # buckets of two stay as well: a component tries one pair a round, whatever buckets it has
        split = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        live = held(marked.join(split.where("lo <> hi").select("key"), "key", "left_semi"), "live")
    # the live buckets of a node alone: a pair must not wait for a bucket that is left out
    keys = live.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    left = live.join(keys, "node").join(nodes.select("node", *late), "node")
    left, right = (left.select("key", *[F.col(c).alias(f"{side}_{c}") for c in left.columns if c != "key"]) for side in "ab")
    first_shared = F.element_at(F.filter("a_keys", lambda k: F.array_contains("b_keys", k)), 1)
    rest = left.join(right, (
        (left["key"] == right["key"]) & (F.col("a_component") < F.col("b_component"))
        & (closeness("a_", "b_") >= bound) & (finer("a_", "b_") if finer else F.lit(True)) & (first_shared == left["key"])
    ))
    pairs = rest.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    return edges.unionByName(held(confirm(pairs), "links"))
