"""b-bit MinHash near-duplicate groups.

A document's set holds its distinct shingles (runs of ``width`` words, A-Z lower-cased; the
whole sequence where it is shorter). Two documents are linked when the Jaccard similarity of
their sets is at least ``percent`` hundredths.

* Documents of equal sets are one class; everything further works on classes.
* Every class gets ``bands * rows`` minima. Bands of full minima give candidate keys; the two
  low bits of every minimum are packed into two bit planes as the signature. Two planes are
  compared by xor and bit counts; unequal minima agree in two bits in a quarter of the cases,
  so similarity is estimated as ``(matches - 1/4) / (3/4)``. Candidates whose estimate is more
  than four standard deviations under the limit, or whose sizes rule the limit out, are dropped.
* ``graph.connect`` tries candidates bucket by bucket, without all pairs of a bucket, and
  confirms each link on the full sets. With 48 bands of 6 rows a link at the limit is missed by
  the bands with probability 5e-7.
* Full sets are formed again from the texts of those classes only that share a key, and with
  them signatures of 4,096 minima, which leave few pairs below the limit to be confirmed (their
  bound lies four and a half standard deviations under the limit).

Defined cases: a NULL text, or one without words, has an empty set, is linked with nothing and
is its own group; each input row is a document of its own, also where ids repeat; a NULL id
counts as the largest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, held, small_batches, table
from tidegrid.llm.graph import components, connect
from tidegrid.llm.hashing import mix64, shingle_hashes, text_bytes, word_hashes

BANDS, ROWS = 48, 6
WIDTH, PERCENT = 5, 80
SLACK = 0.12
#: Minima of the wide signatures (groups, rows), and how far below the limit their estimates may be.
WIDE, WIDE_SLACK = (512, 8), 0.033
BROADCAST_ROWS = 500_000
_COLUMNS = 128


class MinHasher:
    """Minima of ``count`` hash functions over a set of shingle hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.bands, self.rows = bands, rows
        seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32)).astype(np.uint32)
        self.flip = seeds[: bands * rows, None]
        self.factor = seeds[bands * rows :, None] | np.uint32(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.bands * self.rows, np.uint32(2**32 - 1), dtype=np.uint32)
        for start in range(0, len(x), _COLUMNS):
            part = x[None, start : start + _COLUMNS] ^ self.flip
            part *= self.factor
            np.minimum(best, part.min(axis=1), out=best)
        return best

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        grid = minima.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
        return key.view(np.int64)

    def planes(self, minima: np.ndarray) -> np.ndarray:
        """The lowest and the second lowest bits of all minima, each packed into 64-bit words."""
        words = -(-len(minima) // 64)
        out = np.zeros((2, words * 64), dtype=np.uint8)
        out[0, : len(minima)], out[1, : len(minima)] = minima & 1, (minima >> 1) & 1
        return np.packbits(out, axis=1, bitorder="little").view(np.int64).reshape(-1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text_bytes(text, lower=True)), width))


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _clean(text) -> str:
    return text if isinstance(text, str) else ""


def sketches(docs: DataFrame, width: int, hasher: MinHasher) -> DataFrame:
    """id, text_key, n, node (name of the set), keys, planes of every row."""
    kind = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = shingle_set(_clean(text), width)
                if len(shingles):
                    minima = hasher.minima(shingles)
                    rows.append((len(shingles), set_name(shingles), hasher.keys(minima), hasher.planes(minima)))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n", "node", "keys", "planes"], index=batch.index)
            yield pd.concat([batch[["id", "text_key"]], out], axis=1)

    return docs.withColumn("text_key", F.xxhash64("text")).mapInPandas(
        sketch, f"id {kind}, text_key bigint, n bigint, node binary, keys array<bigint>, planes array<bigint>")


def estimate(a: str, b: str, count: int) -> Column:
    """Similarity from two pairs of bit planes, corrected for chance agreement."""
    words = -(-count // 64)
    unequal = sum(
        (F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]).bitwiseOR(F.col(a)[k + words].bitwiseXOR(F.col(b)[k + words])))
         for k in range(words)), F.lit(0))
    matches = 1 - unequal / F.lit(float(count))
    return (matches - 0.25) / 0.75


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, grams, wide for the texts whose ``text_key`` is in ``wanted`` (text_key, node)."""
    hasher = MinHasher(*WIDE, seed=23)
    few = wanted.count() <= BROADCAST_ROWS
    keys = wanted.select("text_key").distinct()
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(F.broadcast(keys) if few else keys, "text_key", "left_semi")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(_clean(t), width) for t in batch["text"]]
            yield pd.DataFrame({
                "node": [set_name(s) for s in sets], "grams": [s.view(np.int64) for s in sets],
                "wide": [hasher.planes(hasher.minima(s)) for s in sets],
            })

    # equal texts give equal rows
    return texts.select("text").mapInPandas(grams, "node binary, grams array<bigint>, wide array<bigint>").dropDuplicates(["node"])


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id, and text_key and the group's name (NULL where it is alone) of every row."""
    small_batches(docs.sparkSession)
    hasher = MinHasher(bands, rows)
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = held(sketches(rows_in, width, hasher), "sketches")
    classes = marks.where("n > 0").dropDuplicates(["node"])
    by_key = classes.select(F.explode("keys").alias("key"), "node")
    shared = by_key.groupBy("key").count().where("count > 1").select("key")
    buckets = held(by_key.join(shared, "key"), "buckets")
    nodes = held(classes.join(buckets.select("node").distinct(), "node", "left_semi"), "nodes")
    sets = held(_sets(rows_in, nodes.select("text_key", "node"), width), "sets")

    def closeness(a: str, b: str) -> Column:
        small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
        return F.when(small * 100 >= large * percent, estimate(f"{a}planes", f"{b}planes", bands * rows))

    def confirm(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("grams").alias("a_grams"))
        b = sets.select(F.col("node").alias("b"), F.col("grams").alias("b_grams"))
        both = F.size(F.array_intersect("a_grams", "b_grams"))
        return pairs.join(a, "a").join(b, "b").where(
            100 * both >= percent * (F.size("a_grams") + F.size("b_grams") - both)).select("a", "b")

    def finer(a: str, b: str) -> Column:
        return estimate(f"{a}wide", f"{b}wide", WIDE[0] * WIDE[1]) >= percent / 100 - WIDE_SLACK

    facts = nodes.select("node", "n", "planes").join(sets.select("node", "wide"), "node")
    links = connect(buckets, facts, closeness, percent / 100 - SLACK, confirm, finer=finer, late=("wide",))
    groups = components(links)
    first = marks.where("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    ids = first.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("first").alias("component_id"))
    named = ids.join(least, "component").select("node", "component_id", F.col("component").alias("grp"))
    return marks.select("id", "n", "node", "text_key").join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        "text_key", "grp")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group: the smallest by (id, hash of the text).

    Rows without words are no copies and all stay.
    """
    groups = held(near_groups(docs, id_col=id_col, text_col=text_col, **options), "groups")
    names = {c: free_name(docs, f"near_{c}") for c in ("id", "key", "n")}
    first = groups.where("n_shingles > 0").groupBy("grp").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_key")).alias("f"))
    chosen = first.select("f.id", "f.text_key", F.lit(1).alias("n")).unionByName(
        groups.where("n_shingles = 0").select(F.col(id_col).alias("id"), "text_key", F.lit(0).alias("n")).distinct())
    side = chosen.toDF(names["id"], names["key"], names["n"])
    joined = docs.join(side, docs[id_col].eqNullSafe(side[names["id"]]) & (F.xxhash64(docs[text_col]) == side[names["key"]]))
    repeated = not groups.where("n_shingles > 0").groupBy(id_col, "text_key").count().where("count > 1").isEmpty()
    if repeated:
        # equal rows (same id and text) stand side by side after the join
        equal = Window.partitionBy(names["id"], names["key"]).orderBy(names["n"])
        joined = joined.withColumn(names["n"], F.col(names["n"]) * F.row_number().over(equal)).where(F.col(names["n"]) <= 1)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), width=2)
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
