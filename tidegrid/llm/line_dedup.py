"""Fuzzy line dedup over all documents.

Lines are the parts of a text between line feeds. The normal form of a line has A-Z lower-cased,
digits as 0, ASCII punctuation dropped and white space made single blanks. Lines of one normal
form are one class. Classes are linked when their SimHashes (64 bits over the
distinct longer words) differ in at most ``distance`` bits and the edit similarity of their normal forms, 1 - edits / longer
length, is at least ``percent`` hundredths. Of every connected group of classes one occurrence
stays: the first by (id, text hash, line number).

* SimHash is cut into ``distance + 2`` blocks. Two hashes within the distance agree in two
  blocks at least, so every pair of blocks is one key, and no such pair is missed.
* Keys are made of the distinct hashes alone, two numbers each; classes come in for the few
  keys that more than one class has.
* ``graph.connect`` goes through those without all pairs of a bucket and confirms links with
  the edit distance on the whole normal forms. A series of edits that is short enough proves a link;
  only pairs for which none is found at sight have their least number of edits worked out.

Defined cases: lines without letters or digits are never removed; a NULL text has no lines; rows
of equal id and text count as one document; a NULL id comes first; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, held, small_batches, table
from tidegrid.llm.graph import components, connect
from tidegrid.llm.hashing import word_hashes

DISTANCE = 3
PERCENT = 80
BITS = 64
_TO = bytes(
    c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if 9 <= c <= 13 and c != 10 else c for c in range(256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
BROADCAST_ROWS = 500_000


def normal_lines(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass").translate(_TO, _PUNCTUATION)
    return [b" ".join(line.split()) for line in data.split(b"\n")]


def _content(line: bytes) -> list[bytes]:
    """The distinct words of more than four bytes; all distinct words where there are none.

    Short words stand in every line of a language and would make unlike lines alike.
    """
    words = set(line.split())
    return [w for w in words if len(w) > 4] or list(words)


def simhashes(lines: list[bytes]) -> np.ndarray:
    """The SimHash of every line; lines must have words."""
    content = [_content(line) for line in lines]
    counts = np.array([len(words) for words in content])
    words = word_hashes(b" ".join([b" ".join(words) for words in content]))
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)


def line_table(docs: DataFrame) -> DataFrame:
    """id, text_key, line_no, node, sim, norm of every line with words (``docs``: id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts become Python strings a few at a time
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                kept = [
                    (i, no, line) for i, text in enumerate(some.column("text").to_pylist()) if text is not None
                    for no, line in enumerate(normal_lines(text)) if line
                ]
                if kept:
                    rows, numbers, norm = zip(*kept)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([
                        some.column("id").take(at), some.column("text_key").take(at), pa.array(numbers, pa.int32()),
                        pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in norm], pa.binary()), pa.array(simhashes(norm)),
                        pa.array([x.decode("utf-8", "replace") for x in norm], pa.string())],
                        names=["id", "text_key", "line_no", "node", "sim", "norm"])

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(
        lines, f"id {kind}, text_key bigint, line_no int, node binary, sim bigint, norm string")


def block_masks(distance: int) -> list[int]:
    """Masks of every pair of ``distance + 2`` blocks of a 64-bit hash."""
    cuts = [round(BITS * k / (distance + 2)) for k in range(distance + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(distance: int) -> Column:
    """One key for every pair of blocks of ``sim``."""
    return F.array(*[
        F.xxhash64(F.lit(t), F.col("sim").bitwiseAND(F.lit(m))) for t, m in enumerate(block_masks(distance))
    ])


ANCHOR = 8


def edits_found(a: str, b: str, bound: int) -> int:
    """The length of some series of edits from ``a`` to ``b``, never less than the edit distance.

    Common runs are followed; where they end, the next anchor of ``a`` that stands in ``b`` at most
    as far on as ``bound`` allows goes on. What is beyond ``bound`` is not searched for.
    """
    i = j = edits = 0
    while i < len(a) and j < len(b) and edits <= bound:
        step = 64
        while step:
            if i + step <= len(a) and j + step <= len(b) and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
            else:
                step >>= 1
        left = bound - edits
        for skip in range(min(left, len(a) - i - ANCHOR) + 1):
            at = b.find(a[i + skip : i + skip + ANCHOR], j, j + left + ANCHOR)
            if at >= 0:
                edits += max(skip, at - j)
                i, j = i + skip, at
                break
        else:
            break
    return edits + max(len(a) - i, len(b) - j)


def _sure(a: str, b: str, percent: int) -> Column:
    """True where edits are found that keep the similarity at ``percent``; not False for certain otherwise."""
    @F.pandas_udf("boolean")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        bounds = [(100 - percent) * max(len(p), len(q)) // 100 for p, q in zip(x, y)]
        return pd.Series([edits_found(p, q, n) <= n for p, q, n in zip(x, y, bounds)], dtype="bool")

    return found(a, b)


def line_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                percent: int = PERCENT) -> DataFrame:
    """id, text_key, line_no, first_id, first_key, first_line, kept of every line with words."""
    small_batches(docs.sparkSession)
    lines = held(line_table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "lines")
    sims = lines.select("sim", "node").distinct().groupBy("sim").agg(F.count("*").alias("classes"))
    keys = held(sims, "sims").select("sim", "classes", F.explode(_keys(distance)).alias("key"))
    # the hashes of a key meet once, sorted: a table of all keys beside them would be as long as they are
    of_key = Window.partitionBy("key")
    beside = {"n": F.sum("classes"), "sims": F.count("*"), "lo": F.min("sim"), "hi": F.max("sim")}
    # where just two hashes of one class each share a key, their distance decides at once
    close = held(
        keys.withColumns({name: found.over(of_key) for name, found in beside.items()})
        .where(f"n > 1 and (sims > 2 or n > sims or bit_count(lo ^ hi) <= {distance})").select("key", "sim"), "close")
    near_sims = close.select("sim").distinct()
    few = near_sims.count() <= BROADCAST_ROWS
    texts = held(
        lines.select("node", "sim", "norm").join(F.broadcast(near_sims) if few else near_sims, "sim", "left_semi")
        .dropDuplicates(["node"]), "line-texts")
    nodes = texts.select("node", "sim", F.length("norm").alias("n"))
    buckets = close.join(nodes.select("sim", "node"), "sim").select("key", "node")

    def closeness(a: str, b: str) -> Column:
        alike = 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
        return F.when(alike, -F.bit_count(F.col(f"{a}sim").bitwiseXOR(F.col(f"{b}sim"))))

    def confirm(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("norm").alias("a_norm"))
        b = texts.select(F.col("node").alias("b"), F.col("norm").alias("b_norm"))
        longer = "greatest(length(a_norm), length(b_norm))"
        within = lambda share: f"levenshtein(a_norm, b_norm, cast(floor({share} * {longer} / 100) as int)) >= 0"
        # the work grows with the bound: most pairs are decided by a narrow one
        narrow = [x for x in (1, 5) if x < 100 - percent]
        close = F.expr(" OR ".join(f"({within(x)})" for x in (*narrow, 100 - percent)))
        return pairs.join(a, "a").join(b, "b").where(_sure("a_norm", "b_norm", percent) | close).select("a", "b")

    groups = components(connect(buckets, nodes, closeness, -distance, confirm))
    placed = (
        lines.select("id", "text_key", "line_no", "node").join(groups, "node", "left")
        .select("id", "text_key", "line_no", F.coalesce("component", "node").alias("grp"))
    )
    first = placed.groupBy("grp").agg(F.min(F.struct("id", "text_key", "line_no")).alias("first"))
    return placed.join(first, "grp").select(
        F.col("id").alias(id_col), "text_key", "line_no", F.col("first.id").alias("first_id"),
        F.col("first.text_key").alias("first_key"), F.col("first.line_no").alias("first_line"),
        (F.struct("id", "text_key", "line_no") == F.col("first")).alias("kept"),
    )


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                    drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` with the lines that are repeats taken out of their texts.

    ``length_col`` is set to the new length in characters where it is named. With
    ``drop_emptied`` a document all of whose words were repeats goes; others stay, empty ones too.
    """
    gone = (
        line_groups(docs, id_col=id_col, text_col=text_col, **options).where("not kept").distinct()
        .groupBy(id_col, "text_key").agg(F.collect_set("line_no").alias("gone"))
    )
    names = {c: free_name(docs, f"line_{c}") for c in ("id", "text_key", "gone")}
    side = gone.select(F.col(id_col).alias(names["id"]), F.col("text_key").alias(names["text_key"]), F.col("gone").alias(names["gone"]))
    joined = docs.join(side, docs[id_col].eqNullSafe(side[names["id"]]) & (F.xxhash64(docs[text_col]) == side[names["text_key"]]), "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, no: ~F.array_contains(names["gone"], no))
    changed = F.col(names["gone"]).isNotNull()
    out = joined.withColumn(text_col, F.when(changed, F.array_join(left, "\n")).otherwise(F.col(text_col)))
    if drop_emptied:
        out = out.where(~changed | F.col(text_col).rlike(r"[^\s\p{Punct}]"))
    if length_col:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "line_no", F.col("first_id").alias("first_doc_id"), F.col("first_line").alias("first_line_no"), "kept")
