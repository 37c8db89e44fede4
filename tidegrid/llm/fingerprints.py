"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (``WORD`` of ``common``; a shorter text is one
shingle). The sketch keeps every distinct shingle hash below ``2**64 / scale``. The threshold is
the same for all texts, so sketches of parts merge by union, and

* containment of A in B is ``|A & B| / |A|`` over the kept hashes, however unequal A and B are;
* resemblance is ``|A & B| / |A | B|``, the likeness reported here.

A fingerprint is the text ``<distinct shingles>:<whole hash>:<kept hashes>``: the number of
distinct shingles, a hash of all their hashes, and the kept ones in ascending order, each of
sixteen hex digits. Where a sketch is empty (short texts) the whole hash still tells
equal sets from others: likeness is then 1 for equal whole hashes and 0 otherwise.

The edited text of a document takes its end from the next one. Documents are cut into ranges of
(id, text hash); the first document of each range is also dealt to the end of the range before
(the very first to the last), so each range streams through one task that holds two texts.

Defined cases: a NULL text is empty; an empty text has no shingles and equals other empty texts
only; a NULL id sorts first; equal ids follow each other by text hash; a table of one row is
its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import parts, table
from tidegrid.llm.hashing import shingle_hashes, text_bytes, word_hashes

WIDTH = 5
SCALE = 4


class Sketch:
    """The kept shingle hashes of one text (sorted), its number of shingles and their whole hash."""

    def __init__(self, text: str, width: int = WIDTH, scale: int = SCALE):
        hashes = np.unique(shingle_hashes(word_hashes(text_bytes(text)), width))
        self.n = len(hashes)
        self.whole = hashlib.blake2b(hashes.tobytes(), digest_size=8).hexdigest()
        self.kept = hashes[: np.searchsorted(hashes, np.uint64(2**64 // scale))] if scale > 1 else hashes

    def fingerprint(self) -> str:
        return f"{self.n}:{self.whole}:{self.kept.astype('>u8').tobytes().hex()}"


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated resemblance, 0 to 1."""
    if a.whole == b.whole:
        return 1.0
    common, every = _common(a, b)
    return common / every if every else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """The estimated share of a's shingles that b has."""
    if a.whole == b.whole:
        return 1.0
    common, _ = _common(a, b)
    return common / len(a.kept) if len(a.kept) else 0.0


def _common(a: Sketch, b: Sketch) -> tuple[int, int]:
    common = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return common, len(a.kept) + len(b.kept) - common


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 scale: int = SCALE) -> DataFrame:
    """id, fingerprint of every row."""
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [Sketch(t if isinstance(t, str) else "", width, scale).fingerprint() for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "fingerprint": marks})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(sketch, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of ``text`` replaced by as much of the start of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, part, last: rows dealt by ranges of (id, text hash) and sorted in them; the row
    that follows a range stands at its end with ``last`` set."""
    spark = docs.sparkSession
    place = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"))
    # the first place of every range: one row per partition comes to the driver
    firsts = (
        docs.select(place.alias("place")).repartitionByRange(parts(spark), "place")
        .groupBy(F.spark_partition_id()).agg(F.min("place").alias("first")).select("first.*").distinct().collect()
    )
    firsts.sort(key=lambda r: (r["id"] is not None, r["id"] or 0, r["tie"]))
    bounds = F.array(*[
        F.struct(F.lit(r["id"]).cast("long").alias("id"), F.lit(r["tie"]).cast("long").alias("tie")) for r in firsts
    ] or [F.lit(None).cast("struct<id:bigint,tie:bigint>")])
    dealt = docs.select(place.alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), bounds.alias("bounds")) \
        .withColumn("part", F.expr("size(filter(bounds, b -> b <= place))"))
    n = F.size("bounds")
    # duplicates of a range's first place are equal rows; the one that goes back may be any of them
    first = F.element_at("bounds", F.greatest("part", F.lit(1))) == F.col("place")
    before = F.when(F.col("part") == 1, n).otherwise(F.col("part") - 1)
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))
    there = F.struct(before.cast("int").alias("part"), F.lit(True).alias("last"))
    return (
        dealt.withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
        .select("place.id", "place.tie", "text", "to.part", "to.last")
        .repartition(parts(spark), "part").sortWithinPartitions("part", "last", "id", "tie")
    )


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 scale: int = SCALE) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses and containments."""
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, edited_has double, next_has double"
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_row = None
        for batch in batches:
            rows = []
            for doc_id, text, part, last in zip(batch["id"], batch["text"], batch["part"], batch["last"]):
                mine = Sketch(text, width, scale)
                if held_row is not None and held_row[2] == part:
                    rows.append(_pair(*held_row[:2], held_row[3], text, mine, width, scale))
                # of equal rows that follow a range only the first counts
                held_row = None if last else (doc_id, text, part, mine)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    return in_ranges(docs, id_col, text_col).select("id", "text", "part", "last").mapInPandas(compare, schema)


def _pair(doc_id, text: str, mine: Sketch, following: str, its: Sketch, width: int, scale: int) -> tuple:
    new_text = edited(text, following)
    new = Sketch(new_text, width, scale)
    return (
        None if pd.isna(doc_id) else int(doc_id), len(text), hashlib.sha256(new_text.encode("utf-8", "surrogatepass")).hexdigest(),
        mine.fingerprint(), new.fingerprint(), likeness(mine, new), likeness(mine, its), containment(mine, new), containment(mine, its),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
