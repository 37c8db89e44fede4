"""Ranked lexical search of stated items over all documents, with bags scored once.

The items name a vocabulary; of a document only the occurrences of its words count, and the length.
So documents fall into classes of equal (term frequency vector over the vocabulary, length factor
m), and a class has one score per item.

* One scan turns each text into its number of terms and its vector, packed as (word, occurrences)
  pairs of 32-bit numbers (``terms.Vocabulary`` finds words by hash and compares their bytes).
* Corpus statistics follow from that table: documents, terms, and documents per word.
* Classes are grouped by a hash and verified on the vector itself. Of a class only the ``k``
  smallest ids can be ranked, so each task passes on at most ``k`` rows of a class: a class that
  holds a third of all rows does not gather anywhere.
* Each class is scored once against all items, as a product of a (classes x words) and a (words x
  items) matrix in exact integers. A task keeps the ``k`` best classes of every item, by score and
  smallest id: any document among the k best lies in one of them.
* Members are expanded by ascending id and ranked per item.

Items are taken in blocks of ``ITEM_BLOCK`` (expected size, dealt by hash), so what travels to
tasks is bounded by a block however many items there are; every block meets all documents.

Defined cases: NULL or empty texts and texts without terms have no terms and count nowhere;
repeated rows are documents of their own; a row without id counts in the statistics but cannot be
named, so it is not ranked; item rows of equal id are one item with the words of all; an item
without words or without a match gives no rows; ties go to the smaller id; very long texts are
read piece by piece; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import held, table
from tidegrid.llm.terms import LETTERS_DIGITS, SLICE_BYTES, Vocabulary, lowered, pieces, slices, text_buffer, word_column, words

BEST = 10
ITEM_BLOCK = 512
CLASS_ROWS = 1024
_EXACT = 2**53
_FOUND = "item int, score bigint, members array<bigint>"


def text_terms(text: str | None) -> set[bytes]:
    """The distinct terms of one text."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, lengths, _ = words(raw, np.array([0, len(raw)]), LETTERS_DIGITS)
    return {w.encode() for w in word_column(lowered(raw), starts, lengths).to_pylist()}


def _bags(raw: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; (text, word) codes that occur, and how often."""
    padded = lowered(raw)
    starts, lengths, texts = words(raw, offsets, LETTERS_DIGITS)
    number = vocabulary.numbers(padded, starts, lengths)
    hit = number >= 0
    return np.bincount(texts, minlength=len(offsets) - 1), *np.unique(texts[hit] * size + number[hit], return_counts=True)


def bags(docs: DataFrame, listed: list[bytes], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n (terms of the text) and bag (its vector over the ``listed`` words) for every row."""
    size = max(1, len(listed))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(listed)
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in slices(offsets, slice_bytes):
                some, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if b == a + 1 and len(some) > slice_bytes:
                    n, total = np.zeros(1, dtype=np.int64), np.zeros(size, dtype=np.int64)
                    for piece in pieces(some, slice_bytes, LETTERS_DIGITS):
                        found = _bags(piece, np.array([0, len(piece)]), vocabulary, size)
                        n += found[0]
                        total[found[1]] += found[2]
                    codes = np.flatnonzero(total)
                    tf = total[codes]
                else:
                    n, codes, tf = _bags(some, at, vocabulary, size)
                data = np.stack([codes % size, tf], axis=1).astype("<u4")
                cuts = (np.searchsorted(codes, np.arange(b - a + 1) * size) * 8).astype(np.int32)
                bag = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), bag], names=["doc_id", "n", "bag"])

    return docs.select("doc_id", "text").mapInArrow(vectors, "doc_id bigint, n bigint, bag binary")


def _pairs(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, 2) words and occurrences of many bags, and the bag of each row."""
    flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64).reshape(-1, 2)
    return flat, np.repeat(np.arange(len(packed)), [len(b) // 8 for b in packed])


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each word of the vocabulary; one number a word comes to the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_pairs(list(batch["bag"]))[0][:, 0], minlength=size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"word": used, "df": total[used]})

    out = np.zeros(size, dtype=np.int64)
    counted = found.select("bag").where(F.length("bag") > 0).mapInPandas(count, "word int, df bigint")
    for word, df in counted.groupBy("word").agg(F.sum("df")).collect():
        out[word] = df
    return out


class BestClasses:
    """The k best classes of one item so far: higher scores first, then smaller first ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def bar(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, scores: np.ndarray, firsts: np.ndarray, members: list) -> None:
        good = np.flatnonzero(scores >= self.bar)
        if len(good) > self.k:
            good = good[np.lexsort((firsts[good], -scores[good]))[: self.k]]
        new = [(-int(scores[i]), int(firsts[i]), members[i]) for i in good]
        self.rows = sorted(self.rows + new, key=lambda r: r[:2])[: self.k] if new else self.rows


def class_scores(flat: np.ndarray, of: np.ndarray, m: np.ndarray, weights: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """(classes, items) scores: sums of w * ((10^9 tf) div (1000 tf + 8 m)) over an item's words."""
    used, column = np.unique(flat[:, 0], return_inverse=True)
    part = weights[flat[:, 0]] * ((1_000_000_000 * flat[:, 1]) // (1000 * flat[:, 1] + 8 * m[of]))
    # whole numbers in doubles are exact, and multiply fast, as long as no sum can pass 2^53
    kind = np.float64 if int(part.max(initial=0)) * len(used) < _EXACT else np.int64
    dense = np.zeros((len(m), len(used)), dtype=kind)
    dense[of, column] = part
    return (dense @ holds[used].astype(kind)).astype(np.int64)


def search_classes(classes: DataFrame, weights: np.ndarray, holds: np.ndarray, k: int) -> DataFrame:
    """item, score, members: the k best classes of every item in each task, from (m, bag, members)."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [BestClasses(k) for _ in range(holds.shape[1])]
        for batch in batches:
            for start in range(0, len(batch), CLASS_ROWS):
                some = batch.iloc[start : start + CLASS_ROWS]
                flat, of = _pairs(list(some["bag"]))
                scores = class_scores(flat, of, some["m"].to_numpy(), weights, holds)
                members = list(some["members"])
                firsts = np.array([x[0] for x in members], dtype=np.int64)
                top = scores.max(axis=0, initial=0)
                for item in np.flatnonzero(top >= [b.bar for b in best]):
                    best[item].offer(scores[:, item], firsts, members)
        rows = [(item, -r[0], r[2]) for item, b in enumerate(best) for r in b.rows]
        yield pd.DataFrame(rows, columns=["item", "score", "members"])

    return classes.select("m", "bag", "members").mapInPandas(search, _FOUND)


def _block(docs: DataFrame, items: list[tuple], k: int, slice_bytes: int) -> DataFrame:
    """item_id, rank, doc_id, score for a bounded list of (item_id, terms)."""
    spark = docs.sparkSession
    listed = sorted(set().union(*[terms for _, terms in items]))
    number = {w: i for i, w in enumerate(listed)}
    holds = np.zeros((max(1, len(listed)), len(items)), dtype=np.uint8)
    for column, (_, terms) in enumerate(items):
        holds[[number[w] for w in terms], column] = 1
    found = held(bags(docs, listed, slice_bytes), "lexical-bags")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(found, len(holds))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    whole = lambda x: f"CAST({x} AS DECIMAL(19,0))"
    m = F.expr(f"100 - 90 + ({whole(f'{90 * n_docs}')} * {whole('n')}) div {whole(max(1, n_terms))}")
    bagged = found.where((F.length("bag") > 0) & F.col("doc_id").isNotNull()).select("doc_id", m.alias("m"), "bag")
    # a hash finds equal classes, the vectors behind it decide
    keys = ["hash", "m", "bag"]
    members = Window.partitionBy(*keys).orderBy("doc_id")
    classes = (
        bagged.withColumn("hash", F.xxhash64("bag", "m")).withColumn("nth", F.row_number().over(members)).where(F.col("nth") <= k)
        .groupBy(*keys).agg(F.sort_array(F.collect_list("doc_id")).alias("members"))
    )
    best = search_classes(classes, weights, holds, k)
    rank = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = (
        best.select("item", "score", F.explode("members").alias("doc_id"))
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    )
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id bigint")
    # at most one block of items
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", item_block: int = ITEM_BLOCK,
           slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, scores above 0 alone."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = items.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    blocks = max(1, -(-items.count() // item_block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        terms: dict[int | None, set[bytes]] = {}
        for item_id, text, _ in dealt.where(F.col("block") == block).toLocalIterator():
            terms.setdefault(item_id, set()).update(text_terms(text))
        part = _block(docs, sorted(terms.items(), key=repr), k, slice_bytes)
        out = part if out is None else out.unionByName(part)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc, doc_id, term, count(*) AS tf FROM (
    SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)) GROUP BY ALL),
n AS (SELECT doc, sum(tf)::BIGINT AS n FROM t GROUP BY doc),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc), s GROUP BY item_id, doc, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
