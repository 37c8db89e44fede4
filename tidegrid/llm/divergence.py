"""Source divergence audit: how the words of each source differ from those of the others.

Words are counted by sorting pointers: a task lays the texts of a slice behind each other, ordered
by (language, source), and sorts pointers to the starts of their words by a multikey quicksort
(``terms.sort_words``). In a run of equal pointers the sources and documents lie in order, so its
length and its changes give the occurrences and documents of every source. Slices leave as
(language, source, word, occurrences, documents) and are summed by Spark.

Each language keeps the words that stand in enough of its documents. A source gives each kept word
a smoothed share p in parts of ``SCALE``, words it never uses included. Two shares differ by
``f = floor((p - q)^2 / (p + q))``.

Every pair of sources of a language is summed over all kept words without a row per word and pair.
With z the share of a word that is not there, the sum is

    over words of g: f(p, z_h)  +  over words of h: f(z_g, p)  +  (V - words of g - words of h) f(z_g, z_h)
    +  over words of both: f(p_g, p_h) - f(p_g, z_h) - f(z_g, p_h) + f(z_g, z_h)

The first sums come from histograms of p; the last one is added up inside tasks, over words dealt
by hash, in tiles of ``TILE`` by ``TILE`` sources, so a task holds one tile whatever the number of
sources.

Defined cases: NULL text, language or source is the empty string; a repeated row is a document of
its own; a document without words counts for its group only; a language without kept words has
pairs of value 0 and no word rows; ties go to the smaller item in the order of UTF-8; very long
texts are counted piece by piece; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import held, table
from tidegrid.llm.terms import LETTERS, SLICE_BYTES, lowered, pieces, slices, sort_words, text_buffer, word_column, words

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
TILE = 256
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _long_text(raw: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray]:
    """The words of one long text and their numbers."""
    seen: dict[str, int] = {}
    for piece in pieces(raw, most, LETTERS):
        padded = lowered(piece)
        starts, lengths, _ = words(piece, np.array([0, len(piece)]), LETTERS)
        order, first = sort_words(padded, starts, lengths)
        heads = np.flatnonzero(first)
        some = order[heads]
        for word, n in zip(word_column(padded, starts[some], lengths[some]).to_pylist(), np.diff(np.append(heads, len(order))).tolist()):
            seen[word] = seen.get(word, 0) + n
    return pa.array(list(seen), pa.string()), np.array(list(seen.values()), dtype=np.int64)


def _slice_counts(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Word, group, occurrences and documents of a slice of texts, whose groups are given."""
    padded = lowered(raw)
    starts, lengths, texts = words(raw, offsets, LETTERS)
    by_group = np.argsort(group[texts], kind="stable")
    starts, lengths, texts = starts[by_group], lengths[by_group], texts[by_group]
    order, first = sort_words(padded, starts, lengths)
    texts = texts[order]
    groups = group[texts]
    changed = lambda x: first | np.append(True, x[1:] != x[:-1])[: len(first)]
    heads = np.flatnonzero(changed(groups))
    if not len(heads):
        return pa.array([], pa.string()), heads, heads, heads
    docs = np.add.reduceat(changed(texts).astype(np.int64), heads)
    some = order[heads]
    return word_column(padded, starts[some], lengths[some]), groups[heads], np.diff(np.append(heads, len(order))), docs


def word_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n, docs of each slice of ``docs`` (text, lang, source, none of them NULL)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            n_sources = max(1, len(source.dictionary))
            code = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
            for a, b in slices(offsets, slice_bytes):
                some, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if b == a + 1 and len(some) > slice_bytes:
                    term, n = _long_text(some, slice_bytes)
                    groups, in_docs = np.full(len(n), code[a]), np.ones(len(n), dtype=np.int64)
                else:
                    term, groups, n, in_docs = _slice_counts(some, at, code[a:b])
                if len(n):
                    yield pa.RecordBatch.from_arrays([
                        lang.dictionary.take(pa.array(groups // n_sources)), source.dictionary.take(pa.array(groups % n_sources)),
                        term, pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    return docs.select("text", "lang", "source").mapInArrow(count, _COUNTS)


def share(n: str, total: str, kinds: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kinds)); 1 where no word is kept."""
    whole = lambda x: f"CAST({x} AS DECIMAL(20,0))"
    return F.expr(f"1 + ({whole(SCALE)} * {whole(f'{n} + 2')}) div {whole(f'greatest(1, {total} + 2 * {kinds})')}")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_words(docs: DataFrame, least_documents: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n, lang_n for every kept word of every source that uses it.

    ``lead`` marks one row of each kept word of a language.
    """
    # dealt by (language, word) once: the sums of a source, of a language and the marks need no other shuffle
    slices_ = word_counts(docs, slice_bytes).repartition("lang", "term")
    sums = slices_.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_word = Window.partitionBy("lang", "term")
    return (
        sums.withColumns({
            "lang_n": F.sum("n").over(of_word), "in_docs": F.sum("docs").over(of_word),
            "lead": F.col("source") == F.min("source").over(of_word)})
        .where(F.col("in_docs") >= least_documents).drop("docs", "in_docs")
    )


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile_sums(rows: pd.DataFrame, sums: dict[tuple[int, int], int]) -> None:
    """Add the terms that two sources share, for whole words of one tile, to ``sums``."""
    slot, slots = np.unique(rows["slot"].to_numpy(), return_inverse=True)
    word = np.unique(rows["term"].to_numpy(), return_inverse=True)[1]
    p = np.zeros((word.max() + 1, len(slot)), dtype=np.int64)
    p[word, slots] = rows["p"].to_numpy()
    z = np.ones(len(slot), dtype=np.int64)
    z[slots] = rows["z"].to_numpy()
    for i in range(len(slot)):
        mine = p[p[:, i] > 0]
        own = mine[:, i, None]
        part = _f(own, np.maximum(mine, 1)) - _f(own, z) - _f(z[i], np.maximum(mine, 1)) + _f(z[i], z)
        for j, value in enumerate(np.where(mine > 0, part, 0).sum(axis=0).tolist()):
            if j != i and value:
                sums[slot[i], slot[j]] = sums.get((slot[i], slot[j]), 0) + value


def shared_sums(rows: DataFrame) -> DataFrame:
    """lang, a, b, shared: the sum over the words of both for pairs of sources of a language, by number.

    ``rows``: lang, term, gid (number of the source), p, z, n_groups.
    """
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, sums, rest = None, {}, None

        def out() -> pd.DataFrame:
            lang, low, high = tile
            base = lambda s: low * TILE + s if s < TILE else high * TILE + s - TILE
            # a tile of two blocks gives the pairs across them only; each block has a tile of its own
            found = [(lang, base(a), base(b), v) for (a, b), v in sums.items() if low == high or (a < TILE) != (b < TILE)]
            return pd.DataFrame(found, columns=["lang", "a", "b", "shared"])

        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch])
            # the last word may go on in the next batch
            last = batch.iloc[-1]
            open_ = (batch["term"] == last["term"]) & (batch["low"] == last["low"]) & (batch["high"] == last["high"]) & (batch["lang"] == last["lang"])
            rest = batch[open_]
            for at, rows_ in batch[~open_].groupby(["lang", "low", "high"], sort=False):
                if at != tile:
                    if sums:
                        yield out()
                    tile, sums = at, {}
                _tile_sums(rows_, sums)
        if rest is not None:
            at = tuple(rest.iloc[0][["lang", "low", "high"]])
            if at != tile:
                if sums:
                    yield out()
                tile, sums = at, {}
            _tile_sums(rest, sums)
            if sums:
                yield out()

    block = (F.col("gid") / TILE).cast("int")
    other = F.explode(F.sequence(F.lit(0), ((F.col("n_groups") - 1) / TILE).cast("int")))
    tiled = (
        rows.withColumn("block", block).withColumn("other", other)
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("slot", F.col("gid") % TILE + F.when(F.col("block") > F.col("low"), TILE).otherwise(0))
        .select("lang", "low", "high", "term", "slot", "p", "z")
    )
    dealt = tiled.repartition("lang", "term").sortWithinPartitions("lang", "low", "high", "term")
    parts = dealt.mapInPandas(add_up, "lang string, a bigint, b bigint, shared bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: each source against every other one of its language
    (part ``pair``), and the words it uses more than its language (part ``term``)."""
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(named(text_col).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source"))
    kept = held(kept_words(docs, least_documents, slice_bytes), "divergence-words")
    langs = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    by_source = Window.partitionBy("lang")
    groups = held(
        docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "kinds", "v", "lang_total"])
        .withColumns({"gid": F.row_number().over(by_source.orderBy("source")).cast("long") - 1, "n_groups": F.count("*").over(by_source)})
        .withColumn("z", share("0", "total", "v")), "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({
        "p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")})

    used = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))

    mine, theirs = (groups.select("lang", *[F.col(c).alias(f"{side}_{c}") for c in ("source", "gid", "z", "kinds", "v")]) for side in "ab")
    pairs = mine.join(theirs, "lang").where("a_gid <> b_gid")
    spread = shares.groupBy("lang", "gid", "p").agg(F.count("*").alias("times")).withColumnRenamed("gid", "a_gid")
    # the words of a against the share of an unused word in b
    one_sided = (
        spread.join(pairs.select("lang", "a_gid", "b_gid", "b_z"), ["lang", "a_gid"])
        .groupBy("lang", "a_gid", "b_gid").agg(F.sum(F.col("times") * difference("p", "b_z")).alias("alone"))
    )
    back = one_sided.select("lang", F.col("a_gid").alias("b_gid"), F.col("b_gid").alias("a_gid"), F.col("alone").alias("alone_b"))
    shared = shared_sums(shares.select("lang", "term", "gid", "p", "z", "n_groups"))
    keys = ["lang", "a_gid", "b_gid"]
    summed = (
        pairs.join(one_sided, keys, "left").join(back, keys, "left")
        .join(shared.select("lang", F.col("a").alias("a_gid"), F.col("b").alias("b_gid"), "shared"), keys, "left")
        .fillna(0, ["alone", "alone_b", "shared"])
        .withColumn("value", F.col("alone") + F.col("alone_b") + F.col("shared") + (F.col("a_v") - F.col("a_kinds") - F.col("b_kinds")) * difference("a_z", "b_z"))
    )
    others = summed.select(
        "lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.when(F.col("a_v") > 0, F.col("value")).otherwise(0).alias("value"))
    others = others.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return others.select(*columns).unionByName(terms.select(*columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
g AS (
  SELECT s.lang, s.source, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (g.lang_total + 2 * g.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
