"""Suffix-array dedup: bytes covered by a string of 100 bytes that also starts earlier.

A window is a string of ``length`` bytes inside one document. Of equal windows the first one (by
document, then place) stays; the bytes of every other one go. Windows are compared as suffixes
cut to that length, sorted by ``suffixes.Suffixes``; no task meets all suffixes:

* **Anchors.** Of the ``SPAN`` grams inside a window the one of the least hash is its anchor. Equal
  windows have equal anchors at equal offsets, so only suffixes of one anchor need be compared.
  One anchor serves a run of neighbouring windows; there is about one to 32 bytes.
* **Candidates.** Anchors whose gram stands once in the corpus have no repeats. A task sends each
  gram once, however often it has it, so a gram that a third of all rows share stays small.
* **Excerpts.** Candidates leave as the bytes of their windows, equal ones once a task with their
  first place. Excerpts of an anchor meet in one task and are sorted twice there: by what follows
  the anchor's start and, reversed, by what precedes it. Two windows at the same offset are equal
  where both sorts give them a long enough common extension, so classes of equal windows are runs
  of the two orders, and the first place of each class is known.
* **Hot anchors.** Anchors with more than ``GROUP_ROWS`` different excerpts are split by content:
  windows at neighbouring offsets share a longer core, whose hash becomes the key; equal excerpts
  are merged again by a combining aggregate. After the last step a key is one whole window.
* **Removal.** All candidate windows repeat an earlier one, but for the firsts found above. Each
  document joins its own few marks and loses the union of the repeated windows.

Hashes only bring candidates together or order them: a collision costs work, never a result (the
sort verifies its order on bytes). The places of a document come from (id, hash of its text).

Defined cases: NULL text is empty; texts shorter than a window keep all bytes; rows of equal id
and equal text are one document, given once per row with one result; rows of equal id and
different texts are ordered by the hash of the text; a NULL id comes before all others; very long
texts are read piece by piece and their marks are as many as their own repeats; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import drop_held, held, table
from tidegrid.llm.hashing import mix64
from tidegrid.llm.suffixes import Suffixes
from tidegrid.llm.terms import slices, text_buffer

LENGTH = 100
SPAN = 64
LEAST_LENGTH = SPAN + 16
PIECE_BYTES = 1 << 20
PART_BYTES = 1 << 22
FLUSH_ANCHORS = 1 << 20
FLUSH_EXCERPTS = 100_000
SORT_ROWS = 20_000
GROUP_ROWS = 4096
CELLS = (64, 8, 1)
_ORDINAL_BITS = 20
_BASE = 0xD1342543DE82EF95
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every place, by doubling."""
    part, width = raw.astype(np.uint64) + np.uint64(1), 1
    total, size = np.zeros(len(raw) + 1, dtype=np.uint64), 0
    while True:
        power = np.uint64(pow(_BASE, width, 1 << 64))
        if gram & width:
            n = len(raw) - size - width + 1
            total, size = total[:n] * power + part[size : size + n], size + width
        width *= 2
        if width > gram:
            return mix64(total)
        part = part[: len(part) - width // 2] * power + part[width // 2 :]


def _least(values: np.ndarray) -> np.ndarray:
    """The least of each ``SPAN`` neighbours, from running minima of blocks."""
    n = len(values) - SPAN + 1
    full = np.full(-(-len(values) // SPAN) * SPAN, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[SPAN - 1 : SPAN - 1 + n])


def _some_anchors(raw: np.ndarray, offsets: np.ndarray, length: int, windows_end: int) -> tuple[np.ndarray, ...]:
    if len(raw) < length:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    grams = gram_hashes(raw, length - SPAN + 1)
    # place in the low bits: the least is unique, and of equal grams the first
    least = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64))
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    full = np.flatnonzero(np.diff(offsets) >= length)
    inside[offsets[full]] += 1
    inside[offsets[full + 1] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    window = window[window < windows_end]
    anchor = (least[window] & _PLACE).astype(np.int64)
    heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
    return anchor[heads], window[heads], np.diff(np.append(heads, len(window))), grams[anchor[heads]]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, piece: int = PIECE_BYTES) -> tuple[np.ndarray, ...]:
    """For each anchor: its text, place, first window, number of windows, and gram hash.

    Windows never reach over a text. Texts longer than a piece are cut at its multiples, always
    at the same places of the text.
    """
    found = [(0, _some_anchors(raw[:0], offsets[:1], length, 0))]
    for a, b in slices(offsets, piece):
        begin, end = int(offsets[a]), int(offsets[b])
        if b > a + 1 or end - begin <= piece:
            found.append((begin, _some_anchors(raw[begin:end], offsets[a : b + 1] - begin, length, end - begin)))
            continue
        for cut in range(begin, end, piece):
            stop = min(cut + piece + length - 1, end)
            found.append((cut, _some_anchors(raw[cut:stop], np.array([0, stop - cut]), length, piece)))
    place = np.concatenate([begin + x[0] for begin, x in found])
    first = np.concatenate([begin + x[1] for begin, x in found])
    n, grams = (np.concatenate([x[k] for _, x in found]) for k in (2, 3))
    return np.searchsorted(offsets, first, side="right") - 1, place, first, n, grams


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to whole rows of about ``PART_BYTES`` of text."""
    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        for a, b in slices(offsets, PART_BYTES):
            yield batch.slice(a, b - a)


def _ordinals(text: np.ndarray) -> np.ndarray:
    """The number of each anchor inside its text, in the bits that a reference has for it."""
    heads = np.flatnonzero(np.append(True, text[1:] != text[:-1])[: len(text)])
    sizes = np.diff(np.append(heads, len(text)))
    return (np.arange(len(text)) - np.repeat(heads, sizes)) & ((1 << _ORDINAL_BITS) - 1)


def doc_key(order: str = "at_id", tie: str = "at_text") -> Column:
    """44 bits of a document's hash. Two documents of one key only share candidates."""
    return F.shiftrightunsigned(F.xxhash64(order, tie), _ORDINAL_BITS)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, at_id and at_text (the order of documents), key."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
        .withColumns({"at_id": F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), "at_text": F.xxhash64("text")})
        .withColumn("key", doc_key())
    )


def candidates(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, ordinals: of each document the anchors whose gram stands elsewhere too."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, refs, n = [], [], 0

        def out() -> pa.RecordBatch:
            gram, ref = np.concatenate(grams), np.concatenate(refs)
            _, first, inverse, times = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
            # a gram that repeats here is known to: its anchors go by themselves, and one row tells the others
            known = np.flatnonzero(times[inverse] > 1)
            alone = np.append(times == 1, np.ones(len(known), dtype=bool))
            return pa.RecordBatch.from_arrays([
                pa.array(np.append(gram[first].view(np.int64), ref[known])), pa.array(np.append(ref[first], ref[known]), mask=~alone),
                pa.array(np.append(np.zeros(len(first), dtype=bool), np.ones(len(known), dtype=bool)))], names=["gram", "ref", "known"])

        for batch in _parts(batches):
            raw, offsets = text_buffer(batch.column("text"))
            text, _, _, _, gram = anchors(raw, offsets, length)
            key = batch.column("key").to_numpy()[text]
            grams.append(gram)
            refs.append((key << _ORDINAL_BITS) | _ordinals(text))
            n += len(gram)
            if n >= FLUSH_ANCHORS:
                yield out()
                grams, refs, n = [], [], 0
        if n:
            yield out()

    rows = docs.select("text", "key").mapInArrow(sketch, "gram bigint, ref bigint, known boolean")
    # a gram has at most one row a task and flush; known ones are keyed by their reference
    met = rows.groupBy("known", "gram").agg(F.count("*").alias("times"), F.collect_list("ref").alias("refs"))
    ref = met.where("known OR times > 1").select(F.explode("refs").alias("ref"))
    return ref.groupBy(F.shiftrightunsigned("ref", _ORDINAL_BITS).alias("key")).agg(
        F.collect_list((F.col("ref").bitwiseAND((1 << _ORDINAL_BITS) - 1)).cast("int")).alias("ordinals"))


def _flagged(text: np.ndarray, ordinals: pa.Array) -> np.ndarray:
    """Which anchors are candidates, by the lists of ordinals of their texts."""
    sizes = pc.fill_null(pc.list_value_length(ordinals), 0).to_numpy().astype(np.int64)
    listed = (np.repeat(np.arange(len(sizes)), sizes) << _ORDINAL_BITS) | ordinals.flatten().to_numpy().astype(np.int64)
    return np.isin((text << _ORDINAL_BITS) | _ordinals(text), listed)


def excerpts(docs: DataFrame, per_document: DataFrame, length: int = LENGTH) -> DataFrame:
    """gram, ahead, excerpt, at_id, at_text, start: the bytes of each candidate's windows.

    ``ahead`` is the number of bytes before the anchor, ``start`` the place of the first window.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}

        def out() -> pa.RecordBatch:
            gram, ahead, excerpt = zip(*seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), pa.array(ahead, pa.int32()), pa.array(excerpt, pa.binary()),
                 *[pa.array(x, pa.int64()) for x in zip(*seen.values())]],
                names=["gram", "ahead", "excerpt", "at_id", "at_text", "start"])

        for batch in _parts(batches):
            raw, offsets = text_buffer(batch.column("text"))
            text, place, first, n, gram = anchors(raw, offsets, length)
            some = _flagged(text, batch.column("ordinals"))
            text, place, first, n, gram = text[some], place[some], first[some], n[some], gram[some]
            at_id, at_text = (batch.column(c).to_numpy()[text].tolist() for c in ("at_id", "at_text"))
            whole = raw.tobytes()
            for g, ahead, i, j, *at in zip(gram.view(np.int64).tolist(), (place - first).tolist(), first.tolist(), (first + n + length - 1).tolist(),
                                           at_id, at_text, (first - offsets[text]).tolist()):
                what, at = (g, ahead, whole[i:j]), tuple(at)
                before = seen.get(what)
                if before is None or at < before:
                    seen[what] = at
                if len(seen) >= FLUSH_EXCERPTS:
                    yield out()
                    seen = {}
        if seen:
            yield out()

    # both sides are dealt by document key; a document's list is no longer than its text
    joined = docs.join(per_document, "key").select("text", "at_id", "at_text", "ordinals")
    return joined.mapInArrow(cut, "gram bigint, ahead int, excerpt binary, at_id bigint, at_text bigint, start bigint")


def _split(rows: DataFrame, cell: int, length: int) -> DataFrame:
    """Excerpts cut to windows whose anchor lies ``cell`` neighbouring offsets ahead, keyed by the
    bytes that all windows of the cell hold."""
    n = F.length("excerpt") - (length - 1)
    low, high = F.col("ahead") - n + 1, F.col("ahead")
    cells = rows.withColumn("cell", F.explode(F.sequence((low / cell).cast("int"), (high / cell).cast("int"))))
    most = F.least("ahead", F.col("cell") * cell + cell - 1)
    least = F.greatest(low, F.col("cell") * cell)
    skipped = F.col("ahead") - most
    core = F.substring(F.col("excerpt"), F.col("ahead") - F.col("cell") * cell + 1, F.lit(length - cell + 1))
    return cells.select(
        F.xxhash64("gram", "cell", core).alias("gram"), most.alias("ahead"),
        F.substring(F.col("excerpt"), skipped + 1, most - least + length).alias("excerpt"),
        "at_id", "at_text", (F.col("start") + skipped).alias("start"))


def first_windows(gram: np.ndarray, ahead: np.ndarray, raw: np.ndarray, offsets: np.ndarray, at: tuple[np.ndarray, ...],
                  length: int = LENGTH) -> np.ndarray:
    """Of each excerpt, as bits, the windows that no earlier excerpt of its gram holds.

    ``raw`` and ``offsets`` hold the excerpts, ordered by gram; ``at`` is (at_id, at_text, start).
    """
    sizes = np.diff(offsets)
    n = sizes - length + 1
    begin = offsets[:-1]
    within = np.arange(int(ahead.sum())) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    reverse = raw[np.repeat(begin + ahead - 1, ahead) - within]
    orders = []
    for buffer, starts, lengths in ((reverse, np.cumsum(ahead) - ahead, ahead), (raw, begin + ahead, np.minimum(sizes - ahead, length))):
        order, common = Suffixes(buffer, starts, lengths, gram).sort()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        orders.append((rank, common))
    (before, before_common), (after, after_common) = orders
    # equal places (a document given twice) are one place
    place = at[2] + ahead
    by_place = np.lexsort((place, at[1], at[0]))
    differs = np.append(False, np.any([x[by_place][1:] != x[by_place][:-1] for x in (*at[:2], place)], axis=0))[: len(by_place)]
    nth = np.empty(len(by_place), dtype=np.int64)
    nth[by_place] = np.cumsum(differs)
    bits = np.zeros(len(n), dtype=np.uint64)
    for offset in range(int(ahead.max(initial=-1)) + 1):
        some = np.flatnonzero((offset <= ahead) & (offset > ahead - n))
        if not len(some):
            continue
        left = np.cumsum(before_common < offset)[before[some]]
        right = np.cumsum(after_common < length - offset)[after[some]]
        # orders keep grams together, and a run of the second never reaches over one
        order = np.lexsort((nth[some], left, right))
        key_l, key_r, place_ = left[order], right[order], nth[some][order]
        heads = np.append(True, (key_l[1:] != key_l[:-1]) | (key_r[1:] != key_r[:-1]))[: len(order)]
        first = place_ == place_[np.flatnonzero(heads)][np.cumsum(heads) - 1]
        kept = some[order[first]]
        bits[kept] |= np.uint64(1) << (ahead[kept] - offset).astype(np.uint64)
    return bits


def firsts(rows: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """at_id, at_text, start, bits: the windows (from ``start`` on) that are the first of their kind."""
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(some: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = text_buffer(some.column("excerpt"))
            at = tuple(some.column(c).to_numpy() for c in ("at_id", "at_text", "start"))
            bits = first_windows(some.column("gram").to_numpy(), some.column("ahead").to_numpy().astype(np.int64), raw, offsets, at, length)
            table_ = pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(bits.view(np.int64))], names=["at_id", "at_text", "start", "bits"])
            return table_.filter(pa.array(bits != 0))

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), SORT_ROWS):
                rest.append(batch.slice(start, SORT_ROWS))
                whole = pa.concat_batches(rest)
                gram = whole.column("gram").to_numpy()
                # all but the last gram, which may go on
                end = int(np.searchsorted(gram, gram[-1])) if gram[0] != gram[-1] else 0
                if end and len(whole) >= SORT_ROWS:
                    yield out(whole.slice(0, end))
                    rest = [whole.slice(end)]
        if rest:
            yield out(pa.concat_batches(rest))

    by_gram = "gram bigint, ahead int, excerpt binary, at_id bigint, at_text bigint, start bigint"
    schema = "at_id bigint, at_text bigint, start bigint, bits bigint"
    ready = None
    for turn, cell in enumerate((None, *CELLS)):
        if cell:
            # a hot gram: merge equal excerpts, then split what is left by ever longer common cores
            merged = _split(rows, cell, length) if cell < SPAN else rows
            first = F.min(F.struct("at_id", "at_text", "start")).alias("at")
            rows = held(merged.groupBy("gram", "ahead", "excerpt").agg(first).select("gram", "ahead", "excerpt", "at.*"), "repeats-split")
        last = cell == CELLS[-1]
        hot = held(rows.groupBy("gram").count().where(F.col("count") > group_rows).select("gram"), "repeats-hot")
        any_hot = not last and not hot.isEmpty()
        part = rows.join(hot, "gram", "left_anti") if any_hot else rows
        ready = part if ready is None else ready.unionByName(part)
        if not any_hot:
            break
        rows = rows.join(hot, "gram", "left_semi")
    columns = [c.split()[0] for c in by_gram.split(", ")]
    sorted_ = ready.select(*columns).repartition("gram").sortWithinPartitions("gram")
    return sorted_.mapInArrow(resolve, schema)


def _removal(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            raw, offsets = text_buffer(batch.column("text"))
            marked = np.flatnonzero(pc.fill_null(pc.list_value_length(batch.column("ordinals")), 0).to_numpy())
            spans: dict[int, np.ndarray] = {}
            if len(marked):
                some = batch.take(pa.array(marked))
                for k, found in _repeated(some, length):
                    spans[int(marked[k])] = found
            kept, listed, whole = [], [], raw.tobytes()
            for k in range(len(batch)):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                found = spans.get(k)
                if found is None:
                    kept.append(whole[begin:end])
                    listed.append([])
                    continue
                at, out = begin, []
                for i, j in found.tolist():
                    out.append(whole[at : begin + i])
                    at = begin + j
                kept.append(b"".join([*out, whole[at:end]]))
                listed.append([{"begin": i, "end": j} for i, j in found.tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(listed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return remove


def _repeated(some: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its (begin, end) spans of repeated windows) of texts that have candidates."""
    raw, offsets = text_buffer(some.column("text"))
    text, _, first, n, _ = anchors(raw, offsets, length)
    mine = _flagged(text, some.column("ordinals"))
    text, first, n = text[mine], first[mine], n[mine]
    marks = some.column("firsts")
    of = np.repeat(np.arange(len(some)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy().astype(np.int64))
    flat = marks.flatten()
    at_id, at_text, start, bits = (flat.field(c).to_numpy() for c in ("at_id", "at_text", "start", "bits"))
    # another document may share the key: marks are for the one they name
    own = (at_id == some.column("at_id").to_numpy()[of]) & (at_text == some.column("at_text").to_numpy()[of])
    place, bits = (offsets[of] + start)[own], bits[own]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    window, of = np.repeat(first, n) + within, np.repeat(text, n)
    # the first windows, one by one: hot excerpts are split, so an anchor's may be marked from several starts
    row, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    is_first = np.isin(window, place[row] + bit)
    window, of = window[~is_first], of[~is_first]
    if not len(window):
        return
    heads = np.flatnonzero(np.append(True, (window[1:] > window[:-1] + length) | (of[1:] != of[:-1])))
    tails = np.append(heads[1:], len(window)) - 1
    both = np.stack([window[heads], window[tails] + length], axis=1) - offsets[of[heads]][:, None]
    rows = of[heads]
    cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(rows)).tolist()):
        yield int(rows[a]), both[a:b]


def without_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, spans (begin, end of each removed run of bytes), kept (the bytes left)."""
    if length < LEAST_LENGTH:
        raise ValueError(f"windows need {LEAST_LENGTH} bytes or more")
    docs = _documents(docs, id_col, text_col)
    per_document = held(candidates(docs, length), "repeats-candidates")
    rows = held(excerpts(docs, per_document, length), "repeats-excerpts")
    found = held(firsts(rows, length, group_rows).withColumn("key", doc_key()), "repeats-firsts")
    drop_held(rows)
    marks = found.groupBy("key").agg(F.collect_list(F.struct("at_id", "at_text", "start", "bits")).alias("firsts"))
    joined = docs.join(per_document.join(marks, "key", "left"), "key", "left")
    return joined.select("doc_id", "text", "at_id", "at_text", "ordinals", "firsts").mapInArrow(
        _removal(length), "doc_id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
