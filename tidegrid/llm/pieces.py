"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation of a text is the one of the highest sum of piece scores (the scores of the
model file, as whole numbers). A character that no piece covers is an unknown, scored below all
pieces, and comes out as its UTF-8 bytes. Among equal sums the piece that ends at a place is the
longest one, place by place from the end: the rule of the library's own best-path search.

Inside a chunk the search is a dynamic program over words. No piece holds a word mark
behind another character, so a place before a word mark is always a cut; the distinct words of a
few rows are solved together (place by place for all words at once), and kept.

A giant text is cut into chunks of ``CHUNK`` code points regardless of cuts:

1. Every chunk gives its transfer matrix: entry (i, j) is the best sum of the pieces that start
   in the chunk when the piece before it reaches i code points into it and the last one reaches
   j code points beyond. Chunks carry the few code points that follow them. The whole words between
   the first and the last cut of a chunk do not depend on its neighbours: their ids are made in the
   same pass, and from there on only the edges of the chunk travel.
2. Matrices multiply in the (max, +) algebra, which is associative: products of ``FAN`` chunks,
   of products, and so on, then back down, give each chunk the best sums of all that is before.
3. With these each chunk knows, for every way to leave it, where it was entered. These maps are
   composed in the same tree from the end, and each chunk learns how it is left.
4. The edges of every chunk are traced back on their own, and the ids of a text are put together,
   in the one shuffle that ids take part in.

Defined cases: a NULL or empty text has no ids; each row is encoded, equal rows alike; texts
that hold the word mark itself decode to blanks, as in the library; an empty table gives an
empty result. The text is not normalised but for the blank put in front; a model file that
normalises otherwise is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import held, parts, small_batches, table

MARK = "▁"
CHUNK = 16_384
FAN = 64
MEMO_WORDS, MEMO_LETTERS = 200_000, 32
TOGETHER_LETTERS, TOGETHER_LONGEST = 100_000, 64
#: rows, and letters of their texts, that are solved at once
SLICE_ROWS, SLICE_LETTERS = 128, 1 << 19
LOW = -(2**60)


class Pieces:
    """The pieces of a model file and the best-path search over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in (" a  b ", "Àﬁ　Ａ\t"):
            if model.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("only models without normalisation, with a blank in front, are handled")
        self.byte_ids, self.scores, self.text = {}, {}, []
        lowest = 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                score = round(model.get_score(i))
                self.scores[piece] = (score, i)
                lowest = min(lowest, score)
                self.text.append(piece.replace(MARK, " ").encode())
        self.unknown = lowest - 10
        self.longest = max(map(len, self.scores))
        inner = [p for p in self.scores if MARK in p.lstrip(MARK)]
        solo = "" if any("\n" in p for p in self.scores) else "\n"
        self.words = None if inner else re.compile(f"{solo}|{MARK}+[^{MARK}{solo}]*|[^{MARK}{solo}]+" if solo else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # every beginning of a piece: its score and id, or None where it is no piece itself
        self.begun = {p[:k]: None for p in self.scores for k in range(1, len(p))} | self.scores
        self.memo: dict[str, bytes] = {}
        # what an id adds to a sum; an unknown character counts once, at its first byte
        self.worth = np.zeros(model.get_piece_size(), dtype=np.int64)
        for score, i in self.scores.values():
            self.worth[i] = score
        for byte, i in self.byte_ids.items():
            self.worth[i] = 0 if 0x80 <= byte < 0xC0 else self.unknown
        if not self.byte_ids:
            self.worth[0] = self.unknown
        self._trie()

    def _trie(self) -> None:
        """The beginnings of pieces as numbered nodes; steps from node to node in a hash table."""
        nodes = {"": 0} | {b: i for i, b in enumerate(self.begun, 1)}
        kinds = {c: i for i, c in enumerate(sorted({c for b in self.begun for c in b}), 1)}
        self.kind_of = np.zeros(0x110000, dtype=np.int32)
        for c, i in kinds.items():
            self.kind_of[ord(c)] = i
        self.kinds = len(kinds) + 1
        self.node_score = np.full(len(nodes), LOW, dtype=np.int64)
        self.node_id = np.full(len(nodes), -1, dtype=np.int32)
        for piece, (score, i) in self.scores.items():
            self.node_score[nodes[piece]], self.node_id[nodes[piece]] = score, i
        keys = np.array([nodes[b[:-1]] * self.kinds + kinds[b[-1]] for b in self.begun], dtype=np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.step_key = np.full(1 << bits, -1, dtype=np.int64)
        self.step_node = np.zeros(1 << bits, dtype=np.int32)
        for slot, key, node in zip(self._slots(keys).tolist(), keys.tolist(), range(1, len(nodes))):
            while self.step_key[slot] >= 0:
                slot = (slot + 1) & mask
            self.step_key[slot], self.step_node[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _steps(self, nodes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The node that each node leads to by a character of this kind; -1 where there is none."""
        keys = nodes.astype(np.int64) * self.kinds + kinds
        slots = self._slots(keys)
        there = self.step_key[slots]
        out = np.where(there == keys, self.step_node[slots], -1)
        off = np.flatnonzero((there != keys) & (there >= 0))
        while len(off):
            slots[off] = (slots[off] + 1) & (len(self.step_key) - 1)
            there = self.step_key[slots[off]]
            out[off] = np.where(there == keys[off], self.step_node[slots[off]], -1)
            off = off[(there != keys[off]) & (there >= 0)]
        return out

    def cuts(self, text: str) -> list[str]:
        """The words of a text, between places that no piece crosses."""
        return self.words.findall(text) if self.words else [text]

    def walk(self, text: str, starts: dict[int, int], end: int) -> tuple[list, list]:
        """Best sums and last pieces at all places of ``text``, from given sums at some places.

        Pieces start before ``end`` and may reach beyond it, within ``text``.
        """
        best, back = [LOW] * (len(text) + 1), [None] * (len(text) + 1)
        for place, value in starts.items():
            best[place] = value
        begun, longest, unknown, size = self.begun, self.longest, self.unknown, len(text)
        for s in range(end):
            base = best[s]
            if base <= LOW // 2:
                continue
            single = True
            for e in range(s + 1, min(size, s + longest) + 1):
                hit = begun.get(text[s:e], False)
                if hit is False:  # no piece begins like this
                    break
                if hit is not None:
                    if base + hit[0] > best[e]:
                        best[e], back[e] = base + hit[0], (s, hit[1])
                    if e == s + 1:
                        single = False
            if single and base + unknown > best[s + 1]:
                best[s + 1], back[s + 1] = base + unknown, (s, -1)
        return best, back

    def trace(self, text: str, back: list, place: int) -> tuple[list[int], int]:
        """Ids up to ``place`` from the last entry point, and that point."""
        ids: list[list[int]] = []
        while back[place] is not None:
            start, piece = back[place]
            ids.append([piece] if piece >= 0 else self.spelled(text[start:place]))
            place = start
        return [i for part in reversed(ids) for i in part], place

    def spelled(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")] if self.byte_ids else [0]

    def word(self, word: str) -> bytes:
        """The ids (little-endian 32-bit) of a whole word."""
        _, back = self.walk(word, {0: 0}, len(word))
        ids = self.trace(word, back, len(word))[0]
        return pack(f"<{len(ids)}i", *ids)

    def together(self, words: list[str]) -> list[bytes]:
        """The ids of many whole words: the steps of ``walk``, each taken for all words at once.

        Places are numbered by their offset in the word, then by word, the longest word first.
        """
        lengths = np.array(list(map(len, words)))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        letters = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds, starts, most = self.kind_of[letters], np.cumsum(lengths) - lengths, int(lengths[0])
        reach = np.searchsorted(-lengths, -np.arange(most + 2), side="right")  # words that have a place of this offset
        reach[0] = len(words)
        first = np.cumsum(reach) - reach
        size = int(first[-1])
        onward = (np.arange(size) + np.repeat(reach[:-1], reach[:-1])).astype(np.int32)
        kind = np.zeros(size, dtype=np.int32)
        real = np.zeros(size, dtype=bool)
        for k in range(most):
            at = slice(first[k], first[k] + reach[k + 1])
            kind[at], real[at] = kinds[starts[: reach[k + 1]] + k], True
        links = []  # by length of the piece: starts (ascending), ends, scores, ids
        begin = np.flatnonzero(real).astype(np.int32)
        now, node = begin, np.zeros(len(begin), dtype=np.int32)
        while len(begin):
            node = self._steps(node, kind[now])
            now = onward[now]
            score = np.where(node >= 0, self.node_score[node], LOW)
            if not links:  # a single character is a link in any case
                ids = np.where(score > LOW, self.node_id[node], -1)
                links.append((begin, now, np.where(score > LOW, score, self.unknown), ids))
            else:
                hit = score > LOW
                links.append((begin[hit], now[hit], score[hit], self.node_id[node[hit]]))
            on = (node >= 0) & real[now]
            begin, now, node = begin[on], now[on], node[on]
        bounds = [np.searchsorted(link[0], first).tolist() for link in links]
        best, came, with_id = np.full(size, LOW, dtype=np.int64), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        best[: len(words)] = 0
        for k in range(most):
            for (start, end, score, ids), at in zip(links, bounds):
                a, b = at[k], at[k + 1]
                if a < b:
                    sums = best[start[a:b]] + score[a:b]
                    better = sums > best[end[a:b]]
                    to = end[a:b][better]
                    best[to], came[to], with_id[to] = sums[better], start[a:b][better], ids[a:b][better]
        who, place, traced = np.arange(len(words)), first[lengths] + np.arange(len(words)), []
        counts, strange = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        while len(who):
            traced.append((who, with_id[place]))
            counts[who] += 1
            strange[who] |= with_id[place] < 0
            place = came[place]
            on = place >= len(words)
            who, place = who[on], place[on]
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), dtype="<i4")
        for k, (who, ids) in enumerate(traced):
            flat[ends[who] - 1 - k] = ids
        raw, out = flat.tobytes(), [b""] * len(words)
        for i, a, b, odd in zip(order.tolist(), (4 * (ends - counts)).tolist(), (4 * ends).tolist(), strange.tolist()):
            out[i] = self.word(words[i]) if odd else raw[a:b]
        return out

    def solved(self, words: list[str]) -> list[bytes]:
        new, some, letters = [], [], 0
        for w in set(words).difference(self.memo):
            if len(w) > TOGETHER_LONGEST:
                self.memo[w] = self.word(w)
                new.append(w)
                continue
            some.append(w)
            letters += len(w)
            if letters >= TOGETHER_LETTERS:
                self.memo.update(zip(some, self.together(some)))
                new, some, letters = new + [w for w in some if len(w) > MEMO_LETTERS], [], 0
        if some:
            self.memo.update(zip(some, self.together(some)))
        found = list(map(self.memo.__getitem__, words))
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for w in (*new, *[w for w in some if len(w) > MEMO_LETTERS]):
            self.memo.pop(w, None)
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, in one piece."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of some whole texts; words that they share are solved once."""
        words = [self.cuts(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = iter(self.solved([w for of_text in words for w in of_text]))
        return [b"".join(islice(known, len(of_text))) for of_text in words]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # chunks: ``body`` followed by ``ahead``, at most ``longest - 1`` code points of what comes next

    def _parts(self, body: str, ahead: str) -> tuple[str, list[str], str]:
        """Head up to a first cut, whole words, tail from a last cut on; the cuts are places that
        no piece crosses and that every state reaches."""
        words = self.cuts(body)
        head, size = 1, len(words[0])
        while head < len(words) and size < self.longest:
            size += len(words[head])
            head += 1
        if head >= len(words):
            return body, [], ""
        return "".join(words[:head]), words[head:-1], words[-1]

    def opened(self, bodies: list[str], aheads: list[str]) -> list[tuple[np.ndarray, str, bytes, str]]:
        """The max-plus matrix of every chunk, its head, the ids of its whole words, and its tail;
        a chunk without cuts is all head."""
        parts = [self._parts(x, y) for x, y in zip(bodies, aheads)]
        known = iter(self.solved([w for _, middle, _ in parts for w in middle]))
        inside = [b"".join(islice(known, len(middle))) for _, middle, _ in parts]
        return [(self._matrix(head, ids, tail, ahead), head, ids, tail) for (head, _, tail), ids, ahead in zip(parts, inside, aheads)]

    def transfer(self, body: str, ahead: str) -> np.ndarray:
        """The max-plus matrix of a chunk."""
        return self.opened([body], [ahead])[0][0]

    def _matrix(self, head: str, ids: bytes, tail: str, ahead: str) -> np.ndarray:
        size, n = self.longest, len(head)
        out = np.full((size, size), LOW, dtype=np.int64)
        if not tail:
            text = head + ahead
            for i in range(min(size, len(text) + 1)):
                if i >= n:
                    out[i, i - n] = 0
                    continue
                best, _ = self.walk(text, {i: 0}, n)
                ends = best[n : n + size]
                out[i, : len(ends)] = ends
            return np.maximum(out, LOW)
        passed = int(self.worth[np.frombuffer(ids, dtype="<i4")].sum())
        ends = np.full(size, LOW, dtype=np.int64)
        best, _ = self.walk(tail + ahead, {0: 0}, len(tail))
        ends[: len(best) - len(tail)] = best[len(tail) : len(tail) + size]
        for i in range(size):
            inside = self.walk(head, {i: 0}, len(head))[0][-1]
            out[i] = np.where(ends > LOW // 2, inside + passed + ends, LOW) if inside > LOW // 2 else LOW
        return out

    def entries(self, body: str, ahead: str, sums: np.ndarray) -> list[int]:
        """For each way to leave the chunk (code points beyond it), how it was entered; -1: never."""
        head, _, tail = self._parts(body, ahead)
        return self.edge_entries(head, tail, ahead, sums)

    def edge_entries(self, head: str, tail: str, ahead: str, sums: np.ndarray) -> list[int]:
        starts = {i: int(v) for i, v in enumerate(sums) if v > LOW // 2}
        if tail:
            _, back = self.walk(head, {i: v for i, v in starts.items() if i <= len(head)}, len(head))
            entry = self.trace(head, back, len(head))[1]
            best, _ = self.walk(tail + ahead, {0: 0}, len(tail))
            return [entry if len(tail) + j < len(best) and best[len(tail) + j] > LOW // 2 else -1 for j in range(self.longest)]
        text, n = head + ahead, len(head)
        best, back = self.walk(text, {i: v for i, v in starts.items() if i <= len(text)}, n)
        return [self.trace(text, back, n + j)[1] if n + j < len(best) and best[n + j] > LOW // 2 else -1 for j in range(self.longest)]

    def chunk_ids(self, body: str, ahead: str, sums: np.ndarray, leave: int) -> bytes:
        """The ids of the pieces that start in the chunk, when it is left with ``leave``."""
        head, middle, tail = self._parts(body, ahead)
        first, last = self.edge_ids(head, tail, ahead, sums, leave)
        return first + b"".join(self.solved(middle)) + last

    def edge_ids(self, head: str, tail: str, ahead: str, sums: np.ndarray, leave: int) -> tuple[bytes, bytes]:
        """The ids before and behind the whole words of the chunk."""
        starts = {i: int(v) for i, v in enumerate(sums) if v > LOW // 2}
        as_bytes = lambda ids: np.asarray(ids, dtype="<i4").tobytes()
        if not tail:
            text = head + ahead
            _, back = self.walk(text, {i: v for i, v in starts.items() if i <= len(text)}, len(head))
            return as_bytes(self.trace(text, back, len(head) + leave)[0]), b""
        _, back = self.walk(head, {i: v for i, v in starts.items() if i <= len(head)}, len(head))
        first = as_bytes(self.trace(head, back, len(head))[0])
        _, back = self.walk(tail + ahead, {0: 0}, len(tail))
        return first, as_bytes(self.trace(tail + ahead, back, len(tail) + leave)[0])


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The pieces of a model file, one per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; sums of LOW stay at LOW."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)


def _matrix(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, dtype="<i8")
    size = int(round(len(flat) ** 0.5))
    return flat.reshape(size, size)


def narrow(ids: bytes, path: str) -> bytes:
    """32-bit ids as they travel: in 16 bits, where the model has no more of them."""
    return np.frombuffer(ids, dtype="<i4").astype(_width(path)).tobytes()


def _width(path: str) -> str:
    return "<u2" if len(pieces(path).text) <= 1 << 16 else "<i4"


KEY = ["row"]


def bounds(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """A few rows at a time: from and to, of at most ``SLICE_ROWS`` rows and, but for a single row, ``SLICE_LETTERS``."""
    start = letters = 0
    for k, size in enumerate(sizes):
        if k - start == SLICE_ROWS or k > start and letters + size > SLICE_LETTERS:
            yield start, k
            start, letters = k, 0
        letters += size
    if start < len(sizes):
        yield start, len(sizes)


def _slices(batches: Iterator[pd.DataFrame], text: str = "head") -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that results do not pile up beside a whole batch."""
    for batch in batches:
        for start, end in bounds(batch[text].str.len().tolist()):
            yield batch.iloc[start:end]


def _scan(chunks: DataFrame, most: int, product, start, onward, value: str, result: str, backwards: bool) -> DataFrame:
    """An exclusive scan over ``value`` in the order of ``c`` (or against it), by a tree of ``FAN``.

    ``product(values)`` folds a block, ``start`` is the state at the outer end, and
    ``onward(state, value)`` passes one value. Gives KEY, c and ``result``: the state each value meets.
    """
    spread = parts(chunks.sparkSession)
    # a fixed number of partitions: the rows are few and small, the work on them is not
    grouped = chunks.withColumn("block", F.floor(F.col("c") / FAN).cast("int")).repartition(spread, *KEY, "block")

    def along(rows: pd.DataFrame, state: bytes) -> pd.DataFrame:
        rows = rows.sort_values("c", ascending=not backwards)
        out = []
        for v in rows[value]:
            out.append(state)
            state = onward(state, v)
        return pd.DataFrame({**{k: rows[k] for k in KEY}, "c": rows["c"], result: out})

    shape = f"row bigint, c int, {result} binary"
    if most < FAN:
        return grouped.groupBy(*KEY, "block").applyInPandas(lambda rows: along(rows, start), shape)

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c", ascending=not backwards)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in KEY}, "c": rows["block"].iloc[0], value: product(list(rows[value]))}])

    blocks = held(grouped.groupBy(*KEY, "block").applyInPandas(
        folded, f"row bigint, c int, {value} binary"), "scan")
    states = _scan(blocks, most // FAN, product, start, onward, value, "state", backwards) \
        .withColumnRenamed("c", "block")

    def passed(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        return along(rows, bytes(given["state"].iloc[0]))

    left = grouped.groupBy(*KEY, "block")
    right = states.select(F.col("row").alias("s_row"), F.col("block").alias("s_block"), "state") \
        .repartition(spread, "s_row", "s_block")
    return left.cogroup(right.groupBy("s_row", "s_block")).applyInPandas(passed, shape)


def _fold_matrices(values: list[bytes]) -> bytes:
    out = _matrix(values[0])
    for v in values[1:]:
        out = times(out, _matrix(v))
    return out.astype("<i8").tobytes()


def _pass_matrix(state: bytes, value: bytes) -> bytes:
    row = np.frombuffer(state, dtype="<i8")
    return times(row[None, :], _matrix(value))[0].astype("<i8").tobytes()


def _fold_entries(values: list[bytes]) -> bytes:
    # from the last chunk to the first: how the block was entered for each way to leave it
    out = np.frombuffer(values[0], dtype="<i4")
    for v in values[1:]:
        out = np.where(out >= 0, np.frombuffer(v, dtype="<i4")[out], -1)
    return out.astype("<i4").tobytes()


def _pass_entry(state: bytes, value: bytes) -> bytes:
    leave = np.frombuffer(state, dtype="<i4")[0]
    return np.frombuffer(value, dtype="<i4")[[leave]].tobytes()


def _giant_ids(giants: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """id, text_key and ids of texts of more than one chunk."""
    kind = giants.schema["id"].dataType.simpleString()
    longest = pieces(model_path).longest
    marked = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    chunks = (
        giants.withColumn("row", F.monotonically_increasing_id())
        .select("row", "id", "text_key", marked.alias("text"), F.ceil((F.length("text") + 1) / chunk).cast("int").alias("n"))
        .select("row", "id", "text_key", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
        .select("row", "id", "text_key", "c", F.expr(f"substring(text, c * {chunk} + 1, {chunk})").alias("body"),
                F.expr(f"substring(text, (c + 1) * {chunk} + 1, {longest - 1})").alias("ahead"))
    )

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model_path)
        for b in _slices(batches, "body"):
            matrices, heads, ids, tails = zip(*p.opened(list(b["body"]), list(b["ahead"])))
            yield b[["row", "id", "text_key", "c", "ahead"]].assign(
                m=[m.astype("<i8").tobytes() for m in matrices], head=heads, tail=tails, inside=[narrow(x, model_path) for x in ids])

    # written once: a row number is the same for all that follows
    solved = held(chunks.mapInPandas(
        opened, f"row bigint, id {kind}, text_key bigint, c int, ahead string, m binary, head string, tail string, inside binary"), "chunks")
    most = solved.agg(F.max("c")).first()[0]
    if most is None:
        return giants.select("id", "text_key", F.array().cast("array<int>").alias("ids")).limit(0)

    start = np.full(longest, LOW, dtype="<i8")
    start[0] = 0
    sums = _scan(solved.select("row", "c", "m"), most, _fold_matrices, start.tobytes(), _pass_matrix, "m", "sums", backwards=False)
    edges = held(solved.select("row", "c", "head", "tail", "ahead").join(sums, ["row", "c"]), "edges")

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model_path)
        for b in _slices(batches):
            found = [
                np.asarray(p.edge_entries(x, y, z, np.frombuffer(s, dtype="<i8")), dtype="<i4").tobytes()
                for x, y, z, s in zip(b["head"], b["tail"], b["ahead"], b["sums"])
            ]
            yield b[["row", "c"]].assign(ways=found)

    leaves = _scan(
        held(edges.mapInPandas(ways, "row bigint, c int, ways binary"), "ways"), most, _fold_entries, np.zeros(1, dtype="<i4").tobytes(),
        _pass_entry, "ways", "leave", backwards=True)

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model_path)
        for b in _slices(batches):
            found = [
                p.edge_ids(x, y, z, np.frombuffer(s, dtype="<i8"), int(np.frombuffer(v, dtype="<i4")[0]))
                for x, y, z, s, v in zip(b["head"], b["tail"], b["ahead"], b["sums"], b["leave"])
            ]
            for place in (0, 1):
                yield b[["row", "c"]].assign(place=2 * place, part=[narrow(x[place], model_path) for x in found])

    ends = edges.join(leaves, ["row", "c"]).mapInPandas(traced, "row bigint, c int, place int, part binary")
    every = solved.select("row", "id", "text_key", "c", F.lit(1).alias("place"), F.col("inside").alias("part")).unionByName(
        ends, allowMissingColumns=True)
    # one document's ids; texts are whole rows anyway
    whole = every.groupBy("row").agg(
        F.max("id").alias("id"), F.max("text_key").alias("text_key"), F.sort_array(F.collect_list(F.struct("c", "place", "part"))).alias("parts"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: np.frombuffer(b"".join(x), dtype=_width(model_path)).astype("<i4"))

    return whole.select("id", "text_key", joined("parts.part").alias("ids"))


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
           back_col: str | None = None) -> DataFrame:
    """id, text_key (hash of the text), ids (array of int) of every row; with ``back_col`` also the text
    that the ids decode to, made beside them."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "text_key", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    whole = F.length("text") < chunk

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path)
        for batch in batches:
            for start, end in bounds(pc.binary_length(batch.column("text")).to_pylist()):
                some = batch.slice(start, end - start)
                found = p.encode_all(some.column("text").to_pylist())
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                out = {"id": some.column("id"), "text_key": some.column("text_key"), "ids": ids}
                if back_col:
                    out["back"] = pa.array([p.decode(np.frombuffer(x, dtype="<i4")) for x in found], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    made = f"id {kind}, text_key bigint, ids array<int>"
    small = rows.where(whole).mapInArrow(encoded, f"{made}, back string" if back_col else made)
    large = _giant_ids(rows.where(~whole), model_path, chunk)
    if back_col:
        large = large.withColumn("back", decode(F.col("ids"), model_path))
    out = small.unionByName(large).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("back", back_col) if back_col else out


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array of ids."""
    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        p = pieces(model_path)
        return batch.map(lambda x: p.decode(np.asarray(x, dtype="<i4")))

    return text(ids)


def encoded_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids of every row, and whether they decode to the very text."""
    out = encode(docs, model_path, back_col="back")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.xxhash64("back") == F.col("text_key")).alias("round_trip"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
