"""Token files: ids in fixed-size chunks, split into byte or bit planes, each plane compressed.

Layout of a token file set (a Parquet folder, so that any store Spark reaches will do): one row
per chunk of ``chunk_ids`` ids (the last of a shard may be shorter) with

* ``shard``, ``chunk``: place of the chunk; shards follow each other in ascending document id;
* ``n_ids``: ids in the chunk; ``width``: bytes of an id (2 or 4), fixed for the set;
* ``planes``: the planes, lowest first, each a zstandard frame. A byte plane holds byte ``k`` of
  every id; a bit plane holds bit ``k`` of every id, packed eight to a byte;
* the chunk index: ``doc_ids``, ``doc_lens`` for every document with ids in this chunk, and
  ``open``: whether the last of them goes on in the next chunk.

Planes bring bytes of one meaning together: high bytes of small ids are nearly constant.

Writing: documents are dealt by ranges of (id, text hash), sorted inside a range, encoded and
cut into chunks as they stream by; a task holds one chunk. Reading: chunks are sorted inside
their shard and streamed again; a document's ids may run over many chunks. Nothing is gathered
per shard or document beyond the document at hand.

Defined cases: a NULL text is an empty one and gives the end id alone; documents of equal id
follow each other by the hash of their texts; a NULL id sorts first; an empty table makes an
empty set of the right columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import fresh_path, parts, table

CHUNK_IDS = 1 << 16
END_ID = 1
LEVEL = 3
CHUNK_SCHEMA = (
    "shard int, chunk int, n_ids int, width int, planes array<binary>, "
    "doc_ids array<bigint>, doc_lens array<bigint>, open boolean"
)
MEMO_WORDS = 1_200_000


def to_planes(ids: np.ndarray, *, width: int, bits: bool) -> list[bytes]:
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if bits:
        spread = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(spread[:, k], bitorder="little") for k in range(8 * width)]
    else:
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(width)]
    pack = zstandard.ZstdCompressor(level=LEVEL)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, width: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), dtype=np.uint8) for p in planes]
    if len(raw) == width:
        whole = np.stack(raw, axis=1)
    else:
        spread = np.stack([np.unpackbits(p, count=n_ids, bitorder="little") for p in raw], axis=1)
        whole = np.packbits(spread, axis=1, bitorder="little")
    return np.ascontiguousarray(whole).view(f"<u{width}").reshape(-1).astype(np.uint32)


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


#: A control character that is no space and a word by itself: it parts words encoded together.
MARK = "\x01"

#: A stop or comma after Latin letters is a word by itself.
_STOPPED = re.compile(r"[a-zß-öø-ÿ]+[.,]")


_PLAIN = re.compile(r"[a-z]+")


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases, and whose words never reach over a space
    or a line feed, nor from a letter to a punctuation mark.

    Such a tokenizer gives the ids of a text as those of its pieces between spaces, so each
    piece goes through the tokenizer once and its ids are kept as bytes. ``bounded`` words are
    kept; then the memory starts anew. Texts of Latin letters are lower-cased first, and a new
    piece that is letters and a stop is put together from both, which leaves fewer to encode.
    """

    def __init__(self, tokenizer, bounded: int = MEMO_WORDS):
        self.tokenizer, self.bounded, self.memo = tokenizer, bounded, {"": b""}
        (self.mark,) = self._ids(MARK)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: set[str]) -> None:
        memo, model = self.memo, self.tokenizer.model
        # the tokenizer's normaliser and word splitter leave lower-case ASCII words as they are
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        memo.update((w, pack(f"<{len(t)}I", *[x.id for x in t])) for w, t in zip(plain, map(model.tokenize, plain)))
        new = new.difference(plain)
        clean = [w for w in new if MARK not in w]
        for start in range(0, len(clean), 4096):
            words = clean[start : start + 4096]
            found = self._ids(f" {MARK} ".join(words))
            # the mark is one id of its own, so the ids between two marks are those of one word
            cuts = np.flatnonzero(found == self.mark)
            ends, raw = np.append(cuts, len(found)) * 4, found.tobytes()
            begins = np.append(0, (cuts + 1) * 4)
            memo.update((w, raw[i:j]) for w, i, j in zip(words, begins.tolist(), ends.tolist()))
        memo.update((w, self._ids(w).tobytes()) for w in new if MARK in w)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        pieces = [_pieces(text) for text in texts]
        if len(self.memo) > self.bounded:
            self.memo = {"": b""}
        memo = self.memo
        known = [list(map(memo.get, p)) for p in pieces]
        new = {w for p, k in zip(pieces, known) if None in k for w, g in zip(p, k) if g is None}
        stopped = [w for w in new if _STOPPED.fullmatch(w)]
        self._learn(new.difference(stopped).union({".", ","}, (w[:-1] for w in stopped)).difference(memo))
        memo.update((w, memo[w[:-1]] + memo[w[-1]]) for w in stopped)
        return [b"".join(map(memo.__getitem__, p) if None in k else k) for p, k in zip(pieces, known)]


def _pieces(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").split(" ")


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, one per Python worker."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[path] = WordEncoder(Tokenizer.from_file(path))
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, width: int = 2, bits: bool = False,
                      shards: int | None = None) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending order of their id."""
    spark = docs.sparkSession

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer_path)
        shard, chunk = TaskContext.get().partitionId(), 0
        buffer, room, doc_ids, doc_lens, opened = [], chunk_ids, [], [], False

        def row(still_open: bool) -> dict:
            ids = np.concatenate(buffer)
            return {
                "shard": shard, "chunk": chunk, "n_ids": len(ids), "width": width,
                "planes": to_planes(ids, width=width, bits=bits), "doc_ids": doc_ids, "doc_lens": doc_lens, "open": still_open,
            }

        for batch in batches:
            rows = []
            for start in range(0, len(batch), 64):
                some = batch.iloc[start : start + 64]
                texts = [t if isinstance(t, str) else "" for t in some["text"]]
                for doc_id, raw in zip(some["id"], encoder.encode(texts)):
                    ids = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id))
                    if int(ids.max()) >> (8 * width):
                        raise ValueError(f"an id needs more than {width} bytes")
                    at = 0
                    while at < len(ids):
                        taken = ids[at : at + room]
                        at += len(taken)
                        room -= len(taken)
                        buffer.append(taken)
                        doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                        doc_lens.append(len(taken))
                        if not room:
                            rows.append(row(at < len(ids)))
                            chunk, buffer, room, doc_ids, doc_lens = chunk + 1, [], chunk_ids, [], []
                            if len(rows) >= 16:
                                yield pd.DataFrame(rows)
                                rows = []
            if rows:
                yield pd.DataFrame(rows)
        if buffer:
            yield pd.DataFrame([row(False)])

    ordered = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards or parts(spark), "id", "tie")
        .sortWithinPartitions("id", "tie")
        .select("id", "text")
    )
    ordered.mapInPandas(encoded, CHUNK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files at ``path``."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at, crc, n, going = None, 0, 0, 0, False
        for batch in batches:
            rows = []
            for c in batch.itertuples(index=False):
                if c.shard != shard:
                    shard, at, going = c.shard, 0, False
                ids = from_planes(list(c.planes), c.n_ids, c.width).astype("<u4")
                done, last = 0, len(c.doc_lens) - 1
                for k, (doc_id, length) in enumerate(zip(c.doc_ids, c.doc_lens)):
                    if not going:
                        crc, n, first = 0, 0, at
                    crc = zlib.crc32(ids[done : done + length].tobytes(), crc)
                    done, n, at = done + int(length), n + int(length), at + int(length)
                    going = bool(c.open) and k == last
                    if not going:
                        rows.append((None if pd.isna(doc_id) else int(doc_id), shard, first, n, crc))
            out = pd.DataFrame(rows, columns=["doc_id", "shard", "local", "n_tokens", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    schema = T.StructType.fromDDL("doc_id bigint, shard int, local bigint, n_tokens bigint, ids_crc32 bigint")
    read = (
        chunks.repartition(parts(spark), "shard").sortWithinPartitions("shard", "chunk").mapInPandas(decoded, schema)
    )
    return read.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
