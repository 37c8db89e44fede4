import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import SF_DIR
from tidegrid.llm.common import fresh_path
from tidegrid.llm.token_files import from_planes, op6_token_files, read_token_files, to_planes, word_encoder, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(pairs):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in pairs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(bits, width):
    ids = np.random.default_rng(1).integers(0, 1 << 16, 1003).astype(np.uint32)
    assert (from_planes(to_planes(ids, width=width, bits=bits), len(ids), width) == ids).all()


def test_encoder_gives_the_ids_of_the_library():
    texts = ["Hello, world. It's  a\ttest\n\nof 'em.", "naïve Straße, élan.É,", "ΑΣ Σ. ΟΔΟΣ, x", "a\x01b \x01 c", "<|endoftext|> a<|startoftext|>",
             "e\u0301 o\u0308x", "\xa0x\u3000y\x85z\x1c", "日本語。 テスト", "AB,c.d .e ,f g.. h.,", "İstanbul ǅ ﬁ", "", " ", "1234,5. 6"]
    library = Tokenizer.from_file(PATH)
    for text, raw in zip(texts, word_encoder(PATH).encode(texts)):
        assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_whole_table_reads_back(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    assert sorted(tuple(r) for r in op6_token_files(spark, SF_DIR).collect()) == expected(docs)


@pytest.mark.parametrize("bits", [False, True])
def test_small_chunks_nulls_repeats_and_empty_tables(spark, bits):
    data = [(None, "z"), (1, None), (2, ""), (3, "same same"), (3, "same same"), (9, "long words here " * 50)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    path = fresh_path(spark, "t")
    write_token_files(docs, path, PATH, chunk_ids=7, bits=bits, width=4, shards=3)
    assert sorted(map(tuple, read_token_files(spark, path).collect()), key=lambda r: r[1]) == expected(data)
    path = fresh_path(spark, "t")
    write_token_files(docs.limit(0), path, PATH)
    assert read_token_files(spark, path).collect() == []
