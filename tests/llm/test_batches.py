"""Batches that reach Python workers are small, and texts are taken apart a few at a time."""

import public_tokenizers
import pytest

import tidegrid.llm.pieces as pieces
from tidegrid.llm import line_dedup, near_dedup
from tidegrid.llm.common import BATCH_BYTES

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
OPERATORS = {
    "pieces": lambda docs: pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), chunk=3000).select("doc_id", "ids"),
    "line dedup": line_dedup.without_repeats,
    "near dedup": near_dedup.keep_first,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_are_small_and_change_no_row(spark, name):
    # whole numbers as words: texts of 500 and of 30,000 letters, some twice
    docs = spark.createDataFrame([(i, " ".join(str(k * k) for k in range(i % 40, i % 40 + (80 if i % 9 else 5000)))) for i in range(120)], "doc_id long, text string")
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "64m")
        found = sorted(map(str, OPERATORS[name](docs).collect()))
        assert int(spark.conf.get(LIMIT)) == BATCH_BYTES
        spark.conf.set(LIMIT, "20000")
        assert sorted(map(str, OPERATORS[name](docs).collect())) == found and spark.conf.get(LIMIT) == "20000"
    finally:
        spark.conf.set(LIMIT, before)


def test_slices_are_bounded_by_rows_and_letters(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_ROWS", 4)
    monkeypatch.setattr(pieces, "SLICE_LETTERS", 100)
    assert list(pieces.bounds([])) == [] and list(pieces.bounds([0])) == [(0, 1)]
    assert list(pieces.bounds([10] * 9)) == [(0, 4), (4, 8), (8, 9)]
    assert list(pieces.bounds([60, 60, 500, 1, 99, 1])) == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6)]
