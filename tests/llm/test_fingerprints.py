import hashlib

import pytest

from tests.llm.conftest import SF_DIR, rows
from tidegrid.llm.fingerprints import Sketch, containment, edited_pairs, fingerprints, likeness, op3_fingerprints


def expected(pairs):
    out = {}
    for i, (doc_id, text) in enumerate(pairs):
        text, following = text or "", pairs[(i + 1) % len(pairs)][1] or ""
        n = len(text) // 2
        new = text[: len(text) - n] + following[:n]
        out[doc_id] = (len(text), hashlib.sha256(new.encode()).hexdigest(), Sketch(text).fingerprint(), Sketch(new).fingerprint(),
                       likeness(Sketch(text), Sketch(new)), likeness(Sketch(text), Sketch(following)))
    return out


def test_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    got = op3_fingerprints(spark, SF_DIR).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert len(got) == len(docs)
    assert {r[0]: tuple(r)[1:] for r in got} == expected(docs)


def test_odd_rows(spark):
    data = [(None, "first of all"), (1, None), (2, ""), (5, "é日 " * 9 + "x"), (7, "word " * 3000)]
    docs = spark.createDataFrame([(*d, 0) for d in data], "doc_id long, text string, part int")
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in edited_pairs(docs).collect()}
    assert got == {k: v[:2] for k, v in expected(data).items()}
    assert rows(edited_pairs(docs.limit(0))) == [] and rows(fingerprints(docs.limit(0))) == []
    one = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    assert [r["edited_sha256"] for r in edited_pairs(one).collect()] == [hashlib.sha256(b"abab").hexdigest()]
    same = spark.createDataFrame([(4, "abcd")] * 3, "doc_id long, text string")
    assert len(edited_pairs(same).collect()) == 3
    assert len(set(rows(fingerprints(same)))) == 1


def test_estimates_follow_the_sets():
    words = [f"w{i}" for i in range(4000)]
    a, b = Sketch(" ".join(words)), Sketch(" ".join(words[:400]))
    assert containment(b, a) == 1 and containment(a, b) == pytest.approx(0.1, abs=0.03)
    assert likeness(a, b) == pytest.approx(0.1, abs=0.03) and likeness(a, a) == 1
    assert likeness(Sketch(""), Sketch("")) == 1 and likeness(Sketch(""), Sketch("a")) == 0
