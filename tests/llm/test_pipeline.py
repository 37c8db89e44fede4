"""The pipeline against brute-force versions of its stages, stage by stage."""

from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SF_DIR
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_groups
from tidegrid.llm import toxicity
from tidegrid.llm.common import fresh_path
from tidegrid.llm.line_dedup import normal_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start, clean, lines, groups, mixed, encoded = kept

    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(source, toxicity.not_held_out(spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    assert sorted(clean) == sorted(
        r for r in start if model.score(np.array([model.lexicon.features(r["text"])]))[0] < 0.5)

    first = brute_lines([(r["doc_id"], r["text"]) for r in clean])
    want = {}
    for r in clean:
        own = [no for no, line in enumerate(normal_lines(r["text"])) if line]
        left = [x for no, x in enumerate(r["text"].split("\n")) if first.get((r["doc_id"], no), (r["doc_id"], no)) == (r["doc_id"], no)]
        if not own or any(first[r["doc_id"], no] == (r["doc_id"], no) for no in own):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    alone = {d for d, _, c in brute_groups([(r["doc_id"], r["text"]) for r in lines], 5) if d == c}
    assert sorted(groups) == sorted(r for r in lines if r["doc_id"] in alone)

    copies = Counter(mixed)
    assert set(copies) <= set(groups) and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed)
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in encoded)


def test_run_gives_the_last_stage(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, f: d.where("doc_id % 2 = 0")), ("b", lambda s, d, f: d.select("doc_id"))])
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id"] and all(r[0] % 2 == 0 for r in got.collect())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, docs):
    """A folder with these documents, and labels of those with an id."""
    df = spark.createDataFrame(docs, DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d[0], 1, int("awful" in (d[1] or ""))) for d in docs if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return df, str(tmp_path)


def through(spark, docs, folder):
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    return seen


def test_stages_with_odd_rows(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(40))
    docs = [(i, f"clean text number {i} about {'abcdefghij'[i % 10] * 5} things {i * 7}", "en", f"s{i % 3}", None) for i in range(40)]
    docs += [(100 + i, f"an awful awful awful thing {i}", "en", "s0", 5) for i in range(40)]
    docs += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t\n", "en", "s1", 4), (203, base, "en", None, 9), (203, base, "en", None, 9),
             (204, base + "\n" + base, "en", "s1", 9), (205, "x" * 30_000, "en", "s2", 9), (None, "no id but words", "en", "s2", 9)]
    df, folder = written(spark, tmp_path, docs)
    toxic, lines, groups, mixed, encoded = through(spark, df, folder)
    ids = {r["doc_id"] for r in toxic.collect()}
    assert not ids & set(range(100, 140)) and {200, 201, 202, 203, 204, 205, None} <= ids
    assert toxic.columns == lines.columns == groups.columns == mixed.columns == df.columns
    assert {200, 201, 202} <= {r["doc_id"] for r in lines.collect()}
    kept = [r["doc_id"] for r in groups.collect()]
    assert kept.count(203) <= 1 and None in kept
    assert {r["doc_id"] for r in mixed.collect()} <= set(kept)
    assert all(r["round_trip"] for r in encoded.collect())


def test_stages_of_an_empty_table(spark, tmp_path):
    df, folder = written(spark, tmp_path, [])
    assert all(found.isEmpty() for found in through(spark, df, folder))
