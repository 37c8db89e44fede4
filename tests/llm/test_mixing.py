from collections import defaultdict

import pytest

from tests.llm.conftest import SF_DIR, rows
from tidegrid.llm.mixing import mix, mixed_documents, op10_mixing, source_targets


def water_fill(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 7, "é": 900}, {"a": 100}, {"x": 0, "y": 12}, {"a": 1, "b": 1, "c": 100000, "d": 2}])
def test_targets_match_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_words_stay_on_target_and_reruns_agree(spark):
    got = op10_mixing(spark, SF_DIR).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source_size"], r["target"]] += r["taken"]
    longest = max(r["size"] for r in got)
    assert all(abs(n - t) <= longest for (_, t), n in taken.items())
    assert sorted(got) == sorted(op10_mixing(spark, SF_DIR).collect())
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_odd_rows_and_clashing_columns(spark):
    data = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (2, None, "s", 2), (3, "", None, 3), (None, "x y", None, 4), (5, "w " * 500, "t", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, mix_copies int")
    plan = {(r["id"], r["source"]): r for r in mix(docs).collect()}
    assert plan[1, "s"]["rows"] == 2 and plan[1, "s"]["copies"] <= 6
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in rows(out):
        counts[r] += 1
    assert counts[data[0]] == plan[1, "s"]["copies"]
    assert all(counts[d] == plan[d[0], d[2]]["copies"] for d in data[2:])
    assert rows(mixed_documents(docs.limit(0))) == [] and rows(mix(docs.limit(0))) == []
