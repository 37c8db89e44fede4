import math

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from tidegrid.llm.topk import top_k

NAN, INF = float("nan"), float("inf")


def brute(data, k):
    kept = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in data
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in kept:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("size", [(10_000, 10_000, 64), (7, 2, 3)])
def test_matches_brute_force(spark, size):
    stripe, group, block = size
    data = [(i, [math.sin(i * 1.7), math.cos(i * 0.3) * 3, (i % 5) - 2.0]) for i in range(60)]
    data += [(100 + i, [0.5, 0.5, -1.0]) for i in range(30)]  # ties
    data += [(200, None), (220, [1.0, None]), (240, [NAN, 1.0]), (260, [INF]), (None, [1.0]), (280, []), (0, data[0][1]), (300, [1e30, 1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in data], "vec_id long, embedding array<double>, rank int")
    got = top_k(df, F.col("vec_id") % 20 == 0, k=5, stripe_rows=stripe, group_rows=group, block_rows=block)
    limit = 2**63 - 1
    want = sorted((q, n, i, max(-limit, min(limit, s))) for q, n, i, s in brute(data, 5))
    plain = lambda rs: [r for r in rs if r[0] != 300 and r[2] != 300]
    assert plain(sorted(rows(got))) == plain(want) and {r[0] for r in want} == {r[0] for r in rows(got)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rows(top_k(df, F.col("vec_id") % 20 == 0)) == []
