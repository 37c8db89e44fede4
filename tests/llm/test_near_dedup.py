import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from tests.llm.conftest import SF_DIR, rows
from tidegrid.llm.graph import components, connect
from tidegrid.llm.near_dedup import keep_first, near_groups, op4_near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, width):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(data, width):
    sets, up = [grams(t, width) for _, t in data], list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(data)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(data):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(data, sets))]


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = [(d, n, c, d == c) for d, n, c in brute(docs, 2)]
    assert sorted(rows(op4_near_dedup(spark, SF_DIR))) == sorted(want)


def test_chains_of_edits_ties_and_odd_rows(spark):
    random.seed(4)
    data, base = [], [f"w{random.randrange(10**6)}" for _ in range(80)]
    for i in range(90):  # a chain of small edits, a large group of near copies, and loners
        words = list(base)
        for k in range(i // 3 if i < 45 else 2):
            words[(i * 7 + k * 5) % 80] = f"x{i if i >= 45 else k}"
        data.append((1000 - i, " ".join(words)))
    data += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "a b c d e f"), (8, "a b c d e f")]
    docs = spark.createDataFrame([(*d, b"k") for d in data], "doc_id long, text string, grp binary")
    got = near_groups(docs, width=2).select("doc_id", "n_shingles", "component_id")
    assert sorted(rows(got)) == sorted(brute(data, 2))
    kept = rows(keep_first(docs, width=2).select("doc_id", "text"))
    want = sorted((d, t) for (d, t), (_, n, c) in zip(data[:-1], brute(data, 2)) if d == c)
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rows(near_groups(docs)) == [] and rows(keep_first(docs)) == []


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(900, 901), (901, 902), (5, 5)], "a long, b long")
    assert dict(rows(components(edges))) == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900, 902: 900}


def test_hubs_with_disjoint_edits(spark):
    random.seed(8)
    data = []
    for hub in range(40):  # the copies of a hub are linked with it alone, mostly in buckets of two
        base = [f"h{random.randrange(10**7)}" for _ in range(80)]
        data.append((hub * 10, " ".join(base)))
        for leaf in range(1, 7):
            words = list(base)
            words[leaf * 11] = f"edit{hub}x{leaf}"
            data.append((hub * 10 + leaf, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in near_groups(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute(data, 5))
    assert {c for _, _, c in got} == {hub * 10 for hub in range(40)}


def test_pairs_of_two_and_keys_left_out(spark):
    # a links x and y in buckets of two; b's closest partner fails, the second is its link
    edges = {("a", "x"), ("a", "y"), ("b", "w")}
    near = {("a", "x"): 0.9, ("a", "y"): 0.8, ("b", "v"): 0.9, ("b", "w"): 0.8}
    nodes = spark.createDataFrame([(n, 1) for n in "abvwxy"], "node string, n int")
    likeness = F.create_map(*[F.lit(x) for pair, c in near.items() for x in ("".join(pair), c)])
    pair_of = lambda a, b: F.concat(F.least(f"{a}node", f"{b}node"), F.greatest(f"{a}node", f"{b}node"))
    buckets = spark.createDataFrame([(k, n) for k, pair in enumerate(near) for n in pair], "key long, node string")
    links = spark.createDataFrame(sorted(edges), "a string, b string")
    got = connect(buckets, nodes, lambda a, b: F.try_element_at(likeness, pair_of(a, b)), 0.5, lambda pairs: pairs.join(links, ["a", "b"]))
    assert set(rows(got)) == edges
