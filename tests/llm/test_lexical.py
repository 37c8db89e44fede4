import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import canonical, oracle_connection
from tests.llm.conftest import SF_DIR
from tidegrid.llm.lexical import OP11_SQL, class_scores, op11_ranked_search, search
from tidegrid.llm.terms import LETTERS_DIGITS, Vocabulary, lowered, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    queries = {}
    for item_id, text in items:
        queries.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, query in queries.items():
        scored = []
        for d, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in query if w in b)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item_id, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_sql_on_the_whole_table(spark):
    con = oracle_connection(SF_DIR)
    cursor = con.execute(OP11_SQL)
    got = op11_ranked_search(spark, SF_DIR)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("more", [{}, {"item_block": 2, "slice_bytes": 40}])
def test_copies_ties_and_odd_rows(spark, more):
    docs = [(i, "Alpha beta gamma " + "filler " * (i % 3)) for i in range(40)] + [(i, "beta") for i in range(40, 45)]
    docs += [(50, None), (51, ""), (52, "... !"), (53, "ALPHA alpha Älpha 1a"), (53, "ALPHA alpha Älpha 1a"), (None, "alpha alpha beta beta"), (54, "alpha " * 300 + "Ω" * 90)]
    items = [(1, "alpha, beta?"), (1, "gamma"), (2, None), (3, "missing"), (4, "älpha 1A"), (None, "beta"), (5, "Älpha")]
    a = spark.createDataFrame([(d, t, 9, b"x") for d, t in docs], "doc_id long, text string, n int, bag binary")
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in search(a, b, k=7, **more).collect()), key=repr)
    assert got == brute(docs, items, 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert search(docs, items).isEmpty() and search(docs, items.limit(0)).isEmpty()


def test_a_vocabulary_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr("tidegrid.llm.terms.word_keys", lambda padded, starts, lengths: (lengths % 2).astype(np.uint64))
    listed = [b"aa", b"bb", b"ccc", b"long-word-of-many-letters", b"long-word-of-many-letterz"]
    vocabulary = Vocabulary(listed)
    text = b"bb ccc aa xx longwordofmanyletters ddd"
    raw = np.frombuffer(text, dtype=np.uint8)
    starts, lengths, _ = words(raw, np.array([0, len(raw)]), LETTERS_DIGITS)
    assert vocabulary.numbers(lowered(raw), starts, lengths).tolist() == [1, 2, 0, -1, -1, -1]


def test_scores_beyond_doubles_stay_exact():
    flat, of = np.array([[0, 3], [1, 5]]), np.array([0, 0])
    weights, holds = np.array([2**33 + 1, 2**33 + 3]), np.ones((2, 1), dtype=np.uint8)
    m = np.array([100])
    want = sum(w * (10**9 * tf // (1000 * tf + 800)) for w, tf in ((2**33 + 1, 3), (2**33 + 3, 5)))
    assert want > 2**52 and class_scores(flat, of, m, weights, holds).tolist() == [[want]]
