import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import canonical, oracle_connection
from tests.llm.conftest import SF_DIR
from tidegrid.llm import divergence
from tidegrid.llm.divergence import OP13_SQL, audit, op13_source_divergence
from tidegrid.llm.terms import LETTERS, lowered, sort_words, words

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, least, top):
    named = [((lang or ""), (source or ""), Counter(TERM.findall((text or "").translate(LOWER)))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in named}:
        mine = [x for x in named if x[0] == lang]
        df = Counter(w for *_, bag in mine for w in bag)
        kept = [w for w in df if df[w] >= least]
        counts = {s: sum((bag for _, x, bag in mine if x == s), Counter()) for s in {x[1] for x in mine}}
        whole = sum(counts.values(), Counter())
        share = lambda bag: {w: 1 + 10**9 * (bag[w] + 2) // (sum(bag[v] for v in kept) + 2 * len(kept)) for w in kept}
        p, q = {s: share(bag) for s, bag in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in counts if o != s)
            words_ = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", words_)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_sql_on_the_whole_table(spark):
    con = oracle_connection(SF_DIR)
    cursor = con.execute(OP13_SQL)
    got = op13_source_divergence(spark, SF_DIR)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("tile, slice_bytes", [(256, 1 << 20), (2, 60)])
def test_odd_rows_ties_and_tiles(spark, monkeypatch, tile, slice_bytes):
    monkeypatch.setattr(divergence, "TILE", tile)
    base = "Alpha beta-gamma ÄÖ délta internationalisation internationalisations"
    docs = [(base + " beta" * (i % 4) + (" only" if i % 5 == 0 else ""), "en", f"s{i % 5}") for i in range(40)]
    docs += [(base, "en", "s1")] * 2 + [(None, "en", "silent"), ("", "en", "silent"), ("beta", None, None), ("123 !", "", "a"), ("only beta " * 30, "en", None)]
    docs += [("rare words here", "de", f"t{i}") for i in range(3)]
    df = spark.createDataFrame([(t, la, s, 3) for t, la, s in docs], "text string, lang string, source string, n int")
    got = audit(df, least_documents=5, top_terms=3, slice_bytes=slice_bytes)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 5, 3)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], "text string, lang string, source string")).isEmpty()


def test_pointers_are_sorted_by_words():
    draw = np.random.default_rng(3)
    text = " ".join("".join(draw.choice(list("abé"), draw.integers(1, 30))) for _ in range(500)).encode()
    raw = np.frombuffer(text, dtype=np.uint8)
    starts, lengths, _ = words(raw, np.array([0, len(raw)]), LETTERS)
    order, first = sort_words(lowered(raw), starts, lengths)
    listed = [text[s : s + n] for s, n in zip(starts[order], lengths[order])]
    assert listed == sorted(text.split()) and first.tolist() == [i == 0 or listed[i] != listed[i - 1] for i in range(len(listed))]
