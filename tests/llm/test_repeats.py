import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import SF_DIR, rows
from tidegrid.llm import repeats, suffixes
from tidegrid.llm.repeats import op12_suffix_dedup, without_repeats


def brute(docs, length=100):
    """Windows in order of (id, hash order of texts, start): each that was seen before is covered."""
    seen, out = {}, {}
    for doc_id, text in docs:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if seen.setdefault(data[s : s + length], (doc_id, s)) != (doc_id, s):
                covered[s : s + length] = b"\x01" * length
        edges = [i for i in range(len(data)) if covered[i] and (i == 0 or not covered[i - 1])]
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out[doc_id] = (len(data), sum(covered), len(edges), hashlib.sha256(kept).hexdigest())
    return out


def test_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    got = {r[0]: tuple(r)[1:] for r in op12_suffix_dedup(spark, SF_DIR).collect()}
    assert got == brute(docs) and len(got) == len(docs)


def shared(spark, docs, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, key string")
    out = {}
    for r in without_repeats(df, **more).collect():
        removed = sum(s["end"] - s["begin"] for s in r["spans"])
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return out


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_passages_edits_periods_and_odd_rows(spark, group_rows):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(7))
    passage = " ".join(word() for _ in range(30))
    line = "a line that very many documents share, and that is longer than a window of one hundred bytes, as it seems to be"
    docs = [(i, f"{word()} {word()}{line}{word()} {i}") for i in range(60)]
    docs += [(100 + i, passage[: 3 * i] + word() + passage[3 * i + 5 :]) for i in range(12)]
    docs += [(200, "ab" * 400), (201, "a" * 350), (202, "ab" * 150), (203, None), (204, ""), (205, "x" * 99), (206, "y" * 100), (207, "y" * 100)]
    docs += [(300, passage + " and " + passage), (301, passage[:99]), (302, passage[:100])]
    want = brute(sorted(docs, key=lambda d: d[0]))
    got = shared(spark, docs, group_rows=group_rows)
    assert {k: v for k, (v,) in got.items()} == want


def test_repeated_rows_and_missing_ids(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(180))
    got = shared(spark, [(5, text), (5, text), (7, text), (None, text[40:160])])
    first = hashlib.sha256(text[40:160].encode()).hexdigest()
    assert got[None] == [(120, 0, 0, first)]
    assert got[5] == [got[5][0]] * 2 and got[5][0][1] == 120 and got[7][0][1] == 180


def test_long_texts_are_cut_the_same_way(spark, monkeypatch):
    draw = np.random.default_rng(0)
    raw = draw.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 700, 5000])
    whole = repeats.anchors(raw, offsets)
    cut = repeats.anchors(raw, offsets, piece=1000)
    windows = lambda found: {(int(f) + i, int(p)) for _, p, f, n, _ in zip(*found) for i in range(n)}
    assert windows(whole) == windows(cut) and len(windows(whole)) == 601 + 4201


def test_empty_table_and_short_windows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(without_repeats(df)) == []
    with pytest.raises(ValueError):
        without_repeats(df, length=20)


@pytest.mark.parametrize("bases", [suffixes.BASES, (2, 1 << 32)])
def test_suffixes_are_sorted_whatever_the_hash(bases, monkeypatch):
    # an even base forgets early bytes: the sort must notice and go on to the bytes
    monkeypatch.setattr(suffixes, "BASES", bases)
    monkeypatch.setattr(suffixes, "_POWERS", {})
    if bases[0] == 2:
        monkeypatch.setattr(suffixes, "_powers", lambda base, n: (np.zeros(n, dtype=np.uint64),) * 2)
    random.seed(2)
    parts = ["".join(random.choice("ab") for _ in range(random.randrange(0, 60))).encode() for _ in range(300)]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    groups = np.sort(np.array([random.randrange(12) for _ in parts]))
    order, common = suffixes.Suffixes(raw, np.cumsum(lengths) - lengths, lengths, groups).sort()
    assert [(groups[i], parts[i]) for i in order] == sorted(zip(groups, parts))
    for k in range(1, len(order)):
        x, y = parts[order[k - 1]], parts[order[k]]
        same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert common[k] == (same if groups[order[k]] == groups[order[k - 1]] else -1)
