import random
from itertools import combinations

from tests.llm.conftest import SF_DIR, rows
from tidegrid.llm.line_dedup import DISTANCE, block_masks, line_groups, normal_lines, op1_line_dedup, simhashes, without_repeats


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def brute(docs):
    """(doc_id, line_no) -> first (doc_id, line_no) of its group; ids are distinct."""
    places = [(d, no, line) for d, t in docs if t is not None for no, line in enumerate(normal_lines(t)) if line]
    forms = sorted({line for _, _, line in places})
    sims = [int(s) & (2**64 - 1) for s in simhashes(forms)] if forms else []
    up = {f: f for f in forms}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for (a, s), (b, t) in combinations(zip(forms, sims), 2):
        x, y = a.decode(), b.decode()
        # lines of one group need no further link
        if bin(s ^ t).count("1") <= DISTANCE and root(a) != root(b) and 100 * edits(x, y) <= 20 * max(len(x), len(y)):
            up[root(b)] = root(a)
    first = {}
    for d, no, line in sorted(places):
        first.setdefault(root(line), (d, no))
    return {(d, no): first[root(line)] for d, no, line in places}


def found(df):
    return {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in df.collect()}


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = op1_line_dedup(spark, SF_DIR)
    assert found(got) == brute(docs)
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["first_doc_id"], r["first_line_no"])) for r in got.collect())


def test_near_lines_and_odd_rows(spark):
    random.seed(2)
    words = [f"longword{random.randrange(10**6)}" for _ in range(120)]
    near = [" ".join(words[:k] + [f"other{i}word"] + words[k + 1 :]) for i, k in enumerate(range(0, 120, 3))]
    docs = [(i + 10, f"{line}\nown line {chr(97 + i % 26)} {chr(97 + i // 26)} number{'x' * i}") for i, line in enumerate(near)]
    docs += [(1, None), (2, ""), (3, "\n\n ... \n"), (4, "Same Line!"), (5, "same line\nsame   line"), (6, "é\n12\n99")]
    df = spark.createDataFrame([(*d, "g") for d in docs], "doc_id long, text string, gone string")
    got = line_groups(df).select("doc_id", "line_no", line_first())
    want = brute(docs)
    assert {(r[0], r[1]): tuple(r[2]) for r in got.collect()} == want
    assert len({v for k, v in want.items() if k[0] >= 10 and k[1] == 0}) < len(near)  # near lines do link
    out = dict(without_repeats(df).select("doc_id", "text").collect())
    for d, t in docs:
        kept = None if t is None else "\n".join(
            line for no, line in enumerate(t.split("\n")) if want.get((d, no), (d, no)) == (d, no))
        assert out[d] == kept
    assert without_repeats(df).columns == df.columns
    assert 5 not in {r["doc_id"] for r in without_repeats(df, drop_emptied=True).collect()}
    assert rows(line_groups(df.limit(0))) == [] and rows(without_repeats(df.limit(0))) == []


def line_first():
    from pyspark.sql import functions as F

    return F.struct("first_id", "first_line").alias("first")


def test_masks_cover_all_pairs_of_blocks():
    masks = [m & (2**64 - 1) for m in block_masks(3)]
    assert len(masks) == 10
    for flips in ((0, 1, 2), (0, 30, 63), (12, 13, 40)):
        changed = sum(1 << b for b in flips)
        assert any(not m & changed for m in masks)


def test_keys_are_dealt_out_once(spark, monkeypatch):
    """Hashes of a key meet in one shuffle; no second table of all keys is joined to them."""
    import contextlib
    import io

    import tidegrid.llm.line_dedup as module

    plans, real = {}, module.held

    def spy(df, name="held"):
        with contextlib.redirect_stdout(io.StringIO()) as shown:
            df.explain()
        plans[name] = shown.getvalue()
        return real(df, name)

    monkeypatch.setattr(module, "held", spy)
    docs = spark.createDataFrame([(1, "some longer words here\nother line"), (2, "some longer words here!"), (3, "number")], "doc_id long, text string")
    got = line_groups(docs).select("doc_id", "line_no", line_first()).collect()
    assert {(r[0], r[1]): tuple(r[2]) for r in got} == brute([tuple(r) for r in docs.collect()])
    assert "Join" not in plans["close"] and "Window" in plans["close"]


def test_edits_found_are_never_too_few(spark):
    from tidegrid.llm.line_dedup import edits_found

    random.seed(5)
    for n in range(400):
        a = "".join(random.choice("ab é日") for _ in range(random.randint(0, 60)))
        b = list(a if n % 4 else a[20:] + a[:20])
        for _ in range(random.randint(0, 8)):
            k = random.randint(0, len(b))
            b[k : k + random.randint(0, 1)] = random.choice(["", "x", "日"])
        b = "".join(b)
        for bound in (0, 3, 12, 60):
            assert edits_found(a, b, bound) >= edits(a, b)
    line = " ".join(f"word{random.randrange(10**6)}" for _ in range(80))
    changed = line[:40] + "other" + line[43:300] + line[307:500] + "é" + line[501:]
    assert edits(line, changed) <= edits_found(line, changed, len(line) // 5) <= 20  # proved at sight
