import random

import numpy as np
import public_tokenizers
import pytest

import tidegrid.llm.pieces as module
from tidegrid.llm.pieces import LOW, MARK, Pieces, decode, encode, times

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["the ", "of", "ing", " ", "  ", "\n", "é", "ß", "日", "a", "e", "t", "h", "in", "er", "tion", "x", "q"]


@pytest.fixture(scope="module")
def p():
    return Pieces(PATH)


def best_path(p, text):
    """A plain search over the whole text."""
    if not text:
        return []
    t = MARK + text.replace(" ", MARK)
    best, back = [0] + [None] * len(t), [None] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - p.longest), end):
            known = p.scores.get(t[start:end])
            if known is None and end - start == 1:
                known = (p.unknown, -1)
            if known and best[start] is not None and (best[end] is None or best[start] + known[0] > best[end]):
                best[end], back[end] = best[start] + known[0], (start, known[1])
    ids, place = [], len(t)
    while place:
        start, piece = back[place]
        ids[:0] = [piece] if piece >= 0 else p.spelled(t[start:place])
        place = start
    return ids


def test_chunks_scan_to_the_same_ids(p):
    random.seed(1)
    for n in range(200):
        text = "".join(random.choice(ALPHABET if n % 2 else ALPHABET[7:]) for _ in range(random.randint(1, 120)))
        want = best_path(p, text)
        assert np.frombuffer(p.encode(text), dtype="<i4").tolist() == want and p.decode(np.array(want)) == text
        t, size = MARK + text.replace(" ", MARK), random.choice([16, 17, 40])
        chunks = [(t[i : i + size], t[i + size : i + size + p.longest - 1]) for i in range(0, len(t), size)]
        state, sums = np.full(p.longest, LOW, dtype=np.int64), []
        state[0] = 0
        for c in chunks:
            sums.append(state)
            state = times(state[None, :], p.transfer(*c))[0]
        ways, leave = [p.entries(*c, s) for c, s in zip(chunks, sums)], [0] * len(chunks)
        for k in range(len(chunks) - 1, 0, -1):
            leave[k - 1] = ways[k][leave[k]]
        got = b"".join(p.chunk_ids(*c, s, v) for c, s, v in zip(chunks, sums, leave))
        assert np.frombuffer(got, dtype="<i4").tolist() == want


def test_products_are_associative(p):
    a, b, c = (p.transfer(x, "er th") for x in ("thethethethethethe", "ingingtiontionabcd", "zzzzzzzzzzzzzzzzzz"))
    assert (times(times(a, b), c) == times(a, times(b, c))).all()


def test_spark_scan_with_giant_and_odd_texts(spark, p, monkeypatch):
    monkeypatch.setattr(module, "FAN", 3)
    data = [(1, "the cat " * 60), (2, "ab" * 500), (2, "ab" * 500), (None, "x  y\n" * 90), (3, None), (4, ""), (5, "short"), (6, "no blank" * 2)]
    docs = spark.createDataFrame([(*d, 0) for d in data], "doc_id long, text string, ids int")
    out = encode(docs, PATH, chunk=50)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in out.collect())
    assert got == sorted((str(d), best_path(p, t)) for d, t in data)
    back = out.select(decode(out["ids"], PATH).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in data)
    assert encode(docs.limit(0), PATH).collect() == []


def test_words_solved_together_are_those_solved_alone(p):
    random.seed(4)
    words = ["".join(random.choice(ALPHABET).replace(" ", MARK) for _ in range(random.randint(1, 24))) for _ in range(400)]
    words += ["\ud800", "q" * 64, "日" * 3, MARK, MARK * 5, "\x00a"]
    assert p.together(words) == [p.word(w) for w in words]
    assert p.solved(words + words) == 2 * [p.word(w) for w in words]
    assert p.encode_all(["", "a b", "a b"]) == [b"", p.encode("a b"), p.encode("a b")]


def test_only_edges_of_chunks_travel(spark, monkeypatch):
    """A chunk is read once: what is written after that holds no text but its edges, and the
    words inside a chunk are not looked up again."""
    seen, real = {}, module.held

    def spy(df, name="held"):
        out = real(df, name)
        seen[name] = out
        return out

    monkeypatch.setattr(module, "held", spy)
    docs = spark.createDataFrame([(1, "some words of a text " * 50), (2, "x"), (None, "other words " * 90)], "doc_id long, text string")
    out = module.encode(docs, PATH, chunk=300, back_col="back")
    assert {(r["doc_id"], r["back"]) for r in out.select("doc_id", "back").collect()} == {tuple(r) for r in docs.collect()}
    assert "body" not in seen["chunks"].columns and not {"body", "inside"} & set(seen["edges"].columns)
    assert max(len(r["head"] + r["tail"]) for r in seen["edges"].collect()) < 100
