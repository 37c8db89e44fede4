from tests.llm.conftest import rows
from tidegrid.llm.toxicity import FuzzyTrie, Lexicon, fit, not_held_out, op5_toxicity, score

SF = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_trie_walk_matches_edit_distances():
    terms = [("stupid", False, 1), ("idiot", False, 0), ("worthless", False, 2), ("lowe", True, 0), ("stupor", False, 1)]
    trie = FuzzyTrie(terms)
    words = ["stupid", "stupd", "stuppid", "stvpid", "ztupid", "stuvid", "stupids", "tupid", "idiot", "idiots", "worthles", "wrthles", "wrthlex", "low",
             "lower", "lowe", "stupir", "stupo", "", "s", "worth", "worthlessly"]
    for word in words:
        want = []
        for n, (term, stem, limit) in enumerate(terms):
            if stem:
                if word.startswith(term):
                    want.append((n, 0))
            elif word and word[0] == term[0] and edits(word[1:], term[1:]) <= limit:
                want.append((n, edits(word[1:], term[1:])))
        assert trie.find(word) == want, word


def test_context_parts_quotation_from_abuse():
    lexicon = Lexicon([("stupid", False, 4.0, 5.0)])
    plain = lexicon.features("you are stupid and that is all")
    quoted = lexicon.features('she said "you are stupid" and that is all')
    misspelled = lexicon.features("you are stupidd and that is all")
    many = lexicon.features("stupid stupid stupid stupid")
    assert quoted[1] < misspelled[1] < plain[1] < many[1] and quoted[0] < plain[0] < many[0]
    assert lexicon.features(None) == lexicon.features("") == lexicon.features("fine words") == (0.0, 0.0, 0.0)


def test_held_out_rows_are_told_apart(spark):
    got = {r["doc_id"]: r for r in op5_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[d]["predicted"], y) for d, y in labels.items() if got[d]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    assert all(p == 0 for p, y in held if y == 0)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "vile vile nasty", 3.0), (2, "fine day", 1.0), (3, None, 2.0), (None, "", 0.0), (1, "vile vile nasty", 3.0), (4, "x " * 5000, 9.0)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = fit(docs, not_held_out(labels))
    out = score(docs, model, score_col="score")
    assert out.columns == ["doc_id", "text", "score", "_score"] and out.count() == 6
    none = fit(docs, labels.limit(0))
    assert {round(r["_score"], 9) for r in score(docs, none).collect()} == {0.0}
    assert rows(score(docs.limit(0), none)) == []
