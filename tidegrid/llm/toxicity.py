"""Toxicity scores from a fuzzy lexicon and its context.

* The lexicon is learned from labelled rows: words, and stems (the first 4 to 7 letters of
  longer words), whose share among toxic documents is many times that among the others, either
  where they occur at all or where they occur three times.
* Its terms form a trie. A Levenshtein automaton runs over the trie: the states of both are
  followed together, so one walk over the letters of a word finds all terms within their edit
  limit. State sets are made once and kept as a table (a lazily built automaton), and almost
  every word falls out after a few letters. Words of six letters or more allow one edit after
  their first letter, shorter ones and stems none.
* A hit counts by its context window: inside quotation marks that open and close within the
  window it is taken as quotation and counts half; other hits in the window add to it, as abuse
  comes in runs; a misspelled hit counts three quarters.
* A logistic model over the strongest evidence, the weight of all hits and their density gives
  the score. It is fitted on at most ``FIT_ROWS`` labelled rows of each class, drawn by hash;
  class shares are restored by weights.

Scores look at the text alone. Whole texts are read.

Defined cases: NULL and empty texts have no hits and get the score of such texts; rows whose
label is NULL, or whose id is NULL, are not learned from; if a class has no labelled row, no text
is called toxic (score 0); repeated label rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import free_name, held, small_batches, table

FIT_ROWS = 6_000
LEXICON_TERMS = 400
STEMS = range(4, 8)
REPEATED = 3
LEAST_ODDS = 1.5
WINDOW = 6
SCORE_ROWS = 512
QUOTED, MISSPELLED, COMPANY = 0.5, 0.75, 0.25
#: What a Python worker keeps at most: words with their hits, states of the automaton.
MEMO_WORDS, MEMO_STATES = 30_000, 30_000
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile(r"[\"“”„«»‹›]")


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    word: int | None = None
    stem: int | None = None
    limit: int = 0
    reach: int = 0


class FuzzyTrie:
    """A trie of terms met by Levenshtein automata; ``find`` gives (term, edits) of a word.

    A state is a set of (trie node, edits so far). Reading a letter follows it in the trie, or
    spends an edit: on another letter of the trie, or on skipping the letter read. Letters that
    the word lacks are skipped in the trie at once.
    """

    def __init__(self, terms: list[tuple[str, bool, int]]):
        """``terms``: (letters, whether it is a stem, edit limit)."""
        self.nodes: list[Node] = [Node()]
        for number, (letters, stem, limit) in enumerate(terms):
            node = self.nodes[0]
            node.reach = max(node.reach, limit)
            for letter in letters:
                if letter not in node.children:
                    node.children[letter] = Node()
                    self.nodes.append(node.children[letter])
                node = node.children[letter]
                node.reach = max(node.reach, limit)
            if stem:
                node.stem = number
            else:
                node.word, node.limit = number, limit
        self.place = {id(n): i for i, n in enumerate(self.nodes)}
        self.forget()

    def forget(self) -> None:
        """Begin the table of states anew."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        key = frozenset(pairs)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        after, todo = set(), []
        for place, edits in self.sets[state]:
            node = self.nodes[place]
            if letter in node.children:
                todo.append((node.children[letter], edits))
            if place:  # the first letter must be right
                if edits < node.reach:
                    todo.append((node, edits + 1))
                todo += [(child, edits + 1) for child in node.children.values() if edits < child.reach]
        while todo:
            node, edits = todo.pop()
            pair = (self.place[id(node)], edits)
            if pair in after:
                continue
            after.add(pair)
            todo += [(child, edits + 1) for child in node.children.values() if edits < child.reach]
        found = self._state(after)
        self.steps[state][letter] = found
        return found

    def find(self, word: str) -> list[tuple[int, int]]:
        state, found = self.start, {}
        for letter in word:
            known = self.steps[state].get(letter)
            state = self._step(state, letter) if known is None else known
            if not self.sets[state]:
                break
            for place, edits in self.sets[state]:
                stem = self.nodes[place].stem
                if stem is not None and not edits:
                    found[stem] = 0
        for place, edits in self.sets[state]:
            node = self.nodes[place]
            if node.word is not None and edits <= node.limit:
                found[node.word] = min(edits, found.get(node.word, edits))
        return sorted(found.items())


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


class Lexicon:
    """Terms with their evidence; ``features`` reads one text."""

    def __init__(self, terms: list[tuple[str, bool, float, float]]):
        """``terms``: (letters, stem, evidence of one occurrence, evidence of several)."""
        self.terms = terms
        self.trie, self.memo = None, {}

    def __getstate__(self):
        return {"terms": self.terms, "trie": None, "memo": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _hits(self, word: str) -> tuple[tuple[int, int], ...]:
        if self.trie is None:
            self.trie = FuzzyTrie([(t, stem, int(not stem and len(t) >= 6)) for t, stem, _, _ in self.terms])
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if len(self.trie.sets) > MEMO_STATES:
            self.trie.forget()
        # words without hits share one empty tuple
        hits = self.memo[word] = tuple(self.trie.find(word))
        return hits

    def forget(self) -> None:
        """Leave nothing behind in a worker that goes on to other tasks."""
        self.trie = None
        self.memo.clear()

    def features(self, text: str | None) -> tuple[float, float, float]:
        words, memo = words_of(text), self.memo
        hit_words = {}
        for word in set(words):
            hits = memo.get(word)
            if hits is None:
                hits = self._hits(word)
            if hits:
                hit_words[word] = hits
        if not hit_words:
            return 0.0, 0.0, 0.0
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text.lower())]
        places = [i for i, w in enumerate(words) if w in hit_words]
        counts: Counter = Counter()
        total = 0.0
        for k, i in enumerate(places):
            left, right = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
            quoted = len(_QUOTES.findall(text[left : spans[i][0]])) % 2 == 1 and _QUOTES.search(text[spans[i][1] : right + 1])
            near = (k > 0 and i - places[k - 1] <= WINDOW) + (k + 1 < len(places) and places[k + 1] - i <= WINDOW)
            factor = (QUOTED if quoted else 1.0) * (1 + COMPANY * near)
            best = 0.0
            for term, edits in hit_words[words[i]]:
                share = factor * (MISSPELLED if edits else 1.0)
                counts[term] += share
                best = max(best, share * max(self.terms[term][2], 0.0))
            total += best
        top = max(self._evidence(term, n) for term, n in counts.items())
        return top, float(np.log1p(total)), float(np.log1p(100 * total / len(words)))

    def _evidence(self, term: int, n: float) -> float:
        _, _, once, often = self.terms[term]
        return often if n >= REPEATED else once if n >= 1 else once / 2


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.intercept + (features - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _term_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts: Counter = Counter()
            for word, n in Counter(words_of(text)).items():
                if 3 <= len(word) <= 40:
                    counts[word, False] += n
                for k in STEMS:
                    if len(word) > k:
                        counts[word[:k], True] += n
            side = 0 if toxic else 2
            for term, n in counts.items():
                row = seen.setdefault(term, [0, 0, 0, 0])
                row[side] += 1
                row[side + 1] += n >= REPEATED
        yield pd.DataFrame(
            [(*term, *row) for term, row in seen.items()], columns=["term", "stem", "toxic_1", "toxic_n", "clean_1", "clean_n"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS, terms: int = LEXICON_TERMS) -> Model:
    """Learn lexicon and weights from labelled rows (``labels``: the rows to learn from alone)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("label_id"), (F.col(label_col) > 0).cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = None
    for value in (0, 1):
        # at most fit_rows rows of each class
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
        drawn = part if drawn is None else drawn.unionByName(part)
    text = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    sample = held(text.join(F.broadcast(drawn), "label_id").select("text", "toxic"), "toxic-sample")
    have = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = have.get(1, 0), have.get(0, 0)
    if not toxic or not clean:
        return Model(Lexicon([]), np.zeros(3), np.ones(3), np.zeros(3), -30.0)

    def odds(a: str, b: str) -> Column:
        return F.log((F.col(a) + 0.5) / (toxic + 1)) - F.log((F.col(b) + 0.5) / (clean + 1))

    support = max(3.0, 0.01 * toxic)
    counted = (
        sample.mapInPandas(_term_rows, "term string, stem boolean, toxic_1 long, toxic_n long, clean_1 long, clean_n long")
        .groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("toxic_1", "toxic_n", "clean_1", "clean_n")])
        .where(F.col("toxic_1") >= support)
        .withColumn("once", odds("toxic_1", "clean_1"))
        .withColumn("often", F.when(F.col("toxic_n") >= support, odds("toxic_n", "clean_n")).otherwise(F.col("once")))
        .where(F.greatest("once", "often") >= LEAST_ODDS)
        .withColumn("use", F.greatest(F.col("once") * F.col("toxic_1"), F.col("often") * F.col("toxic_n")))
        .orderBy(F.desc("use"), "term", "stem").limit(terms).collect()
    )
    lexicon = Lexicon([(r["term"], r["stem"], float(r["once"]), float(max(r["once"], r["often"]))) for r in counted])
    if not counted:
        return Model(lexicon, np.zeros(3), np.ones(3), np.zeros(3), float(np.log((toxic + 0.5) / (clean + 0.5))))

    def feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([lexicon.features(t) for t in batch["text"]], columns=["a", "b", "c"], index=batch.index)
            yield out.assign(toxic=batch["toxic"])
        lexicon.forget()

    # three numbers a row, for at most twice fit_rows rows (more only where ids repeat)
    seen = sample.mapInPandas(feature_rows, "a double, b double, c double, toxic int").toPandas()
    x, y = seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy().astype(float)
    share = {1: sizes[1] / toxic, 0: sizes[0] / clean}
    weight = np.where(y == 1, share[1], share[0])
    return Model(lexicon, *_logistic(x, y, weight / weight.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple:
    """Mean, scale, weights and intercept by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta, penalty = np.zeros(a.shape[1]), np.diag([ridge * len(x)] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta[:-1], float(beta[-1])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row."""
    small_batches(docs.sparkSession)
    names = docs.columns
    text_at, row = names.index(text_col), free_name(docs, score_col)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*renamed.schema.fields, T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts become Python strings a few at a time
            for start in range(0, len(batch), SCORE_ROWS):
                some = batch.slice(start, SCORE_ROWS)
                features = np.array([model.lexicon.features(t) for t in some.column(text_at).to_pylist()]).reshape(len(some), 3)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(model.score(features))], names=schema.names)
        model.lexicon.forget()

    return renamed.mapInArrow(scored, schema).toDF(*names, row)


def not_held_out(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, not_held_out(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(1)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
