"""Toxicity: a learnt lexicon met by Levenshtein automata, judged in context.

Fitting, on labelled rows (at most ``MAX_ROWS``, by least hash of the id):
words and word beginnings whose document counts differ between the two labels
become the lexicon; a beginning is stretched as long as it keeps its documents,
and stands for the whole word where the word ends there. Counting is summed per
task and then by Spark; only the lexicon (at most ``MAX_TERMS``) reaches the
driver.

Scoring: the lexicon is a trie, and the automaton that accepts everything within
the allowed distance of a term is intersected with it; its states are made on
demand and remembered, so a word costs one step a character and most words die
after two. Every hit gets a context score (inside quotation marks, or beside a
verb of reporting, it counts less), and a logistic regression over the summed
scores gives the probability.

Defined cases: null or empty text has no words and gets the score of no hits;
without rows of both labels the score is the share of label 1 (0 for none);
null ids and repeated rows are scored row by row; an empty table gives an
empty one; null labels are not learnt from; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keeps, ship, take_worker

#: Labelled rows used for fitting at most, and lexicon terms at most.
MAX_ROWS, MAX_TERMS = 200_000, 5_000
#: Beginnings considered, in characters; a whole word ends with ``END``.
SHORTEST, LONGEST, END = 4, 12, "$"
#: Likelihood ratio statistic (one degree of freedom, p = 2e-4) and rate ratio a term needs.
EVIDENCE, RATIO = 14.0, 20.0
#: Share of its documents a beginning keeps when it is stretched.
KEEPS = 0.95
#: Context window in characters, weights of quoted and reported hits, verbs of reporting.
WINDOW, QUOTED, REPORTED = 200, 0.25, 0.5
REPORTING = frozenset("said says wrote called quoted quote claimed posted stated reported".split())

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
_FLUSH = 150_000
#: Words without a term nearby that a Python worker remembers at most.
CLEAR_WORDS = 200_000


def allowed(term: str) -> int:
    """Edits a term tolerates: none up to four letters, one up to eight, then two."""
    n = len(term.rstrip(END))
    return 0 if n <= 4 else 1 if n <= 8 else 2


def _terms(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(_WORD.findall((text or "").lower())):
        if len(w) >= SHORTEST:
            out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
            out.add(w + END)
    return out


def _counts(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """``term, n``: documents of ``rows`` (text) that hold each term, of ``only`` where given."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = _terms(text)
                seen.update(found if only is None else found & only)
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _evidence(a: int, n_a: int, b: int, n_b: int) -> float:
    """Log likelihood ratio of a term in a of n_a toxic and b of n_b other documents; 0 if rarer in the toxic."""
    if a * n_b <= b * n_a:
        return 0.0
    total, out = n_a + n_b, 0.0
    for o, n, k in ((a, n_a, a + b), (b, n_b, a + b), (n_a - a, n_a, total - a - b), (n_b - b, n_b, total - a - b)):
        if o:
            out += 2 * o * math.log(o * total / (n * k))
    return out


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], int, int]:
    """Terms and their log rate ratios from ``rows`` (text, label 0/1), and how many rows of label 1 and 0 there are."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_a, n_b = sizes.get(1, 0), sizes.get(0, 0)
    if not n_a or not n_b:
        return {}, n_a, n_b
    # a term needs some toxic documents to reach the evidence at all; the rest is not worth counting
    least = next((a for a in range(1, n_a + 1) if _evidence(a, n_a, 0, n_b) >= EVIDENCE), n_a + 1)
    common = _counts(rows.where("label = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(20 * MAX_TERMS)
    toxic = {r["term"]: r["n"] for r in common.collect()}
    if not toxic:
        return {}, n_a, n_b
    other = {r["term"]: r["n"] for r in _counts(rows.where("label = 0"), frozenset(toxic)).collect()}
    good, ratio = {}, {}
    for term, a in toxic.items():
        b = other.get(term, 0)
        rate = ((a + 0.5) / (n_a + 1)) / ((b + 0.5) / (n_b + 1))
        if rate >= RATIO and _evidence(a, n_a, b, n_b) >= EVIDENCE:
            good[term], ratio[term] = a, round(math.log(rate), 4)
    longer: dict[str, list[str]] = {}
    for term in good:
        longer.setdefault(term[:-1], []).append(term)
    chosen = set()
    for term in sorted(good, key=len):
        if any(term[:k] in good for k in range(SHORTEST, len(term))):
            continue  # a shorter beginning is as good and covers it
        while (best := max(longer.get(term, []), key=lambda t: (good[t], t), default=None)) and good[best] >= KEEPS * good[term]:
            term = best
        chosen.add(term)
    return {t: ratio[t] for t in sorted(chosen, key=lambda t: (-good[t], t))[:MAX_TERMS]}, n_a, n_b


#: What a word without a term nearby gets: distance and weight.
_NONE = (9, 0.0)


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie, states made on demand."""

    def __init__(self, terms: dict[str, float]) -> None:
        # per node: its children, and (edits tolerated, weight) of the beginning and the whole word ending there
        self.children: list[dict[str, int]] = [{}]
        self.begins: list[tuple[int, float]] = [(-1, 0.0)]
        self.wholes: list[tuple[int, float]] = [(-1, 0.0)]
        for term, weight in terms.items():
            node = 0
            for ch in term.rstrip(END):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.begins.append((-1, 0.0))
                    self.wholes.append((-1, 0.0))
                node = self.children[node][ch]
            (self.wholes if term.endswith(END) else self.begins)[node] = (allowed(term), weight)
        self.most = max(map(allowed, terms), default=0)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[tuple[int, float], tuple[int, float]]] = []
        self.clear: set[str] = set()
        self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> frozenset:
        """Adds the nodes reached by leaving out letters of a term."""
        work = list(at.items())
        while work:
            node, e = work.pop()
            if e < self.most and at[node] == e:
                for child in self.children[node].values():
                    if at.get(child, 99) > e + 1:
                        at[child] = e + 1
                        work.append((child, e + 1))
        return frozenset(at.items())

    def _state(self, at: frozenset) -> int:
        if at not in self.states:
            self.states[at] = len(self.sets)
            self.sets.append(at)
            self.next.append({})
            best = [min(((e, -ends[n][1]) for n, e in at if ends[n][0] >= e), default=(9, 0.0)) for ends in (self.begins, self.wholes)]
            self.found.append(tuple((e, -w) for e, w in best))
        return self.states[at]

    def _step(self, state: int, ch: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, child in self.children[node].items():
                cost = e if c == ch else e + 1
                if cost <= self.most and cost < to.get(child, 99):
                    to[child] = cost
            if e < self.most and e + 1 < to.get(node, 99):
                to[node] = e + 1
        out = self.next[state][ch] = self._state(self._closed(to)) if to else -1
        return out

    def nearest(self, word: str) -> tuple[int, float]:
        """Edits to the nearest term that tolerates them, and its weight; 9 edits for none."""
        return self.hits({word}).get(word, _NONE)

    def hits(self, words: set[str]) -> dict[str, tuple[int, float]]:
        """Edits and weight of every word that is near a term."""
        found = {}
        for word in words - self.clear:
            best = self._nearest(word)
            if best[0] < _NONE[0]:
                found[word] = best
            else:
                self.clear.add(word)
        if len(self.clear) > CLEAR_WORDS:
            self.clear.clear()
        return found

    def _nearest(self, word: str) -> tuple[int, float]:
        state, best = 0, _NONE
        for ch in word:
            to = self.next[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state < 0:
                return best
            if self.found[state][0][0] < best[0]:
                best = self.found[state][0]
        whole = self.found[state][1]
        return whole if (whole[0], -whole[1]) < (best[0], -best[1]) else best


FEATURES = ("exact", "near_density", "near", "quoted", "density")
#: Finding a term, misspelt or not, never makes a text less toxic; that it stands in quotes may.
LEAST_WEIGHTS = (0.0, 0.0, 0.0, -1000.0, 0.0)
#: Weight of the copy of a toxic text in which all terms count as misspelt.
MISSPELT = 0.5
_LIVE: dict[tuple, Automaton] = {}
keeps("toxicity", _LIVE.clear)


def _automaton(terms: tuple[tuple[str, float], ...]) -> Automaton:
    if terms not in _LIVE:
        _LIVE.clear()
        _LIVE[terms] = Automaton(dict(terms))
    return _LIVE[terms]


def _in_quotes(text: str, start: int, end: int) -> bool:
    before, after = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    for mark, close in _QUOTES.items():
        if mark == close:
            if before.count(mark) % 2 and mark in after:
                return True
        elif before.rfind(mark) > before.rfind(close) and close in after:
            return True
    return False


def features(text: str | None, automaton: Automaton, misspelt: bool = False) -> list[float]:
    """Numbers of ``FEATURES``; with ``misspelt`` every term counts as one edit away at least."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = automaton.hits(set(words))
    exact = near = quoted = 0.0
    if hits:
        tokens = list(_WORD.finditer(low))
        for i, m in enumerate(tokens):
            if m[0] not in hits:
                continue
            edits, weight = hits[m[0]]
            if _in_quotes(low, m.start(), m.end()):
                weight, quoted = weight * QUOTED, quoted + 1
            if any(t[0] in REPORTING for t in tokens[max(0, i - 6):i + 7]):
                weight *= REPORTED
            if edits == 0 and not misspelt:
                exact += weight
            else:
                near += weight / (1 + max(1, edits))
    near_density, density = (min(5.0, 20 * x / max(1, len(words))) for x in (near, exact))
    return [math.log1p(exact), near_density, math.log1p(near), math.log1p(quoted), density]


def with_features(rows: DataFrame, terms: dict[str, float], keep: list[str], misspelt: bool = False) -> DataFrame:
    """``keep`` columns of ``rows`` and ``features`` (array of double) of ``text``."""
    lexicon = tuple(terms.items())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        automaton = _automaton(lexicon)
        for batch in batches:
            out = [features(t, automaton, misspelt) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*keep, "features"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(measure, f"{kinds}, features array<double>")


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: list[float]
    intercept: float


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labels (doc_id, label), the least by a hash of the id.

    The bound makes the labels small enough to broadcast, so texts are not moved.
    """
    usable = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    bounded = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", "label")


def fit(labelled: DataFrame) -> Model:
    """Model from ``labelled`` (text, label 0/1, see ``training_rows``); label 1 is toxic."""
    ship(labelled.sparkSession)
    rows = cut(labelled.select("text", "label"), "labelled")
    terms, n_a, n_b = learn_lexicon(rows)
    if not terms:
        rate = n_a / max(1, n_a + n_b)
        return Model({}, [0.0] * len(FEATURES), math.log(rate / (1 - rate)) if 0 < rate < 1 else 40.0 * (2 * rate - 1))
    # labelled texts spell their terms right; copies of the toxic ones teach what the automaton's near hits are worth
    copies = with_features(rows.where("label = 1"), terms, ["label"], misspelt=True).withColumn("weight", F.lit(MISSPELT))
    both = with_features(rows, terms, ["label"]).withColumn("weight", F.lit(1.0)).union(copies)
    table = cut(both, "features").withColumn("features", array_to_vector("features"))
    bounds = Matrices.dense(1, len(FEATURES), LEAST_WEIGHTS)
    found = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=40, lowerBoundsOnCoefficients=bounds).fit(table)
    return Model(terms, [float(w) for w in found.coefficients], float(found.intercept))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, score`` (0 to 1)."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not model.terms:
        return own.select("doc_id", F.lit(1 / (1 + math.exp(-model.intercept))).alias("score"))
    weighed = F.aggregate(F.zip_with("features", F.array(*map(F.lit, model.weights)), lambda x, w: x * w), F.lit(model.intercept), lambda s, x: s + x)
    return with_features(own, model.terms, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-weighed))).alias("score"))


def keep_below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of ``docs`` (with ``text``) whose score is under ``limit``; columns as they are."""
    ship(docs.sparkSession)
    if not model.terms:
        return docs if 1 / (1 + math.exp(-model.intercept)) < limit else docs.limit(0)
    lexicon, weights, floor = tuple(model.terms.items()), model.weights, model.intercept
    bar = math.log(limit / (1 - limit))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        automaton = _automaton(lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            below = [floor + sum(w * x for w, x in zip(weights, features(t, automaton))) < bar for t in texts]
            yield batch.filter(pa.array(below, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
