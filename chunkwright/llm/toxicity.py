"""Toxicity by a weighted finite-state pattern grammar.

The grammar composes five transducers over the words of a clause, each a table of states: one reads
insults, one threats (a threat needs someone it is aimed at), one targets, one negation and one
reported speech. Their product is one automaton. On an insult or a threatening word it puts out how
the word is said (NEGATED and REPORTED lower its weight), and at the clause's end what the clause is:
nothing, an insult, an insult aimed at someone, which weighs AIMED times as much, or a threat. Only
matched clauses score; words outside them, threatening words without a target among them, score
nothing. A text's strength is the logarithm of one plus the sum over its clauses.

The insult transducer's words and word beginnings, with their weights, are learned from labelled
texts as smoothed log odds; a logistic regression turns strength into a score. Both use at most
MAX_LABELLED labelled rows, those with the smallest hash of doc_id, outside the held-out fold, and
the lexicon has at most MAX_ENTRIES entries, those of most toxic texts, ties by term.

Defined results: null and empty texts score as a text without matches; very long texts are read
whole; without labelled rows, without toxic ones, or where no word tells them from the others, all
scores are 0; of labels for one text toxic wins; repeated rows each give a row; a null doc_id is not
held out; an empty table gives no rows; extra columns are ignored, whatever their names, and lang,
source and doc_id are never read by the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import map_rows, materialize, small_batches

#: Labelled rows that the fit may use.
MAX_LABELLED = 12_000
#: Lexicon entries, and what one needs: toxic texts, share of toxic texts, lengths of word beginnings.
MAX_ENTRIES, LEAST_TEXTS, LEAST_SHARE, BEGINNINGS = 2_000, 4, 0.7, range(3, 9)
#: Log-likelihood of a term's labels over those of any text's; chance gives this to about one term in e^9.
EVIDENCE = 9.0
THRESHOLD = 0.3

#: Words of the grammar's closed classes.
TARGETS = "you your yours u ur he she they them him her du dich dir dein deine ihr euch sie tu toi te vous votre ton ta tú usted ustedes vosotros tus él ella ellos".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun aucune ningún ninguna nunca tampoco".split()
REPORTS = "said says say called calls wrote writes quoted quote claimed told according sagte sagt schrieb nannte dit dite écrit appelé dijo dice llamó escribió según".split()
THREATS = "kill hurt destroy murder beat stab shoot strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
#: Words that a negation reaches.
NEGATION_REACH = 3
#: What a negation, reported speech and a target make of a match, and what a threat weighs (an insult's is its log odds).
NEGATED, REPORTED, AIMED, THREAT_WEIGHT = 0.25, 0.5, 1.5, 4.0

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = SYMBOLS = range(7)


def _component(states: int, moves: dict[tuple[int, int], int]) -> list[list[int]]:
    """A transducer's table: states x symbols, staying where no move is given; clause ends lead to state 0."""
    return [[0 if symbol == END else moves.get((state, symbol), state) for symbol in SYMBOLS] for state in range(states)]


class Automaton:
    """The product of the five transducers.

    after[state][symbol]: the next state. said[state][symbol]: what a match read there is multiplied by
    (0: no match). clause[state]: what insults and what threats count at the clause's end.
    """

    def __init__(self):
        insult = _component(2, {(0, INSULT): 1})
        threat = _component(3, {(0, THREAT): 1, (1, TARGET): 2})  # 1: a threatening word that waits for its target
        target = _component(2, {(0, TARGET): 1})
        # negation counts words down from its reach
        negation = [[0 if symbol == END else NEGATION_REACH if symbol == NEGATION else max(0, state - 1) for symbol in SYMBOLS] for state in range(NEGATION_REACH + 1)]
        report = _component(2, {(0, REPORT): 1})
        tables = (insult, threat, target, negation, report)
        states = list(product(*(range(len(t)) for t in tables)))
        number = {s: i for i, s in enumerate(states)}
        self.after = [[number[tuple(t[x][symbol] for t, x in zip(tables, s))] for symbol in SYMBOLS] for s in states]
        self.said, self.clause = [], []
        for insulted, threatened, aimed, negated, reported in states:
            factor = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            self.said.append([factor if symbol in (INSULT, THREAT) else 0.0 for symbol in SYMBOLS])
            made = threatened == 2 or threatened == 1 and aimed  # the target may stand before the threat
            self.clause.append(((AIMED if aimed else 1.0) if insulted else 0.0, 1.0 if made else 0.0))


class Grammar(dict):
    """Reads texts. As a dict it keeps the symbol and weight of words it has met."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], most: int = 150_000):
        super().__init__()
        self.words, self.beginnings, self.most = words, beginnings, most
        self.closed = dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(THREATS, THREAT)
        self.automaton = Automaton()

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        word = token.lower()
        weight = self.words.get(word) or max((self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if n <= len(word)), default=0.0)
        if not token[0].isalnum():
            found = END, 0.0
        elif word in self.closed:
            found = self.closed[word], THREAT_WEIGHT
        else:
            found = (INSULT, weight) if weight else (OTHER, 0.0)
        self[token] = found
        return found

    def clauses(self, text: str) -> list[float]:
        """The scores of the matched clauses."""
        marks = list(map(self.__getitem__, _TOKEN.findall(text)))
        if not any(m[0] in (INSULT, THREAT) for m in set(marks)):
            return []
        a = self.automaton
        found, state, insults, threats = [], 0, 0.0, 0.0
        for symbol, weight in (*marks, (END, 0.0)):
            if symbol == END:
                score = a.clause[state][0] * insults + a.clause[state][1] * threats
                if score:
                    found.append(score)
                insults = threats = 0.0
            elif symbol == INSULT:
                insults += a.said[state][symbol] * weight
            elif symbol == THREAT:
                threats += a.said[state][symbol] * weight
            state = a.after[state][symbol]
        return found

    def read(self, text: str) -> tuple[float, int]:
        """The text's strength and its number of matched clauses."""
        found = self.clauses(text)
        return math.log1p(sum(found)), len(found)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """toxic, text of the rows to learn from: one for each text."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    taken = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(taken, "doc_id").select("toxic", "text")
    return rows.groupBy(F.md5("text").alias("k")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], float]:
    """Words and word beginnings (at most MAX_ENTRIES) with weights, and the share of toxic rows."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_TOKEN.findall(text.lower()))
                found = words | {"^" + w[:n] for w in words for n in BEGINNINGS if n < len(w)}
                (toxic if label else clean).update(found)
        terms = list(toxic)  # a term that no toxic text of any partition has is never an entry
        rest = [t for t in clean if t not in toxic]
        both = terms + rest
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([toxic[t] for t in both], pa.int64()), pa.array([clean[t] for t in both], pa.int64())], names=["term", "toxic", "clean"])

    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    if not n_toxic:
        return {}, {}, 0.0
    counts = rows.select("toxic", "text").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") / n_toxic) / (F.col("toxic") / n_toxic + F.col("clean") / max(1, n_clean))
    least = F.col("toxic") / (F.col("toxic") + F.col("clean")) >= LEAST_SHARE
    part, prior = F.col("toxic") / (F.col("toxic") + F.col("clean")), n_toxic / totals[1]
    evidence = F.col("toxic") * F.log(part / prior) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - part) / (1 - prior + 1e-12))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    best = counts.where((F.col("toxic") >= LEAST_TEXTS) & least & (share > 0.9) & (evidence >= EVIDENCE)).select("term", odds.alias("odds"), "toxic").orderBy(F.desc("toxic"), "term").limit(MAX_ENTRIES).collect()
    words, beginnings = {}, {}
    most = Counter()  # by beginning, the texts of its most frequent word: a beginning must say more than that
    for term, _, n in best:
        if not term.startswith("^"):
            for k in BEGINNINGS:
                most[term[:k]] = max(most[term[:k]], n)
    for term, weight, n in sorted(best, key=lambda r: (not r[0].startswith("^"), len(r[0]), r[0])):
        bare = term.removeprefix("^")
        if term.startswith("^") and n < 1.3 * most[bare]:
            continue
        if any(beginnings.get(bare[:n], -1.0) >= weight for n in BEGINNINGS if n <= len(bare)):
            continue  # a shorter beginning says as much
        (beginnings if term.startswith("^") else words)[bare] = weight
    return words, beginnings, n_toxic / totals[1]


def fit_score(strength: np.ndarray, labels: np.ndarray, ridge: float = 0.1, steps: int = 25) -> tuple[float, float]:
    """Bias and weight of the strength by logistic regression; the weight isn't below 0."""
    x = np.c_[np.ones(len(strength)), strength]
    w, penalty = np.zeros(2), np.array([0.0, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        w = w - np.linalg.solve(hessian, gradient)
    return float(w[0]), max(0.0, float(w[1]))


class Model:
    """Lexicon and weights, as they are sent to the workers."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], weights: tuple[float, float] | None):
        self.words, self.beginnings, self.weights = words, beginnings, weights

    def score(self, strength: float) -> float:
        if self.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1] * strength))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    rows = materialize(labelled(docs, labels, most))
    words, beginnings, share = lexicon(rows)
    if not share or not (words or beginnings):
        return Model({}, {}, None)

    def make() -> Callable:
        grammar = Grammar(words, beginnings)
        return lambda r: {"toxic": r["toxic"], "strength": [grammar.read(t)[0] for t in r["text"]]}

    seen = map_rows(rows.select("toxic", "text"), make, "toxic int, strength double").collect()  # at most `most` rows of two numbers
    return Model(words, beginnings, fit_score(np.array([r[1] for r in seen]), np.array([r[0] for r in seen], float)))


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def make() -> Callable:
        grammar = Grammar(model.value.words, model.value.beginnings)

        def run(rows: dict[str, list]) -> dict[str, list]:
            read = [grammar.read(text or "") for text in rows["text"]]
            scores = [model.value.score(strength) for strength, _ in read]
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores], "n_clauses": [n for _, n in read]}

        return run

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int, n_clauses int")


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """docs without the rows that score as toxic; all columns, row by row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches):
        grammar = Grammar(model.value.words, model.value.beginnings)
        for batch in batches:
            keep = [model.value.score(grammar.read(text or "")[0]) < THRESHOLD for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, schema)
