"""Toxic clauses by a weighted finite-state grammar."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.llm.common import per_slice

# Word lists of the grammar, in English, German, French and Spanish.
TARGETS = "you your yourself he she they them this that these those it who " \
    "du dich dir ihr euch er sie dieser diese dieses " \
    "tu toi te vous il elle ils elles ce cet cette ces " \
    "usted ustedes ese esa este esta".split()
NEGATIONS = "not no never neither nor nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORTS = "said says say wrote writes called calls quote quoted reported alleged " \
    "sagte sagt schrieb nannte dit disait dijo dice llamaba".split()
THREATS = "kill hurt destroy murder stab shoot attack beat burn hang " \
    "töten umbringen schlagen tuer frapper matar golpear".split()
ENDS = ".!?;:"
STRIP = "".join(chr(code) for code in range(33, 127) if not chr(code).isalnum())

# Classes of words: what the transducers read.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# Bound of the training sample: rows of each label.
ROWS_PER_LABEL = {1: 4000, 0: 8000}
# Insults are learnt as whole words and as stems of these lengths.
STEMS = (4, 5, 6)
LEAST_EVIDENCE = 1.5
MOST_INSULTS = 2000
MEMO_WORDS = 400_000
FEATURES = ("any", "plain", "targeted", "negated", "reported", "threat", "share")


@dataclass(frozen=True)
class Transducer:
    """States, and arcs from (state, class) to (state, output).

    A class without an arc stays where it is and puts out nothing. `END` always
    leads back to the start.
    """

    arcs: dict[tuple[str, int], tuple[str, frozenset[str]]]
    start: str = ""

    def step(self, state: str, kind: int) -> tuple[str, frozenset[str]]:
        if kind == END:
            return self.start, frozenset()
        return self.arcs.get((state, kind), (state, frozenset()))


def keeps_seen(kind: int, mark: str, reach: int, on: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """Marks an insult or a threat that follows a word of class `kind` in its clause.

    `reach` other words may stand between; a reach of 0 means the whole clause.
    """
    arcs = {("", kind): ("1", frozenset())}
    for far in range(1, reach + 1 if reach else 2):
        here = str(far)
        arcs[(here, kind)] = ("1", frozenset())
        if reach:
            arcs[(here, OTHER)] = (str(far + 1) if far < reach else "", frozenset())
        for found in on:
            arcs[(here, found)] = (here, frozenset([mark]))
    return Transducer(arcs)


def emits(kind: int, mark: str) -> Transducer:
    return Transducer({("", kind): ("", frozenset([mark]))})


@dataclass(frozen=True)
class Composed:
    """Two transducers that read the same words; their outputs are joined."""

    left: Transducer | Composed
    right: Transducer

    @property
    def start(self):
        return (self.left.start, self.right.start)

    def step(self, state, kind: int):
        a, first = self.left.step(state[0], kind)
        b, second = self.right.step(state[1], kind)
        return (a, b), first | second


GRAMMAR = reduce(
    Composed,
    [
        keeps_seen(TARGET, "targeted", reach=4),
        keeps_seen(NEGATION, "negated", reach=3),
        keeps_seen(REPORT, "reported", reach=0),
        emits(THREAT, "threat"),
    ],
    emits(INSULT, "insult"),
)


def table_of(grammar: Composed) -> dict[tuple[int, int], tuple[int, frozenset[str]]]:
    """The composed machine as numbered states, found from the start on."""
    number, queue, table = {grammar.start: 0}, [grammar.start], {}
    for state in queue:
        for kind in range(7):
            after, marks = grammar.step(state, kind)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            table[number[state], kind] = (number[after], marks)
    return table


def word_of(token: str) -> str:
    return token.strip(STRIP)


class Lexicon(dict):
    """Token -> (class, weight, whether a clause ends with it), remembered."""

    def __init__(self, insults: dict[str, float]):
        super().__init__()
        self.insults = insults
        self.fixed = {
            word: kind
            for kind, words in (
                (TARGET, TARGETS),
                (NEGATION, NEGATIONS),
                (REPORT, REPORTS),
                (THREAT, THREATS),
            )
            for word in words
        }

    def __missing__(self, token: str) -> tuple[int, float, bool]:
        word = word_of(token)
        weight = max(
            [self.insults.get(word + "$", 0.0)]
            + [self.insults.get(word[:n], 0.0) for n in STEMS if len(word) >= n]
        )
        kind = INSULT if weight > 0 else self.fixed.get(word, OTHER)
        found = (kind, weight, any(end in token[len(word) :] for end in ENDS))
        if len(token) <= 64 and len(self) < MEMO_WORDS:
            self[token] = found
        return found


class Scorer:
    """Features of a text: sums over its matched clauses, by what is marked in them."""

    def __init__(self, insults: dict[str, float]):
        self.lexicon = Lexicon(insults)
        self.table = table_of(GRAMMAR)

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        look = self.lexicon
        read = [look[token] for token in tokens]
        sums = dict.fromkeys(FEATURES, 0.0)
        if any(kind == INSULT or kind == THREAT for kind, _, _ in read):
            state, worst, marks = 0, 0.0, frozenset()
            for kind, weight, ends in [*read, (OTHER, 0.0, True)]:
                state, fresh = self.table[state, kind]
                marks, worst = marks | fresh, max(worst, weight)
                if ends:
                    self.add_clause(sums, marks, worst)
                    state, worst, marks = 0, 0.0, frozenset()
        total = sum(sums[name] for name in ("plain", "targeted", "negated", "reported", "threat"))
        sums["any"] = float(total > 0)
        sums["share"] = total / (len(tokens) + 20) * 20
        return [math.log1p(sums[name]) for name in FEATURES]

    @staticmethod
    def add_clause(sums: dict[str, float], marks: frozenset[str], weight: float) -> None:
        """A clause matches if it holds an insult, or a threat with a target."""
        if "insult" in marks:
            for kind in ("reported", "negated", "targeted"):
                if kind in marks:
                    sums[kind] += weight
                    return
            sums["plain"] += weight
        elif "threat" in marks and "targeted" in marks:
            sums["threat"] += 0.0 if marks & {"negated", "reported"} else 1.0


@dataclass
class ToxicityModel:
    insults: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """`text, toxic` of at most `ROWS_PER_LABEL` rows of each label, chosen by a hash.

    A document with several labels is toxic if one of them says so.
    """
    marks = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(learn)
    )
    turn = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("toxic") == 1, ROWS_PER_LABEL[1]).otherwise(ROWS_PER_LABEL[0])
    ranked = marks.withColumn("turn", F.row_number().over(turn))
    chosen = (
        ranked.where((F.col("turn") <= max(ROWS_PER_LABEL.values())) & (F.col("turn") <= most))
        .select(F.col("doc_id").alias("id"), "toxic")
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
        .where("text is not null")
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
    )


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Words and stems found in toxic rows far more often than in clean ones.

    The evidence is the lower end of an interval around the log of the ratio.
    """
    words = F.transform(
        F.split(F.lower("text"), r"\s+"), lambda token: F.btrim(token, F.lit(STRIP))
    )
    parts = F.array_distinct(
        F.flatten(
            F.transform(
                F.array_distinct(words),
                lambda word: F.array(
                    F.concat(word, F.lit("$")),
                    *(F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in STEMS),
                ),
            )
        )
    )
    totals = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = totals[0] or 0, totals[1] or 0
    if not bad or not good:
        return {}
    counted = (
        sample.select("toxic", F.explode(parts).alias("part"))
        .where("length(part) > 3")
        .groupBy("part")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
        .withColumn("good", F.col("n") - F.col("bad"))
    )
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = (
        counted.withColumn("evidence", ratio - 1.64 * spread)
        .where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("bad") >= 3))
        .orderBy(F.desc("evidence"), "part")
        .limit(MOST_INSULTS)
        .collect()
    )
    return {row.part: float(row.evidence) for row in best}


def with_features(rows: DataFrame, insults: dict[str, float], keep: str) -> DataFrame:
    """`rows` (first column, text) as the first column and the features of the text."""
    shared = dict(insults)

    def work():
        scorer = Scorer(shared)

        def step(batch: pa.RecordBatch) -> dict:
            return {
                keep: batch.column(0),
                "features": [scorer.features(text) for text in batch.column(1).to_pylist()],
            }

        return step

    kind = rows.schema[keep].dataType.simpleString()
    return per_slice(rows, "text", f"{keep} {kind}, features array<double>", work)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> ToxicityModel:
    """Learn the insults, then how much each kind of clause counts.

    The weights are fitted by logistic regression (Newton steps, a ridge of 1).
    """
    sample = labelled_sample(docs, labels, learn)
    insults = learn_insults(sample)
    rows = with_features(sample.select("toxic", "text"), insults, "toxic").collect()
    size = len(FEATURES)
    if len({row.toxic for row in rows}) < 2:
        rate = sum(row.toxic for row in rows) / max(1, len(rows))
        return ToxicityModel(insults, np.zeros(size), math.log((rate + 1e-6) / (1 - rate + 1e-6)))
    rows.sort(key=lambda row: (row.toxic, row.features))
    x = np.array([[*row.features, 1.0] for row in rows])
    y = np.array([row.toxic for row in rows], float)
    ridge = np.diag([1.0] * size + [0.01])
    w = np.zeros(size + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge @ w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, slope)
    return ToxicityModel(insults, w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, limit: float = 0.3) -> DataFrame:
    """`doc_id, score, predicted` for every row of `docs`, from its text alone.

    Clauses are read by a composition of transducers for insults, threats,
    targets, negation and reported speech. A clause counts if it holds an insult,
    or a threat against somebody; by what else is in it, it counts for another
    feature. `predicted` is 1 where the score is at least `limit`.

    Null and empty texts get the score of a text without matches. Repeated rows
    and null ids are rows like others; empty `docs` give an empty result, and
    without labels of both kinds every score is their rate.
    """
    model = fit(docs, labels, learn)
    rows = docs.select("doc_id", "text")

    def work():
        scorer = Scorer(model.insults)

        def step(batch: pa.RecordBatch) -> dict:
            found = [scorer.features(text) for text in batch.column(1).to_pylist()]
            scores = model.score(np.array(found).reshape(-1, len(FEATURES))).tolist()
            return {
                "doc_id": batch.column(0),
                "score": scores,
                "predicted": [int(score >= limit) for score in scores],
            }

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_slice(rows, "text", f"doc_id {kind}, score double, predicted int", work)


def remove_toxic(docs: DataFrame, labels: DataFrame, learn: Column, limit: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score is below `limit`, with all columns.

    Rows are told apart by id: if one of several rows with an id is toxic, all go.
    """
    bad = score_toxicity(docs, labels, learn, limit).where("predicted = 1")
    gone = bad.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
