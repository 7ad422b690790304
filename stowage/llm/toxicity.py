"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by the composition of three small transducers: targets
(insults, threats and whom they address), negation (a short scope after a
negator) and reported speech (after a verb of saying, to the end of the
clause). Each arc multiplies the weight of the word that it reads, so a word
counts by its place in the clause: an addressed insult counts more, a negated
or quoted one less, and a threat only beside a target.

Insult weights are log-odds learned from labelled rows (whole words and word
beginnings); a logistic curve over the best clause and the total turns matches
into a score. Both are fitted on at most `sample` labelled rows (SAMPLE),
one of each group of near copies. Only the text is looked at when scoring.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import lowered, stored, text_slices

#: At most about so many labelled rows fit the weights; other rows are only scored.
SAMPLE = 60_000
STEMS = (4, 5, 6, 7)
CACHE = 150_000

# Word classes of the grammar.
SEEDS = frozenset("idiot moron stupid loser pathetic worthless disgusting scum trash imbecile bastard cretin dumbass".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn murder strangle attack töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours yourself u they them their he him she her everyone people du dich dir euch ihr sie vous tu te toi votre usted ustedes ti tú".split())
NEGATORS = frozenset("not never no nobody without isn't aren't don't won't nicht kein keine nie pas jamais ne nunca jamás sin".split())
REPORTERS = frozenset("said says say wrote writes called quoted claimed reported allegedly sagte schrieb dit écrit dijo escribió llamó".split())
THREAT_WEIGHT, SEED_WEIGHT = 4.0, 5.0

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER, END = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:,\n\"“”«»()|]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


class Transducer:
    """arcs: (state, class) -> (state, factor); without an arc the state stays and the factor is 1."""

    def __init__(self, arcs: dict[tuple, tuple[object, float]], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol) -> tuple[object, float]:
        return self.arcs.get((state, symbol), (state, 1.0))

    def states(self) -> set:
        return {self.start} | {s for s, _ in self.arcs} | {s for s, _ in self.arcs.values()}

    def compose(self, other: Transducer) -> Transducer:
        """Reads with both; factors multiply."""
        arcs = {}
        for a in self.states():
            for b in other.states():
                for symbol in range(END + 1):
                    (x, p), (y, q) = self.step(a, symbol), other.step(b, symbol)
                    arcs[(a, b), symbol] = ((x, y), p * q)
        return Transducer(arcs, (self.start, other.start))


def _targets() -> Transducer:
    arcs = {("none", THREAT): ("threat", 0), ("none", TARGET): ("target", 0), ("threat", TARGET): ("target", 1)}
    arcs |= {("threat", THREAT): ("threat", 0), ("target", TARGET): ("target", 0), ("target", INSULT): ("target", 1.3)}
    return Transducer(arcs | {(s, END): ("none", 0) for s in ("none", "threat", "target")}, "none")


def _negation(scope: int = 3, factor: float = 0.4) -> Transducer:
    arcs = {}
    for left in range(scope + 1):
        for symbol in range(END + 1):
            arcs[left, symbol] = (max(left - 1, 0), factor if left else 1.0)
        arcs[left, NEGATOR], arcs[left, END] = (scope, 1.0), (0, 1.0)
    return Transducer(arcs)


def _reported(factor: float = 0.6) -> Transducer:
    arcs = {(1, symbol): (1, factor) for symbol in range(END)}
    return Transducer(arcs | {(0, REPORTER): (1, 1.0), (1, END): (0, 1.0)})


def grammar() -> Transducer:
    return reduce(Transducer.compose, (_targets(), _negation(), _reported()))


class Scorer:
    """Matches of one text. lexicon: word, or beginning followed by *, to weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.fsm = lexicon, grammar()
        self.known: dict[str, tuple[int, float]] = {}
        self.hits: set[str] = set()  # known insults and threats

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a lower-case token."""
        if (hit := self.known.get(word)) is None:
            self.known[word] = hit = self._read(word)
            if hit[0] in (INSULT, THREAT):
                self.hits.add(word)
        return hit

    def _read(self, word: str) -> tuple[int, float]:
        if not word[0].isalpha():
            return END, 0.0
        weight = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n)])
        if weight > 0:
            return INSULT, weight
        for words, kind, w in ((THREATS, THREAT, THREAT_WEIGHT), (TARGETS, TARGET, THREAT_WEIGHT), (NEGATORS, NEGATOR, 0.0), (REPORTERS, REPORTER, 0.0)):
            if word in words:
                return kind, w
        return OTHER, 0.0

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """start, end and weight of each matched clause, in characters of the text."""
        low, read = lowered(text or ""), self.read
        if len(self.known) > CACHE:
            self.known.clear()
            self.hits.clear()
        words = set(_WORD.findall(low))
        for w in words.difference(self.known):
            read(w)
        if words.isdisjoint(self.hits):
            return []
        found, state, total, start, end = [], self.fsm.start, 0.0, None, 0
        for m in _TOKEN.finditer(low):
            kind, weight = read(m[0])
            state, factor = self.fsm.step(state, kind)
            if kind == END:
                if total > 0:
                    found.append((start, end, total))
                total, start = 0.0, None
                continue
            start, end = m.start() if start is None else start, m.end()
            total += factor * weight
        if total > 0:
            found.append((start, end, total))
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        return of_clauses(self.clauses(text))


def of_clauses(clauses: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The best clause and the total."""
    weights = [w for *_, w in clauses]
    return (max(weights), math.log1p(sum(weights))) if weights else (0.0, 0.0)


def _signature(text: str) -> int:
    """Least hash of the 5-word shingles: near copies mostly share it."""
    words = text.lower().split()
    grams = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(map(xxhash.xxh64_intdigest, grams)) >> 1


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        marks = [_signature(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.int64())], [*b.schema.names, "sig"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic documents, clean documents: sums of many documents at a time."""

    def out(hits: Counter, misses: Counter):
        terms = list(hits.keys() | misses.keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (hits, misses))], ["term", "pos", "neg"])

    counts = {0: Counter(), 1: Counter()}
    for b in text_slices(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(lowered(text or "")))
            counts[toxic].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n})
        if sum(map(len, counts.values())) > CACHE:
            yield out(counts[1], counts[0])
            counts = {0: Counter(), 1: Counter()}
    yield out(counts[1], counts[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of at most about `sample` labelled rows outside the held-out fifth, near copies once.

    Of near copies the row of least (toxic, hash of the text, id) stands, so equal tables give equal samples. The chosen ids are bounded by the sample, so they are broadcast and no text is shuffled before they are met.
    """
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    ids = ids.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    share = min(1.0, sample / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if sample <= 200_000:
        ids = F.broadcast(ids)
    signed = rows.join(ids, "doc_id").select("doc_id", "text", "toxic").mapInArrow(_signed, "doc_id bigint, text string, toxic int, sig bigint")
    least = signed.groupBy("sig").agg(F.min(F.struct("toxic", F.xxhash64("text").alias("h"), "doc_id", "text")).alias("row"))
    return least.select("row.text", "row.toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """Lexicon and the three coefficients of the score. Without labels the seeds and fixed coefficients stand."""
    rows = stored(labelled_sample(docs, labels, sample))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    seeds = dict.fromkeys(SEEDS, SEED_WEIGHT)
    if not pos or not neg:
        return seeds, [-4.0, 1.0, 1.0]
    base = pos / (pos + neg)
    terms = rows.mapInArrow(_counted, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = F.col("pos") + F.col("neg")
    z = (F.col("pos") - n * base) / F.sqrt(n * base * (1 - base))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    strong = terms.withColumn("z", z).withColumn("odds", odds).where("pos >= 6 and z >= 6 and odds >= 2")  # bounded by the sample
    lexicon = {r["term"]: float(r["odds"]) for r in strong.select("term", "odds").collect()}
    scorer = Scorer(seeds | lexicon)

    def matched(batches):
        for b in text_slices(batches):
            x = [scorer.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array([v[i] for v in x], pa.float64()) for i in (0, 1))], ["toxic", "best", "total"])

    got = rows.mapInArrow(matched, "toxic int, best double, total double").toPandas()  # three numbers for each row of the sample
    got = got.sort_values(["toxic", "best", "total"])  # sums in one order, whatever the tasks'
    return seeds | lexicon, logistic(got[["best", "total"]].to_numpy(), got["toxic"].to_numpy())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Intercept and weights by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]]) -> DataFrame:
    """doc_id, score, predicted and the matched clauses (start, end, weight) of each row.

    A null, empty or blank text has no clause and gets the lowest score. Rows
    without an id are scored and never held out. Repeated rows stay; other columns are ignored; no rows give no rows.
    """
    lexicon, (w0, w1, w2) = model
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches):
        scorer = Scorer(lexicon)
        for b in text_slices(batches):
            spans = [scorer.clauses(t) for t in b.column("text").to_pylist()]
            scores = []
            for s in spans:
                x = of_clauses(s)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * x[0] + w2 * x[1])))))
            rows = [[{"start": a, "end": z, "weight": w} for a, z, w in s] for s in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(rows, kind)], ["doc_id", "score", "clauses"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id bigint, score double, clauses array<struct<start:int,end:int,weight:double>>")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; all columns stay."""
    lexicon, (w0, w1, w2) = fit(docs, labels)
    names = docs.columns

    def run(batches):
        scorer = Scorer(lexicon)
        for b in text_slices(batches):
            x = [scorer.features(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([w0 + w1 * best + w2 * total < 0 for best, total in x], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))
