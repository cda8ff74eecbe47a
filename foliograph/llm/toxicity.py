"""Toxic passages by maximum-scoring segments.

*Fit.* From at most ``FIT_DOCS`` labelled documents (those of smallest id hash, never held-out ones)
the documents of either class that hold a word or word beginning are counted. Each gets a log-odds with an
informative Dirichlet prior (its share of all words, ``PRIOR`` strong); those of at least ``MIN_ODDS`` that
are ``MIN_Z`` standard errors above 0 and in ``MIN_DOCS`` toxic documents are kept, every other word scores
the log ratio of what is left of either class. Equal texts of the sample count once. The number of documents
is the fit's only bound: all their words are looked at, and only those that are kept reach the driver.

*Score.* A word takes the score of itself or of its longest kept beginning. One scan finds all maximal
scoring segments of a text (Ruzzo and Tompa, 1999). By extreme-value statistics (Karlin and Altschul,
1990) a segment of score s in n words is expected ``K n exp(-lambda s)`` times by chance: lambda solves
the score distribution of clean documents, K is the estimate of greatest likelihood from their best
segments. Segments expected at most ``EXPECTED`` times are passages; their evidence, minus the log of the
expectation, adds up (without one, the best segment's counts), and a logistic curve fitted to the labelled
sample turns it into a score.

Labels, language, source and doc_id enter no score. Null, empty and wordless texts have evidence of
no segment and the curve's score for it. Labels without document, documents without label, null labels
and repeated labels (the largest counts) are fine; without toxic or without clean examples every score
is 0. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import chunks, written

#: The bound of the fit: labelled documents.
FIT_DOCS = 20_000
MIN_DOCS, MIN_Z, MIN_ODDS, PRIOR, EXPECTED = 4, 4.0, 3.0, 500.0, 0.05
BEGINNINGS = range(3, 10)
_WORD = re.compile(r"[^\W\d_]+")
#: Words of which a worker remembers the score or the features.
_CACHED = 50_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    """A word (closed by a full stop) and its beginnings, longest first."""
    return [word + ".", *[word[:n] for n in reversed(BEGINNINGS) if n <= len(word)]]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    neutral: float = 0.0
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] | None = None
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        if (x := self.known.get(w)) is None:
            if len(self.known) > _CACHED:
                self.known.clear()
            x = self.known[w] = next((self.odds[f] for f in features(w) if f in self.odds), 0.0)
        return x

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and the words that score above 0."""
        words = _WORD.findall(text.lower())
        return len(words), [(i, s) for i, s in enumerate(map(self.word, words)) if s > 0]

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words and all maximal scoring segments (first word, last word, score)."""
        n, hits = self.hits(text)
        return n, maximal_segments(hits, self.neutral)

    def expected(self, n: int, score: float) -> float:
        """Log of how often chance gives a segment of that score in n words."""
        return math.log(max(self.k * max(n, 1), 1e-300)) - self.lam * score

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence of a text's segments, and those that are significant."""
        logs = [self.expected(n, s) for _, _, s in found]
        passages = [f for f, e in zip(found, logs, strict=True) if e <= math.log(EXPECTED)]
        if passages:
            return sum(-e for e in logs if e <= math.log(EXPECTED)), passages
        return -min(logs, default=self.expected(n, 0.0)), []

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        return self.evidence(*self.segments(text))

    def probability(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * max(evidence, 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def maximal_segments(hits: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that scores ``neutral`` (not above 0) but at the hits."""
    kept: list[list[float]] = []  # first, last, sum before it, sum up to its end
    total, at = 0.0, 0
    for i, s in hits:
        total += neutral * (i - at)
        new = [i, i, total, total + s]
        total += s
        at = i + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in kept]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: for each feature the toxic and the clean documents that hold it; for the empty one their words."""
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    known: dict[str, list[str]] = {}
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                words = _WORD.findall((text or "").lower())
                own: set[str] = set()
                for w in set(words):
                    if (f := known.get(w)) is None:
                        if len(known) > _CACHED:
                            known.clear()
                        f = known[w] = features(w)
                    own.update(f)
                docs[toxic > 0].update(own)
                docs[toxic > 0][""] += len(words)
    names = list(docs[0] | docs[1])
    columns = [pa.array(names, pa.string()), *(pa.array([docs[k][f] for f in names], pa.int64()) for k in (1, 0))]
    yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])


def counts_of(sample: DataFrame) -> DataFrame:
    """feature, toxic and clean: see ``_counts``."""
    rows = sample.select("text", "toxic").mapInArrow(_counts, "feature string, toxic bigint, clean bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def strong_features(counts: DataFrame, n_t: int, n_c: int) -> DataFrame:
    """feature and odds of those worth keeping, for classes of n_t and n_c words. The surprise is the root of the log
    likelihood ratio against equal shares: about the standard errors apart."""
    y, x, n = F.col("toxic"), F.col("clean"), float(n_t + n_c)
    prior = PRIOR * (x + y) / n
    p, q = (y + prior) / (n_t + PRIOR), (x + prior) / (n_c + PRIOR)
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((x + y) * share))).otherwise(0.0)
    surprise = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(y, n_t / n) + part(x, n_c / n))))
    found = counts.where((F.col("feature") != "") & (y >= MIN_DOCS) & (p < 1) & (q < 1))
    return found.where((odds >= MIN_ODDS) & (surprise >= MIN_Z)).select("feature", odds.alias("odds"))


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = FIT_DOCS) -> DataFrame:
    """text and toxic of the labelled sample: at most ``most`` ids, which bounds what is broadcast; equal texts once."""
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")
    return written(rows.dropDuplicates(["text", "toxic"]).select("text", "toxic"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = FIT_DOCS) -> Model:
    sample = labelled(docs, labels, text, doc_id, label, most)
    counts = written(counts_of(sample), "features")
    total = counts.where("feature = ''").first()
    n_t, n_c = (total.toxic, total.clean) if total else (0, 0)
    if not n_t or not n_c:
        return Model()
    odds = {r.feature: r.odds for r in strong_features(counts, n_t, n_c).collect()}
    if not odds:
        return Model()
    model = Model(odds)
    seen = _sample_hits(sample, model)
    words, hit, drift = [0, 0], [0, 0], 0.0
    for n, hits, t in seen:
        words[t > 0] += n
        hit[t > 0] += len(hits)
        drift += sum(s for _, s in hits) if t <= 0 else 0.0
    # What is left of either class; clean text has to lose more than it gains.
    neutral = math.log(1 - min(0.9, hit[1] / words[1])) - math.log(1 - min(0.9, hit[0] / words[0]))
    neutral = model.neutral = min(neutral, -1e-3, -2 * drift / words[0])
    model.lam = _lambda([(n, hits) for n, hits, t in seen if t <= 0], neutral)
    found = [(n, maximal_segments(hits, neutral), t) for n, hits, t in seen]
    tops = [(n, max((s for *_, s in own), default=0.0)) for n, own, t in found if t <= 0 and n]
    model.k = len(tops) / max(1e-9, sum(n * math.exp(-model.lam * s) for n, s in tops))
    evidence = np.array([max(0.0, model.evidence(n, own)[0]) for n, own, _ in found])
    model.curve = _logistic(evidence, np.array([t > 0 for *_, t in found], dtype=float))
    return model


def _sample_hits(sample: DataFrame, model: Model) -> list[tuple[int, list[tuple[int, float]], int]]:
    """(words, hits, toxic) of each document of the sample: at most FIT_DOCS rows, few hits in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                rows = [shared.value.hits(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([[i for i, _ in h] for _, h in rows], pa.list_(pa.int64())), pa.array([[s for _, s in h] for _, h in rows], pa.list_(pa.float64())), part.column("toxic")], names=["n", "at", "scores", "toxic"])

    shared = sample.sparkSession.sparkContext.broadcast(model)
    kind = sample.schema["toxic"].dataType.simpleString()
    rows = sample.select("text", "toxic").mapInArrow(run, f"n bigint, at array<bigint>, scores array<double>, toxic {kind}").collect()
    return sorted((r.n, list(zip(r.at, r.scores, strict=True)), int(r.toxic)) for r in rows)


def _lambda(clean: list[tuple[int, list[tuple[int, float]]]], neutral: float) -> float:
    """The positive root of E[exp(lambda s)] = 1 over the words of clean documents."""
    words = sum(n for n, _ in clean)
    scores = np.array([s for _, hits in clean for _, s in hits])
    if not words or not len(scores):
        return 1.0

    def excess(lam: float) -> float:
        return (float(np.exp(np.minimum(lam * scores, 600.0)).sum()) + (words - len(scores)) * math.exp(lam * neutral)) / words - 1

    low, high = 1e-6, 0.01
    while excess(high) < 0 and high < 4:
        high *= 1.5
    for _ in range(80 if excess(high) >= 0 else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) by Newton's method, lightly held to 0."""
    w, design = np.zeros(2), np.stack([np.ones_like(x), np.minimum(x, 60.0)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (y - p) - np.array([1e-3, 1e-3]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5.0 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted and passages (first and last word, score) of every document."""
    df = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                judged = [shared.value.judge(t or "") for t in part.column("text").to_pylist()]
                scores = [shared.value.probability(e) for e, _ in judged]
                spans = [[{"first": a, "last": b, "score": s} for a, b, s in p] for _, p in judged]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, passage)], names=["doc_id", "held_out", "score", "predicted", "passages"])

    ddl = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, passages array<struct<first:bigint,last:bigint,score:double>>"
    return df.mapInArrow(run, ddl)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns; one pass over the texts."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch, text, 4 << 20):
                kept = [model.probability(model.judge(t or "")[0]) < 0.5 for t in part.column(text).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, ddl)
