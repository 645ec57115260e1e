"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity is a grade from 0 up.  One weight vector scores a text; ordered
thresholds cut the score into grades: P(grade >= k) = sigmoid(score - cut k).
All thresholds share the weights, so scarce severe grades learn from milder
ones.  Features of a word are the word and the beginnings of longer ones,
hashed; a word counts by the one that says most, a text by its distinct words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, text_sizes, written

#: Labelled documents that the model is fitted on, at most, and buckets of features.
FIT_DOCS, BUCKETS = 6000, 1 << 20
#: Lengths of word beginnings that are features.
HEADS = (5, 6, 7, 8)
#: Documents of the sample that a feature must be in, the least evidence for toxicity that makes a feature, and steps of the fit.
LEAST, EVIDENCE, STEPS = 4, 1.5, 400
#: How strongly weights are held to that evidence.
HOLD = 0.3
#: Expected severity from which a document is rejected.
REJECT = 0.6

WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[int]:
    """Buckets of one word: itself and its beginnings."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") % BUCKETS for n in HEADS if len(word) > n] + [xxhash.xxh3_64_intdigest(f"w:{word}") % BUCKETS]


def features(text: str, memo: dict[str, list[int]]) -> np.ndarray:
    """Buckets of a text's distinct words, a row of as many as HEADS + 1 for each; -1 fills a row."""
    out = []
    for w in sorted(set(WORD.findall(text.lower()))):
        found = memo.get(w)
        if found is None:
            found = features_of(w)
            found += [-1] * (len(HEADS) + 1 - len(found))
            if len(memo) < 200_000:
                memo[w] = found
        out.append(found)
    return np.array(out, np.int32).reshape(-1, len(HEADS) + 1)


class Model:
    """Weights by bucket (sparse), the thresholds in order."""

    def __init__(self, weights: dict[int, float], cuts: list[float]):
        self.weights, self.cuts = weights, cuts

    def severity(self, score: float) -> float:
        """Expected grade."""
        return float(sum(1 / (1 + np.exp(np.clip(c - score, -500, 500))) for c in self.cuts))


def document_features(raw: bytes) -> np.ndarray:
    """features() from bytes."""
    return np.frombuffer(raw, np.int32).reshape(-1, len(HEADS) + 1)


def evidence(sample: DataFrame) -> dict[int, float]:
    """Buckets that speak for toxicity, with how much: the lower bound of the log odds ratio between toxic and other documents.

    sample: grade and f (features() as bytes) of each document.  Tasks give a
    row for each bucket that they saw, Spark adds them up, and only buckets
    with enough evidence reach the driver, BUCKETS at most.
    """

    def run(batches):
        toxic, every = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for grade, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                once = np.unique(document_features(raw))  # a document counts once for a feature
                once = once[once >= 0]
                every[once] += 1
                toxic[once] += grade > 0
        seen = np.flatnonzero(every)
        for at in range(0, len(seen), 50_000):
            own = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(toxic[own]), pa.array(every[own])], names=["bucket", "toxic", "n"])

    whole = sample.agg(F.count("*").alias("docs"), F.coalesce(F.count_if(F.expr("grade > 0")), F.lit(0)).alias("bad")).first()
    bad, good = whole["bad"], whole["docs"] - whole["bad"]
    each = sample.select("grade", "f").mapInArrow(run, "bucket long, toxic long, n long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    found = each.where(f"n >= {LEAST}").select("bucket", F.expr(f"ln((toxic + 0.5D) / {bad + 1}) - ln((n - toxic + 0.5D) / {good + 1}) - 1.96D * sqrt(1 / (toxic + 0.5D) + 1 / (n - toxic + 0.5D))").alias("evidence"))
    return {r["bucket"]: r["evidence"] for r in found.where(F.col("evidence") >= EVIDENCE).collect()}


def fit(sample: DataFrame, steps: int = STEPS) -> Model:
    """Fit on documents: i (an id that orders them), grade and f (features() as bytes).

    Weights start at evidence(), are held to it softly, and are never negative.
    The driver gets the few features of each document that speak.  With fewer
    than two grades every document gets the only grade there is.
    """
    known = evidence(sample)

    def run(batches):
        weigh = np.zeros(BUCKETS)
        weigh[list(known)] = list(known.values())
        for batch in batches:
            spoken = []
            for raw in batch.column(2).to_pylist():
                words = document_features(raw)
                best = words[np.arange(len(words)), np.argmax(np.where(words >= 0, weigh[words], -1), axis=1)]
                spoken.append(np.sort(best[weigh[best] > 0]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spoken, pa.list_(pa.int32()))], names=["i", "grade", "spoken"])

    rows = sorted((r["grade"], r["i"], r["spoken"]) for r in sample.select("i", "grade", "f").mapInArrow(run, "i long, grade int, spoken array<int>").collect())
    y = np.array([g for g, _, _ in rows], np.int64)
    n, top = len(y), int(y.max()) if len(y) else 0
    if len(set(y.tolist())) < 2:
        return Model({}, [-50.0] * top)
    names, column = np.unique(np.array([b for _, _, own in rows for b in own], np.int64), return_inverse=True)
    of = np.repeat(np.arange(n), [len(own) for _, _, own in rows])
    share = np.array([np.mean(y >= k) for k in range(1, top + 1)])
    cuts = np.maximum.accumulate(np.log((1 - share + 1e-3) / (share + 1e-3)))
    weights, cuts = descend(column, of, y, np.array([known[b] for b in names.tolist()]), cuts, steps)
    return Model({int(b): float(w) for b, w in zip(names, weights, strict=True)}, cuts.tolist())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def around(score: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= y) and P(grade > y) of each document."""
    above = np.concatenate([np.ones((1, len(score))), sigmoid(score[None, :] - cuts[:, None]), np.zeros((1, len(score)))])
    each = np.arange(len(y))
    return above[y, each], above[y + 1, each]


def cut_slopes(low: np.ndarray, high: np.ndarray, y: np.ndarray, top: int) -> np.ndarray:
    """The slope of the log loss by each cut."""
    p = np.maximum(low - high, 1e-12)
    a, b = low * (1 - low) / p, high * (1 - high) / p
    return np.array([a[y == k].sum() - b[y == k - 1].sum() for k in range(1, top + 1)])


def descend(column: np.ndarray, of: np.ndarray, y: np.ndarray, start: np.ndarray, cuts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts after projected gradient steps with momentum; entry e says that document of[e] has feature column[e] once more."""
    n, m = len(y), len(start)
    v, bend = np.ones(m) / max(1, m) ** 0.5, 1.0
    for _ in range(20):  # the matrix's largest singular value squared bounds the loss's bend
        v = np.bincount(column, np.bincount(of, v[column], n)[of], m).astype(float)  # whole numbers where no feature speaks
        bend = float(np.sqrt((v * v).sum())) or 1.0
        v /= bend
    rate = 1 / (1.05 * bend / (4 * n) + 0.25 + HOLD / n)
    w = start.copy()
    ahead, ahead_cuts, t = w.copy(), cuts.copy(), 1.0
    for _ in range(steps):
        low, high = around(np.bincount(of, ahead[column], n), ahead_cuts, y)
        new = np.maximum(0, ahead - rate * (np.bincount(column, (low + high - 1)[of], m) + HOLD * (ahead - start)) / n)
        new_cuts = np.maximum.accumulate(ahead_cuts - rate * cut_slopes(low, high, y, len(cuts)) / n)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, ahead_cuts = new + (before - 1) / t * (new - w), np.maximum.accumulate(new_cuts + (before - 1) / t * (new_cuts - cuts))
        w, cuts = new, new_cuts
    return w, cuts


def labelled_grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels; unlabelled rows drop out.

    0: not toxic.  1: toxic and of poor quality, which other filters remove
    anyway.  2: toxic text that is well written otherwise.
    """
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.expr("case when toxic = 0 then 0 when coalesce(quality, 0) > 0 then 2 else 1 end")).alias("grade"))


def fit_on(docs: DataFrame, grades: DataFrame, limit: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a sample of labelled documents, limit at most: those whose ids come first in the order of a hash.

    Features are taken on the executors, from whole texts, and written to the
    shared folder.  No labels, or labels of one grade: a model that gives that
    grade.
    """
    sample = grades.select(F.col("doc_id").cast("long").alias("_id"), F.col("grade").cast("int").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    joined = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # limit rows at most

    def run(batches):
        memo: dict[str, list[int]] = {}
        for batch in by_bytes(batches, text_sizes(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t or "", memo).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["i", "grade", "f"])

    return fit(written(joined.mapInArrow(run, "i long, grade int, f binary"), "features"))


PAIR = np.dtype([("bucket", "<i8"), ("weight", "<f8")])


@lru_cache(maxsize=2)
def _weights(packed: bytes) -> tuple[dict[str, float], dict[int, float]]:
    """A memo of words and the weights by bucket; a worker keeps both for the tasks that come."""
    table = np.frombuffer(packed, PAIR)
    return {}, dict(zip(table["bucket"].tolist(), table["weight"].tolist(), strict=True))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of docs as the struct _row with severity (double), the expected grade.

    A text's score is the sum over its distinct words of the largest weight of each.  Null and empty text
    has none, so its severity is the model's for no feature.  Every row stands
    alone; columns of docs may have any names.  An empty table gives none.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t"))
    table = np.array(sorted(model.weights.items()), PAIR)
    packed, cuts = table.tobytes(), model.cuts

    def run(batches):
        memo, weights = _weights(packed)
        graded = Model({}, cuts)
        for batch in by_bytes(batches, text_sizes(1)):
            out = []
            for t in batch.column(1).to_pylist():
                hits = []
                for w in set(WORD.findall((t or "").lower())):
                    hit = memo.get(w)
                    if hit is None:
                        hit = max((weights.get(b, 0.0) for b in features_of(w)))
                        if len(memo) < 150_000:
                            memo[w] = hit
                    if hit:
                        hits.append(hit)
                out.append(graded.severity(sum(sorted(hits))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["_row", "severity"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("severity", T.DoubleType())]))
