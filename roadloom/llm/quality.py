"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w over hashed text features and ordered thresholds,
so one score orders all texts, and gives the expected grade and the probability of any tail of grades.  Features are
present or absent: words, runs of symbols and how often they occur in powers of two, how often a word repeats at once, and how
many lines repeat; a word counts with its first 4, 5 and 6 letters too.  The fit (full-batch Adam with weight decay) reads a bounded sample: the ``sample_docs`` rated
documents that come first by a hash of their id; scoring reads whole texts.

Defined results: null, empty and feature-less texts have score 0 and so the thresholds' own grades; several ratings of
one id count as the lowest, several texts as the smallest; null ratings are left out; without any rating every grade is equally likely; repeated rows
are scored each by themselves; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
REPEATS = re.compile(r"\b(\w+)(?:\s+\1\b){2,}")


def features(text: str | None) -> list[str]:
    """The distinct features of a text."""
    if not text:
        return []
    lower = text.lower()
    counts = Counter(TOKENS.findall(lower))
    found = [*counts]
    symbols = sum(n for t, n in counts.items() if not t[0].isalnum())
    total = symbols + sum(n for t, n in counts.items() if t[0].isalnum())
    found += [f"#{t}{n.bit_length()}" for t, n in counts.items() if not t[0].isalnum()]
    found.append(f"#symbols {round(10 * symbols / total) if total else 0}")
    found += [f"#repeat {len(m[0].split()).bit_length()}" for m in REPEATS.finditer(lower)][:1]
    lines = [x for x in lower.split("\n") if x.strip()]
    found.append(f"#lines {round(5 * (1 - len(set(lines)) / len(lines))) if lines else 0}")
    found.append(f"#distinct {round(10 * len(counts) / total) if total else 0} {total.bit_length()}")
    return found


def buckets(feature: str, bits: int) -> list[int]:
    """The buckets of a feature, and of the beginnings of a longer word."""
    parts = [feature] + [f"^{feature[:n]}" for n in (4, 5, 6) if len(feature) > n and feature[0] != "#"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - bits) for p in parts]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of the buckets and ordered thresholds; grades are 0 to ``len(thresholds)``."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: list[int], levels: int, bits: int = 17, steps: int = 150, decay: float = 10.0, least: int = 4) -> Model:
        if not rows:
            return cls(np.zeros(1 << bits), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)))
        y = np.array(grades)
        at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        held = np.bincount(at, minlength=1 << bits)[at] >= least  # features of a few documents only can't generalise
        at, owner = at[held], owner[held]
        share = np.clip(np.array([(y <= k).mean() for k in range(levels - 1)]), 0.001, 0.999)
        first = np.log(share / (1 - share))
        # thresholds: the first, and the logarithms of the gaps above it
        params = np.concatenate([np.zeros(1 << bits), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
        size = 1 << bits
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            gaps = np.exp(params[size + 1 :])
            cuts = params[size] + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.bincount(owner, params[at], len(rows))
            edge = np.concatenate([[-40.0], cuts, [40.0]])
            hi, lo = sigmoid(edge[y + 1] - score), sigmoid(edge[y] - score)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            ds = dhi - dlo  # of the loss by the score
            grad = np.concatenate([np.bincount(at, ds[owner], size) + decay * params[:size], np.zeros(levels - 1)])
            dcuts = np.array([dlo[y == k + 1].sum() - dhi[y == k].sum() for k in range(levels - 1)])
            grad[size] = dcuts.sum()
            for j in range(levels - 2):
                grad[size + 1 + j] = dcuts[j + 1 :].sum() * gaps[j]
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            params -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        cuts = params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])
        return cls(params[:size], cuts)

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def scorer(self):
        bits, weights = self.bits, self.weights
        memo = Memo(lambda f: float(weights[buckets(f, bits)].sum()))

        def score(text: str | None) -> float:
            memo.trim()
            return sum(map(memo.__getitem__, features(text)))

        return score

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_docs: int = 8000, bits: int = 17) -> Model:
    """A model from ``ratings`` (id, grade from 0 to levels - 1) of ``docs``."""
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample_docs)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # an id with several texts counts with one of them, so the sample stays bounded
    chosen = chosen.groupBy("id", "grade").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in slices(batches):
            rows = [[b for f in features(t) for b in buckets(f, bits)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "grade": batch["grade"], "at": pa.array(rows, pa.list_(pa.int32()))})

    got = chosen.select("id", "grade", "text").mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, grade int, at array<int>").toArrow().sort_by("id")
    flat = got["at"].combine_chunks()
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return Model.fit([values[a:b] for a, b in zip(ends, ends[1:], strict=False)], got["grade"].to_pylist(), levels, bits)


def predict(docs: DataFrame, model: Model, tail: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: id, ``score``, ``expected_grade`` and ``tail_probability``, P(grade >= tail)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        score = model.scorer()
        for batch in slices(batches):
            scores = np.array([score(t) for t in batch["text"].to_pylist()], float)
            tails = model.tails(scores)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "score": pa.array(scores), "expected_grade": pa.array(tails.sum(axis=1)), "tail_probability": pa.array(tails[:, tail - 1])})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double, expected_grade double, tail_probability double").withColumnRenamed("id", id_col)
