"""Mixing to target weights with soft membership, in DataFrame functions only.

A labelled table (id, domain) trains a softmax regression over hashed word beginnings, present or absent; its posteriors
say how far a document belongs to each domain.  Every document then gets a nonnegative rate such that the expected token
totals of the domains, the sums of rate x tokens x posterior, match the targets: of all such rates those nearest to 1 in
least squares.  They are the projected step max(0, 1 - multipliers x posteriors), where projected-gradient steps end; the
few multipliers, one for each domain, are found by Newton steps.  A step needs a sum for each domain and pair of domains over
all documents; a document's rate follows from the multipliers, so nothing as large as the documents is kept or joined
between steps.  Targets that no nonnegative rates meet, as posteriors overlap, are warned of with the reached totals.

The classifier is fitted on the ``sample_docs`` labelled documents that come first by a hash of their id, and has
``buckets`` features for each domain; both bounds are parameters.  Posteriors, totals and rates cover all documents.

Defined results: null, empty and word-less texts have the posteriors of the labels' shares and no tokens; an id with several
labels counts for each, one with several texts with the smallest; null labels and labels that have no target are left out; a target without labels can't be
met and is ignored; with no labels all posteriors are equal; rows with equal texts have equal rates; an empty
table gives no rows.  Documents keep all their columns, held in one struct, so names can't clash.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def features_of(tokens: Column, buckets: int) -> Column:
    """The distinct buckets, from 1, of the tokens' first five characters."""
    return F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.hash(F.substring(t, 1, 5)), F.lit(buckets)) + 1))


def softmax_fit(rows: list[np.ndarray], y: np.ndarray, classes: int, buckets: int, steps: int = 120, decay: float = 4.0, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Biases and weights of a softmax regression by full-batch Adam; features of a few rows only have no weight."""
    at = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    held = np.bincount(at, minlength=buckets)[at] >= least
    at, owner = at[held], owner[held]
    share = np.bincount(y, minlength=classes) / len(y)
    params = np.concatenate([np.zeros((classes, buckets)), np.log(share)[:, None]], axis=1)
    m, v = np.zeros_like(params), np.zeros_like(params)
    truth = np.eye(classes)[y]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(owner, w[at], len(rows)) for w in params], axis=1) + params[:, -1]
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        wrong = p - truth
        grad = np.stack([np.append(np.bincount(at, wrong[owner, c], buckets) + decay * params[c, :-1], wrong[:, c].sum()) for c in range(classes)])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:, -1], params[:, :-1]


class Classifier:
    """Posteriors of the domains as a column expression; fitted on the driver, on a sample of bounded size."""

    def __init__(self, domains: list[str], priors: list[float], weights: list[list[float]] | None, buckets: int):
        self.domains, self.priors, self.weights, self.buckets = domains, priors, weights, buckets

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str, label_col: str, sample_docs: int, buckets: int) -> Classifier:
        known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(domains))
        sample = known.orderBy(F.xxhash64("id", F.lit("sample")), "id", "domain").limit(sample_docs)
        rated = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
        # an id with several texts counts with one of them, so the sample stays bounded
        rated = rated.groupBy("id", "domain").agg(F.min("text").alias("text"))
        seen = stored(rated.select("domain", features_of(tokens_of(F.col("text")), buckets).alias("f")), "mixing-sample")
        got = seen.toArrow()
        labels_ = got["domain"].to_pylist()
        kept = [d for d in domains if d in set(labels_)] or domains
        if not labels_:
            return cls(kept, [0.0] * len(kept), None, buckets)
        flat = got["f"].combine_chunks()
        ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().astype(np.int64) - 1
        bias, weights = softmax_fit([values[a:b] for a, b in zip(ends, ends[1:], strict=False)], np.array([kept.index(d) for d in labels_]), len(kept), buckets)
        return cls(kept, bias.tolist(), [[round(x, 4) for x in w] for w in weights.tolist()], buckets)

    def posteriors(self, df: DataFrame) -> DataFrame:
        """``df`` with its column ``tokens`` as their number ``n_tokens`` and the array ``posteriors``.

        Each step is a projection of its own, for what is used several times to be computed once.
        """
        keep = [c for c in df.columns if c != "tokens"]
        names = [f"_s{i}" for i in range(len(self.priors))]
        df = df.select(*keep, F.size("tokens").cast("long").alias("n_tokens"), features_of(F.col("tokens"), self.buckets).alias("_f"))
        keep.append("n_tokens")
        weights = self.weights or [None] * len(names)
        df = df.select(*keep, *[(F.lit(p) + self._sum(F.col("_f"), w) if w else F.lit(p)).alias(n) for n, p, w in zip(names, self.priors, weights, strict=True)])
        df = df.select(*keep, *names, (F.greatest(*names) if len(names) > 1 else F.col(names[0])).alias("_best"))
        df = df.select(*keep, *[F.exp(F.col(n) - F.col("_best")).alias(n) for n in names])
        df = df.select(*keep, *names, sum((F.col(n) for n in names[1:]), F.col(names[0])).alias("_all"))
        return df.select(*keep, F.array(*[F.col(n) / F.col("_all") for n in names]).alias("posteriors"))

    @staticmethod
    def _sum(features: Column, weights: list[float]) -> Column:
        """The sum of a domain's weights; the list of weights folds to a constant of the plan."""
        constant = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
        return F.aggregate(features, F.lit(0.0), lambda acc, b: acc + F.element_at(constant, b))


def rate_of(p: Column, steps: list[list[float]], step: float, pull: float) -> Column:
    """The rate after these steps; each is the gradient by the domains' totals."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def one(rate, g):
        slope = sum((g[i] * p[i] for i in range(1, len(steps[0]))), g[0] * p[0])
        return F.greatest(F.lit(0.0), rate - F.lit(step) * (slope + F.lit(pull) * (rate - 1.0)))

    return F.aggregate(history, F.lit(1.0), one)


class Mixture:
    """A fitted mixture: the classifier, the gradient steps, the reached ``totals``, and ``missed``, each target's error.

    Errors are shares of the target, of all tokens where a target is zero; ``met`` says that all are within the tolerance.
    """

    def __init__(self, classifier: Classifier, steps: list[list[float]], step: float, pull: float, totals: dict[str, float], missed: dict[str, float], met: bool):
        self.classifier, self.steps, self.step, self.pull, self.totals = classifier, steps, step, pull, totals
        self.missed, self.met = missed, met

    def rates(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``row`` (all columns of the document), ``n_tokens``, ``posteriors`` in the order of the domains, and ``rate``."""
        found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tokens_of(F.col(text_col)).alias("tokens"))
        return self.classifier.posteriors(found).withColumn("rate", rate_of(F.col("posteriors"), self.steps, self.step, self.pull))


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", label_col: str = "domain", sample_docs: int = 8000, buckets: int = 1 << 15, pull: float = 1e-3, iterations: int = 30, close: float = 1e-2) -> Mixture:
    """Rates whose expected domain totals are ``targets`` (weights, any scale) of the documents' tokens.

    Newton steps on the domains' multipliers, until every total is within ``close`` of its target or no step gets nearer;
    ``pull`` damps them.  A target that is missed all the same, or after ``iterations`` steps, is warned of.
    """
    classifier = Classifier.fit(docs, labels, sorted(targets), id_col, text_col, label_col, sample_docs, buckets)
    size = len(classifier.domains)
    goal = np.array([targets[d] for d in classifier.domains], float)
    goal /= goal.sum()
    found = classifier.posteriors(docs.select(tokens_of(F.col(text_col)).alias("tokens")))
    thin = stored(found.select(F.col("n_tokens").cast("double").alias("t"), F.col("posteriors").alias("p")), "mixing-posteriors")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def sums(slope: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Of these multipliers: all tokens, the squared rates, the domains' totals, and how these fall with the multipliers."""
        rated = thin.select("t", *[F.col("p")[i].alias(f"p{i}") for i in range(size)], rate_of(F.col("p"), [slope.tolist()], 1.0, 0.0).alias("r"))
        moves = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = rated.agg(F.sum("t"), F.sum(F.col("t") * F.col("r") * F.col("r")), *[F.sum(F.col("t") * F.col(f"p{i}") * F.col("r")) for i in range(size)], *[F.sum(moves * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()
        total, squares, *rest = [float(x or 0.0) for x in got]
        curve = np.zeros((size, size))
        for (i, j), x in zip(pairs, rest[size:], strict=True):
            curve[i, j] = curve[j, i] = x
        return total, squares, np.array(rest[:size]), curve

    def errors(totals: np.ndarray) -> np.ndarray:
        return (totals / total - goal) / np.where(goal > 0, goal, 1.0) if total else np.zeros(size)

    slope = np.zeros(size)
    total, squares, totals, curve = sums(slope)
    damping = pull * np.diag(np.maximum(totals, 1e-9 * total))
    for _ in range(iterations):
        if np.abs(errors(totals)).max() <= close:
            break
        wrong = totals - goal * total
        move = np.linalg.solve(curve + damping, wrong)
        # the function that the steps minimise: half the squared rates and the multipliers' price
        now, part = squares / 2 + total * goal @ slope, 1.0
        while part > 1e-6:
            _, *tried = sums(slope + part * move)
            if tried[0] / 2 + total * goal @ (slope + part * move) <= now - 1e-4 * part * (wrong @ move):
                break
            part /= 2
        else:
            break
        slope = slope + part * move
        before, (squares, totals, curve) = totals, tried
        if part == 1 and np.abs(totals - before).max() <= 1e-6 * total:
            break
    missed = errors(totals)
    met = bool(np.abs(missed).max() <= close)
    if not met:
        warnings.warn("mixing targets not met: " + ", ".join(f"{d} {x / total:.4f} of the tokens for {g:.4f}" for d, x, g in zip(classifier.domains, totals, goal, strict=True)), stacklevel=2)
    named = lambda values: dict(zip(classifier.domains, values.tolist(), strict=True))
    return Mixture(classifier, [slope.tolist()], 1.0, pull, named(totals), named(missed), met)


def mixed(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` as the rates say: a whole part of copies each, and one more by a seeded hash of the id with the rest's probability."""
    chance = F.pmod(F.xxhash64(F.col(f"row.`{id_col}`"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    return mixture.rates(docs, text_col).select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
