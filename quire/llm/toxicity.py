"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all training texts, whatever their label, are the
unlabelled part. A linear classifier on the presence of words and word beginnings is
trained in numpy on the class-prior-corrected risk

    R = prior * E_P[l(+g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),

whose second part, an estimate, is kept from going below zero. A bounded sample gives candidate
features and, in batches drawn from it, the weights; the shares that choose features are taken over all training rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import TwoGenerationCache, materialise, release_memory, remainder, table

#: Bounds of the positives and the unlabelled rows that batches are drawn from, and of the classifier's features.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 1_024
#: Candidates whose shares are taken over all rows.
MAX_CANDIDATES = 8 * MAX_FEATURES
PREFIXES = (3, 4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if k < len(word) + 1)]


def words_in(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


class Classifier:
    """Weights by feature, a bias, and the memoised features of words."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.index = {f: i for i, f in enumerate(features)}
        self.weights, self.bias = weights.tolist(), bias

    def prepare(self) -> Classifier:
        index = self.index
        self.cache = TwoGenerationCache(lambda w: tuple(index[f] for f in word_features(w) if f in index), 100_000)
        return self

    def score(self, text: str | None) -> float:
        cache, found = self.cache, set()
        for w in words_in(text):
            f = cache[w]
            if f:
                found.update(f)
        weights = self.weights
        z = self.bias + sum([weights[i] for i in sorted(found)])
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, batch: int = 2048, rate: float = 4.0, momentum: float = 0.9, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk under logistic loss, by gradient steps with momentum.

    Plain steps move a feature as fast as it is frequent, so rare ones do not overtake; the mean of the
    second half of the steps is the result.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    v, mean = np.zeros_like(w), np.zeros_like(w)

    def slope(x: np.ndarray, sign: float) -> tuple[np.ndarray, float]:
        """Gradient and value of the mean loss of g * sign."""
        z = sign * (x @ w[:-1] + w[-1])
        s = -sign / (1 + np.exp(np.clip(z, -50, 50)))
        return np.r_[x.T @ s, s.sum()] / len(x), float(np.logaddexp(0, -z).mean())

    for t in range(steps):
        xp = positive[rng.integers(0, len(positive), min(len(positive), batch))].astype(np.float64)
        xu = unlabelled[rng.integers(0, len(unlabelled), min(len(unlabelled), batch))].astype(np.float64)
        gp, _ = slope(xp, 1.0)
        gn, ln = slope(xp, -1.0)
        gu, lu = slope(xu, -1.0)
        g = prior * gp
        if lu - prior * ln >= 0:  # else the negatives' part of the risk stands at zero
            g = g + gu - prior * gn
        g[:-1] += decay * w[:-1]
        v = momentum * v - rate * g
        w = w + v
        if t >= steps // 2:
            mean += w
    w = mean / (steps - steps // 2)
    return w[:-1], float(w[-1])


def draw(docs: DataFrame, fold: DataFrame) -> DataFrame:
    """h, part: hashes of id and text of at most MAX_POSITIVE rows that are labelled toxic (p) and MAX_UNLABELLED of all (u).

    Rows that repeat id and text are drawn once. Only ids and hashes are joined and ordered.
    """
    keys = docs.select("doc_id", row_hash())
    n = docs.count()
    # a little more than is needed, so that repeated rows leave enough
    some = keys.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < min(1.0, 8 * MAX_UNLABELLED / max(n, 1)) * 1_000_000)
    toxic = keys.join(fold.where("toxic = 1").select(F.col("label_id").alias("doc_id")), "doc_id", "left_semi")
    least = lambda df, most, part: df.select("h").distinct().orderBy("h").limit(most).withColumn("part", F.lit(part))
    return least(toxic, MAX_POSITIVE, "p").union(least(some, MAX_UNLABELLED, "u"))


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text").alias("h")


def train(docs: DataFrame, labels: DataFrame, is_training: Column) -> Classifier:
    """A classifier from at most MAX_POSITIVE confirmed toxic and MAX_UNLABELLED other texts of the training rows.

    The sample is drawn in the order of a hash of id and text, so it does not depend on partitions, and an id that
    repeats takes no more of it than it has different texts. Null texts take no part, empty ones have no feature. Of several
    labels of an id the highest holds; a null id has none. Without positives, or without any text, every score is the
    class prior.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.where(is_training & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    fold = marks.where(F.coalesce(remainder("label_id", 5) != 0, F.lit(True)))
    n, toxic = fold.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not toxic:
        return Classifier([], np.empty(0), np.log(0.01 / 0.99))
    prior = min(max(toxic / n, 1e-3), 0.5)
    chosen = materialise(draw(rows, fold), "toxic-chosen")

    def run(batches):
        release_memory()
        seen = set()
        for b in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            parts, feats, hashes = [], [], []
            for h, text, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, part) not in seen:
                    seen.add((h, part))
                    hashes.append(h)
                    parts.append(part)
                    feats.append(sorted({f for w in words_in(text) for f in word_features(w)}))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(parts, pa.string()), pa.array(feats, pa.list_(pa.string()))], names=["h", "part", "feats"])

    sample = rows.select(row_hash(), "text").join(F.broadcast(chosen), "h").mapInArrow(run, "h long, part string, feats array<string>").dropDuplicates(["h", "part"])
    counted = materialise(sample.select("part", "feats"), "toxic-sample")
    sizes = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n, m = sizes.get("p", 0), sizes.get("u", 0)
    if not n or not m:
        return Classifier([], np.empty(0), np.log(prior / (1 - prior)))
    df = counted.select("part", F.explode("feats").alias("f")).groupBy("f").agg(F.count(F.when(F.col("part") == "p", 1)).alias("k"), F.count(F.when(F.col("part") == "u", 1)).alias("c"))
    lift = 1 + 0.4 * (1 / prior - 1)  # the most that a feature of toxic texts only can have is 1 / prior
    # candidates stand out in the sample, if only half as much; shares over all rows then choose among them
    a, b = F.col("k") / n, (F.col("c") + 0.5) / (m + 1)
    likely = df.where(F.col("k") >= 3).where(a >= 0.5 * lift * b).withColumn("z", z_score(a, b, n)).where("z > 2.5").orderBy(F.desc("z"), "f").limit(MAX_CANDIDATES).select("f", "k").collect()
    if not likely:
        return Classifier([], np.empty(0), np.log(prior / (1 - prior)))
    candidates = [r["f"] for r in likely]
    size, shares = document_shares(rows, candidates)
    k = np.array([r["k"] for r in likely])
    a, b = k / n, (shares + 0.5) / (size + 1)
    z = (a - b) / np.sqrt(b * (1 - np.minimum(b, 1 - 1e-9)) / n + 1e-12)
    good = [i for i in np.lexsort((np.array(candidates), -z)) if a[i] >= lift * b[i] and z[i] > 5][:MAX_FEATURES]
    if not good:
        return Classifier([], np.empty(0), np.log(prior / (1 - prior)))
    features = [candidates[i] for i in good]
    return Classifier(features, *fit_sample(counted, features, prior, n, m))


def z_score(a: Column, b: Column, n: int) -> Column:
    return (a - b) / F.sqrt(b * (1 - F.least(b, F.lit(1 - 1e-9))) / n + 1e-12)


def document_shares(rows: DataFrame, candidates: list[str]) -> tuple[int, np.ndarray]:
    """The number of rows, and in how many of them each candidate is."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        release_memory()
        index = {f: i for i, f in enumerate(shared.value)}
        cache = TwoGenerationCache(lambda w: tuple(index[f] for f in word_features(w) if f in index), 100_000)
        size, total = 0, np.zeros(len(index), np.int64)
        for b in batches:
            size += b.num_rows
            for t in b.column(0).to_pylist():
                at: set[int] = set()
                for w in words_in(t):
                    if f := cache[w]:
                        at.update(f)
                total[list(at)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[size, total[at]], pa.int64())], names=["at", "n"])

    got = rows.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(candidates) + 1, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return int(out[-1]), out[:-1]


def fit_sample(counted: DataFrame, features: list[str], prior: float, n: int, m: int) -> tuple[np.ndarray, float]:
    """Weights and bias from the sample."""
    index = {f: i for i, f in enumerate(features)}

    def project(batches):
        release_memory()
        for b in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            # two bytes a feature, the high one first: such rows have the order of their numbers
            rows = [np.array([index[f] for f in d if f in index], ">u2").tobytes() for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["part", "at"])

    def fit(batches):
        release_memory()
        x = {"p": np.zeros((n, len(features)), np.uint8), "u": np.zeros((m, len(features)), np.uint8)}
        seen, rows = Counter(), []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        for part, at in sorted(rows):
            x[part][seen[part], np.frombuffer(at, ">u2")] = 1
            seen[part] += 1
        del rows
        w, bias = nnpu(x["p"], x["u"], prior)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["weights", "bias"])

    # the sample is bounded, MAX_POSITIVE + MAX_UNLABELLED rows of at most MAX_FEATURES numbers: one task fits it
    got = counted.mapInArrow(project, "part string, at binary").repartition(1).mapInArrow(fit, "weights array<double>, bias double").first()
    return np.array(got["weights"]), got["bias"]


def classify(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted (and ``keep`` columns) of every whole text; null and empty texts get the bias alone.

    Rows that repeat, and null or repeated ids, each stay a row. A ``keep`` column that is named as a result is an
    error; other columns are not read.
    """
    if clash := {"score", "predicted"}.intersection(keep):
        raise ValueError(f"columns named as results cannot be kept: {sorted(clash)}")
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    fields = ["doc_id", *keep]
    chosen = docs.select(*fields, *([] if "text" in fields else [F.col("text").cast("string").alias("text")]))
    kinds = ", ".join(f"`{f}` {chosen.schema[f].dataType.simpleString()}" for f in fields)

    def run(batches):
        release_memory()
        c = model.value
        if not hasattr(c, "cache"):
            c.prepare()
        for b in batches:
            score = np.array([c.score(t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in fields), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*fields, "score", "predicted"])

    return chosen.mapInArrow(run, f"{kinds}, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    out = classify(docs, train(docs, table(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
