"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic training texts are the positives; rows of the label table whose
label is not looked at are the unlabelled set. A linear logistic model over words
and word prefixes, and those that make up much of a text, is fitted with numpy so
that it minimises

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

The class prior is the share of toxic rows among the labelled training rows. The
decay of the weights is the one of ``DECAYS`` with the least such risk on folds
of the training rows that a fit has not seen. The sample is bounded by
``positives`` and ``unlabelled`` rows; scoring reads every text whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, cut, word_tokens

PREFIXES = (4, 5)
#: A word or prefix makes up much of a text from two occurrences and one in so many words on.
MUCH = 200
#: Adam's usual decay rates; decays of the weights to choose from, and the folds to choose by.
ADAM = (0.9, 0.999)
DECAYS, FOLDS = (1e-6, 1e-5, 1e-4, 1e-3), 2


def doc_features(text: str | None) -> set[bytes]:
    """Distinct words of a text and their prefixes of 4 and 5 bytes, which end in ``*``; once more with ``+`` for those that make up much of it."""
    words = word_tokens((text or "").encode())
    counts = Counter(words)
    for w, c in list(counts.items()):
        for n in PREFIXES:
            if len(w) > n:
                counts[w[:n] + b"*"] += c
    least = max(2, len(words) / MUCH)
    return {*counts, *(f + b"+" for f, c in counts.items() if c >= least)}


@dataclass
class ToxicityModel:
    bias: float = -4.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + math.fsum(v for f in doc_features(text) if (v := get(f)) is not None)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@dataclass
class Rows:
    """A matrix of noughts and ones: the columns of each row's ones, one row after another."""

    columns: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], len(self.sizes))

    def back(self, slope: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, slope[self.row], width)

    def some(self, chosen: np.ndarray) -> Rows:
        return Rows(self.columns[chosen[self.row]], self.sizes[chosen])


def risks(w: np.ndarray, pos: Rows, unl: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(prior * R+, R- of the unlabelled less the positives' part, probabilities of both sets)."""
    p_pos, p_unl = (np.clip(1 / (1 + np.exp(-np.clip(x.dot(w) + w[-1], -40, 40))), 1e-6, 1 - 1e-6) for x in (pos, unl))
    return -prior * np.log(p_pos).mean(), -np.log1p(-p_unl).mean() + prior * np.log1p(-p_pos).mean(), p_pos, p_unl


def fit_nnpu(pos: Rows, unl: Rows, width: int, prior: float, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of ``width`` columns and, last, the bias."""
    w = np.zeros(width + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(x: Rows, slope: np.ndarray) -> np.ndarray:
        return np.append(x.back(slope, width), slope.sum()) / len(slope)

    for step in range(1, steps + 1):
        # loss of x as positive: log(1 + e^-z), slope p - 1; as negative: log(1 + e^z), slope p
        _, negative, p_pos, p_unl = risks(w, pos, unl, prior)
        corrected = gradient(unl, p_unl) - prior * gradient(pos, p_pos)
        grad = prior * gradient(pos, p_pos - 1) + corrected if negative >= 0 else -corrected
        grad[:-1] += decay * w[:-1]
        m = ADAM[0] * m + (1 - ADAM[0]) * grad
        v = ADAM[1] * v + (1 - ADAM[1]) * grad * grad
        w -= rate * (m / (1 - ADAM[0] ** step)) / (np.sqrt(v / (1 - ADAM[1] ** step)) + 1e-8)
    return w


def chosen_decay(pos: Rows, unl: Rows, folds: tuple[np.ndarray, np.ndarray], confirmed: np.ndarray, width: int) -> float:
    """The decay with the least risk on rows that the fit has not seen.

    A text is in the same fold of both sets, and a fold's prior is the share of
    its unlabelled rows that are ``confirmed`` positives, so that their part of
    the risk cancels but for chance.
    """
    if any((f == k).sum() < 10 for f in folds for k in range(FOLDS)):
        return DECAYS[1]

    def risk(decay: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            share = lambda chosen: min(0.9, max(0.001, float(confirmed[chosen].mean())))
            w = fit_nnpu(*(x.some(f != k) for x, f in zip((pos, unl), folds, strict=True)), width, share(folds[1] != k), decay=decay)
            toxic, rest, *_ = risks(w, *(x.some(f == k) for x, f in zip((pos, unl), folds, strict=True)), share(folds[1] == k))
            total += toxic + max(0.0, rest)
        return total

    return min(DECAYS, key=risk)


def g_statistic(p: Column, n_pos: int, u: Column, n_unl: int) -> Column:
    """How far a feature's counts in both sets are from those of one rate: twice the gain in log likelihood."""
    share = (p + u) / max(1, n_pos + n_unl)

    def gain(k: Column, n: int) -> Column:
        own = F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
        return own + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)

    return 2 * (gain(p, n_pos) + gain(u, n_unl))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000, support: int = 3, by_chance: float = 3.0) -> ToxicityModel:
    """Fits the model on labelled texts whose crc32(doc_id) mod 3 is not 1.

    At most ``positives`` toxic and ``unlabelled`` other rows of ``labels`` are
    used, those with the smallest hash of their id; only their ids and those
    features reach the driver that ``support`` of them have and whose rates, in
    the positives and in the other rows that are none of them, differ more than
    chance makes those of ``by_chance`` of all features differ, for or against
    toxicity. Labels that are null count as missing. Without a toxic row there is nothing to learn and every
    text gets the low score of the bias.
    """
    spark = docs.sparkSession
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", 3) != 1))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not n or not toxic:
        return ToxicityModel()
    prior = min(0.9, max(0.001, toxic / n))
    first = lambda rows, most, is_pos: [(r[0], is_pos) for r in rows.select("doc_id").distinct().orderBy(*order).limit(most).collect()]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ids = first(known.where("toxic = 1"), positives, 1) + first(known, unlabelled, 0)
    chosen = F.broadcast(spark.createDataFrame(ids, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, is_pos int"))  # bounded by the two parameters
    sample = cut(docs.select("doc_id", "text").join(chosen, "doc_id"), "sample")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [sorted(doc_features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("is_pos"), pa.array(features, pa.list_(pa.binary()))], ["doc_id", "is_pos", "features"])

    rows = cut(sample.mapInArrow(found, f"doc_id {id_type}, is_pos int, features array<binary>").withColumn("row", F.monotonically_increasing_id()), "sample-features")
    known_ids = F.broadcast(spark.createDataFrame([x for x in ids if x[1]], chosen.schema).select("doc_id", F.lit(True).alias("known")))  # bounded by the first parameter
    rows = rows.join(known_ids, "doc_id", "left").withColumn("other", (F.col("is_pos") == 0) & F.col("known").isNull())
    each = rows.select("row", "is_pos", "other", F.explode("features").alias("feature"))
    n_pos, n_unl = rows.where("is_pos = 1").count(), rows.where("other").count()
    counts = each.groupBy("feature").agg(F.sum("is_pos").alias("p"), F.count_if("other").alias("u"))
    common = cut(counts.where(F.col("p") + F.col("u") >= support), "features")
    # the G statistic of a feature that has nothing to do with toxicity is about the square of a normal number
    least = NormalDist().inv_cdf(1 - min(0.5, by_chance / max(1, common.count())) / 2) ** 2
    telling = common.where(g_statistic(F.col("p"), n_pos, F.col("u"), n_unl) >= least).select("feature")
    got = each.join(telling, "feature").groupBy("row").agg(F.collect_list("feature").alias("features"))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(FOLDS)).alias("fold")
    got = rows.select("row", "doc_id", "is_pos", "other", fold).join(got, "row", "left").orderBy("is_pos", "doc_id", "row").toArrow()
    numbers: dict[bytes, int] = {}
    lists = [sorted(x or ()) for x in got.column("features").to_pylist()]
    columns = np.array([numbers.setdefault(f, len(numbers)) for x in lists for f in x], np.int64)
    every, is_pos = Rows(columns, np.array([len(x) for x in lists], np.int64)), got.column("is_pos").to_numpy() == 1
    if not is_pos.any() or is_pos.all() or not numbers:
        return ToxicityModel()
    sets, folds = (every.some(is_pos), every.some(~is_pos)), got.column("fold").to_numpy()
    confirmed = ~got.column("other").to_numpy(zero_copy_only=False)[~is_pos]
    decay = chosen_decay(*sets, (folds[is_pos], folds[~is_pos]), confirmed, len(numbers))
    w = fit_nnpu(*sets, len(numbers), prior, decay=decay)
    return ToxicityModel(float(w[-1]), {f: float(w[i]) for f, i in numbers.items() if abs(w[i]) > 1e-4})


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Adds held_out, score and predicted to (doc_id, text) of every row.

    Null and empty texts get the score of a text without features; a null
    doc_id is held out or not as the empty id is. Other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return (
        docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
        .mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
