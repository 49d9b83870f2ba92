"""Language ID: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the byte n-grams (1 to 4 bytes, spaces included) of the lower-cased
text, hashed to BUCKETS vectors. A text is the mean of its subwords' vectors; a
linear softmax on it gives the languages. Vectors and softmax are trained together
by stochastic gradient descent in numpy, on at most SAMPLE labelled texts chosen by
a hash of id and text: the one bounded sample. It is split over all languages of the rows,
each of which has a text in it at least (so with more than SAMPLE languages it has one
of each). A fifth of it is kept from training to
calibrate: it fits the softmax's temperature and the margin (of the best logit over
the next) under which a prediction is rejected: the best score of two languages is
never under a half, but a text in neither gives both about the same. Where there are more
rows, the margin is fitted on at most CALIBRATE others, whose texts stay on the executors. With one language
there is no margin, and only texts without a letter are rejected. Prediction reads
every whole text.

A null text or one without a letter has no language: `und`, score 0, rejected.
With no labelled text at all every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, give_back, map_batches, with_results

#: Hash buckets, dimensions, subword lengths in bytes.
BUCKETS, DIM, GRAMS = 1 << 14, 16, (1, 2, 3, 4)
#: Most labelled texts that training takes, or one for each language if there are more languages.
SAMPLE = 2000
EPOCHS, STEPS, RATE, ROWS_A_STEP = 30, 2000, 4.0, 16
#: (Epochs are as many as give STEPS steps, EPOCHS at least.)
#: Most other labelled texts that fit the margin, the least of them that are enough to, and the share of right ones that rejection may cost.
CALIBRATE, ENOUGH, COST = 20_000, 2000, 0.001
#: Bytes whose subwords are looked up at once.
SLICE = 1 << 16
UNKNOWN = "und"


def subwords(text: str) -> Iterator[np.ndarray]:
    """The bucket of every subword of the whole text, those that begin in SLICE bytes at a time."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data), SLICE):
        some = data[at : at + SLICE + max(GRAMS) - 1].astype(np.uint64)
        code = np.zeros(len(some), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(some) < n:
                break
            code = code[: len(some) - n + 1] << np.uint64(8) | some[n - 1 :]
            if n in GRAMS:
                yield ((code[:SLICE] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)).astype(np.int32)


@dataclass
class Model:
    """languages, the logits that each bucket adds (vector times softmax), bias, temperature, least margin accepted."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.weights[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / n + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def margins(logits: np.ndarray) -> np.ndarray:
    """The best logit over the next; without bound for a single language."""
    if logits.shape[-1] < 2:
        return np.full(logits.shape[:-1], np.inf)
    best = np.partition(logits, -2, axis=-1)
    return best[..., -1] - best[..., -2]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7) -> Model:
    """rows: (label, buckets, shares of them, which sum to 1). Every fifth row calibrates, unless no other row has its language."""
    rng = np.random.default_rng(seed)
    others = {r[0] for k, r in enumerate(rows) if k % 5}
    kept, train = [r for r in rows[::5] if r[0] in others], [r for k, r in enumerate(rows) if k % 5 or len(rows) < 10 or r[0] not in others]
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    epochs = max(EPOCHS, -(-STEPS * ROWS_A_STEP // max(1, len(train))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(train))
        for k in range(0, len(order), ROWS_A_STEP):
            step = [train[i] for i in order[k : k + ROWS_A_STEP]]
            x = np.stack([share @ vectors[bucket] for _, bucket, share in step])
            z = x @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(step)), [label for label, _, _ in step]] -= 1
            p /= len(step)
            back = p @ softmax.T
            softmax -= rate * (x.T @ p)
            bias -= rate * p.sum(axis=0)
            for (_, bucket, share), g in zip(step, back):
                vectors[bucket] -= rate * np.outer(share, g)
    model = Model(languages, (vectors @ softmax).astype(np.float32), bias.astype(np.float32))
    calibrate(model, kept)
    return model


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature with the least log loss on rows not trained on, and the least margin accepted."""
    if not rows:
        return
    z = np.stack([share @ model.weights[bucket] + model.bias for _, bucket, share in rows])
    labels = np.array([label for label, _, _ in rows])

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.scores(z)[np.arange(len(z)), labels], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.05, 4, 60), key=loss))
    right = margins(z)[z.argmax(axis=1) == labels]
    if len(right) and len(model.languages) > 1:
        # Few rows don't show so small a share: then the tail of a normal distribution is lower.
        tail = right.mean() + NormalDist().inv_cdf(COST) * right.std()
        model.accept = float(max(0.0, min(tail, np.quantile(right, COST, method="lower"))))


def train(df: DataFrame, text_col: str, lang_col: str, id_col: str, seed: int = 7) -> Model:
    """Fit on at most SAMPLE rows of df with text and language. The counts are of all rows; the driver gets subword counts only."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    # The text too: ids may be null or repeated.
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("language sample"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("place", place)
    first = F.struct("place", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min(first).alias("first")).collect()
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    languages = sorted(r["lang"] for r in found)
    each = SAMPLE / len(found)
    shares = spark.createDataFrame([(r["lang"], min(1.0, 0.8 * each / r["count"]), r["first"]) for r in found], T.StructType.fromDDL("lang string, share double, first struct<place:double,text:long>"))
    # The first row of each language is in the sample, whatever its share.
    firsts = F.struct(F.col("place"), F.xxhash64("text").alias("text")) == F.col("first")
    chosen = rows.join(F.broadcast(shares), "lang").withColumn("is_first", firsts).where(F.col("is_first") | (F.col("place") < F.col("share"))).select("id", "text", "lang", "place", "is_first")

    def count(batch):
        buckets, counts = [], []
        for x in batch.column(1):
            all_of = sum(np.bincount(b, minlength=BUCKETS) for b in subwords(x.as_py()))
            there = np.flatnonzero(all_of)
            buckets.append(there.astype("<u2").tobytes())
            counts.append(all_of[there].astype("<u4").tobytes())
        return [pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())]

    counted = map_batches(chosen, "buckets binary, counts binary", count, ("text",)).select("lang", "place", "is_first", "buckets", "counts")
    sample, known = [], {x: k for k, x in enumerate(languages)}
    taken = counted.orderBy(F.desc("is_first"), "place", "lang", "buckets").limit(max(SAMPLE, len(found))).collect()
    for r in sorted(taken, key=lambda r: (r["place"], r["lang"].encode(), bytes(r["buckets"]))):
        c = np.frombuffer(r["counts"], "<u4")
        sample.append((known[r["lang"]], np.frombuffer(r["buckets"], "<u2"), (c / c.sum()).astype(np.float32)))
    del taken
    model = fit(sample, languages, seed)
    del sample
    give_back()
    if len(languages) > 1:
        # Beyond the shares that training chose from, so of other rows.
        more = CALIBRATE / SAMPLE * F.col("share")
        others = rows.join(F.broadcast(shares), "lang").where((F.col("place") >= F.col("share")) & (F.col("place") < F.col("share") + more)).where(F.col("text").rlike(r"\p{L}")).select("text", "lang")
        widen(model, others)
    return model


def widen(model: Model, others: DataFrame) -> None:
    """The least margin accepted, from the margins of other rows (text, lang), if they are enough."""

    def judge(batch):
        z = [model.logits(x.as_py()) for x in batch.column(0)]
        right = [model.languages[int(x.argmax())] == lang for x, lang in zip(z, batch.column(1).to_pylist())]
        return [pa.array([float(margins(x)) for x in z], pa.float64()), pa.array(right, pa.bool_())]

    judged = map_batches(others, "margin double, right boolean", judge, ("text", "lang"))
    right = judged.where("right").select("margin").toArrow()["margin"].to_numpy()  # about CALIBRATE numbers at most
    if len(right) >= ENOUGH:
        model.accept = float(max(0.0, np.quantile(right, COST, method="lower")))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df plus lang_pred, score (calibrated, 0 to 1) and rejected."""
    rows = df.withColumn("__letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def run(batch):
        names, scores, rejected = [], [], []
        for x, ok in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ok and model.languages:
                z = model.logits(x)
                p = model.scores(z)
                names.append(model.languages[int(p.argmax())])
                scores.append(min(1.0, float(p.max())))
                rejected.append(bool(margins(z) < model.accept))
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_results(rows, "lang_pred string, score double, rejected boolean", run, [text_col, "__letter"]).drop("__letter")


def held_out(id_col: str) -> F.Column:
    """crc32(id as text) mod 4 is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
