"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its features: the word itself and its character n-grams with marks at both ends,
hashed into a fixed number of buckets. A text is the mean of its words, in which no single word has more than a stated share
(else texts of six words, or of one phrase over and over, hang on one chance word), and a linear softmax reads the class.
Features weigh by their rarity in the sample, else the vectors of what stands in every text learn its chance differences.
Vectors and weights are trained together on a bounded sample of labelled rows, so a misspelling that was never seen shares
most n-gram vectors with the word that was. Where a score reaches one half is settled on the sample's two halves, each read
by a model of the other.

Scoring uses that the model is linear: each bucket's vector is projected once onto the difference of the two class weights,
so a text costs one cached number a word, and every word of the whole text counts.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, slices

_WORDS = re.compile(r"\w+")
#: Words whose number is remembered in a task; the store is emptied when full.
_CACHE_WORDS = 100_000


@dataclass(frozen=True)
class SubwordParams:
    """`max_rows` labelled rows and `max_features` bucket entries bound the training sample, whichever comes first.
    `max_share` is the most that one word may weigh in a text; features in fewer than that
    share `min_docs` of the sampled texts (three at least) are left out, and one in a twentieth of them weighs 1. Small samples are gone through more often, for
    `least_steps` batches."""

    buckets: int = 1 << 20
    dim: int = 4
    n_min: int = 3
    n_max: int = 5
    max_rows: int = 5_000
    max_features: int = 10_000_000
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    scale: float = 100.0
    decay: float = 3e-4
    start: float = 0.02
    min_docs: float = 0.005
    least_steps: int = 450
    max_share: float = 0.01
    seed: int = 7


def word_features(word: str, p: SubwordParams) -> list[int]:
    """The buckets of a lower-case word: itself and its n-grams between `<` and `>`."""
    marked = f"<{word}>"
    size = len(marked)
    grams = [marked]
    for n in range(p.n_min, p.n_max + 1):
        grams += [marked[i:i + n] for i in range(size - n + 1)]
    mask = p.buckets - 1
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in grams]


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def text_bag(text: str | None, p: SubwordParams) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids and their weights in the mean over words of the mean over a word's features."""
    weights: dict[int, float] = {}
    counts = Counter(words_of(text))
    for w, n in counts.items():
        features = word_features(w, p)
        share = min(n / counts.total(), p.max_share) / len(features)
        for f in features:
            weights[f] = weights.get(f, 0.0) + share
    return np.fromiter(weights, np.int32, len(weights)), np.fromiter(weights.values(), np.float32, len(weights))


@dataclass(frozen=True)
class SubwordModel:
    """One number a bucket (its vector along the class difference) and the bias; `score` gives a text's probability."""

    params: SubwordParams
    table: np.ndarray
    bias: float

    def scorer(self):
        known: dict[str, float] = {}
        numbers, p = array("f", self.table.tobytes()), self.params

        def of_word(word: str) -> float:
            features = word_features(word, p)
            value = sum(numbers[f] for f in features) / len(features)
            if len(known) >= _CACHE_WORDS:
                known.clear()
            known[word] = value
            return value

        def score(text: str | None) -> float:
            counts = Counter(words_of(text))
            size = counts.total()
            most, total = p.max_share * size, 0.0
            get = known.get
            for w, n in counts.items():
                value = get(w)
                total += (of_word(w) if value is None else value) * (n if n < most else most)
            logit = self.bias + (total / size if size else 0.0)
            return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, logit))))

        return score


def spread_sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of `values` added up by their place `at` among `size`."""
    return np.stack([np.bincount(at, weights=values[:, d], minlength=size) for d in range(values.shape[1])], axis=1).astype(np.float32)


def fit_bags(bags: list[tuple[int, np.ndarray, np.ndarray]], priors: dict[int, int], p: SubwordParams) -> SubwordModel:
    """Embeddings and softmax weights trained together by Adam on mini-batches.

    Rows weigh so that the classes keep the shares `priors` gives them. With one class or none there is nothing to
    tell apart: every text then scores that class's share, 0 without any label. Rare features leave `bags`.
    """
    total = sum(priors.values())
    seen = {y: sum(1 for b in bags if b[0] == y) for y in (0, 1)}
    if not bags or not seen[0] or not seen[1]:
        share = min(max(priors.get(1, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
        return SubwordModel(p, np.zeros(p.buckets, np.float32), math.log(share / (1 - share)))
    fewest = max(3, p.min_docs * len(bags))
    spread = np.zeros(p.buckets, np.int32)
    for _, ids, _ in bags:
        spread[ids] += 1
    rarity = (np.log((len(bags) + 1) / (spread + 1)) / math.log(20)).astype(np.float32)
    features = np.flatnonzero(spread >= fewest)
    number = np.full(p.buckets, -1, np.int32)
    number[features] = np.arange(len(features), dtype=np.int32)
    for i, (y, ids, shares) in enumerate(bags):  # in place, so that the rare features' memory is given back
        kept = number[ids] >= 0
        bags[i] = (y, number[ids[kept]], shares[kept] * rarity[ids[kept]])
    rng = np.random.default_rng(p.seed)
    vectors = (rng.random((len(features), p.dim), np.float32) - 0.5) * p.start
    weights = (rng.random((p.dim, 2), np.float32) - 0.5) / p.dim
    bias = np.log(np.array([priors[0] / total, priors[1] / total], np.float32))
    m_v, s_v = np.zeros_like(vectors), np.zeros_like(vectors)
    m_w, s_w = np.zeros_like(weights), np.zeros_like(weights)
    row_weight = {y: priors[y] / total * len(bags) / seen[y] for y in (0, 1)}
    place = np.zeros(len(features), np.int64)
    step = 0
    epochs = max(p.epochs, -(-p.least_steps * p.batch // len(bags)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = p.rate * (1 - epoch / epochs)
        for start in range(0, len(order), p.batch):
            part = [bags[i] for i in order[start:start + p.batch]]
            step += 1
            ids = np.concatenate([b[1] for b in part])
            shares = np.concatenate([b[2] for b in part])
            rows = np.repeat(np.arange(len(part)), [len(b[1]) for b in part])
            if not len(ids):
                continue
            y = np.array([b[0] for b in part])
            used = np.flatnonzero(np.bincount(ids, minlength=len(features)))
            place[used] = np.arange(len(used))
            places, shares = place[ids], shares * p.scale
            means = spread_sums(rows, shares[:, None] * vectors[ids], len(part))
            logits = means @ weights + bias
            logits -= logits.max(axis=1, keepdims=True)
            probs = np.exp(logits)
            probs /= probs.sum(axis=1, keepdims=True)
            probs[np.arange(len(part)), y] -= 1
            error = probs * np.array([row_weight[c] for c in y], np.float32)[:, None] / len(part)
            g_w = means.T @ error
            g_v = spread_sums(places, shares[:, None] * (error @ weights.T)[rows], len(used)) + p.decay * vectors[used]
            fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
            m_w, s_w = 0.9 * m_w + 0.1 * g_w, 0.999 * s_w + 0.001 * g_w * g_w
            weights -= rate * (m_w / fix1) / (np.sqrt(s_w / fix2) + 1e-8)
            m_v[used] = 0.9 * m_v[used] + 0.1 * g_v
            s_v[used] = 0.999 * s_v[used] + 0.001 * g_v * g_v
            vectors[used] -= rate * (m_v[used] / fix1) / (np.sqrt(s_v[used] / fix2) + 1e-8)
            bias -= rate * error.sum(axis=0)
    table = np.zeros(p.buckets, np.float32)
    table[features] = (vectors @ (weights[:, 1] - weights[:, 0])) * p.scale * rarity[features]
    return SubwordModel(p, table, float(bias[1] - bias[0]))


def settled_shift(bags: list[tuple[int, np.ndarray, np.ndarray]], priors: dict[int, int], p: SubwordParams) -> float:
    """What to add to a model's logits so that one half is the best threshold by F0.5 on rows the model has not seen; that
    measure counts a clean text taken for toxic for more than a toxic one missed.

    Each half of `bags` is read by a model of the other half; rows weigh as `priors` says, of equally good shifts the one
    nearest 0 counts. Without rows of both classes it is 0.
    """
    logits, classes = [], []
    for half in (0, 1):
        model = fit_bags(bags[1 - half::2], priors, p)
        logits += [model.bias + float(model.table[ids] @ shares) for _, ids, shares in bags[half::2]]
        classes += [y for y, _, _ in bags[half::2]]
    z, toxic = np.array(logits), np.array(classes) == 1
    if toxic.all() or not toxic.any():
        return 0.0
    weight = np.where(toxic, priors[1] / toxic.sum(), priors[0] / (~toxic).sum())

    def measure(shift: float) -> float:
        taken = z + shift >= 0
        return 1.25 * weight[taken & toxic].sum() / (weight[taken].sum() + 0.25 * weight[toxic].sum())

    return max((i / 4 for i in range(-4, 13)), key=lambda c: (round(float(measure(c)), 9), -abs(c)))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: SubwordParams = SubwordParams()) -> SubwordModel:
    """A model from the labelled rows of `docs` (`doc_id`, `text`).

    `labels` must hold only the rows one may learn from. At most `params.max_rows` of them are read, four in ten of them
    toxic where there are enough, and of their bags as many as `params.max_features` allows, in hash order; only these reach the driver. Null texts count
    as empty. A `doc_id` that documents repeat gives one training row each.
    """
    picked, counts = bounded_labels(labels, label, params.max_rows)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 100):
            made = [text_bag(t, params) for t in b["_t"]]
            yield pd.DataFrame({"_h": b["_h"].to_numpy(), "_y": b["_y"].to_numpy(), "_ids": [i.tobytes() for i, _ in made], "_ws": [w.astype(np.float32).tobytes() for _, w in made]})

    # `picked` holds at most max_rows rows of two numbers: a stated bound.
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).join(F.broadcast(picked.select(F.col("doc_id").alias("_d"), "_y")), "_d")
    rows = rows.select(F.xxhash64("_d", "_t").alias("_h"), "_y", "_t").orderBy("_h").limit(params.max_rows).repartition(32)
    held, size = [], 0
    for r in rows.mapInPandas(bags, "_h long, _y int, _ids binary, _ws binary").orderBy("_h").toLocalIterator():
        bag = (r["_y"], np.frombuffer(r["_ids"], np.int32), np.frombuffer(r["_ws"], np.float32))
        size += len(bag[1])
        if size > params.max_features:
            break
        held.append(bag)
    shift = settled_shift(held, counts, params)
    model = fit_bags(held, counts, params)
    return replace(model, bias=model.bias + shift)


def toxicity_score(model: SubwordModel, text: Column) -> Column:
    """Of a text column the model's probability of the toxic class, for null and empty texts too."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_text = model.scorer()
        for part in texts:
            yield pd.Series([of_text(t) for t in part], dtype="float64")

    return score(text)


def score_toxicity(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `score` (0 to 1) and `predicted` (1 from 0.5 on).

    Null and empty texts, and texts without a word, score what the model's bias says. Null ids, repeated rows and ties
    are rows like any other; an empty table gives an empty result; further columns are not read.
    """
    rows = docs.select("doc_id", toxicity_score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
