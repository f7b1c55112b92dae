"""Quality classifier: supervised embeddings of hashed words, word pairs and character n-grams."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_with_tasks
from .common import BYTE_CODES, NOT_SPACE, held_out, mixed, powers, query, row_blocks, table, text_bytes, words
from .labelled import labelled_sample

ship_with_tasks(__name__)

BUCKETS = 18  # bits
GRAMS = (3, 4)
DIMENSIONS = 16
# Bounds of the training sample.
TRAIN_ROWS = 4000
TRAIN_BYTES = 24 << 20
EPOCHS = 6
RATE = 0.5
KEEP_FROM = 0.3
_TEXT_BYTES = 512 << 10
_SHIFT = np.uint64(64 - BUCKETS)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SPREAD = np.uint64(0xFF51AFD7ED558CCD)


def features(data: np.ndarray, borders: np.ndarray):
    """Yields ``(bucket, row)`` of all features of texts that lie back to back.

    Features are words (runs of what is no white space), pairs of words, and the n-grams of UTF-8
    bytes of the whole text, each hashed to a bucket. All pairs of a word with itself are one feature.
    """
    _, _, row, hashes = words(data, borders, NOT_SPACE, BYTE_CODES)
    yield (hashes >> _SHIFT).astype(np.int64), row
    same = row[1:] == row[:-1]
    pairs = np.where(hashes[1:] == hashes[:-1], _PAIR, mixed(hashes[:-1] * _PAIR + hashes[1:]))[same]
    yield (pairs >> _SHIFT).astype(np.int64), row[1:][same]
    of_byte = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    codes, power = BYTE_CODES[data], powers(8)
    for n in GRAMS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        gram = codes[:m] * power[0]
        for k in range(1, n):
            gram = gram + codes[k : m + k] * power[k]
        whole = of_byte[:m] == of_byte[n - 1 :]
        bucket = ((gram ^ (gram >> np.uint64(29))) * _SPREAD + np.uint64(n)) * _PAIR >> _SHIFT
        yield bucket[whole].astype(np.int64), of_byte[:m][whole]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text, and the share of its features in each."""
    data, borders = text_bytes(pa.array([text]))
    found = [b for b, _ in features(data, borders)] if len(data) else []
    if not sum(map(len, found)):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
    return buckets.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def fit(texts: list[str], labels: list[int], share: float, *, seed: int = 7) -> tuple[np.ndarray, float]:
    """Trains vectors and a softmax layer by stochastic gradient descent; returns them folded into one number
    per bucket, the difference of the two classes' outputs, and a bias.

    A document's vector is the mean of its features' vectors, so its output is the mean of these
    numbers plus the bias. The bias is set for ``share``, the part of label 1 among all rows, since the sample is
    balanced. Without both classes the score is ``share`` everywhere.
    """
    prior = math.log(share / (1 - share))
    ones = sum(labels)
    if not ones or ones == len(labels):
        return np.zeros(1 << BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    # Two long arrays rather than many small ones, so the driver gives all of it back.
    ends, all_buckets, all_parts = [0], array("i"), array("f")
    for text in texts:
        buckets, part = bag(text)
        all_buckets.frombytes(buckets.tobytes())
        all_parts.frombytes(part.tobytes())
        ends.append(len(all_buckets))
    all_buckets, all_parts = np.frombuffer(all_buckets, np.int32), np.frombuffer(all_parts, np.float32)
    steps, step = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)).tolist():
            buckets, part = all_buckets[ends[i] : ends[i + 1]], all_parts[ends[i] : ends[i + 1]]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = part @ vectors[buckets]
            logits = output @ hidden + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            back = output.T @ wrong
            output -= rate * np.outer(wrong, hidden)
            bias -= rate * wrong
            # As is usual for averaged vectors, every feature of the document takes the whole step.
            vectors[buckets] -= rate * back * np.minimum(part[:, None] * len(buckets), 4.0)
    sampled = math.log(ones / (len(labels) - ones))
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0]) + prior - sampled


def mean_outputs(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features; 0 for a text without any."""
    sums, counts = np.zeros(len(text)), np.zeros(len(text))
    data, borders = text_bytes(text)
    for a, b in row_blocks(borders, _TEXT_BYTES):
        own, part = borders[a : b + 1] - borders[a], data[borders[a] : borders[b]]
        if not len(part):
            continue
        for bucket, row in features(part, own):
            sums[a:b] += np.bincount(row, weights[bucket], minlength=b - a)
            counts[a:b] += np.bincount(row, minlength=b - a)
    return sums / np.maximum(counts, 1)


class QualityModel:
    """A fitted classifier; ``score`` is a column expression."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> QualityModel:
        """Learns from at most ``rows`` labelled texts of ``text_bytes`` bytes together, never from held-out rows."""
        sample, share = labelled_sample(docs, labels, label, text=text, key=key, rows=rows, text_bytes=text_bytes)
        return QualityModel(*fit([r["text"] for r in sample], [r["label"] for r in sample], share))

    def scorer(self, docs: DataFrame):
        """A function from a text column to its score from 0 to 1; the model broadcast has a fixed size of 1 MB."""
        shared, bias = docs.sparkSession.sparkContext.broadcast(self.weights), self.bias

        @F.arrow_udf("double")
        def score(text: pa.Array) -> pa.Array:
            logits = np.clip(mean_outputs(text, shared.value) + bias, -700, 700)
            return pa.array(1 / (1 + np.exp(-logits)))

        return score.asNondeterministic()


def score_quality(docs: DataFrame, model: QualityModel, *, text: str = "text", key: str = "doc_id", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` (higher: label 1 likelier) and ``predicted``; such columns are replaced.

    Whole texts are scored. A null or empty text has no features and gets the score of the bias alone; a null
    key counts as held out. Repeated rows are scored alike.
    """
    scored = docs.drop("held_out", "score", "predicted").withColumn("score", model.scorer(docs)(F.col(text)))
    return scored.withColumns({"held_out": held_out(F.col(key)), "predicted": predicted(F.col("score"), keep_from)})


def predicted(score: Column, keep_from: float = KEEP_FROM) -> Column:
    return (score >= keep_from).cast("int")


def keep_good(docs: DataFrame, model: QualityModel, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, columns as in ``docs``."""
    text, key = options.get("text", "text"), options.get("key", "doc_id")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    return score_quality(row, model, **(options | {"text": "_text", "key": "_key"})).filter("predicted = 1").select("_row.*")


@query("op10_quality")
def op10(spark, sf):
    """Every document's quality score."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = QualityModel.train(docs, table(spark, sf, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")
