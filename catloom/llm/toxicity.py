"""Toxicity by compression distance: zstandard with a toxic and an ordinary dictionary, window by window."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_with_tasks
from .common import ALPHANUMERIC, BYTE_CODES, held_out, mixed, powers, query, row_blocks, table, text_bytes
from .labelled import labelled_sample

ship_with_tasks(__name__)

# Bounds of the training sample.
TRAIN_ROWS = 4000
TRAIN_BYTES = 12 << 20
WINDOW_WORDS = 12
# Longer windows are cut, since the compressor drops its dictionary for long input; pieces overlap by the longest segment.
WINDOW_BYTES = 512
SEGMENT_BYTES = 24
ORDINARY_BYTES = 32 << 10
GRAM_SIZES = (5, 6, 8)
LEVEL = 6
# Both dictionaries end with this mark and every window too. It costs the same few bytes in both, and makes
# each frame compressible, since zstandard stores short windows as they are when there is little to gain.
_MARK = bytes(range(1, 32)) + bytes(range(1, 32))[::-1]
TOXIC_FROM = 0.5
_SPACE = 32
# Letters, digits and all beyond ASCII stay, A-Z become small, the rest becomes a space.
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[ALPHANUMERIC] = np.flatnonzero(ALPHANUMERIC)
_FOLD[65:91] = np.arange(97, 123)
_TEXT_BYTES = 1 << 20


def folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]


def windows(text: bytes, size: int = WINDOW_WORDS) -> list[bytes]:
    """Consecutive runs of ``size`` words of a folded text, in pieces of at most ``WINDOW_BYTES`` bytes."""
    split = text.split()
    return [piece for i in range(0, len(split), size) for piece in pieces(b" " + b" ".join(split[i : i + size]) + b" ")]


def pieces(run: bytes) -> list[bytes]:
    """A run cut at borders of characters; anything of up to ``SEGMENT_BYTES`` bytes is whole in one piece."""
    out, start = [], 0
    while len(run) - start > WINDOW_BYTES:
        end = _character(run, start + WINDOW_BYTES)
        out.append(run[start:end])
        start = _character(run, end - SEGMENT_BYTES)
    return [*out, run[start:]]


def _character(run: bytes, at: int) -> int:
    """Where the character at ``at`` begins; a character has at most four bytes."""
    return next((i for i in range(at, at - 4, -1) if run[i] & 0xC0 != 0x80), at)


def _grams(text: np.ndarray, size: int) -> np.ndarray:
    m = len(text) - size + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    codes, power, out = BYTE_CODES[text], powers(16), np.zeros(m, np.uint64)
    for k in range(size):
        out += codes[k : m + k] * power[k]
    return mixed(out + np.uint64(size))


def toxic_segments(toxic: list[np.ndarray], ordinary: list[np.ndarray], *, least_share: float = 0.05, most: int = 200) -> list[bytes]:
    """Segments for the toxic dictionary, most valuable first.

    As a dictionary trainer does, it takes the segment that covers most of the samples, marks what it
    covers, and goes on with the rest. Candidates are the byte n-grams of the toxic texts that no ordinary text
    has. A segment must occur in more toxic texts than chance would bring there, and in at least ``least_share``
    of them; it is lengthened while seven of ten occurrences agree on the next byte.
    """
    sizes, ids, docs, places = [], [], [], []
    for size in GRAM_SIZES:
        plain = np.unique(np.concatenate([np.zeros(1, np.uint64)] + [np.unique(_grams(t, size)) for t in ordinary]))
        for d, text in enumerate(toxic):
            grams = _grams(text, size)
            at = np.flatnonzero(plain[np.searchsorted(plain, grams).clip(max=len(plain) - 1)] != grams)
            sizes.append(np.full(len(at), size))
            ids.append(grams[at])
            docs.append(np.full(len(at), d))
            places.append(at)
    if not sizes or not sum(map(len, sizes)):
        return []
    size, doc, place = np.concatenate(sizes), np.concatenate(docs), np.concatenate(places)
    names, gram = np.unique(np.concatenate(ids), return_inverse=True)
    chance = math.log(max(len(names), 2)) / math.log((len(toxic) + len(ordinary)) / len(toxic)) if ordinary else 2
    need = max(2, math.ceil(chance), math.ceil(least_share * len(toxic)))

    def in_docs(keep: np.ndarray) -> np.ndarray:
        pairs = np.unique(gram[keep] * len(toxic) + doc[keep])
        return np.bincount(pairs // len(toxic), minlength=len(names))

    often = in_docs(np.ones(len(gram), bool))[gram] >= need
    size, doc, place, gram = size[often], doc[often], place[often], gram[often]
    open_, chosen, width = np.ones(len(gram), bool), [], np.zeros(len(names), np.int64)
    width[gram] = size
    key = doc * np.int64(1 << 32) + place
    while len(chosen) < most and open_.any():
        counts = in_docs(open_)
        best = int(np.argmax(counts * width))
        if counts[best] < need:
            break
        at = np.flatnonzero(open_ & (gram == best))
        left, right = 0, int(width[best])
        for step in (-1, 1):
            while right - left < SEGMENT_BYTES:
                edge = left - 1 if step < 0 else right
                seen = [int(toxic[doc[i]][place[i] + edge]) for i in at if 0 <= place[i] + edge < len(toxic[doc[i]])]
                byte, n = max(((b, seen.count(b)) for b in set(seen)), key=lambda x: x[1], default=(0, 0))
                # A segment goes up to the space at either end, not into the next word.
                edge_byte = toxic[doc[at[0]]][place[at[0]] + (left if step < 0 else right - 1)]
                if n < 0.7 * len(at) or edge_byte == _SPACE:
                    break
                at = np.array([i for i in at if 0 <= place[i] + edge < len(toxic[doc[i]]) and toxic[doc[i]][place[i] + edge] == byte])
                left, right = (left - 1, right) if step < 0 else (left, right + 1)
        i = at[0]
        chosen.append(bytes(toxic[doc[i]][place[i] + left : place[i] + right]))
        # Whatever shares bytes with an occurrence is covered.
        taken = np.sort(key[open_ & (gram == best)])
        after = taken[np.searchsorted(taken, key - right, side="right").clip(max=len(taken) - 1)]
        open_ &= ~((after > key - right) & (after < key - left + size)) & (gram != best)
    return chosen


def parameters(level: int = LEVEL) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(
        level, source_size=128, dict_size=ORDINARY_BYTES, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def ordinary_dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples for training
        return b"".join(samples)[-size:]


class Distance:
    """Bytes that the toxic dictionary saves on each window against the ordinary one.

    The toxic dictionary ends with the segments trained from toxic text and has the ordinary words
    before them, so both compress ordinary words alike and differ only where toxic segments occur.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            given = zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(compression_params=parameters())
            return zstandard.ZstdCompressor(dict_data=given, compression_params=parameters())

        self._plain, self._toxic = compressor(ordinary), compressor(ordinary + toxic)

    def saved(self, text: bytes) -> np.ndarray:
        plain, toxic = self._plain.compress, self._toxic.compress
        return np.array([len(plain(w)) - len(toxic(w)) for w in (w + _MARK for w in windows(text))], np.float64)


def measures(saved: np.ndarray) -> np.ndarray:
    """What the thresholds see of a text: the best window, the three best, windows with clear savings, their share, and the mean."""
    if not len(saved):
        return np.zeros(5)
    top = np.sort(saved)[::-1][:3]
    clear = (saved >= 3).sum()
    return np.array([top[0], top.sum() / 3, math.log1p(clear), clear / len(saved), saved.mean()])


def calibrate(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic thresholds over the measures by Newton's method with a small ridge; the last number is the bias."""
    x = np.column_stack([rows, np.ones(len(rows))])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-4
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + ridge * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class ToxicityModel:
    """Both dictionaries and the thresholds."""

    def __init__(self, ordinary: bytes, toxic: bytes, beta: np.ndarray):
        self.ordinary, self.toxic, self.beta = ordinary, toxic, beta

    @staticmethod
    def fit(texts: list[str], labels: list[int], share: float) -> ToxicityModel:
        """Dictionaries from two of three texts, thresholds from the third; ``share`` of label 1 sets the weights of the classes."""
        marks = np.array(labels, np.int64)
        if marks.min(initial=1) == marks.max(initial=0) or len(marks) < 2:
            return ToxicityModel(b"", b"", np.array([0, 0, 0, 0, 0, math.log(share / (1 - share))]))
        order = np.concatenate([np.flatnonzero(marks == k) for k in (0, 1)])
        turn = np.empty(len(marks), np.int64)
        for k in (0, 1):
            own = np.flatnonzero(marks == k)
            turn[own] = np.arange(len(own)) % 3
        given = {i: folded(texts[i]) for i in order}
        learn = [i for i in order if turn[i] < 2]
        toxic, plain = ([given[i] for i in learn if marks[i] == k] for k in (1, 0))
        segments = toxic_segments(toxic, plain)
        samples = [w for t in plain for w in windows(t.tobytes())]
        rng = np.random.default_rng(3)
        samples = [samples[i] for i in rng.permutation(len(samples))[:40000]]
        model = ToxicityModel(ordinary_dictionary(samples, ORDINARY_BYTES), b"".join(reversed(segments)), np.zeros(6))
        distance = Distance(model.ordinary, model.toxic)
        rest = [i for i in order if turn[i] == 2] or list(order)
        rows, own = np.array([measures(distance.saved(given[i].tobytes())) for i in rest]), marks[rest]
        ones = max(1, own.sum())
        weights = np.where(own == 1, share / ones, (1 - share) / max(1, len(own) - ones)) * len(own)
        model.beta = calibrate(rows, own, weights)
        return model

    @staticmethod
    def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> ToxicityModel:
        """Learns from at most ``rows`` labelled texts of ``text_bytes`` bytes together, never from held-out rows."""
        sample, share = labelled_sample(docs, labels, label, text=text, key=key, rows=rows, text_bytes=text_bytes)
        return ToxicityModel.fit([r["text"] for r in sample], [r["label"] for r in sample], share)

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        distance = Distance(self.ordinary, self.toxic)
        rows = np.array([measures(distance.saved(t)) for t in texts]).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(rows @ self.beta[:-1] + self.beta[-1], -700, 700)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` (higher: toxic likelier) and ``predicted``; such columns are replaced.

    All windows of the whole text count. A null or empty text has no window and gets the score of the
    bias alone; a null key counts as held out. The model has a fixed size of about 40 kB.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.beta))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        own, out = ToxicityModel(*shared.value), []
        data, borders = text_bytes(column)
        for a, b in row_blocks(borders, _TEXT_BYTES):
            raw, at = _FOLD[data[borders[a] : borders[b]]].tobytes(), (borders[a : b + 1] - borders[a]).tolist()
            out.append(own.scores(raw[x:y] for x, y in zip(at, at[1:], strict=False)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    scored = docs.drop("held_out", "score", "predicted").withColumn("score", score.asNondeterministic()(F.col(text)))
    return scored.withColumns({"held_out": held_out(F.col(key)), "predicted": (F.col("score") >= toxic_from).cast("int")})


@query("op3_toxicity")
def op3(spark, sf):
    """Every document's toxicity score."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = ToxicityModel.train(docs, table(spark, sf, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")
