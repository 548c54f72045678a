"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import PIECE, WordHasher, as_bytes, slices

# Labelled documents the model is fitted to, those with the smallest hashes; a bound for the driver's memory.
FITTED = 4_000
# Lines of a document that are fitted at most, a run of them from a place that its text picks; scoring reads all lines.
LINES_FITTED = 500
ROUNDS = 150

# Sums over a line from which its features follow.
_SUMS = ("bytes", "words", "upper", "lower", "digits", "symbols", "bangs", "repeated", "distinct")
LINE_FEATURES = (
    "symbols", "capitals", "bangs", "digits", "word_length", "odd_length", "repeated", "varied", "ended", "size", "copy", "short"
)


class LineReader:
    """Feature rows of the lines of texts; a line may be of any length, and its words are counted as a whole."""

    def __init__(self) -> None:
        self.hasher = WordHasher(4)
        classes = np.zeros((256, 5), bool)
        for k, characters in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!")):
            classes[list(characters), k] = True
        self.classes = classes

    def _sums(self, lines: list[bytes]) -> np.ndarray:
        out = np.zeros((len(lines), len(_SUMS)))
        lengths = np.array([len(x) for x in lines], np.int64)
        out[:, 0] = lengths
        for a, b in slices(lines):
            if b == a + 1:  # perhaps a very long line: its bytes are counted in pieces, its words hashed as a whole
                line, counts = lines[a], np.zeros((1, 5), np.int64)
                for at in range(0, len(line), PIECE):
                    counts += self.classes[np.frombuffer(line[at : at + PIECE], np.uint8)].sum(0)
                hashes = self.hasher.one(line)[0]
                owner = np.zeros(len(hashes), np.int64)
            else:
                data = b"\n".join(lines[a:b])
                offsets = np.cumsum([0] + [len(x) + 1 for x in lines[a:b]])[:-1]
                codes, starts, _ = self.hasher.spans(data + b"\n")
                counts = np.add.reduceat(self.classes[codes], offsets, axis=0, dtype=np.int64)
                owner = np.searchsorted(offsets, starts, side="right") - 1
                hashes = self.hasher.one(data)[0]
            own = out[a:b]
            own[:, 1] = np.bincount(owner, minlength=b - a)
            own[:, 2:7] = counts
            again = owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]
            own[:, 7] = np.bincount(again, minlength=b - a)
            order = np.lexsort((hashes, owner))
            new = np.r_[True, (np.diff(owner[order]) != 0) | (np.diff(hashes[order]) != 0)] if len(order) else order
            own[:, 8] = np.bincount(owner[order][new], minlength=b - a)
        return out

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, weights, lines per text): a row per line with its own features and its neighbours'."""
        split = [t.split(b"\n") for t in texts]
        lines = [x for own in split for x in own]
        counts = np.array([len(own) for own in split], np.int64)
        s = dict(zip(_SUMS, self._sums(lines).T, strict=True))
        words, letters = np.maximum(s["words"], 1), np.maximum(s["upper"] + s["lower"], 1)
        length = s["bytes"] / words / 10
        ended = np.array([x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines], float)
        copies = np.zeros(len(lines))
        at = 0
        for own in split:
            known: set[bytes] = set()
            for x in own:
                copies[at] = bool(x.strip()) and x in known
                known.add(x)
                at += 1
        columns = (
            np.minimum(s["symbols"] / words, 2), s["upper"] / letters, np.minimum(s["bangs"] / words, 2),
            s["digits"] / np.maximum(s["bytes"], 1), np.minimum(length, 3), np.minimum(np.abs(length - 0.6), 2),
            s["repeated"] / words, s["distinct"] / words, ended, np.log1p(s["words"]) / 5, copies, s["words"] < 3,
        )
        own = np.stack([np.asarray(c, float) for c in columns], axis=1)
        first = np.zeros(len(lines), bool)
        first[np.cumsum(counts) - counts] = True
        last = np.r_[first[1:], True][: len(lines)]
        before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        before[first], after[last] = 0, 0
        edges = np.stack([np.ones(len(lines)), first, last], axis=1)
        return np.concatenate([edges, own, before, after], axis=1), np.maximum(s["bytes"], 1), counts


def forward_backward(unary: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the good state, of neighbouring states, and the log of the partition, for many chains at once.

    ``unary`` is the score of good over bad of each line, ``counts`` the lines of each chain and ``pairs`` the score of
    each pair of neighbouring states. Steps run over the place in the chain, chains in order of length.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    active = np.searchsorted(-counts[order], -np.arange(longest), side="left")
    emit = np.stack([np.zeros_like(unary), unary], axis=1)
    top = emit.max(axis=1)
    emit = np.exp(emit - top[:, None])
    step = np.exp(pairs)
    alpha, beta = np.ones((len(unary), 2)), np.ones((len(unary), 2))
    scale = np.ones(len(unary))
    for t in range(longest):
        at = starts[: active[t]] + t
        own = emit[at] if t == 0 else (alpha[at - 1] @ step) * emit[at]
        scale[at] = own.sum(axis=1)
        alpha[at] = own / scale[at, None]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        beta[at] = (emit[at + 1] * beta[at + 1]) @ step.T / scale[at + 1, None]
    joint = alpha * beta
    good = joint[:, 1] / joint.sum(axis=1)
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(counts) - counts] = False
    b = np.flatnonzero(inner)
    both = alpha[b - 1][:, :, None] * step * (emit[b] * beta[b] / scale[b, None])[:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    total = np.log(scale) + top
    return good, both, total


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray
    pairs: np.ndarray
    slope: float
    shift: float

    def mean_good(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each document."""
        good, _, _ = forward_backward(features @ self.weights, counts, self.pairs)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)

    def scores(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _squash(self.slope * _logit(self.mean_good(features, sizes, counts)) + self.shift)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _adam(parameters: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for k in range(1, rounds + 1):
        g = gradient(parameters)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        parameters = parameters + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return parameters


def fit_lines(features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> LineModel:
    """Fits the field to lines that have their document's label, and then the documents' probabilities.

    Two thirds of the documents fit the field by gradient steps on its likelihood, in which each document
    counts alike; the rest fit a logistic curve from mean marginals to labels. Labels of one kind alone give a constant.
    """
    n = features.shape[1]
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return LineModel(np.zeros(n), np.zeros((2, 2)), 0.0, float(_logit(np.array(share))))
    chosen = np.arange(len(labels)) % 3 > 0
    lines = np.repeat(chosen, counts)
    x, c = features[lines], counts[chosen]
    y = np.repeat(labels[chosen], c).astype(float)
    w = np.repeat(1 / c, c) / len(c)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(c) - c] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((len(at), 2, 2))
    seen[np.arange(len(at)), y[at - 1].astype(int), y[at].astype(int)] = 1

    def gradient(p: np.ndarray) -> np.ndarray:
        good, both, _ = forward_backward(x @ p[:n], c, p[n:].reshape(2, 2))
        unary = x.T @ (w * (y - good))
        pair = ((seen - both) * w[at, None, None]).sum(axis=0).ravel()
        return np.r_[unary, pair] - 1e-4 * p

    p = _adam(np.zeros(n + 4), gradient, rounds, 0.1)
    model = LineModel(p[:n], p[n:].reshape(2, 2), 1.0, 0.0)
    rest = np.repeat(~chosen, counts)
    z = _logit(model.mean_good(features[rest], sizes[rest], counts[~chosen]))
    t = labels[~chosen].astype(float)

    def slope(q: np.ndarray) -> np.ndarray:
        e = t - _squash(q[0] * z + q[1])
        return np.array([(e * z).mean(), e.mean()]) - 1e-3 * q

    q = _adam(np.array([1.0, 0.0]), slope, 400, 0.05)
    return LineModel(model.weights, model.pairs, max(float(q[0]), 1e-3), float(q[1]))


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = LineReader()
    for batch in batches:
        texts, labels = as_bytes(batch.column(0)), batch.column(1)
        for a, b in slices(texts):
            features, sizes, counts = reader.read(texts[a:b])
            ends = np.cumsum(counts)
            runs = []
            for text, end, n in zip(texts[a:b], ends.tolist(), counts.tolist(), strict=True):
                taken = min(n, LINES_FITTED)
                first = end - n + crc32(text) % (n - taken + 1)
                runs.append(slice(first, first + taken))
            yield pa.RecordBatch.from_arrays(
                [
                    labels.slice(a, b - a),
                    pa.array([features[r].astype("<f4").tobytes() for r in runs], pa.binary()),
                    pa.array([sizes[r].astype("<f8").tobytes() for r in runs], pa.binary()),
                ],
                ["label", "features", "sizes"],
            )


def _score_batches(model: LineModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in slices(texts):
                scores = model.scores(*reader.read(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(scores)], ["id", "held_out", "score"]
                )

    return run


def in_fold(id_col: Column, fold: tuple[int, int]) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: tuple[int, int], fitted: int = FITTED
) -> LineModel:
    """Fits a model to at most ``fitted`` labelled documents outside the fold, and ``LINES_FITTED`` lines of each."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~in_fold(F.col("id"), fold))
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fitted)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Bounded by ``fitted`` rows of two numbers; the second limit holds if ids are repeated, and takes the same rows each time.
    sample = rows.join(F.broadcast(known), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(fitted).select("text", "label")
    read = sample.mapInArrow(_read_batches, "label int, features binary, sizes binary").toArrow()
    n = 3 + 3 * len(LINE_FEATURES)
    features = [np.frombuffer(x, "<f4").reshape(-1, n) for x in read.column("features").to_pylist()]
    sizes = [np.frombuffer(x, "<f8") for x in read.column("sizes").to_pylist()]
    return fit_lines(
        np.concatenate(features or [np.zeros((0, n))]).astype(float),
        np.concatenate(sizes or [np.zeros(0)]),
        np.array([len(x) for x in sizes], np.int64),
        np.array(read.column("label").to_pylist(), np.int64),
    )


def line_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fold: tuple[int, int] = (4, 2),
    threshold: float = 0.7,
    fitted: int = FITTED,
) -> DataFrame:
    """Quality of every document by a field that labels each of its lines good or bad.

    A line's features are its own (symbols, capitals, repeated and varied words, length, ending, copies of earlier lines)
    and those of the lines around it. Forward-backward gives each line's probability of being good in its chain;
    their mean, weighted by length, goes through a logistic curve to the document's score. Only labels outside the
    fold (crc32 of the id as text modulo ``fold[0]``, held out if ``fold[1]``) are read, of at most ``fitted`` documents.
    Scoring reads the whole text, one pass without a shuffle.

    Returns id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on). Null and empty texts are a
    single empty line; rows with null ids are not held out; repeated rows are scored alike. Labels that are null or
    neither 0 nor 1 are left out; without labels of both kinds every score is their share. Other columns are not looked at.
    """
    model = train(docs, labels, id_col, text_col, label_col, fold, fitted)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), in_fold(key, fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    scored = rows.mapInArrow(_score_batches(model), f"id {kind}, held_out boolean, score double")
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", predicted.alias("predicted"))
