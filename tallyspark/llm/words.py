"""Words of texts and their hashes, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are hashed at once; a text of any length is done in pieces of about this size.
PIECE = 1 << 20

_SPACES = b" \t\n\x0b\x0c\r"


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about ``limit`` bytes, at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and whether each occurs more than once."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    return ordered[starts], np.diff(np.r_[starts, len(ordered)]) > 1


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, by the position of their first word.

    A run is a polynomial in an odd base with the words' hashes as coefficients, put together from
    runs of half the length.
    """
    m = max(0, len(hashes) - n + 1)
    base = 0x9E3779B97F4A7C15
    run, length = hashes, 1
    out, done = np.zeros(m, np.uint64), 0
    while done < n and m:
        if n & length:
            out = out * np.uint64(pow(base, length, 2**64)) + run[done : done + m]
            done += length
        if done < n:
            run = run[:-length] * np.uint64(pow(base, length, 2**64)) + run[length:]
            length *= 2
    return mix(out)


def _cut(data: bytes, at: int) -> int:
    """The first white space at or after a place, or the end."""
    while at < len(data) and data[at] not in _SPACES:
        at += 1
    return at


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = _cut(data, min(len(data), at + PIECE))
        yield data[at:end]
        at = end


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts; each seed is a hash function of its own."""

    def __init__(self, *seeds: int) -> None:
        self.values, self.steps, self.powers = [], [], []
        for seed in seeds:
            rng = np.random.default_rng(seed)
            self.values.append(rng.integers(0, 2**64, 256, np.uint64))
            self.steps.append(np.uint64(int(rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 5))
            self.powers.append(np.ones(1, np.uint64))
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True

    def _power(self, k: int, n: int) -> np.ndarray:
        if len(self.powers[k]) < n:
            size = 1 << int(n).bit_length()
            self.powers[k] = np.concatenate(([np.uint64(1)], np.full(size - 1, self.steps[k]))).cumprod(dtype=np.uint64)
        return self.powers[k]

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of a text as an array, and where its words start and end."""
        codes = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = ~self.space[codes]
        edges = np.diff(inside)
        return codes, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    def _piece(self, data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes of the words by each seed, and where the words start."""
        codes, starts, ends = self.spans(data)
        if not len(starts):
            return [np.zeros(0, np.uint64) for _ in self.values], starts
        lengths = ends - starts
        # Bytes between words get what place they have after the last word; they are summed apart.
        first = np.zeros(len(codes), np.int32)
        first[starts] = starts
        place = np.arange(len(codes), dtype=np.int32) - np.maximum.accumulate(first)
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[::2], bounds[1::2] = starts, ends
        if bounds[-1] == len(codes):
            bounds = bounds[:-1]
        spread, highest = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), int(place.max()) + 1
        found = []
        for k, values in enumerate(self.values):
            sums = np.add.reduceat(values[codes] * self._power(k, highest)[place], bounds)[::2]
            found.append(mix(sums + spread))
        return found, starts

    def one(self, text: bytes) -> list[np.ndarray]:
        """Hashes of the words of one text, by each seed."""
        done = [self._piece(p)[0] for p in _pieces(text)]
        return [np.concatenate([d[k] for d in done] or [np.zeros(0, np.uint64)]) for k in range(len(self.values))]

    def many(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes of the words of several texts in a row, by each seed, and the number of words of each text."""
        hashes: list[list[np.ndarray]] = []
        counts: list[int] = []
        for a, b in slices(texts):
            data = b"\n".join(texts[a:b])
            if len(data) > 2 * PIECE:
                for text in texts[a:b]:
                    hashes.append(self.one(text))
                    counts.append(len(hashes[-1][0]))
                continue
            found, starts = self._piece(data)
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
            counts += np.diff(np.searchsorted(starts, offsets)).tolist()
            hashes.append(found)
        flat = [np.concatenate([h[k] for h in hashes] or [np.zeros(0, np.uint64)]) for k in range(len(self.values))]
        return flat, np.asarray(counts, np.int64)


def batches_of(batches: Iterable[pa.RecordBatch], id_col: int = 0, text_col: int = 1) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts) of Arrow batches, in slices of about ``PIECE`` bytes."""
    for batch in batches:
        ids, texts = batch.column(id_col), as_bytes(batch.column(text_col))
        for a, b in slices(texts):
            yield ids.slice(a, b - a), texts[a:b]
