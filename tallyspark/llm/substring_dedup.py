"""Removal of repeated passages: a count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .bundles import answers, bundled, expand, expand_bits, shard_cuts, shrink, shrink_bits, unpack_texts, with_answers
from .words import WordHasher, distinct, joined, mix

# Rows of the count-min sketch, and counters in a row per window of the corpus.
DEPTH = 2
WIDTH = 4
# Windows that a shard holds, about.
SHARD = 3_000_000


# Bits of a counter's place by which a bundle looks it up.
LOOKUP = 24


def _low(cells: np.ndarray) -> np.ndarray:
    return mix(cells) >> np.uint64(64 - LOOKUP)


def _groups(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (key, check) stand together, and where each group starts."""
    order = np.argsort(keys)
    ordered, second = keys[order], check[order]
    same = ordered[1:] == ordered[:-1]
    if (second[1:] != second[:-1])[same].any():  # keys alike of windows that are not
        order = np.lexsort((check, keys))
        ordered, second = keys[order], check[order]
        same = (ordered[1:] == ordered[:-1]) & (second[1:] == second[:-1])
    new = np.ones(len(keys), bool)
    new[1:] = ~same
    return order, np.flatnonzero(new)


class _Windows:
    """The windows of a bundle: hashes, and documents by position in the bundle."""

    def __init__(self, texts: list[bytes], length: int, width_bits: int, check: bool) -> None:
        (first, *second), counts = WordHasher(*([1, 2] if check else [1])).many(texts)
        self.counts, self.n_words = counts, len(first)
        ends = np.cumsum(counts)
        # A window starts at each word that has enough words of its document from there on.
        starting = np.maximum(counts - length + 1, 0)
        self.document = np.repeat(np.arange(len(texts)), starting)
        self.at = np.arange(starting.sum()) + np.repeat(ends - counts - (np.cumsum(starting) - starting), starting)
        self.keys = joined(first, length)[self.at]
        # Every second hash is 32 bits of a function of its own.
        self.check = (joined(second[0], length)[self.at] >> np.uint64(32)).astype(np.uint32) if check else None
        self.shift = np.uint64(64 - width_bits)

    def cells(self, row: int) -> np.ndarray:
        """The counter of each window in a row of the sketch, in the order of its 64-bit place."""
        return (mix(self.keys + np.uint64(row * 0x9E3779B97F4A7C15 % 2**64)) >> self.shift) << self.shift


def _sketch_batches(length: int, width_bits: int, shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                windows = _Windows(unpack_texts(data), length, width_bits, False)
                for row in range(DEPTH):
                    cells, twice = distinct(windows.cells(row))
                    cuts = shard_cuts(cells, shards)
                    for s in range(shards):
                        a, b = cuts[s : s + 2]
                        if a < b:
                            own = [row, s, bundle, shrink(cells[a:b] >> windows.shift, True), shrink_bits(twice[a:b])]
                            yield pa.RecordBatch.from_pylist(
                                [dict(zip(("table", "shard", "bundle", "cells", "many"), own, strict=True))], _SKETCH
                            )

    return run


_SKETCH = pa.schema(
    [("table", pa.int32()), ("shard", pa.int32()), ("bundle", pa.int64()), ("cells", pa.binary()), ("many", pa.binary())]
)
_REPLY = pa.schema([("bundle", pa.int64()), ("table", pa.int32()), ("shard", pa.int32()), ("flags", pa.binary())])


def _merge(table: pa.Table) -> pa.Table:
    """Adds up a slice of a sketch row and tells each bundle which of its counters reach two."""
    cells = [expand(x, True) for x in table.column("cells").to_pylist()]
    many = [c[expand_bits(x)] for c, x in zip(cells, table.column("many").to_pylist(), strict=True)]
    flat = np.sort(np.concatenate(cells + many))
    repeated = np.unique(flat[:-1][flat[1:] == flat[:-1]])
    replies = []
    for own in cells:
        at = np.searchsorted(repeated, own)
        at[at == len(repeated)] = 0
        replies.append(shrink_bits(repeated[at] == own if len(repeated) else np.zeros(len(own), bool)))
    return pa.Table.from_arrays(
        [table.column("bundle"), table.column("table"), table.column("shard"), pa.array(replies, pa.binary())], schema=_REPLY
    )


class _Candidates:
    """Windows of a bundle that the sketch estimates as repeated; distinct ones in the order of their hash."""

    def __init__(self, windows: _Windows, ids: list, replies: pa.Table) -> None:
        flags = {}
        for table, shard, data in zip(*(replies.column(c).to_pylist() for c in ("table", "shard", "flags")), strict=True):
            flags[table, shard] = data
        self.flags = flags
        keep = np.ones(len(windows.keys), bool)
        for row in range(DEPTH):
            own = windows.cells(row)
            marks = [expand_bits(flags[k]) for k in sorted(k for k in flags if k[0] == row)]
            repeated = distinct(own)[0][np.concatenate(marks)] if marks else own[:0]
            # Looked up by some of their bits: that lets a few more windows through, and none less.
            table = np.zeros(1 << LOOKUP, bool)
            table[_low(repeated)] = True
            keep &= table[_low(own)]
        # A row without an id has no place in the order of ids: it neither removes nor is removed from.
        known = np.array([i is not None for i in ids], bool)
        owner = np.array([0 if i is None else i for i in ids], np.int64)
        keep &= known[windows.document]
        self.at = windows.at[keep]
        self.owner = owner[windows.document[keep]]
        keys, check = windows.keys[keep], windows.check[keep]
        order, starts = _groups(keys, check)
        self.keys, self.check = keys[order][starts], check[order][starts]
        self.least = np.minimum.reduceat(self.owner[order], starts) if len(starts) else self.owner[:0]
        self.group = np.empty(len(keys), np.int64)
        self.group[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))


def _candidates(bundle: pa.Table, replies: pa.Table, length: int, width_bits: int) -> tuple[list, list[bytes], _Windows, _Candidates]:
    texts = unpack_texts(bundle.column("texts")[0].as_py())
    ids = bundle.column("ids")[0].as_py()
    windows = _Windows(texts, length, width_bits, True)
    return ids, texts, windows, _Candidates(windows, ids, replies)


_ASK = pa.schema(
    [("table", pa.int32()), ("shard", pa.int32()), ("bundle", pa.int64()), ("keys", pa.binary()), ("check", pa.binary()), ("least", pa.binary())]
)


def _ask(length: int, width_bits: int, shards: int):
    def run(bundle: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if bundle.num_rows:
            _, _, _, found = _candidates(bundle, replies, length, width_bits)
            cuts = shard_cuts(found.keys, shards)
            for s in range(shards):
                a, b = cuts[s : s + 2]
                if a < b:
                    least = found.least[a:b].view(np.uint64)
                    own = [DEPTH, s, bundle.column("bundle")[0].as_py(), shrink(found.keys[a:b], True), shrink(found.check[a:b]), shrink(least)]
                    rows.append(dict(zip(_ASK.names, own, strict=True)))
        return pa.Table.from_pylist(rows, _ASK)

    return run


def _group(table: pa.Table) -> pa.Table:
    """Groups a shard's windows exactly and tells each bundle which of them a smaller id has."""
    keys = [expand(x, True) for x in table.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    check = np.concatenate([expand(x) for x in table.column("check").to_pylist()])
    least = np.concatenate([expand(x) for x in table.column("least").to_pylist()]).view(np.int64)
    order, starts = _groups(flat, check)
    smallest = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.r_[starts, len(flat)]))
    smaller = np.empty(len(flat), bool)
    smaller[order] = smallest < least[order]
    parts = np.split(smaller, np.cumsum([len(k) for k in keys])[:-1])
    return pa.Table.from_arrays(
        [table.column("bundle"), table.column("table"), table.column("shard"), pa.array([shrink_bits(p) for p in parts], pa.binary())],
        schema=_REPLY,
    )


def _remove(length: int, width_bits: int, with_text: bool):
    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(bundle: pa.Table, replies: pa.Table) -> pa.Table:
        ids: list = []
        n_words: list[int] = []
        n_removed: list[int] = []
        digests: list[str] = []
        kept_texts: list[str] = []
        if bundle.num_rows:
            ids, texts, windows, found = _candidates(bundle, replies, length, width_bits)
            marks = [expand_bits(found.flags[k]) for k in sorted(k for k in found.flags if k[0] == DEPTH)]
            elsewhere = np.concatenate(marks) if marks else np.zeros(len(found.keys), bool)
            gone = elsewhere[found.group] | (found.owner > found.least[found.group])
            cover = np.bincount(found.at[gone], minlength=windows.n_words + 1)
            cover[length:] -= cover[: max(0, len(cover) - length)].copy()
            stays = np.cumsum(cover[: windows.n_words]) == 0
            n_words = windows.counts.tolist()
            starts = np.cumsum(windows.counts) - windows.counts
            for text, start, n in zip(texts, starts.tolist(), n_words, strict=True):
                keep = stays[start : start + n]
                words = text.split()
                left = int(keep.sum())
                if left < n:
                    words = [words[k] for k in np.flatnonzero(keep)]
                line = b" ".join(words)
                n_removed.append(n - left)
                digests.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    kept_texts.append(line.decode())
        columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns + [pa.array(kept_texts, pa.string())] * with_text, names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = False
) -> DataFrame:
    """Documents without the words of windows that also start in a document with a smaller id.

    1. Every bundle of documents adds its windows to a count-min sketch whose counters saturate at two;
       the sketch grows with the corpus (``WIDTH`` counters a window and row) and its slices are merged each in its own task.
       A bundle learns which of its own counters reached two. Counters only overestimate, so no repeated window is lost.
    2. Windows estimated as repeated are grouped exactly, by 96 bits of two hashes, to the smallest id that has them.
    3. Words covered by a window that a smaller id has are removed; windows are those of the input.

    Returns id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by spaces) and, if asked for,
    ``kept_text``. Null and empty texts and texts shorter than a window lose nothing. Rows with a null id take no
    part in the comparison and are returned whole; rows that share an id never remove words from one another.
    Other columns are not looked at; an empty table gives an empty result.
    """
    bundles = bundled(docs, id_col, text_col)
    total = bundles.agg(F.sum("words")).first()[0] or 0
    width_bits = max(16, min(63, (WIDTH * max(total, 1)).bit_length()))
    shards = max(1, -(-total // SHARD))
    sketch = bundles.select("bundle", "texts").mapInArrow(
        _sketch_batches(window, width_bits, shards), "table int, shard int, bundle bigint, cells binary, many binary"
    )
    reply = "bundle bigint, table int, shard int, flags binary"
    estimated = durable(answers(sketch, _merge, reply))
    texts = bundles.select("bundle", "ids", "texts")
    asked = with_answers(
        texts, estimated, _ask(window, width_bits, shards),
        "table int, shard int, bundle bigint, keys binary, check binary, least binary",
    )
    exact = durable(answers(asked, _group, reply))
    kept = with_answers(
        texts, estimated.unionByName(exact), _remove(window, width_bits, with_text),
        "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text,
    )
    return kept.withColumnRenamed("id", id_col)
