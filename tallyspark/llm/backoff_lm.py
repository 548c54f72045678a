"""Scores of a smoothed n-gram model, walked as a weighted backoff automaton."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .bundles import answers, bundled, expand, shard_cuts, shrink, unpack_texts, with_answers
from .words import WordHasher, mix

# Distinct n-grams that a shard adds up, about.
SHARD = 3_000_000
# Classes of contexts by the power of two of their count.
CLASSES = 64


class _Grams:
    """The tokens of a bundle and its distinct n-grams of each order.

    A text's words are followed by one end token, and preceded by it as a context only.
    """

    END = np.uint64(0x2545F4914F6CDD1D)

    def __init__(self, texts: list[bytes], ids: list, order: int, fold: tuple[int, int]) -> None:
        (hashes,), counts = WordHasher(3).many([t.lower() for t in texts])  # of bytes: A-Z alone
        ends = np.cumsum(counts)
        tokens = np.insert(hashes, ends, self.END)
        self.n_tokens = counts + 1
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens
        self.held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % fold[0] == fold[1] for i in ids], bool)
        self.train = np.repeat(~self.held_out, self.n_tokens)
        place = np.arange(len(tokens)) - np.repeat(self.starts, self.n_tokens)
        self.keys, self.inverse, self.counts, self.valid = [], [], [], []
        own = tokens
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate(([self.END], own[:-1]))  # a text before ends in the end token
                own = mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(k))
            valid = place + 2 >= k  # else the history is shorter
            keys, inverse = np.unique(own, return_inverse=True)
            self.keys.append(keys)
            self.inverse.append(inverse)
            self.valid.append(valid)
            self.counts.append(np.bincount(inverse[self.train & valid], minlength=len(keys)).astype(np.uint32))

    def contexts(self, k: int) -> np.ndarray:
        """Index of the context of every ``k``-gram among the grams one shorter."""
        end = np.searchsorted(self.keys[0], self.END) if k == 2 else 0
        return np.concatenate(([end], self.inverse[k - 2][:-1]))


_ASK = pa.schema([("table", pa.int32()), ("shard", pa.int32()), ("bundle", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema(
    [("bundle", pa.int64()), ("table", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]
)


def _ask_batches(order: int, fold: tuple[int, int], shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, ids, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                grams = _Grams(unpack_texts(data), ids, order, fold)
                for k, (keys, counts) in enumerate(zip(grams.keys, grams.counts, strict=True)):
                    cuts = shard_cuts(keys, shards)
                    for s in range(shards):
                        a, b = cuts[s : s + 2]
                        if a < b:
                            own = [k + 1, s, bundle, shrink(keys[a:b], True), shrink(counts[a:b])]
                            yield pa.RecordBatch.from_pylist([dict(zip(_ASK.names, own, strict=True))], _ASK)

    return run


def _add(table: pa.Table) -> pa.Table:
    """Adds up a shard and gives each bundle the corpus counts of its n-grams."""
    keys = [expand(x, True) for x in table.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    counts = np.concatenate([expand(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(flat)
    sorted_keys = flat[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    sums = np.add.reduceat(counts[order], starts)
    totals = np.empty(len(flat), np.uint64)
    totals[order] = np.repeat(sums, np.diff(np.r_[starts, len(flat)])).astype(np.uint64)
    parts = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
    once = np.arange(len(parts)) == 0  # what holds for the shard is told once
    return pa.Table.from_arrays(
        [
            table.column("bundle"), table.column("table"), table.column("shard"),
            pa.array([shrink(p) for p in parts], pa.binary()),
            pa.array(np.where(once, sums.sum(), 0)), pa.array(np.where(once, (sums > 0).sum(), 0)),
        ],
        schema=_REPLY,
    )


def _read(bundle: pa.Table, replies: pa.Table, order: int, fold: tuple[int, int]) -> tuple[list, _Grams, list[np.ndarray]]:
    ids = bundle.column("ids")[0].as_py()
    grams = _Grams(unpack_texts(bundle.column("texts")[0].as_py()), ids, order, fold)
    told = {}
    for table, shard, data in zip(*(replies.column(c).to_pylist() for c in ("table", "shard", "counts")), strict=True):
        told[table, shard] = data
    counts = [
        np.concatenate([expand(told[k]).astype(np.int64) for k in sorted(k for k in told if k[0] == n + 1)])
        for n in range(order)
    ]
    return ids, grams, counts


def _class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


def _novelty(order: int, fold: tuple[int, int]):
    schema = pa.schema([("n", pa.int64()), ("cls", pa.int64()), ("tokens", pa.int64()), ("single", pa.int64())])

    def run(bundle: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if bundle.num_rows:
            _, grams, counts = _read(bundle, replies, order, fold)
            for k in range(2, order + 1):
                use = grams.train & grams.valid[k - 1]
                cls = _class(counts[k - 2][grams.contexts(k)[use]])
                single = counts[k - 1][grams.inverse[k - 1][use]] == 1
                tokens = np.bincount(cls, minlength=CLASSES)
                alone = np.bincount(cls[single], minlength=CLASSES)
                rows += [
                    {"n": k, "cls": c, "tokens": int(tokens[c]), "single": int(alone[c])} for c in np.flatnonzero(tokens).tolist()
                ]
        return pa.Table.from_pylist(rows, schema)

    return run


class Automaton:
    """States are contexts, arcs are n-grams with log10 weights; a failure arc leads to the context one shorter.

    P(w | h) = (1 - f(h)) c(hw) / c(h) + f(h) P(w | h without its first word), where f is the share of
    tokens that follow contexts about as frequent and are the only one of their n-gram: what a
    context of that frequency leaves for words not seen after it (Good and Turing). At the root, P is add-one smoothing with one
    class for all unknown words. The arc of an n-gram carries the logarithm of the whole sum, the failure arc that of f(h),
    so the weights of a path add up to the probability.
    """

    def __init__(self, grams: _Grams, counts: list[np.ndarray], tokens: int, types: int, failure: np.ndarray) -> None:
        self.grams, self.counts = grams, counts
        p = [(counts[0] + 1) / (tokens + types + 1)]
        self.root = np.log10(p[0])
        self.arcs, self.fail = {}, {}
        for k in range(2, len(counts) + 1):
            inverse = grams.inverse[k - 1]
            at = np.zeros(len(counts[k - 1]), np.int64)
            at[inverse[grams.valid[k - 1]]] = np.flatnonzero(grams.valid[k - 1])  # a place where the n-gram stands
            context = counts[k - 2][grams.contexts(k)[at]]
            f = failure[k, _class(context)]
            own = (1 - f) * counts[k - 1] / np.maximum(context, 1) + f * p[-1][grams.inverse[k - 2][at]]
            p.append(np.where(context > 0, own, p[-1][grams.inverse[k - 2][at]]))
            self.arcs[k] = np.log10(p[-1])
            self.fail[k] = np.log10(failure[k, _class(counts[k - 2])])

    def walk(self) -> np.ndarray:
        """The weight that each token adds, from left to right.

        The state before a token is its longest context that is known, which the tokens before it settle,
        so the states of all tokens are at hand at once. Without an arc for the token, failure arcs are taken
        until there is one; the root has one for every token.
        """
        grams, added = self.grams, np.zeros(len(self.grams.inverse[0]))
        waits = np.ones(len(added), bool)
        for k in sorted(self.arcs, reverse=True):
            context = grams.contexts(k)
            here = waits & grams.valid[k - 1] & (self.counts[k - 2][context] > 0)
            arc = here & (self.counts[k - 1][grams.inverse[k - 1]] > 0)
            added[arc] = added[arc] + self.arcs[k][grams.inverse[k - 1][arc]]
            waits &= ~arc
            missing = here & ~arc
            added[missing] = added[missing] + self.fail[k][context[missing]]
        added[waits] += self.root[grams.inverse[0][waits]]
        return added


def _score(order: int, fold: tuple[int, int], tokens: int, types: int, failure: np.ndarray):
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(bundle: pa.Table, replies: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        ids, grams, counts = _read(bundle, replies, order, fold)
        walk = Automaton(grams, counts, tokens, types, failure).walk()
        first = counts[0][grams.inverse[0]]
        base = np.log10((first + 1) / (tokens + types + 1))
        known = np.add.reduceat((first > 0).astype(np.int64), grams.starts)
        columns = [
            pa.array(ids, pa.int64()), pa.array(grams.held_out), pa.array(grams.n_tokens), pa.array(known),
            pa.array(np.full(len(ids), tokens)), pa.array(np.add.reduceat(base, grams.starts)),
            pa.array(np.add.reduceat(walk, grams.starts)),
        ]
        return pa.Table.from_arrays(columns, names)

    return run


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, fold: tuple[int, int] = (7, 2)
) -> DataFrame:
    """Log10 probability of every text under an n-gram model of the texts that are not held out.

    A row is held out if crc32 of its id as text, modulo ``fold[0]``, is ``fold[1]``; rows with a null id are not.
    N-grams of all other rows are counted over the whole corpus, none is dropped. Bundles of documents
    ask shards of the key range for the counts of their own n-grams, so each builds just the part of the
    automaton its texts walk through, however large the model is.

    Returns id, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` of them seen in training, ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score``. Null and empty texts are the end token alone. Repeated rows count
    as often as they occur; other columns are not looked at; an empty table gives an empty result.
    N-grams are told apart by 64-bit hashes.
    """
    bundles = bundled(docs, id_col, text_col)
    total = bundles.agg(F.sum("words")).first()[0] or 0
    texts = bundles.select("bundle", "ids", "texts")
    asked = texts.mapInArrow(
        _ask_batches(order, fold, max(1, -(-total // SHARD))), "table int, shard int, bundle bigint, keys binary, counts binary"
    )
    told = durable(answers(asked, _add, "bundle bigint, table int, shard int, counts binary, tokens bigint, types bigint"))
    row = told.where(F.col("table") == 1).agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(row[0] or 0), int(row[1] or 0)
    replies = told.select("bundle", "table", "shard", "counts")
    # Bounded by orders times classes, whatever the corpus.
    seen = with_answers(texts, replies, _novelty(order, fold), "n bigint, cls bigint, tokens bigint, single bigint")
    failure = np.ones((order + 1, CLASSES))
    for r in seen.groupBy("n", "cls").agg(F.sum("tokens").alias("tokens"), F.sum("single").alias("single")).collect():
        failure[r["n"], r["cls"]] = (r["single"] + 1) / (r["tokens"] + 2)
    scored = with_answers(
        texts, replies, _score(order, fold, tokens, types, failure),
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
