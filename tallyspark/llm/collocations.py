"""Phrase collocations from exact n-gram counts held in counting quotient filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, scratch_path
from .bundles import expand, expand_bits, shrink, shrink_bits
from .words import as_bytes

BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
# Bytes of text in a bundle, and tokenised at once; entries of a shard on average.
BUNDLE = 8 << 20
PIECE = 1 << 20
SHARD = 2 << 20
LONGEST = 5


# --- counting quotient filters ------------------------------------------------------------------------------------


def _odd_inverse(a: int, bits: int) -> int:
    return pow(a, -1, 1 << bits)


class Permutation:
    """An invertible map of whole numbers of ``bits`` bits onto themselves that spreads them evenly."""

    FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, bits: int) -> None:
        if not 1 <= bits <= 64:
            raise ValueError(f"an n-gram needs {bits} bits, more than the 64 there are")
        self.bits, self.half = bits, np.uint64(max(1, (bits + 1) // 2))
        self.mask = np.uint64((1 << bits) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for factor in self.FACTORS:
            # A shift by at least half the bits is its own inverse.
            x = (x * np.uint64(factor)) & self.mask
            x = x ^ (x >> self.half)
        return x

    def inverse(self, x: np.ndarray) -> np.ndarray:
        for factor in reversed(self.FACTORS):
            x = x ^ (x >> self.half)
            x = (x * np.uint64(_odd_inverse(factor, 64))) & self.mask
        return x


class QuotientFilter:
    """Sorted distinct numbers of ``bits`` bits with counts, in little space and without loss.

    The high bits of a number are its quotient, one bit of ``occupied`` for each that there is; the low ones, in full, its remainder.
    Remainders stand in order of quotient and value, and a bit of ``ends`` closes the run of each quotient (Pandey et
    al., 2017). There are about as many quotients as entries, so an entry takes two bits and its remainder, and its count.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values, self.counts = values, counts

    @classmethod
    def of(cls, values: np.ndarray) -> QuotientFilter:
        """The filter of unsorted, repeated values."""
        distinct, counts = np.unique(values, return_counts=True)
        return cls(distinct, counts.astype(np.uint64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Sorted filters into one; counts of equal values are added."""
        if not filters:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        values = np.concatenate([f.values for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")  # merges the sorted runs
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        return cls(values[first], np.add.reduceat(counts, first) if len(first) else counts)

    def dump(self, bits: int) -> bytes:
        n = len(self.values)
        low = max(0, bits - max(1, n).bit_length())
        quotients, remainders = self.values >> np.uint64(low), self.values & np.uint64((1 << low) - 1)
        occupied = np.zeros(1 << (bits - low), bool)
        occupied[quotients.astype(np.int64)] = True
        ends = np.r_[quotients[1:] != quotients[:-1], True][:n] if n else np.zeros(0, bool)
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if low <= 8 * np.dtype(k).itemsize)
        most = int(self.counts.max(initial=0)).bit_length()
        counted = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= 8 * np.dtype(k).itemsize)
        parts = [shrink_bits(occupied), shrink_bits(ends), shrink(remainders.astype(kind)), shrink(self.counts.astype(counted))]
        return b"".join([bytes([low]), *(len(p).to_bytes(8, "little") + p for p in parts)])

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        low, at, parts = data[0], 1, []
        for _ in range(4):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        occupied, ends = np.flatnonzero(expand_bits(parts[0])), expand_bits(parts[1])
        run = np.cumsum(ends) - ends
        quotients = occupied[run].astype(np.uint64) if len(run) else np.zeros(0, np.uint64)
        return cls((quotients << np.uint64(low)) | expand(parts[2]).astype(np.uint64), expand(parts[3]).astype(np.uint64))


# --- bundles of word codes ------------------------------------------------------------------------------------------


class _Tokens:
    """Words of texts as codes by language, zero where a piece of text ends.

    A word is known by its key, the language and the word with a line end between them, which no word holds.
    """

    def __init__(self) -> None:
        kind = np.ones(256, np.uint8)
        kind[list(SPACES)] = 0
        kind[list(BREAKS)] = 2
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.kind, self.lower, self.ends = kind, lower, SPACES + BREAKS
        self.codes: dict[bytes, int] = {}
        self.waiting: dict[str, list[bytes]] = {}
        self.held: dict[str, int] = {}
        self.stream: list[np.ndarray] = []
        self.size = 0

    def _pieces(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end] not in self.ends:
                end += 1
            yield text[at:end]
            at = end

    def add(self, lang: str, text: bytes) -> None:
        """Texts of a language are tokenised together; their order does not matter."""
        self.size += len(text)
        self.waiting.setdefault(lang, []).append(text)
        self.held[lang] = self.held.get(lang, 0) + len(text)
        if self.held[lang] >= PIECE:
            self._flush(lang)

    def _flush(self, lang: str) -> None:
        for piece in self._pieces(b"\n".join(self.waiting.pop(lang))):
            self._add(lang.encode() + b"\n", piece)
        self.stream.append(np.zeros(1, np.int32))
        self.held[lang] = 0

    def _add(self, lang: bytes, piece: bytes) -> None:
        data = self.lower[np.frombuffer(piece, np.uint8)]
        kind = self.kind[data]
        inside = kind == 1
        edges = np.diff(np.r_[False, inside, False].astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        breaks = np.r_[0, np.cumsum(kind == 2)]
        if len(starts):
            bounds = np.r_[0, np.cumsum(ends - starts)]
            buffers = [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes())]
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
            codes = self.codes
            own = np.array([codes.setdefault(lang + w, len(codes) + 1) for w in coded.dictionary.to_pylist()], np.int32)
            cut = breaks[starts] != np.r_[0, breaks[ends[:-1]]]
            out = np.zeros(len(starts) + int(cut.sum()), np.int32)
            out[np.arange(len(starts)) + np.cumsum(cut)] = own[coded.indices.to_numpy()]
            self.stream.append(out)
        if breaks[-1] != breaks[ends[-1] if len(ends) else 0]:
            self.stream.append(np.zeros(1, np.int32))

    def row(self, number: int) -> pa.RecordBatch:
        for lang in list(self.waiting):
            self._flush(lang)
        codes = np.concatenate(self.stream)
        counts = np.bincount(codes, minlength=len(self.codes) + 1)[1:]
        columns = [
            pa.array([number], pa.int64()),
            pa.array([list(self.codes)], pa.list_(pa.binary())),
            pa.array([shrink(counts.astype("<u4"))], pa.binary()),
            pa.array([shrink(codes.astype("<u4"))], pa.binary()),
            pa.array([len(self.codes)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bundle", "keys", "counts", "codes", "entries"])


BUNDLES = "bundle bigint, keys array<binary>, counts binary, codes binary, entries bigint"


def _bundle_batches(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tokens = TaskContext.get().partitionId() << 32, _Tokens()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if tokens.size and tokens.size + len(text) > size:
                    yield tokens.row(number)
                    number, tokens = number + 1, _Tokens()
                tokens.add(lang, text)
        if tokens.size:
            yield tokens.row(number)

    return run


def _word_shards(keys: list[bytes], split: int) -> np.ndarray:
    """The shard of each word, by hash."""
    return np.array([crc32(k) for k in keys], np.int64) & ((1 << split) - 1)


WORDS = "bundle bigint, shard int, keys array<binary>, counts binary"


def _words_sent(split: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shards, counts = _word_shards(keys, split), expand(counts)
                order = np.argsort(shards, kind="stable")
                present, first = np.unique(shards[order], return_index=True)
                for shard, own in zip(present.tolist(), np.split(order, first[1:]), strict=True):
                    columns = [
                        pa.array([bundle], pa.int64()),
                        pa.array([shard], pa.int32()),
                        pa.array([[keys[i] for i in own.tolist()]], pa.list_(pa.binary())),
                        pa.array([shrink(counts[own])], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["bundle", "shard", "keys", "counts"])

    return run


NUMBERS = "kind string, bundle bigint, shard int, ids binary, keys array<binary>, counts array<bigint>, numbers array<bigint>"


def _words_merged(min_count: int, split: int):
    """Adds up a shard's words, numbers the frequent ones, and tells each bundle the numbers in the order it has sent."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        coded = pa.concat_arrays([c.flatten() for c in rows.column("keys").chunks]).cast(pa.large_binary()).dictionary_encode()
        codes, keys = coded.indices.to_numpy(), coded.dictionary
        counts = [expand(d).astype(np.int64) for d in rows.column("counts").to_pylist()]
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, codes, np.concatenate(counts))
        often = totals >= min_count
        ids = np.zeros(len(keys), np.uint64)
        ids[often] = (np.arange(1, int(often.sum()) + 1, dtype=np.uint64) << np.uint64(split)) | np.uint64(shard)
        out, at = [], 0
        for bundle, own in zip(rows.column("bundle").to_pylist(), counts, strict=True):
            out.append(("reply", bundle, shard, shrink(ids[codes[at : at + len(own)]]), None, None, None))
            at += len(own)
        place = np.flatnonzero(often)
        out.append(("found", -1, shard, None, keys.take(pa.array(place)).to_pylist(), totals[place].tolist(), ids[place].astype(np.int64).tolist()))
        langs = np.array([k[: k.rindex(b"\n")] for k in keys.to_pylist()], object)
        names, lang = np.unique(langs, return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, lang, totals)
        out.append(("total", -1, shard, None, names.tolist(), sums.tolist(), None))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["kind", "bundle", "shard", "ids", "keys", "counts", "numbers"]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


# --- n-grams, one length after another ------------------------------------------------------------------------------


def _keys(words: np.ndarray, grams: np.ndarray, n: int, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams start whose first and whose last n - 1 words are frequent, and the n-grams as packed numbers.

    ``grams`` holds, for each place, the id of the frequent (n - 1)-gram that starts there, or zero.
    """
    m = max(0, len(words) - n + 1)
    starts = np.flatnonzero((grams[:m] != 0) & (grams[1 : m + 1] != 0))
    return starts, (grams[starts] << np.uint64(word_bits)) | words[starts + n - 1]


def _sent(bundle: int, filter_: QuotientFilter, bits: int, split: int) -> list[tuple]:
    """The filter cut into shards by the highest ``split`` bits."""
    rest = bits - split
    edges = np.array([k << rest for k in range(1, 1 << split)], np.uint64)
    cuts = np.r_[0, np.searchsorted(filter_.values, edges), len(filter_.values)]
    out = []
    for shard in range(1 << split):
        part = slice(cuts[shard], cuts[shard + 1])
        values = filter_.values[part] & np.uint64((1 << rest) - 1)
        if len(values):
            out.append(("message", bundle, shard, QuotientFilter(values, filter_.counts[part]).dump(max(rest, 1)), None))
    return out


STATE = "kind string, bundle bigint, shard int, data binary, more binary"


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = ["kind", "bundle", "shard", "data", "more"]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _numbered(word_split: int, word_bits: int, split: int):
    """Local codes to ids of frequent words; sends the pairs of words."""

    def run(bundles: pa.Table, replies: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return _table([])
        bundle, codes = bundles.column("bundle")[0].as_py(), expand(bundles.column("codes")[0].as_py())
        keys = bundles.column("keys")[0].as_py()
        table, shards = np.zeros(len(keys) + 1, np.uint64), _word_shards(keys, word_split)
        for shard, ids in zip(replies.column("shard").to_pylist(), replies.column("ids").to_pylist(), strict=True):
            table[np.flatnonzero(shards == shard) + 1] = expand(ids)
        words = table[codes]
        _, keys = _keys(words, words, 2, word_bits)
        filter_ = QuotientFilter.of(Permutation(2 * word_bits)(keys))
        state = ("state", bundle, -1, shrink(words), None)
        return _table([state, *_sent(bundle, filter_, 2 * word_bits, split)])

    return run


def _merge(min_count: int, bits: int, split: int):
    """Merges a shard's filters, numbers what is frequent, and tells each bundle the numbers in the order it has sent."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        sent = [QuotientFilter.load(d) for d in rows.column("data").to_pylist()]
        whole = QuotientFilter.merged(sent)
        often = whole.counts >= min_count
        values, counts = whole.values[often], whole.counts[often]
        # Numbers of different shards do not meet, and none is zero.
        ids = (np.arange(1, len(values) + 1, dtype=np.uint64) << np.uint64(split)) | np.uint64(shard)
        out = []
        for bundle, own in zip(rows.column("bundle").to_pylist(), sent, strict=True):
            at = np.searchsorted(values, own.values)
            known = np.zeros(len(at), bool)
            inside = at < len(values)
            known[inside] = values[at[inside]] == own.values[inside]
            out.append(("reply", bundle, shard, shrink_bits(known), shrink(ids[at[known]], ascending=True)))
        if len(values):
            keys = Permutation(bits).inverse((np.uint64(shard) << np.uint64(bits - split)) | values)
            found = b"".join(x.astype("<u8").tobytes() for x in (ids, keys, counts))
            out.append(("found", -1, shard, found, None))
        return _table(out)

    return run


def _advance(n: int, word_bits: int, bits: int, next_bits: int, split: int):
    """Numbers a bundle's n-grams by the replies; sends those of n + 1 words."""

    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _table([])
        bundle, words = state.column("bundle")[0].as_py(), expand(state.column("data")[0].as_py())
        before = state.column("more")[0].as_py()
        grams = expand(before) if before is not None else words
        starts, keys = _keys(words, grams, n, word_bits)
        distinct, place = np.unique(Permutation(bits)(keys), return_inverse=True)
        replies = replies.sort_by("shard")
        known = np.concatenate([np.zeros(0, bool), *(expand_bits(d) for d in replies.column("data").to_pylist())])
        ids = np.zeros(len(distinct), np.uint64)
        ids[known] = np.concatenate([np.zeros(0, np.uint64), *(expand(d, ascending=True) for d in replies.column("more").to_pylist())])
        own = np.zeros(len(words), np.uint64)
        own[starts] = ids[place]
        # Words beyond the frequent n-grams are not needed any more.
        edge = np.zeros(len(words) + 1, np.int32)
        at = np.flatnonzero(own)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        words = np.where(np.cumsum(edge[:-1]) > 0, words, np.uint64(0))
        _, keys = _keys(words, own, n + 1, word_bits)
        if not len(keys):
            return _table([])
        filter_ = QuotientFilter.of(Permutation(next_bits)(keys))
        return _table([("state", bundle, -1, shrink(words), shrink(own)), *_sent(bundle, filter_, next_bits, split)])

    return run


FOUND = "id bigint, prefix bigint, last bigint, a bigint"


def _unpacked(word_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, keys, counts = np.frombuffer(data, "<u8").reshape(3, -1)
                prefix, last = keys >> np.uint64(word_bits), keys & np.uint64((1 << word_bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, prefix, last, counts)], ["id", "prefix", "last", "a"])

    return run


def _split(entries: int, bits: int) -> int:
    """Bits of the shard number, for shards of ``SHARD`` entries at most on average."""
    return min(bits - 1, max(0, -(-entries // SHARD) - 1).bit_length())


def _written_and_read(df: DataFrame, name: str, schema: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy("kind").option("parquet.block.size", 32 << 20).option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, min_count: int, bundle: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and one frame for each length with the frequent phrases.

    Frames have id, lang, words, a (count), prefix and last (ids of the phrase without its last word and of that word), suffix (id of the
    phrase without its first word), ``pre`` and ``suf`` (counts of its beginnings, the shortest first, and of its ends, the longest first).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    path = scratch_path(spark, "codes")
    rows.mapInArrow(_bundle_batches(bundle), BUNDLES).write.option("parquet.block.size", 2 * bundle).option("compression", "none").parquet(path)
    bundles = spark.read.parquet(path)
    # Words are counted and numbered as n-grams are: sent to shards, which answer in the order of what was sent.
    word_split = _split(bundles.agg(F.sum("entries")).first()[0] or 0, 32)
    sent = bundles.select("bundle", "keys", "counts").mapInArrow(_words_sent(word_split), WORDS)
    merged = sent.groupBy("shard").applyInArrow(_words_merged(min_count, word_split), NUMBERS)
    merged = _written_and_read(merged, "words", NUMBERS)
    key = F.decode("w.keys", "UTF-8")
    sums = merged.where("kind = 'total'").select(F.explode(F.arrays_zip("keys", "counts")).alias("w"))
    totals = durable(sums.select(key.alias("lang"), F.col("w.counts").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    found = merged.where("kind = 'found'").select(F.explode(F.arrays_zip("keys", "counts", "numbers")).alias("w"))
    found = found.select(F.col("w.numbers").alias("id"), key.alias("key"), F.substring_index(key, "\n", -1).alias("word"), F.col("w.counts").alias("a"))
    lang = F.left("key", F.length("key") - F.length("word") - 1).alias("lang")
    none = F.array().cast("array<bigint>")
    first = found.select("id", lang, F.array("word").alias("words"), "a", F.lit(0).cast("bigint").alias("prefix"), F.col("id").alias("last"))
    levels = [durable(first.select("*", F.lit(0).cast("bigint").alias("suffix"), none.alias("pre"), none.alias("suf")))]
    size = levels[0].agg(F.max("id").alias("most"), F.sum("a").alias("entries")).first()
    if not size["most"]:
        return totals, levels
    word_bits = int(size["most"]).bit_length()
    bits, split = 2 * word_bits, _split(size["entries"], 2 * word_bits)
    replies = merged.where("kind = 'reply'").select(F.col("bundle").alias("of"), "shard", "ids").groupBy("of")
    state = bundles.select("bundle", "keys", "codes").groupBy("bundle").cogroup(replies)
    state = state.applyInArrow(_numbered(word_split, word_bits, split), STATE)
    for n in range(2, LONGEST + 1):
        state = _written_and_read(state, f"state_{n}", STATE)
        merged = state.where("kind = 'message'").groupBy("shard").applyInArrow(_merge(min_count, bits, split), STATE)
        merged = _written_and_read(merged, f"merged_{n}", STATE)
        found = durable(merged.where("kind = 'found'").select("data").mapInArrow(_unpacked(word_bits), FOUND))
        levels.append(_described(found, levels))
        size = found.agg(F.max("id").alias("most"), F.sum("a").alias("entries")).first()
        if n == LONGEST or not size["most"]:
            break
        next_bits = int(size["most"]).bit_length() + word_bits
        next_split = _split(size["entries"], next_bits)
        step = _advance(n, word_bits, bits, next_bits, next_split)
        replies = merged.where("kind = 'reply'").groupBy("bundle")
        state = state.where("kind = 'state'").groupBy("bundle").cogroup(replies).applyInArrow(step, STATE)
        bits, split = next_bits, next_split
    return totals, levels


def _described(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Phrases with their words and the counts of their parts, from those of one word less."""
    shorter = levels[-1]
    begin = shorter.select(
        F.col("id").alias("prefix"), "lang", "words", F.concat("pre", F.array("a")).alias("pre"), F.col("suffix").alias("middle")
    )
    last = levels[0].select(F.col("id").alias("last"), F.col("words").alias("end"))
    rows = found.join(begin, "prefix").join(last, "last")
    # The phrase without its first word is the prefix without its first word, and the last word.
    tail = shorter.select(
        F.col("prefix").alias("middle"), "last", F.col("id").alias("suffix"), F.concat(F.array("a"), "suf").alias("suf")
    )
    rows = rows.join(tail, ["middle", "last"])
    return durable(rows.select("id", "lang", F.concat("words", "end").alias("words"), "a", "prefix", "last", "suffix", "pre", "suf"))


def _score(size: int) -> Column:
    """The lowest cut as (score, k, l, r), in exact arithmetic."""
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n")}
    cuts = []
    for k in range(1, size):
        parts = F.col("pre")[k - 1].cast("decimal(18,0)"), F.col("suf")[k - 1].cast("decimal(18,0)")
        above = (F.lit(1000).cast("decimal(4,0)") * (wide["a"] * wide["n"])).cast("decimal(38,0)")
        under = (parts[0] * parts[1]).cast("decimal(38,0)")
        score = F.call_function("div", above, under).cast("bigint")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col("pre")[k - 1].alias("l"), F.col("suf")[k - 1].alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 100,
    top: int = 2000,
    bundle: int = BUNDLE,
) -> DataFrame:
    """The phrases of two to five words that occur together more often than their parts would by chance, by language.

    Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends and into words at spaces. Counts are exact: every n-gram whose
    beginning and end of n - 1 words are frequent is packed as the id of its beginning and that of its last word, permuted and held in a
    quotient filter of its bundle of documents; filters are cut by quotient, sent to shards and merged there, which tells each bundle which of
    its n-grams are frequent, and under which id. A part of a frequent phrase is frequent, so nothing is lost by going up by length.

    Returns the first ``top`` of each language by score, count (both descending) and phrase: lang, rank (from 1), phrase, a (its
    count), l and r (counts of the two parts at the cut with the lowest score, the first of equals), n (words of the
    language) and score, floor(1000 * a * n / (l * r)). Phrases that every time are part of the same longer one are left out. A null
    language is ``und``; null and empty texts have no words; repeated rows count each; other columns are not looked at; an empty
    table gives an empty result.
    """
    totals, levels = frequent_phrases(docs, text_col, lang_col, min_count, bundle)
    found = None
    for size in range(2, len(levels) + 1):
        own = levels[size - 1]
        if size < len(levels):
            longer = levels[size]
            inside = longer.where(F.col("a") == F.element_at("pre", -1)).select(F.col("prefix").alias("id"))
            inside = inside.unionByName(longer.where(F.col("a") == F.col("suf")[0]).select(F.col("suffix").alias("id")))
            own = own.join(inside, "id", "left_anti")
        # One row per language, small by nature; adaptive execution decides how to join.
        scored = own.join(totals, "lang").select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", _score(size).alias("cut"))
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        empty = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
        return docs.sparkSession.createDataFrame([], empty)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations_sql(min_count: int = 100, top: int = 2000) -> str:
    """The result of ``collocations`` over documents in DuckDB's SQL."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
    n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) AS t(k))),
    f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g
                       GROUP BY lang, k, phrase HAVING count(*) >= {min_count}),
    s AS (SELECT f.lang, f.phrase, f.a, c, l.a AS l, r.a AS r, n.n,
                 (1000::HUGEINT * f.a * n.n) // (l.a::HUGEINT * r.a::HUGEINT) AS score
          FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1) f JOIN n ON n.lang = f.lang
          JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.ws[1:c], ' ')
          JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.ws[c + 1:], ' ')),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    inside AS (SELECT DISTINCT lang, a, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:], ' ')]) AS phrase
               FROM f WHERE k > 2)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
           r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM best ANTI JOIN inside USING (lang, a, phrase)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}
    """
