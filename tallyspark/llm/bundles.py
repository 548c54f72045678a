"""Documents bundled into rows of a few megabytes, and exchanges of what bundles ask of the whole corpus.

Statistics of a corpus that each document needs back (how often a word occurs anywhere, whether a passage
occurs elsewhere) are an exchange in both directions: every bundle sends its distinct keys to shards by key range, a
shard adds up what all bundles sent, and answers each bundle in the order of its keys. Keys
travel sorted and compressed, answers need no keys at all, and a key that every document holds reaches its shard once per
bundle. A bundle never changes once it is written, so a lost executor only repeats work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .words import WordHasher, as_bytes, slices

# Bytes of text in a bundle; one longer text is a bundle of its own.
BUNDLE = 8 << 20


# --- compact arrays -----------------------------------------------------------------------------------------


def shrink(values: np.ndarray, ascending: bool = False) -> bytes:
    """An unsigned array as compressed bytes, byte planes apart; differences if it only ascends."""
    if ascending and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, ascending: bool = False) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(f"<u{size}")
    return np.cumsum(values, dtype=values.dtype) if ascending else values


def shrink_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def expand_bits(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8), count=n).view(bool)


# --- bundles ------------------------------------------------------------------------------------------------


def pack_texts(texts: list[bytes]) -> bytes:
    lengths = np.array([len(t) for t in texts], "<u8")
    return zstandard.ZstdCompressor(level=6).compress(b"".join([len(texts).to_bytes(8, "little"), lengths.tobytes(), *texts]))


def unpack_texts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u8", n, 8).astype(np.int64)) + 8 + 8 * n
    starts = np.r_[8 + 8 * n, ends[:-1]] if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _bundle_batches(size: int, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = WordHasher(0), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def bundle():
            words = sum(
                len(hasher.spans(b"\n".join(texts[a:b]))[1]) for a, b in slices(texts)
            )
            columns = [pa.array([number]), pa.array([ids], pa.list_(kind)), pa.array([pack_texts(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([words])], ["bundle", "ids", "texts", "words"])

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if texts and held + len(text) > size:
                    yield bundle()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(own)
                texts.append(text)
                held += len(text)
        if texts:
            yield bundle()

    return run


def bundled(docs: DataFrame, id_col: str, text_col: str, size: int = BUNDLE) -> DataFrame:
    """(bundle, ids, texts, words) of all rows, written to the shared folder and read back.

    Consecutive rows of a partition share a bundle; nothing is shuffled. Null texts count as empty.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} has to be a whole number, not {kind.simpleString()}")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`"))
    path = scratch_path(spark, "bundles")
    made = rows.mapInArrow(_bundle_batches(size, pa.int64()), "bundle bigint, ids array<bigint>, texts binary, words bigint")
    made.write.option("parquet.block.size", 2 * size).option("compression", "none").parquet(path)
    return spark.read.parquet(path)


# --- exchanges ----------------------------------------------------------------------------------------------


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut into shards of equal key ranges."""
    step = 2**64 // shards
    edges = np.array([k * step for k in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def answers(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What shards answer: ``asked`` has table, shard and bundle, ``answer`` sees all rows of one shard."""
    return asked.groupBy("table", "shard").applyInArrow(answer, schema)


def with_answers(bundles: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
    """``run(bundle, replies)`` for every bundle and the replies to it, as Arrow tables."""
    return bundles.groupBy("bundle").cogroup(replies.groupBy("bundle")).applyInArrow(run, schema)
