"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .components import components
from .words import as_bytes, mix

BITS = 64
# Reference fingerprints beside the structured ones; eight distances fit one long.
RANDOM_REFERENCES = 16
# Members of a bucket that are compared in one unit of work; larger buckets are cut into such chunks.
CHUNK = 2048


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the shingles of a text, repeats included; zero for a text without words."""
    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    n = min(shingle, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        hashes = np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in as_bytes(batch.column(2))]
            signed = pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], ["id", "digest", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, digest, fp) of every row: its id, a 64-bit hash of its text, its fingerprint as a signed long."""
    # A null hashes like the start value and an empty text does not; both count as empty here.
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle), f"id {kind}, digest bigint, fp bigint")


# --- pivot distance tables ------------------------------------------------------------------------------


def references(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Structured and random reference fingerprints.

    Distances to random references all lie near 32, so a pair of unrelated fingerprints passes one such
    coordinate more often than not and no search can start from them. The structured ones are the zero
    word and the 64 words with one bit: a flipped bit moves a single coordinate, taken relative to the
    distance to zero, which is what lets fingerprints be looked up by coordinates that must agree.
    """
    units = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(BITS, dtype=np.uint64)))
    return units, np.random.default_rng(seed).integers(0, 2**64, RANDOM_REFERENCES, np.uint64)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :])


def bands_for(n: int, max_bits: int) -> int:
    """Into how many bands the structured coordinates are cut.

    A pair within ``max_bits`` agrees in all but that many bands, so any cut finds every pair. More bands
    mean longer keys and more of them; this takes the fewest for which a key has room for ``n``
    fingerprints four times over, so that unrelated fingerprints seldom meet.
    """
    bands = max_bits + 1
    while bands < BITS and BITS * (bands - max_bits) / bands < min(log2(max(n, 1)) + 2, 40) and comb(bands + 1, max_bits) <= 512:
        bands += 1
    return bands


def _key_batches(max_bits: int, bands: int):
    cuts = np.array_split(np.arange(BITS), bands)
    choices = list(combinations(range(bands), bands - max_bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, random = references()
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                signed = batch.column(0).to_numpy(zero_copy_only=False)
                fps = signed.view(np.uint64)
                table = distances(fps, units)
                sides = (table[:, 1:].astype(np.int16) - table[:, :1] < 0).astype(np.uint64)
                near = distances(fps, random).view(np.int64)
                for k, chosen in enumerate(choices):
                    columns = np.concatenate([cuts[c] for c in chosen])
                    key = np.zeros(len(fps), np.uint64)
                    for c in columns:
                        key = (key << np.uint64(1)) | sides[:, c]
                    key = mix(key + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(signed), pa.array(near[:, 0]), pa.array(near[:, 1])],
                        ["key", "fp", "near0", "near1"],
                    )

    return run


def _close(fps: np.ndarray, near: np.ndarray, i, j, max_bits: int) -> np.ndarray:
    """Whether pairs survive the largest coordinate difference, then the exact distance."""
    gap = np.abs(near[i].astype(np.int16) - near[j].astype(np.int16)).max(axis=-1)
    ok = gap <= max_bits
    ok[ok] = np.bitwise_count((fps[i] ^ fps[j])[ok]) <= max_bits
    return ok


def unit_links(unit: np.ndarray, fps: np.ndarray, near: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is close within each unit; rows of a unit stand together.

    Small units give every close pair. Large ones give a spanning forest, so their output stays
    linear in their members: a search from member to member takes each one out when it is reached.
    """
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(unit)])
    left, right = [], []
    small = np.repeat(sizes <= 32, sizes)
    for k in range(1, int(sizes[sizes <= 32].max(initial=1))):
        i = np.flatnonzero(small[:-k] & (unit[k:] == unit[:-k]))
        keep = _close(fps, near, i, i + k, max_bits)
        left.append(fps[i[keep]])
        right.append(fps[i[keep] + k])
    for start, size in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        own, coordinates = fps[start : start + size], near[start : start + size]
        free = np.arange(size)
        reached: list[int] = []
        while len(free):
            if not reached:
                reached, free = [int(free[0])], free[1:]
            at = reached.pop()
            keep = _close(own, coordinates, free, np.full(len(free), at), max_bits)
            found, free = free[keep], free[~keep]
            reached += found.tolist()
            left.append(np.full(len(found), own[at]))
            right.append(own[found])
    empty = np.zeros(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _link_batches(max_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows):
            key, lo, hi, fp, near0, near1 = rows
            changes = np.r_[False, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            near = np.ascontiguousarray(np.stack([near0, near1], axis=1)).view(np.uint8)
            a, b = unit_links(np.cumsum(changes), fp.view(np.uint64), near, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = int(np.flatnonzero(last)[0])  # rows are sorted: the last unit may go on in the next batch
            if cut:
                yield links([r[:cut] for r in rows])
            rest = [r[cut:] for r in rows]
        if rest is not None:
            yield links(rest)

    return run


def linked(distinct: DataFrame, max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``max_bits`` of one another.

    Every fingerprint gets its row of distances to the references. Rows are brought together by the
    structured coordinates, band by band (see ``bands_for``); within such a bucket a pair is discarded if
    any of the other coordinates differs by more than ``max_bits``, as the triangle inequality
    allows, and what survives is verified. Buckets with one member end after a count. A bucket beyond
    ``chunk`` members is cut into chunks and each pair of chunks is a unit of work of its own, so
    neither a task nor the output grows with the square of a group.
    """
    n = distinct.count()
    keys = distinct.select("fp").mapInArrow(
        _key_batches(max_bits, bands_for(n, max_bits)), "key bigint, fp bigint, near0 bigint, near1 bigint"
    )
    sizes = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    units = keys.join(sizes, "key").select(
        "key", "fp", "near0", "near1", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    )
    units = units.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "near0", "near1")
    units = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return units.mapInArrow(_link_batches(max_bits), "a bigint, b bigint")


def near_groups(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, root, component): the group of every distinct fingerprint of a frame with id and fp.

    ``root`` is the group's smallest fingerprint, ``component`` its smallest id (null if all are null).
    """
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    groups = components(linked(distinct, max_bits)).withColumnRenamed("node", "fp").join(distinct, "fp")
    ids = groups.groupBy("root").agg(F.min("least").alias("component"))
    groups = groups.join(ids, "root").select("fp", "root", "component")
    return distinct.join(groups, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"),
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints within ``max_bits`` bits are linked and groups are closed over links; a group is named
    by its smallest id. Null and empty texts and texts without words have fingerprint zero and
    are linked like any other. Rows with a null id are grouped by their text and never name a group unless all
    its ids are null. Repeated rows stay repeated. Other columns are not looked at, whatever their names. An empty table
    gives an empty result. Exact copies share a fingerprint and are aggregated before anything else.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    named = prints.join(near_groups(prints, max_bits), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return named.select(
        F.col("id").alias(id_col), digits.alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate group: that of the smallest id.

    If a group's smallest id occurs more than once, the row whose text has the smallest hash stays,
    and one of rows alike in both. Null ids come last. Columns and their order stay as they are.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    # What the row is called by: id and hash of its text, a null id last.
    name = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("digest"))
    kept = prints.join(near_groups(prints, max_bits), "fp").groupBy("root").agg(F.min(name).alias("name"))
    kept = durable(kept.select(F.col("name.id").alias("kept_id"), F.col("name.digest").alias("kept_digest")))
    digest = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(own.alias("own"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))
    left = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    # Rows alike in id and text: seldom there, and only then is the text shuffled to leave one of them.
    alike = prints.groupBy("id", "digest").count().where("count > 1").limit(1).count()
    if alike:
        left = left.dropDuplicates(["id", "digest"])
    return left.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])


__all__ = ["fingerprint", "fingerprints", "keep_one", "near_duplicates", "near_groups"]
