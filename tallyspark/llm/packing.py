"""Packing documents into sequences by bin completion."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .tokens import Encoder, default_path

# Rows of one length that are numbered in one task.
NUMBERED = 20_000

Plan = list[tuple[tuple[int, ...], int]]


# --- what goes together, by lengths alone -----------------------------------------------------------------


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """Bins that any packing needs: items over half a bin cannot meet, the others fill what is left.

    The strongest of the bounds of Martello and Toth, one for each length up to half a bin: items shorter
    than that are left out, and items that leave less room than that are alone.
    """
    number = [0] * (capacity + 2)
    for size, n in counts.items():
        number[size] += n
    items, room = [0], [0]  # before each length: items, and their total length
    for size in range(capacity + 1):
        items.append(items[-1] + number[size])
        room.append(room[-1] + number[size] * size)
    half = capacity // 2
    best = -(-room[-1] // capacity)
    for k in range(half + 1):
        wide = items[capacity - k + 1] - items[half + 1]
        free = wide * capacity - (room[capacity - k + 1] - room[half + 1])
        small = room[half + 1] - room[k]
        best = max(best, items[-1] - items[half + 1] + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: Mapping[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, for all items of a length and all bins alike at a time."""
    open_bins: dict[int, list[list]] = {}  # room left: [filling, bins]
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([filling, n])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[at]
            filling, n = open_bins[room][-1]
            used = min(n, left)
            left -= used
            if used == n:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                open_bins[room][-1][1] -= used
            put(room - size, (*filling, size), used)
    return [(filling, n) for bins in open_bins.values() for filling, n in bins]


def fillings(room: int, sizes: list[int], left: Mapping[int, int], keep: int = 4, effort: int = 300) -> list[tuple[int, ...]]:
    """Undominated ways to fill a room, least waste first, then fewest items.

    The enumeration is bounded: at each item the six largest lengths that fit are tried, each as often as it can be or once, in
    ``effort`` steps at most, and the best ``keep`` fillings are returned. ``sizes`` are the lengths at hand in order, ``left`` how many of each. A filling is dominated if a
    further item fits, or if one or two of its items can be exchanged for one that is as long and fits: whatever
    packs the rest after the greater filling has no less room than after the lesser.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    perfect = 0

    def search(space: int, below: int, chosen: tuple[int, ...]) -> None:
        nonlocal effort, perfect
        at = min(below, bisect_right(sizes, space)) - 1
        if at < 0:
            perfect += space == 0
            found.append((space, chosen))
            return
        for k in range(at, max(-1, at - 6), -1):
            size = sizes[k]
            most = min(left[size], space // size)
            for n in sorted({most, 1}, reverse=True):
                if effort > 0 and perfect < keep:
                    effort -= 1
                    search(space - n * size, k, chosen + (size,) * n)

    def dominated(waste: int, chosen: tuple[int, ...]) -> bool:
        pairs = {x + y: {x, y} for i, x in enumerate(chosen) for y in chosen[:i]} if len(chosen) < 8 else {}
        for size, given in [*((x, {x}) for x in set(chosen)), *pairs.items()]:
            at = bisect_right(sizes, size + waste) - 1
            while at >= 0 and (sizes[at] > size or sizes[at] == size and len(given) > 1):
                if chosen.count(sizes[at]) < left[sizes[at]]:
                    return True
                at -= 1
        return False

    search(room, len(sizes), ())
    found.sort(key=lambda x: (x[0], len(x[1]), [-s for s in x[1]]))
    good = [c for w, c in found if w == 0 or not dominated(w, c)]
    return list(dict.fromkeys(good or [c for _, c in found[:1]]))[:keep]


def bin_completion(counts: Mapping[int, int], capacity: int, nodes: int = 4_000) -> Plan:
    """Packing of items given as {length: number}, as (lengths in a bin, number of such bins).

    Branch and bound. The largest item left gets each of its undominated fillings in turn, and a filling is
    used as often as the counts allow. A branch ends when the waste so far means that it cannot need
    fewer bins than the best packing known, at first that of best-fit decreasing. The search ends when
    the lower bound is met or after ``nodes`` fillings; the best packing known is returned. So with the bounds of ``fillings`` the
    result is optimal where the lower bound is met, and otherwise the best that was found.
    """
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    left = Counter({size: n for size, n in counts.items() if n > 0})
    total, used = sum(size * n for size, n in left.items()), 0
    sizes = sorted(left)
    frames: list[list] = []  # [fillings, next, bin in use, times]

    def take(items: Counter, times: int) -> None:
        for size, n in items.items():
            left[size] -= n * times
            if not left[size]:
                sizes.remove(size)

    def give_back(items: Counter, times: int) -> None:
        for size, n in items.items():
            if not left[size]:
                insort(sizes, size)
            left[size] += n * times

    down = True
    while fewest > bound and nodes > 0:
        if down:
            if not sizes:
                if used < fewest:
                    fewest, best = used, [(bin_, times) for _, _, bin_, times in frames]
                down = False
                continue
            largest = sizes[-1]
            take(own := Counter({largest: 1}), 1)
            options = fillings(capacity - largest, sizes, left)
            give_back(own, 1)
            frames.append([[(largest, *o) for o in options], 0, None, 0])
        if not frames:
            break
        frame = frames[-1]
        if frame[2]:
            give_back(Counter(frame[2]), frame[3])
            used, total = used - frame[3], total + sum(frame[2]) * frame[3]
            frame[2] = None
        if frame[1] == len(frame[0]):
            frames.pop()
            down = False
            continue
        frame[2] = frame[0][frame[1]]
        frame[1] += 1
        items = Counter(frame[2])
        frame[3] = min(left[size] // n for size, n in items.items())
        take(items, frame[3])
        used, total = used + frame[3], total - sum(frame[2]) * frame[3]
        nodes -= 1
        down = used + -(-total // capacity) < fewest
    return best


# --- pieces, their places, and the whole --------------------------------------------------------------------


def _piece_batches(path: str, capacity: int, end: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = None, end.to_bytes(4, "little")
        for batch in batches:
            encoder = encoder or Encoder(path)
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text) + last
                n = len(ids) // 4
                start, number = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((i, number, start, length, zlib.crc32(own), own))
                    start, number = start + length, number + 1
                if len(rows) >= 20_000 or i == batch.num_rows - 1:
                    columns = list(zip(*rows, strict=True))
                    whole = [batch.column(0).take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:5])]
                    yield pa.RecordBatch.from_arrays(whole + [pa.array(columns[5], pa.binary())] * with_ids, names)
                    rows = []

    return run


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
    end: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as ids and an end id, cut only if longer than ``capacity``; then the first piece may be shorter."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(_piece_batches(tokenizer or default_path(), capacity, end, with_ids), schema)


def _slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, per sequence, first sequence, offset) of what the plan places."""
    ranks: Counter = Counter()
    out, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            out.append((size, ranks[size], ranks[size] + n * times - 1, n, sequence, offset))
            ranks[size] += n * times
            offset += n * size
        sequence += times
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
    end: int = 0,
    with_ids: bool = False,
    nodes: int = 4_000,
) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and its ``offset`` there.

    Only lengths decide what goes together, and there are at most ``capacity`` of them: the driver gets the
    number of pieces of each length, however many documents there are, and plans which lengths share a
    sequence (``bin_completion``). The plan, a few thousand rows at most, is joined back to the
    pieces by length and rank. Ranks within a length are counted in hashed parts, so a length that
    very many documents have does not meet in one task.

    Null and empty texts are the end id alone. Rows with null or repeated ids are packed each for
    itself; other columns are not looked at; an empty table gives an empty result. With ``with_ids`` the
    ids of each piece follow as little-endian 32-bit words.
    """
    cut = durable(pieces(docs, id_col, text_col, capacity, tokenizer, end, with_ids))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = bin_completion(counts, capacity, nodes) if counts else []
    slots = cut.sparkSession.createDataFrame(
        _slots(plan), "length bigint, low bigint, high bigint, each bigint, sequence bigint, place bigint"
    )
    parts = 1 + max(counts.values(), default=0) // NUMBERED
    key = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts))
    cut = cut.withColumn("part", key)
    sizes = cut.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    sizes = sizes.select("length", "part", before.alias("before"))
    order = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order)).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.join(
        F.broadcast(slots), (ranked["length"] == slots["length"]) & F.col("rank").between(F.col("low"), F.col("high"))
    )
    ahead = F.col("rank") - F.col("low")
    return placed.select(
        F.col("id").alias(id_col),
        F.col("piece").cast("int").alias("piece"),
        "start",
        ranked["length"].alias("length"),
        "ids_crc32",
        (F.col("sequence") + F.floor(ahead / F.col("each"))).alias("sequence_id"),
        (F.col("place") + F.pmod(ahead, F.col("each")) * ranked["length"]).alias("offset"),
        *(["ids"] if with_ids else []),
    )
