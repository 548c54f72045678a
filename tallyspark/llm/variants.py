"""Spelling variants: the vocabulary as a minimal acceptor, composed with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

# Runs of letters, and what is lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of one part that are composed in one task at most; a part with more is cut into chunks, and pairs of chunks are composed.
CHUNK = 4096


# --- automata -----------------------------------------------------------------------------------------------------


class Acceptor:
    """The minimal deterministic acceptor of a set of strings: states by number, arcs by code point, 0 the dead end."""

    def __init__(self, strings: list[str]) -> None:
        """``strings`` distinct and in code-point order (Daciuk et al., 2000)."""
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}

        def frozen(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return state

        # The path of the last string, not yet frozen: arcs, final, and the code point that leads on.
        path: list[list] = [[{}, False, ""]]
        last = ""
        for s in strings:
            common = 0
            for a, b in zip(last, s):
                if a != b:
                    break
                common += 1
            while len(path) > common + 1:
                arcs, final, _ = path.pop()
                path[-1][0][path[-1][2]] = frozen(arcs, final)
            for c in s[common:]:
                path[-1][2] = c
                path.append([{}, False, ""])
            path[-1][1] = True
            last = s
        while len(path) > 1:
            arcs, final, _ = path.pop()
            path[-1][0][path[-1][2]] = frozen(arcs, final)
        self.start = frozen(*path[0][:2])


def _written(node: tuple | None) -> str:
    """The string of a linked list of code points, last one first."""
    out = []
    while node is not None:
        node, c = node
        out.append(c)
    return "".join(reversed(out))


def _shared(a: Acceptor, p: int, b: Acceptor, q: int) -> list[str]:
    """All strings that lead from both states to an end."""
    out, open_ = [], [(p, q, None)]
    while open_:
        p, q, node = open_.pop()
        if a.final[p] and b.final[q]:
            out.append(_written(node))
        arcs, others = a.arcs[p], b.arcs[q]
        if len(others) < len(arcs):
            for c, t in others.items():
                if c in arcs:
                    open_.append((arcs[c], t, (node, c)))
        else:
            for c, t in arcs.items():
                if c in others:
                    open_.append((t, others[c], (node, c)))
    return out


def compose(a: Acceptor, b: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of a string of ``a`` and one of ``b`` that differ by one replaced, inserted or deleted code point.

    States of the composition are pairs of states and whether the edit is made. Before it both read the same string,
    after it too, so what can follow an edit depends on the pair of states alone and is found once. A pair comes up
    once for each place that an insertion can be at (as in a run of one code point).
    """
    known: dict[tuple[int, int], list[str]] = {}

    def after(p: int, q: int) -> list[str]:
        found = known.get((p, q))
        if found is None:
            found = known[p, q] = _shared(a, p, b, q)
        return found

    edits: dict[tuple[int, int], list[tuple[str, str, str]]] = {}
    open_ = [(a.start, b.start, None)]
    while open_:
        p, q, node = open_.pop()
        here = edits.get((p, q))
        if here is None:
            here = edits[p, q] = [
                *((c, d, s) for c, t in a.arcs[p].items() for d, u in b.arcs[q].items() if c != d for s in after(t, u)),
                *((c, "", s) for c, t in a.arcs[p].items() for s in after(t, q)),
                *(("", d, s) for d, u in b.arcs[q].items() for s in after(p, u)),
            ]
        if here:
            before = _written(node)
            for c, d, s in here:
                yield before + c + s, before + d + s
        others = b.arcs[q]
        for c, t in a.arcs[p].items():
            if c in others:
                open_.append((t, others[c], (node, c)))


# --- words of a corpus --------------------------------------------------------------------------------------------


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    spoil: int | None = 199,
    min_length: int = 6,
    min_count: int = 5,
) -> DataFrame:
    """(word, n) of the runs of letters of all texts, with only A to Z lower-cased.

    ``spoil`` plants slips: a run loses the code point h % length, counted from 0, where ``spoil`` divides h, the crc32 of
    "<id>:<run>". Counts are summed within tasks before the shuffle.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    if spoil:
        h = F.crc32(F.concat("name", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % spoil == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _parts(word: Column) -> Column:
    """The parts of the composition that a word belongs to, as (end, label), where label is its first or last code points.

    Of two words one edit apart, say the shorter has L code points, the first L // 2 or the last L - L // 2 are the same. A
    word of L code points looks for partners of L - 1, L and L + 1, so its ends of all lengths these can ask for are labels.
    """
    n = F.length(word)

    def end(first: bool) -> Column:
        sizes = [F.floor((n + k) / 2) if first else F.ceil((n + k) / 2) for k in (-1, 0, 1)]
        distinct = F.array_distinct(F.array(*[s.cast("int") for s in sizes]))
        cut = (lambda s: F.left(word, s)) if first else (lambda s: F.right(word, s))
        return F.transform(distinct, lambda s: F.struct(F.lit(first).alias("first"), cut(s).alias("label")))

    return F.concat(end(True), end(False))


def _compose_chunks() -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """All parts of one task, or one pair of chunks of a large part."""
        rows = rows.sort_by([("first", "ascending"), ("label", "ascending"), ("side", "ascending"), ("word", "ascending")])
        columns = [rows.column(c).to_pylist() for c in ("first", "label", "side", "word")]
        found: set[tuple[str, str]] = set()
        at, n = 0, rows.num_rows
        while at < n:
            first, label = columns[0][at], columns[1][at]
            sides: dict[int, list[str]] = {}
            while at < n and columns[1][at] == label and columns[0][at] == first:
                word = columns[3][at]
                # The acceptor of a part starts where its label has been read.
                sides.setdefault(columns[2][at], []).append(word[len(label) :] if first else word[: len(word) - len(label)])
                at += 1
            if sum(map(len, sides.values())) < 2:
                continue
            machines = [Acceptor(sorted(words)) for _, words in sorted(sides.items())]
            for x, y in compose(machines[0], machines[-1]):
                x, y = (label + x, label + y) if first else (x + label, y + label)
                if x != y:
                    found.add((min(x, y), max(x, y)))
        pairs = sorted(found)
        return pa.Table.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["a", "b"])

    return run


def near_pairs(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a before b, of all distinct words of the column ``word`` that differ by one replaced, inserted or deleted code point.

    The composition of the vocabulary's acceptor with a one-edit transducer and the acceptor again is enumerated part by
    part: a part is the state that the first half of a word leads to, or, for words read backwards, the last half. Parts are
    hashed to tasks of about ``chunk`` rows. A part with more words is cut into chunks by hash, every two of which are
    composed in a task of their own, so no task holds more than two chunks of a part, whatever the part's size.
    """
    rows = words.select("word", F.explode(_parts(F.col("word"))).alias("part")).select("word", "part.*")
    sizes = rows.groupBy("first", "label").agg(F.count("*").alias("size")).where("size > 1")
    sizes = durable(sizes)
    total = sizes.agg(F.sum("size").alias("rows"), F.max("size").alias("most")).first()
    tasks = max(1, -(-(total["rows"] or 0) // chunk))
    rows = rows.join(sizes, ["first", "label"])
    small = rows.where(F.col("size") <= chunk).select(
        F.pmod(F.xxhash64("first", "label"), F.lit(tasks)).alias("task"), F.lit(0).alias("i"), F.lit(0).alias("j"), "first", "label", F.lit(0).alias("side"), "word"
    )
    parts = small
    if (total["most"] or 0) > chunk:
        large = rows.where(F.col("size") > chunk).withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
        own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
        pair = F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (o < own).cast("int").alias("side")),
        )
        large = large.select(F.xxhash64("first", "label").alias("task"), F.explode(pair).alias("pair"), "first", "label", "word")
        parts = parts.unionByName(large.select("task", "pair.i", "pair.j", "first", "label", "pair.side", "word"))
    # Pairs that agree at both ends, or have several places for the edit, come up more than once.
    return parts.groupBy("task", "i", "j").applyInArrow(_compose_chunks(), "a string, b string").distinct()


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    spoil: int | None = 199,
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    chunk: int = CHUNK,
) -> DataFrame:
    """Words of a corpus with their more frequent near spellings.

    Words are those of ``vocabulary``. Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
    ``form`` is its near word of largest count, ties to the smallest in code-point order, if that count is at least ``ratio``
    times its own; ``root`` follows forms to the last, the word itself if there is none.

    Returns word, form, root, ``n`` (occurrences), ``n_near`` (near words) and ``form_n``, one row per word. Null
    and empty texts have no words; a null id counts as an empty one in the planted slips; repeated rows count each for themselves;
    other columns are not looked at; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more, or forms would go round in circles")
    words = durable(vocabulary(docs, id_col, text_col, spoil, min_length, min_count))
    pair = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))])
    both = near_pairs(words, chunk).select(F.inline(pair))
    partner = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    # The largest count, and of those with it the first word: the least of (minus count, word).
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word"))).alias("best")
    near = both.join(partner, "b").groupBy("a").agg(F.count("*").alias("n_near"), best)
    known = words.join(near, F.col("word") == F.col("a"), "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    known = durable(known)
    # Every round doubles how far a root is followed. Counts grow by the ratio with each form, which bounds the rounds.
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    span = words.agg((F.max("n") / F.min("n")).alias("span")).first()["span"] or 1.0
    steps = int(log(span) / log(ratio) + 1e-9)
    for _ in range(max(0, steps - 1).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(spoil: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> str:
    """The result of ``spelling_variants`` over documents in DuckDB's SQL, crc32 by its usual table."""
    return f"""
    WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
    pairs AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS hexed FROM runs GROUP BY ALL),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hexed), 2),
        lambda i: ('0x' || substr(hexed, i, 2))::BIGINT)), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
        FROM pairs, t),
    spoilt AS (SELECT CASE WHEN h % {spoil} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n
               FROM hashed),
    v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
    cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short
             FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM v)),
    near AS (SELECT DISTINCT * FROM (
        SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
        UNION ALL SELECT c.word, c.n, v.word, v.n FROM cuts c JOIN v ON v.word = c.short
        UNION ALL SELECT v.word, v.n, c.word, c.n FROM cuts c JOIN v ON v.word = c.short)),
    best AS (SELECT a, count(*) AS n_near, any_value(a_n) AS a_n, arg_min({{'w': b, 'n': b_n}}, (-b_n, b)) AS best FROM near GROUP BY a),
    known AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {ratio} * n THEN best.w END AS form,
                                  CASE WHEN best.n >= {ratio} * n THEN best.n END AS form_n FROM v LEFT JOIN best ON a = word),
    up AS (SELECT word, word AS root, 0 AS step FROM known
           UNION ALL SELECT up.word, known.form, step + 1 FROM up JOIN known ON known.word = up.root WHERE known.form IS NOT NULL)
    SELECT k.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
    FROM known k JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word) r ON r.word = k.word
    """
