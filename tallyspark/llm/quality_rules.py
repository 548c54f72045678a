"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

SPACES = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Counts that only rules use.
FURTHER = ("n_lines", "n_ended_lines", "n_capitals", "n_distinct_words", "n_letters", "n_exclaims")

# Rule: (bad if it holds, good if it holds); otherwise the rule abstains. In SQL for both engines.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 10", "n_words >= 100"),
    "chars": ("word_chars < 50", "word_chars >= 400"),
    "repeats": ("5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words AND n_words > 0"),
    "lines": ("3 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines > 0"),
    "variety": ("5 * n_distinct_words < 2 * n_words", "5 * n_distinct_words >= 3 * n_words AND n_words > 0"),
    "symbols": ("25 * n_symbols > n_words", "n_symbols = 0 AND n_words > 0"),
    "letters": ("10 * n_letters < 9 * word_chars", "100 * n_letters >= 95 * word_chars AND n_words > 0"),
    "capitals": ("5 * n_capitals > word_chars", "15 * n_capitals <= word_chars AND n_words > 0"),
    "exclaims": ("10 * n_exclaims > n_words", "50 * n_exclaims <= n_words AND n_words > 0"),
    "endings": ("2 * n_ended_lines < n_lines", "4 * n_ended_lines >= 3 * n_lines AND n_lines > 0"),
    "short_lines": ("n_words < 4 * n_lines", "n_words >= 8 * n_lines AND n_lines > 0"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
ROUNDS = 20
# A document is good or has one chief fault, which several rules look for, each by other evidence: whether a rule's bad votes are
# errors on good documents or a fault of the documents shows in whether the others agree.
FAULTS: dict[str, tuple[str, ...]] = {
    "brevity": ("length", "chars"),
    "repetition": ("repeats", "lines", "variety"),
    "markup": ("symbols", "letters"),
    "shouting": ("capitals", "exclaims"),
    "fragments": ("endings", "short_lines"),
}
KINDS_OF_TEXT = ("good", *FAULTS)
START_PRIOR = {k: 0.8 if k == "good" else 0.2 / len(FAULTS) for k in KINDS_OF_TEXT}
# The start of every rate is the mean of its Beta prior, which counts as much as so many votes.
WEIGHT = 20


def _start(kind: str, rule: str) -> tuple[float, float, float]:
    """Chance that the rule's vote on a document of the kind is bad: start, least, most.

    The bounds only say what the kinds mean: a rule errs on fewer than half of the good documents, and sees more
    than half of those with its own fault. Between them the estimate is free.
    """
    return (0.05, 0.0001, 0.45) if kind == "good" else (0.9, 0.55, 0.999) if rule in FAULTS[kind] else (0.2, 0.001, 0.999)


def _beside(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements of an array in order that are the same as the one before or after them."""

    def met(x: Column, y: Column) -> Column:
        return F.coalesce(same(x, y), F.lit(False))

    return F.filter(ordered, lambda x, k: met(x, F.get(ordered, k - 1)) | met(x, F.get(ordered, k + 1)))


def text_counts(docs: DataFrame, text_col: str, keep: Mapping[str, Column]) -> DataFrame:
    """``keep`` and the counts of every text, without a shuffle; null texts count as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], text.alias("text"))
    kept = list(keep)
    trimmed = F.btrim("text", F.lit(SPACES))
    no_words = F.array().cast("array<string>")
    rows = rows.select(
        *kept,
        F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(no_words).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("bigint").alias("n_letters"),
        F.regexp_count("text", F.lit("!")).cast("bigint").alias("n_exclaims"),
    )
    n = F.size("words")
    words = F.col("words")

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    # 32 bits of a window's hash and its place, which an array's size keeps below 31 bits.
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(places, lambda i: F.shiftleft(window(i).bitwiseAND(F.lit(2**32 - 1)), 31).bitwiseOR(i.cast("bigint")))
    rows = rows.select(
        *kept,
        "words",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        "n_letters",
        "n_exclaims",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*\z"))).cast("bigint").alias("n_ended_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct_words"),
        F.sort_array(packed).alias("packed"),
    )
    counts = [c for c in (*COUNTS, *FURTHER) if c != "n_repeat_words"]
    # Windows that stand next to one of the same hash may occur again; those alone are sorted by their words.
    rows = rows.select(*kept, *counts, "words", _beside(F.col("packed"), lambda x, y: F.shiftright(x, 31) == F.shiftright(y, 31)).alias("packed"))
    place = F.transform("packed", lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    rows = rows.select(*kept, *counts, "words", place.alias("places"))
    named = F.transform(
        "places", lambda i: F.struct(*[F.get(words, i + k).alias(f"w{k}") for k in range(3)], i.alias("place"))
    )
    rows = rows.select(*kept, *counts, F.sort_array(named).alias("windows"))
    again = _beside(F.col("windows"), lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["place"], x["place"] + 1, x["place"] + 2)))
    repeats = F.size(F.array_distinct(covered)).cast("bigint").alias("n_repeat_words")
    return rows.select(*kept, *(repeats if c == "n_repeat_words" else F.col(c) for c in (*COUNTS, *FURTHER)))


def _vote(rule: str) -> Column:
    bad, good = RULES[rule]
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))


Faults = Mapping[str, Mapping[str, float]]


def _posterior(faults: Faults, priors: Mapping[str, float]) -> Column:
    """Probability that a document is good, from its votes."""
    weights = []
    for kind in KINDS_OF_TEXT:
        total = F.lit(log(priors[kind]))
        for rule in RULES:
            f, vote = faults[kind][rule], F.col(f"v_{rule}")
            total = total + F.when(vote == -1, log(f)).when(vote == 1, log(1 - f)).otherwise(0.0)
        weights.append(F.exp(total))
    return weights[0] / reduce(lambda x, y: x + y, weights)


def estimate(
    patterns: Mapping[tuple[int, ...], int], rounds: int = ROUNDS
) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """How often each rule finds fault with each kind of document, and the share of each kind, from counted votes.

    A round gives each pattern of votes its posterior over the kinds, then counts by it. What a rule gets right about good
    documents is one minus its share of faults there, about its own fault the share itself.
    """
    votes = np.array(list(patterns), np.int8).reshape(-1, len(RULES))
    n = np.array(list(patterns.values()), float)
    start, least, most = (np.array([[_start(k, r)[i] for r in RULES] for k in KINDS_OF_TEXT]) for i in range(3))
    first = np.array([START_PRIOR[k] for k in KINDS_OF_TEXT])
    bad, cast = (votes < 0).astype(float), (votes != 0).astype(float)
    faults, priors = start, first
    for _ in range(rounds):
        logs = np.log(priors) + bad @ np.log(faults).T + (cast - bad) @ np.log(1 - faults).T
        held = np.exp(logs - logs.max(1, keepdims=True, initial=-np.inf))
        held *= (n / held.sum(1))[:, None]
        priors = (held.sum(0) + WEIGHT * first) / (n.sum() + WEIGHT)
        faults = np.clip((held.T @ bad + WEIGHT * start) / (held.T @ cast + WEIGHT), least, most)
    return (
        {k: dict(zip(RULES, row, strict=True)) for k, row in zip(KINDS_OF_TEXT, faults.tolist(), strict=True)},
        dict(zip(KINDS_OF_TEXT, priors.tolist(), strict=True)),
    )


def judged(docs: DataFrame, text_col: str, keep: Mapping[str, Column]) -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``quality`` (posterior probability) and ``kept`` of every row."""
    counted = text_counts(docs, text_col, keep)
    votes = [_vote(r).alias(f"v_{r}") for r in RULES]
    voted = durable(counted.select(*keep, *COUNTS, F.expr(BASE_FAILED).alias("base_failed"), *votes))
    names = [f"v_{r}" for r in RULES]
    # At most three to the power of rules rows, whatever the corpus.
    patterns = {tuple(r)[:-1]: r["n"] for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    quality = _posterior(*estimate(patterns))
    judged_ = voted.withColumn("quality", quality)
    return judged_.select(
        *keep, *COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept")
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every document.

    Rules on length, repetition, symbols, letters, capitals and lines vote good or bad or abstain, two or more for each fault.
    Expectation-maximisation estimates from their agreement over all documents, without labels, how
    often each is right about good documents and about each kind of fault; a document is kept if it does not fail the base rule
    and its posterior probability of being good is at least one half, whatever a single rule says. Votes are counted by pattern before anything else, so the shuffle is as small as the patterns.

    Null and empty texts have no words and fail the base rule. Rows with null or repeated ids are judged
    each for itself; other columns are not looked at; an empty table gives an empty result.
    """
    return judged(docs, text_col, {"id": F.col(f"`{id_col}`")}).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept; columns and their order stay as they are."""
    digest = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    verdicts = judged(docs, text_col, {"id": F.col(f"`{id_col}`"), "digest": digest})
    good = verdicts.where("kept").select(F.col("id").alias("good_id"), F.col("digest").alias("good_digest")).distinct()
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(own.alias("own"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))
    left = rows.join(good, F.col("id").eqNullSafe(F.col("good_id")) & (F.col("digest") == F.col("good_digest")), "left_semi")
    return left.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_sql() -> str:
    """The result of ``quality_verdicts`` over documents in DuckDB's SQL, rounds of the estimate unrolled."""
    votes = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v_{r}" for r, (b, g) in RULES.items())
    names = ", ".join(f"v_{r}" for r in RULES)
    weights = {
        k: f"exp(ln(p_{k})" + "".join(
            f" + CASE v_{r} WHEN -1 THEN ln(f_{k}_{r}) WHEN 1 THEN ln(1 - f_{k}_{r}) ELSE 0 END" for r in RULES
        ) + ")"
        for k in KINDS_OF_TEXT
    }
    all_weights = ", ".join(f"{w} AS w_{k}" for k, w in weights.items())
    total = " + ".join(f"w_{k}" for k in KINDS_OF_TEXT)
    first = ", ".join(f"{p!r}::DOUBLE AS p_{k}" for k, p in START_PRIOR.items())
    first += "".join(f", {_start(k, r)[0]}::DOUBLE AS f_{k}_{r}" for k in KINDS_OF_TEXT for r in RULES)

    def fault(k: str, r: str) -> str:
        start, least, most = _start(k, r)
        bad = f"coalesce(sum(CASE WHEN v_{r} < 0 THEN n * w_{k} / w END), 0) + {start * WEIGHT!r}"
        votes = f"coalesce(sum(CASE WHEN v_{r} <> 0 THEN n * w_{k} / w END), 0) + {WEIGHT}"
        return f"least(greatest(({bad}) / ({votes}), {least}), {most})::DOUBLE AS f_{k}_{r}"

    counted = ", ".join(
        f"((coalesce(sum(n * w_{k} / w), 0) + {p * WEIGHT!r}) / (coalesce(sum(n), 0) + {WEIGHT}))::DOUBLE AS p_{k}"
        for k, p in START_PRIOR.items()
    )
    counted += "".join(f", {fault(k, r)}" for k in KINDS_OF_TEXT for r in RULES)
    rounds = ",".join(
        f"""
    e{k + 1} AS MATERIALIZED (SELECT {counted}
        FROM (SELECT *, {total} AS w FROM (SELECT patterns.*, {all_weights} FROM patterns, e{k})))"""
        for k in range(ROUNDS)
    )
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
                FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
    repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) AS t(k) GROUP BY r),
    counts AS (SELECT w.r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
               len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '\\p{{L}}')) AS n_letters,
               len(text) - len(replace(text, '!', '')) AS n_exclaims, len(lines) AS n_lines,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][\\x20\\x09-\\x0D]*\\z'))) AS n_ended_lines,
               len(list_distinct(words)) AS n_distinct_words, coalesce(n_repeat_words, 0) AS n_repeat_words
               FROM w LEFT JOIN repeats USING (r)),
    voted AS MATERIALIZED (SELECT *, {BASE_FAILED} AS base_failed, {votes} FROM counts),
    patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM voted GROUP BY ALL),
    e0 AS (SELECT {first}),{rounds}
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND w_good / ({total}) >= 0.5 AS kept
    FROM (SELECT voted.*, {all_weights} FROM voted, e{ROUNDS})
    """
