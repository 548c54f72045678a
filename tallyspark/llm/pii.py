"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Everything that touches rows is built of DataFrame functions. Spans travel inside the row of their document as arrays, so
texts are not shuffled; lengths and places are counted in code points. Only counted feature rows, at most ``FITTED``, and the
scores of held-out ones reach the driver, which fits the trees to them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import inf

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive quantifiers where giving back could not lead to a match, so long runs neither
# recurse nor are scanned twice. A match does not begin inside a run that has already failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern of the kind to be worth a search.
HINT = {"email": r"[@]|[(\[\x20][Aa][Tt][)\]\x20]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
# Generators of high recall: formats that people also write, and much that is no personal data (two words around "at",
# any run of digit groups). A plain dot between labels has a space on both sides or on none; with one after it only, a sentence ends.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\([Aa][Tt]\)|\[[Aa][Tt]\]|(?<=\x20)[Aa][Tt](?=\x20))\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20\.\x20|\x20?(?:\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\])\x20?|\x20[Dd][Oo][Tt]\x20)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:(?:\[\.\]|\([Dd][Oo][Tt]\)|[\x20.,:-]{0,3}+)[0-9]{1,4}+){2,4}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,20}+",
    "phone": r"\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,15}+",
}
# Format: the check of the kind, how many digits and groups of them, how varied, how many labels. Context: what stands around a span. No feature is a sign
# that only one notation uses (at-sign, plus, dots).
FORMAT = ("checked", "n_digits", "n_groups", "longest", "n_distinct", "n_labels")
CONTEXT = ("letter_before", "letter_after", "digit_before", "digit_after", "named", "secret", "in_quotes")
FEATURES = ("kind", *FORMAT, *CONTEXT)
MOST = 31  # larger values of a feature count as this
# Words before a span that name its kind, or that announce a secret or an identifier.
NAMED = {
    "email": "(?i)(?:mail|contact|write to)[^a-z0-9]*$",
    "ip": r"(?i)(?:\bip|addr|address|host|server)[^a-z0-9]*$",
    "card": r"(?i)(?:card|karte|tarjeta|carte|visa|\bpay)[^a-z0-9]*$",
    "phone": r"(?i)(?:phone|\btel|fon|\bcall|mobil|mobile|fax)[^a-z0-9]*$",
}
SECRET = r"(?i)\b(?:token|password|passwort|secret|key|hash|sha|md5|version|id|no)[\x20:=\"'#]*$"
# An address has a dot in its domain, in whichever notation; with "at" as a word, dots are words too.
DOMAIN = (
    r"(?:@|\([Aa][Tt]\)|\[[Aa][Tt]\])\x20?[A-Za-z0-9-]+(?:\.|\x20\.\x20|\x20?[(\[][Dd][Oo][Tt][)\]]|\x20[Dd][Oo][Tt]\x20)"
    r"|\x20[Aa][Tt]\x20[A-Za-z0-9-]+(?:\x20[Dd][Oo][Tt]\x20|\x20?[(\[][Dd][Oo][Tt][)\]])"
)
# Bound on the distinct feature rows that the trees are fitted to; counts of all candidates are their weights.
FITTED = 20_000
# Of the held-out candidates from a kind's threshold on, so many are to be personal data; a threshold is above one half.
TARGETS = {"email": 0.95, "ip": 0.95, "card": 0.95, "phone": 0.95}
# Candidates that count as wrong besides those held out, so that few examples do not pass for certainty.
DOUBT = 0.5


# --- spans ----------------------------------------------------------------------------------------------------


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _before(lengths: Column, block: int = 64) -> Column:
    """For each element the sum of those before it.

    Sums within a block and sums of blocks are arguments of ``zip_with``, each computed once; named inside a lambda, they
    would be computed for every element of a long array.
    """
    blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int"))
    own = F.transform(blocks, lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    sums = F.aggregate(
        own,
        start,
        lambda s, x: F.struct((s["sum"] + _sum(x)).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all")),
        lambda s: s["all"],
    )
    return F.flatten(F.zip_with(own, sums, lambda x, first: F.transform(x, lambda _, k: first + _sum(F.slice(x, F.lit(1), k)))))


def _matches(name: str, pattern: str) -> list[Column]:
    """Columns with the matches of a pattern and the text between them."""
    worth = F.col("text").rlike(HINT[name])
    none = F.array().cast("array<string>")
    found = F.when(worth, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
    between = F.when(worth, F.split("text", pattern, -1)).otherwise(none)
    return [found.alias(f"found_{name}"), between.alias(f"between_{name}")]


def _places(rows: DataFrame, patterns: dict[str, str], kept: list[str]) -> DataFrame:
    """``spans_<kind>``: the matches of each kind as (start, end, match, before, after)."""
    rows = rows.select(*kept, *[c for k, p in patterns.items() for c in _matches(k, p)])
    lengths = {
        k: F.zip_with(
            F.slice(f"between_{k}", F.lit(1), F.size(f"found_{k}")), F.col(f"found_{k}"),
            lambda b, m: (F.length(b) + F.length(m)).cast("bigint"),
        )
        for k in patterns
    }
    rows = rows.select("*", *[c.alias(f"lengths_{k}") for k, c in lengths.items()])
    rows = rows.select("*", *[F.when(F.size(f"found_{k}") > 0, _before(F.col(f"lengths_{k}"))).alias(f"at_{k}") for k in patterns])

    def span(k: str) -> Column:
        def one(match: Column, i: Column) -> Column:
            before, after = F.get(f"between_{k}", i), F.get(f"between_{k}", i + 1)
            start = F.get(f"at_{k}", i) + F.length(before)
            return F.struct(
                start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"),
                F.right(before, F.lit(24)).alias("before"), F.left(after, F.lit(4)).alias("after"),
            )

        return F.transform(f"found_{k}", one)

    return rows.select(*kept, *[span(k).alias(f"spans_{k}") for k in patterns])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, x: Column) -> Column:
        doubled = F.when(x["k"] % 2 == 1, x["d"] * 2).otherwise(x["d"])
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.struct(c.cast("int").alias("d"), k.alias("k")))
    return F.aggregate(F.filter(numbered, lambda x: x["d"].isNotNull()), F.lit(0), add) % 10 == 0


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(F.regexp_replace(part, "[^0-9]", ""), F.lit("0"))
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))

    return F.forall(F.split(match, r"\."), small)


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern is kept."""
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _accepted(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["match"])


def _of_kind(kind: int, *fields: str) -> Callable[[Column], Column]:
    """A span with its kind and some of its fields."""
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[f].alias(f) for f in fields])


def base_spans(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and, for each kind, ``spans_<kind>`` with the base spans of the column ``text``."""
    rows = _places(docs, BASE, kept)
    return rows.select(
        *kept, *[F.filter(f"spans_{k}", _accepted(k)).alias(f"spans_{k}") for k in KINDS]
    )


# --- candidates and their features ----------------------------------------------------------------------------


def _features(c: Column) -> list[Column]:
    """Features of a candidate, all whole numbers from 0 to ``MOST``."""
    match, digits = c["match"], _digits(c["match"])
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: F.length(g) > 0)
    values = {
        "kind": c["kind"],
        "checked": _checked(c),
        "n_digits": F.length(digits),
        "n_groups": F.size(groups),
        "longest": F.array_max(F.transform(groups, lambda g: F.length(g))),
        "n_distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "n_labels": F.size(F.filter(F.split(match, r"(?i)[^\p{L}\p{N}]+(?:(?:at|dot)[^\p{L}\p{N}]+)?"), lambda g: F.length(g) > 0)),
        "letter_before": c["before"].rlike(r"[\p{L}_]$"),
        "letter_after": c["after"].rlike(r"^[\p{L}_]"),
        "digit_before": c["before"].rlike(r"[0-9][.\x20-]?$"),
        "digit_after": c["after"].rlike(r"^[.\x20-]?[0-9]"),
        "named": reduce(lambda a, b: a | b, [(c["kind"] == i) & c["before"].rlike(NAMED[k]) for i, k in enumerate(KINDS)]),
        "secret": c["before"].rlike(SECRET),
        "in_quotes": c["before"].rlike("[\"']$") | c["after"].rlike("^[\"']"),
    }
    return [F.least(F.coalesce(values[f].cast("int"), F.lit(0)), F.lit(MOST)).alias(f) for f in FEATURES]


def _checked(c: Column) -> Column:
    """Whether a candidate can be of its kind in some notation: by check digit, octets, digits or domain."""
    match, digits = c["match"], _digits(c["match"])
    groups, n = F.split(match, "[^0-9]+"), F.length(digits)
    whole = {
        "email": match.rlike(r"(?:\.|\)|\]|\x20)\x20?[A-Za-z][A-Za-z0-9-]*[A-Za-z]$") & match.rlike(DOMAIN),
        "ip": match.rlike(r"^[0-9]{1,3}(?:(?:\x20?\.\x20?|\[\.\]|\([Dd][Oo][Tt]\))[0-9]{1,3}){3}$") & F.forall(groups, lambda g: g.cast("int") <= 255),
        "card": F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False),
        "phone": n.between(8, 15),
    }
    possible = reduce(lambda a, b: a | b, [(c["kind"] == i) & whole[k] for i, k in enumerate(KINDS)])
    return F.coalesce(possible, F.lit(False))


def _ruled_out(c: Column) -> Column:
    """Whether a candidate cannot be of its kind in any notation: by its check, or as part of a secret or identifier."""
    joined = c["before"].rlike(r"[\p{L}\p{N}_]$") | c["after"].rlike(r"^[\p{L}\p{N}_]")
    return ~_checked(c) | joined | c["before"].rlike(SECRET)


def _is_base(c: Column, of: Callable[[Column, int], Column] = lambda kind, i: kind == i) -> Column:
    """Whether a candidate is, as it stands, what the base pattern of its kind, or of such kinds, accepts."""
    whole = [of(c["kind"], i) & c["match"].rlike(f"^(?:{BASE[k]})$") & valid(k, c["match"]) for i, k in enumerate(KINDS)]
    return reduce(lambda a, b: a | b, whole)


def candidates(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and ``candidates``: (kind, start, end, match, before, after) of all generators, overlapping freely."""
    rows = _places(docs, WIDE, kept)
    spans = [
        F.transform(f"spans_{k}", _of_kind(i, "start", "end", "match", "before", "after")) for i, k in enumerate(KINDS)
    ]
    return rows.select(*kept, F.concat(*spans).alias("candidates"))


# --- boosted trees ----------------------------------------------------------------------------------------------

# A leaf is its value, an inner node (feature, cut, subtree up to the cut, subtree beyond it).
Tree = float | tuple[int, int, "Tree", "Tree"]


def _tree(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, rate: float) -> Tree:
    """The regression tree that best lowers a loss with these first and second derivatives."""

    def gain(a: np.ndarray | float, b: np.ndarray | float):
        return a * a / (b + 1.0)

    leaf = float(-rate * slope.sum() / (bend.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return leaf
    best, found = 1e-6, None
    whole = gain(slope.sum(), bend.sum())
    for f in range(x.shape[1]):
        a = np.cumsum(np.bincount(x[:, f], slope, MOST + 1))
        b = np.cumsum(np.bincount(x[:, f], bend, MOST + 1))
        better = (gain(a, b) + gain(a[-1] - a, b[-1] - b) - whole)[:-1]
        first = int(better.argmax())
        if better[first] > best:
            # Cuts between two values that occur are alike: the middle one, so that either side takes the values near it.
            other = np.flatnonzero(better[first:] < better[first] - 1e-9)
            last = first + (int(other[0]) if len(other) else len(better) - first) - 1
            best, found = float(better[first]), (f, (first + last) // 2)
    if found is None:
        return leaf
    f, cut = found
    low = x[:, f] <= cut
    return f, cut, _tree(x[low], slope[low], bend[low], depth - 1, rate), _tree(x[~low], slope[~low], bend[~low], depth - 1, rate)


def _leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _leaves(low, x), _leaves(high, x))


def boost(x: np.ndarray, right: np.ndarray, weights: np.ndarray, trees: int, depth: int, rate: float = 0.7) -> tuple[float, list[Tree]]:
    """Log-odds and trees for the chance that a feature row is right; no row order or random number plays a part."""
    share = (float(weights[right].sum()) + 0.5) / (float(weights.sum()) + 1.0)
    start = float(np.log(share / (1 - share)))
    margin, found = np.full(len(x), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        found.append(_tree(x, weights * (p - right), weights * p * (1 - p), depth, rate))
        margin = margin + _leaves(found[-1], x)
    return start, found


def _nodes(tree: Tree, features: Sequence[Column]) -> Column:
    """A regression tree as an expression."""
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(features[f] <= cut, _nodes(low, features)).otherwise(_nodes(high, features))


class Detector:
    """Score of a candidate as an expression over its features, and the least score that redacts, by kind."""

    def __init__(self, start: float, trees: Sequence[Tree], thresholds: Mapping[int, float]) -> None:
        self.start, self.trees, self.thresholds = start, list(trees), dict(thresholds)

    def score(self, features: Sequence[Column]) -> Column:
        """The chance that a candidate with these features is personal data of its kind."""
        margin = sum((_nodes(t, features) for t in self.trees), F.lit(self.start))
        return F.round(1 / (1 + F.exp(-margin)), 3)

    def wanted(self) -> dict[int, float]:
        return {k: t for k, t in self.thresholds.items() if t < inf}

    def accepts(self, features: Column) -> Column:
        """Whether a candidate with this struct of features is redacted."""
        score = self.score([features[f] for f in FEATURES])
        enough = [(features["kind"] == k) & (score >= t) for k, t in self.wanted().items()]
        return reduce(lambda a, b: a | b, enough, F.lit(False))


# Classes of candidates: ruled out, accepted by the base pattern, open.
OUT, ACCEPTED, OPEN = 0, 1, 2


def _class(c: Column) -> Column:
    """What is known of a candidate; one that another kind's base pattern accepts as a whole is ruled out for its own kind."""
    other = _is_base(c, lambda kind, i: kind != i)
    return F.when(F.coalesce(_is_base(c), F.lit(False)), ACCEPTED).when(_ruled_out(c) | F.coalesce(other, F.lit(False)), OUT).otherwise(OPEN)


def _thresholds(by_score: Sequence[Mapping[str, float]], targets: Mapping[str, float], doubt: float) -> dict[int, float]:
    """For each kind the least score above one half from which on enough of the held-out candidates are right, infinite if none.

    A candidate that is accepted counts as right, one that is ruled out as wrong. Open ones count as right with the share
    that the known ones at or above their score have, as the trees have not seen them: positives are known in part only.
    """
    thresholds = {}
    for kind, name in enumerate(KINDS):
        thresholds[kind], known, accepted, all_, right = inf, doubt, 0.0, doubt, 0.0
        for r in sorted((r for r in by_score if r["kind"] == kind and r["p"] > 0.5), key=lambda r: -r["p"]):
            known, accepted = known + r["accepted"] + r["out"], accepted + r["accepted"]
            all_ += r["accepted"] + r["out"] + r["open"]
            right += r["accepted"] + r["open"] * accepted / known
            if accepted and right >= targets[name] * all_:
                thresholds[kind] = r["p"]
    return thresholds


def fit(
    docs: DataFrame, trees: int = 12, depth: int = 4, fitted: int = FITTED, targets: Mapping[str, float] = TARGETS, doubt: float = DOUBT
) -> Detector:
    """Fits the trees to candidates of the column ``text`` of which it is known what they are, and sets a threshold for each kind.

    There are no labels for spans. What the base patterns accept is the positive class; candidates that cannot be of their kind
    in any notation (``_ruled_out``) are the negative one. All others are what the trees are to judge, so they are not
    fitted; as no feature is a sign of one notation, they score by format and context like the known ones. Candidates of all documents are
    counted by features, class and fold in one pass; features are small numbers, so there are few such rows, and at most
    ``fitted`` known ones of those not held out, the most frequent first, are fitted with their counts as weights. A quarter of the
    candidates is held out from fitting; all of it sets the thresholds (``_thresholds``), whatever ``fitted``: ``targets``
    is the least share of right ones, with ``doubt`` more counted as wrong. A kind of which no candidate is accepted gets no threshold.
    """
    # An inner explode would let the optimiser filter by the size of the array, which computes all of it once more for each element.
    found = candidates(docs, []).select(F.explode_outer("candidates").alias("c")).where("c IS NOT NULL")
    held = (F.pmod(F.xxhash64("c.match", "c.before", "c.after"), F.lit(4)) == 0).alias("held")
    counted = found.select(F.struct(*_features(F.col("c"))).alias("f"), _class(F.col("c")).alias("class"), held)
    counted = durable(counted.groupBy("f", "class", "held").agg(F.count("*").alias("n")).select("f.*", "class", "held", "n"))
    train = bounded(counted, fitted).collect()
    if not any(r["class"] == ACCEPTED for r in train):
        return Detector(0.0, [], {})
    x = np.array([[r[f] for f in FEATURES] for r in train], np.int64)
    start, grown = boost(x, np.array([r["class"] == ACCEPTED for r in train]), np.array([float(r["n"]) for r in train]), trees, depth)
    detector = Detector(start, grown, {})
    score = detector.score([F.col(f) for f in FEATURES]).alias("p")
    sums = [F.sum(F.when(F.col("class") == v, F.col("n")).otherwise(0)).alias(k) for k, v in (("out", OUT), ("accepted", ACCEPTED), ("open", OPEN))]
    # At most four kinds times a thousand scores.
    by_score = counted.where("held").groupBy("kind", score).agg(*sums).collect()
    return Detector(start, grown, _thresholds([r.asDict() for r in by_score], targets, doubt))


def bounded(counted: DataFrame, fitted: int) -> DataFrame:
    """The known rows that are not held out, at most ``fitted``, the most frequent first."""
    known = counted.where(~F.col("held") & (F.col("class") != OPEN))
    return known.orderBy(F.col("n").desc(), *FEATURES, "class").limit(fitted)


# --- detection and redaction -------------------------------------------------------------------------------------


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def detected(docs: DataFrame, text_col: str, kept: list[str], detector: Detector | None = None) -> DataFrame:
    """``own`` (a struct of the columns ``kept``), ``base`` and ``added``: arrays of (kind, start, end) in the order of kind and start.

    Added spans overlap no base span; of added spans that overlap, the longest stays, the first of equals.
    """
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("none"))
    rows = docs.select(own.alias("own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    detector = detector or fit(rows.select("text"))
    rows = base_spans(rows, ["own", "text"])
    base = F.sort_array(F.concat(*[F.transform(f"spans_{k}", _of_kind(i, "start", "end")) for i, k in enumerate(KINDS)]))
    if not detector.wanted():
        none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
        return rows.select("own", base.alias("base"), none.alias("added"))
    rows = candidates(rows.select("own", "text", base.alias("base")), ["own", "base"])
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: _overlap(b, c)))
    open_ = F.filter(free, lambda c: ~_ruled_out(c))
    rows = rows.select("own", "base", F.transform(open_, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.struct(*_features(c)).alias("f"))).alias("open"))
    extra = F.filter("open", lambda c: detector.accepts(c["f"]))
    rows = rows.select("own", "base", F.transform(extra, lambda c: F.struct(c["kind"], c["start"], c["end"])).alias("extra"))

    def beaten(c: Column) -> Column:
        def better(o: Column) -> Column:
            size, other = c["end"] - c["start"], o["end"] - o["start"]
            first = (o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["kind"] < c["kind"]))
            return _overlap(o, c) & ((other > size) | ((other == size) & first))

        return F.exists("extra", better)

    return rows.select("own", "base", F.sort_array(F.filter("extra", lambda c: ~beaten(c))).alias("added"))


def _equal(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """Spans of personal data in every document.

    Returns id, the number of base spans of each kind, ``base_sha256`` of the base spans and ``spans`` with
    all of them, written kind:start:end in the order of kind and start. Null and empty texts have none. Rows with null or
    repeated ids are searched each for itself; other columns are not looked at; an empty table gives an empty result.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = detected(named, "text", ["id"], detector)
    counts = [
        F.size(F.filter(F.transform("base", lambda s: s["kind"]), _equal(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)
    ]
    return found.select(
        F.col("own.c0").alias(id_col),
        *counts,
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, detector: Detector | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, as [EMAIL]; spans that overlap share one replacement.

    ``length_col``, if there is one, gets the new length. Null texts stay null; columns and their order stay as they are.
    """
    found = detected(docs, text_col, docs.columns, detector)
    spans = F.array_sort(
        F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    own = {c: F.col(f"own.c{i}") for i, c in enumerate(docs.columns)}
    text = own[text_col]

    def cut(state: Column, s: Column) -> Column:
        # A span that begins inside the one before only moves the end.
        inside = s["start"] < state["at"]
        length = (s["start"] - state["at"]).cast("int")
        part = F.concat(F.substring(text, (state["at"] + 1).cast("int"), length), F.get(labels, s["kind"]))
        parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(part)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(state["parts"], ""), rest)

    rows = found.select("own", spans.alias("spans"))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, cut, finish)).otherwise(text)
    rows = rows.select("own", clean.alias("clean"))
    new = {text_col: F.col("clean")}
    if length_col:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.length("clean").cast(kind)
    return rows.select(*[new.get(c, own[c]).alias(c) for c in docs.columns])
