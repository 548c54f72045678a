"""Approximate neighbours, spelling variants and collocations."""

import random

import numpy as np
import pytest

from tallyspark.llm.collocations import Permutation, QuotientFilter, collocations
from tallyspark.llm.hnsw import Graph, build_layer, nearest
from tallyspark.llm.queries import QUERIES
from tallyspark.llm.variants import Acceptor, compose, near_pairs, spelling_variants
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def exact_neighbours(rows, k, every):
    """(query, rank, id, score) by all products; each id with one vector."""
    rows = sorted(rows)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for i, v in rows:
        if i % every == 0:
            found = sorted((-s, int(j)) for s, j in zip((vectors * np.array(v, float)).sum(1), ids, strict=True) if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return out


# --- neighbours -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths"])
def test_graph_search_finds_most_of_the_nearest(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind == "lengths":
        x *= rng.gamma(2.0, 1.0, (3000, 1))
    graph = Graph.build(x)
    queries = x[::30]
    nodes, scores = Graph.stored(graph.vectors, graph.sizes, graph.flat()).search(queries)
    want = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(nodes, want, strict=True)]) > 0.95
    assert (np.diff(scores[:, :20], axis=1) <= 0).all()
    assert all(len(set(n[n >= 0])) == (n >= 0).sum() for n in nodes)


def test_links_are_bounded_distinct_and_not_to_oneself():
    x = np.random.default_rng(1).normal(size=(900, 8)).astype(np.float32)
    links = build_layer(x, 12)
    for i, own in enumerate(links):
        own = own[own >= 0]
        assert 0 < len(own) <= 12 and len(set(own)) == len(own) and i not in own


def test_neighbours_in_several_shards_against_all_products(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 16)).astype(np.float32).astype(float).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest(frame, shard=400).collect()}
    want = {(q, j): s for q, _, j, s in exact_neighbours(rows, 20, 20)}
    assert len(got) == len(want) == 20 * 75
    assert len(got.keys() & want.keys()) > 0.97 * len(want)
    assert all(got[key] == pytest.approx(want[key], rel=1e-12) for key in got.keys() & want.keys())


def test_recall_over_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    got = QUERIES["op11_approximate_neighbours"](spark, "/root/testdata/sf0.1").collect()
    want = exact_neighbours([(r["vec_id"], r["embedding"]) for r in rows], 20, 20)
    assert len(got) == len(want)
    pairs = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(pairs & {(q, j) for q, _, j, _ in want}) >= 0.95 * len(want)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for found in by_query.values():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_neighbours_of_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(i, [0.0, 2.0]) for i in range(300, 320)]
    rows += [(320, None), (340, [0.0, 0.0]), (360, [1.0, None]), (380, [nan, 1.0]), (400, [inf, 1.0]), (None, [1.0, 1.0]), (420, []), (440, [3.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label string, shard int, score double").repartition(3)
    got = [tuple(r) for r in nearest(frame).collect()]
    plain = {i: [*v, *[0.0] * (2 - len(v))] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    assert sorted(got) == sorted(exact_neighbours(plain.items(), 20, 20))


def test_few_and_no_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = nearest(spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (20, [3.0])], schema)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 20, 3.0), (0, 2, 1, -2.0), (20, 1, 0, 3.0), (20, 2, 1, -6.0)]


# --- spelling ---------------------------------------------------------------------------------------------------------


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "", "t"})
    machine = Acceptor(words)

    def accepted(state, before=""):
        found = {before} if machine.final[state] else set()
        return found.union(*(accepted(t, before + c) for c, t in machine.arcs[state].items()))

    assert accepted(machine.start) == set(words)
    # No two states have the same arcs and end.
    states = [(f, tuple(sorted(a.items()))) for a, f in zip(machine.arcs[1:], machine.final[1:], strict=True)]
    assert len(states) == len(set(states)) and len(Acceptor(["tap", "tops", "top", "taps"][:0]).arcs) == 2


def test_composition_against_all_pairs():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(0, 7))) for _ in range(300)})
    got = {tuple(sorted(p)) for p in compose(Acceptor(words), Acceptor(words))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


@pytest.mark.parametrize("chunk", [7, 4096])
def test_near_pairs_in_parts_and_chunks(spark, chunk):
    rng = random.Random(9)
    words = sorted({"pre" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(400)} | {"z" * 6, "z" * 7, "y" * 3000, "y" * 3001})
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    got = {tuple(r) for r in near_pairs(frame, chunk).collect()}
    near = {w: set() for w in words}
    for w in words:
        for v in words:
            if w < v and abs(len(w) - len(v)) <= 1:
                i = next((k for k, (a, b) in enumerate(zip(w, v)) if a != b), min(len(w), len(v)))
                if w[i + 1 :] == v[i + 1 :] or w[i + 1 :] == v[i:] or w[i:] == v[i + 1 :]:
                    near[w].add(v)
    assert got == {(w, v) for w, vs in near.items() for v in vs}


def test_variants_against_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SF).collect()]
    want = brute.spelling([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] for r in got) and len(got) > 500
    for options in ({}, {"min_count": 1, "min_length": 3, "spoil": 3}):
        got = [tuple(r) for r in spelling_variants(odd, **options).collect()]
        assert sorted(got, key=str) == sorted(brute.spelling([(r["doc_id"], r["text"]) for r in odd.collect()], **options), key=str)
    assert spelling_variants(empty).count() == 0


def test_roots_follow_forms_to_the_last(spark):
    # Counts of 1, 5, 25 and 125, each form one edit from the one before; and a tie between two forms.
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg"]
    text = " ".join(" ".join([w] * 5**i) for i, w in enumerate(chain)) + " tiesta" + " tiestb" * 9 + " tiestc" * 9
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), spoil=None, min_count=1).collect()}
    assert [got[w][:2] for w in chain] == [(chain[1], chain[3]), (chain[2], chain[3]), (chain[3], chain[3]), (None, chain[3])]
    assert got["tiesta"] == ("tiestb", "tiestb", 2) and got["tiestb"] == (None, "tiestb", 2)


# --- collocations -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 2, 7, 31, 32, 50, 63, 64])
def test_permutation_is_invertible(bits):
    values = np.arange(1 << bits, dtype=np.uint64) if bits < 10 else np.random.default_rng(2).integers(0, 1 << bits, 5000, np.uint64, endpoint=False) if bits < 64 else np.random.default_rng(2).integers(0, 2**64 - 1, 5000, np.uint64)
    spread = Permutation(bits)(values)
    assert (Permutation(bits).inverse(spread) == values).all() and (spread <= np.uint64((1 << bits) - 1)).all()
    if bits < 10:
        assert sorted(spread.tolist()) == values.tolist()


@pytest.mark.parametrize("bits", [1, 9, 28, 40, 64])
def test_filters_are_lossless_and_merge(bits):
    rng = np.random.default_rng(6)
    many = [rng.integers(0, 2 ** min(bits, 63), n, np.uint64) >> np.uint64(s) for n, s in ((1, 0), (500, 0), (4000, max(0, bits - 10)))]
    filters = [QuotientFilter.of(v) for v in many]
    again = [QuotientFilter.load(f.dump(bits)) for f in filters]
    for a, b in zip(filters, again, strict=True):
        assert (a.values == b.values).all() and (a.counts == b.counts).all()
    whole = QuotientFilter.merged(again)
    values, counts = np.unique(np.concatenate(many), return_counts=True)
    assert (whole.values == values).all() and (whole.counts == counts).all()
    assert len(QuotientFilter.load(QuotientFilter.merged([]).dump(bits)).values) == 0
    if bits == 28:
        dense = QuotientFilter.of(rng.integers(0, 2**28, 200_000, np.uint64))
        assert len(dense.dump(28)) < 3 * len(dense.values)


def test_collocations_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_collocations"](spark, SF).collect()]
    want = brute.phrases([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()])
    assert sorted(got) == sorted(want) and len(got) > 50
    assert {t for _, t in collocations(docs.limit(1)).dtypes} == {"string", "bigint"}


@pytest.mark.parametrize("bundle, piece", [(1 << 24, 1 << 20), (300, 64)])
def test_collocations_of_odd_rows_and_small_bundles(spark, odd, empty, monkeypatch, bundle, piece):
    monkeypatch.setattr("tallyspark.llm.collocations.PIECE", piece)
    monkeypatch.setattr("tallyspark.llm.collocations.SHARD", 50)
    extra = spark.createDataFrame([(None, "New York, new  york\tNEW YORK city; a\u00a0b a\u00a0b! " * 9 + "la la la la la la"), ("en", "x y z " * 30), ("en", "no")], "lang string, text string")
    frame = odd.where("doc_id <> 6 OR doc_id IS NULL").select("lang", "text", "score", "copy_no").unionByName(extra, True).repartition(3)
    for least in (1, 2, 5):
        got = [tuple(r) for r in collocations(frame, min_count=least, bundle=bundle).collect()]
        assert sorted(got) == sorted(brute.phrases([(r["lang"], r["text"]) for r in frame.collect()], min_count=least))
    assert collocations(empty).count() == 0
    assert collocations(frame, min_count=10**6).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    from tallyspark.llm.collocations import _score

    rows = [(10**13 + 7, 3 * 10**13 + 1, [10**13 + 9], [2 * 10**13 + 3]), (101, 10**14, [102], [9 * 10**13])]
    frame = spark.createDataFrame(rows, "a long, n long, pre array<long>, suf array<long>")
    got = [r["s"] for r in frame.select(_score(2)["score"].alias("s"), F.lit(1)).collect()]
    assert got == [1000 * a * n // (p[0] * s[0]) for a, n, p, s in rows]
