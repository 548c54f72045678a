"""Near-duplicates and repeated passages against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.components import components
from tallyspark.llm.simhash import fingerprint, keep_one, linked, near_duplicates
from tallyspark.llm.substring_dedup import remove_repeats
from tallyspark.llm.words import WordHasher, joined
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ("", "  ", "one", "A b C", "a b c d", "The the THE the the", "x " * 500, "é ß É z"):
        assert fingerprint(text.encode()) == brute.simhash(text), text


def test_near_duplicates_on_odd_rows(odd):
    got = [tuple(r) for r in near_duplicates(odd).collect()]
    assert ordered(got) == ordered(brute.near_groups(rows_of(odd)))


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert ordered(got) == ordered(brute.near_groups(rows_of(docs)))


def test_near_duplicates_of_nothing(empty):
    result = near_duplicates(empty)
    assert result.count() == 0
    assert result.columns == ["doc_id", "fingerprint", "component_id"]
    assert keep_one(empty).count() == 0


def test_links_of_large_groups_are_complete_and_few(spark):
    """A crowd of fingerprints around one, in chunks far smaller than the crowd, and pairs at every distance."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(600)}
    for far in range(1, 7):
        a = rng.getrandbits(64)
        prints |= {a, a ^ sum(1 << b for b in rng.sample(range(64), far))}
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = linked(frame, 4, chunk=50).distinct().collect()
    want = {}
    for i, v in enumerate(values):
        for w in values[i + 1 :]:
            if (int(v) ^ int(w)).bit_count() <= 4:
                want.setdefault(int(v), set()).add(int(w))
    close = {(a, b) for a, bs in want.items() for b in bs}
    got = {tuple(sorted((int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))))) for r in links}
    assert got <= close
    assert len(got) < len(close) / 3  # not all pairs of the crowd

    def roots(pairs):
        parent = {int(v): int(v) for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(int(v)) for v in values]

    assert roots(got) == roots(close)


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**12])
def test_bands_leave_enough_that_agree(n):
    bands = simhash.bands_for(n, 4)
    assert bands > 4
    assert 64 * (bands - 4) / bands >= min(np.log2(n) + 2, 20)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(300, 300), (None, 5), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k for k, v in got.items() if v == 0} == set(range(41))
    assert {k for k, v in got.items() if v == 100} == set(range(100, 130))
    assert {k for k, v in got.items() if v == 200} == {200, 201, 202}
    assert 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_leaves_one_row_of_each_group(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    left = rows_of(kept)
    # No two of these rows are within four bits of one another but those of equal fingerprints.
    assert len(left) == len({brute.simhash(t) for _, t in rows_of(odd)})
    assert len({brute.simhash(t) for _, t in left}) == len(left)
    assert (5, dict(rows_of(odd.where("doc_id = 5")))[5]) not in left


def test_word_hashes_tell_words_apart_whatever_the_pieces(monkeypatch):
    texts = [b" a  bb\tccc\n", b"", b"x", "é ü ß é".encode(), b"word " * 5, b"q" * 3000, b"ab ba a b"]
    (hashes,), counts = WordHasher(1).many(texts)
    flat = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len({h: w for h, w in zip(hashes.tolist(), flat, strict=True)}) == len(set(flat)) == len(set(zip(hashes.tolist(), flat, strict=True)))
    monkeypatch.setattr("tallyspark.llm.words.PIECE", 64)
    (again,), _ = WordHasher(1).many(texts)
    assert (again == hashes).all()
    for n in (1, 2, 3, 5, 13):
        assert (joined(hashes, n)[4] == joined(hashes[4 : 4 + n], n)[0]) and len(joined(hashes[:2], 3)) == 0


def test_repeats_on_odd_rows(odd):
    got = [tuple(r) for r in remove_repeats(odd).collect()]
    assert ordered(got) == ordered(brute.without_repeats(rows_of(odd)))
    assert any(removed for _, _, removed, _ in got)


def test_repeats_on_documents_with_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = remove_repeats(docs, with_text=True).collect()
    assert ordered(tuple(r)[:4] for r in got) == ordered(brute.without_repeats(rows_of(docs)))
    assert all(len(r["kept_text"].split()) == r["n_words"] - r["n_removed"] or " " in r["kept_text"] for r in got)


def test_repeats_within_one_document_stay(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(4, f"{passage} x {passage}"), (4, passage), (2, f"y {passage}"), (3, " ".join(f"p{i}" for i in range(12)))],
        "doc_id int, text string",
    )
    got = sorted(tuple(r)[:3] for r in remove_repeats(docs).collect())
    assert got == [(2, 21, 0), (3, 12, 0), (4, 20, 20), (4, 41, 40)]


def test_repeats_of_nothing(empty):
    assert remove_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="whole number"):
        remove_repeats(empty.withColumn("doc_id", F.lit("a")))
