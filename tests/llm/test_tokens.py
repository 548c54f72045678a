"""Token ids, attribution to sections, and packing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm.packing import best_fit, bin_completion, fillings, lower_bound, pack
from tallyspark.llm.token_counts import attribute, count_tokens, token_spans
from tallyspark.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "x y  z", "it's we'll 12 3.4!?", "<|endoftext|> b", "é😀 ß", "a\t\tb  ", "tab \tx"],
)
def test_ids_are_those_of_the_tokenizer(plain, encoder, text):
    assert ids(encoder, text) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab1.' \n\té 😀 ,<|>")), max_size=40))
def test_ids_of_any_text(plain, encoder, text):
    assert ids(encoder, text) == plain.encode(text, add_special_tokens=False).ids


def test_spans_match_the_offsets_of_the_tokenizer(plain, encoder):
    text = "Plain words, then naïve über text.\n\nNext line 123."
    starts, ends = token_spans(text, encoder.byte_lengths(encoder.encode(text)))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == plain.encode(text, add_special_tokens=False).offsets


def test_a_crossing_token_goes_where_most_of_it_is():
    section, shared = attribute(np.array([0, 2, 6, 9]), np.array([2, 6, 9, 12]), np.array([0, 3, 3, 8, 10, 12]))
    # [2, 6) has one character in the first and three in the third section; [6, 9) two and one; [9, 12) one and two.
    assert section.tolist() == [0, 2, 2, 4]
    assert shared.tolist() == [False, True, True, True]
    tie, _ = attribute(np.array([0]), np.array([4]), np.array([0, 2, 4]))
    assert tie.tolist() == [0]


@pytest.mark.parametrize("by", ["line", "field"])
def test_counts_add_up_to_the_document(spark, odd, plain, by):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = count_tokens(docs, fields=("source", "text"), by=by).collect()
        want = Counter()
        for r in docs.collect():
            want[r["doc_id"]] += len(plain.encode(f"{r['source'] or ''}\n{r['text'] or ''}", add_special_tokens=False).ids)
        have = Counter()
        for r in got:
            have[r["doc_id"]] += r["n_tokens"]
            assert 0 <= r["n_shared"] <= r["n_tokens"] and r["start"] <= r["end"]
        assert have == want


@pytest.mark.parametrize("by", ["line", "field"])
def test_counts_per_section_against_character_by_character(spark, plain, odd, by):
    """Each token's bytes follow from its name, one character for a byte; each character knows its section."""
    for docs in (odd.where("doc_id <> 6 OR doc_id IS NULL"), spark.read.parquet(f"{SF}/documents.parquet").limit(60)):
        want = Counter()
        for r in docs.collect():
            values = [r["source"] or "", r["text"] or ""]
            section, owner = {}, []
            for f, value in enumerate(values):
                line = 0
                section[f, 0] = len(owner)
                for c in value + ("\n" if f == 0 else ""):
                    section.setdefault((f, line), len(owner))
                    owner.append((f, line))
                    line += by == "line" and c == "\n"
            text = "\n".join(values)
            of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
            tokens, shared, at = Counter(), Counter(), 0
            for name in plain.encode(text, add_special_tokens=False).tokens:
                touched = [owner[k] for k in range(of_byte[at], of_byte[at + len(name) - 1] + 1)]
                at += len(name)
                held = Counter(touched)
                best = max(held, key=lambda s: (held[s], (-s[0], -s[1])))
                tokens[best] += 1
                shared[best] += len(held) > 1
            for s in section:
                want[r["doc_id"], ("source", "text")[s[0]], s[1], tokens[s], shared[s]] += 1
        got = Counter((r["doc_id"], r["field"], r["section"], r["n_tokens"], r["n_shared"]) for r in count_tokens(docs, fields=("source", "text"), by=by).collect())
        assert got == want


def test_counts_of_nothing(empty):
    assert count_tokens(empty).count() == 0
    with pytest.raises(ValueError, match="by"):
        count_tokens(empty, by="word")


# --- packing ------------------------------------------------------------------------------------------------------


def used(plan):
    return sum(n for _, n in plan)


def packed(plan):
    out = Counter()
    for filling, n in plan:
        for size in filling:
            out[size] += n
    return out


def fewest(items, capacity):
    """Fewest bins by exhaustive search."""
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= items[k] and room not in rooms[:i]:
                place(k + 1, [*rooms[:i], room - items[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(items=st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bin_completion_is_optimal_on_small_cases(items):
    items = sorted(items, reverse=True)
    counts, want = Counter(items), fewest(items, 30)
    plan = bin_completion(counts, 30)
    assert packed(plan) == counts
    assert all(sum(f) <= 30 for f, _ in plan)
    assert used(plan) == want
    assert lower_bound(counts, 30) <= want <= used(best_fit(counts, 30))


def test_bin_completion_beats_best_fit_where_it_fails():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # forty in all: 6 + 4, 5 + 3 + 2 twice
    assert used(bin_completion(counts, 10)) == 4
    assert used(bin_completion({1: 100_000, 5: 3}, 2048)) == 49


def test_fillings_are_undominated():
    left = {9: 1, 7: 1, 5: 2, 2: 1}
    found = fillings(10, [2, 5, 7, 9], left)
    assert found[0] == (5, 5)
    assert set(found) == {(5, 5), (9,)}  # not 7 + 2, as the 9 takes their place, nor 5 + 2, as the 7 does


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, odd, plain, capacity):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = pack(docs, capacity=capacity, with_ids=True).collect()
        want = Counter()
        for r in docs.collect():
            want[r["doc_id"], tuple([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0])] += 1
        sequences, pieces = {}, {}
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            pieces.setdefault(r["doc_id"], []).append(r)
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        have = Counter()
        for key, own in pieces.items():
            if Counter(r["piece"] for r in own).most_common(1)[0][1] > 1:
                have.update({k: v for k, v in want.items() if k[0] == key})  # pieces of rows that share an id
                assert sum(r["length"] for r in own) == sum(len(k[1]) * v for k, v in want.items() if k[0] == key)
                continue
            own.sort(key=lambda r: r["piece"])
            assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
            assert all(r["length"] == capacity for r in own[1:])
            have[key, tuple(np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist())] += 1
        assert have == want
        total = sum(r["length"] for r in rows)
        assert len(sequences) >= -(-total // capacity)


def test_ranks_within_a_length_are_split(spark, monkeypatch):
    monkeypatch.setattr("tallyspark.llm.packing.NUMBERED", 7)
    docs = spark.createDataFrame([(i, "same words") for i in range(100)], "doc_id long, text string")
    rows = pack(docs, capacity=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 100
    assert len({r["sequence_id"] for r in rows}) == 20


def test_packing_nothing(empty):
    assert pack(empty).count() == 0
