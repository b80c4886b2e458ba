import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from veilframe.llm import common, jaccard
from veilframe.llm.components import connected_components
from veilframe.llm.hashing import shingle_set, word_hashes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width=3):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_force(rows, width=3, numerator=90, denominator=100):
    sets = [shingles(t, width) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and denominator * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(linked[i])))
    return sorted(out, key=str)


def one_stays(rows, kept, width=3, numerator=90, denominator=100):
    """Whether of rows (id, text, ...) those without links all stay, and of each component one row of its least id (none comes last) does."""
    sets = [shingles(r[1], width) for r in rows]
    near = lambda a, b: a and b and denominator * len(a & b) >= numerator * len(a | b)
    left = collections.Counter(kept)
    todo = set(range(len(rows)))
    while todo:
        reached, new = set(), {todo.pop()}
        while new:
            i = new.pop()
            reached.add(i)
            more = {j for j in todo if near(sets[i], sets[j])}
            todo -= more
            new |= more
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in reached)
        staying = next((rows[i] for i in reached if (rows[i][0] is None, rows[i][0] or 0) == least and left[rows[i]] > 0), None)
        if staying is None:
            return False
        left[staying] -= 1
    return not +left


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.ngram_join(docs, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    return sorted(map(tuple, got.collect()), key=str)


def near_copies(rng, count, base, edits):
    vocabulary = [f"w{k}" for k in range(400)]
    start = [rng.choice(vocabulary) for _ in range(base)]
    out = []
    for _ in range(count):
        own = list(start)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            own += [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]
        out.append(" ".join(own))
    return out


@given(st.text("aZ \tÉé\n", max_size=60))
def test_words_and_sets(text):
    assert len(word_hashes(text)) == len(words(text))
    assert len(shingle_set(text, 3)) == len(shingles(text))


def test_long_texts_hash_as_short_ones(monkeypatch):
    from veilframe.llm import hashing

    text = " ".join(f"word{k % 77}é" for k in range(3000)) + " " + "y" * 500
    want = word_hashes(text)
    monkeypatch.setattr(hashing, "_SPAN", 100)
    assert np.array_equal(word_hashes(text), want)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.sampled_from([90, 80]), st.data())
def test_similar_sets_agree_on_a_block(size, numerator, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    a = rng.integers(0, 2**63, size, dtype=np.uint64)
    gone = data.draw(st.integers(0, max(0, size // 6)))
    b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, data.draw(st.integers(0, size // 6)), dtype=np.uint64)]))
    a = np.unique(a)
    levels = jaccard.Levels(numerator, 100)
    both = len(np.intersect1d(a, b))
    if 100 * both >= numerator * (len(a) + len(b) - both):
        assert np.intersect1d(jaccard.block_hashes(a, levels), jaccard.block_hashes(b, levels)).size


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = [t for base in (1, 2, 4, 9, 20, 60, 150) for t in near_copies(rng, 14, base, 4)]
    rows = [(rng.randrange(10_000), t) for t in rows + rows[:20]]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, rows, width=5, numerator=8, denominator=10) == brute_force(rows, 5, 8, 10)


def test_large_group_in_tiles(spark, monkeypatch):
    rng = random.Random(12)
    rows = list(enumerate(near_copies(rng, 150, 80, 3)))
    want = brute_force(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "SLICE", 50)
    monkeypatch.setattr(jaccard, "TILE_GRAMS", 1 << 11)  # sets of 78 shingles: tiles of 8 rows a side
    assert run(spark, rows) == want
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    assert run(spark, rows) == want


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = jaccard.ngram_join(cases.documents(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)
    assert run(spark, []) == []
    kept = jaccard.one_of_each(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    assert one_stays(cases.rows(), list(map(tuple, kept.collect())))
    assert jaccard.one_of_each(cases.documents(spark, [])).collect() == []


def test_one_of_each_of_repeated_ids(spark, monkeypatch):
    rng = random.Random(13)
    new = lambda: " ".join(rng.choice([f"w{k}" for k in range(400)]) for _ in range(60))
    near = lambda t: t + " end"
    a, b, c, d, e, f, g = (new() for _ in range(7))
    rows = [
        (1, a), (5, near(a)), (5, b),  # one row of id 5 belongs to another's group
        (6, c), (6, d), (7, near(c)), (8, near(d)),  # two groups of one least id
        (9, e), (9, near(e)), (9, e), (10, e.upper()),  # several rows in one group
        (11, f), (11, None), (11, " "), (12, None), (12, ""), (12, new()), (12, new()),  # several texts that are no copies
        (13, g), (14, near(g)), (None, near(b)), (None, a), (None, new()), (None, ""), (None, None),
    ]
    lone = new()
    rows += [(None, lone), (None, lone), (None, near(lone))]
    for _ in range(2):
        kept = list(map(tuple, jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert one_stays(rows, kept)
        assert sorted(i for i, _ in kept if i is not None) == [1, 5, 6, 6, 9, 11, 11, 11, 12, 12, 12, 12, 13]
        assert sum(i is None for i, _ in kept) == 4 and (None, a) not in kept
        monkeypatch.setattr(common, "BROADCAST_IDS", 0)


def test_unrelated_sets_do_not_meet_on_empty_blocks():
    rng = np.random.default_rng(5)
    for numerator, size in ((90, 1000), (80, 1000), (80, 90)):
        levels, seen = jaccard.Levels(numerator, 100), collections.Counter()
        for _ in range(1500):
            seen.update(set(jaccard.block_hashes(np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64)), levels).tolist()))
        assert sum(n > 1 for n in seen.values()) <= 20 and max(seen.values()) <= 5


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(5, 3), (3, 9), (8, 7), (9, 5), (8, 7)]])
def test_components(spark, edges):
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in list(parent)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_counts_of_column_ranges_lose_no_link(common_grams, only_a, only_b, seed):
    drawn = np.random.default_rng(seed).integers(0, 2**64, common_grams + only_a + only_b, np.uint64, endpoint=False)
    drawn[: common_grams // 2] >>= np.uint64(20)  # many in one range
    a, b = np.unique(drawn[: common_grams + only_a]), np.unique(np.concatenate([drawn[:common_grams], drawn[common_grams + only_a :]]))
    matrix = jaccard.counts_matrix([jaccard.column_counts(a), jaccard.column_counts(b)])
    assert np.abs(matrix[0] - matrix[1]).sum() <= len(np.setxor1d(a, b))
    live = np.triu(np.ones((2, 2), bool), 1)
    sizes = np.array([len(a), len(b)])
    linked = jaccard.overlaps([a, b], live, 80, 100)
    assert not (linked & ~jaccard.possible(sizes, [jaccard.column_counts(s) for s in (a, b)], live, 80, 100)).any()


def test_counts_of_column_ranges_tell_sets_apart():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 2**64, 120, np.uint64, endpoint=False)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 2**64, 280, np.uint64, endpoint=False)])) for _ in range(20)]
    live = np.triu(np.ones((20, 20), bool), 1)
    found = jaccard.possible(np.array([len(s) for s in sets]), [jaccard.column_counts(s) for s in sets], live, 80, 100)
    assert found.sum() < 0.05 * live.sum()
