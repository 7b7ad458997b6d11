"""Near copies at 4/5 of the five-word shingles against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import near_dup_wide, near_dup
from tests.llm.test_operators import prose

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "  ", "two words", "Two  words", "one two three four"]
    for _ in range(25):
        base = prose(rng, rng.randint(8, 150)).split()
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    line = prose(rng, 30)
    texts += [f"{line} {prose(rng, rng.choice([6, 60]))}" for _ in range(60)]  # one line in many texts
    base = prose(rng, 120).split()
    for _ in range(90):  # a large group, not all of it linked to all
        words = list(base)
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def firsts(rows):
    sets = [plain(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in range(len(rows))}


@pytest.mark.parametrize(("block", "sizes"), [(2048, 2), (7, 2), (2048, 3)])
def test_linked_texts_fall_together(spark, rows, monkeypatch, block, sizes):
    """No wrong link, and at most one in a hundred documents missed."""
    monkeypatch.setattr(near_dup_wide, "POSITION_SETS", [s for s in near_dup_wide.POSITION_SETS if s[0] == sizes])
    docs = spark.createDataFrame(rows, FIELDS)
    kept = near_dup_wide.keep_one(docs, block=block)
    ids, want = [r["doc_id"] for r in kept.collect()], firsts(rows)
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert want <= set(ids) and len(set(ids) - want) <= (len(rows) - len(want)) / 100


def test_stage_finds_copies_beyond_the_byte_index(spark, rows):
    """Copies at 4/5 whose fingerprints differ in more than 4, and in more than 7, of 64 bits are dropped."""
    rng = random.Random(8)
    pairs, far = [], []
    while len([b for b in far if b > 7]) < 3:
        words = prose(rng, 60).split()
        other = list(words)
        other[30] = "another"
        a, b = " ".join(words), " ".join(other)
        assert 5 * len(plain(a) & plain(b)) >= 4 * len(plain(a) | plain(b))
        far.append((near_dup.fingerprint(a) ^ near_dup.fingerprint(b)).bit_count())
        pairs.append((a, b))
    docs = spark.createDataFrame([(2 * k + i, t, "en", "s", 0) for k, p in enumerate(pairs) for i, t in enumerate(p)], FIELDS)
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, "").collect()) == [2 * k for k in range(len(pairs))]
    assert P.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(3, "one two three four five six", "a", 1), (3, "one two three four five six", "a", 1), (1, "One two  three four five six", "b", 2), (None, "one two three four five six", "c", 3), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key string, _kept_id int").withColumns({c: F.lit(c) for c in ("fp", "_kept_key", "_more", "row_key", "root", "p0")})
    kept = near_dup_wide.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r)[:4] for r in kept.collect()} == {rows[2], rows[4]}


def test_shared_counts_are_cuts_of_sets():
    rng = np.random.default_rng(1)
    for values in (5, 300, 9000):
        sets = [np.unique(rng.integers(0, values, rng.integers(1, 200))).astype(np.uint32) for _ in range(30)]
        rows, columns = np.array([1, 4, 9]), np.array([2, 5, 20, 29])
        want = [[len(np.intersect1d(sets[i], sets[j])) for j in columns] for i in rows]
        assert near_dup_wide.shared_counts(sets, rows, columns).tolist() == want


def test_position_sets():
    for size, n, _ in near_dup_wide.POSITION_SETS:
        sets = near_dup_wide.position_sets(size, n)
        assert len(set(sets)) == n and all(len(set(s)) == size and max(s) < 64 for s in sets)


def test_filters_seldom_lose_a_pair():
    """Pairs at 4/5 and just above: all filters together lose fewer than 3 in 100, most of them to the index."""
    rng = np.random.default_rng(3)
    sets = near_dup_wide.position_sets(2, 64)
    lost = filtered = 0
    for _ in range(1000):
        n = int(rng.integers(9, 400))
        cut = n // 9
        words = rng.integers(0, 2**63, n + cut).astype(np.uint64)
        a, b = words[:n], words[cut:]
        both = n - cut
        assert 5 * both >= 4 * (2 * n - both)
        x = (near_dup_wide.fingerprint(a) ^ near_dup_wide.fingerprint(b)).view(np.uint64)
        zero = x.view(np.uint8) == 0
        prints, sizes, one, two = np.stack([x, np.zeros_like(x)]), np.array([n, n]), np.array([0]), np.array([1])
        ok = near_dup_wide.tallied(prints, sizes, one, two)[0] and near_dup_wide.may_be(one, two, sizes, prints[:, :2])[0]
        filtered += not ok
        lost += not (ok and any(all(zero[p] for p in s) for s in sets))
    assert filtered <= 5 and lost <= 30


def test_fingerprint_is_the_majority():
    def slow(hashes):
        out = []
        for w in range(8):
            ones = [0] * 64
            for h in hashes:
                x = (int(h) + w * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
                for k, byte in enumerate(x.to_bytes(8, "little")):
                    for b in range(8):
                        ones[8 * k + b] += byte >> 7 - b & 1
            out += [int(2 * n > len(hashes)) for n in ones]
        return np.packbits(out).view(np.int64).tolist()

    for text in ("", "one two three four five six seven", "a b c d e f g h i j k l m n o p"):
        assert near_dup_wide.fingerprint(near_dup_wide.shingles(text)).tolist() == slow(near_dup_wide.shingles(text))
