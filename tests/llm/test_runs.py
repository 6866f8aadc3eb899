import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import runs
from tessera.llm.shingles import word_hashes


def plain_runs(words):
    """All runs by their definition, in quadratic time."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_tail(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_report(doc_id, text):
    words = plain_tail(doc_id, (text or "").encode().split())
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join("%d,%d,%d\n" % r for r in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_small_alphabets(s):
    assert [tuple(r) for r in runs.maximal_runs(s).tolist()] == plain_runs(s)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 6)), max_size=8))
def test_runs_of_words_between_other_words(parts):
    words = [b"%d" % x for root, times in parts for x in root * times]
    assert [tuple(r) for r in runs.runs_of_words(words, word_hashes(b" ".join(words), fold=False)).tolist()] == plain_runs(words)


def test_agreement_equals_plain_comparison():
    rng = random.Random(5)
    s = [rng.randrange(3) for _ in range(300)]
    agree = runs.Agreement([*s, 3], 4)
    pairs = [(i, j) for i in range(0, 301, 3) for j in range(i + 1, 301, 2)]
    plain = [next((k for k in range(301) if max(i, j) + k >= 300 or s[i + k] != s[j + k])) for i, j in pairs]
    got = agree(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    assert got.tolist() == plain


def test_long_runs_take_time_in_proportion():
    rng = random.Random(1)
    took = []
    for n in (20_000, 80_000):
        root = [rng.randrange(50) for _ in range(n // 7)]
        began = time.time()
        found = runs.maximal_runs(root * 7)
        took.append(time.time() - began)
        assert [0, len(root) * 7, len(root)] in found.tolist()
    assert took[1] < 12 * took[0]


def test_query_against_its_definition(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [rng.choice("a b c dd é ü".split()) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice("xyz") for _ in range(rng.randrange(1, 5))] * rng.randrange(3, 8)
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    rows += [(None, "a a a a a a a"), (1000, None), (1001, ""), (1002, " \n"), (-7, "b a " * 9), (5, rows[5][1]), (5, "x " * 30), (1003, "A a " * 8)]
    docs = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in rows], "doc_id long, text string, h int, words int, n string")
    got = runs.run_report(runs.periodic_runs(runs.with_periodic_tails(docs))).drop("n_words").collect()
    want = [(i, *plain_report(i, t)) if i is not None else (None, 1, 0, 7, 1, 7000, *plain_report(1, "")[5:]) for i, t in rows]
    null = [r for r in got if r.doc_id is None]
    assert len(null) == 1 and tuple(null[0])[1:6] == (1, 0, 7, 1, 7000)
    assert null[0].collapsed_sha256 == hashlib.sha256(b"a").hexdigest()
    key = lambda r: (r[0], r[-1], r[-2])
    assert sorted((tuple(r) for r in got if r[0] is not None), key=key) == sorted((r for r in want if r[0] is not None), key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runs.run_report(runs.periodic_runs(runs.with_periodic_tails(docs))).collect() == []


@pytest.mark.parametrize("words", [[], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"]])
def test_shortest_runs(words):
    words = [w.encode() for w in words]
    assert [tuple(r) for r in runs.runs_of_words(words, word_hashes(b" ".join(words), fold=False)).tolist()] == plain_runs(words)
