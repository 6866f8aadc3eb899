import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_collocations(rows, least=30, first=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in plain_pieces(text):
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for q, b in candidates.items()):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Dé", "é", "ü\x1c", "z'", " ", "\xa0x", "ß"]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(["a b c", "B c é ß", "Dé z'", rng.choice(words)]))
            parts.append(rng.choice([" ", "  ", "\t", " ", ". ", "\n", "!", "\x0b", " ; "]))
        rows.append((rng.choice(["en", "fr", None, "e n"]), "".join(parts)))
    return rows + [("en", None), ("en", ""), (None, " \t"), ("xx", "..."), ("en", "a " * 300), ("en", "a " * 300)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"heavy_at": 3, "bits": 16}), (3, {"first": 7, "least": 5}), (4, {"share": 40, "least": 10})])
def test_equals_the_definition(spark, seed, options):
    rows = corpus(seed)
    docs = spark.createDataFrame([(lang, t, 0, 1, "x") for lang, t in rows], "lang string, text string, n int, prefix int, next string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, **options).collect()))
    plain = {k: v for k, v in options.items() if k in ("least", "first", "share")}
    want = plain_collocations(rows, **plain)
    assert want and got == want


def test_stripes_hold_extensions():
    text = pa.array(["x y. x y x", "Y x"], pa.large_string())
    everything = np.full(1 << 13, 255, np.uint8)
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = phrases.count_stripes("en", text, 2, everything, 16, nothing).to_pylist()
    assert {r["prefix"]: dict(zip(r["next"], r["n"])) for r in found} == {"x": {"y": 2}, "y": {"x": 2}}
    one = phrases.count_stripes("en", text, 1, None, 16, nothing).to_pylist()
    assert {w: n for r in one for w, n in zip(r["next"], r["n"])} == {"": 7, "x": 4, "y": 3}


def test_heavy_prefixes_lie_in_pieces():
    text = pa.array([" ".join(f"the w{i}" for i in range(200))], pa.large_string())
    everything = np.full(1 << 13, 255, np.uint8)
    ids, words = phrases.tokenized(text)
    one = phrases._phrase_hashes(phrases.word_hashes(b"the"), 1, phrases._lang_hash("en"))
    rows = phrases.count_stripes("en", text, 2, everything, 16, (one, np.array([4]))).to_pylist()
    pieces = [r for r in rows if r["prefix"] == "the"]
    assert sorted(r["piece"] for r in pieces) == [0, 1, 2, 3]
    assert sum(sum(r["n"]) for r in pieces) == 200 and max(len(r["next"]) for r in pieces) < 120


def test_large_counts_stay_exact(spark):
    """2,000,000 * a passes 64 bits."""
    big = 9_000_000_000_000_000_000 // 3
    one = spark.createDataFrame([("en", "", "x", big), ("en", "", "y", big + 1)], "lang string, prefix string, next string, n long")
    two = spark.createDataFrame([("en", "x", "y", big - 7)], one.schema)
    words = one.selectExpr("lang", "next AS phrase", "n")
    pairs = two.selectExpr("lang", "prefix || ' ' || next AS phrase", "n")
    n_of = spark.createDataFrame([("en", big * 2)], "lang string, n_words long")
    found = phrases._scored([(one, words), (two, pairs)], n_of, 80, 10, 2_000_000).collect()
    assert [tuple(r) for r in found] == [("en", 1, "x y", big - 7, big, big + 1, 2 * big, 2_000_000 * (big - 7) // (2 * big + 1))]


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect() == []
