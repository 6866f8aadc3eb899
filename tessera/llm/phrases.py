"""Phrase collocations by the stripes pattern.

For each number of words m a task keys the first m - 1 words of every place by an associative counter of
the word that follows. These stripes are shuffled by prefix and merged elementwise. A merged stripe gives the
counts of all extensions, and the largest of them decides whether the prefix is subsumed; a prefix's total is
its own entry in the stripe one word shorter, so the empty prefix's stripe holds the words and, under the
empty word, their number. For the other side the same entries are grouped by what follows their first word.
Levels go from one word to four, and a level counts only what can still be frequent: both parts of m - 1
words must be. Tasks learn that from a bitmap of fixed size (hashes, so it errs on one side only, towards
more work); the counts themselves are of the words.

A task counts some megabytes of text at a time, in arrays. Stripes of prefixes so common that one task would
get too much are dealt to several pieces by the next word; at most 65,536 prefixes a level can be such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialized, slices
from tessera.llm.shingles import mix, shingle_hashes, word_hashes

#: Bytes of text that a task counts at a time.
AT_ONCE = 16 << 20
#: Pieces of the stripe of the empty prefix, which counts single words.
ROOT_PIECES = 1024
STRIPES = "lang string, prefix string, piece int, next array<string>, n array<long>"


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


def tokenized(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Word numbers of all texts in a row and the words; number 0 ends a piece, and every text."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\n-\r]", " . ")
    closed = pc.binary_join_element_wise(pa.scalar(".", marked.type), marked, pa.scalar(".", marked.type), pa.scalar(" ", marked.type))
    coded = pc.list_flatten(pc.ascii_split_whitespace(closed)).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    return (ids if empty < 0 else ids[ids != empty]), coded.dictionary


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _phrase_hashes(words: np.ndarray, m: int, lang: np.uint64) -> np.ndarray:
    """Hashes of the phrases of m words at all places."""
    return mix(shingle_hashes(words, m) + lang) if len(words) >= m else np.zeros(0, np.uint64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def count_stripes(lang: str, texts: pa.Array, m: int, frequent: np.ndarray | None, bits: int, heavy: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch | None:
    """Stripes of one language's texts: one row for each prefix of m - 1 words and piece."""
    ids, words = tokenized(texts)
    inside = ids != 0
    size = len(words)
    lookup = pa.concat_arrays([words, pa.array([""], words.type)])
    plain = pc.if_else(pc.equal(words, pa.scalar("", words.type)), pa.scalar(".", words.type), words)
    hashes = word_hashes(" ".join(plain.to_pylist()).encode(), fold=False)
    if m == 1:
        count = np.bincount(ids[inside], minlength=size)
        following = np.flatnonzero(count)
        if not len(following):
            return None
        owner, n, at = np.zeros(len(following) + 1, np.int64), np.append(count[following], count[following].sum()), None
        pieces = np.append((hashes[following] % np.uint64(ROOT_PIECES)).astype(np.int64), 0)
        following = np.append(following, size)  # the empty word's entry is the number of words
    else:
        stops = np.flatnonzero(~inside)
        left = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
        h = _phrase_hashes(hashes[ids], m - 1, _lang_hash(lang))
        places = _places(h, bits)
        good = left[: len(h)] >= m - 1
        good &= (frequent[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        # an extension counts where the words after the first are frequent too
        at = np.flatnonzero(good[:-1] & good[1:] & (left[: max(0, len(h) - 1)] >= m))
        if not len(at):
            return None
        key = ids[at]
        for k in range(1, m - 1):
            key = (key if k == 1 else _ranks(key)) * size + ids[at + k]
        _, first, prefix = np.unique(key, return_index=True, return_inverse=True)
        code, n = np.unique(prefix * size + ids[at + m - 1], return_counts=True)
        owner, following = code // size, code % size
        at = at[first]
        pieces = np.zeros(len(code), np.int64)
        if len(heavy[0]):
            found = np.minimum(np.searchsorted(heavy[0], h[at]), len(heavy[0]) - 1)
            parts = np.where(heavy[0][found] == h[at], heavy[1][found], 1)
            pieces = (hashes[following] % parts[owner].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((pieces, owner))
    owner, pieces, following, n = owner[order], pieces[order], following[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pieces[1:] != pieces[:-1])]))
    offsets = pa.array(np.append(begins, len(owner)), pa.int32())
    own = owner[begins]
    if at is None:
        prefix_text = pa.array([""] * len(own), pa.string())
    else:
        parts = [lookup.take(pa.array(ids[at[own] + k])) for k in range(m - 1)]
        prefix_text = (parts[0] if m == 2 else pc.binary_join_element_wise(*parts, pa.scalar(" ", words.type))).cast(pa.string())
    columns = [
        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(own), np.int32))),
        prefix_text,
        pa.array(pieces[begins], pa.int32()),
        pa.ListArray.from_arrays(offsets, lookup.take(pa.array(following)).cast(pa.string())),
        pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "piece", "next", "n"])


def _stripes(docs: DataFrame, m: int, frequent, bits: int, heavy) -> DataFrame:
    """Stripes of (lang, text) rows, counted in each task; frequent and heavy are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value, np.uint8) if frequent else None
        hot = heavy.value if heavy else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        waiting, held = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting)
            for lang in pc.unique(rows["lang"]).to_pylist():
                texts = rows.filter(pc.equal(rows["lang"], lang))["text"].cast(pa.large_string()).combine_chunks()
                if (out := count_stripes(lang, texts, m, known, bits, hot)) is not None:
                    yield from slices([out], 20_000)

        for batch in slices(batches, 256):
            waiting.append(batch)
            held += batch.nbytes
            if held >= AT_ONCE:
                yield from counted()
                waiting, held = [], 0
        if waiting:
            yield from counted()

    return docs.mapInArrow(run, STRIPES)


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, next, n): stripes merged elementwise, without the entries below least; the empty word's stay."""
    dealt = stripes.repartition("lang", "prefix", "piece")
    entries = dealt.select("lang", "prefix", "piece", F.inline(F.arrays_zip("next", F.col("n").alias("n"))))
    summed = entries.groupBy("lang", "prefix", "piece", "next").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") >= least) | (F.col("next") == "")).drop("piece")


def _hashed(phrases: DataFrame, m: int) -> DataFrame:
    """(h, n) of (lang, phrase, n): the hashes that tasks compute from the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_hashes(" ".join(batch.column(1).to_pylist()).encode(), fold=False)
            langs = np.array([_lang_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            own = mix(shingle_hashes(words, m)[::m] + langs) if len(words) else words
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), batch.column(2)], names=["h", "n"])

    return phrases.select("lang", "phrase", "n").mapInArrow(run, "h long, n long")


def _bitmap(hashed: DataFrame, bits: int) -> bytes:
    """The set of the hashes' leading bits, 2^bits of them whatever the number of rows."""
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = hashed.groupBy(F.floor(place / 32768).alias("at")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("own"))
    out = np.zeros((max(1, (1 << bits) // 32768), 4096), np.uint8)
    for row in rows.collect():  # at most 2^bits / 32768
        out[row["at"]] = np.frombuffer(row["own"], np.uint8)
    return out.tobytes()


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, share: int = 80,
    first: int = 2000, scale: int = 2_000_000, bits: int = 26, heavy_at: int = 100_000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z) and split at [.,;:!?\\x0A-\\x0D] into pieces and those at blanks into words. A
    candidate occurs a >= least times inside pieces, overlaps included; its score is the lowest over its cuts
    into a part seen l times and a rest seen r times of floor(scale * a / (l + r)), the shortest first part
    winning ties. Candidates inside a longer one with 100 * f(longer) >= share * a are dropped, whether or not
    the longer one is. `first` a language stay, by score, then a, both falling, then the phrase's bytes. n is
    the number of words of the language.

    A null language is `und`; a null or empty text has no words; every repeated row counts; other columns,
    whatever their names, are not looked at. An empty table, or one without frequent phrases, gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    frequent = heavy = None
    entries = []
    n_of = None
    for m in range(1, longest + 1):
        level = materialized(_merged(_stripes(rows, m, frequent, bits, heavy), least))
        if m == 1:
            n_of = level.where("next = ''").select("lang", F.col("n").alias("n_words"))
            total = n_of.agg(F.sum("n_words")).first()[0] or 0
            part = max(heavy_at, -(-total // 65_536))
        own = level.where("next <> ''").select("lang", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "n")
        entries.append((level, own))
        if m < longest:
            hashed = _hashed(own, m)
            frequent = spark.sparkContext.broadcast(_bitmap(hashed, bits))
            hot = {r["h"]: -(-r["n"] // part) for r in hashed.where(F.col("n") > part).collect()}  # at most 65,536
            keys = np.sort(np.array(list(hot), np.int64).view(np.uint64))
            heavy = spark.sparkContext.broadcast((keys, np.array([hot[int(k)] for k in keys.view(np.int64)], np.int64)))
    return _scored(entries, n_of, share, first, scale)


def _scored(entries: list[tuple[DataFrame, DataFrame]], n_of: DataFrame, share: int, first: int, scale: int) -> DataFrame:
    longest = len(entries)
    empty = entries[0][1].where("false")
    candidates, totals, longer = empty, empty, empty
    for m in range(2, longest + 1):
        level, own = entries[m - 1]
        candidates = candidates.unionByName(own)
        totals = totals.unionByName(entries[m - 2][1])
        if m > 2:
            rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
            longer = longer.unionByName(level.select("lang", F.col("prefix").alias("phrase"), "n")).unionByName(own.select("lang", rest.alias("phrase"), "n"))
    above = longer.groupBy("lang", F.col("phrase").alias("inner")).agg(F.max("n").alias("most"))
    c = candidates.alias("c")
    kept = c.join(above.alias("u"), (F.col("c.lang") == F.col("u.lang")) & (F.col("c.phrase") == F.col("u.inner")), "left")
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    kept = materialized(kept.where(F.col("most").isNull() | (wide("most") * 100 < wide("c.n") * share)).select("c.lang", "c.phrase", F.col("c.n").alias("a")))
    words = F.split("phrase", " ")
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    sides = cut.select(
        "lang", "phrase", "a", "k",
        F.inline(F.array(
            F.struct(F.lit("l").alias("side"), F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("part")),
            F.struct(F.lit("r").alias("side"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("part")),
        )),
    )
    met = sides.alias("s").join(totals.alias("t"), (F.col("s.lang") == F.col("t.lang")) & (F.col("s.part") == F.col("t.phrase")))
    both = met.groupBy("s.lang", "s.phrase", "s.a").agg(
        *[F.max(F.when((F.col("s.k") == k) & (F.col("s.side") == side), F.col("t.n"))).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"]
    )
    cuts = F.array(*[
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (l{k} + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")),
        )
        for k in range(1, longest)
    ])
    best = both.select("lang", "phrase", "a", F.array_min(F.filter(cuts, lambda x: x.isNotNull())).alias("best"))
    told = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    # first in 64 shares of a language, so that no task sorts all its candidates
    share_of = told.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    short = share_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).where(F.col("rank") <= first)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= first)
    n = n_of.withColumnRenamed("lang", "of")
    return ranked.join(n, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
