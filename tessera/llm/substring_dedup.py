"""Repeated passages across documents, by compact windows.

For each of a few hash functions, the minimum of every subsequence of min_words or more is described by
compact windows (l, c, r): c holds the least hash of all subsequences that start in [l, c] and end in
[c, r]. They are the nodes of the Cartesian tree of the hashes that span enough words, about 2n / t of
n positions. A single minimum may be part of a phrase that many documents hold without the passage, so the
windows of two functions that share a subsequence of min_words are met inside the document, and what they
have in common, with both minima, is a window of its own. These are joined on both minima with the earliest
document that holds them; a document that has the phrase only seldom has the other minimum beside it.

The windows of a document and an earlier one are then joined as intervals: hits on neighbouring diagonals
(a word put in or taken out moves all that follows) whose intervals overlap make one stretch, which is a
candidate. Candidates are verified on the words' shingles: stretches that agree along a diagonal are chained
over edits while the two sides' Jaccard similarity allows. Texts are shuffled once; minima that very many
documents share meet one row, never their own group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, fresh, materialized, row_hash, slices, utf8
from tessera.llm.shingles import mix, shingle_hashes, word_hashes

WIDTH = 5
_rng = np.random.default_rng(5)
_TURNS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_minima(h: np.ndarray, t: int) -> np.ndarray:
    """The minimum of each run of t values, row by row."""
    rows, n = h.shape
    pad = np.full((rows, -n % t), np.uint64(2**64 - 1))
    blocks = np.concatenate([h, pad], 1).reshape(rows, -1, t)
    ahead = np.minimum.accumulate(blocks, 2).reshape(rows, -1)
    behind = np.minimum.accumulate(blocks[:, :, ::-1], 2)[:, :, ::-1].reshape(rows, -1)
    return np.minimum(behind[:, : n - t + 1], ahead[:, t - 1 : n])


def _ranked(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes made distinct, leftmost first among equals, and the place of the least of each run of t, row by row."""
    n = h.shape[1]
    bits = np.uint64(max(1, int(n).bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    ranked = (h & ~place) | np.arange(n, dtype=np.uint64)
    return ranked, (window_minima(ranked, t) & place).astype(np.int64)


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, l, c, r) of all windows that span t positions or more in each row of hashes; among equal hashes the leftmost is the least.

    Only the minima of runs of t positions have such windows, and the nearest smaller values of such a
    minimum are minima of that kind too, so the trees are built over them alone.
    """
    if h.shape[1] < t:
        return (np.zeros(0, np.int64),) * 4
    return _windows(*_ranked(h, t))


def _windows(ranked: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, n = ranked.shape
    new = np.ones(least.shape, bool)
    new[:, 1:] = least[:, 1:] != least[:, :-1]
    spot = np.unique(least[new] + n * np.nonzero(new)[0])
    row, c = spot // n, spot % n
    values, at, left, right = ranked[row, c].tolist(), c.tolist(), [0] * len(c), [n - 1] * len(c)
    edges = np.searchsorted(row, np.arange(rows + 1)).tolist()
    for first, last in zip(edges[:-1], edges[1:]):
        stack: list[int] = []
        for i in range(first, last):
            v = values[i]
            while stack and values[stack[-1]] > v:
                right[stack.pop()] = at[i] - 1
            left[i] = at[stack[-1]] + 1 if stack else 0
            stack.append(i)
    return row, np.array(left, np.int64), c, np.array(right, np.int64)


def common_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, l, c, d, r): what the windows of rows 2 i and 2 i + 1 have in common, for each run of t positions that both hold.

    All subsequences from [l, min(c, d)] to [max(c, d), r] have their least hash of one row at c and of the other at d.
    """
    rows, n = h.shape
    if n < t:
        return (np.zeros(0, np.int64),) * 5
    ranked, least = _ranked(h, t)
    row, left, c, right = _windows(ranked, least)
    span = np.zeros((2, rows, n), np.int64)
    span[0, row, c], span[1, row, c] = left, right
    one, other = least[::2], least[1::2]
    new = np.ones(one.shape, bool)
    new[:, 1:] = (one[:, 1:] != one[:, :-1]) | (other[:, 1:] != other[:, :-1])
    pair = np.nonzero(new)[0]
    c, d = one[new], other[new]
    return pair, np.maximum(span[0, 2 * pair, c], span[0, 2 * pair + 1, d]), c, d, np.minimum(span[1, 2 * pair, c], span[1, 2 * pair + 1, d])


_WINDOWS_SQL = "key long, doc long, fn int, c int, l int, r int"


def windows(docs: DataFrame, id_col: str, text_col: str, t: int, functions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_hashes(word_hashes(text), WIDTH)
                if len(s) < t:
                    continue
                h = mix(s * _TURNS[:functions, None])
                f, l, c, d, r = common_windows(h, t)
                key = mix(mix(h[2 * f, c] + f.astype(np.uint64)) + h[2 * f + 1, d])
                for col, x in zip(cols, (key.view(np.int64), np.full(len(c), doc), 1 << f, c, l, r)):
                    col.append(x)
            types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col).astype(kind.to_pandas_dtype()) if col else [], kind) for col, kind in zip(cols, types)], names=["key", "doc", "fn", "c", "l", "r"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), utf8(F.col(text_col)).alias("text_bytes")).mapInArrow(run, _WINDOWS_SQL)


_CANDIDATES_SQL = "doc long, source long, least int, most int, lo int, hi int"


def candidates(found: DataFrame, t: int, agree: int, slack: int) -> DataFrame:
    """(doc, source, least, most, lo, hi): stretches of a document where enough functions see an earlier one, on the diagonals from least to most."""
    shared = found.groupBy("key").agg(F.min(F.struct("doc", "c")).alias("first"), F.max("doc").alias("last")).where("first.doc < last")
    shared = materialized(shared.select("key", F.col("first.doc").alias("source"), F.col("first.c").alias("source_c")))  # a join of its own can be dealt anew where a key is hot
    hits = found.join(shared, "key").where("doc > source").select("doc", "source", (F.col("c") - F.col("source_c")).alias("shift"), "fn", "l", "r")
    seen = hits.groupBy("doc", "source").agg(F.bit_or("fn").alias("fns"), F.collect_list(F.struct("shift", "fn", "l", "r")).alias("hits"))  # no more than the document has windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy()
            shift, fn, l, r = (flat.field(c).to_numpy().astype(np.int64) for c in ("shift", "fn", "l", "r"))
            of, cut = stretches(np.repeat(np.arange(batch.num_rows), lengths), shift, fn, l, r, slack)
            good = (np.bitwise_count(cut[0]) >= agree) & (cut[4] - cut[3] + 1 >= t)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(of[good])) for i in (0, 1)), *(pa.array(x[good].astype(np.int32)) for x in cut[1:])], names=["doc", "source", "least", "most", "lo", "hi"])

    return seen.where(F.bit_count("fns") >= agree).select("doc", "source", "hits").mapInArrow(run, _CANDIDATES_SQL)


def stretches(pair: np.ndarray, shift: np.ndarray, fn: np.ndarray, l: np.ndarray, r: np.ndarray, slack: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Unions of overlapping intervals [l, r] on neighbouring diagonals of one pair: (pair, (functions, least shift, most shift, lo, hi))."""
    order = np.lexsort((shift, pair))
    pair, shift, fn, l, r = (x[order] for x in (pair, shift, fn, l, r))
    lane = np.cumsum(np.append(True, (pair[1:] != pair[:-1]) | (shift[1:] - shift[:-1] > slack)))
    order = np.lexsort((l, lane))
    pair, shift, fn, l, r, lane = (x[order] for x in (pair, shift, fn, l, r, lane))
    far = np.maximum.accumulate(r + (lane << 33)) - (lane << 33)  # the farthest end so far in this lane
    first = np.flatnonzero(np.append(True, (lane[1:] != lane[:-1]) | (l[1:] > far[:-1] + 1)))
    return pair[first], (np.bitwise_or.reduceat(fn, first), np.minimum.reduceat(shift, first), np.maximum.reduceat(shift, first), l[first], np.maximum.reduceat(r, first))


def agreeing(a: np.ndarray, b: np.ndarray, at: int) -> list[list[int]]:
    """Runs along diagonals that cover all of a that b holds: [from in a, to in a, from in b, to in b, length].

    Where b holds a value several times, a run starts at the one nearest to the last run's diagonal (first: a's position less `at`) or at the first one, whichever goes on longer.
    """
    order = np.argsort(b, kind="stable")
    lows, highs = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    hits = np.flatnonzero(highs > lows)
    out: list[list[int]] = []
    i = 0
    while (k := int(np.searchsorted(hits, i))) < len(hits):
        i = int(hits[k])
        spots = order[lows[i] : highs[i]]
        starts = {int(spots[0]), int(spots[min(int(np.searchsorted(spots, i - at)), len(spots) - 1)])}
        n, j = max((_going_on(a, b, i, j), j) for j in starts)
        out.append([i, i + n, j, j + n, n])
        at, i = i - j, i + n
    return out


def _going_on(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How far a from i and b from j agree."""
    n, step, most = 0, 64, min(len(a) - i, len(b) - j)
    while n < most:
        end = min(most, n + step)
        differ = np.flatnonzero(a[i + n : i + end] != b[j + n : j + end])
        if len(differ):
            return n + int(differ[0])
        n, step = end, 2 * step
    return n


def diagonal(a: np.ndarray, b: np.ndarray, at: int) -> list[list[int]]:
    """Like agreeing(), on the one diagonal where a's position less `at` is b's."""
    s = max(0, at)
    n = max(0, min(len(a) - s, len(b) - (s - at)))
    same = np.zeros(n + 2, np.int8)
    same[1:-1] = a[s : s + n] == b[s - at : s - at + n]
    edge = np.flatnonzero(np.diff(same)).tolist()
    return [[s + i, s + j, s - at + i, s - at + j, j - i] for i, j in zip(edge[::2], edge[1::2])]


def joined(runs: list[list[int]], t: int, percent: int) -> list[tuple[int, int, int]]:
    """(from, to, from in b) of runs joined over what lies between them while shared / (both lengths - shared) is percent / 100 or more; of t or more only."""
    out: list[list[int]] = []
    for run in runs:
        if out and run[2] < out[-1][3] and run[4] < out[-1][4] and run[4] < 5:
            continue  # a chance match that goes back
        out.append(run)
        while len(out) > 1:
            first, last = out[-2], out[-1]
            same = first[4] + last[4]
            if last[2] < first[3] or 100 * same < percent * (last[1] - first[0] + last[3] - first[2] - same):
                break
            out[-2:] = [[first[0], last[1], first[2], last[3], same]]
    return [(x[0], x[1], x[2]) for x in out if x[1] - x[0] >= t]


def similar_stretches(a: np.ndarray, b: np.ndarray, at: int, t: int, percent: int, one: bool = False) -> list[tuple[int, int, int]]:
    """(from, to, from in b) of the longest stretches of a, t or more, that b holds with edits.

    one: the diagonal of `at` is tried first, and is enough where b holds almost nothing of what it leaves.
    """
    if one:
        found = joined(diagonal(a, b, at), t, percent)
        left = np.ones(len(a), bool)
        for s, e, _ in found:
            left[s:e] = False
        rest = a[left]
        if len(rest) < WIDTH or np.isin(rest[::3], b).sum() < 2:
            return found
    return joined(agreeing(a, b, at), t, percent)


_PART_SQL = "doc long, source long, least int, most int, lo int, side int, from int, rid long, shingles binary"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, percent: int = 80, functions: int = 6, agree: int = 1, slack: int = 12, deal: int = 32) -> DataFrame:
    """(doc, rid, start, n_words, source, source_start): passages of an earlier document that doc repeats.

    A passage has min_words words or more, and its five-word shingles and those of the earlier passage
    have a similarity of percent / 100 or more, words put in, taken out or replaced; words are compared
    with A-Z lower-cased. start counts words from 0. The earlier document has a smaller id, so the first
    occurrence is never listed. Repeats inside one document, texts that are null or shorter and rows with
    a null id give nothing; rows that repeat an id with one text are one document. Where rows of one id
    have different texts, passages are given for one of them, of the least rid; the others stay whole.
    Where a passage lies inside another of the same text with the same or a smaller source, the outer one
    is listed, so the smallest source found for a passage always is. An empty table gives no rows.

    functions: an even number; windows of two make one signature, and `agree` of the signatures must see a
    stretch. slack: words by which neighbouring diagonals of one stretch may differ. deal: requests to one row of a text.
    """
    t = min_words - WIDTH + 1
    found = materialized(windows(docs, id_col, text_col, t, functions))
    pairs = materialized(candidates(found, t, agree, slack))
    asks = pairs.select(F.col("doc").alias("node"), F.lit(0).alias("side"), "*").union(
        pairs.select(F.col("source").alias("node"), F.lit(1).alias("side"), "*")
    )
    sizes = materialized(asks.groupBy("node").agg(F.count("*").alias("n")))
    part = F.pmod(F.xxhash64("doc", "source", "least", "lo"), F.ceil(F.col("n") / deal))
    dealt = materialized(asks.join(sizes, "node").withColumn("part", part))  # written, so that a hot node's requests are grouped by part and not by node
    asked = ("doc", "source", "least", "most", "lo", "hi", "side")
    listed = materialized(dealt.groupBy("node", "part").agg(F.collect_list(F.struct(*asked)).alias("asked")))  # about `deal` each

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, ends = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy().cumsum().tolist()
            columns = [flat.field(c).to_numpy() for c in asked]
            rows, size = [], 0
            for i, rid in enumerate(batch.column(0).to_pylist()):
                s = (shingle_hashes(word_hashes(batch.column(1)[i].as_py()), WIDTH) >> np.uint64(32)).astype(np.uint32)
                here = slice(ends[i - 1] if i else 0, ends[i])
                for doc, source, least, most, lo, hi, side in zip(*(c[here].tolist() for c in columns)):
                    a, b = (max(0, lo - most), hi + 1 - least) if side else (lo, hi + 1)
                    part = s[a:b].tobytes()
                    rows.append((doc, source, least, most, lo, side, a, rid, part))
                    size += len(part)
                    if size > 1 << 23:
                        yield pack(rows)
                        rows, size = [], 0
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 9
        types = (pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["doc", "source", "least", "most", "lo", "side", "from", "rid", "shingles"])

    own = docs.select(F.col(id_col).cast("long").alias("node"), row_hash(F.col(text_col)).alias("rid"), utf8(F.col(text_col)).alias("text_bytes"))
    parts = own.join(listed, "node").select("rid", "text_bytes", "asked").mapInArrow(cut, _PART_SQL)
    sides = parts.groupBy("doc", "source", "least", "most", "lo").agg(
        F.min(F.when(F.col("side") == 0, F.struct("rid", "shingles"))).alias("a"), F.min(F.when(F.col("side") == 1, F.struct("rid", "from", "shingles"))).alias("b")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            heads = zip(*(batch.column(c).to_pylist() for c in range(7)))
            for (doc, source, least, most, lo, rid, start), x, y in zip(heads, batch.column(7), batch.column(8)):
                a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if len(a) and len(b):
                    out += [(doc, rid, lo + s, e - s + WIDTH - 1, source, start + at) for s, e, at in similar_stretches(a, b, least + start - lo, t, percent, least == most)]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "rid", "start", "n_words", "source", "source_start"])

    shown = sides.select("doc", "source", "least", "most", "lo", "a.rid", "b.from", F.col("a.shingles").alias("x"), F.col("b.shingles").alias("y"))
    rows = shown.mapInArrow(verify, "doc long, rid long, start long, n_words long, source long, source_start long")
    return outermost(rows)


def outermost(rows: DataFrame) -> DataFrame:
    """The passages that lie inside no other one of the same text whose source is the same or smaller.

    Rows of a text stream by, the smallest source first; only the outlines of those before are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, starts, ends = None, [], []  # passages so far of which none lies in another: both lists ascend
        for batch in batches:
            keep = []
            for doc, rid, start, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (doc, rid) != text:
                    text, starts, ends = (doc, rid), [], []
                end, at = start + n, bisect_right(starts, start)
                keep.append(not at or ends[at - 1] < end)
                if keep[-1]:
                    covered = slice(bisect_left(starts, start), bisect_right(ends, end))
                    starts[covered], ends[covered] = [start], [end]
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = rows.repartition("doc", "rid").sortWithinPartitions("doc", "rid", "source", "start", F.col("n_words").desc(), "source_start")
    return ordered.mapInArrow(run, rows.schema)


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the given (start, n_words), which may overlap."""
    b = np.frombuffer(text, np.uint8)
    blank = np.isin(b, list(BLANKS))
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    keep = np.ones(len(b), bool)
    for start, n in spans:
        last = min(start + n, len(starts)) - 1
        if start <= last:
            keep[starts[start] : ends[last]] = False
    return b[keep].tobytes()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """docs, every column as it was but the text without passages that an earlier document holds; see repeated_passages()."""
    doc, rid, cut = fresh(docs, "doc"), fresh(docs, "rid"), fresh(docs, "spans")
    spans = repeated_passages(docs, id_col, text_col, **rule).groupBy(F.col("doc").alias(doc), F.col("rid").alias(rid)).agg(F.collect_set(F.struct("start", "n_words")).alias(cut))
    marked = docs.join(spans, (docs[id_col].cast("long") == F.col(doc)) & (row_hash(docs[text_col]) == F.col(rid)), "left")
    names = [c for c in docs.columns if c != text_col]
    schema = docs.select(*names, F.col(text_col).cast("string").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t if not s else without_words(t.encode(), [(x["start"], x["n_words"]) for x in s]).decode() for t, s in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, text_col])

    return marked.select(*[F.col(c) for c in names], F.col(text_col), cut).mapInArrow(run, schema).select(*docs.columns)
