"""Periodic runs of words: stretches that repeat a period again and again and cannot be extended.

A document's words become numbers. Two suffix trees, of the sequence and of its reversal, are built with
Ukkonen's algorithm; the Euler tour of each with range minima in blocks gives, in constant time, how far two
places agree to the right and to the left. Candidates are the longest Lyndon words at each place, under the
order of the symbols and under its reverse: every run has such a word as a root of its period (the runs
theorem), and both arrays fall out of the suffixes' order in the tree. Each candidate is extended both ways;
those that reach the asked length are the runs, with their smallest period, since a Lyndon word has none.

Before that, words that cannot be part of a run are set aside, exactly: in a run of at least four periods and
six words every three neighbouring words occur three times or more, so only stretches made of such triples
go into the trees, kept apart by symbols of their own. Work is one pass over the rows, without a shuffle;
trees hold the stretches of one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, utf8
from tessera.llm.shingles import shingle_hashes, word_hashes

#: Entries of an Euler tour whose minima are kept together.
BLOCK = 16


def suffix_tree(s: list[int], symbols: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's tree of s, whose last symbol occurs once.

    Returns edges as {node * symbols + first symbol: child}, where each node's edge starts and stops in s,
    and the leaves in the order of their suffixes. The root is 0.
    """
    n = len(s)
    start, stop, link, leaves = [0], [0], [0], []
    edges: dict[int, int] = {}
    get = edges.get
    node = at = matched = 0
    open_suffixes = 0
    for i, c in enumerate(s):
        unlinked = 0
        open_suffixes += 1
        while open_suffixes:
            if not matched:
                at = i
            key = node * symbols + s[at]
            below = get(key)
            if below is None:
                edges[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                stop.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                begin = start[below]
                span = stop[below] - begin
                if matched >= span:
                    at += span
                    matched -= span
                    node = below
                    continue
                if s[begin + matched] == c:
                    matched += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                middle = len(start)
                edges[key] = middle
                edges[middle * symbols + s[begin + matched]] = below
                edges[middle * symbols + c] = middle + 1
                leaves.append(middle + 1)
                start += [begin, i]
                stop += [begin + matched, n]
                link += [0, 0]
                start[below] = begin + matched
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            open_suffixes -= 1
            if node:
                node = link[node]
            elif matched:
                matched -= 1
                at = i - open_suffixes + 1
    return edges, start, stop, leaves


class Agreement:
    """How far two suffixes of a sequence agree, by the lowest common ancestor in its suffix tree."""

    def __init__(self, s: list[int], symbols: int):
        edges, start, stop, leaves = suffix_tree(s, symbols)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))[np.argsort(keys)]
        keys.sort()
        first = np.searchsorted(keys, np.arange(len(start) + 1) * symbols)
        del edges
        tour, depth = self._tour(child.tolist(), first.tolist(), (np.array(stop) - np.array(start)).tolist())
        where = np.zeros(len(start), np.int64)
        where[tour] = np.arange(len(tour))
        self.where = where[leaves]
        #: Each suffix's place in the order of all suffixes.
        self.order = np.empty(len(leaves), np.int64)
        self.order[np.argsort(self.where)] = np.arange(len(leaves))
        blocks = -(-len(depth) // BLOCK)
        low = np.full(blocks * BLOCK, 1 << 40, np.int64)
        low[: len(depth)] = depth
        self.depth = low
        self.to_right = np.minimum.accumulate(low.reshape(-1, BLOCK)[:, ::-1], 1)[:, ::-1].ravel()
        self.to_left = np.minimum.accumulate(low.reshape(-1, BLOCK), 1).ravel()
        self.levels = [self.to_right[::BLOCK]]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    @staticmethod
    def _tour(child: list[int], first: list[int], span: list[int]) -> tuple[list[int], list[int]]:
        """Nodes of the Euler tour and the length of the path to each; children in the order of their symbols."""
        tour, depths, above = [], [], []
        following = first[:]
        node = depth = 0
        while True:
            tour.append(node)
            depths.append(depth)
            k = following[node]
            if k < first[node + 1]:
                following[node] = k + 1
                above.append((node, depth))
                node = child[k]
                depth += span[node]
            elif above:
                node, depth = above.pop()
            else:
                return tour, depths

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the agreement of suffixes i and j, pairwise different."""
        a, b = self.where[i], self.where[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // BLOCK, b // BLOCK
        out = np.minimum(self.to_right[a], self.to_left[b])
        same = np.flatnonzero(left == right)
        if len(same):
            low, last = self.depth[a[same]], b[same]
            for step in range(1, BLOCK):
                low = np.minimum(low, self.depth[np.minimum(a[same] + step, last)])
            out[same] = low
        far = np.flatnonzero(right - left > 1)
        if len(far):
            lo, hi = left[far] + 1, right[far]
            level = np.frexp((hi - lo).astype(float))[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                row = self.levels[k]
                out[far[own]] = np.minimum(out[far[own]], np.minimum(row[lo[own]], row[hi[own] - (1 << k)]))
        return out


def _next_below(values: list[int]) -> np.ndarray:
    """The place of the next smaller value after each one; len(values) where there is none."""
    out, waiting = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out)


def maximal_runs(s: list[int], times: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) of the runs of s, by start and period: length >= max(least, times * period).

    times is 2 or more. Symbols are integers from 0.
    """
    n = len(s)
    if n < least:
        return np.zeros((0, 3), np.int64)
    symbols = max(s) + 2
    right = Agreement([*s, symbols - 1], symbols)
    order = right.order.tolist()
    place = np.arange(n + 1)
    # the second order is the first one turned round: its next smaller suffix is the next greater one
    ends = np.concatenate([_next_below(order), _next_below([-x for x in order])])
    start = np.concatenate([place, place])
    inside = ends < n
    start, period = start[inside], (ends - start)[inside]
    agree = right(start, start + period)
    del right
    # a first look without the left side: it adds less than a period to a root that starts in the first one
    hopeful = agree + 2 * period > np.maximum(least, times * period)
    start, period, agree = start[hopeful], period[hopeful], agree[hopeful]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    left = Agreement([*s[::-1], symbols - 1], symbols)
    back = left(n - start, n - start - period)  # of the places before both, from right to left
    length = back + period + agree
    found = np.column_stack([start - back, length, period])[length >= np.maximum(least, times * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_words(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """maximal_runs of a document's words: at least six of them and four periods.

    hashes only set stretches aside that hold no run; the words themselves are compared.
    """
    none = np.zeros((0, 3), np.int64)
    if len(words) < 6:
        return none
    triples = shingle_hashes(hashes, 3)
    _, kind, count = np.unique(triples, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[kind] >= 3)
    if len(often) < 4:
        return none
    covered = np.zeros(len(words) + 1, bool)
    for k in range(3):
        covered[often + k] = True
    edge = np.flatnonzero(np.diff(covered, prepend=False))
    begins, ends = edge[::2], edge[1::2]
    own = ends - begins >= 6
    ids: dict[bytes, int] = {}
    s: list[int] = []
    places: list[np.ndarray] = []
    for k, (a, b) in enumerate(zip(begins[own].tolist(), ends[own].tolist())):
        s += [ids.setdefault(w, len(ids)) for w in words[a:b]]
        s.append(ids.setdefault(k, len(ids)))  # type: ignore[call-overload, arg-type]  # no word is an int
        places.append(np.arange(a, b + 1))
    if not s:
        return none
    found = maximal_runs(s[:-1])
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


SCHEMA = "doc {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, runs, collapsed): each row's runs by start and period, and its words without repeats.

    A run is a stretch of words with smallest period q and length of at least max(6, 4q) that neither
    neighbour extends. collapsed joins by one space the words that no run holds after its first q words.
    A null or empty text has no words, no runs and an empty collapsed text. A null id stays null; repeated
    rows are each answered; other columns, whatever their names, are not looked at. An empty table gives
    an empty result. Runs that share a start come in the order of their periods.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, 128):
            counts, sizes, found, collapsed = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                counts.append(len(words))
                runs = runs_of_words(words, word_hashes(text, fold=False))
                if len(runs):
                    words = [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
                    found.append(runs)
                sizes.append(sizes[-1] + len(runs))
                collapsed.append(b" ".join(words))
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            entries = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries).cast(item)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc"), utf8(F.col(text_col)).alias("run_bytes")).mapInArrow(run, SCHEMA.format(id=kind))


def run_report(found: DataFrame) -> DataFrame:
    """What periodic_runs found, as one line a document: number, the run of the greatest exponent, digests."""
    # exact order of length / period: cross products of the two sides
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best),
    )
    line = lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    told = found.withColumn("best", best)
    return told.select(
        F.col("doc").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text of each row, with a periodic tail planted in the texts of a tenth of the ids.

    With h the CRC-32 of the decimal id, g = floor(h / 10) and n words: where h is divisible by 10 and n is
    not 0, each word i >= a = g % n becomes word a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)),
    and the words are joined by one space. A null id and a null or empty text are left as they are; repeated
    rows change alike, and an empty table stays empty.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.crc32(F.col("id").cast("string").cast("binary")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = own.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return own.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias(text_col))
