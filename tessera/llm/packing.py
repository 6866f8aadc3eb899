"""Packing documents into token sequences: bounded-space online best-fit.

Each task packs its own partition in one pass, without a shuffle: open sequences are held in a bitset
keyed by free space, a piece goes to the one with the least room that still fits, and when the fixed
number of open sequences is reached the fullest closes. A sequence's rows go out as it closes, so a task
holds the open ones only, whatever its partition. What a task leaves open, at most the bound, is then
packed again in the same way together with the leftovers of neighbouring partitions, as whole units.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialized, slices, utf8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, room int, group long"

_PIECE_FIELDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")), ("room", pa.int32()), ("group", pa.int64())])


class BestFit:
    """Open bins keyed by free space; at most `bound` of them."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.free_spaces = 0  # bit f: some open bin has f places left
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0
        self.closed: list[int] = []  # since the caller last emptied it

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to capacity tokens."""
        fits = self.free_spaces >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.bound:
                self.closed.append(self._take((self.free_spaces & -self.free_spaces).bit_length() - 1))  # the fullest
            own, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(own)
            self.free_spaces |= 1 << left
            self.open += 1
        else:
            self.closed.append(own)
        return own, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        own = bins.pop()
        if not bins:
            self.free_spaces &= ~(1 << free)
        self.open -= 1
        return own

    def leftovers(self) -> dict[int, int]:
        """Free space of the bins that are still open."""
        return {own: free for free, bins in enumerate(self.by_free) for own in bins}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first that holds the rest."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = 1024, bound: int = 4096, lookahead: int = 1000, spread: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its text's ids and end_id; a null or empty text is end_id alone. Documents
    of more than `capacity` tokens are cut, others stay whole. path: a rank file. bound: open sequences
    in a task. lookahead: a buffer of pieces that are put in order of length before they are placed. spread: partitions whose leftovers are packed together. Repeated rows are packed each;
    an empty table gives no rows. Sequence numbers are distinct, not gapless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        task = TaskContext.get().partitionId()
        bins = BestFit(capacity, bound)
        held: dict[int, list[tuple]] = {}  # rows of open sequences
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 9
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE_FIELDS)], schema=_PIECE_FIELDS)
            out.clear()
            return batch

        def close(own: int, room: int) -> None:
            out.extend((doc, i, start, length, crc, task << 32 | own, offset, room, task // spread) for doc, i, start, length, crc, offset in held.pop(own))

        for batch in slices(batches, 1024):
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = array("I", encode(text.decode()))
                ids.append(end_id)
                raw = memoryview(ids.tobytes())
                found += [(-length, doc, i, start, zlib.crc32(raw[4 * start : 4 * (start + length)])) for i, (start, length) in enumerate(cut(len(ids), capacity))]
            for a in range(0, len(found), lookahead):  # longest first inside a short run fills tighter
                for minus, doc, i, start, crc in sorted(found[a : a + lookahead], key=lambda x: x[0]):
                    own, offset = bins.put(-minus)
                    held.setdefault(own, []).append((doc, i, start, -minus, crc, offset))
                    for done in bins.closed:
                        close(done, 0)
                    bins.closed.clear()
                    if len(out) >= 10_000:
                        yield flush()
        for own, room in bins.leftovers().items():
            close(own, room)
            if len(out) >= 10_000:
                yield flush()
        yield flush()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text_bytes"))
    placed = materialized(own.mapInArrow(run, _PIECES))
    return _repacked(placed, capacity, bound).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _repacked(placed: DataFrame, capacity: int, bound: int) -> DataFrame:
    """Pack the partly filled sequences of neighbouring partitions again, each as one unit."""

    def again(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["used", "sequence_id"], ascending=[False, True])
        bins, first, to, shift = BestFit(capacity, bound), {}, [], []
        for sequence, used in zip(units["sequence_id"].tolist(), units["used"].tolist()):
            own, offset = bins.put(used)
            to.append(first.setdefault(own, sequence))
            shift.append(offset)
        return pd.DataFrame({"sequence_id": units["sequence_id"], "to": to, "shift": shift})

    partly = placed.where("room > 0").groupBy("group", "sequence_id").agg((F.lit(capacity) - F.max("room")).alias("used"))
    moves = partly.groupBy("group").applyInPandas(again, "sequence_id long, to long, shift long")  # at most spread * bound rows a group
    return (
        placed.join(moves, "sequence_id", "left")
        .withColumn("sequence_id", F.coalesce("to", "sequence_id"))
        .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    )
