"""Byte-level BPE encoding and decoding with a segment tree.

Each regex match is merged on its own. A segment tree over its byte positions keeps, in every node, the
leftmost minimum rank of the adjacent pairs below it; the root is the next merge, and a merge changes
the two pairs of its live neighbours by point updates of logarithmic cost, so a match of any length takes
O(n log n). Results of short matches are kept in a bounded table in each Python worker, since a corpus
repeats its words. Work is one pass over the rows: no shuffle, no state beyond that table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, utf8

_NONE = 1 << 30
#: Chunks kept in a worker's table, and the longest chunk kept there.
TABLE, SHORT = 800_000, 64
_TWO_BLANKS = re.compile(r"\s\s|[^\S \n]").search


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: the lowest-ranked adjacent pair is merged first, leftmost on ties."""
    n = len(piece)
    if n == 0:
        return []
    if piece in ranks:
        return [ranks[piece]]
    get = ranks.get
    width = 1
    while width < n - 1:
        width *= 2
    # a leaf holds rank * n + position, so that the minimum is also the leftmost
    none = _NONE * n
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(piece[i : i + 2], _NONE) * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the part that starts at a position
    before = list(range(-1, n - 1))  # the live part on the left

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            low = value if value < other else other
            i >>= 1
            if tree[i] == low:
                return
            tree[i] = value = low

    while (top := tree[1]) < none:
        at = top % n
        gone = end[at]
        stop = end[at] = end[gone]
        if stop < n:
            before[stop] = at
            put(at, get(piece[at : end[stop]], _NONE) * n + at)
        else:
            put(at, none)
        if gone < n - 1:
            put(gone, none)
        left = before[at]
        if left >= 0:
            put(left, get(piece[left:stop], _NONE) * n + left)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Pairs:
    """Ranks of adjacent token pairs, for arrays: a pair's rank is the id of its concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        codes, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    codes.append(a << 32 | b)
                    found.append(rank)
        order = np.argsort(codes)
        self.codes, self.found = np.array(codes, np.int64)[order], np.array(found, np.int64)[order]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.found[at], _NONE)


def merge_many(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> list[bytes]:
    """merge() for many matches of 2 to 33 bytes at once: one segment tree each, walked side by side.

    single: the id of each byte. Returns each match's ids as little-endian int32 bytes.
    """
    out: list[bytes] = [b""] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for width in (1, 2, 4, 8, 16, 32):
        own = np.flatnonzero((sizes <= width + 1) & (sizes > (width // 2 + 1 if width > 1 else 0)))
        if not len(own):
            continue
        n, cols = sizes[own], np.arange(width + 1)
        text = np.frombuffer(b"".join(pieces[i].ljust(width + 1, b"\0") for i in own.tolist()), np.uint8).reshape(-1, width + 1)
        live = cols[None, :] < n[:, None]
        token = single[text]
        end = np.repeat(cols[None, :] + 1, len(own), 0)
        before = np.repeat(cols[None, :] - 1, len(own), 0)
        none = _NONE * 64  # a leaf holds rank * 64 + position: the minimum is also the leftmost
        tree = np.full((len(own), 2 * width), none, np.int64)
        tree[:, width:] = np.where(live[:, 1:], pairs(token[:, :-1], token[:, 1:]) * 64 + cols[:-1], none)
        tree[tree >= none] = none
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        rows = np.arange(len(own))
        while True:
            top = tree[rows, 1]
            go = top < none
            rows, top = rows[go], top[go]
            if not len(rows):
                break
            at = top & 63
            gone = end[rows, at]
            stop = end[rows, gone]
            token[rows, at] = top >> 6
            end[rows, at] = stop
            live[rows, gone] = False
            right = stop < n[rows]
            before[rows[right], stop[right]] = at[right]
            fresh = np.full(len(rows), none, np.int64)
            fresh[right] = pairs(token[rows[right], at[right]], token[rows[right], stop[right]]) * 64 + at[right]
            left = before[rows, at]
            has_left = left >= 0
            lr, ll = rows[has_left], left[has_left]
            in_tree = gone < width
            changed = ((rows, at, fresh), (rows[in_tree], gone[in_tree], none), (lr, ll, pairs(token[lr, ll], token[lr, at[has_left]]) * 64 + ll))
            for r, leaf, value in changed:
                tree[r, width + leaf] = np.minimum(value, none)
            for r, leaf, _ in changed:
                node = (width + leaf) >> 1
                while len(node) and node[0]:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node >>= 1
        ids = token[live].astype("<i4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        for i, a, b in zip(own.tolist(), [0, *ends], ends):
            out[i] = ids[a:b]
    return out


class Codec:
    """Encodes and decodes texts by a rank file; keeps frequent chunks' ids in a bounded table."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)
        self.find = regex.compile(pattern).findall
        self.table: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts whose matches do not depend on what stands around them.

        Where no two blanks are neighbours, a space belongs to the chunk after it and every other blank
        stands alone. Elsewhere the chunks are the matches themselves.
        """
        if _TWO_BLANKS(text) or "\0" in text:
            return self.find(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks; short ones go into the table, the others are returned."""
        parts = {c: [c.encode()] if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else [m.encode() for m in self.find(c)] for c in chunks}
        known: dict[bytes, bytes] = {}
        many = []
        for piece in {p for ps in parts.values() for p in ps}:
            if (rank := self.ranks.get(piece)) is not None:
                known[piece] = rank.to_bytes(4, "little")
            elif len(piece) <= 33:
                many.append(piece)
            else:
                known[piece] = np.array(merge(piece, self.ranks), "<i4").tobytes()
        known.update(zip(many, merge_many(many, self.single, self.pairs)))
        rest = {}
        if len(self.table) + len(parts) > TABLE:
            self.table.clear()
        for c, ps in parts.items():
            ids = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
            if len(c) <= SHORT and len(self.table) < TABLE:
                self.table[c] = ids
            else:
                rest[c] = ids
        return rest

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text as int32. A block's ids are complete before the first is given out: whoever encodes other
        texts in between may clear the table."""
        for a in range(0, len(texts), 256):
            chunks = [self.chunks(t) for t in texts[a : a + 256]]
            table = self.table
            new = set().union(*chunks)
            if missing := new.difference(table):
                held = {c: table[c] for c in new - missing} if len(table) + len(missing) > TABLE else {}
                rest = self.learn(missing)
                table = self.table
                if rest or held:
                    table = _Both({**held, **rest}, table)
            get = table.__getitem__
            yield from [np.frombuffer(b"".join(map(get, own)), "<i4") for own in chunks]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Both(dict):
    """A small table over the kept one."""

    def __init__(self, own: dict, under: dict):
        super().__init__(own)
        self.under = under

    def __missing__(self, key):
        return self.under[key]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_column(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id, ids): the token ids of every whole text; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, 1024):
            ids = list(own.encode_many([(text or b"").decode() for text in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("bpe_bytes")).mapInArrow(run, "id long, ids array<int>")


def decode_column(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, bytes) from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, 1024):
            found = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "bytes"])

    return rows.select("id", "ids").mapInArrow(run, "id long, bytes binary")


def round_trip_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again.

    A null or empty text has no tokens; repeated rows and rows with a null id are each answered; other columns,
    whatever their names, are not looked at. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = list(map(str, range(len(own.tokens))))
        for batch in slices(batches, 1024):
            n, ids_sha, back_sha = [], [], []
            for found in own.encode_many([text.decode() for text in batch.column(1).to_pylist()]):
                ids = found.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", utf8(F.col("text")).alias("bpe_bytes")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
