"""Line deduplication across documents.

Line hashes are range-partitioned by (hash, document) and sorted inside each partition by hash, then by
document from the largest id down, so one pass streams every hash's documents with the one that keeps
the line first. Because the document is part of the range key, a hash that a third of the corpus holds
is spread over many partitions; only the first and last hash of a partition can go on in another one,
and those (two rows a partition at most) are summed and joined back. What comes back is a compressed
keep bitmap for each document that loses lines, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BLANKS, fresh, materialized, row_hash, slices, utf8

_FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("positions", pa.list_(pa.int32()))])
_FOUND_SQL = "h1 long, h2 long, doc long, rid long, positions array<int>"
_RUNS = pa.schema([("kind", pa.int8()), *_FOUND, ("n_docs", pa.int64())])
_RUNS_SQL = f"kind byte, {_FOUND_SQL}, n_docs long"
_DROP, _PENDING, _SUMMARY = 0, 1, 2


def line_hashes(min_chars: int):
    """Rows (doc, rid, text bytes) -> one row for each distinct long line of a text, with its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, docs, rids, ends, positions = [], [], [], [0], []
            for doc, rid, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split(b"\n")):
                    key = line.strip(BLANKS).lower()
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
                for digest, at in found.items():
                    digests.append(digest)
                    positions.extend(at)
                    ends.append(len(positions))
                docs.extend([doc] * len(found))
                rids.extend([rid] * len(found))
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(rids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions, pa.int32()))],
                schema=_FOUND,
            )

    return run


def stream_runs(min_docs: int):
    """Sorted rows of one partition -> rows to drop, rows of edge hashes still open, and those hashes' sums.

    Holds at most the rows of min_docs documents of one hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []

        def emit(kind, row, n=0):
            out.append([kind, *row, n])

        def flush():
            cols = list(zip(*out)) if out else [()] * len(_RUNS)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUNS)], schema=_RUNS)
            out.clear()
            return batch

        key, held, n_docs, first, last_doc, edge = None, [], 0, None, None, True

        def close(final: bool):
            """End the current hash; at a partition's edge it may go on elsewhere."""
            if key is None:
                return
            if edge or final:
                emit(_SUMMARY, (*key, first, None, None), n_docs)
            if edge or final and n_docs < min_docs:
                for row in held:
                    emit(_PENDING, row)

        for batch in batches:
            h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(h1))
            rids, positions = batch.column(3), batch.column(4)
            for a, b in zip(starts.tolist(), ends.tolist()):
                now = (int(h1[a]), int(h2[a]))
                if now != key:
                    close(False)
                    edge = key is None
                    key, held, n_docs, first, last_doc = now, [], 0, int(doc[a]), None
                    if b - a < min_docs and b < len(h1) and not edge:
                        n_docs = min_docs  # too few rows and none to come: all stay
                        continue
                for i in range(a, b):
                    d = int(doc[i])
                    if d != last_doc:
                        n_docs, last_doc = n_docs + 1, d
                    row = (*now, d, rids[i].as_py(), positions[i].as_py())
                    if edge:
                        emit(_PENDING, row)
                    elif n_docs < min_docs:
                        held.append(row)
                    else:
                        for x in held:
                            if x[2] != first:
                                emit(_DROP, x)
                        held = []
                        emit(_DROP, row)
                    if len(out) >= 20_000:
                        yield flush()
        close(True)
        yield flush()

    return run


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, rid, keep_bitmap, n_dropped) of the documents that lose lines.

    A line's key is the line without surrounding blanks, A-Z lower-cased. Keys of min_chars code points
    or more that min_docs documents or more hold stay only in the largest id that holds them, there with
    all their repeats. keep_bitmap: zlib-compressed bits, 1 keeps; lines past its end stay. A null text
    is one empty line; a null id counts as the smallest id. Rows of one id with different texts are told
    apart by rid.
    """
    own = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("doc"), row_hash(F.col(text_col)).alias("rid"), utf8(F.col(text_col)).alias("line_bytes"))
    found = materialized(own.mapInArrow(line_hashes(min_chars), _FOUND_SQL))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(n, "h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc())
    runs = materialized(ordered.mapInArrow(stream_runs(min_docs), _RUNS_SQL))
    sums = (
        runs.where(F.col("kind") == _SUMMARY)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("total"), F.max("doc").alias("keeper"))
        .where(F.col("total") >= min_docs)
    )
    pending = runs.where(F.col("kind") == _PENDING).drop("n_docs").join(F.broadcast(sums), ["h1", "h2"])  # two rows a partition at most
    drops = runs.where(F.col("kind") == _DROP).select("doc", "rid", "positions").unionByName(pending.where("doc <> keeper").select("doc", "rid", "positions"))
    return drops.groupBy("doc", "rid").agg(F.flatten(F.collect_list("positions")).alias("lost")).select("doc", "rid", _bitmap("lost").alias("keep_bitmap"), F.size("lost").cast("long").alias("n_dropped"))


@F.pandas_udf(T.BinaryType())
def _bitmap(lost: pd.Series) -> pd.Series:
    def one(at):
        keep = np.ones(int(max(at)) // 8 * 8 + 8, dtype=bool)
        keep[np.asarray(at, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return lost.map(one)


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, list[bytes]]:
    """(lines before, lines that stay) of one text."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)[: len(lines)]
    keep = np.append(keep, np.ones(len(lines) - len(keep), dtype=bool))
    return len(lines), [line for line, k in zip(lines, keep.tolist()) if k]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column from keep_bitmaps(), null where all lines stay, and that column's name."""
    doc, rid, keep = fresh(docs, "doc"), fresh(docs, "rid"), fresh(docs, "keep_bitmap")
    keys = bitmaps.select(F.col("doc").alias(doc), F.col("rid").alias(rid), F.col("keep_bitmap").alias(keep))
    on = (F.coalesce(docs[id_col], F.lit(-(2**63))).cast("long") == F.col(doc)) & (row_hash(docs[text_col]) == F.col(rid))
    return docs.join(keys, on, "left").drop(doc, rid), keep


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([t if b is None else b"\n".join(kept_lines((t or "").encode(), b)[1]).decode() for t, b in zip(text, bitmap)], dtype=object)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """docs, every column as it was but the text without the lines that keep_bitmaps() drops."""
    marked, keep = with_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **rule), id_col, text_col)
    return marked.withColumn(text_col, _kept_text(F.col(text_col), F.col(keep))).select(*docs.columns)


def line_report(docs: DataFrame, **rule: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document.

    A null or empty text is one empty line, which stays; repeated rows are each answered, and count as one
    document; a null id counts as the smallest. Other columns are not looked at. An empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    marked, keep = with_bitmaps(own, keep_bitmaps(own, **rule))
    digest = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before, dropped, sha = [], [], []
            for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, kept = kept_lines(text, bitmap)
                before.append(n)
                dropped.append(n - len(kept))
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.select("doc_id", utf8(F.col("text")).alias("line_bytes"), keep).mapInArrow(run, digest)
