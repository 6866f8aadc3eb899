"""Near-duplicate documents by b-bit MinHash.

One pass over the texts gives every document a hash of its shingle set, band keys made of its full
minima, and a signature of the minima's low bits packed in bit planes. Documents of one set are one class.
Classes that share a band key are compared by bit counts on their signatures, corrected for chance
collisions, in chunks of bounded size; each chunk proposes maximum spanning forests of the estimates, and
the proposed links are confirmed on full shingle sets. Connected components follow by label propagation.

What the forests do not settle is settled exactly. Every two chunks of a band meet in a block, and
documents with an estimate near enough to one of another component, in a pair not yet refused, bring their
full sets into it; shared shingles are counted for all pairs of the block at once, and a spanning
forest of the true links goes out. Nothing is left open then: two documents that share a band and are
similar enough end in one component, however many look-alikes surround them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialized, row_hash, slices, utf8
from tessera.llm.shingles import shingle_hashes, word_hashes

#: Minima of a signature, bits kept of each, bands and minima in a band.
MINIMA, BITS, BANDS, ROWS = 128, 4, 16, 4
_LONGS = MINIMA * BITS // 64
_rng = np.random.default_rng(11)
_TURNS = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The text's distinct shingles as sorted hashes."""
    return np.unique(shingle_hashes(word_hashes(text), width))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of MINIMA permutations of the shingles."""
    low = np.full(MINIMA, np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[a : a + 2048, None] * _TURNS).min(0))
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The minima's low bits, one plane of MINIMA bits after another, as 64-bit integers."""
    planes = [np.packbits(((low >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)) for p in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    return ((rows ^ (rows >> np.uint64(31))) * _FOLD).sum(1, dtype=np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures, by bit counts, corrected for collisions of BITS bits."""
    words = MINIMA // 64
    differ = np.zeros((*np.broadcast_shapes(a.shape, b.shape)[:-1], words), np.int64)
    for p in range(BITS):
        differ |= a[..., p * words : (p + 1) * words] ^ b[..., p * words : (p + 1) * words]
    same = 1 - np.bitwise_count(differ.view(np.uint64)).sum(-1) / MINIMA
    chance = 1 / 2**BITS
    return (same - chance) / (1 - chance)


_SIG_SQL = "doc long, rid long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, rid, n_shingles, set hash, signature, band keys); a text without words has an empty set and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sets, sigs, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, width)
                n.append(len(own))
                low = minima(own)
                mixed = own * np.uint64(0xD6E8FEB86659FD93)
                sets.append((int(own.sum(dtype=np.uint64).view(np.int64)), int((mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64).view(np.int64))))
                sigs.append(packed(low))
                bands.append(band_keys(low) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array([s[i] for s in sets], pa.int64()) for i in (0, 1)), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc", "rid", "n_shingles", "s1", "s2", "sig", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc"), row_hash(F.col(text_col)).alias("rid"), utf8(F.col(text_col)).alias("text_bytes")).mapInArrow(run, _SIG_SQL)


def forests(sigs: np.ndarray, cut: float, n_forests: int) -> list[tuple[int, int]]:
    """Edges of edge-disjoint maximum spanning forests over pairs with an estimated similarity of cut or more."""
    n = len(sigs)
    if n == 2:
        return [(0, 1)] if similarity(sigs[0], sigs[1]) >= cut else []
    near = similarity(sigs[:, None], sigs[None])
    near[near < cut] = -1.0
    np.fill_diagonal(near, -1.0)
    out: list[tuple[int, int]] = []
    for _ in range(n_forests):
        edges = []
        best, nearest, left = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
        for _ in range(n):  # Prim's algorithm
            u = int(np.where(left, best, -2.0).argmax())
            if best[u] >= 0:
                edges.append((int(nearest[u]), u))
            left[u] = False
            closer = (near[u] > best) & left
            best[closer], nearest[closer] = near[u][closer], u
        if not edges:
            break
        out += edges
        for x, y in edges:
            near[x, y] = near[y, x] = -1.0
    return out


def _parts(n: Column, shingles: Column, chunk: int) -> Column:
    """Chunks that n nodes with that many shingles in all are dealt into: about `chunk` nodes and 16 MB of hashes each."""
    return F.greatest(F.ceil(n / chunk), F.ceil(shingles / (1 << 21))).cast("int")


def _lists(nodes: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(from, to) of each list's entries in the flattened column."""
    offsets = nodes.offsets.to_numpy()
    offsets = (offsets - offsets[0]).tolist()
    return zip(offsets[:-1], offsets[1:])


def shared_bands(classes: DataFrame, chunk: int) -> DataFrame:
    """(band, parts, node, n_shingles, sig): the members of each band that several nodes share, and the chunks it is dealt into.

    Most bands are held by one node, so keys and ids alone are grouped; signatures join what is left, by node.
    """
    keys = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    sizes = keys.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    sizes = materialized(sizes.select("band", _parts(F.col("n"), F.col("shingles"), chunk).alias("parts")))  # a join of its own can be dealt anew where a band is hot
    held = keys.select("band", "node").join(sizes, "band")
    return materialized(held.join(classes.select("node", "n_shingles", "sig"), "node").select("band", "parts", "node", "n_shingles", "sig"))


def proposals(shared: DataFrame, cut: float, n_forests: int) -> DataFrame:
    """Distinct candidate links (a, b), a < b, inside the chunks of bands, from (band, parts, node, sig).

    `shared` is a written table, so that a hot band is grouped by chunk and not by band.
    """
    dealt = shared.select("band", F.pmod(F.xxhash64("node"), "parts").alias("chunk"), "node", "sig")
    grouped = dealt.groupBy("band", "chunk").agg(F.collect_list(F.struct("node", "sig")).alias("nodes"))  # about `chunk` nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, out = batch.column(0).flatten(), []
            ids, sigs = flat.field("node").to_numpy(), flat.field("sig").flatten().to_numpy().reshape(-1, _LONGS)
            for s, e in _lists(batch.column(0)):
                if e - s > 1:
                    out += [(int(ids[s + x]), int(ids[s + y])) for x, y in forests(sigs[s:e], cut, n_forests)]
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])

    return grouped.select("nodes").mapInArrow(run, "a long, b long").distinct()


def blocks(members: DataFrame, chunk: int) -> DataFrame:
    """(band, x, y, node, label, sig): every two chunks of a band with several labels as a block, from (band, node, n_shingles, label, sig).

    Nodes of a band's largest label need not meet each other, so they and the others are dealt into chunks
    of their own, and blocks of two chunks of the largest label are left out.
    """
    counts = members.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    main = F.max(F.struct("n", "label", "shingles"))
    sizes = counts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), main.alias("main"), F.count("*").alias("labels")).where("labels > 1")
    n_main = _parts(F.col("main.n"), F.col("main.shingles"), chunk).alias("n_main")
    n_other = _parts(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles"), chunk).alias("n_other")
    sizes = materialized(sizes.select("band", F.col("main.label").alias("main"), n_main, n_other))
    in_main, deal = F.col("label") == F.col("main"), F.xxhash64("node")
    own = F.when(in_main, F.col("n_other") + F.pmod(deal, "n_main")).otherwise(F.pmod(deal, "n_other")).cast("int")
    last = F.when(in_main, F.col("n_other")).otherwise(F.col("n_other") + F.col("n_main")) - 1
    met = members.join(sizes, "band").withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), last)))
    return met.where("own <> met").select("band", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), "node", "label", "sig")


def unsettled(placed: DataFrame, refused: DataFrame, cut: float) -> DataFrame:
    """(band, x, y, node, label): the nodes of each block that have, in a pair not refused, an estimate of cut or more with another label."""
    at = placed.select("band", "x", "y", "node")
    known = refused.join(at.withColumnRenamed("node", "a"), "a").join(at.withColumnRenamed("node", "b"), ["band", "x", "y", "b"])
    entry = F.struct("node", F.lit(None).cast("long").alias("other"), "label", "sig").alias("entry")
    out = F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<long>").alias("sig")).alias("entry")
    entries = placed.select("band", "x", "y", entry).union(known.select("band", "x", "y", out))
    grouped = entries.groupBy("band", "x", "y").agg(F.collect_list("entry").alias("entries"))  # about two chunks' nodes, and the pairs refused so far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = batch.column(3).flatten()
            pair = flat.field("other").is_valid().to_numpy(zero_copy_only=False)
            ids = flat.field("node").to_numpy()
            others, labels = (flat.field(c).fill_null(0).to_numpy() for c in ("other", "label"))
            sigs = flat.field("sig").flatten().to_numpy().reshape(-1, _LONGS)
            of = np.cumsum(~pair) - 1  # where an entry's signature is
            rows, live = [], []
            for i, (s, e) in enumerate(_lists(batch.column(3))):
                own = s + np.flatnonzero(~pair[s:e])
                gone = s + np.flatnonzero(pair[s:e])
                own = own[np.argsort(ids[own])]
                near = similarity(sigs[of[own], None], sigs[None, of[own]]) >= cut
                near &= labels[own, None] != labels[None, own]
                if len(gone):
                    x, y = np.searchsorted(ids[own], ids[gone]), np.searchsorted(ids[own], others[gone])
                    near[x, y] = near[y, x] = False
                found = own[near.any(1)]
                rows.append(np.full(len(found), i))
                live.append(found)
            rows, live = np.concatenate(rows), np.concatenate(live)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(3)), pa.array(ids[live]), pa.array(labels[live])], names=["band", "x", "y", "node", "label"])

    return grouped.mapInArrow(run, "band long, x int, y int, node long, label long")


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, as a matrix.

    Shingles that few sets hold are counted pair by pair, the others as a product of 0/1 matrices.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    row, col = row[order], np.concatenate(sets)[order]
    new = np.append(True, col[1:] != col[:-1])
    col = np.cumsum(new) - 1
    held = np.bincount(col)
    both = np.zeros(n * n, np.int64)
    rare = held[col] <= 8
    r, c = row[rare], col[rare]
    for d in range(1, 8):
        same = c[d:] == c[:-d]
        if not same.any():
            break
        both += np.bincount(r[:-d][same] * n + r[d:][same], minlength=n * n)
    both = both.reshape(n, n)
    both = both + both.T
    r, c = row[~rare], col[~rare]
    c = np.cumsum(np.append(True, c[1:] != c[:-1])) - 1 if len(c) else c
    for a in range(0, int(c[-1]) + 1 if len(c) else 0, 4096):
        i, j = np.searchsorted(c, (a, a + 4096))
        held_by = np.zeros((n, 4096), np.float32)
        held_by[r[i:j], c[i:j] - a] = 1
        both += (held_by @ held_by.T).astype(np.int64)
    return both


def true_links(open_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): in each block of (band, x, y, node, label), a spanning forest of the pairs of different labels whose full sets are similar enough."""

    def run(block: pa.Table) -> pa.Table:  # about two chunks' nodes
        ids, labels, out = block["node"].to_numpy(), block["label"].to_numpy(), []
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["shingles"]]
        sizes = np.array([len(x) for x in own])
        both = shared_shingles(own)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None] - both)
        linked &= labels[:, None] != labels[None]
        left = np.ones(len(ids), bool)
        for root in np.flatnonzero(linked.any(1)).tolist():  # breadth first
            reached = [root] if left[root] else []
            left[root] = False
            for u in reached:
                new = np.flatnonzero(linked[u] & left)
                left[new] = False
                reached += new.tolist()
                out += [(min(ids[u], ids[v]), max(ids[u], ids[v])) for v in new]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return open_nodes.join(sets, "node").groupBy("band", "x", "y").applyInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles) of the given (node, doc, rid): full sets as sorted 64-bit hashes. Texts are shuffled once unless nodes are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    own = docs.select(F.col(id_col).cast("long").alias("doc"), row_hash(F.col(text_col)).alias("rid"), utf8(F.col(text_col)).alias("text_bytes"))
    return own.join(nodes, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).select("node", "text_bytes").mapInArrow(run, "node long, shingles binary")


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).union(links.select("b")).distinct()


def confirmed(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has a link.

    Labels spread to neighbours and then jump to their label's label, so long chains take logarithmic rounds.
    """
    both = materialized(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialized(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jumped = spread.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", "left")
        new = materialized(jumped.select("node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = 512, n_forests: int = 1) -> DataFrame:
    """(doc, rid, n_shingles, component_id) of every row of docs.

    Links documents whose sets of `width`-word shingles (A-Z lower-cased; the whole sequence where there
    are fewer words) have a Jaccard similarity of percent / 100 or more. component_id is the smallest id
    reachable. A text without words, or a null id, is linked with nothing; its component is its own id.
    Rows that repeat an id with one text are one document; with different texts they are documents of
    their own, each compared by its own text. An empty table gives no rows. Other columns are not read.

    chunk: nodes of a band compared at once. n_forests: forests proposed before the exact comparison;
    both change the work, not the links.
    """
    rows = materialized(signatures(docs, id_col, text_col, width))
    classes = materialized(
        rows.where("n_shingles > 0 and doc is not null")
        .groupBy("s1", "s2")
        .agg(F.min(F.struct("doc", "rid")).alias("least"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
        .select("s1", "s2", F.monotonically_increasing_id().alias("node"), "least.doc", "least.rid", "n_shingles", "sig", "bands")
    )
    share = percent / 100
    cut = share - 4 * (share * (1 - share) / MINIMA) ** 0.5  # a link's estimate is less than this once in 30,000
    shared = shared_bands(classes, chunk)

    def sets_of(nodes: DataFrame, all_at_once: bool) -> DataFrame:
        wanted = materialized(classes.select("node", "doc", "rid").join(nodes, "node"))  # its size is then known
        return materialized(full_sets(docs, wanted.hint("merge") if all_at_once else wanted, id_col, text_col, width))

    links = materialized(proposals(shared, cut, n_forests))
    nodes = materialized(ends(links))
    sets = sets_of(nodes, True)  # grows with docs: one plan at every size
    sure = materialized(confirmed(links, sets, percent))
    labels = components(sure)
    known = shared.join(nodes.withColumn("linked", F.lit(True)), "node", "left").where("parts > 1 or linked")  # in other bands, a node that no forest holds has no candidate
    labelled = known.join(labels, "node", "left").select("band", "node", "n_shingles", F.coalesce("label", "node").alias("label"), "sig")
    open_nodes = materialized(unsettled(materialized(blocks(labelled, chunk)), links.join(sure, ["a", "b"], "left_anti"), cut))
    new = open_nodes.select("node").distinct().join(nodes, "node", "left_anti")
    if not open_nodes.isEmpty():
        sure = sure.unionByName(materialized(true_links(open_nodes, sets.union(sets_of(new, False)), percent)))
        labels = components(sure)
    least = labels.join(classes.select("node", "doc"), "node").groupBy("label").agg(F.min("doc").alias("component"))
    labels = labels.join(least, "label").select("node", "component")
    found = classes.select("s1", "s2", "node", "doc").join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "doc").alias("component"))
    judged = rows.join(found, ["s1", "s2"], "left").select(
        "doc", "rid", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc")).alias("component_id")
    )
    return judged


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, or null, with all their columns.

    Several rows of that id all stay, whether they repeat one text or have different ones.
    """
    found = near_duplicates(docs, width, percent, id_col, text_col)
    doc, rid = fresh(docs, "doc"), fresh(docs, "rid")
    gone = found.where("doc <> component_id").select(F.col("doc").alias(doc), F.col("rid").alias(rid)).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == F.col(doc)) & (row_hash(docs[text_col]) == F.col(rid)), "left_anti")
