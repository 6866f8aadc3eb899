import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, corpus, ledgers, rolling
from tessera.sources import buckets, corpus_files
from tessera.streaming import deliveries

FILES = "repo string, path string, content string"
SOURCE = '"""doc"""\nimport os\n\n\n# about f\n@deco\ndef f():\n    return 1\n\n\nclass C:\n    def m(self):\n        pass\n'
TREE = [("r", "src/parser.py", SOURCE), ("r", "README.md", "# Title\nSome long enough text here.\n## Install\n```\n# not a heading\n```\nmore text for this one\n## Usage\nand the last part of the text\n"), ("r", "node_modules/x.py", "x = 1\n"), ("r", "a.bin", "?")]
INDEX = "unit_id string, repo string, kind string, content_hash string, ref string, updated_at int"


def units(spark, tree, ref):
    return chunking.file_units(spark.createDataFrame(tree, FILES)).withColumn("ref", F.lit(ref))


def test_chunks_follow_structure(spark):
    got = {(r.path, r.symbol): (r.start_line, r.end_line) for r in units(spark, TREE, "a").collect()}
    assert got[("src/parser.py", "f")] == (5, 8) and got[("src/parser.py", "C")] == (11, 13) and ("src/parser.py", None) in got
    assert {s for p, s in got if p == "README.md"} == {"Title", "Title > Install", "Title > Usage"}
    assert not [p for p, _ in got if p not in ("README.md", "src/parser.py")]


@pytest.mark.parametrize("path", ["a.py", "a.txt", "a.rst", "a.md", "b"])
def test_no_chunk_is_too_long_and_no_line_is_lost(spark, path):
    said = "\n".join(["Head", "===="] + [f"line {i} " + "x" * (i % 90) for i in range(400)])
    file, cut = chunking.spans(path, said)
    assert all(len(file.said(a, b)) <= chunking.MAX_CHARS for a, b, _ in cut)
    assert [n for a, b, _ in cut for n in range(a, b + 1)] == list(range(1, len(said.splitlines()) + 1))
    assert chunking.spans(path, "")[1] == []


def test_big_class_becomes_methods():
    body = "".join(f"    def m{i}(self):\n" + "        x = 1\n" * 120 for i in range(4))
    _, cut = chunking.spans("a.py", "class Big:\n    '''doc'''\n" + body)
    assert [s for _, _, s in cut] == ["Big", "Big.m0", "Big.m1", "Big.m2", "Big.m3"] or [s for _, _, s in cut][1:] == ["Big.m1", "Big.m2", "Big.m3"]


@pytest.mark.parametrize("source", ["-" * 100_000 + "1", "(" * 5000, "x = 1\0", "def f(:\n    pass", "lambda: " * 20_000 + "1"])
def test_files_that_do_not_parse_become_windows(source):
    file, cut = chunking.spans("a.py", source)
    assert [n for a, b, _ in cut for n in range(a, b + 1)] == list(range(1, len(file.lines) + 1)) and {s for _, _, s in cut} == {None}


def test_headings_follow_their_documentation():
    assert [chunking.atx_heading(x) for x in ("# a", "### b ##", "####### c", "#d", "## C#", "    # code", "   # e")] == [(1, "a"), (3, "b"), None, None, (2, "C#"), None, (1, "e")]
    assert [chunking.code_fence(x) for x in ("```py", "~~~~", "``", "    ```", "text")] == ["```", "~~~~", "", "", ""]
    assert [chunking.is_underline(*x) for x in (("====", "abcd"), ("===", "abcd"), ("=-==", "abcd"), ("aaaa", "abcd"), ("--", "ab"))] == [True, False, False, False, False]
    _, cut = chunking.spans("a.md", "# One\n````\n```\n# no\n````\ntext that is long enough to stay alone\n## Two\nmore text that is long enough to stay alone\n")
    assert [s for _, _, s in cut] == ["One", "One > Two"]


def test_upsert_is_idempotent(spark):
    empty = spark.createDataFrame([], INDEX)
    first = units(spark, TREE, "ref1")
    index = corpus.upserted(empty, first, F.lit(1)).cache()
    n = index.count()
    assert corpus.upsert_actions(empty, first).where("action = 'inserted'").count() == n > 0
    again = corpus.upsert_actions(index, units(spark, TREE, "ref2"))
    assert {(r.action, r.ref) for r in again.collect()} == {("unchanged", "ref1")}
    assert {(r.ref, r.updated_at) for r in corpus.upserted(index, units(spark, TREE, "ref2"), F.lit(2)).collect()} == {("ref1", 1)}
    edited = [(r, p, c.replace("return 1", "return 2")) for r, p, c in TREE]
    report = corpus.ingest_report(corpus.upsert_actions(index, units(spark, edited, "ref3")).withColumn("repo", F.lit("r")), corpus.prunable(index, units(spark, edited, "ref3"))).first()
    assert (report.inserted, report.updated, report.pruned, report.wrote_nothing) == (0, 1, 0, False)
    fewer = units(spark, TREE[:1], "ref4")
    assert {r.kind for r in corpus.prunable(index, fewer).collect()} == {"doc"}
    assert corpus.prunable(index, fewer.limit(0)).count() == 0
    window = index.unionByName(spark.createDataFrame([("u", "r", "pull_request", "h", "x", 1)], INDEX))
    assert corpus.prunable(window, fewer).where("kind = 'pull_request'").count() == 0


def test_duplicates_keep_the_first(spark):
    rows = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c")], "unit_id string, nth int, text string")
    assert sorted((r.unit_id, r.text, r.copies) for r in corpus.first_of_each(rows, "nth").collect()) == [("u", "a", 2), ("v", "c", 1)]


def test_shards_roll_by_rows_and_bytes(spark):
    rows = [("o/r", "doc", f"{i:03d}", 10) for i in range(7)] + [("o/r", "source", f"{i:03d}", 40) for i in range(5)]
    got = {(r.kind, r.unit_id): r.shard for r in corpus.shards(spark.createDataFrame(rows, "repo string, kind string, unit_id string, bytes int"), rows=3, size=100).collect()}
    assert [got["doc", f"{i:03d}"][-14:-9] for i in range(7)] == ["00000"] * 3 + ["00001"] * 3 + ["00002"]
    assert [got["source", f"{i:03d}"][-14:-9] for i in range(5)] == ["00000"] * 2 + ["00001"] * 2 + ["00002"]
    assert got["doc", "000"] == "doc/o__r-00000.jsonl.gz"


def test_corpus_round_trip_and_unchanged_shards(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(f"u{i}", "o/r", ("source", "doc")[i % 2], "p", None, 1, 2, 4, "text", {"k": "v"}, f"h{i}") for i in range(10)]
    from tessera.sources.schemas import UNIT

    first = spark.createDataFrame(rows, UNIT)
    manifest = corpus_files.write_corpus(first, root).cache()
    assert {r.change for r in manifest.collect()} == {"written"} and manifest.count() == 2
    back = corpus_files.read_corpus(spark, root, manifest)
    assert sorted((r.unit_id, r.metadata["k"], r.content_hash) for r in back.collect()) == [(f"u{i}", "v", f"h{i}") for i in range(10)]
    assert {r.change for r in corpus_files.write_corpus(first.orderBy(F.rand()), root, manifest).collect()} == {"unchanged"}
    edited = first.withColumn("content_hash", F.when(F.col("unit_id") == "u1", "new").otherwise(F.col("content_hash")))
    assert {r.shard[:3]: r.change for r in corpus_files.write_corpus(edited, root, manifest).collect()} == {"doc": "written", "sou": "unchanged"}
    with pytest.raises(FileNotFoundError):
        corpus_files.read_corpus(spark, root, spark.createDataFrame([("doc/none",)], "shard string"))


def test_payload_units(spark, tmp_path):
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, [{"id": 1, "path": "a.py", "diff_hunk": "@@ -1 +1 @@\n+x", "body": "Fix it", "user": {"login": "ann"}, "pull_request_url": "https://x/pulls/7", "line": 3}, {"id": 2, "body": ""}, {"id": 3, "body": "b", "user": None}])))
    comments = corpus_files.read_comments(spark, f"file://{tmp_path}/c.json", "r")
    got = {r.identity: r for r in corpus_files.comment_units(comments).collect()}
    assert got["review_comment/1"].text == "a.py:3\n\n@@ -1 +1 @@\n+x\n\nFix it" and got["review_comment/1"].metadata["pull_request_number"] == "7"
    assert set(got) == {"review_comment/1", "review_comment/3"}
    pulls = spark.createDataFrame([(1, "T", "B", "2024", "2024-02"), (2, "U", None, None, "2024-03"), (3, "V", "C", "2023", "2023-01")], "number int, title string, body string, merged_at string, updated_at string").withColumn("merge_commit_sha", F.lit("s"))
    assert [r.text for r in corpus_files.pull_units(pulls, "r", 2).collect()] == ["T\n\nB"]
    issues = spark.createDataFrame([(1, "T", "B", None, "2"), (2, "U", "C", ("u",), "1")], "number int, title string, body string, pull_request struct<url:string>, updated_at string")
    assert [r.identity for r in corpus_files.issue_units(issues, "r").collect()] == ["issue/1"]


def test_tree_reader(spark, tmp_path):
    (tmp_path / "t" / "vendor").mkdir(parents=True)
    for name, said in (("a.py", b"x = 1\n"), ("b.txt", b"\xff\xfe\x00"), ("c.png", b"p"), ("vendor/d.py", b"y"), ("big.md", b"z" * 500)):
        (tmp_path / "t" / name).write_bytes(said)
    assert [(r.path, r.content) for r in corpus_files.read_tree(spark, f"file://{tmp_path}/t", "r", max_bytes=400).collect()] == [("a.py", "x = 1\n")]


def test_benchmark_vectors_and_freeze(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([("d1", "T", "x", 9)], "_id string, title string, text string, extra int").write.parquet(f"{root}/corpus")
    spark.createDataFrame([("q1", "x", "test"), ("q2", "x", "train"), ("q3", "x", "test")], "_id string, text string, partition string").write.parquet(f"{root}/queries")
    spark.createDataFrame([("q1", "d1", 1)], ["query-id", "corpus-id", "score"]).write.parquet(f"{root}/qrels")
    docs, queries, qrels = corpus_files.read_benchmark(spark, root)
    assert docs.first().text == "T x" and [r.query_id for r in queries.collect()] == ["q1"] and qrels.count() == 1
    corpus_files.write_vectors(spark.createDataFrame([("a", [1.0], 3, "m", "f")], "id string, vector array<float>, tokens int, model string, fingerprint string"), f"{root}/vectors")
    assert corpus_files.read_vectors(spark, f"{root}/vectors", "m", "f").count() == 1 and corpus_files.read_vectors(spark, f"{root}/vectors", "m", "g").count() == 0
    with pytest.raises(ValueError, match="missing"):
        corpus_files.read_vectors(spark, f"{root}/vectors", "m", "f", wanted=spark.createDataFrame([("a", "f"), ("b", "f")], "id string, fingerprint string"))
    corpus_files.write_vectors(corpus_files.read_vectors(spark, f"{root}/vectors", "m"), f"{root}/vectors", held=corpus_files.read_vectors(spark, f"{root}/vectors", "m"))
    assert corpus_files.read_vectors(spark, f"{root}/vectors", "m").count() == 1


def test_freeze_once_and_refuse_changes(spark, tmp_path):
    path, rows = f"file://{tmp_path}/frozen", spark.createDataFrame([(2, "b"), (1, "a")], "id int, said string")
    corpus_files.freeze(rows, path, ["id"])
    corpus_files.freeze(rows.limit(1), path, ["id"])
    assert sorted(tuple(r) for r in corpus_files.read_frozen(spark, path, ["id"]).collect()) == [(1, "a"), (2, "b")]
    rows.limit(1).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="frozen"):
        corpus_files.read_frozen(spark, path, ["id"])


OFFER = "repo string, pr int, path string, line int, nth int"


@pytest.mark.parametrize("held,lines,slots", [([], [1, 2, 3, 4], [1, 2, 3, None]), ([4], [4, 5], [None, 2]), ([], [7, 7, 8], [1, None, 2])])
def test_slots(spark, held, lines, slots):
    offers = spark.createDataFrame([("r", 1, "a", line, i) for i, line in enumerate(lines)], OFFER)
    ledger = spark.createDataFrame([("r", 1, "a", line) for line in held], "repo string, pr int, path string, line int")
    assert [r.slot for r in ledgers.slots(offers, ledger).orderBy("nth").collect()] == slots


def test_offers_are_not_sorted_to_find_slots(spark):
    rows = [("r", 1, "a", 1, 1), ("r", 1, "a", 1, 1), (None, 1, "a", None, 2), ("r", 1, None, 5, 3), ("r", 1, "b", 6, None), ("r", 1, "b", 7, 9), ("r", 1, "b", 8, 8), ("s", 1, "b", 8, 8)]
    found = ledgers.slots(spark.createDataFrame(rows, OFFER), spark.createDataFrame([("s", 1, "x", i) for i in (1, 2)], "repo string, pr int, path string, line int"))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([("r", 1, "a", 1, 1, 2), ("r", 1, "a", 1, 1, None), (None, 1, "a", None, 2, 1), ("r", 1, None, 5, 3, 3), ("r", 1, "b", 6, None, 1), ("r", 1, "b", 7, 9, None), ("r", 1, "b", 8, 8, None), ("s", 1, "b", 8, 8, 3)], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1  # over the granted ones


def test_draft_gates_and_filter(spark):
    drafts = spark.createDataFrame([(1, i, "a", line, ok, True, True) for i, (line, ok) in enumerate([(1, True), (1, True), (2, False), (9, True), (3, True), (3, True), (2, True), (4, True), (5, True), (6, True)])], "run_id int, position int, path string, line int, specific boolean, non_obvious boolean, grounded boolean")
    allowed = spark.createDataFrame([(1, "a", n) for n in range(1, 8)], "run_id int, path string, line int")
    gated = ledgers.draft_gates(drafts, allowed, spark.createDataFrame([(1, "a", 3)], allowed.schema))
    assert [r.fate for r in gated.orderBy("position").collect()] == ["unjudged", "duplicate", "self_critique", "not_commentable", "already_commented", "already_commented", "unjudged", "unjudged", "unjudged", "unjudged"]
    said = spark.createDataFrame([(1, 0, True), (1, 6, False), (1, 7, True), (1, 8, True), (1, 9, True)], "run_id int, position int, keep boolean")
    final = {r.position: r.fate for r in ledgers.filter_verdicts(gated, said).collect()}
    assert [final[i] for i in (0, 6, 7, 8, 9)] == ["kept", "filtered", "kept", "kept", "over_cap"]


def test_claims_release_and_violations(spark):
    runs = spark.createDataFrame([(2, "b", "r", 1), (1, "b", "r", 1), (3, "b", "r", 2)], "run_id int, batch string, repo string, pr int")
    assert {r.run_id for r in ledgers.claims(runs, runs.where("run_id = 3")).collect()} == {1}
    held = spark.createDataFrame([(1, None), (2, "t")], "run_id int, finished_at string")
    assert {r.run_id for r in ledgers.released(held, held).collect()} == {2}
    rows = spark.createDataFrame([("live", "d", None), ("live", None, None), ("replay", None, "b"), ("replay", "d", "b")], "mode string, delivery_id string, batch string")
    assert ledgers.violations(rows).count() == 2


def test_replay_choice_spreads_over_repos(spark):
    pulls = spark.createDataFrame([(f"r{i}", n) for i in range(3) for n in range(4)], "repo string, pr int")
    none = pulls.limit(0)
    first = ledgers.replay_choice(pulls, none, "b1", 6).collect()
    assert len({r.repo for r in first[:3]}) == 3 and first == ledgers.replay_choice(pulls.repartition(3), none, "b1", 6).collect()
    assert set(first) != set(ledgers.replay_choice(pulls, none, "b2", 6).collect())


def test_verdict_lines(spark):
    said = "intro\nVERDICT 4: keep, good point\nVERDICT 5:\n> VERDICT 6: keep\nVERDICT 7: KILL\nVERDICT 8: maybe"
    got = [(r.number, r.draft_id, r.verdict, r.reason, r.refused) for r in ledgers.verdict_lines(spark.createDataFrame([(1, said)], "report_id int, text string")).orderBy("number").collect()]
    assert got == [(2, 4, "keep", "good point", False), (5, 7, "kill", "", False), (6, 8, None, None, True)]


def test_streams(spark, tmp_path):
    src, ledger, point = tmp_path / "in", tmp_path / "ledger", tmp_path / "point"
    src.mkdir()
    rows = [{"delivery_id": d, "event": "pull_request", "action": a, "repo": "r", "pr": p, "ts": f"2024-01-0{i + 1}T00:00:00", "arrival": i} for i, (d, a, p) in enumerate([("d1", "opened", 7), ("d1", "opened", 99), ("d2", "closed", 7), ("d3", "synchronize", 7)])]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))

    def run(frame, mode, name):
        frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{point}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    kept = run(deliveries.once(deliveries.actionable(deliveries.stream(spark, str(src)))), "append", "kept")
    assert sorted(r.delivery_id for r in kept.collect()) == ["d1", "d3"]
    assert run(deliveries.latest_per_pull(deliveries.stream(spark, str(src))), "complete", "latest").where("pr = 7").first().delivery_id == "d3"
    bounded = run(deliveries.once(deliveries.stream(spark, str(src)), within="30 days"), "append", "bounded")
    assert bounded.count() == 3

    offers = tmp_path / "offers"
    offers.mkdir()
    schema = "repo string, pr int, path string, line int, nth int"
    empty = spark.createDataFrame([], "repo string, pr int, path string, line int, slot bigint")

    def feed(name, lines):
        (offers / name).write_text("\n".join(json.dumps({"repo": "r", "pr": 1, "path": "a", "line": n, "nth": i}) for i, n in enumerate(lines)))
        stream = spark.readStream.schema(schema).json(str(offers))
        deliveries.into_ledger(stream, str(ledger), empty, deliveries.slot_step).option("checkpointLocation", f"{point}/slots").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.line, r.slot) for r in buckets.read(spark, str(ledger), empty).collect())

    assert feed("1.json", [4, 4, 5]) == [(4, 1), (5, 2)]
    assert feed("2.json", [5, 6, 7]) == [(4, 1), (5, 2), (6, 3)]


def test_ingest_twice_writes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"

    def fetched(ref):
        rows = units(spark, TREE, ref)
        return rows.withColumn("nth", F.lit(1)).unionByName(rows.where("symbol = 'f'").withColumn("nth", F.lit(2)))

    manifest, index, report = corpus_files.ingest(fetched("a"), spark.createDataFrame([], INDEX), root, F.lit(1))
    manifest, index = manifest.cache(), index.cache()
    first = report.first()
    assert first.inserted == index.count() > 3 and not first.wrote_nothing and {r.change for r in manifest.collect()} == {"written"}
    again, after, report = corpus_files.ingest(fetched("b"), index, root, F.lit(2), manifest)
    assert {r.change for r in again.collect()} == {"unchanged"} and report.first().wrote_nothing and sorted(map(tuple, after.collect())) == sorted(map(tuple, index.collect()))
    assert corpus_files.read_corpus(spark, root, manifest).count() == first.inserted


def test_texts_are_moved_twice_by_an_ingest(spark, tmp_path, monkeypatch):
    """Once to their shard's name and once to its file; nothing that is written on the way holds a text."""
    held = []
    for module in (corpus_files, rolling):
        plain = module.materialized
        monkeypatch.setattr(module, "materialized", lambda df, plain=plain: held.append(df.columns) or plain(df))
    rows = units(spark, TREE, "a").withColumn("nth", F.lit(1))
    root = f"file://{tmp_path}"
    manifest, _, report = corpus_files.ingest(rows.unionByName(rows.withColumn("nth", F.lit(2)).withColumn("text", F.lit("later"))), spark.createDataFrame([], INDEX), root, F.lit(1))
    assert len(held) >= 4 and not [c for c in held if "text" in c]
    got = corpus_files.read_corpus(spark, root, manifest)
    assert {(r.unit_id, r.text) for r in got.collect()} == {(r.unit_id, r.text) for r in rows.collect()} and report.first().inserted == rows.count()
