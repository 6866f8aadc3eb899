"""The corpus pipeline on planted cases, stage by stage."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_operators import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    passage, boiler = words(80, 900), words(9, 901)
    rows = [(i, words(120 + i % 60, i) + ".") for i in range(80)]
    rows += [(100 + i, words(200, 40)) for i in range(4)]  # exact copies
    rows += [(200, words(150, 7777)), (201, words(150, 7777) + " tail"), (300, f"{words(90, 301)} {passage} {words(60, 302)}"), (301, f"{words(70, 303)} {passage} {words(50, 304)}")]
    rows += [(400 + i, f"{boiler} {boiler}\n{words(100, 410 + i)}") for i in range(6)]
    rows += [(500 + i, " ".join(w + "%%%" for w in words(70, 500 + i).split())) for i in range(8)] + [(600, "too short"), (601, None)]
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], COLUMNS)


def test_stages(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    clean = set(range(80))
    assert not ids["quality_rules"] & {*range(500, 508), 600, 601} and ids["quality_rules"] >= clean
    boiled = {r.doc_id: r.text for r in seen["line_dedup"].where("doc_id between 400 and 405").collect()}
    assert [("\n" in boiled[i]) for i in range(400, 406)] == [False] * 5 + [True]
    assert ids["near_dedup"] >= clean and ids["near_dedup"] & {*range(100, 104)} == {100} and ids["near_dedup"] & {200, 201} == {200}
    cut = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert words(80, 900) in cut[300].text and words(80, 900) not in cut[301].text and words(70, 303) in cut[301].text
    assert all(r.n_chars == len(r.text) for r in cut.values()) and all(cut[i].text == words(120 + i % 60, i) + "." for i in clean)
    for name in list(ids)[:-1]:
        assert seen[name].columns == docs.columns
    assert ids["best_fit_packing"] == ids["substring_dedup"]


def test_run_equals_the_stages_and_takes_an_empty_table(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert len({r.doc_id for r in rows}) > 80 and all(n <= 1024 for n in collections.Counter({s: sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}}).values())
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_columns_of_any_name_do_not_clash(spark):
    docs = spark.createDataFrame([(i, words(60, i) + ".", "d", "r", "k", "s", "b", "n") for i in range(12)], "doc_id long, text string, doc string, rid string, spans string, keep_bitmap string, __doc string, node string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r.doc, r.rid, r.spans, r.keep_bitmap, r.node) for r in out.collect()} == {("d", "r", "k", "s", "n")}
