"""Registered queries against their SQL, held-out accuracy, and the pipeline stage by stage."""

import os

import corpus_pipeline
import pytest
from compare import compare, open_duckdb

from hindcast.llm import decontaminate, jaccard_join
from hindcast.llm.oracle import ORACLE
from hindcast.llm.queries import QUERIES

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(spark, open_duckdb(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER)[0] is None


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op3_toxicity"](spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    wrong = [r for r in rows if r["predicted"] != r["toxic"]]
    assert len(wrong) <= 0.05 * len(rows) and not [r for r in wrong if r["predicted"]]


def test_language_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op9_language_gru"](spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_pipeline_with_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns named like those of the stages."""
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, text(i), "en", "s1", 10, 0.5, "mine", i) for i in range(40)]
    rows += [(40, text(0), "en", "s1", 10, 0.7, "copy", 40), (41, None, None, None, None, None, None, None), (42, "", "en", "s2", 0, 0.1, "x", 1), (None, text(50), "en", "s2", 1, 0.1, "x", 2)]
    rows += [rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, hits long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(7)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, after, str(tmp_path)), name)
        assert after.columns == docs.columns
        sizes.append(after.count())
    left = {tuple(r) for r in after.collect()}
    assert left <= set(rows) and not {r for r in left if r[0] in (7, 40)}
    assert {r for r in left if r[0] in (None, 41, 42)} == {r for r in rows if r[0] in (None, 41, 42)}
    assert sizes[1] - sizes[2] == 1 and sizes[0] - sizes[1] >= 3
    placed = corpus_pipeline.assign_shards(spark, after, str(tmp_path))
    assert placed.count() == after.count()
    nothing = docs.limit(0)
    for _name, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.written(stage(spark, nothing, str(tmp_path)), "nothing")
    assert nothing.count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, seen[-1], FOLDER), name)
        assert name == "sharding" or after.columns == columns
        seen.append(after)
    ids = [[r["doc_id"] for r in df.select("doc_id").collect()] for df in seen]
    start, clean, single, pure, mixed, placed = ids
    assert set(clean) <= set(start) and set(single) <= set(clean) and set(pure) <= set(single) and set(mixed) <= set(pure)
    assert sorted(placed) == sorted(mixed)
    classes = jaccard_join.joined(seen[1], similarity=jaccard_join.Similarity(5, 80, 100)).collect()
    assert sorted(single) == sorted({r["component_id"] for r in classes})
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.judged(seen[2], benchmark).where("contaminated").collect()}
    assert sorted(pure) == sorted(set(single) - hit)
