"""The pipeline's stages on small tables, and as a whole against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from saleslode.llm import pseudonyms, stages
from test_llm_operators import brute_components, brute_contamination, frame, odd_texts

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def texts_for_stages():
    r = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    near = [b.replace(b.split(" ")[50], "edited", 1) for b in base[:6]]
    return base + near + base[:3] + odd_texts()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_handles_odd_and_empty_tables(spark, name, stage):
    docs = frame(spark, odd_texts()).drop("k_id", "set_id")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn(
        "doc_id", F.lit(None).cast("long")))
    out = stage(spark, docs, FOLDER)
    if name != "packing":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_one_of_each_group_stays(spark):
    texts = texts_for_stages()
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id in (0, 4)"))
    left = [r.doc_id for r in stages.deduplicated(spark, docs, FOLDER).collect()]
    groups = brute_components(list(enumerate(texts)), 5, 80)
    assert sorted(left) == sorted(i for i, (_, root) in groups.items() if i == root)


def test_contaminated_documents_go(spark):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet")
             .orderBy("item_id").limit(3).collect()]
    texts = [*items, items[0] + " and more words " * 10, "clean words only here", None, ""]
    left = {r.doc_id for r in stages.decontaminated(spark, frame(spark, texts), FOLDER).collect()}
    table = [(r.item_id, r.text) for r in
             spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    judged = brute_contamination(texts, table)
    assert left == {i for i, x in enumerate(judged) if not x[4]} and len(left) < len(texts)


def test_pseudonyms_change_only_values(spark):
    texts = ["card 4111111111111111 here", "nothing", None, ""]
    rows = stages.pseudonymised(spark, frame(spark, texts), FOLDER).orderBy("doc_id").collect()
    assert [r.text for r in rows[1:]] == texts[1:]
    assert rows[0].text == pseudonyms.pseudonymise(texts[0])[0] != texts[0]


def test_pipeline_runs_whole(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count()
    per_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n"),
                                           F.max("doc_tokens").alias("m"))
    assert per_doc.where("n != m").isEmpty()
