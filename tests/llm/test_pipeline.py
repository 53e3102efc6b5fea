"""The stages one after another, on the smallest tables and on odd rows."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline as pipeline


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit(1)).withColumn("id", F.lit("x")).withColumn("lines_removed", F.lit("own"))
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(odd)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = pipeline.drop_toxic(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    learned = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    assert sum(labels[i] == (i not in ids) for i in learned) / len(learned) > 0.95
    lines = pipeline.drop_repeated_lines(spark, kept, sf_dir).cache()
    assert lines.columns == docs.columns and lines.where("lines_removed = 'own'").count() == lines.count()
    assert 0 < lines.count() <= kept.count()
    assert lines.where("text is not null and n_chars <> length(text)").count() == 0
    near = pipeline.drop_near_duplicates(spark, lines, sf_dir)
    assert near.columns == docs.columns and near.count() <= lines.count()
    assert pipeline.pack(spark, near, sf_dir).agg(F.sum("length")).first()[0] > 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]


def test_stages_of_empty_and_repeated_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.count() == 0
    twice = docs.limit(5).union(docs.limit(5))
    for name, stage in pipeline.STAGES[:3]:
        kept = stage(spark, twice, sf_dir).groupBy("doc_id").count().collect()
        assert kept and all(r["count"] == 2 for r in kept), name
