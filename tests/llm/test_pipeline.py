import re

import corpus_pipeline
from pyspark.sql import functions as F

from fleetlens.llm import bpe, jaccard_join, mixing, secret_scans, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, SF))
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert docs.count() > sizes[0] >= sizes[1] == sizes[2]
    tokens = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert tokens.count() == sizes[3]
    again = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tokens.select(*columns).collect()) == sorted(again.select(*columns).collect())
    assert bpe.encode(kept).count() == sizes[3]


def test_no_near_copies_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = jaccard_join.one_of_each(docs)
    assert jaccard_join.join(kept).where(F.col("n_links") > 0).count() == 0
    assert mixing.mixed(kept).columns == docs.columns


def test_other_columns_of_any_name_and_type_pass_all_stages(spark, docs):
    names = ["toxicity", "_text", "_set_id", "_toxicity_text", "_secret_all", "_mix_key", "row", "a.b"]
    wide = docs.select(
        "*", *[F.lit(n).alias(n) for n in names], F.create_map(F.lit("k"), F.lit(1)).alias("map")
    )
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(wide, toxicity.train(wide, labels)).select("row.*")
    for out in (scored, jaccard_join.one_of_each(wide), secret_scans.redacted(wide), mixing.mixed(wide)):
        assert out.columns == wide.columns
        for row in out.collect():
            assert [row[n] for n in names] == names and row["map"] == {"k": 1}
