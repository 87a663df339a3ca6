"""A corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of documents linked by 5-word windows at a Jaccard similarity of 0.8 or more, the one of the smallest
   doc_id stays. Rows of one doc_id are one document, which stays or goes with all its texts; of its rows that repeat a text
   the one of the smallest hash of all columns stays.
3. decontaminate: documents that a benchmark item contaminates go.
4. mix: documents of sources whose budget exceeds their tokens come a second time; none is lost.
5. token_ids: ids of what is left, written to files and read back.

Each stage is written as Parquet to the cluster's shared folder and read again, so a lost executor repeats one stage at most.
Rows with a null doc_id pass stages 2 and 3. Columns of documents are kept up to stage 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, jaccard_join, mixing, quality, queries, token_output
from cairn.llm.common import free_name, stored

MIX_ENTROPY = 0.88
MIX_REPEATS = 2.0
MIX_SEED = 13


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.scored(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= queries.QUALITY_KEPT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(docs, width=5, num=80, den=100)
    ident, text, row, gone = (free_name(docs.columns, c) for c in ("_id", "_text", "_row", "_gone"))
    # Maps have no hash, but their text has.
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    hashed = {text: F.xxhash64("text"), row: F.xxhash64(*plain)}
    linked = joined.where("component_id != doc_id").select(F.col("doc_id").alias(ident), F.lit(True).alias(gone)).distinct()
    slim = docs.where("doc_id is not null").select(F.col("doc_id").alias(ident), *(h.alias(c) for c, h in hashed.items()))
    texts = slim.groupBy(ident, text).agg(F.count("*").alias("n"), F.min(row).alias(f"{row}_least")).join(linked, ident, "left")
    # Only what goes, or stays as one of several rows, is looked up, by one join that both parts below share.
    bad = texts.where((F.col("n") > 1) | F.col(gone)).select(F.col(ident).alias(f"{ident}_bad"), F.col(text).alias(f"{text}_bad"), f"{row}_least", F.coalesce(gone, F.lit(False)).alias(gone))
    marked = docs.withColumns(hashed).join(bad, (F.col("doc_id") == F.col(f"{ident}_bad")) & (F.col(text) == F.col(f"{text}_bad")), "left")
    several = marked.where(~F.col(gone) & (F.col(row) == F.col(f"{row}_least"))).dropDuplicates(["doc_id", text])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(F.col(f"{ident}_bad").isNull()).select(*kept).unionByName(several.select(*kept))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_ENTROPY, MIX_REPEATS, MIX_SEED, places=False)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
