"""The queries of this subpackage, as ``__spark_entry__`` registers them, and the SQL that some of them equal."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod
from .oracles import ORACLE_SQL  # noqa: F401  read by __spark_entry__

QUALITY_KEPT = 0.3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(crc_mod("doc_id", 5) != 0))
    held = docs.select("doc_id", "text")
    return language_id.predict(held, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import preference, reply_pairs

    return preference(reply_pairs(_read(spark, sf_dir, "conversations")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(_read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_pass", "mix_place")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    from . import quality

    learn = crc_mod("doc_id", 5) != 0
    return quality.train(docs.where(learn), labels.where(learn))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _read(spark, sf_dir, "documents")
    model = quality_model(docs, _read(spark, sf_dir, "labels"))
    out = quality.scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_KEPT).cast("int").alias("predicted"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_model

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    model = language_model.train(docs.where(~held_out).select("text"))
    return language_model.scored(docs, model, held_out)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op1_language_id": op1_language_id, "op2_jaccard_join": op2_jaccard_join, "op3_token_output": op3_token_output, "op4_decontaminate": op4_decontaminate, "op5_token_counts": op5_token_counts, "op6_chat_format": op6_chat_format, "op7_mixing": op7_mixing, "op8_embedding_dedup": op8_embedding_dedup, "op9_quality": op9_quality, "op10_language_model": op10_language_model, "op11_spelling_variants": op11_spelling_variants, "op12_source_divergence": op12_source_divergence, "op13_nearest": op13_nearest}
