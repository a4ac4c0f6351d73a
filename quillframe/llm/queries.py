"""The operators' queries over the whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import language, lengths, media, mixing, neardup, packing, passages, quality, repeats, sharding, tokens
from quillframe.llm.common import Scratch


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_media(spark: SparkSession, sf: str) -> DataFrame:
    return media.read_media(media.encode_media(documents(spark, sf)))


def op2_shards(spark: SparkSession, sf: str) -> DataFrame:
    dealt = sharding.shard_documents(documents(spark, sf), Scratch(spark, "shards"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op3_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.group_duplicates(documents(spark, sf), Scratch(spark, "neardup"), neardup.Rule(words=3, num=85, den=100))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    return quality.assess(documents(spark, sf), trusted)


def _remainder(mod: int):
    """crc32 of the id as text; a null id is never held out and never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def op5_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = passages.train(docs, labels.filter(_remainder(4) != 2))
    scored = passages.score(docs, model)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = language.train(docs.filter(_remainder(5) != 0))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf), tokens.default_path(), tokens=2048)


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf), Scratch(spark, "mixing"))
    first = mixed.withColumn("position", F.array_min(F.transform("copies", lambda c: c["position"])))
    placed = first.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf), Scratch(spark, "repeats"), passages=(repeats.PASSAGE, repeats.PASSAGE_GRAM))


def op10_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.length_report(lengths.length_histogram(documents(spark, sf), tokens.default_path()), Scratch(spark, "lengths"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media, op2_shards, op3_neardup, op4_quality, op5_passages, op6_language, op7_packing, op8_mixing, op9_repeats, op10_lengths)
}
SQL: dict[str, str] = {}
