"""From raw documents to packed training sequences, each stage one operator over all that the one before kept.

Stages take (spark, docs, sf_dir) and give a DataFrame; ``run`` writes each result to the shared
folder and rereads it. All but the last return the columns of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm import mixing, neardup, packing, quality, repeats, tokens
from quillframe.llm.common import SPACE, Scratch, blocks, in_arrow

#: SQL cannot say the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ..., which no helper's name clashes with, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _repeated_ids(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.groupBy(F.col(doc_id).alias("repeated")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("repeated")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose text resembles the trusted ones (labels.quality = 1).

    Rows keep all their columns, whatever their names. A null or empty text fails the base rules. Rows that
    repeat stay or go together; null ids are trusted by nobody. No documents, none kept; no labels, the base
    rules alone decide.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return quality.keep_good(docs, trusted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id: five-word shingles, similarity 0.8.

    Rows that repeat an id and a text are one document; the first of them stays. An id may name several
    texts, and null counts as larger than any other id: each text has its own verdict, and of one id's
    texts in a group the one with the least md5 stays. Texts without words, null among them, are in no
    group. Columns may have any names; no documents, none kept.
    """
    scratch, (plain, at) = Scratch(spark, "near_dedup"), _plain(docs)
    rule = neardup.Rule(words=5, num=80, den=100)
    groups = scratch.keep(neardup.group_duplicates(plain, scratch, rule, at["doc_id"], at["text"], with_keys=True).select("doc_id", "text_key", "root"))
    # One row for each document, with the number of rows that repeat it.
    each = groups.groupBy("doc_id", "text_key").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = groups.filter("root IS NOT NULL").groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("root").alias("r"), "best")
    verdict = each.join(least, F.col("root") == F.col("r"), "left").withColumn("gone", F.coalesce(F.col("best") != rank, F.lit(False)))
    special = scratch.keep(verdict.filter("gone OR n > 1").select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "gone"))
    key = F.unhex(F.md5(F.coalesce(F.col(at["text"]), F.lit("")).cast("binary")))

    def having(these: DataFrame, how: str) -> DataFrame:
        return plain.join(these, F.col(at["doc_id"]).eqNullSafe(F.col("of")) & (key == F.col("key")), how)

    kept = having(special, "left_anti")
    twice = special.filter("NOT gone")
    if not twice.isEmpty():
        kept = kept.unionByName(having(twice, "left_semi").dropDuplicates([at["doc_id"], at["text"]]))
    return kept.toDF(*docs.columns)


#: Bytes of a passage that must not repeat: about 50 short words. The anchors' substrings leave windows enough to choose from.
PASSAGE_BYTES, PASSAGE_GRAM = 256, 100


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of PASSAGE_BYTES or more that also occur elsewhere; n_chars follows the text.

    A passage goes from every place, in rows that repeat too; a null text counts as empty and comes back
    empty. Columns may have any names. No documents, none kept.
    """
    plain, at = _plain(docs)
    rest = tuple(c for c in plain.columns if c not in (at["doc_id"], at["text"]))
    out = repeats.remove_repeats(plain, Scratch(spark, "suffix_dedup"), PASSAGE_BYTES, PASSAGE_GRAM, id_col=at["doc_id"], text_col=at["text"], keep=rest)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in at:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return out.select(*[made.get(c, F.col(at[c])).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each time the mix takes one; the last of a source is cut where its target ends.

    Rows that repeat are taken each. A text without words, null among them, is never taken. Null sources
    and ids count as any other. Columns may have any names. No documents, none taken.
    """
    scratch, (plain, at) = Scratch(spark, "mixing"), _plain(docs)
    doc_id, text, source = (at[c] for c in ("doc_id", "text", "source"))
    mixed = mixing.mix_sources(plain, scratch, id_col=doc_id, text_col=text, source_col=source)
    copies = scratch.keep(mixed.select(F.col("doc_id").alias("of"), F.col("source").alias("of_source"), "size", F.explode("copies").alias("copy")))
    if _repeated_ids(plain, doc_id).isEmpty():
        joined = plain.join(copies, F.col(doc_id).eqNullSafe(F.col("of")))
    else:
        # Rows of one id are told apart by their number among those of equal source and size.
        sized = plain.withColumn("words", F.coalesce(F.regexp_count(text, F.lit(mixing.WORD)), F.lit(0)).cast("long"))
        left = sized.withColumn("n", F.row_number().over(Window.partitionBy(doc_id, source, "words").orderBy(F.xxhash64(text))))
        right = copies.withColumn("m", F.row_number().over(Window.partitionBy("of", "of_source", "size", "copy.epoch").orderBy("copy.position")))
        same = F.col(doc_id).eqNullSafe(F.col("of")) & F.col(source).eqNullSafe(F.col("of_source")) & (F.col("words") == F.col("size")) & (F.col("n") == F.col("m"))
        joined = left.join(right, same)
    ordered = joined.select(*plain.columns, "size", "copy.*").repartitionByRange("position").sortWithinPartitions("position", doc_id, "epoch")
    return _cut(ordered.select(*plain.columns, "size", "taken"), docs)


def _cut(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts after their first __taken words, where those are fewer than __size."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, chars = names[docs.columns.index("text")], names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches, text):
            out = {n: block.column(i) for i, n in enumerate(names)}
            size, taken = block.column(len(names)).to_numpy(), block.column(len(names) + 1).to_numpy()
            short = np.flatnonzero(taken < size)
            if len(short):
                texts, counts = out[text].to_pylist(), out[chars].to_pylist() if chars else []
                for i in short:
                    own = data[offsets[i] : offsets[i + 1]]
                    inside = ~SPACE[own]
                    ends = np.flatnonzero(inside & np.append(~inside[1:], True)) + 1
                    texts[i] = own[: ends[taken[i] - 1]].tobytes().decode()
                    if chars:
                        counts[i] = len(texts[i])
                out[text] = texts
                if chars:
                    out[chars] = counts
            yield out

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    return in_arrow(rows.toDF(*names, "size", "taken"), run, schema).toDF(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids. Rows that repeat are packed each; a null or empty text is its end
    token alone; other columns, whatever their names, are not read. No documents, no pieces.

    Of a table that one Spark job wrote, sequence ids rise in the order it was written in, from block to
    block of some thousand documents, so that the mix's training order holds. Other rows are numbered as
    tasks read them."""
    plain, at = _plain(docs)
    order = _written_order(docs)
    if order:
        plain = docs.select(F.col("doc_id").alias(at["doc_id"]), F.col("text").alias(at["text"]), *[c.alias(n) for c, n in zip(order, ("file", "row"), strict=True)])
    return packing.pack_documents(plain, tokens.default_path(), tokens=2048, id_col=at["doc_id"], text_col=at["text"], order_cols=("file", "row") if order else None, with_ids=True)


def _written_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """Number of a row's part file and of the row in it; None where docs is not read from files with one number each."""
    found = [re.match(r"part-(\d+)-", f.rsplit("/", 1)[-1]) for f in docs.inputFiles()]
    if not found or None in found or len({int(m[1]) for m in found}) < len(found):
        return None
    place = docs.metadataColumn("_metadata")
    return F.regexp_extract(place["file_name"], r"part-(\d+)-", 1).cast("long"), place["row_index"]


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before kept; what a stage has written on the way goes when it is done."""
    scratch, docs, last = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        before = list(Scratch.opened)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
            for own in [s for s in Scratch.opened if s not in before]:
                own.close()
            if last is not None:
                scratch.drop(last)
            last = docs
    return docs
