"""Token totals for every context limit from one exact histogram of lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import Scratch, blocks, columns_of, in_arrow
from quillframe.llm.tokens import Encoder

#: Lengths that one slice of the histogram spans; suffix sums run in slices, then across them.
SLICE = 128


def length_histogram(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many whole texts encode to each length. Null and empty texts have length 0.

    A task counts its own texts first, so the shuffle has a row for each task and length. Repeated rows
    count each; other columns, whatever their names, are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, seen = Encoder.at(tokenizer), Counter()
        for rows, _, _ in blocks(batches):
            seen.update(len(x) // 4 for x in encoder.ids(rows.column(0).to_pylist()))
        if seen:
            yield {"n_tokens": np.fromiter(seen.keys(), np.int64), "n_docs": np.fromiter(seen.values(), np.int64)}

    counted = in_arrow(columns_of(df, text=text_col), run, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_report(histogram: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each length L that occurs, with sums over the histogram, which is made once and kept:

    docs_up_to and tokens_up_to (length <= L), docs_over and tokens_over (length > L), share_up_to
    (the fraction of documents no longer than L: L is their quantile), and tokens_truncated, the
    tokens left when every document is cut to L. Between two lengths that occur, the answer for a
    limit follows from the next lower row: tokens_truncated + (limit - L) * docs_over. No rows, no report.
    """
    cells = scratch.keep(histogram).withColumn("slice", F.floor(F.col("n_tokens") / SLICE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    slices = cells.groupBy("slice").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    carried = slices.select(
        F.col("slice").alias("of"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("t").over(everything).alias("t_all"),
    )
    longer = Window.partitionBy("slice").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    suffix = cells.withColumn("d_own", F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).withColumn("t_own", F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
    over, tokens_over = F.col("d_after") + F.col("d_own"), F.col("t_after") + F.col("t_own")
    return suffix.join(carried, F.col("slice") == F.col("of")).select(
        "n_tokens",
        "n_docs",
        (F.col("d_all") - over).alias("docs_up_to"),
        over.alias("docs_over"),
        (F.col("t_all") - tokens_over).alias("tokens_up_to"),
        tokens_over.alias("tokens_over"),
        (F.col("t_all") - tokens_over + F.col("n_tokens") * over).alias("tokens_truncated"),
        ((F.col("d_all") - over) / F.col("d_all")).alias("share_up_to"),
    )
