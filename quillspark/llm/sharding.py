"""Sharding by vector bin packing: bytes, tokens and rows in balance at once.

Rows of equal text are a group and go to one shard. Only a group that no shard can hold
(more than 1 / SHARDS of all bytes or rows) is split, into pieces of like size. What is
packed, largest first, each to the shard whose residual capacity has the greatest dot
product with its vector of bytes, tokens and rows:

* each group of over 1 / (``SHARDS * FINE``) of all bytes or rows by itself (there are
  fewer than 2 x SHARDS x FINE of those), or in its pieces if it is split;
* the many small groups in ``CELLS`` cells: those of like size and like bytes per token
  are dealt by a hash of their text to the cells of that shape.

So what comes to the driver is bounded, however long the table. Slots are numbered within
cells, over several of which a large group is dealt even if it stays together, and the first
slot of each cell within its shard is known from the counts, so no task sorts a shard or a
large group.

Cases: a null or empty text has no bytes and one token; a very long text counts whole, and a
single row is never split; rows that repeat a doc_id take a slot each, and equal rows are
dealt by their place in the table; fewer rows than shards leave some shards empty; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS, FINE, CELLS = 40, 64, 32_768
#: Bounds between shapes: of bytes of a row, and of bytes for each token.
LONG, WIDE = (256, 2048, 16_384), (5, 6.5, 9)
#: What a row takes besides its text.
ROW_BYTES = 16


def pack_vectors(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``sizes``: largest first, to the greatest dot product with what is left of the shards' capacity."""
    total = np.maximum(sizes.sum(axis=0), 1e-9)
    x = sizes / (total / shards)
    left, out = np.ones((shards, sizes.shape[1])), np.zeros(len(sizes), dtype=np.int64)
    for i in np.argsort(-x.sum(axis=1), kind="stable"):
        s = int(np.argmax(left @ x[i]))
        out[i] = s
        left[s] -= x[i]
    return out


def rows_of(documents: DataFrame) -> DataFrame:
    """(row, doc_id, size, tokens, crc, g1, g2): a narrow row for each document; g1 and g2 name the text."""
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    return documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.size(F.split(text, " ")).cast("long").alias("tokens"),
        F.crc32(raw).alias("crc"), F.xxhash64(text).alias("g1"), F.hash(text).alias("g2"),
    )


def large_groups(rows: DataFrame, shards: int) -> pd.DataFrame:
    """(g1, g2, cells, split, cell): the groups that are packed by themselves, over how many cells, whether these may part, and the number of the first."""
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    b, n = max((total.b or 0) / shards, 1.0), max(total.n / shards, 1.0)
    # a row takes part in one group, so groups over a share 1/k of the bytes are fewer than k, and likewise for rows
    large = rows.groupBy("g1", "g2").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") * FINE > b) | (F.col("n") * FINE > n)).toPandas().sort_values(["g1", "g2"], ignore_index=True)
    share = np.maximum(large.b / b, large.n / n)
    large["cells"] = np.minimum(np.ceil(share * FINE), large.n).astype("int64")
    large["split"] = share > 1
    large["cell"] = CELLS + large.cells.cumsum() - large.cells
    return large[["g1", "g2", "cells", "split", "cell"]]


def place(sums: pd.DataFrame, large: pd.DataFrame, shards: int) -> pd.DataFrame:
    """(cell, shard, first): the shard of each cell of ``sums`` and its first slot there; cells of a group that is not split stay together."""
    whole = large[~large.split]
    first = pd.Series(np.repeat(whole.cell.to_numpy(), whole.cells), index=np.repeat(whole.cell.to_numpy(), whole.cells) + np.concatenate([np.arange(k) for k in whole.cells] or [np.zeros(0, int)]))
    unit = sums.cell.map(first).fillna(sums.cell).astype("int64")
    sizes = sums.groupby(unit)[["size", "tokens", "n"]].sum()
    out = sums.assign(shard=unit.map(pd.Series(pack_vectors(sizes.to_numpy(dtype=np.float64), shards), index=sizes.index)))
    out["first"] = out.groupby("shard").n.cumsum() - out.n
    return out[["cell", "shard", "first"]].astype("int64")


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, tokens, crc, shard, slot) of each document."""
    spark = documents.sparkSession
    rows = cut(rows_of(documents))
    large = large_groups(rows, shards)
    own = spark.createDataFrame(large.drop(columns="split").rename(columns={"cell": "at"}), "g1 long, g2 int, cells long, at long")
    shape = sum(((F.col("size") >= x).cast("int") for x in LONG), F.lit(0)) * (len(WIDE) + 1) + sum(((F.col("size") >= x * F.col("tokens")).cast("int") for x in WIDE), F.lit(0))
    shapes = (len(LONG) + 1) * (len(WIDE) + 1)
    small = F.pmod(F.xxhash64("g1", "g2"), F.lit(CELLS // shapes)) * shapes + shape
    placed = rows.join(F.broadcast(own), ["g1", "g2"], "left").withColumn("cell", F.coalesce(F.col("at") + F.pmod("row", "cells"), small))
    sums = placed.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toPandas().sort_values("cell", ignore_index=True)
    where = spark.createDataFrame(place(sums, large, shards), "cell long, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "crc", "size", "row")) - 1
    out = placed.withColumn("rank", rank).join(F.broadcast(where), "cell")
    return out.select("doc_id", "size", "tokens", "crc", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
