"""What the two trained scorers share: folds, and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_measured


def held_out(doc_id: Column) -> Column:
    """Is the row kept from training? A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int], most_bytes: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, y, text): training documents with a label of 0 or 1, at most ``limits[y]`` ids of each, by hash.

    With ``most_bytes`` the documents of a class that come first by hash are taken, each as a whole, as long as their texts have no more bytes together; one with
    more than a sixteenth of that is passed over. An id with both labels counts as 1; null labels are skipped; where rows repeat an id, one text is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.checkpoint()
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in limits.items()]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.union(p)
    picked = picked.checkpoint()
    rows = join_measured(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), picked, "doc_id", rows=sum(limits.values()))
    if most_bytes:
        # of the few thousand rows picked, narrow
        sizes = rows.groupBy("doc_id", "y").agg(F.max(F.octet_length("text").cast("long")).alias("size"))
        most = F.create_map(*(F.lit(x) for pair in most_bytes.items() for x in pair))[F.col("y")]
        sizes = sizes.where(F.col("size") * 16 <= most).withColumn("sum", F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")))
        rows = join_measured(rows, sizes.where(F.col("sum") <= most).select("doc_id", "y").checkpoint(), ["doc_id", "y"], rows=sum(limits.values()))
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).checkpoint()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
