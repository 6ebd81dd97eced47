"""A bounded, repeatable sample of labelled documents with their statistics, for fitting a classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import key_and_text, text_groups
from docloom.llm.text_stats import BASE, EXTRA, all_stats

GROUP_BYTES = 4_000_000


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def label_sample(labels: DataFrame, label: str, most: int, keep: Column | None = None) -> DataFrame:
    """About `most` rows (doc_id, label) at the most, chosen by a hash of the id, so the same rows each time.

    Rows without an id or a label are left out; an id that is labelled more than once takes its largest label; other columns are ignored; an empty table gives an empty sample.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if keep is not None:
        rows = rows.filter(keep)
    part = most / max(most, rows.count())
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * part))
    return chosen.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_stats(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sampled documents, in the order of their ids. The sample is small by construction, so it's broadcast.

    Null texts count as empty, rows without an id have no label, repeated rows count each; without any row both arrays are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            done = 0
            for keys, texts in text_groups(iter([batch]), GROUP_BYTES):
                stats = [list(all_stats(t)) for t in texts]
                part = labels[done : done + len(keys)]
                done += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(part, pa.int32()), pa.array(stats, pa.list_(pa.int64()))], ["doc_id", "label", "stats"])

    rows = key_and_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    found = rows.mapInArrow(run, "doc_id long, label int, stats array<long>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["stats"]))
    return np.array([r["stats"] for r in found], np.int64).reshape(len(found), len(BASE + EXTRA)), np.array([r["label"] for r in found], np.int64)
