"""Shared pieces of the corpus operators: reading tables, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that spread_join() splits, at the most.
HOT_KEYS = 1000
#: ASCII white space of the word pattern [^\x20\x09-\x0D]+ (fixed values).
SPACE = b" \t\n\v\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder spark.checkpoint.dir. Only a local master may leave that unset, and gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="docloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_row(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, but_one: bool = False) -> DataFrame:
    """docs without the rows (doc_id, text hash), or with one of each of them. All columns are kept."""
    doc_id, row = fresh(docs, "gone_id"), fresh(docs, "gone_row")
    gone = gone.select(F.col("doc_id").alias(doc_id), F.col("row").alias(row))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc_id)) & (text_row(docs["text"]) == F.col(row))
    if not but_one:
        return docs.join(gone, same, "left_anti")
    if not gone.limit(1).count():
        return docs
    return docs.join(gone, same, "left_anti").unionByName(docs.join(gone, same).dropDuplicates([doc_id, row]).drop(doc_id, row))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right on one column, a key that many rows of left have being split over several tasks.

    A key is hot with more than a thousandth of the rows of left (1,000 rows at least), so at most HOT_KEYS keys are,
    and the table of them is small. Rows of left with a hot key are dealt by a hash of the whole row,
    and the rows of right with it are repeated once per share: at most 2 * HOT_KEYS more for a right side with distinct keys.
    Without a hot key it's a plain join. left should be a checkpoint: its keys are counted first.
    """
    n, shares, share = (fresh(left, fresh(right, x)) for x in ("n_rows", "n_shares", "share"))
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    rows, greatest = counts.agg(F.sum(n), F.max(n)).first()
    most = max(1000, -(-(rows or 0) // HOT_KEYS))
    if (greatest or 0) <= most:
        return left.join(right, key, how)
    hot = counts.filter(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias(shares))
    hot = F.broadcast(left.sparkSession.createDataFrame(hot.collect(), hot.schema))
    dealt = left.join(hot, key, "left").withColumn(share, F.when(F.col(shares).isNull(), 0).otherwise(F.pmod(F.xxhash64(*(left[c] for c in left.columns)), F.col(shares)).cast("int"))).drop(shares)
    copies = right.join(hot, key, "left").withColumn(share, F.explode(F.sequence(F.lit(0), F.coalesce(shares, F.lit(1)) - 1))).drop(shares)
    return dealt.join(copies, [key, share], how).drop(share)


def key_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns can have any name."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give memory that isn't in use back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (null: empty) of Arrow batches, in groups of about `most` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for start, end in slices_by_bytes(sizes, most):
            part = batch.slice(start, end - start)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
        release()


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def slices_by_bytes(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose lengths add up to `most` at the most (a longer item stands alone)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
