"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Texts are lower-cased words (runs of letters and digits), their shingles five words; an item of fewer
words is one shingle of all its words. A window of a
benchmark item's size that is similar to it shares most of its shingles, so windows are formed only
around shingles that occur in the benchmark (an exact look-up), in any order: every start whose window
holds as many of an item's shingles as the similarity takes is tried, for this item. Windows and items get 64-bit
SimHash fingerprints weighted by the shingles' counts. A multi-index finds all pairs within RADIUS
bits: of eight blocks one has at most two errors, so an item is entered under every block value that
far away, and a window only looks for the items whose shingles it holds: what it meets doesn't grow with the benchmark. Pairs are verified by the exact similarity of the weighted shingles, sum of minima over
sum of maxima of their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, drop_rows, text_row

SHINGLE, SIMILARITY = 5, 0.8
#: (lowest bit, bits) of the blocks, the errors a block may have, and the radius these guarantee.
BLOCKS = tuple((8 * i, 8) for i in range(8))
BLOCK_ERRORS = 2
RADIUS = len(BLOCKS) * (BLOCK_ERRORS + 1) - 1
#: Bytes of a benchmark table (or of the table of places) that are broadcast, at the most, and about what a row takes without its arrays; larger tables are joined by shuffles.
BROADCAST_BYTES, ROW_BYTES = 100_000_000, 48


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes_of(words: Column, size: int) -> Column:
    """Hashes of all shingles of `size` words, in order; empty for fewer words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.when(F.size(words) < size, F.array().cast("array<long>")).otherwise(F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size)))))


def bound(value: Column, use) -> Column:
    """use(value), value being bound by a lambda: written out, the optimizer may copy the splitting of the text into every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def item_shingles(words: Column) -> Column:
    """struct(k, shingles): shingles of five words, or one of all words if there are fewer."""

    def of(w: Column) -> Column:
        return F.struct(F.least(F.size(w), F.lit(SHINGLE)).alias("k"), F.coalesce(*(F.when(F.size(w) == k, hashes_of(w, k)) for k in range(1, SHINGLE)), hashes_of(w, SHINGLE)).alias("shingles"))

    return bound(words, of)


def text_shingles(words: Column, sizes: list[int]) -> Column:
    """array of struct(k, s): the shingles of each of some sizes."""
    return bound(words, lambda w: F.array(*(F.struct(F.lit(k).alias("k"), hashes_of(w, k).alias("s")) for k in sizes)))


def fingerprint_sql(shingles: str, lanes: int) -> str:
    """The SimHash of an array of hashes: counts of 64 / lanes bits at a time in lanes of one long."""
    width = 64 // lanes
    ones, mask = sum(1 << width * i for i in range(lanes)), (1 << width) - 1
    summed = f"aggregate({shingles}, 0L, (acc, x) -> acc + (shiftrightunsigned(x, b) & {ones}L))"
    bits = " | ".join(f"if(2 * (shiftrightunsigned(l, {width * i}) & {mask}L) > size({shingles}), shiftleft(1L, b + {width * i}), 0L)" for i in range(lanes))
    return f"aggregate(sequence(0, {width - 1}), 0L, (fp, b) -> fp | get(transform(array({summed}), l -> {bits}), 0))"


def with_fingerprint(df: DataFrame, shingles: str, name: str) -> DataFrame:
    """Adds the SimHash of an array of shingle hashes: a bit is set if it is in more than half of them. Lanes of 16 bits count up to 65,535, those of 32 bits all that an array can hold."""
    return df.withColumn(name, F.when(F.size(shingles) < 1 << 16, F.expr(fingerprint_sql(shingles, 4))).otherwise(F.expr(fingerprint_sql(shingles, 2))))


def bounded(df: DataFrame, arrays: Column | None = None) -> DataFrame:
    """Broadcast if the table is small, by its rows and the longs in its arrays as counted."""
    held = F.lit(0) if arrays is None else 8 * F.size(arrays)
    total = df.agg(F.sum(ROW_BYTES + held)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df.hint("shuffle_merge")


def block(fingerprint: str, i: int) -> Column:
    low, bits = BLOCKS[i]
    return F.shiftrightunsigned(fingerprint, low).bitwiseAND((1 << bits) - 1)


def numbered(shingles: str) -> Column:
    """The shingles so that the repeats of one differ from each other: what two arrays share then is a plain intersection."""
    in_order = bound(F.array_sort(shingles), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x))))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0).cast("long")))).otherwise(in_order)


def item_keys(items: DataFrame) -> DataFrame:
    """block, value, item, item_fp: each item under all values of each block within BLOCK_ERRORS."""
    rows = items.select("item", "item_fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), block("item_fp", i).alias("own"), F.lit(1 << bits).alias("values")) for i, (_, bits) in enumerate(BLOCKS)))).alias("b"))
    values = rows.select("item", "item_fp", "b.block", "b.own", F.explode(F.sequence(F.lit(0), F.col("b.values") - 1)).alias("value"))
    return values.filter(F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) <= BLOCK_ERRORS).select("block", F.col("value").cast("long").alias("value"), "item", "item_fp")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row (a hash of the text), item_id, start, n_shingles, distance, score: the best window per document and item that reaches `similarity`.

    start counts words from 0. A document shorter than an item is one window. An item of fewer than five words is found where all its words stand in a row. Items without words or
    without an id are not searched; null texts have no words; rows that repeat a text under an id are
    found once; a null doc_id is reported as null; an id that several items have finds the best of them. Other columns are ignored; empty tables give an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), item_shingles(words_of(F.col("text"))).alias("of")).filter("item_id is not null and size(of.shingles) > 0")
    items = items.select("item_id", "of.k", "of.shingles", F.size("of.shingles").alias("m")).withColumn("item", F.xxhash64("item_id", "k", "shingles")).dropDuplicates(["item"])
    items = checkpoint(with_fingerprint(items, "shingles", "item_fp"))
    entries = items.select("item", "k", "m", F.explode(F.array_distinct("shingles")).alias("h"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect()) or [SHINGLE]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_row(F.col("text")).alias("row"), F.col("text"))
    own = texts.select("doc_id", "row", F.explode(text_shingles(words_of(F.col("text")), sizes)).alias("own"))
    hits = own.select("doc_id", "row", "own.k", F.size("own.s").alias("n"), F.posexplode("own.s").alias("p", "h")).join(bounded(entries), ["k", "h"])
    # What the windows and the item share is at most the hits in the window, so a similar window has `need` of them, and starts where the first and last of `need` hits in a row are in it.
    need = F.ceil(similarity / (1 + similarity) * (F.least("n", "m") + F.col("m")) - 1e-9).cast("int")
    found = hits.groupBy("doc_id", "row", "item", "k", "m", "n").agg(F.sort_array(F.collect_set("p")).alias("at")).withColumn("need", need).filter("size(at) >= need")
    ranges = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("m") + 1).alias("low"), F.least(F.get("at", i), F.greatest(F.lit(0), F.col("n") - F.col("m"))).alias("high")))
    ranges = F.filter(ranges, lambda r: r["low"] <= r["high"])
    found = found.withColumn("starts", F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["low"], r["high"]))))).filter("size(starts) > 0")
    places = checkpoint(found.groupBy(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("item", "k", "m", "starts")).alias("wanted")))

    starts_held = F.flatten(F.transform("wanted", lambda w: w["starts"]))
    hit = texts.join(bounded(places, starts_held), (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_doc")))
    # The text is split once; then there's a row per item, and one per window.
    hit = hit.select("doc_id", "row", text_shingles(words_of(F.col("text")), sizes).alias("own"), "wanted").select("doc_id", "row", "own", F.explode("wanted").alias("w"))
    cut = bound(F.get(F.filter("own", lambda o: o["k"] == F.col("w.k")), F.lit(0))["s"], lambda s: F.transform("w.starts", lambda a: F.struct(a.alias("start"), F.slice(s, a + 1, F.col("w.m")).alias("win"))))
    windows = hit.select("doc_id", "row", "w.item", F.explode(cut).alias("cut")).select("doc_id", "row", "item", "cut.start", "cut.win")
    windows = with_fingerprint(windows, "win", "fp")

    keyed = windows.select("*", F.posexplode(F.array(*(block("fp", i) for i in range(len(BLOCKS))))).alias("block", "value"))
    pairs = keyed.join(bounded(item_keys(items)), ["item", "block", "value"])
    errors = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = pairs.withColumn("distance", F.bit_count(errors)).filter(F.col("distance") <= RADIUS)
    earlier = F.lit(False)  # a pair that meets in several blocks counts in the first of them
    for i, (low, bits) in enumerate(BLOCKS):
        earlier = earlier | ((F.col("block") > i) & (F.bit_count(F.shiftrightunsigned(errors, low).bitwiseAND((1 << bits) - 1)) <= BLOCK_ERRORS))
    of_items = items.select("item", "item_id", F.col("m"), numbered("shingles").alias("of_item"))
    pairs = pairs.filter(~earlier).join(bounded(of_items, F.col("of_item")), "item")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect(numbered("win"), F.col("of_item"))))
    pairs = pairs.withColumn("score", F.col("shared") / (F.size("win") + F.col("m") - F.col("shared"))).filter(F.col("score") >= similarity)
    best = F.max_by(F.struct("start", "distance", "score", F.col("m").alias("n_shingles")), F.struct("score", -F.col("start"))).alias("best")
    return pairs.groupBy("doc_id", "row", "item_id").agg(best).select(
        "doc_id", "row", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.n_shingles").cast("long").alias("n_shingles"), F.col("best.distance").cast("int").alias("distance"), "best.score"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    return drop_rows(docs, find_leaks(docs, benchmark).select("doc_id", "row").distinct())
