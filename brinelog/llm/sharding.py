"""Size-balanced shards by sampled splitters; DataFrame operations only.

Rows are ordered by the hash of their text, so that equal texts are neighbours, and cut into shards of equal bytes:

1. draw a sample of keys with a chance in proportion to the size of the row, take its quantiles as splitters of the ranges;
2. a key that alone overfills a range gets a range of its own, subdivided by row; a range that other keys together overfill (over twice
   its share of the bytes) is subdivided at quantiles of a new sample inside it, until no such range holds two keys;
3. running sums inside each range plus the totals of the ranges before it give every row its place in the whole order;
4. the place decides the shard, so shard sizes differ by at most the largest row.

Driver and broadcasts see only the sample, whose expected number of rows is a parameter, and one row per range. Texts are read once.

Defined results: a null text has size 1 and a null checksum; a null ``doc_id`` is an ordinary row; equal rows are interchangeable; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelog.llm.common import materialize

SAMPLES_PER_RANGE = 32


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below ``key``: first among every n-th, then among the n that follow."""
    if not splitters:
        return F.lit(0)
    n = max(1, math.isqrt(len(splitters)))
    groups = [splitters[i:i + n] for i in range(0, len(splitters), n)]
    firsts = F.lit([g[0] for g in groups])
    coarse = F.size(F.filter(firsts, lambda x: x <= key))
    fine = F.get(F.array(*[F.lit(g) for g in groups]), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * n + F.size(F.filter(fine, lambda x: x <= key)))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of the key by bytes, from a size-weighted sample of about ``SAMPLES_PER_RANGE * ranges`` rows."""
    wanted = SAMPLES_PER_RANGE * ranges
    chance = F.col("size") * F.lit(wanted / total)
    draw = F.pmod(F.xxhash64(F.lit("splitter"), "doc_id", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw < chance).groupBy("key").agg(F.sum(F.greatest(F.lit(1.0), chance)).alias("w")).orderBy("key").collect()
    ends, so_far = [], 0.0
    for r in drawn:
        so_far += r.w
        ends.append(so_far)
    at = {bisect.bisect_left(ends, so_far * i / ranges) for i in range(1, ranges)} if drawn else set()
    return sorted({drawn[i].key for i in at if i < len(drawn)})


def _subdivided(rows: DataFrame, full: int, splitters: list[int]) -> list[int]:
    """``splitters`` and further ones inside every range of over twice ``full`` bytes that holds more than one key.

    A round reads the sizes of all ranges, and samples only the overfull ones, of which there are at most half as many as ranges.
    """
    while True:
        ranged = rows.withColumn("range", _range_of(F.col("key"), splitters).cast("int"))
        over = (ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
                .where((F.col("bytes") > 2 * full) & (F.col("low") < F.col("high"))).collect())
        if not over:
            return splitters
        more: set[int] = set()
        for r in over:
            inside = rows.where(F.col("key").between(r.low, r.high))
            for key in _splitters(inside, r.bytes, -(-r.bytes // full)) or [(r.low + r.high) // 2]:
                more.add(key if key > r.low else key + 1)  # low < splitter <= high, so each cuts
        splitters = sorted({*splitters, *more})


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row. ``ranges`` is the number of tasks' ranges."""
    spark = docs.sparkSession
    ranges = ranges or max(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("key")), "shard-rows")
    total, = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    full = max(1, total // ranges)
    heavy = (rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
             .where((F.col("bytes") > full) & (F.col("n") > 1)).orderBy("key").collect())  # at most ``ranges`` keys
    pieces = spark.createDataFrame([(r.key, n, -(-r.bytes // full)) for n, r in enumerate(heavy, 1)], "key long, own int, pieces long")
    rows = rows.join(F.broadcast(pieces), "key", "left").withColumns({
        "own": F.coalesce("own", F.lit(0)),
        "sub": F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.coalesce("pieces", F.lit(1)))})
    splitters = _subdivided(rows.where("own = 0"), full, _splitters(rows, total, ranges)) if total else []
    rows = rows.withColumn("range", _range_of(F.col("key"), splitters).cast("int"))

    slices = [F.col("range"), F.col("own"), F.col("sub")]
    inside = Window.partitionBy(*slices).orderBy("key", "doc_id")
    counted = rows.groupBy(*slices).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy(*slices).collect()
    starts, at_bytes, at_row = [], 0, 0
    for r in counted:
        starts.append((r.range, r.own, r.sub, at_bytes, at_row))
        at_bytes, at_row = at_bytes + r.bytes, at_row + r.n
    before = spark.createDataFrame(starts, "range int, own int, sub long, bytes_before long, rows_before long")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumns({"upto": F.sum("size").over(upto), "nth": F.row_number().over(inside)})
              .join(F.broadcast(before), ["range", "own", "sub"])
              .withColumn("middle", F.col("bytes_before") + F.col("upto") - F.col("size") / 2)
              .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / max(1, total))).cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth") - 1).alias("place")))
    placed = materialize(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
