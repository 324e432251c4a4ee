"""Shared helpers: tables, Arrow passes over texts, written intermediates, connected components.

Operators of this package may add columns named ``_llm_...`` on the way; tables keep clear of that prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelog.session import scratch_path

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes and collects inside go when each has ended, not when the driver next collects garbage.

    Until then they are there, so tasks of lost executors run again as ever.
    """
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    With ``drop_shuffles`` the shuffle files of the write go when it has ended (``shuffles_dropped``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark) if drop_shuffles else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def discard(df: DataFrame) -> None:
    """Delete the files of a written intermediate that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat column list such as ``"doc_id long, text string"``, for batches that Python tasks return."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_KEPT: dict[tuple, object] = {}


def kept(name: tuple, make: Callable[[], object]) -> object:
    """An object, such as an encoder with the words it has met, that a Python worker keeps from task to task; only the last one asked for."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def nothing_kept() -> None:
    """Let go what an earlier task of another operator has kept: workers are used again, and several share the memory of an executor."""
    _KEPT.clear()


def per_batch(fn: Callable[[pa.RecordBatch], dict], ddl: str) -> Rows:
    """Task function that turns each batch into the columns ``fn`` gives (name to list or array)."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for batch in batches:
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """Texts of a batch, null as empty; only a few at a time are Python strings."""
    column = batch.column(name)
    for i in range(0, len(column), 64):
        for text in column.slice(i, 64).to_pylist():
            yield "" if text is None else text


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``edges`` (columns ``a`` and ``b`` of one orderable type).

    Returns ``node, root``; only nodes that occur in an edge. Alternates a large-star and a small-star step: every node is tied to
    the smallest of its neighbours, first on the side of the larger nodes, then on the side of the smaller ones, until
    nothing changes. Aggregates combine before the shuffle and the joins split hot nodes, so a hub is no problem. Nulls and
    loops are ignored. The shuffles of a step go when it has been written.
    """
    e = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", drop_shuffles=True)
    state = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_low, "a")
        star = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(small_low.select("a", F.col("m").alias("b"))).distinct())
        before, e = e, materialize(star, "stars", drop_shuffles=True)
        discard(before)
        with shuffles_dropped(e.sparkSession):
            n, sign = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (n, sign) == state:
            break
        state = (n, sign)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
