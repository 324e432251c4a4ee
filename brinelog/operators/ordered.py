"""Sequence operators that hold when one key owns a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here every key is cut into slices that follow the
order, the window runs inside a slice, and a small table with one row per (key, slice) carries the state across slices.

Only keys of more than ``HOT_ROWS`` rows are cut in ``accumulate``. If there are none, one window over the keys does the work: the rows are shuffled
once, and no table of slices is made that would be as long as the rows where keys are many and small.

Without ``slice_by`` the slices are ranges of (keys, order) between quantiles of a bounded sample: ranges hold about equal numbers of rows and grow in number
with the input, so one hot key, a burst within an hour or one path prefix becomes several even tasks, and many small keys share
a range. ``slice_by`` may name a column that never decreases along ``order`` instead, where such a column bounds the slices; that saves the sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

G, S, R, H = "_group", "_slice", "_local", "_hot"


def hour_slice(ts: str | Column) -> Column:
    """Hours since 1970 of a timestamp."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(col.cast("timestamp")) / 3600)


def block_slice(n: str | Column, width: int = 65536) -> Column:
    """Blocks of ``width`` consecutive values of an ordinal."""
    col = F.col(n) if isinstance(n, str) else n
    return F.floor(col / width)


HOT_ROWS = 1 << 17  # rows of a key that are still sorted in one task
RANGE_ROWS = 1 << 20  # rows of a range, beyond as many ranges as there are shuffle partitions
SAMPLES_PER_RANGE = 64


def _literal(value: object, kind: T.DataType) -> Column:
    """A collected value as a literal of the type it had (times are collected as text)."""
    return F.lit(value).cast(kind)


def range_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> Column:
    """Number of the range of (keys, order) that holds a row, from 0.

    Bounds are quantiles of a sample of about ``SAMPLES_PER_RANGE`` rows a range; they only decide how even the ranges are. Rows that agree in all
    of ``keys`` and ``order`` fall into one range.
    """
    names = [*dict.fromkeys([*keys, *order])]
    kinds = {f.name: f.dataType for f in df.select(*names).schema}
    timed = [n for n in names if isinstance(kinds[n], T.TimestampType | T.TimestampNTZType)]
    narrow = df.select(*names)
    rows = narrow.count()
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    drawn = narrow.sample(min(1.0, SAMPLES_PER_RANGE * ranges / max(rows, 1)), 17).orderBy(*names)
    drawn = drawn.withColumns({n: F.col(n).cast("string") for n in timed}).collect()
    cuts = list(dict.fromkeys(tuple(drawn[len(drawn) * i // ranges]) for i in range(1, ranges))) if drawn else []
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[_literal(v, kinds[n]).alias(n) for n, v in zip(names, cut)]) for cut in cuts])
    # Binary search: the number of bounds at or below the row grows by halved steps; beyond the last bound ``get`` is null.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def number(place: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(bounds, n + step - 1) <= place, n + step).otherwise(n))

    # As an item of an array the place is made once a row, not once a comparison.
    return F.get(F.transform(F.array(F.struct(*names)), number), F.lit(0))


def _sliced(df: DataFrame, keys: Sequence[str], slice_by: Column | None, order: Sequence[str]) -> DataFrame:
    slice_by = range_slice(df, keys, order) if slice_by is None else slice_by
    # Structs are never null, so rows with a null key or order value keep their place in the join as well.
    group = F.struct(*keys) if keys else F.lit(0)
    return df.withColumns({G: group, S: F.struct(slice_by.alias("at"))})


def _position(order: Sequence[str]) -> Column:
    """One plain column where possible: minima and maxima by it then run as hash aggregates, without a sort."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _inside(order: Sequence[str]):
    return Window.partitionBy(G, S).orderBy(*order)


def _across():
    return Window.partitionBy(G).orderBy(S)


def _before():
    return _across().rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.join(carried, [G, S]).drop(G, S)


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Number of rows, and of those of the largest key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    return total or 0, most or 0


def spread(df: DataFrame, keys: Sequence[str], rows: int, each: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys``, so that about ``each`` (``RANGE_ROWS``) of its ``rows`` go to a task; few rows are left to Spark.

    Spark joins partitions by compressed bytes, which may be several million short rows a task; a number given is kept.
    """
    each = each or RANGE_ROWS
    if rows <= each:
        return df
    return df.repartition(max(rows // each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _accumulate_small(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], exclusive: Sequence[str],
                      whole: dict[str, tuple[str, Column]], rows: int) -> DataFrame:
    key = Window.partitionBy(*keys)
    up = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.coalesce(F.sum(v).over(below if n in exclusive else up), F.lit(0)) for n, v in totals.items()}
    return spread(df, keys, rows).withColumns(sums | {n: getattr(F, fn)(v).over(key) for n, (fn, v) in whole.items()})


def accumulate(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None,
               totals: dict[str, Column], exclusive: Sequence[str] = (), whole: dict[str, tuple[str, Column]] | None = None,
               sizes: tuple[int, int] | None = None) -> DataFrame:
    """Running sums ``name: addend`` up to the row (names in ``exclusive``: before it), all in one pass.

    ``whole`` adds facts of the whole key, ``name: (function, value)`` with function sum, min or max; they come from the
    slice table as well, so they cost no further pass over the rows. ``sizes`` gives ``key_sizes`` (or those of coarser keys) where they
    are known, 0 rows if ``df`` is dealt by the keys already; they only decide how the work is dealt.
    """
    whole = whole or {}
    if keys:
        sizes = sizes or key_sizes(df, keys)
        if sizes[1] <= HOT_ROWS:
            return _accumulate_small(df, keys, order, totals, exclusive, whole, sizes[0])
        if slice_by is not None:
            return _accumulate_hot(df, keys, order, slice_by, totals, exclusive, whole)
    rows = _sliced(df, keys, slice_by, order)
    return _attach_carried(rows, rows, order, totals, exclusive, whole)


def _accumulate_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, totals: dict[str, Column],
                    exclusive: Sequence[str], whole: dict[str, tuple[str, Column]]) -> DataFrame:
    """Slices for the keys of over ``HOT_ROWS`` rows, of which there are few; any other key is one slice and carries nothing."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(F.struct(*keys).alias(G), F.lit(True).alias(H))
    marked = df.withColumn(G, F.struct(*keys)).join(F.broadcast(hot), G, "left")
    rows = marked.withColumn(S, F.struct(F.when(F.col(H), slice_by).alias("at")))
    return _attach_carried(rows, rows.where(H), order, totals, exclusive, whole).drop(H)


def _attach_carried(rows: DataFrame, cut: DataFrame, order: Sequence[str], totals: dict[str, Column], exclusive: Sequence[str],
                    whole: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sums inside the slices of ``rows`` and what the slices before add; ``cut`` has the rows of keys with several slices."""
    every = Window.partitionBy(G)
    parts = [F.sum(v).alias(f"_{n}") for n, v in totals.items()]
    parts += [getattr(F, fn)(v).alias(n) for n, (fn, v) in whole.items()]
    carried = cut.groupBy(G, S).agg(*parts).select(
        G, S, *[F.coalesce(F.sum(f"_{n}").over(_before()), F.lit(0)).alias(f"_{n}") for n in totals],
        *[getattr(F, fn)(n).over(every).alias(f"_whole_{n}") for n, (fn, _) in whole.items()])
    up = _inside(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = _inside(order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.coalesce(F.sum(v).over(below if n in exclusive else up), F.lit(0))
                              for n, v in totals.items()})
    if cut is rows:
        joined = _attach(local, carried)
        facts = {n: F.col(f"_whole_{n}") for n in whole}
    else:
        one = Window.partitionBy(G, S)
        local = local.withColumns({n: getattr(F, fn)(v).over(one) for n, (fn, v) in whole.items()})
        joined = local.join(carried, [G, S], "left").drop(G, S)
        facts = {n: F.when(F.col(H), F.col(f"_whole_{n}")).otherwise(F.col(n)) for n in whole}
    sums = {n: F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in totals}
    return joined.withColumns(sums | facts).drop(*[f"_{n}" for n in totals], *[f"_whole_{n}" for n in whole])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None = None, out: str = "rn",
                sizes: tuple[int, int] | None = None) -> DataFrame:
    """1-based position within ``keys``."""
    return accumulate(df, keys, order, slice_by, {out: F.lit(1).cast("bigint")}, sizes=sizes)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None, value: str,
                out: str, exclusive: bool = False) -> DataFrame:
    """Sum of ``value`` up to this row (``exclusive``: before it)."""
    return accumulate(df, keys, order, slice_by, {out: F.col(value)}, [out] if exclusive else [])


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None = None,
               prev: dict[str, str] | None = None, next: dict[str, str] | None = None) -> DataFrame:
    """Values of the previous and next row: ``prev``/``next`` map a source column to its output name."""
    prev, next = prev or {}, next or {}
    rows = _sliced(df, keys, slice_by, order)
    aggs, carry, local = [], [G, S], {R: F.struct(F.row_number().over(_inside(order)).alias("up"),
                                                  F.lead(F.lit(1)).over(_inside(order)).alias("more"))}
    position = _position(order)
    for src in prev:
        aggs.append(F.max_by(src, position).alias(f"_tail_{src}"))
        carry.append(F.lag(f"_tail_{src}").over(_across()).alias(f"_tail_{src}"))
    for src in next:
        aggs.append(F.min_by(src, position).alias(f"_head_{src}"))
        carry.append(F.lead(f"_head_{src}").over(_across()).alias(f"_head_{src}"))
    carried = rows.groupBy(G, S).agg(*aggs).select(*carry)
    for src, out in prev.items():
        local[out] = F.lag(src).over(_inside(order))
    for src, out in next.items():
        local[out] = F.lead(src).over(_inside(order))
    done = rows.withColumns(local).join(carried, [G, S])
    fixed = {out: F.when(F.col(R)["up"] == 1, F.col(f"_tail_{src}")).otherwise(F.col(out)) for src, out in prev.items()}
    fixed |= {out: F.when(F.col(R)["more"].isNull(), F.col(f"_head_{src}")).otherwise(F.col(out))
              for src, out in next.items()}
    borders = [f"_tail_{c}" for c in prev] + [f"_head_{c}" for c in next]
    return done.withColumns(fixed).drop(G, S, R, *borders)


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None,
                 cols: Sequence[str], position: Column | None = None) -> DataFrame:
    """Last non-null value at or before the row, each column on its own. ``position`` may name a plain column that
    orders the rows that hold values."""
    rows = _sliced(df, keys, slice_by, order)
    position = _position(order) if position is None else position
    carried = rows.groupBy(G, S).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_{c}") for c in cols]
    ).select(G, S, *[F.last(f"_{c}", ignorenulls=True).over(_before()).alias(f"_{c}") for c in cols])
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in cols})
    filled = _attach(local, carried)
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in cols}).drop(*[f"_{c}" for c in cols])


def with_group_stats(df: DataFrame, keys: Sequence[str], sizes: tuple[int, int] | None = None, /, **aggs: Column) -> DataFrame:
    """Attach per-key aggregates by a pre-aggregated join instead of a window over the whole key.

    Where ``sizes`` (``key_sizes``) says that no key is hot, a window does it: one shuffle, which steps by the same keys use again.
    """
    if sizes is not None and sizes[1] <= HOT_ROWS:
        return spread(df, keys, sizes[0]).withColumns({n: a.over(Window.partitionBy(*keys)) for n, a in aggs.items()})
    rows = df.withColumn(G, F.struct(*keys))
    return rows.join(rows.groupBy(G).agg(*[a.alias(n) for n, a in aggs.items()]), G).drop(G)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
