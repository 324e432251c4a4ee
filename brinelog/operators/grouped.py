"""Python steps on bounded groups, with the work spread by Spark.

Adaptive execution merges small partitions by bytes, which would leave slow Python work to a few tasks; a repartition
with a number is left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def per_group(df: DataFrame, key: str, order: Sequence[str], fn: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """Run ``fn(key value, columns as arrays) -> rows`` on the rows of each key, in ``order``. Groups must be bounded."""
    def each(cuts: list[int], cols: dict) -> list[tuple]:
        return [row for a, b in zip(cuts, cuts[1:]) for row in fn(cols[key][a], {c: v[a:b] for c, v in cols.items()})]

    return per_groups(df, key, order, each, schema)


def per_groups(df: DataFrame, key: str, order: Sequence[str], fn: Callable[[list[int], dict], list[tuple]], schema: str) -> DataFrame:
    """Run ``fn(cuts, columns as arrays) -> rows`` on many whole groups at once: one lies between each two of ``cuts``.

    Groups must be bounded. They stream by in sorted partitions, so many small groups share one Arrow batch and only the
    group at a batch border is carried over.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def finished(rows: pd.DataFrame) -> pd.DataFrame:
            values = rows[key].to_numpy()
            cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
            cols = {c: rows[c].to_numpy() for c in rows.columns}
            return pd.DataFrame(fn(cuts, cols), columns=names)

        for pdf in batches:
            if pdf.empty:
                continue
            rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            same = rows[key] == rows[key].iat[-1]
            closed, rest = rows[~same], rows[same]
            if not closed.empty:
                yield finished(closed)
        if rest is not None and not rest.empty:
            yield finished(rest)

    return _spread(df, [key]).sortWithinPartitions(key, *order).mapInPandas(run, schema)
