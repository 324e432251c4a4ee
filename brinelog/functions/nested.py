"""JSON selectors and recursion over nested values."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def selector_steps(expr: str) -> list[str]:
    return [s for s in re.split(r"\s+", re.sub(r":", " :", expr)) if s]


def json_hits(df: DataFrame, col: str, expr: str, out: str) -> DataFrame:
    """One row per hit of a selector chain, as a variant: ``key``, ``key=value``, ``:first``, ``:last``.

    A list passes its items on, an object without the key is itself a hit, a scalar is a hit even with steps left. The JSON is parsed once;
    a null document has no hits.
    """
    work = df.withColumns({"_v": F.parse_json(col), "_done": F.lit(False)})
    for step in selector_steps(expr):
        work = _step(work, step)
    items = F.when(_kind(F.col("_v"), "ARRAY"), F.col("_v").cast("array<variant>")).otherwise(F.array("_v"))
    work = work.withColumn("_v", F.explode(F.when(F.col("_done"), F.array("_v")).otherwise(items)))
    return work.withColumn(out, F.col("_v")).drop("_done", "_v")


def json_select(df: DataFrame, col: str, expr: str, out: str) -> DataFrame:
    """Hits as text: scalars plain, objects as JSON."""
    return json_hits(df, col, expr, out).withColumn(out, F.col(out).cast("string"))


def json_bind(df: DataFrame, col: str, expr: str = "", names: Sequence[str] | None = None) -> DataFrame:
    """Every object that a selector chain hits binds all its keys: one row per object, one text column per key.

    A key that an object has replaces a column of the same name; one that it lacks leaves that column as it was, or null where there is none. Hits that
    are no objects bind nothing and give no row. Without ``names`` one pass over the hits finds the keys that occur; with them there is no
    such pass, and other keys are left out.
    """
    hits = json_hits(df, col, expr, "_hit").where(_kind(F.col("_hit"), "OBJECT"))
    hits = hits.withColumn("_keys", F.from_json(F.to_json("_hit"), "map<string,string>")).drop("_hit")
    if names is None:
        names = sorted(r.key for r in hits.select(F.explode(F.map_keys("_keys")).alias("key")).distinct().collect())
    held = F.col("_keys")
    bound = {n: F.when(F.map_contains_key(held, n), held[n]).otherwise(F.col(n).cast("string")) if n in df.columns else held[n] for n in names}
    return hits.withColumns(bound).drop("_keys")


def _kind(value: Column, name: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(name))


def _get(value: Column, key: str) -> Column:
    return F.variant_get(value, f"$['{key}']", "variant")


def _step(df: DataFrame, step: str) -> DataFrame:
    value, done = F.col("_v"), F.col("_done")
    is_list = _kind(value, "ARRAY")
    items = F.when(is_list, value.cast("array<variant>"))

    def hit(v: Column, finished: bool) -> Column:
        return F.struct(v.alias("v"), F.lit(finished).alias("d"))

    scalar = F.array(hit(value, True))
    if step in (":first", ":last"):
        picked = F.try_element_at(items, F.lit(1 if step == ":first" else -1))
        hits = F.when(done, scalar).when(is_list, F.when(picked.isNotNull(), F.array(hit(picked, False))))
        hits = hits.when(_kind(value, "OBJECT"), scalar).otherwise(scalar)
    else:
        key, _, wanted = step.partition("=")
        if wanted:
            chosen = F.filter(items, lambda v: F.variant_get(v, f"$['{key}']", "string").eqNullSafe(F.lit(wanted)))
            from_list, from_object = F.transform(chosen, lambda v: hit(v, False)), scalar
        else:
            chosen = F.filter(items, lambda v: _get(v, key).isNotNull())
            from_list = F.transform(chosen, lambda v: hit(_get(v, key), False))
            from_object = F.when(_get(value, key).isNotNull(), F.array(hit(_get(value, key), False))).otherwise(scalar)
        hits = F.when(done, scalar).when(is_list, from_list).when(_kind(value, "OBJECT"), from_object).otherwise(scalar)
    rows = df.withColumn("_hit", F.explode(hits))
    return rows.withColumns({"_v": F.col("_hit.v"), "_done": F.col("_hit.d")}).drop("_hit")


def map_recursive(fn: Callable[[Column], Column], value: Column, dtype: T.DataType) -> Column:
    """Apply ``fn`` to every leaf of a nested value, following its type."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: map_recursive(fn, x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: map_recursive(fn, x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.struct(*[map_recursive(fn, value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
    return fn(value)


def struct_roundtrip(text: Column, schema: str) -> Column:
    """JSON text to a struct with dotted access, and back to text."""
    return F.to_json(F.from_json(text, schema))
