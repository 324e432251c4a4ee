"""Rule-style combinators: a rule is a function ``DataFrame -> DataFrame``; rows are variable bindings."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.operators import ordered

Rule = Callable[[DataFrame], DataFrame]

# Fixed value: the form of a variable reference in a template.
REFERENCE = re.compile(r"\$\{([a-zA-Z0-9_.]+)\}")


# -- projections ------------------------------------------------------------------------------------------------------

def project_include(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Keep, then drop; names that are not bound are ignored."""
    kept = df if include is None else df.select(*[c for c in include if c in df.columns])
    return kept.drop(*exclude)


def rename(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(aliases))


def rename_only(df: DataFrame, keymap: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in keymap.items() if a in df.columns])


def order_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, the others in alphabetical order."""
    return df.select(*[c for c in first if c in df.columns], *sorted(c for c in df.columns if c not in first))


def tail_columns(adc: Sequence[str], features: Sequence[str]) -> list[str]:
    """Plot columns: target columns without identifiers, features, with the texture families last."""
    # Hidden target columns and the prefixes that go last.
    hidden = {"binID", "pid", "trigger", "byteOffset"}
    last = ("Wedge", "Ring", "HOG")
    ordered_features = sorted(features, key=lambda c: (c.startswith(last), c))
    return [c for c in adc if c not in hidden] + ordered_features


def slice_default(df: DataFrame, schema: Sequence[str] | str | Mapping[str, Callable[[Column], Column] | None],
                  default: object = None, required: bool = False) -> DataFrame:
    """Select by list, by comma-separated text, or by name -> function; a missing name takes the default."""
    if isinstance(schema, str):
        schema = [s.strip() for s in schema.split(",")]
    functions = schema if isinstance(schema, Mapping) else {s: None for s in schema}
    cols = []
    for name, fn in functions.items():
        if name in df.columns:
            value = F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))
        elif default is None:
            if required:
                raise KeyError(name)
            continue
        else:
            value = F.lit(default)
        cols.append((fn(value) if fn else value).alias(name))
    return df.select(*cols)


def pre_block(df: DataFrame, include=None, exclude=(), aliases: Mapping[str, str] | None = None) -> DataFrame:
    return rename(project_include(df, include, exclude), aliases or {})


def post_block(df: DataFrame, distinct: Sequence[str] | None = None, order: Sequence[str] = (),
               slice_by: Column | None = None, count: str | None = None, nth: int | None = None) -> DataFrame:
    """Distinct, then number, then pick the n-th row; ``order`` gives the row order Spark does not keep."""
    rows = df if distinct is None else distinct_project(df, distinct)
    if count is None and nth is None:
        return rows
    if nth is not None:
        return rows.orderBy(*order).offset(nth - 1).limit(1).withColumn(count or "_n", F.lit(nth).cast("bigint")).drop(
            *([] if count else ["_n"]))
    return ordered.number_rows(rows, [], order, slice_by, count)


def retain(before: DataFrame, after: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Drop the names bound before this step unless they are kept."""
    return after.select(*[c for c in after.columns if c in keep or c not in before.columns])


def using_args(df: DataFrame, keys: Sequence[str], rule: Rule) -> DataFrame:
    """Run a rule on the distinct arguments only and join its results back."""
    return df.join(rule(df.select(*keys).distinct()), list(keys))


def uses_required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if any(n not in df.columns for n in names):
        return df.where(F.lit(False))
    return df.where(ordered.all_of([F.col(n).isNotNull() for n in names]))


def passthrough(df: DataFrame) -> DataFrame:
    return df


def miss(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


# -- templates --------------------------------------------------------------------------------------------------------

def _template(text: str, bound: Sequence[str], absent: Callable[[str], Column]) -> Column:
    parts, at = [], 0
    for m in REFERENCE.finditer(text):
        parts.append(F.lit(text[at:m.start()]))
        name = m.group(1)
        parts.append(F.coalesce(F.col(f"`{name}`").cast("string"), absent(name)) if name in bound else absent(name))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def interpolate(template: str, bound: Sequence[str], fail_fast: bool = True) -> Column:
    """Fill ``${name}``; an unbound name makes the result null, or blank without ``fail_fast``."""
    return _template(template, bound, lambda _: F.lit(None).cast("string") if fail_fast else F.lit(""))


def substitute_lenient(template: str, bound: Sequence[str]) -> Column:
    """An unbound reference stays as it is written."""
    return _template(template, bound, lambda name: F.lit("${" + name + "}"))


def assign(df: DataFrame, name: str, template: str) -> DataFrame:
    return df.withColumn(name, interpolate(template, df.columns)).where(F.col(name).isNotNull())


def assign_values(df: DataFrame, name: str, templates: Sequence[str]) -> DataFrame:
    """One row per value."""
    values = F.array(*[interpolate(t, df.columns) for t in templates])
    return df.withColumn(name, F.explode(values)).where(F.col(name).isNotNull())


def assign_multi(df: DataFrame, names: Sequence[str], rows: Sequence[str], delim: str = r"\s+") -> DataFrame:
    """Each template is split by a regex and zipped to the names; every template is a row."""
    exploded = df.withColumn("_t", F.explode(F.array(*[interpolate(t, df.columns) for t in rows])))
    parts = F.split("_t", delim)
    return exploded.where(F.col("_t").isNotNull()).withColumns(
        {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}).drop("_t")


# -- tests and matches ------------------------------------------------------------------------------------------------

OPERATORS = {"eq": Column.__eq__, "gt": Column.__gt__, "lt": Column.__lt__, "ge": Column.__ge__, "le": Column.__le__,
             "ne": Column.__ne__}


def compare_coerce(left: Column, op: str, right: Column) -> Column:
    """Numeric comparison when both sides read as numbers, else text comparison."""
    a, b = left.cast("string"), right.cast("string")
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), OPERATORS[op](x, y)).otherwise(OPERATORS[op](a, b))


def filter_test(df: DataFrame, left: Column, **tests: object) -> DataFrame:
    """The first operator given, in the order eq gt lt ge le ne, decides."""
    for op in OPERATORS:
        if op in tests:
            value = tests[op]
            return df.where(compare_coerce(left, op, value if isinstance(value, Column) else F.lit(str(value))))
    return df


def java_regex(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def _groups(pattern: str) -> tuple[list[int], dict[str, int]]:
    """Group numbers without a name, and those with one."""
    compiled = re.compile(pattern)
    named = dict(compiled.groupindex)
    return [i for i in range(1, compiled.groups + 1) if i not in named.values()], named


def filter_match(df: DataFrame, col: str, pattern: str, groups: Sequence[str] = (), optional: bool = False,
                 full: bool = False) -> DataFrame:
    """Regex match anchored at the start; unnamed groups bind by position, named ones by name, unmatched stay null."""
    unnamed, named = _groups(pattern)
    anchored = f"^(?:{java_regex(pattern)})" + ("$" if full else "")
    text = F.col(col).cast("string")
    binding = {n: i for n, i in zip(groups, unnamed) if n != "-"} | named
    values = {}
    for name, index in binding.items():
        got = F.nullif(F.regexp_extract(text, anchored, index), F.lit(""))
        values[name] = F.coalesce(got, F.col(name)) if name in df.columns else got
    rows = df if optional else df.where(text.rlike(anchored))
    return rows.withColumns(values) if values else rows


def split_rows(df: DataFrame, col: str, out: str, pattern: str = r"\s+") -> DataFrame:
    return df.withColumn(out, F.explode(F.split(F.col(col), pattern)))


def split_cols(df: DataFrame, col: str, names: Sequence[str], pattern: str = r"\s+") -> DataFrame:
    parts = F.split(F.col(col), pattern)
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def template_match(df: DataFrame, template: Mapping[str, object], known_only: bool = True) -> DataFrame:
    """Equality on the given columns; a row without the column value passes, an unknown key is ignored."""
    tests = []
    for name, value in template.items():
        if name in df.columns:
            tests.append(F.col(name).isNull() | (F.col(name) == F.lit(value)))
        elif not known_only:
            raise KeyError(name)
    return df.where(ordered.all_of(tests)) if tests else df


def template_match_regex(df: DataFrame, template: Mapping[str, str]) -> DataFrame:
    return df.where(ordered.all_of([F.col(n).cast("string").rlike(f"(?i){p}") for n, p in template.items()]))


# -- control ----------------------------------------------------------------------------------------------------------

def conjunction_all(df: DataFrame, *rules: Rule) -> DataFrame:
    """Rows of each rule under the bindings of the rules before it."""
    return reduce(lambda rows, rule: rule(rows), rules, df)


def invoke_rule(df: DataFrame, rule: Rule, using: Sequence[str] | None = None) -> DataFrame:
    """Merge the results of a rule into the row; on a clash the result wins."""
    if using is None:
        return rule(df)
    found = rule(df.select(*using).distinct())
    clash = [c for c in found.columns if c in df.columns and c not in using]
    return df.drop(*clash).join(found, list(using))


def import_rule(df: DataFrame, rule: Rule, keys: Sequence[str], also_hits: bool = False) -> DataFrame:
    """Join the imported rule; ``also_hits`` adds the imported rows themselves."""
    imported = rule(df.select(*keys).distinct())
    joined = invoke_rule(df, rule, keys)
    return joined.unionByName(imported, allowMissingColumns=True) if also_hits else joined


def negation_none(df: DataFrame, block: Rule, keys: Sequence[str]) -> DataFrame:
    """Keep the rows for which the block has no solution (the block is judged on its own)."""
    return df.join(block(df).select(*keys), list(keys), "left_anti")


def union_any(df: DataFrame, *branches: Rule) -> DataFrame:
    """All rows of every branch; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b(df) for b in branches])


def hit(df: DataFrame, rest: Rule) -> DataFrame:
    return df.unionByName(rest(df), allowMissingColumns=True)


def first_branch(df: DataFrame, branches: Sequence[Rule], key: Sequence[str], commit: Rule | None = None) -> DataFrame:
    """Per input row (named by ``key``) the rows of the first branch that yields something.

    With ``commit`` the choice also asks that the rest of the rule yields something; its rows are returned.
    """
    tagged = [(commit(b(df)) if commit else b(df)).withColumn("_branch", F.lit(i)) for i, b in enumerate(branches)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return ordered.with_group_stats(rows, key, _first=F.min("_branch")).where("_branch = _first").drop(
        "_branch", "_first")


def first_row(df: DataFrame, branches: Sequence[Rule], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Older meaning of first: only the first row of the branches, per input row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [b(df).withColumn("_branch", F.lit(i)) for i, b in enumerate(branches)])
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_branch", *order)).alias("_r"))
    return best.select(*key, "_r.*").drop("_branch")


def first_solution(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def distinct_project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns]).distinct()


def merge_store(mine: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert: rows of ``other`` replace rows with the same key."""
    return mine.join(other, list(key), "left_anti").unionByName(other)


def scope_flatten(inner: Sequence[str], outer: Mapping[str, Column]) -> dict[str, Column]:
    """Visible bindings: a column of the row wins over the surrounding scope."""
    return {n: F.coalesce(F.col(n), v) if n in inner else v for n, v in outer.items()}


# -- rules as functions -----------------------------------------------------------------------------------------------

def rule_function(rule: Rule, uses: Sequence[str]) -> Callable[..., DataFrame]:
    """A rule as a function of a DataFrame and column keywords."""

    def call(df: DataFrame, **columns: Column | str) -> DataFrame:
        given = {n: c if isinstance(c, Column) else F.lit(c) for n, c in columns.items()}
        missing = [n for n in uses if n not in given and n not in df.columns]
        return miss(df) if missing else rule(df.withColumns(given))

    call.__signature__ = inspect.Signature([inspect.Parameter("df", inspect.Parameter.POSITIONAL_OR_KEYWORD)] + [
        inspect.Parameter(u, inspect.Parameter.KEYWORD_ONLY) for u in uses])
    return call


def rule_function_positional(rule: Rule, uses: Sequence[str]) -> Callable[..., DataFrame]:
    call = rule_function(rule, uses)
    return lambda df, *args: call(df, **dict(zip(uses, args)))
