"""Tag and comment queries. ``bin_tags`` has ``bin_id, tag, ts``; ``comments`` has ``bin_id, comment, ts``."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.functions.stems import stem
from brinelog.operators.feed import having_all_tags, page_query, skip_clause
from brinelog.operators.ordered import all_of, any_of

# English words a comment search ignores.
STOP_WORDS = set(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split())


def normalize_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), r"[^\w ]", "")


def parse_label_tags(text: Column) -> Column:
    """``label:tag1:tag2`` to (label, tags)."""
    parts = F.split(text, ":")
    return F.struct(parts[0].alias("label"), F.slice(parts, 2, F.size(parts)).alias("tags"))


def parse_tags(text: Column) -> Column:
    return F.transform(F.split(text, r"[,+]"), lambda x: normalize_tag(F.trim(x)))


def add_tag(bin_tags: DataFrame, new: DataFrame) -> DataFrame:
    """Existing tags plus the normalised new ones the bin does not have yet."""
    rows = new.withColumn("tag", normalize_tag(F.col("tag"))).dropDuplicates(["bin_id", "tag"])
    fresh = rows.join(bin_tags, ["bin_id", "tag"], "left_anti")
    return bin_tags.unionByName(fresh, allowMissingColumns=True)


def remove_tag(bin_tags: DataFrame, gone: DataFrame) -> DataFrame:
    return bin_tags.join(gone.select("bin_id", normalize_tag(F.col("tag")).alias("tag")), ["bin_id", "tag"], "left_anti")


def tag_cloud(bin_tags: DataFrame, bins: DataFrame, label: str = "%", limit: int = 20) -> DataFrame:
    """The most frequent tags of a series (``label`` is a LIKE pattern), listed by tag."""
    wanted = bins.where(F.col("ts_label").like(label)).select("id")
    counts = bin_tags.join(wanted, bin_tags.bin_id == wanted.id, "left_semi").groupBy("tag").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "tag").limit(limit).orderBy("tag")


def search_tags_all(bins: DataFrame, bin_tags: DataFrame, tags: Sequence[str], page: int = 1, page_size: int = 10,
                    label: str | None = None, include_skip: bool = False) -> DataFrame:
    rows = skip_clause(bins if label is None else bins.where(F.col("ts_label") == label), include_skip)
    hits = having_all_tags(bin_tags, list(dict.fromkeys(tags)))
    found = rows.join(hits, rows.id == hits.bin_id, "left_semi")
    return page_query(found, [F.desc("sample_time"), F.col("id")], page, page_size)


def tag_search_rows(page: DataFrame, bin_tags: DataFrame, comments: DataFrame) -> DataFrame:
    """Comment count and sorted tags of the bins of one page; the page bounds what is collected."""
    ids = page.select(F.col("id").alias("bin_id"))
    n = comments.join(ids, "bin_id", "left_semi").groupBy("bin_id").agg(F.count("*").alias("n_comments"))
    tags = bin_tags.join(ids, "bin_id", "left_semi").groupBy("bin_id", "tag").agg(F.lit(1))
    listed = tags.groupBy("bin_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    out = page.withColumnRenamed("id", "bin_id").join(n, "bin_id", "left").join(listed, "bin_id", "left")
    return out.withColumns({"n_comments": F.coalesce("n_comments", F.lit(0)),
                            "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def recent(rows: DataFrame, bins: DataFrame, label: str | None, page: int = 1, page_size: int = 10,
           ts: str = "ts", tie: str = "bin_id") -> DataFrame:
    """Newest tags or comments of a series, by page."""
    wanted = bins.select(F.col("id").alias("_id")) if label is None else bins.where(
        F.col("ts_label") == label).select(F.col("id").alias("_id"))
    found = rows.join(wanted, rows.bin_id == F.col("_id"), "left_semi")
    return page_query(found, [F.desc(ts), F.col(tie)], page, page_size)


def tag_autocomplete(bin_tags: DataFrame, stem: str) -> DataFrame:
    return bin_tags.where(F.col("tag").startswith(stem)).select("tag").distinct().orderBy("tag")


def search_terms(text: str) -> list[str]:
    """Different stems of the words of a query, without stop words."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({stem(w) for w in words if w not in STOP_WORDS})


def comment_words(comments: DataFrame, key: str = "id") -> DataFrame:
    """``key, word``: each word of a comment once, in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("comment"), F.lit("[a-z0-9]+"), 0))
    return comments.select(key, F.explode(words).alias("word"))


def inflections(words: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``word, term``: the different words among ``words`` whose stem is one of ``terms``.

    Only words that begin like a term are stemmed, each once: stemming never changes the first letter.
    """
    @F.pandas_udf("string")
    def stems(column: pd.Series) -> pd.Series:
        return column.map(stem)

    near = words.where(any_of([F.col("word").startswith(t[:1]) for t in terms])).select("word").distinct()
    return near.withColumn("term", stems("word")).where(F.col("term").isin(*terms))


def search_comments(comments: DataFrame, text: str, bins: DataFrame | None = None, label: str | None = None, key: str = "id") -> DataFrame:
    """Comments that hold every term of ``text``, in any inflection; stop words do not count. ``key`` names a comment."""
    terms = search_terms(text)
    if not terms:
        return comments.limit(0)
    if label is not None:
        wanted = bins.where(F.col("ts_label") == label).select(F.col("id").alias("bin_id"))
        comments = comments.join(wanted, "bin_id", "left_semi")
    words = comment_words(comments, key)
    held = words.join(inflections(words, terms), "word").groupBy(key).agg(*[F.bool_or(F.col("term") == t).alias(f"_t{i}") for i, t in enumerate(terms)])
    hits = held.where(all_of([F.col(f"_t{i}") for i in range(len(terms))]))
    return comments.join(hits.select(key), key, "left_semi")


def author_lookup(rows: DataFrame, users: DataFrame) -> DataFrame:
    """``author``: first and last name of the user, else the e-mail. ``users.email`` is unique."""
    names = users.select(F.col("email").alias("user_email"), F.concat_ws(" ", "first_name", "last_name").alias("_name"))
    joined = rows.join(names, "user_email", "left")
    return joined.withColumn("author", F.coalesce("_name", "user_email")).drop("_name")


def comment_rows(comments: DataFrame, bins: DataFrame, users: DataFrame, current: str, admin: bool = False) -> DataFrame:
    wanted = bins.select(F.col("id").alias("bin_id"), "lid", "ts_label")
    rows = author_lookup(comments.join(wanted, "bin_id"), users)
    return rows.withColumn("deletable", F.lit(admin) | (F.col("user_email") == current))


def delete_by_id(rows: DataFrame, key: int, column: str = "id") -> DataFrame:
    return rows.where(~F.col(column).eqNullSafe(F.lit(key)))
