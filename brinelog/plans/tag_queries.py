"""Registered tag and comment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinelog.operators import tags
from brinelog.plans.registry import query


@query("tag_cloud", """SELECT tag, n FROM (SELECT tag, count(*) AS n FROM bin_tags WHERE bin_id IN (SELECT id FROM obins
  WHERE ts_label LIKE 'F%') GROUP BY 1 ORDER BY n DESC, tag LIMIT 4)""")
def _(t):
    return tags.tag_cloud(t.bin_tags, t.obins, "F%", 4)


@query("search_tags_all", """SELECT id, lid, sample_time, true AS has_next FROM obins WHERE NOT skip
  AND id IN (SELECT bin_id FROM bin_tags WHERE tag = 'A') AND id IN (SELECT bin_id FROM bin_tags WHERE tag = 'R')
  ORDER BY sample_time DESC, id LIMIT 10 OFFSET 10""")
def _(t):
    return tags.search_tags_all(t.obins, t.bin_tags, ["A", "R"], page=2).select("id", "lid", "sample_time", "has_next")


@query("tag_search_rows", """, page AS (SELECT id, lid, sample_time FROM obins WHERE NOT skip
  AND id IN (SELECT bin_id FROM bin_tags WHERE tag = 'N') ORDER BY sample_time DESC, id LIMIT 10)
SELECT id AS bin_id, lid, (SELECT count(*) FROM bin_comments c WHERE c.bin_id = page.id) AS n_comments,
  (SELECT string_agg(tag, ',' ORDER BY tag) FROM (SELECT DISTINCT bin_id, tag FROM bin_tags) b WHERE b.bin_id = page.id)
  AS tags FROM page""")
def _(t):
    page = tags.search_tags_all(t.obins, t.bin_tags, ["N"])
    out = tags.tag_search_rows(page, t.bin_tags, t.bin_comments)
    return out.select("bin_id", "lid", "n_comments", F.array_join("tags", ",").alias("tags"))


@query("recent_tags", """SELECT bin_id, tag, ts, true AS has_next FROM bin_tags WHERE bin_id IN
  (SELECT id FROM obins WHERE ts_label = 'O') ORDER BY ts DESC, bin_id || '/' || tag LIMIT 10 OFFSET 20""")
def _(t):
    keyed = t.bin_tags.withColumn("tie", F.concat_ws("/", F.col("bin_id").cast("string"), "tag"))
    return tags.recent(keyed, t.obins, "O", page=3, tie="tie").drop("tie")


@query("recent_comments", """SELECT c.id, user_email, o_orderdate AS ts, true AS has_next FROM bin_comments c
  JOIN orders ON o_orderkey = c.bin_id WHERE o_orderstatus = 'F' ORDER BY ts DESC, c.id LIMIT 10""")
def _(t):
    dated = t.bin_comments.join(t.obins.select(F.col("id").alias("bin_id"), F.col("sample_time").alias("ts")), "bin_id")
    return tags.recent(dated, t.obins, "F", tie="id").select("id", "user_email", "ts", "has_next")


@query("search_comments", r"""SELECT id FROM bin_comments WHERE regexp_matches(lower(comment),
  '(^|[^a-z0-9])(tion|tions|tione|tiones|tioned|tionedly|tioning|tioningly|tionly|tionlyed|tionlying|tionlys|tionness)([^a-z0-9]|$)') OR
  regexp_matches(lower(comment), '(^|[^a-z0-9])(license|licenses|licensed|licensing|licens)([^a-z0-9]|$)')""")
def _(t):
    one = tags.search_comments(t.bin_comments, "the tion").select("id")
    two = tags.search_comments(t.bin_comments, "the licenses").select("id")
    return one.union(two).distinct()


@query("author_lookup", """SELECT c.id, coalesce(r_name || ' ' || r_regionkey, user_email) AS author FROM bin_comments c
  LEFT JOIN region ON user_email = 'src' || r_regionkey || '@example.org'""")
def _(t):
    return tags.author_lookup(t.bin_comments, _users(t)).select("id", "author")


def _users(t):
    key = F.col("r_regionkey").cast("string")
    return t.region.select(F.concat(F.lit("src"), key, F.lit("@example.org")).alias("email"),
                           F.col("r_name").alias("first_name"), key.alias("last_name"))


@query("comment_rows", """SELECT c.id, lid, coalesce(r_name || ' ' || r_regionkey, user_email) AS author,
  user_email = 'src3@example.org' AS deletable FROM bin_comments c JOIN obins b ON b.id = c.bin_id
  LEFT JOIN region ON user_email = 'src' || r_regionkey || '@example.org'""")
def _(t):
    rows = tags.comment_rows(t.bin_comments, t.obins, _users(t), "src3@example.org")
    return rows.select("id", "lid", "author", "deletable")


@query("tag_autocomplete", """SELECT DISTINCT p_name AS tag FROM part WHERE p_name LIKE 're%'""")
def _(t):
    return tags.tag_autocomplete(t.part.select(F.col("p_name").alias("tag")), "re")


@query("add_tag", """SELECT bin_id, tag FROM bin_tags UNION SELECT o_orderkey, lower(o_orderstatus) FROM orders""")
def _(t):
    new = t.orders.select(F.col("o_orderkey").alias("bin_id"), F.concat(F.col("o_orderstatus"), F.lit("!")).alias("tag"))
    return tags.add_tag(t.bin_tags.select("bin_id", "tag"), new)


@query("remove_tag", """SELECT bin_id, lower(tag) AS tag FROM bin_tags WHERE NOT (tag = 'F' AND bin_id IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))""")
def _(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("bin_id"), F.lit("#F").alias("tag"))
    return tags.remove_tag(t.bin_tags.select("bin_id", F.lower("tag").alias("tag")), gone)


@query("delete_comment", "SELECT id FROM bin_comments WHERE id <> 17")
def _(t):
    return tags.delete_by_id(t.bin_comments, 17).select("id")


@query("normalize_tag", r"SELECT id, regexp_replace(lower(comment), '[^\w ]', '', 'g') AS tag FROM bin_comments WHERE lang = 'en'")
def _(t):
    return t.bin_comments.where("lang = 'en'").select("id", tags.normalize_tag(F.col("comment")).alias("tag"))


@query("parse_label_tags", """SELECT p_partkey, p_type AS label, replace(p_name, ' ', '|') AS tags FROM part""")
def _(t):
    text = F.concat_ws(":", "p_type", F.regexp_replace("p_name", " ", ":"))
    got = tags.parse_label_tags(text)
    return t.part.select("p_partkey", got["label"].alias("label"), F.array_join(got["tags"], "|").alias("tags"))


@query("parse_tags", """SELECT p_partkey, lower(p_type) || '|' || replace(lower(p_brand), '#', '') || '|' || p_name AS tags
  FROM part""")
def _(t):
    text = F.concat(F.col("p_type"), F.lit(" , "), F.col("p_brand"), F.lit("+"), F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(tags.parse_tags(text), "|").alias("tags"))


@query("label_autocomplete", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)\bwi')")
def _(t):
    from brinelog.functions.text import label_autocomplete
    return t.part.where(label_autocomplete(F.col("p_name"), "wi")).select("p_partkey", "p_name")
