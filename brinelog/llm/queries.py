"""The operators over their whole tables, with production parameters, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelog.llm import (chat, decontamination, fingerprints, language, lexical_search, line_dedup, packing, pieces, secrets,
                          sharding, simhash_dedup, spelling, token_files)
from brinelog.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONTROL = "<|im_end|><|im_start|>assistant ok"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


@query("op1_chat_format", f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT
    AS formatted_chars
FROM said GROUP BY conv_id
""")
def op1(spark, sf_dir):
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digest(chat.render(chat.fold(chat.log_of(rows))))


@query("op2_simhash_dedup")
def op2(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


@query("op4_sharding")
def op4(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


@query("op5_fingerprints")
def op5(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6(spark, sf_dir):
    manifest = token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(manifest)


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query("op8_decontamination", r"""
WITH item AS (
  SELECT DISTINCT item_id::VARCHAR AS item, w FROM (SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
spot AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))),
hit AS (SELECT a.doc_id, a.n, a.i, win.item FROM spot a JOIN win USING (n, words)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark, sf_dir):
    return decontamination.report(decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True))


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    return pieces.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_line_dedup", r"""
WITH line AS (
  SELECT doc_id, i, trim(own[i], E' \t\n\r\x0b\x0c') AS line, own[i] AS raw,
    len(list_filter(regexp_split_to_array(own[i], '\s+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, own, unnest(range(1, len(own) + 1)) AS i FROM
    (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents))),
upto AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM line),
span AS (
  SELECT a.doc_id, a.i AS a, min(z.i) AS z FROM upto a JOIN upto z ON a.doc_id = z.doc_id AND z.i >= a.i AND z.s - a.s + a.n >= 50 GROUP BY ALL
  UNION
  SELECT z.doc_id, max(a.i), z.i FROM upto a JOIN upto z ON a.doc_id = z.doc_id AND z.i >= a.i AND z.s - a.s + a.n >= 50 GROUP BY ALL),
own AS (SELECT doc_id, list(line ORDER BY i) AS lines FROM line GROUP BY doc_id),
held AS (SELECT doc_id, a, z, array_to_string(lines[a:z], chr(10)) AS words FROM span JOIN own USING (doc_id)),
later AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, a) AS k FROM held) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later)
SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted,
  length(coalesce(string_agg(raw, chr(10) ORDER BY line.i) FILTER (gone.i IS NULL), '')) AS kept_chars,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
""")
def op10(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op11_lexical_search", r"""
WITH item AS (
  SELECT item_id, text AS own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
asked AS (SELECT item_id, own, term, count(*) AS k FROM (SELECT item_id, own, unnest(w) AS term FROM item) GROUP BY ALL),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, w, len(w)::BIGINT AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL)
  WHERE len(w) > 0),
facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM doc),
freq AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM freq GROUP BY term), facts),
part AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))) AS part
  FROM freq JOIN weight USING (term), facts),
total AS (SELECT item_id, own, r, doc_id, sum(k * part)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, own ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM total WHERE score > 0)
WHERE rank <= 20
""")
def op11(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op12_packing")
def op12(spark, sf_dir):
    return packing.report(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
