"""Text, document and table sinks.

Documents (XML, RDF, JSON, KML) are made as ordered lines ``doc, section, n, text``: one row per target or point, so that
a document with very many parts is never gathered in one cell. ``write_document`` keeps the order over part files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.functions.ids import target_pid
from brinelog.functions.text import csv_number, csv_quote
from brinelog.operators import ordered

# Name spaces and frame lines of the document formats. The vocabulary of the elements is a parameter.
DEFAULT_TERMS = "urn:sample-bins:terms#"
DC_TERMS = 'xmlns:dcterms="http://purl.org/dc/terms/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
RDF_TERMS = ('xmlns:dcterms="http://purl.org/dc/terms/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
             'xmlns:dc="http://purl.org/dc/elements/1.1/"')
KML_ICON = "http://www.gstatic.com/mapspro/images/stock/962-wht-diamond-blank.png"
KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def _lines(df: DataFrame, doc: str, section: int, n: Column | int, text: Column) -> DataFrame:
    place = n if isinstance(n, Column) else F.lit(n)
    return df.select(F.col(doc).alias("doc"), F.lit(section).alias("section"), place.cast("bigint").alias("n"),
                     text.alias("text"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_document(lines: DataFrame, path: str, key: Sequence[str] = ("doc", "section", "n")) -> None:
    """Text files whose concatenation in name order is the documents in key order."""
    lines.repartitionByRange(*key).sortWithinPartitions(*key).select("text").write.mode("overwrite").text(path)


def write_text_files(rows: DataFrame, key: str, value: str, folder: str) -> int:
    """One text file per ``key``, all in ``folder``, with its values as lines; returns the number of files.

    Tasks write the files themselves: a folder per key, as a partitioned write makes it, is moved and listed by the driver one by one. A
    task that runs again writes the same files with the same content.
    """
    from pyarrow import fs

    def target() -> tuple[fs.FileSystem, str]:
        plain = folder.replace("file:/", "/", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        return fs.FileSystem.from_uri(plain)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, where = target()
        name, handle, files = None, None, 0
        for pdf in batches:
            for own, line in zip(pdf["name"].tolist(), pdf["line"].tolist()):
                if own != name:
                    if handle is not None:
                        handle.close()
                    name, handle, files = own, system.open_output_stream(f"{where}/{quote(own, safe='')}"), files + 1
                handle.write((("" if line is None else line) + "\n").encode())
        if handle is not None:
            handle.close()
        yield pd.DataFrame({"files": [files]})

    system, where = target()
    system.create_dir(where, recursive=True)
    named = rows.select(F.coalesce(F.concat(F.lit("key-"), F.col(key).cast("string")), F.lit("none")).alias("name"), F.col(value).alias("line"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(parts, "name").sortWithinPartitions("name", "line").mapInPandas(put, "files long").agg(F.sum("files")).first()[0] or 0


# -- CSV --------------------------------------------------------------------------------------------------------------

def csv_field(col: str, dtype: str) -> Column:
    """Numbers in fixed notation, text quoted unless it reads as a number."""
    numeric = dtype in ("int", "bigint", "double", "float", "smallint", "tinyint") or dtype.startswith("decimal")
    return csv_number(F.col(col)) if numeric else csv_quote(F.col(col).cast("string"))


def csv_rows(targets: DataFrame, columns: Sequence[str], header: bool = True, doc: str = "bin") -> DataFrame:
    """``doc, section, n, text``: a header line per bin and one line per target."""
    names = [*columns, "binID", "pid", "stitched", "targetNumber"]
    types = dict(targets.dtypes)
    body = _lines(targets, doc, 1, F.col("targetNumber"), F.concat_ws(",", *[csv_field(c, types[c]) for c in names]))
    if not header:
        return body
    return _union(_lines(targets.select(doc).distinct(), doc, 0, 0, F.lit(",".join(names))), body)


def _with_header(lines: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The header line ``pid,label,...`` before the lines: its ``roi`` is null, so it sorts first."""
    head = lines.sparkSession.range(1).select(F.lit(None).cast(lines.schema["roi"].dataType).alias("roi"),
                                              F.lit(",".join(["pid", *labels])).alias("text"))
    return head.unionByName(lines)


def scores_csv_rows(scores: DataFrame, bin_lid: Column, labels: Sequence[str]) -> DataFrame:
    """Header and wide score lines without the last label (unclassified), six places, a zero as ``0.0``."""
    cells = F.transform(F.slice("scores", 1, len(labels) - 1), lambda s: F.format_string("%f", s))
    line = F.replace(F.array_join(cells, ","), F.lit("0.000000"), F.lit("0.0"))
    lines = scores.select("roi", F.concat_ws(",", target_pid(bin_lid, F.col("roi")), line).alias("text"))
    return _with_header(lines, labels[:-1])


def scores_csv_rows_short(scores: DataFrame, bin_lid: Column, labels: Sequence[str]) -> DataFrame:
    """Header and wide score lines of all classes, four places, a trailing ``000`` removed, quoted pid."""
    cells = F.transform("scores", lambda s: F.regexp_replace(F.format_string("%.4f", s), "000$", ""))
    pid = F.concat(F.lit('"'), target_pid(bin_lid, F.col("roi")), F.lit('"'))
    return _with_header(scores.select("roi", F.concat_ws(",", pid, F.array_join(cells, ",")).alias("text")), labels)


def score_export_lines(scores: DataFrame, bin_lid: Column, labels: Sequence[str]) -> DataFrame:
    """``bin,label,roi,score`` of the best class of each target."""
    best = F.array_max("scores")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position("scores", best).cast("int"))
    return scores.select(F.concat_ws(",", bin_lid, label, F.col("roi").cast("string"), F.format_string("%.2f", best))
                         .alias("text"))


def write_shards(lines: DataFrame, path: str, shards: int = 8) -> None:
    lines.repartition(shards).write.mode("overwrite").text(path)


def eic_lines(meta: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Space-separated ``image altitude pitch roll`` without the images of the skip list."""
    from brinelog.functions.text import remove_extension
    rows = meta.withColumn("imagename", remove_extension(F.col("imagename")))
    if skip is not None:
        rows = rows.join(skip.select("imagename"), "imagename", "left_anti")
    return rows.select("imagename", F.concat_ws(" ", "imagename", *[F.col(c).cast("string") for c in ("alt", "pitch", "roll")])
                       .alias("text"))


# -- bin documents ----------------------------------------------------------------------------------------------------

def _xml_name(key: Column) -> Column:
    return F.regexp_replace(key, "[^a-zA-Z0-9_]", "_")


def xml_bin_lines(bins: DataFrame, context: DataFrame, props: DataFrame, targets: DataFrame,
                  terms: str = DEFAULT_TERMS) -> DataFrame:
    """``terms`` is the address of the vocabulary. ``bins``: pid, date; ``context``: pid, n, text; ``props``: pid, n, key, value; ``targets``: bin_pid, n, pid."""
    head = F.concat(F.lit(f'<Bin {DC_TERMS} xmlns="{terms}">\n  <dc:identifier>'), F.col("pid"), F.lit("</dc:identifier>\n  <dc:date>"),
                    F.col("date"), F.lit("</dc:date>"))
    name = _xml_name(F.col("key"))
    return _union(
        _lines(bins, "pid", 0, 0, head),
        _lines(context, "pid", 1, F.col("n"), F.concat(F.lit("  <context>"), F.col("text"), F.lit("</context>"))),
        _lines(props, "pid", 2, F.col("n"), F.concat(F.lit("  <"), name, F.lit(">"), F.col("value"), F.lit("</"), name, F.lit(">"))),
        _lines(targets, "bin_pid", 3, F.col("n"), F.concat(F.lit('  <Target dc:identifier="'), F.col("pid"), F.lit('"/>'))),
        _lines(bins, "pid", 4, 0, F.lit("</Bin>")))


def rdf_bin_lines(bins: DataFrame, context: DataFrame, props: DataFrame, targets: DataFrame,
                  terms: str = DEFAULT_TERMS) -> DataFrame:
    """As ``xml_bin_lines`` for RDF/XML with an ordered sequence of targets."""
    about = F.concat(F.lit('  <Bin rdf:about="'), F.col("pid"), F.lit('">\n    <dc:date>'), F.col("date"), F.lit("</dc:date>"))
    name = _xml_name(F.col("key"))
    opened = F.concat(F.lit('    <dcterms:hasPart>\n      <rdf:Seq rdf:about="'), F.col("pid"), F.lit('/targets">'))
    item = F.concat(F.lit('        <rdf:li>\n          <Target rdf:about="'), F.col("pid"), F.lit('"/>\n        </rdf:li>'))
    return _union(
        _lines(bins, "pid", 0, 0, F.concat(F.lit(f'<rdf:RDF {RDF_TERMS} xmlns="{terms}">\n'), about)),
        _lines(context, "pid", 1, F.col("n"), F.concat(F.lit("    <context>"), F.col("text"), F.lit("</context>"))),
        _lines(props, "pid", 2, F.col("n"), F.concat(F.lit("    <"), name, F.lit(">"), F.col("value"), F.lit("</"), name, F.lit(">"))),
        _lines(bins, "pid", 3, 0, opened),
        _lines(targets, "bin_pid", 4, F.col("n"), item),
        _lines(bins, "pid", 5, 0, F.lit("      </rdf:Seq>\n    </dcterms:hasPart>\n  </Bin>\n</rdf:RDF>")))


def json_string(value: Column) -> Column:
    """A text as a JSON string, quotes and escapes included."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _comma(df: DataFrame, doc: str, text: Column) -> tuple[DataFrame, Column]:
    """A comma before every part but the first of its document."""
    rows = ordered.with_group_stats(df, [doc], ordered.key_sizes(df, [doc]), _first=F.min("n"))
    return rows, F.concat(F.when(F.col("n") > F.col("_first"), F.lit(",")).otherwise(F.lit("")), text)


def json_bin_lines(bins: DataFrame, context: DataFrame, props: DataFrame, targets: DataFrame | None = None,
                   full: bool = False) -> DataFrame:
    """Short (no targets), medium (target pids) and full (target records) JSON of bins."""
    head = F.concat(F.lit('{"pid":'), json_string(F.col("pid")), F.lit(',"date":'), json_string(F.col("date")))
    prop = F.concat(F.lit(","), json_string(F.col("key")), F.lit(":"), json_string(F.col("value")))
    ctx, ctx_text = _comma(context, "pid", json_string(F.col("text")))
    parts = [_lines(bins, "pid", 0, 0, head), _lines(props, "pid", 1, F.col("n"), prop),
             _lines(bins, "pid", 2, 0, F.lit(',"context":[')), _lines(ctx, "pid", 3, F.col("n"), ctx_text)]
    if targets is None:
        return _union(*parts, _lines(bins, "pid", 4, 0, F.lit("]}")))
    fields = [c for c in targets.columns if c not in ("bin_pid", "n")]
    record = F.to_json(F.struct(*fields)) if full else json_string(F.col("pid"))
    rows, text = _comma(targets, "bin_pid", record)
    return _union(*parts, _lines(bins, "pid", 4, 0, F.lit('],"targets":[')), _lines(rows, "bin_pid", 5, F.col("n"), text),
                  _lines(bins, "pid", 6, 0, F.lit("]}")))


def xml_target(targets: DataFrame, columns: Sequence[str], date: Column, bin_pid: Column,
               terms: str = DEFAULT_TERMS) -> DataFrame:
    """One target as XML per row."""
    fields = [F.concat(F.lit(f"  <{c}>"), F.col(c).cast("string"), F.lit(f"</{c}>")) for c in columns]
    text = F.concat_ws(
        "\n", F.concat(F.lit(f'<Target {DC_TERMS} xmlns="{terms}" number="'), F.col("targetNumber").cast("string"), F.lit('">')),
        F.concat(F.lit("  <dc:identifier>"), F.col("pid"), F.lit("</dc:identifier>")),
        F.concat(F.lit("  <dc:date>"), date, F.lit("</dc:date>")), *fields,
        F.concat(F.lit("  <dcterms:hasFormat>"), F.col("pid"), F.lit(".png</dcterms:hasFormat>")),
        F.concat(F.lit("  <dcterms:isPartOf>"), bin_pid, F.lit("</dcterms:isPartOf>")), F.lit("</Target>"))
    return targets.select("pid", text.alias("text"))


def rdf_target(targets: DataFrame, columns: Sequence[str], bin_pid: Column, terms: str = DEFAULT_TERMS) -> DataFrame:
    fields = [F.concat(F.lit(f"  <{c}>"), F.col(c).cast("string"), F.lit(f"</{c}>")) for c in columns]
    text = F.concat_ws(
        "\n", F.lit(f'<rdf:RDF {RDF_TERMS} xmlns="{terms}">'), F.concat(F.lit('<Target rdf:about="'), F.col("pid"), F.lit('">')), *fields,
        F.concat(F.lit("  <binID>"), bin_pid, F.lit("</binID>")),
        F.concat(F.lit("  <dcterms:hasFormat>"), F.col("pid"), F.lit(".png</dcterms:hasFormat>")),
        F.lit("</Target>\n</rdf:RDF>"))
    return targets.select("pid", text.alias("text"))


# -- KML --------------------------------------------------------------------------------------------------------------

def kml_track_lines(track: DataFrame, doc: str, title: str = "Vehicle track") -> DataFrame:
    """``track``: doc, ts, latitude, longitude; times first, then places, both in time order."""
    from brinelog.functions.times import iso8601, micros
    docs, at = track.select(doc).distinct(), micros("ts")
    head = (f'{KML_HEAD}\n<kml xmlns="http://www.opengis.net/kml/2.2"\n xmlns:gx="http://www.google.com/kml/ext/2.2">\n'
            f"<Document>\n  <name>{title}</name>\n  <Placemark>\n    <gx:Track>")
    place = F.concat_ws(" ", F.col("longitude").cast("string"), F.col("latitude").cast("string"), F.lit("0"))
    return _union(
        _lines(docs, doc, 0, 0, F.lit(head)),
        _lines(track, doc, 1, at, F.concat(F.lit("      <when>"), iso8601(F.col("ts")), F.lit("</when>"))),
        _lines(track, doc, 2, at, F.concat(F.lit("      <gx:coord>"), place, F.lit("</gx:coord>"))),
        _lines(docs, doc, 3, 0, F.lit("    </gx:Track>\n  </Placemark>\n</Document>\n</kml>")))


def kml_bin_lines(bins: DataFrame, doc: str, title: str = "Sample runs", color: str | None = None) -> DataFrame:
    """One placemark per bin (``pid, ts, latitude, longitude``); its name is the pid after the last slash."""
    from brinelog.functions.times import iso8601, micros
    docs = bins.select(doc).distinct()
    icon = f"<scale>0.5</scale>\n      <Icon><href>{KML_ICON}</href></Icon>"
    style = "" if color else f'\n  <Style id="redstyle">\n    <IconStyle>\n      <color>ff0000ff</color>\n      {icon}\n    </IconStyle>\n  </Style>'
    lid = F.substring_index("pid", "/", -1)
    own = F.lit("    <styleUrl>#redstyle</styleUrl>") if color is None else F.concat(
        F.lit("    <Style><IconStyle><color>"), F.col(color), F.lit(f"</color>\n      {icon}\n    </IconStyle></Style>"))
    mark = F.concat_ws(
        "\n", F.lit("  <Placemark>"), F.concat(F.lit("    <name>"), lid, F.lit("</name>")), own,
        F.concat(F.lit("    <TimeStamp><when>"), iso8601(F.col("ts")), F.lit("</when></TimeStamp>")),
        F.concat(F.lit("    <Point><coordinates>"), F.col("longitude").cast("string"), F.lit(","),
                 F.col("latitude").cast("string"), F.lit(",0</coordinates></Point>")),
        F.concat(F.lit('    <description><![CDATA[<a href="'), F.col("pid"), F.lit('.html">'), lid,
                 F.lit("</a>]]></description>")), F.lit("  </Placemark>"))
    return _union(
        _lines(docs, doc, 0, 0, F.lit(f'{KML_HEAD}\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n  <name>{title}</name>{style}')),
        _lines(bins, doc, 1, micros("ts"), mark),
        _lines(docs, doc, 2, 0, F.lit("</Document>\n</kml>")))


# -- feed and tables --------------------------------------------------------------------------------------------------

def feed_rows(rows: DataFrame) -> DataFrame:
    """Feed entries (``pid, date`` as text) with the largest date."""
    newest = rows.agg(F.max("date").alias("d")).select("d").scalar()
    return rows.withColumn("max_date", newest)


def table_create(df: DataFrame, path: str, **options: str) -> None:
    """Drop and write anew: one committed job, so a reader never sees half of it."""
    df.write.mode("overwrite").options(**options).parquet(path)


def table_insert(df: DataFrame, path: str, columns: Sequence[str], types: dict[str, str]) -> None:
    """Append rows; missing columns become null."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns]
    df.select(*cols).write.mode("append").parquet(path)


def deposit_product(df: DataFrame, path: str) -> None:
    """Files appear only when the job commits."""
    df.write.mode("overwrite").parquet(path)
