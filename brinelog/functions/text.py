"""Text, number and digest helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension form, numeric form of a CSV field, binary units.
EXTENSION = r"\.[a-zA-Z][a-zA-Z0-9]*$"
NUMERIC_FIELD = r"^-?[0-9]*(\.[0-9]+)?$"
UNITS = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi"]


def remove_extension(path: Column) -> Column:
    return F.regexp_replace(path, EXTENSION, "")


def change_extension(path: Column, extension: str) -> Column:
    return F.concat(remove_extension(path), F.lit(f".{extension}"))


def relocate(path: Column, folder: str, extension: str | None = None) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.concat(F.lit(folder.rstrip("/") + "/"), name if extension is None else change_extension(name, extension))


def decamel(text: Column) -> Column:
    return F.initcap(F.regexp_replace(text, r"([a-z])([A-Z]+)", "$1 $2"))


def rpad_text(text: Column, length: int, pad: str = " ") -> Column:
    """Pad on the right, never cut."""
    return F.when(F.length(text) < length, F.rpad(text, length, pad)).otherwise(text)


def sizeof_fmt(size: Column, suffix: str = "B") -> Column:
    value = size.cast("double")
    out = F.format_string(f"%.1fYi{suffix}", value / F.lit(1024.0**8))
    for i in reversed(range(len(UNITS))):
        scaled = value / F.lit(1024.0**i)
        out = F.when(F.abs(scaled) < 1024.0, F.format_string(f"%.1f{UNITS[i]}{suffix}", F.bround(scaled, 1))).otherwise(out)
    return out


def fixed_places(value: Column, places: int = 12) -> Column:
    """Fixed notation from the exact binary value: whole part and fraction are formatted apart, as their difference
    is exact, so that 56712.15 shows its binary tail as C formatting does."""
    v = value.cast("double")
    size = F.abs(v)
    whole = F.floor(size)
    part = F.format_string(f"%.{places}f", size - whole.cast("double"))
    carried = whole + F.substring(part, 1, 1).cast("bigint")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, carried.cast("string"), F.substr(part, F.lit(2)))
    return F.when(size < 2.0**53, exact).otherwise(F.format_string(f"%.{places}f", v))


def csv_number(value: Column, places: int = 12) -> Column:
    """Fixed notation without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(fixed_places(value, places), "0+$", ""), r"\.$", "")


def csv_quote(text: Column) -> Column:
    """Quote unless numeric; the empty text counts as numeric."""
    return F.when(text.rlike(NUMERIC_FIELD), text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def gen_id(namespace: str = "") -> Column:
    return F.concat(F.lit(namespace), F.sha1(F.uuid().cast("binary")))


def label_autocomplete(label: Column, stem: str) -> Column:
    """The stem starts a word, case ignored."""
    return label.rlike(rf"(?i)\b{stem}")


def search_ilike(columns: list[str], fragment: str) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(fragment.lower())), F.lit(False))
    return hit


def filename_shape(path: Column) -> Column:
    """Letter and digit runs of a file name collapsed to one sign each, extension kept."""
    name = F.substring_index(path, "/", -1)
    dotted = F.regexp_extract(name, r"\.[a-zA-Z][a-zA-Z0-9]*$", 0)
    stem = F.when(dotted != "", F.regexp_replace(name, r"\.[a-zA-Z][a-zA-Z0-9]*", "")).otherwise(name)
    for run, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[a-zA-Z]{2,}", "B"), ("[0-9]+", "9")):
        stem = F.regexp_replace(stem, run, sign)
    return F.concat(stem, dotted)
