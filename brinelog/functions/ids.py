"""Sample identifiers and names derived from them, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two identifier layouts and the columns of their target files.
PID_PATTERN_V1 = r"^(IFCB([0-9]+)_(([0-9]{4})_([0-3][0-9][0-9])_((?:[0-1][0-9]|2[0-3])[0-5][0-9][0-5][0-9])))(.*)"
PID_PATTERN_V2 = (r"^(D(([0-9]{4})(0[1-9]|1[0-2])(0[1-9]|[1-2][0-9]|3[0-1])T"
                  r"((?:[0-1][0-9]|2[0-3])[0-5][0-9][0-5][0-9]))_IFCB([0-9]+))(.*)")
TAIL_PATTERN = r"^(?:_([0-9]+))?(?:_([a-zA-Z][a-zA-Z0-9_]*))?(?:\.([a-zA-Z][a-zA-Z0-9]*))?"
LEGACY_V1 = (r"(.*?\b(\w+)?)/?(((IFCB\d+)_(((\d{4})_(\d{3}))_(\d{6})))(_(\d{5}))?)(_([a-zA-Z]\w+))?"
             r"(\.([a-z][a-z0-9]*))?")
LEGACY_V2 = r"(.*?\b(\w+)?)/?((D(((\d{4})(\d{4}))T(\d{6}))_(IFCB\d+))(_(\d{5}))?)(_(\w+))?(\.(\w+))?"
IMAGE_NAME = r"^([A-Z0-9]+\.(((\d{4})\d{2})\d{2})\.(((\d{2})\d)\d{6})\.\d+)(_(\w+))?\.([a-zA-Z0-9]+)"
IMAGE_BIN = r"^(([A-Z0-9]+\.\d{8}\.\d{3})\d).([a-zA-Z0-9]+)"


def group(text: Column, pattern: str, index: int) -> Column:
    """Regex group, null when the pattern or the group did not match."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


SEP = "\u0001"


def parse_pid(df: DataFrame, pid: str = "pid") -> DataFrame:
    """Fields of an identifier; rows that fit neither layout are dropped.

    One match decides on the row, one replacement writes all fields in a common order, one splits the tail; each later
    stage only picks array items.
    """
    text = F.col(pid)
    suffix = F.substring_index(text, "/", -1)
    old = F.startswith(F.col("_suffix"), F.lit("I"))
    # lid, timestamp, year, day of the year or date, instrument, tail
    one = F.regexp_replace("_suffix", PID_PATTERN_V1 + "$", SEP.join(["$1", "$3", "$4", "$4_$5", "$2", "$7"]))
    two = F.regexp_replace("_suffix", PID_PATTERN_V2 + "$", SEP.join(["$1", "$2", "$3", "$3$4$5", "$7", "$8"]))
    namespace = F.substr(text, F.lit(1), F.length(text) - F.length("_suffix"))
    rows = df.where(suffix.rlike(f"{PID_PATTERN_V1}|{PID_PATTERN_V2}")).withColumn("_suffix", suffix)
    rows = rows.withColumns({"_f": F.split(F.when(old, one).otherwise(two), SEP), "namespace": F.nullif(namespace, F.lit("")),
                             "schema_version": F.when(old, "v1").otherwise("v2")})
    names = ["bin_lid", "timestamp", "year", "yearday", "instrument", "_tail"]
    rows = rows.withColumns({n: F.get("_f", F.lit(i)) for i, n in enumerate(names)})
    parts = F.split(F.regexp_replace("_tail", f"{TAIL_PATTERN}.*$", SEP.join(["$1", "$2", "$3"])), SEP)
    rows = rows.withColumns({"_t": parts, "_n": F.split("namespace", "/")})
    target, product, extension = (F.nullif(F.get("_t", F.lit(i)), F.lit("")) for i in range(3))
    out = rows.withColumns({"ts_label": F.nullif(F.get("_n", F.size("_n") - 2), F.lit("")), "target": target,
                            "product": F.coalesce(product, F.lit("raw")), "extension": extension})
    return out.drop("_suffix", "_f", "_t", "_n", "_tail").withColumn("lid", F.concat_ws("_", "bin_lid", "target"))


def parse_pid_legacy(df: DataFrame, pid: str = "pid") -> DataFrame:
    """The older full-string form of the same parse."""
    text = F.col(pid)
    full1, full2 = f"^(?:{LEGACY_V1})$", f"^(?:{LEGACY_V2})$"
    one, two = text.rlike(full1), text.rlike(full2)
    names1 = dict(namespace=1, time_series=2, lid=3, bin_lid=4, instrument=5, date=6, yearday=7, year=8, day=9, time=10,
                  target=12, product=14, extension=16)
    names2 = dict(namespace=1, time_series=2, lid=3, bin_lid=4, date=5, yearday=6, year=7, day=8, time=9, instrument=10,
                  target=12, product=14, extension=16)
    cols = {n: F.when(one, group(text, full1, names1[n])).otherwise(group(text, full2, names2[n])) for n in names1}
    cols["schema_version"] = F.when(one, "v1").otherwise("v2")
    return df.where(one | two).withColumns(cols).withColumn("bin_pid", F.concat(
        F.coalesce("namespace", F.lit("")), "bin_lid"))


def parse_image_name(df: DataFrame, pid: str = "pid") -> DataFrame:
    text = F.col(pid)
    names = dict(imagename=1, ymd=2, ym=3, y=4, ts=5, tenmin=6, h=7, product=9, extension=10)
    out = df.where(text.rlike(IMAGE_NAME)).withColumns({n: group(text, IMAGE_NAME, i) for n, i in names.items()})
    return out.withColumn("img_dir", F.concat("ymd", F.lit("_"), "tenmin", F.lit("0")))


def parse_image_bin(df: DataFrame, pid: str = "pid") -> DataFrame:
    text = F.col(pid)
    names = dict(bin_lid=1, prefix=2, extension=3)
    return df.where(text.rlike(IMAGE_BIN)).withColumns({n: group(text, IMAGE_BIN, i) for n, i in names.items()})


def bin_of_image(name: Column) -> Column:
    """Ten-minute bin ``YYYYMMDD_HHM0`` of an image name."""
    day, ten = r"^[A-Z0-9]+\.(\d{8})\.", r"^[A-Z0-9]+\.\d{8}\.(\d{3})"
    return F.concat(group(name, day, 1), F.lit("_"), group(name, ten, 1), F.lit("0"))


def as_product(namespace: Column, lid: Column, product: Column) -> Column:
    return F.concat(F.coalesce(namespace, F.lit("")), lid, F.lit("_"), product)


def canonicalize(base_url: str, label: Column, lid: Column) -> Column:
    return F.concat(F.lit(base_url), label, F.lit("/"), lid)


def target_pid(bin_pid: Column, number: Column) -> Column:
    """Bin identifier and the number padded to five digits; a longer number is kept whole."""
    text = number.cast("string")
    return F.concat(bin_pid, F.lit("_"), F.lpad(text, F.greatest(F.length(text), F.lit(5)), F.lit("0")))


def add_pids(targets: DataFrame, bin_pid: Column, number: str = "targetNumber") -> DataFrame:
    return targets.withColumns({"binID": bin_pid, "pid": target_pid(bin_pid, F.col(number))})


def lid_of_url(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def fix_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?):/([^/])", "$1://$2")


def product_file_name(url: Column, ending: str = "_fea_v2.csv") -> Column:
    return F.concat(F.regexp_replace(lid_of_url(url), r"\.[a-zA-Z][a-zA-Z0-9]*$", ""), F.lit(ending))


def path_params(path: Column, defaults: Mapping[str, str] | None = None) -> Column:
    """``a/3/b/5`` to a map; given pairs win over defaults."""
    parts = F.split(F.regexp_replace(path, "^/|/$", ""), "/")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1),
                        lambda i: F.struct(parts[i * 2].alias("key"), parts[i * 2 + 1].alias("value")))
    given = F.when(F.size(parts) > 1, F.map_from_entries(pairs)).otherwise(F.map_from_arrays(F.array().cast(
        "array<string>"), F.array().cast("array<string>")))
    if not defaults:
        return given
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


# Time-like pattern words and the regular expressions they stand for.
TIME_WORDS = {
    "yyyy": "(?<yyyy>[0-9]{4})",
    "mm": "(?<mm>0[1-9]|1[0-2])",
    "dd": "(?<dd>0[1-9]|[1-2][0-9]|3[0-1])",
    "YYY": "(?<YYY>[0-3][0-9][0-9])",
    "HH": "(?<HH>[0-1][0-9]|2[0-3])",
    "MM": "(?<MM>[0-5][0-9])",
    "SS": "(?<SS>[0-5][0-9])",
    "#": "[0-9]+",
    "i": "[a-zA-Z][a-zA-Z0-9_]*",
    ".ext": "(?:\\.(?<ext>[a-zA-Z][a-zA-Z0-9_]*))",
    "any": ".*",
}


def time_pattern_regex(pattern: str) -> tuple[str, list[str]]:
    """Java regex and its named groups for a time-like pattern such as ``D(yyyymmdd)_1``."""
    words = "|".join(re.escape(w) for w in sorted(TIME_WORDS, key=len, reverse=True))
    names: list[str] = []

    def expand(m: re.Match) -> str:
        word = m.group(0)
        if word in TIME_WORDS:
            text = TIME_WORDS[word]
        elif word.isdigit():
            text = f"(?<n{word[0]}>[0-9]+)"
        elif set(word) == {"s"}:
            text = "(?<sss>[0-9]+)"
        else:
            return "\\."
        names.extend(re.findall(r"\?<(\w+)>", text))
        return text

    return re.sub(rf"{words}|([0-9])\1*|s+|\.", expand, pattern), names


def match_time_pattern(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Keep rows that start with the pattern and bind its named groups as columns."""
    regex, names = time_pattern_regex(pattern)
    opened = [m.group(1) for m in re.finditer(r"(?<!\\)\((?:\?<(\w+)>|(?!\?))", regex)]
    text = F.col(col)
    cols = {n: group(text, f"^{regex}", opened.index(n) + 1) for n in names}
    return df.where(text.rlike(f"^{regex}")).withColumns(cols)
