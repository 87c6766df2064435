"""Column expressions.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
none is a Python UDF.  Null rules follow Spark 4 ANSI mode: bad input never
throws, it becomes null (``try_*`` functions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinel that the data set uses as a second null in attributes.
NONE_SENTINEL = "None"
# Pattern that strips a Python-repr wrapper such as u'free' -> free
# (a leading u' and every quote).
REPR_PATTERN = "^u'|'$|'"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_repr(col: str | Column) -> Column:
    """u'free' / 'free' -> free; u'None' -> None (then dropped by ``is_present``)."""
    return F.regexp_replace(_c(col), REPR_PATTERN, "")


def is_present(col: str | Column) -> Column:
    """Not null and not the literal string ``None``."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(NONE_SENTINEL))


def contains_flag(col: str | Column, needle: str, yes: str = "Yes", no: str = "No") -> Column:
    """Substring test on a dict-literal text, e.g. ``'lot': True`` -> Yes/No."""
    return F.when(_c(col).contains(needle), F.lit(yes)).otherwise(F.lit(no))


def literal_flag(col: str | Column, key: str) -> Column:
    """Boolean value of ``key`` inside a Python dict literal string.

    ``{'lot': True, 'valet': False}`` with key ``lot`` -> true; key absent -> false;
    null text -> null.
    """
    value = F.regexp_extract(_c(col), f"'{key}': (True|False)", 1)
    return F.when(_c(col).isNull(), F.lit(None).cast("boolean")).otherwise(value == F.lit("True"))


def literal_map(col: str | Column) -> Column:
    """Python dict literal text -> ``map<string,boolean>``, parsed once for all keys.

    A nested literal (as a dict, or as the text of one) adds its keys as
    ``outer.inner``.  True / False become booleans, any other value (None, a word, a
    number) a null; the last of a repeated key counts; text that is no literal, and
    null, is null; ``{}`` is an empty map.  Keys hold no quotes."""
    text = F.regexp_replace(_c(col), '"(\\{[^"]*\\})"', "$1")  # an inner literal kept as text
    text = F.regexp_replace(text, "(?<![A-Za-z0-9_])u?'([^']*)'", '"$1"')
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        text = F.regexp_replace(text, f"(:\\s*){word}(?=\\s*[,}}])", f"$1{json}")
    pairs = "map<string,string>"

    def entries(json: Column) -> Column:
        return F.map_entries(F.from_json(json, pairs))

    def flat(e: Column) -> Column:
        inner = F.transform(entries(e["value"]), lambda i: F.struct(
            F.concat(e["key"], F.lit("."), i["key"]).alias("key"), i["value"].alias("value")))
        return F.when(e["value"].startswith("{"), F.coalesce(inner, F.array().cast("array<struct<key:string,value:string>>"))) \
            .otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    every = F.flatten(F.transform(entries(text), flat))
    # the last of a repeated key
    last = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["key"] == e["key"]))
    value = F.transform(last, lambda e: F.struct(e["key"].alias("key"), F.when(e["value"] == "true", F.lit(True))
                                                 .when(e["value"] == "false", F.lit(False)).alias("value")))
    return F.when(F.trim(_c(col)).startswith("{"), F.map_from_entries(value))


def friend_count(col: str | Column, sep: str = ",", legacy: bool = False) -> Column:
    """Number of entries in a separator-joined friend list.

    Default: null, blank and ``None`` count 0.  ``legacy=True`` is the literal
    ``size(split(col, sep))`` formula (null on null under ANSI, 1 for ``None``).
    """
    c = _c(col)
    plain = F.size(F.split(c, sep))
    if legacy:
        return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(plain)
    t = F.trim(c)
    return (F.when(c.isNull() | (t == F.lit("")) | (t == F.lit(NONE_SENTINEL)), F.lit(0))
            .otherwise(plain))


def month_of(col: str | Column, fmt: str = "yyyy-MM", parse: bool = True) -> Column:
    """``yyyy-MM`` bucket of a date text (bad text -> null) or of a timestamp."""
    c = _c(col)
    ts = F.try_to_timestamp(c.cast("string")) if parse else c
    return F.date_format(ts, fmt)


def month_start(col: str | Column) -> Column:
    """``yyyy-MM`` text -> first day of the month as a date (for ordered series)."""
    return F.try_to_date(F.concat(_c(col), F.lit("-01")), "yyyy-MM-dd")


def preview_text(col: str | Column, n: int = 60, ellipsis: str = "...") -> Column:
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def binary_label(col: str | Column, threshold: float = 3) -> Column:
    """1 when the rating is above ``threshold`` else 0 (null stays null)."""
    return (_c(col) > F.lit(threshold)).cast("int")


def pct(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    """``round(num / den * 100, digits)``; a zero denominator gives null."""
    return F.round(F.try_divide(_c(num), _c(den)) * F.lit(100), digits)


def sentiment_name(col: str | Column) -> Column:
    return F.when(_c(col) == 1, F.lit("Positive")).otherwise(F.lit("Negative"))


def correct_mark(col: str | Column) -> Column:
    return F.when(_c(col), F.lit("✅")).otherwise(F.lit("❌"))


# Display names of the two semantic anomaly classes.
POS_STAR_NEG_TEXT = "positive stars, negative text"
NEG_STAR_POS_TEXT = "negative stars, positive text"


def anomaly_type(stars: str | Column, high: float = 5) -> Column:
    return F.when(_c(stars) == F.lit(high), F.lit(POS_STAR_NEG_TEXT)).otherwise(F.lit(NEG_STAR_POS_TEXT))
