"""Canonical text of values, so that two systems' renderings of one value compare equal.

Everything is a native column expression but nested array literals, whose recursion needs a pandas UDF.
Java's ``$`` also matches before a final line feed and its ``.`` stops at several line ends, so patterns
end in ``\\z`` and turn on ``(?d)`` where the dot matters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How NULL is written.
NULL_TEXT = "\\N"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
STAMP = "\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_newlines(c: Column | str) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def norm_decimal(c: Column | str) -> Column:
    """Trailing zeros of a plain decimal go, and then a trailing point; other texts stay."""
    c = _col(c)
    return F.when(c.rlike("\\A-?[0-9]+[.][0-9]+\\z"), F.regexp_replace(F.regexp_replace(c, "0+\\z", ""), "[.]\\z", "")).otherwise(c)


def norm_timestamp(c: Column | str, compat: bool = True) -> Column:
    """Timestamp-looking texts become ``yyyy-MM-dd HH:mm:ss``.

    compat: fraction and zone are cut off. Otherwise a zone that is given is applied, so that the result
    is the same instant in UTC; texts that only look like timestamps stay as they are.
    """
    c = _col(c)
    plain = F.substring(c, 1, 19)
    if compat:
        return F.when(c.rlike(f"(?d)\\A{STAMP}(\\.\\d+)?.*\\z"), plain).otherwise(c)
    at = F.try_to_timestamp(F.regexp_replace(c, "([+-]\\d{2})\\z", "$1:00"))
    zoned = c.rlike(f"\\A{STAMP}(\\.\\d+)?(Z|[+-]\\d{{2}}(:\\d{{2}})?)\\z")
    return F.when(zoned & at.isNotNull(), F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(c.rlike(f"\\A{STAMP}(\\.\\d+)?\\z"), plain).otherwise(c)


def norm_uuid(c: Column | str) -> Column:
    """Every UUID inside the text in lower case."""
    c = _col(c)
    found = F.regexp_extract_all(c, F.lit(UUID), F.lit(0))
    return F.when(c.rlike(UUID), F.aggregate(found, c, lambda text, u: F.replace(text, u, F.lower(u)))).otherwise(c)


def norm_json_ws(c: Column | str) -> Column:
    """White space outside of JSON strings goes."""
    return F.regexp_replace(_col(c), '("(?:[^"\\\\]|\\\\.)*+")|[ \t\n\r]+', "$1")


def rtrim_text(c: Column | str) -> Column:
    """Trailing spaces, tabs and line ends go."""
    return F.rtrim(_col(c), F.lit(" \t\n\r"))


def _array_items(inner: str) -> list[str]:
    """Top-level items of an array literal without its braces."""
    items, item, quoted, escaped, depth = [], "", False, False, 0
    for ch in inner:
        if not escaped and ch == "," and not quoted and not depth:
            items.append(item)
            item = ""
            continue
        item += ch
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted:
            depth += (ch == "{") - (ch == "}")
    return [*items, item] if item or items else []


def _array_json(literal: str) -> str:
    out = []
    for item in map(str.strip, _array_items(literal[1:-1])):
        if item in ("", "NULL", "null"):
            out.append("null")
        elif item in ("t", "f"):
            out.append("true" if item == "t" else "false")
        elif len(item) > 1 and item[0] == item[-1] == '"':
            text, at, plain = item[1:-1], 0, ""
            while at < len(text):
                at += text[at] == "\\" and at + 1 < len(text) or text[at : at + 2] == '""'
                plain += text[at]
                at += 1
            out.append(json.dumps(plain, ensure_ascii=False))
        elif len(item) > 1 and item[0] == "{" and item[-1] == "}":
            out.append(_array_json(item))
        else:
            try:
                float(item)
                out.append(item if item.lower().lstrip("+-") not in ("nan", "inf", "infinity") else json.dumps(item))
            except ValueError:
                out.append(json.dumps(item, ensure_ascii=False))
    return "[" + ",".join(out) + "]"


@F.pandas_udf(T.StringType())
def _nested_array_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda v: _array_json(v) if isinstance(v, str) and v[:1] == "{" and v[-1:] == "}" else v)


def pg_array_to_json(c: Column | str) -> Column:
    """An array literal (``{a,NULL,t,"x",{1,2}}``) as JSON; other texts stay.

    Flat literals of bare numbers, words, t, f and NULL stay native; quotes and nesting go to the UDF.
    """
    c = _col(c)
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    item = F.split(inner, ",", -1)

    def one(x: Column) -> Column:
        x = F.trim(x)
        return (
            F.when(x.isin("", "NULL", "null"), F.lit("null"))
            .when(x == "t", F.lit("true"))
            .when(x == "f", F.lit("false"))
            .when(x.rlike("\\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\z"), x)
            .otherwise(F.concat(F.lit('"'), x, F.lit('"')))
        )

    flat = F.when(inner == "", F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(item, one), ","), F.lit("]")))
    simple = c.rlike('(?s)\\A\\{[^{}"\\\\\\x00-\\x1f]*\\}\\z')
    return F.when(simple, flat).when(c.rlike("(?s)\\A\\{.*\\}\\z"), _nested_array_json(F.when(~simple, c))).otherwise(c)


def _shortest(c: Column) -> Column:
    """A floating-point value in its shortest decimal form, without an exponent where 38 digits allow it."""
    as_text = c.cast("string")
    return F.coalesce(norm_decimal(as_text.try_cast("decimal(38,15)").cast("string")), as_text)


def _canonical_text(c: Column, compat: bool) -> Column:
    """``norm_uuid(norm_timestamp(norm_decimal(norm_newlines(c))))``, of which a text takes the steps that it is long enough for: a timestamp has 19 characters, a UUID 36.

    Most texts of tables are short, and each regular expression costs more than their hash.
    """
    lines = F.when(F.contains(c, F.lit("\r")), norm_newlines(c)).otherwise(c)
    number = F.when(F.contains(c, F.lit(".")), norm_decimal(lines)).otherwise(lines)
    n = F.length(c)
    return F.when(n < 19, number).when(n < 36, norm_timestamp(number, compat)).otherwise(norm_uuid(norm_timestamp(norm_decimal(norm_newlines(c)), compat)))


def canonical(c: Column | str, dtype: T.DataType, json_text: bool = False, compat: bool = True, float_digits: int | None = None) -> Column:
    """Canonical text of a column of type ``dtype``; NULL becomes ``\\N``.

    json_text: the column holds JSON as text. compat: see ``norm_timestamp``. float_digits: round
    floating-point values to so many decimals first.
    """
    c = _col(c)
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "1").when(~c, "0")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = _shortest(c) if float_digits is None else F.coalesce(norm_decimal(F.round(c.try_cast("decimal(38,15)"), float_digits).cast("string")), c.cast("string"))
    elif isinstance(dtype, T.DecimalType):
        text = norm_decimal(c.cast("string"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        text = _canonical_text(c.cast("string"), compat)
        text = norm_json_ws(text) if json_text else text
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))


def canonical_light(c: Column | str) -> Column:
    """Right-trimmed text; of any text with a point, trailing zeros and then the point go. NULL becomes ``\\N``."""
    text = rtrim_text(_col(c).cast("string"))
    text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+\\z", ""), "[.]+\\z", "")).otherwise(text)
    return F.coalesce(text, F.lit(NULL_TEXT))


def tsv_escape(c: Column | str) -> Column:
    """Backslash, line ends and tab escaped by a backslash."""
    c = F.replace(_col(c), F.lit("\\"), F.lit("\\\\"))
    for plain, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def tsv_unescape(c: Column | str) -> Column:
    """The inverse of ``tsv_escape``; the bare mark of NULL gives NULL.

    Escaped backslashes are put aside as U+0000 U+0001, U+0000 itself as U+0000 U+0002, meanwhile.
    """
    c = _col(c)
    text = F.replace(F.replace(c, F.lit("\0"), F.lit("\0\2")), F.lit("\\\\"), F.lit("\0\1"))
    for plain, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    text = F.replace(F.replace(text, F.lit("\0\1"), F.lit("\\")), F.lit("\0\2"), F.lit("\0"))
    return F.when(c == NULL_TEXT, F.lit(None).cast("string")).otherwise(text)


def export_text(c: Column | str, dtype: T.DataType) -> Column:
    """Text of a value in an export file, escaped: NULL, booleans as 1 and 0, timestamps without trailing zeros, arrays as JSON.

    A text that reads ``\\N`` is escaped like any other, so it does not come back as NULL.
    """
    c = _col(c)
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "1").when(~c, "0")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = _shortest(c)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(tsv_escape(text), F.lit(NULL_TEXT))


def bytea_to_binary(c: Column | str) -> Column:
    """``\\x`` and hex digits become bytes; other texts give their own bytes."""
    c = _col(c)
    return F.when(c.rlike("\\A\\\\x([0-9a-fA-F]{2})*\\z"), F.unhex(F.substring(c, F.lit(3), F.length(c)))).otherwise(c.cast("binary"))


def truncate_values(c: Column | str, n: int) -> Column:
    """At most n characters; 0 leaves the text as it is."""
    return F.substring(_col(c), 1, n) if n else _col(c)


def byte_diff(a: Column | str, b: Column | str, most: int = 80) -> Column:
    """struct(at, len_a, len_b, tail_a, tail_b): first byte offset at which two texts differ (null if none), and hex from there on."""
    x, y = F.encode(_col(a), "UTF-8"), F.encode(_col(b), "UTF-8")
    hex_a, hex_b = F.hex(x), F.hex(y)
    shorter = F.least(F.length(x), F.length(y))
    steps = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    same = F.get(F.filter(steps, lambda k: F.substring(hex_a, 2 * k + 1, F.lit(2)) != F.substring(hex_b, 2 * k + 1, F.lit(2))), F.lit(0))
    at = F.coalesce(same, F.when(F.length(x) != F.length(y), shorter))

    def tail(h: Column) -> Column:
        return F.substring(h, 2 * F.coalesce(at, F.lit(0)) + 1, F.lit(most))

    return F.struct(at.alias("at"), F.length(x).alias("len_a"), F.length(y).alias("len_b"), tail(hex_a).alias("tail_a"), tail(hex_b).alias("tail_b"))


def format_duration(seconds: Column | str) -> Column:
    """``1h2m3.456s``; hours and minutes only where they are needed."""
    s = _col(seconds).cast("double")
    h, m, rest = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("int"), F.pmod(s, F.lit(60.0))
    return F.when(s >= 3600, F.format_string("%dh%dm%.3fs", h, m, rest)).when(s >= 60, F.format_string("%dm%.3fs", m, rest)).otherwise(F.format_string("%.3fs", rest))
