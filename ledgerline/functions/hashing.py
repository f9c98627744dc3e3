"""Row hashes over canonical texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.canonical import NULL_TEXT, canonical, rtrim_text

INEXACT = (T.FloatType, T.DoubleType, T.MapType, T.StructType, T.VariantType)
TEXT = (T.StringType, T.CharType, T.VarcharType)


def is_json(field: T.StructField) -> bool:
    return bool(field.metadata.get("json"))


def hashable_columns(source: DataFrame, target: DataFrame | None = None, exclude: Iterable[str] = (), float_digits: int | None = None) -> list[str]:
    """Columns of both sides (names without regard to case), by lower-case name.

    A column that is approximate, nested or JSON on either side is left out, unless float_digits takes
    approximate ones in, rounded. JSON text is told by the field's metadata ``{"json": true}`` or by
    ``exclude``.
    """
    sides = [{f.name.lower(): f for f in df.schema.fields} for df in (source, target if target is not None else source)]
    skip = INEXACT if float_digits is None else INEXACT[2:]
    left_out = {c.lower() for c in exclude}
    names = [n for n in sides[0] if n in sides[1] and n not in left_out]
    return sorted(n for n in names if not any(isinstance(side[n].dataType, skip) or is_json(side[n]) for side in sides))


def text_columns(source: DataFrame, target: DataFrame | None = None) -> set[str]:
    """Lower-case names of the columns that are text on either side; they are right-trimmed on both."""
    return {f.name.lower() for df in (source, target) if df is not None for f in df.schema.fields if isinstance(f.dataType, TEXT)}


def _texts(df: DataFrame, columns: list[str], trim: set[str], compat: bool, float_digits: int | None) -> list[Column]:
    fields = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for name in columns:
        text = canonical(df[fields[name.lower()].name], fields[name.lower()].dataType, compat=compat, float_digits=float_digits)
        out.append(rtrim_text(text) if name.lower() in trim else text)
    return out


def row_hash(df: DataFrame, columns: list[str] | None = None, style: str = "safe", trim: set[str] | None = None, compat: bool = True, float_digits: int | None = None) -> Column:
    """MD5 over the canonical texts of the columns, in the order of their lower-case names.

    ``compat`` joins them by ``|``, so ``a|b`` and ``a``, ``b`` collide; ``safe`` puts each text's length
    before it and marks NULL apart from the text that reads ``\\N``.
    """
    names = sorted(columns if columns is not None else hashable_columns(df, float_digits=float_digits), key=str.lower)
    return texts_hash(column_texts(df, names, text_columns(df) if trim is None else trim, compat, float_digits), style)


def texts_hash(texts: list[Column], style: str = "safe") -> Column:
    """``row_hash`` of the texts that ``column_texts`` gives."""
    if style == "compat":
        return F.md5(F.concat_ws("|", *[F.coalesce(t, F.lit(NULL_TEXT)) for t in texts]))
    # One concatenation of all pieces: one a text, put together by another, would copy every text twice.
    pieces = [F.lit("")]
    for k, t in enumerate(texts):
        pieces += [F.lit("|")] * (k > 0) + [F.coalesce(F.length(t).cast("string"), F.lit("N")), F.when(t.isNull(), F.lit("")).otherwise(F.lit(":")), F.coalesce(t, F.lit(""))]
    return F.md5(F.concat(*pieces))


def column_texts(df: DataFrame, columns: list[str], trim: set[str], compat: bool = True, float_digits: int | None = None) -> list[Column]:
    """The canonical texts that ``row_hash`` takes of the columns, NULL as NULL."""
    fields = {f.name.lower(): f.name for f in df.schema.fields}
    return [F.when(df[fields[n.lower()]].isNotNull(), t) for n, t in zip(columns, _texts(df, columns, trim, compat, float_digits))]


def row_key(df: DataFrame, keys: list[str]) -> Column:
    """Canonical text of a key, its parts joined by U+001F."""
    return F.concat_ws("\x1f", *_texts(df, keys, set(), True, None))


def hash_bucket(h: Column | str, buckets: int) -> Column:
    """First eight hex digits of a hash, as a number, modulo the number of buckets."""
    h = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % buckets


def hash_halves(h: Column | str) -> list[Column]:
    """The 16 bytes of an MD5 as two integers, hi and lo, which ``halves_hash`` puts together again.

    Groups by them are hashed and kept as plain numbers, in less memory than by 32 hex digits.
    """
    h = F.col(h) if isinstance(h, str) else h
    return [F.conv(F.substring(h, start, 16), 16, -10).cast("bigint").alias(name) for start, name in ((1, "hi"), (17, "lo"))]


def halves_hash(hi: Column | str = "hi", lo: Column | str = "lo") -> Column:
    """The hash, in hex digits, whose ``hash_halves`` these are."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def half_bucket(hi: Column | str, buckets: int) -> Column:
    """``hash_bucket`` of the hash with this first half."""
    return F.shiftrightunsigned(hi, 32) % buckets


__all__ = ["NULL_TEXT", "hash_bucket", "hashable_columns", "is_json", "row_hash", "row_key", "text_columns"]
