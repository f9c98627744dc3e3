"""Values of change events as typed columns: bytes, array literals, booleans, JSON, and everything a cast can do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.canonical import truncate_values

#: Source types of byte strings, by name and by number.
BYTE_TYPES = ("bytea", "oid_17", "17")

#: Tokens of an array literal: quoted items, braces, commas, and runs of anything else.
TOKEN = r'"(?:[^"\\]|\\.)*+"|[{},]|(?:[^{},"\\]|\\.)++'
#: Bounds before a literal, as in ``[0:1]={a,b}``.
BOUNDS = r"\A(?:\[[+-]?[0-9]+:[+-]?[0-9]+\])+="


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there; neither does it make the plan grow."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bytes_text(cell: Column, source_type: Column) -> Column:
    """The text of a byte string as ``decode_value`` takes it: of texts that are no byte strings at the source, ``\\x`` and their own bytes in hex."""
    own = F.concat(F.lit("\\x"), F.hex(F.encode(cell, "UTF-8")))
    return F.when(source_type.isNotNull() & ~F.lower(source_type).isin(*BYTE_TYPES) & cell.startswith("\\x"), own).otherwise(cell)


def decode_value(cell: Column, dtype: T.DataType, max_length: int = 0) -> Column:
    """The text of a value as ``dtype``; NULL where it does not fit.

    Bytes are ``\\x`` and hex digits, or else the text's own bytes. Booleans are t, f, 1, 0 and what Spark casts. Arrays are
    literals in braces, nested as deep as the type, or JSON arrays; an item that does not fit makes the whole value NULL. Structs and maps are JSON,
    whose fields are NULL where they do not fit.
    Strings are cut to max_length characters unless that is 0.
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(cell.isin("t", "1"), True).when(cell.isin("f", "0"), False).otherwise(cell.try_cast("boolean"))
    if isinstance(dtype, T.BinaryType):
        digits = F.when(cell.rlike("\\A\\\\x([0-9a-fA-F]{2})*\\z"), F.unhex(F.substring(cell, F.lit(3), F.length(cell))))
        return F.when(cell.startswith("\\x"), digits).otherwise(F.encode(cell, "UTF-8"))
    if isinstance(dtype, T.ArrayType):
        return _array(cell, dtype, max_length)
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.when(F.get_json_object(cell, "$").isNotNull(), F.from_json(cell, dtype))
    if isinstance(dtype, T.VariantType):
        return F.try_parse_json(cell)
    if isinstance(dtype, T.StringType):
        return truncate_values(cell, max_length)
    return cell.try_cast(dtype)


def _array(cell: Column, dtype: T.ArrayType, max_length: int) -> Column:
    depth, leaf = 1, dtype.elementType
    while isinstance(leaf, T.ArrayType):
        depth, leaf = depth + 1, leaf.elementType
    texts: T.DataType = T.StringType()
    for _ in range(depth):
        texts = T.ArrayType(texts)
    literal = F.regexp_replace(cell, BOUNDS, "")
    # Of JSON, items are read as texts and decoded like those of literals.
    json = F.when(cell.startswith("["), F.when(literal == cell, cell)).otherwise(None)
    json = F.coalesce(json, F.when(literal.startswith("{"), array_json(literal, depth)))

    def whole(items: Column, level: int) -> Column:
        """Whether all items fit."""
        if level < depth:
            return F.forall(items, lambda x: x.isNull() | whole(x, level + 1))
        return F.forall(items, lambda x: x.isNull() | decode_value(x, leaf, max_length).isNotNull())

    def typed(items: Column, level: int) -> Column:
        return F.transform(items, lambda x: typed(x, level + 1) if level < depth else decode_value(x, leaf, max_length))

    parsed = F.from_json(json, texts)
    return parsed if isinstance(leaf, T.StringType) and not max_length else named(parsed, lambda items: F.when(whole(items, 1), typed(items, 1)))


def array_json(literal: Column, depth: int) -> Column:
    """An array literal whose items all lie ``depth`` braces deep, as JSON with strings for items; NULL if it is none.

    The literal is cut into tokens, which are checked by a fold over their kinds and written one by one.
    """
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("last"), F.lit(True).alias("ok"))

    def step(s: Column, token: Column) -> Column:
        def after(kind: Column) -> Column:
            last, at = s["last"], s["depth"]
            fits = (
                F.when(kind == "{", last.isin("", "{", ",") & (at < depth) & ((last == "") == (at == 0)))
                .when(kind == "}", last.isin("{", "}", "i") & (at > 0))
                .when(kind == ",", last.isin("}", "i") & (at > 0))
                .otherwise(last.isin("{", ",") & (at == depth))
            )
            return F.struct((at + F.when(kind == "{", 1).when(kind == "}", -1).otherwise(0)).alias("depth"), kind.alias("last"), (s["ok"] & fits).alias("ok"))

        return named(F.when(token.isin("{", "}", ","), token).otherwise("i"), after)

    def quoted(text: Column) -> Column:
        return named(F.to_json(F.array(text)), lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2))

    def written(t: Column) -> Column:
        plain = F.when(t.startswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.trim(t))
        return F.when(t == "{", "[").when(t == "}", "]").when(t == ",", ",").when(F.lower(F.trim(t)) == "null", "null").otherwise(quoted(F.regexp_replace(plain, r"(?s)\\(.)", "$1")))

    def joined(tokens: Column) -> Column:
        right = F.aggregate(tokens, state, step, lambda s: s["ok"] & (s["depth"] == 0) & (s["last"] == "}"))
        return F.when(right, F.array_join(F.transform(tokens, written), ""))

    def checked(tokens: Column) -> Column:
        # Nothing of the literal lies between tokens: an open quote would.
        complete = F.length(F.array_join(tokens, "")) == F.length(literal)
        return F.when(complete, named(F.filter(tokens, lambda t: F.trim(t) != ""), joined))

    return named(F.regexp_extract_all(literal, F.lit(f"(?s){TOKEN}"), F.lit(0)), checked)
