"""Changes of a table's columns that a feed tells between its row events."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.decode import decode_value
from ledgerline.streaming.changes import resolve

#: Column types of the source, by the types they take here. Others are read as Spark names them.
TYPES = {
    "int": "int", "integer": "int", "int4": "int", "serial": "int", "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "smallint": "smallint", "int2": "smallint", "text": "string", "varchar": "string",
    "character varying": "string", "char": "string", "character": "string", "uuid": "string", "json": "string", "jsonb": "string", "boolean": "boolean", "bool": "boolean", "real": "float", "float4": "float",
    "double precision": "double", "float8": "double", "numeric": "decimal(38,18)", "decimal": "decimal(38,18)", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp",
    "timestamp with time zone": "timestamp", "timestamp without time zone": "timestamp", "bytea": "binary",
}

NAME = r'(?:"((?:[^"]|"")+)"|([A-Za-z_][\w$]*))'
ALTER = re.compile(rf"\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{NAME}(?:\s*\.\s*{NAME})?\s+(.*?);?\s*", re.I | re.S)
ADD = re.compile(rf"ADD\s+(?:COLUMN\s+)?(IF\s+NOT\s+EXISTS\s+)?{NAME}\s+(.+?)(?:\s+DEFAULT\s+('(?:[^']|'')*'|[-+\w.]+)(?:::[\w ]+)?)?(\s+NOT\s+NULL|\s+NULL)?", re.I | re.S)
DROP = re.compile(rf"DROP\s+(?:COLUMN\s+)?(IF\s+EXISTS\s+)?{NAME}(?:\s+(?:CASCADE|RESTRICT))?", re.I | re.S)
RENAME = re.compile(rf"RENAME\s+(?:COLUMN\s+)?{NAME}\s+TO\s+{NAME}", re.I | re.S)


@dataclass(frozen=True)
class Alter:
    """One column added (with the type and default of its rows), dropped or renamed."""

    kind: str
    name: str
    to: str | None = None
    dtype: T.DataType | None = None
    default: str | None = None
    lenient: bool = False

    @property
    def rewrites(self) -> bool:
        """Whether rows that no event touches have to be written anew: files are read by column name, so a new column without default is NULL in them."""
        return self.kind != "add" or self.default is not None


def _unquoted(quoted: str | None, plain: str | None) -> str:
    return quoted.replace('""', '"') if quoted is not None else plain.lower()


def source_type(text: str) -> T.DataType:
    """A column type of the source; ValueError if it has none here."""
    low = re.sub(r"\s+", " ", text.strip().lower())
    if low.endswith("[]"):
        return T.ArrayType(source_type(low[:-2]))
    sized = re.fullmatch(r"(numeric|decimal)\s*\((\d+)(?:\s*,\s*(\d+))?\)", low)
    if sized:
        return T.DecimalType(int(sized[2]), int(sized[3] or 0))
    bare = re.sub(r"\s*\(\s*\d+\s*\)", "", low)
    try:
        return T.DataType.fromDDL(TYPES.get(bare, low))
    except Exception as error:
        raise ValueError(f"no type here for {text.strip()!r}") from error


def parse_alters(ddl: str) -> list[Alter]:
    """The column changes of an ALTER TABLE statement; ValueError if it does anything else to columns. Other statements give none."""
    found = ALTER.fullmatch(ddl)
    if found is None:
        return []
    out = []
    for action in _actions(found[5]):
        if m := RENAME.fullmatch(action):
            out.append(Alter("rename", _unquoted(m[1], m[2]), to=_unquoted(m[3], m[4])))
        elif re.match(r"(ADD|DROP)\s+(CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK)\b", action, re.I):
            continue
        elif m := DROP.fullmatch(action):
            out.append(Alter("drop", _unquoted(m[2], m[3]), lenient=bool(m[1])))
        elif m := ADD.fullmatch(action):
            default = m[5]
            if default is not None:
                default = default[1:-1].replace("''", "'") if default.startswith("'") else None if default.upper() == "NULL" else default
            out.append(Alter("add", _unquoted(m[2], m[3]), dtype=source_type(m[4]), default=default, lenient=bool(m[1])))
        elif re.match(r"(OWNER|SET|RESET|ENABLE|DISABLE|CLUSTER|VALIDATE|REPLICA)\b", action, re.I):
            continue
        else:
            raise ValueError(f"cannot follow {action!r}")
    return out


def _actions(text: str) -> list[str]:
    """The actions of a statement: parted by commas outside of brackets and quotes."""
    parts, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "," and depth == 0:
            parts.append(part.strip())
            part = ""
            continue
        else:
            depth += (c == "(") - (c == ")")
        part += c
    return [*parts, part.strip()]


def alter(df: DataFrame, change: Alter, keys: list[str]) -> DataFrame:
    """``df`` with a column added at its end, dropped or renamed. Key columns stay as they are."""
    low = {c.lower(): c for c in df.columns}
    there = change.name if change.name in df.columns else low.get(change.name.lower())
    if change.kind == "add":
        if there is not None:
            if change.lenient:
                return df
            raise ValueError(f"column {change.name} is there already")
        value = F.lit(None).cast(change.dtype) if change.default is None else decode_value(F.lit(change.default), change.dtype)
        return df.withColumn(change.name, value)
    if there is None:
        if change.lenient:
            return df
        raise ValueError(f"no column {change.name} to {change.kind}")
    if there in resolve(df.schema, keys):
        raise ValueError(f"cannot {change.kind} the key column {there}")
    if change.kind == "drop":
        return df.drop(there)
    if change.to in df.columns:
        raise ValueError(f"column {change.to} is there already")
    return df.withColumnRenamed(there, change.to)
