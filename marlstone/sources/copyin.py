"""COPY: bulk loads of delimited text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SqlError
from ..spec import TableSpec, split_top, unquoted

_UNSET = "\x00\x01unset\x01\x00"


def parse_copy(sql: str) -> tuple[str, list[str] | None, str, dict]:
    """(table, columns, file, options) of a COPY statement, with the options in either notation."""
    m = re.match(r"(?is)^\s*COPY\s+(\"[^\"]+\"|`[^`]+`|\w+)\s*(?:\(([^)]*)\))?\s+FROM\s+'((?:[^']|'')*)'\s*(?:WITH\s*)?(.*?);?\s*$", sql)
    if not m:
        raise SqlError("expected COPY table [(columns)] FROM 'file' [WITH (options)]")
    rest = m.group(4).strip()
    rest = rest[1:-1] if rest.startswith("(") and rest.endswith(")") else re.sub(r"(?i)\b(CSV|HEADER|DELIMITER|NULL|QUOTE)\b", r",\1", rest).lstrip(", ")
    got = {"header": False, "delimiter": ",", "quote": '"', "null": ""}
    for part in split_top(rest) if rest else []:
        x = re.match(r"(?is)^(\w+)(?:\s+(?:AS\s+)?(.*))?$", part)
        if not x:
            raise SqlError(f"can't read option {part!r}")
        name, value = x.group(1).lower(), (x.group(2) or "").strip()
        value = value[1:-1].replace("''", "'") if value.startswith("'") else value
        if name == "format" and value.lower() == "csv" or name == "csv":
            continue
        if name == "header":
            got["header"] = value.lower() not in ("false", "off", "0")
        elif name in ("delimiter", "quote", "null"):
            got[name] = value
        else:
            raise SqlError(f"option {part!r} isn't supported")
    columns = [unquoted(c) for c in split_top(m.group(2))] if m.group(2) else None
    return unquoted(m.group(1)), columns, m.group(3).replace("''", "'"), got


def _fields(names: list[str], sep: str, quote: str, null: str) -> list[Column]:
    """The fields of the column ``value`` by name; a line that isn't fields between separators is an error.

    Each field is taken with the separator before it.  A quoted one is closed, with doubled quotes
    inside, or the parts don't make up the line again.
    """
    s, q = re.escape(sep), re.escape(quote)
    line = F.concat(F.lit(sep), F.col("value"))
    pattern = f"{s}(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}(?={s}|$)|(?!{q})(?:(?!{s}).)*+)"
    parts = F.regexp_extract_all(line, F.lit(pattern), 0)
    whole = F.array_join(parts, "") == line
    wrong = F.raise_error(F.concat(F.lit(f"expected {len(names)} fields, quotes closed: "), F.col("value")))
    held = F.when(whole & (F.size(parts) == len(names)), parts).otherwise(wrong.cast("array<string>"))
    out = []
    for i, n in enumerate(names):
        field = F.substring(held[i], F.lit(len(sep) + 1), F.length(held[i]))
        inner = F.replace(F.substring(field, F.lit(len(quote) + 1), F.length(field) - 2 * len(quote)), F.lit(quote * 2), F.lit(quote))
        out.append(F.when(field.startswith(quote), inner).when(field != null, field).alias(n))
    return out


def read_delimited(spark: SparkSession, path: str, spec: TableSpec, columns: list[str] | None, header: bool, delimiter: str, quote: str, null: str) -> DataFrame:
    """The file's rows with the table's columns; columns that aren't in the file have their defaults.

    Only an unquoted field that equals the null marker is NULL.  With the default marker Spark's
    reader does that by itself; any other marker needs to know which fields were quoted, so lines
    are cut by a regular expression then.  Blank lines are skipped; lines don't continue within quotes.
    """
    names = [spec.column(c).name for c in columns] if columns else spec.names()
    if null == "":
        raw = ", ".join(f"`{n}` string" for n in names)
        opts = {"sep": delimiter, "quote": quote, "escape": quote, "header": header, "enforceSchema": True, "mode": "FAILFAST", "nullValue": _UNSET, "emptyValue": ""}
        rows = spark.read.schema(raw).options(**opts).csv(path)
    else:
        text = spark.read.text(path)
        if header:
            # the first line of each file
            first = text.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("s"), "value", F.monotonically_increasing_id().alias("i"))
            heads = first.groupBy("p").agg(F.min("i").alias("i"))
            text = first.join(F.broadcast(heads), ["p", "i"], "left_anti").select("value")
        rows = text.select(F.regexp_replace("value", "\r+$", "").alias("value")).where("value <> ''").select(*_fields(names, delimiter, quote, null))
    typed = []
    for c in spec.columns:
        if c.name in names:
            typed.append(F.col(f"`{c.name}`").cast(c.type).alias(c.name))
        else:
            typed.append((F.expr(c.default) if c.default else F.lit(None)).cast(c.type).alias(c.name))
    return rows.select(*typed)
