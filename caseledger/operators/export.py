"""Export projections, dates, sort and file sinks."""

from __future__ import annotations

import datetime as _dt
import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..schema import BASE_EXPORT, EXPORT_HEADERS, by_position

# Date formats (strftime %d-%b-%y and %Y-%m-%d %H:%M:%S).
RECORD_DATE_FORMAT = "dd-MMM-yy"
TOKEN_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Short export names per run type.
SHORT_NAMES = {
    "consultants_data": "cons_patterns",
    "clients_data": "clients_patterns",
    "all_data": "all_patterns",
    "custom_data": "custom_patterns",
}
QUICK_EXPORT_NAME = "drive_data_export"


def export_columns(rules: list[dict]) -> list[str]:
    """8 base headers + rule names (file order, stripped, no repeats) + DATE ADDED."""
    cols = list(BASE_EXPORT)
    for r in rules:
        name = (r.get("name") or "").strip()
        if name and name not in cols:
            cols.append(name)
    cols.append(EXPORT_HEADERS["date_added"])
    return cols


def with_headers(records: DataFrame) -> DataFrame:
    """Rename internal columns to export headers (rule columns already are)."""
    return records.select(*[F.col(f"`{c}`").alias(EXPORT_HEADERS.get(c, c)) for c in records.columns])


def project_export(records: DataFrame, rules: list[dict], include_updated_on: bool = False) -> DataFrame:
    """Keep the known export columns that exist, in export order."""
    df, at = by_position(records)
    at = {EXPORT_HEADERS.get(c, c): col for c, col in at.items()}
    cols = export_columns(rules)
    if include_updated_on:
        cols.append(EXPORT_HEADERS["updated_on"])
    return df.select(*[at[c].alias(c) for c in cols if c in at])


def quick_export(records: DataFrame) -> DataFrame:
    """P10: the 9 base columns only; Catalyst prunes every rule column."""
    df = with_headers(records)
    cols = BASE_EXPORT + [EXPORT_HEADERS["date_added"]]
    return df.select(*[F.col(f"`{c}`") for c in cols if c in df.columns])


def stamp_dates(records: DataFrame, as_of, mode: str = "strict") -> DataFrame:
    """DATE ADDED (and UPDATED ON outside token mode) from ``as_of``.

    ``as_of`` is a date/datetime/ISO string; a parameter, so output is
    reproducible (the tool used the wall clock).
    """
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, _dt.datetime) else as_of.isoformat()
    ts = F.to_timestamp(F.lit(str(as_of)))
    if mode == "token":
        return records.withColumn("date_added", F.date_format(ts, TOKEN_DATE_FORMAT))
    day = F.date_format(ts, RECORD_DATE_FORMAT)
    return records.withColumn("date_added", day).withColumn("updated_on", day)


def sort_records(records: DataFrame) -> DataFrame:
    """O1: by client number, then case number; the other key columns break
    ties (binary collation = code-point order). Keys are unique per root after
    grouping, so the range partitioner can split any hot client number."""
    tail = [c for c in ["client_name", "case_name", "tm_no", "class_code", "root"]
            if c in records.columns]
    return records.orderBy("client_number", "case_no", *tail)


def python_booleans(df: DataFrame) -> DataFrame:
    """Booleans as ``True``/``False`` text, as the tool's CSV shows them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "boolean":
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        out.append(c.alias(f.name))
    return df.select(*out)


#: Rows of a CSV file at most. Where cells hold line breaks a file is read whole by one
#: task, so files must not grow with the table.
FILE_ROWS = 50_000

# Read-side null marker that never occurs in text: an unquoted empty field is
# null, a quoted one ("") is the empty string.
_CSV_NULL = "\u0000"


# Line-safe cells: code of each character that would end a line or start a code.
# Every backslash of an encoded cell starts a code; the backslash's own comes first on
# the way in and last on the way out.
_LINE_SAFE = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def _texts(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def line_safe(c: Column) -> Column:
    """Text without line breaks: backslash, LF and CR as ``\\s``, ``\\n``, ``\\r``."""
    return reduce(lambda x, code: F.replace(x, F.lit(code[0]), F.lit(code[1])), _LINE_SAFE, c)


def from_line_safe(c: Column) -> Column:
    return reduce(lambda x, code: F.replace(x, F.lit(code[1]), F.lit(code[0])), reversed(_LINE_SAFE), c)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", lines: bool = False) -> None:
    """Header, no index, multi-line cells quoted (FILES holds newlines).
    Empty text is written as ``""`` and null as an empty field, so a read-back
    keeps the two apart (missing values are ``""`` in this data model). No file holds
    more than ``FILE_ROWS`` rows, unless ``lines`` is set: each row is then one line
    (cells by ``line_safe``), so large files are read by many tasks; other tools see
    the codes."""
    out = _texts(df, line_safe) if lines else df
    writer = out.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
    if lines:
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    else:
        writer = writer.option("maxRecordsPerFile", FILE_ROWS)
    writer.csv(path)


def read_csv(spark, path: str, lines: bool = False) -> DataFrame:
    """Read back a W3 export (multi-line cells, ``""`` vs null kept). ``lines``: it was
    written so; a file is then split among tasks."""
    out = (spark.read.option("header", True).option("multiLine", not lines)
           .option("escape", '"').option("nullValue", _CSV_NULL).csv(path))
    return _texts(out, from_line_safe) if lines else out


def write_export(df: DataFrame, base_dir: str, run: str, fmt: str = "csv",
                 source: DataFrame | None = None) -> str | None:
    """Never overwrite: write ``name``, else ``name_1``, ``name_2``...

    Skips empty results (returns None). The existence test is the write
    itself (``errorifexists``), so it works on any file system. ``source`` is
    an input that is empty exactly when ``df`` is; testing it instead saves
    computing ``df`` up to its first row.
    """
    if (df if source is None else source).isEmpty():
        return None
    name = SHORT_NAMES.get(run, run)
    for i in itertools.count():
        path = f"{base_dir.rstrip('/')}/{name if i == 0 else f'{name}_{i}'}.{fmt}"
        try:
            if fmt == "csv":
                write_csv(python_booleans(df), path)
            else:
                df.write.mode("errorifexists").format(fmt).save(path)
            return path
        except AnalysisException as exc:
            if "PATH_ALREADY_EXISTS" in str(exc) or "already exists" in str(exc):
                continue
            raise

