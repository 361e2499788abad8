"""Parse and diagnose folder names as DataFrame operators.

Each operator adds columns to its input; a name is split once, and every field
expression reads the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

PARSERS = ("legacy", "token")


def _check(parser: str) -> None:
    if parser not in PARSERS:
        raise ValueError(f"parser must be one of {PARSERS}, got {parser!r}")


def parse_clients(df: DataFrame, parser: str = "legacy", col: str = "client_folder") -> DataFrame:
    """Add ``client_number`` and ``client_name``."""
    _check(parser)
    name = F.col(col)
    if parser == "legacy":
        out = df.withColumn("_client", N.legacy_client(name))
    else:
        out = df.withColumn("_blanked", N.blanked(name)).withColumn("_client", N.token_client(name, F.col("_blanked"))).drop("_blanked")
    return out.select("*", "_client.*").drop("_client")


def parse_cases(df: DataFrame, parser: str = "legacy", col: str = "case_folder",
                tokens: str | None = None) -> DataFrame:
    """X2+X3 / X6-X8: add ``case_no``, ``case_name``, ``tm_no``, ``class_code``.
    With ``tokens`` the token parser's typed tokens are added, as ``tokenize_names``
    gives them. Each step's columns are read by the next, so that all are computed
    once."""
    _check(parser)
    fields = N.legacy_fields if parser == "legacy" else N.token_fields
    out = df.withColumn("_blanked", N.blanked(F.col(col)))
    out = out.withColumns(fields(F.col("_blanked"))).drop("_blanked")
    behind = F.col("_behind")
    full, short = N.legacy_case_name(behind, F.col("tm_no")) if parser == "legacy" else N.token_case_name(behind)
    out = out.withColumns({"_full": full, "_short": short})
    added = [F.col(tokens)] if tokens and parser == "token" else []
    if added:
        out = tokenize_names(out, col, tokens)
    name = F.when(F.col("_full") != "", F.col("_full")).otherwise(F.col("_short")).alias("case_name")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *added, "case_no", name, "tm_no", "class_code")


def tokenize_names(df: DataFrame, col: str = "case_folder", out: str = "tokens") -> DataFrame:
    """Add ``array<struct<type, raw, position>>``."""
    return df.withColumn(out, N.typed_tokens(N.name_tokens(F.col(col))))


def token_rows(df: DataFrame, col: str = "case_folder") -> DataFrame:
    """X4, long form: one row per (name, token) with type, raw and position."""
    toks = tokenize_names(df.select(col), col, "_t")
    return toks.select(col, F.explode("_t").alias("tok")).select(
        col, F.col("tok.position").alias("position"), F.col("tok.type").alias("type"),
        F.col("tok.raw").alias("raw"))


def diagnose_clients(df: DataFrame, col: str = "client_folder") -> DataFrame:
    """Token parse of client folders plus ``recognized`` and ``issues``."""
    parsed = parse_clients(df, "token", col)
    recognized = F.col("client_number") != ""
    return parsed.select(
        F.col(col).alias("folder_name"), "client_number", "client_name",
        recognized.alias("recognized"),
        F.when(recognized, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit(N.CLIENT_ISSUE))).alias("issues"))


def severity(case_no: str = "case_no", tm_no: str = "tm_no", class_code: str = "class_code"):
    """Columns issues, warnings, is_failure, is_warning, is_ok."""
    no_case = F.col(case_no) == ""
    no_tm = F.col(tm_no) == ""
    no_class = F.col(class_code) == ""
    issues = F.array_compact(F.array(F.when(no_case, F.lit(N.CASE_ISSUE))))
    warnings = F.array_compact(F.array(F.when(no_tm, F.lit(N.TM_WARNING)),
                                       F.when(no_class, F.lit(N.CLASS_WARNING))))
    return [
        issues.alias("issues"),
        warnings.alias("warnings"),
        no_case.alias("is_failure"),
        (~no_case & (no_tm | no_class)).alias("is_warning"),
        (~no_case & ~no_tm & ~no_class).alias("is_ok"),
    ]


def diagnose_cases(df: DataFrame, col: str = "case_folder") -> DataFrame:
    """Token parse of case folders plus severity (F1.5)."""
    parsed = parse_cases(df, "token", col)
    return parsed.select(F.col(col).alias("folder_name"), "case_no", "case_name", "tm_no",
                         "class_code", *severity())
