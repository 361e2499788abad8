"""Folder-name parsers as Spark column expressions.

Two parsers exist: ``legacy`` (the default of every shipped run) and ``token``.
Both are built-in text expressions evaluated in the JVM, with no Python: a name's tokens
are put between single blanks once, and each field is one regex over that text, which
Spark compiles into its stages (array lambdas are interpreted).

Regex dialect: the patterns are Python ``re`` patterns. Java needs ``(?U)`` to
give ``\\d`` and ``\\s`` the same Unicode meaning, ``(?d)`` so that only ``\\n``
ends a line, and ``[\\s\\x1c-\\x1f]`` to split where ``str.split()`` splits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name patterns of the two parsers (Python syntax).
LEGACY_CLIENT = r"^([A-Z]-\d+)\s+(.+)$"
LEGACY_CASE_NO = r"^[A-Z]\d{3}-\d{3}$"
LEGACY_SHORT_NAME = r"^[A-Z][a-zA-Z]+$"
LEGACY_TM_NO = r"^\d{6}$"
LEGACY_CLASS = r"^C\d+$"

TOKEN_PATTERNS = [  # checked in this order, first match gives the type
    ("CLIENT_NO", r"^[A-Z]-\d+$"),
    ("CASE_NO", r"^[A-Z]\d{2,3}-\d{3}$"),
    ("TM_NO", r"^\d{6}$"),
    ("CLASS", r"^[Cc]\d{1,2}$"),
    ("DATE", r"^\d{2}-\d{2}-\d{4}$"),
    ("NUM", r"^\d+$"),
    ("WORD", r"^[A-Za-z][A-Za-z&.'-]*$"),
]
TOKEN_OTHER = "OTHER"

# Placeholders of the deep scan and diagnosis messages.
ROOT_CLIENT_NAME = "Root/Uncategorized"
NO_CASE_NAME = "—"
CLIENT_ISSUE = "does not match pattern [A-Z]-NNN ClientName"
CASE_ISSUE = "missing Case # (expected pattern like A001-001 or A52-029)"
TM_WARNING = "missing TM No (expected 6-digit number)"
CLASS_WARNING = "missing Class code (expected C01, C29, etc.)"

# Python's str.split() whitespace = Java's Unicode White_Space plus \x1c-\x1f.
_WS = r"[\s\x1c-\x1f]"
SPLIT_PATTERN = "(?U)" + _WS + "+"


def java_token_pattern(p: str) -> str:
    """Anchored token pattern in Java syntax with Unicode digits."""
    return "(?U)" + p


def name_tokens(name: Column) -> Column:
    """Whitespace tokens of a name, empty tokens dropped (= ``str.split()``)."""
    return F.filter(F.split(F.coalesce(name, F.lit("")), SPLIT_PATTERN), lambda x: x != "")


def blanked(name: Column) -> Column:
    """The tokens of a name with one blank before, between and behind them, so that a
    whole token is what a regex finds between two blanks."""
    return F.concat(F.lit(" "), F.trim(F.array_join(F.split(F.coalesce(name, F.lit("")), SPLIT_PATTERN), " ")), F.lit(" "))


def _inner(pattern: str) -> str:
    """A token pattern without its anchors."""
    return pattern[1:-1]


def _first(text: Column, pattern: str) -> Column:
    """The first token of ``blanked`` text that matches, else an empty text."""
    return F.regexp_extract(text, f"(?U) ({_inner(pattern)}) ", 1)


def _last(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, f"(?Us)^.* ({_inner(pattern)}) ", 1)


def _behind(text: Column, pattern: str) -> Column:
    """What follows the first matching token, blanks at both ends; else an empty text."""
    return F.regexp_extract(text, f"(?Us) {_inner(pattern)}( .*)", 1)


# ---------------------------------------------------------------- legacy --

def legacy_client(name: Column) -> Column:
    """struct(client_number, client_name): ``A-12 Name`` -> (``A-12``, ``Name``)."""
    p = "(?Ud)^([A-Z]-\\d+)" + _WS + "+(.+)$"
    name = F.coalesce(name, F.lit(""))
    number = F.regexp_extract(name, p, 1)
    return F.struct(
        number.alias("client_number"),
        F.when(number != "", F.regexp_extract(name, p, 2)).otherwise(name).alias("client_name"),
    )


def legacy_fields(text: Column) -> dict[str, Column]:
    """case_no, tm_no, class_code of ``blanked`` text, the last matching token each, and
    ``_behind``, what ``legacy_case_name`` looks at."""
    return {"case_no": _last(text, LEGACY_CASE_NO), "tm_no": _last(text, LEGACY_TM_NO),
            "class_code": _last(text, LEGACY_CLASS), "_behind": _behind(text, LEGACY_CASE_NO)}


def legacy_case_name(behind: Column, tm_no: Column) -> tuple[Column, Column]:
    """(full, short) name from what lies behind the first case token: up to the first
    token equal to the TM, without case and class tokens (only when a TM is present),
    and the first capitalised word."""
    cut = F.call_function("substring_index", behind, F.concat(F.lit(" "), tm_no, F.lit(" ")), F.lit(1))
    codes = f"(?U) (?:{_inner(LEGACY_CASE_NO)}|{_inner(LEGACY_CLASS)})(?= |\\z)"
    full = F.when(tm_no != "", F.trim(F.regexp_replace(cut, codes, ""))).otherwise(F.lit(""))
    return full, _first(behind, LEGACY_SHORT_NAME)


# ----------------------------------------------------------------- token --

def token_type(x: Column) -> Column:
    """First matching type in ``TOKEN_PATTERNS`` order. WORD is tested first:
    it needs no digit while every other pattern requires one, so it can
    overlap none of them and the result is the same, with one regex test for
    the most common tokens."""
    order = [kp for kp in TOKEN_PATTERNS if kp[0] == "WORD"] + \
        [kp for kp in TOKEN_PATTERNS if kp[0] != "WORD"]
    expr = None
    for kind, p in order:
        cond = x.rlike(java_token_pattern(p))
        expr = F.when(cond, F.lit(kind)) if expr is None else expr.when(cond, F.lit(kind))
    return expr.otherwise(F.lit(TOKEN_OTHER))


def typed_tokens(tokens: Column) -> Column:
    """array<struct<type, raw, position>>; position is 0-based."""
    return F.transform(tokens, lambda x, i: F.struct(
        token_type(x).alias("type"), x.alias("raw"), i.alias("position")))


_TOKEN = dict(TOKEN_PATTERNS)


def token_client(name: Column, text: Column) -> Column:
    """First token must be CLIENT_NO; the rest, joined by one blank, is the name.
    ``text`` is the ``blanked`` name."""
    p = f"(?Us)^ ({_inner(_TOKEN['CLIENT_NO'])})( .*)"
    number = F.regexp_extract(text, p, 1)
    return F.struct(
        number.alias("client_number"),
        F.when(number != "", F.trim(F.regexp_extract(text, p, 2))).otherwise(F.coalesce(name, F.lit(""))).alias("client_name"),
    )


def token_fields(text: Column) -> dict[str, Column]:
    """case_no, tm_no, class_code of ``blanked`` text, the first token of each type, and
    ``_behind``, what ``token_case_name`` looks at. (No token matches two of these
    types' patterns, so the order of the types plays no part.)"""
    return {"case_no": _first(text, _TOKEN["CASE_NO"]), "tm_no": _first(text, _TOKEN["TM_NO"]),
            "class_code": _first(text, _TOKEN["CLASS"]), "_behind": _behind(text, _TOKEN["CASE_NO"])}


def token_case_name(behind: Column) -> tuple[Column, Column]:
    """(full, fallback) name from what lies behind the first CASE_NO: up to the first
    TM_NO, without CASE_NO and CLASS tokens, and the first WORD."""
    case_no, tm_no, code = (_inner(_TOKEN[k]) for k in ("CASE_NO", "TM_NO", "CLASS"))
    full = F.trim(F.regexp_replace(behind, f"(?Us) (?:{tm_no} .*|(?:{case_no}|{code})(?= |\\z))", ""))
    return full, _first(behind, _TOKEN["WORD"])


def signature(toks: Column) -> Column:
    """Structural signature such as ``[CASE_NO] [UPPER] [TM_NO] [CLASS]``.

    WORD tokens written in capitals are shown as UPPER.
    """
    return F.array_join(F.transform(toks, lambda t: F.concat(
        F.lit("["),
        F.when((t["type"] == "WORD") & (t["raw"] == F.upper(t["raw"])), F.lit("UPPER"))
        .otherwise(t["type"]),
        F.lit("]"))), " ")
