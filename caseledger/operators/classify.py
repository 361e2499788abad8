"""The rule engine.

Rules are compiled once per plan on the driver (tens of rows) into one
``rlike`` literal per rule; the regex is compiled once per task. A rule is
true when any of its patterns is found, ignoring case, in the blank-joined
stems of the whole case, so a match may cross two files.
"""

from __future__ import annotations

import logging
import re
from collections import OrderedDict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import by_position
from . import patterns as PT

# Java flags giving Python ``re`` behaviour: ignore case (Unicode-aware),
# Unicode \d \w \s \b, and only \n ends a line.
RULE_FLAGS = "(?iuUd)"
# The same for text and patterns of ASCII alone, where Java is much faster.
ASCII_FLAGS = "(?id)"

# The data-sheet override (keywords and identity patterns).
DATA_SHEET = r"DATA\s*SHEET"
COMPANY_KEYWORDS = [r"\bPVT\b", r"\bPRIVATE\b", r"PVT\s*LTD", r"\bLIMITED\b",
                    r"\bLTD\b", r"\bSMC\b", r"\bINC\b", r"\bCORPORATION\b"]
IDENTITY_PATTERNS = [r"\bNTN\b", r"\bCNIC\b", r"\bNIC\b", r"\bPASSPORT\b", r"\bID\s*[BF]?\b"]
COMPANY_RULE = "COMPANY"
NTN_RULE = "NTN"

_LOG = logging.getLogger(__name__)
_BACKREF = re.compile(r"\\[1-9]|\\k<|\(\?P=")


def active_rules(rules: list[dict]) -> "OrderedDict[str, list[str]]":
    """Stripped names; rules without name or patterns dropped; patterns of
    equal names concatenated in file order."""
    out: OrderedDict[str, list[str]] = OrderedDict()
    for r in rules:
        name = (r.get("name") or "").strip()
        pats = list(r.get("patterns") or [])
        if name and pats:
            out.setdefault(name, []).extend(pats)
    return out


def route_rules(rules: list[dict], route_by: str = "name") -> "OrderedDict[str, list[str]]":
    """Group patterns by rule ``name`` (actual behaviour) or by ``target``
    (the documented one, empty target = name)."""
    if route_by == "name":
        return active_rules(rules)
    if route_by != "target":
        raise ValueError("route_by must be 'name' or 'target'")
    renamed = [{"name": (r.get("target") or "").strip() or (r.get("name") or "").strip(),
                "patterns": r.get("patterns")} for r in rules if (r.get("name") or "").strip()]
    return active_rules(renamed)


def plain_text_pattern(words: list[str]) -> str:
    """C4: ``\\b(w1|w2)\\b`` over escaped words (blank lines ignored)."""
    words = [w.strip() for w in words if w.strip()]
    return r"\b(" + "|".join(re.escape(w) for w in words) + r")\b" if words else ""


def make_rule(name: str, patterns: list[str], target: str = "", plain_text: bool = False) -> dict:
    """A rule as the editor saves it: name/target upper-cased and trimmed."""
    name = name.strip().upper()
    target = target.strip().upper() or name
    pats = [p.strip() for p in patterns if p.strip()]
    if plain_text and pats:
        pats = [plain_text_pattern(pats)]
    return {"name": name, "patterns": pats, "target": target}


def to_java(pattern: str) -> str:
    """A Python pattern with the same meaning in Java: group names (Java allows
    letters and digits only), ``[`` and ``&`` inside a class (operators in Java),
    and ``\\Z`` (the very end in Python, ``\\z`` in Java)."""
    out, names, i, in_class = [], {}, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i:i + 2]
            out.append("\\z" if pair == "\\Z" and not in_class else pair)
            i += 2
            continue
        if in_class:
            out.append("\\" + c if c in "[&" else c)
            in_class = c != "]"
        elif c == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", pattern[i:])[0]  # a first ] is literal
            out.append(head.replace("]", "\\]"))
            i += len(head)
            continue
        elif m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
            out.append(f"(?<{names.setdefault(m[1], f'g{len(names)}')}>")
            i += len(m[0])
            continue
        elif m := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(f"\\k<{names.get(m[1], m[1])}>")
            i += len(m[0])
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _safe(pattern: str, name: str, messages: list[str]) -> str | None:
    """``pattern`` as it can run on any text: itself, the same search in a form that
    ends, or None with a message."""
    if not PT.needs_care(pattern):
        return pattern
    same = PT.simplified(pattern)
    if same is not None:
        if PT.needs_stack(same):
            messages.append(f"pattern {pattern!r} in {name} may need a deep stack on long texts")
        return same
    if PT.never_ends(pattern):
        messages.append(f"skipping pattern {pattern!r} in {name}: it may never end on long texts")
        return None
    messages.append(f"pattern {pattern!r} in {name} may need a deep stack on long texts")
    return pattern


def lint_rules(spark: SparkSession, rules: "OrderedDict[str, list[str]]"):
    """Drop patterns that cannot compile, keep the rest.

    Python-invalid patterns are skipped as the tool skips them. Java-invalid
    ones would fail the whole job, so they are probed at plan time: one probe
    for all patterns, per-pattern probes only if that one fails. Patterns whose
    search may take exponential time, or a stack as deep as the text, are put into
    an equal form that doesn't, or skipped (the former) with a message. Returns
    (clean rules with Java patterns, list of messages).
    """
    messages, clean = [], OrderedDict()
    for name, pats in rules.items():
        keep = []
        for p in pats:
            try:
                re.compile(p)
            except re.error as exc:
                messages.append(f"skipping bad pattern {p!r} in {name}: {exc}")
                continue
            keep.append(to_java(p))
        clean[name] = [safe for p in keep if (safe := _safe(p, name, messages)) is not None]

    def probe(pats):
        spark.range(1).select(*[F.lit("").rlike(RULE_FLAGS + p) for p in pats]).collect()

    every = [p for pats in clean.values() for p in pats]
    if every:
        try:
            probe(every)
        except Exception:  # noqa: BLE001 - Spark raises several error classes here
            for name, pats in clean.items():
                ok = []
                for p in pats:
                    try:
                        probe([p])
                        ok.append(p)
                    except Exception as exc:  # noqa: BLE001
                        messages.append(f"skipping pattern {p!r} in {name}: "
                                        f"{type(exc).__name__}")
                clean[name] = ok
    low = {}
    for name in rules:
        if name.lower() in low:
            messages.append(f"rules {low[name.lower()]} and {name} differ in case only: two columns that one "
                            "stored table can hold only with spark.sql.caseSensitive")
        low.setdefault(name.lower(), name)
    return clean, messages


def match_any(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """True if any pattern is found in ``text`` (ignore case); never null. Where
    every match must hold one of a few literals, ASCII texts are searched for these
    first, in ``low``, their lower-case form, and most never meet the regex."""
    if not patterns:
        return F.lit(False)
    low = F.lower(text) if low is None else low
    plain = [p for p in patterns if not _BACKREF.search(p)]
    special = [[p] for p in patterns if _BACKREF.search(p)]
    marked = [p for p in plain if PT.required_literals([p])]
    ascii_text = F.octet_length(text) == F.char_length(text)

    def found(some: list[str]) -> Column:
        pattern = "|".join(f"(?:{p})" for p in some) if len(some) > 1 else some[0]
        full = text.rlike(RULE_FLAGS + pattern)
        if not pattern.isascii():
            return full
        # one look at a character spares trying each pattern at nearly every place
        first = PT.first_chars(some)
        short = text.rlike(f"{ASCII_FLAGS}(?={first})(?:{pattern})" if first else ASCII_FLAGS + pattern)
        literals = PT.required_literals(some)
        if literals:
            short = _any([F.contains(low, F.lit(x)) for x in literals]) & short
        return F.when(ascii_text, short).otherwise(full)

    groups = [g for g in (marked, [p for p in plain if p not in marked], *special) if g]
    return F.coalesce(_any([found(g) for g in groups]), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rule_text(files: Column) -> Column:
    """All stems of a case joined by one blank (the text rules run on)."""
    return F.translate(F.coalesce(files, F.lit("")), "\n", " ")


def classify(df: DataFrame, rules, spark: SparkSession | None = None,
             files_col: str = "files", route_by: str = "name",
             data_sheet_override: bool = True, lint: bool = True,
             messages: list[str] | None = None) -> DataFrame:
    """C2 + C3: one boolean column per active rule, then the data-sheet
    override. ``rules`` is a list of rule dicts or an already active mapping.
    What the check of the patterns has to say is logged as a warning and added
    to ``messages``.
    """
    active = rules if isinstance(rules, OrderedDict) else route_rules(rules, route_by)
    if lint:
        active, said = lint_rules(spark or df.sparkSession, active)
        for message in said:
            _LOG.warning(message)
        if messages is not None:
            messages += said
    tmp = df.withColumn("_text", rule_text(F.col(files_col))).withColumn("_low", F.lower("_text"))
    text, low = F.col("_text"), F.col("_low")
    flags = OrderedDict((name, match_any(text, pats, low)) for name, pats in active.items())
    if data_sheet_override:
        fire = match_any(text, [DATA_SHEET], low) & match_any(text, COMPANY_KEYWORDS, low)
        identity = match_any(text, IDENTITY_PATTERNS, low)
        flags[COMPANY_RULE] = F.when(fire, F.lit(True)).otherwise(
            flags.get(COMPANY_RULE, F.lit(None).cast("boolean")))
        flags[NTN_RULE] = F.when(fire & ~identity, F.lit(False)).otherwise(
            flags.get(NTN_RULE, F.lit(None).cast("boolean")))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in flags]
    return tmp.select(*keep, *[v.alias(k) for k, v in flags.items()])


def rule_hits_long(records: DataFrame, rule_names: list[str], id_cols: list[str]) -> DataFrame:
    """(record, rule) pairs where the rule is true."""
    df, at = by_position(records)
    hits = F.array(*[F.when(at[c], F.lit(c)) for c in rule_names if c in at])
    return df.select(*[at[c].alias(c) for c in id_cols], F.explode(F.array_compact(hits)).alias("rule"))


def rule_hit_counts(records: DataFrame, rule_names: list[str]) -> DataFrame:
    """Number of records per rule (zero counts kept), one pass."""
    df, at = by_position(records)
    counts = [F.struct(F.lit(c).alias("rule"), F.count_if(at[c]).alias("hits")) for c in rule_names if c in at]
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))
