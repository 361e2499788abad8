"""Rule sets. A rule is ``{name, patterns: [regex], target}``."""

from __future__ import annotations

import copy

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..schema import RULES

# The built-in rule set (14 rules), seeded when no rule file exists.
_DEFAULT_PATTERNS = [
    ("TM-1", [r"\bTM-1\b", r"\bTM1\b", r"\(TM-1\)", r"\[TM-1\]"]),
    ("TM-48", [r"\bTM-48\b", r"\bTM48\b", r"\(TM-48\)", r"\[TM-48\]",
               r"UPDATED\s*\[TM-48\]", r"TM-48\s*-\s*COPY"]),
    ("EXAM", [r"\bEXAMINATION\b", r"\bSHOWCASE\b", r"SHOWCASE\s*NOTICE",
              r"17\(2\)\(B\)", r"14\(3\)\(A\)", r"14\(1\)\(b\)",
              r"\bREPLY\b", r"REPLY\s*OF\s*NOTICE", r"MULTIPAL\s*REPLIES"]),
    ("ACK", [r"\bACK\b", r"ACKNOWLEDGMENT", r"ACKNOLDGEMENT"]),
    ("ACCEPTANCE", [r"\bACCEPTANCE\b", r"ACCEPTANCE\s*DONE", r"COMPLETE\s*FILE"]),
    ("D-NOTE", [r"\bTM-11\b", r"\bTM11\b", r"IPO-PAKISTAN\s*__\s*TM\s*11",
                r"TM\s*11", r"DEMAND\s*NOTE"]),
    ("TM-16", [r"\bTM-16\b", r"\bTM16\b", r"TM\s*16"]),
    ("TM-50", [r"\bTM-50\b", r"\bTM50\b", r"TM\s*50"]),
    ("TM-06", [r"IPO-PAKISTAN\s*__\s*TM\s*06", r"IPO-PAKISTAN\s*__\s*TM\s*\d{2}"]),
    ("COMPANY", [r"BOARD\s*OF\s*RESULOTION", r"BOARD\s*OF\s*RESOLUTION",
                 r"\bPVT\s*LTD\b", r"\bPRIVATE\s*LIMITED\b", r"\bSMC\b", r"\bLIMITED\b"]),
    ("NTN", [r"\bNTN\b", r"\bCNIC\b", r"\bNIC\b", r"\bPASSPORT\b", r"\bID\s*[BF]?\b",
             r"DATA\s*SHEET"]),
    ("OPPO", [r"WITHDRAWN\s*LETTER", r"\bOPPOSITION\b", r"GROUNDS\s*OF\s*OPPOSITION",
              r"\bOPPO\b", r"LEGAL\s*NOTICE", r"LEGAL\s*NOTIC\b"]),
    ("PUB", [r"\bPUBLICATION\b", r"JOURNAL\s*PUBLICATION", r"JOURNAL\s*CONVERT",
             r"Journal_\d+"]),
    ("CERTIFICATE", [r"\bCERTIFICATE\b", r"CERTIFICATE\s*WITH\s*SIGN",
                     r"ORIGINAL\s*CERTIFICATE", r"TRADE\s*MARK\s*CERTIFICATE",
                     r"RENEWAL\s*CERTIFICATE"]),
]

# The rule file shipped with the tool (15 rules, 113 patterns).
_SHIPPED_PATTERNS = [
    ("TM-1", [r"\b(TM1|TM\-1|TM\-01|TM\ 01|tm1|tm\-01|tm\ 1|tm\ 01)\b"]),
    ("TM-48", [r"\bTM-48\b", r"\bTM48\b", r"\(TM-48\)", r"\[TM-48\]",
               r"UPDATED\s*\[TM-48\]", r"TM-48\s*-\s*COPY"]),
    ("EXAM", [r"\bEXAMINATION\b", r"\bSHOWCASE\b", r"SHOWCASE\s*NOTICE",
              r"17\(2\)\(B\)", r"14\(3\)\(A\)", r"14\(1\)\(b\)", r"\bREPLY\b",
              r"REPLY\s*OF\s*NOTICE", r"MULTIPAL\s*REPLIES"]),
    ("ACK", [r"\bACK\b", r"ACKNOWLEDGMENT", r"ACKNOLDGEMENT"]),
    ("ACCEPTANCE", [r"\bACCEPTANCE\b", r"\bACCEPT\b", r"\bACCEPTED\b", r"\baccepted\b",
                    r"\baccept\b", r"ACCEPTANCE\s*DONE", r"COMPLETE\s*FILE"]),
    ("D-NOTE", [r"\bTM-11\b", r"\bTM11\b", r"IPO-PAKISTAN\s*__\s*TM\s*11", r"TM\s*11",
                r"DEMAND\s*NOTE"]),
    ("TM-16", [r"\bTM-16\b", r"\bTM16\b", r"\bTM 16\b", r"TM\s*16",
               r"IPO-PAKISTAN\s*__\s*TM\s*16", r"TM\s*16"]),
    ("TM-50", [r"\bTM-50\b", r"\bTM50\b", r"TM\s*50", r"IPO-PAKISTAN\s*__\s*TM\s*50",
               r"TM\s*50"]),
    ("TM-06", [r"IPO-PAKISTAN\s*__\s*TM\s*06", r"IPO-PAKISTAN\s*__\s*TM\s*\d{2}",
               r"IPO-PAKISTAN\s*__\s*TM\s*06", r"TM\s*06", r"\boppo\b", r"\bopposition\b",
               r"\bOPPO\b", r"\bOPPOSITION\b", r"\bTM6\b"]),
    ("COMPANY", [r"BOARD\s*OF\s*RESULOTION", r"BOARD\s*OF\s*RESOLUTION", r"\bPVT\s*LTD\b",
                 r"\bPRIVATE\s*LIMITED\b", r"\bSMC\b", r"\bLIMITED\b", r"\b(SMC)\b",
                 r"\b(PVT)\b", r"\bLtd\b", r"\bLTD\b", r"\bDATA\s*SHEET\b",
                 r"\bAUDITORS\s*CERTIFICATE\b", r"\bAUDITOR\s*CONSENT\b",
                 r"\bAUDITOR\s*REPORT\b", r"\bAUDITORS\b", r"\bAUDITOR\b", r"\bauditors\b",
                 r"\bauditor\b", r"\bINCORPORATION\b", r"\bFILING\b"]),
    ("NTN", [r"\bNTN\b", r"\bCNIC\b", r"\bNIC\b", r"\bPASSPORT\b", r"\bID\s*[BF]?\b",
             r"DATA\s*SHEET"]),
    ("OPPO", [r"WITHDRAWN\s*LETTER", r"\bOPPOSITION\b", r"GROUNDS\s*OF\s*OPPOSITION",
              r"\bOPPO\b", r"\bTM-05\b", r"\bTM-5\b", r"\bTM5\b", r"LEGAL\s*NOTICE",
              r"LEGAL\s*NOTIC\b", r"\bTM-06\b", r"\bTM-6\b", r"\bTM6\b"]),
    ("PUB", [r"\bPUBLICATION\b", r"JOURNAL\s*PUBLICATION", r"J\s*NO", r"JOURNAL\s*CONVERT",
             r"\bJOURNAL\b", r"\bPUB\b", r"\bJNO\b", r"Journal_\d+", r"PUB_\d+", r"PUB\d+"]),
    ("CERTIFICATE", [r"\bCERTIFICATE\b", r"\bCOM\b", r"\b[C]\b", r"\bCER\b",
                     r"CERTIFICATE\s*WITH\s*SIGN", r"ORIGINAL\s*CERTIFICATE",
                     r"TRADE\s*MARK\s*CERTIFICATE", r"RENEWAL\s*CERTIFICATE"]),
    ("TM-11", [r"\bTM-11\b", r"\bTM11\b", r"\bTM 11\b", r"TM\s*11",
               r"IPO-PAKISTAN\s*__\s*TM\s*11", r"TM\s*11"]),
]


def _as_rules(pairs):
    return [{"name": n, "patterns": list(p), "target": n} for n, p in pairs]


DEFAULT_RULES = _as_rules(_DEFAULT_PATTERNS)
SHIPPED_RULES = _as_rules(_SHIPPED_PATTERNS)


def default_rules() -> list[dict]:
    """The built-in set (a fresh copy)."""
    return copy.deepcopy(DEFAULT_RULES)


def shipped_rules() -> list[dict]:
    """The rule file that ships with the tool (a fresh copy)."""
    return copy.deepcopy(SHIPPED_RULES)


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules from a multi-line JSON array.

    Missing file -> the built-in set; unreadable file -> no rules. The rule
    table has tens of rows, so it is collected to the driver where the rule
    expressions are built once per plan.
    """
    try:
        schema = T.StructType(RULES.fields + [T.StructField("_corrupt_record", T.StringType())])
        df = spark.read.schema(schema) \
            .option("multiLine", True).option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        rows = df.collect()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return default_rules()
        return []
    if any(r["_corrupt_record"] is not None for r in rows):
        return []
    return [{"name": r["name"] or "", "patterns": list(r["patterns"] or []),
             "target": r["target"] or ""} for r in rows]
