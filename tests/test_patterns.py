"""What patterns demand and cost: literals, lint, equal forms."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseledger.operators import patterns as P
from caseledger.operators.classify import (COMPANY_KEYWORDS, DATA_SHEET, IDENTITY_PATTERNS, active_rules, classify,
                                           lint_rules, match_any, to_java)
from caseledger.sources.rules import default_rules, shipped_rules

# ---------------------------------------------------------------- literals --

_ATOMS = st.sampled_from(["tm", "a", "AB", "\\d", "\\s*", "[ab]", "x?", "(?:ab|cd)", "(NO|no)+", "-", "\\b", "^", "$",
                          "(?:tm)?", "b{2}", ".", "\\.", "(q|)", "(?=ab)", "[^a]", "(ab)*", "é", "\\-"])
_PATTERN = st.lists(_ATOMS, min_size=1, max_size=5).map("".join) | \
    st.lists(st.lists(_ATOMS, min_size=1, max_size=3).map("".join), min_size=2, max_size=3).map("|".join)


@given(_PATTERN, st.lists(st.sampled_from(["tm", "TM", "ab", "cd", "a", "b", "NO", "-", " ", "1", ".", "x", "q"]),
                          max_size=8).map("".join))
@settings(max_examples=1500, deadline=None)
def test_every_match_holds_a_literal(pattern, text):
    some = P.required_literals([pattern])
    if some is not None and re.search(pattern, text, re.I):
        assert any(x in text.lower() for x in some)


@pytest.mark.parametrize("patterns, literals", [
    ([r"\bPVT\b", r"PVT\s*LTD"], ["pvt"]), ([r"TM[-\s]?1\b"], ["tm"]), ([r"(NTN|CNIC)\s*\d"], ["cnic", "ntn"]),
    ([r"DATA\s*SHEET"], ["sheet"]), ([r"a?b?"], None), ([r"x"], None), ([r"\d+"], None), ([r"(?:abc)?"], None),
    ([r"abc|\d"], None), ([r"(?x) a b c"], None), ([r"é"], None), ([r"[a-z]{3}"], None), ([r"ab(?!cd)"], ["ab"])])
def test_literals_of_patterns(patterns, literals):
    assert P.required_literals(patterns) == literals


def _flags(rules, text):
    """The rules as Python reads them."""
    out = {n: any(re.search(p, text, re.I) for p in ps) for n, ps in active_rules(rules).items()}
    if re.search(DATA_SHEET, text, re.I) and any(re.search(p, text, re.I) for p in COMPANY_KEYWORDS):
        out["COMPANY"] = True
        if not any(re.search(p, text, re.I) for p in IDENTITY_PATTERNS):
            out["NTN"] = False
    return out


@pytest.mark.parametrize("rules", [shipped_rules(), default_rules()], ids=["shipped", "default"])
def test_flags_with_and_without_literals(spark, rules):
    rnd = random.Random(4)
    words = ["TM-1", "tm 01", "UPDATED [TM-48]", "examination", "REPLY", "ack", "Journal_12", "cnic front", "DATA SHEET",
             "pvt ltd", "scan", "LEGAL", "notice", "demand  note", "Certificate", "ntn", "opposition", "page", "pub no 3",
             "tm16", "TM-11", "ipo-pakistan", "ſmc", "Keep", "é", "limited"]
    texts = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))) for _ in range(250)} | {""})
    df = spark.createDataFrame([(t.replace(" ", "\n", 1),) for t in texts], "files string")
    got = classify(df, rules).collect()
    for row in got:
        want = _flags(rules, row["files"].replace("\n", " "))
        assert {k: row[k] for k in want} == want, row["files"]


def test_fuzzed_rules(spark):
    rnd = random.Random(9)
    atoms = ["tm", "AB", r"\d", r"\s*", "[ab]", "(?:ab|cd)", "(no|on)+", "-", r"\b", "b{2}", r"\.", "(q|)", "x?", "e"]
    rules = [{"name": f"R{i}", "patterns": ["".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 4)))
                                             for _ in range(rnd.randint(1, 3))]} for i in range(40)]
    texts = sorted({"".join(rnd.choice(["tm", "TM", "ab", "cd", "no", "on", "-", " ", "1", ".", "x", "q", "bb", "é"])
                            for _ in range(rnd.randint(1, 8))) for _ in range(200)})
    got = classify(spark.createDataFrame([(t,) for t in texts], "files string"), rules, data_sheet_override=False)
    for row in got.collect():
        for r in rules:
            assert row[r["name"]] == any(re.search(p, row["files"], re.I) for p in r["patterns"]), (r, row["files"])


def test_literals_are_searched_first(spark):
    df = spark.createDataFrame([("x",)], "t string").select(match_any(F.col("t"), [r"\bPVT\b"]).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()


# -------------------------------------------------------------------- lint --

ENDLESS = [r"(a+)+$", r"x(a+)+y", r"x(a|a)*b", r"x(a|aa)+b", r"x(.*a)*y", r"x(a*b?)*c", r"x(a{1,3})+c", r"x(\w+\d*)+y",
           r"x((ab)*)*y", r"^(([a-z])+.)+[A-Z]([a-z])+$", r"x(a+a+b)+c", r"x(a?b?)*y"]
ENDING = [r"(\w+\s)+y", r"TM[-\s]*\d+", r"a.*b.*c", r"x(ab|cd)*z", r"(?:INV|REC)+\d", r"(\d{3}-)+x", r"(a|b)*c", r"(ab?)*c",
          r"x(a+b)+y", r"\b(one|two)\b", r"(?:\d+,)*\d+x"]


@pytest.mark.parametrize("pattern", ENDLESS)
def test_patterns_that_may_never_end(pattern):
    assert P.never_ends(pattern)


@pytest.mark.parametrize("pattern", ENDING)
def test_patterns_that_end(pattern):
    assert not P.never_ends(pattern)


@pytest.mark.parametrize("rules", [shipped_rules(), default_rules()], ids=["shipped", "default"])
def test_the_given_rules_stay_as_they_are(spark, rules):
    clean, said = lint_rules(spark, active_rules(rules))
    assert said == []
    assert clean == {n: [to_java(p) for p in ps] for n, ps in active_rules(rules).items()}


_LOOP_ATOMS = st.sampled_from(["a", "b", "(a|b)*", "(ab|cd)*", "(a+)+", "(?:ab|c)+", "[ab]", "x", "(a|ab)*", "c?", "(ab)+?",
                               "(?:a|b|cd){2,}", "(b|)", "d{1,2}", "(?=a)", "\\b"])


@given(st.lists(_LOOP_ATOMS, min_size=1, max_size=4).map("".join)
       | st.lists(st.lists(_LOOP_ATOMS, min_size=1, max_size=2).map("".join), min_size=2, max_size=3).map("|".join),
       st.text(alphabet="abcdx ", max_size=10))
@settings(max_examples=1500, deadline=None)
def test_simplified_patterns_are_found_in_the_same_texts(pattern, text):
    same = P.simplified(pattern)
    if same is not None:  # this syntax means the same in Python
        assert bool(re.search(same, text, re.I)) == bool(re.search(pattern, text, re.I)), same


def test_long_texts_neither_hang_nor_fail(spark):
    rules = [{"name": "A", "patterns": [r"(a+)+$"]}, {"name": "B", "patterns": [r"(a|b)*c"]},
             {"name": "C", "patterns": [r"x(ab|cd)*z"]}, {"name": "D", "patterns": [r"x(\w|\d)*z"]},
             {"name": "E", "patterns": [r"x(a+)+z", "plain"]}]
    n = 1 << 20
    texts = {"a" * n: [1, 0, 0, 0, 0], "a" * n + "!": [0, 0, 0, 0, 0], "ab" * (n // 2) + "c": [0, 1, 0, 0, 0],
             "x" + "abcd" * (n // 4) + "z": [0, 1, 1, 1, 0], "x" + "abcd" * (n // 4) + "! plain": [0, 1, 0, 0, 1]}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, files string")
    said: list[str] = []
    t0 = time.time()
    got = classify(rows, rules, data_sheet_override=False, messages=said).orderBy("i").collect()
    assert time.time() - t0 < 60
    assert [[int(r[n]) for n in "ABCDE"] for r in got] == list(texts.values())
    assert len(said) == 1 and "x(a+)+z" in said[0] and "never end" in said[0]


def test_first_characters():
    """places where no match can begin are passed over by one look."""
    from caseledger.operators import patterns as PT

    def chars(*patterns):
        found = PT.first_chars(list(patterns))
        return None if found is None else "".join(bytes.fromhex(found[1:-1].replace("\\x", "")).decode())

    assert chars(r"\bTM1\b") == "Tt"
    assert chars(r"\b(TM1|ACK)\b", r"\d+") == "0123456789ATat"
    assert chars(r"a?b") == "ABab" and chars(r"(?:x|y*z)") == "XYZxyz"
    assert chars(r"[C-D]+") == "CDcd" and chars(r"(a|b){2,3}c") == "ABab"
    for p in (r"a*", r"\b", r"x|", r"[^a]b", r".b", r"(?=a)a", r"(?i:a)b", r"\Sb", r"(a)?\1"):
        assert chars(p) is None, p
    assert chars("a", "b*") is None
