"""Pieces, mixing, URL filter, personal data."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseledger.llm import mixing, personal, pieces, urls

# ----------------------------------------------------------------- pieces --

VOCAB = pieces.vocabulary(
    [("<unk>", 0.0, "control")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    + [(t, -1.5 - 0.37 * i, "normal") for i, t in enumerate(
        ["▁a", "ab", "abc", "▁", "▁▁", "b", "a", "▁ab", "c", "é", "日本", "bc", "▁▁▁c", "cab", "bca"])])


def _brute_encode(v, text):
    raw = (" " + text).encode()
    keys = {k: i for i, k in enumerate(v.pieces) if k and i > 256}
    best = {0: (0.0, [])}
    for i in range(len(raw)):
        if i not in best:
            continue
        n = len(raw[i:].decode()[0].encode())
        one = raw[i:i + n] in keys
        steps = [(len(k), v.scores[t], [t]) for k, t in keys.items() if raw.startswith(k, i)]
        if not one:
            steps.append((n, v.unknown, [int(v.bytes_ids[b]) for b in raw[i:i + n]]))
        for n_, s, ids in steps:
            got = (best[i][0] + s, best[i][1] + ids)
            if i + n_ not in best or got[0] > best[i + n_][0] + 1e-9:
                best[i + n_] = got
    return best[len(raw)][1] if text else []


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abc é日本▁\n😀", max_size=16)), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoding_against_brute_force_and_round_trip(texts):
    blocks = list(pieces.encode_blocks(VOCAB, pa.array(texts, pa.string())))
    got = [ids for _, _, c in blocks for ids in c.to_pylist()]
    for t, ids in zip(texts, got):
        assert ids == (None if t is None else _brute_encode(VOCAB, t))
    assert [None if i is None else pieces.decode_ids(VOCAB, i) for _, _, c in blocks for i in pieces._ids_of(c)] == texts


def test_double_array_holds_its_keys():
    keys = {bytes(k): i for i, k in enumerate([b"a", b"ab", b"\xff\x00", b"b", b"abc" * 9])}
    base, check, value = pieces.double_array(keys)

    def look(k):
        s = 0
        for c in k:
            t = base[s] + c
            if check[t] != s:
                return -1
            s = t
        return value[s]
    assert all(look(k) == i for k, i in keys.items())
    assert look(b"abca") == -1 and look(b"c") == -1 and look(b"ba") == -1


def test_merge_ranks_become_log_scores():
    v = pieces.vocabulary([(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
                          + [("a", 0.0, "normal"), ("b", -1.0, "normal"), ("c", -1e9, "normal")])
    p = np.exp(v.scores[256:])
    assert p.sum() == pytest.approx(1) and p[0] > p[1] > p[2]


def test_pieces_on_spark(spark):
    rows = [(1, "ab  cab", "x"), (1, "ab  cab", "x"), (2, None, "y"), (3, "", None), (None, "a " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(df, VOCAB, keep=("doc_id", "text"))
    back = pieces.decode(out, VOCAB, keep=("doc_id", "text"), text="back").collect()
    assert len(back) == 5 and all(r["back"] == r["text"] for r in back)
    assert pieces.encode(df.limit(0), VOCAB).count() == 0
    assert pieces.encode(df, VOCAB, check="same").where("same").count() == 5


# ----------------------------------------------------------------- mixing --

def _docs(spark, sizes, extra=()):
    rows = [(i * 10_000 + k, "w " * (5 + k % 7), s) for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, source string")


def test_exponent_meets_either_aim(spark):
    t = spark.createDataFrame([("=a", 9000), ("=b", 900), ("=c", 100)], "_s string, tokens long")
    share = np.array([0.9, 0.09, 0.01])

    def weights(a):
        return share ** a / (share ** a).sum()
    a = mixing.find_exponent(t, 10_000, entropy=0.7)
    w = weights(a)
    assert -(w * np.log(w)).sum() == pytest.approx(0.7, abs=1e-5)
    a = mixing.find_exponent(t, 10_000, repetitions=3.0)
    assert (weights(a) / share).max() == pytest.approx(3, abs=1e-4)
    assert mixing.find_exponent(t, 10_000, repetitions=0.5) == 1.0  # out of reach
    assert mixing.find_exponent(t, 10_000, entropy=2.0) == 0.0      # always met
    with pytest.raises(ValueError):
        mixing.find_exponent(t, 10_000)


def test_mix_draws_budgets_in_permuted_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 256)
    docs = _docs(spark, {"a": 600, "b": 80, "c": 10}, [(1, None, None), (1, None, None), (2, "", "c"), (None, "w w", "a")])
    mix = mixing.plan(docs, repetitions=2.5)
    rows = [r.asDict() for r in mixing.draw(mix).collect()]
    for s in mix.sources.collect():
        own = [r for r in rows if r["_s"] == s["_s"]]
        drawn, most = sum(r["n_tokens"] for r in own), 11
        assert s["quota"] - most <= drawn <= s["quota"] + 1e-6
        for e in range(s["epochs"]):  # whole epochs hold every token
            assert sum(r["n_tokens"] for r in own if r["epoch"] == e) == s["tokens"]
        assert drawn / s["tokens"] <= 2.5 + 1e-6
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r)
    for b in blocks.values():
        assert sorted(r["position"] for r in b) == list(range(len(b)))
    whole = [sum(r["n_tokens"] for r in blocks[b]) for b in sorted(blocks)][:-1]
    assert all(abs(n - 256) <= 60 for n in whole)
    again = {(r["doc_id"], r["epoch"], r["block"], r["n_tokens"]) for r in rows}
    assert again == {(r["doc_id"], r["epoch"], r["block"], r["n_tokens"]) for r in mixing.draw(mix).collect()}


def test_apply_puts_rows_in_the_drawn_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = [(i, "ab"[i % 2], "w " * (400 if i == 6 else 1 + i % 7)) for i in range(120)]  # one long text
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.plan(docs, repetitions=1.5, whole_epochs=True)
    want = sorted((r["doc_id"], r["epoch"], r["block"]) for r in mixing.draw(mix).collect())
    got = sorted((r["_mix_id"], r["_mix_epoch"], r["_mix_block"]) for r in mixing.blocked(docs, mix).collect())
    assert got == want
    assert sorted(r["doc_id"] for r in mixing.apply(docs, mix).collect()) == sorted(d for d, _, _ in want)


def test_totals_of_bucket_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 40)
    docs = _docs(spark, {"a": 400, "b": 60})
    want = sorted(tuple(r) for r in mixing.draw(mixing.plan(docs, repetitions=2.0)).collect())
    assert max(r[3] for r in want) > 20
    monkeypatch.setattr(mixing, "BUCKET_GROUP", 2)  # many groups, the same blocks
    assert sorted(tuple(r) for r in mixing.draw(mixing.plan(docs, repetitions=2.0)).collect()) == want


def test_apply_returns_columns_of_any_name(spark):
    names = ["_mix_row", "_mix_s", "_mix_epoch", "_mix_block", "epochs", "place", "_s"]
    docs = _docs(spark, {"a": 20, "b": 9}).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = mixing.apply(docs, mixing.plan(docs, repetitions=2.0, whole_epochs=True))
    assert out.columns == docs.columns
    assert {tuple(r)[-len(names):] for r in out.collect()} == {tuple(range(len(names)))}


def test_apply_keeps_every_document(spark):
    docs = _docs(spark, {"a": 300, "b": 40}, [(1, None, None), (None, "x", "a")]).withColumn("_mix_x", F.lit(1))
    mix = mixing.plan(docs, repetitions=2.0, whole_epochs=True)
    out = mixing.apply(docs, mix)
    assert out.columns == docs.columns
    n = {(r["doc_id"], r["source"]): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert len(n) == 342 and set(n.values()) <= {1, 2}
    assert all(c == 1 for (_, s), c in n.items() if s == "a")
    none = docs.limit(0)
    assert mixing.apply(none, mixing.plan(none, repetitions=2.0, whole_epochs=True)).count() == 0


# ------------------------------------------------------------- URL filter --

def _plain_rule(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else None


URLS = ["http://A.Example.ORG/es/1", "http://example.org/en/12", "https://x.example.org/en/2", "http://example.org", None, "",
        "no scheme", "http://a.com/fr/9?x=://y/de/", "http://a.com/de/", "ftp://notcom/de/", "http://org/", "//a.org/b",
        "http://a.org?q", "http://a.org#f", "http://É.com/fr/é", "http://a.net/x\ny", "http://://b.org/", "http://a.net/" + "q" * 100_000]


def test_rules_against_plain_python(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, score int")
    model = ([0.0] * (1 << urls.BITS), 0.0)
    got = {r["page_id"]: r for r in urls.judge(df, model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = _plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0])
        assert got[i]["verdict"] == (rule[1] if rule else "allow")


def test_url_model_learns(spark):
    table = urls.labelled_urls(spark)
    model = urls.train(table)
    pages = spark.createDataFrame([(1, "https://www.spam-links.example.net/x"), (2, "http://blog.museum-garden.example.com/en/4"),
                                   (3, "http://casino-online-poker.example.net/de/9"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, model, rules=[]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    assert urls.train(table.limit(0)) == ([0.0] * (1 << urls.BITS), 0.0)
    assert urls.judge(pages.limit(0), model).count() == 0


def test_url_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    plan = urls.judge(pages, ([0.0] * (1 << urls.BITS), 0.0))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------- personal data --

def _plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        s = sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@given(st.text(alphabet="a@.1 25-+(é%", max_size=40))
@settings(max_examples=1500, deadline=None)
def test_base_spans_against_plain_patterns(text):
    assert personal.base_spans(text) == _plain_base(text)


def test_base_examples():
    text = "é x.y+z@a-b.co.uk, 10.0.0.255 300.1.1.1 1.2.3.4.5.6.7.8 x 4111 1111 1111 1111 +1 (918) 555-1234 a@b@c.d"
    assert personal.base_spans(text) == _plain_base(text) and len(personal.base_spans(text)) == 7
    assert personal.base_spans("a" * 200_000 + " @" * 1000 + "9" * 200_000) == []


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"write to staff member m{i}@mail.example.com today" if i % 2 else f"server address: 10.0.{i}.7 is up")
            for i in range(40)]
    rows += [(100, "server address: 10.0.x.9 is up"), (101, "write to staff member joe@localhost today"),
             (102, "some other 77x88 number"), (103, None), (104, ""), (104, "again joe@localhost alone"), (None, "ip 1.2.3.4")]
    rows += [(200 + i, f"value of {i} here") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal.find_personal(df)
    got = personal.digest(found).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["spans"]) for r in got}
    assert (101, "email:22:35") in by and (100, "") in by and (102, "") in by and (None, "ip:3:10") in by
    assert sum(r["n_learned"] for r in got) == 1
    empty = [r for r in got if r["doc_id"] == 103][0]
    assert empty["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and empty["n_email"] == 0
    out = {(r["doc_id"], r["text"]) for r in personal.redact(df.withColumn("text_key", F.lit(1))).collect()}
    assert (101, "write to staff member [EMAIL] today") in out and (103, None) in out and (2, "server address: [IP] is up") in out
    assert personal.redact(df.limit(0)).count() == 0


def test_bootstrapping_goes_on_while_it_finds_more(spark):
    rows = []
    for k in range(4):  # patterns of step k count only once the entities of step k - 1 are known
        for name in (f"p{k}", f"q{k}"):
            rows += [("email", 1000 + i, [name]) for i in range(18 if k else 22)]
            rows += [(None, 10 * k + i, [name]) for i in range(4 if k else 0)]
            rows += [(None, 10 * (k + 1) + i, [name]) for i in range(4)]
    seen = spark.createDataFrame(rows, "kind string, entity long, patterns array<string>")
    found = personal.confident_patterns(seen).collect()
    assert sorted(r["pattern"] for r in found) == sorted(f"{c}{k}" for c in "pq" for k in range(4))


def test_long_runs_are_split_into_identifiers():
    key = "k1" * 50
    text = f"{'x' * 70}/ab12cd/\u6f22\u5b57{key}\u6f22, and a1."
    assert [text[a:b] for a, b in personal.tokens_like_identifiers(text)] == ["ab12cd", key, "a1"]


def test_context_words_are_whole():
    long = "w" * 5000
    text = f"{long} {long}x 10.0.0.1\u3000{long}y"
    one, two = (personal.patterns(t, t.index("10."), t.index("10.") + 8) for t in (text, text.replace("x 10", "z 10")))
    assert len(one) == 2 and not set(one) & set(two)  # words that differ after 64 characters
    assert all(len(p) < 100 for p in one)
    assert personal.patterns("a  bc (10.0.0.1), d", 7, 15) == ["bc ( <number>", "( <number> ),", "( <number>"]


def _plain_contexts(text, spans):
    out = {}
    for a, b in spans:  # words end at blanks and at every other span
        cuts = sorted({0, len(text), *(p for s in spans for p in s)})
        parts = [(p, w) for p, q in zip(cuts, cuts[1:]) for w in [text[p:q].split()] if w]
        left = [personal._word(w) for p, ws in parts if p < a for w in ws][-2:]
        right = [personal._word(w) for p, ws in parts if p >= b for w in ws][:1]
        out[a] = (left, right)
    return out


@given(st.lists(st.sampled_from(["ab", " ", "1.2.3.4", "x@y.z", ",", "q" * 100, " " * 90, "id:77"]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_contexts_against_plain_python(parts):
    text = "".join(parts)
    spans = list(personal.tokens_like_identifiers(text))
    got = personal.Contexts(text, spans)
    assert {a: got.beside(a) for a, _ in spans} == _plain_contexts(text, spans)


def test_many_spans_in_one_run_take_linear_time():
    import time
    text = ",".join(f"a{i}@b.co" for i in range(60_000))
    begin = time.monotonic()
    spans, seen = personal.observe(text)
    assert len(spans) == len(seen) == 60_000 and time.monotonic() - begin < 20
    assert seen[5]["patterns"][0] == "a4@b.co , <address>"


def test_redact_returns_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "at 10.0.0.1", 7, 8, 9)], "doc_id long, text string, _pii_spans int, _row int, _pii_id int")
    out = personal.redact(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "at [IP]", 7, 8, 9)]


def test_mask_overlapping_spans():
    assert personal.mask("ab 12 cd", [("ip", 3, 5), ("card", 3, 4), ("phone", 4, 6)]) == "ab [IP]cd"
