"""Time on long texts, and the same results as on short ones."""

import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from caseledger.llm import pieces, toxicity
from caseledger.llm.common import texts_of
from caseledger.llm.textvec import NOT_WORD, word_blocks


def _model(words):
    """Only ``words`` are toxic."""
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    data, off = texts_of(pa.array([" ".join(words)]))
    for w in word_blocks(data, off, NOT_WORD):
        weights[w.hash & toxicity._MASK] = 20
    return toxicity.Model(-6.0, weights)


@given(st.lists(st.sampled_from(["fine é words", "bad thing", "日本 bad 😀", "ok", ""]), max_size=8),
       st.sampled_from([". ", "! ", "\n"]))
@settings(max_examples=100, deadline=None)
def test_offending_sentences_are_found_in_code_points(parts, stop):
    text = stop.join(parts)
    _, spans = toxicity._score(pa.array(["é bad.", text, None]), _model(["bad"]), True)
    got = [text[s["start"]:s["end"]] for s in spans[1]]
    assert got == [p.rstrip(" 😀") if "😀" not in p else p for p in parts if "bad" in p]
    assert [(s["start"], s["end"]) for s in spans[0]] == [(0, 5)] and spans[2] == []


def test_a_long_offending_text_takes_linear_time():
    text = "é this is a very bad sentence. " * 33_000
    t0 = time.time()
    _, spans = toxicity._score(pa.array([text]), _model(["bad"]), True)
    assert time.time() - t0 < 10
    assert len(spans[0]) == 33_000
    assert text[spans[0][-1]["start"]:spans[0][-1]["end"]] == "é this is a very bad sentence"


VOCAB = pieces.vocabulary(
    [("<unk>", 0.0, "control")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    + [(t, -1.5 - 0.37 * i, "normal") for i, t in enumerate(
        ["▁a", "ab", "abc", "▁", "▁▁", "b", "a", "▁ab", "c", "é", "日本", "bc", "▁▁▁c", "cab", "bca"])])


@given(st.text(alphabet="abcé日本😀", max_size=60), st.integers(1, 12), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_long_chunks_are_solved_as_short_ones(text, long_chunk, window):
    col = pa.array([text, "ab " + text])
    want = [c.to_pylist() for _, _, c in pieces.encode_blocks(VOCAB, col)]
    old = pieces.LONG_CHUNK, pieces.WINDOW
    pieces.LONG_CHUNK, pieces.WINDOW = long_chunk, window
    try:
        assert [c.to_pylist() for _, _, c in pieces.encode_blocks(VOCAB, col)] == want
    finally:
        pieces.LONG_CHUNK, pieces.WINDOW = old


def test_a_long_text_without_blanks_takes_linear_time():
    v = pieces.load()
    rng = np.random.default_rng(2)
    syllables = np.array(["ta", "ren", "é", "kol", "日", "str", "ing", "0x", "😀", "mm"])
    text = "".join(syllables[rng.integers(0, 10, 400_000)])
    t0 = time.time()
    (_, _, coded), = pieces.encode_blocks(v, pa.array([text]))
    assert len(text.encode()) > 1_000_000 and time.time() - t0 < 10
    assert pieces.decode_ids(v, np.array(coded[0].as_py())) == text
