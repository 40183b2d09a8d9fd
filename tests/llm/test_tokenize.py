import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.lexicon import Lexicon
from threadloom.llm.tokenize import PATTERN, TOKENIZERS, Encoder, encode_column, load_ranks, merge

VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
RANKS = load_ranks(VOCABULARY) if os.path.exists(VOCABULARY) else {}
SMALL = Encoder(RANKS, Lexicon.build({w: RANKS[w] for w in list(RANKS)[:3000]}))
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={}) if RANKS else None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_ids_are_those_of_the_public_tokenizer(text):
    assert SMALL.encode([text])[0] == TRUTH.encode_ordinary(text)


def test_long_runs_special_text_and_memo():
    r = random.Random(1)
    run = "".join(r.choice("abcñß漢") for _ in range(20_000))
    for text in (run, "a" * 50_000, "<|endoftext|> hi", "don't  stop\n\n\t x", " ", "🙂🙂 №7"):
        assert SMALL.encode([text])[0] == TRUTH.encode_ordinary(text)
    assert SMALL.encode([None, ""]) == [[], []] and merge(b"hello", RANKS) == TRUTH.encode_ordinary("hello")


def test_ids_decode_to_the_text():
    back = {i: w for w, i in RANKS.items()}
    text = "Über den Wolken – naïve façade, señal №7.\n"
    assert b"".join(back[i] for i in SMALL.encode([text])[0]).decode() == text


def test_column(spark):
    frame = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "x")], "doc bigint, body string").selectExpr("*", "'c' AS text", "1 AS n")
    found = sorted(((r.doc or 0), r.ids) for r in encode_column(frame, "doc", "body").collect())
    assert found == [(0, TRUTH.encode_ordinary("x")), (1, TRUTH.encode_ordinary("Hello world")), (1, TRUTH.encode_ordinary("Hello world")), (2, []), (3, [])]
    assert encode_column(frame.limit(0), "doc", "body").count() == 0
