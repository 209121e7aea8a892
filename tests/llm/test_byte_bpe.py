import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import tokens
from leafmill.llm.byte_bpe import encoder_of, read_ranks

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    data = open(f"{tokens.TOKENIZERS}/{request.param}", "rb").read()
    ranks = {t: i for i, t in enumerate(read_ranks(data))}
    return encoder_of(data), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(pair):
    own, public = pair
    parts = ["a", " ", "  ", "\n", "\t", "é", "中", "裏", "覚醒", "龍契", "'s", "'ll", "1", "²", "_", "​", "\x1c", "\x85", "　", "😀", "-", " the", "\xa0", "﻿", "\x00", "word", "!?", "。", ","]
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert own.encode(text) == public.encode_ordinary(text), repr(text)
    han = [chr(rng.randint(0x3400, 0xA000)) for _ in range(3000)]
    for _ in range(3000):
        text = "".join(rng.choice(han) for _ in range(rng.randint(1, 9)))
        assert own.encode(text) == public.encode_ordinary(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    own = encoder_of(open(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}", "rb").read())
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert own.decode(own.encode(text)) == text


def test_long_runs(pair):
    own, public = pair
    for text in ("a" * 5000, " " * 3000 + "x", "中" * 4000, "ab" * 3000):
        assert own.encode(text) == public.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # `ids` clashes with the result
    v = tokens.ranks(spark)
    out = tokens.encode(df, v)
    assert out.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    got = out.collect()
    assert [list(r.ids) for r in got if r.doc_id in (1, 2)] == [[], []] and len(got) == 5
    back = {r.doc_id: r.text for r in tokens.decode(out, v).collect()}
    assert back[3] == "Hello  world\n" and back[1] == ""
    assert tokens.encode(df.limit(0), v).count() == 0
    assert sorted(r.tokens for r in tokens.count(df, v, ["doc_id"]).collect()) == sorted(len(r.ids) for r in got)
