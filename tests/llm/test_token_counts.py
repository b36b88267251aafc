import random
from collections import Counter

import pytest

from heliograph.llm import token_counts as tc


def lengths(nasty_rows):
    enc = tc.encoder(open(f"{tc.TOKENIZERS}/{tc.RANKS}", "rb").read())
    return [len(enc.encode_ordinary(r[1] or "")) for r in nasty_rows]


def test_histogram(nasty, nasty_rows):
    n = lengths(nasty_rows)
    rows = tc.length_histogram(tc.count_tokens(nasty)).collect()
    by = Counter(n)
    assert {r.context_limit: r.n_docs for r in rows} == by
    for r in rows:
        x = r.context_limit
        assert r.n_tokens == x * by[x]
        assert r.docs_within == sum(v <= x for v in n) and r.tokens_within == sum(v for v in n if v <= x)
        assert r.docs_longer == sum(v > x for v in n) and r.tokens_longer == sum(v for v in n if v > x)
        assert r.truncated_total == sum(min(v, x) for v in n)
        assert abs(r.quantile - r.docs_within / len(n)) < 1e-12


def test_any_limit(nasty, nasty_rows):
    n = lengths(nasty_rows)
    limits = [0, 1, 7, 100, 333, 10**6]
    got = tc.answer(tc.length_histogram(tc.count_tokens(nasty)), limits).collect()
    assert [(r.context_limit, r.docs_within, r.truncated_total) for r in got] == [(x, sum(v <= x for v in n), sum(min(v, x) for v in n)) for x in limits]


def test_empty(nothing):
    assert tc.length_histogram(tc.count_tokens(nothing)).collect() == []


def test_long_runs_count_as_the_whole_pattern_would():
    enc = tc.encoder(open(f"{tc.TOKENIZERS}/{tc.RANKS}", "rb").read())
    rng = random.Random(1)
    for _ in range(400):
        run = lambda: "".join(rng.choices(rng.choice([" ", "\n", "\t", " \n", "\u3000 \r\n\x85\xa0"]), k=rng.choice([1, 2, 999, 1000, 1001, 1500])))
        text = "".join(rng.choice([run(), "word", "'s", "12", "\x1c\x1f", "é", "!?"]) for _ in range(8))
        assert tc.text_length(enc, text) == len(enc.encode_ordinary(text)), repr(text)


@pytest.mark.parametrize("char", [" ", "\n", "\t"])
def test_runs_of_any_length(spark, char):
    """The pattern alone fails on runs of a million."""
    n = 10_000_000
    rows = spark.createDataFrame([(1, char * 1_000_000), (2, f"a{char * 1_000_000}b")], "doc_id long, text string")
    enc = tc.encoder(open(f"{tc.TOKENIZERS}/{tc.RANKS}", "rb").read())
    assert tc.text_length(enc, char * n) == len(enc._encode_single_piece(char * n))
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(rows).collect()}
    assert got[1] == len(enc._encode_single_piece(char * 1_000_000)) and got[2] == len(enc.encode_ordinary("a")) + len(enc._encode_single_piece(char * 999_999)) + len(enc.encode_ordinary(char + "b"))
