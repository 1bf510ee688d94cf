import random

import pytest

from loomgraph.llm import tokens

DOCS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "It's <|endoftext|> 12 and <|fim_prefix|>"), (5, "Œuvre naïve 壷の図 🖼️ \r\n x\x1c\x85y"), (5, "repeat"), (None, "no id"),
    (6, "word, 12 ab.c " * 20_000), (7, "x" * 120_000), (8, " " * 120_000 + "a"), (9, "=" * 120_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [7]) for i, t in DOCS], "doc_id bigint, text string, ids array<int>")


def test_ids_are_those_of_the_library(docs):
    plain = tokens.encoding()
    found = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in tokens.token_ids(docs).collect()), key=repr)
    assert found == sorted(((i or 0, plain.encode_ordinary(t or "")) for i, t in DOCS), key=repr)
    counts = sorted((r["doc_id"] or 0, r["n"]) for r in tokens.token_counts(docs).collect())
    assert counts == sorted((i, len(x)) for i, x in found)


def test_special_strings_are_ordinary_text(docs):
    assert 50256 not in tokens.encode("a <|endoftext|> b", tokens.encoding())


def test_round_trip(docs):
    found = sorted(((r["doc_id"] or 0), r["text"]) for r in tokens.decoded(tokens.token_ids(docs)).collect())
    assert found == sorted((i or 0, t or "") for i, t in DOCS)


def test_cuts_at_safe_boundaries_change_nothing():
    rng, plain = random.Random(1), tokens.encoding()
    for _ in range(200):
        text = "".join(rng.choice(["a", "é", "'s", "'re", "'", " ", "  ", "\n", "9", "٣", "²", ".", "!?", "，", "€", "ß", "字", "ж", "́", "_", "\xa0", "\u2028", "\x1c", "\u0378"]) for _ in range(300))
        assert "".join(tokens.segments(text, 7)) == text
        assert tokens.encode(text, plain, 7) == plain.encode_ordinary(text)


def test_empty(spark):
    assert tokens.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("text", ["壷の図，" * 30_000, "Слово, слово. " * 20_000, "12 345 " * 30_000, "ab1२x٣," * 20_000, "٣٤٥٦ कखग। " * 15_000])
def test_long_texts_of_any_script_are_cut(text):
    parts = list(tokens.segments(text))
    assert "".join(parts) == text and max(map(len, parts)) < tokens.SEGMENT + 100
    assert tokens.encode(text, tokens.encoding()) == tokens.encoding().encode_ordinary(text)
