import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.encode import Ranks, decode_ids, dictionary, encode_corpus, fold_merges, words_of
from graphloom.llm.queries import TOKENIZERS

JSON, RANKS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no tokenizer files here")

TEXTS = [
    None, "", " ", "  \n\t ", " 　x ", "Hello world, it's 12345 don't DON'T we'll", "naïve café Übermaß 漢字かな交じり文 🙂👍🏽 é", "<|endoftext|> is text", "a" * 700, "ab" * 300 + "漢" * 200, "x\r\ny\r\n\r\nz", "\u0085\u001c\u001f odd", "0x1f {\"k\":15141}",
    "b" * 1500 + " end", "ſ K İ ß", "____ --- ===", "é" * 60, "tab\tsep\t\tend ", "trailing   ",
]


@pytest.fixture(scope="module")
def ranks():
    return Ranks(JSON)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("most", [400_000, 3])
def test_equal_to_the_reference(spark, reference, most):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab 漢é\n1'.") for _ in range(rng.randint(1, 80))) for _ in range(40)] + TEXTS[5:7]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, JSON, ["doc_id"], most=most).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_rare_words_are_joined(spark, reference):
    """The dictionary of all tasks holds some words only: every text gets the ids of the others by the join, texts that repeat too."""
    rng = random.Random(3)
    words = [f"{a}{b}ation" for a in "bcdfgh" for b in ("al", "er", "in")]
    texts = [" ".join(rng.choice(words[:3] if rng.random() < 0.8 else words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df, JSON, ["doc_id"], most=4).collect())
    assert got == sorted((i % 50, reference.encode_ordinary(t)) for i, t in enumerate(texts))


def test_round_trip(spark, ranks):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = encode_corpus(df, JSON, ["doc_id"]).select("doc_id", decode_ids(F.col("ids"), ranks).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_fold_equals_heap(spark, ranks):
    words = ["a", "hello", " understanding", " Übermaß", "zzzzzzzzzz", "abababab", "漢字", " antidisestablishmentarianism"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold_merges(F.col("w"), ranks).alias("ids"))
    assert {r.w: r.ids for r in df.collect()} == {w: ranks.encode_word(w.encode()) for w in words}


def test_dictionary_and_empty_table(spark, ranks):
    df = spark.createDataFrame([("a b a b a c",), (None,)], "text string")
    assert {r.word for r in dictionary(df, ranks).collect()} == {"a", " a", " b", " c"}
    assert {r.word: r.n for r in dictionary(df, ranks).collect()} == {"a": 1, " a": 2, " b": 2, " c": 1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_corpus(empty, JSON, ["doc_id"]).count() == 0
    assert "".join(df.where("text is not null").select(words_of(F.col("text"))).first()[0]) == "a b a b a c"
