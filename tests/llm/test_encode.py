import random

import pytest
from tokenizers import Tokenizer

from terrakite.llm.encode import TOKENIZER_DIR, decode_column, encode_column, vocabulary


@pytest.fixture(scope="module")
def codec():
    return vocabulary().codec()


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "1", "２", "é", "の", "。", "🙂", "‍", "́", "<|endoftext|>", "-", "...", "X", "½"]


def test_tree_equals_tokenizer_on_random_texts(codec, exact):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        assert list(codec.tree(text, rng.randint(1, 12)).ids) == exact(text), repr(text)


def test_join_is_associative(codec):
    rng = random.Random(5)
    for _ in range(300):
        a, b, c = ("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 20))) for _ in range(3))
        x, y, z = map(codec.leaf, (a, b, c))
        assert list(codec.join(codec.join(x, y), z).ids) == list(codec.join(x, codec.join(y, z)).ids)


@pytest.mark.parametrize("text", ["x" * 20000, " \n" * 9000, "a b  c" * 4000, "のは" * 9000, "​" * 9000, "'re" * 5000])
def test_very_long_texts(codec, exact, text):
    ids = codec.encode(text)
    assert list(ids) == exact(text)
    assert codec.decode(ids) == text


def test_columns_null_empty_blank_and_clashing_names(spark):
    rows = [(1, None, "p"), (2, "", "q"), (3, "  ", "r"), (3, "twice", "s"), (None, "no key", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = {(r.doc_id, tuple(r.ids)) for r in encode_column(df, "doc_id", "text", vocabulary()).collect()}
    assert {(1, ()), (2, ())} <= out and len(out) == 5 and (3, tuple(vocabulary().codec().encode("  "))) in out
    back = {(r.doc_id, r.text) for r in decode_column(encode_column(df, "doc_id", "text", vocabulary()), "doc_id", "ids", vocabulary()).collect()}
    assert back == {(1, ""), (2, ""), (3, "  "), (3, "twice"), (None, "no key")}
    sizes = encode_column(df, "doc_id", "text", vocabulary(), counts_only=True)
    assert sorted(r.n_tokens for r in sizes.collect())[:2] == [0, 0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_column(df, "doc_id", "text", vocabulary()).collect() == []
