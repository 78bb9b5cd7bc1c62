import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelode.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'’ é́ΣσςßİI<|>1²½٣# ​ \x1c中文😀\n\t"
    for _ in range(3000):
        yield "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        yield "".join(r.choice("aeitrns") for _ in range(r.randint(0, 40)))
    yield from ["", "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|>", "<|endof", "a" * 3000, "don't they'll"]


def test_ids_equal_the_library(encoder, library):
    for text in texts():
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_small_tables_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr("pagelode.llm.bpe.KEPT_WORDS", 3)
    monkeypatch.setattr("pagelode.llm.bpe.KEPT_PAIRS", 5)
    small = Encoder(Vocabulary(PATH))
    for text in list(texts())[:400]:
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, tiny_dir, library):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    for row in bpe_round_trip(docs, PATH).select("text", "ids", "decoded").collect():
        wanted = library.encode(row.text, add_special_tokens=False).ids
        assert row.ids == wanted
        assert row.decoded == library.decode(wanted, skip_special_tokens=False)


def test_nulls_clashing_names_and_empty_tables(spark):
    rows = [(None, None, "x", 5), (1, "", "x", 5), (2, "the cat", "x", 5), (2, "the cat", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _source string, ids int")
    coded = bpe_encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "_source", "ids"]
    assert sorted(len(r.ids) for r in coded.collect()) == [0, 0, 2, 2]
    back = bpe_decode(coded, PATH)
    assert sorted(r.decoded for r in back.collect()) == ["", "", "the</w> cat</w>", "the</w> cat</w>"]
    assert bpe_encode(docs.limit(0), PATH).count() == 0
