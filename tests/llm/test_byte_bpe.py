import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from pagelode.llm import byte_bpe as B
from pagelode.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=ranks.ranks, special_tokens={}
    )


ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz'’ é́ΣσςßİI<|>1²½٣# ​ \x1c中文😀\n\t",
    "aeitrns ",
    " \n\t'sre lv",
    "a",
    "ab",
    " ",
    "\n a'",
    "the ing'll 12!",
]


@pytest.mark.parametrize("leaf, leaf_bytes", [(1, 1), (2, 1), (3, 2), (5, 3), (2048, 48)])
def test_ids_equal_the_library_for_any_leaf(ranks, library, monkeypatch, leaf, leaf_bytes):
    monkeypatch.setattr(B, "LEAF_CHARS", leaf)
    monkeypatch.setattr(B, "LEAF_BYTES", leaf_bytes)
    monkeypatch.setattr(B, "LEAF_IDS", leaf)
    encoder, r = B.TreeEncoder(ranks), random.Random(leaf)
    for _ in range(2500):
        text = "".join(r.choices(r.choice(ALPHABETS), k=r.randint(0, 60))) * r.choice((1, 1, 3))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize(
    "text",
    ["a" * 9000, "é" * 4001, " " * 5000 + "x" + " " * 5001, "!" * 7777, "abc" * 2333 + "'s" * 2000,
     "\n" * 4097 + "y", "x " * 5000, "1" * 6001, "<|endoftext|>" * 300],
    ids=lambda t: repr(t[:4]),
)
def test_long_pieces_equal_the_library(ranks, library, text):
    encoder = B.TreeEncoder(ranks)
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_any_cut_of_a_text_joins_to_the_same(ranks, library):
    encoder = B.TreeEncoder(ranks)
    text = "It's  the\n\n boys'll!' re\t'r e 12   x''ve aaaaaaaaaaaaaaaaaaaaaaaa"
    for cut in range(len(text) + 1):
        both = encoder._join(encoder._text(text[:cut]), encoder._text(text[cut:]))
        assert [i for ids in both[1] for i in ids] == library.encode_ordinary(text), cut


def test_small_tables_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_RUNS", 2)
    monkeypatch.setattr(B, "KEPT_PAIRS", 2)
    encoder = B.TreeEncoder(ranks)
    text = "one two three two one " * 30 + "z" * 500
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_query_equals_the_library(spark, tiny_dir, library):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, tiny_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("packed", [False, True])
def test_nulls_clashing_names_and_empty_tables(spark, library, packed):
    rows = [(None, None, "x", 5), (1, "", "x", 5), (2, "the cat", None, 5), (2, "the cat", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _Source string, ids int")
    coded = B.byte_bpe_encode(docs, PATH, PATTERN, packed=packed)
    assert coded.columns == ["doc_id", "text", "_Source", "ids"]
    want = library.encode_ordinary("the cat")
    found = [B.unpack(bytes(r.ids)) if packed else r.ids for r in coded.orderBy("doc_id").collect()]
    assert found == [[], [], want, want]
    back = B.byte_bpe_decode(coded, PATH, PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"the cat", b"the cat"]
    nothing = coded.selectExpr("doc_id", "cast(null as binary) as ids" if packed else "cast(null as array<int>) as ids")
    assert {bytes(r.decoded) for r in B.byte_bpe_decode(nothing, PATH, PATTERN).collect()} == {b""}
    assert B.byte_bpe_round_trip(docs.limit(0), PATH, PATTERN, packed=packed).count() == 0
