import re

import pytest

from pyspark.sql import functions as F

from pagelode.functions import text as T
from pagelode.functions.stem import stem_tokens, stem_word

# Porter's published examples, one or more per rule
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress",
    "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "communism": "commun", "activate": "activ",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "élan": "élan", "is": "is", "x1": "x1",
}


@pytest.mark.parametrize("word", STEMS)
def test_porter_examples(word):
    assert stem_word(word) == STEMS[word]


def test_stemming_a_column_keeps_order_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, ["cats", "hopping", "cats"]), (2, []), (3, None), (4, ["ponies"])],
        "id int, t array<string>",
    ).coalesce(1)
    got = {r.id: r.s for r in df.select("id", stem_tokens("t").alias("s")).collect()}
    assert got == {1: ["cat", "hop", "cat"], 2: [], 3: [], 4: ["poni"]}


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ('élan: "a b" ~x^2', 'élan "a b" x 2'),
        (":::", ""),
        ("a+b -c* (d) 'e'", "a+b -c* (d) 'e'"),
        ("a \t b_1", "a b_1"),
    ],
)
def test_clean_query(spark, raw, cleaned):
    assert one(spark, raw, T.clean_query) == cleaned


def test_clean_text_knows_all_white_space(spark):
    assert one(spark, "　a\x1c\x85b \n", T.clean_text) == "a b"


def test_tokens(spark):
    text = "The Café's 3.14 a x_y IS...ok É"
    assert one(spark, text, T.tokens) == ["café", "3.14", "x_y", "ok"]


def test_tokens_without_stop_words(spark):
    words = one(spark, "to be", lambda c: T.tokens(c, stop_words=[], min_length=1))
    assert words == ["to", "be"]


def test_snippet(spark):
    assert one(spark, "x" * 300, T.snippet) == "x" * 300
    assert one(spark, "x" * 301, T.snippet) == "x" * 300 + "..."


def test_every_white_space_run_becomes_one_space(spark):
    listed = re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), T.WHITESPACE)
    spaces = [chr(c) for c in range(0x3001) if re.fullmatch(f"[{listed}]", chr(c))]
    assert " " in spaces and "\u3000" in spaces and len(spaces) > 20
    runs = ["", *spaces, *[s + " " for s in spaces], *[" " + s for s in spaces], "\n" * 3, " \t \n "]
    texts = [f"{a}x y{a}é​z{a}" for a in runs]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text("t").alias("c")).collect()
    one = re.compile("[" + "".join(spaces) + "]+")
    assert [r.c for r in rows] == [one.sub(" ", r.t).strip(" ") for r in rows]
