"""Registered queries of this subpackage; each takes (spark, folder of the tables)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe
from .byte_bpe import byte_bpe_round_trip
from .decontaminate import decontaminate
from .html_extract import extract_text
from .lm_score import read_ranks, score_texts
from .ngram_join import ngram_components
from .phrases import mine_phrases
from .pii import KINDS, find_pii
from .quality_rules import quality_rules
from .quality_model import score_quality
from .toxicity import score_toxicity
from .url_filters import filter_urls, host_of
from .whitening import fit_whitening, whiten
from .common import fold, sha256, table, text_or_empty

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def bpe_digests(encoded, *more):
    """Digest columns of encoded documents, and ``more`` of theirs."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
        *more,
    )


@query
def op3_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", text_or_empty().alias("text"))
    coded = bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe_digests(coded)


@query
def op6_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules(docs).select(
        "doc_id",
        *[F.col(f"quality.{f}") for f in [*fields, "base_failed", "kept", "n_kept_words"]],
        sha256("quality.cleaned").alias("cleaned_sha256"),
    )


@query
def op10_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = decontaminate(docs.select("doc_id", "text"), table(spark, folder, "benchmark"))
    found = F.col("contamination")
    return judged.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        sha256(F.array_join(found["items"], ",")).alias("items_sha256"),
        found["contaminated"].alias("contaminated"),
    )


@query
def op9_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("pii", lambda x: x["kind"] != "term")
    kinds = F.transform("pii", lambda x: x["kind"])
    others = lambda k: F.size(F.array_remove(kinds, k))
    counts = [(F.size(kinds) - others(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_pii(docs).select(
        "doc_id",
        *counts,
        sha256(F.array_join(F.transform(base, named), ",")).alias("base_sha256"),
        F.array_join(F.transform("pii", named), ",").alias("spans"),
    )


@query
def op5_ngram_join(spark, folder):
    return ngram_components(table(spark, folder, "documents"))


@query
def op8_html_extract(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = extract_text(pages)
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    scored = score_toxicity(docs, table(spark, folder, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def dated_lists(spark, folder):
    """List entries that events hand out: each names the page of its user's number."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    host, part = host_of("url"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^/?#]+)", 1)
    kind = F.col("event_id") % 3
    named = events.join(pages, F.col("user_id") == F.col("page_id"))
    return named.select(
        F.when(F.col("event_id") % 5 == 0, "allow").otherwise("block").alias("list"),
        F.when(kind == 0, "domain").when(kind == 1, "host").otherwise("prefix").alias("kind"),
        F.when(kind == 0, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
        .when(kind == 1, host)
        .otherwise(F.concat(host, part))
        .alias("pattern"),
        F.col("ts").alias("time"),
        F.when(F.col("event_type").isin("view", "error"), "remove").otherwise("add").alias("action"),
        F.col("event_id").alias("seq"),
    )


@query
def op1_url_filters(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    seconds = F.lit(1704067200) + F.col("page_id") * 7919 % 2592000
    captures = pages.withColumn("fetch_time", F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    found = filter_urls(captures, dated_lists(spark, folder))
    fields = ["kept", "list", "kind", "pattern", "since"]
    return found.select("page_id", "url", *[f"url_filter.{f}" for f in fields])


@query
def op7_quality_model(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    held_out = fold("doc_id", 4) == 2
    scored = score_quality(docs, table(spark, folder, "labels"), held_out)
    return scored.withColumn("held_out", held_out)


@query
def op2_lm_score(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    held_out = fold("doc_id", 5) == 1
    scored = score_texts(docs, held_out, read_ranks(path, public_tokenizers.PATTERN))
    return scored.withColumn("held_out", held_out)


@query
def op11_whitening(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = whiten(vectors, fit_whitening(vectors))
    whole = ["n", "deviation", "identity_error"]
    return found.select(
        "vec_id",
        *[F.col(f"whitening.{f}") for f in whole],
        F.inline("whitening.components"),
    )


@query
def op12_byte_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe_round_trip(docs, path, public_tokenizers.PATTERN, packed=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        sha256("ids").alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
    )


@query
def op13_phrases(spark, folder):
    return mine_phrases(table(spark, folder, "documents").select("lang", "text"))
