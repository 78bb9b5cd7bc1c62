"""Postings, matching and scoring on a small corpus, brute force beside it."""

import math

import pytest

from pyspark.sql import functions as F

from pagelode.functions.shards import add_shard
from pagelode.operators import analyze, joins
from pagelode.operators.analyze import (
    Analyzer, build_postings, bundle_postings, pack_postings, term_stats, tokenize, unbundle_postings, unpack_postings,
)
from pagelode.operators.match import (
    analyze_queries,
    match_all,
    match_any,
    match_by_document,
    match_exclude,
    match_field,
    match_multi,
    match_phrase,
    match_prefix,
    match_terms,
    phrase_terms,
)
from pagelode.operators.score import bm25, hit_store, project_hits, scored_matches, top_k
from pagelode.operators.suggest import popular_terms, suggest
from pagelode.plans.index import build_index, read_index, write_index
from pagelode.plans.search import search

PLAIN = Analyzer().unstemmed()
SCHEMA = (
    "url string, title string, content string, meta_description string, headings string, "
    "content_length int, crawl_time timestamp, depth int"
)
TITLES = [
    ("d1", "red fox", "the quick red fox, red fox again", "about a fox", ""),
    ("d2", "Foxes running", "runners ran with the foxes", "", "red heading"),
    ("d3", "blue car", "a blue car is not red; fox red", "cars", ""),
    ("d4", "", "", "", ""),
    ("d5", "redder reddest", "quick " * 30 + "fox red fox", "quick", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, len(t[2]), None, i) for i, t in enumerate(TITLES)]
    return spark.createDataFrame(rows, SCHEMA)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def pairs(df):
    return {(r.query_id, r.url) for r in df.collect()}


def test_postings_hold_positions(docs):
    rows = build_postings(docs, PLAIN).filter("url = 'd1' AND field = 'content'").collect()
    got = {r.term: (r.tf, r.field_len, r.positions) for r in rows}
    # "the" is a stop word; positions count the words that stay
    assert got == {
        "quick": (1, 6, [0]),
        "red": (2, 6, [1, 3]),
        "fox": (2, 6, [2, 4]),
        "again": (1, 6, [5]),
    }


def test_postings_of_empty_fields_are_absent(docs):
    assert build_postings(docs, PLAIN).filter("url = 'd4'").count() == 0


def test_postings_equal_grouped_tokens(docs):
    grouped = (
        tokenize(docs)
        .groupBy("field", "term", "url")
        .agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("p"))
    )
    built = build_postings(docs).select("field", "term", "url", "tf", "positions")
    assert built.exceptAll(grouped).count() == grouped.exceptAll(built).count() == 0


def test_postings_are_built_without_a_shuffle(docs):
    plan = build_postings(docs, PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_packed_postings_are_the_postings(spark, docs, shards):
    odd = spark.createDataFrame([("e1", "red fox", "again red", None, "x"), (None, "red", None, "", "a1 a2 a1")], "url string, title string, content string, meta_description string, headings string")
    both = docs.select(odd.columns).unionByName(odd)
    packed = pack_postings(both, PLAIN, shards)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert packed.groupBy("url", "field", "field_len", f"shard_{shards}").count().filter("count > 1").count() == 0
    got, wanted = unpack_postings(packed), add_shard(build_postings(both, PLAIN), "term", shards)
    assert got.columns == wanted.columns
    assert got.exceptAll(wanted).count() == wanted.exceptAll(got).count() == 0


@pytest.mark.parametrize("held, sent", [(1, 1), (7, 2), (1 << 20, 1 << 16)])
def test_unpacked_postings_come_in_sorted_runs(docs, monkeypatch, held, sent):
    """Whatever number of terms is held at once; texts without a term give none."""
    monkeypatch.setattr(analyze, "HELD_TERMS", held)
    monkeypatch.setattr(analyze, "SENT_ROWS", sent)
    odd = docs.withColumn("content", F.lit("été été \U0001f600x ﬀa z9 été a.b")).unionByName(docs.limit(2))
    both = docs.unionByName(odd).unionByName(docs.filter("url = 'd4'")).coalesce(1)
    got = unpack_postings(pack_postings(both, PLAIN, 5))
    wanted = add_shard(build_postings(both, PLAIN), "term", 5)
    assert got.exceptAll(wanted).count() == wanted.exceptAll(got).count() == 0
    keys = [(r.field, r.shard_5, r.term.encode()) for r in got.collect()]
    falls = sum(a > b for a, b in zip(keys, keys[1:]))
    assert falls == 0 if held > 100 else falls > 0
    assert unpack_postings(pack_postings(docs.filter("url = 'd4'"), PLAIN, 5)).count() == 0


@pytest.mark.parametrize("held, shards, parts", [(7, 5, 2), (1 << 20, 3, 7), (1 << 20, 16, 1)])
def test_bundled_postings_are_the_postings(spark, docs, monkeypatch, held, shards, parts):
    monkeypatch.setattr(analyze, "HELD_TERMS", held)
    odd = spark.createDataFrame([("e1", "red fox", "été red " + "z9 " * 300, None, "x"), (None, "red", None, "", "a1 a2 a1")], "url string, title string, content string, meta_description string, headings string")
    both = docs.select(odd.columns).unionByName(odd).unionByName(odd)
    bundles = bundle_postings(both, PLAIN, shards, parts)
    got, wanted = unbundle_postings(bundles, shards), add_shard(build_postings(both, PLAIN), "term", shards)
    assert got.columns == wanted.columns
    assert got.exceptAll(wanted).count() == wanted.exceptAll(got).count() == 0
    # a shard's rows are in its own parts, or in that of its neighbours
    where = got.select(f"shard_{shards}", F.spark_partition_id()).distinct().collect()
    n = bundles.rdd.getNumPartitions()
    assert n >= parts
    assert all(p * shards // n == shard if n > shards else p == shard // -(-shards // n) for shard, p in where)
    none = bundle_postings(both.filter("url = 'd4'"), PLAIN, shards, parts)
    assert unbundle_postings(none, shards).count() == 0


def test_bundles_are_small(spark):
    """What the build shuffles takes less than the terms alone."""
    rows = [(f"https://web.example.com/en/{i}", " ".join(f"word{i * j % 997}" for j in range(1, 200))) for i in range(400)]
    texts = spark.createDataFrame(rows, "url string, content string").coalesce(1)
    terms = pack_postings(texts, PLAIN, 16, ["content"]).select(F.explode("terms").alias("t"))
    sent = bundle_postings(texts, PLAIN, 16, 1, ["content"]).agg(F.sum(F.octet_length("data"))).first()[0]
    assert sent < terms.agg(F.sum(F.octet_length("t"))).first()[0] / 2


def test_stems_only_in_stemmed_fields(docs):
    terms = {(r.field, r.term) for r in build_postings(docs).filter("url = 'd2'").collect()}
    assert ("title", "fox") in terms and ("title", "run") in terms
    assert ("headings", "heading") in terms


@pytest.fixture(scope="module")
def postings(docs):
    return build_postings(docs, PLAIN)


def test_boolean_matching(spark, postings):
    terms = analyze_queries(ask(spark, "red fox", "blue", "the", "fox: zebra"), PLAIN)
    found = match_multi(postings, terms)
    assert pairs(match_all(found, terms)) == {(0, "d1"), (0, "d3"), (0, "d5"), (1, "d3")}
    assert pairs(match_any(found)) == {
        (0, "d1"), (0, "d2"), (0, "d3"), (0, "d5"), (1, "d3"), (3, "d1"), (3, "d3"), (3, "d5"),
    }
    minus = match_any(match_terms(postings, analyze_queries(ask(spark, "car"), PLAIN)))
    assert pairs(match_exclude(match_all(found, terms), minus)) == {
        (0, "d1"), (0, "d5"), (1, "d3"),
    }


def test_long_queries_need_more_than_one_mask_word(spark):
    words = [f"w{i:03}" for i in range(150)]
    rows = [("all", " ".join(words)), ("most", " ".join(words[:-1]))]
    schema = "url string, title string"
    docs = spark.createDataFrame(rows, schema)
    index = build_postings(docs, PLAIN, ["title"])
    terms = analyze_queries(ask(spark, " ".join(words)), PLAIN, ["title"])
    assert pairs(match_all(match_multi(index, terms, ["title"]), terms)) == {(0, "all")}


def test_single_field(spark, postings):
    terms = analyze_queries(ask(spark, "red"), PLAIN)
    assert pairs(match_field(postings, terms, "title")) == {(0, "d1")}
    assert pairs(match_field(postings, terms, "headings")) == {(0, "d2")}


def test_phrases(spark, postings):
    phrases = phrase_terms(ask(spark, '"red fox"', '"fox red"', "quick quick", "red fox red"), PLAIN)
    rows = match_phrase(postings, phrases, term_stats(postings)).filter("field = 'content'").collect()
    got = sorted((r.query_id, r.url, r.start) for r in rows)
    assert [g for g in got if g[0] != 2] == [
        (0, "d1", 1), (0, "d1", 3), (0, "d3", 2), (0, "d5", 31),
        (1, "d1", 2), (1, "d3", 3), (1, "d5", 30), (3, "d1", 1), (3, "d3", 2),
    ]
    assert sum(g[0] == 2 for g in got) == 29


def test_prefixes(spark, postings):
    wanted = spark.createDataFrame(
        [(0, "re"), (1, "redd"), (2, ""), (3, "zz"), (4, "f")], "query_id long, prefix string"
    )
    assert pairs(match_prefix(postings, wanted, "title", term_stats(postings))) == {
        (0, "d1"), (0, "d5"), (1, "d5"), (4, "d1"), (4, "d2"),
    }


def test_prefixes_beside_shorter_ones(spark, postings):
    """The range of all prefixes ends behind what the shortest of them covers."""
    wanted = spark.createDataFrame(
        [(0, "re"), (1, "red fox"), (2, "quz")], "query_id long, prefix string"
    )
    found = match_prefix(postings, wanted, "title", term_stats(postings))
    assert pairs(found) == {(0, "d1"), (0, "d5")}


def clause_rows(spark, *rows):
    return spark.createDataFrame(
        list(rows), "query_id long, clause_no int, occur string, kind string, text string"
    )


def brute_clauses(docs, clauses, analyzer=PLAIN):
    """Clause by clause over plain token lists."""
    tokens = {}
    for r in tokenize(docs, analyzer).collect():
        tokens.setdefault((r.field, r.url), {})[r.pos] = r.term
    texts = {k: [v[i] for i in sorted(v)] for k, v in tokens.items()}
    fields = {f for f, _ in texts}
    urls = [r.url for r in docs.select("url").collect()]
    out = {}
    for query in {c[0] for c in clauses}:
        for url in urls:
            score, needed, met, bad, hit = 0.0, 0, 0, False, False
            for _, _, occur, kind, text in (c for c in clauses if c[0] == query):
                words = text.lower().split()
                groups = [[w] for w in words] if kind == "term" else [words] if words else []
                for unit in groups:
                    found, add = False, 0.0
                    for f in fields:
                        t = texts.get((f, url), [])
                        if kind == "prefix":
                            here = any(w.startswith(unit[-1]) for w in t)
                            add = 1.0 if here or found else 0.0
                        else:
                            n = len(unit)
                            here = any(t[i : i + n] == unit for i in range(len(t) - n + 1))
                            if here:
                                lens = [len(texts.get((f, u), [])) for u in urls]
                                for w in unit:
                                    df = sum(w in texts.get((f, u), []) for u in urls)
                                    tf = t.count(w)
                                    norm = 0.25 + 0.75 * len(t) / (sum(lens) / len(urls))
                                    add += (math.log(len(urls) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * norm)
                        found |= here
                    needed += occur == "must"
                    met += occur == "must" and found
                    bad |= occur == "must_not" and found
                    hit |= occur != "must_not" and found
                    score += add if occur != "must_not" else 0.0
            if hit and met == needed and not bad:
                out[query, url] = score
    return out


def test_scored_matches_equal_plain_clauses(spark, docs, postings):
    rows = [
        (0, 0, "must", "term", "red"), (0, 1, "should", "phrase", "fox red"),
        (1, 0, "must", "phrase", "red fox"), (1, 1, "must_not", "term", "again"),
        (2, 0, "should", "prefix", "redd"), (2, 1, "should", "prefix", "fox"),
        (3, 0, "must", "prefix", "re"), (3, 1, "must", "term", "fox car"), (3, 2, "should", "term", "zzz"),
        (4, 0, "must_not", "term", "red"),
        (5, 0, "must", "term", ""), (5, 1, "should", "term", "quick"), (5, 2, "must_not", "phrase", "fox running"),
        (6, 0, "must", "phrase", "quick quick quick"), (6, 1, "must_not", "prefix", "zz"),
        *[(7, i, "should", "term", w) for i, w in enumerate(["red"] * 70 + ["fox"])],
    ]
    index = build_index(docs, PLAIN)
    found = scored_matches(
        index.postings, clause_rows(spark, *rows), index.term_stats, index.field_stats, PLAIN
    )
    got = {(r.query_id, r.url): r.score for r in found.collect()}
    wanted = brute_clauses(docs, rows)
    assert got.keys() == wanted.keys() and len(got) > 8
    for key, score in wanted.items():
        assert got[key] == pytest.approx(score, abs=2e-6), key


def brute_bm25(word, k1=1.2, b=0.75):
    """Score per document of one word over the content field only."""
    texts = {u: c for u, _, c, _, _ in TITLES}
    words = {
        u: [w for w in "".join(c if c.isalnum() else " " for c in t).lower().split()
            if w not in PLAIN.stop_words and len(w) > 1]
        for u, t in texts.items()
    }
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = sum(word in ws for ws in words.values())
    idf = math.log(n / (df + 1)) + 1
    return {
        u: idf * ws.count(word) * (k1 + 1)
        / (ws.count(word) + k1 * (1 - b + b * len(ws) / mean))
        for u, ws in words.items() if word in ws
    }


def test_bm25(spark, docs):
    index = build_index(docs, PLAIN)
    terms = analyze_queries(ask(spark, "fox"), PLAIN, ["content"])
    rows = bm25(index.postings, terms, index.term_stats, index.field_stats).collect()
    expected = brute_bm25("fox")
    assert {r.url: r.score for r in rows} == pytest.approx(expected, abs=1e-6)
    weighted = bm25(
        index.postings, terms, index.term_stats, index.field_stats, field_weights={"content": 2}
    )
    assert {r.url: r.score for r in weighted.collect()} == pytest.approx(
        {u: 2 * s for u, s in expected.items()}, abs=1e-6
    )


def test_top_k_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.floor(F.col("id") / 1000).alias("query_id"),
        F.floor(F.col("id") / 1000).cast("double").alias("score"),
        F.col("id").cast("string").alias("url"),
    )
    best = top_k(rows, 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    assert [(r.url, r["rank"]) for r in best.orderBy("rank").collect()] == [
        ("0", 1), ("1", 2), ("10", 3),
    ]


def test_suggestions(spark, docs, postings):
    wanted = spark.createDataFrame(
        [(0, "Re"), (1, "fox"), (2, "red fox"), (3, "c")], "query_id long, prefix string"
    )
    rows = suggest(docs, postings, term_stats(postings), wanted).collect()
    assert sorted((r.query_id, r["rank"], r.word) for r in rows) == [
        (0, 1, "red"), (0, 2, "redder"), (0, 3, "reddest"), (1, 1, "foxes"), (3, 1, "car"),
    ]


def test_popular_terms(docs):
    rows = popular_terms(build_index(docs, PLAIN).term_stats, 3).collect()
    assert [(r.term, r.df) for r in rows] == [("blue", 1), ("foxes", 1), ("redder", 1)]


def test_stored_index_answers_like_the_lazy_one(spark, docs, tmp_path):
    lazy = build_index(docs)
    write_index(docs, str(tmp_path / "index"), shards=4)
    stored = read_index(spark, str(tmp_path / "index"))
    queries = ask(spark, "red foxes", "running", "quick fox", "zebra", "  ")
    for ranking in (True, False):
        answers = [
            {
                (r.query_id, r["rank"]): r.asDict()
                for r in search(index, queries, 1e9, limit=2, enable_ranking=ranking).collect()
            }
            for index in (lazy, stored)
        ]
        assert answers[0] == answers[1]
        assert (1, 1) in answers[0] and not any(q > 2 for q, _ in answers[0])


def test_stored_index_prunes_directories(spark, docs, tmp_path):
    index = write_index(docs, str(tmp_path / "index"), PLAIN, shards=4)
    terms = analyze_queries(ask(spark, "fox"), PLAIN, ["content"])
    plan = match_terms(index.postings, terms)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan


def test_results_do_not_depend_on_the_join_strategy(spark, docs, monkeypatch):
    """With nothing small enough to broadcast, salted shuffles give the same rows."""

    def answers():
        index = build_index(docs, PLAIN)
        queries = ask(spark, "red fox", "quick")
        terms = analyze_queries(queries, PLAIN)
        scored = bm25(index.postings, terms, index.term_stats, index.field_stats)
        found = project_hits(hit_store(docs), top_k(scored, 10), queries, 10)
        hits = sorted(tuple(r) for r in found.drop("crawl_time").collect())
        prefixes = spark.createDataFrame([(0, "re")], "query_id long, prefix string")
        ranked = search(index, queries, 1e9).drop("crawl_time").collect()
        return hits, pairs(match_prefix(index.postings, prefixes, "title", index.term_stats)), sorted(map(str, ranked))

    small = answers()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert answers() == small


def test_salting_keeps_anti_and_left_joins_whole(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    big = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, x string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = joins.join_small(big, small, ["k"], how, spread=["v"])
        plain = big.join(small, ["k"], how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_a_failed_build_leaves_the_published_index(spark, tmp_path):
    path = str(tmp_path / "index")
    fields = "title string, content string, meta_description string, headings string, url string"
    docs = lambda *urls: spark.createDataFrame([("t", "fox", "", "", u) for u in urls], fields)
    with pytest.raises(FileNotFoundError):
        read_index(spark, path)
    write_index(docs("a"), path, PLAIN, shards=2)
    broken = docs("b").withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_index(broken, path, PLAIN, shards=2)
    assert [r.url for r in read_index(spark, path).documents.collect()] == ["a"]
    write_index(docs("b", "c"), path, PLAIN, shards=2)
    assert read_index(spark, path).documents.count() == 2


def test_scores_group_where_postings_are_dealt_by_url(spark, docs, tmp_path, monkeypatch):
    """One shuffle of postings, not of (query, url) pairs, in parts that follow the table's size."""
    index = write_index(docs, str(tmp_path / "index"), PLAIN, shards=2)
    terms = analyze_queries(ask(spark, "red fox", "fox", "quick fox"), PLAIN)
    for task_bytes, parts in ((1 << 40, spark.sparkContext.defaultParallelism), (100, None)):
        monkeypatch.setattr(joins, "TASK_BYTES", task_bytes)
        scored = bm25(index.postings, terms, index.term_stats, index.field_stats, require_all=False)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(url" in line]
        assert len(dealt) == 1 and "hashpartitioning(query_id" not in plan
        n = int(dealt[0].split(", ")[1].split(")")[0])
        assert n == parts if parts else n > spark.sparkContext.defaultParallelism
        every = {(q, u) for q in range(3) for u in ("d1", "d3", "d5")}
        assert pairs(scored) == every | {(0, "d2")}


def test_many_terms_of_a_prefix_are_found_without_the_vocabulary(spark, docs, tmp_path, monkeypatch):
    index = write_index(docs, str(tmp_path / "index"), PLAIN, shards=2)
    prefixes = spark.createDataFrame([(0, "re"), (1, "fo"), (2, "redd"), (3, None)], "query_id long, prefix string")
    wanted = pairs(match_prefix(index.postings, prefixes, "title", index.term_stats))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)  # three prefixes fit, their four terms do not
    found = match_prefix(index.postings, prefixes.filter("prefix is not null"), "title", index.term_stats)
    assert pairs(found) == wanted == {(0, "d1"), (0, "d5"), (1, "d1"), (1, "d2"), (2, "d5")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "term_stats" not in plan and "pmod" not in plan


def test_phrases_of_common_words_meet_in_few_documents(spark, docs, tmp_path, monkeypatch):
    index = write_index(docs, str(tmp_path / "index"), PLAIN, shards=2)
    asked = ask(spark, "quick red fox", "red fox red", "quick quick fox", "fox", "fox red fox")
    phrases = phrase_terms(asked, PLAIN, ["content"])

    def places():
        return sorted((r.query_id, r.url, r.start) for r in match_phrase(index.postings, phrases, index.term_stats).collect())

    small = places()
    assert (0, "d1", 0) in small and (4, "d5", 30) in small and (2, "d5", 28) in small
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert places() == small


def test_repeated_urls_match_once(spark, docs, tmp_path):
    index = write_index(docs.unionByName(docs), str(tmp_path / "index"), PLAIN, shards=2)
    terms = analyze_queries(ask(spark, "red fox"), PLAIN, ["title"])
    assert match_by_document(index.postings, terms).count() == match_terms(index.postings, terms).count()
    assert match_any(match_multi(index.postings, terms, ["title"])).count() == 1


def test_no_broadcast_grows_with_the_vocabulary(spark, tmp_path, monkeypatch):
    """What phrases and clauses broadcast is bounded by the queries or by the limits."""
    rows = [(f"u{i}", "red fox", f"red fox w{i} v{i} red fox", "", "", 9, None, 0) for i in range(60)]
    index = write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), PLAIN, shards=2)
    clauses = spark.createDataFrame(
        [(1, 0, "must", "phrase", "red fox"), (1, 1, "should", "prefix", "w1"), (1, 2, "must_not", "term", "w5")],
        "query_id long, clause_no int, occur string, kind string, text string",
    )
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 40)
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    phrases = phrase_terms(ask(spark, "red fox"), PLAIN, ["content"])
    places = match_phrase(index.postings, phrases, index.term_stats)
    assert places.count() == 120
    found = scored_matches(index.postings, clauses, index.term_stats, index.field_stats, PLAIN)
    assert {r.url for r in found.collect()} == {f"u{i}" for i in range(60) if i != 5}
    assert index.term_stats.count() > 120
    assert sent and max(df.count() for df in sent) <= 40
