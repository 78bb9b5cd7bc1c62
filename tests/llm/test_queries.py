"""Registered queries beside their SQL, and the cases every operator must bear."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import lm_model as M
from pagelode.llm.decontaminate import decontaminate, item_words
from pagelode.llm.html_extract import extract_text, main_text
from pagelode.llm.oracle import ORACLES
from pagelode.llm.quality_model import score_quality
from pagelode.llm.quality_rules import quality_rules
from pagelode.llm.queries import QUERIES
from pagelode.llm import toxicity
from pagelode.llm.toxicity import Trie, score_toxicity
from pagelode.llm.url_filters import filter_urls, validity_intervals

from ..check_oracle import compare, connect


@pytest.fixture(scope="module")
def db(tiny_dir):
    return connect(tiny_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tiny_dir, db, name):
    if name in QUERIES:
        got = QUERIES[name](spark, tiny_dir).toPandas()
        assert compare(got, db.execute(ORACLES[name]).df()) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- quality rules ---------------------------------------------------------------------


def test_quality_rules_on_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a " * 5000), (4, "Home | About | News | Contact\nA fine line of ten words or more stands here today."), (4, "x")]
    docs = spark.createDataFrame([(i, t, "q", "c") for i, t in rows], "doc_id int, text string, quality string, _w string")
    got = quality_rules(docs)
    assert got.columns == ["doc_id", "text", "_w", "quality"]
    by = {(r.doc_id, r.text): r.quality for r in got.collect()}
    assert by[1, None].n_words == 0 and by[1, None].base_failed and by[1, None].cleaned == ""
    assert by[3, "a " * 5000].n_repeat_words == 5000
    assert by[4, rows[3][1]].cleaned == "A fine line of ten words or more stands here today."
    assert quality_rules(docs.limit(0)).count() == 0
    plan = got.filter("quality.kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- decontamination -------------------------------------------------------------------


@pytest.mark.parametrize("block", [40, 10_000])
def test_windows_equal_plain_search(spark, block):
    word = lambda i: f"w{i % 7}"
    items = [(1, " ".join(word(i * i) for i in range(30))), (2, "w1 w2"), (2, "Ä-b"), (None, "w3 w3 w3"), (5, None), (6, "!")]
    docs = [(i, " ".join(word(i * k + k * k) for k in range(60)) + (" ä b" if i % 2 else "")) for i in range(20)]
    docs += [(20, None), (21, ""), (22, items[0][1].upper()), (22, items[0][1].upper())]
    a = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id int, text string, item_id string")
    b = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate(a, b, block_bytes=block)
    windows = {}
    for i, t in items:
        w = item_words((t or "").encode())
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add("" if i is None else str(i))
    assert got.count() == len(docs)
    for r in got.collect():
        w = item_words((r.text or "").encode())
        hit, found = set(), set()
        for span, names in windows.items():
            for s in range(len(w) - len(span) + 1):
                if tuple(w[s : s + len(span)]) == span:
                    hit |= set(range(s, s + len(span)))
                    found |= names
        c = r.contamination
        assert (c.n_words, c.n_hit, c.items) == (len(w), len(hit), sorted(found))
        assert c.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate(a, b.limit(0)).filter("contamination.contaminated").count() == 0
    assert decontaminate(a.limit(0), b).count() == 0


# --- pages -----------------------------------------------------------------------------


def test_main_text():
    page = """<html><head><title>T</title></head><body><nav><p>Menu here.</p></nav><header><h1>Site</h1></header>
    <article><h1>Head &amp; more</h1><p>Some <b>bold</b>
      text, long enough.<p>Second<br>line.<script>x("</p>")</script><ul><li>one</li><li>two</li></ul>
    <div class="comments"><p>I disagree.</p></div></article><aside>Other</aside><footer>&copy; x</footer></body>"""
    assert main_text(page) == "Head & more\n\nSome bold text, long enough.\n\nSecond line.\n\none\n\ntwo"


STORY = "A long story, told in full. " * 20


@pytest.mark.parametrize("page", [
    f'<body class="no-sidebar"><p>{STORY}</p></body>', f'<article class="post has-comments"><p>{STORY}</p></article>',
    f'<main id="search-history"><p>{STORY}</p></main>', f'<div class="share-price-report"><p>{STORY}</p></div>',
    f'<div class="story"><p>{STORY}</p></div><article><p>Teaser, short.</p></article>',
    f'<div><p>{STORY}</p></div><div class="left-sidebar"><p>{"Words beside it. " * 20}</p></div>',
])
def test_stories_stay_whole(page):
    assert main_text(page) == STORY.strip()


@pytest.mark.parametrize("between", ["", "<p>By A. B.</p>"])
def test_headline_before_the_article(between):
    got = main_text(f"<body><h1>The headline</h1>{between}<article><p>{STORY}</p></article></body>")
    assert got.startswith("The headline\n\n") and got.endswith(STORY.strip())


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- x", "<div>" * 5000 + "x", "<p>a" * 5000, '<a "' * 5000, "&#0;&#99999999;"])
def test_odd_pages(page):
    assert isinstance(main_text(page), str)


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, None, "t"), (2, "<p>a</p>", "t"), (2, "<p>a</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string")
    got = extract_text(pages)
    assert sorted(map(tuple, got.collect())) == [(1, ""), (2, "a"), (2, "a")]
    assert extract_text(pages.limit(0)).count() == 0


# --- lists -----------------------------------------------------------------------------

ENTRY = "list string, kind string, pattern string, time timestamp_ntz, action string, seq long"


def test_lists_as_of_the_fetch(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    raw = [
        ("block", "domain", "x.org", 2, "add", 1), ("block", "domain", "x.org", 4, "remove", 2),
        ("allow", "host", "a.x.org", 3, "add", 3), ("block", "prefix", "a.x.org/p", 1, "add", 4),
        ("block", "prefix", "a.x.org/p", 1, "remove", 5), ("block", "host", None, 1, "add", 6), ("block", "other", "x.org", 1, "add", 7),
    ]
    entries = spark.createDataFrame([(a, b, c, day(d), e, f) for a, b, c, d, e, f in raw], ENTRY.replace("timestamp_ntz", "string"))
    entries = entries.withColumn("time", F.col("time").cast("timestamp_ntz"))
    assert validity_intervals(entries).count() == 2
    asked = [(1, "http://b.x.org/", 1), (2, "http://b.x.org/", 2), (3, "http://b.x.org/", 4), (4, "http://A.x.org/p/q", 3), (5, "http://A.x.org/p", 2), (6, None, 2), (7, "no url", 2), (7, "no url", 2)]
    captures = spark.createDataFrame([(i, u, day(d), "k") for i, u, d in asked], "page_id int, url string, fetch_time string, list string")
    captures = captures.withColumn("fetch_time", F.col("fetch_time").cast("timestamp_ntz"))
    got = filter_urls(captures, entries)
    kept = sorted((r.page_id, r.url_filter.kept) for r in got.collect())
    assert kept == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, True), (7, True)]
    assert filter_urls(captures, entries.limit(0)).filter("url_filter.kept").count() == len(asked)


# --- models ----------------------------------------------------------------------------


def test_trie_finds_one_wrong_letter():
    trie = Trie({"stupid": 3.0, "abc": 1.0}, 5)
    one = ["stupd", "stuppid", "stupic", "xstupid", "tupid", "stupi"]
    assert all(trie.fuzzy(w) == 3.0 for w in one)
    assert not any(trie.fuzzy(w) for w in ["stpd", "abd", "", "stu", "stupendous"])
    assert trie.exact("stupidly") == (3.0, 6)


def test_short_terms_and_stems_are_found_misspelled(spark):
    trie = Trie({"stupid": 3.0, "scum": 2.5}, toxicity.ToxicityRules().fuzzy_length, {"scam": 0.0})
    assert all(trie.misspelled(w) == 3.0 for w in ["stuppidly", "stupd", "stupdness"])
    assert all(trie.misspelled(w) == 2.5 for w in ["scvm", "skum", "skumbag"])
    assert trie.misspelled("scams") == trie.misspelled("table") == 0.0
    texts = [(f"you scum n{i}", 1) for i in range(20)] + [(f"a scam of m{i}", 0) for i in range(20)] + [("skum", 1)]
    rows = spark.createDataFrame(texts, "_text string, toxic int")
    learned = toxicity._misspelled(rows, {"scum": 3.5}, {0: 20, 1: 21}, toxicity.ToxicityRules())
    assert learned["scam"] == 0.0 and learned["skum"] >= 2.0


def test_beginnings_use_up_no_places(spark):
    words = ["abominable", "detestable", "miserable"]
    texts = [(f"{' '.join(words)} n{i}", 1) for i in range(20)] + [(f"fine m{i}", 0) for i in range(60)]
    rows = spark.createDataFrame(texts, "_text string, toxic int")
    found = toxicity._lexicon(rows, {0: 60, 1: 20}, toxicity.ToxicityRules(lexicon=3))
    assert sorted(found) == words


def test_toxicity_learns_and_bears_odd_rows(spark):
    toxic = [(i, f"you are a vile{'xyz'[i % 3]} person number n{i} of m{i * 7}", 1) for i in range(30)]
    clean = [(100 + i, f"you are a good person number n{i} of m{i * 5}", 0) for i in range(90)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in toxic + clean] + [(None, None, 0.5), (500, "", 0.5), (501, "a viley one", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic + clean], "doc_id long, toxic int")
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = {r.doc_id: r for r in score_toxicity(docs, labels, held).collect()}
    assert all(got[i].predicted == y for i, _, y in toxic + clean)
    assert got[501].predicted == 1 and got[500].predicted == got[None].predicted == 0
    none = score_toxicity(docs, labels.limit(0), held).collect()
    assert len(none) == len(got) and all(r.predicted == 0 for r in none)


def test_only_equal_texts_are_one_training_row(spark):
    shared = "a passage that many texts share word for word and that is half of each of them"
    texts = [f"{shared} {' '.join(f'w{i}x{k}' for k in range(16))}" for i in range(60)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[:7])], "_id long, _text string, toxic int")
    assert toxicity._different(rows).count() == 60


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, d)
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_quality_shrinks_sparse_sites(spark):
    good, bad = "a normal text of several different words here", "x x x x x x x x x x"
    rows = [(i, bad if i % 10 < 8 else good, "big", "p") for i in range(200)] + [(300 + i, good, "fine", "p") for i in range(200)]
    rows += [(900, good, "tiny", None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(t == good)) for i, t, *_ in rows[:400]], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(docs, labels, F.lit(False)).collect()}
    assert got[8].kept and not got[0].kept
    assert got[8].host_posterior < got[900].host_posterior < got[300].host_posterior
    assert None in got and score_quality(docs.limit(0), labels, F.lit(False)).count() == 0


def test_gradient_equals_differences():
    r = np.random.default_rng(3)
    w = M.start_weights(np.log(np.full(M.CLASSES, 1 / M.CLASSES)))
    w["near"] += r.normal(size=w["near"].shape).astype(np.float32) * 0.1
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x = M.windows(r.integers(1, M.CLASSES, size=50))
    real = x[:, M.CONTEXT :] != M.PAD
    loss = lambda: -(M.log_probs(w, x) * real).sum() / real.sum()
    g = M.gradient(w, x)
    for name in w:
        flat, own = w[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in np.argsort(-np.abs(own))[:3]:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - own[k]) < 1e-4, name


def test_windows_score_each_token_once_and_look_back_only():
    r = np.random.default_rng(4)
    w = M.start_weights(np.log(np.full(M.CLASSES, 1 / M.CLASSES)))
    for n in (1, 16, 17, 100):
        c = r.integers(1, M.CLASSES, size=n)
        x = M.windows(c)
        assert x[:, M.CONTEXT :].ravel()[:n].tolist() == c.tolist()
        assert not x[:, M.CONTEXT :].ravel()[n:].any()
        other = c.copy()
        other[-1] = 1 + c[-1] % (M.CLASSES - 1)
        a, b = (M.log_probs(w, M.windows(z)).ravel()[: n - 1] for z in (c, other))
        assert np.allclose(a, b, atol=1e-5)


def test_trie_equals_edit_distance():
    import random

    def within_one(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= 1

    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(3, 8)))
    terms = {word(): float(k + 1) for k in range(60)}
    trie = Trie(terms, 5)
    for _ in range(3000):
        w = word()
        wanted = max([x for t, x in terms.items() if len(t) >= 5 and within_one(w, t)], default=0.0)
        assert trie.fuzzy(w) == wanted, w
