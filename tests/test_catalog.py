"""Every registered query beside its SQL on the smallest tables."""

import importlib
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from pagelode.plans.catalog import QUERIES
from pagelode.plans.oracle import ORACLES

from .check_oracle import compare, connect



@pytest.fixture(scope="module")
def db(tiny_dir):
    return connect(tiny_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tiny_dir, db, name):
    got = QUERIES[name](spark, tiny_dir).toPandas()
    wanted = db.execute(ORACLES[name]).df()
    assert compare(got, wanted) == ""
    assert len(got) > 0


def test_stems_in_sql_equal_stemmed_words(db):
    from pagelode.functions.stem import stem_word
    from pagelode.plans.oracle import _porter

    words = (
        "caresses ponies ties cats feed agreed plastered bled motoring sing conflated sized "
        "hopping tanned falling hissing fizzed failing filing happy sky relational rational "
        "yyes syzygy toy by hoping flying dying eying wooed ed ing ss is yed boxed rolled "
        "controll probate rate cease adoption generalizations été naïveté x2ed"
    ).split()
    values = ", ".join(f"('{w}')" for w in words)
    sql = f"WITH asked(term) AS (VALUES {values}), {_porter('asked')} SELECT word, stem FROM stems"
    assert dict(db.execute(sql).fetchall()) == {w: stem_word(w) for w in words}


def test_entry_works_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    for names in ([], ["corpus_pipeline.py"]):
        for name in names:
            (copy / name).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
        assert done.stdout.split() == ["True", str(len(QUERIES))], done.stderr


def test_entry_registers_all(spark):
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_runs(spark):
    assert importlib.reload(entry_point).entry(spark).columns


def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path):
    rows = [(n, f"https://h{n}.example/", f"<title>T{n}</title><p>Text {n}</p>") for n in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found = QUERIES["stream_ingest"](spark, str(tmp_path))
    assert sorted(r["url"] for r in found.collect()) == sorted(url for _, url, _ in rows)


@pytest.mark.parametrize("name", ["term_frequency", "tf_idf"])
def test_terms_are_counted_in_whole_texts(spark, tmp_path, name):
    """A word that stands past a snippet's end counts, in the text and in the corpus."""
    filler = "dull " * 99
    texts = [f"red {filler}Fox fox", f"red {filler}end", "blue", "red fox", "red sky"]
    docs = [(n, t, "en", "web", len(t)) for n, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    asked = spark.createDataFrame([(7, "red Fox")], "item_id long, text string")
    asked.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {(r.url[-1], r.term): r[3] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    red, fox = (math.log(4 / (df + 1)) if name == "tf_idf" else 1 for df in (4, 2))
    tf = {"0": (1 / 102, 2 / 102), "1": (1 / 101, 0), "3": (1 / 2, 1 / 2), "4": (1 / 2, 0)}
    wanted = {(d, t): x for d, (a, b) in tf.items() for t, x in (("red", a * red), ("fox", b * fox))}
    assert found == pytest.approx(wanted, abs=1e-6)
    tables = duckdb.connect()
    for table in ("documents", "benchmark"):
        tables.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    sql = tables.execute(ORACLES[name]).df()
    assert compare(QUERIES[name](spark, str(tmp_path)).toPandas(), sql) == ""
