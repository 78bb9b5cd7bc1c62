"""Every stage of the pipeline against plain Python on its own input."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagelode.llm.decontaminate import item_words
from pagelode.session import stage

from .brute import components, pii_base

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def steps(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], tiny_dir), "stage"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert len(steps) == 6 and "ids" in steps[-1].columns


def test_quality_keeps_clean_documents_as_they_are(steps):
    before, after = rows(steps[0]), rows(steps[1])
    plain = [i for i, r in before.items() if len(r.text.split()) >= 10 and not set(r.text) & set("*#$%&|!")]
    repeats = lambda t: any(a == b for a, b in zip(t.split(), t.split()[1:]))
    plain = [i for i in plain if not repeats(before[i].text) and "rights reserved" not in before[i].text]
    assert plain and all(after[i].text == before[i].text for i in plain if i in after)
    assert sum(i in after for i in plain) >= 0.95 * len(plain)
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_document_of_each_group(steps):
    texts = {i: r.text for i, r in rows(steps[1]).items()}
    assert sorted(rows(steps[2])) == sorted(set(components(texts).values()))


def test_contaminated_documents_go(spark, tiny_dir, steps):
    windows = set()
    for item in spark.read.parquet(f"{tiny_dir}/benchmark.parquet").collect():
        w = item_words(item.text.encode())
        windows |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12)) if w}
    wanted = []
    for i, r in rows(steps[2]).items():
        w, hit = item_words(r.text.encode()), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(w)):
            wanted.append(i)
    assert sorted(rows(steps[3])) == sorted(wanted)


def test_personal_data_is_replaced(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in before.items():
        assert not pii_base(after[i].text)
        if not pii_base(r.text):
            assert after[i].text == r.text


def test_ids_of_the_last_stage(steps):
    library = Tokenizer.from_file(PATH)
    before, after = rows(steps[4]), rows(steps[5])
    assert set(before) == set(after)
    for i, r in before.items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert after[i].ids == ids and after[i].n_tokens == len(ids)
        assert after[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_on_an_empty_table(spark, tiny_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tiny_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
