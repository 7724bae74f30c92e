"""The pipeline against a brute-force version of its deterministic stages, and the driver's contract."""

from __future__ import annotations

import re

import corpus_pipeline
from quillflow.llm import mixing, quality_rules, queries
from tests.llm.test_operators import LOWER, WORD, components, measured, simhash


def brute_force(rows):
    """What quality rules, exact dedup and near-dedup keep of (doc_id, text)."""
    kept = []
    for key, text in rows:
        n, chars, symbols, dup, repeat = measured(text)
        lines = len([x for x in text.split("\n") if WORD.search(x)])
        upper = len(re.findall("[A-Z]", text))
        if not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 5 * chars or 100 * dup > 60 * lines or 100 * upper > 50 * chars or chars > 15 * n or chars < 2 * n):
            kept.append((key, text))
    last: dict = {}
    for key, text in kept:
        last[text.translate(LOWER)] = max(last.get(text.translate(LOWER), key), key)
    kept = [(k, t) for k, t in kept if last[t.translate(LOWER)] == k]
    prints = {k: simhash(t) for k, t in kept}
    keys = sorted(prints)
    groups = components(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (prints[a] ^ prints[b]).bit_count() <= 3])
    return {k: t for k, t in kept if groups[k] == k}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_force([(r.doc_id, r.text or "") for r in docs.collect()])
    found = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, found, sf_dir)
        assert found.columns == docs.columns, name
    found = found.persist()
    assert {r.doc_id: r.text for r in found.collect()} == want
    mixed = mixing.mixed_documents(found.select(*corpus_pipeline.COLUMNS))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    tokens = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()) == tokens
    found.unpersist()


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, block string, size string"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named like the operators' own."""
    good = " ".join(f"plain{k % 70}x{k}" for k in range(90))
    long = " ".join(f"w{k}q{k % 977}" for k in range(60_000))
    texts = [None, "", " \n\t", "short", good, good, good.upper(), good + " tail", long, " ".join(f"other{k}y" for k in range(80))]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "d", 5, "b", "z") for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[9], (None, good, None, None, None, None, None, None, None), (None, texts[9] + " without key here", None, None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None), (4, good, "de", "s9", 1, "", 1, "", "")]


def test_each_stage_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), EXTRA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "bpe" or docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert kept["quality_rules"] == sorted([(False, 4), (False, 4), (False, 4), (False, 5), (False, 7), (False, 8), (False, 9), (False, 9), (True, 0), (True, 0)])
    # of equal texts the largest key, and one row of it; the text without key is a class of its own
    assert kept["exact_dedup"] == [(False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]
    near = {r.doc_id: simhash(r.text) for r in spark.read.parquet(f"{tmp_path}/exact_dedup").collect()}
    keys = sorted(k for k in near if k is not None)
    groups = components([*keys, 10**9], [(a, b) for a in [*keys, 10**9] for b in keys if b < a and (near[a if a < 10**9 else None] ^ near[b]).bit_count() <= 3])
    assert [k for none, k in kept["simhash_near_dedup"] if not none] == [k for k in keys if groups[k] == k]
    assert {k for none, k in kept["bpe"]} <= {k for _, k in kept["simhash_near_dedup"]}


def test_each_stage_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], EXTRA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_bpe_stage_visits_one_worker(spark, tmp_path):
    found = corpus_pipeline.bpe_stage(spark, spark.createDataFrame(odd_rows(), EXTRA), str(tmp_path))
    # two passes leave an executor four idle workers with their memos
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_stored_tables_are_deleted(spark, tmp_path):
    import glob

    from quillflow.llm import scratch

    def make():
        return scratch.stored(spark.range(5).toDF("a"), "passed-on").where("a > 2")

    found = scratch.only_result(spark, make, "result")
    assert found.count() == 2 and not glob.glob(f"{scratch.shared_dir(spark)}/quillflow/passed-on-*")


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from quillflow.llm import scratch

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError):
            scratch.shared_dir(session)


def test_policy_is_versioned():
    assert quality_rules.mask(("base", 1)) == 3
    assert quality_rules.mask(("web", 1)) & quality_rules.mask(("web", 2)) == quality_rules.mask(("web", 1))


def test_registration():
    import __spark_entry__ as driver

    known = driver.queries()
    assert "pipeline" in known and [sum(n.startswith(f"op{k}_") for n in known) for k in range(1, 11)] == [1] * 10
    assert set(queries.SQL) <= set(driver.oracle_sql())
