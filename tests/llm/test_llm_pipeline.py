"""The queries and the corpus pipeline on the smallest tables."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import check
import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from cohortloom.llm import decontaminate, hyperminhash, pii, toxicity
from cohortloom.llm.catalogue import ORACLE, QUERIES
from cohortloom.llm.tokens import tokenizer_path
from cohortloom.session import stage

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_queries_are_registered():
    assert [q for q in queries() if q.startswith("op")] == list(QUERIES)
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in queries() and set(ORACLE) <= set(oracle_sql())


@needs_data
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    ok, note = check.compare(spark, check.connect(FOLDER), FOLDER, name, ORACLE.get(name))
    assert ok, note


@needs_data
def test_every_stage_decides_as_its_operator_does(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = []
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, FOLDER))
        before = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert out.dtypes == docs.dtypes
            after = {r.doc_id: r for r in out.collect()}
            assert set(after) <= set(before)
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
            assert set(after) == {r.doc_id for r in scores if r.toxic_score < 0.5}
        if name == "near_copies":
            assert set(after) == {r.doc_id for r in hyperminhash.near_duplicates(docs).collect() if r.kept}
        if name == "decontamination":
            found = decontaminate.report(decontaminate.find_hits(docs, bench)).collect()
            assert set(after) == {r.doc_id for r in found if not r.contaminated}
            assert all(after[r.doc_id].text == before[r.doc_id].text for r in found if not r.n_hit)
            assert decontaminate.report(decontaminate.find_hits(out, bench)).where("n_hit > 0").count() <= sum(r.n_hit > 0 for r in found)
        if name == "personal_data":
            spans = {r.doc_id: r.spans for r in pii.report(pii.find(docs)).collect()}
            assert set(after) == set(before)
            assert all((after[d].text != before[d].text) == bool(spans[d]) for d in before)
        if name == "packing":
            plain = Tokenizer.from_file(tokenizer_path())
            texts = {d: [*plain.encode(r.text or "", add_special_tokens=False).ids, 2] for d, r in before.items()}
            total = 0
            for r in out.collect():
                own = np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4")
                assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(texts[r.doc_id])
                total += r.length
            assert total == sum(map(len, texts.values()))
        kept.append(out.count())
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == kept[-1]


@needs_data
def test_a_corpus_of_odd_rows_or_none(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "no id", "en", "s", 5)], docs.schema)
    for given in (docs.limit(40).unionByName(odd), docs.limit(0)):
        current = stage(given)
        for name, step in corpus_pipeline.STAGES[:-1]:
            current = stage(step(spark, current, FOLDER))
            assert current.dtypes == docs.dtypes
        names = {r.doc_id for r in current.collect()}
        assert given.isEmpty() or {9001, 9002, None} <= names
        assert given.isEmpty() == corpus_pipeline.STAGES[-1][1](spark, current, FOLDER).isEmpty()
