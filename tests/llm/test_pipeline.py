"""The corpus pipeline, its stages against brute force, and the registered queries."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from radiomap.llm import bpe, decontam, pii, quality, simhash
from radiomap.llm.queries import ORACLE, QUERIES, read, tokenizer
from tests.conftest import SF_SMALL
from tests.llm.test_simhash import components, fingerprint
from tools.oracle_check import compare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    out = [read(spark, SF_SMALL, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], SF_SMALL).collect(), stage(spark, out[-1], SF_SMALL).schema))
    return out


def test_stage_columns_and_rows(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    sizes = [s.count() for s in stages]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5] > 0


def test_each_decision(spark, stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    scored = quality.classify(stages[0], read(spark, SF_SMALL, "labels"))
    assert ids[1] == {r.doc_id for r in scored.where("keep").collect()}
    rows = sorted((r.doc_id, fingerprint(r.text)) for r in stages[1].collect())
    root = components([v for _, v in rows], 2)
    assert ids[2] == {rows[r][0] for r in set(root)}
    leaking = {r.doc_id for r in decontam.leaks(stages[2], read(spark, SF_SMALL, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaking
    field = pii.train()
    for before, after in zip(stages[3].orderBy("doc_id").collect(), stages[4].orderBy("doc_id").collect(), strict=True):
        base, every = pii._all_spans([before.text], field)
        assert after.text == pii.replace(before.text, every[0])
        assert after.n_chars == (len(after.text) if every[0] else before.n_chars)
    codec = bpe.Codec(open(tokenizer(), encoding="utf-8").read())
    want = {r.doc_id: next(codec.encode([r.text])) for r in stages[4].collect()}
    assert {r.doc_id: r.ids for r in stages[5].collect()} == want


def test_ids_are_decoded_again(stages):
    assert corpus_pipeline.STAGES[-1][0] == "BPE encoding and decoding"
    codec = bpe.Codec(open(tokenizer(), encoding="utf-8").read())
    got = {r.doc_id: r for r in stages[5].collect()}
    assert got and all(r.decoded_sha256 == hashlib.sha256(codec.decode(r.ids)).hexdigest() for r in got.values())


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.exceptAll(stages[-1]).count() == 0 and got.count() == stages[-1].count()


def test_empty_documents(spark):
    docs = read(spark, SF_SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), stage(spark, docs, SF_SMALL).schema)
    assert docs.count() == 0


def test_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    problems, *_ = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert not problems, problems


def test_simhash_whole_table(spark):
    docs = read(spark, SF_SMALL, "documents").collect()
    values = [fingerprint(r.text) for r in docs]
    root = components(values, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_dedup"](spark, SF_SMALL).collect()}
    for d, v, r in zip(docs, values, root, strict=True):
        assert got[d.doc_id] == (f"{v:016x}", min(x.doc_id for x, q in zip(docs, root, strict=True) if q == r))
    assert simhash.MAX_BITS == 2
