"""Pipeline and registered queries."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from snapplan.llm.common import settle
from snapplan.llm.mixing import BLOCK, mix_sources
from snapplan.llm.queries import ORACLES, QUERIES
from snapplan.llm.tokenize import byte_level_ids

from .conftest import odd_documents


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    rows = [(d, x, "en", f"src{k % 3}", None) for k, (d, x) in enumerate(odd_documents())]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i == 39)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept[name] = docs.collect()
    assert len(kept["source_mixing"]) == len(kept["ngram_join"]) < len(kept["line_dedup"])
    ids = [r.doc_id for r in kept["ngram_join"]]
    assert ids.count(2) == 1
    assert 300 not in ids and 3 in ids
    assert {302, 303, 304} <= set(ids)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = sum(len(byte_level_ids(r.text or "", "byte_bpe_50k.json")) // 4 + 1 for r in kept["source_mixing"])
    assert sum(r.length for r in packed) == tokens


def test_sequences_follow_the_mix(spark):
    rows = [(i, "word " * (5 + i % 300 if i % 4 else 400), "en", "ab"[i % 4 == 0], None) for i in range(4000)]
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
                  .repartition(7))
    mixed = settle(corpus_pipeline.mix(spark, docs, ""))
    packed = corpus_pipeline.pack(spark, mixed, "", group=256).collect()
    place = {r.doc_id: r.position for r in mix_sources(docs).collect()}
    assert sorted(r.doc_id for r in packed) == list(range(4000))
    runs = defaultdict(list)
    for r in packed:
        runs[r.sequence_id >> 32].append(r)
    at = 0
    share = 1000 ** 0.5 / (1000 ** 0.5 + 3000 ** 0.5)
    for g in sorted(runs):
        assert sorted(place[r.doc_id] for r in runs[g]) == list(range(at, at + len(runs[g])))
        at += len(runs[g])
        if at < 2000:                                 # before a source ends
            assert abs(sum(r.doc_id % 4 == 0 for r in runs[g]) - share * len(runs[g])) < 2 * BLOCK
        opens = [place[r.doc_id] for r in sorted(runs[g], key=lambda r: r.sequence_id) if r.offset == 0]
        assert opens == sorted(opens)
    assert len(runs) == 16


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_ngram_join"])
def test_against_sql(spark, name):
    import duckdb
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = c.execute(f"SELECT * FROM ({ORACLES[name]}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    assert got == want
