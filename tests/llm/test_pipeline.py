"""The pipeline's stages, each against brute force on what the one before it kept."""

from __future__ import annotations

import importlib.util
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_exchange import brute_components, tokens
from tests.llm.test_learned import check_packing

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as cp  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"input": docs.collect()}
    columns = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        seen[name] = docs.collect()
    tox, exact, near, mixed, packed = (seen[n] for n, _ in cp.STAGES)
    assert {r.doc_id for r in tox} < {r.doc_id for r in seen["input"]} and len(tox) > 0.7 * len(seen["input"])
    last = defaultdict(int)
    for r in tox:
        last[r.text] = max(last[r.text], r.doc_id)
    assert {r.doc_id for r in exact} == set(last.values()) and len(exact) == len(last)
    rows = [(r.doc_id, r.text) for r in exact]
    assert {r.doc_id for r in near} == {i for i, _, c in brute_components(rows) if i == c}
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in near}
    assert abs(sum(len(tokens(r.text)) for r in mixed) - sum(len(tokens(r.text)) for r in near)) < 0.1 * sum(len(tokens(r.text)) for r in near)
    check_packing(packed, [(r.doc_id, r.text) for r in mixed], 2048)


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run and [n for n, _ in cp.STAGES][0] == "toxicity"
    got = cp.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


@pytest.mark.parametrize("table", ["none", "odd"])
def test_stages_on_empty_and_odd_tables(spark, request, tmp_path, table):
    docs = request.getfixturevalue(table)
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        assert (docs.count() == 0) == (n == 0)


def test_batches_are_bounded_by_bytes(spark):
    """Wide rows: an Arrow batch ends by its bytes, not after 10 000 rows; ``run`` leaves the session as it was, and a smaller bound stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        cp.run(spark, SF)
        assert spark.conf.get(key, None) == before
        for stage in (cp.toxicity, cp.jaccard_join, cp.packing):
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < cp.BATCH_BYTES + 50_000
            spark.conf.unset(key)
        spark.conf.set(key, "1m")
        cp.bound_batches(spark)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < (1 << 20) + 50_000
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
