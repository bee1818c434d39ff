import zlib

import numpy as np
from pyspark.sql import functions as F

from changeflow.llm import quality_gam as G
from changeflow.llm.common import read
from .llm_fixtures import SF_MID


def test_held_out_accuracy(spark):
    quality = {r.doc_id: r.quality for r in read(spark, SF_MID, "labels").collect()}
    rows = G.op8_quality_gam(spark, SF_MID).collect()
    assert len(rows) == read(spark, SF_MID, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [quality[r.doc_id] == r.predicted for r in rows if r.held_out and r.doc_id in quality]
    assert len(held) > 80 and np.mean(held) >= 0.97


def test_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.Gam(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (500, 3)).astype(float)
    model = G.Gam(x, (x[:, 0] + x[:, 2] > 18).astype(float))
    for row, got in zip(x[:20], model.score(x[:20])):
        total = model.intercept + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(row, model.edges, model.tables))
        total += sum(t[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for (i, j), t in model.pairs.items())
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows(spark, odd, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(None, 1, 0), (5, 1, None), (5, 0, 0), (9, 1, 0), (3, None, 1), (2**60 + 1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = odd.withColumn("held_out", F.lit(False))
    assert {r.score for r in G.quality_scores(rows, none).collect()} == {0.5}
    out = G.quality_scores(rows, some).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out) and any(r.doc_id == 2**60 + 1 for r in out)
    assert G.quality_scores(no_docs.withColumn("held_out", F.lit(False)), some).count() == 0
