import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from changeflow.llm import toxicity as T
from changeflow.llm.common import read
from .llm_fixtures import SF_MID


def unit(v):
    norm = math.sqrt(sum(w * w for w in v.values()))
    return {t: w / norm for t, w in v.items()}


def brute(vectors, sizes, query, k):
    """Nearest entries by cosine until they hold k examples."""
    scored = [(-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors)]
    out, held = [], 0
    for s, i in sorted(x for x in scored if x[0] < 0):
        if held >= k:
            break
        out.append((i, -s))
        held += sizes[i]
    return out


def test_neighbours_are_exact_with_ties():
    rng = np.random.default_rng(3)
    draw = lambda: unit({int(t): float(rng.integers(1, 4)) for t in rng.choice(12, int(rng.integers(1, 5)), replace=False)})
    vectors = [draw() for _ in range(700)]
    sizes = [int(n) for n in rng.integers(1, 5, 700)]
    index = T.BlockMaxIndex(vectors, sizes, block=16)
    for _ in range(200):
        query = draw()
        for k in (1, 7, 40):
            got, want = index.nearest(query, k), brute(vectors, sizes, query, k)
            assert [n.entry for n in got] == [i for i, _ in want]
            assert np.allclose([n.cosine for n in got], [c for _, c in want], atol=1e-11)
    assert index.nearest({99: 1.0}) == [] == T.BlockMaxIndex([]).nearest({0: 1.0})


def test_blocks_bound_their_scores_and_most_are_skipped(monkeypatch):
    vectors = sorted((unit({t: 1.0, 50: 1 + i / 7}) for t in range(40) for i in range(20)), key=lambda v: sorted(v.items()))
    index = T.BlockMaxIndex(vectors, block=16)
    seen, plain = [], T.BlockMaxIndex._scores
    monkeypatch.setattr(T.BlockMaxIndex, "_scores", lambda self, q, b: seen.append(b) or plain(self, q, b))
    query = unit({3: 1.0, 50: 0.2})
    assert len(index.nearest(query, 5)) == 5 and len(seen) < index.blocks / 3
    for b in range(index.blocks):
        assert plain(index, query, b).max() <= index.bounds(query)[b] + 1e-9


def test_isotonic_rises_and_keeps_the_mean():
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.7, 0.9]), np.array([0, 1, 0, 0, 1, 1.0])
    steps, levels = T.isotonic(x, y, np.array([50, 1, 9, 20, 30, 40.0]))
    assert (np.diff(levels) >= 0).all() and levels[0] < 0.1 and levels[-1] > 0.9 and steps[0] == 0.1
    assert len(T.isotonic(np.empty(0), np.empty(0), np.empty(0))[0]) == 0


def test_terms_are_the_words_of_toxic_texts_and_not_of_copied_ones(spark):
    rng = np.random.default_rng(1)
    plain = [f"{c}{v}{d}" for c in "bdgklmnprst" for v in "aeiou" for d in "lmnrst"]
    text = lambda extra: " ".join(rng.permutation([*rng.choice(plain, 60), *extra]))
    rows = [(text(["rotter"] * 3 if i % 2 else ["skunkish", "skunky"]), 1) for i in range(30)] + [(text([]), 0) for _ in range(300)]
    rows += [("zyxwords xylotexts that one text of label one has and its copies " * 2, 1)] * 20
    got = T.select_terms(spark.createDataFrame(rows, "text string, y int").repartition(4))
    assert set(got) == {"rotter", "skunk"}
    assert T.select_terms(spark.createDataFrame(rows[:20], "text string, y int")) == []


def test_score_tells_a_text_full_of_a_term_from_a_long_one():
    examples = [(i, [0], [4], 96 + i % 5, 1) for i in range(40)] + [(100 + i, [0], [1], 700 + i, 0) for i in range(40)] + [(200 + i, [], [], 300, 0) for i in range(300)]
    model = T.Model(np.array([4.0]), examples)
    assert model.score([0], [8], 200)[0] > 0.9 and model.score([0], [1], 900)[0] < 0.1 and model.score([], [], 50) == (model.blank, [])
    near = model.score([0], [4], 97)[1]
    assert sum(n for _, _, n, _ in near) >= T.NEIGHBOURS and all(n == y for _, _, n, y in near)


def test_held_out_accuracy(spark):
    toxic = {r.doc_id: r.toxic for r in read(spark, SF_MID, "labels").collect()}
    rows = T.op12_toxicity(spark, SF_MID).collect()
    assert len(rows) == read(spark, SF_MID, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(y for y, _ in held) >= 15
    assert np.mean([p for y, p in held if y]) >= 0.75 and np.mean([p for y, p in held if not y]) <= 0.01


def test_odd_rows(spark, odd, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(None, 1, 1), (5, 1, None), (5, 0, 0), (9, 1, 0), (3, None, 1), (2**60 + 1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = odd.withColumn("held_out", F.lit(False))
    assert {r.score for r in T.toxicity_scores(rows, none).collect()} == {0.0}
    out = T.toxicity_scores(rows, some).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out) and any(r.doc_id == 2**60 + 1 for r in out)
    assert T.toxicity_scores(no_docs.withColumn("held_out", F.lit(False)), some).count() == 0
