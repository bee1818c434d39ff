import collections
import random

import numpy as np
import pandas as pd
import pytest

from changeflow.llm import jaccard_join as J
from changeflow.llm.common import arrow_rows
from changeflow.llm.components import components
from .llm_fixtures import SF_SMALL


def sets_of(rows, n):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def run(df, n, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, n, percent).collect()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_matches_brute_force(spark, n, percent):
    rng = random.Random(n)
    passage = " ".join(f"shared{i}" for i in range(55))
    rows, i = [], 0
    for group in range(25):
        base = [f"g{group}w{rng.randrange(200)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
            text = " ".join(w)
            rows.append((i, (text + " " + passage if group % 3 == 0 else text.upper() if i % 5 == 0 else text)))
            i += 1
    rows += [(1000 + k, t) for k, t in enumerate(["", None, "a", "A", "a b", "a b c", "é b", "É b", "a  b"])]
    rng.shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, percent) == brute(rows, n, percent)


def test_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(50 - k, " ".join(words[2 * k : 2 * k + 60])) for k in range(20)]
    want = brute(rows, 1, 85)
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85) == want
    assert {c for _, c in want.values()} == {31}


def test_large_group_with_common_words(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4, 85) == brute(rows, 4, 85)


def test_search_equals_counting():
    rng = np.random.default_rng(4)
    for _ in range(60):
        query = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        members = [np.unique(np.concatenate([rng.choice(query, rng.integers(1, len(query) + 1)), rng.integers(0, 90, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
        for percent in (30, 60, 85):
            want = [i for i, m in enumerate(members) if 100 * len(np.intersect1d(query, m)) >= percent * len(np.union1d(query, m))]
            assert J.search(query, members, percent) == want


def test_odd_rows(spark, odd, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(odd).collect()]
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for i, n, c in got:
        by[i].add(c)
    assert by[2**60 + 1] == {5} and by[5] == {5} and by[None] == {None}
    assert by[2] == {2} and by[3] == {3} and by[4] == {4} and by[7] == {7}
    assert J.jaccard_components(no_docs).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 1 and kept.where("doc_id IS NULL").count() == 2


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r.component_id for r in J.jaccard_components(df).collect()} == {1}


def test_every_text_of_an_id_links(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefgh"]
    for k in range(4):
        # Whichever of its two texts comes first, document 5 links by both.
        one, two = texts[2 * k], texts[2 * k + 1]
        df = spark.createDataFrame([(5, one), (5, two), (9, two + " end"), (8, one + " end")], "doc_id long, text string")
        assert {r.component_id for r in J.jaccard_components(df).collect()} == {5}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.op6_jaccard_join(spark, SF_SMALL).collect()} == brute(rows, 4, 85)


def test_batch_setting_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), arrow_rows(spark, 7):
        assert spark.conf.get(key) == "7"
        sizes = spark.range(100, numPartitions=1).mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long")
        assert max(r.n for r in sizes.collect()) == 7
        raise RuntimeError
    assert spark.conf.get(key) == before
