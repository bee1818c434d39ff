"""The pipeline on a small fixture, each stage against a brute-force version on the rows its predecessor kept."""

import hashlib
import random

import pytest
import tokenizers

import corpus_pipeline as P
from changeflow.llm.bpe import vocabulary_path
from changeflow.llm.common import save
from .test_jaccard_join import brute as components
from .test_line_dedup import brute as without_lines
from .test_quality_rules import counts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    bench = [(i, words(30)) for i in range(5)]
    rows = []
    for i in range(160):
        text = words(70) + ".\n" + words(40)
        if i % 8 == 1:
            text = " ".join(w + "###" for w in text.split())
        elif i % 8 == 2:
            text = words(20)
        elif i % 8 == 3 and i > 8:
            w = rows[i - 8][1].split(" ")
            w[7] = "changed"
            text = " ".join(w)
        elif i % 8 == 4:
            text += "\nThis line is in many of the documents"
        elif i % 8 == 5:
            text = words(30) + " " + bench[i % 5][1] + " " + words(30)
        rows.append((i, text, "en", "src0", len(text)))
    rows += [(None, words(60), None, None, None), (500, None, None, None, None), (501, "", "en", "src1", 0), rows[0]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 8 != 1), 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, bench


def test_stages(spark, tables):
    path, rows, bench = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    rank = lambda r: ((r[0] is not None, r[0]), r[1])

    def step(k, docs):
        out = save(P.STAGES[k][1](spark, docs, path), f"test-{k}")
        assert k == 4 or out.columns == columns
        return out, sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=rank) if k < 4 else out.collect()

    docs, got = step(0, docs)
    good = [(r[0], r[1]) for r in rows if counts(r[1])[0] >= 50 and "#" not in r[1]]
    assert got == sorted(good, key=rank)
    docs, got = step(1, docs)
    assert got == sorted([(i, t) for i, _, _, t in without_lines(good)], key=rank)
    assert docs.where("n_chars <> length(text)").count() == 0
    known = {i: t for i, t in got if i is not None}
    docs, got2 = step(2, docs)
    keep = {i for i, (_, c) in components(sorted(known.items()), 5, 80).items() if c == i}
    assert got2 == [r for r in got if r[0] is None or r[0] in keep]
    docs, got3 = step(3, docs)
    assert got3 == [r for r in got2 if not any(b in r[1] for _, b in bench)] and len(got3) < len(got2)
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    _, last = step(4, docs)
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in last), key=str) == sorted(
        ((i, len(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in got3), key=str)


def test_near_copies_reach_the_third_stage(spark, tables):
    """One-line copies with one changed word: line dedup keeps both, the third stage one of them."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.replace(t.split()[40], "changed")) for i, t in enumerate(texts[:6])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = save(P.STAGES[1][1](spark, docs, tables[0]), "near-lines")
    known = {r.doc_id: r.text for r in docs.collect()}
    keep = {i for i, (_, c) in components(sorted(known.items()), 5, 80).items() if c == i}
    assert len(keep) < len(known) and keep == set(range(12))
    assert {r.doc_id for r in P.STAGES[2][1](spark, docs, tables[0]).collect()} == keep


def test_run_is_the_stages_in_order(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in P.STAGES:
        docs = save(stage(spark, docs, tables[0]), f"test-{name}")
    assert sorted(map(str, P.run(spark, tables[0]).collect())) == sorted(map(str, docs.collect()))
    assert [k for k, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontaminate", "bpe"] and P.ORACLE_SQL is None


def test_empty_and_odd_tables(spark, odd, no_docs, tables, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for docs in (no_docs, odd):
        for name, stage in P.STAGES:
            out = save(stage(spark, docs, path), f"odd-{name}")
            if name != "bpe":
                assert out.columns == docs.columns
                assert out.count() <= docs.count()
