import collections
import re

from pyspark.sql import functions as F

from changeflow.llm import quality_rules as Q
from changeflow.llm.common import read
from .llm_fixtures import SF_MID


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_match_brute_force(spark, odd):
    texts = [None, "", "a", "a a a a", "a b c a b c a b", "x\nx\n \nx y\nx", "a b a b a b a", "#$ %& é b", "aaa\n\naaa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(odd.select("text"))
    for r in df.select("text", Q.statistics(F.col("text")).alias("s")).select("text", "s.*").collect():
        assert tuple(r[c] for c in BASE) == counts(r.text)


def test_learns_a_planted_rule(spark):
    rows = [(i, " ".join(f"w{i}x{j}{'#' if i % 4 == 0 else ''}" for j in range(60 + i % 30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(300)] + [(None, 0, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in Q.quality_rules(docs, labels).collect()}
    assert out == {i: i % 4 != 0 for i in range(400)}
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == {i for i in range(400) if i % 4}


def test_odd_rows_and_no_labels(spark, odd, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(odd, none).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.kept == (not r.base_failed)
    assert Q.quality_rules(no_docs, none).count() == 0
    kept = Q.keep_good(odd, none)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {9}


def test_query_agrees_with_labels_and_keeps_good(spark):
    rows = Q.op9_quality_rules(spark, SF_MID).collect()
    quality = {r.doc_id: r.quality for r in read(spark, SF_MID, "labels").collect()}
    open_rows = [(quality[r.doc_id], r.kept) for r in rows if r.doc_id in quality and not r.base_failed]
    assert all(kept for q, kept in open_rows if q == 1)
    bad = [kept for q, kept in open_rows if q == 0]
    assert bad and sum(bad) <= 0.05 * len(bad)
    texts = {r.doc_id: r.text for r in read(spark, SF_MID, "documents").collect()}
    for r in rows:
        assert tuple(r[c] for c in BASE) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_no_python_in_plan(odd):
    plan = odd.select(Q.statistics(F.col("text")).alias("s"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
