import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from changeflow.llm import importance_resampling as R
from .llm_fixtures import SF_SMALL


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(w):
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def low(x):
    return (x is not None, x)


def brute(docs, target, percent=5, min_words=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += features(words(text))
    for text in target:
        t += features(words(text))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, text in docs:
        w = words(text)
        f = features(w)
        weight = sum(n * gain(b) for b, n in f.items())
        u = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], low(r[0])))
    drawn = fit[: percent * len(fit) // 100]
    return [(*r, None) for r in rows if r[1] < min_words] + [(*r, k + 1 if k < len(drawn) else None) for k, r in enumerate(fit)]


def run(docs, target, **kw):
    return [tuple(r) for r in R.resample(docs, target, **kw).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]


def key(r):
    return tuple(low(x) for x in r)


TARGET = ["One two THREE four", "été 東京 x1 x2", "", None, "a~b[c]d é", "one two three four"]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["one", "Two", "three,", "four", "été", "東京", "x1", "~", "a_b", "\x80\x7f", "Ünd", "I'm"]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 90))))) for i in range(400)]
    docs += [(1000 + i, "one two three four " * 10) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert sorted(run(df, target), key=key) == sorted(brute(docs, TARGET), key=key)
    assert sorted(run(df, target, percent=37, min_words=3), key=key) == sorted(brute(docs, TARGET, 37, 3), key=key)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_scan_emits_every_run(n, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_SPANS", 7)
    for text in ["", "one", "one two", "one two three", "a b c d e f g h i j k l m n o p", "~ ~", "é  É x"]:
        w = words(text)
        want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in range(1, n + 1) for i in range(len(w) - k + 1))
        count, got = R.bucket_counts(text, 97, n)
        assert count == len(w) and {int(b): int(got[b]) for b in np.flatnonzero(got)} == dict(want)


def test_odd_rows(spark, odd, no_docs):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    none = target.limit(0)
    assert sorted(run(odd, target, percent=50), key=key) == sorted(brute(docs, TARGET, 50), key=key)
    assert sorted(run(odd, none, percent=50), key=key) == sorted(brute(docs, [], 50), key=key)
    assert run(no_docs, target) == [] == run(no_docs, none)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    assert sorted(map(tuple, R.op13_importance_resampling(spark, SF_SMALL).collect()), key=key) == sorted(con.execute(R.OP13_SQL).fetchall(), key=key)
