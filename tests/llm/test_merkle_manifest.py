import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from changeflow.llm import merkle_manifest as M
from .llm_fixtures import SF_SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """The root of ``nodes`` and every node's (left, sibling) pairs."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, k in zip(ways, at):
            way.append((k % 2 == 1, nodes[k ^ 1] if k ^ 1 < len(nodes) else ""))
        at = [k // 2 for k in at]
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def brute(rows):
    """rows: (doc_id, lang, leaf). (doc_id, leaf, subroot, root, path) of each."""
    low = lambda x: (x is not None, x)
    trees = {}
    for i, lang, x in sorted(rows, key=lambda r: (low(r[0]), r[2])):
        trees.setdefault(lang, []).append((i, x))
    made = {lang: climb([x for _, x in own]) for lang, own in trees.items()}
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    root, up = climb([made[v][0] for v in langs]) if langs else (None, [])
    return [(i, x, made[v][0], root, way + up[k]) for k, v in enumerate(langs) for (i, x), way in zip(trees[v], made[v][1])]


def key(r):
    return repr(r)


@pytest.mark.parametrize("every", [2, 6])
def test_matches_brute_force_over_sizes(spark, every):
    rows = [(i * 3 % 1009, lang, h(lang or "", str(i))) for lang, n in [("en", 300), ("é", 65), ("fr", 64), ("z", 1), (None, 2), ("", 17)] for i in range(n)]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, lang string, leaf string, ref string").repartition(5)
    out = M.proofs(M.manifest(df, every)).withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.h) for s in r.path]) for r in out]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert all(r.folded == r.root for r in out)


def test_only_every_few_levels_are_stored(spark):
    df = spark.range(300).select("id", F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("ref")).withColumnRenamed("id", "doc_id")
    stored = M.manifest(df, 3).levels
    assert [level.select(F.sum(F.size("nodes"))).first()[0] for level in stored] == [300, 38, 5]
    assert max(level.select(F.max(F.size("nodes"))).first()[0] for level in stored) == 8


def test_tampering_shows(spark):
    rows = M.op11_merkle_manifest(spark, SF_SMALL).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert sorted(tuple(r) for r in M.op11_merkle_manifest(spark, SF_SMALL).collect()) == sorted(con.execute(M.OP11_SQL).fetchall())


def test_odd_rows(odd, no_docs):
    cols = [F.col(c) for c in M.FIELDS]
    leaves = lambda docs: docs.select("doc_id", "lang", M.leaf(*cols).alias("leaf"), F.lit(None).cast("string").alias("ref"))
    rows = [(r.doc_id, r.lang, leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in odd.collect()]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.h) for s in r.path]) for r in M.proofs(M.manifest(leaves(odd))).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert M.proofs(M.manifest(leaves(no_docs))).collect() == []


def test_no_python_in_plan(odd):
    leaves = odd.select("doc_id", "lang", M.leaf(*[F.col(c) for c in M.FIELDS]).alias("leaf"), F.lit(None).cast("string").alias("ref"))
    plan = M.proofs(M.manifest(leaves))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
