
import duckdb
from pyspark.sql import functions as F

from changeflow.llm import line_dedup as L
from .llm_fixtures import SF_SMALL

STRIP = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(docs):
    """docs: (doc_id, text) rows; None sorts first."""
    rank = lambda i: (i is not None, i)
    first = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            k = lower(line.strip(STRIP))
            if len(k) >= 10 and (k not in first or rank(i) < rank(first[k])):
                first[k] = i
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(STRIP)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(docs):
    out = L._with_bitmaps(docs, 10)
    return [tuple(r) for r in out.select("row.doc_id", "n_lines", "n_dropped", L._kept_text(F.col("row.text"), F.col("keep_bitmap")).alias("t")).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_matches_brute_force_on_lines_shared_by_many(spark):
    rows = [(i, "\n".join(f"{'  ' if (i + j) % 3 else ''}Shared LINE number {j % (i % 7 + 1)}{' ' * (i % 2)}" for j in range(i % 11)) + "\nshort\nown line of " + str(i)) for i in range(300)]
    rows += [(1000 + i, "The common line of all\nÉTÉ long enough\néTÉ long enough") for i in range(200)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(got) == sorted(brute(rows))


def test_odd_rows(odd, no_docs):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(run(odd), key=key) == sorted(brute(rows), key=key)
    assert run(no_docs) == []
    assert L.dedup_lines(no_docs).columns == no_docs.columns


def test_stage_keeps_columns_and_recounts(odd):
    out = L.dedup_lines(odd)
    assert out.schema.fieldNames() == odd.schema.fieldNames() and out.count() == odd.count()
    twin = out.where(F.col("doc_id") == 2**60 + 1).first()
    assert twin.text == "" and twin.n_chars == 0 and twin.row == "x"
    assert out.where("doc_id IS NULL AND text IS NULL").count() == 1


def test_bitmap_round_trip(spark):
    df = spark.createDataFrame([([0, 1, 4], 7), ([2], 3), ([0, 1, 2], 3)], "d array<int>, n int")
    got = [tuple(map(tuple, r.x)) for r in df.select(L.unpack(L._pack(L._keep_runs(F.col("d"), F.col("n")))).alias("x")).collect()]
    assert got == [((2, 2), (5, 2)), ((0, 2),), ()]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert sorted(tuple(r) for r in L.op10_line_dedup(spark, SF_SMALL).collect()) == sorted(con.execute(L.OP10_SQL).fetchall())


def test_no_python_in_plan(odd):
    plan = L._with_bitmaps(odd, 10)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
