"""Operator 10: line dedup.

Lines are hashed, range-partitioned by hash and sorted by document and position
inside each hash; one ordered pass keeps the first occurrence. A hash that a
third of the corpus shares is dealt over ``SALTS`` sub-ranges: each sub-range
finds its own first document, and a second ordered pass over these (at most
``SALTS`` documents a hash) finds the overall first. The operator returns one
run-length keep bitmap per document that loses lines, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.llm.common import SPACES, ascii_lower, read, save

# Sub-ranges per hash in the first pass: bounds what the second pass sees of one hash.
SALTS = 64
MIN_KEY_CHARS = 10


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty give one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, text) of every row; the hash tells rows of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, salt, doc_id, row_hash, pos) of each line whose key is long enough."""
    at = _rows(docs).select("doc_id", "row_hash", F.posexplode(lines_of(ascii_lower(F.col("text")))).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACES))
    return at.select("doc_id", "row_hash", "pos", key.alias("key")).where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        "doc_id", "row_hash", "pos",
    )


def _first_doc(*by: str) -> Column:
    order = Window.partitionBy(*by).orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.first("doc_id").over(order)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, row_hash, pos) of every line whose key an earlier document holds."""
    lines = save(_keyed_lines(docs, min_chars), "line-hashes")
    dealt = lines.repartitionByRange("h1", "h2", "salt").withColumn("first_doc", _first_doc("h1", "h2", "salt"))
    later = ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    dealt = save(dealt.withColumn("later", later).drop("first_doc", "salt"), "line-firsts")
    firsts = dealt.where(~F.col("later")).withColumn("first_doc", _first_doc("h1", "h2"))
    cols = ["doc_id", "row_hash", "pos"]
    return dealt.where("later").select(cols).unionByName(firsts.where(later).select(cols))


def _keep_runs(dropped: Column, n_lines: Column) -> Column:
    """(start, length) of each run of kept lines between sorted dropped positions."""
    ends = F.concat(dropped, F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    runs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                       lambda r: F.struct(r["s"].alias("start"), (r["e"] - r["s"]).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def _pack(runs: Column) -> Column:
    """Runs as binary: four bytes of start and four of length each."""
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(word(r["start"]), word(r["length"]))), ""))


def unpack(bitmap: Column) -> Column:
    """The (start, length) runs of a packed keep bitmap."""
    text = F.hex(bitmap)
    number = lambda i: F.conv(F.substr(text, i, F.lit(8)), 16, 10).cast("int")
    count = (F.octet_length(bitmap) / 8).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(number(i * 16 + 1).alias("start"), number(i * 16 + 9).alias("length")))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One row per document that loses lines: doc_id, row_hash, n_dropped, dropped positions' keep bitmap.

    A line's key is the line without surrounding white space, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in two or more documents
    keep their lines in the smallest doc_id only. Rows of one doc_id count as
    one document; a null doc_id is one document that sorts before all others;
    null texts are one empty line, which is never dropped. Exact repeated rows
    share one bitmap. Only doc_id and text are read, so extra columns of any
    name do no harm. An empty table gives no rows.
    """
    gone = dropped_lines(docs, min_chars).groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return gone.select("doc_id", "row_hash", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def _with_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with its n_lines, n_dropped and keep bitmap (null: all kept)."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    maps = line_bitmaps(docs, min_chars).select(F.col("doc_id").alias("bd"), F.col("row_hash").alias("bt"), "n_dropped", "dropped")
    joined = own.join(maps, own["d"].eqNullSafe(maps["bd"]) & (own["t"] == maps["bt"]), "left")
    n_lines = F.size(lines_of(F.col("row.text")))
    return joined.select("row", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                         F.when(F.col("dropped").isNotNull(), _pack(_keep_runs(F.col("dropped"), n_lines))).alias("keep_bitmap"))


def _kept_text(text: Column, bitmap: Column) -> Column:
    parts = F.flatten(F.transform(unpack(bitmap), lambda r: F.slice(lines_of(text), r["start"] + 1, r["length"])))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(parts, "\n"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and keep_bitmap (null: every line stays) of every row."""
    return _with_bitmaps(docs, min_chars).select("row.doc_id", "n_lines", "n_dropped", "keep_bitmap")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` with its columns, ``text`` reduced to the kept lines joined by ``\\n``.

    A text that loses no line comes back as it was, null included; ``n_chars``,
    where the table has it, is counted again for texts that lose lines.
    """
    out = _with_bitmaps(docs, min_chars)
    text = F.when(F.col("keep_bitmap").isNull(), F.col("row.text")).otherwise(_kept_text(F.col("row.text"), F.col("keep_bitmap")))
    out = out.withColumn("new_text", text)
    cols = []
    for f in docs.schema.fields:
        c = F.col("row").getField(f.name)
        if f.name == "text":
            c = F.col("new_text")
        elif f.name == "n_chars":
            c = F.when(F.col("keep_bitmap").isNull(), c).otherwise(F.length("new_text")).cast(f.dataType)
        cols.append(c.alias(f.name))
    return out.select(*cols)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and keep_bitmap of every document."""
    out = _with_bitmaps(read(spark, sf_dir, "documents").select("doc_id", "text"), MIN_KEY_CHARS)
    sha = F.sha2(_kept_text(F.col("row.text"), F.col("keep_bitmap")), 256)
    return out.select("row.doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keyed.*, coalesce(first_doc < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
