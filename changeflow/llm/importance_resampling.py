"""Operator 13: target-distribution importance resampling over hashed n-grams.

Separators are collapsed to single spaces; an overlapped regex scan whose
look-arounds hold the word boundaries then emits, at every word, the spans of
the n-grams that start there, and each span's CRC names its bucket. Documents are scanned once: their
bucket counts are written, summed for the corpus, turned into gains against the
target's counts, and looked up again for each document's weight. Gumbel noise
from a hash of the id makes the draw without replacement repeatable.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import read, save
from changeflow.llm.ranks import ranked

BUCKETS = 10_000
WORDS = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Rows of text in hand, and spans of one text counted at a time.
BATCH_ROWS = 256
BLOCK_SPANS = 500_000

# Every byte of a separator is a space, A-Z is a-z, all others (bytes of characters beyond ASCII too) are themselves.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
# Stands after the last word so that every word starts a full run; it is a separator, so no word holds it.
END = b"~"

PROFILE = "doc_id long, n_words long, n_features long, buckets array<smallint>, counts array<int>"


@functools.cache
def scanner(words: int) -> regex.Pattern:
    """Matches every run of ``words`` words; group k is the run without its last k words."""
    run = rb"[^ ]+"
    for _ in range(words - 1):
        run = rb"(" + run + rb") [^ ]+"
    return regex.compile(rb"(?<= )" + run + rb"(?= )")


def collapsed(text: str) -> tuple[bytes, int]:
    """The words of ``text`` with one space before and after each, and their number."""
    found = text.encode().translate(FOLD).split()
    return b" " + b" ".join(found) + b" " if found else b"", len(found)


def bucket_counts(text: str, buckets: int = BUCKETS, words: int = WORDS) -> tuple[int, np.ndarray]:
    """Words of ``text``, and how often each bucket is hit by its runs of 1 to ``words`` words."""
    line, n = collapsed(text)
    total = np.zeros(buckets, np.int64)
    if n == 0:
        return 0, total
    matches = scanner(words).finditer(line + (END + b" ") * (words - 1), overlapped=True)
    spans = map(methodcaller("group", *reversed(range(words))), matches)
    each = itertools.chain.from_iterable(zip(spans) if words == 1 else spans)
    for start in range(0, n, BLOCK_SPANS):
        crc = np.fromiter(map(zlib.crc32, itertools.islice(each, BLOCK_SPANS * words)), np.uint32).reshape(-1, words)
        for k in range(words):
            # The last k words start no run of k + 1 words; theirs hold END.
            total += np.bincount(crc[: max(n - k - start, 0), k] % buckets, minlength=buckets)
    return n, total


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            rows = batch.slice(at, BATCH_ROWS)
            found = [bucket_counts(t.as_py() or "") for t in rows.column(1)]
            hit = [np.flatnonzero(c) for _, c in found]
            ends = np.cumsum([0, *map(len, hit)]).astype(np.int32)
            buckets = np.concatenate(hit).astype(np.int16)
            counts = np.concatenate([c[h] for (_, c), h in zip(found, hit)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([int(c.sum()) for _, c in found], pa.int64()),
                pa.ListArray.from_arrays(ends, buckets), pa.ListArray.from_arrays(ends, counts),
            ], ["doc_id", "n_words", "n_features", "buckets", "counts"])


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and the hit buckets with their counts, of every row of ``docs`` (doc_id, text); null texts hit none."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_profile, PROFILE)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        np.add.at(total, _flat(batch.column(0)), _flat(batch.column(1)))
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])


def corpus_counts(of: DataFrame) -> np.ndarray:
    """How often each bucket is hit in all of ``profiles``; one row a bucket and task is exchanged, one a bucket collected."""
    sums = of.select("buckets", "counts").mapInArrow(_sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():
        total[row.bucket] = row.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of target to corpus with one more feature in every bucket, in thousandths, rounded down."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = [(float(t + 1) * s_all) / (float(s + 1) * t_all) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths, rounded down; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(of: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``profiles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worth = gain[_flat(batch.column("buckets"))] * _flat(batch.column("counts"))
            lengths = batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False)
            weight = np.diff(np.r_[0, np.cumsum(worth)][np.r_[0, np.cumsum(lengths)]])
            score = weight + np.array([noise(i.as_py(), seed) for i in batch.column("doc_id")], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight, pa.int64()), pa.array(score, pa.int64())],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])

    return of.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text); ``rank`` is null if not drawn.

    Of the N rows with at least ``min_words`` words the floor(percent * N / 100)
    of highest score are drawn, ties to the smaller doc_id (null first).
    ``target`` (text) is the distribution wanted. Null and empty texts have no
    words, weight 0 and are never drawn. Rows that repeat a doc_id or a text are
    rows of their own, with the noise of their id. An empty target leaves the
    weights to the smoothing; no rows give none. Other columns are not read.
    """
    of = save(profiles(docs), "dsir-profiles")
    gain = gains(corpus_counts(of), corpus_counts(profiles(target.select(F.lit(0).alias("doc_id"), "text"))))
    scored = save(weighted(of, gain, seed), "dsir-scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    fit = ranked(scored.where(F.col("n_words") >= min_words).withColumn("all", F.lit(0)), "all", order, "dsir-order")
    drawn = F.when(F.col("pos") < F.floor(F.col("n") * percent / 100), F.col("pos") + 1)
    fit = fit.select(*scored.columns, drawn.cast("long").alias("rank"))
    return fit.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the benchmark's texts."""
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)
), texts AS (
  SELECT 0 AS side, doc_id AS id, text, row_number() OVER () AS rn FROM documents
  UNION ALL SELECT 1, item_id, text, -row_number() OVER () FROM benchmark
), listed AS (
  SELECT side, id, rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), words AS (
  SELECT side, rn, unnest(w) AS a, unnest(range(len(w))) AS pos FROM listed
), grams AS (
  SELECT side, rn, a, lead(a) OVER q AS b, lead(a, 2) OVER q AS c FROM words WINDOW q AS (PARTITION BY rn ORDER BY pos)
), counted AS (
  SELECT side, rn, f, count(*) AS n FROM (SELECT side, rn, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS f FROM grams) WHERE f IS NOT NULL GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(string_split(regexp_replace(hex(encode(f)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::BIGINT AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM sums, totals
), weights AS (
  SELECT rn, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rn
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM listed LEFT JOIN weights USING (rn) WHERE side = 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ordered
"""
