"""Operator 6: n-gram Jaccard join by T-occurrence search.

1. Every text becomes its set of word n-gram hashes; documents of equal sets are
   one node from there on.
2. Hub links: nodes that share a key made of two minima of the set meet the
   smallest node of that key. Verified links give first components.
3. Prefix lists: a pair at the threshold shares a token among the first
   ``n - ceil(threshold * n) + 1`` tokens of both, in any common order; common
   tokens come last in it. Only pairs of different components are candidates.
4. Both kinds of candidates go through the T-occurrence search: the inverted
   lists of the query's tokens over its candidates are split by DivideSkip; the
   short ones are heap-merged, the long ones probed by binary search, and
   candidates that reach the required overlap are links.

Step 3 makes the result exact; 2 and the token order only save work.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import arrow_rows, read, save
from changeflow.llm.components import components

# Hub keys per node, and minima in each.
HUB_KEYS = 6
KEY_MINIMA = 2
# Token order: one document in ORDER_SAMPLE is looked at for common tokens, and at most
# ORDER_TOKENS of them (2 MB) are sent out. Neither changes the result.
ORDER_SAMPLE = 16
ORDER_MIN = 4
ORDER_TOKENS = 1 << 18
# Candidates in one inverted index; words a worker remembers; ids broadcast when they number fewer.
INDEX_ROWS = 256
CACHE_WORDS = 100_000
BROADCAST_IDS = 2_000_000
# Rows of texts that a Python stage holds at a time.
BATCH_ROWS = 512

# Odd multipliers and shifts of a 64-bit mixing function.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text: A-Z lower-cased, words split at ASCII white space.

    Fewer than ``n`` words give the whole sequence as one; none give the empty set.
    """
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mix(h * STEP + words[i : len(words) - width + 1 + i])
    return np.unique(h)


def hub_keys(tokens: np.ndarray) -> list[int]:
    """Keys that sets of high overlap are likely to share: minima under HUB_KEYS x KEY_MINIMA hash functions."""
    if not len(tokens):
        return []
    seeds = STEP * np.arange(1, HUB_KEYS * KEY_MINIMA + 1, dtype=np.uint64)
    low = np.array([_mix(tokens + seed).min() for seed in seeds], np.uint64).reshape(HUB_KEYS, KEY_MINIMA)
    keys = np.arange(HUB_KEYS, dtype=np.uint64)
    for m in range(KEY_MINIMA):
        keys = _mix(keys * STEP + low[:, m])
    return keys.view(np.int64).tolist()


def prefix(tokens: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The tokens that a set at the threshold must share one of; ``common`` (sorted) come last in the order."""
    if not len(tokens):
        return tokens
    keep = len(tokens) - math.ceil(percent * len(tokens) / 100) + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
        tokens = np.concatenate([tokens[~last], tokens[last]])
    return tokens[:keep]


def required(size_a: int, size_b: int, percent: int) -> int:
    """The smallest overlap of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def search(query: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """The members whose overlap with ``query`` reaches the threshold, by DivideSkip T-occurrence search."""
    needs = [required(len(query), len(m), percent) for m in members]
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for i, m in enumerate(members):
        at = np.minimum(np.searchsorted(query, m), len(query) - 1)
        for t in at[query[at] == m].tolist():
            lists[t].append(i)
    lists = sorted((x for x in lists if x), key=len)
    least = min(needs, default=0)
    if not lists or least <= 0:
        return []
    longest = len(lists[-1])
    n_long = min(least - 1, int(least / (0.1 * math.log2(longest + 1) + 1)), len(lists)) if longest > 8 else 0
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while heap:
        member, count = heap[0][0], 0
        while heap and heap[0][0] == member:
            _, k, at = heap[0]
            count += 1
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        need, left = needs[member], n_long
        for x in long:
            if count >= need or count + left < need:
                break
            at = bisect_left(x, member)
            count += at < len(x) and x[at] == member
            left -= 1
        if count >= need:
            found.append(member)
    return found


def _sketch(n: int, percent: int, common: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                tokens = shingles(text, n, hashes)
                sign = xxhash.xxh3_128_digest(tokens.tobytes())
                s1, s2 = np.frombuffer(sign, np.int64).tolist()
                rows.append((doc_id, len(tokens), s1, s2, hub_keys(tokens), prefix(tokens, percent, common).view(np.int64).copy()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "s1", "s2", "hub_keys", "prefix"])

    return run


def _tokens(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            for text in frame["text"].tolist():
                yield pd.DataFrame({"token": shingles(text, n, hashes).view(np.int64)})

    return run


def _verify(n: int, percent: int):
    """Rows (a, b, a_text, b_text), equal a and a_text side by side: the pairs that reach the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            a, b, texts = frame["a"].tolist(), frame["b"].tolist(), frame["a_text"].tolist()
            out: list[tuple[int, int]] = []
            start = 0
            while start < len(a):
                end = start + 1
                while end < len(a) and a[end] == a[start] and texts[end] == texts[start] and end - start < INDEX_ROWS:
                    end += 1
                query = shingles(texts[start], n, hashes)
                members = [shingles(x, n, hashes) for x in frame["b_text"].iloc[start:end]]
                out += [(a[start], b[start + i]) for i in search(query, members, percent)]
                start = end
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def common_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of n-grams found in several documents of the ordering sample, the commonest ORDER_TOKENS."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(ORDER_SAMPLE)) == 0).select("text")
    counts = some.mapInPandas(_tokens(n), "token long").groupBy("token").count().where(F.col("count") >= ORDER_MIN)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        got = counts.orderBy(F.desc("count"), "token").limit(ORDER_TOKENS).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows of ``docs`` with these ids. The ids are broadcast only if they are few enough."""
    own = docs.select(F.col("doc_id").alias("id"), "text")
    return own.join(_small(ids), "id", "left_semi")


def _links(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The candidate ``pairs`` (a, b of ids) that are links, verified on the texts; written."""
    pairs = save(pairs, "pairs")
    ids = save(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    texts = save(_texts(docs, ids).dropDuplicates(["id", "text"]), "pair-texts")
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    # A doc_id that repeats with other texts has a run for each of them.
    rows = rows.select("a", "b", "a_text", "b_text", F.xxhash64("a_text").alias("a_hash")).sortWithinPartitions("a", "a_hash").drop("a_hash")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return save(rows.mapInPandas(_verify(n, percent), "a long, b long"), "pair-links")


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a saved table of ids), broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _enough_in_common(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough tokens for a link.

    Tokens in common outside the prefixes number at most ceil(percent * n / 100) - 1
    of the larger set; the rest of the required overlap must be in both prefixes.
    """
    ids = save(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "list-ids")
    own = nodes.join(_small(ids), "node", "left_semi")
    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("prefix").alias("p" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    outside = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    enough = (F.size(F.array_intersect("pa", "pb")) + outside) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return both.where(enough).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id must be an integer).

    Two documents link when 100 * |intersection| >= percent * |union| of their
    n-gram sets; component_id is the smallest doc_id reachable. Texts without
    words (null and empty included) have empty sets and link with nothing.
    Rows of one doc_id are one document, linked with each other through it; rows
    of a null doc_id link with nothing and get a null component_id. Only doc_id
    and text are read. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = common_tokens(docs, n)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # null ids would turn integers into floats in pandas
    sketch = rows.mapInPandas(_sketch(n, percent, common), "doc_id string, n long, s1 long, s2 long, hub_keys array<long>, prefix array<long>")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        sketch = save(sketch.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
    known = sketch.where("doc_id IS NOT NULL AND n > 0")
    node_of = save(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "nodes")
    # One row per node: the row that carries its smallest doc_id.
    nodes = known.join(node_of.select("s1", "s2", F.col("node").alias("doc_id")), ["s1", "s2", "doc_id"]).dropDuplicates(["s1", "s2"])
    nodes = save(nodes.select(F.col("doc_id").alias("node"), "n", "hub_keys", "prefix"), "node-sketches")

    keyed = nodes.select("node", F.explode("hub_keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    stars = keyed.join(hubs, "key").where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _links(docs, stars, n, percent)
    first = components(links)

    # Nodes of no hub link are components of their own.
    placed = nodes.select("node", "n", "prefix").join(_small(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    posting = placed.select("node", F.col("n").cast("int").alias("n"), "component", F.posexplode("prefix").alias("pos", "token"))
    shared = save(posting.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token"), "shared-tokens")
    active = save(posting.join(_small(shared), "token", "left_semi"), "lists")
    a, b = active.alias("a"), active.alias("b")
    met = (F.col("a.component") != F.col("b.component")) & (F.col("a.node") < F.col("b.node")) & _near_size(F.col("a.n"), F.col("b.n"), percent)
    # The first common token of a link leaves room for the required overlap on both sides.
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & met & room).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    pairs = _enough_in_common(save(pairs, "list-pairs"), nodes, percent)
    # Nodes of one doc_id belong together.
    same = known.select("doc_id", "s1", "s2").join(node_of, ["s1", "s2"]).groupBy("doc_id").agg(F.collect_set("node").alias("of")).where(F.size("of") > 1)
    same = same.select(F.array_min("of").alias("a"), F.explode("of").alias("b")).where("a < b")
    links = links.unionByName(_links(docs, pairs, n, percent)).unionByName(same)

    groups = components(links)
    of_set = node_of.join(groups, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    out = sketch.select("doc_id", "n", "s1", "s2").join(of_set, ["s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id.

    All columns stay as they are. Rows of a null doc_id stay. Of rows that repeat
    one doc_id every row stays or goes with the document.
    """
    groups = jaccard_components(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    gone = save(groups.select(F.col("doc_id").alias("gone_id")), "near-copies")
    side = _small(gone)
    return docs.join(side, docs["doc_id"] == side["gone_id"], "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), n=4, percent=85)
