"""Operator 12: toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are word beginnings (whole words among them) that labelled toxic texts use
more often than chance allows; a text's other words together are one background
term, so that a text full of a term is told from a long one that holds it once.
Inverse document frequencies are counted over all documents. The labelled
examples form an inverted index cut into blocks, each term keeping its largest
weight in every block. A text visits blocks by their upper bound and stops at
the first that cannot hold a nearer example, so its neighbours are exact. Their
distance-weighted votes are turned into probabilities by an isotonic fit to the
votes that the examples get from each other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import id_remainder, read, save

# At most this many labelled rows are examples, those of smallest id hash, and this many word beginnings are terms.
MAX_EXAMPLES = 20_000
MAX_TERMS = 4096
# Characters of a word beginning; shorter words are no terms.
SHORTEST, LONGEST = 3, 12
# Toxic examples, in so many different word contexts, that a term needs at least, and how far its share must exceed that of all.
MIN_SUPPORT = 4
LIFT = 2.0
# Log-likelihood ratio that a term needs beyond twice the logarithm of the number of beginnings tried.
MARGIN = 4.0
# Uses of a term in one text that count when terms are chosen.
MOST_USES = 5
CONTEXTS = 63
# Other words that weigh as much as one use of a term of idf 1.
BACKGROUND = 20.0
NEIGHBOURS = 15
BLOCK = 64
# Added to a neighbour's distance before its vote is weighted by the inverse.
SOFTEN = 0.05
THRESHOLD = 0.7
BATCH_ROWS = 512
# Beginnings and words that a task holds before it hands on or forgets them.
HELD_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The lower-case runs of letters of a text."""
    return WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    """The beginnings of a word that can be terms, the word itself among them if it is short enough."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


def _uses(text: str | None) -> tuple[Counter, dict[str, int]]:
    """How often a text uses each beginning, at most MOST_USES times, and a bit for the hash of each word before it."""
    uses: Counter = Counter()
    contexts: dict[str, int] = {}
    last = ""
    for word in words(text):
        bit = 1 << zlib.crc32(last.encode()) % CONTEXTS
        for start in beginnings(word):
            uses[start] += 1
            contexts[start] = contexts.get(start, 0) | bit
        last = word
    return Counter({k: min(n, MOST_USES) for k, n in uses.items()}), contexts


def _toxic_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, uses, texts, contexts) summed over the toxic texts of a task."""
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        cols = [pa.array([v[k] for v in held.values()], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *cols], ["start", "uses", "texts", "contexts"])

    for batch in batches:
        for text in batch.column(0):
            uses, contexts = _uses(text.as_py())
            for start, n in uses.items():
                entry = held.setdefault(start, [0, 0, 0])
                entry[0] += n
                entry[1] += 1
                entry[2] |= contexts[start]
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def _clean_uses(tried: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tried), np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = Counter(tried[b] for w, n in Counter(words(text.as_py())).items() for b in beginnings(w) if b in tried for _ in range(min(n, MOST_USES)))
                for i, n in found.items():
                    total[i] += min(n, MOST_USES)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["i", "uses"])

    return run


def choose_terms(tried: list[tuple[str, int, int]], share: float) -> list[str]:
    """The terms among ``tried`` (start, uses in toxic texts, uses in clean ones), strongest first; none begins with another.

    ``share`` is that of toxic texts. The strength is the log-likelihood ratio
    of the uses against that share; of beginnings as strong the longer is taken.
    """

    def strength(a: int, c: int) -> float:
        part = lambda x, p: x * math.log(x / ((a + c) * p)) if x else 0.0
        return round(2 * (part(a, share) + part(c, 1 - share)), 9)

    least = 2 * math.log(max(len(tried), 1)) + MARGIN
    strong = [(strength(a, c), start) for start, a, c in tried if a >= LIFT * share * (a + c)]
    chosen: list[str] = []
    known, inner = set(), set()
    for g, start in sorted(strong, key=lambda x: (-x[0], -len(x[1]), x[1])):
        if g >= least and start not in inner and not known.intersection(beginnings(start)) and len(chosen) < MAX_TERMS:
            chosen.append(start)
            known.add(start)
            inner.update(beginnings(start))
    return chosen


def select_terms(examples: DataFrame) -> list[str]:
    """The terms of ``examples`` (text, y), strongest first.

    A beginning is tried if it stands in MIN_SUPPORT toxic texts and after as
    many different words in them, so that a passage copied many times does not
    make its words terms. What is collected is bounded by the examples.
    """
    n = examples.agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    if not 0 < n["toxic"] < n["all"]:
        return []
    toxic = examples.where("y = 1").select("text").mapInArrow(_toxic_uses, "start string, uses long, texts long, contexts long")
    toxic = toxic.groupBy("start").agg(F.sum("uses").alias("uses"), F.sum("texts").alias("texts"), F.bit_or("contexts").alias("contexts"))
    toxic = toxic.where((F.col("texts") >= MIN_SUPPORT) & (F.bit_count("contexts") >= MIN_SUPPORT)).select("start", "uses").orderBy("start").collect()
    clean = examples.where("y = 0").select("text").mapInArrow(_clean_uses({r["start"]: i for i, r in enumerate(toxic)}), "i int, uses long")
    uses = {r["i"]: r["uses"] for r in clean.groupBy("i").agg(F.sum("uses").alias("uses")).collect()}
    return choose_terms([(r["start"], r["uses"], uses.get(i, 0)) for i, r in enumerate(toxic)], n["toxic"] / n["all"])


class Neighbour(NamedTuple):
    entry: int
    cosine: float


class BlockMaxIndex:
    """Inverted lists over unit vectors, with each term's largest weight in every block of entries.

    An entry stands for ``sizes`` examples of one vector.
    """

    def __init__(self, vectors: list[dict[int, float]], sizes: list[int] | None = None, block: int = BLOCK) -> None:
        self.block = block
        self.blocks = -(-len(vectors) // block)
        self.sizes = sizes or [1] * len(vectors)
        lists: dict[int, tuple[list[int], list[float]]] = {}
        for i, vector in enumerate(vectors):
            for term, weight in vector.items():
                ids, weights = lists.setdefault(term, ([], []))
                ids.append(i)
                weights.append(weight)
        self.lists = {}
        for term, (own, weighing) in lists.items():
            ids, weights = np.array(own), np.array(weighing)
            held, starts = np.unique(ids // block, return_index=True)
            self.lists[term] = (ids, weights, held, np.r_[starts, len(ids)], np.maximum.reduceat(weights, starts))

    def bounds(self, query: dict[int, float]) -> np.ndarray:
        """The most that an entry of each block can score."""
        out = np.zeros(self.blocks)
        for term, weight in query.items():
            if term in self.lists:
                _, _, held, _, most = self.lists[term]
                out[held] += weight * most
        return out

    def _scores(self, query: dict[int, float], b: int) -> np.ndarray:
        """The cosines of a block's entries."""
        scores = np.zeros(self.block)
        for term, weight in query.items():
            if term in self.lists:
                ids, weights, held, starts, _ = self.lists[term]
                at = np.searchsorted(held, b)
                if at < len(held) and held[at] == b:
                    own = slice(starts[at], starts[at + 1])
                    scores[ids[own] - b * self.block] += weight * weights[own]
        return np.round(scores, 12)

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS) -> list[Neighbour]:
        """The entries of highest cosine above 0 that together hold ``k`` examples, ties to the smaller number; all that share a term if they hold fewer."""
        bounds = np.round(self.bounds(query) + 1e-9, 12)
        order = np.lexsort((np.arange(self.blocks), -bounds))
        best: list[tuple[float, int]] = []
        held = 0
        for b in order[: np.count_nonzero(bounds > 2e-9)].tolist():
            if held >= k and (-bounds[b], b * self.block) >= best[-1]:
                break
            scores = self._scores(query, b)
            best, found, held = [], sorted([*best, *((-scores[j], b * self.block + j) for j in np.flatnonzero(scores).tolist())]), 0
            for one in found:
                if held >= k:
                    break
                best.append(one)
                held += self.sizes[one[1]]
        return [Neighbour(i, float(-s)) for s, i in best]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least ``x`` and smoothed mean of ``y`` of each step of the ascending step function nearest to the weighted points."""
    steps: list[list[float]] = []
    for value in np.unique(x):
        own = x == value
        steps.append([value, float(y[own] @ weight[own]), float(weight[own].sum())])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, total, n = steps.pop()
            steps[-1][1] += total
            steps[-1][2] += n
    level = np.array([(total + 1) / (n + 2) for _, total, n in steps])
    return np.array([s[0] for s in steps]), np.maximum.accumulate(level) if len(level) else level


class Model:
    """Terms' weights, the examples' index, and the map from votes to probabilities."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, list[int], list[int], int, int]]) -> None:
        """``examples`` are (doc_id, terms, counts, other words, y)."""
        self.idf = idf
        entries: dict[tuple, list[tuple[int, int]]] = {}
        for doc_id, terms, counts, others, y in examples:
            entries.setdefault(tuple(self.vector(terms, counts, others).items()), []).append((doc_id, y))
        # Entries of like terms share blocks, which keeps the blocks' bounds close.
        keys = sorted(entries, key=lambda v: [(t, w) for t, w in sorted(v, key=lambda tw: (tw[0] < 0, -tw[1]))])
        self.vectors = [dict(k) for k in keys]
        self.ids = [min(entries[k])[0] for k in keys]
        self.sizes = [len(entries[k]) for k in keys]
        self.toxic = [sum(y for _, y in entries[k]) for k in keys]
        self.index = BlockMaxIndex(self.vectors, self.sizes)
        blank = [(n, t) for v, n, t in zip(self.vectors, self.sizes, self.toxic) if not v or set(v) == {-1}]
        share = sum(self.toxic) / sum(self.sizes) if self.sizes else 0.0
        self.blank = (sum(t for _, t in blank) + share) / (sum(n for n, _ in blank) + 1)
        x, y, weight = [], [], []
        for i, vector in enumerate(self.vectors):
            near = self.index.nearest(vector, NEIGHBOURS + 1) if vector else []
            for label, n in ((1, self.toxic[i]), (0, self.sizes[i] - self.toxic[i])):
                if n and (vote := self.vote(near, (i, label))) is not None:
                    x.append(vote)
                    y.append(label)
                    weight.append(n)
        self.steps, self.levels = isotonic(np.array(x), np.array(y, float), np.array(weight, float))

    def vector(self, terms: list[int], counts: list[int], others: int) -> dict[int, float]:
        """Unit TF-IDF vector; the other words are term -1. Texts without words have none."""
        weights = {t: c * float(self.idf[t]) for t, c in zip(terms, counts)} | ({-1: others / BACKGROUND} if others else {})
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: round(w / norm, 12) for t, w in weights.items()}

    def vote(self, near: list[Neighbour], without: tuple[int, int] | None = None) -> float | None:
        """Share of toxic ones among the NEIGHBOURS nearest examples, each weighted by the inverse of its distance.

        Of an entry with more examples than places are left, its share counts.
        ``without`` leaves out one example: its entry and label.
        """
        places, votes, total = NEIGHBOURS, 0.0, 0.0
        for entry, cosine in near:
            n, toxic = self.sizes[entry], self.toxic[entry]
            if without and entry == without[0]:
                n, toxic = n - 1, toxic - without[1]
            if n and places:
                weight = min(n, places) / (1 - min(cosine, 1.0) + SOFTEN)
                places -= min(n, places)
                votes += weight * toxic / n
                total += weight
        return round(votes / total, 9) if total else None

    def score(self, terms: list[int], counts: list[int], others: int) -> tuple[float, list[tuple[int, float, int, int]]]:
        """Probability of being toxic, and the nearest examples that say so: a doc_id, the cosine, how many are like it, how many of them toxic."""
        if not terms:
            return self.blank, []
        near = self.index.nearest(self.vector(terms, counts, others))
        vote = self.vote(near)
        if vote is None:
            return self.blank, []
        at = np.searchsorted(self.steps, vote, "right") - 1
        return float(self.levels[max(at, 0)]), [(self.ids[e], c, self.sizes[e], self.toxic[e]) for e, c in near]


class Stems(dict):
    """The term's number of every word asked for, -1 if it begins with none."""

    def __init__(self, terms: list[str]) -> None:
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
        self[word] = out = next((self.number[b] for b in beginnings(word) if b in self.number), -1)
        return out


def _counter(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                found = [Counter(map(stems.__getitem__, words(t.as_py()))) for t in rows.column(2)]
                others = [f.pop(-1, 0) for f in found]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array([sorted(f) for f in found], pa.list_(pa.int32())),
                    pa.array([[f[t] for t in sorted(f)] for f in found], pa.list_(pa.int32())), pa.array(others, pa.int32()),
                ], ["doc_id", "held_out", "terms", "counts", "others"])

    return run


EVIDENCE = "array<struct<doc_id:long,cosine:double,alike:int,toxic:int>>"


def _scorer(model: Model):
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("alike", pa.int32()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts without terms share their score, texts of equal counts their neighbours.
            known: dict[tuple, tuple] = {}
            out = []
            for terms, counts, others in zip(*(batch.column(c).to_pylist() for c in ("terms", "counts", "others"))):
                key = (tuple(terms), tuple(counts), others if terms else 0)
                if key not in known:
                    known[key] = model.score(*key)
                out.append(known[key])
            near = [[{"doc_id": i, "cosine": c, "alike": n, "toxic": y} for i, c, n, y in e] for _, e in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array(near, evidence)],
                                             ["doc_id", "held_out", "score", "evidence"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and evidence (nearest examples: a doc_id, the cosine, examples alike, toxic ones of them) of every row of ``docs`` (doc_id, text, boolean held_out).

    Learned from rows that are not held out and have a label; a document with
    several labels is toxic if any says so, and rows that repeat its id are
    examples of their own. Null and empty texts and texts without a term need no
    neighbours: their score is the share of toxic examples without a term. Null
    doc_ids are scored and never learned from. Without labels every score is 0.
    Only the named columns are read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    chosen = docs.where("NOT held_out").select("doc_id").distinct().join(marks, "doc_id")
    # At most MAX_EXAMPLES pairs of numbers, so broadcasts of it are bounded.
    chosen = F.broadcast(save(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES), "toxicity-labels"))
    terms = select_terms(docs.where("NOT held_out").join(chosen, "doc_id").select("text", "y"))
    counted = save(docs.mapInArrow(_counter(terms), "doc_id long, held_out boolean, terms array<int>, counts array<int>, others int"), "toxicity-terms")
    df = {r["t"]: r["n"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counted.count()
    idf = np.array([math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in range(len(terms))])
    examples = counted.where("NOT held_out").join(chosen, "doc_id").select("doc_id", "terms", "counts", "others", "y")
    rows = examples.orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "counts", "others").limit(MAX_EXAMPLES).collect()
    model = Model(idf, [tuple(r) for r in rows])
    return counted.mapInArrow(_scorer(model), f"doc_id long, held_out boolean, score double, evidence {EVIDENCE}")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of documents whose crc32(doc_id as text) mod 3 is not 1 and scores all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    out = toxicity_scores(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
