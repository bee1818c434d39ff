"""Operator 4: language ID by a byte convolutional network.

Texts are cut into fixed windows of bytes, the last one padded with zeros.
Filters of several widths run over byte embeddings; the maximum of each over the
window goes to a softmax over the learned languages. A text's answer is the mean
over all its windows, weighted by their bytes. Trained in numpy on the driver
from a bounded sample; applied to batches of windows inside Spark tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.llm.common import id_remainder, read

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
# About this many documents of each language at most are fitted on, chosen by a hash of the text (copies count
# once), and this many windows of each.
MAX_TRAIN = 600
TRAIN_WINDOWS = 4
RARE = 0.25
EPOCHS, BATCH, RATE = 12, 64, 0.004
# Windows scored in one numpy step; documents cut into windows in one step.
STEP_WINDOWS = 32
STEP_ROWS = 128
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter by Unicode's general category."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text's bytes, one a row, and the bytes in each."""
    n = max(1, -(-len(raw) // WINDOW))
    rows = np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)
    sizes = np.full(n, WINDOW)
    sizes[-1] = max(1, len(raw) - (n - 1) * WINDOW)
    return rows, sizes


class ByteNet:
    """Embedding, filters of WIDTHS, max pooling and softmax. All filters are stored at the largest width."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.span = labels, max(WIDTHS)
        total = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.span, EMBED, total), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.params = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (self.span, EMBED, total)).astype(np.float32) * self.mask,
            "bias": np.zeros(total, np.float32),
            "out": rng.normal(0, 0.1, (total, len(labels))).astype(np.float32),
            "out_bias": np.zeros(len(labels), np.float32),
        }

    def tables(self) -> np.ndarray:
        """What each byte adds to every filter at each offset: (offset, byte, filter)."""
        p = self.params
        return np.einsum("be,sef->sbf", p["embed"], p["filters"]).astype(np.float32)

    def activations(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Filter outputs at every position of every window: (window, position, filter)."""
        n = rows.shape[1] - self.span + 1
        out = tables[0].take(rows[:, :n], axis=0)
        for s in range(1, self.span):
            out += tables[s].take(rows[:, s : s + n], axis=0)
        return out

    def head(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.params["bias"], 0) @ self.params["out"] + self.params["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Class probabilities of each window."""
        steps = [self.activations(rows[i : i + STEP_WINDOWS], tables).max(1) for i in range(0, len(rows), STEP_WINDOWS)]
        return self.head(np.concatenate(steps))

    def gradients(self, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy; only each filter's winning position passes any back."""
        p = self.params
        act = self.activations(rows, self.tables())
        where = act.argmax(1)
        pooled = np.take_along_axis(act, where[:, None, :], 1)[:, 0] + p["bias"]
        hidden = np.maximum(pooled, 0)
        z = hidden @ p["out"] + p["out_bias"]
        prob = np.exp(z - z.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        dz = (prob - np.eye(len(self.labels), dtype=np.float32)[y]) / len(y)
        dh = (dz @ p["out"].T) * (pooled > 0)
        seen = rows[np.arange(len(rows))[:, None, None], where[:, :, None] + np.arange(self.span)]
        emb = p["embed"][seen]
        d_filters = np.einsum("bf,bfse->sef", dh, emb) * self.mask
        d_emb = np.einsum("bf,sef->bfse", dh, p["filters"])
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, seen.ravel(), d_emb.reshape(-1, EMBED))
        return {"embed": d_embed, "filters": d_filters, "bias": dh.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum(0)}

    def fit(self, rows: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        """Adam over shuffled windows; each is cut at a random length half of the time, so that short texts are learned too."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.params.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                cut = np.where(rng.random(len(pick)) < 0.5, rng.integers(8, WINDOW, len(pick)), WINDOW)
                part = np.where(np.arange(WINDOW) < cut[:, None], rows[pick], 0).astype(np.uint8)
                t += 1
                for k, g in self.gradients(part, y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.params[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def sampled(docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(lang, h, text) of the ``most`` distinct texts of smallest hash of each language; all of a language that has fewer.

    Copies of a text count once. A rough count of distinct texts gives each
    language a bound below which some 2 * ``most`` of their hashes lie; only
    these are told apart exactly. Bounds are whole numbers of 63 bits, so no
    language is too large to be drawn from.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)).alias("h"), "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return known
    bound = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(2**63 - 1 if n <= 2 * most else (2**63 - 1) * 2 * most // n))])
    near = known.where(F.col("h") <= bound[F.col("lang")])
    chosen = near.select("lang", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= most).drop("place")
    # At most ``most`` rows a language.
    chosen = F.broadcast(chosen.withColumnsRenamed({"lang": "of", "h": "at"}))
    return near.join(chosen, (F.col("lang") == F.col("of")) & (F.col("h") == F.col("at"))).drop("of", "at")


def train(docs: DataFrame, most: int = MAX_TRAIN) -> ByteNet | None:
    """A net learned from (text, lang) of at most ``most`` distinct texts of each language; None without labelled text.

    Of a text TRAIN_WINDOWS windows are read, one from each equal part of the
    whole of it at a place drawn by its hash, all of it if it is shorter.
    """
    some = sampled(docs, most)
    size = F.length("text")
    place = lambda j: F.greatest(F.floor(size * (j + F.pmod(F.xxhash64("h", F.lit(j)), F.lit(1000)) / 1000) / TRAIN_WINDOWS) - WINDOW // 2, F.lit(0)) + 1
    parts = F.when(size <= WINDOW, F.array("text")).otherwise(F.array(*[F.substr("text", place(j).cast("int"), F.lit(WINDOW)) for j in range(TRAIN_WINDOWS)]))
    rows, y, labels = [], [], []
    for r in sorted(some.select("lang", "h", parts.alias("parts")).dropDuplicates(["lang", "h"]).collect()):
        labels += [r["lang"]] * (r["lang"] not in labels)
        cut = [windows(p.encode("utf-8", "replace"))[0][:1] for p in r["parts"] if has_letter(p)]
        rows += cut
        y += [labels.index(r["lang"])] * len(cut)
    if not labels:
        return None
    net = ByteNet(labels)
    if rows:
        y, seen = np.array(y), np.bincount(y, minlength=len(labels))
        # A language of few texts is read several times over, so that it has RARE of the windows of the largest one.
        again = np.maximum(1, np.ceil(RARE * seen.max() / np.maximum(seen, 1)).astype(int))[y]
        net.fit(np.repeat(np.concatenate(rows), again, axis=0), np.repeat(y, again))
    return net


def _answers(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                texts = part.column(1).to_pylist()
                best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                todo = [i for i, t in enumerate(texts) if net and has_letter(t)]
                if todo:
                    cut = [windows(texts[i].encode("utf-8", "replace")) for i in todo]
                    prob = net.predict(np.concatenate([c for c, _ in cut]), tables)
                    size = np.concatenate([s for _, s in cut]).astype(float)
                    starts = np.cumsum([0, *[len(s) for _, s in cut][:-1]])
                    mean = np.add.reduceat(prob * size[:, None], starts) / np.add.reduceat(size, starts)[:, None]
                    for i, m in zip(todo, mean):
                        best[i], score[i] = net.labels[int(m.argmax())], float(min(1.0, m.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Every row of ``docs`` (extra columns in the struct ``row``) with lang_pred and score of its whole text.

    Null texts and texts without a letter, and all texts where nothing was
    learned, give ``und`` with score 0.
    """
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), "text")
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_answers(net), f"row {kind}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 4 is not 2 and predicts all."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    net = train(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), net).select("row.doc_id", "row.held_out", "lang_pred", "score")
