"""Operator 1: HTML extraction with a recurrent block labeller.

A page is a sequence of leaf blocks. A bidirectional LSTM in numpy reads one
vector a block (hashed words of its tag path, hashed words of its text, a few
proportions) in both directions and labels each block as main text or not with
the whole page as context. It is trained on the driver: on a bounded sample of
pages, labelled where their markup names its parts, and on pages composed from
the sample's sentences in layouts whose parts are known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import read
from changeflow.llm.html_blocks import Block, blocks

PATH_DIM, WORD_DIM, SHAPE_DIM = 256, 32, 7
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM
HIDDEN = 20
# Pages looked at for fitting, whole: those of smallest hash among pages of at most so many characters, copies once; composed pages.
MAX_PAGES = 120
MAX_PAGE_CHARS = 60_000
COMPOSED = 450
EPOCHS, BATCH, RATE = 9, 12, 0.01
# Blocks labelled in one numpy step, padding included.
STEP_BLOCKS = 4096

# Words by which pages name their parts, for labels and layouts.
MAIN_NAMES = ["content", "post", "entry", "article", "story", "main", "body", "text"]
OTHER_NAMES = [
    "nav", "menu", "navbar", "breadcrumb", "header", "masthead", "topbar", "footer", "copyright", "legal", "sidebar", "widget", "related", "recommended",
    "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter",
    "subscribe", "signup", "login", "search", "share", "social", "comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "tags", "pagination",
]
OTHER_TAGS = ["nav", "header", "footer", "aside", "form"]


class Features:
    """Block vectors; path vectors and word places are remembered."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[tuple[str, ...], ...]) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            got = np.zeros(PATH_DIM, np.float32)
            names = [n for element in path for n in element]
            for n in [*names, "last:" + path[-1][0]] if path else names:
                h = zlib.crc32(n.encode())
                got[h % PATH_DIM] += 1
                got[(h >> 16) % PATH_DIM] += 1
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = got = np.minimum(got, 3)
        return got

    def page(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), INPUT), np.float32)
        for i, b in enumerate(page):
            found = b.text.split()
            if len(self.words) > 200_000:
                self.words.clear()
            for w in found:
                if w not in self.words:
                    self.words[w] = zlib.crc32(w.lower().encode()) % WORD_DIM
            out[i, :PATH_DIM] = self.path(b.path)
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([self.words[w] for w in found], minlength=WORD_DIM) / max(4, len(found))
            n = len(b.text)
            marks = sum(map(b.text.count, ".,;!?"))
            out[i, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 8, np.log1p(len(found)) / 6, b.linked, min(1.0, 10 * marks / n), i / len(page), len(b.path) / 10, 1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs, one read backwards, and a logistic output. Batches are (block, page, input) with a mask."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.params: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.params["x" + way] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.params["h" + way] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        gates = x @ self.params["x" + way]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            z = gates[t] + h @ self.params["h" + way]
            i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN] + 1), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            c_new = (f * c + i * g) * on + c * (1 - on)
            th = np.tanh(c_new)
            h_new = o * th * on + h * (1 - on)
            trace.append((t, h, c, i, f, o, g, th, on))
            h, c = h_new, c_new
            out[t] = h
        return out, trace

    def _back(self, x: np.ndarray, d_out: np.ndarray, trace: list, way: str) -> tuple[np.ndarray, np.ndarray]:
        d_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_w = np.zeros_like(self.params["h" + way])
        dh = np.zeros_like(trace[0][1])
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, th, on in reversed(trace):
            dh = dh + d_out[t]
            d_cell = dc + dh * o * (1 - th * th) * on
            dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), dh * th * o * (1 - o), d_cell * i * (1 - g * g)], 1) * on
            d_gates[t] = dz
            d_w += h.T @ dz
            dc = d_cell * f * on + dc * (1 - on)
            dh = dz @ self.params["h" + way].T + dh * (1 - on)
        return x.reshape(-1, INPUT).T @ d_gates.reshape(-1, 4 * HIDDEN), d_w

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._read(x, mask, w)[0] for w in "fb"], 2)
        return sigmoid(both @ self.params["out"] + self.params["out_bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        read_ = {w: self._read(x, mask, w) for w in "fb"}
        both = np.concatenate([read_[w][0] for w in "fb"], 2)
        d = (sigmoid(both @ self.params["out"] + self.params["out_bias"]) - y) * mask / max(1.0, mask.sum())
        grads = {"out": np.tensordot(d, both, ([0, 1], [0, 1])), "out_bias": d.sum().reshape(1)}
        d_both = d[:, :, None] * self.params["out"]
        for w, part in zip("fb", (d_both[:, :, :HIDDEN], d_both[:, :, HIDDEN:])):
            grads["x" + w], grads["h" + w] = self._back(x, part, read_[w][1], w)
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.params.items()}
        t = 0
        for _ in range(EPOCHS):
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]) // 8)
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for k in rng.permutation(len(batches)):
                x, mask = pad([pages[i][0] for i in batches[k]])
                y = np.zeros_like(mask)
                for j, i in enumerate(batches[k]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                t += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v2[name] = 0.99 * v2[name] + 0.01 * g * g
                    self.params[name] -= (RATE * (m[name] / (1 - 0.9**t)) / (np.sqrt(v2[name] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages side by side: (block, page, input), and the mask of real blocks."""
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), INPUT), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


def named_labels(page: list[Block]) -> list[int] | None:
    """Labels where the markup names its main part: blocks inside article or main and no part named otherwise. None elsewhere."""
    inside = [any(e[0] in ("article", "main") for e in b.path) for b in page]
    if not any(inside):
        return None
    other = set(OTHER_NAMES)
    return [int(a and not any(e[0] in OTHER_TAGS or other & set(e[1:]) for e in b.path)) for a, b in zip(inside, page)]


def compose(rng: np.random.Generator, sentences: list[str]) -> tuple[str, list[int]]:
    """A page in a random layout, made of ``sentences``, and the label of each of its blocks."""
    out: list[str] = []
    labels: list[int] = []
    pick = lambda x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    words = lambda n: " ".join(pick(sentences).split()[:n]) or "x"

    def leaf(tag: str, text: str, label: int) -> None:
        out.append(f"<{tag}>{text}</{tag}>")
        labels.append(label)

    def other(name: str | None = None) -> None:
        name = name or pick(OTHER_NAMES)
        tag = name if name in OTHER_TAGS and chance(0.7) else pick(["div", "section", "aside", "ul", "form"]) if chance(0.5) else "div"
        key = pick(["class", "id"])
        out.append(f"<{tag}>" if tag == name and chance(0.6) else f'<{tag} {key}="{name}{pick(["", "-box", " wrap", "_area", "-list"])}">')
        comment = name in ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond")
        for _ in range(int(rng.integers(1, 7))):
            if tag in ("ul", "nav") or name in ("menu", "navbar", "nav", "breadcrumb", "pagination", "tags"):
                leaf("li", f'<a href="/x">{words(int(rng.integers(1, 4)))}</a>', 0)
            elif name in ("header", "masthead", "topbar", "banner") and chance(0.5):
                leaf(pick(["h1", "h2"]), words(int(rng.integers(1, 6))), 0)
            elif comment or chance(0.3):
                leaf(pick(["p", "div"]), " ".join(pick(sentences) for _ in range(int(rng.integers(1, 4)))), 0)
            else:
                leaf(pick(["p", "div", "h3", "li"]), words(int(rng.integers(2, 14))), 0)
        out.append(f"</{tag}>")

    out.append("<body>")
    for name in ("header", "nav", "menu", "cookie", "notice", "ad", "breadcrumb"):
        if chance(0.45):
            other(name)
    wrap = pick(["article", "main", "div", "section"])
    if wrap in ("div", "section"):
        out.append(f'<{wrap} {pick(["class", "id"])}="{pick(MAIN_NAMES)}{pick(["", "-body", "-content", " page"])}">')
    else:
        out.append(f"<{wrap}>" if chance(0.6) else f'<{wrap} class="{pick(MAIN_NAMES)}">')
    if chance(0.8):
        leaf("h1", words(int(rng.integers(3, 14))), 1)
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.72:
            leaf("p", " ".join(pick(sentences) for _ in range(int(rng.integers(1, 6)))), 1)
        elif kind < 0.8:
            leaf(pick(["h2", "h3"]), words(int(rng.integers(2, 9))), 1)
        elif kind < 0.84:
            leaf(pick(["blockquote", "li", "pre", "td"]), words(int(rng.integers(3, 20))), 1)
        elif kind < 0.88:
            leaf("p", words(int(rng.integers(1, 4))), 1)
        else:
            other(pick(["ad", "related", "share", "newsletter", "promo", "sponsored", "subscribe"]))
    if chance(0.25):
        other(pick(["comments", "comment", "tags", "share", "replies"]))
    if chance(0.88):
        out.append(f"</{wrap}>")
        for name in ("comments", "related", "sidebar", "newsletter", "form", "login", "ads", "disqus", "footer", "footer"):
            if chance(0.35):
                other(name)
        if chance(0.4):
            out.append("<footer>")
            labels.append(0)
            out.append(f"&copy; {words(int(rng.integers(2, 14)))}</footer>")
    return "".join(out), labels


def train(pages: DataFrame) -> BiLstm:
    """A labeller for ``pages`` (html), fitted on a bounded sample and on pages composed from its sentences.

    The sample is the MAX_PAGES distinct pages of smallest hash among those of
    at most MAX_PAGE_CHARS characters, read whole. A rough count of them bounds
    the hashes that are sorted; the bound is a whole number of 63 bits, so no
    table is too large to be drawn from.
    """
    known = pages.where(F.length("html") <= MAX_PAGE_CHARS).select(F.xxhash64("html").bitwiseAND(F.lit(2**63 - 1)).alias("h"), "html")
    n = known.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    bound = 2**63 - 1 if n <= 2 * MAX_PAGES else (2**63 - 1) * 2 * MAX_PAGES // n
    some = known.where(F.col("h") <= bound).dropDuplicates(["h"]).orderBy("h").limit(MAX_PAGES).select("html")
    made = Features()
    data, sentences = [], []
    for row in sorted(some.collect()):
        page = list(blocks(row["html"]))
        sentences += [s for b in page for s in (b.text[:2000].split(". ")) if len(s) > 20]
        labels = named_labels(page)
        if labels:
            data.append((made.page(page), np.array(labels, np.float32)))
    sentences = [s.replace("&", "and").replace("<", " ") for s in sentences] or ["A sentence of some words."]
    rng = np.random.default_rng(9)
    for _ in range(COMPOSED):
        page, labels = compose(rng, sentences)
        got = list(blocks(page))
        if len(got) == len(labels):
            data.append((made.page(got), np.array(labels, np.float32)))
    model = BiLstm()
    model.fit(data)
    return model


def label(model: BiLstm, pages: list[list[Block]], made: Features) -> list[np.ndarray]:
    """Main-text probability of every block of each page. Pages of like length are read together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        take = 1
        while take < len(order) and (take + 1) * len(pages[order[take]]) <= STEP_BLOCKS:
            take += 1
        now, order = order[:take], order[take:]
        x, mask = pad([made.page(pages[i]) for i in now])
        got = model.predict(x, mask)
        for j, i in enumerate(now):
            out[i] = got[: len(pages[i]), j]
    return out


def _extract(model: BiLstm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                pages = [list(blocks(h)) for h in part.column(1).to_pylist()]
                marks = label(model, pages, made)
                kept = [[b.text for b, p in zip(page, m) if p >= 0.5] for page, m in zip(pages, marks)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.list_(pa.string()))], names=["row", "blocks"])

    return run


def main_blocks(pages: DataFrame, model: BiLstm) -> DataFrame:
    """Every row of ``pages``: its columns but html in the struct ``row``, and the texts of its main blocks in page order.

    Null and empty pages, and pages without main text, give an empty list. Rows
    are read on their own, so nulls elsewhere and repeated rows need no care.
    """
    packed = pages.select(F.struct(*[c for c in pages.columns if c != "html"]).alias("row"), "html")
    return packed.mapInArrow(_extract(model), f"row {packed.schema['row'].dataType.simpleString()}, blocks array<string>")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = F.array_join("blocks", " ")
    return main_blocks(pages, train(pages)).select("row.page_id", "row.url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
