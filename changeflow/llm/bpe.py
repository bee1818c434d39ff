"""Operator 3: byte-level BPE encoding and decoding.

A piece of text is merged on a segment tree over its adjacent pairs: each leaf
holds a pair's rank and position, each node the smaller of its children, so the
root is the leftmost pair of lowest rank. A merge changes three leaves, each
repaired along one path to the root. Distinct short pieces of a batch are merged
together, one tree a row of a numpy array; long pieces get a tree of their own.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from changeflow.llm.common import read

VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the byte-level pre-tokenizer's pattern; white space is Unicode's White_Space.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same pattern spelled out for texts of code points below 256, where the faster engine serves.
LATIN_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
# Pieces of up to this many bytes share a forest; longer ones get their own tree.
FOREST_BYTES = 64
FOREST_ROWS = 4096
# Bounds of a worker's memory: bytes of remembered pieces (each with its ids and some overhead; longer ones
# than FOREST_BYTES are not remembered), and pieces of text in hand.
CACHE_BYTES = 32_000_000
PIECE_OVERHEAD = 250
BLOCK_PIECES = 200_000
BATCH_ROWS = 256
FREE = np.int64(2**62)
SMALL_FREE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = itertools.count(256)
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = np.array([ids[c] for c in symbols], dtype=np.int64)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.base = max(ids.values()) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes.update((i, t.encode()) for t, i in self.special.items())
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.id_texts = [str(i) for i in range(max(self.token_bytes) + 1)]
        self.forget()

    def forget(self) -> None:
        """Forget the remembered pieces."""
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached_bytes = 0

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, FREE where there is none."""
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], FREE)


def _width(n: int) -> int:
    return 1 << max(1, (n - 1).bit_length())


def merge_forest(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
    """Ids of pieces of 1 to ``width`` bytes (a power of two), merged side by side.

    Row r of ``tree`` is the segment tree of piece r; a key is rank * width + position.
    Column ``width`` of the other arrays stands for "no neighbour".
    """
    rows = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int32, rows)
    raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(rows, width)
    ids = np.zeros((rows, width + 1), np.int32)
    ids[:, :width] = vocab.byte_ids[raw]
    column = np.arange(width, dtype=np.int32)
    after = np.full((rows, width + 1), width, np.int32)
    after[:, :width] = np.where(column + 1 < sizes[:, None], column + 1, width)
    before = np.full((rows, width + 1), width, np.int32)
    before[:, 1:width] = column[:-1]
    live = column < sizes[:, None]
    tree = np.full((rows, 2 * width), SMALL_FREE)

    def keys(a: np.ndarray, b: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        rank = vocab.pair_ranks(a.astype(np.int64), b)
        return np.where(there & (rank < FREE), rank * width + at, SMALL_FREE).astype(np.int32)

    tree[:, width : 2 * width - 1] = keys(ids[:, : width - 1], ids[:, 1:width], column[:-1], live[:, 1:])
    for level in range(width.bit_length() - 2, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])

    def put(r: np.ndarray, at: np.ndarray, key: np.ndarray | np.int32) -> None:
        node = at + width
        tree[r, node] = key
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    def repair(r: np.ndarray, at: np.ndarray) -> None:
        right = after[r, at]
        put(r, at, keys(ids[r, at], ids[r, right], at, right < width))

    r = np.flatnonzero(tree[:, 1] < SMALL_FREE)
    while len(r):
        rank, left = np.divmod(tree[r, 1], np.int32(width))
        right = after[r, left]
        beyond = after[r, right]
        ids[r, left] = vocab.merged[rank]
        after[r, left] = beyond
        before[r, beyond] = left
        live[r, right] = False
        put(r, right, SMALL_FREE)
        repair(r, left)
        prior = before[r, left]
        some = np.flatnonzero(prior < width)
        repair(r[some], prior[some])
        r = r[tree[r, 1] < SMALL_FREE]
    flat = ids[:, :width][live].tolist()
    ends = np.cumsum(live.sum(1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


def merge_tree(vocab: Vocabulary, piece: bytes) -> tuple[int, ...]:
    """Ids of one piece of any length, on one segment tree held in flat arrays."""
    n = len(piece)
    width = _width(n)
    symbols = vocab.byte_ids[np.frombuffer(piece, np.uint8)]
    ranks = vocab.pair_ranks(symbols[:-1], symbols[1:])
    leaves = np.full(width, FREE)
    leaves[: n - 1] = np.where(ranks < FREE, ranks * width + np.arange(n - 1), FREE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = array("q", np.concatenate([np.full(1, FREE), *reversed(levels)]).astype(np.int64).tobytes())
    ids = array("q", symbols.astype(np.int64).tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    free, base, rank_of, merged = int(FREE), vocab.base, vocab.rank_of, vocab.merged

    def put(at: int, key: int) -> None:
        node = at + width
        tree[node] = key
        while node := node >> 1:
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best

    def pair_key(at: int) -> int:
        rank = rank_of.get(ids[at] * base + ids[after[at]]) if after[at] < n else None
        return free if rank is None else rank * width + at

    while (top := tree[1]) < free:
        rank, left = divmod(top, width)
        right = after[left]
        ids[left], ids[right] = int(merged[rank]), -1
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        put(right, free)
        put(left, pair_key(left))
        if before[left] >= 0:
            put(before[left], pair_key(before[left]))
    return tuple(i for i in ids if i >= 0)


def merge_pieces(vocab: Vocabulary, pieces: list[str]) -> dict[str, tuple[int, ...]]:
    """Ids of each distinct piece."""
    out: dict[str, tuple[int, ...]] = {}
    forests: dict[int, list[tuple[str, bytes]]] = {}
    for p in pieces:
        raw = p.encode("utf-8")
        if len(raw) > FOREST_BYTES:
            out[p] = merge_tree(vocab, raw)
        else:
            forests.setdefault(_width(len(raw)), []).append((p, raw))
    for width, group in forests.items():
        for i in range(0, len(group), FOREST_ROWS):
            part = group[i : i + FOREST_ROWS]
            out.update(zip((p for p, _ in part), merge_forest(vocab, [raw for _, raw in part], width)))
    return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pattern(text: str) -> re.Pattern | regex.Pattern:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PIECES
    return LATIN_PIECES


def _piece_runs(vocab: Vocabulary, text: str) -> Iterator[list[str | int]]:
    """The pieces of a text in runs of at most BLOCK_PIECES; a special string comes as its id."""
    parts = vocab.split.split(text) if vocab.split and any(s in text for s in vocab.special) else [text]
    for part in parts:
        if part in vocab.special:
            yield [vocab.special[part]]
        elif part:
            pattern = _pattern(part)
            found = (m.group() for m in pattern.finditer(part)) if len(part) > BLOCK_PIECES else iter(pattern.findall(part))
            while run := list(itertools.islice(found, BLOCK_PIECES)):
                yield run


def encode_texts(vocab: Vocabulary, texts: list[str | None]) -> Iterator[list[int]]:
    """The ids of each text, in order. Distinct new pieces of a block are merged together."""
    block: list[tuple[int, list]] = []
    done: dict[int, list[int]] = {}
    held = turn = 0

    def flush() -> None:
        if vocab.cached_bytes > CACHE_BYTES:
            vocab.forget()
        cache = vocab.cache
        new = {p for _, run in block for p in run if p.__class__ is str and p not in cache}
        merged = merge_pieces(vocab, list(new))
        cache.update(merged)
        for i, run in block:
            if run and run[0].__class__ is int:
                done[i].extend(run)
            else:
                done[i].extend(itertools.chain.from_iterable(map(cache.__getitem__, run)))
        block.clear()
        for piece, ids in merged.items():
            if len(piece) > FOREST_BYTES:
                del cache[piece]
            else:
                vocab.cached_bytes += PIECE_OVERHEAD + len(piece) + 8 * len(ids)

    for i, text in enumerate(texts):
        done[i] = []
        for run in _piece_runs(vocab, text or ""):
            block.append((i, run))
            held += len(run)
            if held >= BLOCK_PIECES:
                flush()
                held = 0
                while turn < i:
                    yield done.pop(turn)
                    turn += 1
    flush()
    while turn < len(texts):
        yield done.pop(turn)
        turn += 1


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of ids: their bytes joined and read as UTF-8; ids outside the vocabulary give nothing."""
    known = vocab.token_bytes
    try:
        found = list(map(known.__getitem__, ids))
    except KeyError:
        found = [known.get(i, b"") for i in ids]
    return b"".join(found).decode("utf-8", "replace")


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = pa.array(list(encode_texts(vocab, part.column(1).to_pylist())), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return run


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [decode_ids(vocab, x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _digest_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                sizes, shas, decoded = [], [], []
                for ids in encode_texts(vocab, part.column(1).to_pylist()):
                    sizes.append(len(ids))
                    shas.append(hashlib.sha256(",".join(map(vocab.id_texts.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(vocab, ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        vocab.forget()

    return run


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``, by the vocabulary file at ``path``.

    Null and empty texts give no ids. Every row is encoded whole and on its own,
    so null or repeated doc_ids, extra columns and empty tables need no special
    case. ``path`` must be readable on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode_batches(path or vocabulary_path()), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (string) of every row of an ``encode`` result; null ids give the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches(path or vocabulary_path()), f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; rows as in ``encode``.

    One pass: a task encodes its texts, decodes the ids and keeps only digests,
    so neither ids nor decoded texts leave the worker.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_digest_batches(path or vocabulary_path()), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return digests(read(spark, sf_dir, "documents"))
