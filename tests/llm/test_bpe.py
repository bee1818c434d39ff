import hashlib
import random

import pytest
import tokenizers

from changeflow.llm import bpe as B
from .llm_fixtures import SF_SMALL


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.vocabulary_path())


@pytest.fixture(scope="module")
def vocab():
    return B.load(B.vocabulary_path())


def test_same_ids_as_the_library(library, vocab):
    rng = random.Random(1)
    texts = ["", None, "a<|endoftext|>b", " <|endoftext|><|endoftext|>", "a" * 3000, "ab" * 700 + " " * 500 + "\n\n  x", "x\x1c\x1d y'll 'S we're"]
    texts += ["a" + chr(c) + chr(c) + " b " + chr(c) + "1" for c in range(0x3200)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(rng.choice(points)) for _ in range(30)) for _ in range(1000)]
    parts = ["a", "b", " ", "\n", "é", "1", "'", "s", "!", "the", "ing", "\t", " ", "日本"]
    texts += ["".join(rng.choice(parts) for _ in range(60)) for _ in range(1000)]
    for text, ids in zip(texts, B.encode_texts(vocab, texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == want, repr(text)
        assert B.decode_ids(vocab, ids) == library.decode(want, skip_special_tokens=False) == (text or "")


def test_one_tree_and_the_forest_agree(vocab):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdething ") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    by_width = {w: [p for p in pieces if B._width(len(p)) == w] for w in (2, 4, 8, 16, 32, 64)}
    for width, group in by_width.items():
        if group:
            assert B.merge_forest(vocab, group, width) == [B.merge_tree(vocab, p) for p in group]


def test_blocks_smaller_than_a_text(vocab, library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_PIECES", 7)
    monkeypatch.setattr(B, "CACHE_BYTES", 1000)
    texts = ["one two three four five six seven eight nine ten", "", "<|endoftext|> a b c d e f g h i j", "last"]
    texts.append("one" * 50 + " one" * 3)
    vocab.forget()
    assert list(B.encode_texts(vocab, texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_rows(odd, no_docs, library):
    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    rows = sorted(((r.doc_id, *want(r.text)) for r in odd.select("doc_id", "text").collect()), key=str)
    assert sorted((tuple(r) for r in B.digests(odd).collect()), key=str) == rows
    assert B.digests(no_docs).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in B.op3_bpe(spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_remembered_pieces_are_bounded_by_bytes(vocab):
    vocab.forget()
    list(B.encode_texts(vocab, ["x" * 5000, "short words here"]))
    assert vocab.cache and max(map(len, vocab.cache)) <= B.FOREST_BYTES and vocab.cached_bytes > 0
    vocab.forget()
    assert not vocab.cache and vocab.cached_bytes == 0


def test_one_pass_has_one_python_stage(spark):
    plan = B.op3_bpe(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
