import zlib

import numpy as np
from pyspark.sql import functions as F

from changeflow.llm import language_id as L
from changeflow.llm.common import read
from .llm_fixtures import SF_MID


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in read(spark, SF_MID, "documents").collect()}
    rows = L.op4_language_id(spark, SF_MID).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.lang_pred in set(lang.values()) for r in rows)
    held = [lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert np.mean(held) >= 0.97


def test_odd_rows(spark, odd, no_docs):
    net = L.train(odd)
    out = L.identify(odd, net).select("row.doc_id", "lang_pred", "score").collect()
    assert len(out) == odd.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[2] == by[3] == by[4] == ("und", 0.0) and by[9][0] == "en" and by[7][0] == "en"
    assert L.train(no_docs) is None and L.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in L.identify(odd, None).collect()} == {"und"}
    assert L.identify(no_docs, net).count() == 0


def test_letters():
    assert [L.has_letter(t) for t in (None, "", "12 !?", "1a", "٣", "é", "日", "😀")] == [False, False, False, True, False, True, True, False]


def test_gradients_match_differences():
    net = L.ByteNet(["a", "b", "c"], seed=1)
    rng = np.random.default_rng(2)
    rows, y = rng.integers(0, 256, (5, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    net.mask = net.mask.astype(np.float64)
    net.tables = lambda: np.einsum("be,sef->sbf", net.params["embed"], net.params["filters"])
    loss = lambda: -np.log(net.predict(rows, net.tables())[np.arange(5), y]).mean()
    grads = net.gradients(rows, y)
    for name in net.params:
        flat = net.params[name].reshape(-1)
        for i in np.argsort(-np.abs(grads[name].reshape(-1)))[:3]:
            was, h = flat[i], 1e-5
            flat[i] = was + h
            up = loss()
            flat[i] = was - h
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * h) - grads[name].reshape(-1)[i]) < 1e-4 * max(1, abs(grads[name].reshape(-1)[i]))


def test_every_window_counts():
    rows, sizes = L.windows(b"x" * (L.WINDOW * 2 + 3))
    assert rows.shape == (3, L.WINDOW) and sizes.tolist() == [L.WINDOW, L.WINDOW, 3] and L.windows(b"")[0].shape == (1, L.WINDOW)


def test_copies_do_not_crowd_out_a_language_and_large_tables_are_drawn_from(spark):
    french = "Le chat de la voisine dort sur le toit rouge depuis ce matin."
    rows = [(french, "fr")] * 5000 + [(f"The dog number {i} of the house runs in the garden all day", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    some = L.sampled(docs, 40).select("lang", "text").distinct().collect()
    assert sum(r.lang == "fr" for r in some) == 1 and sum(r.lang == "en" for r in some) == 40
    # A share below one in a million leaves the languages' smallest hashes.
    tiny = L.sampled(docs, 1).select("lang", "text").distinct().collect()
    assert sorted(r.lang for r in tiny) == ["en", "fr"]
    net = L.train(docs)
    got = {r.row.id: r.lang_pred for r in L.identify(spark.createDataFrame([(1, french), (2, rows[-1][0])], "id int, text string"), net).collect()}
    assert got == {1: "fr", 2: "en"}
