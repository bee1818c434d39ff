import html
import re

import numpy as np
import pytest

from changeflow.llm import html_extract as H
from changeflow.llm.common import read
from changeflow.llm.html_blocks import blocks
from .llm_fixtures import SF_MID


@pytest.fixture(scope="module")
def model(spark):
    return H.train(read(spark, SF_MID, "pages"))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<!-- x <p>y</p> -->") == []
    assert texts("<script>var t='</p>';</script><style>p{}</style><title>t</title>a &amp; b&nbsp;c &#233;") == ["a & b c é"]
    assert texts("<p>one <b>t</b>wo<br>three<p>four<ul><li>five<li>six</ul>seven") == ["one two three", "four", "five", "six", "seven"]
    assert texts("a < b <p") == ["a < b"] and texts('<p class="a > b">x</p>') == ["x"] and texts("x &am") == ["x &am"]
    assert [b.path[-1] for b in blocks('<div class="Side-Bar x" id=main><p>t')] == [("p",)] and list(blocks('<div class="Side-Bar x" id=main>t'))[0].path == (("div", "side", "bar", "x", "main"),)
    assert [round(b.linked, 1) for b in blocks("<p><a href=x>ab</a>cd</p><p>ef</p>")] == [0.5, 0.0]


def test_query_matches_the_articles(spark):
    got = {r.page_id: r for r in H.op1_html_extract(spark, SF_MID).collect()}
    for r in read(spark, SF_MID, "pages").collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        body = re.sub(r"<[a-zA-Z/!][^>]*(?:>|$)", lambda m: " " if re.match(r"</?(?:p|h1|br)\b", m.group()) else "", body)
        want = " ".join(html.unescape(body).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_layouts_not_in_the_sample(model):
    page = """<body><header><h1>The site</h1><p>Its slogan here</p></header><div class="navbar"><a href=x>Home</a></div><div id="content"><h2>Of the thing</h2>
    <p>And therhean is the is esndha reedes ha. Thand the of on.</p><div class="advertisement">Buy the thing now</div><p>Then edinth. Is thndor, thonndon ernd.</p></div>
    <div class="comments"><div class=comment><p>Great article, then edinth is thndor.</p></div></div><aside><p>Popular posts of the week.</p></aside>
    <form><p>Subscribe to our letter</p></form><footer>us</footer>"""
    found = list(blocks(page))
    kept = [b.text[:14] for b, p in zip(found, H.label(model, [found], H.Features())[0]) if p >= 0.5]
    assert kept == ["Of the thing", "And therhean i", "Then edinth. I"]


def test_composed_pages_held_out(model):
    rng = np.random.default_rng(99)
    right = total = 0
    for _ in range(120):
        page, labels = H.compose(rng, ["Thand the of on, erre thon.", "Is thndor the thing of it.", "Ouing eawh thlyanble ntrely."])
        found = list(blocks(page))
        assert len(found) == len(labels)
        if found:
            right += ((H.label(model, [found], H.Features())[0] >= 0.5) == np.array(labels)).sum()
            total += len(labels)
    assert right / total > 0.95


def test_gradients_match_differences():
    net = H.BiLstm(seed=1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(2)
    x, mask = H.pad([rng.normal(size=(n, H.INPUT)).astype(np.float32) for n in (4, 2)])
    y = (rng.random(mask.shape) < 0.5) * mask
    loss = lambda: -(np.log(np.where(y == 1, net.predict(x, mask), 1 - net.predict(x, mask))) * mask).sum() / mask.sum()
    for name, g in net.gradients(x, mask, y).items():
        flat = net.params[name].reshape(-1)
        i = int(np.abs(g).reshape(-1).argmax())
        was, h = flat[i], 1e-3
        flat[i] = was + h
        up = loss()
        flat[i] = was - h
        down = loss()
        flat[i] = was
        assert abs((up - down) / (2 * h) - g.reshape(-1)[i]) < 0.02 * abs(g.reshape(-1)[i]) + 1e-5


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Words of a very long page here.</p>" * 5000 + "</article>"
    rows = [(None, None, None, "a"), (1, "u", "", "b"), (2, None, long, None), (2, None, long, None), (3, "u", "<p", "c"), (4, "u", "\x00<article><p>ok &#0; then</p>", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string")
    out = H.main_blocks(pages, model).select("row.page_id", "row.blocks", "blocks").collect()
    assert [len(r[2]) for r in sorted(out, key=lambda r: r.page_id or 0)][:4] == [0, 0, 5000, 5000] and len(out) == 6
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.main_blocks(none, H.train(none)).count() == 0


def test_quotes_open_values_only_behind_an_equals_sign_and_slashes_close_nothing():
    read = lambda page: [b.text for b in blocks(page)]
    assert read("<p title='it's'>Hello</p><p>Next one's here</p>") == ["Hello", "Next one's here"]
    assert read('<div class="a"">One</div><p "x" y=\'>\' z = ">">Two</p>') == ["One", "Two"]
    assert read('<script src="x.js"/>var leak=1;</script><style/>p{}</style><title/>T</title><p>Text</p>') == ["Text"]
    assert read("<p>a<svg/>b</p><p a=b/c='d>e</p><p =x ==>f</p>") == ["ab", "e", "f"]
    assert read('<p>one</p><p class="open>two</p>') == ["one", "two"]
    assert read("<p " + "a'\"= " * 20_000) == []
    assert read("<p>x" + "<a b='" * 5_000 + "y") != []


def test_a_sample_smaller_than_one_in_a_million_is_drawn(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_PAGES", 1)
    monkeypatch.setattr(H, "COMPOSED", 2)
    monkeypatch.setattr(H, "EPOCHS", 1)
    seen = []
    monkeypatch.setattr(H, "blocks", lambda page: seen.append(page) or blocks(page))
    pages = spark.createDataFrame([("<article><p>" + f"Page {i}. " * 5 + "</p></article>",) for i in range(50)] * 3 + [(None,), ("x" * 100_000,)], "html string")
    H.train(pages)
    assert sum(p.startswith("<article><p>Page") for p in seen) == 1
