"""Toxicity, language ID and HTML extraction, by held-out accuracy."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pipelens.llm import html_text, language, shingles, toxicity
from pipelens.llm.convnet import ConvNet, windows
from pipelens.llm.entry import op2_toxicity, op6_html_text, op9_language_id
from tests.llm.conftest import ODD, words


def test_windows_cover_all_units():
    at, first, n = windows(np.array([0, 5, 12]), 4, 2)
    assert n.tolist() == [1, 2, 3] and first.tolist() == [0, 1, 3] and at.shape == (6, 6)
    assert (at[:, 0] == -1).all() and at[:, 1].tolist() == [0, 1, 2, 3, 4, -1] and at[:, 5].tolist() == [13, 14, 15, 16, -1, -1]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = ConvNet(20, dim=3, widths=(1, 2), filters=2, classes=2, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for w in net.widths:
        net.p[f"b{w}"] += 0.1  # away from the kink at 0
    texts, y = [rng.integers(1, 20, (n, 2)) for n in (3, 9, 1)], np.array([0, 1, 1])
    weight = np.ones(2)

    def loss():
        total = 0.0
        for t, label in zip(texts, y):
            at, first, _ = windows(np.array([len(t)]), 4, net.beyond)
            units = np.concatenate([t, np.zeros((1, 2), int)])[at]
            p = net.classify(np.maximum.reduceat(net.pooled(units, 4), first, axis=0))
            total -= np.log(p[0, label])
        return total / len(texts)

    g = net._gradients(texts, y, 4, weight)
    for k in net.p:
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in rng.choice(len(flat), min(10, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            if k == "E" and i < net.dim:
                continue
            assert grad[i] == pytest.approx((up - down) / 2e-5, abs=1e-3)


def test_byte_tables_equal_the_plain_network():
    net = ConvNet(256, dim=4, widths=(2, 3, 4), filters=3, classes=3)
    data = np.random.default_rng(1).integers(0, 256, (19, 7)).astype(np.uint8)
    assert np.allclose(net.pooled(data[..., None].astype(int), 16), net.pooled_bytes(data, 16), atol=1e-4)


def test_language(spark, sf):
    got = op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.9 and 0 <= r[1] and r[2] <= 1


def test_language_of_odd_rows(docs, spark, sf):
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    got = language.identify(docs([*ODD, (30, "123 !! 456")]), model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(ODD) + 1 and all(by[i] == ("und", 0.0) for i in (2, 3, 4, 30)) and by[7][0] in model.languages and got[0].runs == "x"
    assert language.identify(docs([]), model).count() == 0
    assert language.train(docs([])) is None and language.identify(docs(ODD), None).where("lang_pred <> 'und'").count() == 0


BAD = ["vilestuff", "crudeword", "nastything"]


def toxic_docs(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        w, bad = words(rng.randint(5, 400), seed * 10_000 + i), i % 4 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s", "ing", "!"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_from_its_fold_alone(docs, spark):
    rows = toxic_docs(1200, 1)
    d = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(d, labels)
    got = toxicity.score_toxicity(d, model).select("doc_id", "score").withColumn("held", toxicity.held_out("doc_id")).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(d, flipped)
    assert np.allclose(model.net.p["E"], again.net.p["E"]) and model.thresholds == again.thresholds
    assert 0 < model.threshold < 1 and set(model.thresholds) <= {"en"}
    odd = toxicity.score_toxicity(docs(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and odd[0].runs == "x"
    assert odd[1].score == odd[2].score
    assert toxicity.train(d, labels.where("toxic = 0")) is None and toxicity.score_toxicity(d, None).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_toxicity(docs([]), model).count() == 0


def test_long_words_and_texts_hash_as_short_ones(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abAB-é", k=rng.choice([1, 3, 4, 5, 9, 200, 5000]))) for _ in range(300)).encode()
    for data in (text, b"  " + text + b" ", b"x" * 9000, b" " * 5000, b""):
        data = np.frombuffer(data, np.uint8)
        whole, counts = toxicity.word_features(data, np.array([0, len(data)]))
        words = shingles.Words(data, np.array([0, len(data)]))
        for chunk in (64, 1000):
            monkeypatch.setattr(shingles, "CHUNK", chunk)
            monkeypatch.setattr(toxicity, "CHUNK", chunk)
            pieces, n = toxicity.word_features(data, np.array([0, len(data)]))
            assert n.tolist() == counts.tolist() and (pieces == whole).all()
            assert shingles.long_hashes(data)[:, 0].tolist() == words.hashes().tolist()
            monkeypatch.undo()


def test_scores_equal_a_plain_forward_pass():
    """Both networks against loops over windows, places and filters."""
    rng = np.random.default_rng(8)

    def plain(net, units, length):
        best = {w: np.zeros(net.filters) for w in net.widths}
        padded = np.concatenate([units, np.zeros((max(net.widths), units.shape[1]), int)])
        for at in range(max(1, len(units))):
            for w in net.widths:
                value = sum(sum(net.p["E"][f] for f in padded[at + j]) @ net.p[f"W{w}"][j] for j in range(w))
                best[w] = np.maximum(best[w], value)
        hidden = np.concatenate([np.maximum(best[w] + net.p[f"b{w}"], 0) for w in net.widths])
        z = np.exp(hidden @ net.p["U"] + net.p["c"])
        return z / z.sum()

    texts = ["one two three", "", "x", " ".join(f"w{i}" for i in rng.integers(0, 50, 300)), "é ü 1 2"]
    net = ConvNet(toxicity.BUCKETS, 8, (1, 2, 3), 8, 2)
    model = toxicity.ToxicityModel(net)
    got = np.concatenate(list(model.scores(pa.array(texts))))
    for text, score in zip(texts, got):
        data = np.frombuffer(text.encode(), np.uint8)
        units, _ = toxicity.word_features(data, np.array([0, len(data)]))
        assert score == pytest.approx(plain(net, units, toxicity.WINDOW)[1], abs=1e-4)
    net = ConvNet(256, 8, (2, 3, 4), 8, 3)
    found = np.concatenate(list(language.LanguageModel(["a", "b", "c"], net).probabilities(pa.array(texts))))
    for text, p in zip(texts, found):
        data = shingles._LOWER[np.frombuffer(text.encode(), np.uint8)].astype(int)
        wide = np.concatenate([data, np.zeros(8, int)])
        parts = []
        for at in range(0, max(1, len(data)), language.WINDOW):
            seen = data[at : at + language.WINDOW + net.beyond][:, None]
            best = {w: np.zeros(net.filters) for w in net.widths}
            for i in range(language.WINDOW):
                for w in net.widths:
                    units = [int(seen[i + j, 0]) if i + j < len(seen) else 0 for j in range(w)]
                    best[w] = np.maximum(best[w], sum(net.p["E"][u] @ net.p[f"W{w}"][j] for j, u in enumerate(units)))
            hidden = np.concatenate([np.maximum(best[w] + net.p[f"b{w}"], 0) for w in net.widths])
            z = np.exp(hidden @ net.p["U"] + net.p["c"])
            parts.append(z / z.sum())
        assert len(wide) and np.allclose(p, np.mean(parts, 0), atol=1e-4)


def test_long_texts_are_read_to_the_end(docs, spark):
    rows = toxic_docs(600, 2)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs([(i, t) for i, t, _ in rows]), labels)
    body = " ".join(words(150_000, 3))
    clean, bad = np.concatenate(list(model.scores(pa.array([body, f"{body} {BAD[0]}"]))))
    assert bad > clean


def test_toxicity_query(spark, sf):
    got = op2_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("predicted <> cast(score >= 0.3 as int) or score < 0 or score > 1").count() == 0


# --- HTML -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_text.trained_model()


def strip(page):
    return page.replace(" data-keep", "").replace(" data-drop", "")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    m = html_text.TreeModel(rng.normal(size=html_text.FEATURES), rng.normal(size=(2, 2)))
    page = html_text.parse("<body><div><p>a b c</p><ul><li>x<li>y</ul></div><p>z</p></body>")
    n = len(page.parent)
    score = np.array([m.w[f].sum() for f in page.features])
    total, hits, norm = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        p = np.exp(sum(score[k] * y[k] for k in range(n)) + sum(m.edge[y[page.parent[k]], y[k]] for k in range(1, n)))
        norm += p
        total += p * np.array(y)
        for k in range(1, n):
            hits[k, y[page.parent[k]], y[k]] += p
    belief, joint = m.marginals(html_text.Forest([page]))
    assert np.allclose(np.exp(belief[:, 1]), total / norm) and np.allclose(joint, hits / norm)


def test_held_out_pages(model):
    pages = html_text.labelled_pages(150, seed=77)
    got = model.texts([html_text.parse(strip(p)) for p in pages])
    right = wrong = missed = 0
    for page, text in zip(pages, got):
        p = html_text.parse(page)
        want = [t for k, t in p.segments if p.keep[k]]
        found = text.split("\n\n") if text else []
        right += len(set(want) & set(found))
        wrong += len(set(found) - set(want))
        missed += len(set(want) - set(found))
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_blocks_and_references(model):
    page = "<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A  title\n here</h1><p>One &amp; two&nbsp;&eacute; with some more words.<br>next<p>Three <b>bold</b>text goes on for a while.</article><footer>&copy; x</footer>"
    assert model.texts([html_text.parse(page)]) == ["A title here\n\nOne & two é with some more words. next\n\nThree boldtext goes on for a while."]


@pytest.mark.parametrize("page", ["", "<", "<a<b<c", "<p", "</p></p>", "<script>x", "plain", "<div " + "x='" * 500, "<p>" * 3000 + "deep", "<!-- never ends", "a > b < c"])
def test_broken_pages(model, page):
    assert isinstance(model.texts([html_text.parse(page)])[0], str)


#: Pages written by hand, and the text that is content.
BY_HAND = [
    (
        "<article><p>First paragraph of the text is here and it is long enough.</p><section><div><div><div><div><div><p>Deep words here.</p></div></div></div></div></div></section></article>",
        "First paragraph of the text is here and it is long enough.\n\nDeep words here.",
    ),
    (
        "<body><div id=wrap><nav><a href=/>Home</a> <a href=/x>News</a></nav><main><h1>Title of it</h1><p>Some text with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in it, as formulas go in long lines.</p>"
        "<div class=comments><h3>Comments</h3><p>Nice article!</p></div></main><footer>Copyright 2020 Me</footer></div></body>",
        "Title of it\n\nSome text with x=2 in it, as formulas go in long lines.",
    ),
    (
        "<div class='site'><div class='cookie-banner'>We use cookies <button>OK</button></div><div class=content><h2>A heading</h2><p>Para one is a normal sentence of text.</p>"
        "<ul><li>first point of the list</li><li>second point of the list</li></ul><table><tr><td>cell a</td><td>cell b</td></tr></table><p>End.</p></div>"
        "<div class=sidebar><h4>Popular</h4><ul><li><a href=1>One</a></li></ul></div></div>",
        "A heading\n\nPara one is a normal sentence of text.\n\nfirst point of the list\n\nsecond point of the list\n\ncell a\n\ncell b\n\nEnd.",
    ),
    ("<section>" + "<div>" * 80 + "<p>Inner words that are of the section and long enough to count.</p></section><footer><p>Copyright words.</p></footer>", "Inner words that are of the section and long enough to count."),
    (
        "<article><h1>Of films</h1><video src=v><p>Your browser does not play this video, here is the transcript of it instead.</p></video>"
        "<p>More of the article text follows <svg><text>a drawing</text></svg> in this paragraph.</p><form><label>Mail</label><input></form></article>",
        "Of films\n\nYour browser does not play this video, here is the transcript of it instead.\n\nMore of the article text follows a drawing in this paragraph.",
    ),
]


@pytest.mark.parametrize(("page", "want"), BY_HAND)
def test_pages_by_hand(model, page, want):
    assert model.texts([html_text.parse(page)]) == [want]


@pytest.mark.parametrize("page", ["<svg>" * 40_000, "<div>" * 10_000 + "<tr><td>x</td>" * 10_000, "<script>" * 30_000, "<div>" * 40_000 + "x", '<a "' * 50_000 + "<p>x</p>", "<" * 200_000 + "p>x", " " * 5_000_000, "a" * 5_000_000, "<p>" + "\n" * 5_000_000 + "x"])
def test_long_pages_take_linear_time(model, page):
    start = time.process_time()
    model.texts([html_text.parse(page)])
    assert time.process_time() - start < 15


class _Article(HTMLParser):
    """Blocks of the article of the table's pages, whose menus and notes stand outside of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_query_and_odd_rows(spark, sf, model):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op6_html_text(spark, sf).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        reader = _Article()
        reader.feed(pages[r.page_id])
        assert r.text == "\n\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y")], "page_id bigint, html string, text string")
    assert [r.text for r in html_text.extract_text(odd, model).collect()] == ["", "", ""]
    assert html_text.extract_text(odd.limit(0), model).count() == 0
