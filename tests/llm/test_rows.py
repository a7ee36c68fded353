"""URL filter, top-k search, embedding near-dedup and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelens.llm import embedding_dedup, entry, topk, url_filter
from pipelens.llm.embedding_dedup import near_vectors
from pipelens.llm.topk import top_k
from pipelens.llm.url_filter import filter_urls
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert_same(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])


# --- URLs -------------------------------------------------------------------------------------------------------------


def judge(url, listed):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


ODD_URLS = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.b.org/x?y", "x://example.org/es/1#z", "x://www.example.org/en/12", "x://notexample.org/es/", "http://com/fr/?q", "http://É.com/de/", "http://a..org/", "x://y.com/de/://org/", "http://org/" + "a/" * 5000, "http://" + "a." * 300 + "org/"]


def test_urls_like_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    hosts = ["org", "example.org", "com", "a.com", "net", "b.a.com"]
    listed = list({(rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b", "/de/"])): rng.choice(["allow", "block"]) for _ in range(20)}.items())
    listed = [(h, p, v) for (h, p), v in listed]
    urls = [*ODD_URLS, *[f"http://{rng.choice(['', 'www.', 'a.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/b/c', '/de/x', '?q'])}" for _ in range(150)]]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] * 2, "page_id bigint, url string, rule string, key int")
    table = spark.createDataFrame(listed, "host string, path string, verdict string")
    for most in (1, 1 << 17):  # a filter that is full passes all keys to the exact join
        monkeypatch.setattr(url_filter, "SENT_BLOCKS", most)
        got = filter_urls(pages, table).collect()
        assert len(got) == 2 * len(urls)
        assert all((r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], listed) for r in got)
    assert filter_urls(pages, table.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert filter_urls(pages.limit(0), table).count() == 0


def test_bloom_filter(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_filter.bloom_blocks(keys, 128)
    probe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("block", url_filter._block(F.col("key"), 128))
    masks = url_filter._masks(F.col("key"))
    hit = probe.join(blocks, "block").where(sum(((F.col(f"w{j}").bitwiseAND(m) == m).cast("int") for j, m in enumerate(masks)), F.lit(0)) == 4)
    assert hit.where("id < 2000").count() == 2000 and hit.where("id >= 2000").count() < 400


def test_urls_stay_native(spark, sf):
    physical = entry.op8_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in physical and "Arrow" not in physical


# --- vectors ----------------------------------------------------------------------------------------------------------


def cloud(n, groups, seed, spread=0.05, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


BAD_VECTORS = [(900, None, 1), (901, [], 1), (902, [math.nan] * 16, 1), (903, [math.inf] + [0.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [0.0] * 16, 1), (906, [1.0] * 16, None), (907, [1.0] * 3, 1), (908, [1.0] * 3, 1)]


def brute_links(rows, threshold):
    good = [(i, np.array(v, float), l) for i, v, l in rows if v is not None and len(v) and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    top, n = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, x, l) in enumerate(good):
        for j, y, m in good[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i] += 1
                n[j] += 1
                u, v = root(i), root(j)
                top[max(u, v)] = min(u, v)
    return {i: (n[i], root(i)) for i in top}


@pytest.mark.parametrize(("spread", "cell_rows"), [(0.05, 20), (0.4, 40), (0.3, 10_000)])
def test_near_vectors_like_brute_force(spark, monkeypatch, spread, cell_rows):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    x = cloud(240, 12, 3, spread)
    x[50:80] = x[0]
    rows = [(i, [float(f) for f in v], i % 2) for i, v in enumerate(x)] + BAD_VECTORS
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, cell int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, 0.93, cell_rows).collect()}
    assert got == brute_links(rows, 0.93)
    assert near_vectors(df.limit(0)).count() == 0


def test_guest_bound_loses_no_pair():
    rng = np.random.default_rng(5)
    x = embedding_dedup.unit(rng.normal(size=(300, 6)))
    c = embedding_dedup.spherical_kmeans(x, 7)
    home, s = (x @ c.T).argmax(1), x @ c.T
    sine = math.sqrt(1 - 0.8**2)
    gap = np.linalg.norm(c[home][:, None] - c[None], axis=2)
    near = s[np.arange(300), home][:, None] - s <= sine * gap + 1e-9
    i, j = np.nonzero(x @ x.T >= 0.8)
    assert near[i, home[j]].all()


def test_segment_bound_holds():
    rng = np.random.default_rng(6)
    q, x = rng.integers(-60, 60, (20, 37)), rng.integers(-60, 60, (30, 37))
    exact = q @ x.T
    for n in topk.LEVELS:
        assert (topk.segments(q, n) @ topk.segments(x, n).T >= exact - 1e-6).all()


def test_top_k_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (300, 10))
    x[20:60] = x[0]
    rows = [(i, [int(f) for f in v]) for i, v in enumerate(x)] + [(300, None), (320, [None] * 10), (340, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    for query in range(0, 300, 20):
        scores = x @ x[query]
        best = [i for i in np.lexsort((np.arange(300), -scores)) if i != query][:20]
        own = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        assert [(r["rank"], r.vec_id, r.score) for r in own] == [(k + 1, i, scores[i]) for k, i in enumerate(best)]
    assert not [r for r in got if r.query_id >= 300]
    few = top_k(df.where("vec_id < 5"), F.lit(True), k=20).collect()
    assert len(few) == 20 and top_k(df.limit(0), F.lit(True)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from pipelens.llm import language, toxicity
    from pipelens.storage import staged
    from tests.llm.test_documents import brute_components, brute_repeats, check_packed, slow_encoder

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    frames, columns = [docs], docs.columns
    for name, stage in p.STAGES[:-1]:
        out = staged(stage(spark, frames[-1], sf), name)
        assert out.columns == columns
        frames.append(out)
    sets = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, model).where(F.col("score") >= model.limit("lang")).collect()}
    assert set(sets[1]) == set(texts) - bad
    known = language.train(frames[1])
    unknown = {r.doc_id for r in language.identify(frames[1], known).where((F.col("lang_pred") == "und") | (F.col("score") < known.floor)).collect()}
    assert set(sets[2]) == set(sets[1]) - unknown
    lines = brute_repeats(list(sets[2].items()), 50)
    assert sets[3] == {i: t for i, t in lines.items() if t == sets[2][i] or t.strip()}
    groups = brute_components(list(sets[3].items()), 5, 80)
    assert set(sets[4]) == {i for i, (_, top) in groups.items() if top == i}
    packed = p.run(spark, sf).collect()
    check_packed(packed, sets[4], slow_encoder(), 1024)


def test_pipeline_stages_take_odd_tables(spark, sf):
    import corpus_pipeline as p
    from pipelens.storage import staged
    from tests.llm.conftest import DOC, ODD

    for rows in ([], [(i, t, "en", None, None) for i, t in ODD]):
        docs = spark.createDataFrame(rows, DOC)
        for name, stage in p.STAGES:
            docs = staged(stage(spark, docs, sf), f"odd-{name}")
        assert docs.count() >= 0
    same = spark.createDataFrame([(5, "one two three four five six", "en", "s", 1)] * 3 + [(6, "one two three four five six", "en", "s", 1)], DOC)
    assert [r.doc_id for r in p.drop_near_duplicates(spark, same, sf).collect()] == [5]
    t, u = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    ids = spark.createDataFrame([(i, x, "en", "s", 1, 2.0) for i, x in [(3, t), (5, t), (5, u), (9, u), (None, u), (7, " ")]], f"{DOC}, score double")
    left = p.drop_near_duplicates(spark, ids, sf)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, u), (3, t), (5, u), (7, " ")])
    kept = p.drop_unknown_languages(spark, ids, sf)
    assert kept.columns == ids.columns and kept.where("score <> 2.0").isEmpty()
