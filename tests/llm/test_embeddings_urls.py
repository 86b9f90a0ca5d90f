import math

import numpy as np

from terrachron.llm import embeddings, urls


def test_tile_products_find_all_links():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    y = np.concatenate([x[:50] + rng.normal(size=(50, 64)) * 0.2, rng.normal(size=(50, 64))])
    i, j = embeddings.links_between(x, y, 0.98, False)
    cos = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(cos >= 0.98)))) and len(i)


def test_embeddings(spark):
    a, near, far = [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]
    rows = [(1, a, 0), (2, a, 0), (3, near, 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [math.nan, 1.0], 0), (9, [None, 1.0], 0), (10, far, 0), (None, a, 0), (11, [], 0), (12, [1.0], 0), (13, [math.inf, 0.0], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: r for r in embeddings.embedding_duplicates(table, tile=2).collect()}
    assert {i: (got[i].n_links, got[i].component_id) for i in (1, 2, 3)} == {1: (2, 1), 2: (2, 1), 3: (2, 1)}
    assert all(got[i].n_links == 0 and got[i].kept for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None))
    assert len(got) == len(rows) and embeddings.embedding_duplicates(table.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        (2, "https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (3, "https://shop.com", "shop.com", "", None, None),
        (4, "https://shop.com/a", "shop.com", "/a", "com/", "allow"),
        (5, "ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"),
        (6, "http://notcom/a", "notcom", "/a", None, None),
        (7, "no scheme", "", "", None, None),
        (8, None, "", "", None, None),
        (None, "http://b.net?q=/fr/", "b.net", "", None, None),
        (4, "https://shop.com/a", "shop.com", "/a", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "v", "t") for i, u, *_ in rows], "page_id long, url string, verdict string, template string")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for i, _, host, path, rule, verdict in rows:
        r = next(r for r in got if r.page_id == i and r.host == host)
        assert (r.path, r.rule) == (path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_templates_learn_bad_branches(spark):
    bad = [(f"http://h.org/spam/{i}", 1) for i in range(30)]
    good = [(f"http://h.org/news/{i}", 0) for i in range(30)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(bad + good)] + [(100, "http://h.org/spam/new"), (101, "http://h.org/news/new")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, rules=(), labels=spark.createDataFrame(bad + good, "url string, bad int")).collect()}
    assert got[100].verdict == "block" and got[101].verdict == "allow" and got[100].template == "/spam/*"
