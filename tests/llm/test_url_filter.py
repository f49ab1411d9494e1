import re

import numpy as np
import pytest

from wirelore.llm import url_filter as uf


@pytest.mark.parametrize("url, host, path, rule", [
    ("https://Blog.Example.NET/en/1?x=/fr/#y", "blog.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/de/1", "example.net", "/de/1", "net/"), ("http://a.example.com/de/x#t", "a.example.com", "/de/x", "example.com/de/"),
    ("http://notexample.com/de/x", "notexample.com", "/de/x", None), ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/"), ("http://x.net?p=1", "x.net", "", None),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://ÄB.Org/fr/é", "Äb.org", "/fr/é", "org/fr/"),
])
def test_parts_and_rules(spark, url, host, path, rule):
    row = uf.judge_urls(spark.createDataFrame([(1, url, 3)], "page_id long, url string, score int")).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)
    if rule:
        assert row.verdict == ("block" if rule in ("net/", "example.com/de/") else "allow")


def test_the_model_tells_its_labels_and_unseen_urls():
    weights, bias = uf.fit()
    score = lambda u: weights[s].sum() / len(s) ** 0.5 + bias if len(s := uf.slots_of(*uf._split(u))) else float("-inf")
    assert all((score(u) > 0) == bool(y) for u, y in uf.LABELLED)
    assert score("http://www.cheap-pills.shop.test/en/8") > 0 and score("https://www.thether.example.com/en/31") < 0


def test_bounds_and_edges(spark):
    with pytest.raises(ValueError):
        uf.fit([("http://a/", 0)] * (uf.MAX_LABELLED + 1))
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://b.com/")], "page_id long, url string")
    assert uf.judge_urls(pages).count() == 3 and uf.judge_urls(pages.limit(0)).count() == 0
    assert uf.judge_urls(pages, labelled=[]).filter("verdict = 'allow'").count() == 3


def _plain_parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m.group().lower(), found[1]), found[2]) if found else ("", "")


def _plain_rule(host, path):
    labels = host.split(".")
    fits = [(h + p, v) for v, h, p in uf.RULES if labels[-len(h.split(".")):] == h.split(".") and path[:len(p)] == p]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def _plain_model():
    """The same regression on a dense matrix, row by row: what ``fit`` does on lists of slots."""
    rows = [(uf.slots_of(*_plain_parts(u)), y) for u, y in uf.LABELLED]
    used = {s: i for i, s in enumerate(sorted({int(s) for slots, _ in rows for s in slots}))}
    x = np.zeros((len(rows), len(used)))
    for r, (slots, _) in enumerate(rows):
        for s in slots:  # two grams of one slot count twice
            x[r, used[int(s)]] += 1 / np.sqrt(len(slots))
    y, w, bias = np.array([label for _, label in rows], float), np.zeros(len(used)), 0.0
    for _ in range(400):
        wrong = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w, bias = w - 2.0 * (x.T @ wrong + 1e-3 * w), bias - 2.0 * wrong.mean()
    return {s: w[i] for s, i in used.items()}, bias


def test_a_whole_table_as_a_plain_version_judges_it(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = {r.page_id: r for r in uf.judge_urls(pages).collect()}
    weights, bias = _plain_model()
    assert got.keys() == urls.keys()
    for page, url in urls.items():
        (host, path), row = _plain_parts(url), got[page]
        rule, verdict = _plain_rule(host, path)
        slots = uf.slots_of(host, path) if host or path else []
        score = 1 / (1 + np.exp(-(sum(weights.get(int(s), 0.0) for s in slots) / len(slots) ** 0.5 + bias))) if len(slots) else 0.0
        assert (row.host, row.path, row.rule) == (host, path, rule) and row.score == pytest.approx(score, abs=1e-4)
        assert row.verdict == (verdict or ("block" if score >= 0.5 else "allow"))
