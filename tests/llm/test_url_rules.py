import math
from collections import Counter
from itertools import combinations

import pytest
from folioframe.llm import url_rules
from folioframe.llm.url_rules import RULES, judge_urls, mine, split_url, tokens
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"


def naive(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    best = None
    for h, p, says in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return host, path, best


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/en/", "http://a.b.com/en/x?y#z", "http://xcom/en/", "https://Example.com/en/7?p=/en/", "https://m.example.com/en/77", "http://notexample.com/en/7",
    "http://x.net/de/8", "http://www.example.net/de/8", "http://www.example.net/de/9", "http://q.org/es/", "http://q.org/es", "http://q.org?/es/", "http://q.org#/es/", "a://b://c.com/en/", "http://q.org/ES/", "http://user@h.com:80/en/", "http://é.com/en/\nx",
]


def test_stated_rules_against_plain_code(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], PAGES)
    out = {r.page_id: r for r in judge_urls(pages, spark.createDataFrame([], LABELS)).collect()}
    for i, url in enumerate(URLS):
        host, path, best = naive(url)
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, best and best[0], best[1] if best else "allow"), url


def spam_pages():
    rows, labels = [], []
    for i in range(400):
        spam, odd = i % 4 == 0, i % 3 == 0
        host = "www.cheap-pills.example.org" if spam else "www.garden.example.org"
        rows.append((i, f"http://{host}/{'buy' if spam or odd else 'read'}/now/{i}{'?ref=x' if i % 5 == 0 else ''}", ""))
        labels.append((i, int(not (spam and i % 16)), 0))
    return rows, labels


def wilson(p, n, z=2.0):
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def brute_rules(rows, least, confidence, lift):
    n, bad = len(rows), sum(b for _, b in rows)
    seen, with_bad = Counter(), Counter()
    for items, b in rows:
        for k in range(1, len(items) + 1):
            for some in combinations(sorted(items), k):
                seen[some] += 1
                with_bad[some] += b
    sure = {s: wilson(with_bad[s] / seen[s], seen[s]) for s in seen if with_bad[s] >= least}
    rules = {s: c for s, c in sure.items() if c > max(confidence, lift * bad / n)}
    return {s for s, c in rules.items() if not any(set(o) < set(s) and rules[o] >= c - 1e-12 for o in rules)}


@pytest.mark.parametrize("most", [500_000, 0])
def test_mined_rules_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_rules, "BROADCAST_TOKENS", most)
    monkeypatch.setattr(url_rules, "BROADCAST_SETS", most)
    rows, labels = spam_pages()
    pages = spark.createDataFrame(rows, PAGES)
    items = {r.page_id: r["items"] for r in split_url(pages).select("page_id", tokens().alias("items")).collect()}
    labelled = [(items[i], not quality) for i, quality, _ in labels]
    found = mine(spark.createDataFrame(labelled, "items array<string>, bad boolean"), 0.0, 20, 0.5, 1.5).collect()
    expected = brute_rules(labelled, 20, 0.5, 1.5)
    assert {tuple(r["items"]) for r in found} == expected and expected
    judged = judge_urls(pages, spark.createDataFrame(labels, LABELS), rules=(), support=0.0)
    assert "NestedLoop" not in judged._jdf.queryExecution().toString()
    out = judged.collect()
    for r in out:
        blocked = any(set(rule) <= set(items[r.page_id]) for rule in expected)
        assert r.verdict == ("block" if blocked else "allow")
        assert len(r.mined or []) == sum(set(rule) <= set(items[r.page_id]) for rule in expected)
    assert 0 < sum(len(r.mined or []) > 0 for r in out) < len(out)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 1), (None, 0, 0), (2, None, None)]])
def test_awkward_rows(spark, labels):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://x.org/a", None), (2, "http://" + "y" * 50000 + "/p", "")], PAGES)
    extra = pages.withColumn("host", F.lit(3)).withColumn("items", F.lit("z"))
    out = judge_urls(extra, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 4 and {r.verdict for r in out} == {"allow"}
    assert judge_urls(spark.createDataFrame([], PAGES), spark.createDataFrame(labels, LABELS)).count() == 0
