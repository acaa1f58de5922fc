import math

import pytest

from tallyglass.llm import url_filter
from tallyglass.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host int, verdict int"


def judge(spark, urls, rules=URL_RULES):
    rows = spark.createDataFrame([(i, u, 0, 0) for i, u in enumerate(urls)], SCHEMA)
    return {r.page_id: r for r in url_filter.judge_urls(rows, rules).collect()}


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("http://a.NET/x?y#z", "a.net", "/x", "net/"),
        ("http://net", "net", "", None),
        ("http://net/", "net", "/", "net/"),
        ("http://internet/", "internet", "/", None),
        ("x://Example.net/en/1", "example.net", "/en/1", "example.net/en/"),
        ("x://sub.example.net/en", "sub.example.net", "/en", "net/"),
        ("x://example.com/de/a#b/c", "example.com", "/de/a", "example.com/de/"),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/"),
        ("x://a.org?q=/fr/", "a.org", "", None),
        ("x://É.net:8/y://z", "É.net:8", "/y://z", None),
        ("no scheme/net/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule):
    row = judge(spark, [url])[0]
    assert (row.host, row.path, row.rule) == (host, path, rule)
    assert row.verdict == (URL_RULES[rule] if rule else "allow")


def test_empty_table_and_repeated_rows(spark):
    assert judge(spark, []) == {}
    rows = spark.createDataFrame([(1, "x://a.b/c"), (1, "x://a.b/c"), (None, None)], "page_id long, url string")
    out = url_filter.judge_urls(rows, URL_RULES)
    assert out.count() == 3 and out.columns == ["page_id", "host", "path", "rule", "verdict", "score"]


def test_models_against_plain_python(spark):
    urls = [f"http://good{i % 7}.net/news/story-{i}" for i in range(60)] + [f"http://bad{i % 5}.xyz/cheap-pills/{i}" for i in range(60)]
    urls += ["http://a.io/news/story-4", "http://a.io/cheap-pills/9", "http://q.io/ÄÖ", "http://z.io/" + "news/" * 20_000]
    rules = {"net/": "allow", "xyz/": "block"}
    got = judge(spark, urls, rules)

    from hashlib import md5

    def text(url):
        s = url.split("://", 1)[1].lower()
        return "^^^" + "".join("0" if c in "0123456789" else c if c in "abcdefghijklmnopqrstuvwxyz./?=&#_%:-" else "~" for c in s) + "$"

    def grams(url):
        t = text(url)
        return [t[i : i + 4] for i in range(len(t) - 3)]

    counts = [{}, {}]
    for u in urls:
        side = 0 if ".net/" in u else 1 if ".xyz/" in u else None
        if side is not None and md5(u.split("://", 1)[1].encode()).hexdigest()[0] not in "048c":
            for g in grams(u):
                counts[side][g] = counts[side].get(g, 0) + 1

    def p(side, gram):
        value = 1 / url_filter.SYMBOLS
        for k in range(4):
            tail, context = gram[3 - k :], gram[3 - k : 3]
            c = sum(n for g, n in counts[side].items() if g.endswith(tail))
            inside = {}
            for g, n in counts[side].items():
                if g[3 - k : 3] == context:
                    inside[g[-1]] = inside.get(g[-1], 0) + n
            if inside:
                value = (c + len(inside) * value) / (sum(inside.values()) + len(inside))
        return value

    for i in range(120, 123):
        want = math.floor(sum(round(1e6 * (math.log(p(0, g)) - math.log(p(1, g)))) for g in grams(urls[i])) / len(grams(urls[i])))
        assert abs(got[i].score - want) <= 1
    assert [got[i].verdict for i in (120, 121, 123)] == ["allow", "block", "allow"]
