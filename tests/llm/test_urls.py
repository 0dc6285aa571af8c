import random
import time
from itertools import combinations

from attesta.llm import urls
from pyspark.sql import functions as F


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, after = rest[:end], rest[end:]
    path = after[: min((after.index(c) for c in "?#" if c in after), default=len(after))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    best = (None, None)
    for v, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[1] or ""):
            best = (v, rule)
    return best


URLS = [
    "http://a.example.com/en/71", "HTTP://A.Example.COM/en/8", "http://example.com/en/7", "http://xcom/en/", "http://com/en/", "https://b.example.net/de/8#x", "https://b.example.net/de/9",
    "https://net/de", "x://ORG/es/?q=1", "http://a.org?x=/es/", "http://a.org#/es/", "no scheme", None, "", "http://", "http:///en/", "http://İ.com/en/1", "a b://c.com\n/en/",
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    for i, u in enumerate(URLS):
        host, path = slow_parts(u)
        verdict, rule = slow_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_mined_rules_match_brute_force(spark):
    rows = []
    for i in range(200):
        host = ["shop.example.fr", "casino.example.fr", "news.site.uk"][i % 3]
        rows.append((i, f"https://{host}/{['a', 'bet', 'c'][i % 5 % 3]}/{i}?{['page', 'ref'][i % 2]}=1"))
    bad = {i: ("casino" in u and "/bet/" in u) or i % 17 == 0 for i, u in rows}
    pages = spark.createDataFrame([*rows, (900, None), (901, "https://x.casino.example.fr/bet/1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in bad.items() if i % 4] + [(None, True), (5000, True), (1, None)], "page_id long, bad boolean")
    h, p, q = urls.split_url(F.col("url"))
    sets = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urls.tokens(h, p, q).alias("t")).collect()}
    train = [(sets[i], b) for i, b in bad.items() if i % 4]
    found = set()
    for items in {frozenset(c) for s, _ in train for r in range(1, len(s) + 1) for c in combinations(sorted(s), r)}:
        n = sum(items <= s for s, _ in train)
        k = sum(items <= s and b for s, b in train)
        if k / len(train) >= 0.05 and k / n >= 0.8:
            found.add(items)
    assert found
    want = {i: "block" if any(f <= s for f in found) else "allow" for i, s in sets.items()}
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels, min_support=0.05, min_confidence=0.8).collect()}
    assert got == want and set(want.values()) == {"block", "allow"}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_long_urls_make_no_more_rules_than_short_ones(spark):
    """Copies of a url of 200 segments, and paths of which each goes one step deeper."""
    rows = [(i, "https://bad.example/" + "/".join(f"s{k}x" for k in range(200))) for i in "abcabc".encode()]
    rows += [(200 + i, "https://deep.example/" + "/".join(f"d{k}x" for k in range(i))) for i in range(1, 40)]
    rows += [(400 + i, f"https://good.example/{i}") for i in range(160)] + [(600, "https://x.bad.example/s7x/s8x"), (600, "https://good.example/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 200) for i in dict.fromkeys(r[0] for r in rows) if i < 600], "page_id long, bad boolean")
    start = time.time()
    got = [(r.page_id, r.verdict) for r in urls.judge(pages, labels).collect()]
    assert time.time() - start < 60 and len(got) == len(rows)
    assert {v for i, v in got if i < 200} == {"block"} and {v for i, v in got if 200 <= i < 600} == {"allow"}
    assert sorted(v for i, v in got if i == 600) == ["allow", "block"]


def test_rules_of_tokens_behind_ten_more_widespread_ones(spark):
    """Pages of 14 to 20 tokens; bad are those with two or three of the rarest."""
    r = random.Random(4)
    rows = []
    for i in range(240):
        wide = [f"w{chr(97 + k)}" for k in range(16) if r.random() < 0.85]
        rare = [x for x in ("p", "q", "r", "t") if r.random() < 0.4]
        rows.append((i, f"https://h.example/{'/'.join(wide + rare)}"))
    bad = lambda u: {"p", "q"} <= set(u.split("/")) or {"q", "r", "t"} <= set(u.split("/"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, bad(u)) for i, u in rows if i % 3], "page_id long, bad boolean")
    sets = {i: frozenset(u.split("/")[3:]) for i, u in rows}
    train = [(sets[i], bad(u)) for i, u in rows if i % 3]
    found = []
    for items in (frozenset(c) for k in (1, 2, 3) for c in combinations(sorted(frozenset().union(*sets.values())), k)):
        n, k = sum(items <= s for s, _ in train), sum(items <= s and b for s, b in train)
        if k >= 5 and k / n >= 0.95:
            found.append(items)
    want = {i: "block" if any(f <= s for f in found) else "allow" for i, s in sets.items()}
    got = {x.page_id: x.verdict for x in urls.judge(pages, labels, min_confidence=0.95).collect()}
    assert got == want and {frozenset("pq"), frozenset("qrt")} <= set(found)
    assert all(want[i] == "block" for i, u in rows if bad(u))
