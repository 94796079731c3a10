import random
import re

from veilscan.llm.queries import URL_RULES
from veilscan.llm.url_filter import url_verdicts

URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://net/", "http://xnet/", "https://example.net/en/1", "https://example.net/EN/1",
    "https://sub.example.net/en", "https://sub.example.net/en/?q", "http://example.com/de/#t", "http://example.com/d", "ftp://x.org/fr/a/b?c://d", "http://org/fr/",
    "http://user@x.net:80/", "http://x.net?y/", "a://b://c.net/", "http://.net/", "http://é.net/é", "http://" + "a." * 2000 + "net/" + "p" * 5000, "http://x.net/\nb", "://h.net/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best, least = None, None
    for rule, action in rules:
        h, _, p = rule.partition("/")
        rank = (-len(rule), action != "block", rule)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or rank < least):
            best, least = (rule, action), rank
    return host, path, best and best[0], best[1] if best else default


def run(spark, rows, rules):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, short long")
    table = spark.createDataFrame(rules, "rule string, action string")
    got = url_verdicts(pages, table).collect()
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str)


def test_equals_brute_force_with_nulls_and_repeats(spark):
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(URLS)] + [(None, URLS[4], "h", "r", 1), (4, URLS[4], "h", "r", 1)]
    assert run(spark, rows, URL_RULES) == sorted(((r[0], *brute(r[1], URL_RULES)) for r in rows), key=str)


def test_rules_of_many_shapes(spark):
    rules = [("a.b/", "block"), ("b/x", "allow"), ("b/xy", "block"), ("c.a.b/xy", "allow"), ("NET/", "block"), ("bad", "block"), ("d/", "none"), ("d/e", None)]
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(["http://c.a.b/xyz", "http://a.b/xyz", "http://b/xz", "http://q.net/", "http://bad/", "http://d/e"])]
    known = [("a.b/", "block"), ("b/x", "allow"), ("b/xy", "block"), ("c.a.b/xy", "allow")]
    want = sorted(((r[0], *(brute(r[1], known) if "net" not in r[1] else ("q.net", "/", "NET/", "block"))) for r in rows), key=str)
    assert run(spark, rows, rules) == want


def test_rules_of_random_hosts_and_folders(spark):
    r = random.Random(3)

    def address():
        return ".".join(r.choice("ab") for _ in range(r.randint(1, 4))) + "/" + "".join(r.choice("ab//") for _ in range(r.randint(0, 7)))

    rules = {address(): r.choice(["allow", "block"]) for _ in range(60)}
    rows = [(i, "http://" + address(), "h", "r", 1) for i in range(300)]
    assert run(spark, rows, list(rules.items())) == sorted(((i, *brute(u, list(rules.items()))) for i, u, *_ in rows), key=str)


def test_ties_and_empty_tables(spark):
    assert run(spark, [(1, "http://d.net/", "", "", 1)], [("d.net/", "allow"), ("d.net/", "block")])[0][4] == "block"
    pages = spark.createDataFrame([(1, "http://d.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, action string")
    assert [r["verdict"] for r in url_verdicts(pages, none).collect()] == ["allow"]
    assert url_verdicts(pages.limit(0), none).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://d.net/")], "page_id long, url string")
    plan = url_verdicts(pages, spark.createDataFrame(URL_RULES, "rule string, action string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
