import random
import re

import pyarrow as pa
import pytest

from entigraph.llm import urlfilter
from entigraph.llm.urlfilter import Rule, UrlFilter


def as_regex(glob):
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**", at):
            out, at = out + ".*", at + 1
        elif glob[at] == "*":
            out += "[^/]*"
        elif glob[at] == "?":
            out += "[^/]"
        elif glob[at] == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        else:
            out += re.escape(glob[at])
        at += 1
    return re.compile(out, re.S)


def brute(rules, default, url):
    fit = [(r.name is not None, len(r.name or ""), -i, r) for i, r in enumerate(rules) if as_regex(r.glob).fullmatch(url)]
    best = max(fit, key=lambda x: x[:3])[3] if fit else Rule(default, "")
    return best.name, best.verdict


@pytest.mark.parametrize("n_rules", [0, 1, 7, 60])
def test_random_globs(n_rules):
    rng = random.Random(n_rules)
    piece = lambda: "".join(rng.choice(["a", "b", "é", "/", ".", "*", "**", "?", "\\*", "ab", "漢"]) for _ in range(rng.randint(0, 7)))
    rules = [Rule(rng.choice(["allow", "block"]), piece(), rng.choice([None, "x" * rng.randint(1, 4)])) for _ in range(n_rules)]
    urls = ["".join(rng.choice(["a", "b", "é", "/", ".", "*", "漢", "ab"]) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["ab" * 5000 + "/", ""]
    filter_ = UrlFilter(rules, "allow")
    got = [(filter_.rules[i].name, filter_.rules[i].verdict) if i >= 0 else (None, "allow") for i in filter_.winners(pa.array(urls))]
    assert got == [brute(rules, "allow", u) for u in urls]


ROWS = [
    (0, "http://www.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (1, "http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (2, "http://example.com/en/?q", "example.com", "/en/", "example.com/en/", "block"),
    (3, "http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    (4, "http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    (5, "http://x.com", "x.com", "", None, "allow"),
    (6, "http://x.net/es/a#b", "x.net", "/es/a", "net/es/", "block"),
    (7, "http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    (8, "http://x.org/a.com/b", "x.org", "/a.com/b", None, "allow"),
    (9, "http://my-casino.org", "my-casino.org", "", None, "block"),
    (10, "http://free-bets.org/x", "free-bets.org", "/x", None, "block"),
    (11, "http://free-bets.com/x", "free-bets.com", "/x", "com/", "allow"),
    (12, "http://x.org/casino", "x.org", "/casino", None, "allow"),
    (13, None, "", "", None, "allow"),
    (14, "nothing", "", "", None, "allow"),
    (None, "http:///x.com/", "", "/x.com/", None, "allow"),
    (15, "a://b://c?d", "b:", "//c", None, "allow"),
    (16, "x://h.com?y=/en/", "h.com", "", None, "allow"),
    (17, "://é.net/fr/é\n", "é.net", "/fr/é\n", "net/fr/", "block"),
    (17, "://é.net/fr/é\n", "é.net", "/fr/é\n", "net/fr/", "block"),
    (18, "http://x.com/" + "a" * 200_000, "x.com", "/" + "a" * 200_000, "com/", "allow"),
]


def test_rows(spark):
    pages = spark.createDataFrame([(i, u, i, "h", "j") for i, u, *_ in ROWS], "page_id long, url string, rule long, host string, `judged.rule` string")
    rules = urlfilter.rules_of(urlfilter.NAMED, urlfilter.HOSTS)
    got = [tuple(r) for r in urlfilter.judge(pages, rules).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted([(i, *rest) for i, _, *rest in ROWS], key=key)
    kept = urlfilter.keep_allowed(pages, rules)
    assert kept.columns == pages.columns and kept.count() == sum(r[-1] == "allow" for r in ROWS)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, [], "block").collect()} == {"block"}


def test_no_shuffle_and_only_the_url_is_read(spark, sf_dir):
    from entigraph.llm.queries import QUERIES

    plan = QUERIES["op13_url_filters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "html" not in plan
