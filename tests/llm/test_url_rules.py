import random
import re

import pytest

from oresmith.llm import url_rules
from oresmith.llm.queries import HOST_RULES, URL_RULES


def brute(url, rules):
    """The fitting rule of highest rank, every rule tried."""
    if url is None:
        return None
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    fitting = [r for r in rules if re.search(r.regex, url_rules._lower_host(url) if r.match_case else lower)]
    return max(fitting, key=lambda r: (r.rank, r.name), default=None)


def by_contract(url):
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return None
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, _ in HOST_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://example.net/en/1", "HTTP://Example.NET/en/1", "http://example.net/EN/1", "http://notexample.net/en/1",
    "http://example.net", "http://example.net?x=/en/", "http://a.org/fr/", "http://a.orgx/fr/", "http://x.com/?u=http://y.net/", "://net/",
    "http://example.com/de/?login=1", "http://example.com/login", "http://example.com/logins", "http://example.com/a?page=2&ref=x",
]


def test_index_equals_trying_all_rules():
    choose = random.Random(2)
    parts = ["net", "example", "com", "org", "fr", "de", "en", "login", "cart", "page=1", "ref=", "www"]
    urls = URLS + [
        "http://" + "".join(choose.choice(parts) + choose.choice("./?&=-_:/#") for _ in range(choose.randint(1, 6))) for _ in range(3000)
    ]
    counts = {"net": 9, "example": 5}
    index = url_rules.RuleIndex(URL_RULES, counts)
    for url in urls:
        found = index.best(url)
        assert found == brute(url, URL_RULES), url
        if found is None or found.match_case:
            assert (found and found.name) == by_contract(url), url


def test_a_rule_is_filed_under_its_rarest_token():
    rule = url_rules.host_rule("example.net/en/", "allow", (1, 1))
    assert set(rule.tokens) == {"example", "net", "en"}
    index = url_rules.RuleIndex([rule], {"example": 7, "net": 9, "en": 2})
    assert list(index.filed) == ["en"]


def test_tokens_next_to_a_wildcard_are_not_used():
    assert url_rules.PatternRule("x", "^redirect*url=^id=", "block", (0,)).tokens == ["id"]
    index = url_rules.RuleIndex([url_rules.PatternRule("x", "^redirect*url=", "block", (0,))], {})
    assert not index.filed and index.best("http://a/redirect?url=b").name == "x"


@pytest.mark.parametrize("empty", [False, True])
def test_frames(spark, empty):
    rows = [(i, url, "x") for i, url in enumerate(URLS + URLS[3:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").where("false" if empty else "true")
    judged = url_rules.judge_urls(pages, "url", URL_RULES, ["page_id"]).collect()
    assert len(judged) == (0 if empty else len(rows))
    for row in judged:
        expected = brute(rows[row["page_id"]][1], URL_RULES)
        assert (row["rule"], row["verdict"]) == ((expected.name, expected.verdict) if expected else (None, None))
    if not empty:
        at = {r["page_id"]: (r["host"], r["path"]) for r in judged}
        assert at[0] == at[1] == at[2] == ("", "") and at[4] == ("example.net", "/en/1") and at[8] == ("example.net", "")
