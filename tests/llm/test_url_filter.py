import random

import pytest

from check import frame
from tallygrain.llm import url_filter
from tests.conftest import SF

SCHEMA = "page_id long, url string"


@pytest.fixture()
def judged(spark, rows):
    def run(urls, **kw):
        df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], SCHEMA)
        out = url_filter.filter_urls(df, **kw)
        return [(r["host"], r["path"], r["rule"], r["n_strict"], r["n_soft"], r["verdict"]) for r in out.orderBy("page_id").collect()]

    return run


def test_matches_sql(spark, duck):
    df = url_filter.op1_url_filter(spark, SF)
    cursor = duck.execute(url_filter._check_sql())
    assert frame(df.columns, df.collect()) == frame([d[0] for d in cursor.description], cursor.fetchall())


def test_host_path_and_longest_rule(judged):
    got = judged(
        [
            "https://WWW.Example.com/en/x?y=/fr/",
            "http://a.example.com/en/",
            "http://notexample.com/en/",
            "http://net/fr/1",
            "http://a.net/frx",
            "http://a.com",
            "http://a.com#/",
            "//a.com/",
            None,
            "",
            "x://É.COM/É",
        ]
    )
    assert [(g[0], g[1], g[2], g[5]) for g in got] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"),
        ("notexample.com", "/en/", "com/", "allow"),
        ("net", "/fr/1", "net/fr/", "block"),
        ("a.net", "/frx", None, "allow"),
        ("a.com", "", None, "allow"),
        ("a.com", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("É.com", "/É", "com/", "allow"),
    ]


def test_terms_count_at_boundaries(judged):
    got = judged(
        ["http://x.org/spam", "http://x.org/spammer/farms", "http://x.org/spam/spam", "http://x.org/SPAM_farm", "http://spam-farm.org", "http://xspam-farm.org"]
    )
    assert [g[3:] for g in got] == [
        (0, 1, "allow"),
        (0, 0, "allow"),
        (0, 1, "allow"),
        (0, 2, "block"),
        (1, 2, "block"),
        (0, 1, "allow"),
    ]


def test_automaton_equals_plain_search():
    rng = random.Random(5)
    found = url_filter.automaton(url_filter.STRICT, url_filter.SOFT)
    pieces = [*url_filter.STRICT, *url_filter.SOFT, "-", "/", ".", "a", "7", "é"]

    def alone(url, term):
        edge = lambda c: c not in url_filter.LETTER_OR_DIGIT
        at = [i for i in range(len(url)) if url.startswith(term, i)]
        return sum((i == 0 or edge(url[i - 1])) and (i + len(term) == len(url) or edge(url[i + len(term)])) for i in at)

    for _ in range(500):
        url = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        want = (sum(alone(url, t) for t in url_filter.STRICT), sum(alone(url, t) > 0 for t in url_filter.SOFT))
        assert url_filter.terms_in(url, found) == want


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", host string, verdict int")
    assert url_filter.filter_urls(df).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/" + "x" * 100_000, "h", 3)] * 2, SCHEMA + ", host string, verdict int")
    assert [r["verdict"] for r in url_filter.filter_urls(one).collect()] == ["allow", "allow"]


def test_vocabulary_of_100_000_terms_from_a_table(spark):
    rng = random.Random(8)
    terms = [("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 12))), rng.choice(["strict", "soft"])) for _ in range(100_000)]
    terms += [("BOTH-ways", "soft"), ("both-WAYS", "strict"), (None, "soft"), ("", "strict"), ("other", "unknown")]
    table = spark.createDataFrame(terms, "term string, class string")
    strict, soft = url_filter.vocabulary(table)
    classes = {}
    for t, c in terms:
        if t and c != "unknown":
            t = t.lower()
            classes[t] = max(c, classes.get(t, ""))
    assert (set(strict), set(soft)) == tuple({t for t, c in classes.items() if c == k} for k in ("strict", "soft"))
    urls = ["/".join(rng.choice(terms[:5000])[0] + rng.choice(["", "", "x9"]) for _ in range(4)) for _ in range(400)]
    df = spark.createDataFrame([(i, "http://a.org/" + u) for i, u in enumerate(urls)], SCHEMA)
    got = url_filter.filter_urls(df, strict=strict, soft=soft).orderBy("page_id").collect()
    strict, soft = set(strict), set(soft)
    for r, u in zip(got, urls):
        words = ["http", "a", "org", *u.split("/")]
        hits = sum(w in strict for w in words), len({w for w in words if w in soft})
        assert (r["n_strict"], r["n_soft"]) == hits
        assert r["verdict"] == ("block" if hits[0] or hits[1] >= 2 else "allow")


def test_a_worker_builds_its_automaton_once():
    first = url_filter.kept_automaton("k", ("a",), ("b",))
    assert url_filter.kept_automaton("k", ("a",), ("b",)) is first
    other = url_filter.kept_automaton("l", ("c",), ())
    assert other is not first and len(url_filter._KEPT) == 1


def test_of_equally_long_rules_the_first_counts(judged):
    rules = (url_filter.Rule("b.org", "/", "block"), url_filter.Rule("org", "/ab", "allow"), url_filter.Rule("b.org", "/", "allow"))
    assert [g[2::3] for g in judged(["http://b.org/ab"], rules=rules)] == [("b.org/", "block")]
