import random
import re

from pyspark.sql import functions as F

from lintlake.llm import urls


def direct(url, rules=(*urls.LISTED, *urls.WORDS)):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if re.search(r.pattern, host + path)]
    best = max(fits, key=lambda r: (r.listed, r.rank), default=None)
    return host, path, best.name if best and best.listed else None, best.verdict if best else "allow"


CASES = [
    None, "", "no scheme.com/en/", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "https://example.com/en", "https://example.com/en/", "https://xexample.com/en/x",
    "https://www.example.com/en/", "https://a.www.example.com/en/q", "http://net/es/", "http://a.net/es", "http://a.net/fr/x", "http://NET/FR/", "http://a.net/ES/",
    "ftp://casino.org/x", "x://my-casino-win.example.org/", "x://mycasinowin.org/", "http://com", "http://com/", "http://com.org/", "http://free-bets.net?x=/es/",
    "http://a.org/x?u=http://b.net/fr/", "http://ads-track.example.org#casino", "http://user@example.com/en/", "http://example.com:80/en/", "a\nb://example.com/en/\nx", "http://İ.net/es/",
]


def test_against_all_rules(spark):
    rnd = random.Random(2)
    made = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.', 'm.', 'blog.'])}{rnd.choice(['example', 'casino', 'ads-track', 'free-bets', 'porn.x', 'doubleclick'])}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en/', 'es/', 'fr/', 'wp-login.php', ''])}{rnd.randrange(9)}" for _ in range(200)]
    rows = [(i, u) for i, u in enumerate([*CASES, *made, *CASES])] + [(None, "http://a.net/fr/"), (1, "http://a.net/fr/")]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "token", "rule", "best", "n")})
    got = sorted((tuple(r) for r in urls.filter_urls(pages).collect()), key=str)
    assert got == sorted(((i, *direct(u)) for i, u in rows), key=str)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_the_rarest_token(spark):
    tokens = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("",)] * 9, "token string")
    rules = [urls.word_rule("block", "a.*b", "a", "b"), urls.word_rule("block", "a.*z", "a", "z"), urls.word_rule("block", ".")]
    filed = {r["name"]: r["token"] for r in urls.rule_index(tokens, rules).collect()}
    assert filed == {"a.*b": "b", "a.*z": "z", ".": ""}


def test_many_rules_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 1)
    pages = spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string")
    got = sorted((tuple(r) for r in urls.filter_urls(pages).collect()), key=str)
    assert got == sorted(((i, *direct(u)) for i, u in enumerate(CASES)), key=str)


def test_every_branch_of_a_rule_is_fetched(spark):
    xxx = ["http://xxx-clips.net/a", "http://www.xxx-a1.org/", "http://my-xxx-clips-x.com", "http://a.org/b.xxx-c.html", "http://XXX-clips.net/", "http://a.porn.org/"]
    free = ["http://xxx.net/a", "http://axxx-clips.net/", "http://xxx-clips/", "http://a.xxx/-clips.", "http://a.net/XXX-b.c"]
    pages = spark.createDataFrame(list(enumerate([*xxx, *free])), "page_id long, url string")
    got = sorted((tuple(r) for r in urls.filter_urls(pages).collect()), key=str)
    assert got == sorted(((i, *direct(u)) for i, u in enumerate([*xxx, *free])), key=str)
    both = re.compile(r"(^|[.-])casino[.-]|(^|[.-])free-bets[.-]|(^|[.-])ads-track[.-]|(^|[.-])(porn|xxx-\w+)[.-]")
    assert all((r[4] == "block") == bool(both.search(r[1] + r[2])) for r in got)
