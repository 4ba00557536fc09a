from pyspark.sql import functions as F

from lintlake.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<!-- <p>not this</p> --><div class="cookie-notice">We use cookies</div><div class="wrap-{n}"><div class="{cls}">
<h1>Title &amp; more</h1><p>First <b>bold</b>
   text&nbsp;here.<p>Second<br>line {n} &lt;3 <a href=x>linked</a> &am<ul><li>one<li>two</ul>
<form><input><label>mail</label></form><div class="share-buttons">Share</div><blockquote>Quote</blockquote></div>
<div class="comments"><p>{long}</p></div></div>
<aside>Side</aside><div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""
WANT = "Title & more\nFirst bold text here.\nSecond line {n} <3 linked &am\none\ntwo\nQuote"


def page(n, cls="x1"):
    return PAGE.format(n=n, cls=cls, long="Comment text. " * 30)


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("host", "path", "score", "text", "salt")})
    return sorted((tuple(r) for r in pages.extract(df).select("page_id", "url", "text", "n_chars").collect()), key=str)


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", page(i)) for i in range(6)]
    for i, _, text, n in run(spark, rows):
        assert text == WANT.format(n=i) and n == len(text)


def test_hosts_agree_on_a_path(spark):
    # one page's sidebar without a telling name outweighs its article
    odd = '<body><div class="c7"><p>{a}</p></div><div class="k3"><p>{b}</p></div></body>'
    rows = [(i, "http://host.org/x", odd.format(a="Article text. " * 50, b="Short.")) for i in range(9)]
    rows.append((9, "http://HOST.org/y", odd.format(a="Brief.", b="Long box. " * 200)))
    rows.append((10, "none", odd.format(a="Brief.", b="Long box. " * 200)))
    got = {i: t for i, _, t, _ in run(spark, rows)}
    assert got[9] == "Brief." and got[10] == ("Long box. " * 200).strip()


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.com/", page(i, f"body-{i}")) for i in range(9)]
    want = run(spark, rows)
    monkeypatch.setattr(pages, "BROADCAST_HOSTS", 0)
    assert run(spark, rows) == want


def test_edges(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [
        (1, None, None), (2, "http://a.b/", ""), (None, "http://a.b/", "plain text &lt;b&gt;"), (3, "x", "<p>open <i>never closed"), (4, "x", "<!-- open comment <p>x</p>"),
        (5, "x", '<p title="a>b">quoted</p>'), (5, "x", '<p title="a>b">quoted</p>'), (6, "x", long), (7, "x", "<script>no end <p>x</p>"), (8, "x", "a < b > c"), (9, "x", '<p class="open>text</p>'),
        (10, "x", "</p></div>text</article>"), (11, "x", "<table><tr><td>a<td>b<tr><td>c</table>"),
    ]
    got = {}
    for i, _, text, n in run(spark, rows):
        assert n == len(text)
        got.setdefault(i, []).append(text)
    assert got[1] == [""] and got[2] == [""] and got[None] == ["plain text <b>"] and got[3] == ["open never closed"]
    assert got[4] == [""] and got[5] == ["quoted", "quoted"] and got[6] == ["\n".join(["word"] * 20_000)]
    assert got[7] == [""] and got[8] == ["a < b > c"] and got[10] == ["text"] and got[11] == ["a b\nc"]
    assert run(spark, rows[:0]) == []
