"""JavaScript tokens: regular expressions at any indentation, code in template literals."""

import pytest

from lintlake.operators import relations as R
from lintlake.operators import rules_typescript


def toks(sources, text):
    rows = R.tokens(sources({"a.ts": text}), "typescript").orderBy("pos").collect()
    return [(r["tok"], r["kind"], r["line"]) for r in rows if r["kind"] not in ("newline",)]


@pytest.mark.parametrize("blanks", [0, 4, 14, 300])
def test_regex_after_any_blanks(sources, blanks):
    pad = "\n" + " " * blanks
    text = f"const a = [{pad}/`/,{pad}eval(x),{pad}/['\"]\\//g /* c */ ];\nreturn{pad}/'/;b++ / c / d; x = y / 2 / z"
    got = [t for t, k, _ in toks(sources, text) if k == "regex"]
    assert got == ["/`/", "/['\"]\\//g", "/'/"]
    assert "eval" in [t for t, _, _ in toks(sources, text)]
    lines = {t: n for t, _, n in toks(sources, text)}
    assert (lines["/`/"], lines["eval"]) == (2, 3)


def test_first_thing_in_a_file_and_comments_between(sources):
    assert toks(sources, "\n\n /a`b/.test(x)")[0] == ("/a`b/", "regex", 3)
    got = toks(sources, "f( // one\n /* two\n */ /r'/)")
    assert got == [("f", "word", 1), ("(", "punct", 1), ("// one", "comment", 1), ("/* two\n */", "comment", 2), ("/r'/", "regex", 3), (")", "punct", 3)]


def test_code_in_templates(sources):
    got = toks(sources, "x = `a\n${f({b: 1})} and ${\n g}`;y")
    assert [t for t, _, _ in got] == ["x", "=", "`a\n${", "+", "(", "f", "(", "{", "b", ":", "1", "}", ")", ")", "+", "} and ${", "+", "(", "g", ")", "+", "}`", ";", "y"]
    assert [k for t, k, _ in got if t[0] in "`}" and len(t) > 1] == ["template"] * 3
    assert {t: n for t, _, n in got}["f"] == 2 and got[-1] == ("y", "word", 3)
    rows = R.code_rows(sources({"a.ts": "const s = `${eval(x)}`;\nconst t = `plain eval(x)`;\n"}), "typescript")
    found = rules_typescript.RULES["ts/eval-usage"](rows).collect()
    assert [r["line_start"] for r in found] == [1]
