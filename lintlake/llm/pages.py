"""Main text of web pages by consensus host paths.

A page is read into text blocks, each with the paths of the containers it stands in: tags with
classes and ids, digits generalised. A page scores its containers by the share of its good text
they hold, and votes for the best. Spark counts the votes per host and path; the path that wins
a host is then used to extract all its pages, and a page that lacks it, or has no host, uses its
own best.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import BATCH_BYTES, cut, small_batches
from lintlake.llm.urls import host_of

#: Winning paths of up to this many hosts are sent to every task; more are joined by salted host.
BROADCAST_HOSTS, SALTS = 100_000, 16

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre "
    "blockquote figure figcaption address details summary header footer nav aside form fieldset hr dialog menu center "
    "hgroup search legend optgroup option select".split()
)
#: Blocks that may hold a page's main text.
CONTAINER = frozenset("html body main article section div td table tbody tr ul ol blockquote form center".split())
#: Elements that are never main text.
DROPPED = frozenset(
    "head nav footer aside form script style noscript button select option textarea title iframe svg canvas template "
    "dialog menu object audio video map search xmp noembed noframes datalist".split()
)
PARAGRAPH_ENDS = BLOCK - {"html", "body"}
#: Words of a class, an id or a role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead comment comments disqus reply "
    "replies respond notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup "
    "login share sharing social related recommended recommendations pagination pager toolbar skip copyright legal "
    "search complementary contentinfo".split()
)
#: With these a class speaks of a page's layout.
LAYOUT = frozenset("with has no without layout".split())
TEXT_WORDS = frozenset("article content post entry main story text body".split())
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")


class Block:
    """A block's text, how much of it stands in links, and its containers' paths."""

    __slots__ = ("text", "linked", "paths")

    def __init__(self, text: str, linked: int, paths: tuple[str, ...]):
        self.text, self.linked, self.paths = text, linked, paths


class _Open:
    __slots__ = ("tag", "path", "dropped", "article", "link", "container")

    def __init__(self, tag, path, dropped, article, link, container):
        self.tag, self.path, self.dropped, self.article, self.link, self.container = tag, path, dropped, article, link, container


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without what is never main text."""
    root = _Open("", "", False, False, False, False)
    stack = [root]
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    containers: tuple[str, ...] = ("",)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), containers))
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal containers
        while len(stack) > to:
            if stack.pop().container:
                containers = containers[:-1]

    at = 0
    while True:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not stack[-1].dropped:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1].link:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in VOID:
                continue
            if tag in BLOCK or tag in ("td", "th"):
                flush()
            # an inline end tag does not reach over the block it stands in
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCK and not stack[-1].dropped:
                        flush()
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
                if tag == "p" and stack[i].tag in CONTAINER:
                    break
            continue
        top = stack[-1]
        if tag == "br" or tag in ("td", "th"):
            pieces.append(" ")
        if tag in BLOCK:
            flush()
            if tag in PARAGRAPH_ENDS:
                _end_open(stack, close, ("p",), CONTAINER)
            if tag == "li":
                _end_open(stack, close, ("li",), ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                _end_open(stack, close, ("dt", "dd"), ("dl",))
            elif tag == "tr":
                _end_open(stack, close, ("tr", "td", "th"), ("table",))
            top = stack[-1]
        elif tag in ("td", "th"):
            _end_open(stack, close, ("td", "th"), ("tr", "table"))
            top = stack[-1]
        if tag in VOID:
            continue
        attributes = m[3] if m[2] else m[6]
        names, words, hidden = _named(attributes) if attributes and len(attributes) > 1 else ("", (), False)
        dropped = top.dropped or tag in DROPPED or hidden or (tag == "header" and not top.article)
        if not dropped and tag not in ("html", "body", "main", "article") and words:
            dropped = _marked(words, top.article)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes and attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        path = f"{top.path}/{tag}{names}" if tag in CONTAINER else top.path
        if tag in CONTAINER:
            containers = (*containers, path)
        stack.append(_Open(tag, path, dropped, top.article or tag in ("article", "main"), top.link or tag == "a", tag in CONTAINER))
    flush()
    return out


def _end_open(stack: list[_Open], close, tags: tuple[str, ...], bounds) -> None:
    """Ends an open element of ``tags`` that nothing of ``bounds`` encloses more closely."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            close(i)
            if len(tags) == 1 or tags[0] != "tr":
                return
        elif stack[i].tag in bounds:
            return


def _named(attributes: str) -> tuple[str, tuple[str, ...], bool]:
    """The part of a path that names an element, its words, and whether it is hidden."""
    names, words, hidden = [], [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" and value != "until-found" or value == "true"
            continue
        words.extend(value.split())
        if key == "class":
            names.extend(f".{w}" for w in sorted(set(re.sub(r"\d+", "#", value).split())))
        elif key == "id" and value:
            names.append("!" + re.sub(r"\d+", "#", value))
    return "".join(names), tuple(words), hidden


def _marked(words: tuple[str, ...], in_article: bool) -> bool:
    for word in words:
        parts = [p for p in SPLIT.split(word) if p]
        if LAYOUT.intersection(parts):
            continue
        if MARKS.intersection(parts) or ("header" in parts and not in_article):
            return True
    return False


def scores_of(blocks: list[Block]) -> dict[str, float]:
    """For each container path with at least half of the good text: its share, a little more
    the deeper it lies, and more if its name speaks of an article."""
    total, share = 0, {}
    for b in blocks:
        good = len(b.text) - b.linked
        total += good
        for path in set(b.paths):
            share[path] = share.get(path, 0) + good
    out = {}
    for path, good in share.items():
        if total and 2 * good >= total:
            last = path.rsplit("/", 1)[-1]
            named = 1.3 if re.split(r"[.!]", last)[0] in ("article", "main") else 1.15 if TEXT_WORDS.intersection(SPLIT.split(last.partition(".")[2] + " " + last.partition("!")[2])) else 1.0
            out[path] = good / total * named * (1 + 0.01 * path.count("/"))
    return out


def _best(scores: dict[str, float]) -> str:
    return max(scores, key=lambda p: (scores[p], p), default="")


def text_of(blocks: list[Block], path: str | None) -> str:
    """The text below ``path``; below the page's own best if it does not have that."""
    found = [b.text for b in blocks if path in b.paths] if path is not None else []
    if not found and blocks:
        own = _best(scores_of(blocks))
        found = [b.text for b in blocks if own in b.paths]
    return "\n".join(found)


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes, score``: over all pages that have a host, how many find a path best,
    and the sum of its scores."""
    small_batches(pages)
    own = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).where("host <> '' AND html <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                scores = scores_of(blocks_of(page.as_py()))
                best = _best(scores)
                for path, score in scores.items():
                    held = total.setdefault((host, path), [0, 0])
                    held[0] += path == best
                    held[1] += round(score * 1000)  # whole numbers: sums do not hang on their order
            if total:
                rows = [(h, p, *held) for (h, p), held in total.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "votes", "score"])

    return own.mapInArrow(run, "host string, path string, votes long, score long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """``host, path``: each host's path of most votes, of equals that of the highest sum, then
    the last by name."""
    return votes(pages).groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` per row: the main text and the host's path.

    Character references are decoded, white space in a block is one blank, blocks are joined
    by line breaks in page order. Null or empty html gives the empty text. A page without a
    host goes by itself. Repeated rows get a row each, extra columns play no part.
    """
    best = cut(winners(pages))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    if best.count() <= BROADCAST_HOSTS:
        joined = own.join(F.broadcast(best), "host", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = dict(own.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "n_chars", "path"]
        for batch in batches:
            start, held, texts = 0, 0, []
            paths = batch.column("path").to_pylist()
            for i, page in enumerate(batch.column("html")):
                text = text_of(blocks_of(page.as_py() or ""), paths[i])
                texts.append(text)
                held += len(text)
                if held > BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), part.column("path")], names=names)
                    start, held, texts = i + 1, 0, []

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")
