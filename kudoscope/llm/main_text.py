"""Main text of web pages by template deduction over the pages of a host.

Tokens are tags and text pieces, told apart by their path of open elements.
Pages of a host whose articles read alike are one page here: copies say nothing
about a template.  Tokens with the same occurrence vector over a host's different
pages (how often in which page) form a class; vectors are compared by page counts,
totals and a sum of page hashes, which partial aggregates can build for hosts of any
size.  Classes of three tokens or more that occur in most pages are valid if their
span of page places lies inside or outside the span of every better supported class;
the valid classes together are the host's template.

Text pieces that the template does not hold are slots.  A page's main text are
the slots of its article (or main) element; where it has none, those of the
body without link lists.  Inside an article a block goes only as a whole, when all
its pieces are in the template: a repeated share line, notice or list of stories
goes, a word that many articles set in bold stays.  An article of which nothing would
be left is taken as it is.  Navigation, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments go, by element and by the
words of class and id: whole names, or their first or last part, but no name
that says has, no or with.  Name words never drop html, body, main or article,
and inside an article "header" is no such word.  Where they drop what lies
around a page's only article, the article is taken if it holds more than the
rest of the body.

Templates are small and are broadcast while their tokens stay under
``BROADCAST_TOKENS``; beyond that they are joined by a shuffle.  A null or
empty page has an empty text, a null url the host ``''``; repeated rows are
treated alike.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.llm.common import written

BROADCAST_TOKENS = 1_000_000
CLASS_TOKENS = 3
HOST_PAGES = 3
HELD_TOKENS = 50_000  # counted tokens that a task holds

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "nav header footer aside form button select option dialog menu head canvas audio video object map".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul li".split()
)
# Words of class and id that mark what is not the article.
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list "
    "cookie cookies consent disqus footer header hidden login masthead menu modal nav navbar navigation newsletter "
    "notice pager pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
UNNAMED = MAIN | {"html", "body"}  # never dropped by name words
STATES = frozenset("has no not with without".split())  # names that tell of the page, not of the element
# Kinds of drop: for good; by name words around an article; by name words.
GONE, AROUND, NAMED = 1, 2, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|iframe|template|textarea|title|svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*>|<[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])|-")


class Node(NamedTuple):
    token: int
    text: str | None  # None: a tag
    block: int
    main: bool
    dropped: int  # 0: kept
    link: bool


def _is_role(attributes: str, main: bool = False) -> bool:
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [w.lower() for w in _SPLIT.split(name) if w]
            if STATES.isdisjoint(parts):
                ends = {name.lower(), *parts[:1], *parts[-1:]} - ({"header"} if main else set())
                if not ROLE_WORDS.isdisjoint(ends):
                    return True
    return False


def _drop(name: str, attributes: str, main: bool, above: int) -> int:
    """The kind of drop of an element, from its own names and what lies above."""
    if above == GONE or (name in BOILERPLATE and not (name == "header" and main)):
        return GONE
    if name in MAIN and above == NAMED:
        return GONE if _is_role(attributes) else AROUND
    if above == NAMED or name in UNNAMED or not _is_role(attributes, main):
        return above
    return GONE if above == AROUND else NAMED


def _hash(path: str, value: str) -> int:
    h = xxhash.xxh64_intdigest(f"{path}\0{value}")
    return h - (1 << 64) if h >> 63 else h


def nodes(page: str | None) -> Iterator[Node]:
    """Tags and text pieces of a page in order."""
    page = page or ""
    stack: list[tuple[str, str, bool, int, bool]] = []  # name, path, main, dropped, link
    top = ("", "", False, 0, False)
    block = at = 0

    def piece(end: int) -> Iterator[Node]:
        if end > at:
            raw = page[at:end]
            if raw.strip():
                yield Node(_hash(top[1], raw.strip()), entities.unescape(raw), block, *top[2:])
            elif raw:
                yield Node(0, " ", block, *top[2:])

    for m in _TOKEN.finditer(page):
        yield from piece(m.start())
        at = m.end()
        name = (m[3] or "").lower()
        if m[1] or not name:
            continue
        if name == "br":
            yield Node(0, " ", block, *top[2:])
        if name not in INLINE and name != "br":
            block += 1
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in MAIN or stack[k][0] in ("div", "section", "td", "li"):
                        break
            up = stack[-1] if stack else ("", "", False, 0, False)
            path = f"{up[1]}/{name}"
            if name not in VOID:
                dropped = _drop(name, m[4], up[2], up[3])
                stack.append((name, path, up[2] or name in MAIN, dropped, up[4] or name == "a"))
            yield Node(_hash(path, "<>"), None, block, up[2], up[3], up[4])
        top = stack[-1] if stack else ("", "", False, 0, False)
    yield from piece(len(page))


def _host():
    return F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _print(found: list[Node]) -> int:
    """What the article of a page reads, as a number (of the whole page where it
    has no article)."""
    pieces = [n for n in found if n.text is not None and n.token and not n.dropped]
    inner = [n for n in pieces if n.main] or pieces
    return _hash("", " ".join(" ".join(n.text for n in inner).split()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a batch's pages, folded by host and article: count, first and last
    place; token 0 stands for the page."""
    found: dict[tuple[str, int, int], tuple] = {}
    for batch in batches:
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            own = list(nodes(page))
            mark, n = _print(own), max(1, len(own))
            seen: dict[int, list] = {0: [1, 0, 0]}
            for at, node in enumerate(own, 1):
                if node.token:
                    x = seen.setdefault(node.token, [0, at, at])
                    x[0] += 1
                    x[2] = at
            for token, (count, first, last) in seen.items():
                key, x = (host, mark, token), (count, first / n, last / n)
                found[key] = max(found.get(key, x), x)
            if len(found) >= HELD_TOKENS:
                yield _token_rows(found)
                found.clear()
    yield _token_rows(found)


def _token_rows(found: dict[tuple[str, int, int], tuple]) -> pa.RecordBatch:
    keys, values = list(zip(*found)) or [[]] * 3, list(zip(*found.values())) or [[]] * 3
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(keys[0]), pa.string()), *[pa.array(list(k), pa.int64()) for k in keys[1:]],
            pa.array(list(values[0]), pa.int64()), *[pa.array(list(v), pa.float64()) for v in values[1:]],
        ],
        names=["host", "page", "token", "count", "first", "last"],
    )


def templates(pages: DataFrame) -> DataFrame:
    """``host`` and the token hashes of its template."""
    seen = F.max(F.struct("count", "first", "last")).alias("x")
    salt = F.xxhash64("page").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = (
        pages.select(_host().alias("host"), "html")
        .mapInArrow(_counted, "host string, page bigint, token bigint, count bigint, first double, last double")
        .groupBy("host", "page", "token")
        .agg(seen)
        .groupBy("host", "token")
        .agg(
            F.count("*").alias("pages"),
            F.sum("x.count").alias("total"),
            F.sum((salt * F.col("x.count")).bitwiseAND(F.lit(0xFFFFFFFF))).alias("vector"),
            F.sum("x.first").alias("first"),
            F.sum("x.last").alias("last"),
        )
    )
    per_host = F.max(F.when(F.col("token") == 0, F.col("pages")))
    # tokens of few pages go before anything is gathered
    often = counts.where(F.col("pages") >= 2)
    sizes = counts.where("token = 0").groupBy("host").agg(per_host.alias("n"))
    classes = (
        often.where("token != 0")
        .join(sizes, "host")
        .where((F.col("n") >= HOST_PAGES) & (F.col("pages") * 2 > F.col("n")))
        .groupBy("host", "pages", "total", "vector")
        .agg(
            F.collect_list("token").alias("tokens"),
            F.min(F.col("first") / F.col("pages")).alias("lo"),
            F.max(F.col("last") / F.col("pages")).alias("hi"),
        )
        .where(F.size("tokens") >= CLASS_TOKENS)
        .groupBy("host")
        .agg(F.collect_list(F.struct("pages", "lo", "hi", "tokens")).alias("classes"))
    )
    crosses = lambda c, d: (
        (d["pages"] > c["pages"])
        & (((d["lo"] < c["lo"]) & (c["lo"] < d["hi"]) & (d["hi"] < c["hi"])) | ((c["lo"] < d["lo"]) & (d["lo"] < c["hi"]) & (c["hi"] < d["hi"])))
    )
    valid = F.filter("classes", lambda c: ~F.exists("classes", lambda d: crosses(c, d)))
    return classes.select("host", F.flatten(F.transform(valid, lambda c: c["tokens"])).alias("template"))


def _own_blocks(inner: list[Node], template: frozenset[int]) -> list[Node]:
    """The blocks of an article that hold a piece outside the template; all of them
    where none does."""
    own = {n.block for n in inner if n.token and n.token not in template}
    return [n for n in inner if n.block in own or not n.token] if own else inner


def extract(page: str | None, template: frozenset[int]) -> str:
    """Main text of a page: the slots its template leaves, block by block."""
    pieces = [n for n in nodes(page) if n.text is not None]
    kept = [n for n in pieces if not n.dropped]
    inner = _own_blocks([n for n in kept if n.main], template)
    if not any(n.token for n in inner):
        inner = [n for n in kept if n.token not in template or not n.token]
        linked: dict[int, list[int]] = {}
        for n in inner:
            x = linked.setdefault(n.block, [0, 0])
            x[n.link] += len(n.text.strip())
        inner = [n for n in inner if linked[n.block][0] >= linked[n.block][1]]
        around = [n for n in pieces if n.dropped == AROUND]
        if sum(len(n.text.strip()) for n in around) > sum(len(n.text.strip()) for n in inner):
            inner = around
    out, block = [], None
    for n in inner:
        if n.block != block:
            out.append(" ")
            block = n.block
        out.append(n.text)
    return " ".join("".join(out).split())


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, url, page, template = batch.columns
        hosts = template.to_pylist()
        texts = [extract(p, frozenset(t or ())) for p, t in zip(page.to_pylist(), hosts)]
        yield pa.RecordBatch.from_arrays(
            [page_id, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main text and its length of every page."""
    found = written(templates(pages))
    tokens = found.agg(F.sum(F.size("template") + 8)).first()[0] or 0
    side = F.broadcast(found) if tokens <= BROADCAST_TOKENS else found
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html", _host().alias("host"))
    return (
        rows.join(side, "host", "left")
        .select("page_id", "url", "html", "template")
        .mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
    )
