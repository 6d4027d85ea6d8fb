"""Main text of web pages by template deduction over the pages of a host.

Tokens are the tag paths of a page, with their classes, and the texts of its blocks. Across the pages of
one host each token has an occurrence vector: how often it stands in each page. Tokens with equal vectors
form an equivalence class. A class that holds tag paths and stands equally often in most pages is part of
the host's template, and its paths nest it. What the template leaves open are slots. Slots inside menus,
headers, footers, sidebars, notices, adverts, forms and comments are named as such by their tags, classes,
ids or roles; the other slots hold the main text.

Where a page marks its article, slots outside it are no main text. Inside it a text is template only if it
shares a class with the path that it stands in, so that this element never holds another text: a notice in
an element of its own goes, a sentence that many articles repeat among other paragraphs stays, and so does
any heading. Outside articles a text is template if its class holds any tag path.

Vectors are hashed and summed by host and token with partial aggregates, so a host may hold any number of
pages; a task extracts page by page. A template has at most as many tokens as two average pages.
"""

from __future__ import annotations

import html as _entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meandra.llm.common import BROADCAST_KEYS, cut, short
from meandra.llm.urls import host_of

#: Share of a host's pages that hold a template token, and least number of them.
SUPPORT, LEAST = 0.5, 3
#: Template tokens that are broadcast at most (16 bytes each); more are joined by shuffle.
BROADCAST_TOKENS = 500_000
# Elements without text, elements that close themselves, elements that part blocks.
RAW = frozenset("script style noscript template iframe svg math object canvas head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
# Elements, and words of class, id or role, that mark what is no main text.
ASIDE = frozenset("nav footer aside form button select textarea input label fieldset menu dialog".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar masthead complementary contentinfo dialog form".split()
)
# Words that only say which or where beside a mark (site-footer); elements that no mark takes out; elements whose text ends nowhere else.
BESIDE = frozenset("site main page top bottom left right primary secondary global post article entry list item items link links box bar block container wrapper wrap inner area section panel widget widgets unit slot".split())
FRAME = frozenset("html body main article".split())
CODE = frozenset("script style".split())
# Elements inside a line, which no class takes out; elements that a slash closes; headings.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SLASH = frozenset("svg math".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_PART = re.compile(r"=\s*[\"']|>")
_CLASS = re.compile(r"(?:^|[\s\"'])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_OPENS = re.compile(rf"<(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)


class Block:
    __slots__ = ("path", "name", "text", "aside", "article", "main", "inner")

    def __init__(self, path: int, name: str, text: str, aside: bool, article: bool, main: bool, inner: bool):
        # path: hash of the tag path; inner: beside the main text by what stands inside the outermost article alone
        self.path, self.name, self.text, self.aside, self.article, self.main, self.inner = path, name, text, aside, article, main, inner


def _marked(attributes: str, inside: bool) -> tuple[bool, bool]:
    """(marks something beside the main text, marks the main text) by class, id or role.

    A name marks as a whole: all its words are marks or say which one, so no-sidebar is none.
    """
    beside = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for name in value.split():
            words = {w.lower() for w in _WORDS.findall(name)}
            marks = words & (MARKS if inside else MARKS | {"header"})
            beside |= bool(marks) and words <= marks | MARKS | BESIDE
            main |= m[1].lower() == "role" and "main" in words
    return beside, main


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of each tag; name is empty for comments and declarations. Linear in the page.

    A quote only opens a value after an equals sign. One that never closes, or a tag without an end,
    is read as if quotes had no meaning from there on; a last tag without an end is text.
    """
    at, quotes, size = 0, True, len(page)
    while (m := _START.search(page, at)) is not None:
        if m[1]:
            end = page.find("-->", m.end())
            at = size if end < 0 else end + 3
            yield m.start(), at, False, "", ""
            continue
        if m[2]:
            end = page.find(">", m.end())
            at = size if end < 0 else end + 1
            yield m.start(), at, False, "", ""
            continue
        end, look = -1, m.end()
        while quotes and (part := _PART.search(page, look)) is not None:
            if part[0] == ">":
                end = part.start()
                break
            close = page.find(part[0][-1], part.end())
            if close < 0:
                break
            look = close + 1
        if end < 0:
            quotes = False
            end = page.find(">", m.end())
            if end < 0:
                return
        at = end + 1
        moved = yield m.start(), at, bool(m[3]), m[4].lower(), page[m.end() : end]
        if moved is not None:
            at = moved
            yield at, at, False, "", ""


def parse(page: str) -> tuple[Counter, list[Block]]:
    """Hashes of the tag paths with their numbers, and the blocks of text in page order. Linear in the page, however deep."""
    paths: Counter = Counter()
    blocks: list[Block] = []
    # open elements: (name, path, beside the main text, in an article, in a main element, beside it by what is inside the article)
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    open_: Counter = Counter()
    endless: set[str] = set()
    text: list[str] = []
    where = stack[0]

    def flush() -> None:
        nonlocal text
        if text:
            joined = _SPACE.sub(" ", _entities.unescape("".join(text))).strip()
            if joined:
                blocks.append(Block(where[1], where[0], joined, *where[2:]))
            text = []

    def say(s: str) -> None:
        nonlocal where
        if s:
            if not text:
                where = stack[-1]
            text.append(s)

    def shut(i: int) -> None:
        for s in stack[i:]:
            open_[s[0]] -= 1
        del stack[i:]

    told, tags = 0, _tokens(page)
    for start, end, closes, name, attributes in tags:
        say(page[told:start])
        told = end
        if not name:
            continue
        if closes:
            if name in BLOCK:
                flush()
            if open_[name] > 0:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if any(s[2:4] != stack[i - 1][2:4] or s[5] != stack[i - 1][5] for s in stack[i:]):
                    flush()
                shut(i)
            continue
        top = stack[-1]
        beside, main = _marked(attributes, top[3] or top[4]) if "=" in attributes else (False, False)
        beside = (beside and name not in FRAME and name not in INLINE) or name in ASIDE or (name == "header" and not (top[3] or top[4]))
        if name in RAW:
            paths[_child(top[1], name, attributes)] += 1
            if not (name in SLASH and attributes.endswith("/")):
                found = None if name in endless else _ends(name).search(page, end)
                if found is not None:
                    told = found.end()
                elif name != "head":  # left open: code goes to the end of the page, others to where a block begins
                    endless.add(name)
                    following = None if name in CODE else _OPENS.search(page, end)
                    told = following.start() if following else len(page)
                if told != end:
                    tags.send(told)
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            say(" ")
        if name in VOID:
            paths[_child(top[1], name, attributes)] += 1
            continue
        if beside and not (top[2] and top[5]):
            flush()
        if name in BLOCK and open_["p"] > 0:  # a paragraph ends where the next block begins, so markup left open does not pile up
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    shut(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            top = stack[-1]
        path = _child(top[1], name, attributes)
        paths[path] += 1
        open_[name] += 1
        stack.append((name, path, top[2] or beside, top[3] or name == "article", top[4] or main or name == "main", top[3] and (top[5] or beside)))
    say(page[told:])
    flush()
    return paths, blocks


@lru_cache(maxsize=256)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


@lru_cache(maxsize=65_536)
def _step(parent: int, name: str, label: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{parent}/{name}.{label}".encode("utf-8", "surrogatepass")))


def _child(parent: int, name: str, attributes: str) -> int:
    """Hash of a tag path from that of its parent, so that a path costs the same at any depth."""
    found = _CLASS.search(attributes) if "=" in attributes else None
    return _step(parent, name, (found[1] or found[2] or found[3] or "") if found else "")


def _token(b: Block) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{b.path}\0{b.text}".encode("utf-8", "surrogatepass")))


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, token, own, n): the tag paths of a page, own being null, and its block texts that may be template.

    own is the path of a text inside an article, 0 outside: 0 is the path of no element.
    """
    for batch in short(batches):
        cols: list[list] = [[], [], [], [], []]
        for host, nr, page in zip(*(c.to_pylist() for c in batch.columns)):
            paths, blocks = parse(page or "")
            texts = {_token(b): (b.path if b.article else 0) for b in blocks if not b.aside and not (b.article and b.name in HEADING)}
            times = Counter(_token(b) for b in blocks)
            for token, own, n in [(p, None, n) for p, n in paths.items()] + [(t, own, times[t]) for t, own in texts.items()]:
                for col, x in zip(cols, (host, nr, token, own, n)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["host", "page", "token", "own", "n"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template array<long>): block texts in an equivalence class with template tags, host by host."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), F.col("html").cast("string").alias("html"))
    tokens = rows.mapInArrow(_page_tokens, "host string, page long, token long, own long, n long")
    sizes = cut(rows.groupBy("host").agg(F.count("*").alias("pages")))
    if sizes.count() <= BROADCAST_KEYS:  # checked size; else a host's tokens meet its size by shuffle
        sizes = F.broadcast(sizes)
    vectors = tokens.groupBy("host", "token", "own").agg(F.count("*").alias("support"), F.sum(F.xxhash64("page", "n").bitwiseAND(F.lit((1 << 40) - 1))).alias("vector"), F.min("n").alias("least"), F.max("n").alias("most"))
    steady = vectors.filter((F.col("support") >= LEAST) & (F.col("least") == F.col("most"))).join(sizes, "host").filter(F.col("support") >= F.ceil(F.col("pages") * SUPPORT))
    steady = cut(steady.select("host", "token", "own", "support", "vector"))
    tags = steady.filter("own is null").select("host", "vector", "support", "token")
    outside = steady.filter("own = 0").join(tags.select("host", "vector", "support").distinct(), ["host", "vector", "support"], "left_semi")
    inside = steady.filter("own <> 0").join(tags.withColumnRenamed("token", "own"), ["host", "vector", "support", "own"], "left_semi")
    return outside.select("host", "token").unionByName(inside.select("host", "token")).groupBy("host").agg(F.collect_set("token").alias("template"))


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The slots of one page that hold its main text, joined by blank lines."""
    _, blocks = parse(page)
    slots = [b for b in blocks if not b.aside]
    if not any(b.article for b in slots):  # a mark around the only articles of a page does not take them out
        slots = [b for b in blocks if b.article and not b.inner] or slots
    if any(b.article for b in slots):
        slots = [b for b in slots if b.article]
    elif any(b.main for b in slots):
        slots = [b for b in slots if b.main]
    return "\n\n".join(b.text for b in slots if not template or _token(b) not in template)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, frozenset[int]] = {}
    for batch in short(batches):
        texts = []
        for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            key = tuple(template or ())
            if key not in known:
                known = {key: frozenset(key)}
            texts.append(main_text(page or "", known[key]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    text: the blocks of the main text in page order, white space inside a block turned into one
    space, blocks trimmed and parted by two line feeds; character references are decoded. Nothing
    of the main text is dropped or capped. n_chars counts code points.

    Null or empty html gives an empty text. Pages without a host share the host ''. Repeated rows
    come back repeated, and nulls in page_id or url stay. Other columns are ignored. Markup that
    is never closed ends with its parent.
    """
    found = cut(templates(pages))
    facts = found.agg(F.count("*").alias("hosts"), F.sum(F.size("template")).alias("tokens")).first()
    if (facts["tokens"] or 0) + facts["hosts"] <= BROADCAST_TOKENS:
        found = F.broadcast(found)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
