"""Main text of web pages: structure first, then a suffix array per host.

A page is cut into blocks of text. Menus, headers, footers, side bars, notices,
adverts, forms, comments and the like are known by their elements and names;
paragraphs, headings, list items and the like inside an article are main text.
On every page, what is left (blocks outside an article, and blocks inside one
that no element marks as text) is judged by repetition: the token streams of a
host's pages, all blocks in page order, are concatenated, and stretches that
several pages share are boilerplate, as are shorter blocks that several pages
hold as a whole. Marked article text counts against blocks beside an article,
such as teasers, but not against text it may quote. A page keeps the blocks
that are its own.

The suffix array of a host is cut at `LENGTH` tokens. A token is repeated
exactly where it lies in `LENGTH` tokens that another page has, that is where
neighbours in the array have a common prefix of `LENGTH`; so suffixes are put
together by their first `LENGTH` tokens, by hash, and their order among others
is not needed. It is built in shards, of those suffixes alone that a block to
judge can have, and equal ones are combined before the shuffle, so neither a
large host nor a very common stretch lands in one task.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.bytewords import NOT_SPACE, chunks, mix
from docspark.llm.url_filter import host_of
from docspark.session import stored

#: Tokens two pages must share in a row for a stretch to count as repeated.
LENGTH = 6
#: A block goes when at least this share of its tokens is repeated.
COVERED = 0.8
#: Bits of the filter of suffixes that blocks to judge have; more suffixes let
#: more through, and change nothing else.
FILTER_BITS = 1 << 23

#: LOOSE is MAIN without an element that marks text; `blocks_of` says MAIN.
MAIN, FREE, CHROME, LOOSE = 0, 1, 2, 3

#: A tag of an element whose content is no text: its slash, name and attributes.
_NO_TEXT = r"<(/?)(noscript|template|svg|iframe|textarea|select|title)(?![\w:-])((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>"
_RAW = r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
_NO_TEXT_TAG = re.compile(f"{_RAW}|{_NO_TEXT}", re.S | re.I)
_TOKEN = re.compile(
    f"{_RAW}|{_NO_TEXT.replace('(/?)(', '/?(?:').replace('((?:', '(?:(?:')}"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CHROME_TAGS = frozenset(
    "nav header footer aside form button menu dialog head object audio video canvas fieldset".split())
_CHROME_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads advert adverts "
    "advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr "
    "notice alert newsletter subscribe subscription signup share sharing social comment comments "
    "disqus reply replies respond breadcrumb breadcrumbs related recommended popup modal overlay "
    "widget login search pagination pager toolbar skip copyright disclaimer".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
_STATES = frozenset("has with without no is not free enabled disabled".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary address".split())
_MAIN_NAMES = frozenset("article articlebody content post entry story".split())
#: Names that begin with one of these say what a text is about.
_TOPICS = frozenset("category categories cat tag tags topic topics label subject".split())
#: An opening tag of the key closes an open element of the values.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}


def _without_text(page: str) -> dict[int, int]:
    """Where elements without text begin, and the end of their end tags.

    Self-closed tags and those without an end tag hold nothing; only script
    and style run to the end of the page.
    """
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for tag in _NO_TEXT_TAG.finditer(page):
        if tag.group(3) is None:
            continue
        waiting = opened.setdefault(tag.group(3).lower(), [])
        if not tag.group(2):
            if not tag.group(4).endswith("/"):
                waiting.append(tag.start())
        elif waiting:
            ends[waiting.pop()] = tag.end()
    return ends


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order."""
    return [(MAIN if z == LOOSE else z, t) for z, t in _zoned(page)]


def _zoned(page: str) -> list[tuple[int, str]]:
    """`blocks_of`, with LOOSE told from MAIN."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at = FREE, 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                loose = zone == MAIN and next((n for n, _ in reversed(stack) if n not in _INLINE), "") not in _TEXT_TAGS
                out.append((LOOSE if loose else zone, text))

    no_text = _without_text(page)
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            held.append(page[at:token.start()])
        at = no_text.get(token.start(), token.end())
        name = token.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name in _INLINE and not token.group(4).strip():
            if not token.group(2):
                continue
            if not any(n == name for n, _ in stack):
                continue
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if token.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    zone_before = stack[i][1]
                    if zone_before != zone:
                        flush()
                    zone = zone_before
                    del stack[i:]
                    break
            continue
        zone = _close_implied(stack, name, zone)
        inner = _zone(name, token.group(4), zone, stack)
        if inner != zone:
            flush()
        stack.append((name, zone))
        zone = inner
    held.append(page[at:])
    flush()
    return out


def _close_implied(stack: list[tuple[str, int]], name: str, zone: int) -> int:
    closed = _CLOSES.get(name, set())
    if name not in _INLINE:
        closed = closed | {"p"}
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in closed:
            zone = stack[i][1]
            del stack[i:]
            break
        if stack[i][0] not in _INLINE and stack[i][0] not in ("td", "th"):
            break
    return zone


def _zone(name: str, attributes: str, zone: int, stack: list[tuple[str, int]]) -> int:
    words: set[str] = set()
    if attributes.strip():
        lowered = attributes.lower()
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", lowered) or "display:none" in lowered.replace(" ", ""):
            return CHROME
        for key, *values in _ATTRIBUTE.findall(lowered):
            value = "".join(values)
            if key in ("class", "id", "itemprop"):
                words |= _parts(value)
            elif key == "role":
                if value in _CHROME_ROLES:
                    return CHROME
                if value == "main":
                    words.add("content")
            elif key == "aria-hidden" and value == "true":
                return CHROME
    if zone == CHROME:
        # An article never lies in these; the element was left open.
        left_open = name in ("article", "main") and not words & _CHROME_NAMES and not any(
            n in ("aside", "footer", "div", "section", "ul") for n, _ in stack)
        if left_open:
            return MAIN
        return MAIN if name in _HEADINGS and _article_header(stack) else CHROME
    if name in ("body", "html"):
        return zone
    if name == "main" and zone == FREE:
        # The page says that this is its text, whatever else it is called.
        return MAIN
    if name in _CHROME_TAGS or words & _CHROME_NAMES:
        return CHROME
    if name in ("article", "main") or words & _MAIN_NAMES:
        return MAIN
    return zone


def _parts(names: str) -> set[str]:
    """Words of class names or an id; `has-sidebar` or `ad-free` name nothing,
    and neither do topics such as `category-notice`."""
    words: set[str] = set()
    for name in names.split():
        parts = _NAME.findall(name)
        if not parts or parts[0] in _STATES or parts[-1] in _STATES:
            continue
        if len(parts) == 1 or parts[0] not in _TOPICS:
            words |= set(parts)
    return words


def _article_header(stack: list[tuple[str, int]]) -> bool:
    """Directly in a header element of an article: its headings are text."""
    return bool(stack) and stack[-1][0] == "header" and stack[-1][1] == MAIN


def _stream(blocks: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all blocks of a page, and the number of each's block."""
    tokens, owner, n = [], [], 0
    for words in chunks(pa.array([t for _, t in blocks], pa.large_string()), NOT_SPACE):
        tokens.append(words.hashes(lower=True))
        owner.append(np.repeat(np.arange(n, n + words.n_texts), np.diff(words.bounds)))
        n += words.n_texts
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(tokens), np.concatenate(owner)


def _suffixes(tokens: np.ndarray) -> np.ndarray:
    """The hash of the first LENGTH tokens of each suffix that has them."""
    s = np.zeros(max(0, len(tokens) - LENGTH + 1), dtype=np.uint64)
    for j in range(LENGTH):
        s = mix(s * np.uint64(0x2545F4914F6CDD1D) + tokens[j:j + len(s)] + np.uint64(j + 1))
    return s


def _short_blocks(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of each block with fewer than LENGTH tokens, and its hash."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(starts, len(owner)))
    starts, sizes = starts[sizes < LENGTH], sizes[sizes < LENGTH]
    s = sizes.astype(np.uint64)
    for j in range(LENGTH - 1):
        longer = sizes > j
        s[longer] = mix(s[longer] * np.uint64(0x9FB21C651E98DF25) + tokens[starts[longer] + j] + np.uint64(j + 1))
    return starts, mix(s)


def _judged_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, blocks) of pages that have blocks to judge."""
    for batch in batches:
        found = []
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            blocks = _zoned(page or "")
            if any(z in (FREE, LOOSE) for z, _ in blocks):
                found.append((host, key, [{"zone": z, "text": t} for z, t in blocks]))
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string())])))],
            names=["host", "key", "blocks"])


def _places(blocks: list[tuple[int, str]], zones: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, suffix, whether all of it lies outside `zones`) of a page's
    suffixes. A short block that starts at token a has the place -1 - a."""
    tokens, owner = _stream(blocks)
    inside = np.isin(np.array([z for z, _ in blocks], dtype=np.int64)[owner], zones) if len(owner) else np.zeros(0, bool)
    s = _suffixes(tokens)
    starts, short = _short_blocks(tokens, owner)
    sums = np.append(0, np.cumsum(inside))
    apart = sums[LENGTH:] == sums[:-LENGTH] if len(s) else np.zeros(0, bool)
    return (np.concatenate([np.arange(len(s)), -1 - starts]), np.concatenate([s, short]),
            np.concatenate([apart, ~inside[starts]]))


def _bits(host: str, suffixes: np.ndarray) -> np.ndarray:
    return mix(suffixes + np.uint64(zlib.crc32(host.encode()))) % np.uint64(FILTER_BITS)


def _judged_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, at, suffix, bit) of the suffixes that touch blocks to judge."""
    for batch in batches:
        for host, key, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "blocks"))):
            at, s, apart = _places([(b["zone"], b["text"]) for b in blocks], (FREE, LOOSE))
            at, s = at[~apart], s[~apart]
            yield pa.RecordBatch.from_arrays([
                pa.array([host] * len(s), pa.string()), pa.array([key] * len(s), pa.int64()),
                pa.array(at, pa.int32()), pa.array(s.view(np.int64)), pa.array(_bits(host, s).astype(np.int64))],
                names=["host", "key", "at", "suffix", "bit"])


def _all_suffixes(shared):
    """(host, key, suffix, marked) of all blocks of every page, without those
    that no block to judge can have. Marked ones touch marked article text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
                _, s, plain = _places(_zoned(page or ""), (MAIN,))
                kept = wanted[_bits(host, s)]
                s, marked = s[kept], ~plain[kept]
                parts = [np.unique(s[marked]), np.unique(s[~marked])]
                n = sum(map(len, parts))
                yield pa.RecordBatch.from_arrays([
                    pa.array([host] * n, pa.string()), pa.array([key] * n, pa.int64()),
                    pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat([True, False], [len(x) for x in parts]))],
                    names=["host", "key", "suffix", "marked"])

    return run


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, key, text): the article's blocks, null without one."""
    for batch in batches:
        texts = []
        for page in batch.column("html").to_pylist():
            main = [t for z, t in blocks_of(page or "") if z == MAIN]
            texts.append("\n".join(main) if main else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("key"), pa.array(texts, pa.string())],
            names=["page_id", "url", "key", "text"])


def _own_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own): the blocks of a page that are not boilerplate.

    Beside an article, a block outside goes when other pages have its words
    anywhere, also in their articles: it is a teaser. Text that another
    article may quote goes only when unmarked text repeats it. An article that
    repeats others in more than half of its words is a copy and keeps its
    text; so does a page of which nothing else is left.
    """
    for batch in batches:
        texts = []
        for blocks, repeated in zip(batch.column("blocks").to_pylist(), batch.column("repeated").to_pylist()):
            pairs = [(b["zone"], b["text"]) for b in blocks]
            tokens, owner = _stream(pairs)
            sizes = np.maximum(1, np.bincount(owner, minlength=len(pairs)))
            shares = []
            for plain_only in (False, True):
                covered = np.zeros(len(tokens) + LENGTH, dtype=bool)
                for r in repeated or []:
                    at = r["at"]
                    if plain_only and not r["plain"]:
                        continue
                    if at < 0:
                        covered[:len(tokens)] |= owner == owner[-1 - at]
                    else:
                        covered[at:at + LENGTH] = True
                shares.append(np.bincount(owner, covered[:len(tokens)], len(pairs)) / sizes)
            article = [i for i, (z, _) in enumerate(pairs) if z in (MAIN, LOOSE)]
            free = [i for i, (z, _) in enumerate(pairs) if z == FREE]
            gone = {i for i in free if shares[0 if article else 1][i] >= COVERED}
            gone |= {i for i in article if pairs[i][0] == LOOSE and shares[1][i] >= COVERED}
            words = {i: len(pairs[i][1].split()) for i in article}
            if 2 * sum(words[i] for i in article if i in gone) > sum(words.values()):
                gone -= set(article)
            kept = sorted(i for i in article + free if i not in gone) or free
            texts.append("\n".join(pairs[i][1] for i in kept))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "own"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages`.

    White space inside a block becomes one space, blocks are joined by a line
    break, character references are decoded. Null and empty pages have the
    empty text; pages whose URL has no host share the empty host; equal rows
    get equal texts. Other columns are not used.
    """
    rows = pages.select(
        "page_id", "url", "html", host_of(F.col("url")).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("key"))
    pages_of = rows.select("host", "key", "html")
    loose = stored(pages_of.mapInArrow(
        _judged_pages, "host string, key long, blocks array<struct<zone:int,text:string>>").dropDuplicates(["key"]), "judged")
    articles = rows.select("page_id", "url", "key", "html").mapInArrow(
        _articles, "page_id long, url string, key long, text string")
    if loose.isEmpty():
        # Nothing to judge on any page, so nothing to join.
        text = F.coalesce("text", F.lit(""))
        return articles.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    asked = stored(loose.mapInArrow(
        _judged_suffixes, "host string, key long, at int, suffix long, bit long"), "asked")
    wanted = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in asked.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).collect():
        wanted[r["word"]] = r["bits"]
    shared = pages.sparkSession.sparkContext.broadcast(wanted.tobytes())
    plain = F.when(~F.col("marked"), F.col("key"))
    repeated = pages_of.mapInArrow(_all_suffixes(shared), "host string, key long, suffix long, marked boolean").groupBy(
        "host", "suffix").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"),
        (F.min(plain) < F.max(plain)).alias("plain")).filter("lo < hi").select("host", "suffix", F.coalesce("plain", F.lit(False)).alias("plain"))
    covered = asked.join(repeated, ["host", "suffix"]).groupBy("key").agg(
        F.collect_list(F.struct("at", "plain")).alias("repeated"))
    own = stored(loose.join(covered, "key", "left").select("key", "blocks", "repeated").mapInArrow(
        _own_runs, "key long, own string"), "own-runs")
    text = F.coalesce("own", "text", F.lit(""))
    return articles.join(own, "key", "left").select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
