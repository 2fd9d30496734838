"""Main text of web pages, by templates deduced from the pages of a host.

Tokens are tags and whole text blocks, told apart by their path of open
elements. A token's occurrence vector says how often each page of the host has
it; tokens with equal vectors form an equivalence class. Classes found on
enough pages are candidates. A class is ordered if its tokens stand in the same
order on all its pages; ordered classes, those of single tokens and the larger
ones first, are valid if all tokens of one lie in one gap of the other on every
page. The valid
classes make the host's template, and the stretches between their tokens are
slots. The host's slots are ranked by what its pages hold there: the container
with most slot text is the main one, and the slots with text in it give the
text. Boxes in it that hold nothing but template text are the site's, not the
article's.

Vectors are never built: a sum of hashes over pages, one a token, is equal for
equal vectors. The template of a host has at most as many tokens as some of its
pages, as a token must be on a good part of them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.schemas import extended
from quire.session import stored

#: A template token is on this share of a host's pages, and on this many, or more.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Templates of up to so many tokens in all are broadcast (some 16 bytes each).
BROADCAST_TOKENS = 1_000_000
#: A slot is of the main container if this share of its text over the host, or more, lies in there.
MAIN_SHARE = 0.1
#: Of several articles of a page, those with this share of the largest one's text, or more, are the main ones.
ARTICLE_SHARE = 0.25

#: Elements without text of the page's own.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea input iframe object svg canvas audio video dialog menu".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements inside a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr input button select svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an open paragraph can't hold.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words in class and id that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies notice notices alert consent gdpr comment comments commentlist respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar widget skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words before a marked one that turn it into a property of the layout.
LAYOUT = frozenset("has with no without".split())
#: Words that may stand with a marked one in a class of a box inside the article.
PLAIN = frozenset("list links link box bar wrap wrapper container area section block items item buttons icons tools posts post user reader row inner outer content group".split())
#: Elements that hold other blocks; inside the article only these are left out for their class, or for holding template text alone.
BOXES = frozenset("div section ul ol dl table details figure fieldset".split())

#: What a head can hold; anything else ends one that isn't closed.
METADATA = frozenset("base basefont bgsound head html link meta noscript script style template title".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The end of a tag, or one attribute with its value. No part can match in two ways, so a tag is read once.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)""")
_SPLIT = re.compile(r"[^a-z0-9]+")


def tags(source: str) -> Iterator[tuple[int, int, str, bool, dict[str, str] | None]]:
    """Each tag and comment: (start, end, name, is it an end tag, attributes); comments have no name.

    Names are in lower case, the first of two equal attributes counts. A tag
    that the page ends in is dropped. What follows ``<`` decides: a ``<`` before anything but
    a letter, ``/``, ``!`` or ``?`` is text. Send a place to go on from there.
    """
    at, size = 0, len(source)
    while (start := source.find("<", at)) >= 0:
        mark = source[start + 1 : start + 2]
        end_tag = mark == "/"
        name = _NAME.match(source, start + 1 + end_tag)
        if name is None:
            at = start + 1
            if mark and mark in "!?/":
                if source.startswith("<!--", start):
                    short = next((x for x in ("<!-->", "<!--->") if source.startswith(x, start)), None)
                    close = source.find("-->", start + 4)
                    at = start + len(short) if short else close + 3 if close >= 0 else size
                else:
                    close = source.find(">", start + 2)
                    at = close + 1 if close >= 0 else size
                yield start, at, "", False, None
            continue
        attributes: dict[str, str] = {}
        at = name.end()
        if source.startswith(">", at):
            at += 1
            new = yield start, at, name[0].lower(), end_tag, attributes
            at = at if new is None else new
            continue
        while (m := _ATTRIBUTE.match(source, at)) is not None:
            at = m.end()
            if m[1]:
                break
            value = m[3] or m[4] or m[5] or ""
            attributes.setdefault(m[2].lower(), html.unescape(value) if "&" in value else value)
        else:
            yield start, size, "", False, None
            return
        if source[at - 2] == "/" and m.end() - m.start() > 1:
            attributes["/"] = ""
        new = yield start, at, name[0].lower(), end_tag, attributes
        if new is not None:
            at = new


def _unwanted(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Is an element left out with all it holds? ``inside`` an article or <main>, ids and classes of headings and paragraphs don't count."""
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body"):
        return False
    of = lambda key: attributes.get(key, "").strip().lower()
    if "hidden" in attributes or of("aria-hidden") == "true" or of("role") in ROLES:
        return True
    if inside:
        for token in of("class").split() if name in BOXES else ():
            words = [w for w in _SPLIT.split(token) if w]
            if any(w in MARKED for w in words) and all(w in MARKED or w in PLAIN for w in words):
                return True
        return False
    for key in ("class", "id"):
        words = _SPLIT.split(of(key))
        if any(w in MARKED and not (i and words[i - 1] in LAYOUT) for i, w in enumerate(words)):
            return True
    return False


class Page:
    """The tokens of a page, and its blocks of text in page order."""

    def __init__(self, source: str):
        self.tokens: list[int] = []
        #: (index of the block's token, kind, article, innermost box, text); kind 0: outside, 1: in <main>, 2: in <article>, -1: left out
        self.blocks: list[tuple[int, int, int, int, str]] = []
        #: The box around each box in a container; 0: none.
        self.around: list[int] = [0]
        self._open: list[tuple] = []  # name, elements left out so far, kind, article, innermost box in the container, path
        self._names: Counter = Counter()
        self._articles = 0
        self._text: list[str] = []
        found, at, go_on = tags(source), 0, None
        while True:
            try:
                start, end, name, end_tag, attributes = found.send(go_on)
            except StopIteration:
                break
            self._add(source[at:start])
            at, go_on = end, None
            if not name:
                continue
            if end_tag:
                self._end(name)
                continue
            self._start(name, attributes)
            if name in RAW and "/" not in attributes:
                close = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(source, at)
                if close is None:
                    self._text.clear()
                    at = len(source)
                    break
                at = go_on = close.start()
        self._add(source[at:])
        self._flush()

    def _path(self, last: str) -> int:
        above = self._open[-1][5] if self._open else 0
        return xxhash.xxh64_intdigest(f"{above}/{last}") - (1 << 63)

    def _add(self, text: str) -> None:
        if self._open and self._open[-1][0] == "head" and text.strip():
            self._pop("head")
        if text and not (self._open and self._open[-1][1]):
            self._text.append(html.unescape(text))

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            _, left_out, kind, article, box, _ = self._open[-1] if self._open else ("", 0, 0, 0, 0, 0)
            self.blocks.append((len(self.tokens), -1 if left_out else kind, article, box, text))
            self.tokens.append(self._path("#" + text))

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        if self._names["head"] and name not in METADATA:
            self._pop("head")
        if name not in INLINE:
            self._flush()
        if name in ENDS_P and self._names["p"]:
            self._pop("p")
        if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            if self._open and self._open[-1][0] in same:
                self._pop(self._open[-1][0])
        path = self._path(name)
        self.tokens.append(path)
        if name in VOID or "/" in attributes:
            return
        _, left_out, kind, article, box, _ = self._open[-1] if self._open else ("", 0, 0, 0, 0, 0)
        unwanted = _unwanted(name, attributes, kind > 0)
        if kind and name in BOXES:
            self.around.append(box)
            box = len(self.around) - 1
        if name == "article" and kind < 2:
            self._articles += 1
            article = self._articles
        kind = max(kind, {"article": 2, "main": 1}.get(name, 1 if attributes.get("role", "").strip().lower() == "main" else 0))
        self._open.append((name, left_out + unwanted, kind, article, box, path))
        self._names[name] += 1

    def _end(self, name: str) -> None:
        if self._names[name]:
            if name not in INLINE:
                self._flush()
            self._pop(name)
            self.tokens.append(self._path("/" + name))

    def _pop(self, name: str) -> None:
        while True:
            top = self._open[-1][0]
            if top not in INLINE:
                self._flush()
            self._open.pop()
            self._names[top] -= 1
            if top == name:
                return


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) -> (host, page, tokens) and its blocks: the index, kind and size of each."""
    for batch in batches:
        for begin in range(0, len(batch), 500):
            part = batch.slice(begin, 500)
            pages = [Page(source.as_py() or "") for source in part.column(2)]
            tokens = pa.array([p.tokens for p in pages], pa.list_(pa.int64()))
            at, kind, size = (pa.array([[f(b) for b in p.blocks] for p in pages], pa.list_(pa.int32())) for f in (lambda b: b[0], lambda b: b[1], lambda b: len(b[4])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tokens, at, kind, size], ["host", "page", "tokens", "at", "kind", "size"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, tokens) -> (host, token, vector): a row a page and token; vector hashes page and count."""
    for batch in batches:
        for begin in range(0, len(batch), 500):
            hosts, tokens, vectors = [], [], []
            for host, key, found in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns), strict=True):
                for t, n in Counter(found).items():
                    hosts.append(host)
                    tokens.append(t)
                    vectors.append(xxhash.xxh64_intdigest(f"{key}:{n}") >> 20)  # 44 bits: sums stay exact
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(vectors, pa.int64())], ["host", "token", "vector"])


def class_places(found: list[int], of: dict[int, int]) -> dict[int, list[int]]:
    """{class: places of its tokens} on a page with these tokens."""
    places: dict[int, list[int]] = {}
    for i, t in enumerate(found):
        if (c := of.get(t)) is not None:
            places.setdefault(c, []).append(i)
    return places


def nested(found: list[int], places: dict[int, list[int]]) -> set[int]:
    """The classes that nest: each lies in one gap of all before it, or they in one of its gaps.

    Classes of tokens that a page has once come first, then larger ones.
    """
    kept: list[tuple[int, np.ndarray]] = []
    times = {c: len(at) // len({found[i] for i in at}) for c, at in places.items()}
    for c, at in sorted(places.items(), key=lambda x: (times[x[0]], -len(x[1]), x[0])):
        at = np.array(at)
        gaps = lambda x, y: len(x) == 1 or np.searchsorted(y, x[0]) == np.searchsorted(y, x[-1])
        if all(gaps(at, other) or gaps(other, at) for _, other in kept):
            kept.append((c, at))
    return {c for c, _ in kept}


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens, template, classes) -> (host, class, order): the order of each class's tokens on a page."""
    for batch in batches:
        out: list[tuple] = []
        for found, host, tokens, classes in _rows(batch, "tokens", "host", "known", "classes"):
            for c, at in class_places(found, dict(zip(tokens, classes, strict=True))).items():
                out.append((host, c, xxhash.xxh64_intdigest(np.array([found[i] for i in at], np.int64).tobytes()) - (1 << 63)))
        yield _columns(out, host=pa.string(), **{"class": pa.int64()}, order=pa.int64())


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens, template, classes) -> (host, class, nested)."""
    for batch in batches:
        out: list[tuple] = []
        for found, host, tokens, classes in _rows(batch, "tokens", "host", "known", "classes"):
            places = class_places(found, dict(zip(tokens, classes, strict=True)))
            kept = nested(found, places)
            out += [(host, c, c in kept) for c in places]
        yield _columns(out, host=pa.string(), **{"class": pa.int64()}, nested=pa.bool_())


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters in each slot of a page by kind of container: (host, slot, kind, chars)."""
    for batch in batches:
        out: list[tuple] = []
        for found, host, tokens, at, kind, size in _rows(batch, "tokens", "host", "known", "at", "kind", "size"):
            template, sums = set(tokens), Counter()
            for slot, k, n in zip(slots_of(found, at, template), kind, size, strict=True):
                if slot is not None and k >= 0:
                    sums[slot, k] += n
            out += [(host, slot, k, n) for (slot, k), n in sums.items()]
        yield _columns(out, host=pa.string(), slot=pa.int64(), kind=pa.int32(), chars=pa.int64())


def slots_of(found: list[int], at: list[int], template: set[int]) -> list[int | None]:
    """The slot of each block, by the template token before it; None for blocks that are template tokens."""
    out, last, i = [], 0, 0
    for place in at:
        while i < place:
            if found[i] in template:
                last = found[i]
            i += 1
        out.append(None if found[place] in template else last)
    return out


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    place = batch.schema.get_field_index
    for begin in range(0, len(batch), 200):
        part = batch.slice(begin, 200)
        yield from zip(*(part.column(place(n)).to_pylist() for n in names), strict=True)


def _columns(rows: list[tuple], **types) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _beside(rows: DataFrame, listed: DataFrame, how: str = "inner") -> DataFrame:
    """Join a table of one row a host, broadcast only if its arrays are small in all; else skewed hosts are split by the adaptive join."""
    size = listed.agg(F.sum(F.size("known") + 1)).first()[0] or 0
    return rows.join(F.broadcast(listed) if size <= BROADCAST_TOKENS else listed, "host", how)


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    raw = pages.select(_host(url_col).alias("host"), F.col(id_col).cast("string").alias("page"), F.col(html_col).cast("string").alias("html"))
    return stored(raw.mapInArrow(_parse, "host string, page string, tokens array<long>, at array<int>, kind array<int>, size array<int>"))


def host_templates(parsed: DataFrame) -> DataFrame:
    """``(host, known, classes)``: the tokens of each host's template, and their equivalence classes.

    A host needs ``LEAST_PAGES`` pages for a template. Pages with equal html
    count one each. Rows that repeat a page count again, all alike.
    """
    n = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    vectors = parsed.select("host", "page", "tokens").mapInArrow(_count, "host string, token long, vector long").groupBy("host", "token").agg(F.count("*").alias("on"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("sum"))
    frequent = vectors.where(F.col("on") >= LEAST_PAGES).join(n, "host").where(F.col("on") >= SUPPORT * F.col("pages"))
    classes = stored(frequent.select("host", "token", F.xxhash64("on", "sum").alias("class")))
    rows = parsed.select("host", "tokens")
    order = _beside(rows, _listed(classes)).mapInArrow(_order, "host string, class long, order long")
    order = order.groupBy("host", "class").agg((F.min("order") == F.max("order")).alias("ordered")).where("ordered").select("host", "class")
    classes = stored(classes.join(order, ["host", "class"]))
    nest = _beside(rows, _listed(classes)).mapInArrow(_nest, "host string, class long, nested boolean")
    nest = nest.groupBy("host", "class").agg(F.min("nested").alias("nested")).where("nested").select("host", "class")
    return _listed(classes.join(nest, ["host", "class"]))


def main_slots(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """``(host, best, main)``: the kind of the main container, and the slots that hold its text.

    The main container is that of most slot text over the host's pages: articles,
    or <main> with the articles in it, or, without either, the whole page.
    """
    sums = _beside(parsed.drop("page"), templates).mapInArrow(_slots, "host string, slot long, kind int, chars long")
    sums = stored(sums.groupBy("host", "slot", "kind").agg(F.sum("chars").alias("chars")))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("chars"))), F.lit(0))
    best = F.when((of(1) == 0) & (of(2) == 0), 0).when(of(2) >= of(1), 2).otherwise(1)
    best = sums.groupBy("host").agg(best.alias("best"))
    inside = F.sum(F.when(F.col("kind") >= F.col("best"), F.col("chars")).otherwise(0))
    main = sums.join(best, "host").groupBy("host", "best", "slot").agg((inside >= MAIN_SHARE * F.sum("chars")).alias("main")).where("main")
    return stored(main.groupBy("host", "best").agg(F.sort_array(F.collect_list("slot")).alias("main")))


def _listed(classes: DataFrame) -> DataFrame:
    """A row a host; the tokens of a host are no more than those of a few of its pages."""
    both = F.sort_array(F.collect_list(F.struct("token", "class")))
    one = classes.groupBy("host").agg(both.alias("x"))
    return stored(one.select("host", F.col("x.token").alias("known"), F.col("x.class").alias("classes")))


def main_text(page: Page, template: set[int], best: int | None = None, main: set[int] | None = None) -> tuple[str, int]:
    """The text of the page's main slots, and the number of slots it was taken from.

    ``best`` and ``main`` are the host's main container and its slots. A page
    without text there, or of a host without a template, is taken by its own
    container. In a container, template text stays if it stands among the
    article's blocks, and goes where a whole box holds nothing else, unless half
    of the text or more is the template's, as on copies of a page. Without a
    container template text goes.
    """
    slots = slots_of(page.tokens, [b[0] for b in page.blocks], template)
    chosen = []
    if best is not None:
        chosen = [(s, b) for s, b in zip(slots, page.blocks, strict=True) if b[1] >= best and (s in main if s is not None else best > 0)]
    if not any(s is not None for s, _ in chosen):
        best = max((b[1] for b in page.blocks), default=0)
        chosen = [(s, b) for s, b in zip(slots, page.blocks, strict=True) if b[1] >= max(best, 0) and (s is not None or best > 0)]
    if best == 2:
        sizes = Counter()
        for _, b in chosen:
            sizes[b[2]] += len(b[4])
        chosen = [(s, b) for s, b in chosen if sizes[b[2]] >= ARTICLE_SHARE * max(sizes.values())]
    if best and best > 0:
        own = {0}  # boxes that hold text of the page's own, with all around them
        for box in (b[3] for s, b in chosen if s is not None):
            while box not in own:
                own.add(box)
                box = page.around[box]
        if 2 * sum(len(b[4]) for s, b in chosen if s is not None) > sum(len(b[4]) for _, b in chosen):
            chosen = [(s, b) for s, b in chosen if b[3] in own]
    return " ".join(b[4] for _, b in chosen), len({s for s, _ in chosen if s is not None})


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, ``n_chars`` (code points), ``n_slots`` and ``n_template``.

    ``text`` is the article without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments; character references are
    decoded, white space inside a block becomes one space, blocks are joined by
    one space. ``n_slots`` counts the template's slots it comes from,
    ``n_template`` the page's tokens that are the template's.

    Null and empty html gives an empty text. Pages with a null or odd url form
    one host. A host of fewer than 3 pages has no template: its pages are one
    slot. Every row is returned; columns of the four names are replaced, all
    others stay.
    """
    new = ["text", "n_chars", "n_slots", "n_template"]
    keep = [c for c in pages.columns if c not in new]
    parsed = _parsed(pages, id_col, url_col, html_col)
    templates = host_templates(parsed)
    known = stored(templates.select("host", "known").join(main_slots(parsed, templates), "host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index
            rows = []
            for source, tokens, best, main in zip(*(batch.column(place(f"__{c}")) for c in ("html", "known", "best", "main")), strict=True):
                page, template = Page(source.as_py() or ""), set(tokens.as_py() or ())
                text, slots = main_text(page, template, best.as_py(), set(main.as_py() or ()))
                rows.append((text, len(text), slots, sum(t in template for t in page.tokens)))
            columns = [batch.column(place(k)) for k in keep]
            made = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*keep, *new])

    inner = ["host", "known", "best", "main", "html"]
    source = pages.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("html"), _host(url_col).alias("host"))
    joined = _beside(source, known, "left").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(f"__{c}") for c in inner])
    return joined.mapInArrow(run, extended(pages.select(*keep), "text string, n_chars long, n_slots long, n_template long"))
