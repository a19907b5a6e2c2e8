"""HTML extraction by deducing each host's template from token equivalence classes.

A token is an element's path of tags with its class and role (``html/body/div.ad``) or a text block under such a path.
Its occurrence vector says how often it stands on each distinct page of the host; tokens that share a vector form a
class. Classes of enough tokens and pages are kept and validated:

* ordered: on every page a class's tokens stand in the same order, round after round if they repeat. Tokens whose place
  in the round changes leave the class.
* nested: each round of a class lies between the same two tokens of every class that stands once on all of its pages.
  A class that straddles another is dropped.

The class of the page's root, once on every page, is the outermost template; other classes nest in its slots, among them
those of further layouts and of optional parts. Their texts are the template's, as are texts equally often on every
page. Slots of a class compete for the article once per class: by what their element says it is, then by how much text
the pages hold there. A page takes the best slot that it has.

On Spark, a page is one row of tokens with their places. Vectors are never built: the xor of a hash of (page, count) over
distinct pages tells them apart. Classes are groups by that, places are numbered by a window that holds one class of one
page, and the rest are counts, minima and maxima. Only one row per host joins the pages again; it is as large as a few
pages, since a class must be on a fifth of them.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tillweave.llm.common import slices_of, stored

#: Distinct pages that a class must be on, and that a host must have before a text on all of them counts as its template's.
LEAST_PAGES = 4
#: A class must be on one in so many of its host's distinct pages, and have so many tokens.
SHARE = 5
LEAST_TOKENS = 3

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg canvas iframe object select option textarea button".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset(["body", "html"])
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table menu".split())
PHRASES = frozenset("a abbr b bdi bdo big cite code data del em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
ROLES = {"navigation": -3, "banner": -3, "contentinfo": -3, "complementary": -3, "search": -3, "dialog": -3, "alert": -3, "main": 3, "article": 2}
#: Words of a class or id that mark what isn't the article.
SIDE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|widget\w*|related|"
    r"recommend\w*|comments?|disqus|replies|respond|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|social|toolbar|skip|pagination|pager|copyright|legal)(?:$|[-_ ])",
    re.I,
)
MAIN = re.compile(r"(?:^|[-_ ])(?:article|main|content|post|entry|story|body)(?:[-_ ]?(?:body|content|text|main))?(?:$|[-_ ])", re.I)
_SPACE = re.compile(r"\s+")
# Quotes delimit a value after an equals sign only, and nothing is tried twice, so that a scan is one pass.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|</?[a-zA-Z](?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


class Element(NamedTuple):
    tag: str
    path: str
    rank: int  # below 0: not the article (-1 by its name only); above: likelier the article
    inside: int  # index among the page's elements
    parent: int


class Block(NamedTuple):
    text: str
    path: str
    holder: int  # index of the innermost element that holds it
    side: bool
    after: int  # index of the last element that began before its end


#: Longer paths go on from a hash of themselves, so that deep nesting costs no more than its elements.
LONGEST_PATH = 1 << 10


def rank_of(tag: str, marks: dict[str, str], within: int) -> int:
    """What an element says it is. Header elements inside an article belong to it."""
    if tag in HIDDEN or "hidden" in marks or marks.get("aria-hidden") == "true":
        return -2
    role = ROLES.get(marks.get("role", "").lower(), 0)
    if tag in BOILERPLATE or role < 0 or (tag == "header" and within < 2):
        return -3
    if tag in ("main", "article"):
        return 3 if tag == "article" else 2
    words = f"{marks.get('class', '')} {marks.get('id', '')}".strip()
    if words and tag not in ("html", "body") and SIDE.search(words):
        return -1
    return max(role, 1 if words and MAIN.search(words) else 0)


class Open(NamedTuple):
    """An element that isn't closed yet, with what holds for all that it is in."""

    element: Element
    peak: int  # the highest rank
    hidden: bool
    side: bool


class Page:
    """Elements in order and text blocks with decoded references and single blanks.

    Unclosed and stray tags are tolerated: a block start ends an open paragraph, a list item its sibling, and an end
    tag all that it holds. What a hidden or marked phrase holds is dropped, and the text around it stays one block; a
    phrase that only a name marks and that holds blocks is a wrapper and treated like one.
    """

    def __init__(self, source: str):
        root = Element("", "", 0, 0, 0)
        self.elements, self.blocks, self.text = [root], [], []
        self.stack = [Open(root, 0, False, False)]
        self.places: dict[str, list[int]] = {}  # where open elements of a tag stand in the stack
        self.block_places: list[int] = []
        self.phrases: list[tuple[int, list[str]]] = []  # marked phrases: where they stand, and the text before them
        self.read(source)
        self.close(1)

    def flush(self, at: int | None = None) -> None:
        """What was read so far is a block of the element at a place of the stack."""
        if self.text:
            joined = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
            self.text.clear()
            holder = self.stack[-1 if at is None else at]
            if joined and not holder.hidden and not (at is None and self.phrases):
                self.blocks.append(Block(joined, holder.element.path, holder.element.inside, holder.side, len(self.elements) - 1))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().element.tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()
            if self.phrases and self.phrases[-1][0] == len(self.stack):
                self.text = self.phrases.pop()[1]

    def close(self, depth: int) -> None:
        """Ends the element at a place with all that it holds, phrases first: the text around them is its block."""
        marked = bisect_left(self.phrases, depth, key=lambda p: p[0])
        if marked < len(self.phrases):
            self.pop_to(self.phrases[marked][0])
        self.flush()
        self.pop_to(depth)

    def place_of(self, *tags: str) -> int:
        """The innermost open element with one of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def wrap(self) -> None:
        """Phrases that only a name marks and in which a block starts are wrappers: the text before them is a block."""
        while self.phrases and self.stack[self.phrases[-1][0]].element.rank == -1:
            at, before = self.phrases.pop()
            inner, self.text = self.text, before
            if not self.phrases:
                self.flush(at - 1)
            self.text = inner

    def push(self, tag: str, rank: int, label: str) -> None:
        holder = self.stack[-1]
        parent = holder.element
        # Inline elements are no part of a path: their text belongs to the block around them.
        path = parent.path
        if tag in BLOCKS or rank:
            if len(path) > LONGEST_PATH:
                path = f"~{xxhash.xxh64_hexdigest(path)}"
            path = f"{path}/{label}"
        element = Element(tag, path, rank, len(self.elements), parent.inside)
        self.elements.append(element)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append(Open(element, max(holder.peak, rank), holder.hidden or rank == -2, holder.side or rank < 0))

    def end(self, tag: str) -> None:
        depth = self.place_of(tag)
        if tag in BLOCKS:
            if depth:
                self.close(depth)
            else:
                self.flush()
        elif depth and not (self.block_places and self.block_places[-1] > depth):
            self.pop_to(depth)

    def start(self, tag: str, token: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.wrap()
            self.flush()
            if tag in CLOSES_P and (depth := self.place_of("p")):
                self.close(depth)
            if tag in ALIKE:
                depth = self.place_of(*ALIKE[tag])
                if depth > self.place_of(*LISTS):
                    self.close(depth)
        if tag in VOID:
            return
        marks = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in token or "hidden" in token else {}
        rank = rank_of(tag, marks, self.stack[-1].peak)
        if token.endswith("/>") and tag not in BLOCKS:
            return
        label = tag + ("." + ".".join(sorted(marks["class"].split())) if marks.get("class") else "") + ("@" + marks["role"] if marks.get("role") else "")
        if rank < 0 and tag not in BLOCKS:
            if rank == -2 or tag in PHRASES:
                self.phrases.append((len(self.stack), self.text))
                self.text = []
            else:
                self.flush()
        self.push(tag, rank, label)

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self.text.append(source[at:])
                break
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            token = m.group()
            name = _NAME.match(token)
            if name is None:
                if token.startswith("<![CDATA["):
                    self.text.append(entities.escape(token[9:].removesuffix("]]>")))
                continue
            tag = name[1].lower()
            if token[1] == "/":
                self.end(tag)
            elif tag == "br":
                self.text.append(" ")
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else n
            else:
                self.start(tag, token, token[len(name[0]) :])


def parse(source: str) -> tuple[list[Element], list[Block]]:
    page = Page(source)
    return page.elements, page.blocks


def below_each(elements: list[Element], blocks: Iterable[Block]) -> list[int]:
    """Characters of the blocks that each element holds. Elements come after those that hold them."""
    out = [0] * len(elements)
    for b in blocks:
        out[b.holder] += len(b.text)
    for e in reversed(elements[1:]):
        out[e.parent] += out[e.inside]
    return out


def down_from(elements: list[Element], own: Callable[[Element], bool], any_of: bool) -> list[bool]:
    """For every element whether any, or all, of those it is in and itself have a property."""
    out: list[bool] = []
    for e in elements:
        mine = own(e)
        out.append(mine if not out else (mine or out[e.parent]) if any_of else (mine and out[e.parent]))
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def text_hash(block: Block) -> int:
    return xxhash.xxh64_intdigest(f"{block.path}\x00{block.text}") >> 1


def tokens(source: str) -> dict[tuple[str, int], list]:
    """(path, hash of text or 0) -> characters of article-like text below, rank, places in the order of elements and blocks."""
    elements, blocks = parse(source)
    below = below_each(elements, (b for b in blocks if not b.side))
    out: dict[tuple[str, int], list] = {}
    for i, e in enumerate(elements):
        row = out.setdefault((e.path, 0), [0, e.rank, []])
        row[0] += below[i]
        row[1] = e.rank
        row[2].append((i, 0))
    for k, b in enumerate(blocks):
        row = out.setdefault((b.path, text_hash(b)), [0, 0, []])
        row[0] += len(b.text)
        row[2].append((b.after, k + 1))
    places = {at: place for place, at in enumerate(sorted(at for _, _, found in out.values() for at in found))}
    for row in out.values():
        row[2] = [places[at] for at in row[2]]
    return out


TOKEN = pa.struct([("path", pa.string()), ("text", pa.int64()), ("size", pa.int64()), ("rank", pa.int32()), ("at", pa.list_(pa.int32()))])


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per distinct page of a host: host, page (hash of its html), mass (all its characters) and its tokens. Pages without texts say nothing."""

    def lists(counts: list[int], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(1), 1 << 22):
                part = batch.slice(begin, stop - begin)
                hosts, ids, masses, counts, flat = [], [], [], [], []
                for url, source in zip(*(c.to_pylist() for c in part.columns)):
                    found = tokens(source or "")
                    if any(text for _, text in found):
                        hosts.append(host_of(url))
                        ids.append(xxhash.xxh64_intdigest(source) >> 1)
                        masses.append(found["", 0][0])
                        counts.append(len(found))
                        flat += [(*key, *row) for key, row in found.items()]
                path, text, size, rank, at = zip(*flat) if flat else ((),) * 5
                places = lists([len(x) for x in at], pa.array([x for one in at for x in one], pa.int32()))
                columns = [pa.array(path, pa.string()), pa.array(text, pa.int64()), pa.array(size, pa.int64()), pa.array(rank, pa.int32()), places]
                rows = lists(counts, pa.StructArray.from_arrays(columns, fields=list(TOKEN)))
                of_page = [pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(masses, pa.int64())]
                yield pa.record_batch([*of_page, rows], names=["host", "page", "mass", "tokens"])

    found = "host string, page long, mass long, tokens array<struct<path: string, text: long, size: long, rank: int, at: array<int>>>"
    return pages.select("url", "html").mapInArrow(run, found).dropDuplicates(["host", "page"])


def occurrences(rows: DataFrame) -> DataFrame:
    """One row per page and token of it."""
    return rows.select("host", "page", "mass", F.explode("tokens").alias("t")).select("host", "page", "mass", "t.*")


def token_statistics(rows: DataFrame) -> DataFrame:
    """One row per (host, token): the pages it is on, its occurrence vector (by a hash), its fewest and most occurrences
    on one of these pages, characters below it, and all characters of these pages."""
    return occurrences(rows).groupBy("host", "path", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("page", F.size("at"))).alias("vector"), F.min(F.size("at")).alias("low"),
        F.max(F.size("at")).alias("high"), F.sum("size").alias("size"), F.max("rank").alias("rank"), F.sum("mass").alias("mass"),
    )


def candidate_classes(stats: DataFrame) -> DataFrame:
    """The tokens of all classes of enough tokens and pages: host, vector, pages, high, members (of the class), path, text."""
    of_host = stats.where("path = '' AND text = 0").select("host", F.col("pages").alias("all"))
    frequent = stats.where(f"pages >= {LEAST_PAGES}").join(of_host, "host").where(f"pages * {SHARE} >= all").drop("all")
    by = ["host", "vector", "pages"]
    large = frequent.groupBy(*by).agg(F.count(F.lit(1)).alias("members")).where(f"members >= {LEAST_TOKENS}")
    return frequent.join(large, by).select(*by, "high", "members", "path", "text")


def ordered_classes(rows: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of candidates that keep their place in the round on every page, and where they stand on pages."""
    wanted = candidates.select("host", "path", "text", "vector", "members", F.xxhash64("path", "text").alias("token"))
    found = occurrences(rows).join(wanted, ["host", "path", "text"]).select("host", "page", "vector", "members", "token", F.explode("at").alias("at"))
    number = F.row_number().over(Window.partitionBy("host", "page", "vector").orderBy("at")) - 1
    placed = found.withColumn("number", number).select(
        "host", "page", "vector", "token", "at", (F.col("number") % F.col("members")).alias("place"), F.expr("number DIV members").alias("round")
    )
    placed = stored(placed, "page-places")
    steady = placed.groupBy("host", "vector", "token").agg(F.min("place").alias("place"), F.max("place").alias("last")).where("place = last").drop("last")
    left = steady.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("members")).where(f"members >= {LEAST_TOKENS}")
    steady = stored(steady.join(left, ["host", "vector"]), "page-classes")
    return steady, placed.join(steady.select("host", "vector", "token"), ["host", "vector", "token"])


def nested_classes(classes: DataFrame, placed: DataFrame) -> DataFrame:
    """Of classes (host, vector, pages, high), those that straddle no other, with the innermost class that they nest in
    (parent, null for the root's) and the slot there, the number of the parent's tokens before them. Classes of one page
    meet each other; they have three tokens or more, so there are at most a third as many as the page has."""
    rounds = placed.groupBy("host", "page", "vector", "round").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    inner = rounds.groupBy("host", "page", "vector").agg(F.collect_list(F.struct("first", "last")).alias("rounds")).join(classes.drop("high"), ["host", "vector"])
    once = classes.where("high = 1").select("host", F.col("vector").alias("parent"), F.col("pages").alias("parent_pages"))
    outer = placed.select("host", "page", F.col("vector").alias("parent"), "at").join(once, ["host", "parent"])
    outer = outer.groupBy("host", "page", "parent", "parent_pages").agg(F.collect_list("at").alias("marks"))
    pairs = inner.join(outer, ["host", "page"]).where("vector != parent AND parent_pages >= pages")
    before = "size(filter(marks, m -> m < r.{}))".format
    pairs = pairs.select(
        "host", "vector", "pages", "parent", "parent_pages", F.expr(f"forall(rounds, r -> {before('first')} = {before('last')})").alias("inside"),
        F.expr(f"array_sort(array_distinct(transform(rounds, r -> {before('first')})))").alias("slots"),
    )
    met = pairs.groupBy("host", "vector", "pages", "parent", "parent_pages").agg(
        F.count(F.lit(1)).alias("together"), F.bool_and("inside").alias("inside"), F.min("slots").alias("slots"), F.max("slots").alias("most")
    )
    met = stored(met.where("together = pages"), "page-nesting")
    straddling = met.where("NOT inside OR slots != most").select("host", "vector").distinct()
    # The innermost of those around a class is on the fewest pages; of equal ones, that with most tokens before it.
    tightest = F.struct((-F.col("parent_pages")).alias("p"), "slots", "parent")
    parents = met.where("inside AND slots = most AND slots[0] > 0").groupBy("host", "vector").agg(F.max(tightest).alias("t"))
    parents = parents.select("host", "vector", F.col("t.parent").alias("parent"), F.col("t.slots").alias("slots"))
    return classes.join(straddling, ["host", "vector"], "left_anti").join(parents, ["host", "vector"], "left")


def template_classes(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """The tokens of all valid classes: host, path, text, vector, pages, high, place (in the round), parent and slots."""
    candidates = stored(candidate_classes(stats), "page-candidates")
    steady, placed = ordered_classes(rows, candidates)
    classes = candidates.join(steady.select("host", "vector").distinct(), ["host", "vector"]).groupBy("host", "vector", "pages").agg(F.max("high").alias("high"))
    valid = nested_classes(stored(classes, "page-class-list"), placed)
    members = candidates.select("host", "path", "text", "vector", F.xxhash64("path", "text").alias("token"))
    members = members.join(steady.select("host", "vector", "token", "place"), ["host", "vector", "token"])
    return members.join(valid, ["host", "vector"]).drop("token")


def templates(pages: DataFrame) -> DataFrame:
    """(host, articles, fixed): paths of the article's slots, best first, and the hashes of the template's texts.

    Pages without texts don't count. Slots in classes count twice by what they say they are; one per class is kept, if
    it holds half of its pages' text, and the best of all in any case. A class's texts are the template's unless they are
    half of the text on their pages: then the pages are copies, and nothing tells template from article.
    """
    rows = stored(page_tokens(pages), "pages-as-tokens")
    stats = stored(token_statistics(rows), "page-tokens")
    classes = stored(template_classes(rows, stats), "page-template")
    root = stats.where("path = '' AND text = 0").select("host", F.col("pages").alias("all"), F.col("mass").alias("whole_mass"))
    member = classes.select("host", "path", "text", F.lit(True).alias("member"))
    token = stats.join(root, "host").join(member, ["host", "path", "text"], "left")

    once = F.expr("high = 1 AND (pages = all OR member IS NOT NULL)")
    half = F.expr("2 * size >= IF(high = 1 AND member, mass, whole_mass)")
    order = F.struct(
        (once.cast("int") * F.col("rank") + F.col("rank")).alias("o_rank"), half.cast("int").alias("half"),
        F.when(half, F.length("path")).otherwise(0).alias("o_depth"), F.col("size").alias("o_size"), F.col("path").alias("path"),
    )
    slots = token.where("text = 0 AND rank >= 0 AND size > 0").withColumn("o", order)
    best = slots.groupBy("host").agg(F.max("o").alias("o"))
    layouts = slots.where("member AND high = 1 AND o.half = 1").groupBy("host", "vector").agg(F.max("o").alias("o")).select("host", "o")
    articles = best.unionByName(layouts).groupBy("host").agg(F.sort_array(F.collect_set("o"), asc=False).alias("o")).select("host", F.expr("o.path").alias("articles"))

    texts = token.where("text != 0")
    whole = texts.where(f"pages = all AND low = high AND all >= {LEAST_PAGES}").groupBy("host").agg(F.collect_set("text").alias("whole"), F.sum("size").alias("_whole"))
    partly = texts.where("member").groupBy("host", "vector").agg(F.collect_set("text").alias("part"), F.sum("size").alias("_part"), F.max("mass").alias("mass"))
    partly = partly.where("2 * _part < mass").groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("part"))
    none = F.expr("CAST(array() AS array<long>)")
    return (
        root.select("host", "whole_mass").join(articles, "host", "left").join(whole, "host", "left").join(partly, "host", "left")
        .select("host", "articles", F.concat(F.when(2 * F.col("_whole") < F.col("whole_mass"), F.col("whole")).otherwise(none), F.coalesce("part", none)).alias("fixed"))
    )


def extract(source: str, articles: Sequence[str] | None, fixed: set[int]) -> str:
    """The blocks of the first of the article's slots that the page has, without what isn't the article. A page that lacks them falls back to its
    own element of the highest rank, then to everything that isn't marked as something else, and where all texts are
    marked, to the element that holds most of those marked by a class or id only."""
    elements, blocks = parse(source)
    paths = {e.path for e in elements}
    article = next((a for a in articles or () if a in paths), None)
    roots = {e.inside for e in elements if article is not None and e.path == article}
    if not roots or max((e.rank for e in elements), default=0) > max(elements[i].rank for i in roots):
        best = max((e.rank for e in elements), default=0)
        own = {e.inside for e in elements if best > 0 and e.rank == best}
        roots = own or roots or {0}
    in_roots = down_from(elements, lambda e: e.inside in roots, True)
    inside = [b for b in blocks if not b.side and in_roots[b.holder]]
    if all(b.side for b in blocks):
        # Names alone don't empty a page: elements named as something else that hold at least half of its text are let pass.
        lasting = down_from(elements, lambda e: e.rank != -3, False)
        left = [b for b in blocks if lasting[b.holder]]
        below = below_each(elements, left)
        passed = down_from(elements, lambda e: e.rank >= 0 or 2 * below[e.inside] >= below[0], False)
        inside = [b for b in left if passed[b.holder]]
    return "\n\n".join(b.text for b in inside if text_hash(b) not in fixed)


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but an earlier ``text``, and ``text``: the article, blocks joined by blank lines.

    A null html is empty; a page without an article gives an empty text; a null or odd url belongs to the host ''.
    Equal rows give equal rows; an empty table gives none. The one row per host meets the pages by broadcast when small
    and else by a shuffle that adaptive execution can split, since it is stored first.
    """
    kept = [f for f in pages.schema if f.name.lower() != "text"]
    names = [f"c{i}" for i in range(len(kept))]  # whatever the columns are called, none is lost
    model = stored(templates(pages), "page-templates").withColumnRenamed("host", "of_host")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1))
    rows = pages.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names)), host.alias("of_host"))
    rows = rows.join(model, "of_host", "left").select(*names, "articles", "fixed")
    place = [f.name.lower() for f in kept].index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(place), 1 << 22):
                part = batch.slice(begin, stop - begin)
                texts = [
                    extract(source or "", articles, set(fixed or ()))
                    for source, articles, fixed in zip(*(part.column(i).to_pylist() for i in (place, len(names), len(names) + 1)))
                ]
                yield pa.record_batch([*part.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    made = rows.mapInArrow(run, rows.drop("articles", "fixed").withColumn("text", F.lit("")).schema)
    return made.select(*(F.col(n).alias(f.name) for f, n in zip(kept, names)), "text")
