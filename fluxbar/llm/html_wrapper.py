"""Main text of web pages by wrapper induction.

The block structure of each page is a tree in which repeated equal siblings count
once. The trees of a host's pages are aligned by simple tree matching and merged
to one template; a page's blocks so get slots of the template. A text that most
different pages of the host have in the same slot belongs to the template; slots
whose texts vary hold content, and the template's smallest subtree with most of the
varying text is where a page's main text is taken from. Elements that say what
they are (navigation, forms, comments, adverts, ...) are left out whatever they
hold. Hosts with too few different pages have no template: there <article> and
<main> decide.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import join_to_few, map_batches, materialize, struct

#: Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "nav footer aside form script style noscript template button select option textarea svg iframe object dialog menu head title input label audio video canvas map xmp noembed noframes search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - {"option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "head", "html", "title"}
#: An element of this name ends an open one of these, up to the container named after them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that name what isn't the article; those in STEMS also as a word's beginning.
WORDS = frozenset(
    "ad ads adsense adslot adunit banner promo promoted nav navi menu submenu footer masthead topbar toolbar sidebar rail widget widgets share sharing social sharebar related recommended more trending popular tags taglist pagination pager skip hidden popup modal overlay notice notices alert consent gdpr login signin signup search subscribe reply replies respond discussion disqus byline teaser".split()
)
STEMS = ("advert", "sponsor", "comment", "breadcrumb", "newsletter", "cookie", "navbar", "navigation", "sidebar", "outbrain", "taboola", "googlead")
#: Words that say nothing against the others of a class name or id.
NEUTRAL = frozenset(
    "box list block container wrapper wrap inner outer section area item items button buttons bar form post posts link links slot unit story stories article articles content user icon icons row col column group panel body text title header main left right top bottom sticky float inline small large mobile desktop print js is has count feed link label entry".split()
)
MOST_DEPTH = 256
#: Pairs of siblings compared in a table; more are aligned in order, key by key.
MOST_CELLS = 40_000

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# Searched in the page itself: its lower case can have other places (U+0130 becomes two code points).
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text and text.strip() else {}


def _named(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for key in ("class", "id") for w in _WORDS.findall(attributes.get(key, ""))}


def _says_unwanted(name: str) -> bool:
    """Whether a class or id names what isn't the article and nothing else: popular-posts does, popular-science doesn't."""
    words = [w.lower() for w in _WORDS.findall(name)]
    named = [w for w in words if w in WORDS or w.startswith(STEMS)]
    return bool(named) and all(w in WORDS or w.startswith(STEMS) or w in NEUTRAL or w.isdigit() or len(w) == 1 for w in words)


def _unwanted(tag: str, attributes: dict[str, str], within: bool = False) -> bool:
    """within: the element lies in an article, where a word of a name must not be that of a subject."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    words = _named(attributes)
    if tag == "article":
        return any(w.startswith("comment") or w in ("teaser", "related") for w in words)
    if within and not any(_says_unwanted(x) for key in ("class", "id") for x in attributes.get(key, "").split()):
        words = set()
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    return any(w in WORDS or w.startswith(STEMS) for w in words)


#: Bits of a block's kind: unwanted; mostly links; within main; within an article.
UNWANTED, LINKED, MAIN, ARTICLE = 1, 2, 4, 8


class Page:
    """Blocks of a page in order: (node, text, kind), and its block structure. Of a header within the article headings are wanted."""

    def __init__(self, html: str):
        self.keys, self.parents, self.blocks = [""], [-1], []
        # Of each open element: tag, node of its block, unwanted (2: in a line), main, within a header.
        stack = [("", 0, 0, 0, False)]
        places: dict[str, list[int]] = {}
        buffer: list[str] = []
        linked = [0, 0]

        def last(tags) -> int:
            """Place of the innermost open element of these names, 0 if there is none."""
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def flush():
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    _, node, unwanted, main, header = stack[-1]
                    kind = UNWANTED * bool(unwanted or (header and not last(HEADINGS))) + LINKED * (2 * linked[0] > max(1, linked[1])) + (0, MAIN, ARTICLE)[main]
                    self.blocks.append((node, text, kind))
                buffer.clear()
            linked[0] = linked[1] = 0

        def say(text: str):
            if text and stack[-1][2] != 2:
                if "&" in text:
                    text = entities.unescape(text)
                buffer.append(text)
                linked[1] += len(text)
                linked[0] += len(text) * bool(places.get("a"))

        def close_to(at: int):
            if any(x[0] in BLOCK for x in stack[at:]):
                flush()
            for x in stack[at:]:
                places[x[0]].pop()
            del stack[at:]

        at = 0
        while True:
            m = _TAG.search(html, at)
            if not m:
                say(html[at:])
                break
            say(html[at : m.start()])
            at = m.end()
            closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                if tag == "br":
                    buffer.append(" ")
                elif places.get(tag):
                    close_to(places[tag][-1])
                elif tag in BLOCK:
                    flush()
                continue
            if tag in ENDS_P and places.get("p") and last(("td", "th", "button", "table", "object")) < places["p"][-1]:
                close_to(places["p"][-1])
            if tag in ENDS:
                ended, until = ENDS[tag]
                while (inner := last(ended)) > last(until):
                    close_to(inner)
            if tag in BLOCK:
                flush()
            if tag in VOID:
                buffer.append(" " if tag in ("br", "img") else "")
                continue
            _, node, unwanted, main, header = stack[-1]
            attributes = _attributes(rest)
            if not unwanted and _unwanted(tag, attributes, main == 2):
                # An unwanted block is still one of the page; what an unwanted part of a line holds is no text at all.
                unwanted = 1 if tag in BLOCK else 2
            if tag == "header" or (tag not in ("body", "html", "main", "article") and "header" in _named(attributes)):
                header, unwanted = True, unwanted or int(not main)
            if tag == "article" or attributes.get("itemprop", "").lower() == "articlebody":
                main = 2
            elif tag == "main" or attributes.get("role", "").lower() == "main":
                main = max(main, 1)
            if tag in BLOCK and len(stack) < MOST_DEPTH:
                # Without the id: rows with ids of their own are rows of one kind.
                self.keys.append(f"{tag}.{'.'.join(sorted(attributes.get('class', '').split()))}" if attributes.get("class") else tag)
                self.parents.append(node)
                node = len(self.keys) - 1
            if tag in RAW:
                ended = _RAW_END[tag].search(html, at)
                end = ended.start() if ended else len(html)
                close = html.find(">", end)
                at = len(html) if close < 0 else close + 1
                continue
            if not rest.endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span", "em", "strong"):
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, node, unwanted, main, header))
        flush()

    def shape(self) -> tuple[str, np.ndarray]:
        """The structure as lines "parent key" in pre-order, equal siblings in a row taken as one, and each node's line."""
        n = len(self.keys)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parents[i]].append(i)
        known: dict[tuple, int] = {}
        form = [0] * n
        for i in range(n - 1, -1, -1):
            own: list[int] = []
            for c in children[i]:
                if not own or own[-1] != form[c]:
                    own.append(form[c])
            form[i] = known.setdefault((self.keys[i], *own), len(known))
        lines, place = [], np.zeros(n, np.int32)
        todo = [(0, -1)]
        alike: dict[int, list[int]] = {0: [0]}
        while todo:
            first, parent = todo.pop()
            at = len(lines)
            lines.append(f"{parent} {self.keys[first]}")
            rows: list[list[int]] = []
            for member in alike.pop(first):
                place[member] = at
                k = -1
                last = None
                for c in children[member]:
                    if form[c] != last:
                        k, last = k + 1, form[c]
                        if k == len(rows):
                            rows.append([])
                    rows[k].append(c)
            for row in reversed(rows):
                alike[row[0]] = row
                todo.append((row[0], at))
        return "\n".join(lines), place


class Template:
    """A tree of keys that grows by aligning shapes with it."""

    def __init__(self, shape: str):
        self.keys, self.children = [], []
        for line in shape.split("\n"):
            parent, _, key = line.partition(" ")
            self.keys.append(key)
            self.children.append([])
            if int(parent) >= 0:
                self.children[int(parent)].append(len(self.keys) - 1)

    def match(self, other: Template) -> dict[int, int]:
        """Node of other -> node here, by simple tree matching: the most pairs of nodes with equal keys, order and parents kept.

        Siblings that agree from the front are paired at once, and so are those from
        the back; the table is for what lies between. Where that has over MOST_CELLS
        pairs, each sibling takes the next one of its key.
        """
        weight: dict[tuple[int, int], int] = {}
        plans: dict[tuple[int, int], tuple] = {}
        todo = [(0, 0, False)]
        while todo:
            a, b, ready = todo.pop()
            if (a, b) in weight:
                continue
            if not ready:
                plans[a, b] = plan = self._plan(self.children[a], other.children[b], other.keys)
                todo.append((a, b, True))
                todo += [(x, y, False) for x, y in (*plan[0], *plan[1]) if (x, y) not in weight]
                continue
            sure, maybe, mine, theirs = plans[a, b]
            table = None
            if maybe:
                table = np.zeros((len(mine) + 1, len(theirs) + 1), np.int32)
                row, column = {x: i for i, x in enumerate(mine)}, {y: j for j, y in enumerate(theirs)}
                worth = np.zeros((len(mine), len(theirs)), np.int32)
                for x, y in maybe:
                    worth[row[x], column[y]] = weight[x, y]
                for i in range(len(mine)):
                    best = np.maximum(table[i, 1:], table[i, :-1] + worth[i])
                    table[i + 1, 1:] = np.maximum.accumulate(best)
            weight[a, b] = 1 + sum(weight[p] for p in sure) + (int(table[-1, -1]) if maybe else 0)
            plans[a, b] = sure, mine, theirs, table
        out, todo = {0: 0}, [(0, 0)]
        while todo:
            sure, mine, theirs, table = plans[todo.pop()]
            pairs = list(sure)
            i, j = (len(mine), len(theirs)) if table is not None else (0, 0)
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((mine[i], theirs[j]))
            for x, y in pairs:
                out[y] = x
                todo.append((x, y))
        return out

    def _plan(self, mine: list[int], theirs: list[int], keys: list[str]) -> tuple[list, list, list, list]:
        """Pairs that are sure, pairs to weigh, and the siblings between which these lie."""
        low, most = 0, min(len(mine), len(theirs))
        while low < most and self.keys[mine[low]] == keys[theirs[low]]:
            low += 1
        high = 0
        while high < most - low and self.keys[mine[-1 - high]] == keys[theirs[-1 - high]]:
            high += 1
        sure = [*zip(mine[:low], theirs[:low], strict=True), *zip(mine[len(mine) - high :], theirs[len(theirs) - high :], strict=True)]
        mine, theirs = mine[low : len(mine) - high], theirs[low : len(theirs) - high]
        if len(mine) * len(theirs) <= MOST_CELLS:
            return sure, [(x, y) for x in mine for y in theirs if self.keys[x] == keys[y]], mine, theirs
        where: dict[str, list[int]] = {}
        for i, x in enumerate(mine):
            where.setdefault(self.keys[x], []).append(i)
        at = 0
        for y in theirs:
            own = where.get(keys[y], [])
            k = bisect_left(own, at)
            if k < len(own):
                sure.append((mine[own[k]], y))
                at = own[k] + 1
        return sure, [], mine, theirs

    def merge(self, other: Template) -> None:
        """Add what of other has no partner here, after its nearest aligned sibling."""
        partner = self.match(other)
        for b in range(len(other.keys)):
            if b not in partner:
                self.keys.append(other.keys[b])
                self.children.append([])
                partner[b] = len(self.keys) - 1
            at = self.children[partner[b]]
            last = 0
            for c in other.children[b]:
                if c in partner:
                    last = at.index(partner[c]) + 1 if partner[c] in at else last
                else:
                    self.keys.append(other.keys[c])
                    self.children.append([])
                    partner[c] = len(self.keys) - 1
                    at.insert(last, partner[c])
                    last += 1

    def shape(self) -> str:
        lines, todo = [], [(0, -1)]
        while todo:
            node, parent = todo.pop()
            at = len(lines)
            lines.append(f"{parent} {self.keys[node]}")
            todo += [(c, at) for c in reversed(self.children[node])]
        return "\n".join(lines)


def induce(shapes: list[str]) -> str:
    """The template of some shapes or templates, in an order that doesn't depend on theirs."""
    template = None
    for shape in sorted(set(shapes), key=lambda s: (len(s), s)):
        if template is None:
            template = Template(shape)
        else:
            template.merge(Template(shape))
    return template.shape()


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64))


def host(url) -> F.Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _own(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))


def by_tags(kinds: list[int]) -> list[int]:
    """The wanted blocks within articles, else those within main, else all that aren't mostly links."""
    main = max((k & (MAIN | ARTICLE) for k in kinds if not k & UNWANTED), default=0)
    return [i for i, k in enumerate(kinds) if not k & UNWANTED and (k & (MAIN | ARTICLE) == main if main else not k & LINKED)]


def by_template(kinds: list[int], slots: list[int], hashes: list[int], region: set[int], fixed: set[tuple[int, int]]) -> list[int]:
    """The wanted blocks in the region's slots whose text isn't the template's; links beyond articles go. A page without any there is read by its tags."""
    free = [i for i, (s, h) in enumerate(zip(slots, hashes, strict=True)) if (s, h) not in fixed]
    kept = [i for i in free if slots[i] in region and not kinds[i] & UNWANTED and (kinds[i] & (MAIN | ARTICLE) or not kinds[i] & LINKED)]
    return kept or [i for i in by_tags(kinds) if i in set(free)]


def content_region(template: str, slots: list[int], mass: list[float], share: float = 0.8) -> list[int]:
    """The nodes of the template's smallest subtree that holds `share` of the mass, on the way down from the root.

    The way ends where text stands beside: in the node itself, or in a child without
    children of its own, such as a heading or a paragraph.
    """
    tree = Template(template)
    total = np.zeros(len(tree.keys))
    for slot, m in zip(slots, mass, strict=True):
        total[slot] += m
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += tree.children[node]
    below = total.copy()
    for node in reversed(order):
        below[node] += below[tree.children[node]].sum()
    node, most = 0, below[0]
    while most > 0 and not total[node] and not any(total[c] and not tree.children[c] for c in tree.children[node]):
        best = max(tree.children[node], key=lambda c: below[c], default=None)
        if best is None or below[best] < share * most:
            break
        node = best
    out, todo = [], [node]
    while todo:
        out.append(todo.pop())
        todo += tree.children[out[-1]]
    return sorted(out)


def _hashes() -> F.Column:
    """What tells the texts of a slot apart."""
    return F.transform("texts", lambda t: F.xxhash64(t))


def wrappers(read_: DataFrame, min_pages: int = 3, min_share: float = 0.5, fan: int = 32) -> DataFrame:
    """(form_key, n, slots, region, fixed_slots, fixed_texts) of each shape of a host's pages; region is null for hosts of fewer than min_pages different pages.

    A text belongs to the template if min_pages different pages and min_share of all
    of the host have it in the same slot. Pages whose three longest blocks are alike
    are copies and count once. The shapes of a host are merged `fan` at a time, round by round. A
    host has 2 / min_share such texts at most for each block of a page.
    """
    shapes = materialize(read_.groupBy("host", "form_key").agg(F.max("shape").alias("shape"), F.count(F.lit(1)).alias("n")), "shapes")

    def fold(key, rows):
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "shape": [induce(rows["shape"].tolist())]})

    left = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    parts = shapes.select("host", "shape")
    while left > fan:
        left = -(-left // fan)
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(left))).groupBy("host", "salt").applyInPandas(fold, "host string, shape string")
        parts = materialize(parts, "template-parts")
    templates = materialize(parts.groupBy("host").applyInPandas(fold, "host string, shape string").select(F.col("host").alias("t_host"), F.col("shape").alias("template")), "templates")

    def align(batch):
        known: dict[str, Template] = {}
        slots = []
        for shape, template in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            own, other = known.setdefault(template, Template(template)), Template(shape)
            partner = own.match(other)
            slots.append([partner.get(i, -1) for i in range(len(other.keys))])
        yield {"host": batch.column(0), "form_key": batch.column(1), "n": batch.column(2), "slots": slots}

    aligned = shapes.join(templates, shapes["host"] == templates["t_host"]).select("host", "form_key", "n", "shape", "template")
    slots = materialize(map_batches(aligned, align, struct("host string, form_key long, n long, slots array<int>")), "slots")

    pages = read_.count()
    narrow = read_.select("host", "form_key", "content", "nodes", _hashes().alias("hashes"), F.transform("texts", F.length).alias("sizes"), "kinds")
    narrow = join_to_few(narrow, slots.drop("host"), "form_key", "n", pages)
    each = narrow.select("host", "content", "slots", F.explode(F.arrays_zip("nodes", "hashes", "sizes", "kinds")).alias("b"))
    each = each.select("host", "content", F.element_at("slots", F.col("b.nodes") + 1).alias("slot"), F.col("b.hashes").alias("text"), F.col("b.sizes").alias("size"), F.col("b.kinds").alias("kind"))
    # What weighs in a slot: the wanted text that isn't mostly links, twice within main and three times within an article.
    weight = F.when((F.col("kind").bitwiseAND(UNWANTED) == 0) & ((F.col("kind") >= MAIN) | (F.col("kind").bitwiseAND(LINKED) == 0)), F.col("size") * F.when(F.col("kind") >= ARTICLE, 3).when(F.col("kind") >= MAIN, 2).otherwise(1)).otherwise(0)
    texts = each.groupBy("host", "slot", "text", "content").agg(F.sum(weight).alias("mass")).groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("pages"), F.sum("mass").alias("mass"))
    texts = materialize(texts, "slot-texts")
    totals = read_.select("host", "content").distinct().groupBy(F.col("host").alias("n_host")).agg(F.count(F.lit(1)).alias("different"))
    totals = materialize(texts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(totals, F.col("host") == F.col("n_host")).drop("n_host"), "hosts")
    is_fixed = (F.col("pages") >= min_pages) & (F.col("pages") >= min_share * F.col("different"))
    marked = join_to_few(texts, totals, "host", "n", texts.count()).withColumn("fixed", is_fixed)
    varying = marked.groupBy("host", "slot").agg(F.sum(F.when(~F.col("fixed"), F.col("mass")).otherwise(0)).cast("double").alias("mass"), F.max("different").alias("different"))
    varying = varying.where((F.col("mass") > 0) & (F.col("slot") >= 0) & (F.col("different") >= min_pages)).groupBy("host").agg(F.collect_list("slot").alias("at"), F.collect_list("mass").alias("mass"))
    fixed = marked.where("fixed").groupBy(F.col("host").alias("f_host")).agg(F.collect_list("slot").alias("fixed_slots"), F.collect_list("text").alias("fixed_texts"))

    def choose(batch):
        rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
        yield {"r_host": batch.column(0), "region": [content_region(*row) for row in rows]}

    regions = map_batches(varying.join(templates, F.col("host") == F.col("t_host")).select("host", "template", "at", "mass"), choose, struct("r_host string, region array<int>"))
    hosts = materialize(regions.join(fixed, F.col("r_host") == F.col("f_host"), "left").drop("f_host"), "regions")
    return materialize(slots.join(hosts, F.col("host") == F.col("r_host"), "left").select("form_key", "n", "slots", "region", "fixed_slots", "fixed_texts"), "wrappers")


READ = struct("page_id long, url string, host string, shape string, content long, nodes array<int>, texts array<string>, kinds array<int>")
SCHEMA = struct("page_id long, url string, text string, n_chars long, n_template int, by_template boolean")


def extract_main_text(pages: DataFrame, **how) -> DataFrame:
    """One row for each row of pages: page_id, url, text, its length in code points, how many blocks went to the template, and whether a template chose.

    The whole html is read. Character references are decoded, white space within a
    block becomes one space, blocks are joined by a line feed. Null or empty html
    gives an empty text; pages without a host form one; a null page_id stays null;
    rows that repeat a page give repeated results; other columns are ignored. Elements
    nested deeper than MOST_DEPTH count as part of the block around them.
    """

    def read(batch):
        out = {c: [] for c in READ.names}
        out["page_id"], out["url"], out["host"] = batch.column(0), batch.column(1), batch.column(2)
        for text in batch.column(3).to_pylist():
            page = Page(text)
            shape, place = page.shape()
            out["shape"].append(shape)
            out["nodes"].append([int(place[b[0]]) for b in page.blocks])
            out["texts"].append([b[1] for b in page.blocks])
            out["kinds"].append([b[2] for b in page.blocks])
            # Pages whose longest blocks are the same are taken for copies.
            longest = sorted({b[1] for b in page.blocks if not b[2] & UNWANTED}, key=lambda x: (-len(x), x))[:3]
            out["content"].append(_hash("\n".join(longest)))
        yield out

    read_ = map_batches(_own(pages), read, READ).withColumn("form_key", F.xxhash64("host", "shape"))
    read_ = materialize(read_, "pages-read", "zstd")
    found = wrappers(read_, **how)

    def write(batch):
        n_texts, names = batch.num_rows, ("page_id", "url", "nodes", "texts", "hashes", "kinds", "slots", "region", "fixed_slots", "fixed_texts")
        col = {c: batch.column(k).to_pylist() if k > 1 else batch.column(k) for k, c in enumerate(names)}
        out = {"page_id": col["page_id"], "url": col["url"], "text": [], "n_chars": [], "n_template": [], "by_template": []}
        for r in range(n_texts):
            kinds, texts = col["kinds"][r], col["texts"][r]
            if col["region"][r] is None:
                kept, left = by_tags(kinds), 0
            else:
                slots = [col["slots"][r][k] for k in col["nodes"][r]]
                fixed = set(zip(col["fixed_slots"][r] or (), col["fixed_texts"][r] or (), strict=True))
                kept = by_template(kinds, slots, col["hashes"][r], set(col["region"][r]), fixed)
                left = len(texts) - len(kept)
            text = "\n".join(texts[i] for i in kept)
            out["text"].append(text)
            out["n_chars"].append(len(text))
            out["n_template"].append(left)
            out["by_template"].append(col["region"][r] is not None)
        yield out

    joined = join_to_few(read_.select("page_id", "url", "nodes", "texts", "kinds", "form_key"), found, "form_key", "n", read_.count())
    columns = ["page_id", "url", "nodes", "texts", _hashes().alias("hashes"), "kinds", "slots", "region", "fixed_slots", "fixed_texts"]
    return map_batches(joined.select(*columns), write, SCHEMA)
