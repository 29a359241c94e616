"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper.  Each page's DOM tree is aligned with up to
REFERENCES other pages of its host (those with the smallest of as many hashes of
the page_id) by simple tree matching: equal subtrees are aligned first, then
nodes of one tag.  A text that most references repeat at the aligned place is
template, a varying slot is content.  This holds inside article and main
elements too, if two references at least agree and the article keeps half of its
text; other text outside of them counts only on pages without such elements.
Elements whose role is menu, header, footer, sidebar, notice, advert, form,
script, style or reader comments never are content; a header inside an article
is part of it.

A reference holds tags and text hashes only, so a hot host costs small rows,
and the join is salted.  A reference equal to the page is left out; if there is
no other, nothing is template.  Trees of any depth and markup that is none
are read.  Null or empty html: empty text.  Null or malformed url: the host "".
Repeated or null page_ids: each row by itself.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import arrow_map, hot_join
from trawl.session import bounded_broadcast, materialize

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
DROP = set("script style nav header footer aside form noscript template title head iframe svg button select "
           "textarea dialog menu object".split())
_WORDS = (r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|notice|consent|popup|modal|sidebar|side-bar|menu|nav|navbar|"
          r"navigation|breadcrumbs?|masthead|comments?|disqus|replies|newsletter|subscribe|share|related")
ROLE = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.I)
OUTER = re.compile(r"(?:^|\s)(?:(?:site|page|main|top|global)[_-])?(?:header|footer)(?:$|\s)", re.I)
SOCIAL = re.compile(r"^\s*social\s*$|(?:^|\s)social[_-](?:links|icons|media|bar|buttons|share)", re.I)
REFERENCES = 5
CELLS = 40_000  # of an alignment table kept whole
WHOLE = {"article", "main"}
HEADS = {"header", "footer"}  # inside an article they are part of it
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
CLOSES_P = BLOCK - {"body", "html"}
NOT_P = BLOCK - {"p"}


class Node:
    __slots__ = ("tag", "drop", "kids", "inside")

    def __init__(self, tag, drop=False, inside=False):
        self.tag, self.drop, self.kids, self.inside = tag, drop, [], inside or tag in WHOLE


class Dom(HTMLParser):
    """A forgiving tree of block elements; inline text goes to its block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _pop(self, tag, stop=()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def dropped(self, tag, attrs) -> bool:
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "") + " " + a.get("id", "")
        if tag in ("body", "html"):
            return False
        inside = self.open[-1].inside
        if tag in DROP and not (inside and tag in HEADS):
            return True
        return a.get("role", "").lower() in ROLES or "hidden" in a or bool(ROLE.search(names)) or bool(SOCIAL.search(names)) \
            or not inside and bool(OUTER.search(names))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in DROP:
            if tag in CLOSES_P or tag in DROP:
                self._pop("p", NOT_P)
            if tag == "li":
                self._pop("li", {"ul", "ol", "menu"})
            elif tag in ("dt", "dd"):
                self._pop("dt", {"dl"})
                self._pop("dd", {"dl"})
            elif tag in ("td", "th", "tr"):
                self._pop("td", {"tr", "table"})
                self._pop("th", {"tr", "table"})
                if tag == "tr":
                    self._pop("tr", {"table"})
            elif tag == "body":
                self._pop("head")
        elif tag == "br":
            self.open[-1].kids.append(" ")
            return
        elif tag in VOID or not self.dropped(tag, attrs):
            return  # inline text goes to its block
        node = Node(tag, self.dropped(tag, attrs), self.open[-1].inside)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in DROP:
            self._pop(tag, () if tag in ("body", "html", *WHOLE, *DROP) else WHOLE | DROP)
        elif self.open[-1].tag == tag:  # a dropped inline element
            self.open.pop()

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment up to the next ``>``, as in browsers."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(html: str | None) -> Node:
    dom, html = Dom(), html or ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[a-zA-Z/!]", html[cut:cut + 2]):
        html = html[:cut]  # the file ends inside a tag
    dom.feed(html)
    dom.close()
    return dom.root


def squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def runs(node: Node):
    """The children of a node as text runs (str) and nodes, in order."""
    held: list[str] = []
    for k in node.kids:
        if isinstance(k, str):
            held.append(k)
            continue
        if k.drop and k.tag not in BLOCK and k.tag not in DROP:
            continue  # the text around a dropped inline element is one
        if text := squeeze(held):
            yield text
        held = []
        yield k
    if text := squeeze(held):
        yield text


class Tree:
    """A node of an outline: tag, children (trees, or hashes of texts), a hash of all
    that, and the numbers of its texts, ``first`` up to ``last``."""
    __slots__ = ("tag", "kids", "key", "first", "last")

    def __init__(self, tag, first):
        self.tag, self.kids, self.first = tag, [], first


def outline(root: Node) -> list:
    """The tags (opening) and text hashes of a tree in page order, None closing a
    node; dropped elements are left out."""
    out, todo = [], [root]
    while todo:
        k = todo.pop()
        if k is None:
            out.append(None)
        elif isinstance(k, str):
            out.append(xxhash.xxh3_64_intdigest(k))
        else:
            out.append(k.tag)
            todo.append(None)
            todo.extend(x for x in [*runs(k)][::-1] if isinstance(x, str) or not x.drop)
    return out


def grown(tokens: list) -> Tree:
    """The tree of an outline."""
    top, n = Tree("", 0), 0
    path = [top]
    for t in tokens:
        if t is None:
            node = path.pop()
            node.last = n
            node.key = xxhash.xxh3_64_intdigest(repr((node.tag, [k.key if isinstance(k, Tree) else k for k in node.kids])))
        elif isinstance(t, str):
            node = Tree(t, n)
            path[-1].kids.append(node)
            path.append(node)
        else:
            path[-1].kids.append(t)
            n += 1
    return top.kids[0]


def key_of(x) -> int:
    return x.key if isinstance(x, Tree) else x


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places in two lists of children, in order: equal ones first, then nodes
    of one tag.  Lists of any length are aligned by the same table; of wide ones a
    few rows are kept, and those between are made again on the way back."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < min(ha, hb) and key_of(a[lo]) == key_of(b[lo]):
        lo += 1
    while ha > lo and hb > lo and key_of(a[ha - 1]) == key_of(b[hb - 1]):
        ha, hb = ha - 1, hb - 1
    out = [(i, i) for i in range(lo)] + [(ha + i, hb + i) for i in range(len(a) - ha)]
    rows, cols = ha - lo, hb - lo
    if not rows or not cols:
        return out

    def weight(x, y):
        if key_of(x) == key_of(y):
            return 2
        return int(isinstance(x, Tree) and isinstance(y, Tree) and x.tag == y.tag)

    def back(table, i, j, top):
        """The path from row i, column j up to row ``top``, the first of ``table``."""
        while i > top and j:
            w = weight(a[lo + i - 1], b[lo + j - 1])
            if w and table[i - top][j] == table[i - top - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((lo + i, lo + j))
            elif table[i - top][j] == table[i - top - 1][j]:
                i -= 1
            else:
                j -= 1
        return j

    if rows * cols <= CELLS:
        table = [[0] * (cols + 1)]
        for i in range(lo, ha):
            prev, row = table[-1], [0]
            for j in range(lo, hb):
                row.append(max(prev[j - lo + 1], row[-1], prev[j - lo] + weight(a[i], b[j])))
            table.append(row)
        back(table, rows, cols, 0)
        return out
    keys = np.array([key_of(y) for y in b[lo:hb]], np.uint64)
    number = {t: n for n, t in enumerate({y.tag for y in b[lo:hb] if isinstance(y, Tree)})}
    tags = np.array([number[y.tag] if isinstance(y, Tree) else -1 for y in b[lo:hb]])

    def following(prev, i):
        """Row i + 1 of the table."""
        x = a[lo + i]
        w = (tags == number.get(x.tag, -2)).astype(np.int32) if isinstance(x, Tree) else np.zeros(cols, np.int32)
        w[keys == np.uint64(key_of(x))] = 2
        row = np.zeros(cols + 1, np.int32)
        np.maximum.accumulate(np.maximum(prev[1:], prev[:-1] + w), out=row[1:])
        return row

    step = math.isqrt(rows) + 1
    kept = [row := np.zeros(cols + 1, np.int32)]
    for i in range(rows):
        row = following(row, i)
        if (i + 1) % step == 0:
            kept.append(row)
    j, end = cols, rows
    while end and j:
        top = (end - 1) // step * step
        table = [kept[top // step]]
        for i in range(top, end):
            table.append(following(table[-1], i))
        j, end = back(table, end, j, top), top
    return out


def constant(page: Tree, ref: Tree) -> list[int]:
    """Simple tree matching, top down: the numbers of the page's texts that are
    aligned with an equal text of the reference."""
    found, todo = [], [(page, ref)]
    while todo:
        x, y = todo.pop()
        if x.key == y.key:
            found.extend(range(x.first, x.last))
            continue
        n, numbers = x.first, []
        for k in x.kids:
            numbers.append(n)
            n = k.last if isinstance(k, Tree) else n + 1
        for i, j in aligned(x.kids, y.kids):
            if isinstance(x.kids[i], Tree) and isinstance(y.kids[j], Tree):
                todo.append((x.kids[i], y.kids[j]))
            elif key_of(x.kids[i]) == key_of(y.kids[j]):
                found.append(numbers[i])
    return found


def content(root: Node, refs: list[list]) -> list[str]:
    """The blocks of a page that are content, given outlines of other pages."""
    own = outline(root)
    others = [r for r in refs if r != own]
    votes: Counter = Counter()
    if others:
        mine = grown(own)
        for r in others:
            votes.update(constant(mine, grown(r)))
    texts, todo = [], [(root, False)]  # (text, inside an article or main element)
    while todo:
        k, inside = todo.pop()
        if isinstance(k, str):
            texts.append((k, inside))
        else:
            inside = inside or k.tag in WHOLE
            todo.extend((x, inside) for x in [*runs(k)][::-1] if isinstance(x, str) or not x.drop)
    template = [2 * votes[i] > len(others) for i in range(len(texts))]
    whole = [t for t, inside in texts if inside]
    varying = [t for i, (t, inside) in enumerate(texts) if inside and not (template[i] and votes[i] > 1)]
    if 2 * sum(map(len, varying)) >= sum(map(len, whole)) > 0:
        return varying
    blocks = [t for (t, _), same in zip(texts, template) if not same]
    return whole or blocks or [t for t, _ in texts]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z]+://([^/?#]+)", 1).alias("host"))

    def outlines(b):
        return {"host": b["host"], "page_id": b["page_id"],
                "tree": [json.dumps(outline(tree(h)), separators=(",", ":")) for h in b["html"]]}

    # the references are chosen by page_id alone; only they are parsed here
    own = rows.where("page_id IS NOT NULL")
    ids = own.groupBy("host").agg(*[F.min_by("page_id", F.xxhash64("page_id", F.lit(i))).alias(f"id{i}") for i in range(REFERENCES)])
    ids = materialize(ids, "references")
    chosen = ids.select("host", F.explode(F.array_distinct(F.array(*[f"id{i}" for i in range(REFERENCES)]))).alias("page_id"))
    n_hosts, longest = ids.agg(F.count(F.lit(1)), F.max(F.octet_length("host"))).first()
    chosen = bounded_broadcast(chosen, n_hosts * REFERENCES, 48 + (longest or 0))
    trees = arrow_map(own.join(chosen, ["host", "page_id"], "left_semi").select("host", "page_id", "html"), outlines,
                      "host string, page_id long, tree string",
                      pa.schema([("host", pa.string()), ("page_id", pa.int64()), ("tree", pa.string())]))
    refs = trees.groupBy("host").agg(*[F.min_by("tree", F.xxhash64("page_id", F.lit(i))).alias(f"ref{i}") for i in range(REFERENCES)])
    refs = refs.select("host", F.array_distinct(F.array(*[f"ref{i}" for i in range(REFERENCES)])).alias("refs"))

    def texts(b):
        known = {r: json.loads(r) for rs in b["refs"] for r in rs or ()}
        out = ["\n".join(content(tree(h), [known[r] for r in rs or ()])) for h, rs in zip(b["html"], b["refs"])]
        return {"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]}

    joined = hot_join(rows, refs, "host", "page_id", "left")
    return arrow_map(joined.select("page_id", "url", "html", "refs"), texts,
                     "page_id long, url string, text string, n_chars long",
                     pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                                ("n_chars", pa.int64())]), 64)
