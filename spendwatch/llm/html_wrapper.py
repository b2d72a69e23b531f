"""Main text of web pages by wrapper induction.

Up to ``EXEMPLARS`` pages of a host are its wrapper.  Every page is aligned with
the best of them by simple tree matching on the DOM trees (same tag, children
matched in order, largest total), which names the slot of each block; a block
without a partner keeps its own path.  Over all pages of the host, the pages that
have a text in a slot are counted; text on most pages is template and dropped,
everywhere on the page.  The outermost ``article`` and ``main`` elements, all of
them, are the region, the whole page where there is none; inside them more
pages must agree (``template_keys``), and one that would lose most of its words
is kept.  Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are cut
by element, role and class name first, but no element that holds the article,
and none that holds most of the text for a form or a part of its name.

Every page is extracted from its whole html; exemplars only name slots.  The
exemplars and templates of all hosts are broadcast when their measured size is
below ``BROADCAST_BYTES``, and joined by host otherwise.

Defined cases: null or empty html gives an empty text; a page without a host
or alone on it has no template; pages that differ in template only are copies
and count once; broken markup is repaired by the usual closing rules; child
lists of every length and depth are matched exactly, in linear space; repeated
rows are extracted each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

EXEMPLARS = 3
BROADCAST_BYTES = 16 << 20
TABLE_CELLS = 40_000   # larger tables are halved; the matching is the same
TREES = 64           # hosts whose parsed exemplars a worker keeps

# HTML element classes (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu "
                  "nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
BARRIER = frozenset("html body table td th caption button object template article section div main aside nav "
                    "header footer form blockquote".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
                "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
                "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CUT = frozenset("head title script style noscript template nav footer aside form button select textarea input menu "
                "iframe object embed svg canvas audio video dialog fieldset datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                      "toolbar".split())
CUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
                      "navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice "
                      "notices notification popup modal overlay comment comments commentlist reply replies disqus "
                      "respond share sharing social related recommended newsletter subscribe subscription signup login "
                      "toolbar pagination pager widget".split())
# class words that name a part also inside a longer name ("ad-box"); the others may describe a wrapper ("has-sidebar")
PART_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr "
                       "comment comments commentlist disqus newsletter".split())
NEVER = frozenset("head title script style noscript template iframe object embed svg canvas audio video".split())
HEAD_NAMES = frozenset("header masthead".split())
CONTENT = frozenset(["article", "main"])


class Node:
    """An element: ``kids`` are elements and texts in order; after parsing ``els`` has the elements,
    ``text`` the own text, ``own`` its words, ``shape`` a hash of the tags below, ``size`` their number;
    ``path`` keeps the region path of an exemplar."""

    __slots__ = ("tag", "cut", "name", "kids", "els", "text", "own", "shape", "size")

    def __init__(self, tag, cut=0, name=""):
        self.tag, self.cut, self.name, self.kids = tag, cut, name, []


class _Builder(HTMLParser):
    """Tree of elements and texts; cut elements are marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]

    def _close(self, tags, barrier) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, BARRIER)
        if tag in SELF_CLOSING:
            self._close(*SELF_CLOSING[tag])
        if tag in ("html", "body") and self.root.kids and any(n.tag == tag for n in self.stack):
            return
        if tag == "html":
            return
        if tag == "body":
            self._close({"head"}, ())
        at = dict(attrs) if attrs else {}
        inside = any(n.tag in CONTENT for n in self.stack)
        node = Node(tag, _is_cut(tag, at, inside), (at.get("class") or "").lower() if at else "")
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use") and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK and tag not in CUT:
                return            # a stray inline end tag closes no block

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


_TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _is_cut(tag: str, at: dict, inside: bool) -> int:
    """0: kept; 1: cut unless it holds most of the page's text; 2: cut; 3: never text.  See ``_pruned`` for 1 and 2."""
    if tag in NEVER:
        return 3
    if tag in CUT or tag == "header" and not inside:
        return 1 if tag in ("form", "fieldset") else 2
    if not at or tag in CONTENT or tag == "body":
        return 0
    if "hidden" in at or at.get("aria-hidden") == "true":
        return 3
    if (at.get("role") or "").lower() in CUT_ROLES:
        return 1 if at["role"].lower() == "form" else 2
    cut = 0
    for key in ("class", "id"):
        if at.get(key):
            whole = {t.lower() for t in at[key].split()}
            names = {t.lower() for t in _TOKENS.findall(at[key])}
            if whole & CUT_NAMES or names & PART_NAMES or not inside and whole & HEAD_NAMES:
                return 2
            if not inside and names & (CUT_NAMES | HEAD_NAMES):
                cut = 1
    return cut


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return _pruned(b.root)


def _pruned(root: Node) -> Node:
    """Without cut elements, with the derived fields; recursion-free.

    An element with an article or main is not cut while none stands outside cut elements, and
    one that is cut for a form or a part of its name is not cut when it holds most of the text.
    """
    order, todo = [], [(root, False)]
    free = False                  # an article or main outside cut elements
    while todo:
        node, below = todo.pop()
        order.append(node)
        free |= node.tag in CONTENT and not below
        todo += [(k, below or k.cut > 0) for k in node.kids if not isinstance(k, str) and k.cut < 3]
    words: dict = {}              # words outside parts that are cut for certain, and whether there is an article or main
    for node in reversed(order):
        n, holds = 0, node.tag in CONTENT
        for k in node.kids:
            if isinstance(k, str):
                n += len(k.split())
            elif k.cut < 3:
                n += words[id(k)][0] if k.cut < 2 else 0
                holds |= words[id(k)][1]
        words[id(node)] = n, holds
    total = words[id(root)][0]

    def kept(k):
        if not k.cut or k.cut == 3:
            return not k.cut
        n, holds = words[id(k)]
        return holds and not free or k.cut == 1 and 2 * n > total

    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        node.kids = [k for k in node.kids if isinstance(k, str) or kept(k)]
        node.els = [k for k in node.kids if not isinstance(k, str)]
        own = " ".join([k for k in node.kids if isinstance(k, str)]).split()
        node.text, node.own = " ".join(own), len(own)
        todo += node.els
    for node in reversed(order):
        node.size = 1 + sum(k.size for k in node.els)
        node.shape = hash((node.tag, *[k.shape for k in node.els]))
    return root


def match(a: Node, b: Node, memo: dict | None = None) -> int:
    """Simple tree matching: size of the largest order-preserving matching of equal tags, at every size and depth."""
    memo = {} if memo is None else memo
    if a.tag != b.tag:
        return 0
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        if _known(p, q, memo) is not None:
            todo.pop()
            continue
        head, x, y, tail = _trimmed(p.els, q.els)
        by: dict = {}
        for v in {v.shape: v for v in y}.values():
            by.setdefault(v.tag, []).append(v)
        need = [(u, v) for u in {u.shape: u for u in x}.values() for v in by.get(u.tag, ())
                if _known(u, v, memo) is None]
        if need:
            todo += need
            continue
        todo.pop()
        same = sum(u.size for u in p.els[:head]) + sum(u.size for u in p.els[len(p.els) - tail:])
        memo[p.shape, q.shape] = 1 + same + (_last_row(x, y, memo)[-1] if x and y else 0)
    return _known(a, b, memo)


def _known(a: Node, b: Node, memo: dict) -> int | None:
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    return memo.get((a.shape, b.shape)) if a.els and b.els else 1


def _trimmed(x: list, y: list) -> tuple[int, list, list, int]:
    """(head, x, y, tail): the lists without their equal heads and tails, which a largest matching can always pair."""
    n, head, tail = min(len(x), len(y)), 0, 0
    while head < n and x[head].shape == y[head].shape:
        head += 1
    while tail < n - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    return head, x[head:len(x) - tail], y[head:len(y) - tail], tail


def _rows(x, y, memo):
    """The rows of the matching table, one at a time; weights are looked up once per pair of shapes."""
    weights: dict = {}
    last = [0] * (len(y) + 1)
    yield last
    for p in x:
        if p.shape not in weights:
            of = {v.shape: match(p, v, memo) for v in {v.shape: v for v in y}.values()}
            weights[p.shape] = [of[v.shape] for v in y]
        row, best = [0], 0
        for j, w in enumerate(weights[p.shape]):
            if w and last[j] + w > best:
                best = last[j] + w
            if last[j + 1] > best:
                best = last[j + 1]
            row.append(best)
        last = row
        yield last


def _last_row(x, y, memo) -> list:
    for last in _rows(x, y, memo):
        pass
    return last


def pairs(x: list, y: list, memo: dict):
    """The pairs of a largest matching of two child lists: one table where it is small, else halves (Hirschberg)."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        head, u, v, tail = _trimmed(x, y)
        yield from zip(x[:head], y[:head])
        yield from zip(x[len(x) - tail:], y[len(y) - tail:])
        if not u or not v:
            continue
        if len(u) > 1 and len(u) * len(v) > TABLE_CELLS:
            mid = len(u) // 2
            left, right = _last_row(u[:mid], v, memo), _last_row(u[mid:][::-1], v[::-1], memo)
            cut = max(range(len(v) + 1), key=lambda j: left[j] + right[len(v) - j])
            todo += [(u[:mid], v[:cut]), (u[mid:], v[cut:])]
            continue
        rows = list(_rows(u, v, memo))
        i, j = len(u), len(v)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                yield u[i - 1], v[j - 1]
                i, j = i - 1, j - 1


def partners(a: Node, b: Node):
    """(node of ``a``, its partner in ``b``) of a largest matching."""
    memo: dict = {}
    todo = [(a, b)] if a.tag == b.tag else []
    while todo:
        p, q = todo.pop()
        yield p, q
        todo += pairs(p.els, q.els, memo)


def align(a: Node, b: Node, same: set) -> None:
    """Adds to ``same`` the ids of nodes of ``a`` whose own text equals that of their partner in ``b``."""
    same.update(id(p) for p, q in partners(a, b) if p.text == q.text)


def regions(root: Node) -> list[Node]:
    """All outermost article and main elements in page order, the root if there is none."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in CONTENT:
            out.append(node)
        else:
            todo += reversed(node.els)
    return out or [root]


def blocks(node: Node) -> list[tuple[Node, str]]:
    """Texts of the blocks in page order, white space runs as one space, each with its block element."""
    out: list = []
    now: list[str] = []
    owners = [node]

    def flush():
        s = " ".join("".join(now).split())
        now.clear()
        if s:
            out.append((owners[-1], s))

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is flush:
            flush()
            owners.pop()
        elif isinstance(k, str):
            now.append(k)
        elif k.tag == "br":
            now.append("\n")
        else:
            if k.tag in BLOCK or k is node:
                flush()
                owners.append(k)
                todo.append(flush)
            todo += reversed(k.kids)
    flush()
    return out


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def paths(root: Node) -> dict[int, bytes]:
    """Per node a hash of the tags and classes from the root to it."""
    out = {id(root): _digest(root.tag.encode())}
    todo = [root]
    while todo:
        node = todo.pop()
        for k in node.els:
            out[id(k)] = _digest(out[id(node)], k.tag.encode(), k.name.encode("utf-8", "replace"))
        todo += node.els
    return out


def wrapper(exemplars: list[Node]) -> list[tuple[Node, dict]]:
    """The exemplars with the slot of each node: that of its partner in the best exemplar before, else its path."""
    out: list = []
    for e in exemplars:
        out.append((e, aligned(e, out)))
    return out


def aligned(page: Node, known: list[tuple[Node, dict]]) -> dict[int, bytes]:
    """Per node of the page its slot in the wrapper ``known``."""
    slots = paths(page)
    if known:
        best, names = max(known, key=lambda x: match(page, x[0]))
        slots.update((id(p), names[id(q)]) for p, q in partners(page, best))
    return slots


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def page_slots(page: Node, known: list[tuple[Node, dict]]) -> list[tuple[int, int, int, str]]:
    """(key, slot, words, text) of the blocks of the page's regions; the last bit of ``slot`` tells article and main."""
    names = aligned(page, known)
    out = []
    for top in regions(page):
        inside = top.tag in CONTENT
        for node, text in blocks(top):
            slot = names[id(node)]
            key = _digest(slot, b"in" if inside else b"out", text.encode("utf-8", "replace"))
            out.append((_number(key), _number(slot) & ~1 | inside, text.count(" ") + 1, text))
    return out


def extract(html: str, exemplars: list[Node], template: frozenset = frozenset()) -> str:
    """Main text of one page, as ``main_text`` of its row; ``exemplars`` are parsed pages of its host, ``template``
    the host's template keys."""
    found = page_slots(parse(html), wrapper(exemplars)) if html else []
    whole = sum(n for _, slot, n, _ in found if slot & 1)
    lost = sum(n for key, slot, n, _ in found if slot & 1 and key in template)
    return "\n\n".join(t for key, slot, _, t in found if key not in template or slot & 1 and 2 * lost > whole)


class _Wrappers:
    """Wrappers of the hosts seen last."""

    def __init__(self):
        self.kept: OrderedDict = OrderedDict()

    def of(self, host, found) -> list:
        if host is None:
            return []
        if host not in self.kept:
            self.kept[host] = wrapper([parse(x or "") for x in found() or ()])
            if len(self.kept) > TREES:
                self.kept.popitem(last=False)
        self.kept.move_to_end(host)
        return self.kept[host]


_BLOCKS = "array<struct<words: long, key: long, slot: long, text: string>>"


def _block_rows(known):
    """Columns: page_id, url, host, copy (hash of the html), html, and exemplars unless ``known`` is a broadcast of
    them.  Every page is parsed and aligned once, here; its blocks go on with their keys."""
    kind = pa.list_(pa.struct([("words", pa.int64()), ("key", pa.int64()), ("slot", pa.int64()), ("text", pa.string())]))

    def run(batches):
        wrappers = _Wrappers()
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                s, out = b.slice(lo, 200), []
                for i, (host, html) in enumerate(zip(s.column(2).to_pylist(), s.column(4).to_pylist())):
                    if known is None:
                        found = lambda: s.column(5)[i].as_py()  # noqa: B023, E731
                    else:
                        found = lambda: known.value.get(host, ())  # noqa: B023, E731
                    blocks = page_slots(parse(html), wrappers.of(host, found)) if html else []
                    out.append([(n, key, slot, text) for key, slot, n, text in blocks])
                yield pa.RecordBatch.from_arrays([*s.columns[:4], pa.array(out, kind)],
                                                 names=["page_id", "url", "host", "copy", "blocks"])
    return run


def template_keys(slots: DataFrame) -> DataFrame:
    """(host, key) of template text from host, copy and slots of all pages.

    Equal pages count once, and so do pages whose longest block that most pages of the host
    lack is the same.  Text is template when more than half of the pages that have its slot
    have it there, two at least; in article and main, when more than half of all pages of the
    host have it, three at least.
    """
    pages = materialize(slots.dropDuplicates(["host", "copy"]), "wrapper_slots")
    n = pages.groupBy("host").agg(F.count("*").alias("n"))
    most = (pages.select("host", F.explode("slots.key").alias("key")).groupBy("host", "key").agg(F.count("*").alias("c"))
            .where("c > 1").join(n, "host").where("2 * c > n").groupBy("host").agg(F.collect_set("key").alias("most")))
    most = materialize(most, "wrapper_most")
    pages = pages.join(small_side(most), "host", "left")
    own = F.expr("array_max(filter(slots, x -> most is null or not array_contains(most, x.key))).key")
    pages = materialize(pages.select("host", "slots", F.coalesce(own, F.lit(0)).alias("own")), "wrapper_pages")
    s = pages.select("host", "own", F.explode("slots").alias("s")).select("host", "own", "s.key", "s.slot")
    text = materialize(s.groupBy("host", "slot", "key").agg(F.countDistinct("own").alias("c")).where("c > 1"), "wrapper_text")
    slot = s.groupBy("host", "slot").agg(F.countDistinct("own").alias("has"))
    n = pages.groupBy("host").agg(F.countDistinct("own").alias("n"))
    found = slot.join(n, "host").join(small_side(text), ["host", "slot"])
    inside = F.col("slot").bitwiseAND(F.lit(1)) == 1
    return found.where(F.when(inside, (F.col("c") > 2) & (2 * F.col("c") > F.col("n"))).otherwise(
        2 * F.col("c") > F.col("has"))).select("host", "key").distinct()


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    p = p.withColumn("host", F.when(host != "", host)).withColumn("h", F.xxhash64("page_id", "url"))
    orders = [F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(EXEMPLARS)]
    chosen = materialize(p.where("host is not null").groupBy("host").agg(*orders), "wrapper_hosts")
    picked = F.array(*[F.xxhash64("h", F.lit(k)) for k in range(EXEMPLARS)])
    found = p.join(small_side(chosen.select(F.col("host").alias("__h"), *[f"m{k}" for k in range(EXEMPLARS)])),
                   (F.col("host") == F.col("__h")) & F.exists(F.arrays_zip(picked.alias("p"), F.array(
                       *[F.col(f"m{k}") for k in range(EXEMPLARS)]).alias("m")), lambda x: x["p"] == x["m"]))
    found = materialize(found.select("host", "h", "html").groupBy("host", "h").agg(F.min("html").alias("html")),
                        "wrapper_exemplars")
    lists = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("h", "html"))).alias("ex"))
    lists = lists.select("host", F.col("ex.html").alias("ex"))
    size = found.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    p = p.withColumn("copy", F.xxhash64("html"))
    kind = p.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, copy long, blocks {_BLOCKS}"
    columns = ["page_id", "url", "host", "copy", "html"]
    if size <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r.host: r.ex for r in lists.collect()})
        blocks = p.select(*columns).mapInArrow(_block_rows(known), schema)
    else:
        blocks = p.join(lists, "host", "left").select(*columns, "ex").mapInArrow(_block_rows(None), schema)
    blocks = materialize(blocks, "wrapper_blocks")
    slots = F.array_distinct(F.transform("blocks", lambda x: F.struct(x["words"].alias("words"), x["key"].alias("key"), x["slot"].alias("slot"))))
    keys = materialize(template_keys(blocks.where("host is not null").select("host", "copy", slots.alias("slots"))), "wrapper_template")
    template = keys.groupBy("host").agg(F.collect_list("key").alias("template"))
    if 8 * keys.count() <= BROADCAST_BYTES:
        template = F.broadcast(template)
    return blocks.join(template, "host", "left").withColumn("text", main_text()).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def main_text() -> Column:
    """The text of ``blocks`` without those in ``template``; an article that would lose over half of its words is
    taken for a copy and kept.  The blocks of a page are few and its host's template is one array of numbers."""
    return F.expr("""transform(array(struct(
        aggregate(filter(blocks, x -> x.slot & 1 = 1), 0L, (a, x) -> a + x.words) as whole,
        aggregate(filter(blocks, x -> x.slot & 1 = 1 and array_contains(template, x.key)), 0L, (a, x) -> a + x.words) as lost)),
      s -> array_join(transform(filter(blocks, x -> not coalesce(array_contains(template, x.key), false)
                                                    or x.slot & 1 = 1 and 2 * s.lost > s.whole), x -> x.text), '\n\n'))[0]""")
