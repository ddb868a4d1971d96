"""Main text of web pages by deduction of each host's template from equivalence classes.

1. Tokens of a page are its start and end tags, each with its path of tags, classes and ids, and its whole text nodes
   with their path. Tokens of a host whose occurrence vectors over the host's pages are the same form an equivalence
   class; vectors are compared by a sum of hashes of (page, count), so a class comes from two aggregations and no page
   list is ever built. A class goes on if it is frequent (most of the host's pages) and large.
2. A second pass tests that a class's tokens stand in one order on the pages, and that its instances lie in one slot of
   one class around them. Classes that do so on most pages are valid; nested in each other's slots they are the template.
   The same pass sums up what each slot holds: text outside links, and how much of it stands in parts that their tags
   and class names give to articles, or to menus, notices, forms and comments.
3. Extraction walks a page along its host's template. Template text stays out. A slot is the article's if most of its text
   has evidence for it and not against it; hosts without any such evidence take the slots that hold most of their text.
   Within a slot, parts that pages themselves mark as menus, notices, forms or comments go. Content in a slot that the
   template doesn't know, and pages that leave nothing this way, are judged by the page's own tags.
Pages of hosts with few pages take the template of all pages together, if these are enough.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch


@dataclass(frozen=True)
class Template:
    """few: hosts with fewer pages use all pages' template; share: of a host's pages, for a frequent class; large: its
    tokens at least; agree: share of these pages on which order and nesting are the same; most: share of a host's text
    that slots without evidence need. broadcast_rows: so many template rows are broadcast, more are joined by host in a
    salted shuffle."""

    few: int = 5
    share: float = 0.6
    large: int = 3
    agree: float = 0.9
    most: float = 0.2
    broadcast_rows: int = 200_000
    salts: int = 16


_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# Any attribute, name and then value, so that no name is found inside another's name or value.
_ATTR = re.compile(r"""([^\s=>/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOLD = {"class", "id", "role", "hidden", "aria-hidden"}
_RAW = {"script", "style", "textarea", "title", "template", "svg", "iframe", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_NEVER = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "input"} | _RAW
# Content inside an article, not where a page marks none.
_OUTSIDE = {"header", "label", "noscript"}
# An end tag that is left out: a start tag on the left closes an open one of the right.
_CLOSES = {"p": _BLOCK - {"body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|widget|menu|nav\w*|breadcrumbs?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|social|related|recommended|comments?|comment-list|reply|replies|respond|disqus|footer|masthead|site-header|page-header|toolbar|pagination|pager|copyright|legal)(?:$|[\s_-])", re.I)
_WORD = _ASIDE.pattern[len(r"(?:^|[\s_-])") : -len(r"(?:$|[\s_-])")]
_WHOLE = re.compile(rf"(?:^|\s){_WORD}(?:[_-]{_WORD})*(?=$|\s)", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main)(?:[\s_-](?:body|content|text))?(?:$|\s)", re.I)


class Node:
    __slots__ = ("attrs", "children", "key", "parent", "path", "tag", "wide")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.wide = tag, attrs, parent, [], False
        self.key = f"{tag}.{attrs}" if attrs else tag
        self.path = f"{parent.path}/{self.key}" if parent else ""


@lru_cache(maxsize=1 << 16)
def _attributes(inside: str) -> str:
    """Those attributes of a start tag that tell what it is for, as name=value parts."""
    found = ((k.lower(), v.strip("\"'").replace("=", "-")) for k, v in _ATTR.findall(inside))
    return " ".join(f"{k}={v}" for k, v in found if k in _TOLD)


def _text_size(node: Node) -> int:
    """Characters of text outside links and controls."""
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += len(c.strip())
            elif c.tag not in ("a", "label", "button", "select", "option"):
                stack.append(c)
    return total


def _judge_forms(root: Node, forms: list[Node], marked: list[Node]) -> None:
    """Finds the forms that the page is wrapped in: around a marked article, or, on pages without one, most of the text."""
    for x in marked:
        for up in _ancestors(x):
            up.wide = up.wide or up.tag == "form"
    if not marked:
        whole = _text_size(root)
        for form in forms:
            form.wide = 2 * _text_size(form) > whole


def parse(page: str) -> Node:
    """A tree of elements and text from any string; comments and declarations are left out, unclosed tags are closed."""
    root = at = Node("#root", "", None)
    forms, marked = [], []
    pos, n, low = 0, len(page), None
    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            at.children.append(page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = at
            while up is not root and up.tag != tag:
                # An inline end tag never closes a block.
                if up.tag in _BLOCK and tag not in _BLOCK:
                    break
                up = up.parent
            if up is not root and up.tag == tag:
                at = up.parent
            continue
        up = at
        while up is not root and up.tag not in ("ul", "ol", "dl", "table", "article", "div", "section", "body"):
            if tag in _CLOSES.get(up.tag, ()):
                at = up.parent
                break
            up = up.parent
        node = Node(tag, _attributes(m[3]) if m[3] else "", at)
        at.children.append(node)
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", pos)
            end = n if end < 0 else end
            close = page.find(">", end)
            pos = n if close < 0 else close + 1
            continue
        at = node
        if tag == "form":
            forms.append(node)
        elif _rank(tag, node.attrs) < 2:
            marked.append(node)
    if forms:
        _judge_forms(root, forms, marked)
    return root


def _squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def key(token: str) -> int:
    """A token's 64-bit hash, the same everywhere; templates are sets of them."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def events(root: Node) -> Iterator[tuple[str, Node, str]]:
    """A page in order: ("start", element, path), ("end", element, "/" and path), ("text", its element, its text)."""
    stack: list = [(c, root) for c in reversed(root.children)]
    while stack:
        x, parent = stack.pop()
        if isinstance(x, str):
            if text := _squeeze(x):
                yield "text", parent, text
        elif parent is None:
            yield "end", x, f"/{x.path}"
        else:
            yield "start", x, x.path
            stack.append((x, None))
            stack.extend((c, x) for c in reversed(x.children))


def token(kind: str, node: Node, value: str) -> str:
    return f"{node.path}#{value}" if kind == "text" else value


def tokens(root: Node) -> Counter:
    """Counts of a page's tokens."""
    return Counter(token(*e) for e in events(root))


@lru_cache(maxsize=1 << 16)
def _is_aside(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _NEVER or (tag in _OUTSIDE and not inside):
        return True
    if not attrs:
        return False
    if re.search(r"(?:^|\s)(?:hidden=|aria-hidden=true(?:\s|$)|role=(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert)(?:\s|$))", attrs):
        return True
    names = re.sub(r"(?:^|\s)(?:class|id|role)=", " ", attrs)
    # Of an article's parts a name such as related-work says nothing, one made of listed words alone does.
    return bool((_WHOLE if inside else _ASIDE).search(names)) and tag not in ("article", "main", "body")


def _aside(node: Node, inside: bool) -> bool:
    return not node.wide and _is_aside(node.tag, node.attrs, inside)


@lru_cache(maxsize=1 << 16)
def _rank(tag: str, attrs: str) -> int:
    """What an element is marked as: 0 an article, 1 the main part, 2 content by name, 3 nothing of these."""
    if tag == "article":
        return 0
    if tag == "main" or re.search(r"(?:^|\s)role=main(?:\s|$)", attrs):
        return 1
    return 2 if attrs and _MAIN.search(re.sub(r"(?:^|\s)(?:class|id)=", " ", attrs)) else 3


def _weight(node: Node, template: frozenset, inside: bool) -> int:
    """Characters in the slots of a part, outside links and asides."""
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, Node):
                if c.tag != "a" and not _aside(c, inside):
                    stack.append(c)
            elif (text := _squeeze(c)) and not (template and key(f"{x.path}#{text}") in template):
                total += len(text)
    return total


def _ancestors(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def _find_main(root: Node, template: frozenset) -> tuple[list[Node], bool]:
    every, stack = [], [root]
    while stack:
        x = stack.pop()
        every.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not _aside(c, False))
    taken: set[Node] = set()
    above: set[Node] = set()
    marked = [(x, r) for x in every if (r := _rank(x.tag, x.attrs)) < 3]
    for rank in range(3):
        # The outermost ones that neither lie in one taken before nor hold one; every lists parents first.
        fresh = set()
        for x, r in marked:
            if x in above or r != rank:
                continue
            up = list(_ancestors(x))
            if not any(u in taken or u in fresh for u in up):
                fresh.add(x)
        taken |= fresh
        above |= {u for x in fresh for u in _ancestors(x)}
    if taken:
        return [x for x in every if x in taken], True
    # The deepest element that still holds most of the page's slot text.
    at, total = root, _weight(root, template, False)
    while total:
        inner = [(w, c) for c in at.children if isinstance(c, Node) and c.tag not in ("p", "span", "b", "i", "em", "strong") and not _aside(c, False) and (w := _weight(c, template, False)) * 10 >= total * 8]
        if not inner:
            break
        at = max(inner, key=lambda x: x[0])[1]
    return [at], False


def _blocks(main: list[Node], sure: bool, template: frozenset) -> str:
    blocks: list[str] = []
    parts: list[str] = []
    tops = set(main)

    def flush() -> None:
        text = _squeeze("".join(parts))
        parts.clear()
        if text:
            blocks.append(text)

    todo: list = [y for x in reversed(main) for y in (None, x)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            if not template or key(f"{x[1].path}#{_squeeze(x[0])}") not in template:
                parts.append(x[0])
        elif x in tops or not _aside(x, sure):
            if x.tag == "br":
                parts.append(" ")
                continue
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            todo.extend(c if isinstance(c, Node) else (c, x) for c in reversed(x.children))
    flush()
    return "\n".join(blocks)


class Nested:
    """A host's template: the classes of its tokens, where each class is nested, and what is known of the slots.

    A slot is a class and the token of it that was last seen; (0, 0) is the page itself.
    """

    def __init__(self, classes: dict[int, int], around: dict[int, tuple[int, int]], valid: set[int], slots: dict[tuple[int, int], tuple[int, int, int, int]], most: float):
        self.size = Counter(classes.values())
        self.classes = {t: c for t, c in classes.items() if c in valid}
        self.text = frozenset(self.classes)
        # What lies in a class that isn't valid belongs to the slot around it.
        known: dict[tuple[int, int], list[int]] = {}
        for slot, stats in slots.items():
            seen = set()
            while slot[0] and slot[0] not in valid:
                seen.add(slot[0])
                slot = around.get(slot[0], (0, 0))
                slot = (0, 0) if slot[0] in seen else slot
            have = known.setdefault(slot, [0, 0, 0, 0])
            for k in range(4):
                have[k] += stats[k]
        self.main = self._main(known, most)
        self.known = set(known)

    @staticmethod
    def _main(known: dict, most: float) -> set:
        """Slots (text, of it in links, in article parts, in aside parts) that hold the article."""
        clean = {s: v for s, v in known.items() if 2 * v[3] <= v[0]}
        told = {s for s, v in clean.items() if 2 * v[2] > v[0]}
        if told:
            return told
        plain = {s: v[0] - v[1] for s, v in clean.items()}
        return {s for s, n in plain.items() if n and n >= most * sum(plain.values())}


class Walk:
    """Follows a page along classes of tokens. slot is where the walk is; instances(), what it has seen of each class."""

    def __init__(self, classes: dict[int, int], size: Counter):
        self.classes, self.size = classes, size
        self.open: list[list] = []
        self.seen: dict[int, list] = {}

    @property
    def slot(self) -> tuple[int, int]:
        return (self.open[-1][0], self.open[-1][1][-1]) if self.open else (0, 0)

    def step(self, t: int) -> bool:
        """Takes the next token; False if it isn't of the classes."""
        c = self.classes.get(t)
        if c is None:
            return False
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == c), None)
        if at is not None and t in self.open[at][1]:
            self._close(at)
            at = None
        if at is None:
            self.open.append([c, [], self.slot])
            at = len(self.open) - 1
        else:
            self._close(at + 1)
        self.open[at][1].append(t)
        if len(self.open[at][1]) == self.size[c]:
            self._close(at)
        return True

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            c, order, around = self.open.pop()
            have = self.seen.setdefault(c, [order, around, True])
            have[2] = have[2] and have[0] == order and have[1] == around and len(order) == self.size[c]

    def instances(self) -> dict[int, list]:
        """class: the order of its tokens, the slot around it, and whether all its instances are alike and whole."""
        self._close(0)
        return self.seen


def _evidence(root: Node) -> dict[Node, tuple[bool, bool]]:
    """For each element whether it lies in a part that is marked as an article, and in one that is marked as something else."""
    mains, sure = _find_main(root, frozenset())
    tops = set(mains) if sure else set()
    out, stack = {root: (root in tops, False)}, [root]
    while stack:
        x = stack.pop()
        inside, aside = out[x]
        for c in x.children:
            if isinstance(c, Node):
                mine = inside or c in tops
                out[c] = (mine, aside or (c not in tops and _aside(c, mine)))
                stack.append(c)
    return out


def _assemble(events_: Iterator[tuple[str, Node, str, bool]]) -> str:
    """Blocks of the text nodes that are taken, joined by newlines."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = _squeeze("".join(parts))
        parts.clear()
        if text:
            blocks.append(text)

    for kind, node, value, taken in events_:
        if kind == "text":
            if taken:
                parts.append(value)
        elif node.tag == "br":
            parts.append(" ")
        elif node.tag in _BLOCK:
            flush()
    flush()
    return "\n".join(blocks)


def _raw_events(root: Node) -> Iterator[tuple[str, Node, str]]:
    """As events(), but text is as it stands, also where it is white space."""
    stack: list = [(c, root) for c in reversed(root.children)]
    while stack:
        x, parent = stack.pop()
        if isinstance(x, str):
            yield "text", parent, x
        elif parent is None:
            yield "end", x, f"/{x.path}"
        else:
            yield "start", x, x.path
            stack.append((x, None))
            stack.extend((c, x) for c in reversed(x.children))


def _in_slots(root: Node, nested: Nested, hashes: Hashes) -> str:
    evidence, walk = _evidence(root), Walk(nested.classes, nested.size)

    def judged() -> Iterator[tuple[str, Node, str, bool]]:
        for kind, node, value in _raw_events(root):
            if kind != "text":
                walk.step(hashes(value))
                yield kind, node, value, False
                continue
            text = _squeeze(value)
            if text and walk.step(hashes(token(kind, node, text))):
                continue
            inside, aside = evidence[node]
            own = walk.slot in nested.main if walk.slot in nested.known else inside
            yield kind, node, value, own and not aside

    return _assemble(judged())


class Hashes(dict):
    """Tokens' hashes; those that come again, such as paths of tags, are computed once."""

    def __missing__(self, t: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[t] = key(t)
        return self[t]

    def __call__(self, t: str) -> int:
        return self[t] if len(t) < 200 else key(t)


def extract(page: str, template: frozenset | Nested = frozenset(), hashes: Hashes | None = None) -> str:
    """The main text, blocks joined by newlines; by the template's slots, or by the page's own marks where it has none."""
    root = parse(page)
    if isinstance(template, Nested):
        text = _in_slots(root, template, hashes or Hashes()) if template.main else ""
        if text:
            return text
        template = template.text
    main, sure = _find_main(root, template)
    text = _blocks(main, sure, template)
    # Copies of one page make all their text the template's.
    return _blocks(main, sure, frozenset()) if sure and template and not text else text


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, token and this page's part of the token's occurrence vector."""
    hashes = Hashes()
    for batch in batches:
        host, token_, vector = [], [], []
        for h, p in zip(batch.column(0).to_pylist(), _text.plain(batch.column(1)), strict=True):
            text = p.as_py()
            count = tokens(parse(text))
            if not count:
                continue
            host.extend([h] * len(count))
            token_.extend(map(hashes, count))
            page = np.uint64(key(text) & 0xFFFFFFFFFFFFFFFF)
            vector.append(_text.mix(np.fromiter(count.values(), dtype=np.uint64) + page).view(np.int64) >> 8)
        if host:
            yield pa.record_batch([pa.array(host, pa.string()), pa.array(token_, pa.int64()), pa.array(np.concatenate(vector))], names=["host", "token", "vector"])


def candidates(pages: DataFrame, spec: Template, scratch: Scratch) -> DataFrame:
    """(host, tokens, classes): the tokens of frequent and large classes of each host with pages enough, and of all pages, at host null."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    rows = pages.select("host", "html").mapInArrow(_vectors, "host string, token long, vector long")
    # Sums wrap nothing: 56-bit parts in decimals. Partial sums leave one row per task, host and token.
    each = rows.groupBy("host", "token").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("support"))
    each = scratch.keep(each)
    every = each.groupBy("token").agg(F.sum("vector").alias("vector"), F.sum("support").alias("support"))
    total = pages.count()
    of_host = each.join(hosts, "host").where(F.col("pages") >= spec.few).select("host", "token", "vector", "support", "pages")
    of_all = every.select(F.lit(None).cast("string").alias("host"), "token", "vector", "support", F.lit(total).cast("long").alias("pages")).where(F.col("pages") >= spec.few)
    frequent = of_host.unionByName(of_all).where(F.col("support") >= F.col("pages") * spec.share)
    classes = frequent.groupBy("host", "vector").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= spec.large)
    # A class's number is its least token; 0 is the page itself.
    classes = classes.select("host", "tokens", F.transform("tokens", lambda t: F.array_min("tokens")).alias("classes"))
    return classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.flatten(F.collect_list("classes")).alias("classes"))


_SEEN = "host string, class long, orders long, around long, gap long, n long, text long, links long, inside long, aside long"


def _nesting(general: dict[int, int]):
    """What pages say of a template's classes and slots. Class rows (n 1 for each page): orders is a hash of the order of
    tokens, 0 if the instances differ, around and gap the slot around. Slot rows (n null): class and gap, and the characters
    of text, of it in links, in article parts and in aside parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes = Hashes(), Counter(general.values())
        for batch in batches:
            found: Counter = Counter()
            slots: dict = {}
            cache: dict = {}
            for page, host, of, named in zip(_text.plain(batch.column(0)), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                root = parse(page.as_py())
                evidence = _evidence(root)
                # Pages of hosts that have no template of their own speak for the general one.
                h, (classes, size) = None, (general, sizes)
                if of.is_valid:
                    if host not in cache:
                        own = dict(zip(of.as_py(), named.as_py(), strict=True))
                        cache[host] = own, Counter(own.values())
                    h, (classes, size) = host, cache[host]
                if not classes:
                    continue
                walk, links = Walk(classes, size), 0
                for kind, node, value in events(root):
                    links += (kind == "start") - (kind == "end") if node.tag == "a" and kind != "text" else 0
                    if not walk.step(hashes(token(kind, node, value))) and kind == "text":
                        inside, aside = evidence[node]
                        have = slots.setdefault((h, *walk.slot), [0, 0, 0, 0])
                        for k, yes in enumerate((True, links > 0, inside, aside)):
                            have[k] += len(value) * yes
                for c, (order, around, alike) in walk.instances().items():
                    found[h, c, hash_of(order) if alike else 0, *around] += 1
            rows = [(h, c, o, a, g, n, None, None, None, None) for (h, c, o, a, g), n in found.items()] + [(h, c, None, None, g, None, *v) for (h, c, g), v in slots.items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(10)], names=["host", "class", "orders", "around", "gap", "n", "text", "links", "inside", "aside"])

    return run


def hash_of(order: list[int]) -> int:
    return key(",".join(map(str, order)))


def templates(pages: DataFrame, spec: Template, scratch: Scratch) -> DataFrame:
    """(host, tokens, classes, nests, slots): nests are (class, around, gap, valid), slots (class, gap, text, links, inside, aside)."""
    found = scratch.keep(candidates(pages, spec, scratch))
    general = _general(found)
    general = dict(zip(general["tokens"], general["classes"], strict=True)) if general else {}
    rows = _with_template(pages, found, ["tokens", "classes"], spec)
    seen = scratch.keep(rows.select("html", "host", "tokens", "classes").mapInArrow(_nesting(general), _SEEN).groupBy("host", "class", "orders", "around", "gap").agg(*[F.sum(c).alias(c) for c in ("n", "text", "links", "inside", "aside")]))
    # The order and the slot around that most pages have; a class is valid if that is nearly all of them.
    nests = seen.where("n is not null").groupBy("host", "class").agg(F.sum("n").alias("pages"), F.max(F.struct(F.when(F.col("orders") == 0, 0).otherwise(F.col("n")).alias("n"), "around", "gap")).alias("best"))
    nests = nests.select("host", F.struct("class", F.col("best.around").alias("around"), F.col("best.gap").alias("gap"), (F.col("best.n") >= F.col("pages") * spec.agree).alias("valid")).alias("nest")).groupBy("host").agg(F.collect_list("nest").alias("nests"))
    slots = seen.where("n is null").groupBy("host").agg(F.collect_list(F.struct("class", "gap", "text", "links", "inside", "aside")).alias("slots"))
    key_ = lambda df: df.withColumn("k", F.coalesce("host", F.lit("\0")))
    out = key_(found).join(key_(nests).drop("host"), "k", "left").join(key_(slots).drop("host"), "k", "left")
    return out.select("host", "tokens", "classes", "nests", "slots")


def _general(found: DataFrame):
    """The one row of all pages together: its tokens are those that most of all pages have."""
    rows = found.where("host is null").take(1)
    return rows[0].asDict(recursive=True) if rows else None


def _with_template(rows: DataFrame, found: DataFrame, columns: list[str], spec: Template) -> DataFrame:
    own = found.where("host is not null").select("host", *columns)
    if (own.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= spec.broadcast_rows:
        return rows.join(F.broadcast(own), "host", "left")
    salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spec.salts - 1))))
    return rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.lit(spec.salts)), F.lit(0)).cast("int")).join(salted, ["host", "salt"], "left")


def _nested(row: dict, most: float) -> Nested:
    nests, slots = row["nests"] or [], row["slots"] or []
    return Nested(dict(zip(row["tokens"], row["classes"], strict=True)), {n["class"]: (n["around"], n["gap"]) for n in nests}, {n["class"] for n in nests if n["valid"]}, {(s["class"], s["gap"]): (s["text"], s["links"], s["inside"], s["aside"]) for s in slots}, most)


def _texts(general: dict | None, spec: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, hashes = _nested(general, spec.most) if general else frozenset(), Hashes()
        cache: dict = {}
        for batch in batches:
            texts = []
            columns = [batch.column(k) for k in range(4, 8)]
            for i, (page, host) in enumerate(zip(_text.plain(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                t = every
                if columns[0][i].is_valid:
                    if host not in cache:
                        if len(cache) > 200:
                            cache.clear()
                        cache[host] = _nested({n: c[i].as_py() for n, c in zip(("tokens", "classes", "nests", "slots"), columns, strict=True)}, spec.most)
                    t = cache[host]
                texts.append(extract(page.as_py(), t, hashes))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, spec: Template = Template(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text. Pages without a url, or with one that has no host, share the
    template of all pages. Repeated rows are extracted each; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = spark or pages.sparkSession
    scratch = Scratch(spark, "html")
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    found = scratch.keep(templates(rows, spec, scratch))
    joined = _with_template(rows, found, ["tokens", "classes", "nests", "slots"], spec)
    return joined.select("page_id", "url", "html", "host", "tokens", "classes", "nests", "slots").mapInArrow(_texts(_general(found), spec), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"), Template(), spark)
