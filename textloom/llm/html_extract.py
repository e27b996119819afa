"""Main text of web pages, with wrappers inferred for each host as union-free regular expressions.

A page becomes a tree of block tags (inline tags join the text of their block) with a text slot where a block has text.
Its skeleton is that tree with equal siblings folded into a repeated group. A host's wrapper starts from one
skeleton and is aligned with the next: children that match are merged, those that one side lacks become optional, those
that recur become repeated, text becomes a slot. There is no choice operator, so the wrapper stays union-free. Every group
carries sums over all pages that it stands for: pages, characters, characters in links, blocks, and the least and the greatest hash of
its text. They tell its role on the host:

* template: a group with one text on ``LEAST_PAGES`` pages or more, or a text that every page with its path has. Left out, as long as
  at least ``VARIED`` of a page's text is not template (else its host has copies, and template cannot be told from content);
* navigation: a group of short blocks that are mostly links, where it stands apart. Left out; beside running text that varies (a list of references) it is content;
* content: a group whose text varies. Kept.

Tags and names are the prior. Tags that say what the contract leaves out (nav, footer, form and so on) are left out without
a vote; so are groups whose name says so and nothing else (``ad-slot``, ``comments``). A name that has such a word among others
(``ad-hoc``, ``newsletter-history``, in an article ``comments-on-policy``) is outweighed by running text that varies; one that only hints (``related-work``) needs a role that agrees. ``article`` and ``main`` are taken as content whole; of the two the one that
holds the host's running text, by the wrapper's sums, is the page's text.

A page is matched with its host's wrapper by walking the expression: each child takes the first place at or after the
place of the one before that accepts it. A child without a place is judged by its tag and name alone.

All pages take part. A task merges the skeletons it meets host by host; the partial wrappers are then merged in rounds of
about ``FAN_IN``, so a host with a third of all pages asks no task to hold more than that many. Sums, least and greatest
do not depend on the order of merging. Groups of one parent beyond ``WIDTH`` names are told apart by tag only; the wrapper ends ``DEPTH`` levels below the root,
and what lies deeper is judged by its tag and name and by the role of what it stands in.

Defined results: a null html is an empty page with empty text; a page that has no content region gives the body less
what is left out; broken markup is closed as browsers do it for blocks; a null url is a host of its own; repeated rows
are worked out one by one; an empty table gives no rows; elements may be nested to any depth.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import scratch_table, texts_of

#: Tags by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img "
    "math mi mo mn mrow ms msup msub msubsup mfrac msqrt mroot mtext mspace mover munder munderover semantics".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button select dialog head menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words that say what a group is wherever they stand in its name; words that say it only if the name has no others.
TELLING_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter nav navbar breadcrumb breadcrumbs pagination sidebar comments commentlist disqus".split())
HINTING_WORDS = frozenset(
    "promo promotion banner notice notices alert popup modal overlay subscribe subscription signup login navigation menu pager side widget footer header masthead topbar toolbar share sharing social "
    "related recommended comment reply replies respond discussion skip hidden aside bar box list slot item area container section wrapper".split()
)
#: Of these no name is made alone.
_NEUTRAL = frozenset("bar box list slot item area container section wrapper".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that stand beside these in names of reader comments.
COMMENT_COMPANIONS = frozenset("user users reader readers visitor guest post article blog entry page body text content author meta thread section count form wrap inner holder area block tree title".split())
FRAMES = frozenset("root html body main".split())
CONTENT_TAGS = frozenset(("article", "main"))
RUNNING_TAGS = frozenset("# p blockquote pre dd".split())
UNNAMED = frozenset("div section ul ol".split())
#: Share of links and characters of a block from which, and below which, a group is navigation; share of a host's text that has to vary.
LINKED, SHORT_BLOCK, VARIED = 0.6, 80, 0.1
LEAST_PAGES = 3
WIDTH, DEPTH, FAN_IN = 64, 48, 32
#: Hosts that a task holds wrappers of at once.
HOSTS_HELD = 256

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_WORDS = re.compile(r"[a-z]+")
_NUMBERS = re.compile(r"[0-9]{2,}")
_DENIED = re.compile(r"(?:has|with|no|without|not)[-_]", re.I)


class Node:
    """A block element, or a text slot (tag '#'): its name, what its tag and name say of it, children, text and its
    characters in links."""

    __slots__ = ("children", "links", "name", "prior", "tag", "text")

    def __init__(self, tag: str, name: str = "", prior: str = "", text: str = "", links: int = 0) -> None:
        self.tag, self.name, self.prior, self.text, self.links = tag, name, prior, text, links
        self.children: list[Node] = []

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag


@lru_cache(maxsize=1 << 14)
def _named(tag: str, attributes: str) -> tuple[str, str]:
    """Name (first class or id, numbers of several digits taken for equal) and prior of an element: 'out' by tag or role, 'telling' by its name, 'talk' by the
    name of reader comments, 'maybe' and 'maybe talk' if the name has other words too, 'hint', 'heads' (a header, which belongs to an article if it stands in one), 'region' or ''."""
    name, found, roles = "", set(), set()
    for attribute, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        for token in value.strip("\"'").split():
            if attribute.lower() == "role":
                roles.add(token.lower())
                continue
            name = name or _NUMBERS.sub("0", token[:40])
            words = _WORDS.findall(_CAMEL.sub(r"\1 \2", token).lower())
            if _DENIED.match(token) or not words:
                continue
            known = [w for w in words if w in TELLING_WORDS or w in HINTING_WORDS]
            if set(known) <= _NEUTRAL:
                continue
            if len(known) == len(words):
                found.add("heads" if set(known) <= {"header", "masthead"} | _NEUTRAL else "talk" if set(known) & COMMENT_WORDS else "telling")
            elif set(words) & TELLING_WORDS and tag not in CONTENT_TAGS:
                talk = set(words) & COMMENT_WORDS
                found.add(("talk" if set(words) - set(known) <= COMMENT_COMPANIONS else "maybe talk") if talk else "maybe")
            else:
                found.add("hint")
    if tag in BOILERPLATE_TAGS or roles & BOILERPLATE_ROLES - {"banner"}:
        return name, "out"
    if tag in FRAMES:
        return name, "region" if tag == "main" else ""
    for kind in ("talk", "telling", "maybe talk", "maybe"):
        if kind in found:
            return name, kind
    if tag in CONTENT_TAGS or roles & {"main", "article"}:
        return name, "region"
    if tag == "header" or "banner" in roles or "heads" in found:
        return name, "heads"
    return name, "hint" if "hint" in found else ""


_ENDS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_CLOSED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def parse(page: str | None) -> Node:
    """The tree of a page."""
    root, page = Node("root"), page or ""
    stack, held, at = [root], [], 0
    made: list[Node] = []
    opened: Counter[str] = Counter()
    link = 0  # depth at which a link was opened, 0 if none is

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(x[0] for x in held))).strip()
            links = sum(len(x[0]) for x in held if x[1])
            held.clear()
            if text:
                stack[-1].children.append(Node("#", text=text, links=min(links, len(text))))

    def cut(n: int) -> None:
        nonlocal link
        for x in stack[n:]:
            opened[x.tag] -= 1
        del stack[n:]
        if link > n:
            link = 0

    def innermost(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> int:
        """Place of the innermost open element of these tags; 0 if there is none before one of stops."""
        if not any(opened[t] for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stops:
                return 0
        return 0

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            held.append((page[at:], link > 0))
            break
        if m.start() > at:
            held.append((page[at : m.start()], link > 0))
        at = max(m.end(), m.start() + 1)
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name == "a":
                link = 0
            elif name not in INLINE and name not in VOID and (k := innermost((name,))):
                flush()
                cut(k)
            continue
        if name in INLINE:
            if name == "a":
                link = len(stack)
            elif name == "br":
                held.append((" ", False))
            continue
        if name in RAW and not m.group(3).endswith("/"):
            at = max(at, re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, at).end())
            continue
        flush()
        if name in CLOSES_P and (k := innermost(("p",))):
            cut(k)
        while name in _CLOSED_BY and (k := innermost(_CLOSED_BY[name], _ENDS[name])):
            cut(k)
        if name in VOID or m.group(3).endswith("/"):
            continue
        node = Node(name, *_named(name, m.group(3)))
        stack[-1].children.append(node)
        stack.append(node)
        made.append(node)
        opened[name] += 1
    flush()
    # Groups without a name are told apart by what they hold: mostly links, blocks, or a text.
    length: dict[int, int] = {}
    for node in reversed(made):
        chars = sum(len(c.text) if c.tag == "#" else length[id(c)] for c in node.children)
        length[id(node)] = chars
        node.links = sum(c.links for c in node.children)
        if not node.name and node.tag in UNNAMED:
            node.name = "~links" if node.links * 2 > chars else "~blocks" if any(c.tag != "#" for c in node.children) else "~text"
    return root


# ---- wrappers: [key, mark, children, sums], mark one of '1' once, '?' optional, '+' repeated, '*' both

#: Places of the sums of a group; of the last four the first two are least and greatest hash of its text, the others of its pages.
PAGES, CHARS, LINKS, BLOCKS, LO, HI, PAGE_LO, PAGE_HI = range(8)
_HASH_BITS = (1 << 40) - 1


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def skeleton(root: Node, page: int = 0) -> list:
    """The page's own wrapper: equal siblings folded, with sums; page is the page's hash."""
    page &= _HASH_BITS
    done: list[list] = []  # finished children of the nodes that are open
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    texts: list[list[str]] = []
    while todo:
        node, depth, leaving = todo.pop()
        if node.tag == "#":
            h = hashed(node.text) & _HASH_BITS
            texts[-1].append(node.text)
            done[-1].append(["#", "1", [], [1, len(node.text), node.links, 1, h, h, page, page]])
            continue
        if not leaving:
            todo.append((node, depth, True))
            todo.extend((c, depth + 1, False) for c in reversed(node.children))
            done.append([])
            texts.append([])
            continue
        children, own = done.pop(), texts.pop()
        h = hashed("\n".join(own)) & _HASH_BITS
        sums = [1, *(sum(c[3][k] for c in children) for k in (CHARS, LINKS, BLOCKS)), h, h, page, page]
        made = [node.key, "1", folded(children) if depth < DEPTH else [], sums]
        if not done:
            return made
        done[-1].append(made)
        # A long text stands in what holds it by its hash.
        texts[-1].append(f"{h:x}" if own else "")
    raise AssertionError


def _summed(a: list[int], b: list[int]) -> list[int]:
    """Sums of two groups; what comes from one page (or from equal ones) counts as one page."""
    same = a[PAGE_LO] == a[PAGE_HI] == b[PAGE_LO] == b[PAGE_HI]
    pages = max(a[PAGES], b[PAGES]) if same else a[PAGES] + b[PAGES]
    return [pages, *(a[k] + b[k] for k in (CHARS, LINKS, BLOCKS)), min(a[LO], b[LO]), max(a[HI], b[HI]), min(a[PAGE_LO], b[PAGE_LO]), max(a[PAGE_HI], b[PAGE_HI])]


def folded(children: list[list]) -> list[list]:
    """Siblings of equal key become one repeated group, at the place of the first; so a list of children is as long as its
    distinct keys, however long the page. Beyond WIDTH keys, names are dropped."""
    out: dict[str, list] = {}
    for c in children:
        if (was := out.get(c[0])) is None:
            out[c[0]] = c
        else:
            out[c[0]] = [c[0], "*" if set(was[1] + c[1]) & set("?*") else "+", aligned(was[2], c[2]), _summed(was[3], c[3])]
    if len(out) > WIDTH and any("." in k for k in out):
        return folded([[k.partition(".")[0], *c[1:]] for k, c in out.items()])
    return list(out.values())


def merged(a: list, b: list) -> list:
    """The wrapper of two wrappers of equal key, from different pages."""
    mark = ("*" if set(a[1] + b[1]) & set("?*") else "+") if set(a[1] + b[1]) & set("+*") else ("?" if "?" in a[1] + b[1] else "1")
    return [a[0], mark, aligned(a[2], b[2]), _summed(a[3], b[3])]


def _optional(x: list) -> list:
    return [x[0], {"1": "?", "+": "*"}.get(x[1], x[1]), *x[2:]]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Children by a longest common subsequence of their keys; what one side lacks becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list[list] = []
    place: dict[str, int] = {}

    def put(x: list) -> None:
        """A key that both sides have in another order stands where it was met first, repeated."""
        if x[0] in place:
            was = out[place[x[0]]]
            out[place[x[0]]] = [x[0], "*", aligned(was[2], x[2]), _summed(was[3], x[3])]
        else:
            place[x[0]] = len(out)
            out.append(x)

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            put(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            put(_optional(a[i]))
            i += 1
        else:
            put(_optional(b[j]))
            j += 1
    return folded(out) if len(out) > WIDTH else out


class Places:
    """The places of an expression; ``take`` gives the place of the next child, or None."""

    def __init__(self, wrapper: list | None) -> None:
        self.items = wrapper[2] if wrapper else []
        self.order = {c[0]: k for k, c in enumerate(self.items)}
        self.at = 0

    def take(self, child: Node) -> list | None:
        k = self.order.get(child.key)
        if k is None:
            k = self.order.get(child.tag)
        if k is None or (k < self.at and self.items[k][1] not in "+*"):
            return None
        self.at = max(self.at, k)
        return self.items[k]


# ---- roles


def navigation(sums: list[int] | None) -> bool:
    return bool(sums) and sums[BLOCKS] > sums[PAGES] and sums[LINKS] >= LINKED * sums[CHARS] and sums[CHARS] < SHORT_BLOCK * sums[BLOCKS]


def template(sums: list[int] | None) -> bool:
    return bool(sums) and sums[PAGES] >= LEAST_PAGES and sums[LO] == sums[HI] and sums[PAGE_LO] != sums[PAGE_HI]


def running(sums: list[int] | None, least: int) -> bool:
    """Blocks of that many characters on average, less than half of them in links, of no template."""
    return bool(sums) and sums[CHARS] >= least * sums[BLOCKS] and sums[LINKS] * 2 < sums[CHARS] and not template(sums)


def with_prose(wrapper: list | None) -> bool:
    """Whether running text stands in a group itself, not further down."""
    return bool(wrapper) and any(c[0].partition(".")[0] in RUNNING_TAGS and running(c[3], SHORT_BLOCK) for c in wrapper[2])


def left_out(node: Node, sums: list[int] | None, inside: bool, holds_region: bool, constants: bool, beside: bool = False) -> bool:
    """Whether a group is left out: what its tag and name say, and its role on the host; beside: it stands beside running text."""
    if node.prior == "out" or node.prior == "talk" or node.prior == "maybe talk" and not inside:
        return True
    if node.prior == "telling":
        return not holds_region
    if node.prior in ("maybe", "maybe talk"):
        return not holds_region and not running(sums, SHORT_BLOCK // 2)
    if node.prior == "heads":
        return not inside and not holds_region
    if node.tag in FRAMES or node.prior == "region" or holds_region:
        return False
    role = (navigation(sums) and not (beside and not node.prior)) or (constants and template(sums))
    if node.prior == "hint":
        return role or bool(sums) and sums[CHARS] < SHORT_BLOCK * sums[BLOCKS] and sums[LINKS] * 2 >= sums[CHARS]
    return role and not inside


def holding(root: Node) -> set[int]:
    """Nodes that have a content region below them, regions in what tags and names leave out aside."""
    out: set[int] = set()
    up: dict[int, Node | None] = {id(root): None}
    nodes = [root]
    for node in nodes:
        for c in node.children:
            if c.tag != "#" and c.prior not in ("out", "talk", "maybe talk"):
                up[id(c)] = node
                nodes.append(c)
                if c.prior == "region":
                    x: Node | None = node
                    while x is not None and id(x) not in out:
                        out.add(id(x))
                        x = up[id(x)]
    return out


def _running(wrapper: list, article: bool = False) -> tuple[int, int]:
    """Characters outside links of a wrapper's (articles, main parts outside articles), what tags leave out aside."""
    here, rest = 0, 0
    todo = [(wrapper, article, False)]
    while todo:
        w, article, main = todo.pop()
        tag = w[0].partition(".")[0]
        if tag in BOILERPLATE_TAGS:
            continue
        if tag == "#":
            free = w[3][CHARS] - w[3][LINKS]
            if article:
                here += free
            elif main:
                rest += free
        article, main = article or tag == "article", main or tag == "main"
        todo.extend((c, article, main) for c in w[2])
    return here, rest


def blocks(root: Node, wrapper: list | None, fixed: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the slots that the wrapper leaves, in page order: those in articles, or else in the main part, or else
    all. fixed has hashes of path and text that every page of the host has. Without a wrapper the page is its own. Where template would
    leave less than VARIED of the page, the page is taken for a copy and template is kept."""
    if wrapper is None:
        return _left(root, skeleton(root), frozenset(), False)
    found = _left(root, wrapper, fixed, True)
    every = _left(root, wrapper, frozenset(), False)
    return found if sum(map(len, found)) >= VARIED * sum(map(len, every)) else every


def _left(root: Node, wrapper: list, fixed: frozenset[int], constants: bool) -> list[str]:
    articles, rest = _running(wrapper)
    regions = holding(root)
    out: list[tuple[bool, bool, str]] = []
    todo: list[tuple[Node, list | None, int, bool, bool, bool]] = [(root, wrapper, 0, False, False, False)]
    while todo:
        node, w, path, article, main, beside = todo.pop()
        if node.tag == "#":
            if article or main or not fixed or _slot(path, node.text) not in fixed:
                out.append((article, main, node.text))
            continue
        if left_out(node, w[3] if w else None, article or main, id(node) in regions, constants, beside):
            continue
        if node.prior == "region":
            is_main = node.tag == "main" or node.tag != "article" and not article
            main, article = main or is_main, article or not is_main
        places, beside = Places(w), beside or node.tag not in FRAMES and with_prose(w)
        below = [(c, places.take(c) if w else None, _step(path, c), article, main, beside) for c in node.children]
        todo.extend(reversed(below))
    if any(x[0] for x in out) and not (rest > articles and any(x[1] for x in out)):
        return [x[2] for x in out if x[0]]
    return [x[2] for x in out if x[1] or x[0]] if any(x[1] for x in out) else [x[2] for x in out]


def _step(path: int, node: Node) -> int:
    return xxhash.xxh3_64_intdigest(f"{path:x}/{node.tag}.{node.prior}")


def _slot(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path:x}={text}") >> 1


def slots(root: Node) -> list[tuple[int, int]]:
    """(path, path and text), hashed, of each text outside content regions and what tags and names leave out, once each."""
    out: set[tuple[int, int]] = set()
    todo = [(root, 0)]
    while todo:
        node, path = todo.pop()
        if node.tag == "#":
            out.add((path >> 1, _slot(path, node.text)))
        elif node.prior in ("", "hint") or node.tag in ("root", "html", "body"):
            todo.extend((c, _step(path, c)) for c in node.children)
    return sorted(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _merged_forms(forms: list[str]) -> str:
    ordered = sorted(map(json.loads, forms), key=lambda f: (len(str(f)), str(f)))
    w = ordered[0]
    for f in ordered[1:]:
        w = merged(w, f)
    return json.dumps(w, separators=(",", ":"))


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper as JSON, fixed array<bigint>: path and text, hashed, of the texts that every page with the path has), written to the shared folder."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        schema = pa.schema([("host", pa.string()), ("form", pa.string()), ("path", pa.int64()), ("slot", pa.int64()), ("page", pa.int64())])

        def forms() -> pa.RecordBatch:
            hosts = sorted(held)
            none = pa.nulls(len(hosts), pa.int64())
            made = pa.array([json.dumps(held[h], separators=(",", ":")) for h in hosts], pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), made, none, none, none], schema=schema)

        for batch in batches:
            rows: list[tuple[str, int, int, int]] = []
            for host, page in zip(batch.column("host").to_pylist(), texts_of(batch, "html"), strict=True):
                tree, number = parse(page), hashed(page or "")
                form = skeleton(tree, number)
                held[host] = merged(held[host], form) if host in held else form
                rows += [(host, path, slot, number) for path, slot in slots(tree)]
                if len(held) > HOSTS_HELD:
                    yield forms()
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([columns[0], pa.nulls(len(rows), pa.string()), *columns[1:]], schema=schema)
        if held:
            yield forms()

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = scratch_table(rows.transform(shipped).mapInArrow(seen, "host string, form string, path bigint, slot bigint, page bigint"), "page-forms")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([_merged_forms(f) for f in batch.column("forms").to_pylist()], pa.string())], ["host", "form"])

    partial = rows.where("form is not null").select("host", "form")
    while True:
        counts = partial.groupBy("host").agg(F.count("*").alias("n"))
        if (counts.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            break
        dealt = partial.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("form"), F.ceil(F.col("n") / fan_in)))
        partial = scratch_table(dealt.groupBy("host", "part").agg(F.collect_list("form").alias("forms")).select("host", "forms").transform(shipped).mapInArrow(joined, "host string, form string"), "merged-forms")
    texts = rows.where("form is null").select("host", "path", "slot", "page").distinct()
    per_slot = texts.groupBy("host", "path", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    per_path = texts.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("pages"))
    same = per_slot.join(per_path, ["host", "path"]).where("n = pages").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("fixed"))
    return scratch_table(partial.join(same, "host", "left").select("host", F.col("form").alias("wrapper"), F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed")), "wrappers")


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars of every page."""
    rows = pages.select(*keep, host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    known = wrappers(pages, url_col=url_col, html_col=html_col)
    rows = rows.join(known.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"), F.col("fixed").alias("_fixed")), "_host", "left")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[list | None, frozenset[int]]] = {}
        for batch in batches:
            texts = []
            for k, (host, page) in enumerate(zip(batch.column("_host").to_pylist(), texts_of(batch, "_html"), strict=True)):
                if host not in memory:
                    if len(memory) >= HOSTS_HELD:
                        memory.clear()
                    told = batch.column("_wrapper")[k].as_py()
                    memory[host] = (None if told is None else json.loads(told), frozenset(batch.column("_fixed")[k].as_py() or ()))
                texts.append("\n".join(blocks(parse(page), *memory[host])))
            names = [n for n in batch.schema.names if n[0] != "_"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name[0] != "_")
    out = rows.transform(shipped).mapInArrow(extracted, f"{told}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
