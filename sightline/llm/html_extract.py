"""Main text of web pages by wrappers: union-free regular expressions inferred from same-host pages.

A page's token stream is parsed into elements; equal neighbours (groups of up to PERIOD elements) are
folded into repeated groups. The expressions of a host's pages are then aligned one after another: what
both have is aligned further inside, what only one has becomes optional, and a text that differs
becomes a slot, while one that all pages share stays in the wrapper. Pages of a host mostly fold to the
same few expressions, so equal ones are merged where they are read, and a host with a third of all
pages still aligns few.

The wrapper says which of its parts are main text (``judged``):

* Elements that never hold it (menus, forms, scripts and the like by their tags, hidden ones) are left
  out. What class, id or role say is a hint: the wrapper may show that the element holds the page's
  heading or most of its text, and then it stays.
* Inside an article or main element everything else is main text, repeated bylines too.
* A page without one is read in the wrapper's region: from the body, step by step into the one container
  that has nearly all of the text that varies. Lists of links there are menus, and text that all the
  host's pages share is left out where it begins or ends the region.

No step recurses, so the depth of a page does not matter, and each takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .url_filter import url_parts

PERIOD = 4
#: Lists of more different children than this are no longer aligned by place: children of one signature become one.
WIDE = 256
#: A region's container has at least this share of the varying text around it; an element that holds this much is main whatever its name says.
NEARLY_ALL, MOST = 0.9, 0.5
#: Wrappers are sent to all tasks up to this many bytes; beyond, pages are joined with them by host.
MAX_BROADCAST_BYTES = 32 << 20
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CLOSES_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOT_MAIN = frozenset("nav header footer aside form script style template noscript iframe button select textarea input menu dialog svg object embed head title".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar comment comments reply replies disqus respond notice notices alert cookie cookies consent gdpr popup modal newsletter subscribe signup share "
    "sharing social related widget toolbar pagination pager login search copyright legal disclaimer contentinfo complementary".split()
)
#: Readers' comments may be longer than the article.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: A name of several parts is no hint with one of these: it says what the element has or lacks, or that it is about the text.
NO_HINT = frozenset("no not non without has have with open closed main content text body entry article post story layout".split())
#: Elements that hold the whole page or text: what their class says is no reason to leave them out.
WHOLE = frozenset("html body main article".split())
CONTAINERS = frozenset("html body div section center table tbody tr td span font".split())
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_TO_MARK = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
TEXT = "#"


# ---- pages ------------------------------------------------------------------------------------


def signature(name: str, attributes: str) -> str:
    """The tag with its names of class, id and role (digits aside), and a mark if it is hidden."""
    if not attributes:
        return name
    words, hidden = [], ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = "!"
        elif key in ("class", "id", "role"):
            words += filter(None, (re.sub(r"[^a-z_-]+", "", name).strip("_-") for name in value.split()))
    return name + "".join("." + w for w in dict.fromkeys(words)) + hidden


def tag_of(sign: str) -> str:
    return sign.partition(".")[0].rstrip("!")


def _tag_end(page: str, at: int, lone: set) -> int:
    """Where the tag ends whose attributes begin at ``at``: behind the first > outside quoted values. ``lone``: quotes that do not occur any more."""
    while True:
        at = _TO_MARK.match(page, at).end()
        if at == len(page):
            return at
        mark, at = page[at], at + 1
        if mark == ">":
            return at
        before = page[max(0, at - 33) : at - 1].rstrip()
        if before.endswith("=") and mark not in lone:
            close = page.find(mark, at)
            if close < 0:
                lone.add(mark)
            else:
                at = close + 1


def parse(page: str) -> list:
    """The page as [signature, children]; a text is a string. Open ends are closed as browsers do; stray ends are passed over."""
    root: list = ["", []]
    stack, at, lone = [root], 0, set()
    opened: dict[str, list[int]] = {}  # for each tag, the depths at which it is open

    def close(depth: int) -> None:
        for node in reversed(stack[depth:]):
            opened[tag_of(node[0])].pop()
        del stack[depth:]

    def close_own(name: str, within: tuple[str, ...]) -> None:
        own = opened.get(name)
        if own and all(not opened.get(w) or opened[w][-1] < own[-1] for w in within):
            close(own[-1])

    while token := _TAG.search(page, at):
        if token.start() > at:
            stack[-1][1].append(page[at : token.start()])
        if token[1]:
            end = page.find("-->", token.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        if token[2]:
            end = page.find(">", token.end())
            at = end + 1 if end >= 0 else len(page)
            continue
        at = _tag_end(page, token.end(), lone)
        name = re.sub(r"[^a-z0-9:_-]+", "", token[4].lower())
        if token[3]:
            if opened.get(name):
                close(opened[name][-1])
            continue
        if name in CLOSES_P:
            close_own("p", ("button", "td", "th", "table"))
        if name in CLOSES_OWN:
            for own in ("td", "th", "tr") if name == "tr" else ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,):
                close_own(own, CLOSES_OWN[name])
        ended = page.endswith("/>", 0, at)
        node = [signature(name, page[token.end() : at - 1 - ended]), []]
        stack[-1][1].append(node)
        if name in VOID or ended:
            continue
        if name in RAW:  # up to its own end tag nothing is a tag or comment
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        else:
            opened.setdefault(name, []).append(len(stack))
            stack.append(node)
    if at < len(page):
        stack[-1][1].append(page[at:])
    return root


# ---- expressions ------------------------------------------------------------------------------


class Node:
    """An element of an expression; a text has the signature TEXT, a group the empty one. A text's hash is 0 once it differs: it is a slot."""

    __slots__ = ("sign", "repeated", "optional", "children", "hash", "chars", "kind", "mass", "varied", "heading", "article", "by_sign")

    def __init__(self, sign: str, repeated: int = 0, optional: int = 0, children: list | None = None, hash_: int = 0, chars: int = 0):
        self.sign, self.repeated, self.optional, self.children, self.hash, self.chars = sign, repeated, optional, children if children is not None else [], hash_, chars


class Part:
    """A child that is being folded or aligned: its own expression is made later, of all its sources."""

    __slots__ = ("sign", "repeated", "optional", "sources", "members", "hash", "chars")

    def __init__(self, sign: str, repeated: int = 0, optional: int = 0, sources: list | None = None, members: list | None = None, hash_: int = 0, chars: int = 0):
        self.sign, self.repeated, self.optional, self.sources, self.members, self.hash, self.chars = sign, repeated, optional, sources, members, hash_, chars

    def take(self, other: Part) -> None:
        """Become one part for both."""
        self.repeated, self.optional = self.repeated | other.repeated, self.optional | other.optional
        if self.sign == TEXT:
            self.hash, self.chars = self.hash if self.hash == other.hash else 0, self.chars + other.chars
        elif self.sign:
            self.sources += other.sources
        else:
            for one, two in zip(self.members, other.members):
                one.take(two)


def _same(a: Part, b: Part) -> bool:
    return a.sign == b.sign and (a.sign != "" or [x.sign for x in a.members] == [x.sign for x in b.members])


def _parts(source) -> list[Part]:
    """The children of a page's element or of an expression's."""
    import xxhash

    out: list[Part] = []
    if isinstance(source, Node):
        for child in source.children:
            out.append(Part(child.sign, child.repeated, child.optional, [child], _parts(child) if not child.sign else None, child.hash, child.chars))
        return out
    for child in source[1]:
        if not isinstance(child, str):
            out.append(Part(child[0], sources=[child]))
        elif words := child.split():
            text = " ".join(words)
            own = Part(TEXT, hash_=(xxhash.xxh3_64_intdigest(text) >> 1) | 1, chars=len(text))
            if out and out[-1].sign == TEXT:  # a comment between them
                out[-1].hash, out[-1].chars = (out[-1].hash * 31 + own.hash) & 0x7FFFFFFFFFFFFFFF | 1, out[-1].chars + own.chars
            else:
                out.append(own)
    return out


def folded(children: list[Part]) -> list[Part]:
    """Neighbouring equal groups of elements, the shortest first, become one repeated group."""
    for size in range(1, PERIOD + 1):
        out: list[Part] = []
        for child in children:
            out.append(child)
            one, two = out[-2 * size : -size], out[-size:]
            if len(one) == size and all(_same(a, b) for a, b in zip(one, two)) and not (size == 1 and child.sign == TEXT):
                del out[-size:]
                for a, b in zip(one, two):
                    a.take(b)
                if size == 1:
                    out[-1].repeated = 1
                else:
                    out[-size:] = [Part("", 1, members=one)]
            elif size > 1 and len(out) > size and out[-size - 1].sign == "" and len(out[-size - 1].members) == size and all(_same(a, b) for a, b in zip(out[-size - 1].members, two)):
                group = out[-size - 1]
                del out[-size:]
                for a, b in zip(group.members, two):
                    a.take(b)
        children = out
    return children


def _common(one: list[Part], two: list[Part]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of two lists of children."""
    if len(one) == len(two) and all(map(_same, one, two)):
        return [(i, i) for i in range(len(one))]
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i in range(len(one) - 1, -1, -1):
        for j in range(len(two) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(one[i], two[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(one) and j < len(two):
        if _same(one[i], two[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(one: list[Part], two: list[Part]) -> list[Part]:
    """One list for two: the longest common sequence of children is required, the rest optional. What then stands side by side is folded once more."""
    out, i, j = [], 0, 0
    for a, b in [*_common(one, two), (len(one), len(two))]:
        for rest in (one[i:a], two[j:b]):
            for part in rest:
                part.optional = 1
                out.append(part)
        if a < len(one):
            one[a].take(two[b])
            out.append(one[a])
        i, j = a + 1, b + 1
    joined: list[Part] = []
    for part in out:
        if joined and part.sign and joined[-1].sign == part.sign:
            optional = joined[-1].optional & part.optional
            joined[-1].take(part)
            joined[-1].optional, joined[-1].repeated = optional, int(part.sign != TEXT)
        else:
            joined.append(part)
    return joined if len(joined) <= WIDE else _collapsed(joined)


def _collapsed(parts: list[Part]) -> list[Part]:
    """One part for each signature, wherever it stands."""
    out: dict[str, Part] = {}
    for part in parts:
        for own in part.members if not part.sign else [part]:
            own.optional = 1
            if own.sign in out:
                out[own.sign].take(own)
                out[own.sign].repeated = int(own.sign != TEXT)
            else:
                out[own.sign] = own
    return list(out.values())


def expression(*sources) -> Node:
    """One expression for pages or expressions: for each element, of all that are to become one, the folded children are aligned one after another."""
    root = Node("")
    stack: list[tuple[Node, list]] = [(root, list(sources))]

    def made(part: Part) -> Node:
        node = Node(part.sign, part.repeated, part.optional, hash_=part.hash, chars=part.chars)
        if not part.sign:
            node.children = [made(m) for m in part.members]  # groups are not nested deeper than PERIOD
        elif part.sign != TEXT:
            stack.append((node, part.sources))
        return node

    while stack:
        node, own = stack.pop()
        if len(own) == 1 and isinstance(own[0], Node):
            node.children = own[0].children
            continue
        whole: list[Part] | None = None
        for source in own:
            parts = folded(_parts(source))
            if len(parts) > WIDE:
                parts = _collapsed(parts)
            whole = parts if whole is None else aligned(whole, parts)
        node.children = [made(part) for part in whole or []]
    return root


def written(e: Node) -> str:
    """The expression as text: ``( )+`` repeated, ``( )?`` optional, ``#`` a text slot, ``"`` a text that stays."""
    out, stack = [], [e]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        marks = node.repeated or node.optional or not node.sign and node is not e
        before, after = "(" * bool(marks), (")" + "+" * node.repeated + "?" * node.optional) * bool(marks)
        if node.sign == TEXT:
            out.append(before + ('"' if node.hash else TEXT) + after)
            continue
        out.append(before + (f"<{node.sign}>" if node.sign else ""))
        stack.append(("</>" if node.sign else "") + after)
        stack += [x for c in reversed(node.children) for x in (c, " ")][:-1]
    return "".join(out)


def packed(e: Node) -> tuple[str, list[int], list[int]]:
    """The expression's shape, and of its texts, in order, hashes and lengths."""
    shape, hashes, chars, stack = [], [], [], list(reversed(e.children))
    while stack:
        node = stack.pop()
        if node is None:
            shape.append(")")
            continue
        shape.append(f"{2 * node.repeated + node.optional}{node.sign}")
        if node.sign == TEXT:
            hashes.append(node.hash)
            chars.append(node.chars)
        else:
            stack.append(None)
            stack += reversed(node.children)
    return "\x01".join(shape), hashes, chars


def unpacked(shape: str, hashes, chars) -> Node:
    root = Node("")
    stack, texts = [root], iter(zip(hashes, chars))
    for token in shape.split("\x01") if shape else []:
        if token == ")":
            stack.pop()
            continue
        flags, sign = int(token[0]), token[1:]
        node = Node(sign, flags >> 1, flags & 1)
        stack[-1].children.append(node)
        if sign == TEXT:
            node.hash, node.chars = map(int, next(texts))
        else:
            stack.append(node)
    return root


# ---- what a wrapper's parts hold --------------------------------------------------------------


def _hint(sign: str) -> int:
    """3 if a name says that the element has readers' comments, 2 if a whole name says that it is not main text, 1 if a part of a name does, else 0."""
    name, *words = sign.rstrip("!").split(".")
    if name in WHOLE:
        return 0
    split = [parts for parts in (re.split("[_-]+", w) for w in words) if NO_HINT.isdisjoint(parts)]
    if any(not COMMENTS.isdisjoint(parts) for parts in split):
        return 3
    if not NOT_MAIN_WORDS.isdisjoint(words):
        return 2
    return int(any(not NOT_MAIN_WORDS.isdisjoint(parts) for parts in split))


def _main(sign: str) -> bool:
    """An article or main element, or one with a name of which main is a part and none says otherwise."""
    name, *words = sign.rstrip("!").split(".")
    return name in ("article", "main") or any("main" in parts and NOT_MAIN_WORDS.isdisjoint(parts) for parts in (re.split("[_-]+", w) for w in words))


OUT, REST, REGION, MAIN = range(4)


def judged(wrapper: Node, pages: int) -> Node:
    """Set on every part of a host's wrapper what it holds: ``kind``, and for a text whether all pages share it."""
    order: list[tuple[Node, int, bool, bool]] = []  # part, place of its parent, whether left out by tag, whether in a link
    stack: list[tuple[Node, int, bool, bool, bool]] = [(wrapper, -1, False, False, False)]
    while stack:
        node, parent, out, link, optional = stack.pop()
        out, link, optional = out or node.sign.endswith("!") or tag_of(node.sign) in NOT_MAIN, link or tag_of(node.sign) == "a", optional or bool(node.optional)
        shared = bool(node.hash) and pages > 1 and not optional
        if node.sign == TEXT and not shared:
            node.hash = 0
        node.mass = 0 if node.sign != TEXT or out or link else node.chars
        node.varied = 0 if node.hash else node.mass
        node.heading, node.article = tag_of(node.sign) in ("h1", "main") and not out, tag_of(node.sign) == "article" and not out
        stack += [(c, len(order), out, link, optional) for c in reversed(node.children)]
        order.append((node, parent, out, link))
    for node, parent, _, _ in reversed(order):
        if parent >= 0:
            up = order[parent][0]
            up.mass, up.heading, up.article = up.mass + node.mass, up.heading or node.heading, up.article or node.article
    kinds: list[int] = []
    for node, parent, out, _ in order:
        kind = kinds[parent] if parent >= 0 else REST
        if out:
            kind = OUT
        elif kind != OUT and node.sign and node.sign != TEXT:
            hint, large = _hint(node.sign), node.mass >= MOST * wrapper.mass
            if hint and not node.heading and not (large and (hint == 1 or hint == 2 and node.article)):
                kind = OUT
            elif _main(node.sign):
                kind = MAIN
        node.kind = kind
        kinds.append(kind)
    # The region of pages without a main element.
    for node, parent, _, _ in reversed(order):
        if node.kind != REST:
            node.varied = 0
        if parent >= 0:
            order[parent][0].varied += node.varied
    region = wrapper
    while True:
        inside = [c for g in region.children for c in (g.children if not g.sign else [g])]
        largest = max(inside, key=lambda c: c.varied, default=None)
        if largest is None or not largest.varied or largest.kind != REST or largest.repeated or tag_of(largest.sign) not in CONTAINERS or largest.varied < NEARLY_ALL * region.varied:
            break
        region = largest
    stack_: list[tuple[Node, bool]] = [(region, False)]
    while stack_:
        node, menu = stack_.pop()
        menu = menu or node is not region and _is_menu(node)
        if node.kind == REST and not menu:
            node.kind = REGION
        if node.kind in (REST, REGION):
            stack_ += [(c, menu) for c in node.children]
    for node, *_ in order:
        own = [c for g in node.children for c in (g.children if not g.sign else [g])]
        node.by_sign = {}
        for c in sorted(own, key=lambda c: (-c.kind, bool(c.hash))):  # where the place is not known, rather keep a text than leave it out
            node.by_sign.setdefault(c.sign, []).append(c)
    return wrapper


def _is_menu(node: Node) -> bool:
    """A block whose text is all in links, of which there may be any number."""
    if tag_of(node.sign) in INLINE or not node.sign or node.sign == TEXT or node.mass:
        return False
    stack, repeated, links = list(node.children), bool(node.repeated), 0
    while stack:
        child = stack.pop()
        repeated |= bool(child.repeated)
        links += tag_of(child.sign) == "a"
        stack += child.children
    return links > 1 or links == 1 and repeated


# ---- reading a page along its wrapper ---------------------------------------------------------


def _placed(children: list, own: Node | None) -> list[Node | None]:
    """The wrapper's part for every child of a page's element: by signature, and by place where several have it."""
    if own is None:
        return [None] * len(children)
    found = [own.by_sign.get(TEXT if isinstance(c, str) else c[0]) for c in children]
    if all(f is None or len(f) == 1 for f in found):
        return [f[0] if f else None for f in found]
    at: dict[int, Node] = {}
    parts = [p for g in folded(_parts(["", children])) for p in (g.members if not g.sign else [g])]
    wanted = [p for g in _parts(own) for p in (g.members if not g.sign else [g])]
    nodes = [c for g in own.children for c in (g.children if not g.sign else [g])]
    if len(parts) <= WIDE:
        for i, j in _common(parts, wanted):
            if parts[i].sign != TEXT:
                at |= {id(source): nodes[j] for source in parts[i].sources}
    return [at.get(id(c)) or (f[0] if f else None) for c, f in zip(children, found)]


def blocks_of(page: list, wrapper: Node) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, kind, whether all pages share it) of the page's blocks in order, and whether it has a main element.

    White space is made one space, references are decoded, empty blocks are left out. What an inline
    element inside a block holds may be of another kind: it is then a block of its own, and the rest stays one.
    """
    blocks: list[list[tuple[str, int | None, bool]]] = [[]]
    main = False
    stack: list[tuple] = [(page, wrapper, REST)]
    while stack:
        node, own, kind = stack.pop()
        if node is None:
            blocks.append([])
        elif isinstance(node, str):
            filled = bool(node.strip())
            blocks[-1].append((html.unescape(node), (own.kind if own is not None else kind) if filled else None, own is not None and bool(own.hash)))
        else:
            name = tag_of(node[0])
            if own is not None:
                kind = own.kind
            main = main or kind == MAIN
            if name in ("br", "wbr", "img"):
                blocks[-1].append((" " if name == "br" else "", None, False))
                continue
            if name not in INLINE:
                blocks.append([])
                stack.append((None, None, kind))
            stack += reversed([(c, w, kind) for c, w in zip(node[1], _placed(node[1], own))])
    out = []
    for block in blocks:
        for kind in dict.fromkeys(k for _, k, _ in block if k is not None):
            text = " ".join("".join(piece for piece, k, _ in block if k in (kind, None)).split())
            if text:
                out.append((text, kind, all(shared for _, k, shared in block if k == kind)))
    return out, main


def main_text(page: list, wrapper: Node) -> str:
    found, main = blocks_of(page, wrapper)
    if main:
        return "\n".join(text for text, kind, _ in found if kind == MAIN)
    own = [(text, shared) for text, kind, shared in found if kind == REGION]
    varied = [i for i, (_, shared) in enumerate(own) if not shared]
    return "\n".join(text for text, _ in (own[varied[0] : varied[-1] + 1] if varied else own))


# ---- tables -----------------------------------------------------------------------------------

_SCHEMA = "host string, shape string, hashes array<bigint>, chars array<bigint>, pages long"


def _expressions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch, one row for each host and shape."""
    for frame in frames:
        seen: dict[tuple[str, str], list] = {}
        for host, page in zip(frame["host"], frame["html"]):
            shape, hashes, chars = packed(expression(parse(page or "")))
            _add(seen, (host, shape), hashes, chars, 1)
        yield pd.DataFrame([(*key, *own) for key, own in seen.items()], columns=["host", "shape", "hashes", "chars", "pages"])


def _add(seen: dict, key, hashes, chars, pages: int) -> None:
    if key in seen:
        own = seen[key]
        own[0] = [a if a == b else 0 for a, b in zip(own[0], hashes)]
        own[1] = [a + b for a, b in zip(own[1], chars)]
        own[2] += pages
    else:
        seen[key] = [list(hashes), list(chars), pages]


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One expression for all of a group, the commonest shape first."""
    seen: dict[str, list] = {}
    for _, shape, hashes, chars, pages in frame[["host", "shape", "hashes", "chars", "pages"]].itertuples(index=False):
        _add(seen, shape, hashes, chars, int(pages))
    whole = None
    for shape, (hashes, chars, _) in sorted(seen.items(), key=lambda s: (-s[1][2], s[0])):
        e = unpacked(shape, hashes, chars)
        whole = e if whole is None else expression(whole, e)
    return pd.DataFrame([(frame["host"].iloc[0], *packed(whole), sum(own[2] for own in seen.values()))], columns=["host", "shape", "hashes", "chars", "pages"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, shape, hashes, chars, pages. ``pages``: host, html."""
    found = pages.mapInPandas(_expressions, _SCHEMA)
    parts = found.groupBy("host", F.pmod(F.hash("shape"), F.lit(SALTS)).alias("salt")).applyInPandas(_merged, _SCHEMA)
    return parts.groupBy("host").applyInPandas(_merged, _SCHEMA)


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[str, Node]] = {}  # of the hosts met last
    for frame in frames:
        out = []
        for page, host, shape, hashes, chars, number in frame[["html", "host", "shape", "hashes", "chars", "pages"]].itertuples(index=False):
            if host not in known:
                if len(known) >= 1000:
                    known.clear()
                known[host] = judged(unpacked(shape, hashes, chars), number)
            out.append(main_text(parse(page or ""), known[host]))
        yield frame[["page_id", "url"]].assign(text=out, n_chars=[len(t) for t in out])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Null and empty html give an empty text; a null url belongs to the host of no name; repeated pages
    are read alike; an empty table gives an empty result. Other columns are ignored. The whole page is
    read, however long or deep. Of a host with one page nothing is known to be shared.
    """
    space = Workspace(pages.sparkSession, "wrappers")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), url_parts(F.col("url").cast("string"))[0].alias("host"))
    wrappers = space.table(infer_wrappers(rows.select("host", "html")), "inferred")
    size = wrappers.agg(F.sum(F.octet_length("shape") + 16 * F.size("hashes"))).head()[0] or 0
    found = rows.join(F.broadcast(wrappers) if size <= MAX_BROADCAST_BYTES else wrappers, "host")
    return found.mapInPandas(_extracted, f"page_id {_kind(rows)}, url string, text string, n_chars long")


def _kind(rows: DataFrame) -> str:
    return rows.schema["page_id"].dataType.simpleString()
