"""Main text of web pages by tree scoring.

The page is parsed into a tree (forgiving: open paragraphs, stray ends and cut-off pages are fine). What is never
main text goes: scripts, styles, forms, menus, page headers, footers, sidebars, notices, adverts and reader comments,
known by tag, role, hidden state, or the words of the class and id of blocks; words within a line stay. Each paragraph left passes points for its length
and its commas to its ancestors, less with each level; a container's points are discounted by its link
density. The best container is kept, with those of its siblings that score well or read like text, and the
headings before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select option textarea iframe svg math object applet canvas audio video dialog menu head title".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "title", "legend"}
#: A tag closes the open one of these that its own kind may not lie in, up to the nearest stop.
SIBLINGS = {"li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})), "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "option": (frozenset({"option"}), frozenset({"select"}))}
SCOPE = frozenset("article body div section main td th li table blockquote header footer aside nav form html dd figure".split())
BAD = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent dialog disclaimer disqus footer foot gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription taboola toolbar topbar tracking widget widgets".split())
#: Of the words above those that hold beside any other.
SURE = frozenset("comment comments sidebar footer ad ads".split())
#: Words of places and boxes.
BOXES = frozenset("area bar block bottom box button card center column container global group holder inner item items js left level link links list message mobile outer page panel primary reader row right secondary section site slot sticky top unit user view wrap wrapper zone".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var".split())
INLINE_STOPS = frozenset({"article", "body", "main", "table"})
GOOD = frozenset("article body content entry main post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "points", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.points = tag, attrs, parent, [], 0.0


class _Builder(HTMLParser):
    """Builds the tree. ``depths`` has the places of the open nodes of each tag, so that an end tag costs no walk over open nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.open, self.depths = [self.root], {}

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close((tag,), INLINE_STOPS - {tag} if tag not in BLOCKS else frozenset())

    def _close(self, tags, stops):
        """Closes the innermost open node of some tags, with all that is open in it, unless one of the stops is open in it."""
        innermost = lambda names: max((d[-1] for t in names if (d := self.depths.get(t))), default=0)
        at = innermost(tags)
        if at and at >= innermost(stops):
            for node in self.open[at:]:
                self.depths[node.tag].pop()
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def marked(names: str) -> bool:
    """Whether a class or an id says that an element isn't main text.

    One of its words must name such a part and the others no more than a place or a box: ``cookie-notice`` or ``ad-slot`` do, ``notice-board``
    or ``share-price`` don't.
    """
    for name in names.split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if len(w) > 1}
        if words & BAD and words <= BAD | GOOD | BOXES and (not words & GOOD or words & SURE):
            return True
    return False


def dropped(node: Node, in_article: bool) -> bool:
    """Whether a node is never main text. Forms that hold the text of the page are seen to by ``prune``."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "#root"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    marks = attrs.get("class", "") + " " + attrs.get("id", "")
    if tag in ("article", "main"):
        return bool(marks.strip()) and bool({"comment", "comments"} & set(re.split(r"[^a-z]+", marks.lower())))
    # Words within a line are text, whatever they are called.
    return tag not in INLINE and bool(marks.strip()) and marked(marks)


def holds_text(root: Node) -> set[int]:
    """The forms that hold an article, or paragraphs of 250 letters and more: wrappers of a page, which its text must not go with."""
    out: set[int] = set()
    forms: list[list] = []
    paragraphs = 0
    for kind, x in walk(root):
        if kind == "text":
            if forms and paragraphs:
                forms[-1][1] += len(x)
        elif x.tag == "p":
            paragraphs += 1 if kind == "in" else -1
        elif x.tag in ("article", "main") and kind == "in" and forms:
            forms[-1][2] = True
        elif x.tag == "form":
            if kind == "in":
                forms.append([x, 0, False])
            else:
                form, letters, whole = forms.pop()
                if letters >= 250 or whole:
                    out.add(id(form))
                if forms:
                    forms[-1][1] += letters
                    forms[-1][2] |= whole
    return out


def walk(node: Node) -> Iterator[tuple[str, Node | str]]:
    """("in", node), ("text", str) and ("out", node) in page order, without recursion."""
    yield "in", node
    stack = [(node, iter(node.children))]
    while stack:
        top, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                yield "text", child
            else:
                yield "in", child
                stack.append((child, iter(child.children)))
                break
        else:
            yield "out", top
            stack.pop()


def prune(root: Node) -> None:
    kept = holds_text(root)
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = in_article or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or id(c) in kept or not dropped(c, in_article)]
        stack += [(c, in_article) for c in node.children if not isinstance(c, str)]


def measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """Per node: letters of its text, of its links, and commas; each from its children, in one walk."""
    sums: dict[int, list[int]] = {}
    open_: list[list[int]] = []
    links = 0
    for kind, x in walk(root):
        if kind == "in":
            open_.append([0, 0, 0])
            links += x.tag == "a"
        elif kind == "text":
            n = len(" ".join(x.split()))
            own = open_[-1]
            own[0] += n
            own[1] += n if links else 0
            own[2] += x.count(",") + x.count("，") + x.count("、")
        else:
            links -= x.tag == "a"
            own = open_.pop()
            sums[id(x)] = tuple(own)
            if open_:
                for k in range(3):
                    open_[-1][k] += own[k]
    return sums


def best_container(root: Node, sums: dict[int, tuple[int, int, int]]) -> Node | None:
    scored: dict[int, Node] = {}
    for kind, node in walk(root):
        if kind != "in" or node.tag == "#root":
            continue
        letters, linked, commas = sums[id(node)]
        bears = node.tag in ("p", "pre", "blockquote", "td", "dd", "figcaption", "li") or (node.tag in ("div", "section", "article", "main") and any(isinstance(c, str) and c.strip() for c in node.children))
        if not bears or not letters:
            continue
        points = (1 + commas + min(letters / 100, 3)) * (1 - linked / letters)
        level, up = 0, node.parent if node.tag not in ("div", "section", "article", "main") else node
        while up is not None and up.tag not in ("#root", "html") and level < 5:
            up.points += points / (1, 2, 6, 9, 12)[level]
            scored[id(up)] = up
            level, up = level + 1, up.parent
    best, most = None, 0.0
    for node in scored.values():
        letters, linked, _ = sums[id(node)]
        value = node.points * (1 - linked / max(1, letters)) * (1.5 if node.tag in ("article", "main") else 1.0)
        if value > most:
            best, most = node, value
    # A part of an article is less than the article.
    for whole in ("article", "main"):
        up = best
        while up is not None:
            if up.tag == whole:
                return up
            up = up.parent
    return best


def chosen(best: Node, sums: dict[int, tuple[int, int, int]]) -> list[Node | str]:
    """The best container, with siblings that score a fifth as much or read like text, and headings before it."""
    if best.parent is None:
        return [best]
    out, before = [], True
    for child in best.parent.children:
        if child is best:
            out.append(child)
            before = False
        elif isinstance(child, Node):
            letters, linked, _ = sums[id(child)]
            density = linked / max(1, letters)
            heading = before and child.tag in ("h1", "h2", "hgroup") and best.tag not in ("article", "main", "body")
            same = child.tag in ("article", "section", "div", "main") and child.points * (1 - density) >= max(5.0, 0.2 * best.points)
            text = child.tag in ("p", "pre", "blockquote") and letters > 80 and density < 0.25 and best.tag != "article"
            if heading or same or text:
                out.append(child)
    return out


def main_text(html: str | None) -> str:
    """The blocks of the main part, white space within each turned into one space, joined by one space; empty if none.

    White space is what Unicode calls so, no-break spaces included. Null and blank pages have no text.
    """
    if not html or not html.strip():
        return ""
    root = parse(html)
    prune(root)
    sums = measure(root)
    best = best_container(root, sums)
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        if block := " ".join("".join(now).split()):
            blocks.append(block)
        now.clear()

    for part in chosen(best, sums) if best is not None else [root]:
        for kind, x in walk(part):
            if kind == "text":
                now.append(x)
            elif x.tag in BLOCKS:
                end()
        end()
    return " ".join(blocks)
