"""Main text of web pages by tree scoring.

A page is read into a tree in one pass (forgiving unclosed and stray tags).  Parts
that cannot be main text go first: by tag (menus, footers, sidebars, forms,
scripts, styles ...; headers outside of articles) or by the words of class and id
(adverts, notices, comments, shares ...), unless the page's article is in them; where
the words may mean something else, links, length and shape vote too (``unlikely``).
Each paragraph then passes points to its ancestors: one, one for each comma, up to
three for its length, halved at the grandparent and further divided above.  A
container's points are discounted by its link density; the best one is kept.  Around it, up to the enclosing article or main part or else
the whole page, everything goes that is mostly links; the other blocks are the
text.  Beside an article or main part stay others, plain paragraphs and what
scores nearly as well.  A page on which nothing scores gives all its blocks that
are not mostly links.

Defined results: a null or empty html, or one without main text, gives the empty
text; equal rows give equal rows; a null id is kept; very long pages count whole;
score ties fall to the outer, then earlier container; an empty table gives an
empty table.  Other columns are not read, whatever their names.  A page is read in
time in proportion to its length, long names and attributes included.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, tune

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag; quoted values may hold a ">".
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9A-Fa-f]{8,})")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Their content is no markup; it goes with the tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("script style noscript template head title nav footer aside form button select option textarea input label iframe svg canvas object embed audio video dialog menu map fieldset xmp noembed noframes".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre address hr center details summary".split())
#: An open one of these ends where one of the set begins.
_PARAGRAPH_ENDS = BLOCK | frozenset("form fieldset nav header footer aside figure menu".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = frozenset("ul ol dl table div section article main body html".split())

#: Words of a class or id (cut at signs and capitals) that name a part of one of the
#: kinds that are no main text.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: These may also be no more than a box around the text.
BOXES = frozenset("widget widgets overlay modal popup popups side rail toolbar banner social share shares sharing".split())
KINDS = COMMENTS | BOXES | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsors sponsored promo promos sidebar sidebars aside menu menus nav navs navbar navigation breadcrumb breadcrumbs pagination pager footer footers cookie cookies consent gdpr notice notices alert alerts newsletter newsletters subscribe subscription signup login related recommended recommendation recommendations".split()
)
#: Words beside which a kind's word keeps its meaning; beside others, as in
#: promotion-history, it is one vote.
PLAIN = frozenset(
    "a an the of to in on at by for with and or id js css container containers wrapper wrap box boxes slot slots area areas section sections block blocks list lists item items body content contents text inner outer left right top bottom center middle main site page global web app reader readers user users visitor visitors view module modules bar bars panel panels unit units row rows col cols column columns post posts article articles entry entries story form forms link links message messages msg policy dialog title heading header head count counts button buttons btn primary secondary tertiary sticky fixed floating mobile desktop small large big wide mini full sub home first last new old more all default group groups region zone layer holder frame display image images icon icons label feed thread threads stream tree root node template layout part parts info data".split()
)
#: Words that are a vote alone: what they name may be a part of the article.
VOTES = frozenset("tag tags meta byline skip copyright legal disclaimer foot toc feedback discussion discussions thread threads conversation responses promotion promotions".split())
_TALK = frozenset("feedback discussion discussions thread threads conversation responses".split())
#: What each reader's comment has.
_SIGNED = frozenset("author avatar date time timestamp user username posted".split())
#: A head is the page's unless it stands in an article or main part, or is named one's.
HEADER = frozenset(["header", "masthead"])
_OWN_HEADER = frozenset("article post entry story".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content|post|entry|story|body|text)(?:$|[\s_-])", re.I)

_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden|aria-hidden)(?:\s|$)")
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BORDERS = frozenset("td th table".split())
_STOPS = _SCOPE.union(*_CLOSES.values())


class Node:
    """An element; ``near`` is the closest element, itself included, that an end
    or begin of a list item, cell or option looks for, ``block`` the closest block."""

    __slots__ = ("tag", "parent", "items", "marks", "points", "chars", "linked", "block", "near", "commas", "inline")

    def __init__(self, tag: str, parent: Node | None, marks: str = ""):
        self.tag, self.parent, self.items, self.marks = tag, parent, [], marks
        self.points = 0.0
        self.chars = self.linked = self.commas = self.inline = 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.near = self if parent is None or tag in _STOPS else parent.near


def unescape(s: str) -> str:
    """Character references decoded; numbers beyond Unicode are U+FFFD."""
    if "&" not in s:
        return s

    def short(m: re.Match) -> str:
        hexadecimal = m[0][2] in "xX"
        digits = m[0][3 if hexadecimal else 2 :].lstrip("0") or "0"
        return ("&#x" if hexadecimal else "&#") + (digits if len(digits) < 8 else "fffd" if hexadecimal else "65533")

    return entities.unescape(_LONG_REFERENCE.sub(short, s))


def names(marks: str) -> list[list[str]]:
    """The words of each name in ``marks``.  A name that says what a layout has beside
    it (has-sidebar, menu-open) is left out."""
    out = []
    for name in marks.split():
        low = name.lower()
        if low.startswith(("has-", "with-", "no-", "without-")) or low.endswith(("-open", "-closed", "-enabled", "-disabled")):
            continue
        out.append([w.lower() for w in _PART.findall(name)])
    return out


class _Open:
    """The open elements by name, so that an end tag without a begin costs nothing.

    A cell or table is a border: within it only the names of ``_SCOPE`` are seen
    beyond it."""

    def __init__(self):
        self.all: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]

    def add(self, tag: str) -> None:
        self.all[tag] += 1
        if tag in _BORDERS:
            self.scopes.append(Counter())
        self.scopes[-1][tag] += 1

    def remove(self, tag: str) -> None:
        self.all[tag] -= 1
        if tag in _BORDERS:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1

    def sees(self, tag: str) -> bool:
        return (self.all if tag in _SCOPE else self.scopes[-1])[tag] > 0


def _marks(attributes: str) -> str:
    """Words of class, id and role, and ``hidden``."""
    out = []
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        k, value = k.lower(), a or b or c or ""
        out.append(f"{k} {value}" if k == "hidden" or (k == "aria-hidden" and value == "true") else value)
    return " ".join(out)


def tree(page: str) -> Node:
    """The page's elements, in one pass; a string among a node's items is text."""
    root = node = Node("html", None)
    open_, at, n = _Open(), 0, len(page)
    last_end, quotes = page.rfind(">"), True

    def text(s: str) -> None:
        if s:
            node.items.append(unescape(s))

    def close(upto: Node) -> Node:
        """``upto`` and all in it end."""
        x = node
        while x is not upto:
            open_.remove(x.tag)
            x = x.parent
        open_.remove(upto.tag)
        return upto.parent

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                node.items.append(page[lt + 9 : n if end < 0 else end])
                at = n if end < 0 else end + 3
            else:
                at = n if lt > last_end else page.find(">", lt) + 1
            continue
        ends = after == "/"
        m = _NAME.match(page, lt + 1 + ends) if lt < last_end else None
        if not m:  # no tag
            if lt > last_end:
                text(page[at:])
                break
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        tag, begin = m[0].lower(), m.end()
        rest = _REST.match(page, begin) if quotes else None
        if rest:
            at = rest.end()
        else:  # a quote is open to the end of the page: from here on tags end at any ">"
            quotes = False
            at = page.find(">", begin) + 1
        attributes = page[begin : at - 1]
        if ends:
            if open_.sees(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            continue
        if tag == "html":
            continue
        if tag in _PARAGRAPH_ENDS:  # an open paragraph ends here, with what it holds
            up = node.block
            if up.parent is not None and (up.tag == "p" or (tag in _HEADS and up.tag in _HEADS)):
                node = close(up)
        if tag in _CLOSES:
            up = node.near
            while up.parent is not None and up.tag not in _CLOSES[tag] and up.tag not in _SCOPE:
                up = up.parent.near
            if up.tag in _CLOSES[tag]:
                node = close(up)
        new = Node(tag, node, _marks(attributes) if attributes else "")
        node.items.append(new)
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            new.items.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else n
            at = at or n
            continue
        open_.add(tag)
        node = new
    return root


def _prune(root: Node, unwanted) -> None:
    """Take out the elements for which ``unwanted(node, within)`` holds, where
    ``within`` tells whether it stands in an article or main part."""
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or node.tag in ("article", "main")
        node.items = [x for x in node.items if isinstance(x, str) or not unwanted(x, within)]
        todo += [(x, within) for x in node.items if not isinstance(x, str)]


def _dropped(node: Node, within: bool) -> bool:
    return node.tag in DROP or (node.tag == "header" and not within) or bool(node.marks and _HIDDEN.search(node.marks))


def _primary(root: Node) -> Node | None:
    """The article or main part of most words, if it has a third of the page's;
    an article in another one or of a comment's class is none."""
    best = None
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "main" or (node.tag == "article" and not _comment(node)):
            if best is None or node.chars - node.linked > best.chars - best.linked:
                best = node
            continue
        todo += [x for x in reversed(node.items) if not isinstance(x, str)]
    return best if best is not None and 3 * (best.chars - best.linked) >= root.chars - root.linked else None


def _comment(node: Node) -> bool:
    return bool(node.marks) and any(not COMMENTS.isdisjoint(words) for words in names(node.marks))


def _signed(node: Node) -> bool:
    """A date or an author's mark is among the next elements."""
    todo, seen = [node], 0
    while todo and seen < 12:
        x = todo.pop(0)
        seen += 1
        if x.tag == "time" or (x is not node and x.marks and any(not _SIGNED.isdisjoint(w) for w in names(x.marks))):
            return True
        todo += [y for y in x.items[:6] if not isinstance(y, str)]
    return False


def _talk(node: Node) -> bool:
    """Two or more parts of one shape, each signed: readers' comments."""
    shapes = Counter((x.tag, x.marks) for x in node.items if not isinstance(x, str) and x.tag in BLOCK | {"article"})
    shape, times = max(shapes.items(), key=lambda x: x[1], default=(None, 0))
    return times > 1 and all(_signed(x) for x in node.items if not isinstance(x, str) and (x.tag, x.marks) == shape)


def _words(node: Node) -> int:
    """About how many words stand outside of links."""
    return (node.chars - node.linked) // 6


def unlikely(node: Node, within: bool, page: int) -> bool:
    """Whether the names of an element, with its links and its share of the page's
    ``page`` plain characters, say that it is no main text.

    A name of a kind's words and plain ones decides, save that a box of most of the
    page's text is only a box.  A kind's word beside others, and a word of ``VOTES``,
    need a second vote: many links, next to no words outside an article, or signed
    parts of one shape."""
    found, vote, talk = set(), False, False
    for words in names(node.marks):
        kinds = KINDS.intersection(words)
        if kinds and PLAIN.issuperset(w for w in words if w not in KINDS and len(w) > 1):
            found |= kinds
        elif kinds or not VOTES.isdisjoint(words):
            vote = True
            talk = talk or not _TALK.isdisjoint(words)
        elif not within and not HEADER.isdisjoint(words) and _OWN_HEADER.isdisjoint(words):
            return True
    if found:
        return not (found <= BOXES and node.chars >= 200 and 5 * (node.chars - node.linked) >= 3 * page)
    return vote and (3 * node.linked >= max(1, node.chars) or (not within and _words(node) < 10) or (talk and _talk(node)))


def prune(root: Node) -> None:
    """Take out what cannot be main text, but nothing that holds the page's article."""
    _prune(root, _dropped)
    measure(root)
    spared, up = set(), _primary(root)
    while up is not None:
        spared.add(id(up))
        up = up.parent
    page = root.chars - root.linked

    def unwanted(node: Node, within: bool) -> bool:
        if not node.marks or node.tag in ("html", "body") or id(node) in spared:
            return False
        if node.tag in ("main", "article"):
            return _comment(node)
        return unlikely(node, within, page)

    _prune(root, unwanted)


def _walk(root: Node):
    """Nodes in page order (no recursion: pages may nest deeply)."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.items) if not isinstance(x, str)]


def blocks(root: Node) -> list[str]:
    """The texts of the blocks below ``root``, in page order."""
    out, held = [], []

    def end() -> None:
        line = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if line:
            out.append(line)

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        else:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.items)
    end()
    return out


def measure(root: Node) -> list[Node]:
    """All nodes in page order, with their lengths: of all text, of that in links,
    of that outside inner blocks, and commas there."""
    nodes = list(_walk(root))
    for node in reversed(nodes):  # children first
        linked = chars = commas = inline = 0
        for x in node.items:
            if isinstance(x, str):
                s = _SPACE.sub(" ", x)
                size = len(s.strip())
                chars += size
                inline += size
                commas += s.count(",") + s.count("，")
                continue
            chars += x.chars
            linked += x.linked
            if x.tag not in BLOCK:
                inline += x.inline
                commas += x.commas
        node.chars, node.linked, node.commas, node.inline = chars, chars if node.tag == "a" else linked, commas, inline
    return nodes


def score(root: Node) -> list[Node]:
    """Give points to containers; returns those with any, in page order."""
    nodes = measure(root)
    for node in nodes:
        if node.tag not in BLOCK or (node.inline < 25 and not (node.tag == "p" and node.inline)):
            continue
        points = (1 + node.commas + min(3, node.inline // 100)) * (1 - node.linked / max(1, node.chars))
        up, level = (node if node.tag not in ("p", "pre", "blockquote", "td", "li", *_HEADS) else node.parent), 0
        while up is not None and level < 6:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    return [x for x in nodes if x.points > 0]


def _total(node: Node) -> float:
    bonus = 1.0
    if node.tag in ("article", "main"):
        bonus = 3.0
    elif LIKELY.search(node.marks or ""):
        bonus = 1.5
    return node.points * bonus * (1 - node.linked / max(1, node.chars))


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    prune(root)
    found = score(root)
    if not found:
        top = next((x for x in _walk(root) if x.tag in ("article", "main")), root)
        for x in _walk(top):
            _unlink(x)
        return "\n".join(blocks(top))
    best = max(found, key=_total)
    least, path = max(10.0, 0.2 * _total(best)), [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    at = max((i for i, x in enumerate(path) if x.tag in ("article", "main")), default=len(path) - 1)
    for inner, outer in zip(path[:at], path[1 : at + 1], strict=True):
        _unlink(outer, inner, least)
    top, out = path[at], []
    for x in [top] if top.parent is None else top.parent.items:
        if x is top or (not isinstance(x, str) and (_total(x) >= least or (x.tag in ("article", "main", "p") and not _links(x.linked, x.chars)))):
            out += blocks(x)
    return "\n".join(out)


def _links(linked: int, chars: int) -> bool:
    return 2 * linked >= max(1, chars)


def _unlink(node: Node, spare: Node | None = None, least: float = float("inf")) -> None:
    """Take out the blocks, and the runs of text between blocks, that are mostly
    links; not ``spare`` and what scores ``least``."""
    kept, run = [], []

    def end() -> None:
        chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in run)
        if spare in run or not _links(sum(0 if isinstance(x, str) else x.linked for x in run), chars):
            kept.extend(run)
        run.clear()

    for x in node.items:
        if isinstance(x, str) or x.tag not in BLOCK:
            run.append(x)
            continue
        end()
        if x is spare or _total(x) >= least or not _links(x.linked, x.chars):
            kept.append(x)
    end()
    node.items = kept


def _extract(batches):
    for batch in batches:
        text = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of ``(page_id, url, html)``."""
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))
