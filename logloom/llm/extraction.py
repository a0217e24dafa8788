"""Main text of web pages by consensus host paths.

Every page is parsed into a light tree. Containers are scored by the good text inside them: that of
their blocks, less what stands in links. A page's best container is the lowest that covers nearly all
of the page's good text, and it is named by its generalised path: tags with their first class, digits
folded. Spark adds up the scores per host and path; the path with the most pages behind it, then the
highest score, wins its host. Pages are then extracted again from the containers on the winning path;
a page whose own best text is not covered by them, or whose host has none, uses its own best container.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.session import stored

#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that end a block, what an open paragraph ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that never belong to the main text.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object svg math canvas audio video dialog menu search noframes xmp fieldset label".split())
#: Words in a class, id or role that mark what surrounds a main text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments cookie cookies consent copyright disqus footer gdpr header "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies "
    "respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo dialog alert".split()
)
#: Lists, tables and quotes are parts of a text; their score counts for what holds them.
CONTAINERS = frozenset("article main div section body center".split())
#: The share of good text that is nearly all, and that of other text which a title or a lead may bring along.
NEARLY_ALL, ALONG = 0.9, 0.1
#: A tag's name, and one attribute or the end of a tag, as the standard's tokenizer reads them: each match goes on where the last one ended.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)("|\Z)|'([^']*)('|\Z)|([^\s>]*)))?)""")
#: Words that only say where a marked element stands or what it looks like: site-header, comments-area, ad-slot.
PLACES = frozenset(
    "site area left right top bottom wrapper wrap container bar posts buttons list body section inner outer box slot block main reader readers user users form "
    "item items group panel module unit zone holder region row column col links link title thread entry post count meta".split()
)
#: Headings over what readers wrote, with or without their number.
COMMENTS_HEADING = re.compile(
    r"\W*\d*\W*(?:(?:user|reader|readers'?) )?(?:comments?|replies|responses|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)\W*\d*\W*", re.I
)
#: What a link or button under a reader's words says.
REPLY = re.compile(r"\W*(?:reply|reply to .{1,60}|antworten|r[ée]pondre|responder)\W*", re.I)
#: Parts of names that say that readers wrote it, and text outside that shows other marked elements to be beside the main text.
READERS = frozenset("comment comments disqus reply replies respond".split())
ENOUGH = 80
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What shows that an element holds the main text, whatever it is called.
HOLDERS = frozenset("article main h1".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
#: Names written as one word: commentlist, navbar.
_COMPOUND = frozenset(mark + place for mark in BOILERPLATE for place in PLACES)


class Node:
    __slots__ = ("tag", "name", "parent", "parts", "dropped", "marked", "depth", "enter", "leave")

    def __init__(self, tag: str, name: str, parent, dropped: bool, marked: bool = False):
        self.tag, self.name, self.parent, self.dropped, self.marked = tag, name, parent, dropped, marked
        self.parts: list = []  # texts and nodes in page order
        self.depth = parent.depth + 1 if parent is not None else 0
        self.enter = self.leave = 0  # places among the kept nodes in page order: its own, and that after its last descendant

    def path(self) -> str:
        names, at = [], self
        while at is not None and at.tag:
            names.append(at.name)
            at = at.parent
        return ">".join(reversed(names))


def _tag_end(page: str, position: int) -> tuple[int, dict[str, str], bool]:
    """(place after the tag, attributes, whether it closes itself) of a tag whose name ends at ``position``.

    A page that ends inside a tag ends there, as the standard has it, so nothing is read twice.
    """
    attributes: dict[str, str] = {}
    end = len(page)
    while True:
        m = _ATTRIBUTE.match(page, position)
        if m[1]:
            return m.end(), attributes, m[0].endswith("/>")
        if m.end() == position or m[4] == "" or m[6] == "":
            return end, attributes, False
        position = m.end()
        if m[2]:
            attributes.setdefault(m[2].lower(), m[3] or m[5] or m[7] or "")


def _boilerplate(name: str) -> bool:
    """Whether a name is made of marks and places only, with one mark at least."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    marks = [p in BOILERPLATE or p in _COMPOUND for p in parts]
    return any(marks) and all(mark or p in PLACES for mark, p in zip(marks, parts, strict=True))


def _marked(attributes: dict[str, str]) -> bool:
    """Whether an id, class or role is a name of boilerplate."""
    return any(_boilerplate(n) for n in f"{attributes.get('id', '')} {attributes.get('class', '')} {attributes.get('role', '')}".split())


def _kept(root: Node) -> list[Node]:
    """All nodes not dropped in page order, numbered."""
    order: list[Node] = []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if node.__class__ is tuple:
            node[0].leave = len(order)
            continue
        if node.dropped:
            continue
        node.enter = len(order)
        order.append(node)
        todo.append((node,))
        todo.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    return order


def _own_text(node: Node) -> str:
    """The text of an element and the inline elements in it, up to what a heading or a link may hold."""
    found, todo = [], [node]
    while todo and len(found) < 50:
        at = todo.pop()
        if isinstance(at, str):
            found.append(at)
        elif not at.dropped or at.tag == "button":
            todo.extend(reversed(at.parts))
    return " ".join(entities.unescape("".join(found)).split())


def _comments(order: list[Node]) -> list[Node]:
    """Containers of what readers wrote, told by their structure.

    Either their first block is a heading that says so, or at least two children of one name each hold a
    link or button to reply.
    """
    replies: dict[int, set[str]] = {}  # container -> names of children with a reply
    twice: set[int] = set()
    found = []
    for node in order:
        if node.tag in HEADINGS and node.tag != "h1" and COMMENTS_HEADING.fullmatch(_own_text(node)):
            up = node.parent
            if up.tag in ("div", "section", "aside") and next((p for p in up.parts if not isinstance(p, str) or p.strip()), None) is node:
                if any(not isinstance(p, str) and p.tag in ("ul", "ol", "dl", "div", "article", "form") for p in up.parts):
                    found.append(up)
        if any(not isinstance(p, str) and p.tag in ("a", "button") and REPLY.fullmatch(_own_text(p)) for p in node.parts):
            item, up = node, node.parent
            for _ in range(4):  # the link stands near the top of its item
                if up is None or not up.tag:
                    break
                names = replies.setdefault(up.enter, set())
                if item.name in names:
                    twice.add(up.enter)
                    break
                if item.tag in BLOCKS and item.tag != "p":
                    names.add(item.name)
                item, up = up, up.parent
    return found + [order[i] for i in sorted(twice) if order[i].tag not in ("body", "html", "article", "main")]


def _settle(root: Node) -> None:
    """Drops the marked elements, but none that holds an article, main or h1 or most of the page's text.

    Most is over three quarters of the text outside links; it does not save an element beside an article
    or main with text of its own, nor one beside an h1 that has other text with it: any, if readers wrote
    the marked one, else a good deal.
    """
    order = _kept(root)
    readers = _comments(order)
    for node in readers:
        node.marked = True
    if not any(n.marked for n in order):
        return
    wrote = {n.enter for n in readers} | {n.enter for n in order if n.marked and READERS & set(_NAME_PARTS.findall(n.name.lower()))}
    amounts, linked, under, article = [0] * len(order), [False] * len(order), [False] * len(order), [0] * len(order)
    for node in order:
        up, at = node.parent.enter if node.parent is not None else 0, node.enter
        linked[at] = node.tag == "a" or linked[up]
        under[at] = node.marked or under[up]
        amounts[at] = 0 if linked[at] else sum(len(p.strip()) for p in node.parts if isinstance(p, str))
    for node in reversed(order[1:]):
        amounts[node.parent.enter] += amounts[node.enter]
    holders = [n.enter for n in order if n.tag in HOLDERS]
    # articles and titles that no marked element holds, and the text that none holds
    articles = 0
    for node in order:
        article[node.enter] = article[node.parent.enter] if node.parent is not None else 0
        if node.tag in ("article", "main") and amounts[node.enter] and not under[node.enter]:
            articles += 1
            article[node.enter] += 1  # so many are around what is inside
    titled = any(n.tag == "h1" and amounts[n.enter] and not under[n.enter] for n in order)
    aside = sum(amounts[n.enter] for n in order if n.marked and not under[n.parent.enter])
    other = amounts[0] - aside - sum(amounts[n.enter] for n in order if n.tag in HEADINGS and not under[n.enter])
    for node in order:
        if node.marked and bisect_left(holders, node.leave) == bisect_left(holders, node.enter):
            little = amounts[node.enter] * 4 <= amounts[0] * 3
            beside = article[node.enter] < articles
            node.dropped = little or beside or titled and other >= (1 if node.enter in wrote else ENOUGH)


def parse(page: str) -> Node:
    """The page's tree. Unclosed and stray tags are mended as far as blocks need it; nothing raises.

    One pass with a cursor that only moves on: the time grows with the page, whatever is broken in it.
    """
    root = at = Node("", "", None, False)
    depth_of: dict[str, int] = {}
    doubtful = False
    position, end = 0, len(page)
    while position < end:
        start = page.find("<", position)
        if start < 0:
            at.parts.append(page[position:])
            break
        following = page[start + 1 : start + 2]
        closing = following == "/"
        m = _NAME.match(page, start + 2 if closing else start + 1)
        if m is None and following not in ("!", "?", "/"):
            at.parts.append(page[position : start + 1])  # a plain <
            position = start + 1
            continue
        if start > position:
            at.parts.append(page[position:start])
        if m is None:
            if page.startswith("<!--", start):
                close = start + 4 if page.startswith((">", "->"), start + 4) else page.find("-->", start + 4)
                position = end if close < 0 else page.find(">", close) + 1
            elif page.startswith("<![CDATA[", start):
                close = page.find("]]>", start)
                at.parts.append(page[start + 9 : end if close < 0 else close])
                position = end if close < 0 else close + 3
            else:
                close = page.find(">", start)
                position = end if close < 0 else close + 1
            continue
        tag = m[0].lower()
        position, attributes, itself = _tag_end(page, m.end())
        if closing:
            if tag == "br" or tag == "p" and not depth_of.get("p"):
                at.parts.append(Node(tag, tag, at, False))
            elif depth_of.get(tag):
                while at.tag != tag:
                    depth_of[at.tag] -= 1
                    at = at.parent
                depth_of[tag] -= 1
                at = at.parent
            continue
        closed, borders = ({"p"}, frozenset()) if tag in BLOCKS and depth_of.get("p") else CLOSES.get(tag, ((), ()))
        for ended, within in ((closed, borders), CLOSES.get(tag, ((), ()))):
            if any(depth_of.get(t) for t in ended):
                found, up = None, at
                while up.tag and up.tag not in within and not (ended == {"p"} and up.tag in BLOCKS and up.tag != "p"):
                    if up.tag in ended:
                        found = up
                    up = up.parent
                if found is not None:
                    while at is not found.parent:
                        depth_of[at.tag] -= 1
                        at = at.parent
        name = tag
        if kind := attributes.get("class", "").split():
            name += "." + _DIGITS.sub("#", kind[0].lower())
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        dropped = tag in DROPPED or hidden
        marked = not dropped and bool(attributes) and tag not in ("html", "body", "article", "main") and tag not in HEADINGS and _marked(attributes)
        if tag == "header":  # a site's header; an article's own holds its title
            dropped = dropped or not (depth_of.get("article") or depth_of.get("main"))
        node = Node(tag, name, at, dropped, marked)
        doubtful = doubtful or marked or tag in HEADINGS or tag in ("a", "button")
        at.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, position)
            position = _tag_end(page, close.end())[0] if close else end
        elif tag not in VOID and not itself:
            at = node
            depth_of[tag] = depth_of.get(tag, 0) + 1
    if doubtful:
        _settle(root)
    return root


def blocks(node: Node) -> list[str]:
    """The node's blocks in page order, references decoded, white space folded, without dropped parts."""
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            found.append(text)

    todo: list = [iter(node.parts)]
    tags = [node.tag]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if tags.pop() in BLOCKS:
                flush()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif part.dropped:
            if part.tag in BLOCKS:
                flush()
        else:
            if part.tag in BLOCKS:
                flush()
            todo.append(iter(part.parts))
            tags.append(part.tag)
    flush()
    return found


class Texts:
    """Of every element: all its text, its good text, and its good text outside the containers in it.

    Good text is a block's text outside links less half of that in links, if anything is left; inside a
    kept element with the name of boilerplate it counts half.
    """

    def __init__(self, root: Node):
        self.order: list[Node] = []  # in page order
        self.every: dict[int, int] = {}
        self.good: dict[int, float] = {}
        self.own: dict[int, float] = {}
        todo: list[tuple[Node, Node, bool, float]] = [(root, root, False, 1.0)]
        while todo:
            node, block, linked, weight = todo.pop()
            if node.dropped:
                continue
            node.enter = node.leave = len(self.order)
            block = node if node.tag in BLOCKS else block
            linked = linked or node.tag == "a"
            weight = 0.5 if node.marked else weight
            self.order.append(node)
            text = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
            self.every[id(node)] = text
            self.good.setdefault(id(node), 0.0)
            self.good[id(block)] += weight * text * (-0.5 if linked else 1.0)
            todo.extend((p, block, linked, weight) for p in reversed(node.parts) if not isinstance(p, str))
        for node in self.order:
            self.own[id(node)] = self.good[id(node)] = max(0.0, self.good[id(node)])
        for node in reversed(self.order):
            node.leave = max(node.leave, node.enter + 1)
            if node.parent is None:
                continue
            up = id(node.parent)
            node.parent.leave = max(node.parent.leave, node.leave)
            self.every[up] += self.every[id(node)]
            self.good[up] += self.good[id(node)]
            if node.tag not in CONTAINERS:
                self.own[up] += self.own[id(node)]

        self.headings = [n for n in self.order if n.tag == "h1" and self.every[id(n)]]
        self.places = [n.enter for n in self.headings]
        self.amounts = [0, *accumulate(self.every[id(n)] for n in self.headings)]

    def titles(self, node: Node) -> tuple[int, int]:
        """The range of the headings h1 with text inside the node."""
        return bisect_left(self.places, node.enter), bisect_left(self.places, node.leave)

    def title_text(self, node: Node) -> int:
        first, end = self.titles(node)
        return self.amounts[end] - self.amounts[first]


def _inside(node: Node, of: Node) -> bool:
    return of.enter <= node.enter < of.leave


def best_container(root: Node, texts: Texts | None = None) -> tuple[Node, float] | None:
    """The container of the main text and its score; the root where the text stands in no other.

    An article or main that covers over half of the good text goes before other containers. A container
    gives way to one around it that adds the title, or paragraphs of its own, and hardly anything else.
    """
    texts = texts or Texts(root)
    total = texts.good[id(root)]
    if total <= 0:
        return None
    articles = [n for n in texts.order if n.tag in ("article", "main") and texts.good[id(n)] * 2 > total]
    pool = articles or [n for n in texts.order if n.tag in CONTAINERS or n is root]
    enough = [n for n in pool if texts.good[id(n)] >= NEARLY_ALL * total]
    best = enough[-1] if enough else max(reversed(pool), key=lambda n: texts.good[id(n)])
    inner, up = best, best.parent
    titled = texts.title_text(best) > 0
    while up is not None:
        if up.tag in CONTAINERS or up is root:
            titles = 0 if titled else texts.title_text(up)
            lead = 0.0 if articles else texts.own[id(up)]
            fits = texts.every[id(up)] - texts.every[id(inner)] <= lead + titles + ALONG * texts.every[id(inner)]
            if (titles or lead) and fits:
                best, inner, titled = up, up, titled or titles > 0
        up = up.parent
    return best, texts.good[id(best)] * (1.5 if best.tag in ("article", "main") else 1.0)


def _covers(nodes: list[Node], best: Node, texts: Texts) -> bool:
    """Whether the nodes hold nearly all of the best container's good text, and its titles.

    Of a body, which is best where a page has no one place for its text, that is the text outside the
    containers in it: among these the host's path decides.
    """
    held = sum(texts.good[id(n)] for n in nodes)
    whole_page = best.tag in ("", "body")
    wanted = texts.own[id(best)] + held if whole_page else texts.good[id(best)]
    if not whole_page:
        held = sum(texts.good[id(n)] if _inside(n, best) else texts.good[id(best)] for n in nodes if _inside(n, best) or _inside(best, n))
    return held > 0 and held >= NEARLY_ALL * wanted and all(any(_inside(t, n) for n in nodes) for t in texts.headings[slice(*texts.titles(best))])


def _on_path(root: Node, path: str) -> list[Node]:
    names = path.split(">")
    depth = len(names)
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped or node.depth > depth:
            continue
        if node.depth == depth and node.name == names[-1] and node.tag in CONTAINERS and node.path() == path:
            found.append(node)
        elif node.depth == 0 or node.name == names[node.depth - 1]:  # only below what the path names
            todo.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    return found


def extract(page: str, path: str | None = None) -> str:
    """The main text: from the containers on ``path`` if they cover the page's best text, else from its best container."""
    root = parse(page)
    texts = Texts(root)
    best = best_container(root, texts)
    places = _on_path(root, path) if path else []
    if best is not None and not (places and _covers(places, best[0], texts)):
        places = [best[0]]
    found = [b for n in places or [root] for b in blocks(n)]
    return "\n\n".join(found)


def host(url: Column) -> Column:
    """Lower-case host of a URL; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path: the path that wins each host. Votes are summed per (host, path) before hosts are compared."""

    def run(batches):
        for batch in batches:
            best = [best_container(parse(p)) for p in batch.column(1).to_pylist()]
            paths = [b[0].path() or None if b else None for b in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array([b[1] if b else 0.0 for b in best], pa.float64())], ["host", "path", "score"])

    votes = pages.select(host(F.col(url)).alias("host"), whole(F.col(html)).alias("html")).mapInArrow(run, "host string, path string, score double")
    votes = votes.filter("path IS NOT NULL AND host <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.round("score").cast("long")).alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("pages", "score", "path")).alias("path"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    Null and empty pages, and pages without text, give the empty text; null urls take part without a
    host; repeated rows and null keys get a row each; an empty table gives no rows; other columns are
    ignored. Winning paths are stored, so Spark knows their size: few hosts are broadcast, many joined
    by a shuffle that splits a large host.
    """
    paths = stored(host_paths(pages, url, html), "paths")
    asked = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), whole(F.col(html)).alias("h"), host(F.col(url)).alias("host"))
    joined = asked.join(paths, "host", "left").select("k", "u", "h", "path")

    def run(batches):
        for batch in batches:
            texts = [extract(p, path) for p, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["k", "u", "t", "n"])

    kind = joined.schema["k"].dataType.simpleString()
    made = joined.mapInArrow(run, f"k {kind}, u string, t string, n bigint")
    return made.select(F.col("k").alias(key), F.col("u").alias(url), F.col("t").alias("text"), F.col("n").alias("n_chars"))
