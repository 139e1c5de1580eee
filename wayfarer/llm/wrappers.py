"""Main text of web pages by union-free regular expressions inferred for each host.

Pages of a host come from a few templates.  All pages of a host are aligned: tags that agree advance together, texts that
differ become slots, siblings that recur become repeated groups (+), and what only one side has becomes an optional group
(?).  Pages of one tag structure are merged first, which is associative and commutative, in the tasks that read them; one
skeleton per distinct structure is left, and these are aligned in the order of their digests, in cells and then over the
cells, so the wrapper depends on the pages alone and no task sees the pages of a host.  The result is a wrapper without
unions, as ``<body> <nav> … <article> <h1> #text </h1> ( <p> #text </p> )+ </article> …``; a template that only some pages
have is an optional group of it, with a content region of its own.

Each page is matched against its host's wrapper and read through it.  A page that the wrapper does not describe (its tags
are no word of the expression) is read through a wrapper inferred from itself.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, pick, shared_dir, sliced, written

BROADCAST_BYTES = 16 << 20
#: Skeletons held by a task before they are passed on, cells of a host's structures, characters of a text kept for show.
HELD, CELLS, SHOWN = 500, 1024, 200
#: Deeper elements become siblings, as in browsers; their text stays.
MAX_DEPTH = 200
#: An alignment over more cells than this anchors on labels that are unique on both sides first.
LCS_CELLS = 250_000
#: Text counts as constant over a host when so many pages have it.
SEEN = 3

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
CHROME_TAGS = set("nav footer aside form button select dialog menu head script style template noscript iframe svg math object textarea".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
#: Opening one of these ends an open one of the set, up to the nearest container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Names of chrome.  A whole class, id or role has to be one of these (numbers read as #): parts of slugs say nothing.
CHROME_NAME = re.compile(r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|footer|masthead|cookies?|consent|notice|popup|modal|overlay|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|comments?|replies|respond|disqus|widget|toolbar|pagination|pager|tags|copyright|skip|contentinfo|navigation|complementary)(?:[_-]?#)*", re.I)
#: Elements whose ids authors choose for the page's frame; other ids (of headings, say) are made from the text.
FRAMES = set("div section article main aside nav header footer form ul ol table".split())
HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|topbar)(?:$|[\s_-])", re.I)

#: Attributes up to the end of a tag, as the HTML tokenizer reads them: a quote opens a value only right after the equals
#: sign, and anywhere else it is an ordinary character.
ATTRIBUTES = r"((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(" + RAW + r")(?=[\s/>])" + ATTRIBUTES + r"(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)" + ATTRIBUTES + r"(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: A slash that ends the last attribute's value closes nothing.
SLASHED = re.compile(r"=\s*[^\s>\"']*/\Z")
SPACE = re.compile(r"\s+")
#: Numbers in names, as of posts and parts, are no part of a template.
DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    """An element of a page, or of a wrapper: count is '', '?', '+' or '*'.  Text nodes have no tag.

    Wrapper text: size over all pages, pages n, and mark, the digest of a text that all of them share (a slot has None).
    """

    tag: str
    name: str = ""
    text: str | None = None
    count: str = ""
    size: int = 0
    children: list[Node] = field(default_factory=list)
    mark: int | None = None
    n: int = 1
    flags: int = 0
    rule: Node | None = None
    index: tuple[dict[str, list[int]], list[int]] | None = None

    @property
    def label(self) -> str:
        return f"{self.tag}.{SPACE.sub('.', self.name.strip())}" if self.name.strip() else self.tag

    @property
    def chrome(self) -> bool:
        return self.tag in CHROME_TAGS or self.named

    @property
    def named(self) -> bool:
        return bool(self.name and self.tag not in ("html", "body", "main", "article") and any(map(CHROME_NAME.fullmatch, self.name.split())))


def parse(source: str) -> Node:
    """The token stream as nested elements, with the end tags that HTML lets authors omit."""
    root = Node("#root")
    stack = [root]

    def close(tags: set, until: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    for m in TOKEN.finditer(source):
        raw, _, end, tag, attrs, text = m.groups()
        if text is not None:
            stack[-1].children.append(Node("", text=text))
        elif raw:
            continue
        elif tag:
            tag = tag.lower()
            if end:
                if tag in VOID:
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK and tag not in BLOCK:
                        break
                continue
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "th", "article", "section", "div", "li", "blockquote", "main", "aside", "form", "body"})
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            name = " ".join(a or b or c for kind, a, b, c in ATTRIBUTE.findall(attrs) if kind.lower() in ("class", "role") or kind.lower() == "id" and tag in FRAMES) if attrs else ""
            node = Node(tag, DIGITS.sub("#", htmllib.unescape(name)))
            stack[-1].children.append(node)
            if tag not in VOID and (tag in BLOCK or not attrs.endswith("/") or SLASHED.search(attrs)) and len(stack) < MAX_DEPTH:
                stack.append(node)
    return root


# --- inference ----------------------------------------------------------------------------------------------


def digest(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def said(node: Node) -> str:
    """The text of a text node, white space reduced; empty for blanks."""
    return SPACE.sub(" ", node.text or "").strip()


def fold(node: Node) -> Node:
    """A page's element as a wrapper element: neighbours of one label become one repeated group."""
    out: list[Node] = []
    for child in node.children:
        if child.tag == "":
            text = said(child)
            if text:
                out.append(Node("", text=text if len(text) <= SHOWN else None, size=len(text), mark=digest(text)))
            continue
        folded = fold(child)
        if out and out[-1].tag and out[-1].label == folded.label:
            last = out[-1]
            out[-1] = Node(last.tag, last.name, None, "+", 0, align(last.children, folded.children, False))
        else:
            out.append(folded)
    return Node(node.tag, node.name, None, "", 0, out)


def optional(node: Node) -> Node:
    return Node(node.tag, node.name, node.text, {"": "?", "+": "*"}.get(node.count, node.count), node.size, node.children, node.mark, node.n)


def merge(a: Node, b: Node, pages: bool = True) -> Node:
    """Two elements as one: of different pages, or (pages false) of one page, whose texts then follow each other."""
    many = "+" in a.count + b.count or "*" in a.count + b.count
    maybe = "?" in a.count + b.count or "*" in a.count + b.count
    count = "*" if many and maybe else "+" if many else "?" if maybe else ""
    if a.tag == "":
        same = a.mark is not None and a.mark == b.mark
        mark = (a.mark if same else None) if pages else None if a.mark is None or b.mark is None else digest(a.mark, b.mark)
        return Node("", text=a.text if a.text == b.text else None, count=count, size=a.size + b.size, mark=mark, n=a.n + b.n if pages else max(a.n, b.n))
    return Node(a.tag, a.name, None, count, 0, align(a.children, b.children, pages))


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a common subsequence: the longest, or for long lists one through the labels unique on both sides.
    What both begin and end with is taken off first."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
    inner = between(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*((i, i) for i in range(head)), *((head + i, head + j) for i, j in inner), *((len(a) - tail + i, len(b) - tail + i) for i in range(tail))]


def between(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    if len(a) * len(b) > LCS_CELLS:
        seen_a, seen_b = Counter(a), Counter(b)
        at = {x: j for j, x in enumerate(b) if seen_b[x] == 1}
        pairs = [(i, at[x]) for i, x in enumerate(a) if seen_a[x] == 1 and x in at]
        ends: list[int] = []
        tops: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            where = bisect_left(ends, j)
            ends[where : where + 1] = [j]
            tops[where : where + 1] = [k]
            back.append(tops[where - 1] if where else -1)
        chain: list[tuple[int, int]] = []
        k = tops[-1] if tops else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        out: list[tuple[int, int]] = []
        i = j = 0
        for x, y in [*reversed(chain), (len(a), len(b))]:
            if (x - i) * (y - j) <= LCS_CELLS:
                out += [(i + p, j + q) for p, q in common(a[i:x], b[j:y])]
            if x < len(a):
                out.append((x, y))
            i, j = x + 1, y + 1
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[Node], b: list[Node], pages: bool = True) -> list[Node]:
    """Two token streams of one element as one: mismatches become slots, optional or repeated groups."""
    if not a or not b:
        return [optional(x) for x in a or b]
    labels_a, labels_b = [x.label for x in a], [x.label for x in b]
    if labels_a == labels_b:
        return [merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    out: list[Node] = []
    i = j = 0
    for x, y in [*common(labels_a, labels_b), (len(a), len(b))]:
        out += map(optional, a[i:x])
        out += map(optional, b[j:y])
        if x < len(a):
            out.append(merge(a[x], b[y], pages))
        i, j = x + 1, y + 1
    # A group that an alignment has put beside one of its own label is a repetition of it.
    joined: list[Node] = []
    for x in out:
        if joined and x.tag and joined[-1].label == x.label:
            y = merge(joined[-1], x, pages)
            joined[-1] = Node(y.tag, y.name, None, "*" if y.count in ("?", "*") else "+", 0, y.children)
        else:
            joined.append(x)
    return joined


def structure(node: Node) -> str:
    return f"{node.label}{node.count}({' '.join(map(structure, node.children))})"


def packed(node: Node) -> list:
    return [node.tag, node.name, node.text, node.count, node.size, node.mark, node.n, node.flags, [packed(c) for c in node.children]]


def unpacked(row: list) -> Node:
    tag, name, text, count, size, mark, n, flags, children = row
    return Node(tag, name, text, count, size, [unpacked(c) for c in children], mark, n, flags)


def infer(pages: list[str]) -> Node | None:
    wrapper = None
    for source in pages:
        page = fold(parse(source))
        wrapper = page if wrapper is None else merge(wrapper, page)
    return wrapper


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tokens."""
    if node.tag == "":
        shown = "#text" if node.mark is None else repr(node.text) if node.text is not None else f"#text={node.mark:x}"
        return f"( {shown} ){node.count}" if node.count else shown
    body = " ".join([f"<{node.label}>", *map(expression, node.children), *([] if node.tag in VOID else [f"</{node.tag}>"])]) if node.tag != "#root" else " ".join(map(expression, node.children))
    return f"( {body} ){node.count}" if node.count else body


REGION, CONSTANT, FIXED = 1, 2, 4
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks that a region does not narrow down to: what stands beside them belongs to the same text.
LEAVES = set("p li td th tr tbody thead table ul ol dl dt dd h1 h2 h3 h4 h5 h6 pre blockquote caption figcaption figure address center hr legend summary".split())


def leaves(node: Node) -> list[Node]:
    return [node] if node.tag == "" else [x for c in node.children for x in leaves(c)]


def constant(node: Node) -> bool:
    """Whether the text below is the same on all pages that have the element, SEEN of them at least."""
    texts = leaves(node)
    return bool(texts) and all(x.mark is not None and x.n >= SEEN for x in texts)


def site_header(node: Node) -> bool:
    """A header that the alignment does not show to vary with the page, as a page's title does."""
    return (node.tag == "header" or bool(HEADER_NAME.search(node.name))) and not any(x.mark is None and x.n >= SEEN for x in leaves(node))


def weight(node: Node, varies: bool) -> int:
    """Characters of running text below, without chrome, site headers and links.  On hosts whose pages differ, text that
    is constant over the pages does not run."""
    if node.tag == "":
        return 0 if varies and constant(node) else node.size
    if node.chrome or node.tag == "a" or site_header(node):
        return 0
    return sum(weight(c, varies) for c in node.children)


def article(node: Node) -> bool:
    """An article or main element with text outside of links; names of parts of it are not asked."""
    return node.tag in ("article", "main") and any(map(holds, node.children))


def holds(node: Node) -> bool:
    return node.tag == "" or node.tag not in CHROME_TAGS and node.tag != "a" and any(map(holds, node.children))


def regions(wrapper: Node) -> list[tuple[list[str], Node]]:
    """(labels from the root, part) of the content regions, in page order.

    Every article and main element with running text is one, whole, in every template; so is whatever else holds running
    text beside them, as a lead or a title.  Where there is no such element, the region is the lowest container of all the
    running text.
    """
    found: list[tuple[list[str], Node]] = []
    varies = any(x.mark is None for x in leaves(wrapper)) and weight(wrapper, True) > 0

    def marked(node: Node) -> bool:
        return article(node) or any(marked(c) for c in node.children if c.tag and not c.chrome and not site_header(c))

    def collect(node: Node, trail: list[str]) -> None:
        for inline, group in groupby(node.children, lambda c: c.tag not in BLOCK):
            parts = list(group)
            # Text, links and emphasis that follow each other are one line; it runs if a part of it does.
            line = inline and any(weight(c, varies) for c in parts)
            for child in parts:
                here = [*trail, child.label or "#text"]
                if article(child):
                    found.append((here, child))
                elif child.tag and (child.chrome or site_header(child)):
                    continue
                elif child.tag and marked(child):
                    collect(child, here)
                elif line or weight(child, varies):
                    found.append((here, child))

    if marked(wrapper):
        collect(wrapper, [])
        return found
    path: list[str] = []
    node = wrapper
    while True:
        running = [c for c in node.children if weight(c, varies)]
        if len(running) != 1 or running[0].tag not in BLOCK or running[0].tag in LEAVES:
            return [(path, node)]
        node = running[0]
        path.append(node.label)


def ruled(wrapper: Node) -> Node:
    """The wrapper with its content regions flagged, the blocks inside them that are part of the template, and the named
    elements whose text is constant over differing pages."""
    for _, node in regions(wrapper):
        node.flags |= REGION
        if any(x.mark is None for x in leaves(node)):
            flag_fixed(node)
    if any(x.mark is None for x in leaves(wrapper)):
        flag_constants(wrapper)
    return wrapper


def flag_fixed(region: Node) -> None:
    """Slots and what varies with the page are the text of a region.  A block (no heading) that every page of the region
    has, with the same text, belongs to the template, unless such blocks make up most of the region."""
    found: list[Node] = []
    todo = [region]
    while todo:
        for child in todo.pop().children:
            if child.count in ("", "+") and child.tag:
                if child.tag in BLOCK and child.tag not in HEADINGS and constant(child):
                    found.append(child)
                else:
                    todo.append(child)
    length = lambda node: sum(x.size for x in leaves(node))
    if 2 * sum(map(length, found)) <= length(region):
        for node in found:
            node.flags |= FIXED


def flag_constants(node: Node) -> None:
    for child in node.children:
        if child.named and constant(child):
            child.flags |= CONSTANT
        flag_constants(child)


def dropped(node: Node, inside: bool) -> bool:
    """Whether a page's element is chrome or template.  Outside the regions its name decides; inside, the name counts
    only where the alignment finds the text constant over the host or most of the text is links."""
    if node.tag in CHROME_TAGS or node.rule is not None and node.rule.flags & FIXED:
        return True
    if not node.named:
        return False
    if not inside or node.rule.flags & CONSTANT:
        return True
    total = sum(len(said(x)) for x in leaves(node))
    return linked(node) * 2 > total


def linked(node: Node) -> int:
    return sum(len(said(x)) for x in leaves(node)) if node.tag == "a" else sum(linked(c) for c in node.children)


# --- extraction ---------------------------------------------------------------------------------------------


def places(labels: list[str], wrapper: Node) -> list[int] | None:
    """The part of the wrapper that each label of a page's token stream is read by; None if the expression does not match.

    Of the parts between two that must come, the first that a reading can stand at allows whatever a later one allows,
    so a reading is followed for one part of each such stretch.
    """
    parts = wrapper.children
    if wrapper.index is None:
        at: dict[str, list[int]] = {}
        for k, p in enumerate(parts):
            at.setdefault(p.label, []).append(k)
        due = [len(parts)] * (len(parts) + 1)  # due[k]: the first part from k on that must come
        for k in range(len(parts) - 1, -1, -1):
            due[k] = due[k + 1] if parts[k].count in ("?", "*") else k
        wrapper.index = at, due
    at, due = wrapper.index
    # Position by the part due after it; the positions before as linked lists.
    states: dict[int, tuple[int, tuple | None]] = {due[0]: (-1, None)}
    for label in labels:
        spots, after = at.get(label, []), {}
        for end, (j, chain) in states.items():
            where = bisect_left(spots, j + 1)
            steps = [j] if j >= 0 and parts[j].count in ("+", "*") and parts[j].label == label else []
            if where < len(spots) and spots[where] <= end:
                steps.append(spots[where])
            if end < len(parts) and parts[end].label == label:
                steps.append(end)
            for k in steps:
                old = after.get(due[k + 1])
                if old is None or k < old[0]:
                    after[due[k + 1]] = (k, (k, chain))
        if not after:
            return None
        states = after
    if len(parts) not in states:
        return None
    chain, out = states[len(parts)][1], []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def described(page: Node, wrapper: Node) -> bool:
    """Match the page's tags against the wrapper; each element then knows the part of the wrapper that it is read by."""
    page.rule = wrapper
    stream = [c for c in page.children if c.tag or said(c)]
    where = places([c.label for c in stream], wrapper)
    return where is not None and all(described(c, wrapper.children[j]) for c, j in zip(stream, where, strict=True))


def blocks(page: Node) -> list[str]:
    """Texts of the blocks of the content regions, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", htmllib.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    def walk(n: Node, inside: bool, body: bool) -> None:
        # Where the region is the whole body, names decide as they do outside.
        body = body and n.tag in ("#root", "html", "body")
        for child in n.children:
            here = inside or child.rule is not None and bool(child.rule.flags & REGION)
            if child.tag == "":
                if here or child.rule is None:
                    run.append(child.text or "")
            elif child.tag == "br":
                run.append(" ")
            elif not dropped(child, here and not body):
                block = child.tag in BLOCK
                if block:
                    flush()
                walk(child, here, body)
                if block:
                    flush()

    walk(page, bool(page.rule.flags & REGION), True)
    flush()
    return out


def main_text(source: str | None, wrapper: Node | None) -> str:
    if not source:
        return ""
    page = parse(source)
    if wrapper is None or not described(page, wrapper):
        described(page, ruled(fold(page)))
    return "\n".join(blocks(page))


@lru_cache(maxsize=64)
def read_rules(rules: str | None) -> Node | None:
    return unpacked(json.loads(rules)) if rules else None


#: path: labels from the root to the first content region; regions: those of all; rules: the wrapper with its regions, as JSON.
WRAPPERS = "host string, pages bigint, path array<string>, regions array<array<string>>, wrapper string, rules string"
_SKELETONS = pa.schema([("host", pa.string()), ("cell", pa.int32()), ("structure", pa.int64()), ("pages", pa.int64()), ("skeleton", pa.string())])
SKELETONS = "host string, cell int, structure bigint, pages bigint, skeleton string"


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def aligned(group: pd.DataFrame) -> tuple[int, Node, int]:
    """All skeletons of a group as one: equal structures first, then the structures in the order of their digests."""
    whole = None
    for _, same in group.groupby("structure", sort=True):
        one = None
        for text in same["skeleton"]:
            one = unpacked(json.loads(text)) if one is None else merge(one, unpacked(json.loads(text)))
        whole = one if whole is None else merge(whole, one)
    return int(group["structure"].min()), whole, int(group["pages"].sum())


def host_wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages aligned, path, regions, wrapper, rules), one row per host, over all its pages with html.

    A task merges the pages of one host and structure as it reads them and passes on skeletons, without texts above SHOWN
    characters; the structures of a host are aligned in CELLS cells, and then the cells.
    """
    rows = pick(pages, url=url_col, html=html_col).where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("host"), "html")

    def skeletons(batches):
        held: dict[tuple[str, int], list] = {}

        def passed():
            keys = list(held)
            columns = [[k[0] for k in keys], [k[1] % CELLS for k in keys], [k[1] for k in keys], [held[k][0] for k in keys], [json.dumps(packed(held[k][1])) for k in keys]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SKELETONS, strict=True)], schema=_SKELETONS)

        for part in sliced(batches):
            for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = fold(parse(source))
                key = (host, digest(structure(page)))
                old = held.get(key)
                held[key] = [1, page] if old is None else [old[0] + 1, merge(old[1], page)]
                if len(held) >= HELD:
                    yield passed()
        yield passed()

    def of_cell(group: pd.DataFrame) -> pd.DataFrame:
        first, whole, n = aligned(group)
        return pd.DataFrame({"host": group["host"][:1], "cell": group["cell"][:1], "structure": [first], "pages": [n], "skeleton": [json.dumps(packed(whole))]})

    def of_host(group: pd.DataFrame) -> pd.DataFrame:
        _, whole, n = aligned(group)
        paths = [path for path, _ in regions(whole)]
        return pd.DataFrame({"host": group["host"][:1], "pages": [n], "path": [paths[0] if paths else []], "regions": [paths], "wrapper": [expression(whole)], "rules": [json.dumps(packed(ruled(whole)))]})

    cells = rows.mapInArrow(skeletons, SKELETONS).groupBy("host", "cell").applyInPandas(of_cell, SKELETONS)
    return cells.groupBy("host").applyInPandas(of_host, WRAPPERS)


TEXTS = "page_id bigint, url string, text string, n_chars bigint"
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one per input row.

    Null and empty html give the empty text; a null url is a host of its own; repeated rows repeat; an empty table gives
    no rows; other columns are ignored.  Wrappers are broadcast up to BROADCAST_BYTES, which are counted first, and joined
    by shuffle beyond.
    """
    if wrappers is None:
        wrappers = written(host_wrappers(pages, id_col=id_col, url_col=url_col, html_col=html_col), "wrappers", shared_dir(pages.sparkSession))
    rules = wrappers.select("host", "rules")
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    small = (rules.agg(F.sum(F.length("rules"))).head()[0] or 0) <= BROADCAST_BYTES
    if small:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["rules"] for r in rules.collect()})
        rows = rows.withColumnRenamed("host", "rules")
    else:
        rows = rows.join(rules, "host", "left")

    def run(batches):
        for part in sliced(batches, SLICE_ROWS if small else 16):
            keys = part.column(3).to_pylist()
            texts = [main_text(h, read_rules(shared.value.get(k) if small else k)) for h, k in zip(part.column(2).to_pylist(), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXTS)

    return rows.select("page_id", "url", "html", "rules").mapInArrow(run, TEXTS)
