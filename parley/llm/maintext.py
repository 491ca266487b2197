"""Main text of HTML pages by tree scoring.

A page becomes a tree. Menus, forms, adverts, comments and the like are cut off by element, role and
class. Every paragraph then passes points for its length and commas to its ancestors, fewer with each
level; a container's points are discounted by the share of its text that stands in links. The container
with the most points is kept, together with those of its siblings that score well enough.
"""

import html
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, within the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
P_STOPS = frozenset("table td th caption button object applet marquee html".split())
DROP = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map form button "
    "select textarea datalist fieldset nav footer aside menu dialog noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|comments?|commentlist|"
    r"disqus\w*|respond|replies|reply|cookies?|cookiebar|consent|gdpr|notices?|notification\w*|alerts?|popup\w*|modal|overlay|"
    r"newsletter\w*|subscribe\w*|subscription|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|breadcrumbs?|"
    r"menu\w*|nav|navbar|navigation|footer\w*|masthead|toolbar|topbar|pagination|pager|widgets?|outbrain|taboola|"
    r"search\w*|skip|copyright|disclaimer|teasers?|tags?|tagcloud)(?=$|[\s_-])",
    re.I,
)
#: Junk outside of an article only; inside it is the article's own head.
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
GOOD = re.compile(r"article|body|content|entry|main|page|post|text|story|blog", re.I)
BAD = re.compile(r"hidden|foot|meta|outbrain|shout|tool|list|link|combx|contact", re.I)
REMARK = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>", re.S)
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)  # a ">" ends it, also within quotes
ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]*+)))?", re.S)
HEADINGS = {f"h{i}" for i in range(1, 7)}
START = {"article": 10, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "li": -3}
START |= {"ul": -3, "ol": -3, "dl": -3, "address": -3, "th": -5} | {h: -5 for h in HEADINGS}
LEVELS = 5


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "linked", "article", "score", "dropped")

    def __init__(self, tag, attrs="", parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.linked = 0
        self.article = self.dropped = False
        self.score = None


class Open:
    """The open elements; the nearest of a kind is known without a walk over the others."""

    def __init__(self, root):
        self.nodes, self.at, self.blocks = [root], {}, [0]

    def push(self, node):
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, tags):
        """Place of the innermost element with one of the tags; 0 (the root): none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, k):
        """Ends the element at place ``k`` and all within it."""
        for node in self.nodes[k:]:
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.nodes[k:]

    def end_paragraph(self):
        k = self.nearest(("p",))
        if k and k >= max(self.blocks[-1], self.nearest(P_STOPS)):
            self.cut(k)

    def end_open(self, ended, within):
        k = self.nearest(ended)
        if k and k >= self.nearest(within):
            self.cut(k)

    def close(self, name):
        """An end tag. A stray inline one does not end blocks, one of div, p or li no table."""
        k = self.nearest((name,))
        if not k or (name not in BLOCK and self.blocks[-1] > k):
            return
        if name not in ("div", "p", "li") or self.nearest(("table",)) < k:
            self.cut(k)


def marks(page):
    """Tags, comments and the like in page order, as matches; time grows in proportion to the page.

    After the first tag that its quotes keep open to the end of the page, a tag ends at the next ">".
    The caller sends the place to go on from, or None for the end of the match.
    """
    tag, last, at = TAG, page.rfind(">"), page.find("<")
    while at >= 0:
        found = REMARK.match(page, at)
        if found is None and at < last:
            found = tag.match(page, at)
            if found is None and (found := PLAIN.match(page, at)):
                tag = PLAIN
        elif found is None:
            # No tag ends any more; a comment may still begin.
            found = REMARK.search(page, at)
            if found is None:
                return
        if found is None:
            at = page.find("<", at + 1)
            continue
        on = yield found
        at = page.find("<", found.end() if on is None else on)


def parse(page):
    """The tree of a page; never fails, unclosed and stray tags are mended as browsers mostly do."""
    root = Node("#root")
    opened, at = Open(root), 0

    def text(value):
        if value:
            opened.nodes[-1].children.append(html.unescape(value) if "&" in value else value)

    reader, on = marks(page), None
    while True:
        try:
            found = reader.send(on)
        except StopIteration:
            break
        on = None
        text(page[at : found.start()])
        at = found.end()
        if found.re is REMARK:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        name = found[2].lower()
        if found[1]:
            opened.close(name)
            continue
        if name in BLOCK:
            opened.end_paragraph()
        if name in ENDS:
            opened.end_open(*ENDS[name])
        parent = opened.nodes[-1]
        node = Node(name, found[3], parent)
        parent.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            node.children.append(page[at : end.start()] if end else page[at:])
            at = on = end.end() if end else len(page)
        elif name not in VOID:
            opened.push(node)
    text(page[at:])
    return root


def attributes(raw):
    out = {}
    for name, a, b, c in ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _ordered(root):
    """All nodes, parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _weight(names):
    return 25 * (GOOD.search(names) is not None) - 25 * (BAD.search(names) is not None) if names else 0


def prune(nodes):
    """Cut off everything that is not an article's text; returns names (class and id) by node."""
    names, inside = {}, {}
    for node in reversed(nodes):
        if node.tag in ("article", "main"):
            node.article = True
        if node.article and node.parent:
            node.parent.article = True
    for node in nodes:
        parent = node.parent
        inside[node] = parent is not None and (inside[parent] or parent.tag in ("article", "main"))
        if parent is not None and parent.dropped:
            node.dropped = True
            continue
        tag = node.tag
        if tag in DROP or (tag == "header" and not inside[node]):
            node.dropped = True
            continue
        if not node.attrs or node.attrs.isspace():
            continue
        values = attributes(node.attrs)
        names[node] = joined = f"{values.get('class', '')} {values.get('id', '')}"
        if tag in ("html", "body", "article", "main"):
            # A comment may be marked up as an article of its own.
            node.dropped = tag == "article" and re.search(r"(?:^|[\s_-])comment", joined, re.I) is not None
            continue
        role = values.get("role", "").strip().lower()
        hidden = "hidden" in values or values.get("aria-hidden") == "true"
        hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I)
        junk = role in ROLES or JUNK.search(joined) or (not inside[node] and HEADER.search(joined))
        if hidden or (junk and not node.article and tag not in HEADINGS):
            node.dropped = True
    return names


def squeeze(text):
    return " ".join(text.split())


def measure(nodes):
    """Characters of text, and of text in links, below each node that is left."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.chars += sum(len(squeeze(c)) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def own_text(node):
    """Text of a paragraph: its own and that of inline elements in it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(" ")
        elif not c.dropped and c.tag not in BLOCK:
            todo += reversed(c.children)
    return squeeze("".join(out))


def density(node):
    return node.linked / node.chars if node.chars else 0.0


def score(nodes, names):
    """Points of the containers; returns the best one or None."""
    scored = []
    for node in nodes:
        if node.dropped or node.tag not in BLOCK or node.tag in ("body", "html", "hr") or node.tag in HEADINGS:
            continue
        words = own_text(node)
        if len(words) < 25:
            continue
        points = 1 + words.count(",") + words.count("、") + words.count("，") + min(len(words) // 100, 3)
        if node.chars:
            points *= 1 - density(node)
        up, level = node.parent, 0
        if node.tag not in ("p", "pre", "blockquote", "li", "td", "dd"):
            up = node  # text right inside a container counts for the container
        while up is not None and up.parent is not None and level < LEVELS:
            if up.score is None:
                up.score = START.get(up.tag, 0) + _weight(names.get(up, ""))
                scored.append(up)
            up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    best, most = None, None
    for node in scored:
        value = node.score * (1 - density(node))
        if most is None or value > most:
            best, most = node, value
    return best


def kept(best, names):
    """The best container and those of its siblings that belong to it, in page order."""
    node = best
    while node.parent is not None:  # parts of one article stay together
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.parent
    if best.parent is None:
        return [best]
    least = max(10, 0.2 * (best.score or 0) * (1 - density(best)))
    out = []
    for node in best.parent.children:
        if not isinstance(node, Node) or node.dropped:
            continue
        take = node is best
        if not take and node.score is not None:
            bonus = 0.2 * (best.score or 0) if names.get(node) and names.get(node) == names.get(best) else 0
            take = node.score * (1 - density(node)) + bonus >= least
        if not take and node.tag == "p" and best.tag != "article":
            words, link = own_text(node), density(node)
            take = (len(words) > 80 and link < 0.25) or (words and link == 0 and re.search(r"[.!?。！？]( |$)", words))
        if not take and node.tag in HEADINGS and best.tag not in ("article", "main"):
            take = density(node) == 0
        if take:
            out.append(node)
    return out


def blocks(tops):
    """Texts of the blocks below some nodes, in page order, white space squeezed."""
    out, run = [], []

    def flush():
        words = squeeze("".join(run))
        run.clear()
        if words:
            out.append(words)

    todo = [x for top in reversed(tops) for x in (None, top)]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.tag == "br":
            run.append(" ")
        elif not c.dropped and c.tag not in RAW:
            if c.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(c.children)
    flush()
    return out


def main_text(page):
    """Main text of one page: blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    nodes = _ordered(parse(page))
    names = prune(nodes)
    measure(nodes)
    best = score(nodes, names)
    if best is None:  # no paragraph of any length: what is left of the page, an article first
        best = next((n for n in nodes if not n.dropped and n.tag in ("article", "main") and n.chars), None)
        return "\n".join(blocks([best or nodes[0]]))
    return "\n".join(blocks(kept(best, names)))


def extracted(df, key="page_id", html_col="html", carry=("url",)):
    """(key, carried columns, text, n_chars) of every row. Null html is an empty text."""
    cols = [key, *carry]
    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(cols)).to_pylist()]
            # Lone surrogates, which character references cannot make, would not encode.
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(cols))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*cols, "text", "n_chars"],
            )

    return df.select(*cols, F.col(html_col).alias("_html")).mapInArrow(run, schema)


def pages_query(pages):
    """op4: main text of every page."""
    return extracted(pages)
