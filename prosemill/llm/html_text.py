"""Main text of web pages by composite text density over the element tree."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._shared import slices, table

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile("[>\"']")
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
READ = ("class", "id", "role", "hidden", "style")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "script style noscript template head title nav footer aside iframe button select textarea input svg canvas object audio video dialog menu map noembed noframes".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Words of a class, id or role that name page furniture, and words that may stand beside them in such a name.
HINT_WORDS = frozenset(
    "nav navbar navigation menu menubar masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored banner promo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment "
    "comments commentlist disqus respond related recommended breadcrumb breadcrumbs pagination pager toolbar topbar complementary contentinfo "
    "paywall skiplink adsbygoogle adslot adslots adunit adbox adspace adchoices outbrain taboola doubleclick sharethis sharebar sharedaddy addthis addtoany livefyre "
    "fbcomments commentbox replies relatedposts optin popover colophon".split()
)
BESIDE = frozenset(
    "site main page global top bottom left right primary secondary header container wrapper wrap outer inner box area list block section bar item items "
    "links link group widget panel column col row module holder region unit slot posts post reader user form icons buttons text title "
    "fb x below above article after before thread threads this us now by google embed tool tools count counter friends facebook twitter whatsapp linkedin pinterest email jp wp like likes rail strip stack "
    "inline sticky floating fixed slide up in out the your and more via dfp gpt tag leaderboard rectangle skyscraper mobile desktop".split()
)
P_ENDERS = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
SCOPES = ("article", "aside", "body", "button", "caption", "div", "form", "header", "footer", "main", "nav", "object", "section", "table", "td", "th")
HEADINGS = frozenset("h1 h2 h3".split())
OUTER = frozenset(("#root", "html", "body"))
TEXT_LEVEL = INLINE | frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd blockquote".split())
#: A parent belongs to the article while its density is at least this share of its dense part's.
CLIMB = 0.5


class Tree:
    """Elements in document order: parent, tag, whether it is page furniture, whether hints say so, and text runs."""

    __slots__ = ("parent", "tag", "junk", "hint", "runs")

    def __init__(self):
        self.parent, self.tag, self.junk, self.hint = [-1], ["#root"], [False], [False]
        self.runs: list[tuple[int, str]] = []  # element, text

    def add(self, parent: int, tag: str, junk: bool, hint: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.junk.append(junk)
        self.hint.append(hint)
        return len(self.tag) - 1


class Open:
    """The open elements, with the depths at which each tag is open, so that no search walks the stack."""

    def __init__(self, tree: Tree):
        self.tree, self.stack = tree, [0]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        self.depths.setdefault(self.tree.tag[node], []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        for node in reversed(self.stack[depth:]):
            self.depths[self.tree.tag[node]].pop()
        del self.stack[depth:]

    def deepest(self, tags: tuple[str, ...]) -> int:
        """Depth of the innermost open element with one of the tags; 0 if there is none."""
        return max((d[-1] for d in map(self.depths.get, tags) if d), default=0)


def furniture_name(token: str) -> bool:
    """Whether a class, id or role names page furniture: ``sidebar``, ``site-footer``, but not ``has-sidebar`` or ``ad-free``."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", token).lower())
    return any(w in HINT_WORDS for w in words) and all(w in HINT_WORDS or w in BESIDE for w in words)


def _is_junk(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture whatever it holds, and whether its name calls it so."""
    hint = tag == "form"
    if tag in NEVER or (tag == "header" and not inside_article):
        return True, hint
    if tag in ("html", "body", "article", "main"):
        return False, hint
    folded = attrs.lower()
    if not any(name in folded for name in READ):
        return False, hint
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, hint
        if key in ("class", "id", "role"):
            tokens = value.split()
            hint = hint or any(map(furniture_name, tokens)) or (not inside_article and "header" in tokens)
    return False, hint


def tag_end(page: str, at: int) -> int:
    """End of the tag that is open at ``at``: the first > outside quoted values; -1 if there is none."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        at = m.end()
        if page[before] == "=":
            at = page.find(m[0], at) + 1
            if not at:
                break
    return -1


def parse(page: str) -> Tree:
    """A forgiving parse: implied end tags, raw-text elements, unclosed and stray tags, cut-off pages.

    An open head ends at the first text or element that cannot be in one, unless a template holds it. Once a quoted
    value has no end, that tag and all after it end at their first >. The time is linear in the page.
    """
    tree, at, size, strict = Tree(), 0, len(page), True
    opened = Open(tree)
    stack = opened.stack
    head = 0  # depth of the open one

    def end_head():
        nonlocal head
        if opened.deepest(("template",)) <= head:
            opened.cut(head)
            head = 0

    def add_text(upto: int):
        text = page[at:upto]
        if text:
            if head and not text.isspace():
                end_head()
            tree.runs.append((stack[-1], text))

    look = 0
    while (low := page.find("<", max(at, look))) >= 0:
        m = NAME.match(page, low)
        if not m:
            m = MARKUP.match(page, low)
            if m:
                add_text(low)
                at = m.end()
            else:
                look = low + 1
            continue
        add_text(low)
        name = m[2].lower()
        at = tag_end(page, m.end()) if strict else -1
        if at < 0:
            strict = False
            at = page.find(">", m.end()) + 1 or size
        attrs = page[m.end() : at].removesuffix(">")
        if m[1]:
            depth = opened.deepest((name,))
            if depth and not ((name in INLINE or name == "p") and opened.deepest(SCOPES) > depth):
                opened.cut(depth)
                head = head if head < len(stack) else 0
            continue
        if head and name not in IN_HEAD:
            end_head()
        ends, within = SAME_ENDS.get(name, (None, None))
        if ends is None and name in P_ENDERS:
            ends, within = ("p",), SCOPES
        if ends:
            floor = opened.deepest(within)
            while (depth := opened.deepest(ends)) > floor:
                opened.cut(depth)
        node = tree.add(stack[-1], name, *_is_junk(name, attrs, opened.deepest(("article", "main")) > 0))
        if name not in INLINE:
            tree.runs.append((node, ""))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            tree.runs.append((node, " "))
            continue
        if attrs.endswith("/") and name in ("svg", "path"):
            continue
        if name == "head" and not head:
            head = len(stack)
        opened.push(node)
    add_text(size)
    return tree


def settle_hints(tree: Tree, texts: list[str]) -> None:
    """Make elements with a furniture name page furniture, but for those that hold most of the page's unlinked text.

    Where there is an article or main element, only one that holds such an element is spared: long comments beside
    a short article stay comments.
    """
    if True not in tree.hint:
        return
    n = len(tree.tag)
    chars, outside, holds = [0] * n, [False] * n, [False] * n
    for (node, _), text in zip(tree.runs, texts):
        chars[node] += len(text)
    for i in range(1, n):
        outside[i] = outside[tree.parent[i]] or tree.tag[i] == "a" or tree.junk[i]
        chars[i] = 0 if outside[i] else chars[i]
    for i in range(n - 1, 0, -1):
        holds[i] |= tree.tag[i] in ("article", "main") and chars[i] > 0
        holds[tree.parent[i]] |= holds[i]
        chars[tree.parent[i]] += chars[i]
    for i in range(1, n):
        if tree.hint[i] and (2 * chars[i] <= chars[0] or holds[0] > holds[i]):
            tree.junk[i] = True


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters for each tag, adjusted for links.

    With C characters, T tags, L link characters and K link tags in a subtree, density is C/T times the
    logarithm of (C/L * T/K) to the base ln(C/(C-L) * L + Lb/Cb * C + e), where b is the whole body (``ratio``).
    """
    if not chars:
        return 0.0
    t = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + ratio * chars + math.e)
    return max(0.0, chars / t * math.log(max(1.0, chars / max(1, link_chars) * t / max(1, link_tags))) / base)


def densities(tree: Tree, texts: list[str]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Of every element: density, the sum over its children, characters, and characters inside links.

    Page furniture has no characters.
    """
    n = len(tree.tag)
    chars, links = [0] * n, [0] * n
    for (node, _), text in zip(tree.runs, texts):
        chars[node] += len(text)
    tags, anchors = [0] * n, [0] * n
    gone, linked = [False] * n, [False] * n
    for i in range(1, n):
        gone[i] = gone[tree.parent[i]] or tree.junk[i]
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
        chars[i] = 0 if gone[i] else chars[i]
        links[i] = chars[i] if linked[i] else 0
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        if not gone[i]:
            tags[up] += tags[i] + 1
            anchors[up] += anchors[i] + (tree.tag[i] == "a")
    ratio = links[0] / max(1, chars[0])
    own, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        own[i] = composite_density(chars[i], tags[i], links[i], anchors[i], ratio)
        if i:
            sums[tree.parent[i]] += own[i]
    return own, sums, chars, links


def chosen(tree: Tree, texts: list[str], drop: list[bool]) -> list[bool]:
    """Which elements belong to the article; see ``main_text``."""
    own, sums, chars, links = densities(tree, texts)
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    best = max((i for i in range(n) if not drop[i]), key=lambda i: (sums[i], own[i], -i))
    if sums[best] <= 0:
        best = 0
    path = [best]
    while path[-1] > 0:
        path.append(parent[path[-1]])
    # A paragraph is never the whole: what holds it is.
    inner = [i for i in path if tag[i] not in OUTER and tag[i] not in TEXT_LEVEL] or [i for i in path if tag[i] in OUTER][:1]
    threshold = min(own[i] for i in inner)
    top = inner[0]
    for up in inner[1:]:
        if tag[top] in ("article", "main") or own[up] < CLIMB * own[top]:
            break
        top = up
    keep = [False] * n
    keep[top] = True
    on_path = set(path)
    heads: dict[int, list[int]] = {}  # headings since the last other child of each element on the path
    for i in range(1, n):
        up = parent[i]
        if keep[up]:
            # Inside the article only blocks of links that are thinner than all of its path are left out.
            menu = 5 * links[i] > 4 * chars[i] and chars[i] > 0 and own[i] < threshold and tag[i] not in INLINE and tag[i] != "p" and tag[i] not in HEADINGS
            keep[i] = not menu
        elif up in on_path and not drop[i] and chars[i]:
            if tag[i] in HEADINGS:
                heads.setdefault(up, []).append(i)
                continue
            if i == top or (i not in on_path and own[i] >= threshold > 0 and tag[top] not in ("article", "main")):
                keep[i] = True
            if i in on_path or keep[i]:
                for h in heads.pop(up, ()):
                    keep[h] = True
            heads.pop(up, None)
    for i in range(1, n):
        if keep[parent[i]] and tag[i] in INLINE:
            keep[i] = True
        elif tag[parent[i]] in HEADINGS and keep[parent[i]]:
            keep[i] = True
    return keep


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, white space inside a block as one space, joined by line feeds.

    The element with the largest density sum, or what holds it if it is a paragraph, is the article's core. The threshold is the lowest density on the path
    from it up to the body. A parent on that path replaces the core while it is at least half as dense, up to an article
    or main element; siblings of path elements that reach the threshold belong to the article too, where no article or
    main element was reached, and so do headings right before it. Blocks of links that are thinner than the threshold are
    left out inside it; page furniture is as well, and nothing else. Null, empty and text-free pages give an empty
    text; a page without tags is one block.
    """
    tree = parse(page or "")
    texts = [" ".join(html.unescape(t).split()) if not t.isspace() else "" for _, t in tree.runs]
    settle_hints(tree, texts)
    n = len(tree.tag)
    drop = [False] * n
    for i in range(1, n):
        drop[i] = drop[tree.parent[i]] or tree.junk[i]
    keep = chosen(tree, texts, drop)
    blocks, words, block_of = [], [], None
    host = [0] * n
    for i in range(1, n):
        host[i] = host[tree.parent[i]] if tree.tag[i] in INLINE else i
    for node, text in tree.runs:
        block = host[node]
        if block != block_of:
            blocks.append("".join(words))
            words, block_of = [], block
        if keep[node] and not drop[node]:
            words.append(html.unescape(text))
    blocks.append("".join(words))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page; null html counts as empty.

    Repeated rows give a row each, equal rows equal ones; null ids and urls stay null; an empty table gives no rows; other columns are
    not read, whatever their names. Pages of any length are parsed whole, in one pass.
    """

    def batches(it):
        for batch in slices(it, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
