"""Main text of web pages from flat text blocks.

A page is cut at block-level tags into flat blocks of text.  Each block is
described by its word count and link density, those of the blocks before and
after it, whether an article encloses it, and how surely something else does (a
class name such as "share" says little, a footer much).  One decision tree,
grown from the small labelled table below, says whether it belongs to the main
text.  A wrapper that is marked as something else but encloses the page's
article (a form around the page, a layout named after its sidebar) doesn't count
as something else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements whose tags end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements whose content is no markup, or is never shown as text.
RAW_TAGS = frozenset("iframe math noembed noframes noscript object script select style svg template textarea title xmp".split())
#: Those of them that last to the end of the page if nothing closes them; of others then only the tag goes.
ENDLESS_TAGS = frozenset("script style textarea title xmp".split())
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold what isn't the article.
BOILER_TAGS = frozenset("aside button dialog footer form menu nav".split())
#: Elements that hold the article.
CONTENT_TAGS = frozenset("article main".split())
#: Words in class, id and role of what isn't the article.
BOILER_NAMES = frozenset("alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright dialog footer gdpr login masthead menu menubar modal nav navbar navigation overlay pager paginate pagination popup sidebar sitemap skip toolbar".split())
#: Such words that articles' wrappers bear as well; words and links say more.
VAGUE_NAMES = frozenset("ad ads advert advertisement adverts form legal newsletter notice notices privacy promo promoted promotion reader recommended recommendations related search share sharing signup skyscraper social sponsor sponsored subscribe subscription tags widget widgets".split())
#: Words of readers' replies.
REPLY_NAMES = frozenset("comment commentlist comments discussion disqus replies reply respond responses shoutbox".split())
#: First words of names that say what else the page has.
ABOUT_OTHERS = frozenset("has is no with without".split())
#: Words in class, id and role that mark the article.
CONTENT_NAMES = frozenset("article blogpost content entry main post story".split())

#: Open elements that a start tag closes, where they stand innermost.
IMPLIED_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""")
_NAME = re.compile(r"[a-z]+")

#: The labelled table: words and link density of a block, of the one before and
#: of the one after, whether it stands in an article (-1: outside of those that
#: the page has), how surely in something that is none, and whether it is main text.
LABELLED = """
words density before before_density after after_density article other main
30    0.10    45     0.00           20    0.00          1       2     0
4     1.00    50     0.00           60    0.00          1       2     0
15    0.00    30     0.00           30    0.00          1       2     0
80    0.00    60     0.00           20    0.00          1       2     0
1     0.00    12     0.00           9     0.00          1       2     0
1     1.00    0      0.00           1     1.00          0       2     0
1     1.00    1      1.00           1     1.00          0       2     0
2     1.00    1      1.00           12    0.00          0       2     0
6     0.00    0      0.00           1     1.00          0       2     0
12    0.00    1      1.00           8     0.00          0       2     0
25    0.00    3      1.00           40    0.00          0       2     0
60    0.00    80     0.00           10    0.00          0       2     0
14    0.00    70     0.00           0     0.00          0       2     0
120   0.02    60     0.00           5     0.00          0       2     0
3     0.00    90     0.00           0     0.00          0       2     0
4     0.00    50     0.00           60    0.00          1       1     0
15    0.00    30     0.00           30    0.00          1       1     0
30    0.10    45     0.00           20    0.00          1       1     0
5     0.00    5      0.00           5     0.00          1       1     0
6     1.00    60     0.00           50    0.00          1       1     0
60    0.00    50     0.00           70    0.00          1       1     1
60    0.00    60     0.00           4     0.00          1       1     1
45    0.00    60     0.00           40    0.00          1       1     1
80    0.00    60     0.00           20    0.00          1       1     1
50    0.05    20     0.00           45    0.00          1       1     1
10    0.00    1      1.00           10    0.00          0       1     0
10    0.00    10     0.00           60    0.00          0       1     0
12    0.00    60     0.00           0     0.00          0       1     0
30    0.00    5      0.00           10    0.00          0       1     0
20    0.00    60     0.00           50    0.00          0       1     0
60    0.00    3      0.00           4     0.00          0       1     0
60    0.80    50     0.80           70    0.70          0       1     0
5     1.00    5      1.00           5     1.00          0       1     0
60    0.00    0      0.00           0     0.00          0       1     1
60    0.00    70     0.00           50    0.00          0       1     1
50    0.00    60     0.00           0     0.00          0       1     1
80    0.05    3      0.00           60    0.00          0       1     1
45    0.00    0      0.00           55    0.00          0       1     1
60    0.00    60     0.00           4     0.00          0       1     1
60    0.00    70     0.00           50    0.00          -1      1     0
12    0.00    60     0.00           2     1.00          -1      1     0
90    0.00    60     0.00           80    0.00          -1      1     0
8     1.00    9      1.00           7     1.00          1       0     0
12    1.00    11     1.00           10    1.00          1       0     0
6     1.00    7      1.00           8     1.00          1       0     0
9     1.00    2      0.00           8     1.00          1       0     0
7     1.00    10     1.00           40    0.00          1       0     0
10    1.00    60     0.00           10    1.00          1       0     0
8     1.00    25     0.00           9     1.00          1       0     0
5     0.00    12     0.00           5     0.00          1       0     1
1     0.00    40     0.00           35    0.00          1       0     1
2     0.00    0      0.00           8     0.00          1       0     1
9     0.00    12     0.00           1     0.00          1       0     1
40    0.00    5      0.00           60    0.00          1       0     1
200   0.05    40     0.00           90    0.00          1       0     1
35    0.30    60     0.00           14    0.00          1       0     1
3     0.00    1      1.00           3     0.00          1       0     1
7     0.00    20     0.00           14    0.00          1       0     1
2     1.00    30     0.00           30    0.00          1       0     1
90    0.00    1      0.00           16    0.00          1       0     1
8     0.50    70     0.00           12    0.00          1       0     1
12    0.00    40     0.00           3     1.00          1       0     1
30    0.00    20     0.00           1     1.00          1       0     1
4     0.00    0      0.00           2     1.00          1       0     1
1     0.00    5      1.00           1     1.00          1       0     1
60    0.20    1      1.00           2     1.00          1       0     1
3     1.00    2      1.00           2     1.00          1       0     1
18    0.80    4      0.60           6     0.90          1       0     1
2     1.00    2      1.00           2     1.00          1       0     1
1     1.00    2      1.00           1     1.00          1       0     1
9     1.00    60     0.00           50    0.00          1       0     1
6     1.00    20     0.00           35    0.00          1       0     1
14    1.00    45     0.00           30    0.05          1       0     1
40    0.00    50     0.00           9     1.00          1       0     1
3     0.00    40     0.00           8     1.00          1       0     1
25    0.00    8      1.00           30    0.00          1       0     1
80    0.10    12     1.00           10    1.00          1       0     1
5     0.00    9      1.00           11    1.00          1       0     1
8     0.00    7      1.00           60    0.00          1       0     1
2     0.00    10     1.00           9     1.00          1       0     1
30    0.30    8      1.00           12    1.00          1       0     1
15    0.00    90     0.00           12    1.00          1       0     1
120   0.05    10     1.00           50    0.00          1       0     1
4     0.00    0      0.00           0     0.00          1       0     1
1     0.00    0      0.00           0     0.00          1       0     1
30    0.00    0      0.00           0     0.00          1       0     1
5     0.00    20     0.00           0     0.00          1       0     1
12    0.00    60     0.00           0     0.00          1       0     1
8     0.00    5      0.00           0     0.00          1       0     1
14    0.00    2      0.00           0     0.00          1       0     1
2     0.00    1      0.00           0     0.00          1       0     1
10    0.00    1      1.00           10    0.00          1       0     1
4     0.00    1      1.00           9     0.00          1       0     1
12    0.00    1      1.00           28    0.00          1       0     1
4     0.00    1      1.00           2     1.00          0       0     0
2     1.00    3      1.00           2     1.00          0       0     0
5     1.00    40     0.00           5     1.00          0       0     0
9     0.90    10     0.80           8     0.90          0       0     0
20    0.80    12     0.90           25    0.70          0       0     0
3     0.00    2      1.00           1     1.00          0       0     0
1     1.00    0      0.00           1     1.00          0       0     0
40    0.70    30     0.80           35    0.75          0       0     0
6     0.60    2      1.00           4     0.00          0       0     0
4     0.00    0      0.00           3     1.00          0       0     0
9     0.00    1      1.00           20    0.00          0       0     0
5     0.00    1      1.00           15    0.00          0       0     0
12    0.00    1      1.00           28    0.00          0       0     0
12    0.00    1      0.00           0     0.00          0       0     0
16    0.00    3      0.00           0     0.00          0       0     0
9     0.00    2      0.00           0     0.00          0       0     0
10    0.00    1      1.00           10    0.00          0       0     0
4     0.00    1      1.00           9     0.00          0       0     0
13    0.00    1      1.00           4     0.00          0       0     0
8     0.00    1      1.00           12    0.00          0       0     0
12    0.00    60     0.00           0     0.00          0       0     0
8     0.00    5      0.00           0     0.00          0       0     0
16    0.00    100    0.00           0     0.00          0       0     0
7     0.00    20     0.00           0     0.00          0       0     0
45    0.00    60     0.00           50    0.00          0       0     1
30    0.05    12     0.00           55    0.00          0       0     1
120   0.00    4      0.00           80    0.02          0       0     1
60    0.10    90     0.00           3     1.00          0       0     1
25    0.00    40     0.00           35    0.00          0       0     1
12    0.00    50     0.00           70    0.00          0       0     1
8     0.00    60     0.00           90    0.00          0       0     1
6     0.00    3      0.00           40    0.00          0       0     1
22    0.00    8      0.00           10    0.00          0       0     1
2     0.00    2      0.00           2     0.00          0       0     1
6     0.00    6      0.00           3     0.00          0       0     1
16    0.00    258    0.00           72    0.00          0       0     1
61    0.00    5      0.00           8     0.00          0       0     1
23    0.00    166    0.00           24    0.00          0       0     1
1     0.00    87     0.00           35    0.00          0       0     1
9     0.00    222    0.00           41    0.00          0       0     1
17    0.00    4      0.00           5     0.00          0       0     1
79    0.00    4      0.00           1     0.00          0       0     1
680   0.00    6      0.00           9     0.00          0       0     1
1     0.00    5      0.00           1     0.00          0       0     1
11    0.00    60     0.00           26    0.00          0       0     1
5     0.00    81     0.00           52    0.00          0       0     1
10    0.00    2      0.00           12    0.00          0       0     1
100   0.00    1      0.00           18    0.00          0       0     1
1     0.00    0      0.00           60    0.00          0       0     1
9     0.00    0      0.00           45    0.00          0       0     1
60    0.00    0      0.00           60    0.00          0       0     1
30    0.00    0      0.00           15    0.00          0       0     1
120   0.00    60     0.00           0     0.00          0       0     1
90    0.00    0      0.00           0     0.00          0       0     1
200   0.00    4      0.00           0     0.00          0       0     1
56    0.00    3      0.00           31    0.00          0       0     1
80    0.00    2      0.00           8     0.00          0       0     1
5     0.00    1      0.00           11    0.00          0       0     1
7     0.00    3      0.00           13    0.00          0       0     1
11    0.00    1      1.00           60    0.00          0       0     1
9     0.00    2      1.00           45    0.00          0       0     1
10    0.00    10     0.00           60    0.00          0       0     1
10    0.00    11     0.00           9     0.00          0       0     1
4     0.00    5      0.00           20    0.00          0       0     1
12    0.00    4      0.00           15    0.00          0       0     1
6     0.00    30     0.00           12    0.00          0       0     1
5     0.00    60     0.00           9     0.00          0       0     1
14    0.00    80     0.00           10    0.00          0       0     1
10    0.00    12     0.00           8     0.00          0       0     1
26    0.00    30     0.00           0     0.00          0       0     1
60    0.00    70     0.00           0     0.00          0       0     1
30    0.00    0      0.00           0     0.00          0       0     1
1     0.00    30     0.00           0     0.00          -1      0     0
12    0.00    40     0.00           2     1.00          -1      0     0
8     0.00    70     0.00           80    0.00          -1      0     0
20    0.00    60     0.00           50    0.00          -1      0     0
5     1.00    6      1.00           5     1.00          -1      0     0
3     0.00    5      1.00           9     1.00          -1      0     0
9     1.00    60     0.00           50    0.00          -1      0     0
60    0.80    50     0.70           70    0.75          -1      0     0
60    0.90    60     0.00           70    0.00          -1      0     0
60    0.00    3      0.00           1     1.00          -1      0     0
80    0.00    3      1.00           2     1.00          -1      0     0
60    0.00    3      0.00           5     0.00          -1      0     0
90    0.00    1      0.00           0     0.00          -1      0     0
50    0.00    12     0.00           9     0.00          -1      0     0
60    0.00    0      0.00           8     0.00          -1      0     0
70    0.00    60     0.00           80    0.00          -1      0     1
90    0.05    80     0.00           45    0.00          -1      0     1
50    0.00    70     0.00           65    0.00          -1      0     1
60    0.02    45     0.00           90    0.00          -1      0     1
60    0.00    65     0.00           2     1.00          -1      0     1
55    0.00    50     0.00           4     0.00          -1      0     1
80    0.00    40     0.00           1     0.00          -1      0     1
70    0.00    2      1.00           60    0.00          -1      0     1
60    0.00    1      0.00           75    0.05          -1      0     1
50    0.00    5      0.00           50    0.00          -1      0     1
60    0.00    70     0.00           0     0.00          -1      0     1
80    0.00    50     0.00           0     0.00          -1      0     1
"""


@dataclass
class Block:
    """A flat block: its text, words, words in links, and what encloses it."""

    text: str
    words: int
    link_words: int
    article: bool
    other: int  # 0 not, 1 by a class name that says little, 2 something else than the article


@dataclass
class Scope:
    """A marked open element, and those around it: what it starts, and whether it is something else."""

    outer: Scope | None = field(default=None, repr=False)
    tag: str = ""
    article: bool = False
    ends: int = 0
    other: int = 0
    barred: bool = False  # nothing in it can be the page's article
    body: Scope | None = field(default=None, repr=False)  # the outermost article within the innermost something else
    words: int = 0  # outside of links, if a body
    all_words: int = 0  # outside of links


@dataclass
class Node:
    """A decision: of a feature, at most a threshold or above; a leaf has only a label."""

    label: int
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = field(default=None, repr=False)
    high: Node | None = field(default=None, repr=False)


def grow(rows: list[tuple[list[float], int]], least: int = 1) -> Node:
    """A binary tree by the largest fall of Gini impurity; the first best split wins."""
    ones = sum(y for _, y in rows)
    node = Node(int(2 * ones >= len(rows)))
    if ones in (0, len(rows)):
        return node

    def gini(part: list[tuple[list[float], int]]) -> float:
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = gini(rows) - 1e-9
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            low, high = [r for r in rows if r[0][f] <= (a + b) / 2], [r for r in rows if r[0][f] > (a + b) / 2]
            if min(len(low), len(high)) >= least and (g := gini(low) + gini(high)) < best - 1e-12:
                best, node.feature, node.threshold, node.low, node.high = g, f, (a + b) / 2, low, high
    if node.feature >= 0:
        node.low, node.high = grow(node.low, least), grow(node.high, least)
    return node


@lru_cache(1)
def tree() -> Node:
    """What the table says."""
    rows = [list(map(float, line.split())) for line in LABELLED.strip().split("\n")[1:]]
    return grow([(features, int(label)) for *features, label in rows])


def decided(features: list[float]) -> tuple[int, list[int]]:
    """(label, the features asked for) of a block."""
    node, asked = tree(), []
    while node.feature >= 0:
        asked.append(node.feature)
        node = node.low if features[node.feature] <= node.threshold else node.high
    return node.label, asked


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """(holds an article, how surely something else, and no article of the page either) of a start tag."""
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            own = _NAME.findall(token)
            if own and own[0] not in ABOUT_OTHERS:
                names.update(own)
    article = tag in CONTENT_TAGS or bool(names & CONTENT_NAMES)
    page = tag in ("html", "body")
    hidden = not page and bool(_HIDDEN.search(attributes))  # a hidden page is shown later
    free = page or tag in CONTENT_TAGS
    replies = not free and bool(names & REPLY_NAMES)
    other = 2 if tag in BOILER_TAGS or hidden or replies or not free and names & BOILER_NAMES else int(not free and bool(names & VAGUE_NAMES))
    return article and not other, other, hidden or replies


def _inside(outer: Scope, tag: str, starts: bool, ends: int, barred: bool) -> Scope:
    new = Scope(outer, tag, outer.article or starts, ends, max(outer.other, ends), outer.barred or barred, outer.body)
    if ends:
        new.body = new if tag == "form" else None
    elif tag in CONTENT_TAGS and (new.body is None or new.body.tag == "form"):
        new.body = new
    return new


def _judge(found: list[Block], held: list[Scope], scopes: list[Scope]) -> None:
    """What counts as something else, after a change."""
    for x in scopes:  # outer ones first
        x.other = max(x.ends, x.outer.other if x.outer else 0)
    for b, scope in zip(found, held, strict=True):
        b.other = scope.other


def _free_most(found: list[Block], held: list[Scope], scopes: list[Scope]) -> None:
    """A vague name says nothing of what holds most of the page's words outside of links."""
    for b, scope in zip(found, held, strict=True):
        scope.all_words += b.words - b.link_words
    for x in reversed(scopes):
        if x.outer:
            x.outer.all_words += x.all_words
    for x in scopes:
        if x.ends == 1 and 2 * x.all_words > scopes[0].all_words:
            x.ends = 0
    _judge(found, held, scopes)


def _free_article(found: list[Block], held: list[Scope], scopes: list[Scope]) -> None:
    """Wrappers of the page's article no longer count as something else.

    Its article is the <article> or <main> with the most words outside of links,
    or without any the form, if that holds more than what stands in no wrapper
    (of which, if there is one, only the article counts).
    """
    strict = plain = 0
    for b, scope in zip(found, held, strict=True):
        own = b.words - b.link_words
        if scope.body:
            scope.body.words += own
        if not b.other:
            plain += own
            strict += own if b.article else 0
    bodies = [x for x in scopes if x.body is x]
    inner = [x for x in bodies if x.tag in CONTENT_TAGS]
    bodies = [x for x in inner or bodies if x.other and not x.barred]
    best = max(bodies, key=lambda x: x.words, default=None)
    if best is None or best.words <= (strict or plain):
        return
    around, at = [], best
    while at is not None:
        if at.ends:
            around.append(at)
        at = at.outer
    if strict and (best.tag == "form" or any(x.tag in BOILER_TAGS and x.tag != "form" for x in around)):
        return
    for x in around:
        x.ends = 0
    _judge(found, held, scopes)


def blocks(html: str) -> list[Block]:
    """The page's flat blocks, in order; empty ones are left out."""
    out: list[Block] = []
    held: list[Scope] = []  # of each block
    parts: list[str] = []
    linked: list[str] = []
    root = scope = Scope()
    scopes = [root]
    stack: list[tuple[str, Scope]] = []  # open elements: name, and the innermost marked one
    opened: dict[str, int] = {}  # how many of each name
    links = pos = 0
    end = len(html)

    def close() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(len(words), len("".join(linked).split())), scope.article, scope.other))
                held.append(scope)
            parts.clear()
            linked.clear()

    def leave(depth: int) -> None:
        nonlocal scope
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]
        scope = stack[-1][1] if stack else root

    match = _TOKEN.match
    while pos < end:
        m = match(html, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or len(raw) == 1:
                text = unescape(raw) if "&" in raw else raw
                parts.append(text)
                if links:
                    linked.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                close()
            if tag == "a":
                links = max(0, links - 1)
                linked.append(" ")
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                leave(depth)
            continue
        if tag in BLOCK_TAGS:
            close()
            links = 0
            ends_here = IMPLIED_ENDS.get(tag, {"p"})
            while stack and stack[-1][0] in ends_here:
                leave(len(stack) - 1)
        if tag == "br":
            parts.append(" ")
            if links:
                linked.append(" ")
        if tag in RAW_TAGS:
            if not m[3].endswith("/") or tag in ("script", "style"):
                stop = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])[^>]*>?").search(html, pos)
                pos = stop.end() if stop else end if tag in ENDLESS_TAGS else pos
            continue
        if tag in VOID_TAGS:
            continue
        if tag == "a":
            links += 1
        elif tag in BLOCK_TAGS and tag != "p" or tag == "span" or tag == "p" and m[3]:
            starts, ends, barred = _marks(tag, m[3])
            if tag == "header":
                ends = ends if scope.article else 2  # of the page, not of the article
            if starts or ends or tag not in ("p", "span"):
                if starts or ends:
                    scope = _inside(scope, tag, starts, ends, barred)
                    scopes.append(scope)
                stack.append((tag, scope))
                opened[tag] = opened.get(tag, 0) + 1
    close()
    _free_most(out, held, scopes)
    _free_article(out, held, scopes)
    return out


def described(found: list[Block]) -> Iterator[list[float]]:
    """The features of each block, in the table's order."""
    outside = -float(any(b.article and not b.other for b in found))
    sizes = [(float(b.words), b.link_words / b.words) for b in found]
    edge = (0.0, 0.0)
    for i, b in enumerate(found):
        before, after = sizes[i - 1] if i else edge, sizes[i + 1] if i + 1 < len(found) else edge
        yield [*sizes[i], *before, *after, 1.0 if b.article else outside, float(b.other)]


def main_text(html: str) -> str:
    """The main text's blocks, joined by an empty line."""
    found = blocks(html)
    return "\n\n".join(b.text for b, x in zip(found, described(found), strict=True) if decided(x)[0])


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of pages (page_id, url, html), one for each row.

    ``text``: the main text of the whole page, its character references decoded,
    white space within a block as one space, blocks joined by two line feeds in
    page order; empty if there is none or ``html`` is null.  ``n_chars`` counts
    its code points.  Null ids and urls stay null; pages may be of any length
    and need not be well-formed; repeated rows give repeated rows; further
    columns are ignored.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
