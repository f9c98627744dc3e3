"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat text blocks. Each is described by its word count, its link density and whether it
is a heading, and by the same of the blocks before and after it; marks of the page's author (element and
class names) are no features. A decision tree, trained on the small labelled table below, tells blocks of
running text from the rest. Then the blocks vote: every element of the page sums the words the tree takes
less those it does not, and the element with the largest sum holds the article. If nearly all of its words were taken, all of
it is kept, so that short lines, lists of links and formulas inside an article stay; else each block stands for itself.
Marks have no say in this: no element counts as the article by its name, and blocks in what may be furniture (navigation, headers, footers,
menus) vote like others and stay where the tree takes them, but not for the sake of the rest; of elements with equal votes the one with less of it is chosen. Only what may read like an article's own text, which are
forms, sidebars, notices, adverts and readers' comments, is left out by its marks, and votes against what holds it. Pages
are independent, so there is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.batches import texts

#: What marks say of an element: nothing, that it may be furniture, or that it is some that may read like an article (adverts, notices, comments, sidebars, forms).
PLAIN, SUSPECT, FURNITURE = 0, 1, 2

#: Labelled blocks in page order, a line for each page. A block is its words, "/" and its linked words if it
#: has any, "h" if it is a heading; "+" marks running text of the article.
LABELLED = """
1/1 1/1 2/2 14 +9h +80/2 +3 +1 +45 20/1
1/1 3/3 30 +5h +12 +1 +2 +150 +6 35/2
1/1 1/1 1/1 1/1 8 +7h +7 +60 +34 +9 8
1/1 2/2 1/1 6 +12h +12 +100 +1 +1 +2 +41 +8 9
2/2 1/1 1/1 9 +4h +4 +2 +1 +3 6
1/1 1/1 1/1 5 +3h +3 +1 7
1/1 1/1 1/1 7 +6h +25 4
1/1 1/1 2/2 11 +10h +10 +1 12
1/1 1/1 1/1 3 +8h +8 +6 +18 +4 +5 +70 10
3/3 1/1 2/2 12 +2h +15 +2 +22 +16 3
1/1 +9h +30 +4 +66 7
1/1 1/1 +5h +5 +120 +3 +2 11/1
1/1 1/1 1/1 9 +5h +5 +106 +41 +3 +83 +44 +2 +168 +16 +64 +18 +179 +1 +118 +75 +4 +63 +2 +63 +77 +162 +6 +133 +25 11
1/1 2/2 1/1 5 +9h +65 +37 +21 +53 +15 +3 +210 +49 +6 +3 +131 +1 +1 +97 +66 +22 +5 +85 +4 10
2/2 1/1 3/3 8 +14h +31 +70 +7 +12 +3 +19 +4 +240 +58 +2 +90 +1 7
+40
+15/1
+1
+6/2
+7h +40
+5h +20 +3
3/3 +4h +90 +2
3/3 +8h +1 +70/20
2/2 +7h +30/10 +4 +12/8 +2/1 +25/22 +5 +20/20 +3 16/1
4/4 +8h +55/10 6/6 +70/4 2/2 +9/3 25/25
+10h +33 9/9 +48 +120/12 4/4 4/4 3/3 18/2
+5h +40/1 3/3 4/4 2/2 5/5 +60 7
1/1 1/1 2/2 +7h +60/1 +90 +40/3 3/3 2/2 5/4
3/3 2/2 +6h +35 +8 +52/2 +75 4/4 6/3 4
2/2 4/4 +5h +110/5 +10 +64 3 2/2 1/1
2/2 3 +30 +45 +28/4
1/1 +80/2 +85 2/2 1/1
4/4 +66 1/1 +95/3 2/2
1/1 2/2 3/3 +60 +60 +60 2/2 1/1
1/1 1/1 3/3 +35 +1 +2 +44 4/4 3/3
5/5 4/4 6/6 5/5 7/7
1/1 1/1 +6h +60 +3h +45 +80 +2h +70 +12 8/2
2/2 1/1 3/3 +9h +25 +60 +1h +60 +4h +20 +60 2/2 1/1
3/3 1/1 +1h +60 +1h +20 +60 5/2 1/1
+8h +40/3 +2h +15 +5h +90 +30 +3h +4 +65 1/1 3/3
1/1 2/2 +5h +110 +4h +6 +3 +50 +2h +25 +140 +9 2h 4/4 5/5 3/3
2/2 2/2 +7h +3h +35 +60 +2h +55 +4h +75/4 3h 8/8 7/7 2/2
1/1 1/1 9h 2/2 3/3 2/2 8h 4/4 3/3
6/6 3h 12/12 10/10 9/9 4
"""

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("head noscript template svg iframe object canvas audio video select button datalist".split())
INLINE = frozenset("math mi mn mo mrow ms mtext msup msub mfrac msqrt mover munder a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEAD_TAGS = frozenset("head title meta link style script base noscript template".split())
SUSPECT_TAGS = frozenset("nav header footer".split())
FURNITURE_TAGS = frozenset("aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block, and so are no candidates for the article.
LEAF_TAGS = HEADINGS | frozenset("address blockquote caption dd dt figcaption li p pre th".split())
#: Words of class names and ids, and roles. A name counts if it has one of these words and else only words of layout.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts alert comment comments consent cookie cookies disqus gdpr modal newsletter notice notification popup promo promotion replies reply sidebar sponsor sponsored subscribe".split()
)
SUSPECT_NAMES = frozenset("banner breadcrumb breadcrumbs copyright footer header legal login masthead menu nav navbar navigation pager pagination related search share sharing signup social teaser toolbar widget".split())
LAYOUT_NAMES = frozenset("area bar block body bottom box buttons col column container content fixed global group inner item items left link links list main outer page panel post posts primary right row section secondary site slot top unit wrap wrapper".split())
FURNITURE_ROLES = frozenset("complementary dialog form menu menubar search alert".split())
SUSPECT_ROLES = frozenset("banner contentinfo navigation".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Za-z]+")
DROP = -2


def _named(name: str) -> int:
    """What one class name or id says."""
    words = set(NAME.findall(name))
    if words <= FURNITURE_NAMES | SUSPECT_NAMES | LAYOUT_NAMES:
        return FURNITURE if words & FURNITURE_NAMES else SUSPECT if words & SUSPECT_NAMES else PLAIN
    return PLAIN


def _state(tag: str, attributes: str, around: int) -> int:
    """What holds for the text in a new element: the stronger of its own marks and those around it."""
    if around == DROP or tag in DROPPED:
        return DROP
    said = FURNITURE if tag in FURNITURE_TAGS else SUSPECT if tag in SUSPECT_TAGS else PLAIN
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return DROP
            if key == "role":
                said = max(said, FURNITURE if value in FURNITURE_ROLES else SUSPECT if value in SUSPECT_ROLES else PLAIN)
            elif key in ("class", "id") and tag not in ("body", "html"):
                said = max([said, *map(_named, value.split())])
    return max(around, said)


class Page:
    """blocks: (text, words, linked words, heading, state, element) of each text block, in page order.

    parents, states and leaves describe the elements, which are numbered as they open; 0 is the page.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, int, int, int, int, int]] = []
        self.parents, self.states, self.leaves = [0], [PLAIN], [False]
        parts: list[tuple[str, bool]] = []
        stack: list[tuple[str, int, int]] = []
        state, element, links, heading, at = PLAIN, 0, 0, 0, 0

        def close() -> None:
            if parts:
                text = " ".join("".join(p for p, _ in parts).split())
                if text and state != DROP:
                    self.blocks.append((text, text.count(" ") + 1, sum(len(p.split()) for p, linked in parts if linked), heading, state, element))
                parts.clear()

        def opened(tag: str) -> int:
            self.parents.append(element)
            self.states.append(state)
            self.leaves.append(tag in LEAF_TAGS)
            return len(self.parents) - 1

        while at < len(page):
            token = TOKEN.search(page, at)
            end = token.start() if token else len(page)
            if end > at and state != DROP:
                text = page[at:end]
                parts.append((html.unescape(text) if "&" in text else text, links > 0))
            if token is None:
                break
            at = token.end()
            tag = (token[2] or "").lower()
            if not tag:
                continue
            closing = bool(token[1])
            if tag in INLINE:
                if tag == "a":
                    links = 0 if closing else 1
                elif tag == "br":
                    parts.append((" ", False))
                continue
            close()
            if tag in RAW:
                if not closing:
                    past = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                    at = past.end() if past else len(page)
                continue
            if tag in HEADINGS:
                heading = 0 if closing else 1
            elif tag == "p":
                heading = 0
            if stack and (tag == "p" == stack[-1][0] or stack[-1][0] == "head" and tag not in HEAD_TAGS):
                _, state, element = stack.pop()
            if tag == "body" and not closing:
                stack.clear()
                element = 0
                state = _state(tag, token[3], PLAIN)
                element = opened(tag)
            elif tag in VOID or tag == "p" and (closing or not token[3]):
                continue
            elif not closing and not token[3].endswith("/"):
                stack.append((tag, state, element))
                state = _state(tag, token[3], state)
                element = opened(tag)
                links = 0
            elif closing and any(name == tag for name, *_ in stack):
                while True:
                    name, state, element = stack.pop()
                    if name == tag:
                        break
                links = 0
        close()


FEATURES = tuple(f"{name}_{where}" for where in ("before", "here", "after") for name in ("words", "density", "heading"))


def features(rows: list[tuple[int, int, int]]) -> list[tuple[float, ...]]:
    """FEATURES of each (words, linked words, heading) in page order; beyond either end there is an empty block."""
    none = (0.0, 0.0, 0.0)
    sizes = [none, *((float(w), min(1.0, n / w), float(h)) for w, n, h in rows), none]
    return [(*sizes[k], *sizes[k + 1], *sizes[k + 2]) for k in range(len(rows))]


def labelled() -> list[list[tuple[int, int, int, int]]]:
    """LABELLED as (words, linked words, heading, label) of each block of each page."""
    pages = []
    for line in LABELLED.strip().split("\n"):
        found = [re.fullmatch(r"(\+?)(\d+)(?:/(\d+))?(h?)", block) for block in line.split()]
        pages.append([(int(m[2]), int(m[3] or 0), int(m[4] == "h"), int(m[1] == "+")) for m in found])
    return pages


Tree = tuple | float


def train(spark: SparkSession, depth: int = 10) -> Tree:
    """Fit the tree on LABELLED: nested (feature, threshold, tree up to it, tree above it), with labels at the leaves."""
    table = [(Vectors.dense(x), float(row[3])) for page in labelled() for x, row in zip(features([r[:3] for r in page]), page)]
    frame = spark.createDataFrame(table, ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(frame)

    def convert(node) -> Tree:
        if node.subtreeDepth() == 0:
            return node.prediction()
        return (node.split().featureIndex(), node.split().threshold(), convert(node.leftChild()), convert(node.rightChild()))

    return convert(model._call_java("rootNode"))


def is_article(tree: Tree, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if x[feature] <= threshold else high
    return tree > 0.5


#: Share of an element's words that the tree must take for all of it to be kept.
NEARLY_ALL = 0.8


def article(page: Page, taken: list[bool]) -> list[bool]:
    """For each block, whether it is kept, from the tree's answers for the blocks."""
    n = len(page.parents)
    votes, words, yeses, suspect, count = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for block, yes in zip(page.blocks, taken):
        size, state, element = block[1], block[4], block[5]
        votes[element] += size if yes and state != FURNITURE else -size
        if state != FURNITURE:
            words[element] += size
            yeses[element] += size * yes
            suspect[element] += size * (state == SUSPECT)
        count[element] += 1
    for e in range(n - 1, 0, -1):
        for sums in (votes, words, yeses, suspect, count):
            sums[page.parents[e]] += sums[e]
    able = [e for e in range(n) if e == 0 or page.states[e] != FURNITURE and not page.leaves[e] and count[e] > 1]
    best = max(able, key=lambda e: (votes[e], -suspect[e], -e))
    inside = [False] * n
    for e in range(n):
        inside[e] = e == best or e > 0 and inside[page.parents[e]]
    whole = best > 0 and votes[best] > 0 and yeses[best] >= NEARLY_ALL * words[best]
    return [inside[e] and state != FURNITURE and (yes or whole and state != SUSPECT) for (*_, state, e), yes in zip(page.blocks, taken)]


def main_text(source: str, tree: Tree) -> str:
    page = Page(source)
    taken = [is_article(tree, x) for x in features([b[1:4] for b in page.blocks])]
    return "\n".join(b[0] for b, kept in zip(page.blocks, article(page, taken)) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks of the article joined by one line feed, empty if none) and n_chars of each row.

    Null and empty pages have an empty text. Null ids and urls stay null, and repeated rows are
    extracted like all others. Empty tables give no rows; other columns are ignored. Pages are read
    whole, unclosed elements included.
    """
    tree = train(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p, tree) for p in texts(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    done = narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
