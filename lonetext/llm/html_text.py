"""HTML extraction: flat text blocks, classified by a decision tree on their own and their neighbours' statistics.

A page is cut into blocks at block-level tags. Each block has its words, its link density (share of words inside links),
both for the block before and after, and whether it lies in a part marked as page furniture or as the article. A
decision tree grown on the small labelled table below decides which blocks are main text.

A class or id marks furniture if it names nothing else: "comments" or "site-footer", but not "has-sidebar". An article
that lies in a part so marked, in a form or in a header is not furniture, unless it is marked itself; hidden parts,
menus, asides and footers stay furniture with all they contain.

Defined results: a NULL or empty page has the text "" with 0 characters. Markup may be broken: unclosed tags end with
their parents, stray end tags are skipped, an unfinished tag or comment at the end is dropped. White space inside a block becomes one space,
character references are decoded once, blocks follow the order of the page, one line each. Rows are treated one by one;
columns named like an output column are replaced, all others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from lonetext.llm.words import slices, texts_of

# A small labelled table, by hand: typical blocks of news pages, blogs, forums and shops.
LABELLED_COLUMNS = ("words", "links", "before_words", "before_links", "after_words", "after_links", "furniture",
                    "article", "main")
LABELLED = np.array([
    # page furniture: menus, adverts, footers, forms, notices, comments, long or short
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (3, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0), (14, 0.0, 2, 1.0, 8, 0.0, 1, 0, 0), (22, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0),
    (12, 0.2, 60, 0.0, 0, 0.0, 1, 0, 0), (30, 0.1, 90, 0.0, 0, 0.0, 1, 0, 0), (45, 0.0, 30, 0.0, 50, 0.0, 1, 0, 0),
    (80, 0.0, 40, 0.0, 60, 0.0, 1, 0, 0), (25, 0.0, 70, 0.0, 20, 0.0, 1, 1, 0), (6, 0.0, 80, 0.0, 70, 0.0, 1, 1, 0),
    (2, 1.0, 60, 0.0, 50, 0.0, 1, 1, 0), (50, 0.05, 55, 0.0, 60, 0.0, 1, 1, 0), (120, 0.0, 80, 0.0, 80, 0.0, 1, 1, 0),
    # the article: headings, paragraphs of any length, paragraphs with some links
    (8, 0.0, 12, 0.0, 60, 0.0, 0, 1, 1), (1, 0.0, 50, 0.0, 40, 0.0, 0, 1, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1),
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 1, 1), (45, 0.05, 60, 0.0, 90, 0.0, 0, 1, 1), (150, 0.0, 45, 0.0, 1, 0.0, 0, 1, 1),
    (20, 0.3, 60, 0.0, 50, 0.0, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (35, 0.4, 40, 0.1, 30, 0.0, 0, 1, 1),
    (4, 0.0, 150, 0.0, 9, 0.1, 0, 1, 1), (12, 0.0, 5, 1.0, 14, 0.0, 0, 1, 1), (400, 0.0, 9, 0.0, 0, 0.0, 0, 1, 1),
    # link lists inside an article
    (3, 1.0, 60, 0.0, 3, 1.0, 0, 1, 0), (5, 1.0, 3, 1.0, 4, 1.0, 0, 1, 0), (10, 0.9, 80, 0.0, 0, 0.0, 0, 1, 0),
    (30, 0.8, 50, 0.0, 12, 0.2, 0, 1, 0),
    # pages without marks: long blocks with few links, and short ones beside them
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 0, 1), (40, 0.05, 60, 0.0, 30, 0.1, 0, 0, 1), (18, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1),
    (25, 0.1, 4, 0.0, 70, 0.0, 0, 0, 1), (7, 0.0, 60, 0.0, 55, 0.0, 0, 0, 1), (9, 0.0, 30, 0.0, 48, 0.0, 0, 0, 1),
    (90, 0.2, 2, 1.0, 3, 1.0, 0, 0, 1), (200, 0.0, 1, 1.0, 2, 0.5, 0, 0, 1), (17, 0.0, 22, 0.0, 25, 0.0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (30, 0.05, 2, 1.0, 0, 0.0, 0, 0, 1), (26, 0.0, 0, 0.0, 4, 1.0, 0, 0, 1),
    # pages without marks: links, labels and lone short lines
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (4, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    (5, 0.0, 3, 0.0, 4, 1.0, 0, 0, 0), (8, 0.6, 2, 1.0, 3, 0.0, 0, 0, 0), (40, 0.7, 30, 0.8, 25, 0.6, 0, 0, 0),
    (10, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0), (6, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (12, 0.5, 60, 0.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0), (9, 0.0, 8, 0.4, 0, 0.0, 0, 0, 0), (11, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0),
])

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no text of the page.
RAW_TAGS = frozenset("script style template noscript iframe object svg annotation annotation-xml head title textarea select".split())
LOOSE_TAGS = frozenset("p li td th tr dt dd b i u em strong font option".split())  # often left unclosed, mark nothing
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button label fieldset".split())
ARTICLE_TAGS = frozenset(("article", "main"))
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
    "navigation menu footer header masthead sidebar aside cookie cookies consent notice alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond related recommended share sharing social breadcrumb "
    "breadcrumbs newsletter subscribe signup login pagination pager toolbar widget copyright legal disclaimer".split())
# Words that say where a part is or what shape it has.
PLACE_WORDS = frozenset(
    "site page main top bottom left right global primary secondary box bar list item section area block container "
    "wrapper body inner outer links buttons icons form div".split())
FIRM_TAGS = frozenset("nav footer aside menu dialog button label".split())
ARTICLE_ROLES = frozenset(("main", "article"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

TOKEN = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Tree:
    """A binary decision tree as flat lists; a leaf has feature -1."""
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[bool]

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> "Tree":
        """Splits by Gini impurity, midway between values; ties take the first feature and the lowest threshold."""
        tree = Tree([], [], [], [], [])

        def node(rows: np.ndarray, level: int) -> int:
            at = len(tree.feature)
            tree.feature.append(-1)
            tree.threshold.append(0.0)
            tree.left.append(-1)
            tree.right.append(-1)
            tree.value.append(bool(y[rows].mean() >= 0.5))
            best = (1e-9, -1, 0.0)
            if level < depth and 0 < y[rows].sum() < len(rows):
                gini = lambda p: p * (1 - p)
                for f in range(x.shape[1]):
                    values = np.unique(x[rows, f])
                    for cut in (values[1:] + values[:-1]) / 2:
                        low = x[rows, f] <= cut
                        share = low.mean()
                        if min(low.sum(), (~low).sum()) < least:
                            continue
                        gain = gini(y[rows].mean()) - share * gini(y[rows[low]].mean()) - (1 - share) * gini(
                            y[rows[~low]].mean())
                        if gain > best[0] + 1e-12:
                            best = (gain, f, float(cut))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                tree.feature[at], tree.threshold[at] = best[1], best[2]
                tree.left[at] = node(rows[low], level + 1)
                tree.right[at] = node(rows[~low], level + 1)
            return at

        node(np.arange(len(x)), 0)
        return tree

    def decide(self, row: Sequence[float]) -> bool:
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if row[self.feature[at]] <= self.threshold[at] else self.right[at]
        return self.value[at]


def trained(labelled: np.ndarray = LABELLED) -> Tree:
    return Tree.grow(labelled[:, :-1], labelled[:, -1])


def _names_furniture(token: str) -> bool:
    words = WORD.findall(token)
    return not FURNITURE_WORDS.isdisjoint(words) and all(w in FURNITURE_WORDS or w in PLACE_WORDS for w in words)


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether a tag opens page furniture, whether an article in it is furniture too, and whether it opens the article."""
    furniture, article = tag in FURNITURE_TAGS or tag == "header" and not in_article, tag in ARTICLE_TAGS
    firm = tag in FIRM_TAGS
    if attributes:
        values: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            quoted = value[:1] in ("'", '"') and value[:1] == value[-1:]
            values.setdefault(name.lower(), (value[1:-1] if quoted else value).lower())  # the first of a name counts
        if values.get("hidden", "false") != "false" or values.get("aria-hidden") == "true":
            furniture = firm = True
        role = values.get("role", "").strip()
        furniture, article = furniture or role in FURNITURE_ROLES, article or role in ARTICLE_ROLES
        if tag not in ("body", "html"):
            tokens = f"{values.get('class', '')} {values.get('id', '')}".split()
            furniture = furniture or any(_names_furniture(t) for t in tokens)
    return furniture, firm, article


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """(text, words, link density, furniture, article) of every block with text, in the order of the page."""
    result: list[tuple[str, int, float, bool, bool]] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, bool]] = []
    soft = firm = article = links = 0  # marks of furniture that an article in it undoes, and others

    def flush() -> None:
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                n = text.count(" ") + 1
                inside = min(n, len(unescape(" ".join(linked)).split()))
                result.append((text, n, inside / n, soft + firm > 0, article > 0))
            pieces.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if links:
                linked.append(text)

    at = 0
    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            rest = page[at:]
            cut = re.search(r"<[/!?A-Za-z]", rest)  # an unfinished tag is dropped
            add(rest if cut is None else rest[:cut.start()])
            break
        add(page[at:found.start()])
        at = found.end()
        if found[2] is None:
            if found[0] == "<!--":
                end = page.find("-->", at)
                at = size if end < 0 else end + 3
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            if any(tag == open_tag for open_tag, *_ in stack):
                flush()
                while True:
                    open_tag, s, f, a = stack.pop()
                    soft, firm, article, links = soft - s, firm - f, article - a, links - (open_tag == "a")
                    if open_tag == tag:
                        break
        elif tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = size
        elif tag not in VOID_TAGS and not found[3].rstrip().endswith("/"):
            marked, f, a = _marks(tag, found[3], article > 0)
            if tag not in LOOSE_TAGS or marked or a:
                if marked or a:
                    flush()
                s = int(marked and not f)
                if a and not marked and not article:
                    s = -soft
                stack.append((tag, s, int(marked and f), a))
                soft, firm, article, links = soft + s, firm + (marked and f), article + a, links + (tag == "a")
    flush()
    return result


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    kept = []
    for i, (text, n, density, furniture, article) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if tree.decide((n, density, *before, *after, furniture, article)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """`pages` without the html, with text and n_chars (code points)."""
    tree = tree or trained()
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()),
                                                              T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p, tree) for p in texts_of(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in names]
                    + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*names, "text", "n_chars"])

    return pages.select(*names, "html").mapInArrow(run, schema)
