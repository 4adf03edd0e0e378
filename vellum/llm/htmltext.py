"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (what stands between two block-level tags).  Each
block is described by its number of words and its link density, those of its two
neighbours, and by what encloses it (furniture such as menus, forms or comments; an article;
a heading).  A decision tree, fitted by Spark ML on the blocks of the small labelled pages of
``examples``, says which blocks belong to the article; they are joined in page order.

Scale: one pass over the pages, no shuffle.  Pages are cut into blocks in Arrow batches, in
time that grows with a page's length; the tree is a CASE expression over the array of blocks.

Defined cases: null and empty pages give the empty text, as do pages without an article;
equal rows are extracted each; further columns are not read.  White space (Unicode's) inside
a block is one space.  Character references are decoded once.  A tag that the end of the page
cuts off is dropped; unclosed elements end with the element around them; what is hidden
(``hidden``, ``display:none``) counts as markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vellum.llm.examples import KEEP, PAGES

type Tree = bool | tuple[int, float, Tree, Tree]

#: Comment or declaration, or tag with its name and attributes; quoted values may hold anything.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W_]", re.UNICODE)

#: Elements whose content is never text of the page.
_SKIPPED = frozenset("script style template svg math iframe object embed canvas audio video noscript noframes head title select datalist option button textarea map".split())
#: Elements whose content is text to the parser, up to the end tag.
_RAW = frozenset("script style textarea title iframe noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text: they end no block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of an element closes when it is still open.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tbody thead body div section article aside nav main blockquote form".split())

#: Elements and roles that hold a page's furniture.
_FURNITURE = frozenset("nav footer aside form menu dialog fieldset address search".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note".split())
#: Words in class names and ids that tell of furniture.
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion teaser nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "sidebar aside rail widget widgets footer foot masthead topbar toolbar banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login "
    "popup modal overlay toast share sharing social related recommended recommendations trending popular comment comments commentlist disqus discussion respond reply replies feedback "
    "copyright disclaimer legal skip search paywall".split()
)
_HEADER_WORDS = frozenset("header head".split())
#: Words in class names and ids that tell of an article.
_ARTICLE_WORDS = frozenset("article articlebody story post entry content maincontent body text prose".split())
#: A class that begins so says what a page has not, or has elsewhere.
_DENIED = frozenset("no not non has with without hide is".split())
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FURNITURE, ARTICLE, HEADING = "furniture", "article", "heading"
#: Weight of a labelled block that an element marks as furniture or article: such blocks are rarer in the examples than on the web.
MARKED = 8
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", FURNITURE, ARTICLE, HEADING)


def _hints(names: str) -> set[str]:
    found: set[str] = set()
    for name in names.split():
        parts = [p.lower() for p in _SPLIT.findall(name)]
        if parts and parts[0] not in _DENIED:
            found.update(parts)
    return found


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, furniture, an article."""
    given = {m[0].lower(): next((v for v in m[1:] if v), "") for m in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    hidden = tag in _SKIPPED or "hidden" in given or bool(_HIDDEN.search(given.get("style", "")))
    role = given.get("role", "").lower()
    words = _hints(html.unescape(f"{given.get('class', '')} {given.get('id', '')}")) if tag not in ("html", "body") else set()
    article = tag in ("article", "main") or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody" or bool(words & _ARTICLE_WORDS)
    furniture = tag in _FURNITURE or role in _FURNITURE_ROLES or (tag != "main" and bool(words & _FURNITURE_WORDS))
    if not in_article and not article:
        furniture = furniture or tag == "header" or bool(words & _HEADER_WORDS)
    return hidden, furniture, article and not furniture


class _Page:
    """The open block elements of a page, and the text of the block that is being read."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, float, bool, bool, bool]] = []
        self.opened: list[tuple[str, bool, bool, bool]] = []  # name, hidden, in furniture, in an article
        self.texts: list[str] = []
        self.linked: list[str] = []
        self.in_link = False

    @property
    def inside(self) -> tuple[str, bool, bool, bool]:
        return self.opened[-1] if self.opened else ("", False, False, False)

    def text(self, text: str) -> None:
        if text and not self.inside[1]:
            self.texts.append(text)
            if self.in_link:
                self.linked.append(text)

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.texts)).split())
        if text:
            _, _, furniture, article = self.inside
            words = sum(1 for w in text.split(" ") if _WORD.search(w))
            links = sum(1 for w in html.unescape(" ".join(self.linked)).split() if _WORD.search(w))
            density = min(1.0, links / words) if words else float(bool(self.linked))
            self.blocks.append((text, words, density, furniture, article, any(e[0] in _HEADINGS for e in self.opened[-3:])))
        self.texts.clear()
        self.linked.clear()

    def close(self, names: set[str] | frozenset[str], scopes: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of one of ``names`` and what is open in it, but nothing beyond a scope."""
        for i in range(len(self.opened) - 1, -1, -1):
            if self.opened[i][0] in names:
                del self.opened[i:]
                self.in_link = False
                return
            if self.opened[i][0] in scopes:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag == "body":
            self.opened.clear()
        self.close(_CLOSES.get(tag, {"p"}), _SCOPES)
        _, hidden, furniture, article = self.inside
        own = _kind(tag, attributes, article)
        self.opened.append((tag, hidden or own[0], furniture or own[1], article or own[2]))


def _after(page: str, tag: str, at: int) -> int:
    """Where the element ``tag`` ends whose content begins at ``at``: elements of its name may lie in it, unless it is raw."""
    depth = 1
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*(?:>|\Z)", page[at:] if tag not in _RAW else "", re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return at + m.end()
    if tag in _RAW:
        m = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
        return m.end() if m else len(page)
    return len(page)


def flat_blocks(page: str | None) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, link density, in furniture, in an article, heading) of a page's text blocks, in order."""
    read = _Page()
    at, page = 0, page or ""
    while at < len(page):
        m = _TAG.search(page, at)
        read.text(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in _RAW and not closing:
            at = _after(page, tag, at)
        elif tag == "br":
            read.text(" ")
        elif tag in _INLINE:
            if tag == "a":
                read.in_link = not closing
            if attributes and not closing and tag not in _VOID and _kind(tag, attributes, False)[0]:
                at = _after(page, tag, at)
                read.in_link = read.in_link and tag != "a"
        else:
            read.end_block()
            if closing:
                read.close({tag})
            elif tag not in _VOID and not (tag in _SKIPPED and attributes.endswith("/")):
                read.open(tag, attributes)
    read.end_block()
    return read.blocks


def described(blocks: list[tuple[str, int, float, bool, bool, bool]]) -> list[tuple[str, list[float]]]:
    """(text, features) of a page's blocks; outside the page stand blocks without words."""
    out = []
    for i, (text, words, density, furniture, article, heading) in enumerate(blocks):
        before = blocks[i - 1] if i else ("", 0, 0.0)
        after = blocks[i + 1] if i + 1 < len(blocks) else ("", 0, 0.0)
        out.append((text, [float(v) for v in (words, density, before[1], before[2], after[1], after[2], furniture, article, heading)]))
    return out


_BLOCKS = "array<struct<text string, f array<double>>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("f", pa.list_(pa.float64()))]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The struct of a row and the blocks of its page, some pages at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, 128):
            batch = whole.slice(i, 128)
            blocks = [[{"text": t, "f": f} for t, f in described(flat_blocks(p))] for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, _ARROW)], ["row", "blocks"])


def labelled_blocks(spark: SparkSession, pages: Sequence[str] = PAGES) -> DataFrame:
    """(text, f, label) of the blocks of labelled pages; a block that belongs to the article begins with ``KEEP``."""
    rows = [(text.removeprefix(KEEP), f, float(text.startswith(KEEP))) for page in pages for text, f in described(flat_blocks(page))]
    return spark.createDataFrame(rows, "text string, f array<double>, label double")


def fit(labelled: DataFrame, depth: int = 6) -> Tree:
    """The decision tree of labelled blocks: a leaf says whether to keep, a node is (feature, threshold, tree up to it, tree beyond)."""
    marked = F.greatest(F.get("f", F.lit(FEATURES.index(FURNITURE))), F.get("f", F.lit(FEATURES.index(ARTICLE))))
    rows = labelled.select(array_to_vector("f").alias("v"), "label", F.when(marked > 0, float(MARKED)).otherwise(1.0).alias("weight"))
    model = DecisionTreeClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxDepth=depth, maxBins=64, seed=1).fit(rows)

    def told(node) -> Tree:
        if not node.subtreeDepth():
            return bool(node.prediction())
        return node.split().featureIndex(), node.split().threshold(), told(node.leftChild()), told(node.rightChild())

    return told(model._java_obj.rootNode())


def kept(tree: Tree, f: Column) -> Column:
    """Whether the tree keeps a block with the features ``f``."""
    if isinstance(tree, bool):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(F.get(f, F.lit(feature)) <= threshold, kept(low, f)).otherwise(kept(high, f))


def main_text(pages: DataFrame, tree: Tree, html_col: str = "html") -> DataFrame:
    """``row``, a struct of all columns but the page's, and ``text``, the article's blocks joined by one space."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*rest).alias("row"), F.col(html_col).cast("string").alias("html"))
    schema = StructType([rows.schema["row"], StructField("blocks", StructType.fromDDL(f"b {_BLOCKS}")["b"].dataType)])
    chosen = F.filter("blocks", lambda b: kept(tree, b["f"]))
    return rows.mapInArrow(_cut, schema).select("row", F.array_join(F.transform(chosen, lambda b: b["text"]), " ").alias("text"))


def op11(pages: DataFrame) -> DataFrame:
    found = main_text(pages.select("page_id", "url", "html"), fit(labelled_blocks(pages.sparkSession)))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
