"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: a node of the tree is a path of tags with their classes.  A node's
presentation importance is the entropy of the child layouts that its pages show; its content importance falls
with the entropy of its texts over the pages, each text weighing its words.  A node matters if either does, so
its importance is 1 - (1 - content) (1 - presentation), and branches of low importance (adverts, notices, boxes:
one layout and a stock of texts, page after page) are removed from each page.

Few pages say little, so importance is taken as if PRIOR_PAGES more pages had shown the node, at one half if
its class or id is a name that the web uses for such branches and at one otherwise: names decide where there
are no statistics, and give way to them where there are.  Rules remove only what the HTML and ARIA standards
define as no content (scripts, forms, navigation and the like).  An article is content by the same standard:
inside one only branches with a class or id are judged.

No host is handled in one task: pages emit counted features, the entropies are sums over counts, and only the
highest low nodes of a host go back to its pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .scratch import stored

#: A branch below this importance goes.
THRESHOLD = 0.95
#: What importance is before any page is seen: the weight of that belief in pages, and its value for named and other nodes.
PRIOR_PAGES, NAMED, UNNAMED = 8.0, 0.5, 1.0
#: Pages that agree in their longest blocks, as many as hold this share of their words, are copies and count once.
SAME_SHARE = 0.5

# Element and role names of the HTML, SVG, MathML and ARIA standards.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mrow msub msup msubsup mfrac msqrt mroot mtext mspace mover munder munderover mtable mtr mtd semantics annotation svg g path text tspan circle rect line polyline polygon ellipse use defs symbol".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes".split())
REMOVED_TAGS = frozenset("nav footer aside form button select dialog menu head".split()) | RAW
REMOVED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
CONTENT_TAGS, STRUCTURE = frozenset(("article", "main")), frozenset(("html", "body", "article", "main"))
#: Names that pages give to such branches by convention, and words that may stand beside one in a compound.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu nav navbar navigation newsletter notice pagination promo related search share sharing sidebar social sponsored subscribe".split()
)
BESIDE = frozenset("area bar block box container item links list main section site top widget wrapper".split())
#: An open element that these start tags end.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


def is_named(token: str) -> bool:
    """A conventional name, or a compound of such names and neutral words."""
    parts = [x for x in re.split("[-_]+", token) if x]
    return token in NAMES or any(x in NAMES for x in parts) and all(x in NAMES or x in BESIDE for x in parts)


class Node:
    """An open element: its path, and what is known of it without statistics."""

    __slots__ = ("children", "in_content", "named", "parent", "path", "removed", "tag", "tellable")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        names, role, hidden = [], "", False
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() in ("class", "id"):
                names += value.split()
            elif m[1].lower() == "role":
                role = value
            else:
                hidden = True
        self.tag, self.parent = tag, parent
        above = parent.in_content if parent else False
        self.in_content = above or tag in CONTENT_TAGS
        by_rule = hidden or tag in REMOVED_TAGS or tag == "header" and not above or role in REMOVED_ROLES
        self.removed = by_rule or (parent.removed if parent else False)
        #: In an article, a branch without class or id is never judged: it is its text.
        self.tellable = not self.removed and tag not in STRUCTURE and (bool(names) or not above)
        self.named = self.tellable and any(map(is_named, names))
        self.path = (parent.path if parent else "") + ">" + tag + "".join(sorted("." + _DIGITS.sub("0", n) for n in set(names)))
        self.children: list[str] = []


def blocks(page: str) -> list[tuple[Node, str]]:
    """(block element, text) in page order, without those that rules remove; white space is one space."""
    out: list[tuple[Node, str]] = []
    stack: list[Node] = []
    parts: list[str] = []
    lower = ""

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text and not (stack and stack[-1].removed):
                out.append((stack[-1] if stack else Node("body", "", None), text))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in INLINE:
                continue
            close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif m[2] or m[4]:
            tag, attributes = (m[2] or m[4]).lower(), m[3] or m[5]
            if tag == "br":
                parts.append(" ")
                continue
            if tag in INLINE:
                continue
            close()
            if tag in RAW:
                lower = lower or page.lower()
                found = lower.find("</" + tag, at)
                at = end if found < 0 else found
                continue
            if stack and (stack[-1].tag == "p" or tag in CLOSED_BY.get(stack[-1].tag, ())):
                stack.pop()
            if stack:
                stack[-1].children.append(tag)
            if tag not in VOID:
                stack.append(Node(tag, attributes, stack[-1] if stack else None))
    close()
    return out


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def tellable_paths(node: Node | None) -> Iterator[Node]:
    while node is not None:
        if node.tellable:
            yield node
        node = node.parent


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Kinds of features: the page has the node (and its judged parent), a text of the node, the node's layout.
HAS, TEXT, LAYOUT = 0, 1, 2
FEATURES = "host string, node long, kind int, feature long, page long, words long, named boolean"


def identity(found: list[tuple[Node, str]]) -> str:
    """The longest blocks of a page's content, as many as hold SAME_SHARE of its words: what copies with other adverts agree in.

    Content is what lies in an article, else what no name tells apart, else everything.
    """
    texts = [t for n, t in found if n.in_content] or [t for n, t in found if not any(x.named for x in tellable_paths(n))] or [t for _, t in found]
    ordered = sorted(((len(t.split()), t) for t in texts), reverse=True)
    left, chosen = SAME_SHARE * sum(n for n, _ in ordered), []
    for n, t in ordered:
        if left <= 0:
            break
        chosen.append(t)
        left -= n
    return "\n".join(chosen)


def page_features(page: str) -> list[tuple]:
    """(node, kind, feature, page, words, named) of the nodes that statistics may judge, each once."""
    found = blocks(page)
    same, seen = _hash(identity(found)), set()
    for node, text in found:
        feature, words = _hash(text), len(text.split())
        for n in tellable_paths(node):
            path, above = _hash(n.path), next(tellable_paths(n.parent), None)
            layout = _hash(" ".join(n.children))
            seen |= {(path, HAS, _hash(above.path) if above else 0, same, 1, n.named), (path, TEXT, feature, same, words, n.named), (path, LAYOUT, layout, same, 1, n.named)}
    return sorted(seen)


def node_features(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, page, words, named) of every node that statistics may judge; page is the same for copies of a page.

    A page without a host belongs to no site: it has no row here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *x) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in page_features(page)]
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["host", "node", "kind", "feature", "page", "words", "named"])

    hosted = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''")
    return hosted.mapInArrow(run, FEATURES)


def importance(features: DataFrame) -> DataFrame:
    """(host, node, above, pages, presentation, content, statistic, named, importance) of the merged tree.

    With m pages and a text of w words on d of them, content is 1 - the mean of log_m(d) over the words of all
    occurrences, and presentation the entropy of the layouts to the base m; statistic joins the two, and
    importance shrinks it towards the prior.  A node of one page has statistic 1.
    """
    counted = features.groupBy("host", "node", "kind", "feature", "page").agg(F.max("words").alias("words"), F.max("named").alias("named"))
    counted = counted.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).cast("double").alias("d"), F.max("words").alias("words"), F.max("named").alias("named"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))
    shown, dlog = F.col("d") * F.col("words"), F.col("d") * F.ln("d")
    summed = counted.groupBy("host", "node").agg(
        of(HAS, F.col("d")).alias("pages"), of(TEXT, F.col("words") * dlog).alias("t"), of(TEXT, shown).alias("tn"), of(LAYOUT, dlog).alias("s"), of(LAYOUT, F.col("d")).alias("sn"),
        F.max("named").alias("named"), F.max(F.when(F.col("kind") == HAS, F.col("feature"))).alias("above"),
    )
    scale = F.ln(F.greatest("pages", F.lit(2.0)))
    content = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.col("t"), F.col("tn") * scale), F.lit(0.0)))
    presentation = F.least(F.lit(1.0), F.coalesce((F.ln("sn") - F.try_divide(F.col("s"), F.col("sn"))) / scale, F.lit(0.0)))
    told = summed.withColumns({"content": content, "presentation": presentation})
    joined = told.withColumn("statistic", F.when(F.col("pages") > 1, 1 - (1 - F.col("content")) * (1 - F.col("presentation"))).otherwise(1.0))
    prior = F.when(F.col("named"), F.lit(NAMED)).otherwise(F.lit(UNNAMED))
    shrunk = (F.col("pages") * F.col("statistic") + PRIOR_PAGES * prior) / (F.col("pages") + PRIOR_PAGES)
    return joined.select("host", "node", "above", "pages", "presentation", "content", "statistic", "named", shrunk.alias("importance"))


def low_branches(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, low): the highest nodes to remove, one row per host that has any; what lies below them goes with them."""
    low = stored(importance(node_features(pages)).where(F.col("importance") < threshold).select("host", "node", "above"), "low-nodes")
    parents = low.select("host", F.col("node").alias("above"))
    return low.join(parents, ["host", "above"], "left_anti").groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low"))


def kept_blocks(page: str, low: set[int] | None) -> list[str]:
    """The blocks of a page outside low nodes; a page of no site (low is None) goes by names alone."""
    if low is None:
        return [text for node, text in blocks(page) if not any(n.named for n in tellable_paths(node))]
    return [text for node, text in blocks(page) if not low or not any(_hash(n.path) in low for n in tellable_paths(node))]


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Blocks are joined by one space; the text of a null or empty page, or of one without content, is empty.  A
    page without a url that names a host is a site of its own, so only names and rules remove branches from
    it.  Repeated rows give repeated rows, and count once in the statistics; very long pages are parsed whole.
    An empty table gives an empty one.
    """
    # the stored table has a known size: Spark broadcasts it if it is small, else joins by host and AQE splits a hot one
    low = stored(low_branches(pages, threshold), "low-branches")
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    source = named.join(low, "host", "left").select("page_id", "url", "html", F.when(F.col("host") != "", F.coalesce("low", F.array().cast("array<long>"))).alias("low"))
    id_type = source.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(kept_blocks(page, None if low is None else set(low))) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def removals(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, blocks, words) of what statistics alone and names remove, and of what is kept, over the blocks that rules leave.

    statistics: with no regard to names the branch would go; names: it goes since its name lowers its importance.
    """
    told = importance(node_features(pages)).where((F.col("importance") < threshold) | ((F.col("pages") * F.col("statistic") + PRIOR_PAGES * UNNAMED) / (F.col("pages") + PRIOR_PAGES) < threshold))
    alone = (F.col("pages") * F.col("statistic") + PRIOR_PAGES * UNNAMED) / (F.col("pages") + PRIOR_PAGES) < threshold
    low = told.groupBy("host").agg(F.collect_set(F.when(alone, F.col("node"))).alias("told"), F.collect_set(F.when(F.col("importance") < threshold, F.col("node"))).alias("low"))
    source = pages.select(F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host")).join(stored(low, "low-branches"), "host", "left").select("html", "host", "told", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int]] = {}
            for page, name, told, low in zip(*(c.to_pylist() for c in batch.columns)):
                told, low = set(told or ()), set(low or ())
                for node, text in blocks(page):
                    above = list(tellable_paths(node))
                    paths = {_hash(n.path) for n in above}
                    gone = bool(paths & low) if name else any(n.named for n in above)
                    total = out.setdefault("statistics" if gone and paths & told else "names" if gone else "kept", [0, 0])
                    total[0] += 1
                    total[1] += len(text.split())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([b for b, _ in out.values()], pa.int64()), pa.array([w for _, w in out.values()], pa.int64())], ["path", "blocks", "words"])

    return source.mapInArrow(run, "path string, blocks long, words long").groupBy("path").agg(F.sum("blocks").alias("blocks"), F.sum("words").alias("words"))
