"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements, named by tag, class
and id (digits left out) and kept as a hash of its parent's and its own name. Pages of a host with the same blocks are
one page there, however often they are served, and so are marked main parts (article or main) with the same
blocks. For each node Spark counts on how many distinct pages it stands, on how many of them each of its
layouts (the sequence of its child elements) and each of its contents (a sentence or such a piece of a text block
in it or up to LEVELS elements below it) stands. With m pages and l layouts,

* presentation importance is the entropy of the layouts, to the base m;
* content importance is 1 - mean over contents of log(pages with it) / log(m);
* the node's importance is (1 - DECAY^l) * presentation + DECAY^l * content, and 1 on a single page.

A small host says little by itself. So a node's importance is averaged with a prior that weighs PRIOR_PAGES
pages: its importance over all hosts together, which share templates, or 1 inside a marked main part.

Where to cut follows from the host: from the level at which most of its text stands, importances are followed
downwards to the first gap of GAP or more; what lies below the gap is what the site repeats. A host without such a gap repeats
nothing. A branch goes from a page where its element and all elements below it lie under the gap.

After the tree come marks. Some elements are never main text whatever their site does, such as readers' comments, which no
two pages share: those whose tag or class says menu, header, footer, sidebar, notice, advert, form, comment
section, script or style. Where a page marks its main part (article or main), only that part is read.
Inside it a class counts only where the tree agrees, or where all of it names comments or an advert.
A name on a wrapper says nothing of what it wraps. So such a mark does not count on an element that holds more
than MOST of the page's text (ALMOST_ALL, where a tag or a word means only links or readers' text), unless the
site style tree agrees; nor around a marked part, unless most of such parts' text stands outside of the noise,
as with an article among teasers. A menu, a footer, a sidebar or a form without paragraphs that is closed by its own
tag is noise however much it holds. Where names alone would empty a page they are ignored; tags and the tree may.
Only script, style, textarea, title, iframe, noembed and noframes have content that is no markup; one that is never closed takes
the characters up to the next tag, and nothing behind.

Counts are added up by Spark with partial sums, so a host with a third of all pages costs no single
task more. The nodes found unimportant are sent once to every worker while they are few (the number is
checked); else each page's own nodes meet them in a join by host and node.

Defined results: a null html is empty and gives an empty text; a null or odd url has the host ''; repeated
rows are one page of their site and give equal rows; an empty table gives an empty result; broken markup is read as far
as it goes, to any depth; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import read, settle

DECAY = 0.9
LEVELS = 1
PRIOR_PAGES = 20
GAP = 0.08
#: Levels that hold less than this share of a host's text do not fill a gap.
LEAST_TEXT = 0.002
MOST = 0.5
ALMOST_ALL = 0.9
BROADCAST_NODES = 500_000

#: Fixed sets of HTML element names.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; all others are read.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog select button fieldset option head search".split())
TEXT_TAGS = frozenset("p h1 h2 h3 article main".split())
CLOSES_P = BLOCKS - frozenset("body html button option optgroup legend caption".split())
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table article section div body main td th blockquote".split())
#: Fixed words that name noise in a class, id or role.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer foot colophon copyright sidebar side widget widgets notice notices cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup login search form comment comments disqus reply replies respond discussion reactions share sharing social related recommended "
    "pagination pager skip toolbar complementary contentinfo alert disclaimer paywall".split()
)
#: Names that mark readers' comments or an advert also inside a marked main part, where they are the whole name.
EXACT_NAME = re.compile(r"(?:(?:user|reader|post|article)s?-?)?comments?(?:-?(?:list|section|area|thread|form|box))?|disqus(?:[_-]thread)?|ads?|adverts?|advertisements?|adsbygoogle", re.I)
#: Those that no site gives to a wrapper of its main text.
CLOSED_TAGS = frozenset("nav footer aside".split())
STRONG_TAGS = frozenset("nav footer menu dialog select button option head".split())
STRONG_WORDS = frozenset("comment comments disqus reply replies respond discussion reactions breadcrumb breadcrumbs pagination pager".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(?:>|\Z)", re.S
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What parts the pieces of a block: the end of a sentence or a separator.
_PIECE = re.compile(r"(?<=[.!?;:])\s+|\s*[·•|–—]\s*")


_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
#: A mark that counts only where the site style tree agrees.
AGREED = 1e-9


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in order; kind is text, open or close. Raw elements are left out."""
    at = 0
    find = _TOKEN.search
    while m := find(html, at):
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        if name := m[2]:
            name = name.lower()
            if name in RAW and not m[3].endswith("/"):
                end = _ENDS[name].search(html, at)
                if end:
                    at = end.end()
                else:  # never closed: what comes before the next tag is its content
                    following = html.find("<", at)
                    at = following if following >= 0 else len(html)
            else:
                yield "open", name, m[3]
        elif m[1]:
            yield "close", m[1].lower(), ""
    if at < len(html):
        yield "text", html[at:], ""


class Node:
    """An open or closed block element."""

    __slots__ = ("tag", "parent", "key", "noise", "start", "end", "children", "article", "main", "own", "by_tag", "text")

    def __init__(self, tag: str, parent: Node | None, label: str, noise: float, start: int, by_tag: bool = False):
        self.tag, self.parent, self.noise, self.start, self.end, self.children, self.own = tag, parent, noise, start, -1, [], False
        self.by_tag = by_tag  # noise by its tag, whatever its names say
        self.text = False  # holds a paragraph, a heading or a marked part
        self.key = _hash(f"{parent.key if parent else ''}>{label}")
        self.article = tag == "article" or parent is not None and parent.article
        self.main = tag == "main" or parent is not None and parent.main

    @property
    def inside(self) -> bool:
        """Whether the element lies in a marked main part."""
        return self.parent is not None and (self.parent.article or self.parent.main)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def _named(tag: str, attributes: str, up: Node | None) -> tuple[str, float, bool]:
    """The element's part of a path, up to which share of the page's text its marks make it noise (0: not at all), and whether its tag does."""
    by_tag = tag in NOISE_TAGS or tag == "header" and not (up is not None and up.article)
    inside = up is not None and (up.article or up.main)
    noise = (ALMOST_ALL if tag in STRONG_TAGS else MOST) if by_tag else 0.0
    label = tag
    if attributes:
        for kind, a, b, c in _NAME.findall(attributes):
            value = a or b or c
            label += f"{'.' if kind.lower() == 'class' else '#'}{re.sub(r'[0-9]+', '', value).strip()}"
            if tag in ("html", "body", "article", "main"):
                continue
            words = {x.lower() for x in _WORD.findall(value)}
            if not words.isdisjoint(NOISE_WORDS):
                strong = not words.isdisjoint(STRONG_WORDS)
                if inside and not any(map(EXACT_NAME.fullmatch, value.split())):
                    noise = max(noise, AGREED)
                else:
                    noise = max(noise, ALMOST_ALL if strong else MOST)
        if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:[\s=]|$)", attributes):
            noise = ALMOST_ALL
    return label, noise, by_tag


def parse(html: str | None) -> tuple[list[str], list[Node | None], list[Node]]:
    """Text blocks in page order, the innermost element around each, and all elements, parents first."""
    blocks: list[str] = []
    around: list[Node | None] = []
    nodes: list[Node] = []
    stack: list[Node] = []
    held: list[str] = []
    is_open: Counter = Counter()

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(text)
                around.append(stack[-1] if stack else None)
                if stack:
                    stack[-1].own = True

    def close(k: int) -> None:
        flush()
        for node in stack[k:]:
            node.end = len(blocks)
            is_open[node.tag] -= 1
        del stack[k:]

    if not isinstance(html, str):
        return blocks, around, nodes
    head = False
    for kind, name, attributes in tokens(html):
        if kind == "text":
            if not head:
                held.append(name)
        elif kind == "open":
            if name == "head":
                head = True
            elif name == "br":
                held.append(" ")
            elif name in BLOCKS:
                if head and name != "html":
                    head = False
                flush()
                if name in CLOSES_P and stack and stack[-1].tag == "p":
                    close(len(stack) - 1)
                if name in SAME:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].tag in SAME[name]:
                            close(k)
                            break
                        if stack[k].tag in SCOPES or stack[k].tag == "tr" and name in ("td", "th") or not any(is_open[x] for x in SAME[name]):
                            break
                up = stack[-1] if stack else None
                label, noise, by_tag = _named(name, attributes, up)
                node = Node(name, up, label, noise, len(blocks), by_tag)
                if name in TEXT_TAGS:
                    while up is not None and not up.text:
                        up.text, up = True, up.parent
                    up = node.parent
                if up is not None:
                    up.children.append(name)
                nodes.append(node)
                if name not in VOID and not attributes.endswith("/") or name in ("div", "p"):
                    stack.append(node)
                    is_open[name] += 1
                else:
                    node.end = len(blocks)
        elif name == "head":
            head = False
            held.clear()
        elif name in BLOCKS:
            if is_open[name]:
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                if stack[k].by_tag and (name in CLOSED_TAGS or name == "form" and not stack[k].text):
                    stack[k].noise = 1.0  # closed as it should be: noise however much it holds
                close(k)
            else:
                flush()
    close(0)
    return blocks, around, nodes


def main_text(html: str | None, low: set[int]) -> str:
    """The page's blocks without the branches that the site's tree holds unimportant (low: their nodes), then without noise."""
    blocks, around, nodes = parse(html)
    sizes = [len(x) for x in blocks]
    upto = list(accumulate(sizes, initial=0))
    high: set[Node] = set()  # elements that are important or hold one that is
    for n in reversed(nodes):
        if n in high or n.key not in low:
            high.add(n)
            if n.parent is not None:
                high.add(n.parent)
    bad: dict[Node | None, bool] = {None: False}  # inside noise
    bad_inside: dict[Node | None, bool] = {None: False}  # inside noise that lies in the marked part
    bad_tag: dict[Node | None, bool] = {None: False}  # inside noise by its tag
    for n in nodes:
        own = bool(n.noise) and (upto[n.end] - upto[n.start] <= n.noise * upto[-1] or n not in high)
        bad[n] = bad[n.parent] or own
        bad_inside[n] = n.inside and bad_inside[n.parent] or own and (n.article or n.main)
        bad_tag[n] = bad_tag[n.parent] or own and n.by_tag
    left = [k for k, n in enumerate(around) if n is None or n in high]
    return "\n".join(blocks[k] for k in _main_part(around, sizes, left, bad, bad_inside, bad_tag))


def _main_part(around: list[Node | None], sizes: list[int], left: list[int], bad: dict, bad_inside: dict, bad_tag: dict) -> list[int]:
    """Of the blocks left, those of the marked main part, or of the page where none is marked, without noise; where names alone would leave nothing they do not count."""
    size = lambda part: sum(sizes[k] for k in part)
    clean = [k for k in left if not bad[around[k]]]
    marked = {tag: [k for k in left if around[k] is not None and getattr(around[k], tag)] for tag in ("article", "main")}
    inner = {tag: [k for k in part if not bad_inside[around[k]]] for tag, part in marked.items()}
    for part in inner.values():
        outer = set(clean).intersection(part)
        if outer and 2 * size(outer) >= size(part):
            return sorted(outer)
    named = [k for k in left if not bad_tag[around[k]]]
    return inner["article"] or inner["main"] or clean or named


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_features(html: str | None) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """What a page adds to its site's tree: (part, hash of the part's blocks, rows), rows (node, kind, feature, weight).

    Part 1 is what lies in a marked main part, part 0 the rest. Kinds: 0 the node, 1 its layout, 2 a content, 3 the characters of its own blocks."""
    blocks, around, nodes = parse(html)
    rows: tuple[dict, dict] = {}, {}
    texts: tuple[list, list] = [], []
    for n in nodes:
        own = rows[n.inside]
        own[n.key, 0, 0] = 1
        own[n.key, 1, _hash(">".join(n.children))] = 1
    for text, n in zip(blocks, around):
        texts[n is not None and (n.article or n.main)].append(text)
        if n is not None:
            rows[n.inside][n.key, 3, 0] = rows[n.inside].get((n.key, 3, 0), 0) + len(text)
        features = [_hash(x) for x in _PIECE.split(text) if x]
        for _ in range(LEVELS + 1):
            if n is None:
                break
            rows[n.inside].update(((n.key, 2, x), 1) for x in features)
            n = n.parent
    return [(part, _hash("\n".join(texts[part])), [(*k, v) for k, v in sorted(own.items())]) for part, own in enumerate(rows) if own and blocks]


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, node, inside, kind, feature, n) of each host's style tree, for pages (host, html)."""

    def tree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {}
            for host, html in zip(batch["host"], batch["html"]):
                for part, page, rows in page_features(html):
                    raw = np.array(rows, np.int64).tobytes()
                    key = host, part, page
                    found[key] = min(found.get(key, raw), raw)
            yield pd.DataFrame([(*k, v) for k, v in found.items()], columns=["host", "part", "page", "tree"]).astype({"part": np.int32, "page": np.int64})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for host, part, raw in zip(batch["host"], batch["part"], batch["tree"]):
                for node, kind, feature, weight in np.frombuffer(raw, np.int64).reshape(-1, 4).tolist():
                    found[host, node, part, kind, feature] += weight
                if len(found) > 100_000:
                    yield _counted(found)
                    found = Counter()
            if found:
                yield _counted(found)

    schema = "host string, node long, inside int, kind int, feature long, n long"
    distinct = pages.mapInPandas(tree, "host string, part int, page long, tree binary").groupBy("host", "part", "page").agg(F.min("tree").alias("tree"))
    counts = distinct.select("host", "part", "tree").mapInPandas(count, schema)
    return counts.groupBy("host", "node", "inside", "kind", "feature").agg(F.sum("n").alias("n"))


def _counted(found: Counter) -> pd.DataFrame:
    rows = pd.DataFrame([(*k, n) for k, n in found.items()], columns=["host", "node", "inside", "kind", "feature", "n"])
    return rows.astype({"node": np.int64, "inside": np.int32, "kind": np.int32, "feature": np.int64, "n": np.int64})


def importance(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, chars, importance) of the nodes in counts; importance is 1 on a single page, and for contents where a node has none."""
    n = F.col("n").cast("double")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    tree = counts.groupBy(*keys).agg(
        of(0, F.col("n")).alias("m"), of(3, F.col("n")).alias("chars"), of(1, n * F.log(n)).alias("nlogn"), of(1, n).alias("seen"), of(1, F.lit(1)).alias("layouts"),
        of(2, F.log(n)).alias("logs"), of(2, F.lit(1)).alias("contents"),
    )
    presentation = (F.log("seen") - F.col("nlogn") / F.col("seen")) / F.log("m")
    content = F.coalesce(1 - F.col("logs") / F.col("contents") / F.log("m"), F.lit(1.0))
    near = F.pow(F.lit(DECAY), F.col("layouts"))
    mixed = F.when(F.col("m") <= 1, 1.0).otherwise((1 - near) * presentation + near * content)
    return tree.select(*keys, "m", F.coalesce("chars", F.lit(0)).alias("chars"), mixed.alias("importance"))


def cuts(nodes: DataFrame) -> DataFrame:
    """(host, cut) of the hosts with a gap, for nodes (host, level, chars); a host has 101 levels at most."""
    levels = nodes.where("chars > 0").groupBy("host", "level").agg(F.sum("chars").alias("chars"))
    host = Window.partitionBy("host")
    levels = levels.withColumn("all", F.sum("chars").over(host)).withColumn("top", F.max(F.struct("chars", "level")).over(host)["level"])
    levels = levels.where(F.col("chars") >= LEAST_TEXT * F.col("all")).where("level <= top")
    below = F.lag("level").over(host.orderBy("level"))
    gaps = levels.withColumn("below", below).where(F.col("level") - F.col("below") >= int(round(100 * GAP)))
    return gaps.groupBy("host").agg(F.max("level").alias("cut"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """(host, node) of the unimportant nodes of each host's style tree, for pages (host, html)."""
    counts = settle(style_counts(pages), "style-counts")
    everywhere = counts.where("inside = 0").groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"))
    prior = importance(everywhere, "node").select("node", F.col("importance").alias("prior"))
    own = importance(counts, "host", "node", "inside").join(prior, "node", "left")
    before = F.when(F.col("inside") == 1, 1.0).otherwise(F.col("prior"))
    mixed = (F.col("m") * F.col("importance") + PRIOR_PAGES * before) / (F.col("m") + PRIOR_PAGES)
    nodes = settle(own.select("host", "node", "chars", F.round(100 * mixed).cast("int").alias("level")), "style-nodes")
    # One row a host.
    return nodes.join(cuts(nodes), "host").where("level < cut").select("host", "node")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    low = settle(low_nodes(pages.select("host", "html")).distinct(), "style-tree")
    if low.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        found: dict[str, set[int]] = {}
        for host, node in low.collect():  # the number is checked
            found.setdefault(host, set()).add(node)
        sent = spark.sparkContext.broadcast(found)

        @pandas_udf("string")
        def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for html, host in batches:
                yield pd.Series([main_text(h, sent.value.get(o, set())) for h, o in zip(html, host)], dtype=object)

        out = pages.withColumn("text", text("html", "host"))
    else:
        out = _extract_by_join(pages, low)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _extract_by_join(pages: DataFrame, low: DataFrame) -> DataFrame:
    """The same for any number of low nodes: each page gets those of its own nodes that are low."""

    @pandas_udf("array<long>")
    def keys(htmls: pd.Series) -> pd.Series:
        return pd.Series([sorted({n.key for n in parse(h)[2]}) for h in htmls])

    @pandas_udf("string")
    def text(html: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, set(x) if x is not None else set()) for h, x in zip(html, own)], dtype=object)

    rows = settle(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    found = rows.select("row", "host", F.explode(keys("html")).alias("node")).join(low, ["host", "node"]).groupBy("row").agg(F.collect_list("node").alias("own"))
    return rows.join(found, "row", "left").withColumn("text", text("html", "own")).drop("row", "own")


def op3(spark, sf_dir) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
