"""Main text of web pages, with a site style tree.

Pages of one host are merged into one tree of element paths (tags with their classes). Every element has a presentation
importance, the entropy of the child patterns its pages show it with, and a content importance, one minus the mean entropy
of the text blocks below it over the host's pages, both as logarithms to the base of the number of pages: what differs
from page to page counts, what every page repeats does not. Branches whose composite importance is under LOW are cut from
each page of the host. A host with fewer than MIN_PAGES pages with the element gives no evidence, and there only the
meaning of tags, roles and class names decides, which is applied on every page. Equal pages of a host are one page in all
of this: copies say nothing about what the site repeats. The root, body, main and article are never cut as a whole, and
a page whose article (or whole text) would be cut to nothing keeps it.

What a page shows is sent on in a packed row per distinct html and host, folded in the sending task first; statistics are
sums per (host, path, pattern) and (host, path, block), folded before the shuffle, so one host may hold any share of the
pages. Cut branches reach the pages by a join salted over SALTS parts of each host. Only pages, never sites,
are in a task's memory.

Defined results: NULL or empty html has an empty text; markup that is not closed or not opened is read as a browser would
roughly read it; a page whose url is NULL or has no host belongs to no site. Repeated rows are counted and returned as
often as they occur. An empty table gives an empty table. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, MIN_PAGES, CONTENT_WEIGHT, SALTS = 0.25, 5, 0.9, 16
BATCH = 256

# How HTML elements are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th
blockquote pre figure figcaption address nav header footer aside form fieldset hr details summary caption""".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SELF_CLOSING = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
                "option": {"select"}}
NOT_TEXT = set("script style noscript template head title iframe object svg math canvas audio video select option button "
               "textarea input label".split())
NOT_MAIN = {"nav", "footer", "aside", "form", "dialog", "menu"}
NOT_MAIN_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOT_MAIN_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|menus?|nav|nav-?bar|navigation|"
    r"bread-?crumbs?|footer|masthead|cookies?\w*|consent|gdpr|notices?|pop-?up\w*|modal|overlay|newsletter\w*|subscri\w*|"
    r"share|sharing|social|comments?|comment-?(?:list|section|form)|disqus\w*|replies|respond|related|recommend\w*|widgets?|"
    r"log-?in|sign-?up|search|toolbar|pagination|pager|legal|copyright|skip-?link|outbrain|taboola)(?:$|[-_\s])", re.I)
KEEP = {"html", "body", "main"}
NEVER_CUT = KEEP | {"article"}


class _Reader(HTMLParser):
    """Blocks of a page in order: (path of their element, whether outside what is never main text, whether in an article
    and in main, text); and the child patterns of every element path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: tag, path, whether main text, in an article, in main, pattern of children, text allowed
        self.stack = [("", "", True, False, False, [], True)]
        self.blocks: list[tuple[str, bool, bool, bool, str]] = []
        self.patterns: set[tuple[str, str]] = set()
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                at = next(s for s in reversed(self.stack) if s[0] in BLOCK or not s[0])
                self.blocks.append((at[1], at[2], at[3], at[4], text))

    def pop(self) -> None:
        if self.stack[-1][0] in BLOCK:
            self.flush()
        tag, path, *_, children, _ = self.stack.pop()
        if tag in BLOCK:
            self.patterns.add((path, " ".join(children)))

    def close_to(self, tag: str, stop: set[str]) -> None:
        """Close the nearest open element of this tag, if it is nearer than any of `stop`."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            return
        if tag in CLOSES_P:
            self.close_to("p", {"article", "section", "div", "td", "body", "li", "blockquote"})
        if tag in SELF_CLOSING:
            self.close_to(tag, SELF_CLOSING[tag])
        if tag in BLOCK:
            self.flush()
        _, path, main, article, in_main, children, allowed = self.stack[-1]
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}"
        if tag not in KEEP and main:
            within = article or in_main
            if tag in NOT_MAIN or tag == "header" and not within or named.get("role") in NOT_MAIN_ROLES:
                main = False
            elif "hidden" in named or named.get("aria-hidden") == "true" or NOT_MAIN_NAME.search(names):
                main = False
        if tag in BLOCK and (not children or children[-1] != tag):
            children.append(tag)
        if tag in BLOCK:
            label = ".".join([tag, *sorted((named.get("class") or "").split())])
            path = f"{path}/{label}"
        self.stack.append((tag, path, main, article or tag == "article", in_main or tag == "main", [],
                           allowed and tag not in NOT_TEXT))

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self.close_to(tag, {"article", "body"} - {tag} if tag not in ("html", "body", "main") else set())

    def handle_data(self, data: str) -> None:
        if self.stack[-1][-1]:
            self.text.append(data)


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    while len(reader.stack) > 1:
        reader.pop()
    reader.flush()
    return reader


def path_hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - 2**63


def ancestors(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def main_text(html: str | None, cut: set[int]) -> str:
    """The blocks of the article, or of main, or of all, without what is never main text and without cut branches; with
    them if nothing would be left."""
    known: dict[str, bool] = {}

    def cuttable(path: str) -> bool:
        return path.rsplit("/", 1)[1].split(".")[0] not in NEVER_CUT

    def low(path: str) -> bool:
        if path not in known:
            known[path] = bool(cut) and any(path_hash(p) in cut for p in ancestors(path) if cuttable(p))
        return known[path]

    blocks = [b for b in read(html).blocks if b[1]]
    choices = [c for c in ([b for b in blocks if b[2]], [b for b in blocks if b[3]]) if c] or [blocks]
    left = [[b for b in c if not low(b[0])] for c in choices]
    return "\n".join(b[4] for b in next((c for c in left if c), choices[0]))


def host_of(url: Column) -> Column:
    """The host of a url in lower case; NULL if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def _packed(page: _Reader) -> bytes:
    """Paths with their parents, the child patterns of paths and the texts of blocks, each with the place of its path."""
    paths = sorted({p for p, _ in page.patterns})
    at = {p: i for i, p in enumerate(["", *paths])}
    patterns = sorted(page.patterns)
    blocks = sorted({(at[path], path_hash(text)) for path, _, _, _, text in page.blocks})
    return b"".join(np.array(x, kind).tobytes() for x, kind in (
        ([len(paths), len(patterns), len(blocks)], "<u4"), ([at[p.rpartition("/")[0]] for p in paths], "<u4"),
        ([at[p] for p, _ in patterns], "<u4"), ([i for i, _ in blocks], "<u4"), ([path_hash(p) for p in paths], "<i8"),
        ([path_hash(v) for _, v in patterns], "<i8"), ([v for _, v in blocks], "<i8")))


def _unpacked(packed: bytes) -> set[tuple[int, int, int]]:
    """(path, kind, value) of a page: that it has the path, a child pattern of it, a block below it."""
    n, k, m = np.frombuffer(packed, "<u4", 3).tolist()
    places = np.frombuffer(packed, "<u4", n + k + m, 12).tolist()
    hashes = np.frombuffer(packed, "<i8", n + k + m, 12 + 4 * (n + k + m)).tolist()
    parents, paths = [0, *places[:n]], [0, *hashes[:n]]
    seen = {(p, 0, 0) for p in paths[1:]}
    seen |= {(paths[i], 1, v) for i, v in zip(places[n: n + k], hashes[n: n + k], strict=True)}
    for i, value in zip(places[n + k:], hashes[n + k:], strict=True):
        while i:
            seen.add((paths[i], 2, value))
            i = parents[i]
    return seen


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, digest and packed content of every page; once for pages that this task has read already."""
    done: set[tuple[str, bytes]] = set()
    for batch in batches:
        for low in range(0, len(batch), BATCH):
            part = batch.slice(low, BATCH)
            hosts, digests, shown = [], [], []
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                digest = xxhash.xxh3_128_digest(html)
                if (host, digest) not in done:
                    done.add((host, digest))
                    hosts.append(host)
                    digests.append(digest)
                    shown.append(_packed(read(html)))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()),
                                              pa.array(shown, pa.binary())], ["host", "digest", "shown"])


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), BATCH):
            part = batch.slice(low, BATCH)
            hosts, rows = [], []
            for host, shown in zip(part.column("host").to_pylist(), part.column("shown").to_pylist(), strict=True):
                seen = _unpacked(shown)
                hosts += [host] * len(seen)
                rows += seen
            paths, kinds, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()),
                                              pa.array(kinds, pa.int32()), pa.array(values, pa.int64())],
                                             ["host", "path", "kind", "value"])


def importance(pages: DataFrame) -> DataFrame:
    """The style tree: host, path, pages, presentation, content and composite importance of every element."""
    distinct = (pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")
                .mapInArrow(_shown, "host string, digest binary, shown binary").dropDuplicates(["host", "digest"]))
    seen = distinct.select("host", "shown").mapInArrow(_observed, "host string, path bigint, kind int, value bigint")
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k").cast("double")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    per = counts.groupBy("host", "path").agg(
        of(0, k).alias("pages"), of(1, k).alias("shown"), of(1, k * F.log(k)).alias("k_log_k"),
        of(2, F.lit(1.0)).alias("blocks"), of(2, F.log(k)).alias("log_k"))
    base = F.log("pages")
    # entropy of pattern shares k / shown, and mean entropy of blocks spread evenly over their k pages
    presentation = F.least(F.lit(1.0), (F.log("shown") - F.col("k_log_k") / F.col("shown")) / base)
    content = F.when(F.col("blocks") > 0, 1 - F.col("log_k") / (F.col("blocks") * base)).otherwise(0.0)
    several = per.where(F.col("pages") > 1)
    return several.withColumns({"presentation": presentation, "content": content}).withColumn(
        "composite", CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    cut = (importance(pages).where((F.col("pages") >= MIN_PAGES) & (F.col("composite") < LOW) & (F.col("blocks") > 0))
           .groupBy("host").agg(F.collect_set("path").alias("cut"))  # as many as a site has kinds of elements
           .select("host", "cut", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))

    @F.arrow_udf("binary")
    def squeezed(htmls: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=3)
        return pa.array([h and packer.compress(h.encode()) for h in htmls.to_pylist()], pa.binary())

    # pages are dealt out by site, so they travel compressed
    dealt = pages.select("page_id", "url", squeezed("html").alias("page"), host_of(F.col("url")).alias("host"),
                         F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int").alias("salt"))

    @F.arrow_udf("string")
    def text_of(packed: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array([main_text(h and zstandard.decompress(h).decode(), set(c or ()))
                         for h, c in zip(packed.to_pylist(), cuts.to_pylist(), strict=True)], pa.string())

    # pages without a host keep their place: they match nothing and need not meet in one task
    homeless = dealt.where("host is null").withColumn("cut", F.lit(None).cast("array<bigint>"))
    housed = dealt.where("host is not null").join(cut, ["host", "salt"], "left").select(*homeless.columns)
    return housed.unionByName(homeless).select("page_id", "url", text_of("page", "cut").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
