"""Main text of web pages by equivalence classes of their elements.

Elements (their paths of tags and classes) with the same occurrence vector over
the different pages of a host form a class; a class valid for the host (each
element once on nearly every page) belongs to its template, and valid elements nest by
their paths. What lies in a template element and in none below it is a slot. Spark
adds up how much text and how much of it in links each slot holds on all pages
of the host; the slot of most text outside links is the main one. It stands for the
article or main element around it, if there is one (slots in such elements come before others), or else for itself and all
slots of at least `least` of its text that aren't mostly links. A page without
the host's main slot is judged by its own elements.

Within these, elements of tags for menus, headers, footers, sidebars, forms,
scripts and styles go, but for the headings in an article's own header. So do elements
one of whose class names (or id or role) is a word for notices, adverts, comments and the
like, alone or beside words for parts of a page (comments-list), unless they hold most of
what is kept.

Vectors are sums of hashes of pages, so that Spark adds them up before its
shuffle, however many pages a host has; copies of a page count once.

Defined cases: a null or empty html gives an empty text; a null url is a host
of its own; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, small

BLOCKS = set(
    "html body article main section div nav header footer aside form ul ol table p h1 h2 h3 h4 h5 h6 li dl dt dd tr td th thead tbody tfoot caption blockquote pre figure figcaption hr title head address fieldset details summary".split()
)
DROPPED = set("script style noscript template nav footer aside form head header button select textarea iframe svg dialog".split())
VOID = set("br hr img meta link input area base col embed source track wbr".split())
#: An open element of these ends where another of its group begins.
SAME = [{"p"}, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}]
NAMES = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies menu nav navbar navigation newsletter notice notices popup promo related share sidebar social sponsor sponsored".split())
#: Words that may stand beside one of NAMES in a name, as in comments-list or cookie-banner.
BESIDE = set("area article bar block body bottom box consent container content desktop feed footer form global google header inner item items left links list mobile outer page panel post reader right section site slot sticky thread top unit user widget wrap wrapper".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Templates broadcast at most.
HOSTS = 20_000


def is_noise(name: str) -> bool:
    """Whether a class, id or role is a word of NAMES, with nothing but words of BESIDE and numbers around it."""
    parts = [p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
    return any(p in NAMES for p in parts) and all(p in NAMES or p in BESIDE or p.isdigit() for p in parts)


class Element:
    """An open element: its path, and whether its tag or its names tell that it's no article text."""

    __slots__ = ("tag", "path", "above", "by_tag", "named", "size")

    def __init__(self, tag: str, names: dict, above: "Element | None"):
        self.tag, self.above, self.size = tag, above, 0
        self.path = f"{above.path if above else ''}/{tag}" + "".join(f".{c}" for c in (names.get("class") or "").split())
        whole = tag in ("html", "body", "article", "main")
        self.by_tag = tag in DROPPED
        self.named = not whole and any(is_noise(x) for k in ("class", "id", "role") for x in (names.get(k) or "").split())

    def around(self) -> Iterator["Element"]:
        node: Element | None = self
        while node is not None:
            yield node
            node = node.above


def dropped(node: Element) -> bool:
    """Whether a tag around says that this is no article text.

    A form around an article says nothing, as whole pages lie in forms; neither does a header within it about its headings.
    """
    article, title, waiting = False, node.tag in HEADINGS, False
    for e in node.around():
        if e.tag == "header" and title and not article:
            waiting = True  # it counts unless an article is around
        elif e.by_tag and not (article and e.tag == "form"):
            return True
        article = article or e.tag in ("article", "main")
    return waiting and not article


class Page(HTMLParser):
    """The text blocks of a page, each with its element and its characters in links, and how often each path opens."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.times: dict[str, int] = {}
        self.blocks: list[tuple[Element | None, str, int]] = []
        self.parts: list[tuple[str, bool]] = []
        self.in_link = False
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(x for x, _ in self.parts).split())
        if text:
            self.blocks.append((self.open[-1] if self.open else None, text, sum(len(x.strip()) for x, link in self.parts if link)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
            self.in_link = False
        if tag == "br":
            self.parts.append((" ", False))
        self.in_link = tag == "a" or self.in_link
        if tag in VOID or not (tag in BLOCKS or tag in DROPPED):
            return
        if self.open and (any(tag in x and self.open[-1].tag in x for x in SAME) or (self.open[-1].tag == "p" and tag in BLOCKS)):
            self.open.pop()
        self.open.append(Element(tag, dict(attrs), self.open[-1] if self.open else None))
        path = self.open[-1].path
        self.times[path] = self.times.get(path, 0) + 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.in_link = self.in_link and tag != "a"
        if any(x.tag == tag for x in self.open):
            self.flush()
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.parts.append((data, self.in_link))

    def weights(self) -> dict[str, tuple[int, int]]:
        """Characters below each path, and those of them in links; what its tag drops doesn't count."""
        out: dict[str, tuple[int, int]] = dict.fromkeys(self.times, (0, 0))
        for node, text, links in self.blocks:
            if node is not None and not dropped(node):
                for path in {x.path for x in node.around()}:
                    out[path] = (out[path][0] + len(text), out[path][1] + links)
        return out


def inside(path: str, of: str) -> bool:
    return path == of or path.startswith(f"{of}/")


class Template:
    """Nested template elements (path, characters below, of them in links), and the slots of the main text."""

    def __init__(self, elements: list[tuple[str, float, float]], least: float):
        self.paths = {p for p, _, _ in elements}
        own = {p: [c, k] for p, c, k in elements}
        for p, c, k in elements:
            above = self.slot(p.rpartition("/")[0])
            if above:
                own[above][0] -= c
                own[above][1] -= k
        prose = {p: c - k for p, (c, k) in own.items()}
        around_of = lambda p: [k for k, x in enumerate(p.split("/")) if x.split(".")[0] in ("article", "main")]
        # slots of articles come before all others
        self.main = max(sorted(prose), key=lambda p: (bool(around_of(p)) and prose[p] > 0, prose[p]), default=None)
        parts, around = (self.main or "").split("/"), around_of(self.main or "")
        self.region = "/".join(parts[: around[0] + 1]) if around else None
        self.kept = {p for p, x in prose.items() if p == self.main or (x > 0 and x >= least * prose[self.main] and 2 * own[p][1] < own[p][0])}

    def slot(self, path: str) -> str | None:
        """The deepest template element around a path."""
        while path and path not in self.paths:
            path = path.rpartition("/")[0]
        return path or None

    def holds(self, path: str) -> bool:
        return inside(path, self.region) if self.region else self.slot(path) in self.kept


def main_text(page: Page, template: Template | None, least: float = 0.2) -> str:
    """The text in the main slots of the host's template, or of the page's own if it lacks them."""
    if template is None or template.main not in page.times:
        weights = page.weights()
        template = Template([(p, *weights[p]) for p, n in page.times.items() if n == 1], least)
    if template.main is None:
        found = [x for x in page.blocks if x[0] is None or not (dropped(x[0]) or any(e.named for e in x[0].around()))]
        return " ".join(t for _, t, _ in found)
    root = template.region or ""
    found = [x for x in page.blocks if x[0] is not None and template.holds(x[0].path)]
    within = lambda node: [e for e in node.around() if not root or inside(e.path, root) and e.path != root]
    found = [x for x in found if not dropped(x[0])]
    total = sum(len(t) for _, t, _ in found)
    for node, t, _ in found:
        for e in node.around():
            e.size += len(t)
    return " ".join(t for node, t, _ in found if not any(e.named and 2 * e.size <= total for e in within(node)))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, share: float = 0.9) -> DataFrame:
    """host and template: path, characters and characters in links of its valid elements; pages has host and html."""

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, key, html in zip(pdf["host"], pdf["key"], pdf["html"]):
                page = Page(html)
                weights = page.weights()
                rows += [(host, key, path, n, *weights[path]) for path, n in page.times.items()]
                rows.append((host, key, "", 1, 0, 0))
            yield pd.DataFrame(rows, columns=["host", "key", "path", "n", "chars", "links"])

    keyed = pages.select("host", F.xxhash64("html").alias("key"), "html")
    seen = keyed.mapInPandas(elements, "host string, key bigint, path string, n bigint, chars bigint, links bigint").dropDuplicates(["host", "key", "path"])
    vectors = seen.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.pmod(F.xxhash64("key", "n"), F.lit(2**31))).alias("vector"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    vectors = checkpointed(vectors)
    sizes = vectors.filter("path = ''").select("host", F.col("pages").alias("of"))
    elements_only = vectors.filter("path <> ''")
    classes = elements_only.groupBy("host", "pages", "vector").agg(F.max("most").alias("class_most"))
    valid = elements_only.join(classes, ["host", "pages", "vector"]).join(sizes, "host").filter((F.col("class_most") == 1) & (F.col("pages") >= share * F.col("of")))
    # at most 1 / share times a page's own elements
    return valid.groupBy("host").agg(F.collect_list(F.struct("path", (F.col("chars") / F.col("of")).alias("chars"), (F.col("links") / F.col("of")).alias("links"))).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.2, **options) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    kind = dict(rows.dtypes)["page_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Template] = {}
        for pdf in batches:
            texts = []
            for host, html, elements in zip(pdf["host"], pdf["html"], pdf["template"]):
                if host not in known and elements is not None:
                    known = known if len(known) < 1000 else {}
                    known[host] = Template([(e["path"], e["chars"], e["links"]) for e in elements], least)
                texts.append(main_text(Page(html), known.get(host), least))
            yield pdf[["page_id", "url"]].assign(text=texts)

    found = small(checkpointed(templates(rows, **options)), HOSTS)
    got = rows.join(found, "host", "left").select("page_id", "url", "host", "html", "template").mapInPandas(run, f"page_id {kind}, url string, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))
