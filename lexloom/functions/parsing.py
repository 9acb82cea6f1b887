"""Parsers of one page's source: HTML, markdown and plain text into titled sections. Small helpers of the parsing job."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Extensions that are parsed as markdown and as HTML; all others are plain text.
MARKDOWN, HTML = ("md", "markdown", "rst"), ("html", "htm")
SYMBOL = re.compile(r"\b(?:[A-Za-z_]\w*(?:::|\.)?){1,5}\b")
MOST_SYMBOLS = 256


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def path_title(path: str) -> str:
    """The file's name without its extension, with blanks for dashes and underscores."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return re.sub("[-_]", " ", stem) if stem else "Documentation"


def slug(value: str) -> str:
    return "-".join(x for x in "".join(c if c.isalnum() else "-" for c in value.lower()).split("-") if x)


def symbols_of(value: str) -> set[str]:
    return {s for s in SYMBOL.findall(value) if len(s.encode()) > 2 and ("." in s or "::" in s or "_" in s)}


def section(heading: str, anchor: str) -> dict:
    return {"heading": heading, "anchor": anchor, "text": "", "code": []}


class Sections(list):
    def current(self, title: str) -> dict:
        """The last section; text before any heading opens one named by the page."""
        if not self:
            self.append(section(title, "top"))
        return self[-1]

    def cleaned(self) -> list[dict]:
        for s in self:
            s["text"] = s["text"].strip()
        return [s for s in self if s["text"] or s["code"]]


def page(path: str, title: str, url: str, symbols: set[str], sections: list[dict]) -> dict:
    return {"path": path, "title": title, "canonical_url": url, "symbols": sorted(symbols, key=str.encode)[:MOST_SYMBOLS], "sections": sections}


def lines_of(text: str) -> list[str]:
    """Lines end at a newline only; a carriage return before it goes."""
    lines = text.split("\n")
    return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]


def plain_text(path: str, url: str, source: str) -> dict:
    """A section for each paragraph; one that the end of the file closes is anchored at the top."""
    title = path_title(path)
    out, held = [], []
    for line in [*lines_of(source), None]:
        if line is not None and line.strip():
            held.append(line.strip())
        elif held:
            out.append(section(title, "top" if line is None else slug(title)) | {"text": "\n".join(held)})
            held = []
    return page(path, title, url, set(), Sections(out).cleaned())


def front_matter(source: str) -> tuple[dict[str, str], str]:
    """The keys (the first line of each wins) between --- lines at the very start, and the rest."""
    found = re.match(r"---\n(.*?)\n---\n", source, re.S)
    if not found:
        return {}, source
    keys: dict[str, str] = {}
    for line in lines_of(found[1]):
        key, colon, value = line.partition(":")
        if colon:
            keys.setdefault(key.strip(), value.strip().strip("'\""))
    return keys, source[found.end() :]


def markdown(path: str, url: str, source: str, base: str, standalone: bool = False) -> dict:
    """Headings open sections, closed fences are code. standalone: without front matter, fourth-level headings, symbols and the dropping of {{ lines; the first heading always names the page."""
    keys, body = ({}, source) if standalone else front_matter(source)
    title = keys.get("title", path_title(path))
    if "slug" in keys:
        url = f"{base.rstrip('/')}/{keys['slug'].lstrip('/')}"
    heads = re.compile(rf"#{{1,{3 if standalone else 4}}} ")
    sections, symbols, code, fenced = Sections(), set(), [], False
    for line in lines_of(body):
        bare = line.lstrip()
        if bare.startswith("```"):
            text = "".join(f"{x}\n" for x in code)
            if fenced and text.strip():
                sections.current(title)["code"].append(text.rstrip())
                symbols |= symbols_of(text)
            code, fenced = [], not fenced
        elif fenced:
            code.append(line)
        elif head := heads.match(bare):
            heading = bare[head.end() :].strip()
            if not sections and (standalone or title == path_title(path)):
                title = heading
            sections.append(section(heading, slug(heading)))
        elif bare.strip() and (standalone or not bare.startswith("{{")):
            sections.current(title)["text"] += line.strip() + "\n"
            for inline in line.split("`")[1::2]:
                symbols |= symbols_of(inline)
    return page(path, title, url, set() if standalone else symbols, sections.cleaned())


class Elements(HTMLParser):
    """The elements of a page in order, each with the texts below it."""

    TEXT, HEADS = {"p", "li", "dt", "dd", "th", "td"}, {"h1", "h2", "h3", "h4"}
    VOID = set("area base br col embed hr img input link meta source track wbr".split())
    #: What an opening tag ends: the open element of these names, up to one of the bounds.
    ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
    NO_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict, list[str]]] = []
        self.open: list[tuple[str, dict, list[str]]] = []
        self.feed(source)
        self.close()

    def end(self, names: set[str], bounds: set[str]):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in bounds:
                return
            if self.open[k][0] in names:
                del self.open[k:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in self.NO_P:
            self.end({"p"}, {"button", "table", "td", "th"})
        if tag in self.ENDS:
            self.end(*self.ENDS[tag])
        made = (tag, dict(attrs), [])
        self.found.append(made)
        if tag not in self.VOID:
            self.open.append(made)

    def handle_endtag(self, tag):
        self.end({tag}, set())

    def handle_data(self, data):
        for _, _, texts in self.open:
            texts.append(data)


def html(path: str, url: str, source: str) -> dict:
    """Sections by headings over the whole body; blocks in blocks repeat their text, as each is taken by itself."""
    elements = Elements(source).found
    flat = lambda texts: " ".join(" ".join(texts).split())
    title = next((flat(x) for tag, _, x in elements if tag in ("title", "h1")), "") or path_title(path)
    sections, symbols = Sections(), set()
    for tag, attrs, texts in elements:
        if tag in Elements.HEADS and (heading := flat(texts)):
            sections.append(section(heading, attrs["id"] if attrs.get("id") is not None else slug(heading)))
        elif tag in Elements.TEXT and (text := flat(texts)):
            sections.current(title)["text"] += text + "\n"
        elif tag == "pre" and (code := "".join(texts).strip()):
            sections.current(title)["code"].append(code)
        elif tag == "code":
            symbols |= symbols_of("".join(texts))
    return page(path, title, url, symbols, sections.cleaned())


def parse(path: str, url: str, source: str, base: str, standalone: bool = False) -> dict:
    kind = extension(path)
    if kind in MARKDOWN:
        return markdown(path, url, source, base, standalone)
    return html(path, url, source) if kind in HTML else plain_text(path, url, source)
