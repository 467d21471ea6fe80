"""Main text of web pages by equivalence classes of template tokens.

Tokens are tags of containers and words. A tag's role is its path from the root; a word's is the
block it stands in, with the block's path and the tag before it. Words of one block in one role
always occur together, so they are carried as one token. Pages of a host with the same outer
containers form a group; two tokens of a group are equivalent when they occur equally often on each
of its pages. Occurrence vectors are compared by a fingerprint that is added up over pages, and
tokens that a page of the group lacks are dropped as soon as a task meets that page, so little more
than the templates is exchanged, and pages of a host never meet in one task.

Tags that all pages have, and whose parents are template too, nest into the group's template. A
text is template when its class holds a tag that encloses it. What remains are slots: their texts
are extracted, except from slots that are chrome by element or name, or that are made of links
beside others that are not.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stash

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "nav", "header", "footer", "main", "article", "section", "aside", "div", "form", "ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "fieldset", "dialog", "figure", "blockquote", "center", "details"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "address", "caption", "figcaption", "thead", "tfoot", "summary", "legend", "option"}
#: Never part of an article; a header inside an article or main element is.
OUTSIDE = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "textarea", "svg", "canvas", "object", "dialog", "title", "menu", "audio", "video"}
_CORE = (
    "ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|banners?|promos?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|header|masthead|footer"
    "|comments?|commentlist|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social|related|recommended|newsletter|subscribe|signup|popup|modal|widgets?|pagination|pager|complementary|contentinfo|search|skip"
)
#: Names of chrome: one of the above, alone or with the names of a kind of box around it.
NOISE = re.compile(
    rf"(?:(?:site|page|main|top|bottom|left|right|global|post|article|user|reader|primary|secondary|the)[-_]?)*(?:{_CORE})"
    rf"(?:[-_]?(?:{_CORE}|bar|box|lists?|links?|sections?|area|wrap(?:per)?|container|block|form|buttons?|items?|posts|articles|slots?|units?|top|bottom|left|right|inner|outer|body|text|title|head|label|content|main|message|policy|icons?|thread|entry))*",
    re.I,
)
TITLE = re.compile(r"(?:post|article|entry|story|content)[-_]?(?:header|head|title)", re.I)
#: Share of a group's data that its article and main elements must hold for the rest to be dropped.
MAIN = 0.2
#: A text is template on so many distinct pages at least, and while all such texts make up no more of
#: the text of a page than this share: beyond it the pages are copies.
MIN_PAGES, MAX_FIXED = 3, 0.5
#: Tokens that a task holds before it hands on what it has.
HELD = 200_000
#: Template tokens (some hundred bytes each) that are broadcast; beyond them templates are joined by
#: exchange, with each host's pages dealt over so many tasks.
MAX_BROADCAST_TOKENS, SALTS = 200_000, 32


def label(name: str, attributes: str) -> str:
    """Element name with its ids (marked by #), classes and role, without the numbers in them."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    parts = [("#" if k == "id" else "") + re.sub(r"\d+", "", x).replace("/", "_").strip("-_") for k in ("id", "class", "role") for x in found.get(k, "").split()]
    return " ".join([name, *parts])


def is_noise(own: str, inside: bool = False) -> bool:
    """Whether an element of this label is chrome; ``inside`` an article or main element."""
    name, *rest = own.split(" ")
    if name in OUTSIDE or (name == "header" and not inside):
        return True
    names = [x.lstrip("#") for x in rest]
    return name not in ("html", "body", "article", "main") and any(NOISE.fullmatch(x) and not TITLE.fullmatch(x) for x in names)


def is_main(own: str) -> bool:
    name, *rest = own.split(" ")
    return name in ("article", "main") or "main" in rest or "#main" in rest


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """("open"|"close"|"text"|"break"|"link"|"unlink", element label or text, path) in page order.

    Paths have containers and elements outside of articles; other elements don't open a level, as
    their closing tags are often missing. A closing tag without its element is skipped; one closes
    what is open inside, and the end of the page all that is open.
    """
    stack: list[str] = []
    at = 0
    while True:
        m = MARKUP.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            yield "text", page[at:stop], ""
        if not m:
            while stack:
                yield "close", stack[-1], "/".join(stack)
                stack.pop()
            return
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", html.escape(m[0][9:].removesuffix("]]>")), ""
            continue
        name = m[2].lower()
        if name == "a":
            yield "unlink" if m[1] else "link", name, ""
            continue
        if m[1]:
            if name in BLOCKS:
                yield "break", name, ""
            if any(x.split(" ")[0] == name for x in stack):
                while stack:
                    top = stack[-1]
                    yield "close", top, "/".join(stack)
                    stack.pop()
                    if top.split(" ")[0] == name:
                        break
            continue
        if name == "br":
            yield "text", " ", ""
        if name in BLOCKS:
            yield "break", name, ""
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
            own = page.find(">", at) + 1 if end else 0
            at = own or len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in CONTAINERS or name in OUTSIDE:
            stack.append(label(name, m[3]))
            yield "open", stack[-1], "/".join(stack)


def parse(page: str) -> tuple[list[str], list[tuple[str, str, str, int]]]:
    """Paths of the containers in the order they open, and the blocks of text: (path, tag before, text,
    characters in links)."""
    tags, blocks = [], []
    here: list[str] = []
    path = before = ""
    linked, link = 0, False
    for kind, what, own in walk(page):
        if kind == "text":
            here.append(what)
            linked += link * len(what.strip())
            continue
        if kind in ("link", "unlink"):
            link = kind == "link"
            continue
        if here:
            text = " ".join(html.unescape("".join(here)).split())
            if text:
                blocks.append((path, before, text, min(linked, len(text))))
            here, linked = [], 0
        before = f"{kind} {what}"
        if kind == "open":
            path = own
            tags.append(own)
        elif kind == "close":
            path, link = own.rpartition("/")[0], False
    text = " ".join(html.unescape("".join(here)).split())
    return tags, [*blocks, (path, before, text, min(linked, len(text)))] if text else blocks


def layout_of(tags: list[str]) -> int:
    """A number for the set of outer containers: html, body and what lies in the body."""
    outer = sorted({re.sub(r" #[^ /]*", "", p) for p in tags if p.count("/") < 3 and p.rpartition("/")[2].split(" ")[0] in ("html", "body", "div", "nav", "header", "footer", "main", "article", "aside", "form", "table")})
    return signed(xxhash.xxh3_64_intdigest("\n".join(outer)))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def text_role(path: str, before: str, text: str) -> str:
    return f"{path}\n{xxhash.xxh3_128_hexdigest(f'{before}\n{text}')}"


def token_counts(tags: list[str], blocks: list[tuple[str, str, str, int]]) -> dict[tuple[str, str], list[int]]:
    """(kind, role) to [occurrences, characters of text inside, those in links]; kind "tag" or "text", and
    one token "page" for the page itself."""
    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
    out["page", ""][0] = 1
    for p in tags:
        out["tag", p][0] += 1
    for path, before, text, linked in blocks:
        own = out["text", text_role(path, before, text)]
        own[0] += 1
        own[1] += len(text)
        own[2] += linked
        out["page", ""][1] += len(text)
        while path:
            inside = out["tag", path]
            inside[1] += len(text)
            inside[2] += linked
            path = path.rpartition("/")[0]
    return out


def ancestors(path: str) -> list[str]:
    """The path and those of the containers around it, from the inside out."""
    out = []
    while path:
        out.append(path)
        path = path.rpartition("/")[0]
    return out


def chrome(path: str) -> bool:
    """Whether a container or one around it is chrome."""
    inside = False
    for own in path.split("/") if path else ():
        if is_noise(own, inside):
            return True
        inside |= is_main(own)
    return False


@dataclass
class Template:
    """Slots by the path of the tag they lie in, each to be kept or not, and the texts of the template."""

    slots: dict[str, bool]
    texts: frozenset[str]


def deduce(tokens: list[tuple[str, str, int, int, int]], n_pages: int) -> Template:
    """The template of a group from the tokens (kind, role, vector, chars, links) that all its pages have.

    ``n_pages`` counts its distinct pages, ``MIN_PAGES`` or more standing for many.
    """
    classes: dict[int, set[str]] = defaultdict(set)
    tags: dict[str, list[int]] = {}
    whole = 0
    for kind, role, vector, chars, links in sorted(tokens, key=lambda t: t[1].count("/")):
        if kind == "page":
            classes[vector].add("")
            whole = chars
        elif kind == "tag" and (role.rpartition("/")[0] in tags or "/" not in role):
            tags[role] = [chars, links]
            classes[vector].add(role)
    texts: dict[str, int] = {}
    for kind, role, vector, chars, _ in tokens if n_pages >= MIN_PAGES else ():
        path = role.partition("\n")[0]
        if kind == "text" and not chrome(path) and any(p in classes[vector] for p in [*ancestors(path), ""]):
            texts[role] = chars
    direct: dict[str, list[int]] = {p: list(v) for p, v in {"": [whole, 0], **tags}.items()}
    for p, (chars, links) in tags.items():
        direct[p.rpartition("/")[0]][0] -= chars
        direct[p.rpartition("/")[0]][1] -= links
    open_slots = {p: v for p, v in direct.items() if not chrome(p)}
    if sum(texts.values()) > MAX_FIXED * sum(v[0] for v in open_slots.values()):
        texts = {}
    for role, chars in texts.items():
        direct[role.partition("\n")[0]][0] -= chars
    main = {p for p in open_slots if any(is_main(x) for x in p.split("/"))}
    data = sum(v[0] for v in open_slots.values())
    if main and sum(open_slots[p][0] for p in main) >= MAIN * data:
        kept = main
    else:
        linked = {p for p, (chars, links) in open_slots.items() if 2 * links > chars and p not in main}
        rest = sum(v[0] for p, v in open_slots.items() if p not in linked)
        kept = open_slots.keys() - (linked if rest > sum(open_slots[p][0] for p in linked) else set())
    return Template({p: p in kept for p in direct}, frozenset(texts))


def extract(tags: list[str], blocks: list[tuple[str, str, str, int]], template: Template) -> str:
    """The blocks of the slots that are kept, one a line."""
    out = []
    for path, before, text, _ in blocks:
        slot = next((p for p in [*ancestors(path), ""] if p in template.slots), "")
        if template.slots.get(slot, True) and not chrome(path) and text_role(path, before, text) not in template.texts:
            out.append(text)
    return "\n".join(out)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


class _Groups:
    """What the pages that a task has met have in common, by group."""

    def __init__(self) -> None:
        self.tokens: dict[tuple[str, int], dict[tuple[str, str], list[int]]] = {}
        self.pages: dict[tuple[str, int], list[int]] = {}

    def add(self, own: str, page: str) -> None:
        tags, blocks = parse(page)
        group = own, layout_of(tags)
        key = xxhash.xxh3_64_intdigest(page.encode("utf-8", "replace"))
        counts = {t: [v[0] and signed(xxhash.xxh3_64_intdigest(f"{key} {v[0]}")), *v[1:]] for t, v in token_counts(tags, blocks).items()}
        known = self.tokens.get(group)
        if known is None:
            self.tokens[group] = {t: [1, *v] for t, v in counts.items()}
        else:
            # a token that this page lacks is no template
            self.tokens[group] = {t: [known[t][0] + 1, *(x + y for x, y in zip(known[t][1:], counts[t], strict=True))] for t in known.keys() & counts.keys()}
        # the smallest keys tell whether there are enough distinct pages
        self.pages[group] = sorted({*self.pages.get(group, ()), key})[:MIN_PAGES]

    def __len__(self) -> int:
        return sum(map(len, self.tokens.values()))

    def batch(self) -> pa.RecordBatch:
        rows = [(*g, kind, role, n, str(vector), chars, links) for g, own in self.tokens.items() for (kind, role), (n, vector, chars, links) in own.items()]
        rows += [(*g, "copy", str(key), 1, "0", 0, 0) for g, keys in self.pages.items() for key in keys]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "layout", "kind", "role", "n", "vector", "chars", "links"])


def learn_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, layout, tokens, n_pages): the tokens that all pages of a group have.

    A group's tokens are no more than those of its smallest page.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = _Groups(), 0
        for batch in batches:
            for own, page in zip(batch.column(0), batch.column(1), strict=True):
                groups.add(own.as_py(), page.as_py())
                held += 1
                if held % 256 == 0 and len(groups) > HELD:
                    yield groups.batch()
                    groups = _Groups()
        yield groups.batch()

    source = pages.select(host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    group = ["host", "layout"]
    tokens = stash(
        source.mapInArrow(run, "host string, layout long, kind string, role string, n long, vector string, chars long, links long")
        .groupBy(*group, "kind", "role")
        .agg(F.sum("n").alias("n"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links")),
        "tokens",
    )
    totals = tokens.where("kind = 'page'").select(*group, F.col("n").alias("n_rows"))
    copies = tokens.where("kind = 'copy'").groupBy(*group).agg(F.count(F.lit(1)).alias("n_pages"))
    common = tokens.where("kind != 'copy'").join(totals, group).where("n = n_rows")
    token = F.struct("kind", "role", F.col("vector").cast("string").alias("vector"), "chars", "links")
    return common.groupBy(*group).agg(F.collect_list(token).alias("tokens")).join(copies, group)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", templates: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (empty if none) and ``n_chars``.

    Null html counts as empty; pages without a host form one host. Whole pages are read whatever
    their length; repeated rows get equal rows, null ids are carried, other columns are ignored, an
    empty table stays empty. Copies of a page count once as evidence: on fewer than three distinct
    pages, or where fixed texts make up more than half of the text outside chrome, no text is taken
    for template. Texts of one role that tie are all template, or none.
    """
    spark = pages.sparkSession
    ship(spark)
    found = stash(templates if templates is not None else learn_templates(pages, url_col, html_col), "templates")

    @F.pandas_udf("long")
    def layout(html_of: pd.Series) -> pd.Series:
        return pd.Series([layout_of([own for kind, _, own in walk(x or "") if kind == "open"]) for x in html_of], dtype="int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Template] = {}
        for batch in batches:
            texts = []
            for page, own, shape, tokens, distinct in zip(*batch.columns[2:], strict=True):
                key = own.as_py(), shape.as_py()
                if key not in known:
                    if len(known) >= 1000:
                        known.clear()
                    rows = [(t["kind"], t["role"], int(t["vector"]), t["chars"], t["links"]) for t in tokens.as_py() or ()]
                    known[key] = deduce(rows, distinct.as_py() or 0)
                texts.append(extract(*parse(page.as_py() or ""), known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"), host(F.col(url_col)).alias("host")).withColumn("layout", layout("_html"))
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    group = ["host", "layout"]
    if size <= MAX_BROADCAST_TOKENS:
        joined = source.join(F.broadcast(found), group, "left")
    else:
        # pages of one host are dealt over as many tasks as there are salts
        dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64("_url", "_html"), F.lit(SALTS)).cast("int")).join(dealt, [*group, "salt"], "left")
    columns = joined.select("_id", "_url", "_html", "host", "layout", "tokens", "n_pages")
    kind = columns.schema["_id"].dataType.simpleString()
    done = columns.mapInArrow(run, f"_id {kind}, _url string, text string")
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_template(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
