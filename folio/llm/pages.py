"""HTML extraction by template deduction from equivalence classes.

A page is a sequence of tokens: its tags with their paths, and its text nodes. Over the pages of a host every token has an
occurrence vector, its counts by page. Vectors are not built: an order-free hash of (page, count) stands for them, so
Spark groups tokens by partial aggregation, whatever the size of a host. Tokens with equal vectors form an equivalence
class. A class is valid with at least `LEAST_PAGES` pages and `LEAST_TOKENS` tokens. Valid classes nest: a class lies in the
one whose element is nearest above it, and so on no more pages than that. The host's template is made of the classes that
have elements, such as each of its layouts, and of the classes of texts alone that stand on `TEMPLATE_SHARE` of the pages
of the class around them; fewer pages with a passage in common are no layout. What the template leaves open are its slots.

A slot is dropped when its path lies in the frame of a page (menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles, comments: by element, class or id), when most of its text is links outside an article, or when its text
is part of the template itself. The last two are judged on whole blocks, so no sentence loses its links or its fixed words:
a block is mostly links if it is so itself and so are, together, all blocks with its path on the host (links and the text
beside them); it belongs to the template if every text in it does. Pages whose host has no valid template are judged by
their paths alone. Where a page has an article or main element with text, only that element is read.

Blocks end at block-level tags; a line break is white space. Null and empty pages give an empty text; repeated rows are
extracted alike. Other columns are carried along, those named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged

LEAST_PAGES = 5
LEAST_TOKENS = 2
#: Texts of a class without elements are part of the template on this share of the pages of the class around it.
TEMPLATE_SHARE = 0.6
LINK_SHARE = 0.6
SALTS = 16
#: HTML elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
FRAME = set(
    "nav header footer aside form head script style noscript template iframe svg math button select textarea input menu"
    " dialog title object canvas audio video".split()
)
_FRAME = (
    r"ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?|banner|sidebar|nav|navbar|navigation|menu"
    r"|breadcrumbs?|header|masthead|footer|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|share"
    r"|sharing|social|related|recommended|comments?|respond|replies|disqus|pagination|pager|widget|toolbar"
)
#: Whole class or id names, or names of parts of a page in front of one (`site-header`) or of forms of one behind (`nav-list`).
FRAME_NAMES = re.compile(
    rf"(?:{_FRAME}|side|form|search|(?:search|login|signup|comment|contact|subscribe|newsletter)[-_](?:form|box|bar|field)"
    r"|(?:side|nav|menu|tool|ad|cookie|consent|notice|alert|share|social|promo)[-_]?(?:bar|box|banner|menu|nav|list|links|items?"
    r"|buttons?|icons?|wrapper|container|area|block|slot|unit)"
    rf"|(?:site|page|global|main|primary|secondary|top|bottom|left|right|mobile|sticky)[-_](?:{_FRAME})"
    r"|(?:reader|user|post|article|blog|entry|disqus|fb|facebook)[-_]comments?|comments?[-_](?:list|area|section|wrapper|thread)"
    r"|(?:related|recommended)[-_](?:posts?|articles?|links?|stories|content|items?)"
    r"|(?:share|social|sharing|post|article)[-_](?:share|sharing|social|buttons?|icons?)"
    r"|(?:cookie|privacy|consent|gdpr)[-_](?:notice|consent|banner|popup|modal))",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "alert", "dialog"}
#: What opening an element closes, if it is open in the same block.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
CLOSE_P = BLOCKS - {"body", "html", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*)", re.S)
#: One attribute of a tag, its value with it.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Names do not contain the signs that a path is made of.
SIGNS = str.maketrans("/@!", "___")


def label(name: str, rest: str) -> str:
    """An element as a path names it: its tag, with class, id and role."""
    name = name.translate(SIGNS)
    if "=" not in rest and "hidden" not in rest.lower():
        return name
    found: dict[str, str] = {}
    for a, x, y, z in ATTRIBUTE.findall(rest):
        found.setdefault(a.lower(), x or y or z)
    marks = " ".join(v for k in ("class", "id") if (v := " ".join(found.get(k, "").split()))).translate(SIGNS)
    role = found.get("role", "").strip().lower().translate(SIGNS)
    return name + (f".{marks}" if marks else "") + (f"@{role}" if role else "") + ("!" if "hidden" in found else "")


def framing(element: str) -> bool:
    """Whether an element of a path belongs to the frame of a page."""
    body, _, role = element.partition("@")
    name, _, marks = body.partition(".")
    if name.rstrip("!") in FRAME or role.rstrip("!") in ROLES or element.endswith("!"):
        return True
    return bool(marks) and any(FRAME_NAMES.fullmatch(m) for m in marks.rstrip("!").split())


def parsed(page: str | None, tags: bool = False) -> Iterator[tuple[str, str, int, bool]]:
    """The texts of a page in order: path, text, number of the block, whether it lies in a link; with `tags`, an empty text
    for every element that opens."""
    page = page or ""
    stack: list[tuple[str, str]] = []
    block, at, path, link = 0, 0, "", False
    end = len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            text = entities.unescape(page[at:stop])
            if text.strip():
                yield path, text, block, link
            elif text:
                yield path, " ", block, link
        if not found:
            return
        at = found.end()
        token = found.group()
        tag = TAG.match(token.rstrip(">")) if token[1] not in "!?" else None
        if tag is None:
            continue
        closing, name, rest = tag.group(1), tag.group(2).lower(), tag.group(3)
        block += name in BLOCKS
        if closing:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if place is not None and (name in BLOCKS or not any(n in BLOCKS for n, _ in stack[place + 1 :])):
                del stack[place:]
        elif name == "br":
            yield path, " ", block, link
        elif name in VOID:
            pass
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        else:
            if name in CLOSE_P:
                _close(stack, {"p"}, {"button", "td", "th", "table"})
            if name in CLOSES:
                _close(stack, CLOSES[name], SCOPE.get(name, {"table"}))
            stack.append((name, label(name, rest)))
        path = "/".join([mark for _, mark in stack])
        link = any(n == "a" for n, _ in stack)
        if tags and not closing and name not in VOID and name not in RAW:
            yield path, "", block, link


def _close(stack: list[tuple[str, str]], names: set[str], scope: set[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in scope:
            return


def inside(path: str) -> bool:
    """Whether a path lies in an article or main element."""
    names = [e.partition(".")[0].partition("@") for e in path.split("/")]
    return any(n in ("article", "main") or role == "main" for n, _, role in names)


def block_path(path: str) -> str:
    """A path up to its last block element: that of the block which holds a text."""
    elements = path.split("/")
    while elements and re.split("[.@!]", elements[-1], maxsplit=1)[0] not in BLOCKS:
        elements.pop()
    return "/".join(elements)


def framed(path: str) -> bool:
    return any(framing(e) for e in path.split("/"))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page: each path with its count of elements, the letters of its blocks, and each text outside articles as a token of its own."""
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"]):
            own = _hash(page or "")
            paths: dict[str, list[int]] = {}
            holders: dict[str, str] = {}
            texts: dict[tuple[str, int], int] = {}
            for path, text, _, link in parsed(page, tags=True):
                n = len(text.strip())
                if path not in holders:
                    holders[path] = block_path(path)
                    paths.setdefault(holders[path], [0, 0, 0])
                paths.setdefault(path, [0, 0, 0])[0] += text == ""
                seen = paths[holders[path]]
                seen[1] += n
                seen[2] += n * link
                if n and not inside(path):
                    key = path, _hash(" ".join(text.split()))
                    texts[key] = texts.get(key, 0) + 1
            rows += [(host, own, p, None, c, n, m) for p, (c, n, m) in paths.items()]
            rows += [(host, own, p, t, c, 0, 0) for (p, t), c in texts.items()]
        made = pd.DataFrame(rows, columns=["host", "page", "path", "text", "n", "chars", "link_chars"], dtype=object)
        yield made.astype({"text": "Int64"})  # a float column would round the hashes


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host with a valid template: host, drop_paths (of blocks made of links), drop_texts (hashes of `path` and text)."""
    # Copies of a page say nothing about a template: each different page of a host counts once.
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    schema = "host string, page long, path string, text long, n int, chars long, link_chars long"
    tokens = staged(rows.mapInPandas(_tokens, schema).distinct(), "page-tokens")
    vector = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    seen = tokens.groupBy("host", "path", "text").agg(
        vector, F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars")
    )
    # Tokens of a class stand on the same pages: texts on fewer pages are in no valid one.
    seen = staged(seen.where(F.col("text").isNull() | (F.col("pages") >= LEAST_PAGES)), "page-classes")
    classes = seen.groupBy("host", "vector").agg(
        F.count("*").alias("tokens"), F.max("pages").alias("support"), F.max(F.col("text").isNull()).alias("has_elements")
    )
    valid = classes.where((F.col("tokens") >= LEAST_TOKENS) & (F.col("support") >= LEAST_PAGES))
    members = seen.join(valid, ["host", "vector"])
    hosts = valid.groupBy("host").agg(F.max("support").alias("top"))
    texts = members.where(F.col("text").isNotNull())
    # The class around a text: that of the nearest element above it which is in a class; without one, the widest of the host.
    around = members.where(F.col("text").isNull()).select("host", F.col("path").alias("above"), F.col("support").alias("outer"))
    prefixes = "transform(split(path, '/'), (e, k) -> array_join(slice(split(path, '/'), 1, k + 1), '/'))"
    alone = texts.where(~F.col("has_elements")).withColumn("above", F.explode(F.expr(prefixes)))
    nested = alone.join(around, ["host", "above"], "left").groupBy("host", "path", "text").agg(
        F.max("support").alias("support"), F.max_by("outer", F.when(F.col("outer").isNotNull(), F.length("above"))).alias("outer")
    )
    nested = nested.join(hosts, "host").where(F.col("support") >= TEMPLATE_SHARE * F.coalesce("outer", "top"))
    fixed = texts.where("has_elements").select("host", "path", "text").unionByName(nested.select("host", "path", "text"))
    # Slots made of links.
    slots = seen.where(F.col("text").isNull() & (F.col("link_chars") > LINK_SHARE * F.col("chars"))).join(hosts, "host")
    drops = slots.select("host", F.col("path"), F.lit(None).cast("long").alias("text")).unionByName(
        fixed.select("host", "path", "text")
    )
    return drops.groupBy("host").agg(
        F.collect_set(F.when(F.col("text").isNull(), F.col("path"))).alias("drop_paths"),
        F.collect_set(F.when(F.col("text").isNotNull(), F.concat_ws("\n", "path", F.col("text").cast("string")))).alias("drop_texts"),
    )


def page_text(page: str | None, drop_paths=(), drop_texts=()) -> str:
    """The open slots of a page, as blocks."""
    verdicts: dict[str, tuple[bool, bool, bool]] = {}
    # Per kind, the blocks: number, texts, letters, letters in links, letters in texts of the template, whether a slot of links.
    blocks: dict[bool, list[list]] = {True: [], False: []}
    links, fixed = set(drop_paths), set(drop_texts)
    for path, text, block, link in parsed(page):
        if path not in verdicts:
            verdicts[path] = framed(path), inside(path), bool(links) and block_path(path) in links
        dropped, main, linked = verdicts[path]
        if dropped:
            continue
        own = blocks[main]
        if not own or own[-1][0] != block:
            own.append([block, [], 0, 0, 0, linked])
        last = own[-1]
        last[1].append(text)
        n = len(text.strip())
        last[2] += n
        last[3] += n * link
        if n and fixed and not main and f"{path}\n{_hash(' '.join(text.split()))}" in fixed:
            last[4] += n
    for main in (True, False):
        found = []
        for _, parts, n, in_links, in_template, linked in blocks[main]:
            if not main and n and (linked and in_links > LINK_SHARE * n or in_template == n):
                continue
            if t := " ".join("".join(parts).split()):
                found.append(t)
        if found:
            return "\n".join(found)
    return ""


def extract(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """`pages` with the columns text and n_chars (code points) in place of the html."""
    pages = pages.drop("text", "n_chars")
    known = staged(templates(pages, url, html), "templates")
    known = known.select(
        F.col("host").alias("__host"), "drop_paths", "drop_texts",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"),
    )
    salted = pages.withColumns({"__host": host_of(url), "__salt": F.pmod(F.xxhash64(F.col(page_id)), F.lit(SALTS)).cast("int")})

    @F.arrow_udf("string")
    def texts(htmls: pa.Array, paths: pa.Array, fixed: pa.Array) -> pa.Array:
        return pa.array([page_text(h.as_py(), p.as_py() or (), t.as_py() or ()) for h, p, t in zip(htmls, paths, fixed)], pa.string())

    joined = salted.join(known, ["__host", "__salt"], "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c != html]
    out = joined.select(*kept, texts(F.col(html), F.col("drop_paths"), F.col("drop_texts")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
