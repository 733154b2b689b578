"""HTML extraction by equivalence-class template deduction over the pages of a host.

Every page becomes tokens: its container tags, each with its path of tags and names, and its texts.  Tokens of one
host that occur equally often on every page, that is with the same occurrence vector, form an equivalence class.
A vector is kept as the page count and two sums of hashes of (page, count), which add up over any parts of the
data, so no host's pages ever meet in one task.

A container's class is valid if it is on at least ``least`` pages and a tenth of the host's.  A text's class is
valid if it is on half of the host's pages and holds a tag too: then the text belongs to the template.  Valid
classes nest by their paths, each in the slot of the nearest valid container around it, from the page itself
inwards; that is the host's template.  What stands between template tokens is slots; for each container the template knows how
much slot text the host's pages have in it on average (links left out) and how much right in it.

Extraction walks the template from the outermost container of the page inwards: into the nested container with
the most slot text, as long as it has half of all and no slot text stands right in the present one.  Where the walk
ends are the main slots; a level-one heading right in a container passed on the way belongs to them.  ``article``
and ``main`` are tokens like all others, but their slot text counts fourfold in the choice.  In the main slots, tags
that aren't the article's (menus, footers, forms, side notes, scripts), parts whose class, id or role says
advert, notice, comments or the like and nothing else (`marked`), texts other than headings in a ``header``, and
texts of the template go.

Pages of hosts with fewer than ``least`` pages share the template of all such pages; where there are too
few for that too, a page is its own template.  Each block's white space becomes one space; blocks are trimmed and
joined by a line end.  Broken and cut-off mark-up is read as far as it goes.  Null and empty pages give the empty
text, an empty table an empty table.  Pages with a null or odd url share one host.  Repeated rows count as one page
each.  Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut, ship

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
#: Tags by their part in a page.
RAW = set("script style noscript template textarea title iframe svg math select option canvas audio video object".split())
SKIPPED = RAW | set("nav aside footer form button head dialog menu fieldset label input datalist".split())
CONTAINERS = set("html body div section article main nav aside header footer form ul ol dl table td th tr tbody thead figure details dialog menu blockquote center fieldset".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary caption legend option".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words that name a part that isn't the article's, and words of layout that may stand with them.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar "
    "cookie cookies consent notice notices alert gdpr popup modal overlay comment comments reply replies disqus discussion form login signup subscribe subscription newsletter share sharing social related "
    "recommended recommendations widget widgets pagination pager toolbar contentinfo complementary".split()
)
LAYOUT = set("area bar block box bottom container first header inner item items last left list outer panel right row section site slot small top unit wrap wrapper".split())
MOST_SENT = 32 << 20
#: How much more slot text in these tags counts when the main container is chosen.
HINT, HINTED = 4, re.compile(r"/(article|main)([./]|$)")
FIXED, OPEN, OFF = 0, 1, 2


class Block(NamedTuple):
    """A piece of text right in a container, or with the empty text the opening of one."""

    path: str
    off: bool
    header: bool
    tag: str
    text: str
    free: int  # characters outside of links


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


@lru_cache(maxsize=1 << 16)
def path_hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) >> 1


def text_hash(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") >> 1


def marked(names: list[str]) -> bool:
    """Whether a name consists of words that mark a part and words of layout only."""
    for name in names:
        words = set(re.split(r"[_\-]+", name)) - {""}
        if words & MARKS and words <= MARKS | LAYOUT:
            return True
    return False


@lru_cache(maxsize=1 << 16)
def _opened(tag: str, attrs: str) -> tuple[str, bool]:
    """A container's label, and whether it is no part of an article."""
    found = {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(attrs))} if attrs else {}
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().split()
    off = tag in SKIPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or tag not in ("html", "body") and marked(names)
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", n).replace("/", "|") for n in names})]), off


def blocks(html: str) -> Iterator[Block]:
    """The containers as they open and the blocks with text, in page order."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, off, in a header
    path, off, header = "", False, False
    piece: list[str] = []
    raw, tag_now, links, linked = "", "", 0, 0

    def text_block() -> Iterator[Block]:
        nonlocal linked
        text = " ".join(unescape("".join(piece)).split())
        piece.clear()
        if text:
            yield Block(path, off, header, tag_now, text, max(0, len(text) - linked))
        linked = 0

    for m in TOKEN.finditer(html):
        closing, tag, attrs, _ = m.groups()
        if tag is None:
            if not raw and not m[0].startswith(("<!", "<?")):
                piece.append(m[0])
                if links:
                    linked += len(m[0].strip())
            continue
        tag = tag.lower()
        if raw:
            if closing and tag == raw:
                raw = ""
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag in BLOCKS or tag in SKIPPED:
            yield from text_block()
            tag_now = "" if closing or tag in CONTAINERS else tag
            links = 0
        if tag in RAW and tag not in CONTAINERS:
            if not closing and not attrs.rstrip().endswith("/"):
                raw = tag
            continue
        if tag in VOID or tag not in CONTAINERS and tag not in SKIPPED:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    path, off, header = stack[-1][1:] if stack else ("", False, False)
                    break
            continue
        label, is_off = _opened(tag, attrs)
        path, off, header = f"{path}/{label}", off or is_off, header or tag == "header"
        stack.append((tag, path, off, header))
        yield Block(path, off, header, "", "", 0)
    if not raw:
        yield from text_block()


def page_tokens(html: str) -> dict[int, tuple[int, int, str | None, int, int | None]]:
    """For each token of a page: its count, its slot characters, its path if it is a container, its kind, a text's container."""
    count, chars, more = Counter({path_hash(""): 1}), Counter(), {path_hash(""): ("", OPEN, None)}
    for b in blocks(html):
        own = path_hash(b.path)
        if not b.text:
            count[own] += 1
            more[own] = (b.path, OFF if b.off or b.header else OPEN, None)
        elif not b.off:
            t = text_hash(b.path, b.text)
            count[t] += 1
            more[t] = (None, FIXED, own)
            if not b.header:
                chars[own] += b.free
                chars[t] += b.free
    return {t: (k, chars[t], *more[t]) for t, k in count.items()}


PARTS = "host string, token long, pages long, v1 long, v2 long, chars long, path string, kind int, parent long"


def _tokens(batches):
    """The occurrence vectors' parts over one run of pages."""
    import pyarrow as pa

    held: dict[tuple[str, int], list] = {}

    def flush():
        keys = list(held)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
        cols += [pa.array([held[k][j] for k in keys], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()))]
        held.clear()
        return pa.RecordBatch.from_arrays(cols, names=["host", "token", "pages", "v1", "v2", "chars", "path", "kind", "parent"])

    for batch in batches:
        for n, url, html in zip(batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
            host = host_of(url.as_py())
            for t, (k, chars, path, kind, parent) in page_tokens(html.as_py() or "").items():
                v = xxhash.xxh3_64_intdigest(f"{n.as_py()}:{k}")
                row = held.setdefault((host, t), [0, 0, 0, 0, path, kind, parent])
                row[0] += 1
                row[1] += v & 0xFFFFFFFF
                row[2] += v >> 32
                row[3] += chars
        if len(held) > 200_000:
            yield flush()
    if held:
        yield flush()


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "token").agg(*(F.sum(c).alias(c) for c in ("pages", "v1", "v2", "chars")), F.max("path").alias("path"), F.max("kind").alias("kind"), F.max("parent").alias("parent"))


def templates(pages: DataFrame, least: int = 3) -> DataFrame:
    """(host, known, nodes): the hashes of the texts in each host's template, and its containers.

    A node has its path's hash, the mean slot text in it and right in it.  The row of the null host is the
    template of all hosts with fewer than ``least`` pages.
    """
    rows = _sums(pages.select("page_id", "url", "html").mapInArrow(_tokens, PARTS), "host")
    tokens = cut(rows.where((F.col("kind") > FIXED) | (F.col("pages") >= least)))
    size = tokens.where(F.col("token") == path_hash("")).select("host", F.col("pages").alias("all"))
    pool = _sums(tokens.where(F.col("kind") > FIXED).join(size.where(F.col("all") < least), "host", "left_semi").withColumn("host", F.lit(None).cast("string")), "host")
    every = pool.where(F.col("token") == path_hash("")).agg(F.max("pages")).first()[0] or 0
    classes = tokens.join(size.where(F.col("all") >= least), "host")
    if every >= least:
        classes = classes.unionByName(pool.withColumn("all", F.lit(every).cast("long")))
    tags = classes.where(F.col("kind") > FIXED)
    # A class is the tokens of a host with one vector; a lone text's class has no tag to hang it into the template.
    held = tags.select("host", "pages", "v1", "v2").distinct()
    fixed = cut(classes.where((F.col("kind") == FIXED) & (F.col("pages") * 2 >= F.col("all"))).join(held, ["host", "pages", "v1", "v2"], "left_semi"))
    texts = fixed.groupBy("host").agg(F.collect_set("token").alias("known"))
    taken = fixed.groupBy("host", F.col("parent").alias("token")).agg(F.sum("chars").alias("fixed"))
    boxes = tags.where(F.col("kind") == OPEN).join(taken, ["host", "token"], "left")
    boxes = cut(boxes.select("host", "token", "path", "pages", "all", (F.col("chars") - F.coalesce("fixed", F.lit(0))).alias("own")))
    # Slot text counts for every container around it.
    parts = F.split("path", "/")
    around = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    volume = boxes.where("own > 0").select(F.col("host").alias("_host"), F.explode(around).alias("_path"), "own").groupBy("_host", "_path").agg(F.sum("own").alias("within"))
    nodes = boxes.where((F.col("pages") >= least) & (F.col("pages") * 10 >= F.col("all")))
    nodes = nodes.join(volume, F.col("host").eqNullSafe(F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    mean = lambda c: (F.coalesce(F.col(c), F.lit(0)) / F.col("pages")).alias(c)
    nodes = nodes.groupBy("host").agg(F.collect_list(F.struct("token", mean("within"), mean("own"))).alias("nodes"))
    return nodes.join(texts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left").select("host", "known", "nodes")


class Template(NamedTuple):
    known: frozenset[int]
    nodes: dict[int, tuple[float, float]]  # of each container's path: slot text in it, and right in it


def _as_template(known, nodes) -> Template:
    return Template(frozenset(known or ()), {n["token"]: (n["within"], n["own"]) for n in nodes or ()})


def own_template(found: list[Block]) -> Template:
    """A page as its own template."""
    own = Counter()
    for b in found:
        own[b.path] += 0 if b.off or b.header else b.free
    within = Counter()
    for path, n in own.items():
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            within["/".join(parts[:i])] += n
    return Template(frozenset(), {path_hash(p): (float(n), float(own[p])) for p, n in within.items()})


def main_path(found: list[Block], nodes: dict[int, tuple[float, float]]) -> str:
    """The path of the container with the main slots: the walk from the page inwards."""
    inside: dict[str, set[str]] = {}
    for b in found:
        if not b.text and not b.off and not b.header and path_hash(b.path) in nodes:
            around = b.path.rpartition("/")[0]
            while around and path_hash(around) not in nodes:
                around = around.rpartition("/")[0]
            inside.setdefault(around, set()).add(b.path)
    now = ""
    while now in inside:
        weight = {p: nodes[path_hash(p)][0] * (HINT if HINTED.search(p) else 1) for p in inside[now]}
        best = max(weight, key=lambda p: (weight[p], p))
        own = nodes.get(path_hash(now), (0.0, 0.0))[1]
        outer = not now or now.rpartition("/")[2].partition(".")[0] in ("html", "body")
        if not weight[best] or 2 * weight[best] < sum(weight.values()) + own or own >= 1 and not outer:
            break
        now = best
    return now


def main_text(html: str, template: Template | None) -> str:
    """The blocks in the main slots of one page."""
    found = list(blocks(html))
    known, nodes = template or own_template(found)
    main = main_path(found, nodes)
    outer = main.rpartition("/")[2].partition(".")[0] in ("", "html", "body")
    out = []
    for b in found:
        if not b.text or b.off or known and text_hash(b.path, b.text) in known:
            continue
        if b.path == main or not main or b.path.startswith(main + "/"):
            if not b.header or b.tag in HEADINGS and not outer:
                out.append(b.text)
        elif b.tag == "h1" and not b.header and (not b.path or main.startswith(b.path + "/")):
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, least: int = 3, salts: int = 64) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    The templates are sent to every task while they stay under ``MOST_SENT`` bytes; beyond that they are joined by
    host, each host's pages dealt over ``salts`` parts.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    ship(spark)
    pages = pages.select("page_id", "url", "html")
    made = cut(templates(pages, least))
    size = made.agg(F.sum(F.length("host") + 8 * F.coalesce(F.size("known"), F.lit(0)) + 24 * F.size("nodes") + 64)).first()[0] or 0
    shared = made.where("host is null").first()
    few = size <= MOST_SENT
    sent = spark.sparkContext.broadcast(({r.host: _as_template(r.known, r.nodes) for r in made.collect()} if few else {}, _as_template(shared.known, shared.nodes) if shared else None))

    def named(batches):
        for batch in batches:
            hosts = pa.array([host_of(u.as_py()) for u in batch.column("url")], pa.string())
            yield batch.append_column("host", hosts)

    def run(batches):
        by_host, pool = sent.value
        for batch in batches:
            if few:
                used = [by_host.get(host_of(u.as_py()), pool) for u in batch.column("url")]
            else:
                used = [_as_template(k.as_py(), n.as_py()) if n.is_valid else pool for k, n in zip(batch.column("known"), batch.column("nodes"), strict=True)]
            text = [main_text(h.as_py() or "", t) for h, t in zip(batch.column("html"), used, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    out = "page_id long, url string, text string"
    if few:
        return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, out)
    hosted = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(named, "page_id long, url string, html string, host string")
    spread = made.where("host is not null").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = hosted.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts))).join(spread, ["host", "_salt"], "left")
    return both.select("page_id", "url", "html", "known", "nodes").mapInArrow(run, out)
