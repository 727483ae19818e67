"""HTML extraction by removal of site templates.

Every page is parsed once in a task.  Elements are hashed as subtrees (tag, attributes, text,
children); Spark counts beside how many different contents of a host each hash stands and deletes
the subtrees that stand beside many, however many pages the host has.  On pages that declare no main
content any subtree can go; inside a declared one (``article``, else ``main``) only containers of two
or more blocks or of a long one, so that a heading or sentence which articles share stays.

What a page is about is told by its rare blocks: those that, with their near copies (MinHash bands
of word triples), stand in few contents of the host.  A menu that dominates short pages therefore
does not make them alike, and the copies and near copies of an article, which have no rare block but
at most a few edited ones that count as the original, do not make their paragraphs a template.

What is a menu, header, footer, sidebar, notice, advert, form, script, style or comment section by
its tag or role, or by a class or id of listed names alone, is deleted wherever it stands, so that a
host with a single page is clean as well; a class or id never deletes headings, the page, the main
content or what it stands in.  The main text is what stays of the declared main content, or, on
pages that declare none, of the page.

Blocks end at block elements; character references are decoded; ASCII white space inside a block
becomes one space; blocks are trimmed, empty ones dropped, and joined in page order by newlines.

Defined results: null and empty html give an empty text; text before, after or without any markup
counts as the body's; unclosed elements end with the page; a null or unreadable url has the empty
host; repeated rows are extracted one by one and count as one page of their host; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.session import materialize, release

#: a subtree is a template of its host from so many different contents on
MIN_PAGES = 5
#: words from which a single block in a container of the main content can be a template
LONG_BLOCK = 50
#: near copies of a block: bands and rows of MinHash over word triples
BANDS, ROWS, WIDTH = 5, 4, 3

# HTML element names by their role.
RAW = "script style title textarea iframe noembed noframes xmp"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table "
    "tbody tfoot thead tr ul"
)
DROPPED = "aside button dialog footer form head menu nav noscript object select svg template"
DROPPED_ROLES = "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar"
# Words of class and id attributes that name boilerplate.
DROPPED_NAMES = (
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted related respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget"
)

_VOID, _BLOCK, _DROPPED = set(VOID.split()), set(BLOCK.split()), set(DROPPED.split())
_ROLES, _NAMES = set(DROPPED_ROLES.split()), set(DROPPED_NAMES.split())
#: elements that can be a template inside the main content
_CONTAINERS = set("aside blockquote center details dialog dir div dl fieldset figure footer header hgroup nav ol section table ul".split())
#: never dropped by a class or id
_KEPT = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: start tags that end an open element of the same kind
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"article", "main", "section", "div", "body", "html", "table", "ul", "ol", "dl", "blockquote", "td", "th"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW.split())})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s/>"'=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+|["'][^\s>]*+""")
_NAME_PART = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass(slots=True, eq=False)
class _Node:
    tag: str
    dropped: bool  # by its tag or role, or in such an element
    main: str  # the tag of the declared main content it is in
    parent: _Node | None = None
    named: bool = False  # its class or id names boilerplate
    parts: list = field(default_factory=list)
    digest: int = 0
    first: int = 0  # the blocks that end inside it: first to last, exclusive
    last: int = 0

    def path(self) -> Iterator[_Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent


def _names_boilerplate(value: str) -> bool:
    """One of the classes (or the id) is made of listed names alone; other names are left to the counts."""
    for word in value.split():
        parts = [p for p in _NAME_PART.findall(word) if not p.isdigit()]
        if parts and _NAMES.issuperset(parts):
            return True
    return False


def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(boilerplate by its tag, role or being hidden; by its class or id; declared as the main content by its role)"""
    if tag in _DROPPED:
        return True, False, False
    main = named = False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = (value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value).lower()
        if name in ("class", "id"):
            named = named or (tag not in _KEPT and _names_boilerplate(value))
        elif name == "role":
            if value in _ROLES:
                return True, False, False
            main = main or value == "main"
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                return True, False, False
        elif value != "false":
            return True, False, False
    return False, named, main


def _choose_main(declared: list[_Node]) -> tuple[str, set[_Node]]:
    """The tag of the declared main content, and its elements' ancestors: these stay whatever their class
    or id.  Content in an element that names boilerplate counts where no other is declared beside it."""
    in_named = {n: any(a.named for a in n.path()) for n in declared}
    mains = [n for n in declared if n.main == "main"]
    free = [n for n in mains if not in_named[n]]
    articles = [n for n in declared if n.main == "article"]
    found = [n for n in articles if not in_named[n]]
    found = found or [n for n in articles if not free or any(a in free for a in n.path())] or free or mains
    return (found[0].main, {a for n in found for a in n.path()}) if found else ("", set())


def parse(page: str) -> tuple[bool, list[str], list[tuple[int, int, int]]]:
    """(whether main content is declared, the blocks of the main content, or of the page if none is
    declared, the subtrees that can be templates: hash, first and last of their blocks)."""
    root = _Node("", False, "")
    stack = [root]
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    scopes = [0]
    blocks: list[tuple[list[tuple[str, _Node]], _Node]] = []
    text: list[tuple[str, _Node]] = []
    declared: list[_Node] = []
    closed: list[_Node] = []

    def end_block() -> None:
        if text:
            blocks.append((text.copy(), stack[-1]))
            text.clear()

    def add(piece: str) -> None:
        top = stack[-1]
        top.parts.append(piece)
        if not top.dropped:
            text.append((piece, top))

    def close() -> None:
        node = stack.pop()
        open_at[node.tag].pop()
        if scopes[-1] == len(stack):
            scopes.pop()
        node.last = len(blocks)
        if node.first < node.last:
            closed.append(node)
        if node.tag not in ("html", "body", "head"):
            node.digest = xxhash.xxh3_64_intdigest(_SPACE.sub(" ", "".join(node.parts)).strip()) - 2**63
            stack[-1].parts.append(f"<{node.digest}>")

    def close_to(at: int) -> None:
        while len(stack) > at:
            if stack[-1].tag in _BLOCK:
                end_block()
            close()

    def innermost(tags) -> int:
        """The place of the innermost open element of these, 0 if none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        if token["end"] or token["end2"]:
            if open_at.get(tag):
                close_to(open_at[tag][-1])
            elif tag in _BLOCK:
                end_block()
            continue
        if tag in _BLOCK:
            if (i := innermost(("p",))) > scopes[-1]:
                close_to(i)
            end_block()
        if tag in _CLOSES and (i := innermost(_CLOSES[tag])) and i >= scopes[-1]:
            close_to(i)
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                add("" if tag == "wbr" else " ")
            continue
        if tag in ("td", "th"):
            add(" ")
        top = stack[-1]
        attributes = token["attributes"] or token["attributes2"] or ""
        dropped, named, role = (True, False, False) if top.dropped else _kind(tag, attributes)
        if tag == "header" and not top.main:
            dropped = True
        main = top.main
        starts_main = not dropped and ((tag == "article" and main != "article") or ((tag == "main" or role) and not main))
        if starts_main:
            main = "article" if tag == "article" else "main"
        node = _Node(tag, dropped, main, top, named)
        if starts_main:
            declared.append(node)
        node.parts.append(f"{tag} {attributes} ")
        node.first = len(blocks) + bool(text)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    if at < len(page):
        add(page[at:])
    end_block()
    while len(stack) > 1:
        close()

    kind, kept = _choose_main(declared)
    gone: dict[_Node, bool] = {root: False}

    def is_gone(node: _Node) -> bool:
        if node not in gone:
            path = [node]
            while path[-1].parent not in gone:
                path.append(path[-1].parent)
            for n in reversed(path):
                gone[n] = gone[n.parent] or (n.named and n not in kept)
        return gone[node]

    found: list[str] = []
    words: list[int] = []
    before = [0]  # blocks of the result before each block
    for pieces, holder in blocks:
        if not kind or holder.main == kind:
            joined = _SPACE.sub(" ", html.unescape("".join(p for p, n in pieces if not is_gone(n)))).strip(" ")
            if joined:
                found.append(joined)
                words.append(joined.count(" ") + 1)
        before.append(len(found))
    roots = set(declared)
    subtrees = []
    for node in closed:
        first, last = before[node.first], before[node.last]
        if first < last and node.digest and not (
            kind and (node in roots or node.main != kind or node.tag not in _CONTAINERS or (last - first == 1 and words[first] < LONG_BLOCK))
        ):
            subtrees.append((node.digest, first, last - 1))
    return bool(kind), found, subtrees


def _block_keys(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each block, its MinHash bands: ``BANDS`` numbers back to back)."""
    hashes = np.array([xxhash.xxh3_64_intdigest(b) - 2**63 for b in blocks], dtype=np.int64)
    words, at = X.word_hashes(*X.text_bytes(pa.array(blocks, pa.large_string())))
    n = BANDS * ROWS
    minima = X.minhashes(*X.shingles(words, at, WIDTH), X.random_words(51, n) | X.U64(1), X.random_words(52, n))
    factors = X.random_words(53, ROWS) | X.U64(1)
    bands = (minima.reshape(len(blocks), BANDS, ROWS) * factors).sum(axis=2, dtype=X.U64) + X.random_words(54, BANDS)
    return hashes, X.mix(bands.reshape(-1)).view(np.int64)


_PARSED = (
    "page_id bigint, url string, host string, content bigint, blocks array<string>, hashes array<bigint>, bands array<bigint>, "
    "subtrees array<struct<subtree: bigint, first: int, last: int>>"
)


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("subtree", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            blocks, subtrees, contents = [], [], []
            for page in part.column("html").to_pylist():
                _, found, held = parse(page or "")
                blocks.append(found)
                subtrees.append([{"subtree": d, "first": a, "last": b} for d, a, b in held])
                contents.append(xxhash.xxh3_64_intdigest("\n".join(found)) - 2**63)
            urls = part.column("url").to_pylist()
            hosts = [m[1].lower() if (m := _HOST.match(u or "")) else "" for u in urls]
            # only pages with subtrees that can be templates need their blocks told apart
            keyed = [found if held else [] for found, held in zip(blocks, subtrees, strict=True)]
            hashes, bands = _block_keys([b for found in keyed for b in found])
            at = np.concatenate([[0], np.cumsum([len(found) for found in keyed])])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(blocks, pa.list_(pa.string())),
                    X.list_of(hashes, at), X.list_of(bands, at * BANDS), pa.array(subtrees, kind),
                ],
                names=["page_id", "url", "host", "content", "blocks", "hashes", "bands", "subtrees"],
            )


def _content_keys(contents: DataFrame, min_pages: int) -> DataFrame:
    """(host, content, key): pages with one key are about the same; without a rare block, none.

    ``contents`` (host, content, hashes, bands) are different.  Near copies of a block take the least
    hash that they share a band with, twice, and count together."""
    blocks = contents.select("host", "content", "bands", F.posexplode("hashes").alias("at", "block")).select(
        "host", "content", "block", F.slice("bands", F.col("at") * BANDS + 1, BANDS).alias("keys")
    ).dropDuplicates(["host", "content", "block"])
    blocks = materialize(blocks, "blocks")
    banded = blocks.groupBy("host", "block").agg(F.first("keys").alias("keys")).select("host", "block", F.explode("keys").alias("band"))
    near = banded.groupBy("host", "band").agg(F.min("block").alias("least"), F.max("block").alias("most")).where("least < most").drop("most")
    linked = materialize(banded.join(near, ["host", "band"]).groupBy("host", "block").agg(F.min("least").alias("least")), "linked")
    again = linked.select("host", F.col("block").alias("least"), F.col("least").alias("further"))
    classes = linked.join(again, ["host", "least"], "left").select("host", "block", F.coalesce("further", "least").alias("class"))
    classed = materialize(
        blocks.drop("keys").join(classes, ["host", "block"], "left").select("host", "content", F.coalesce("class", "block").alias("class")).distinct(), "classed"
    )
    often = classed.groupBy("host", "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "class")
    keys = classed.join(often, ["host", "class"], "left_anti").groupBy("host", "content").agg(F.min("class").alias("key"))
    keys = materialize(keys, "keys")
    release(blocks, linked, classed)
    return keys


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree): subtrees that stand beside at least ``min_pages`` different contents of the
    host, told apart by their rare blocks.  Exact copies of a page's text are one content."""
    holders = parsed.select("host", "content", F.explode("subtrees.subtree").alias("subtree")).distinct()
    often = materialize(
        holders.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "subtree"), "often"
    )
    held = materialize(holders.join(often, ["host", "subtree"]), "holders")
    hosts = often.select("host").distinct()
    contents = parsed.join(hosts, "host", "left_semi").where(F.size("hashes") > 0).select("host", "content", "hashes", "bands").dropDuplicates(["host", "content"])
    keys = _content_keys(contents, min_pages)
    found = held.join(keys, ["host", "content"]).select("host", "subtree", "key").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    found = materialize(found.where(F.col("n") >= min_pages).select("host", "subtree"), "templates")
    release(often, held, keys)
    return found


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the blocks that no cut covers."""
    for batch in batches:
        blocks, cuts = batch.column("blocks"), batch.column("cuts")
        texts = []
        for i in range(batch.num_rows):
            own = blocks[i].as_py()
            if cuts[i].is_valid:
                depth = [0] * (len(own) + 1)
                for cut in cuts[i].as_py():
                    depth[cut["first"]] += 1
                    depth[cut["last"] + 1] -= 1
                covered = 0
                kept = []
                for block, step in zip(own, depth, strict=False):
                    covered += step
                    if not covered:
                        kept.append(block)
                own = kept
            texts.append("\n".join(own))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    source = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    parsed = materialize(
        source.mapInArrow(_parse_pages, _PARSED).withColumn("row", F.monotonically_increasing_id()), "pages", compression="zstd"
    )
    known = templates(parsed, min_pages)
    held = parsed.select("row", "host", F.explode("subtrees").alias("s")).select("row", "host", "s.*")
    cuts = materialize(held.join(known, ["host", "subtree"]).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("cuts")), "cuts")
    joined = parsed.join(cuts, "row", "left").select("page_id", "url", "blocks", "cuts")
    return joined.mapInArrow(_without, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
