"""Main text of web pages: blocks by markup, and boilerplate by suffix arrays over each host's token streams."""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch, small_batches
from listwright.llm.words import WordHashes, fold, gram_hashes

C = F.col

# The markup's own names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul", "head",
}
#: Never article text, whatever stands in them.
AWAY = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
MAIN = {"article", "main"}
#: Words of class and id names that mark page furniture.
FURNITURE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "privacy", "promo",
    "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget",
}
#: Names that do not mark furniture inside an article.
OWN = {"header", "banner", "notice", "notices", "tags", "widget"}
SIBLINGS = {"option", "tr", "td", "th"}
P_ENDS = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "head"}

TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>?"""
    r"""|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
SCHEME = re.compile(r"^[a-zA-Z][\w+.-]*://")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    #: Inside markup that is never article text.
    away: bool
    #: Inside an article or main element.
    main: bool


def _named_furniture(value: str, inside: bool) -> bool:
    """Does a class or id name furniture by its first or last part? Inside an article a header is the article's own."""
    for word in value.split():
        parts = NAME_PART.findall(word)
        if parts and parts[0] not in ("has", "no", "with", "without"):
            if any(p in FURNITURE and not (inside and p in OWN) for p in (parts[0], parts[-1])):
                return True
    return False


def _furniture(name: str, rest: str, inside: bool) -> bool:
    if name in AWAY or name == "header" and not inside:
        return True
    if name in ("html", "body"):
        return False
    for key, a, b, c in ATTRIBUTE.findall(rest) if rest.strip() else ():
        key, value = key.lower(), references.unescape(a or b or c).lower()
        if key in ("class", "id") and _named_furniture(value, inside or name in MAIN):
            return True
        if key == "role" and value.strip() in ROLES and not inside or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and HIDDEN.search(value):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Open elements end at their end tag, at an outer one's, or at the page's end."""
    out: list[Block] = []
    kept: list[str] = []
    gone: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture here or outside, main here or outside
    away = main = False
    at = 0

    def close() -> None:
        for held, flag in ((kept, False), (gone, True)):
            if held:
                text = SPACE.sub(" ", references.unescape("".join(held))).strip()
                if text:
                    out.append(Block(text, flag, main))
                held.clear()

    while True:
        tag = TAG.search(page, at)
        piece = page[at : tag.start()] if tag else page[at:]
        if piece:
            (gone if away else kept).append(piece)
        if tag is None:
            break
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        blocklike = name in BLOCK or name in AWAY
        if blocklike:
            close()
        elif name == "br":
            (gone if away else kept).append(" ")
        if tag["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            # A block's end also ends what is open inside it; an inline element's does not reach over blocks.
            if k is not None and (blocklike or not any(n in BLOCK or n in AWAY for n, _, _ in stack[k + 1 :])):
                del stack[k:]
                _, away, main = stack[-1] if stack else ("", False, False)
            continue
        rest = tag["rest"] or ""
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in P_ENDS:
            # A new block ends an open paragraph, and the inline elements left open in it.
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK or stack[k][0] in AWAY), None)
            if k is not None and stack[k][0] == "p":
                del stack[k:]
        elif name in SIBLINGS:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), None)
            if k is not None and stack[k][0] == name:
                del stack[k:]
        _, outer_away, outer_main = stack[-1] if stack else ("", False, False)
        away = outer_away or _furniture(name, rest, outer_main)
        main = outer_main or name in MAIN
        stack.append((name, away, main))
    close()
    return out


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` tokens at least, by prefix doubling."""
    n, step = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < depth and step < n:
        following = np.full(n, -1, dtype=np.int64)
        following[: n - step] = rank[step:]
        order = np.lexsort((following, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (following[order][1:] != following[order][:-1])
        ranks = np.concatenate(([0], np.cumsum(new)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        if ranks[-1] == n - 1:
            break
        step *= 2
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each suffix with the one before it in the order."""
    n = len(tokens)
    out, alive = np.zeros(n, dtype=np.int64), np.ones(max(0, n - 1), dtype=bool)
    a, b = order[:-1], order[1:]
    for k in range(most):
        alive &= np.maximum(a, b) + k < n
        alive[alive] = tokens[a[alive] + k] == tokens[b[alive] + k]
        if not alive.any():
            break
        out[1:][alive] += 1
    return out


def shared_runs(streams: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``least`` tokens, as hashes, and how many of the streams hold each."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # Every stream ends with a token of its own, so no run reaches over a page's end.
    owner = np.repeat(np.arange(len(streams)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(owner), dtype=bool)
    inner[ends] = False
    words = np.zeros(len(owner), dtype=np.uint64)
    words[inner] = np.concatenate(streams)
    tokens = np.empty(len(owner), dtype=np.int64)
    tokens[ends] = np.arange(len(streams))
    tokens[inner] = np.unique(words[inner], return_inverse=True)[1] + len(streams)
    order = suffix_array(tokens, least)
    group = np.cumsum(common_prefixes(tokens, order, least) < least) - 1
    whole = np.zeros(len(tokens), dtype=bool)
    if len(tokens) > least:
        gaps = np.cumsum(~inner)
        whole[: len(tokens) - least] = gaps[least - 1 : -1] == np.concatenate(([0], gaps[:-1]))[: len(tokens) - least]
    pairs = np.unique(np.stack((group, owner[order]), axis=1)[whole[order]], axis=0)
    count = np.bincount(pairs[:, 0], minlength=int(group[-1]) + 1)
    first = order[np.searchsorted(group, np.arange(int(group[-1]) + 1))]
    runs = np.flatnonzero(count)
    return gram_hashes(words, least)[first[runs]], count[runs]


#: The words that ``bytes.split`` gives.
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@dataclass(frozen=True)
class Settings:
    #: Words of a run that counts as repeated; pages of one host, and share of its different pages, that must hold it.
    least_words: int = 4
    pages: int = 3
    share: float = 0.1
    #: Words that repeated runs must cover without a gap before they are cut from a block that has others.
    long_words: int = 8
    #: Pages of one host whose streams share a suffix array. Hosts with more are dealt into several groups.
    group_pages: int = 400


def extract(spark: SparkSession, pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every row of ``pages (page_id, url, html, ...)``.

    Markup decides where it speaks: navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments are left out, text of article and main elements is kept whole. Text that is in neither is kept
    where it is unique: the streams of such text of one host are joined, a suffix array finds runs that distinct
    pages share, and long parts of blocks or whole blocks that such runs cover are left out; the
    other words of a block stay. Pages of equal text outside marked regions are counted as one page. Null or empty html gives an empty text; a null url is a host of its own.
    Repeated rows are pages of their own; an empty table gives no row; other columns are ignored.
    """
    small_batches(spark, 256)
    s = settings
    scratch = Scratch(spark, "html")

    # Equal rows have equal results, so a row is known by the hash of its columns.
    source = pages.select(C("page_id").cast("bigint").alias("page_id"), "url", "html")
    source = source.select(F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", "html")

    def read(batches):
        for batch in batches:
            texts = [[b.text for b in blocks_of(page or "") if not b.away] for page in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.list_(pa.string()))], ["row", "page_id", "url", "blocks"])

    def outside(batches):
        memo = WordHashes()
        for batch in batches:
            hosts, streams, owners = [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hosts.append(SCHEME.sub("", url or "").split("/")[0].lower())
                stream, owner, at = [], [], -1
                for b in blocks_of(page or ""):
                    at += not b.away
                    if not b.main:
                        words = fold(b.text).split()
                        stream += words
                        owner += [-1 if b.away else at] * len(words)
                streams.append(memo.of(stream).view(np.int64))
                owners.append(owner)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(hosts, pa.string()), pa.array(streams, pa.list_(pa.int64())), pa.array(owners, pa.list_(pa.int32())),
            ], ["row", "host", "stream", "owner"])

    streams = source.select("row", "url", "html").mapInArrow(outside, "row bigint, host string, stream array<bigint>, owner array<int>")
    streams = scratch.keep(streams.filter(F.size("stream") >= s.least_words), "streams")

    # A host's pages are dealt into groups of bounded size; counts of equal runs are added up over its groups.
    own = F.filter("stream", lambda x, k: F.get("owner", k) >= 0)
    different = streams.withColumn("key", F.xxhash64(F.when(F.size(own) > 0, own).otherwise(C("stream"))))
    different = scratch.keep(different.groupBy("host", "key").agg(F.min("row").alias("row"), F.min_by("stream", "row").alias("stream")), "different")
    n = F.count(F.lit(1))
    sizes = different.groupBy("host").agg(F.ceil(n / s.group_pages).alias("groups"), F.greatest(F.lit(s.pages), F.ceil(n * s.share)).alias("least"))
    dealt = different.select("row", "host", "stream").join(sizes, "host")
    dealt = dealt.select("host", F.pmod(F.xxhash64("row"), "groups").alias("part"), "stream")

    def arrays(key, table):
        own = [np.array(x, dtype=np.int64).view(np.uint64) for x in table.column("stream").to_pylist()]
        runs, count = shared_runs(own, s.least_words)
        host = pa.array([key[0].as_py()] * len(runs), pa.string())
        return pa.table({"host": host, "run": pa.array(runs.view(np.int64)), "n": pa.array(count, pa.int64())})

    runs = dealt.groupBy("host", "part").applyInArrow(arrays, "host string, run bigint, n bigint")
    common = runs.groupBy("host", "run").agg(F.sum("n").alias("n")).filter(C("n") >= s.pages)
    common = common.join(sizes.select("host", "least"), "host").filter(C("n") >= C("least")).select("host", "run")

    def places(batches):
        for batch in batches:
            rows, hosts, runs, firsts, owners = [], [], [], [], []
            for row, host, stream, owner in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = gram_hashes(np.array(stream, dtype=np.int64).view(np.uint64), s.least_words).view(np.int64)
                rows += [row] * len(hashes)
                hosts += [host] * len(hashes)
                runs.append(hashes)
                firsts += range(len(hashes))
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), pa.array(np.concatenate(runs) if runs else [], pa.int64()), pa.array(firsts, pa.int32()),
            ], ["row", "host", "run", "first"])

    # Only pages with text outside any marked region have something to decide.
    undecided = streams.filter(F.exists("owner", lambda k: k >= 0))
    held = undecided.mapInArrow(places, "row bigint, host string, run bigint, first int").join(common, ["host", "run"])
    held = held.groupBy("row").agg(F.collect_set("first").alias("firsts"))

    def covered(batches):
        for batch in batches:
            out = []
            for owner, firsts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                owner, mark, far = np.array(owner), np.zeros(len(owner), dtype=bool), np.zeros(len(owner), dtype=bool)
                # Runs that start one word after another make up a longer one.
                firsts = np.sort(np.array(firsts))
                for chain in np.split(firsts, np.flatnonzero(np.diff(firsts) > 1) + 1):
                    end = chain[-1] + s.least_words
                    mark[chain[0] : end] = True
                    far[chain[0] : end] |= end - chain[0] >= s.long_words
                cuts = []
                for b in np.unique(owner[owner >= 0]).tolist():
                    inside = mark[owner == b]
                    inside = inside if inside.all() and len(inside) < s.long_words else far[owner == b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))).tolist()
                    for first, end in zip(edges[::2], edges[1::2]):
                        cuts += [b, first, end]
                out.append(cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["row", "cuts"])

    def rest(batches):
        for batch in batches:
            out = []
            for blocks, cuts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                by_block: dict[int, list[tuple[int, int]]] = {}
                for b, first, end in zip(*(iter(cuts or []),) * 3):
                    by_block.setdefault(b, []).append((first, end))
                for b, parts in by_block.items():
                    spans, kept, at = [m.span() for m in WORD.finditer(blocks[b])], [], 0
                    for first, end in parts:
                        kept.append(blocks[b][at : spans[first][0]].strip())
                        at = spans[end - 1][1]
                    blocks[b] = " ".join(x for x in (*kept, blocks[b][at:].strip()) if x)
                out.append("\n".join(x for k, x in enumerate(blocks) if x or k not in by_block))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    gone = undecided.select("row", "owner").dropDuplicates(["row"]).join(held, "row").mapInArrow(covered, "row bigint, cuts array<int>")
    parsed = source.mapInArrow(read, "row bigint, page_id bigint, url string, blocks array<string>")
    joined = parsed.join(gone, "row", "left")
    texts = joined.select("page_id", "url", "blocks", "cuts").mapInArrow(rest, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
