"""Main text of web pages: a suffix array of each host's page streams finds boilerplate, unique runs are kept.

A page is cut into blocks of text. Text of article and main elements is protected: a host may show one article, or one
passage, under several addresses. All other text of all pages (menus, adverts, footers and what no element speaks for)
is concatenated, host by host, as token streams; suffix arrays over them find runs of at least MIN_TOKENS tokens that
MIN_PAGES pages of different text share. Such runs are deleted, and the unique runs between them are kept, unless they
stand in what HTML itself marks as no main text: menus, headers, footers, sidebars, forms, hidden parts, and elements
whose class, id or role says advert, notice, comment and so on. These marked parts still count as evidence: a line that
is a footer on one page and a bare div on two others is on three pages.

Hosts are dealt over shards of about SHARD_PAGES streams, whatever their size. A shard's array names its runs and counts
their pages; the counts are added over all shards of the host before anything is deleted, so that the number of shards
doesn't change a result. Pages of the same whole text count as one page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import prepare, stage

MIN_TOKENS, MIN_PAGES, SHARD_PAGES = 6, 3, 64

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("nav header footer aside form dialog menu button select object svg canvas audio video math head".split())
#: Words in class, id or role that mark what is not main text; the first group marks an article as well.
COMMENT = frozenset("comment comments disqus respond replies".split())
CHROME = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary contentinfo cookie cookies consent footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted related search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|</(?:[^>]*>|[^>]+\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")  # white space, without the separators that Python adds to it
MAIN, FREE, MARKED = "main", "free", "marked"
_NONE, _SOFT, _HARD = 0, 1, 2


def _mark(name: str, attrs: str) -> int:
    """How an element marks its text: not, by a word that an article may overrule, or for good."""
    if name in OUT:
        return _HARD
    level = _NONE
    if attrs and name not in ("body", "html"):
        for key, *values in _ATTR.findall(attrs):
            value, key = "".join(values).lower(), key.lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return _HARD
            if key in ("class", "id", "role"):
                words = _SPLIT.split(value)
                if not COMMENT.isdisjoint(words):
                    return _HARD
                if not CHROME.isdisjoint(words):
                    level = _SOFT
    return level


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page's text blocks in order; white space is normalised, character references are decoded node by node.

    kind: main in an article or main element, free where nothing speaks for or against the text, marked where an element
    says that it is no main text. Where words in class, id or role would leave no article of the page, they don't count
    for articles and what these stand in (a listing of search results, a sponsored post).
    """
    if not page:
        return []
    found, buried = _blocks(page, False)
    return _blocks(page, True)[0] if buried and not any(kind == MAIN for kind, _ in found) else found


def _blocks(page: str, overrule: bool) -> tuple[list[tuple[str, str]], bool]:
    """The blocks, and whether an article has text under a word's mark only. overrule: such marks end at an article."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, mark, whether it is an article, soft marks that it overruled
    standing: dict[str, int] = {}  # how many of a name are on the stack
    levels: list[int] = []  # where the blocks are on the stack
    hard = soft = vouched = silent = 0
    buried = False
    shown: list[str] = []
    marked: list[str] = []

    def close():
        for kind, pieces in ((MAIN if vouched else FREE, shown), (MARKED, marked)):
            if pieces:
                if text := normal("".join(pieces)):
                    out.append((kind, text))
                pieces.clear()

    def pop():
        nonlocal hard, soft, vouched, silent
        name, mark, main, overruled = stack.pop()
        standing[name] -= 1
        if levels and levels[-1] == len(stack):
            levels.pop()
        hard -= mark == _HARD
        soft += overruled - (mark == _SOFT)
        vouched -= main
        silent -= name == "head"

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not silent:
            (marked if hard or soft else shown).append(html.unescape(piece))
            buried |= bool(vouched and soft and not hard) and not piece.isspace()
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            close()
        if m["end"] or m["end2"]:
            if standing.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in BLOCK:  # ends an open paragraph
            while levels and stack[levels[-1]][0] == "p":
                for _ in range(len(stack) - levels[-1]):
                    pop()
            levels.append(len(stack))
        mark, main, overruled = _mark(name, attrs), name in ("article", "main"), 0
        if main and overrule and mark != _HARD:
            mark, overruled, soft = _NONE, soft, 0
        stack.append((name, mark, main, overruled))
        standing[name] = standing.get(name, 0) + 1
        hard += mark == _HARD
        soft += mark == _SOFT
        vouched += main
        silent += name == "head"
    close()
    return out, buried


def suffix_array(x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of x by prefix doubling, and the length of the common prefix of each suffix with the one before it, counted up to most."""
    n = len(x)
    rank, step = np.unique(x, return_inverse=True)[1], 1
    while True:
        second = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    sa = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    alive = np.arange(1, n)
    depth = 0
    while len(alive) and depth != most:  # all suffixes at once, a token deeper each round
        a, b = sa[alive] + depth, sa[alive - 1] + depth
        ok = (a < n) & (b < n)
        alive, a, b = alive[ok], a[ok], b[ok]
        alive = alive[x[a] == x[b]]
        depth += 1
        lcp[alive] = depth
    return sa, lcp


def _name(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(tokens).encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_runs(streams: list[list[list[str]]], pages: list[int], min_tokens: int = MIN_TOKENS) -> dict[int, int]:
    """Name of each run of min_tokens tokens -> on how many pages it stands, from the streams' suffix array.

    A stream is a list of stretches that no run crosses; pages: how many pages each stream stands for.
    """
    names: dict[str, int] = {}
    ids, owner, left, at, breaks = [], [], [], [], 0
    for k, stream in enumerate(streams):
        for j, part in enumerate(stream):
            breaks += 1
            ids += [names.setdefault(t, len(names)) for t in part]
            ids.append(-breaks)
            owner += [k] * (len(part) + 1)
            left += range(len(part), -1, -1)
            at += [(k, j, i) for i in range(len(part) + 1)]
    if len(ids) <= min_tokens:
        return {}
    owner, left, weight = np.array(owner), np.array(left), np.array(pages)
    sa, lcp = suffix_array(np.array(ids, np.int64), min_tokens)
    group = np.cumsum(lcp < min_tokens)  # intervals of the array whose common prefix is long enough
    whole = left[sa] >= min_tokens
    pairs = np.unique(np.stack((group[whole], owner[sa][whole])), axis=1)
    count = np.bincount(pairs[0], weight[pairs[1]], minlength=group[-1] + 1).astype(int)
    out = {}
    for i in np.flatnonzero(whole & np.r_[True, group[1:] != group[:-1]]):
        k, j, start = at[sa[i]]
        out[_name(streams[k][j][start : start + min_tokens])] = int(count[group[i]])
    return out


def covered(tokens: list[str], gone: set[int], min_tokens: int = MIN_TOKENS) -> list[bool]:
    """Which of the tokens stand in one of the named runs."""
    end, out = 0, []
    for i in range(len(tokens)):
        if i + min_tokens <= len(tokens) and _name(tokens[i : i + min_tokens]) in gone:
            end = i + min_tokens
        out.append(i < end)
    return out


def stretches(outside: list[dict | None]) -> list[list[str]]:
    """The token streams of a page's text outside articles, cut where an article stands."""
    out: list[list[str]] = [[]]
    for x in outside:
        if x is None:
            out.append([])
        else:
            out[-1] += x["text"].split(" ")
    return out


_PARSED = ["page_id", "url", "host", "parts", "outside", "has_free"]
_OUTSIDE = pa.list_(pa.struct([("free", pa.bool_()), ("text", pa.string())]))


def _parse(batches):
    for b in batches:
        parts, outside, free = [], [], []
        for page in b.column("html").to_pylist():
            found, rest = blocks(page), []
            for kind, text in found:
                if kind != MAIN:
                    rest.append({"free": kind == FREE, "text": text})
                elif rest and rest[-1]:
                    rest.append(None)
            parts.append([text if kind == MAIN else None for kind, text in found if kind != MARKED])
            outside.append(rest)
            free.append(any(kind == FREE for kind, _ in found))
        arrays = [*(b.column(c) for c in _PARSED[:3]), pa.array(parts, pa.list_(pa.string())), pa.array(outside, _OUTSIDE), pa.array(free, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, _PARSED)


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    host, shard, shards = (pdf[c].iloc[0] for c in ("host", "shard", "shards"))
    found = shared_runs([stretches(x) for x in pdf["outside"]], pdf["pages"].tolist())
    if shards == 1:  # no other shard can add pages
        found = {k: n for k, n in found.items() if n >= MIN_PAGES}
    return pd.DataFrame({"host": host, "shard": shard, "name": np.array(list(found), np.int64), "pages": np.array(list(found.values()), np.int64)})


def _clean(pdf: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """What is left of each free block of a stream, and how many words of free and of marked blocks are in runs."""
    gone, rows = set(runs["name"].tolist()), []
    for host, key, outside in zip(pdf["host"], pdf["key"], pdf["outside"], strict=True):
        hit = [x for part in stretches(outside) for x in covered(part, gone)]
        at, left, free, marked = 0, [], 0, 0
        for x in outside:
            if x is None:
                continue
            tokens = x["text"].split(" ")
            mine = hit[at : at + len(tokens)]
            at += len(tokens)
            if x["free"]:
                left.append(" ".join([t for t, c in zip(tokens, mine, strict=True) if not c]))
                free += sum(mine)
            else:
                marked += sum(mine)
        rows.append((host, key, left, free, marked))
    return pd.DataFrame(rows, columns=["host", "key", "left", "free_gone", "marked_gone"])


def _fill(batches):
    for b in batches:
        texts = []
        for parts, left in zip(b.column("parts").to_pylist(), b.column("left").to_pylist(), strict=True):
            rest = iter(left)
            texts.append(" ".join(x for x in (next(rest) if p is None else p for p in parts) if x))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, parts (unmarked blocks in order, null in place of a free one), outside (blocks outside articles, null where an article stands), has_free."""
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    schema = f"page_id {kind}, url string, host string, parts array<string>, outside array<struct<free: boolean, text: string>>, has_free boolean"
    key, whole = (F.md5(F.to_json(x).cast("binary")) for x in (F.col("outside"), F.struct("parts", "outside")))
    return stage(rows.mapInArrow(_parse, schema).withColumns({"key": key, "whole": whole}), "html-parsed")


def cleaned(parsed: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """host, key, left, free_gone, marked_gone of every distinct stream of a host: its free blocks without what the host's suffix arrays find on MIN_PAGES pages."""
    streams = parsed.where(F.size("outside") > 0)
    distinct = streams.groupBy("host", "key").agg(F.first("outside").alias("outside"), F.countDistinct("whole").alias("pages"))
    distinct = stage(distinct, "html-streams")
    shards = distinct.groupBy("host").agg(F.ceil(F.count("*") / shard_pages).cast("int").alias("shards"))
    contents = stage(distinct.join(stage(shards, "host-shards"), "host").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")), "html-contents")
    runs = stage(contents.groupBy("host", "shard").applyInPandas(_runs, "host string, shard int, name long, pages long"), "html-runs")
    shared = runs.groupBy("host", "name").agg(F.sum("pages").alias("all")).where(F.col("all") >= MIN_PAGES).drop("all")
    gone = runs.join(shared, ["host", "name"]).select("host", "shard", "name")
    return contents.groupBy("host", "shard").cogroup(gone.groupBy("host", "shard")).applyInPandas(_clean, "host string, key string, left array<string>, free_gone long, marked_gone long")


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null, empty and text-free pages give an empty text. A null or odd url is a host of its own. Repeated rows each keep a
    row; rows of a host with the same whole text count as one page of it. Cut-off pages end where they end, very long ones
    are read whole. Further columns are not read. No rows, no rows.
    """
    parsed = parsed_pages(pages)
    left = cleaned(parsed.select("host", "key", "whole", "outside"), shard_pages).select("host", "key", "left")
    alone = parsed.where("not has_free").select("page_id", "url", F.array_join("parts", " ").alias("text"))
    # only pages with text that nothing speaks for wait for the array
    free = parsed.where("has_free").select("page_id", "url", "host", "key", "parts").join(left, ["host", "key"])
    kind = pages.schema["page_id"].dataType.simpleString()
    filled = free.select("page_id", "url", "parts", "left").mapInArrow(_fill, f"page_id {kind}, url string, text string")
    out = alone.unionByName(filled)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def removed_words(pages: DataFrame) -> DataFrame:
    """One row: words of all pages, in articles, and outside them: free or marked, and how many of either the suffix arrays find repeated."""
    parsed = parsed_pages(pages)
    n = lambda c: F.size(F.split(c, " "))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    words = parsed.select(
        "host", "key", total(F.transform(F.filter("parts", lambda x: x.isNotNull()), n)).alias("article"),
        *[total(F.transform(F.filter("outside", lambda x: x.isNotNull() & (x["free"] == flag)), lambda x: n(x["text"]))).alias(name) for name, flag in (("free", True), ("marked", False))],
    )
    found = cleaned(parsed.select("host", "key", "whole", "outside")).select("host", "key", "free_gone", "marked_gone")
    sums = words.join(found, ["host", "key"], "left")
    return sums.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("article", "free", "marked", "free_gone", "marked_gone")])
