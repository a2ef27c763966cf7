"""Web pages and source documents: titles, links, canonical addresses, Markdown, native formats."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

# Fixed values.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid".split()
STRIPPED = frozenset("script style noscript nav footer header aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PRIVATE_HOST = r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|0\.|\[?::1\]?$|\[?f[cd][0-9a-f]{2}:|\[?fe80:)"


def title(html: Column | str, url: Column | str) -> Column:
    """PRS4: the first h1 without tags, else the title element, else the address."""
    plain = lambda tag: T.collapse(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    return F.coalesce(F.nullif(plain("h1"), F.lit("")), F.nullif(plain("title"), F.lit("")), F.col(url) if isinstance(url, str) else url)


def links(pages: DataFrame) -> DataFrame:
    """PRS11: page_id, position, href of links, without mail, phone, script and fragment links."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    out = pages.select("page_id", "url", F.posexplode(hrefs).alias("position", "href")).withColumn("href", T.strip("href"))
    return out.where((F.col("href") != "") & ~F.col("href").rlike("(?i)^(mailto:|tel:|javascript:|#)"))


def resolve(base: Column, href: Column) -> Column:
    """An absolute address for a link on a page: absolute, scheme-relative, rooted or relative to the page's folder."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z]+:)//", 1), F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^([A-Za-z]+://[^/]+(?:/.*)?/)", 1)
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))


def canonical(url: Column | str) -> Column:
    """PRS12: no fragment, lower-case scheme and host, no tracking parameters, no slash at the end of the path."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, path = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+://[^/?]*)", 1)), F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1)
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    kept = F.array_join(query, "&")
    return F.concat(head, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def dedupe_key(url: Column | str) -> Column:
    """PRS13: the canonical address, with a folder's index page as the folder."""
    return F.regexp_replace(canonical(url), r"/index\.html?$", "")


def allowed(url: Column, domains: list[str], prefixes: list[str]) -> Column:
    """PRS14/PRS15: http or https, a host among the domains (any, if there are none), a prefix among those given, no private host."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    ok = (host != "") & ~host.rlike(PRIVATE_HOST)
    if domains:
        ok &= host.isin(domains)
    if prefixes:
        ok &= F.exists(F.array(*map(F.lit, prefixes)), lambda p: url.startswith(p))
    return ok


def fetch_state(status: Column, content_type: Column, redirects: Column, most_redirects: int = 5) -> Column:
    """SRC2: what becomes of an address by its response."""
    html = F.lower(F.substring_index(content_type, ";", 1)).isin("text/html", "text/plain")
    return F.when(redirects > most_redirects, "FAILED").when(status == 410, "GONE").when(status == 429, "DISCOVERED").when(status != 200, "FAILED").when(~html, "SKIPPED").otherwise("PROCESSED")


def parser_for(content_type: Column, url: Column) -> Column:
    """PRS16: which parser reads a document."""
    kind = F.lower(F.substring_index(content_type, ";", 1))
    return F.when(kind.isin("application/json") | url.endswith(".json"), "json").when(url.rlike(r"\.mdx?$"), "markdown").when(url.endswith(".rst"), "rst").when(kind == "text/html", "html").otherwise("text")


def strip_front_matter(c: Column | str) -> Column:
    """PRS9: without a leading block between --- lines."""
    return F.regexp_replace(c, r"\A﻿?---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def is_stub(c: Column | str) -> Column:
    """PRS19: a redirect notice, or a short page under construction."""
    low = F.lower(c)
    return (low.contains("redirect:") & low.contains("has moved")) | (low.contains("under construction") & (F.length(c) < 400))


def doc_version(ref: Column | str) -> Column:
    """PRS17: version of a source reference such as v4.0.0 or branch-3.5."""
    return F.regexp_extract(ref, r"(\d+(?:\.\d+)+)", 1)


def module_of(path: Column | str) -> Column:
    """PRS17: dotted module of a source path."""
    return F.when(F.col(path).rlike(r"\.py$") if isinstance(path, str) else path.rlike(r"\.py$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^.*?python/", ""), r"(/__init__)?\.py$", ""), "/", ".")).otherwise("")


class _Markdown(HTMLParser):
    """PRS1/PRS2: Markdown of the main part of a page."""

    def __init__(self, root: str | None):
        super().__init__(convert_charrefs=True)
        self.root, self.inside, self.skip = root, 0 if root else 1, 0
        self.out: list[str] = []
        self.table: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.lists: list[list] = []
        self.pre, self.href = False, None

    def put(self, s: str):
        (self.cell if self.cell is not None else self.out).append(s)

    def handle_starttag(self, tag, attrs):
        if tag in STRIPPED:
            self.skip += 1
        if tag == self.root:
            self.inside += 1
        if self.skip or not self.inside:
            return
        if re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "blockquote"):
            self.put("\n\n")
        elif tag == "br":
            self.put("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "pre":
            self.pre = True
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            self.put("[")
        elif tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in STRIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if not self.skip and self.inside:
            if re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "section", "blockquote", "ul", "ol"):
                if tag in ("ul", "ol") and self.lists:
                    self.lists.pop()
                self.put("\n\n")
            elif tag == "pre":
                self.pre = False
                self.put("\n```\n\n")
            elif tag == "code" and not self.pre:
                self.put("`")
            elif tag in ("b", "strong"):
                self.put("**")
            elif tag in ("i", "em"):
                self.put("*")
            elif tag == "a":
                self.put(f"]({self.href or ''})")
            elif tag in ("td", "th") and self.cell is not None and self.table:
                self.table[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
                self.cell = None
            elif tag == "table" and self.table is not None:
                rows, self.table = [r for r in self.table if r], None
                if rows:
                    width = max(map(len, rows))
                    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                    self.put("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")
        if tag == self.root:
            self.inside -= 1

    def handle_data(self, data):
        if not self.skip and self.inside:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def collapse_outside_fences(text: str) -> str:
    """PRS3: blank lines and runs of blanks collapsed, but not inside fences."""
    parts = re.split(r"(```.*?```)", text, flags=re.S)
    return "".join(p if k % 2 else re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", lambda m: "\n" + m[0].rsplit("\n", 1)[1], re.sub(r"(?<=\S)[ \t]+", " ", p))) for k, p in enumerate(parts)).strip()


def html_markdown(html: str | None, least_words: int = 40) -> str | None:
    """PRS1/PRS5: Markdown of a page's main, article or body element; None if it has under least_words words."""
    if not html:
        return None
    low = html.lower()
    root = next((t for t in ("main", "article", "body") if f"<{t}" in low), None)
    parser = _Markdown(root)
    parser.feed(html)
    parser.close()
    text = collapse_outside_fences("".join(parser.out))
    return text if len(text.split()) >= least_words else None


def to_markdown(pages: DataFrame, least_words: int = 40) -> DataFrame:
    """page_id, title, markdown of the pages that have enough words."""

    @F.pandas_udf("string")
    def md(s: pd.Series) -> pd.Series:
        return s.map(lambda h: html_markdown(h, least_words))

    return pages.select("page_id", title("html", "url").alias("title"), md("html").alias("markdown")).where("markdown is not null")


def markdown_scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """PRS20/WIN6: headings, table rows and fences of a Markdown text, and whether a fence stays open or raw HTML is left."""
    lines = F.split(text, "\n", -1)
    fence = lambda x: F.ltrim(x).startswith("```")
    # parity of the fences before each line, folded over the lines
    fold = F.aggregate(
        lines, F.struct(F.lit(0).alias("fences"), F.lit(0).alias("headings"), F.lit(0).alias("rows"), F.lit(0).alias("raw")),
        lambda s, x: F.struct(
            (s["fences"] + F.when(fence(x), 1).otherwise(0)).alias("fences"),
            (s["headings"] + F.when((s["fences"] % 2 == 0) & x.rlike(r"^#{1,6}\s+\S"), 1).otherwise(0)).alias("headings"),
            (s["rows"] + F.when((s["fences"] % 2 == 0) & F.ltrim(x).startswith("|"), 1).otherwise(0)).alias("rows"),
            (s["raw"] + F.when((s["fences"] % 2 == 0) & x.rlike(r"</?(div|span|table|p)\b"), 1).otherwise(0)).alias("raw"),
        ),
    )
    return docs.select(key, fold.alias("f")).select(key, F.col("f.headings").alias("headings"), F.col("f.rows").alias("table_rows"), F.floor(F.col("f.fences") / 2).cast("int").alias("fences"), (F.col("f.fences") % 2 == 1).alias("open_fence"), (F.col("f.raw") > 0).alias("raw_html"))


def rst_sections(text: str) -> list[tuple[str, str]]:
    """PRS6/PRS8: (title, body) of reStructuredText sections, by underlines at least as long as the title."""
    lines, out, title_, body = text.replace("\r\n", "\n").split("\n"), [], "", []
    k = 0
    while k < len(lines):
        under = lines[k + 1] if k + 1 < len(lines) else ""
        if lines[k].strip() and re.fullmatch(r"([=\-~^\"'#*+.])\1{2,}\s*", under) and len(under.rstrip()) >= len(lines[k].rstrip()):
            out.append((title_, "\n".join(body).strip()))
            title_, body = lines[k].strip(), []
            k += 2
            continue
        if not re.fullmatch(r"([=\-~^\"'#*+.])\1{2,}\s*", lines[k]):
            body.append(lines[k])
        k += 1
    out.append((title_, "\n".join(body).strip()))
    return [s for s in out if s[0] or s[1]]


def native_text(text: str) -> str:
    """PRS8: a source document without front matter, template directives and HTML comments, with plain line feeds."""
    text = re.sub(r"\A﻿?---\n.*?\n---\n?", "", text.replace("\r\n", "\n").replace("\r", "\n"), flags=re.S)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"<!--.*?-->|\{%.*?%\}|\{\{.*?\}\}", "", text, flags=re.S)).strip()


def rst_documents(docs: DataFrame, key: str) -> DataFrame:
    """PRS6/PRS8: key, section, title, body of every section of reStructuredText documents; null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = [(k, i, *s) for k, text in zip(pdf[key], pdf["text"], strict=True) for i, s in enumerate(rst_sections(text) if text else [])]
            yield pd.DataFrame(rows, columns=[key, "section", "title", "body"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, section int, title string, body string")


#: What a generated page's title ends with, and links to sources that are not read.
TITLE_MARKS = [" - Spark ", " — Spark "]
SOURCE_LINK = r"\[\s*source\s*\]"


def rendered_title(html: Column | str, url: Column | str) -> Column:
    """PRS7: the first heading, else the title element up to its product mark, else the address's last part in words."""
    plain = lambda tag: T.collapse(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    whole = plain("title")
    for mark in TITLE_MARKS:
        whole = F.when(whole.contains(mark), F.substring_index(whole, mark, 1)).otherwise(whole)
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"([^/]*?)(?:\.[^./]*)?/*$", 1), "[-_]", " "), " +", " "))
    return F.coalesce(F.nullif(plain("h1"), F.lit("")), F.nullif(whole, F.lit("")), F.nullif(stem, F.lit("")), F.col(url) if isinstance(url, str) else url)


def rendered(pages: DataFrame, least_words: int = 10) -> DataFrame:
    """PRS7: page_id, title, text, word_count, content_hash, headings (text and level) of rendered pages; too short ones go."""
    md = F.pandas_udf(lambda s: s.map(lambda h: html_markdown(h, 0)), "string")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(md("html"), SOURCE_LINK, ""), r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.ltrim(x).startswith("[#]"))
    rows = pages.select("page_id", rendered_title("html", "url").alias("title"), T.strip(F.array_join(kept, "\n")).alias("text"))
    heads = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    heads = F.transform(heads, lambda x: F.struct(T.strip(F.regexp_extract(x, r"^#{1,6}\s+(.+?)\s*#*\s*$", 1)).alias("heading"), F.length(F.regexp_extract(x, "^(#{1,6})", 1)).alias("level")))
    out = rows.withColumn("word_count", T.word_count("text")).where((F.col("word_count") >= least_words) & F.col("text").isNotNull())
    return out.select("page_id", "title", "text", "word_count", F.sha2("text", 256).alias("content_hash"), heads.alias("headings"))
