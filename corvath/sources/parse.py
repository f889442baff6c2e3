"""Format parsers: from bytes or text to blocks (document_id, block_no, text, line_start, line_end, section, ...)."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvath.functions.text import lines, stem_title, strip

# The languages of source files by extension; any other source file is "code".
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".css": "css",
    ".sql": "sql",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".sh": "bash",
    ".ps1": "powershell",
}
# Links to files of these kinds aren't followed.
SKIPPED_FILES = (".pdf", ".zip", ".tar", ".gz", ".rar", ".7z", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".exe", ".dmg", ".bin", ".iso")
CODE_LINES, CODE_STEP = 40, 30
_SKIPPED = {"script", "style", "meta", "noscript", "iframe"}
_BLOCKS = {"h1", "h2", "h3", "h4", "p", "li", "pre", "blockquote"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def decode(content: Column) -> Column:
    """Bytes as UTF-8 where they are that, else as ISO 8859-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def parser_of(file_name: Column, mime_type: Column) -> Column:
    """The parser's name for a file: by extension or MIME type, first match wins."""
    ext = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), "(\\.[^./]+)$", 1))
    mime = F.lower(F.coalesce(mime_type, F.lit("")))
    return (
        F.when((ext == ".pdf") | (mime == "application/pdf"), "pdf")
        .when((ext == ".docx") | (mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), "docx")
        .when(ext.isin(".md", ".markdown"), "markdown")
        .when(ext.isin(".html", ".htm") | (mime == "text/html"), "html")
        .when(ext.isin(list(LANGUAGES)) | mime.contains("code"), "code")
        .otherwise("text")
    )


def language_of(file_name: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), "(\\.[^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("code"))


def text_blocks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """document_id, line_start, line_end, text: one block for each line that isn't blank, as it stands."""
    split = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("document_id"), F.posexplode(lines(F.col(text_col))).alias("at", "text"))
    return split.where(strip(F.col("text")) != "").select("document_id", (F.col("at") + 1).alias("line_start"), (F.col("at") + 1).alias("line_end"), "text")


def markdown_blocks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """document_id, section, line_start, line_end, text: the lines between headings; headings are no blocks."""
    each = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("document_id"), F.posexplode(lines(F.col(text_col))).alias("at", "line"))
    heading = F.regexp_extract("line", "^(#{1,6})\\s+(.+)$", 2)
    so_far = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = each.withColumn("heading", F.nullif(strip(heading), F.lit("")))
    placed = marked.withColumn("island", F.count("heading").over(so_far)).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit("General"))).where("heading is null")
    joined = placed.groupBy("document_id", "island", "section").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"), F.min("at").alias("a"), F.max("at").alias("b"))
    text = strip(F.array_join(F.col("x.line"), "\n"))
    return joined.select("document_id", "section", (F.col("a") + 1).alias("line_start"), (F.col("b") + 1).alias("line_end"), text.alias("text")).where("text <> ''")


def markdown_title(text: Column, file_name: Column) -> Column:
    """The first heading of level one, else the file's titled stem."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, "(?m)^#\\s+(.+)$", 1)), F.lit("")), stem_title(file_name))


def code_blocks(documents: DataFrame, id_col: str, text_col: str, name_col: str, size: int = CODE_LINES, step: int = CODE_STEP) -> DataFrame:
    """document_id, section, line_start, line_end, text: windows of `size` lines, every `step` lines, unless blank."""
    split = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("document_id"), F.coalesce(F.col(name_col), F.lit("")).alias("name"), lines(F.col(text_col)).alias("l"))
    # a line end at the end of a text begins no further line
    split = split.withColumn("l", F.when((F.size("l") > 0) & (F.element_at("l", -1) == ""), F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l"))).where(F.size("l") > 0)
    windows = split.select("document_id", "name", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(step))).alias("a"))
    found = windows.select("document_id", "name", (F.col("a") + 1).alias("line_start"), F.least(F.col("a") + size, F.size("l")).alias("line_end"), F.array_join(F.slice("l", F.col("a") + 1, F.lit(size)), "\n").alias("text"))
    return found.where(strip(F.col("text")) != "").select("document_id", F.concat("name", F.lit(":"), "line_start", F.lit("-"), "line_end").alias("section"), "line_start", "line_end", "text")


class _Blocks(HTMLParser):
    """Title, first h1, blocks in document order and links. An end tag closes up to its start tag, if that is open."""

    def __init__(self, implied_end_tags: bool):
        super().__init__(convert_charrefs=True)
        self.implied, self.open, self.blocks, self.links = implied_end_tags, [], [], []
        self.title: list[str] | None = None
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in _SKIPPED:
            self.skipping += tag not in _VOID
            return
        if tag in _VOID:
            return
        if self.implied and tag in _BLOCKS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p" or self.open[k][0] == tag == "li":
                    del self.open[k:]
                    break
        parts: list[str] = []
        if tag in _BLOCKS:
            self.blocks.append((tag, parts))
        if tag == "title" and self.title is None:
            self.title = parts
        self.open.append((tag, parts))

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - (tag not in _VOID))
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not self.skipping and data.strip():
            for tag, parts in self.open:
                if tag in _BLOCKS or tag == "title":
                    parts.append(data.strip())


def parse_html(html: str, stem: str = "", implied_end_tags: bool = False) -> tuple[str, list[tuple[str, str]], list[str]]:
    p = _Blocks(implied_end_tags)
    p.feed(html)
    p.close()
    blocks = [(tag, " ".join(parts)) for tag, parts in p.blocks if parts]
    title = " ".join(p.title or []) or next((t for tag, t in blocks if tag == "h1"), stem)
    return title, blocks, p.links


def html_blocks(pages: DataFrame, id_col: str, html_col: str, stem_col: str | None = None, implied_end_tags: bool = False) -> DataFrame:
    """document_id, title, block_no, tag, text. No built-in reads HTML, hence a UDF on Arrow batches."""

    @F.pandas_udf("struct<title: string, blocks: array<struct<tag: string, text: string>>>")
    def parse(html: pd.Series, stem: pd.Series) -> pd.DataFrame:
        out = [parse_html(h or "", s or "", implied_end_tags) for h, s in zip(html, stem)]
        return pd.DataFrame({"title": [t for t, _, _ in out], "blocks": [[{"tag": a, "text": b} for a, b in x] for _, x, _ in out]})

    stem = F.col(stem_col) if stem_col else F.lit("")
    parsed = pages.select(F.col(id_col).alias("document_id"), parse(F.col(html_col), stem).alias("p"))
    return parsed.select("document_id", F.col("p.title").alias("title"), F.posexplode("p.blocks").alias("block_no", "b")).select("document_id", "title", "block_no", "b.tag", "b.text")


def html_titles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col, html_title: the title, else the first heading of level one, else an empty string."""

    @F.pandas_udf("string")
    def title(html: pd.Series) -> pd.Series:
        return pd.Series([parse_html(h or "")[0] for h in html])

    return pages.select(id_col, title(F.col(html_col)).alias("html_title"))


def html_links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """document_id, link_no, link: absolute http(s) links in order, duplicates kept, without anchors, mail and files."""

    @F.pandas_udf("array<string>")
    def links(url: pd.Series, html: pd.Series) -> pd.Series:
        out = []
        for base, h in zip(url, html):
            found = []
            for href in parse_html(h or "")[2]:
                href = href.strip()
                if href and not href.lower().startswith(("#", "mailto:", "tel:", "javascript:")):
                    full = urljoin(base or "", href)
                    p = urlparse(full)
                    if p.scheme in ("http", "https") and not p.path.lower().endswith(SKIPPED_FILES):
                        found.append(full)
            out.append(found)
        return pd.Series(out)

    return pages.select(F.col(id_col).alias("document_id"), F.posexplode(links(F.col(url_col), F.col(html_col))).alias("link_no", "link"))


def docx_blocks(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """document_id, block_no, section, is_table, text of .docx bytes: paragraphs under their headings, then table rows."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(data: bytes) -> list[dict]:
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):  # not such a file
            return []
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
        out, section = [], "Introduction"
        for p in body.findall(f"{w}p"):
            style = p.find(f"{w}pPr/{w}pStyle")
            if not (s := text(p).strip()):
                continue
            if style is not None and style.get(f"{w}val", "").startswith("Heading"):
                section = s
            else:
                out.append({"section": section, "is_table": False, "text": s})
        for row in body.iter(f"{w}tr"):
            if cells := [c for c in (text(x).strip() for x in row.findall(f"{w}tc")) if c]:
                out.append({"section": section, "is_table": True, "text": " | ".join(cells)})
        return out

    @F.pandas_udf("array<struct<section: string, is_table: boolean, text: string>>")
    def blocks(content: pd.Series) -> pd.Series:
        return pd.Series([read(bytes(c)) if c is not None else [] for c in content])

    return files.select(F.col(id_col).alias("document_id"), F.posexplode(blocks(F.col(content_col))).alias("block_no", "b")).select("document_id", "block_no", "b.*")


def page_blocks(pages: DataFrame, id_col: str, page_col: str, text_col: str) -> DataFrame:
    """document_id, page_number, block_no, text: the paragraphs of pages whose text was extracted before."""
    each = pages.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("document_id"), F.col(page_col).alias("page_number"), F.posexplode(F.split(text_col, "\n\n")).alias("block_no", "raw"))
    return each.select("document_id", "page_number", "block_no", strip(F.col("raw")).alias("text")).where("text <> ''")


def search_results(pages: DataFrame, html_col: str, limit: int = 10) -> DataFrame:
    """position, title, url, snippet, domain from the result cards of a scraped result page; redirects are unwrapped."""
    card = re.compile(r'<a[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>(?:(?!result__a).)*?(?:result__snippet[^>]*>(.*?)</a>)?', re.S)
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", s or "")).strip()

    @F.pandas_udf("array<struct<title: string, url: string, snippet: string, domain: string>>")
    def cards(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            rows = []
            for href, title, snippet in card.findall((h or "").replace("&amp;", "&")):
                url = parse_qs(urlparse(href).query).get("uddg", [href])[0]
                if len(rows) < limit and urlparse(url).netloc:
                    rows.append({"title": plain(title), "url": url, "snippet": plain(snippet), "domain": urlparse(url).netloc})
            out.append(rows)
        return pd.Series(out)

    return pages.select(F.posexplode(cards(F.col(html_col))).alias("position", "r")).select("position", "r.*")
