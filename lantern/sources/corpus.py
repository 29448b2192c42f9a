"""Readers of the knowledge corpus: files, JSON lines, sectioned Markdown, HTML pages, tagged logs, runs."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = "id string, product string, section string, title string, keywords array<string>, text string"
REQUIRED = ("doc_id", "title", "text", "category", "product", "status")
STATUSES = ("actual", "archived")
SUFFIXES = ("pdf", "docx", "html", "htm", "md", "txt")


def files(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """path (below root), content, modified of the corpus files: known suffixes, nothing hidden, failed or ignored.

    An ignore rule is a folder ("drafts/"), a path glob ("a/*.md") or a bare name's glob ("*.tmp").
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    named = found.select(path.alias("path"), "content", F.col("modificationTime").alias("modified"))
    kept = named.filter(F.col("path").rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$") & ~F.col("path").rlike(r"(^|/)\."))
    for rule in ignore:
        kept = kept.filter(~F.col("path").rlike(_glob(rule)))
    return kept


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def _glob(rule: str) -> str:
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, _quoted(c)) for c in rule.rstrip("/"))
    if rule.endswith("/"):
        return f"^{body}/" if "/" in rule.rstrip("/") else f"(^|/){body}/"
    return f"^{body}$" if "/" in rule else f"(^|/){body}$"


def json_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """number, row, error of articles in JSON lines (number, value): a line that can't be read keeps its number and says why."""
    row = F.from_json(line, ARTICLE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.filter(F.trim(line) != "").withColumn("row", row)
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f"row.{c}")), F.lit("")) == "", c) for c in ("id", "title", "text")))), ", ")
    error = F.when(F.col("row").isNull() | F.col("row._bad").isNotNull(), "not JSON").when(missing != "", F.concat(F.lit("missing: "), missing))
    return parsed.select("number", "row", error.alias("error"))


def knowledge_base(text: DataFrame, column: str = "value") -> DataFrame:
    """The articles of nested knowledge bases, a JSON object with a list of articles each."""
    return text.select(F.explode(F.from_json(column, f"articles array<struct<{', '.join(x.replace(' ', ':', 1) for x in ARTICLE.split(', '))}>>")["articles"]).alias("a")).select("a.*")


def _pairs(text: Column, line: str) -> Column:
    """A map of the `key: value` pairs between `line` separators, trimmed."""
    pairs = F.filter(F.transform(F.split(text, line), lambda p: F.split(p, ":", 2)), lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))


def markdown_sections(texts: DataFrame, column: str = "value") -> DataFrame:
    """Columns of texts but its own, with number, heading, meta (front matter, overridden by the section's comment) and text."""
    body = F.regexp_replace(column, r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    front = _pairs(F.regexp_extract(column, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1), r"\n")
    rest = [c for c in texts.columns if c != column]
    parts = texts.select(*rest, front.alias("front"), F.posexplode(F.split(body, r"(?m)^## ")).alias("number", "part")).filter("number > 0")
    comment = F.regexp_extract("part", r"(?s)<!--(.*?)-->", 1)
    own = _pairs(comment, ";")
    meta = F.map_concat(F.map_filter("front", lambda k, v: ~F.map_contains_key(own, k)), own)
    heading = F.trim(F.substring_index("part", "\n", 1))
    said = F.trim(F.regexp_replace(F.regexp_replace("part", r"(?s)<!--.*?-->", ""), r"\A[^\n]*\n?", ""))
    said = F.regexp_replace(said, r"\A\s+|\s+\z", "")
    return parts.select(*rest, "number", heading.alias("heading"), meta.alias("meta"), F.concat_ws("\n", heading, F.nullif(said, F.lit(""))).alias("text"))


class _Page(HTMLParser):
    SKIP = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript"))
    VOID = frozenset(("br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "wbr"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.texts: dict[str, list[str]] = {k: [] for k in ("article", "main", "body", "h1", "title")}
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            named = dict(attrs)
            self.meta.setdefault((named.get("name") or named.get("property") or "").lower(), named.get("content") or "")
        elif tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.SKIP & set(self.open):
            for k, parts in self.texts.items():
                if k in self.open:
                    parts.append(text)


PAGE = T.StructType([T.StructField(k, T.StringType()) for k in ("title", "text", "author", "created")])


@F.pandas_udf(PAGE)
def page(html: pd.Series) -> pd.DataFrame:
    """title (h1, else title), text (article, else main, else body), author and date of HTML pages."""
    rows = []
    for source in html:
        parser = _Page()
        parser.feed(source or "")
        parser.close()
        t = {k: "\n".join(v) if k in ("article", "main", "body") else " ".join(v) for k, v in parser.texts.items()}
        rows.append((t["h1"] or t["title"] or None, t["article"] or t["main"] or t["body"], parser.meta.get("author"), parser.meta.get("article:published_time") or parser.meta.get("date")))
    return pd.DataFrame(rows, columns=["title", "text", "author", "created"])


def tagged(lines: DataFrame, tag: str, kinds: dict[str, str], line: str = "value") -> dict[str, DataFrame]:
    """A frame for each kind of the tagged JSON lines, read by that kind's schema."""
    kind = F.get_json_object(line, f"$.{tag}")
    return {k: lines.filter(kind == k).select(F.from_json(line, schema).alias("r")).select("r.*") for k, schema in kinds.items()}


def accepted(rows: DataFrame) -> DataFrame:
    """rows with reason: the first required field that is missing, or a status out of its domain; null: accepted."""
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED]
    return rows.withColumn("reason", F.coalesce(*empty, F.when(~F.col("status").isin(*STATUSES), F.concat(F.lit("status "), "status"))))


def repeated_keys(rows: DataFrame, key: str, source: str) -> DataFrame:
    """key, n, first, last of keys that more than one row has: how many, and two of the sources."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(source).alias("first"), F.max(source).alias("last")).filter("n > 1")
