"""Facts and posts from text, as set operations over lines; links from HTML.

A document's lines are keyed by the document, never by its source, so no window grows with the
corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import clean_item, word_key

def extract_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """SRC-3: anchors of list items, table rows and articles, with link text (an image's alt counts) and the text of what encloses them."""
    blocks = F.regexp_extract_all(html_col, F.lit(r"(?is)<(?:li|tr)\b[^>]*>(.*?)</(?:li|tr)>"), F.lit(1))
    each = pages.select(id_col, F.posexplode(blocks).alias("block_no", "block"))
    anchors = each.select(id_col, "block_no", "block", F.posexplode(F.regexp_extract_all("block", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))).alias("link_no", "a"))
    href = F.regexp_extract("a", r"(?is)<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)", 1)
    return anchors.select(id_col, "block_no", "link_no", href.alias("href"), text_of(F.regexp_replace("a", r"(?is)<img\b[^>]*?alt\s*=\s*\"([^\"]*)\"[^>]*>", "$1")).alias("link_text"), text_of(F.col("block")).alias("context"))


def text_of(html: Column) -> Column:
    """Tags off, the five basic character references read, white space collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """SRC-4: id, line_no, line: collapsed, non-empty lines of the whole text, or of its first `most` characters where that is set."""
    text = F.col(text_col) if most is None else F.substring(text_col, 1, most)
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where(F.col("line") != "")


def sections(lines: DataFrame, is_heading: Column, id_col: str = "doc_id") -> DataFrame:
    """WIN-6, WIN-12: id, section_no, heading, lines, body: what follows a heading belongs to it; 0 is what stands before the first."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    placed = lines.withColumn("heading", is_heading).withColumn("section_no", F.sum(F.col("heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = placed.groupBy(id_col, "section_no").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("heading"), F.count_if(~F.col("heading")).alias("lines"), F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line")))).alias("b"))
    return grouped.select(id_col, "section_no", "heading", "lines", F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("body"))


def joined_continuations(lines: DataFrame, has_key: Column, id_col: str = "doc_id") -> DataFrame:
    """WIN-8: a line without a key is joined to the last one with a key."""
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("row_no", F.sum(has_key.cast("int")).over(order)).where(F.col("row_no") > 0)
    g = placed.groupBy(id_col, "row_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("b"))
    return g.select(id_col, "row_no", F.array_join(F.transform("b", lambda x: x["line"]), " ").alias("line"))


def labelled_fields(docs: DataFrame, rules: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """EXT-7: id, path, value: the first match of each rule (path, pattern with one group); the last rule of a path wins."""
    found = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("path"), F.trim(F.regexp_extract(text_col, r, 1)).alias("value")) for i, (p, r) in enumerate(rules)])
    each = docs.select(id_col, F.explode(F.filter(found, lambda x: x["value"] != "")).alias("f"))
    return each.groupBy(id_col, F.col("f.path").alias("path")).agg(F.max_by("f.value", "f.i").alias("value"))


def section_items(sections_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """EXT-8, FN-17, SET-7: distinct cleaned items of each section, in order."""
    items = F.array_distinct(F.filter(F.transform(F.split("body", "\n"), lambda x: clean_item(x)), lambda x: x != ""))
    return sections_df.select(id_col, "section_no", F.posexplode(items).alias("item_no", "item"))


def unambiguous_matches(rows: DataFrame, posts: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """JOIN-10, EXT-9: a row is attached only if exactly one post matches, else it is reported.

    Posts are counted by their keys before they meet rows, so that a row meets one row, however many posts it matches; a row id may repeat.
    """
    of = posts.groupBy(*keys).agg(F.count("post_id").alias("n"), F.min("post_id").alias("post_id"))
    j = rows.join(of, keys, "left").groupBy(row_id).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.min("post_id").alias("post_id"))
    return j.select(row_id, F.when(F.col("matches") == 1, F.col("post_id")).alias("post_id"), F.when(F.col("matches") == 1, "ATTACHED").when(F.col("matches") == 0, "UNMATCHED").otherwise("AMBIGUOUS").alias("status"))


def token_overlap(a: Column, b: Column) -> Column:
    """JOIN-12: shared words of two names."""
    words = lambda x: F.array_distinct(F.split(word_key(x), " "))
    return F.size(F.array_intersect(words(a), words(b)))


def rekeyed(path: Column, aliases: dict[str, str], prefix: str) -> Column:
    """EXT-15: a post's path by its alias; other paths stay."""
    out = path
    for old, new in aliases.items():
        out = F.when(path == old, F.lit(prefix + new)).otherwise(out)
    return out


def ambiguity_fact(ambiguities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """EXT-12: all ambiguities of a document as one JSON list."""
    return ambiguities.groupBy(id_col).agg(F.to_json(F.array_sort(F.collect_set("message"))).alias("value")).withColumn("path", F.lit("extraction.ambiguities"))


def quality_report(docs: DataFrame, headings: DataFrame, structured: DataFrame, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """EXT-13: by document, its headings (all, or `most` of them) and status."""
    told = F.array_sort(F.collect_set("heading"))
    h = headings.groupBy(id_col).agg((told if most is None else F.slice(told, 1, most)).alias("headings"))
    return docs.select(id_col).join(h, id_col, "left").join(structured.select(id_col, "status", "strategy"), id_col, "left")


def breakdown_rows(df: DataFrame, id_col: str, json_col: str, depth: int | None = None) -> DataFrame:
    """FN-29: id, path, value of the scalars and lists in a JSON object, however deep; keys are joined by dots. With depth, objects below so many keys are left out.

    A level of keys is read at a time; without depth a job looks whether there is another.
    """
    level = df.select(id_col, F.lit("").alias("path"), F.try_parse_json(json_col).alias("v"))
    found, seen = None, 0
    while found is None or (seen < depth if depth is not None else not level.isEmpty()):
        entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        level = level.select(id_col, "path", F.explode(entries).alias("e")).select(id_col, F.concat_ws(".", F.nullif("path", F.lit("")), F.col("e.key")).alias("path"), F.col("e.value").alias("v"))
        rows = level.where(~F.schema_of_variant("v").startswith("OBJECT")).select(id_col, "path", F.try_variant_get("v", "$", "string").alias("value"))
        found, seen = rows if found is None else found.unionByName(rows), seen + 1
        level = level.where(F.schema_of_variant("v").startswith("OBJECT"))
    return found
