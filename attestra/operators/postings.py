"""Posts of notices: tables without bars, numbered positions, parents and their parts, names of a listing, owners, and canonical posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import canonical_post_name, collapsed, first_place, let, post_key, split_camel, word_key

# What heads a table, and what its rows are made of.
TABLE_HEADER = (
    r"(?i)\bname\s+of\s+(?:the\s+)?posts?\b.*?\b(?:minimum\s+)?educational\s+qualification\b.*?\bscale\s+of\s+pay\b"
    r".*?\btotal\s+(?:no[.,]?\s+of\s+)?vacant\s+(?:posts?|dost|oost)\b"
)
POSITION_HEADER = r"(?i)\bposition\s+essential\s+qualification\b"
QUALIFICATION = (
    r"(?:b\.?\s*sc\.?|m\.?\s*sc\.?|hsslc|hslc|mbbs|bachelor|master|graduate|post[- ]?graduate|diploma|certificate|iti\b|degree\b|class\s+[ivx]+\b|passed\b)"
)
PAY = r"\b\d{1,2}[,.]?\d{3}\s*[-–]\s*\d{1,2}[,.]?\d{3}\b"
COUNT_LINE = r"(?i)^\s*(\d{1,5})(?:\s+(?:nos?\.?|[A-Za-z]))"
COUNT_ONLY = r"(?i)^\(?\s*(\d{1,5})\s*(?:nos?\.?|posts?)\s*\)?$"
SERIAL_ROW = r"^\s*([0-9Il]{1,3})[.)]?\s+(\S.*?)\s*$"
CATEGORIES = ("UR", "OBC", "SC", "ST", "EWS")


def _headed(text: Column, header: str, within: int) -> Column:
    """struct(lines, header_no) of a text: its lines, white space collapsed, and the first that heads a table together with the `within` - 1 after it; null if none does."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), collapsed)
    told = lambda x, i: F.array_join(F.slice(x, i + 1, F.lit(within)), " ").rlike(header)
    found = lambda x: F.struct(x.alias("lines"), first_place(F.lit(0), F.size(x), lambda i: told(x, i)).alias("header_no"))
    # a header's own word anywhere in the text: cheap to find, and missing from nearly all texts
    return F.when(text.rlike(r"(?i)\bqualification\b"), let(let(lines, found), lambda h: F.when(h["header_no"].isNotNull(), h)))


def _whole(digits: Column) -> Column:
    """Digits as a number, null where there are none: a cast of no digits fails by an exception, which costs far more than the cast."""
    return let(digits, lambda x: F.when(x != "", x.try_cast("int")))


def _below(headed: Column, say) -> Column:
    """What the lines below a header say, one struct a line; serial is that of a line which begins with one."""
    serial = lambda x: _whole(F.translate(F.regexp_extract(x, SERIAL_ROW, 1), "Il", "11")).alias("serial")
    lines = F.slice(headed["lines"], headed["header_no"] + 2, F.size(headed["lines"]))
    return F.transform(lines, lambda x: F.struct(x.alias("line"), serial(x), *say(x)))


def _rows(told: Column) -> Column:
    return F.filter(F.transform(told, lambda t, i: F.struct(i.alias("i"), t["serial"].alias("serial"))), lambda r: r["serial"].isNotNull())


def numbered_position_list(text: Column) -> Column:
    """EXT-4 of a notice: struct(status, posts); see numbered_positions."""
    kind = "array<struct<line_no:int,post_key:string,name:string,total:int>>"

    def posts(told: Column) -> Column:
        at = lambda j: F.get(told, j)
        ends = lambda j: at(j)["count"].isNotNull() | (at(j)["line"] == "") | at(j)["serial"].isNotNull() | at(j)["ends"]

        def named(i: Column, j: Column) -> Column:
            title = F.concat(F.array(F.regexp_extract(at(i)["line"], SERIAL_ROW, 2)), F.transform(F.slice(told, i + 2, j - i - 1), lambda t: t["line"]))
            name = F.btrim(collapsed(F.array_join(title, " ")), F.lit(" ,:-"))
            fits = lambda x: F.length(x).between(1, 160) & ~x.rlike("[.;:]")
            return let(name, lambda x: F.when(fits(x), F.struct(i.alias("line_no"), post_key(x, F.lit("")).alias("post_key"), x.alias("name"), at(j)["count"].alias("total"))))

        read = lambda i: let(first_place(i + 1, F.least(i + 8, F.size(told)), ends), lambda j: F.when(at(j)["count"].isNotNull(), named(i, j)))
        return F.array_compact(F.transform(_rows(told), lambda r: read(r["i"])))

    def judged(found: Column) -> Column:
        again = F.size(F.array_distinct(F.transform(found, lambda p: p["post_key"]))) < F.size(found)
        status = lambda some: F.when(again | (F.size(some) == 0), "AMBIGUOUS").otherwise("EXPLICIT")
        return let(F.filter(found, lambda p: p["total"] > 0), lambda some: let(status(some), lambda x: F.struct(x.alias("status"), F.when(x == "EXPLICIT", some).cast(kind).alias("posts"))))

    count = lambda x: _whole(F.regexp_extract(x, COUNT_ONLY, 1)).alias("count")
    said = let(_headed(text, POSITION_HEADER, 4), lambda h: F.when(h.isNotNull(), let(let(_below(h, lambda x: (count(x), x.rlike("[.;:]$").alias("ends"))), posts), judged)))
    return F.coalesce(said, F.struct(F.lit("LEGACY_UNSPLIT").alias("status"), F.lit(None).cast(kind).alias("posts")))


def numbered_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """EXT-4: id, status, posts: numbered headings with a count of their own within seven lines.

    A document without the header is unsplit; a repeated name, or a header without any post, makes it ambiguous.
    """
    return docs.select(id_col, numbered_position_list(F.col(text_col)).alias("p")).select(id_col, "p.*")


def whitespace_table(text: Column) -> Column:
    """EXT-3, WIN-9, WIN-10 of a notice: struct(status, posts, error); see whitespace_tables."""
    kind = "array<struct<post_key:string,name:string,total:int>>"

    def read(told: Column, i: Column, serial: Column) -> Column:
        """A row's post, the line where it ends, and what is wrong with it; null if it has no qualification."""
        at, n = lambda j: F.get(told, j), F.size(told)
        begins = lambda j: at(j)["qualifies"] | (at(j)["line"] == "") | at(j)["serial"].isNotNull()
        below = let(first_place(i + 1, F.least(i + 8, n), begins), lambda j: F.when(at(j)["qualifies"], j))
        upto = lambda title: F.when(title.rlike(f"(?i){QUALIFICATION}"), i).otherwise(below)

        def counted(title: Column, q: Column) -> Column:
            inline = F.regexp_extract(title, f"(?i)^(.*?){QUALIFICATION}", 1)
            words = F.when(q == i, inline).otherwise(F.array_join(F.concat(F.array(title), F.transform(F.slice(told, i + 2, q - i - 1), lambda t: t["line"])), " "))
            name = F.btrim(split_camel(words), F.lit(" ,:-"))
            limit = F.least(q + 25, n)
            pay = let(F.coalesce(first_place(q + 1, limit, lambda j: at(j)["serial"] == serial + 1), limit), lambda end: first_place(q, end, lambda j: at(j)["pay"]))
            place = let(pay, lambda p: F.struct(p.alias("pay"), first_place(p + 1, F.least(p + 6, n), lambda j: at(j)["count"].isNotNull()).alias("count_at")))
            named = lambda x: F.length(x).between(1, 180) & ~x.rlike("[.;]")
            fault = lambda x, p: F.when(~named(x), "TITLE").when(p["pay"].isNull(), "PAY").when(p["count_at"].isNull(), "COUNT").when(at(p["count_at"])["count"] < 1, "TOTAL")
            whole = lambda x, p: F.struct(fault(x, p).alias("fault"), post_key(x, F.lit("")).alias("post_key"), x.alias("name"), at(p["count_at"])["count"].alias("total"), p["count_at"].alias("end"))
            return let(name, lambda x: let(place, lambda p: whole(x, p)))

        titled = F.regexp_extract(at(i)["line"], SERIAL_ROW, 2)
        return let(titled, lambda title: let(upto(title), lambda q: F.when(q.isNotNull(), counted(title, q))))

    def walked(told: Column) -> Column:
        state = lambda expected, begin, error, posts: F.struct(expected.alias("expected"), begin.alias("begin"), error.alias("error"), posts.alias("posts"))
        wrong = lambda s, error: state(s["expected"], s["begin"], error, s["posts"])

        def taken(s: Column, post: Column) -> Column:
            again = F.exists(s["posts"], lambda p: p["post_key"] == post["post_key"])
            more = F.array_append(s["posts"], F.struct(post["post_key"].alias("post_key"), post["name"].alias("name"), post["total"].alias("total")))
            return (
                F.when(post.isNull(), s).when(post["fault"].isNotNull(), wrong(s, post["fault"])).when(again, wrong(s, F.lit("DUPLICATE")))
                .otherwise(state(s["expected"] + 1, post["end"] + 1, F.lit(None).cast("string"), more))
            )

        def step(s: Column, row: Column) -> Column:
            passed = s["error"].isNotNull() | (row["i"] < s["begin"]) | (row["serial"] < s["expected"])
            return F.when(passed, s).when(row["serial"] > s["expected"], wrong(s, F.lit("SERIAL"))).otherwise(let(read(told, row["i"], row["serial"]), lambda post: taken(s, post)))

        return F.aggregate(_rows(told), state(F.lit(1), F.lit(0), F.lit(None).cast("string"), F.expr(f"cast(array() as {kind})")), step)

    def judged(w: Column) -> Column:
        status = F.when(w["error"].isNotNull() | (F.size(w["posts"]) == 0), "AMBIGUOUS").otherwise("EXPLICIT")
        return let(status, lambda x: F.struct(x.alias("status"), F.when(x == "EXPLICIT", w["posts"]).cast(kind).alias("posts"), w["error"].alias("error")))

    count = lambda x: _whole(F.regexp_extract(x, COUNT_LINE, 1)).alias("count")
    say = lambda x: (x.rlike(f"(?i)^{QUALIFICATION}").alias("qualifies"), x.rlike(PAY).alias("pay"), count(x))
    said = let(_headed(text, TABLE_HEADER, 8), lambda h: F.when(h.isNotNull(), let(let(_below(h, say), walked), judged)))
    return F.coalesce(said, F.struct(F.lit("LEGACY_UNSPLIT").alias("status"), F.lit(None).cast(kind).alias("posts"), F.lit(None).cast("string").alias("error")))


def whitespace_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """EXT-3, WIN-9, WIN-10: id, status, posts, error: vacancy tables whose columns survived as lines.

    A row is a serial and a title, up to a qualification within eight lines, a range of pay before the
    next row, and a count within five lines of it. Serials run 1, 2, 3 …; the first row that breaks a
    rule makes the document ambiguous. All is worked out within the document's row: what each line is,
    once, and then the rows in order, of which only those that come next are read.
    """
    return docs.select(id_col, whitespace_table(F.col(text_col)).alias("p")).select(id_col, "p.*")


def refined_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """JOIN-18, EXT-11, WIN-13: doc_id, ordinal, name, n, refined: a document's parents are replaced by their children where all of them fit.

    parents: doc_id, name, n; children: doc_id, parent, name, n. A group of children fits if exactly
    one parent has its name and its sum is the parent's total; one that doesn't keeps all parents of the document.
    """
    groups = children.groupBy("doc_id", "parent").agg(F.sum("n").alias("sum"))
    named = parents.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("parents"), F.first("n").alias("n"))
    checked = groups.join(named, (groups["doc_id"] == named["doc_id"]) & (groups["parent"] == named["name"]), "left")
    fits = F.coalesce((F.col("parents") == 1) & (F.col("sum") == F.col("n")), F.lit(False))
    whole = checked.groupBy(groups["doc_id"]).agg(F.bool_and(fits).alias("refined")).where("refined")
    replaced = groups.join(whole, "doc_id").select("doc_id", F.col("parent").alias("name"), F.lit(True).alias("gone"))
    kept = parents.join(replaced, ["doc_id", "name"], "left").where("gone is null").select("doc_id", "name", "n", F.lit(False).alias("refined"))
    new = children.join(whole.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.concat_ws(" – ", "parent", "name").alias("name"), "n", F.lit(True).alias("refined"))
    order = Window.partitionBy("doc_id").orderBy("refined", "name", "n")
    return kept.unionByName(new).withColumn("ordinal", F.row_number().over(order))


def aligned(listing: Column, parsed: Column) -> Column:
    """JOIN-12: struct(aligned, names): the listing's names for the parsed posts, in order, if each shares more words with its own post than any other name does; all names are taken or none."""
    words = lambda names: F.transform(names, lambda x: F.array_distinct(F.split(word_key(x), " ")))
    shared = lambda a, b: F.size(F.filter(F.array_intersect(a, b), lambda w: w != ""))

    def fits(w: Column) -> Column:
        other = lambda p, i: F.array_max(F.transform(w["l"], lambda x, j: F.when(i == j, F.lit(0)).otherwise(shared(x, p))))
        best = F.transform(w["p"], lambda p, i: F.struct(shared(F.get(w["l"], i), p).alias("own"), other(p, i).alias("other")))
        return F.forall(best, lambda b: (b["own"] > 0) & (b["own"] > b["other"]))

    ok = (F.size(listing) == F.size(parsed)) & (F.size(listing) > 1) & let(F.struct(words(listing).alias("l"), words(parsed).alias("p")), fits)
    return let(F.coalesce(ok, F.lit(False)), lambda k: F.struct(k.alias("aligned"), F.when(k, listing).otherwise(parsed).alias("names")))


def aligned_names(docs: DataFrame, id_col: str = "doc_id", listing: str = "listing", parsed: str = "parsed") -> DataFrame:
    """JOIN-12 by row: id, aligned, names; listing and parsed are arrays of names."""
    return docs.select(id_col, aligned(F.col(listing), F.col(parsed)).alias("a")).select(id_col, "a.*")


def owner_posts(owners: DataFrame, posts: DataFrame) -> DataFrame:
    """JOIN-11: owner_id, post_id of each owner phrase that contains a post's organisation and its base name, as whole words.

    owners: owner_id, phrase; posts: post_id, organisation, base; of any number of words. An inverted index
    of the phrases' words is probed by that word of an organisation that fewest phrases have; what meets
    is compared in full. A post without an organisation has no owner.
    """
    told = owners.select("owner_id", word_key("phrase").alias("told")).where("told <> ''").distinct()
    index = told.select("owner_id", "told", F.explode(F.array_distinct(F.split("told", " "))).alias("word"))
    counts = index.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = posts.select("post_id", word_key("organisation").alias("unit"), word_key("base").alias("base")).where("unit <> ''").distinct()
    of = known.select("*", F.explode(F.array_distinct(F.split("unit", " "))).alias("word")).join(counts, "word", "left")
    rare = of.groupBy("post_id", "unit", "base").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"))
    within = lambda x: F.contains(F.concat(F.lit(" "), "told", F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))
    return index.join(rare, "word").where(within("unit") & ((F.col("base") == "") | within("base"))).select("owner_id", "post_id").distinct()


def category_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FN-33: id, category, n: lines that begin with a category, with what wraps to the lines after them; their last number counts."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line", collapsed("line"))
    label = F.regexp_extract("line", rf"^({'|'.join(CATEGORIES)})\b", 1)
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("label", label).withColumn("row_no", F.sum((F.col("label") != "").cast("int")).over(order)).where("row_no > 0")
    rows = placed.groupBy(id_col, "row_no").agg(F.max("label").alias("category"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("b"))
    numbers = F.regexp_extract_all(F.array_join(F.transform("b", lambda x: x["line"]), " "), F.lit(r"(\d+)"), F.lit(1))
    last = rows.select(id_col, "row_no", "category", F.try_element_at(numbers, F.lit(-1)).cast("int").alias("n")).where("n is not null")
    return last.groupBy(id_col, "category").agg(F.max_by("n", "row_no").alias("n"))


def canonical_posts(posts: DataFrame) -> DataFrame:
    """EXT-16: posts (name, organisation, previous) with the canonical name and the key of it."""
    return posts.withColumn("name", canonical_post_name("name", "organisation", "previous")).withColumn("post_key", post_key("name", F.lit("")))


def listing_notices(rows: DataFrame, cutoff: Column, cap: int) -> DataFrame:
    """EXT-14, WIN-15, SORT-8: source, url, title, day, exceeded: the last row of each URL from the cutoff on, the cap's latest by source.

    rows: source, url, position, title, day (null where a row has no date: it stays). Rows of a source are
    counted by aggregate; the window keeps the first `cap` of each source within its task before it shuffles.
    """
    last = rows.where(F.coalesce(F.col("day") >= cutoff, F.lit(True))).groupBy("source", "url").agg(F.max_by(F.struct("title", "day"), "position").alias("r")).select("source", "url", "r.*")
    counts = last.groupBy("source").agg((F.count(F.lit(1)) > cap).alias("exceeded"))
    order = Window.partitionBy("source").orderBy(F.col("day").desc_nulls_last(), "url")
    return last.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).drop("nth").join(counts, "source")
