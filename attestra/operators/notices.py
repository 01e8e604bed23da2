"""Posts of a notice: a table between bars, a series told in words, a table whose bars are lost, numbered positions, or a title.

What a notice says of its posts is worked out within its own row, over the array of its lines: nothing is
shuffled, so a notice of any source costs what its text costs. Every strategy gives a status (EXPLICIT,
AMBIGUOUS or LEGACY_UNSPLIT), the posts where it is EXPLICIT, and what was wrong where it is AMBIGUOUS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scalars import canonical_post_name, collapsed, first_place, header_key, let, post_key
from attestra.operators.postings import aligned, numbered_position_list, whitespace_table

# Headers of vacancy tables and what they mean.
VACANCY_HEADERS = {
    "post": "post_name",
    "postname": "post_name",
    "nameofpost": "post_name",
    "nameofthepost": "post_name",
    "department": "department",
    "dept": "department",
    "organisation": "organisation",
    "organization": "organisation",
    "unitorganisation": "organisation",
    "unitorganization": "organisation",
    "ur": "vacancies.ur",
    "unreserved": "vacancies.ur",
    "obcmobc": "vacancies.obc_mobc",
    "obc": "vacancies.obc_mobc",
    "sc": "vacancies.sc",
    "stp": "vacancies.st_p",
    "sth": "vacancies.st_h",
    "ews": "vacancies.ews",
    "pwbd": "vacancies.pwbd",
    "pwd": "vacancies.pwbd",
    "women": "vacancies.women",
    "total": "vacancies.total",
    "totalposts": "vacancies.total",
    "noofposts": "vacancies.total",
    "numberofposts": "vacancies.total",
}
#: Fixed value: the categories whose counts sum to a post's total.
PRIMARY = ("vacancies.ur", "vacancies.obc_mobc", "vacancies.sc", "vacancies.st_p", "vacancies.st_h", "vacancies.ews")
# How a series of vacancies is told.
MARKER = r"(?i)\b([0-9][0-9,]*)\s+posts?\s+of\s+"
SEPARATOR = r"(?i)(?:,|&|\band\b)\s*$"
QUALIFIED = r"(?i)^(.+?)\s+(?:in|under)\s+(.+)$"
PAY_SCALE = r"(?i)\s+in\s+the\s+Pay\s+Scale\b.*$"
SINGLE_POST_TITLE = r"(?i)^\s*(?:advertisement|advt\.?)\s+for\s+the\s+post\s+of\s+(.+?)\s*$"
SEVERAL_POSTS = r"(?i)\bfollowing\b.{0,80}\bposts?\b"
LISTING_LEAD = r"(?i)^\s*(?:advertisement|advt\.?|recruitment\s+notice)\s*[-:]?\s*"
#: Characters of a notice in which a series, or a word against a single post, counts as its opening.
LEAD = 8_000

POST = "struct<ordinal:int,post_key:string,name:string,base:string,organisation:string,department:string,total:int,facts:map<string,string>>"
PARSED = f"struct<status:string,posts:array<{POST}>,errors:array<string>>"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def raw_lines(text: str | Column) -> Column:
    """A text's lines as they are; a null text has one empty line."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.split(F.replace(whole, F.lit("\r\n"), F.lit("\n")), "\n")


def source_lines(text: str | Column) -> Column:
    """A text's lines, stripped."""
    return F.transform(raw_lines(text), stripped)


def cells_of(line: Column) -> Column:
    """The cells between a line's bars."""
    return F.transform(F.split(F.regexp_replace(stripped(line), r"^\|+|\|+$", ""), r"\|"), stripped)


def is_rule(cells: Column) -> Column:
    """A row of dashes under a header."""
    return F.forall(cells, lambda c: c.rlike("^[-: ]+$"))


def meanings(cells: Column, headers: dict[str, str]) -> Column:
    """What each header cell means, null where it is none."""
    known = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    return F.transform(cells, lambda c: F.try_element_at(known, header_key(c)))


def may_head(line: Column) -> Column:
    """Whether a line's letters and digits have "post" in a row, as every header of a post's name has: cheap to find, and missing from nearly all rows."""
    return line.rlike("(?i)p[^a-z0-9]*o[^a-z0-9]*s[^a-z0-9]*t")


def rows_after(lines: Column, header: Column, *, width: Column | None = None) -> Column:
    """WIN-7: the rows of cells after a header: blank or other lines before the first are passed over, the first after it ends the table, and so does, if width is given, a row of another width, which is the last."""
    n = F.size(lines)
    bar = lambda i: F.get(lines, i).contains("|")
    row = lambda i: bar(i) & ~is_rule(cells_of(F.get(lines, i)))
    between = lambda first: F.coalesce(first_place(first + 1, n, lambda i: ~bar(i)), n) - first
    rows = let(
        first_place(header + 1, n, row),
        lambda first: F.filter(F.transform(F.slice(lines, first + 1, between(first)), cells_of), lambda c: ~is_rule(c)),
    )
    if width is not None:
        odd = lambda r: first_place(F.lit(0), F.size(r), lambda i: F.size(F.get(r, i)) != width)
        rows = let(rows, lambda r: F.slice(r, F.lit(1), F.coalesce(odd(r) + 1, F.size(r))))
    return F.coalesce(rows, F.expr("cast(array() as array<array<string>>)"))


def _parsed(status: Column, posts: Column, errors: Column) -> Column:
    nothing = F.expr(f"cast(array() as array<{POST}>)")
    return F.struct(status.alias("status"), F.when(status == "EXPLICIT", posts).otherwise(nothing).alias("posts"), errors.alias("errors")).cast(PARSED)


def _list(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def vacancy_table(lines: Column) -> Column:
    """EXT-1, WIN-7, AGG-15 of a notice's lines: status, posts, errors.

    A header means at least a post's name and a total. No header is LEGACY_UNSPLIT; two, one without
    rows, and any bad row (width, name or total, six numeric categories that don't sum to the total, a
    key again) are AMBIGUOUS, with all errors.
    """
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: let(F.get(lines, i), lambda x: x.contains("|") & may_head(x)))
    head = lambda i: let(meanings(cells_of(F.get(lines, i)), VACANCY_HEADERS), lambda m: F.when(F.array_contains(m, "post_name") & F.array_contains(m, "vacancies.total"), F.struct(i.alias("i"), m.alias("means"))))
    table = lambda h: let(F.struct(h["means"].alias("means"), rows_after(lines, h["i"]).alias("rows")), _posts_of_table)
    found = lambda heads: (
        F.when(F.size(heads) == 0, _parsed(F.lit("LEGACY_UNSPLIT"), F.array(), _list()))
        .when(F.size(heads) > 1, _parsed(F.lit("AMBIGUOUS"), F.array(), _list("TABLES"))).otherwise(let(F.get(heads, F.lit(0)), table))
    )
    return let(F.array_compact(F.transform(places, head)), found)


def _posts_of_table(table: Column) -> Column:
    paths = sorted(set(VACANCY_HEADERS.values()))
    last = lambda what: F.array_max(F.transform(table["means"], lambda m, i: F.when(m == what, i))).alias(what)
    return let(F.struct(*map(last, paths)), lambda at: _checked(F.transform(table["rows"], lambda cells, n: _row(cells, n, at, F.size(table["means"]), paths))))


def _row(cells: Column, n: Column, at: Column, width: Column, paths: list[str]) -> Column:
    """A row of cells as a post with its error, if any; at says which cell holds what."""
    cell = F.struct(F.size(cells).alias("n"), *[F.get(cells, at.getField(p)).alias(p) for p in paths])
    number = lambda v, p: F.when(v.getField(p).rlike(r"^\d+$"), v.getField(p).try_cast("int"))
    counts = [p for p in paths if p.startswith("vacancies.")]

    def typed(v: Column) -> Column:
        text = {c: collapsed(v.getField(p)).alias(c) for c, p in (("name", "post_name"), ("unit", "organisation"), ("department", "department"))}
        return F.struct(v["n"].alias("n"), *text.values(), *[number(v, p).alias(p) for p in counts])

    def post(v: Column) -> Column:
        total, six = v.getField("vacancies.total"), [v.getField(p) for p in PRIMARY]
        pairs = [*[(p, v.getField(p).cast("string")) for p in counts], ("name", v["name"]), ("organisation.name", F.nullif(v["unit"], F.lit(""))), ("department.name", F.nullif(v["department"], F.lit("")))]
        facts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(p).alias("path"), x.alias("value")) for p, x in pairs]), lambda f: f["value"].isNotNull()))
        differ = F.coalesce(sum(six, F.lit(0)) != total, F.lit(False))  # null, so not checked, unless all six are numbers
        error = (
            F.when(v["n"] != width, F.format_string("row %d: %d cells, expected %d", n + 1, v["n"], width))
            .when((v["name"] == "") | total.isNull(), F.format_string("row %d: no post name or total", n + 1))
            .when(differ, F.format_string("row %d: categories don't sum to the total", n + 1))
        )
        owner = F.coalesce(F.nullif(v["unit"], F.lit("")), v["department"])
        return F.struct(
            (n + 1).alias("ordinal"), post_key(v["name"], owner).alias("post_key"), canonical_post_name(v["name"], F.coalesce(F.nullif(v["department"], F.lit("")), v["unit"])).alias("name"),
            F.lower(v["name"]).alias("base"), v["unit"].alias("organisation"), v["department"].alias("department"), total.alias("total"), facts.alias("facts"), error.alias("error"),
        )

    return let(cell, lambda v: let(typed(v), post))


def _checked(rows: Column) -> Column:
    def check(rows: Column) -> Column:
        again = lambda r, i: F.exists(F.slice(rows, F.lit(1), i), lambda q: q["error"].isNull() & (q["post_key"] == r["post_key"]))
        errors = F.array_compact(F.transform(rows, lambda r, i: F.coalesce(r["error"], F.when(again(r, i), F.format_string("row %d: key %s again", i + 1, r["post_key"])))))
        errors = F.when(F.size(rows) == 0, _list("no rows")).otherwise(errors)
        posts = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in ("ordinal", "post_key", "name", "base", "organisation", "department", "total", "facts")]))
        return let(errors, lambda e: _parsed(F.when(F.size(e) > 0, "AMBIGUOUS").otherwise("EXPLICIT"), posts, e))

    return let(rows, check)


def vacancy_series(title: Column, text: Column, lead: int = LEAD) -> Column:
    """EXT-2, WIN-11 of a notice: 'n posts of X in Y', told in the title or, if it has no such marker, in the text's opening.

    What stands between two markers is a name, with its organisation behind 'in' or 'under', and ends with
    a comma, '&' or 'and'. An organisation holds for the names before it that have none. A sentence's
    end, another conjunction or comma within a name, a missing separator, a name left without an
    organisation, a total of 0 and a key again are AMBIGUOUS.
    """
    candidates = F.filter(F.array(collapsed(title), collapsed(F.substring(text, 1, lead))), lambda x: x.rlike(MARKER))
    trim = lambda x: F.regexp_replace(x, "^[ ,:-]+|[ ,:-]+$", "")

    def segment(body: Column, i: Column, totals: Column) -> Column:
        last = i == F.size(totals) - 1
        ended = F.trim(body).rlike(SEPARATOR)
        inner = F.trim(F.when(last, F.regexp_replace(body, r"(?s)[.;].*$", "")).otherwise(F.regexp_replace(F.trim(body), SEPARATOR, "")))
        total = F.replace(F.get(totals, i), F.lit(","), F.lit("")).try_cast("int")
        unit = lambda x: F.nullif(F.trim(F.regexp_replace(trim(collapsed(F.regexp_extract(x, QUALIFIED, 2))), PAY_SCALE, "")), F.lit(""))
        name = lambda x: trim(collapsed(F.when(x.rlike(QUALIFIED), F.regexp_extract(x, QUALIFIED, 1)).otherwise(x)))
        wrong = lambda x: (~last & (~ended | x.rlike("[.;]"))) | (x == "") | x.rlike(r"(?i)[,;]|\band\b")
        read = let(inner, lambda x: F.struct(name(x).alias("name"), F.when(x.rlike(QUALIFIED), unit(x)).alias("unit"), x.rlike(QUALIFIED).alias("qualified"), wrong(x).alias("wrong")))
        return let(read, lambda r: F.struct(r["name"].alias("name"), r["unit"].alias("unit"), (r["wrong"] | (r["qualified"] & ((r["name"] == "") | r["unit"].isNull()))).alias("wrong"), total.alias("total")))

    def posts(segments: Column) -> Column:
        later = lambda i: F.get(F.filter(F.transform(F.slice(segments, i + 1, F.size(segments)), lambda s: s["unit"]), lambda u: u.isNotNull()), F.lit(0))
        shared = lambda s, i: s["unit"].isNull() | ((i > 0) & F.get(segments, i - 1)["unit"].isNull())
        same = lambda s: F.size(F.filter(segments, lambda q: F.lower(q["name"]) == F.lower(s["name"]))) > 1
        capital = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), " ")
        owned = F.transform(
            segments,
            lambda s, i: F.struct(s["name"].alias("base"), s["total"].alias("total"), later(i).alias("unit"), F.when(shared(s, i) | same(s), capital(s["name"])).otherwise(s["name"]).alias("shown")),
        )
        named = F.transform(owned, lambda s: F.struct(s["base"].alias("base"), s["total"].alias("total"), s["unit"].alias("unit"), canonical_post_name(s["shown"], s["unit"]).alias("name")))

        def post(s: Column, i: Column) -> Column:
            facts = F.create_map(F.lit("name"), s["name"], F.lit("organisation.name"), s["unit"], F.lit("vacancies.total"), s["total"].cast("string"))
            return F.struct(
                (i + 1).alias("ordinal"), post_key(s["base"], s["unit"]).alias("post_key"), s["name"].alias("name"), F.lower(s["base"]).alias("base"),
                s["unit"].alias("organisation"), F.lit("").alias("department"), s["total"].alias("total"), facts.alias("facts"),
            )

        torn = F.exists(segments, lambda s: s["wrong"]) | F.element_at(segments, -1)["unit"].isNull()
        zero = F.exists(segments, lambda s: F.coalesce(s["total"] < 1, F.lit(True)))

        def judged(found: Column) -> Column:
            twice = F.size(F.array_distinct(F.transform(found, lambda p: p["post_key"]))) < F.size(found)
            errors = F.when(torn, _list("the series can't be split")).when(zero | twice, _list("a total is 0, or a post is named twice")).otherwise(_list())
            return let(errors, lambda e: _parsed(F.when(F.size(e) > 0, "AMBIGUOUS").otherwise("EXPLICIT"), found, e))

        return let(F.transform(named, post), judged)

    def split_up(told: Column) -> Column:
        cut = lambda totals: F.transform(F.slice(F.split(told, MARKER), F.lit(2), F.size(totals)), lambda body, i: segment(body, i, totals))
        return let(let(F.regexp_extract_all(told, F.lit(MARKER), F.lit(1)), cut), posts)

    split = let(F.get(candidates, F.lit(0)), split_up)
    return F.when(F.size(candidates) == 0, _parsed(F.lit("LEGACY_UNSPLIT"), F.array(), _list())).otherwise(split)


def single_post(title: Column, text: Column, lead: int = LEAD) -> Column:
    """EXT-5 of a notice: the one post of a title 'Advertisement for the post of X'; AMBIGUOUS where the text's opening speaks of following posts."""
    name = F.regexp_replace(collapsed(F.regexp_extract(collapsed(title), SINGLE_POST_TITLE, 1)), "^[ ,:-]+|[ ,:-]+$", "")
    titled = collapsed(title).rlike(SINGLE_POST_TITLE)
    several = collapsed(F.substring(text, 1, lead)).rlike(SEVERAL_POSTS)
    shown = canonical_post_name(name, F.lit(""))
    post = F.struct(
        F.lit(1).alias("ordinal"), post_key(name, F.lit("")).alias("post_key"), shown.alias("name"), F.lower(name).alias("base"), F.lit("").alias("organisation"),
        F.lit("").alias("department"), F.lit(None).cast("int").alias("total"), F.create_map(F.lit("name"), shown).alias("facts"),
    )
    usable = F.length(name).between(1, 240) & ~name.rlike("[.;:]")
    status = F.when(titled & several, "AMBIGUOUS").when(titled & usable, "EXPLICIT").otherwise("LEGACY_UNSPLIT")
    return _parsed(status, F.array(post), F.when(titled & several, _list("the title's post is one of several")).otherwise(_list()))


def pipe_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """EXT-1 by row: id, status, posts, errors; see vacancy_table."""
    return docs.select(id_col, let(source_lines(text_col), vacancy_table).alias("p")).select(id_col, "p.*")


def _as_posts(found: Column) -> Column:
    """Posts of a name and a total as posts of a notice."""

    def post(p: Column, i: Column) -> Column:
        facts = F.create_map(F.lit("name"), p["name"], F.lit("vacancies.total"), p["total"].cast("string"))
        return F.struct(
            (i + 1).alias("ordinal"), post_key(p["name"], F.lit("")).alias("post_key"), canonical_post_name(p["name"], F.lit("")).alias("name"), F.lower(p["name"]).alias("base"),
            F.lit("").alias("organisation"), F.lit("").alias("department"), p["total"].alias("total"), facts.alias("facts"),
        )

    return F.coalesce(F.transform(found, post), F.expr(f"cast(array() as array<{POST}>)"))


def listed_posts(title: Column, found: Column) -> Column:
    """JOIN-12 for EXT-3: posts (name, total) by the names of the listing's title 'A & B', where each name is plainly its own post's and no two have one key."""
    names = F.transform(F.split(F.regexp_replace(collapsed(title), LISTING_LEAD, ""), r"\s+&\s+"), lambda x: F.regexp_replace(x, "^[ ,:-]+|[ ,:-]+$", ""))
    keys = lambda a: F.array_distinct(F.transform(a["names"], lambda x: post_key(x, F.lit(""))))
    pick = lambda a: F.when(F.size(keys(a)) == F.size(found), F.transform(found, lambda p, i: F.struct(F.get(a["names"], i).alias("name"), p["total"].alias("total"))))
    plain = F.transform(found, lambda p: F.struct(p["name"].alias("name"), p["total"].alias("total")))
    return F.coalesce(let(aligned(names, F.transform(found, lambda p: p["name"])), pick), plain)


def structure_posts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """EXT-6: id, strategy, status, posts, errors: table, series, table without bars, numbered positions, title: the first that isn't LEGACY_UNSPLIT.

    All is worked out within the row; a strategy is tried where those before it found nothing.
    """
    text, title = F.col(text_col), F.col(title_col)
    found = lambda c, posts, errors: _parsed(c["status"], _as_posts(posts), errors)
    strategies = [
        ("TABLE", let(source_lines(text_col), vacancy_table)), ("NARRATIVE", vacancy_series(title, text)),
        ("COLUMNS", let(whitespace_table(text), lambda c: found(c, listed_posts(title, c["posts"]), F.array_compact(F.array(c["error"]))))),
        ("POSITIONS", let(numbered_position_list(text), lambda c: found(c, c["posts"], _list()))), ("SINGLE", single_post(title, text)),
    ]
    out, missed, hit = docs, F.lit(True), F.struct(F.lit("NONE").alias("strategy"), _parsed(F.lit("LEGACY_UNSPLIT"), F.array(), _list()).alias("p"))
    for name, parsed in strategies:  # each is a column of its own: within one another they are more than the analyzer resolves
        out = out.withColumn(f"of_{name}", F.when(missed, parsed))
        missed = missed & (F.col(f"of_{name}.status") == "LEGACY_UNSPLIT")
    for name, _ in reversed(strategies):
        p = F.col(f"of_{name}")
        hit = F.when(p["status"] != "LEGACY_UNSPLIT", F.struct(F.lit(name).alias("strategy"), p.alias("p"))).otherwise(hit)
    return out.select(id_col, hit.alias("hit")).select(id_col, "hit.strategy", "hit.p.*")
