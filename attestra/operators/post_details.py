"""What a notice says of each of its posts: detail tables, aligned columns, scoped clauses and rosters.

Every statement becomes a claim (source, at, row, ordinal, path, kind, value, locator, problem), worked out
within the notice's row over the array of its lines. A claim without an owner, or of a wrong form, says so
in `problem`. `attached` then keeps the first value of each post and path and reports what differs from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import collapsed, first_place, let, numeric_date
from attestra.operators.notices import cells_of, may_head, meanings, raw_lines, rows_after, source_lines

# Headers of detail tables and the facts below them.
DETAIL_HEADERS = {
    "post": "post_name",
    "postname": "post_name",
    "nameofpost": "post_name",
    "nameofthepost": "post_name",
    "organisation": "organisation",
    "organization": "organisation",
    "department": "department",
    "minimumqualification": "qualification.minimum",
    "essentialqualification": "qualification.essential",
    "qualification": "qualification.minimum",
    "desirablequalification": "qualification.desirable",
    "subject": "qualification.subject",
    "specialisation": "qualification.specialisation",
    "specialization": "qualification.specialisation",
    "recognizedboarduniversity": "qualification.recognised_institution_requirement",
    "recognisedboarduniversity": "qualification.recognised_institution_requirement",
    "technicalqualification": "qualification.technical",
    "registrationlicence": "qualification.registration_or_licence",
    "minimumpercentage": "qualification.minimum_percentage",
    "minimumgrade": "qualification.minimum_grade",
    "minimumage": "age.minimum",
    "maximumage": "age.maximum",
    "age": "age.range",
    "agereferencedate": "age.reference_date",
    "agecutoffdate": "age.reference_date",
    "agerelaxation": "age.relaxations",
    "payscale": "pay.scale",
    "gradepay": "pay.grade_pay",
    "paylevel": "pay.level",
    "fixedremuneration": "salary.fixed",
    "minimumexperience": "experience.minimum",
    "desirableexperience": "experience.desirable",
    "domicile": "domicile.requirement",
    "nationality": "nationality.requirement",
    "language": "language.requirement",
    "physicalstandards": "physical.criteria",
    "medicalstandards": "medical.criteria",
    "selectionprocess": "selection.process",
    "othereligibility": "eligibility.other",
}
OWNER_PATHS = ("post_name", "organisation", "department")
# What opens and closes a clause for some posts, and what the clauses say.
SCOPE_START = r"(?i)^\s*\d+(?:\.\d+)*(?:\.[A-Z]|\.\d+)?\.?\s+For\s+the\s+posts?\s+of\s+"
SCOPE_END = r"(?i)^\s*\d+(?:\.\d+)+(?:\.[A-Z]|\.\d+)?\.?\s+"
AGE_OWNER = r"(?i)For\s+the\s+posts?\s+of\s+(.+?)\s*:\s*The\s+age\b"
AGE_RULE = r"(?i)must\s+be\s+(\d{1,3})\s*-\s*(\d{1,3})(?:\s+years?)?\s+as\s+on\s+(\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{4})"
LICENCE = r"(?i)For\s+the\s+posts?\s+of\s+(.+?),\s*Applicant\s+must\s+possess\s+(.+?driving\s+licen[cs]e.+?)(?:\.|$)"
ROSTER = r"(?i)^\s*(.+?)\s+in\s+(.+?)\s+with\s+Grade\s+Pay\s+of\s+(Rs\.?\s*[0-9,]+/-?)"
PAGE_HEADER = r"(?i)^Page\s+\d+\s+of\s+\d+$"
#: How an owner's phrase may name an organisation or post otherwise.
OWNER_ALIASES = (
    (r"\bf\s*&\s*es\b", "fire emergency services"),
    (r"\bfire\s*&\s*emergency\s+services\b", "fire emergency services"),
    ("handyme n", "handymen"),
)
#: Words that make another post of a name when they follow it.
NOT_FOLLOWED_BY = {"driver": "constable|operator"}
# Categories of a roster, and those that sum to the total.
ROSTER_CATEGORIES = {
    "unreserved": "vacancies.ur",
    "obc/mobc": "vacancies.obc_mobc",
    "tea tribes & adivasi communities": "vacancies.tea_tribes_adivasi",
    "sc": "vacancies.sc",
    "st (p)": "vacancies.st_p",
    "st (h)": "vacancies.st_h",
    "ews": "vacancies.ews",
    "pwbd": "vacancies.pwbd",
    "pwd": "vacancies.pwbd",
    "women": "vacancies.women",
    "ex-servicemen": "vacancies.ex_servicemen",
}
ROSTER_PRIMARY = ("vacancies.ur", "vacancies.obc_mobc", "vacancies.tea_tribes_adivasi", "vacancies.sc", "vacancies.st_p", "vacancies.st_h", "vacancies.ews")
#: Lines within which the last roster of a notice must come to its total.
ROSTER_REACH = 80

CLAIM = "struct<source:int,at:int,row:int,ordinal:int,path:string,kind:string,value:string,locator:string,problem:string>"
CLAIMS = f"array<{CLAIM}>"
PIPES, COLUMNS, SCOPES, ROSTERS = 1, 2, 3, 4


def _claim(source: int, at: Column, row: Column, locator: Column, *, ordinal=None, path=None, kind=None, value=None, problem=None) -> Column:
    none = F.lit(None)
    parts = (F.lit(source), at, row, ordinal, path, kind, value, locator, problem)
    names = ("source", "at", "row", "ordinal", "path", "kind", "value", "locator", "problem")
    return F.struct(*[(none if p is None else p if isinstance(p, Column) else F.lit(p)).alias(n) for n, p in zip(names, parts)]).cast(CLAIM)


def _no_claims() -> Column:
    return F.expr(f"cast(array() as {CLAIMS})")


def _each(items: Column, make) -> Column:
    """The claims of all items, one array."""
    return F.coalesce(F.flatten(F.transform(items, make)), _no_claims())


def _last(keys: Column, key) -> Column:
    """The place of the last of keys that is key."""
    return F.array_max(F.transform(keys, lambda m, i: F.when(m == key, i)))


def _detail_paths(means: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(means, lambda m: m.isNotNull() & ~m.isin(*OWNER_PATHS))))


def _is_detail_head(means: Column) -> Column:
    return F.coalesce(F.array_contains(means, "post_name"), F.lit(False)) & (F.size(_detail_paths(means)) > 0)


def known_posts(posts: Column) -> Column:
    """Posts with what their owners' names are compared by: made once for all that a notice says."""
    told = lambda p: F.coalesce(F.nullif(p["department"], F.lit("")), p["organisation"])
    keys = lambda p: (F.lower(collapsed(p["organisation"])).alias("organisation"), F.lower(collapsed(p["department"])).alias("department"), owner_key(p["base"]).alias("owner_base"), owner_key(told(p)).alias("owner_unit"))
    return F.transform(posts, lambda p: F.struct(p["ordinal"].alias("ordinal"), p["base"].alias("base"), p["total"].alias("total"), *keys(p)))


def _named_posts(known: Column, name: Column, unit: Column) -> Column:
    """JOIN-10: posts of this name and, where a unit is given, of this organisation or department."""
    same = lambda p: (p["organisation"] == unit) | (p["department"] == unit)
    return F.filter(known, lambda p: (p["base"] == name) & ((unit == "") | F.coalesce(same(p), F.lit(False))))


def _exact_date(value: Column) -> Column:
    return F.date_format(numeric_date(F.regexp_replace(value, r"\s*([./-])\s*", "$1")), "yyyy-MM-dd")


def table_claims(lines: Column, known: Column) -> Column:
    """EXT-9 between bars: claims of every detail table; a row's width, its one owner and its values' types must fit."""
    barred = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: let(F.get(lines, i), lambda x: x.contains("|") & may_head(x)))
    placed = lambda m: F.transform(_detail_paths(m), lambda path: F.struct(path.alias("path"), _last(m, path).alias("at")))
    head = lambda i: let(meanings(cells_of(F.get(lines, i)), DETAIL_HEADERS), lambda m: F.when(_is_detail_head(m), F.struct(i.alias("i"), F.size(m).alias("width"), placed(m).alias("paths"), *[_last(m, what).alias(what) for what in OWNER_PATHS])))
    heads = F.array_compact(F.transform(barred, head))

    def of_row(h: Column, cells: Column, k: Column) -> Column:
        locator = F.format_string("table=post-details-%d;row=%d", h["i"] + 1, k + 1)
        claim = lambda **more: _claim(PIPES, h["i"], k, locator, **more)
        cell = lambda what: F.get(cells, h[what])
        name = F.lower(collapsed(cell("post_name")))
        unit = F.lower(F.coalesce(F.nullif(collapsed(cell("organisation")), F.lit("")), collapsed(cell("department"))))

        def of_path(p: Column, owner: Column) -> Column:
            path = p["path"]

            def typed(raw: Column) -> Column:
                number, day = F.regexp_extract(raw, r"(?i)^(\d{1,3})(?:\s*years?)?$", 1), _exact_date(raw)
                whole, dated = path.isin("age.minimum", "age.maximum"), path == "age.reference_date"
                kind = F.when(whole, "INTEGER").when(dated, "DATE").otherwise("STRING")
                value = F.when(whole, F.nullif(number, F.lit(""))).when(dated, day).otherwise(raw)
                problem = F.when(value.isNull(), F.concat(F.lit("not an exact "), F.lower(kind)))
                return claim(ordinal=F.when(value.isNotNull(), owner), path=path, kind=kind, value=value, problem=problem)

            return let(collapsed(F.get(cells, p["at"])), lambda raw: F.when(~raw.isin("", "-", "—"), typed(raw)))

        def owned(found: Column) -> Column:
            one = F.array_compact(F.transform(h["paths"], lambda p: of_path(p, F.get(found, F.lit(0))["ordinal"])))
            return F.when(F.size(found) == 1, one).otherwise(F.array(claim(problem=F.format_string("matches %d posts", F.size(found)))))

        return F.when(F.size(cells) != h["width"], F.array(claim(problem="damaged columns"))).otherwise(let(let(F.struct(name.alias("n"), unit.alias("u")), lambda x: _named_posts(known, x["n"], x["u"])), owned))

    return _each(heads, lambda h: F.flatten(F.transform(rows_after(lines, h["i"], width=h["width"]), lambda cells, k: of_row(h, cells, k))))


def aligned_columns(line: Column) -> Column:
    """array of struct(start, stop, title): the columns of a header line, cut where two or more spaces stand; stop is where the next begins. None where there are bars or no such gap."""
    titles = F.regexp_extract_all(F.regexp_replace(line, r"\s+$", ""), F.lit(r"(\S(?:.*?\S)?)(?=\s{2,}|$)"), F.lit(1))
    kind = "array<struct<start:int,title:string>>"
    # each title begins at its first occurrence behind the end of the one before it
    walked = F.aggregate(
        titles,
        F.expr(f"named_struct('at', 1, 'found', cast(array() as {kind}))"),
        lambda s, t: let(
            F.call_function("locate", t, line, s["at"]),
            lambda p: F.struct((p + F.length(t)).alias("at"), F.array_append(s["found"], F.struct((p - 1).alias("start"), collapsed(t).alias("title"))).alias("found")),
        ).cast(f"struct<at:int,found:{kind}>"),
    )["found"]
    cut = lambda found: F.transform(found, lambda c, i: F.struct(c["start"].alias("start"), F.get(found, i + 1)["start"].alias("stop"), c["title"].alias("title")))
    return F.when(~line.contains("|") & line.rlike(r"\S\s{2,}\S"), let(walked, cut))


def column_claims(lines: Column, known: Column) -> Column:
    """EXT-9 in aligned columns: rows are cut by the places of the header's words; a line without a post's name goes on with the row before it."""
    value = "array<struct<path:string,value:string>>"
    state = f"struct<rows:array<{value}>,current:{value},done:boolean>"
    head = lambda i: let(
        aligned_columns(F.get(lines, i)),
        lambda columns: let(
            meanings(F.transform(columns, lambda c: c["title"]), DETAIL_HEADERS),
            lambda means: F.when(
                _is_detail_head(means),
                F.struct(
                    i.alias("i"), means.alias("means"),
                    F.filter(
                        F.transform(columns, lambda c, k: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.when(_last(means, F.get(means, k)) == k, F.get(means, k)).alias("path"))),
                        lambda c: c["path"].isNotNull(),
                    ).alias("cuts"),
                ),
            ),
        ),
    )
    heads = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(may_head(F.get(lines, i)), head(i))))
    of = lambda values, path: F.coalesce(F.get(F.filter(values, lambda v: v["path"] == path), F.lit(0))["value"], F.lit(""))

    def owners(values: Column) -> Column:
        unit = F.coalesce(F.nullif(collapsed(of(values, "organisation")), F.lit("")), collapsed(of(values, "department")))
        return let(F.struct(F.lower(collapsed(of(values, "post_name"))).alias("n"), F.lower(unit).alias("u")), lambda x: _named_posts(known, x["n"], x["u"]))

    def step(s: Column, line: Column, cuts: Column) -> Column:
        pushed = F.when(s["current"].isNotNull(), F.array_append(s["rows"], s["current"])).otherwise(s["rows"])
        cell = lambda c: F.trim(line.substr(c["start"] + 1, F.coalesce(c["stop"], F.length(line)) - c["start"]))
        make = lambda rows, current, done: F.struct(rows.alias("rows"), current.alias("current"), done.alias("done")).cast(state)
        nothing = F.lit(None).cast(value)

        def named(v: Column) -> Column:
            fits = F.size(owners(v)) > 0
            joined = F.transform(s["current"], lambda c, i: F.struct(c["path"].alias("path"), F.when((c["path"] == "post_name") | (F.get(v, i)["value"] == ""), c["value"]).otherwise(collapsed(F.concat_ws(" ", c["value"], F.get(v, i)["value"]))).alias("value")))
            return (
                F.when((of(v, "post_name") != "") & fits, make(pushed, v, F.lit(False)))
                .when(of(v, "post_name") != "", make(pushed, nothing, F.lit(True)))
                .when(s["current"].isNotNull(), make(s["rows"], joined, F.lit(False)))
                .otherwise(s.cast(state))
            )

        values = F.transform(cuts, lambda c: F.struct(c["path"].alias("path"), cell(c).alias("value")))
        return F.when(s["done"], s.cast(state)).when(F.trim(line) == "", make(pushed, nothing, F.size(pushed) > 0)).otherwise(let(values, named))

    def rows(h: Column) -> Column:
        after = F.slice(lines, h["i"] + 2, F.size(lines))
        start = F.expr(f"cast(named_struct('rows', array(), 'current', null, 'done', false) as {state})")
        return F.aggregate(after, start, lambda s, line: step(s, line, h["cuts"]), lambda s: F.when(s["current"].isNotNull(), F.array_append(s["rows"], s["current"])).otherwise(s["rows"]))

    def of_row(h: Column, values: Column, k: Column) -> Column:
        locator = F.format_string("columns=post-details-%d;row=%d", h["i"] + 1, k + 1)
        claim = lambda **more: _claim(COLUMNS, h["i"], k, locator, **more)

        def of_path(path: Column, owner: Column) -> Column:
            bounds = r"(?i)^(\d{1,3})\s*(?:to|-|and)\s*(\d{1,3})(?:\s*years?)?$"

            def said(raw: Column) -> Column:
                least, most = (claim(ordinal=owner, path=p, kind="INTEGER", value=F.regexp_extract(raw, bounds, g)) for p, g in (("age.minimum", 1), ("age.maximum", 2)))
                age = F.when(raw.rlike(bounds), F.array(least, most)).otherwise(F.array(claim(path=path, problem="not an exact range")))
                plain = F.array(claim(ordinal=owner, path=path, kind="STRING", value=raw))
                return F.when(raw.isin("", "-", "—"), _no_claims()).when(path == "age.range", age).otherwise(plain)

            return let(collapsed(of(values, path)), said)

        def owned(found: Column) -> Column:
            one = _each(_detail_paths(h["means"]), lambda path: of_path(path, F.get(found, F.lit(0))["ordinal"]))
            return F.when(F.size(found) == 1, one).otherwise(F.array(claim(problem=F.format_string("matches %d posts", F.size(found)))))

        return let(owners(values), owned)

    return _each(heads, lambda h: F.flatten(F.transform(rows(h), lambda values, k: of_row(h, values, k))))


def owner_key(value: Column) -> Column:
    """FN-13 for an owner's phrase: its words after the known other names are written out."""
    out = F.lower(collapsed(value))
    for pattern, name in OWNER_ALIASES:
        out = F.regexp_replace(out, pattern, name)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def _says(text: Column, base: Column) -> Column:
    """Whether a phrase names a post; a name that another post's name begins with isn't met within that."""
    out = (base != "") & text.contains(base)
    for name, rest in NOT_FOLLOWED_BY.items():
        out = F.when(base == name, text.rlike(rf"\b{name}\b(?!\s+(?:{rest}))")).otherwise(out)
    return out


def owner_ordinals(owner: Column, known: Column) -> Column:
    """JOIN-11 within a notice: the posts that a phrase names.

    The phrase is cut into segments, each ending with an organisation of the notice. A post is named if a
    segment of its organisation holds its name, or if there is one and the phrase names no post at all.
    """

    def places(told: Column, unit: Column) -> Column:
        def of(parts: Column) -> Column:
            begin = lambda k: F.aggregate(F.slice(parts, F.lit(1), k + 1), F.lit(0), lambda a, x: a + F.length(x)) + k * F.length(unit)
            many = F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
            return F.transform(many, lambda k: let(begin(k), lambda b: F.struct(b.alias("begin"), (b + F.length(unit)).alias("end"), unit.alias("unit"))))

        return let(F.split(told, F.concat(F.lit(r"\b"), unit, F.lit(r"\b"))), of)

    def named(told: Column) -> Column:
        units = F.array_distinct(F.filter(F.transform(known, lambda p: p["owner_unit"]), lambda u: (u != "") & told.contains(u)))
        words = lambda found, o, i: let(F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0), lambda a: F.substring(told, a + 1, F.greatest(o["end"] - a, F.lit(0))))
        cut = lambda found: F.transform(found, lambda o, i: F.struct(o["unit"].alias("unit"), words(found, o, i).alias("words")))

        def pick(segments: Column, any_post: Column) -> Column:
            mine = lambda p: F.filter(segments, lambda s: s["unit"] == p["owner_unit"])
            chosen = F.filter(known, lambda p: let(mine(p), lambda m: (F.size(m) > 0) & (F.exists(m, lambda s: _says(s["words"], p["owner_base"])) | ~any_post)))
            return F.transform(chosen, lambda p: p["ordinal"])

        any_post = F.exists(known, lambda p: _says(told, p["owner_base"]))
        return let(let(F.array_sort(F.flatten(F.transform(units, lambda u: places(told, u)))), cut), lambda segments: let(any_post, lambda said: pick(segments, said)))

    return let(owner_key(owner), named)


def scope_blocks(lines: Column, start: str = SCOPE_START, end: str = SCOPE_END) -> Column:
    """WIN-12: the blocks of lines that a line matching `start` opens; the next that matches `start` or `end` closes it and stands outside."""
    n = F.size(lines)
    places = F.sequence(F.lit(0), n - 1)
    opens = F.filter(places, lambda i: F.get(lines, i).rlike(start))
    closer = lambda i: first_place(i + 1, n, lambda j: F.get(lines, j).rlike(start) | F.get(lines, j).rlike(end))
    return F.transform(opens, lambda i: F.slice(lines, i + 1, F.coalesce(closer(i), n) - i))


def body_lines(text: str | Column, headers: str = PAGE_HEADER) -> Column:
    """SRC-4: a text's lines, white space collapsed, without empty ones and page headers."""
    return F.filter(F.transform(raw_lines(text), collapsed), lambda x: (x != "") & ~x.rlike(headers))


def scope_claims(lines: Column, known: Column) -> Column:
    """EXT-10, clauses: ages as on a date, and licences, for the posts that a clause names."""

    def of_block(text: Column, n: Column) -> Column:
        part = lambda pattern, g: F.regexp_extract(text, pattern, g)
        age_at, licence_at = (F.format_string(f"scope={kind};occurrence=%d", n + 1) for kind in ("age", "licence"))
        age = lambda **more: _claim(SCOPES, n, F.lit(0), age_at, **more)
        licence = lambda **more: _claim(SCOPES, n, F.lit(1), licence_at, **more)

        def aged(x: Column) -> Column:
            facts = [("age.minimum", "INTEGER", x["least"]), ("age.maximum", "INTEGER", x["most"]), ("age.reference_date", "DATE", x["day"])]
            each = _each(x["owners"], lambda o: F.array(*[age(ordinal=o, path=p, kind=k, value=v) for p, k, v in facts]))
            return (
                F.when((F.size(x["owners"]) == 0) | ~x["ruled"], F.array(age(problem="owner or form is uncertain")))
                .when(x["day"].isNull(), F.array(age(problem="the date is invalid"))).otherwise(each)
            )

        def licensed(owners: Column) -> Column:
            each = F.transform(owners, lambda o: licence(ordinal=o, path="qualification.registration_or_licence", kind="STRING", value=collapsed(part(LICENCE, 2))))
            return F.when(F.size(owners) == 0, F.array(licence(problem="owner is uncertain"))).otherwise(each)

        rule = lambda: F.struct(
            owner_ordinals(part(AGE_OWNER, 1), known).alias("owners"), text.rlike(AGE_RULE).alias("ruled"), part(AGE_RULE, 1).alias("least"), part(AGE_RULE, 2).alias("most"), _exact_date(part(AGE_RULE, 3)).alias("day")
        )
        first = F.when(text.rlike(AGE_OWNER), let(rule(), aged)).otherwise(_no_claims())
        second = F.when(text.rlike(LICENCE), let(owner_ordinals(part(LICENCE, 1), known), licensed)).otherwise(_no_claims())
        return F.concat(first, second)

    return _each(F.transform(scope_blocks(lines), lambda block: collapsed(F.array_join(block, " "))), of_block)


def roster_counts(block: Column) -> Column:
    """FN-33 of a roster's lines: map of path to the last number of the category's last line; a category whose label wraps goes on with the next line or two."""
    text = F.array_join(block, "\n")
    text = F.regexp_replace(text, r"(?im)^(Tea\s+Tribes\s*&\s*Adivasi)\s*\n", "$1 ")
    text = F.regexp_replace(text, r"(?im)^(Tea\s+Tribes\s*&\s*Adivasi [^\d\n]*)\n", "$1 ")
    labels = [(F.lit(label), F.lit(path)) for label, path in ROSTER_CATEGORIES.items()]
    begins = lambda low, label: F.startswith(low, F.concat(label, F.lit(" ")))

    def read(line: Column) -> Column:
        return let(F.lower(line), lambda low: hits(line, low))

    def hits(line: Column, low: Column) -> Column:
        hit = F.lit(None).cast("struct<path:string,value:int>")
        for label, path in reversed(labels):
            numbers = F.regexp_extract_all(line.substr(F.length(label) + 1, F.length(line)), F.lit(r"\b(\d+)\b"), F.lit(1))
            hit = F.when(begins(low, label) & (F.size(numbers) > 0), F.struct(path.alias("path"), F.try_element_at(numbers, F.lit(-1)).try_cast("int").alias("value"))).otherwise(hit)
        return hit

    found = F.array_compact(F.transform(F.split(text, "\n"), read))
    last = lambda f: F.filter(f, lambda x, i: ~F.exists(F.slice(f, i + 2, F.size(f)), lambda y: y["path"] == x["path"]))
    return let(found, lambda f: F.map_from_entries(last(f)))


def roster_claims(lines: Column, known: Column, reach: int = ROSTER_REACH) -> Column:
    """EXT-10, AGG-16, rosters: 'X in Y with Grade Pay of Z' and category counts up to a total; the primary ones must sum to the total of the one post that is named."""
    n = F.size(lines)
    roster = lambda i: let(F.get(lines, i), lambda x: x.rlike("(?i)grade") & x.rlike(ROSTER))  # noqa: E731 - its own word first, which few lines have
    heads = F.filter(F.sequence(F.lit(0), n - 1), roster)

    def of_head(i: Column, k: Column, following: Column) -> Column:
        stop = F.coalesce(following, F.least(n, i + reach))
        total = first_place(i, stop, lambda j: F.get(lines, j).rlike(r"(?i)^Total\s+"))
        locator = F.format_string("roster;occurrence=%d", k + 1)
        claim = lambda **more: _claim(ROSTERS, k, F.lit(0), locator, **more)
        line = F.get(lines, i)
        owner = F.concat_ws(" in ", F.regexp_extract(line, ROSTER, 1), F.regexp_extract(line, ROSTER, 2))

        def fits(x: Column) -> Column:
            stated = F.get(F.filter(known, lambda p: p["ordinal"] == F.get(x["owners"], F.lit(0))), F.lit(0))["total"]
            summed = sum((F.coalesce(F.try_element_at(x["counts"], F.lit(p)), F.lit(0)) for p in ROSTER_PRIMARY), F.lit(0))
            facts = F.transform(F.map_entries(x["counts"]), lambda e: claim(ordinal=F.get(x["owners"], F.lit(0)), path=e["key"], kind="INTEGER", value=e["value"].cast("string")))
            pay = claim(ordinal=F.get(x["owners"], F.lit(0)), path="pay.grade_pay", kind="STRING", value=collapsed(F.regexp_extract(line, ROSTER, 3)))
            sound = F.coalesce((F.size(F.map_keys(x["counts"])) > 0) & (summed == stated), F.lit(False))
            return (
                F.when(F.size(x["owners"]) != 1, F.array(claim(problem=F.format_string("matches %d posts", F.size(x["owners"])))))
                .when(~sound, F.array(claim(problem="doesn't sum to the post's total"))).otherwise(F.concat(F.array(pay), facts))
            )

        closed = lambda t: F.struct(owner_ordinals(owner, known).alias("owners"), roster_counts(F.slice(lines, i + 1, t - i + 1)).alias("counts"))
        return let(total, lambda t: F.when(t.isNull(), _no_claims()).otherwise(let(closed(t), fits)))

    return let(heads, lambda hs: _each(hs, lambda i, k: of_head(i, k, F.get(hs, k + 1))))


def own_claims(posts: Column) -> Column:
    """What the posts came with, as claims that stand before all others."""
    zero, post = F.lit(0), F.lit("post")
    kind = lambda path: F.when(path.startswith("vacancies."), "INTEGER").otherwise("STRING")
    of = lambda p: F.transform(F.map_entries(p["facts"]), lambda e: _claim(0, zero, zero, post, ordinal=p["ordinal"], path=e["key"], kind=kind(e["key"]), value=e["value"]))
    return _each(posts, of)


def claims(notices: DataFrame, id_col: str = "doc_id", text_col: str = "text", posts_col: str = "posts") -> DataFrame:
    """EXT-9, EXT-10: id and one row for each claim of its posts, detail tables, aligned columns, scoped clauses and rosters.

    notices: id, text, posts (as structure_posts gives them). A notice without posts makes no claims.
    """
    text = F.col(text_col)
    body = lambda known: lambda x: F.when(F.size(x) > 0, F.concat(scope_claims(x, known), roster_claims(x, known))).otherwise(_no_claims())
    told = lambda known: F.concat(let(source_lines(text), lambda x: table_claims(x, known)), let(raw_lines(text), lambda x: column_claims(x, known)), let(body_lines(text), body(known)))
    made = let(F.col(posts_col), lambda posts: F.when(F.size(posts) > 0, F.concat(own_claims(posts), let(known_posts(posts), told))))
    return notices.select(id_col, F.explode(made).alias("c")).select(id_col, "c.*")


def attached(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """claims with the first value of each post and path alone: rows without a problem are facts; the others, unowned, ill-formed or in conflict with that value, say what is wrong.

    A claim that repeats the first value goes. Rows are windowed by notice, post and path, in the order of the claims.
    """
    order = Window.partitionBy(id_col, "ordinal", "path", F.col("problem").isNotNull()).orderBy("source", "at", "row", "locator")
    told = found.withColumn("nth", F.row_number().over(order)).withColumn("first", F.first(F.struct("kind", "value")).over(order))
    differs = ~F.struct("kind", "value").eqNullSafe(F.col("first"))
    conflict = F.when(differs & F.col("problem").isNull(), "conflicts with another value")
    out = told.withColumn("problem", F.coalesce("problem", conflict)).where((F.col("nth") == 1) | F.col("problem").isNotNull())
    return out.drop("nth", "first")
