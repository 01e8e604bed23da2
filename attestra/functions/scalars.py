"""Scalar functions as Column builders. All stay in the JVM but nfc, for which Spark has no function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x{00A0}]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable stands for it, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_place(start: Column, end: Column, ok) -> Column:
    """The first place from start up to end, exclusive, that is ok; null if there is none. Those after it aren't looked at."""
    places = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(places, F.lit(None).cast("int"), lambda found, i: F.coalesce(found, F.when(ok(i), i)))


# Values (FLT-1, FLT-2, FN-27, FN-28, FN-32)


def typed_value(kind: str | Column, raw: str | Column) -> Column:
    """struct(value_canon, is_valid): the canonical text of raw under its declared type; a reject is reported, not dropped."""
    kind, raw = _c(kind), _c(raw)
    integer = F.when(raw.rlike(r"^-?[0-9]{1,18}$"), F.try_to_number(raw, F.lit("S999999999999999999")).cast("decimal(18,0)").cast("string"))
    plain = raw.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    number = raw.try_cast("decimal(38,18)")
    text = F.regexp_replace(F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    decimal = F.when(plain & number.isNotNull(), F.when(number == 0, F.lit("0")).otherwise(text))
    boolean = F.when(raw.isin("true", "false"), raw)
    date = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$") & raw.try_cast("date").isNotNull(), raw)
    zoned = raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:\d{2})$")
    moment = F.when(zoned, F.date_format(F.to_utc_timestamp(raw.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    canon = F.when(kind == "STRING", raw).when(kind == "INTEGER", integer).when(kind == "DECIMAL", decimal).when(kind == "BOOLEAN", boolean).when(kind == "DATE", date).when(kind == "DATETIME", moment).when(kind == "JSON", canonical_json(raw))
    valid = F.when(kind == "NULL", raw.isNull()).otherwise(canon.isNotNull())
    return F.struct(canon.alias("value_canon"), F.coalesce(valid, F.lit(False)).alias("is_valid"))


def canonical_json(raw: str | Column) -> Column:
    """Compact JSON with sorted keys; null if raw isn't JSON."""
    return F.to_json(F.try_parse_json(_c(raw)))


def bounded(value: str | Column, limit: int = 10_000, suffix: str = "...[truncated]") -> Column:
    value = _c(value)
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - len(suffix)), F.lit(suffix))).otherwise(value)


def present(canon: str | Column) -> Column:
    canon = _c(canon)
    return F.coalesce(~canon.isin("", "[]", "{}"), F.lit(False))


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# Text (FLT-4, FLT-5, FLT-19, FLT-20, FN-11..FN-17, NFC)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def evidence_text(value: str | Column) -> Column:
    """Line feeds only, outer white space off; empty becomes null."""
    text = F.regexp_replace(F.regexp_replace(_c(value), "\r\n?", "\n"), r"^[\s]+|[\s]+$", "")
    return F.nullif(text, F.lit(""))


def comparison_text(excerpt: str | Column, context: str | Column) -> Column:
    joined = F.concat_ws("\n", _c(excerpt), _c(context))
    return F.lower(F.trim(F.regexp_replace(joined, SPACE, " ")))


def redacted_error(value: str | Column, limit: int = 2_000) -> Column:
    first = F.substring_index(_c(value), "\n", 1)
    return F.substring(F.regexp_replace(first, r"(\w+://)[^\s:/@]+:[^\s@]+@", "$1***:***@"), 1, limit)


def first_label(text: str | Column, markers: list[tuple[str, str]], otherwise: Column) -> Column:
    """The label of the first marker that text contains."""
    out = F.lit(None).cast("string")
    for marker, label in reversed(markers):
        out = F.when(_c(text).contains(marker), F.lit(label)).otherwise(out)
    return F.coalesce(out, otherwise)


def slug(value: str | Column, joiner: str = "_") -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]+", joiner), F.lit(joiner))


def collapsed(value: str | Column) -> Column:
    """White space runs as one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(value), F.lit("")), SPACE, " "))


def post_key(title: str | Column, organisation: str | Column, most: int = 110) -> Column:
    """FN-11: the slug of both in lower case, "post" where nothing is left of it, or 97 characters of it and 12 of the hash where it is too long."""
    seed = F.replace(F.lower(collapsed(F.concat_ws(" ", _c(title), _c(organisation)))), F.lit("ß"), F.lit("ss"))
    hashed = lambda seed, short: F.concat(F.regexp_replace(F.substring(short, 1, 97), "_+$", ""), F.lit("_"), F.substring(F.sha2(seed, 256), 1, 12))
    keyed = lambda seed: let(slug(seed), lambda short: F.when(short == "", "post").when(F.length(short) <= most, short).otherwise(hashed(seed, short)))
    return let(seed, keyed)


def _named(value: str | Column) -> Column:
    return F.btrim(collapsed(value), F.lit(" .,:;"))


def canonical_post_name(title: str | Column, unit: str | Column, previous: str | Column | None = None) -> Column:
    """FN-12: title without a trailing ' - unit' or ' – unit', in any case, of the previous unit and of this one; then ' – unit'."""

    def without(title: Column, ending: Column) -> Column:
        cut = F.length(title) - F.length(ending) - 3
        tail = F.lower(title.substr(cut + 1, F.length(title)))
        ends = (F.length(ending) > 0) & (cut >= 0) & ((tail == F.lower(F.concat(F.lit(" - "), ending))) | (tail == F.lower(F.concat(F.lit(" – "), ending))))
        return F.when(ends, F.trim(F.substring(title, F.lit(1), cut))).otherwise(title)

    last = lambda title, unit: let(without(title, unit), lambda t: F.when(F.length(unit) > 0, F.concat(t, F.lit(" – "), unit)).otherwise(t))
    first = lambda x: x["title"] if previous is None else without(x["title"], F.coalesce(_c(previous), F.lit("")))
    return let(F.struct(_named(title).alias("title"), _named(unit).alias("unit")), lambda x: let(first(x), lambda t: last(t, x["unit"])))


def header_key(value: str | Column) -> Column:
    """FN-13: the letters and digits of a header, in lower case, without spaces."""
    return F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]", "")


def word_key(value: str | Column) -> Column:
    """FN-13: the words of letters and digits of a name, in lower case, a space between them."""
    return F.trim(F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]+", " "))


def split_camel(value: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(value), "(?<=[a-z])(?=[A-Z])", " "), r"^[\s.,;:-]+|[\s.,;:-]+$", "")


def without_trailing_date(value: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(value), r"(?i)[\s,]*dated\s+\d{1,2}[./-]\d{1,2}[./-]\d{4}\s*$", ""))


def labelled(line: str | Column) -> Column:
    """struct(label, value) of 'label: value'."""
    line = _c(line)
    return F.struct(word_key(F.regexp_extract(line, r"^\s*([^:]{1,80}?)\s*:", 1)).alias("label"), F.trim(F.regexp_extract(line, r"^[^:]*:\s*(.*)$", 1)).alias("value"))


def clean_item(line: str | Column) -> Column:
    """A list item without its bullet or number."""
    return F.trim(F.regexp_replace(_c(line), r"^\s*(?:[-*•]|\(?(?:\d{1,2}|[ivxIVX]{1,5}|[a-zA-Z])[.)])\s+", ""))


# URLs (FLT-3, FLT-7)


def normalize_url(url: str | Column) -> Column:
    """Lower scheme and host, no default port or fragment, '/' for an empty path; null for other schemes and for credentials."""
    url = F.trim(_c(url))
    scheme, port = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    path, query = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    ok = scheme.isin("http", "https") & (host != "") & ~url.rlike(r"^[A-Za-z]+://[^/?#]*@")
    return F.when(ok, F.concat(scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(path == "", F.lit("/")).otherwise(path), query))


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z]+://([^/?#:]*)", 1))


# Hashes and keys (FN-1..FN-10)


def canonical_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by the unit separator; null is told from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]), 256)


def fact_set_hash(facts: Column) -> Column:
    """SHA-256 of an array of structs in sorted order, so that the input's order doesn't matter."""
    return F.sha2(F.to_json(F.array_sort(facts), {"ignoreNullFields": "false"}), 256)


def uuid5(namespace_hex: str, name: str | Column) -> Column:
    """UUID of version 5: SHA-1 of namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), _c(name).cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def subject_key(authority: str | Column, year: str | Column, url: str | Column) -> Column:
    return F.concat_ws("_", _c(authority), F.lit("ADVT"), F.coalesce(_c(year).cast("string"), F.lit("UNKNOWN")), F.upper(F.substring(F.sha2(_c(url), 256), 1, 12)))


def number_year_key(prefix: str, reference: str | Column) -> Column:
    """PREFIX_ADVT_n_YYYY of 'n/YYYY', leading zeros off; null if it has another form."""
    n, y = F.regexp_extract(_c(reference), r"(\d+)\s*/\s*(\d{4})", 1), F.regexp_extract(_c(reference), r"(\d+)\s*/\s*(\d{4})", 2)
    return F.when(n != "", F.concat(F.lit(f"{prefix}_ADVT_"), n.try_cast("bigint").cast("string"), F.lit("_"), y))


def campaign_key(prefix: str, year: str | Column, reference: str | Column) -> Column:
    """Null if either part is missing."""
    ref = F.nullif(F.upper(slug(reference)), F.lit(""))
    return F.when(_c(year).isNotNull() & ref.isNotNull(), F.concat_ws("_", F.lit(prefix), _c(year).cast("string"), ref))


# Dates (FN-19..FN-26)


def numeric_date(text: str | Column) -> Column:
    """The first dd.mm.yyyy, dd/mm/yyyy or dd-mm-yyyy; an impossible date is null."""
    at = lambda i: F.regexp_extract(_c(text), r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", i)
    return F.concat_ws("-", at(3), F.lpad(at(2), 2, "0"), F.lpad(at(1), 2, "0")).try_cast("date")


def worded_date(text: str | Column) -> Column:
    """'4th August 2026' and '4 August 2026'."""
    at = lambda i: F.regexp_extract(_c(text), r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*,?\s+(\d{4})", i)
    month = F.ceil(F.position(F.lower(at(2)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) / 3).cast("string")
    return F.when(at(1) != "", F.concat_ws("-", at(3), F.lpad(month, 2, "0"), F.lpad(at(1), 2, "0")).try_cast("date"))


def listing_date(text: str | Column) -> Column:
    iso = F.regexp_extract(_c(text), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    return F.coalesce(iso, numeric_date(text), worded_date(text))


def application_window(text: str | Column) -> Column:
    """struct(start_date, end_date) of 'from d to d'; null where the start is later than the end."""
    date = r"(\d{1,2}[./-]\d{1,2}[./-]\d{4})"
    start = numeric_date(F.regexp_extract(_c(text), rf"(?i)from\s+{date}", 1))
    end = numeric_date(F.coalesce(F.nullif(F.regexp_extract(_c(text), rf"(?i)(?:to|till|until|upto)\s+{date}", 1), F.lit("")), F.regexp_extract(_c(text), rf"(?i)last date[^0-9]*{date}", 1)))
    return F.when(start <= end, F.struct(start.alias("start_date"), end.alias("end_date")))


def lifecycle(start: str | Column, end: str | Column, as_of: Column, recent_days: int = 30) -> Column:
    start, end = _c(start), _c(end)
    return (
        F.when(start > end, "UNKNOWN").when(start > as_of, "UPCOMING").when(end.isNull(), "UNKNOWN").when(end >= as_of, "OPEN")
        .when(F.datediff(as_of, end) <= recent_days, "RECENTLY_CLOSED").otherwise("CLOSED")
    )


def age_on(birth: str | Column, cutoff: str | Column) -> Column:
    b, c = _c(birth), _c(cutoff)
    early = (F.month(c) < F.month(b)) | ((F.month(c) == F.month(b)) & (F.day(c) < F.day(b)))
    return F.year(c) - F.year(b) - early.cast("int")


def next_due(last: str | Column, minutes: str | Column) -> Column:
    return F.timestamp_add("MINUTE", _c(minutes), _c(last))


# Predicates (FLT-6, FLT-9, FLT-10, FLT-11)

# The paths that count as critical.
CRITICAL_EXACT = ("application.start_date", "application.end_date", "application.deadline", "application.last_date", "application.url", "application.apply_url", "eligibility.minimum_age", "eligibility.maximum_age", "eligibility.age_cutoff_date", "vacancies.total")
CRITICAL_PREFIX = r"^(eligibility\.(age_relaxation|qualification|domicile|experience)|qualification\.|domicile\.|experience\.)"
CRITICAL_POST = {1: r"^posts\.[0-9]+\.(vacancies|eligibility|qualification|experience|age)(\.|$)", 2: r"^posts\.[^.]+\.(vacancies|eligibility|qualification|experience|age|application)(\.|$)"}


def is_critical(path: str | Column, version: int = 1) -> Column:
    path = _c(path)
    return path.isin(*CRITICAL_EXACT) | path.rlike(CRITICAL_PREFIX) | path.rlike(CRITICAL_POST[version])


def opening_notice(title: str | Column, opening: str, lifecycle_terms: tuple[str, ...]) -> Column:
    """The title matches the opening pattern and has none of the later terms."""
    title = F.lower(_c(title))
    return title.rlike(opening) & ~title.rlike("|".join(lifecycle_terms))


def accepted_by_rule(title: str | Column, wanted: tuple[str, ...], unwanted: tuple[str, ...]) -> Column:
    title = F.lower(_c(title))
    has = lambda terms: title.rlike("|".join(terms)) if terms else F.lit(False)
    return has(wanted) & ~has(unwanted)


def within_history(date: str | Column, as_of: Column, months: int) -> Column:
    """An unknown date stays in."""
    return F.coalesce(_c(date) >= F.add_months(as_of, -months), F.lit(True))
