"""Facts of a notice's headed sections by rules that are rows, and fields by a user's own grammar.

A section's kind decides which rules read it: sections meet rules by an equi-join on the kind, and each
rule's pattern is a column. What a rule does with the section is its handler; a new kind, path or pattern is
a new row, no new code. For texts without headings, or grammars that rules can't say, there is the table
function `extract_fields`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.scalars import collapsed, let
from attestra.operators.post_details import body_lines

# Headings and the kind of what stands below them.
HEADINGS = {
    "eligibility criteria": "eligibility",
    "educational qualification": "qualification",
    "education qualification": "qualification",
    "educational standards": "qualification",
    "educational and other qualification required": "qualification",
    "educational qualification other mandatory requirement": "qualification",
    "qualification": "qualification",
    "age": "age",
    "age criteria": "age",
    "age limit": "age",
    "age relaxation": "age_relaxation",
    "relaxation in age": "age_relaxation",
    "relaxations": "age_relaxation",
    "domicile residency": "domicile",
    "domicile": "domicile",
    "residency": "domicile",
    "nationality": "nationality",
    "experience": "experience",
    "pay scale": "pay",
    "salary pay scale": "pay",
    "remuneration": "pay",
    "physical standards": "physical",
    "physical standard": "physical",
    "physical standard test": "physical",
    "physical efficiency test": "physical",
    "pst pet": "physical",
    "medical standards": "medical",
    "medical standard": "medical",
    "medical fitness": "medical",
    "reservation": "reservation",
    "reservation of vacancies": "reservation",
    "application fee": "application_fee",
    "how to apply": "application_steps",
    "application procedure": "application_steps",
    "application process": "application_steps",
    "where to apply": "application_location",
    "application portal": "application_location",
    "documents required": "documents",
    "documents to be uploaded": "documents",
    "documents": "documents",
    "certificates documents": "documents",
    "selection process": "selection",
    "selection procedure": "selection",
    "recruitment process": "selection",
    "phases of recruitment tests": "selection",
    "mode of selection": "selection",
    "scheme of examination": "exam_pattern",
    "exam pattern": "exam_pattern",
    "examination pattern": "exam_pattern",
    "written test": "exam_pattern",
    "syllabus": "syllabus",
    "other eligibility conditions": "other_eligibility",
    "eligibility conditions": "other_eligibility",
    "general instructions": "instructions",
    "important instructions": "instructions",
}
_NUMBER = r"(?i)^\s*\d+(?:\.\d+)*(?:\.[A-Z])?\.?\s*"
_BULLET = r"(?i)\s*(?:\(?(?:[ivx]{1,5}|\d{1,3}|[a-z])[.)]|[-•*])\s+"

RULE = "kind string, n int, handler string, path string, label string, pattern string, type string"
#: Handlers: TEXT the whole section, LIST its items, MATCH the pattern's first group, PAIR and OBJECT what several rules of a path say together.
TEXT, LIST, MATCH, PAIR, OBJECT = "TEXT", "LIST", "MATCH", "PAIR", "OBJECT"


def default_rules(region: str, language: str) -> list[tuple]:
    """The rules of notices of a region; (kind, n, handler, path, label, pattern, type)."""
    who = r"(?i)((?:Applicant|Candidate)s?\s+must\s+"
    years = r".{0,220}?Additional\s+(\d+)\s*(?:\([^)]*\)\s*)?years"
    rows = [
        ("eligibility", MATCH, "nationality.requirement", None, who + r"be\s+(?:a\s+)?Citizen\s+of\s+India)", "STRING"),
        ("eligibility", MATCH, "domicile.requirement", None, who + rf"be.{{0,40}}?Permanent\s+Resident\s+of\s+{region})", "STRING"),
        ("eligibility", MATCH, "registration.employment_exchange", None, who + rf"be\s+registered\s+with\s+a\s+local\s+Employment\s+Exchange\s+in\s+{region})", "STRING"),
        ("eligibility", MATCH, "language.requirement", None, who + rf"speak\s+{language}\s+or\s+any\s+other\s+State\s+language\s+fluently)", "STRING"),
        ("age", MATCH, "age.minimum", None, r"(?i)\bminimum(?:\s+age)?\s*[:=-]?\s*(\d{1,3})\s*years?\b", "INTEGER"),
        ("age", MATCH, "age.maximum", None, r"(?i)\bmaximum(?:\s+age)?\s*[:=-]?\s*(\d{1,3})\s*years?\b", "INTEGER"),
        ("age_relaxation", PAIR, "age.relaxations", "SC / ST(P) / ST(H)", r"(?i)SC,?\s*ST\s*\(P\)\s*and\s*ST\s*\(H\)\s+(\d+)\s+years", "JSON"),
        ("age_relaxation", PAIR, "age.relaxations", "OBC / MOBC", r"(?i)OBC\s*/\s*MOBC\s+(\d+)\s+years", "JSON"),
        ("age_relaxation", PAIR, "age.relaxations", "Trained Home Guards", r"(?i)Trained\s+Home\s+Guards" + years, "JSON"),
        ("age_relaxation", PAIR, "age.relaxations", "Ex-servicemen", r"(?i)Ex[ -]?Servicemen" + years, "JSON"),
        ("age_relaxation", PAIR, "age.relaxations", "PwBD", r"(?i)PwBD.{0,100}?(\d+)\s+years", "JSON"),
        ("domicile", TEXT, "domicile.requirement", None, None, "STRING"),
        ("nationality", TEXT, "nationality.requirement", None, None, "STRING"),
        ("experience", TEXT, "experience.requirement", None, None, "STRING"),
        ("pay", MATCH, "pay.scale", None, r"(?i)(Rs\.?\s*[\d,]+(?:\s*[-–]\s*[\d,]+)?(?:/-)?)", "STRING"),
        ("medical", TEXT, "medical.criteria", None, None, "STRING"),
        ("physical", TEXT, "physical.criteria", None, None, "STRING"),
        ("application_fee", TEXT, "application.fee", None, None, "STRING"),
        ("application_steps", LIST, "application.steps", None, None, "JSON"),
        ("application_location", TEXT, "application.where_to_apply", None, None, "STRING"),
        ("documents", LIST, "application.documents_required", None, None, "JSON"),
        ("selection", LIST, "selection.phases", None, None, "JSON"),
        ("exam_pattern", OBJECT, "selection.exam_pattern", "questions", r"(?i)\b(\d+)\s+(?:multiple\s+choice|objective|questions)", "JSON"),
        ("exam_pattern", OBJECT, "selection.exam_pattern", "marks", r"(?i)\bTotal\s+marks\b.{0,60}?\b(\d+)\b", "JSON"),
        ("exam_pattern", OBJECT, "selection.exam_pattern", "duration", r"(?i)\bDuration\s*:?\s*(\d+\s+(?:hours?|minutes?))", "JSON"),
        ("exam_pattern", OBJECT, "selection.exam_pattern", "mode", r"(?i)\b(OMR\s+answer\s+sheet|computer[ -]based)", "JSON"),
        ("syllabus", LIST, "syllabus.subjects", None, None, "JSON"),
        ("other_eligibility", LIST, "eligibility.other", None, None, "JSON"),
        ("instructions", LIST, "instructions.important", None, None, "JSON"),
    ]
    return [(kind, n, handler, path, label, pattern, of) for n, (kind, handler, path, label, pattern, of) in enumerate(rows)]


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def _has_small(text: Column) -> Column:
    """Whether a text isn't all in capitals; only letters beyond a-z need the comparison, which is slow."""
    return text.rlike("[a-z]") | (text.rlike(r"[^\x00-\x7F]") & (text != F.upper(text)))


def heading(line: Column) -> Column:
    """struct(kind, title, rest) of a heading line, else null.

    A heading may be numbered and is followed by its end, a colon, a stop or a dash. One that is numbered
    without a dot must be in capitals, and one without a number mustn't be a sentence.
    """
    gap = r"[\s&/()-]+"
    names = "|".join(gap.join(map(re.escape, name.split())) for name in sorted(HEADINGS, key=len, reverse=True))
    known = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    bare, number = F.regexp_replace(line, _NUMBER, ""), F.trim(F.regexp_extract(line, _NUMBER.replace("(?i)^", "(?i)^(") + ")", 1))

    def read(x: Column) -> Column:
        kind = F.try_element_at(known, F.lower(F.regexp_replace(x["title"], gap, " ")))
        plain = (x["number"] != "") & ~F.rtrim(F.regexp_replace(x["number"], r"\.$", "")).contains(".") & _has_small(x["bare"])
        sentence = (x["number"] == "") & line.endswith(".") & _has_small(line)
        rest = F.regexp_replace(x["bare"].substr(F.length(x["title"]) + 1, F.length(x["bare"])), r"^[\s:.-]+", "")
        return F.when((x["title"] != "") & ~plain & ~sentence, F.struct(kind.alias("kind"), x["title"].alias("title"), rest.alias("rest")))

    return let(F.struct(bare.alias("bare"), number.alias("number"), F.regexp_extract(bare, rf"(?i)^({names})(?=\s*[:.-]|\s*$)", 1).alias("title")), read)


def headed_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """WIN-6 for EXT-8: id, occurrence, kind, title, lines of every headed section; what stands on the heading's own line is its first. Page headers are passed over."""

    def cut(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), heading(x).alias("h"))), lambda x: x["h"].isNotNull())
        first = lambda x: F.when(x["h"]["rest"] != "", F.array(x["h"]["rest"])).otherwise(F.expr("cast(array() as array<string>)"))
        body = lambda hs, x, k: F.slice(lines, x["i"] + 2, F.coalesce(F.get(hs, k + 1)["i"], F.size(lines)) - x["i"] - 1)
        return let(heads, lambda hs: F.transform(hs, lambda x, k: F.struct((k + 1).alias("occurrence"), x["h"]["kind"].alias("kind"), x["h"]["title"].alias("title"), F.concat(first(x), body(hs, x, k)).alias("lines"))))

    return docs.select(id_col, F.explode(let(body_lines(text_col), cut)).alias("s")).select(id_col, "s.*")


def list_items(lines: Column) -> Column:
    """SET-7: the items of a section, bullets and numbers off; a line without one goes on with the item before it, unless no line has one."""
    bulleted = F.exists(lines, lambda x: x.rlike("^" + _BULLET))
    joined = F.regexp_replace(F.array_join(lines, "\n"), rf"\n(?!{_BULLET.replace('(?i)', '')})", " ")
    items = F.when(bulleted, F.split(joined, "\n")).otherwise(lines)
    clean = F.transform(items, lambda x: F.regexp_replace(collapsed(F.regexp_replace(x, "^" + _BULLET, "")), r"[.;]+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def section_facts(sections: DataFrame, rules: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """EXT-8, AGG-19: id, path, type, value, locator: what the rules of a section's kind read in it.

    sections as headed_sections gives them; rules: RULE. What PAIR and OBJECT rules of one path find in a
    section is one JSON value. A path with two values in a notice is dropped: no section outranks another.
    """
    several = F.col("handler").isin(PAIR, OBJECT)
    of = F.array_sort(F.collect_list(F.struct("n", "label", "pattern", "handler")))  # rules that make one value together are one row before they meet sections
    sets = rules.groupBy(F.col("kind").alias("rule_kind"), "path", "type", F.when(~several, F.col("n")).alias("alone")).agg(of.alias("of")).withColumn("handler", F.get("of", F.lit(0))["handler"])
    j = sections.join(sets, sections["kind"] == sets["rule_kind"]).withColumn("body", F.array_join("lines", " "))
    said = lambda x: let(collapsed(x), lambda v: F.when(v != "", v))
    hit = lambda r: said(F.call_function("regexp_extract", F.col("body"), F.coalesce(r["pattern"], F.lit("()")), F.lit(1)))
    items = let(list_items(F.col("lines")), lambda v: F.when(F.size(v) > 0, F.to_json(v)))
    pairs = lambda found: F.to_json(F.transform(found, lambda x: F.struct(x["label"].alias("category"), F.concat(x["value"], F.lit(" years")).alias("relaxation"))))
    quoted = lambda x: F.concat(F.to_json(F.array(x["label"])).substr(F.lit(2), F.length(F.to_json(F.array(x["label"]))) - 2), F.lit(":"), F.when(x["value"].rlike(r"^\d+$"), x["value"]).otherwise(F.concat(F.lit('"'), F.replace(x["value"], F.lit('"'), F.lit('\\"')), F.lit('"'))))
    whole = lambda found: F.concat(F.lit("[{"), F.array_join(F.transform(found, quoted), ","), F.lit("}]"))
    found = F.filter(F.transform("of", lambda r: F.struct(r["label"].alias("label"), hit(r).alias("value"))), lambda x: x["value"].isNotNull())
    joined = let(found, lambda x: F.when(F.size(x) > 0, F.when(F.col("handler") == PAIR, pairs(x)).otherwise(whole(x))))
    value = F.when(F.col("handler") == TEXT, said(F.col("body"))).when(F.col("handler") == LIST, items).when(several, joined).otherwise(hit(F.get("of", F.lit(0))))
    # one value at most: exploded, so that no filter below computes it once more
    every = j.select(id_col, "occurrence", "kind", "path", "type", F.explode(F.array_compact(F.array(value))).alias("value"))
    locator = F.concat(F.lit("section="), F.col("kind"), F.lit(";occurrence="), F.col("occurrence").cast("string"))
    one = F.struct("type", "value")
    told = every.groupBy(id_col, "path").agg(F.min(one).alias("least"), F.max(one).alias("most"), F.min_by(F.struct("type", "value", locator.alias("locator")), "occurrence").alias("f"))
    return told.where("least = most").select(id_col, "path", "f.*")


@F.udtf(returnType="path string, value string, start int, end int")
class extract_fields:  # noqa: N801 - called as a function
    """Table function (text, grammar): one row for each match of a user's grammar, a JSON object of path to pattern.

    A pattern's group `value`, or else its first group, or else the match is the value; start and end are
    places in the text. Patterns are Python's. A null text or grammar gives no rows; a pattern that is
    none ends the query. Compiled grammars are kept for the rows that follow.
    """

    def __init__(self):
        self.known: dict[str, list] = {}

    def eval(self, text: str, grammar: str) -> Iterator[tuple]:
        if text is None or grammar is None:
            return
        if grammar not in self.known:
            self.known[grammar] = [(path, re.compile(pattern)) for path, pattern in json.loads(grammar).items()]
        for path, pattern in self.known[grammar]:
            for m in pattern.finditer(text):
                group = "value" if "value" in pattern.groupindex else 1 if pattern.groups else 0
                yield path, m.group(group), m.start(group), m.end(group)


def grammar_fields(docs: DataFrame, grammar: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UDTF surface: id, path, value, start, end of every match of the grammar in a row's text; grammar may be another for each row."""
    rows = docs.select(id_col, F.col(text_col).alias("text"), grammar.alias("grammar")).alias("t")
    return rows.lateralJoin(extract_fields(F.col("t.text").outer(), F.col("t.grammar").outer()).alias("f")).select(f"t.{id_col}", "f.*")
