"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, columns_of, map_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base ones; their order follows.
ADDED = ("iban", "ssn")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "iban": "[IBAN]", "ssn": "[SSN]"}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Words that speak for a kind, or against personal data of any kind, when they stand near a span.
NEAR = {
    "email": frozenset("mail email contact write reply kontakt schreiben courriel écrire correo escribir contacto".split()),
    "ip": frozenset("ip host address login server adresse serveur servidor dirección".split()),
    "card": frozenset("card visa mastercard credit payment cvv expires karte kreditkarte zahlung carte paiement tarjeta pago".split()),
    "phone": frozenset("phone telephone call tel mobile fax contact telefon handy anrufen téléphone appeler teléfono móvil llamar".split()),
    "iban": frozenset("iban bank account transfer bic swift konto bankverbindung überweisung compte banque virement cuenta banco transferencia".split()),
    "ssn": frozenset("ssn social security taxpayer sozialversicherung sécurité sociale seguridad".split()),
}
AGAINST = frozenset("example version sample isbn invoice order serial beispiel rechnung bestellung exemple facture commande ejemplo factura pedido".split())
#: Score before words are looked at. A checksum counts more than a shape alone; an added kind is listed from LEAST on, so words decide for each of them.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.6, "iban": 0.6, "ssn": 0.4}
#: Characters on either side of a span in which words count, what words of either list move a score by, and the least score of an added span.
REACH, STEP, LEAST = 40, 0.2, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def octet(part: str) -> bool:
    """Whether digits, as many as there may be, say at most 255."""
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a domain is taken with the longest local part before it, not beyond the span before; time is linear in the text."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m.group().split(".")))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def nearby(text: str, start: int, end: int) -> set[str]:
    """Lower-cased whole words within REACH characters of a span; a word that the reach cuts doesn't count."""
    first, last = max(0, start - REACH), min(len(text), end + REACH)
    before = [m.group() for m in _LETTERS.finditer(text, first, start) if m.start() > first or not first or not text[first - 1].isalpha()]
    after = [m.group() for m in _LETTERS.finditer(text, end, last) if m.end() < last or last == len(text) or not text[last].isalpha()]
    return {w.lower() for w in before + after}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = nearby(text, start, end)
    value = PRIOR[kind] + STEP * bool(near & NEAR[kind]) - STEP * bool(near & AGAINST)
    return round(min(1.0, max(0.0, value)), 2)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Bank accounts whose check digits fit and numbers of social security, each as far as the words near it allow; none over a base span."""
    found = [("iban", *m.span()) for m in _IBAN.finditer(text) if 15 <= len(m.group().replace(" ", "")) <= 34 and mod97(m.group())]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)] if "-" in text else []
    if not found:
        return []
    free = clear_of((a, b) for _, a, b in base)
    return [s for s in found if free(s[1], s[2]) and score(text, *s) >= LEAST]


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with scores), each by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    every = base + (added_spans(text, base) if _DIGIT.search(text) else [])
    order = (*KINDS, *ADDED).index
    return base, [(*s, score(text, *s)) for s in sorted(every, key=lambda s: (s[1], order(s[0]), s[2]))]


def written(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def masked(text: str | None, spans: list[tuple]) -> str | None:
    """text with every span replaced by its kind; of overlapping spans the first names the whole stretch."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], MASKS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id, counts by base kind, base_sha256, spans, scored spans and, if asked for, the masked text.

    Null and empty texts have no spans (base_sha256 is that of an empty string), and a null text
    stays null when masked. Repeated rows give repeated results, an empty table an empty one; only
    the named columns are read. Work and memory are linear in each text.
    """
    rows = columns_of(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(x: dict[str, list]) -> dict[str, list]:
        found = [find(t) for t in x["text"]]
        out = {"id": x["id"]} | {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        out |= {"base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], "spans": [written(s) for _, s in found]}
        out["scored"] = [[{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in s] for _, s in found]
        return out | ({"masked": [masked(t, s) for t, (_, s) in zip(x["text"], found)]} if with_text else {})

    schema = f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, scored array<struct<kind:string,start:int,end:int,score:double>>"
    return map_batches(rows, run, schema + ", masked string" * with_text).withColumnRenamed("id", id_col)


def mask_pii(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the same columns and rows; spans of the text are replaced by their kinds and chars_col counts anew."""
    schema = docs.schema

    def run(x: dict[str, list]) -> dict[str, list]:
        return x | {text_col: [masked(t, find(t)[1]) for t in x[text_col]]}

    out = map_batches(docs, run, schema)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType))
    return out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
