"""Secrets: patterns propose, and the whole corpus tells copied examples from an owner's own credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, columns_of, cut_lineage, map_batches, spread_join, table

KINDS = ("assign", "access", "hex")
#: The kind that the method adds: tokens of high entropy that few owners have.
ADDED = "entropy"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_TABLE = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))
_HEX_RUN = b"x" * 24
#: 24 or more characters with digits and letters of both cases in one run.
_DENSE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")
LEAST_BITS = 3.8
#: A value that this many owners, or repositories, have is a copied example.
OWNERS, REPOSITORIES = 3, 50


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start and then kind. Cheap tests first: few texts hold a keyword or a long run."""
    found = []
    low = text.encode().lower()
    if any(n.encode() in low for n in _NAMES):
        found += [("assign", *m.span(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m.group()) for m in _ACCESS.finditer(text)]
    if _HEX_RUN in text.encode().translate(_HEX_TABLE):
        found += [("hex", *m.span(), m.group()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


_WORD24 = re.compile(rb"[A-Za-z0-9+/_-]{24}")


def added_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Dense tokens that are no base span: letters of both cases and digits, of high entropy."""
    if not _WORD24.search(text.encode()):
        return []
    out, free = [], clear_of((a, b) for _, a, b, _ in base)
    for m in _DENSE.finditer(text):
        v = m.group()
        if any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= LEAST_BITS and free(*m.span()):
            out.append((ADDED, *m.span(), v))
    return out


def written(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, print binary, found array<struct<kind:string,start:int,end:int,value:string>>"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Each row's base counts and all its candidates; value is the SHA-256 of the secret, never the secret."""
    rows = columns_of(docs, id=id_col, owner=docs[owner_col].cast("string"), text=text_col)

    def run(x: dict[str, list]) -> dict[str, list]:
        base = [base_spans(t) if t else [] for t in x["text"]]
        every = [b + (added_spans(t, b) if t else []) for t, b in zip(x["text"], base)]
        return {
            "id": x["id"], "owner": x["owner"], **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS},
            "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base],
            "print": [hashlib.blake2b(t.encode(), digest_size=16).digest() if e else b"" for t, e in zip(x["text"], every)],
            "found": [[{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()} for k, a, b, v in e] for e in every],
        }

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, owner string, {_FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories: over the whole corpus, counted in two steps so that a copied value is summed before it is dealt out."""
    pairs = found.groupBy("value", "owner", "id").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.count("owner").alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live.

    A document is a repository, and owner_col names its owner. A candidate that at least `owners`
    owners or `repositories` repositories hold is a copied example, any other looks live. Base spans
    always stay; of the dense tokens that the method adds, only those that look live are listed.
    live has the spans that look live.

    Null and empty texts have no spans, and a null owner counts as none. Repeated rows give repeated
    results, an empty table an empty one; only the named columns are read. Texts are read once, and
    what was found (no text) is written to the shared checkpoint folder. Rows without candidates are
    never shuffled; the places of a widely copied value, also those in exact copies of a text, meet its
    counts in several tasks. A text of any length is searched whole in its task; equal rows are told
    apart by number only, so ties and any row order give the same.
    """
    rows = cut_lineage(candidates(docs, id_col, text_col, owner_col))
    some = rows.where(F.size("found") > 0)
    key = ["id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "print"]
    each = some.select(*key, F.size("found").alias("of"), F.explode("found").alias("c")).select(*key, "of", "c.*")
    stats = ownership(each.select("value", "owner", "id"))
    is_live = (F.col("owners") < owners) & (F.col("repositories") < repositories)
    judged = spread_join(each, stats, "value", ["id", "print", "start"]).select(*key, "of", "kind", "start", "end", is_live.alias("looks_live"))
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    # Equal rows fall into one group and hold `of` candidates each; the group is written out as often as there were rows.
    spans = judged.groupBy(*key, "of").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.struct("start", order.alias("k"), "end", "kind", "looks_live"))).alias("s"))
    say = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    kept = F.filter("s", lambda x: (x["kind"] != ADDED) | x["looks_live"])
    live = F.filter("s", lambda x: x["looks_live"])
    told = spans.select(*key, say(kept).alias("spans"), F.size(live).cast("long").alias("n_live"), F.size(F.filter("s", lambda x: ~x["looks_live"])).cast("long").alias("n_example"), say(live).alias("live"), F.explode(F.sequence(F.lit(1), (F.col("n") / F.col("of")).cast("int"))).alias("copy"))
    none = rows.where(F.size("found") == 0).select(*key, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"), F.lit("").alias("live"))
    return told.select(none.columns).unionByName(none).select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "live")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
