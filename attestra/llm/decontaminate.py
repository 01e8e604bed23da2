"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

The automaton holds each item's words in pieces that don't overlap, short enough that every window
of the item contains a whole piece. A text is scanned once; where a piece occurs, its item is
followed to both sides as far as the words agree, and a run as long as a window is a hit. So the
automaton is as large as the benchmark and not as all its windows. Hits are found in the normalised
text and mapped back to words and to code points of the original.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, columns_of, cut_lineage, map_batches, restored, table

#: Words of a benchmark window.
WINDOW = 13
#: Benchmark bytes that one automaton holds (about one trie node each, some 60 bytes); a larger benchmark is scanned in blocks, with the same result.
BLOCK_BYTES = 6_000_000

_SPACE = 0x20
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else _SPACE for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


@dataclass(frozen=True)
class Pieces:
    """items: (id, words) of each item. The automaton's value of a piece is (its words, [(item's number, the piece's place in it)])."""

    items: list[tuple[str | None, list[bytes]]]
    size: int
    automaton: ahocorasick.Automaton | None

    @classmethod
    def of(cls, benchmark: tuple[tuple[str | None, str | None], ...], size: int) -> Pieces:
        items = [(item, w) for item, text in benchmark if (w := words(text))]
        found: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        for number, (_, w) in enumerate(items):
            # A window of `size` words that begins anywhere has a multiple of `step` among its first `step` places.
            step = (size + 1) // 2 if len(w) >= size else len(w)
            for at in range(0, len(w) - step + 1, step):
                key = f" {b' '.join(w[at : at + step]).decode('latin-1')} "
                found.setdefault(key, (step, []))[1].append((number, at))
        out = ahocorasick.Automaton()
        for key, value in found.items():
            out.add_word(key, value)
        if found:
            out.make_automaton()
        return cls(items, size, out if found else None)


_BUILT: list[tuple[object, int, Pieces]] = []


def pieces(benchmark: tuple[tuple[str | None, str | None], ...], size: int) -> Pieces:
    """A worker's last automaton, while it is asked for the same broadcast value."""
    if not (_BUILT and _BUILT[0][0] is benchmark and _BUILT[0][1] == size):
        _BUILT[:] = [(benchmark, size, Pieces.of(benchmark, size))]
    return _BUILT[0][2]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive word ranges, sorted, with overlapping and adjacent ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(text: str | None, bench: Pieces) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, hit word ranges, items with an occurring window) of one text."""
    w = words(text)
    if not w or bench.automaton is None:
        return len(w), [], set()
    joined = b" ".join(w)
    ends = list(bench.automaton.iter(f" {joined.decode('latin-1')} "))
    if not ends:
        return len(w), [], set()
    gaps = np.flatnonzero(np.frombuffer(b" " + joined + b" ", np.uint8) == _SPACE)
    last = np.searchsorted(gaps, [e for e, _ in ends]) - 1
    hits: list[tuple[int, int]] = []
    met: set[int] = set()
    first, stop = 0, 0  # the range of hit words that was joined last
    followed: dict[tuple[int, int], int] = {}  # up to which word an item is known to agree, or not to, for each place that it would begin at
    for k, (_, (n, places)) in zip(last.tolist(), ends):
        at = k - n + 1
        for number, place in places:
            item, begins = bench.items[number][1], at - place
            if followed.get((number, begins), -1) >= at + n or (number in met and first <= max(begins, 0) and begins + len(item) <= stop):
                continue
            a, b, low, high = at, at + n, max(begins, 0), min(begins + len(item), len(w))
            while a > low and w[a - 1] == item[a - 1 - begins]:
                a -= 1
            while b < high and w[b] == item[b - begins]:
                b += 1
            followed[number, begins] = b
            if b - a >= min(bench.size, len(item)):
                hits.append((a, b - 1))
                met.add(number)
                first, stop = (min(a, first), max(b, stop)) if a <= stop and b >= first and stop else (a, b)
    return len(w), merged(hits), {i for number in met if (i := bench.items[number][0]) is not None}


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of words as code points of the original text, end exclusive."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in ranges]


_STATE = "id {kind}, text string, n_words long, hits array<struct<first:int,last:int>>, items array<string>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id, text, n_words, n_hit, n_items, items, items_sha256, contaminated, spans.

    Null and empty texts have no words: nothing is hit, and items_sha256 is that of an empty
    string. Benchmark items without words have no window; an item without an id marks words as hit
    and is not listed. Repeated rows of docs give repeated results; repeated items count once.
    Empty tables give an empty result or no hits. Only the named columns are read.

    The benchmark is the query set: it is read in blocks of about block_bytes, each of which is
    broadcast and scanned against all documents; one block is the rule. Between blocks the state is
    written to the shared checkpoint folder.
    """
    items = columns_of(benchmark, item=benchmark[item_col].cast("string"), text=item_text_col).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    state = columns_of(docs, id=id_col, text=text_col)
    kind = state.schema["id"].dataType.simpleString()
    for k in range(blocks):
        of_block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        held = docs.sparkSession.sparkContext.broadcast(tuple((r["item"], r["text"]) for r in of_block.collect()))

        def run(x: dict[str, list], held=held) -> dict[str, list]:
            bench = pieces(held.value, size)
            found = [scan(t, bench) for t in x["text"]]
            if "hits" in x:
                found = [(n, merged([*h, *((r["first"], r["last"]) for r in old)]), ids | set(was)) for (n, h, ids), old, was in zip(found, x["hits"], x["items"])]
            return {"id": x["id"], "text": x["text"], "n_words": [n for n, _, _ in found], "hits": [[{"first": a, "last": b} for a, b in h] for _, h, _ in found], "items": [sorted(ids) for _, _, ids in found]}

        last = k == blocks - 1
        state = map_batches(state, (lambda x, run=run: _finished(run(x))) if last else run, _RESULT.format(kind=kind) if last else _STATE.format(kind=kind))
        if not last:
            state = cut_lineage(state)
    return state.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


_RESULT = "id {kind}, text string, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def _finished(x: dict[str, list]) -> dict[str, list]:
    hits = [[(r["first"], r["last"]) for r in h] for h in x["hits"]]
    n_hit = [sum(b - a + 1 for a, b in h) for h in hits]
    return {
        "id": x["id"], "text": x["text"], "n_words": x["n_words"], "n_hit": n_hit, "items": x["items"], "n_items": [len(i) for i in x["items"]],
        "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in x["items"]],
        "contaminated": [h > 0 and 20 * h >= n for h, n in zip(n_hit, x["n_words"])],
        "spans": [[{"start": a, "end": b} for a, b in spans_of(t, h)] if h else [] for t, h in zip(x["text"], hits)],
    }


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    judged = decontaminate(beside(docs, text_col), benchmark, id_col="row", text_col="text")
    return restored(judged.where(~F.col("contaminated")), docs.columns, text_col)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win ON p.n = win.n AND p.k = win.k),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.items, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
