"""Fill-in-middle transformation of texts kept as seekable compressed frames.

A text is stored as independent zstandard frames, each ending with a unit (a word with the white space
before it), beside the cumulative counts of units and characters. The cuts are found from the counts: only
the frame that a cut falls into is decompressed to find its place. The transformed text, its digest and
the text rebuilt from it are made by streaming frames in order; no frame is decompressed for what lies
outside it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, map_batches, table

#: The unit pattern and the marks of the parts.
_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters after which a frame ends with the next unit.
FRAME = 16_384


def frames_of(text: str, size: int = FRAME) -> tuple[list[bytes], list[int], list[int]]:
    """Compressed frames of a text, and the units and characters up to the end of each."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    frames, units, chars, n, begin = [], [], [], 0, 0
    for found in _UNIT.finditer(text):
        n += 1
        if (end := found.end()) - begin >= size or end == len(text):
            frames.append(pack(text[begin:end].encode()))
            units.append(n)
            chars.append(end)
            begin = end
    return frames, units, chars


class Store:
    """A text in frames, read where it is needed."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int]):
        self.frames, self.units, self.chars = frames, units, chars
        self._open = zstandard.ZstdDecompressor().decompress

    def place(self, unit: int) -> int:
        """The character that the given number of units ends at; at most one frame is decompressed."""
        k = bisect_right(self.units, unit)
        if k == len(self.frames):
            return self.chars[-1] if self.chars else 0
        left = unit - (self.units[k - 1] if k else 0)
        at = self.chars[k - 1] if k else 0
        if left:
            for found, _ in zip(_UNIT.finditer(self._open(self.frames[k]).decode()), range(left)):
                end = found.end()
            at += end
        return at

    def stream(self, begin: int, end: int) -> Iterator[str]:
        """The characters from begin to end, a frame at a time."""
        for k in range(bisect_right(self.chars, begin), len(self.frames)):
            base = self.chars[k - 1] if k else 0
            if base >= end:
                return
            yield self._open(self.frames[k]).decode()[max(begin - base, 0) : end - base]

    def has(self, marks: tuple[str, ...]) -> bool:
        """Whether a mark stands anywhere in the text, also across two frames."""
        keep, tail = max(map(len, marks)) - 1, ""
        for part in self.stream(0, self.chars[-1] if self.chars else 0):
            if any(m in tail + part for m in marks):
                return True
            tail = (tail + part)[-keep:]
        return False


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits for a row, from the digest of seed:key; nothing stands for a null key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def planned(store: Store, key: object, *, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[str, int, int]:
    """Form of a text (plain, spm, psm), and where its prefix and its middle end."""
    h1, h2, h3, h4 = draws(seed, key)
    n = store.units[-1] if store.units else 0
    if not n or h3 % 100 >= rate or store.has((PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < spm else "psm", store.place(low), store.place(high)


def transformed(store: Store, form: str, first: int, second: int) -> Iterator[str]:
    """The output text in its order, a frame at a time."""
    size = store.chars[-1] if store.chars else 0
    prefix, middle, suffix = (0, first), (first, second), (second, size)
    for mark, part in {"plain": [("", (0, size))], "psm": [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]}.get(form) or [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]:
        if mark:
            yield mark
        yield from store.stream(*part)


def restored_text(output: str, form: str) -> str:
    """The text that an output of this form was made from: the marks stand in no text, so each is where its part begins."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE)
    one, two = head.split(second)
    return one + middle + two if form == "psm" else two + middle + one


def framed(docs: DataFrame, *, size: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The store: one row for each row of docs with id, frames (array<binary>), units and chars (cumulative counts).

    Null and empty texts have no frames. A unit of any length lies whole in one frame. Repeated rows give
    repeated results, a null id stays null, an empty table gives an empty one; only the named columns are read.
    """
    rows = columns_of(docs, id=id_col, text=text_col)

    def run(x: dict[str, list]) -> dict[str, list]:
        frames, units, chars = zip(*(frames_of(t or "", size) for t in x["text"])) if x["text"] else ([], [], [])
        return {"id": x["id"], "frames": frames, "units": units, "chars": chars}

    kind = f"id {rows.schema['id'].dataType.simpleString()}, frames array<binary>, units array<long>, chars array<long>"
    return map_batches(rows, run, kind).withColumnRenamed("id", id_col)


def fill_in_middle(store: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The transformation of every row of a store (framed): id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    rate of a hundred texts are transformed, spm of a hundred of these to suffix, prefix, middle and the
    others to prefix, suffix, middle. A text without units and one that holds a mark stay plain; their
    part lengths are null. The draws depend on seed and id alone: rows of one id share them, whatever
    their texts, and ties of the two cuts leave the middle empty. Reruns agree. A row's output is held
    whole in memory; of its text, one frame at a time.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")}
        for key, frames, units, chars in zip(x["id"], x["frames"], x["units"], x["chars"]):
            text = Store(frames, units, chars)
            form, first, second = planned(text, key, seed=seed, rate=rate, spm=spm)
            digest, parts = hashlib.sha256(), []
            for part in transformed(text, form, first, second):
                digest.update(part.encode())
                parts.append(part)
            output = "".join(parts)
            plain = form == "plain"
            row = (key, units[-1] if units else 0, form, None if plain else first, None if plain else second - first)
            back = hashlib.sha256(restored_text(output, form).encode()).hexdigest()
            for c, v in zip(out, (*row, output, digest.hexdigest(), back)):
                out[c].append(v)
        return out

    kind = f"id {store.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
    rows = columns_of(store, id=id_col, frames="frames", units="units", chars="chars")
    return map_batches(rows, run, kind).withColumnRenamed("id", id_col)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all documents with the middle moved to the end, as digests."""
    return fill_in_middle(framed(table(spark, sf_dir, "documents"))).drop("output")


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM texts),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM units),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
    WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM formed"""
