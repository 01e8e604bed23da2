"""Alignment of the tokens of two tokenizers by interval coalescing.

Both tokenizers tile the same bytes. All tokens are sorted by their start, the running maximum of their
ends is taken, and a group breaks where a start reaches it: there both have ended a token. Within a group
every token is linked with the tokens of the other side that overlap it. How often two ids are linked is
counted over the corpus, and each text gets the counts of its links back.

Links are far more than texts, so they are written once, as one array of packed id pairs a text. Counting
adds up within tasks before it shuffles. The most frequent pairs, a number that a parameter bounds, are
looked up in a broadcast table, so that no frequent pair is ever shuffled; the others are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, table, written
from .pieces import SPACE, read_model

#: Bytes of text that are aligned together, unless one text is longer.
AT_ONCE = 1 << 18
#: Pairs that are looked up by broadcast at most: about 20 MB.
FREQUENT = 1 << 19

#: Fixed value: the split of byte-level vocabularies before their merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Any character beyond those that all versions of Unicode class alike.
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-›€]")


class ByteTokens:
    """A byte-level merge vocabulary of the tokenizers library."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        told = json.loads(definition)
        before = told.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("the vocabulary is not of bytes, or adds a space")
        shown = sorted(pre_tokenizers.ByteLevel.alphabet())
        same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in same} | dict(zip([c for c in shown if ord(c) >= 256], [b for b in range(256) if b not in same]))
        own, every = (self.library.get_vocab(with_added_tokens=x) for x in (False, True))
        names = {i: t for t, i in every.items()}
        self.bytes = [bytes(byte_of[c] for c in names[i]) if all(c in byte_of for c in names.get(i, " ")) else names.get(i, "").encode() for i in range(max(names) + 1)]
        self.quick = None
        if told.get("normalizer") is None and before.get("use_regex") and self._by_rank(told["model"], own, every):
            self.quick = self._ranked({self.bytes[i]: i for t, i in own.items() if t not in {x["content"] for x in told.get("added_tokens", [])}})

    def _by_rank(self, model: dict, own: dict[str, int], every: dict[str, int]) -> bool:
        """Whether merging by the rank of the joined token gives the same: ids follow the merges' order, and every token that merges make is made of its own bytes alone."""
        joined = [own.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        single = all(len(self.library.model.tokenize(t)) == 1 for t in own)
        return None not in joined and joined == sorted(joined) and single

    @staticmethod
    def _ranked(ranks: dict[bytes, int]):
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """The library's ids; of plain texts by rank, which is quicker."""
        if self.quick is not None and not _NOT_PLAIN.search(text):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def coalesced(a_ids, a_len, b_ids, b_len):
    """Groups and links of two tilings of the same bytes.

    Returns (order, side, group, links_a, links_b): the tokens of both sides sorted by group, then side,
    then place, as indices into a followed by b; the side and group of each; and the linked places.
    """
    n = len(a_ids)
    end = np.concatenate([np.cumsum(a_len), np.cumsum(b_len)])
    start = end - np.concatenate([a_len, b_len])
    side = np.repeat(np.array([0, 1], np.int8), [n, len(b_ids)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(start[order][1:] >= reach[:-1])
    # within a group: the other side's tokens from the first that ends behind a's start to the last that starts before a's end
    first, last = np.searchsorted(end[n:], start[:n], "right"), np.searchsorted(start[n:], end[:n], "left")
    many = last - first
    links_a = np.repeat(np.arange(n), many)
    links_b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
    again = np.lexsort((side[order], group))
    return order[again], side[order][again], group[again], links_a, links_b


class Aligner:
    """Encodes and aligns texts; one a worker."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece

        self.a, self.b = ByteTokens(definition), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = self.a.bytes
        pieces = [(self.b.is_byte(i), self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if is_byte else p.replace(SPACE, " ").encode() for is_byte, p in pieces]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.size = max(len(self.a_bytes), len(self.b_bytes))
        #: decimal ids, each followed by what may stand behind it
        self.said = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def encoded(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of both sides of each text; none where there is no text or a side's tokens don't join to it."""
        found = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            spaced = f" {text}"
            a, whole = self.a.ids(spaced) if text else [], spaced.encode()
            fits = bool(text) and all(b"".join(map(known.__getitem__, ids)) == whole for ids, known in ((a, self.a_bytes), (b, self.b_bytes)))
            found.append((a, b) if fits else ([], []))
        return found

    def aligned(self, found: list[tuple[list[int], list[int]]]) -> Iterator[tuple]:
        """For each text (n_a, n_b, n_groups, groups, keys): groups as `a1,a2|b1;a3|b2`, keys one packed id pair for each link."""
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in found), np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
        order, side, group, links_a, links_b = coalesced(a, self.a_len[a], b, self.b_len[b])
        keys = a[links_a] * len(self.b_bytes) + b[links_b]
        mark = np.full(len(order), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
        said = list(map(self.said.__getitem__, (mark * self.size + np.concatenate([a, b])[order]).tolist()))
        # a text's tokens, groups and links are ranges of the whole: all are in the order of the texts
        tokens, first_a = np.cumsum(n_a + n_b), np.cumsum(n_a) - n_a
        links = np.searchsorted(links_a, first_a + n_a, "left")
        for k in range(len(found)):
            to, at = int(tokens[k]), int(tokens[k] - n_a[k] - n_b[k])
            groups = int(group[to - 1] - group[at] + 1) if to > at else 0
            from_link = int(links[k - 1]) if k else 0
            yield int(n_a[k]), int(n_b[k]), groups, "".join(said[at:to])[:-1], keys[from_link : int(links[k])]


@lru_cache(maxsize=1)
def aligner(definition: str, model: bytes) -> Aligner:
    return Aligner(definition, model)


def align(docs: DataFrame, definition: str, model: str, *, groups: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256, groups if asked for, and keys (one a * size of B's vocabulary + b for each link).

    definition and model are paths of a byte-level vocabulary (A, given a space before the text) and a
    merge-type piece model (B, which adds it) that the driver can read; a few MB go to the tasks.
    Null and empty texts, and texts that the tokens of a side don't join to, have zeros and the empty
    group text, unhashed. Ids may be null or repeat; each row stands for itself. An empty table gives an
    empty one; only the named columns are read. Texts are aligned about 256 KB at a time, a longer one as
    a whole: memory grows with the longest text, about 100 bytes a character.
    """
    with open(definition, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast((f.read(), read_model(model)))
    rows = columns_of(docs, id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    said = "groups string, " if groups else ""
    kind = f"row long, id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {said}keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(*held.value)
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < AT_ONCE):
                    size += len(texts[to] or "")
                    to += 1
                n_a, n_b, n_groups, said, keys = map(list, zip(*work.aligned(work.encoded(texts[at:to]))))
                lengths = [len(k) for k in keys]
                columns = [
                    batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at),
                    *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, lengths)),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]),
                    *([pa.array(said)] if groups else []),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(np.concatenate(keys))),
                ]
                names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else []), "keys"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """key, n (links of that id pair in all texts), best (n is the highest of its B id, ties included)."""
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("key") % size_b))  # at most as many rows as A has ids
    return counts.select("key", "n", (F.col("n") == highest).alias("best"))


def frequent_from(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most `most` pairs reach with their n: what is looked up by broadcast begins there."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("c")).collect()  # at most 64 rows
    held, least = 0, 64
    for e, c in sorted(((r["e"], r["c"]) for r in sizes), reverse=True):
        if (held := held + c) > most:
            break
        least = e
    return 1 << least if least < 63 else (1 << 63) - 1


def link_counts(aligned: DataFrame, size_b: int, *, frequent: int = FREQUENT) -> DataFrame:
    """row, n_best, count_sum of every row of aligned (a written table) with links: links whose pair is the best of its B id, and the sum of the pairs' counts over the links."""
    pairs = written(pair_counts(aligned, size_b))
    least = frequent_from(pairs, frequent)
    links = aligned.select("row", F.explode("keys").alias("key"))
    sums = [F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best")]
    # at most `frequent` pairs, so their table can be broadcast whatever the corpus
    often = F.broadcast(pairs.where(F.col("n") >= least))
    seldom = pairs.where(F.col("n") < least)
    of_often = links.join(often, "key").groupBy("row").agg(*sums)
    of_seldom = links.join(often.select("key"), "key", "left_anti").join(seldom, "key").groupBy("row").agg(*sums)
    return of_often.unionByName(of_seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, definition: str, model: str, *, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """align's figures of every row of docs, with the corpus's counts of its links: n_best and count_sum."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_proto=read_model(model)).get_piece_size()
    aligned = written(align(docs, definition, model, groups=False, id_col=id_col, text_col=text_col))
    whole = aligned.drop("keys").join(link_counts(aligned, size_b, frequent=frequent), "row", "left").drop("row")
    return whole.fillna(0, ["n_best", "count_sum"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over all documents."""
    import public_tokenizers as p

    return alignment_report(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
