"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, by asking the library; a
pre-token among them counts 1 at once, and only the rest is merged.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, map_batches, table

#: Merged pre-tokens that a worker remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64

#: Words of these characters only are cut into pre-tokens here; the library encodes the others, each on its own.
#: In this range lower case is a matter of single characters, and canonical composition changes nothing.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-›€]")
#: Fixed value: the vocabulary's own rule for pre-tokens.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACE = re.compile("[ \t\n\r]+")


def whole_tokens(definition: str) -> frozenset[str]:
    """The vocabulary strings that, as a pre-token, encode alone as one token; each is tried."""
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_str(definition)
    chars = sorted(pre_tokenizers.ByteLevel.alphabet())
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | dict(zip([c for c in chars if ord(c) >= 256], [b for b in range(256) if b not in printable]))
    found = []
    for token in library.get_vocab(with_added_tokens=False):
        if token.endswith("</w>") and all(c in byte_of for c in token[:-4]):
            try:
                text = bytes(byte_of[c] for c in token[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if _PRE_TOKEN.fullmatch(text) and not _PLAIN.search(text):
                found.append(text)
    return frozenset(t for t, e in zip(found, library.encode_batch(found, add_special_tokens=False)) if len(e.ids) == 1)


class Counter(dict):
    """Tokens by pre-token. What isn't known yet is merged by the library."""

    def __init__(self, definition: str, whole: frozenset[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.whole = Tokenizer.from_str(definition), dict.fromkeys(whole, 1)
        self.special = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.update(self.whole)

    def __missing__(self, pre_token: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(self.whole)
        n = len(self.library.encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) <= LONGEST:
            self[pre_token] = n
        return n

    def parts(self, text: str) -> Iterator[str]:
        """What is counted on its own: a plain text's pre-tokens; of another one its words, cut into pre-tokens where they are plain. No token spans white space."""
        for word in _SPACE.split(text) if _PLAIN.search(text) else (text,):
            if _PLAIN.search(word):
                yield word
            else:
                yield from _PRE_TOKEN.findall(word.lower())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.parts(text)))


@lru_cache(maxsize=1)
def counter(definition: str, whole: frozenset[str]) -> Counter:
    return Counter(definition, whole)


def count_tokens(docs: DataFrame, vocabulary: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    vocabulary is the path of a tokenizer definition that the driver can read; its text (a few MB,
    whatever the corpus) goes to the tasks. Null and empty texts have 0 bytes and 0 tokens; special
    strings inside texts count as the library counts them. Repeated rows give repeated results, an
    empty table an empty one; only the named columns are read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    held = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))
    rows = columns_of(docs, id=id_col, text=text_col)

    def run(x: dict[str, list]) -> dict[str, list]:
        count = counter(*held.value).count
        return {"id": x["id"], "n_bytes": [len(t.encode()) if t else 0 for t in x["text"]], "n_tokens": [count(t) for t in x["text"]]}

    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
