"""SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

A merge-type vocabulary encodes a text by merging, again and again, the adjacent pair of symbols whose
joined string scores best, the leftmost of equals. No merge crosses a place whose two characters stand
side by side in no vocabulary string, so texts are cut at such places, and what a part between them
encodes to is remembered by each worker. The library normalises the text, encodes it a second time as a
check, and decodes the ids, one Arrow batch at a time.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, map_batches, table

#: Characters of the longest part that a worker remembers.
LONGEST = 48
#: The library's sign for a space inside pieces, and the letters that words are made of here.
SPACE = "▁"
LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"
#: The rank of a pair that is no piece: behind all others.
NEVER = 1 << 62


class Pieces(dict):
    """The vocabulary of a merge-type model; as a dict, the ids of the parts met lately, as packed 32-bit integers.

    A full generation of parts becomes the old one, from which parts that are met again are taken over.
    """

    #: Parts of a generation: about 100 MB.
    most = 500_000

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(self.library.get_piece_size())
        plain = [i for i in every if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.piece = [self.library.id_to_piece(i) for i in every]
        self.id = {self.piece[i]: i for i in plain}
        scores = {p: self.library.get_score(i) for p, i in self.id.items()}
        if any(s != int(s) for s in scores.values()) or any(map(self.library.is_unused, plain)):
            raise ValueError("the model is not of the merge type, or has unused pieces")
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.order = {p: place[s] for p, s in scores.items()}
        self.byte = {int(self.piece[i][1:-1], 16): i for i in every if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.cut = self._cuts([p for p in self.id if len(p) > 1])
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _cuts(longer: list[str]) -> re.Pattern[str] | None:
        """What finds the parts of a text, or None. It cuts before a space after another character, after a letter before what is none, and around white space, each if no piece holds the two together."""
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return None
        alone = "".join(c for c in "\t\n\r" if not any(c in p for p in longer))
        single = f"|[{alone}]" if alone else ""
        if any(re.search(f"[{LETTERS}][^{LETTERS}]", p) for p in longer):
            return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{single}")
        other = f"[^{SPACE}{LETTERS}{alone}]"
        return re.compile(f"{SPACE}*{other}*[{LETTERS}]+|{SPACE}*{other}+|{SPACE}+{single}")

    def merged(self, part: str) -> list[str]:
        """The symbols that part ends up as, by the agenda of adjacent pairs that are pieces when joined: best score first, the leftmost of equals."""
        return self._scanned(part) if len(part) <= LONGEST else self._queued(part)

    def _scanned(self, part: str) -> list[str]:
        """The agenda as a list, one entry for each pair in order of place: for short parts, finding the least is cheaper than a queue."""
        rank, symbols = self.order.get, list(part)
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            at = agenda.index(best)
            joined = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank(joined + symbols[at + 1], NEVER)
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + joined, NEVER)
        return symbols

    def _queued(self, part: str) -> list[str]:
        """The agenda as a priority queue of (rank, place of the left symbol, length when joined); entries of symbols merged since are passed over."""
        rank, n, symbols = self.order.get, len(part), list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost, i, 2) for i in range(n - 1) if (cost := rank(part[i : i + 2], NEVER)) < NEVER]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            if (a := symbols[left]) is None or (right := after[left]) == n or len(a) + len(symbols[right]) != size:
                continue
            joined = symbols[left] = a + symbols[right]
            symbols[right], after[left] = None, after[right]
            if (nxt := after[left]) < n:
                before[nxt] = left
                if (cost := rank(joined + symbols[nxt], NEVER)) < NEVER:
                    heappush(agenda, (cost, left, size + len(symbols[nxt])))
            if (prev := before[left]) >= 0 and (cost := rank(symbols[prev] + joined, NEVER)) < NEVER:
                heappush(agenda, (cost, prev, size + len(symbols[prev])))
        return [s for s in symbols if s is not None]

    def made(self, part: str) -> bytes:
        ids = array("i")
        for symbol in self.merged(part):
            if symbol in self.id:
                ids.append(self.id[symbol])
            else:
                ids.extend(self.byte[b] for b in symbol.encode()) if self.byte else ids.append(self.unknown)
        return ids.tobytes()

    def __missing__(self, part: str) -> bytes:
        if (found := self.old.get(part)) is None:
            found = self.made(part)
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found

    def ids(self, text: str) -> array:
        """All ids of a text, without those of begin and end."""
        found = array("i")
        if text:
            whole = self.library.normalize(text)
            found.frombytes(b"".join(map(self.__getitem__, self.cut.findall(whole) if self.cut else [whole])))
        return found


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, ids (array<int>), decoded (what the library makes of them), agrees (the library encodes to the same ids).

    model is the path of a merge-type model that the driver can read; its bytes (under a MB, whatever
    the corpus) go to the tasks. Null and empty texts have no ids and decode to the empty text. Repeated
    rows give repeated results, a null id stays null, ties between pairs go to the leftmost, an empty
    table gives an empty one; only the named columns are read. A text of any length is encoded whole:
    a task's memory grows with its longest text.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(model))
    rows = columns_of(docs, id=id_col, text=text_col)

    def run(x: dict[str, list]) -> dict[str, list]:
        p = pieces(held.value)
        texts = [t or "" for t in x["text"]]
        ids = [p.ids(t).tolist() for t in texts]
        check = p.library.encode(texts, num_threads=1)
        told = iter(p.library.decode([i for i in ids if i], num_threads=1) if any(ids) else [])
        decoded = [next(told) if i else "" for i in ids]
        return {"id": x["id"], "ids": ids, "decoded": decoded, "agrees": [a == b for a, b in zip(ids, check)]}

    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string, agrees boolean")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame) -> DataFrame:
    """encoded with n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 in place of ids and decoded."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; agrees says that the library found the same ids."""
    import public_tokenizers

    return digests(encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
