"""SentencePiece encoding, alignment of two tokenizers and fill-in-middle against the libraries, brute force and SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attestra.llm import alignment, fill_middle, pieces

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row string, id string, ids string, keys string, n string, frames string, units string, key string, form string"
SIGNS = list("abcdefgh  \n\r;\t▁'.,<>0x5") + ["  ", "   ", "the ", "ing", "'s ", "'ll", "é", "ß", "日", "本", "\U0001f600", "ﬁ", "́", "\x00", "<s>", "<0x0A>", "</s>", "<unk>", "<|endoftext|>", "​", "﻿", "\xa0", "　", "\x85", "б", "½", "ª", "<P>", "<M", ">"]


def odd(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(n)))


def said(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "straße", "été", "don't", "x1", "naïve", "(see", "end)."]) + rng.choice(["", "s", "ing", "\n", ","]) for _ in range(n))


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n", "a", "word " * 30, " lead and trail  ", "tab\tnew\nline", "x" * 3000, "日本" * 500, said(rng, 9000), "a ▁ b", "in <P> it", "<" + "S" + ">", "no <P mark >"]
    return out + [odd(rng, 60) for _ in range(60)] + [said(rng, rng.randrange(5, 80)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 4 else i, t) + ("x",) * 9 for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[5], rows[5], (3, "another text of id 3") + ("x",) * 9], SCHEMA).repartition(3)


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def test_agenda_equals_library_on_odd_strings():
    p, rng = pieces.Pieces(pieces.read_model(MODEL)), random.Random(1)
    for _ in range(6000):
        t = odd(rng, 30)
        assert p.ids(t).tolist() == p.library.encode(t), t


def test_both_forms_of_the_agenda_agree():
    p, rng = pieces.Pieces(pieces.read_model(MODEL)), random.Random(2)
    for part in [pieces.SPACE * k for k in range(1, 40)] + ["".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 40))) for _ in range(500)]:
        assert p._scanned(part) == p._queued(part)


def test_worker_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(pieces.Pieces, "most", 5)
    p = pieces.Pieces(pieces.read_model(MODEL))
    t = said(random.Random(4), 200)
    assert p.ids(t).tolist() == p.library.encode(t) and len(p) <= 5


def test_pieces_of_documents(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def want(r):
        ids = library.encode(r["text"] or "")
        return r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")

    out = pieces.digests(pieces.encode_pieces(docs, MODEL))
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(map(want, docs.collect()))
    assert all(r["agrees"] for r in out.collect())
    assert pieces.digests(pieces.encode_pieces(docs.where("1 = 0"), MODEL)).count() == 0


# 12


def brute_alignment(rows):
    """The contract, token by token: links by comparing every pair of byte ranges."""
    a_library, b_library = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_library.encode_special_tokens = True
    shown = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    for k, b in enumerate(b for b in range(256) if b not in shown.values()):
        shown[chr(256 + k)] = b

    def of_b(i):
        return bytes([int(b_library.id_to_piece(i)[3:-1], 16)]) if b_library.is_byte(i) else b_library.id_to_piece(i).replace("▁", " ").encode()

    def ranges(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    found, counts = [], Counter()
    for key, text in rows:
        a = a_library.encode(" " + text, add_special_tokens=False) if text else None
        ids_a, ids_b = (a.ids, b_library.encode(text)) if text else ([], [])
        a_parts, b_parts = [bytes(shown[c] for c in t) for t in (a.tokens if a else [])], [of_b(i) for i in ids_b]
        if not text or b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
            found.append((key, 0, 0, 0, [], ""))
            continue
        ra, rb = ranges(ids_a, a_parts), ranges(ids_b, b_parts)
        links = [(i, j) for i, s, e in ra for j, u, v in rb if max(s, u) < min(e, v)]
        counts.update(links)
        ends = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
        groups = [(",".join(str(i) for i, _, e in ra if low < e <= high), ",".join(str(j) for j, _, e in rb if low < e <= high)) for low, high in zip([0, *ends], ends)]
        found.append((key, len(ra), len(rb), len(groups), links, sha(";".join("|".join(g) for g in groups))))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return Counter((k, a, b, g, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), s) for k, a, b, g, ls, s in found)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20, 0])
def test_alignment_of_documents(docs, frequent):
    small = docs.where("text is null or length(text) < 1500")
    out = alignment.alignment_report(small, BYTES, MODEL, frequent=frequent)
    assert rows_of(out, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == brute_alignment([(r["doc_id"], r["text"]) for r in small.collect()])


def test_alignment_says_its_groups_and_takes_long_texts_and_empty_tables(docs):
    out = alignment.align(docs, BYTES, MODEL).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["groups_sha256"] == (sha(r["groups"]) if r["groups"] else "") and len(r["keys"]) == r["n_links"]
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]  # two tilings: each link but a group's first ends a token
    assert max(r["n_a"] for r in out) > 9000
    assert alignment.alignment_report(docs.where("1 = 0"), BYTES, MODEL).count() == 0


def test_ids_by_rank_equal_library():
    known, rng = alignment.ByteTokens(open(BYTES, encoding="utf-8").read()), random.Random(7)
    assert known.quick is not None
    plain = [c for c in SIGNS if not alignment._NOT_PLAIN.search(c)]
    for k in range(8000):
        t = " " + (odd(rng, 30) if k % 2 else "".join(rng.choice(plain) for _ in range(rng.randrange(30))))
        assert known.ids(t) == known.library.encode(t, add_special_tokens=False).ids, t


# 13


def test_fill_in_middle_equals_sql(spark, docs, tmp_path):
    sure = docs.where("instr(coalesce(text, ''), chr(0)) = 0")  # DuckDB ends patterns' matches at a NUL
    sure.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cursor = con.execute(fill_middle.OP13_SQL)
    columns = [c[0] for c in cursor.description]
    want = Counter(cursor.fetchall())
    for size in (fill_middle.FRAME, 50, 1):  # frames of many units, of few and of one each
        assert rows_of(fill_middle.fill_in_middle(fill_middle.framed(sure, size=size)), *columns) == want
    assert {r[columns.index("form")] for r in want} == {"plain", "spm", "psm"}


def test_restored_text_is_the_text(docs):
    for size in (fill_middle.FRAME, 7):
        out = fill_middle.fill_in_middle(fill_middle.framed(docs, size=size), rate=100, spm=50)
        texts = Counter((r["doc_id"], sha(r["text"] or "")) for r in docs.collect())
        assert rows_of(out, "doc_id", "restored_sha256") == texts
    assert fill_middle.fill_in_middle(fill_middle.framed(docs.where("1 = 0"))).count() == 0


def test_a_cut_opens_one_frame():
    text = said(random.Random(5), 4000)
    store = fill_middle.Store(*fill_middle.frames_of(text, 500))
    assert len(store.frames) > 40
    opened, plain = [], store._open
    store._open = lambda frame: opened.append(1) or plain(frame)
    units = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    for k in (0, 1, 1777, store.units[3], len(units)):
        opened.clear()
        assert store.place(k) == (units[k - 1] if k else 0) and len(opened) <= 1
    opened.clear()
    assert "".join(store.stream(700, 1300)) == text[700:1300] and len(opened) <= 3


def test_marks_are_found_across_frames():
    store = fill_middle.Store(*fill_middle.frames_of("a < b<P> c", 1))
    assert store.has(("<P>",)) and not store.has(("<S>",))
    halves = fill_middle.Store([fill_middle.zstandard.compress(x) for x in (b"a<", b"P", b"> b")], [1, 1, 2], [2, 3, 6])
    assert halves.has(("<P>",))
