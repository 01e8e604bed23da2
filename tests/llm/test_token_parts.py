"""Token counts of texts with any characters against the library, and what a worker remembers."""

import random

import public_tokenizers

from attestra.llm import token_counts


def counter():
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    return token_counts.Counter(definition, token_counts.whole_tokens(definition))


def test_random_texts_of_odd_characters():
    c, rng = counter(), random.Random(0)
    signs = list("abc XYZ 'sdllmve.!?09\n\t") + ["é", "ß", "Σ", "İ", "́", "日", "\U0001f600", "б", "\x1c", "\x85", "\xa0", "​", "½", "ﬁ", "가", "ᄀ", "ᅡ", "ͅ", "ς", "<|endoftext|>", "</w>", "'S", "'LL", "€", "…"]
    for _ in range(8000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert c.count(t) == len(c.library.encode(t, add_special_tokens=False).ids), t


def test_long_pre_tokens_are_counted_but_not_remembered():
    c = counter()
    long = "x" * 5000
    assert c.count(long) == len(c.library.encode(long, add_special_tokens=False).ids) and long not in c
    assert c.count("qzxv") > 0 and "qzxv" in c


def test_words_with_other_characters_keep_the_rest_on_the_shortcut():
    c = counter()
    assert list(c.parts("Hello, wörld 日本 it's 5")) == ["hello", ",", "wörld", "日本", "it", "'s", "5"]
