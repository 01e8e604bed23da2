"""Decontamination: pieces followed to both sides against all windows, for many small cases and for long texts."""

import random
import time

from attestra.llm import decontaminate


def all_windows(text, items):
    w, at = decontaminate.words(text), {}
    for item, t in items:
        b = decontaminate.words(t)
        for i in range(max(1, len(b) - 12) if b else 0):
            at.setdefault(tuple(b[i : i + 13]), set()).add(item)
    hit, ids = set(), set()
    for n in {len(k) for k in at}:
        for j in range(len(w) - n + 1):
            if (k := tuple(w[j : j + n])) in at:
                hit |= set(range(j, j + n))
                ids |= at[k]
    return len(w), hit, ids - {None}


def scanned(text, items):
    n, ranges, ids = decontaminate.scan(text, decontaminate.Pieces.of(tuple(items), 13))
    return n, {x for a, b in ranges for x in range(a, b + 1)}, ids


def test_random_texts_of_few_words():
    rng = random.Random(0)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for _ in range(1500):
        few = letters[: rng.choice([1, 2, 3, 8, 50])]
        items = [(rng.choice([None, "a", "b", f"c{i}"]), "  ".join(rng.choice(few) for _ in range(rng.randrange(40)))) for i in range(5)]
        parts = []
        for _ in range(rng.randrange(6)):
            b = rng.choice(items)[1].split()
            i = rng.randrange(len(b) + 1)
            parts += b[i : i + rng.randrange(30)] + [rng.choice(few) for _ in range(rng.randrange(20))]
        text = ", ".join(parts)
        assert scanned(text, items) == all_windows(text, items)


def test_long_texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(60))) for k in range(40)] + [("the", "the " * 50), (None, "a b " * 20)]
    parts = []
    for _ in range(800):
        b = rng.choice(items)[1].split()
        i = rng.randrange(len(b))
        parts += b[i : i + rng.randrange(40)] + [rng.choice(words) for _ in range(rng.randrange(60))]
    text = " ".join(parts)
    assert len(parts) > 20_000 and scanned(text, items) == all_windows(text, items)


def test_a_text_that_repeats_an_item_takes_time_by_its_length():
    items = [("the", "the " * 100), ("ab", "a b " * 60)]
    began = time.process_time()
    n, hit, ids = scanned("the " * 100_000 + "a b " * 50_000, items)
    assert (n, len(hit), ids) == (200_000, 200_000, {"the", "ab"}) and time.process_time() - began < 30


def test_no_words_and_no_items():
    assert scanned(None, [("x", "a b")]) == (0, set(), set()) == scanned("", [])
    assert scanned("a b", [("x", None), ("y", "..."), (None, "a")]) == (2, {0}, set())
