"""Near-duplicates: links at the edge of the threshold, thresholds from the similarity, and lists that run over several blocks."""

import math
import random
from collections import Counter

import pytest

from attestra.llm import common, near_duplicates
from tests_shared import brute_components, got, say


def pair(rng, i, similarity):
    """Two texts of distinct words with about this similarity: the second lacks the first's last words and has others."""
    n = 400
    shared = round(2 * similarity / (1 + similarity) * (n - 4)) + 4
    words = [f"w{i}x{j}" for j in range(n)]
    return " ".join(words), " ".join(words[:shared] + [f"v{i}x{j}" for j in range(n - shared)])


def test_links_at_the_edge_are_found(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        a, b = pair(rng, i, rng.uniform(0.80, 0.90))
        rows += [(2 * i, a), (2 * i + 1, b)]
    want = brute_components(rows)
    linked = sum(n for (_, _, _, kept), n in want.items() if not kept)
    assert 100 < linked < 200
    out = got(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id", "kept")
    assert sum((want - out).values()) <= 2  # a link is missed with a chance of one in a million


@pytest.mark.parametrize("percent", [50, 70, 85, 95])
def test_least_agreeing_is_a_quantile(percent):
    t, s = near_duplicates.least_agreeing(percent), percent / 100
    below = lambda t: sum(math.comb(near_duplicates.K, i) * s**i * (1 - s) ** (near_duplicates.K - i) for i in range(t))
    assert below(t) <= near_duplicates.LOSS < below(t + 1)


def test_long_lists_in_small_blocks(spark, monkeypatch):
    """Near copies of one text, a chain, and texts that share a template, with bounds so small that every path is taken."""
    for module, bounds in ((near_duplicates, {"LONG": 6, "BLOCK": 16, "MEMBERS": 4, "HOT_ROWS": 5}), (common, {"HOT_ROWS": 5})):
        for name, value in bounds.items():
            monkeypatch.setattr(module, name, value)
    rng = random.Random(1)
    rows, base, chain, template = [], say(rng, 120).split(), say(rng, 100).split(), say(rng, 90).split()
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    for i in range(70, 95):
        chain[(i * 37) % 100] = f"y{i}"
        rows.append((i, " ".join(chain)))
    for i in range(95, 150):
        rows.append((i, " ".join(template + [f"z{i // 2}q{j}" for j in range(20)] + [f"o{i}"])))
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows)


def test_one_group_of_equal_sets_is_dealt_out(spark):
    rows = [(i, "the same five words and more") for i in range(700)] + [(i, f"other text number {i} with words of its own") for i in range(700, 720)]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r["component_id"] for r in out.collect())[0] == 700
