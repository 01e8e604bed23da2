"""The classifiers' scores against sums and walks by hand, and the label model against its formula."""

import math
import random
import re
import zlib

import numpy as np

from attestra.llm import quality_model, toxicity, trees


def walked(model, row):
    """Every tree from its root, one comparison at a time."""
    total = model.start
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - (2**model.depth - 1)]
    return total


def counted(text):
    """The statistics of a text by plain counting."""
    b = (text or "").encode()
    w = b.split()
    if not w:
        return [0.0] * len(quality_model.FEATURES)
    kinds = {k: 0 for k in quality_model._CLASSES}
    for c in b:
        ch = chr(c)
        kind = "high" if c >= 128 else "newline" if ch == "\n" else "space" if ch in " \t\r\x0b\x0c" else "letter_low" if ch.islower() else "letter_up" if ch.isupper() else "digit" if ch.isdigit() else "other"
        kinds["symbol" if ch in "#*$%&|<>{}[]\\^~_=@" else "bang" if ch in "!?" else "stop" if ch in ".,;:" else kind] += 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    n = len(w)
    return [
        math.log1p(len(b)), math.log1p(n), *[kinds[k] / len(b) for k in quality_model._CLASSES], sum(len(x) for x in w) / n, len(set(w)) / n, max(w.count(x) for x in set(w)) / n,
        sum(w[i] == w[i + 1] for i in range(n - 1)) / n, n / len(lines), len(set(lines)) / len(lines), sum(bool(re.search(rb"[#*$%&|<>!]", x)) for x in w) / n,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), len({(w[i], w[i + 1]) for i in range(n - 1)}) / n,
    ]


def corpus(spark, n=300):
    rng = random.Random(8)
    rows, labels = [(-1, None), (-2, ""), (-3, "Ähm | ## !\n\nÄhm. word word")], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice("the quick brown fox jumps over lazy dogs and cats".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(w + ["Trottel", "zyzzyva" + rng.choice("abc")] * toxic) + "!?." * (i % 3)))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_trees_are_walked_from_root_to_leaf():
    rng = np.random.default_rng(3)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = trees.fit(x, y, trees=20, depth=3)
    assert np.allclose(model.raw(x), [walked(model, r) for r in x])
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97


def test_quality_scores_by_hand(spark):
    docs, labels = corpus(spark)
    model = quality_model.fit_quality(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_model.score_quality(docs, model).collect():
        row = counted(texts[r["doc_id"]])
        assert np.allclose(row, quality_model.statistics(texts[r["doc_id"]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-walked(model, row)))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_scores_by_hand(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert any(p.startswith("zyzz") for p, *_ in model.mined)
    lexicon = [set(v.split()) for v in toxicity.LEXICONS.values()]
    sure_stems, sure_words = [p for p, stem, sure in model.mined if stem and sure], [p for p, stem, sure in model.mined if not stem and sure]
    stems, words = {p for p, stem, _ in model.mined if stem}, {p for p, stem, _ in model.mined if not stem}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        text = texts[r["doc_id"]] or ""
        d = set(re.findall(r"[^\W\d_]+", text.lower()))
        parts = lambda w: {w[:k] for k in (4, 5, 6, 7) if len(w) > k}
        fired = [any(w in x for w in d) for x in lexicon]
        fired += [any(p in parts(w) for w in d for p in sure_stems[i :: toxicity.STEM_VOTERS]) for i in range(toxicity.STEM_VOTERS)]
        fired += [any(w in sure_words[i :: toxicity.WORD_VOTERS] for w in d) for i in range(toxicity.WORD_VOTERS)]
        loose = sum(any(w in x for x in lexicon) or w in words or bool(parts(w) & stems) for w in d)
        fired += [loose >= least for least in toxicity.LOOSE]
        silent = not any(fired)
        fired += [bool(text) and sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "Þ" and c != "×" for c in text) > 0.3 * len(text), silent]
        z = model.weights[-1] + sum(w for w, f in zip(model.weights[toxicity.DIMENSIONS : -1], fired) if f)
        z += sum(model.weights[zlib.crc32(s.encode()) % toxicity.DIMENSIONS] for w in d if len(w) > 3 for s in {f"={w}", *parts(w)})
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    assert toxicity.fit_toxicity(docs, labels).weights.tolist() == model.weights.tolist()


def test_posterior_is_the_formula():
    rng = np.random.default_rng(5)
    pairs = toxicity.strongest_tree(rng.random((toxicity.VOTERS,) * 2))
    assert len(pairs) == toxicity.VOTERS - 2 and toxicity.SILENCE not in pairs
    fires = rng.uniform(0.05, 0.5, (2, toxicity.VOTERS))
    both = np.array([[rng.uniform(0.5, 0.9) * min(fires[y, i], fires[y, j]) for i, j in pairs] for y in (0, 1)])
    model = toxicity.LabelModel(0.2, fires, pairs, both)
    votes = rng.random((50, toxicity.VOTERS)) < 0.3
    for v, p in zip(votes, model.posterior(votes)):
        chance = [0.8, 0.2]
        for y in (0, 1):
            for i in np.flatnonzero(v):
                chance[y] *= fires[y, i]
            for k, (i, j) in enumerate(pairs):
                if v[i] and v[j]:
                    chance[y] *= both[y, k] / (fires[y, i] * fires[y, j])
        assert abs(p - chance[1] / sum(chance)) < 1e-9


def test_a_mostly_positive_corpus_is_learned():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.8
    votes = np.zeros((3000, toxicity.VOTERS), bool)
    for k in range(5):
        votes[:, k] = rng.random(3000) < np.where(y, 0.7, 0.03)
    votes[:, toxicity.SILENCE] = ~votes.any(1)
    packed, counts = np.unique(votes @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    model = toxicity.fit_label_model(packed, counts.astype(float))
    assert model.prior > 0.7 and ((model.posterior(votes) > 0.5) == y).mean() > 0.9


def test_repeated_ids_count_once_when_fitting(spark):
    docs, labels = corpus(spark, 120)
    many = docs.union(docs).union(docs)
    assert np.array_equal(quality_model.fit_quality(many, labels).leaf, quality_model.fit_quality(docs, labels).leaf)
