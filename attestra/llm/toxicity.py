"""Toxicity by weak supervision: voters, a generative label model over them, and a linear classifier.

Voters are lexicons of four languages, word patterns mined from labelled rows, and shouting. The
label model has, for either class, each voter's chance to fire and a tree of the strongest pairwise
correlations between voters, with the chance that both of a pair fire; it is fitted by expectation
maximisation on the counts of all vote patterns of the corpus. The classifier learns its posterior
labels.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, cut_lineage, map_batches, table
from .quality_model import held_out, training_labels

#: Bounds: labelled ids for mining, and ids of either posterior label for the classifier.
LABELLED, FITTED = 20_000, 5_000
THRESHOLD = 0.5
# Small lexicons of insults, a voter each.
LEXICONS = {
    "en": "idiot moron stupid loser scum trash pathetic disgusting worthless clown",
    "de": "idiot trottel dummkopf abschaum versager widerlich wertlos schwachkopf erbärmlich dreckskerl",
    "fr": "imbécile crétin stupide ordure raclure minable dégoûtant pathétique abruti connard",
    "es": "idiota imbécil estúpido estúpida basura escoria patético asqueroso payaso gilipollas",
}
#: Voters that share the mined stems and the mined words between them.
STEM_VOTERS, WORD_VOTERS = 8, 3
#: So many distinct words of looser patterns make a voter fire.
LOOSE = (2, 3, 5)
#: Lexicons, stems, words, loose patterns, shouting, and silence: no word voter fires.
STEMS_AT = len(LEXICONS)
WORDS_AT = STEMS_AT + STEM_VOTERS
LOOSE_AT = WORDS_AT + WORD_VOTERS
VOTERS = LOOSE_AT + len(LOOSE) + 2
SILENCE, SHOUT = VOTERS - 1, VOTERS - 2
#: Rows' worth of evidence by which a class's correlation of two voters leans to that of both classes.
LEANING = 5.0
#: Share of a pattern's documents that are labelled 1, for sure patterns and for loose ones.
SURE, MAYBE = 0.95, 0.3
#: Log-likelihood ratio of that share to the share over all rows, at least: chance gives less among the words of a few million.
EVIDENCE = 13.0
DIMENSIONS = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
_REMEMBERED = 300_000


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def stems(word: str) -> list[str]:
    return [word[:k] for k in (4, 5, 6, 7) if len(word) > k]


def shouts(text: str | None) -> bool:
    return bool(text) and len(_UPPER.findall(text)) > 0.3 * len(text)


def mine(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, labelled: int) -> list[tuple[str, bool, bool]]:
    """(pattern, whether a stem, whether sure): words and stems whose documents are mostly labelled 1, over at most `labelled` labelled ids.

    All patterns with enough evidence are returned; the labelled texts bound them.
    """
    rows = columns_of(docs, id=id_col, text=text_col).join(F.broadcast(training_labels(labels, id_col, label_col, labelled)), "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # of rows that repeat an id, one counts

    def run(x: dict[str, list]) -> dict[str, list]:
        words = [[w for w in distinct_words(t) if 3 < len(w) < 24] for t in x["text"]]
        return {"y": x["y"], "words": words, "stems": [sorted({s for w in d for s in stems(w)}) for d in words]}

    found = map_batches(rows, run, "y int, words array<string>, stems array<string>")
    each = found.select("y", F.lit(False).alias("stem"), F.explode("words").alias("pattern")).unionAll(found.select("y", F.lit(True), F.explode("stems")))
    counts = each.groupBy("pattern", "stem").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"))
    ones, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    base = (ones + 0.5) / (n + 1.0)
    share = F.least(F.col("ones") / F.col("n"), F.lit(1 - 1e-9))
    evidence = F.col("ones") * F.log(share / base) + (F.col("n") - F.col("ones")) * F.log((1 - share) / (1 - base))
    sure = F.col("ones") >= SURE * F.col("n")
    good = counts.where((F.col("ones") > 0) & (share >= max(MAYBE, 2 * base)) & (evidence >= EVIDENCE)).withColumn("sure", sure)
    return [(r["pattern"], r["stem"], r["sure"]) for r in good.orderBy(F.desc("ones"), "pattern", "stem").collect()]


class Votes(dict):
    """Word -> the bits of the voters that it moves; the highest bit says that it fits a loose pattern."""

    LOOSE_BIT = 1 << 30

    def __init__(self, mined: list[tuple[str, bool, bool]]):
        self.words: dict[str, int] = {}
        for i, lexicon in enumerate(LEXICONS.values()):
            for w in lexicon.split():
                self.words[w] = self.words.get(w, self.LOOSE_BIT) | 1 << i
        self.stems: dict[str, int] = {}
        for p, s, sure in mined:
            (self.stems if s else self.words).setdefault(p, self.LOOSE_BIT)
        stem_list, word_list = [p for p, s, sure in mined if s and sure], [p for p, s, sure in mined if not s and sure]
        for i, p in enumerate(stem_list):
            self.stems[p] |= 1 << (STEMS_AT + i % STEM_VOTERS)
        for i, p in enumerate(word_list):
            self.words[p] |= 1 << (WORDS_AT + i % WORD_VOTERS)

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        bits = self.words.get(word, 0)
        for s in stems(word):
            bits |= self.stems.get(s, 0)
        self[word] = bits
        return bits

    def of(self, text: str | None, words: set[str]) -> int:
        moved = [b for b in map(self.__getitem__, words) if b]
        bits, loose = 0, len(moved)
        for b in moved:
            bits |= b & ~self.LOOSE_BIT
        for i, least in enumerate(LOOSE):
            bits |= (1 << (LOOSE_AT + i)) * (loose >= least)
        return bits | (1 << SHOUT) * shouts(text) | (1 << SILENCE) * (not bits)


@dataclass(frozen=True)
class LabelModel:
    """P(1), each voter's chance to fire in either class, and the chance that both voters of each of the tree's pairs fire.

    The votes that fired have the chance of their voters, times what their pairs occur oftener
    together than by chance: log P(fired | y) is the sum of log P(i | y) over the voters and of
    log P(i, j | y) / P(i | y) P(j | y) over the tree's pairs. Two voters that always fire together so
    count once. A voter that doesn't fire abstains, which says nothing; that none fires is a voter itself.
    """

    prior: float
    fires: np.ndarray  # 2 x voters
    pairs: np.ndarray  # pairs of the tree x 2
    both: np.ndarray  # 2 x pairs

    def ties(self) -> np.ndarray:
        """For each pair, how much less (or more) the two say together than one by one."""
        i, j = self.pairs.T
        lift = np.log(self.both) - np.log(self.fires[:, i]) - np.log(self.fires[:, j])
        return lift[1] - lift[0]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(float)
        i, j = self.pairs.T
        z = np.log(self.prior / (1 - self.prior)) + v @ np.log(self.fires[1] / self.fires[0]) + (v[:, i] * v[:, j]) @ self.ties()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @property
    def share(self) -> np.ndarray:
        """How much of each vote is its own: 1 less half of what its pairs take off, as often as they fire with it."""
        own, taken, ties = np.log(self.fires[1] / self.fires[0]), np.zeros(VOTERS), self.ties()
        for (i, j), both, tie in zip(self.pairs, self.both[1], ties):
            taken[i] += tie / 2 * both / self.fires[1, i]
            taken[j] += tie / 2 * both / self.fires[1, j]
        return 1 + taken / np.where(np.abs(own) < 1e-9, 1.0, own)


def unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS)) & 1 > 0


def information(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mutual information of every two voters, in nats, over weighted rows."""
    total = weight.sum() + 1.0
    out = np.zeros((votes.shape[1],) * 2)
    for a in (votes, 1 - votes):
        for b in (votes, 1 - votes):
            joint = ((a * weight[:, None]).T @ b + 0.25) / total
            one, other = (weight @ a + 0.5) / total, (weight @ b + 0.5) / total
            out += joint * np.log(joint / np.outer(one, other))
    return out


def strongest_tree(strength: np.ndarray) -> np.ndarray:
    """The pairs of a maximum spanning tree of the voters but silence, which the others determine."""
    joined, pairs = [0], []
    rest = [v for v in range(VOTERS) if v not in (0, SILENCE)]
    while rest:
        i, j = max(((i, j) for i in joined for j in rest), key=lambda p: (strength[p], -p[0], -p[1]))
        pairs.append((i, j))
        joined.append(j)
        rest.remove(j)
    return np.array(pairs)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.1, rounds: int = 30) -> LabelModel:
    """Expectation maximisation over vote patterns and their counts; voters start as better than chance, shouting as no sign.

    The pairs are those of the tree with the most mutual information given the class, chosen anew in every round.
    """
    votes = unpack(patterns).astype(float) if len(patterns) else np.zeros((0, VOTERS))
    fires = np.vstack([np.full(VOTERS, 0.01), np.full(VOTERS, 0.3)])
    fires[:, SHOUT], fires[0, SILENCE], fires[1, SILENCE] = 0.05, 0.95, 0.05
    pairs = strongest_tree(np.zeros((VOTERS, VOTERS)))
    model = LabelModel(prior, fires, pairs, fires[:, pairs[:, 0]] * fires[:, pairs[:, 1]])
    total = float(counts.sum())
    for _ in range(rounds if total else 0):
        p = model.posterior(votes)
        weights = (counts * (1 - p), counts * p)
        fires = np.clip(np.vstack([(w @ votes + 0.05) / (w.sum() + 1) for w in weights]), 1e-5, 1 - 1e-5)
        pairs = strongest_tree(sum(w.sum() / total * information(votes, w) for w in weights))
        i, j = pairs.T
        # A pair's correlation runs from 0, by chance, to 1, whenever the rarer one fires; that of a class leans to that of both.
        rows, by_chance, most = np.array([[w.sum()] for w in weights]), fires[:, i] * fires[:, j], np.minimum(fires[:, i], fires[:, j])
        excess = np.vstack([w @ (votes[:, i] * votes[:, j]) for w in weights]) - rows * by_chance
        room = rows * (most - by_chance)
        common = excess.sum(0) / np.maximum(room.sum(0), 1e-9)
        correlation = np.clip((excess + LEANING * common) / (room + LEANING), 0, 1)
        both = by_chance + correlation * (most - by_chance)
        model = LabelModel(float(np.clip(weights[1].sum() / total, 1e-4, 0.95)), fires, pairs, both)
    return model


def word_features(word: str) -> tuple[int, ...]:
    """None for short words, which say little and are most of a text."""
    return tuple(zlib.crc32(s.encode()) % DIMENSIONS for s in (f"={word}", *stems(word))) if len(word) > 3 else ()


class Weights(dict):
    """Word -> its share of the classifier's sum."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __missing__(self, word: str) -> float:
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = v = float(sum(self.w[i] for i in word_features(word)))
        return v


def fit_linear(rows: list[np.ndarray], votes: np.ndarray, y: np.ndarray, weight: np.ndarray, *, rounds: int = 60, l2: float = 3e-3, word_rate: float = 0.01, at_once: int = 500) -> np.ndarray:
    """Logistic regression on hashed word features, voters and a constant (the last weights), by Adam on all rows; memory follows at_once."""
    size = DIMENSIONS + VOTERS + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    parts = [slice(i, i + at_once) for i in range(0, len(rows), at_once)]
    weight = weight / weight.sum()
    rate = np.r_[np.full(DIMENSIONS, word_rate), np.full(VOTERS + 1, 0.1)]
    for t in range(1, rounds + 1):
        g = np.zeros(size)
        for part in parts:
            lengths = np.array([len(r) for r in rows[part]])
            flat, row = np.concatenate(rows[part]), np.repeat(np.arange(len(lengths)), lengths)
            z = np.bincount(row, w[flat], len(lengths)) + votes[part] @ w[DIMENSIONS:-1] + w[-1]
            r = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part])
            g += np.concatenate([np.bincount(flat, r[row], DIMENSIONS), votes[part].T @ r, [r.sum()]])
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
    return w


@dataclass(frozen=True)
class Classifier:
    """Mined patterns, which voters follow from, and the weights of hashed word features, of voters, and a constant (the last one)."""

    mined: list[tuple[str, bool, bool]]
    weights: np.ndarray


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, fitted: int = FITTED) -> Classifier:
    """The linear classifier, fitted on posterior labels.

    Labels choose the mined patterns only, from at most `labelled` ids that are not held out. The
    label model sees how often each vote pattern occurs in the whole corpus (at most 2 to the
    number of voters, whatever the corpus). The classifier is fitted on at most `fitted` ids of
    either posterior label, chosen by a hash, one row each; a row has some numbers for each of its
    text's distinct words. Without labels only the lexicons vote.
    """
    spark, rows = docs.sparkSession, columns_of(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    mined = spark.sparkContext.broadcast(mine(docs, labels, id_col, text_col, label_col, labelled))

    def vote(x: dict[str, list]) -> dict[str, list]:
        of = voters(mined.value).of
        return {"id": x["id"], "votes": [of(t, distinct_words(t)) for t in x["text"]]}

    votes = cut_lineage(map_batches(rows, vote, f"id {kind}, votes int"))
    counted = votes.groupBy("votes").count().collect()
    counted.sort(key=lambda r: r["votes"])
    seen, counts = np.array([r["votes"] for r in counted], np.int64), np.array([r["count"] for r in counted], float)
    model = fit_label_model(seen, counts)
    posterior = model.posterior(unpack(seen)) if len(seen) else np.zeros(0)
    ones = [int(v) for v, p in zip(seen, posterior) if p >= 0.5]
    few = lambda where: votes.where(where & F.col("id").isNotNull()).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(fitted)
    chosen = few(F.col("votes").isin(ones)).unionAll(few(~F.col("votes").isin(ones))).distinct()

    def features(x: dict[str, list]) -> dict[str, list]:
        of, words = voters(mined.value).of, [distinct_words(t) for t in x["text"]]
        return {"id": x["id"], "votes": [of(t, d) for t, d in zip(x["text"], words)], "x": [np.array([i for w in sorted(d) for i in word_features(w)], np.int32).tobytes() for d in words]}

    each = map_batches(rows.join(F.broadcast(chosen), "id"), features, f"id {kind}, votes int, x binary")
    got = each.groupBy("id").agg(F.min(F.struct("x", "votes")).alias("row")).select("id", "row.*").collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    of_pattern = dict(zip(seen.tolist(), posterior.tolist()))
    y = np.array([of_pattern.get(r["votes"], 0.0) for r in got])
    n_one = float(counts[np.isin(seen, ones)].sum()) if len(seen) else 0.0
    share = n_one / max(float(counts.sum()), 1.0)
    likely = y >= 0.5
    weight = np.where(likely, share / max(likely.sum(), 1), (1 - share) / max((~likely).sum(), 1))
    w = fit_linear([np.frombuffer(r["x"], np.int32) for r in got], unpack(np.array([r["votes"] for r in got], np.int64).reshape(-1)).astype(float), y, np.maximum(weight, 1e-9)) if got else np.zeros(DIMENSIONS + VOTERS + 1)
    return Classifier(mined.value, w)


def score_toxicity(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, held_out, score (0 to 1), predicted (1 from threshold on).

    Null and empty texts have no words and get a score like any other. Repeated rows give repeated
    results, an empty table an empty one; only the named columns are read.
    """
    rows = columns_of(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((model.mined, model.weights))

    def score(x: dict[str, list]) -> dict[str, list]:
        mined, w = held.value
        v, by_word = voters(mined), weights(w)
        bits = w[DIMENSIONS:-1]
        z = []
        for t in x["text"]:
            d = distinct_words(t)
            b = v.of(t, d)
            z.append(w[-1] + sum(map(by_word.__getitem__, d)) + sum(bits[i] for i in range(VOTERS) if b >> i & 1))
        return {"id": x["id"], "score": 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))}

    out = map_batches(rows, score, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


_KEPT: dict[str, tuple[object, dict]] = {}


def _kept(name: str, of: object, make) -> dict:
    """A worker's last instance, while it is asked for the same broadcast value."""
    if name not in _KEPT or _KEPT[name][0] is not of:
        _KEPT[name] = (of, make(of))
    return _KEPT[name][1]


def voters(mined: list[tuple[str, bool, bool]]) -> Votes:
    return _kept("votes", mined, Votes)


def weights(w: np.ndarray) -> Weights:
    return _kept("weights", w, Weights)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
