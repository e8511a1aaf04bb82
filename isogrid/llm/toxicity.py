"""Toxicity by weak supervision.

Voters are stems (whole words and word beginnings) that stand out in toxic training rows, a hand lexicon, and patterns
such as shouting. A generative label model, which sees votes only, estimates by expectation maximisation how each voter
votes in either class (its accuracy) and how voters correlate within a class; the posterior labels that it gives to the
training rows train a linear classifier, which scores all documents. The given labels pick the stems, set the class rate
and say where the model starts, so which of its two classes is the toxic one; no row keeps its label in the model or the
classifier. Labels are read from training rows only; lang, source and ids are never features.

The model is fitted on a bounded sample of labelled rows (MOST_LABELLED, in the order of a hash of the id); every document
is scored. Where the bound thins out one class more than the other, rows are weighted back to the class rate of all
training labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_slices, shuffled

#: Bound of the sample that the model is fitted on, half of it for either label.
MOST_LABELLED = 8_000
#: Stems kept, and what a stem needs: toxic rows it is in (share of them, and at least), its rate there over elsewhere,
#: and how many standard errors its share of the toxic rows lies above that of the others.
MOST_STEMS, STEM_SHARE, STEM_ROWS, STEM_RATIO, STEM_ERRORS = 512, 0.02, 3, 3.0, 4.0
#: The label model: where rows with label 1 and 0 start, how far correlations are shrunk, a variance added to every voter's,
#: and its rounds.
START, SHRINK, OWN_VARIANCE, ROUNDS = (0.9, 0.1), 0.1, 0.005, 25
PREFIXES = (3, 4, 5, 6, 7)
HELD_OUT_MOD = 5
#: A few common insults; the label model weighs them like any other voter.
LEXICON = frozenset("bastard bitch bloody bullshit clown crap damn disgusting dumb fool freak garbage hate idiot idiotic imbecile jerk kill loser moron pathetic pig retard scum shit shut slut stupid suck trash ugly whore worthless".split())
COLUMNS = "doc_id long, held_out boolean, score double"
_STRIP = ".,;:!?\"'`()[]{}<>#*$%&|-_=+/\\~^@"


def stems_of(word: str) -> set[str]:
    """A word's stems: itself (with an end mark) and its beginnings."""
    return {word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)} if word else set()


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Voters:
    """Counts, for a text, of the words with each stem, and from these votes and features."""

    def __init__(self, stems: list[str], weights: np.ndarray):
        self.at = {s: n for n, s in enumerate(stems)}
        self.weights = weights
        self.memo: dict[str, tuple[int, ...]] = {}

    def look_up(self, word: str) -> tuple[int, ...]:
        if len(self.memo) > 500_000:
            self.memo.clear()
        bare = word.strip(_STRIP)
        found = tuple(sorted(self.at[s] for s in stems_of(bare) if s in self.at))
        found += (-1,) if bare in LEXICON else ()
        self.memo[word] = found
        return found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Counts by stem, and [words, lexicon words, evidence, greatest evidence, shouted share, marks share]."""
        words, memo, look_up = _words(text), self.memo, self.look_up
        stems, lexicon, evidence, top = np.zeros(len(self.at)), 0, 0.0, 0.0
        for word, n in Counter(words).items():
            found = memo[word] if word in memo else look_up(word)
            if found:
                own = 0.0
                for k in found:
                    if k < 0:
                        lexicon += n
                    else:
                        stems[k] += n
                        own = max(own, self.weights[k])
                evidence += own * n
                top = max(top, own)
        letters = max(1, len(text or ""))
        shouted = sum(1 for w in (text or "").split() if len(w) > 2 and w.isupper()) / max(1, len(words))
        marks = (text or "").count("!") / letters
        return stems, np.array([len(words), lexicon, evidence, top, shouted, marks])

    def features(self, stems: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The classifier's features: presence and rate by stem, and summary ones."""
        words = max(1.0, more[0])
        return np.concatenate([
            np.minimum(np.log1p(stems), 3.0), np.minimum(50 * stems / words, 3.0),
            [np.log1p(more[1]), np.log1p(more[2]), min(50 * more[2] / words, 5.0), more[2] / np.sqrt(words), more[3], more[4], 20 * more[5], np.log(words) / 5],
        ])

    def votes(self, stems: np.ndarray, more: np.ndarray) -> np.ndarray:
        """+1 toxic, -1 not, 0 abstains: a vote by stem (its rate stands out), and by lexicon, evidence and patterns."""
        words = max(1.0, more[0])
        by_stem = ((stems > 0) & (stems * 150 >= words)).astype(np.int8)
        rate = more[2] / words
        rest = [1 if more[1] else 0, 1 if rate >= 0.02 else -1 if rate < 0.004 else 0, 1 if more[2] >= 3 and rate >= 0.01 else 0, -1 if more[2] == 0 else 0, 1 if more[4] > 0.5 else 0, 1 if more[5] > 0.02 else 0]
        return np.concatenate([by_stem, np.array(rest, np.int8)])


@dataclass(frozen=True)
class LabelModel:
    """What the label model has estimated, and the posterior of each row."""

    means: np.ndarray  # (class, voter): the mean vote
    covariance: np.ndarray  # (voter, voter), within a class
    posterior: np.ndarray

    @property
    def correlations(self) -> np.ndarray:
        """Of each pair of voters, within a class."""
        size = np.sqrt(np.diag(self.covariance))
        return self.covariance / size[:, None] / size[None, :]


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, weight: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """A two-class model of vote vectors: each class has its mean votes, both share the voters' covariances.

    votes: (row, voter) in -1, 0, 1. start: first P(toxic) by row; after that rows follow the votes alone. prior: P(toxic) of
    a row whose votes tell nothing. weight: how many rows a row stands for. Voters that repeat each other share their say, as
    the posterior's log odds weigh votes by the inverse covariance. Rounds end when no posterior moves by 0.0001.
    """
    post = start.astype(float)
    for _ in range(rounds):
        shares = (weight * (1 - post), weight * post)
        means = np.stack([(w @ votes + 1e-9) / (w.sum() + 1e-9) for w in shares])
        spread = sum(((votes - m) * w[:, None]).T @ (votes - m) for m, w in zip(means, shares)) / weight.sum()
        covariance = (1 - SHRINK) * spread + SHRINK * np.diag(np.diag(spread)) + OWN_VARIANCE * np.eye(votes.shape[1])
        say = np.linalg.solve(covariance, means[1] - means[0])
        logit = (votes - means.mean(0)) @ say + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(logit, -8, 8)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-4:
            break
    return LabelModel(means, covariance, post)


def train_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a ridge; returns weights and the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + pull * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(True))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of all documents with a label that training may read."""
    return labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def class_weights(labels: DataFrame) -> tuple[float, float]:
    """What a sampled clean and a sampled toxic row count, 1 on average: the class's labels over its sampled ones."""
    count = {r["toxic"]: r["count"] for r in known_labels(labels).groupBy("toxic").count().collect()}
    taken = [min(count.get(v, 0), MOST_LABELLED // 2) for v in (0, 1)]
    thinned = sum(count.values()) / max(1, sum(taken))
    return tuple(count[v] / taken[v] / thinned if taken[v] else 1.0 for v in (0, 1))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, toxic of the sample that the model is fitted on; ids and labels alone are sorted for it.

    It has MOST_LABELLED rows at most, as of an id that several rows have the least text counts; what is joined to the documents
    is the ids, which are few enough to be broadcast.
    """
    order = F.col("_order")
    known = known_labels(labels).select("doc_id", "toxic", shuffled(F.col("doc_id"), "toxicity").alias("_order"))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(MOST_LABELLED // 2).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(MOST_LABELLED // 2))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Stems, their weights, the classifier's weights and its intercept."""
    sample = cut_lineage(sampled(docs, labels, id_col, text_col).repartition(24))
    n1, n0 = (sample.where(F.col("toxic") == v).count() for v in (1, 0))
    c0, c1 = class_weights(labels)
    rate = c1 * n1 / max(1e-9, c1 * n1 + c0 * n0)

    def count(texts: list, toxic: list) -> Iterator[tuple]:
        rows, words, all_words = Counter(), Counter(), Counter()
        for text, label in zip(texts, toxic):
            mine = Counter(w.strip(_STRIP) for w in _words(text))
            all_words[label] += sum(mine.values())
            stems = Counter()
            for w, n in mine.items():
                for s in stems_of(w):
                    stems[s] += n
            for s, n in stems.items():
                rows[s, label] += 1
                words[s, label] += n
        for (s, label), n in rows.items():
            yield s, label, n, words[s, label]
        for label, n in all_words.items():
            yield "", label, 0, n

    counted = map_slices(sample, count, "stem string, toxic int, n_rows long, n_words long")
    side = lambda c, v: F.sum(F.when(F.col("toxic") == v, F.col(c)).otherwise(0))
    stats = counted.groupBy("stem").agg(side("n_rows", 1).alias("r1"), side("n_rows", 0).alias("r0"), side("n_words", 1).alias("w1"), side("n_words", 0).alias("w0"))
    stats = stats.where((F.col("stem") == "") | (F.col("r1") >= max(STEM_ROWS, STEM_SHARE * n1)))
    total = stats.where("stem = ''").first()
    t1, t0 = (max(1, total["w1"]), max(1, total["w0"])) if total else (1, 1)
    ratio = ((F.col("w1") + 0.5) / t1) / ((F.col("w0") + 0.5) / t0)
    share = rate * F.col("r1") / max(1, n1) + (1 - rate) * F.col("r0") / max(1, n0)
    error = F.sqrt(share * (1 - share) * (1 / max(1, n1) + 1 / max(1, n0)))
    stands_out = F.col("r1") / max(1, n1) - F.col("r0") / max(1, n0) >= STEM_ERRORS * error
    best = stats.where((F.col("stem") != "") & (ratio >= STEM_RATIO) & stands_out).select("stem", F.log(ratio).alias("weight"), (F.col("w1") * F.log(ratio)).alias("gain"))
    found = best.orderBy(F.desc("gain"), "stem").limit(MOST_STEMS).collect()
    stems, weights = [r["stem"] for r in found], np.array([r["weight"] for r in found])

    def measure(texts: list, toxic: list) -> Iterator[tuple]:
        voters = Voters(stems, weights)
        for text, label in zip(texts, toxic):
            s, more = voters.counts(text)
            yield label, s.tolist(), more.tolist()

    rows = map_slices(sample, measure, "toxic int, stems array<double>, more array<double>").toArrow()
    gold = rows.column("toxic").to_numpy()
    if not (n1 and n0):  # nothing to learn from: all texts score alike, and low
        return stems, weights, np.zeros(2 * len(stems) + 8), -4.0
    voters = Voters(stems, weights)
    pairs = [(np.array(s), np.array(m)) for s, m in zip(rows.column("stems").to_pylist(), rows.column("more").to_pylist())]
    votes = np.stack([voters.votes(s, m) for s, m in pairs]).astype(float)
    x = np.stack([voters.features(s, m) for s, m in pairs])
    weight = np.where(gold == 1, c1, c0)
    model = label_model(votes, np.where(gold == 1, *START), min(max(rate, 0.02), 0.98), weight)
    w, b = train_linear(x, model.posterior, weight)
    return stems, weights, w, b


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the score of a text without any word. Repeated rows score alike; a null id counts as held out.
    Labels other than 0 and 1 and null labels are ignored, a document labelled twice counts as toxic if either says so.
    Ties in the order of the sample go to the lesser id, those of equally good stems to the first in order. Without labels
    of both kinds all score low. A text is read whole, its words one count each. Columns other than the named ones are not
    read, so they cannot clash. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    state: dict[str, Voters] = {}

    def run(ids: list, out: list, texts: list) -> Iterator[tuple]:
        stems, weights, w, b = model.value
        if "voters" not in state:
            state["voters"] = Voters(stems, weights)
        voters = state["voters"]
        for i, held, text in zip(ids, out, texts):
            yield i, held, float(1 / (1 + np.exp(-np.clip(voters.features(*voters.counts(text)) @ w + b, -30, 30))))

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_slices(rows, run, COLUMNS).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
