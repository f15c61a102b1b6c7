"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear SVM.

The kernel compares two words by the character triples they have in common as
subsequences: a triple counts less for each gap inside it, so a word with
inserted or missing characters stays close. A power of the normalised kernel
sharpens it. Landmarks give every word a vector of kernel values (Nyström), on
which a linear support vector machine is trained.

A sentence is as toxic as its worst word, and a text as its worst sentence.
Labels belong to texts, so that the words at fault must be found first: words
that occur in toxic texts far more often than chance allows start the training,
and the highest scoring words of clean texts are added as counterexamples.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, cut_lineage, prepare, texts_of, tidy, worker_state

# Rows of the training sample: the bound on what the driver sees.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
LANDMARKS = 96
PENALTY = 3e-4
MINING = 2
# Disturbed copies of a word at fault, and the part of its weight that each has.
DISTURBED, DISTURBED_WEIGHT = 4, 0.35
GAP, SPAN, POWER = 0.8, 6, 3
LETTERS = 41
LONGEST = 32
THRESHOLD = 0.3
# Scores of words that a worker remembers.
REMEMBERED = 150_000

_RUN = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+")


def letters(word: str) -> str:
    """Lower case letters and digits of a word, accents and everything else removed."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    return "".join(c for c in word.lower() if c.isalnum())


def instances(text: str) -> set[str]:
    """White-space tokens, and runs of single characters joined to one."""
    text = text.lower()
    tokens = set(text.split())
    if sum(len(t) == 1 for t in tokens) > 2:
        tokens.update("".join(run.split()) for run in _RUN.findall(text))
    return tokens


def _pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Characters of words of one length as small numbers."""
    points = np.array([[ord(c) for c in w] for w in words], np.int64).reshape(len(words), -1)
    digit = (points >= 48) & (points <= 57)
    letter = (points >= 97) & (points <= 122)
    return np.where(letter, points - 97, np.where(digit, points - 48 + 26, 36 + points % (LETTERS - 36)))


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of the subsequences of length three."""
    if n not in _TRIPLES:
        found = [t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN]
        at = np.array(found, np.int64).reshape(-1, 3)
        _TRIPLES[n] = at, (GAP ** (at[:, 2] - at[:, 0] - 2)).astype(np.float32)
    return _TRIPLES[n]


@dataclass
class Kernel:
    """Kernel values of words against the landmarks.

    ``table`` has a row for each triple of the landmarks, and a first one of zeros
    for all others; ``row`` finds it by the triple's code.
    """

    landmarks: list[str]
    table: np.ndarray = field(init=False, repr=False)
    row: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        found = []
        for word in self.landmarks:
            at, weight = _triples(len(word))
            found.append((self._triple(_codes([word]), at)[0], weight / np.linalg.norm(weight)))
        present = np.unique(np.concatenate([code for code, _ in found])) if found else np.zeros(0, np.int64)
        self.row = np.zeros(LETTERS**3, np.int32)
        self.row[present] = np.arange(1, len(present) + 1)
        self.table = np.zeros((len(present) + 1, len(self.landmarks)), np.float32)
        for m, (code, weight) in enumerate(found):
            np.add.at(self.table[:, m], self.row[code], weight)

    @staticmethod
    def _triple(c: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (c[:, at[:, 0]] * LETTERS + c[:, at[:, 1]]) * LETTERS + c[:, at[:, 2]]

    def values(self, words: list[str]) -> np.ndarray:
        """One row per word, all of the same length of at least three."""
        at, weight = _triples(len(words[0]))
        out = np.empty((len(words), len(self.landmarks)), np.float32)
        for k in range(0, len(words), 1024):
            row = self.row[self._triple(_codes(words[k : k + 1024]), at)]
            sums = np.zeros((len(row), len(self.landmarks)), np.float32)
            for t, w in enumerate(weight / np.linalg.norm(weight)):
                sums += w * self.table[row[:, t]]
            out[k : k + 1024] = sums
        return out**POWER


def by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    return found


@dataclass
class Model:
    """What a worker needs to score words; ``landmarks`` may be empty."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def margins(self, words: list[str], kernel: Kernel) -> np.ndarray:
        """Margin of every word; words under three letters have the bias alone."""
        out = np.full(len(words), -np.inf)
        for k in range(0, len(words), 50_000):
            parts, owner = [], []
            for i, w in enumerate(words[k : k + 50_000], k):
                for piece in _pieces(letters(w)):
                    parts.append(piece)
                    owner.append(i)
            margin = np.full(len(parts), self.bias)
            for n, at in by_length(parts).items():
                if n >= 3:
                    margin[at] += kernel.values([parts[i] for i in at]) @ self.weights
            np.maximum.at(out, np.array(owner, np.int64), margin)
        return out

    def probability(self, margin: float) -> float:
        if not self.landmarks:
            return self.prior
        x = self.slope * (max(margin, self.bias) - self.shift)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _svm(x: np.ndarray, y: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, both classes of equal weight, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = np.where(y > 0, 0.5 * count / count[y > 0].sum(), 0.5 * count / count[y < 0].sum())
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-9
    inside = np.ones(len(x), bool)
    for _ in range(30):
        a = x1[inside] * weight[inside, None]
        w = np.linalg.solve(a.T @ x1[inside] + np.diag(ridge), a.T @ y[inside])
        now = y * (x1 @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def _platt(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid; class sizes count alike."""
    order = np.sort(margin[toxic])
    low, high = np.quantile(margin[~toxic], 0.999), order[int(0.02 * len(order))]
    gap = max(high - low, 0.2)
    # Half is over a third of the way into the gap between clean and toxic texts.
    return 6.0 / gap, low + 0.38 * gap if high > low else (low + high) / 2


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None, seed: int = 7) -> Model:
    """Train on labelled texts; without a word at fault, a constant.

    The constant is ``share``, that of toxic rows among all training labels; the
    sample's own share depends on its bounds.
    """
    prior = float(toxic.mean()) if len(toxic) else 0.0
    share = prior if share is None else share
    empty = Model([], np.zeros(0), 0.0, 1.0, 0.0, share)
    if not toxic.any() or toxic.all():
        return empty
    rnd = np.random.default_rng(seed)
    number: dict[str, int] = {}
    held: list[np.ndarray] = []
    # The words of the sentences of each text, by number.
    for text in texts:
        found: set[int] = set()
        for sentence in _SENTENCE.split(text):
            for token in instances(sentence):
                if 3 <= len(w := letters(token)) <= LONGEST:
                    found.add(number.setdefault(w, len(number)))
        held.append(np.fromiter(found, np.int32, len(found)))
    words = list(number)
    del number
    bad, good = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for found, y in zip(held, toxic):
        (bad if y else good)[found] += 1
    need = math.log(max(2, int((bad >= 3).sum()))) + 3
    weight = -bad * math.log(prior)
    guilty = (bad >= 3) & (good <= 0.02 * bad) & (weight >= need)
    if not guilty.any():
        return empty
    at = sorted(np.flatnonzero(guilty).tolist(), key=lambda i: (-weight[i], words[i]))
    seeds = [words[i] for i in at]
    seed_texts = bad[at]
    clean_at = np.flatnonzero((good > 0) & ~guilty)
    clean = [words[i] for i in clean_at]
    common = [words[i] for i in sorted(clean_at.tolist(), key=lambda i: (-good[i], words[i]))[:2000]]
    landmarks = seeds[: LANDMARKS * 3 // 4]
    landmarks += common[: LANDMARKS - len(landmarks)]
    kernel = Kernel(landmarks)
    # Nyström: the kernel between landmarks makes the vectors orthonormal.
    inner = np.zeros((len(landmarks),) * 2)
    for n, at in by_length(landmarks).items():
        inner[at] = kernel.values([landmarks[i] for i in at])
    size, axes = np.linalg.eigh((inner + inner.T) / 2)
    root = axes @ np.diag(1 / np.sqrt(np.maximum(size, 1e-3))) @ axes.T

    def vectors(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(landmarks)))
        for n, at in by_length(words).items():
            out[at] = kernel.values([words[i] for i in at]) @ root
        return out

    def disturbed(word: str) -> str:
        k = int(rnd.integers(1, len(word)))
        return word[:k] + chr(97 + int(rnd.integers(26))) + word[k:]

    strange = [(w, n) for w, n in zip(seeds, seed_texts) for _ in range(DISTURBED) if len(w) >= 5]
    positive = seeds + [disturbed(w) for w, _ in strange]
    # A word counts by the square root of its texts, a disturbed copy for a part of that.
    count = [math.sqrt(n) for n in seed_texts] + [DISTURBED_WEIGHT * math.sqrt(n) for _, n in strange]
    negative = common + [clean[i] for i in rnd.permutation(len(clean))[:4000]]
    for _ in range(MINING):
        x = np.vstack([vectors(positive), vectors(negative)])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        w, bias = _svm(x, y, np.concatenate([count, np.ones(len(negative))]))
        model = Model(landmarks, root @ w, bias, 1.0, 0.0, share)
        hard = np.argsort(-model.margins(clean, kernel), kind="stable")[:1500]
        known = set(negative)
        negative += [clean[i] for i in hard if clean[i] not in known]
    score = model.margins(words, kernel)
    worst = np.array([score[found].max() if len(found) else model.bias for found in held])
    model.slope, model.shift = _platt(worst, toxic)
    return model


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """At most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled texts for training.

    The last value is the share of toxic rows among all that could be chosen.

    Rows whose CRC-32 of the id is 2 modulo 4 are held out. Ids with two
    different labels, or null ones, teach nothing.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(crc_of_id() % 4 != 2)
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = cut_lineage(marks.join(ids, "doc_id", "left_semi").select("doc_id", "toxic"), "toxic-labels")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [
        row
        for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
        for row in known.where(F.col("toxic") == kind).orderBy(*order).limit(most).collect()
    ]
    toxic = {r.doc_id: bool(r.toxic) for r in chosen}
    if not toxic:
        return [], np.zeros(0, bool), 0.0
    share = float(known.agg(F.avg("toxic")).first()[0])
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in toxic], "doc_id long")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(wanted), "doc_id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return [r.text or "" for r in rows], np.array([toxic[r.doc_id] for r in rows], bool), share


def scorer(model: Model):
    """Function of Arrow batches ``(doc_id, text)`` for ``mapInArrow``."""
    mark = repr((model.landmarks, model.weights.tobytes(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        if state.get("mark") != mark:  # a worker serves many tasks
            state.update(mark=mark, kernel=Kernel(model.landmarks), known={})
        kernel, known = state["kernel"], state["known"]
        for batch in batches:
            texts = [instances(t) for t in texts_of(batch.column(1))]
            if model.landmarks:
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list(set().union(*texts))
                known.update(zip(new, model.margins(new, kernel).tolist()))
                worst = [max(map(known.__getitem__, words), default=model.bias) for words in texts]
            else:
                worst = [0.0] * len(texts)
            scores = [model.probability(m) for m in worst]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Whole texts are scored; a null or empty text has the score of a text without
    a suspicious word. Without usable labels, with labels of one kind only, or with
    no word at fault, the score is the share of toxic labels for every text. A null id has ``held_out`` false.
    Repeated rows each have a row. Other columns are not read.
    """
    prepare(docs.sparkSession)
    model = fit(*sample(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(tidy("toxicity", scorer(model)), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns.

    Where nothing tells toxic texts from clean ones (no word at fault), all rows stay.
    """
    prepare(docs.sparkSession)
    model = fit(*sample(docs, labels))
    if not model.landmarks:
        return docs
    run = scorer(model)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.record_batch([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])
            (scored,) = run(iter([short]))
            yield batch.filter(pa.array(scored.column("score").to_numpy() < THRESHOLD))

    return docs.mapInArrow(tidy("toxicity", passing), docs.schema)
