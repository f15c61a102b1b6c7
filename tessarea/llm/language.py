"""Language identification by blended-spectrum n-gram presence kernels.

Texts are cut into stretches of bytes; all of them are scored. A stretch is the
set of its byte n-grams of one to three letters. The kernel of two stretches is
the number of n-grams they share, normalised. Landmarks from the training rows
turn each stretch into a vector of kernel values (Nyström), and kernel ridge
regression gives one weight vector per language against the rest. Presence
matrices of many stretches are multiplied with the landmarks at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, cut_lineage, prepare, texts_of, worker_state

# Training rows of a language at most: the bound on what the driver sees.
SAMPLE = 250
# Parts of a language that choose their rows apart.
PARTS = 32
LANDMARKS_PER_LANGUAGE = 32
STRETCH = 2048
FEATURES = 6000
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"
BLOCK = 256

# ASCII other than letters becomes a space; bytes of other letters stay.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters_of(text: str) -> bytes:
    """Lower-case words parted by single spaces, as bytes."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def stretches(data: bytes) -> list[bytes]:
    """The whole text in pieces of about equal length, at least one."""
    count = max(1, -(-len(data) // STRETCH))
    step = -(-len(data) // count) or 1
    return [b" " + data[k * step : (k + 1) * step] + b" " for k in range(count)]


def codes(data: bytes) -> np.ndarray:
    """N-grams of one to three bytes as numbers of 24 bits."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    two = b[:-1] << 8 | b[1:]
    return np.concatenate([b, two, two[:-1] << 8 | b[2:]])


@dataclass
class Model:
    languages: list[str]
    features: np.ndarray  # codes, sorted
    landmarks: np.ndarray  # features by landmarks, presence over the root of the landmark's size
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray

    def place_of(self) -> np.ndarray:
        """Table from code to feature number; the last number is for unknown codes."""
        table = np.full(1 << 24, len(self.features), np.uint16)
        table[self.features] = np.arange(len(self.features))
        return table

    def scores(self, pieces: list[bytes], place: np.ndarray) -> np.ndarray:
        """One row of language scores per piece, in blocks of matrix products."""
        out = np.empty((len(pieces), len(self.languages)))
        for k in range(0, len(pieces), BLOCK):
            block = pieces[k : k + BLOCK]
            present = np.zeros((len(block), len(self.features) + 1), np.float32)
            for i, piece in enumerate(block):
                present[i, place[codes(piece)]] = 1
            present = present[:, :-1]
            size = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
            out[k : k + BLOCK] = (present @ self.landmarks) / size @ self.weights + self.bias
        return out


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Train on texts with their languages; None without any."""
    languages = sorted(set(langs))
    if not languages:
        return None
    number = {g: i for i, g in enumerate(languages)}
    pieces, of = [], []
    for text, lang in zip(texts, langs):
        for piece in stretches(letters_of(text))[:: max(1, len(text) // (4 * STRETCH))]:
            pieces.append(piece)
            of.append(number[lang])
    of = np.array(of)
    rnd = np.random.default_rng(11)
    marks = np.concatenate(
        [rnd.permutation(np.flatnonzero(of == i))[:LANDMARKS_PER_LANGUAGE] for i in range(len(languages))]
    )
    found: Counter = Counter()
    for i in marks:
        found.update(np.unique(codes(pieces[i])).tolist())
    features = np.array(sorted(sorted(found, key=lambda c: (-found[c], c))[:FEATURES]))
    model = Model(languages, features, np.zeros(0), np.zeros(0), np.zeros(len(languages)))
    place = model.place_of()
    rows = np.zeros((len(marks), len(features) + 1), np.float32)
    for r, i in enumerate(marks):
        rows[r, place[codes(pieces[i])]] = 1
    rows = rows[:, :-1]
    model.landmarks = (rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))).T.copy()
    model.weights = np.eye(len(marks))
    model.bias = np.zeros(len(marks))
    languages_, model.languages = model.languages, [""] * len(marks)
    kernel = model.scores(pieces, place)  # against the landmarks
    inner = kernel[marks]
    size, axes = np.linalg.eigh((inner + inner.T) / 2)
    root = axes @ np.diag(1 / np.sqrt(np.maximum(size, 1e-4))) @ axes.T
    x = kernel @ root
    weight = 1 / np.bincount(of, minlength=len(languages_))[of] / len(languages_)
    y = np.where(of[:, None] == np.arange(len(languages_)), 1.0, -1.0)
    mean_x, mean_y = weight @ x, weight @ y
    centred = (x - mean_x) * weight[:, None]
    solved = np.linalg.solve(centred.T @ (x - mean_x) + RIDGE * np.eye(x.shape[1]), centred.T @ (y - mean_y))
    model.languages, model.weights, model.bias = languages_, root @ solved, mean_y - mean_x @ solved
    return model


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """At most ``SAMPLE`` texts a language, from rows whose CRC-32 of the id is not 0 modulo 5."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
    ).where("doc_id IS NOT NULL AND lang IS NOT NULL").where(crc_of_id() % 5 != 0)
    # First within parts of a language, so that the last round holds SAMPLE * PARTS rows of it at most.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    ids = known.distinct().select("doc_id", "lang", part)
    for group in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("rank", F.row_number().over(order)).where(f"rank <= {SAMPLE}").drop("rank")
    ids = cut_lineage(ids.select("doc_id", "lang"), "language-sample")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    rows = texts.where("text IS NOT NULL").join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang))
    rows = [r for r in rows if letters_of(r.text)]
    return [r.text for r in rows], [r.lang for r in rows]


def _predict(model: Model):
    mark = repr((model.languages, model.features.tobytes(), model.weights.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("language")
        if state.get("mark") != mark:
            state.update(mark=mark, place=model.place_of())
        place = state["place"]
        for batch in batches:
            pieces, owner, share = [], [], []
            lettered = batch.column("lettered").to_pylist()
            for i, (text, ok) in enumerate(zip(texts_of(batch.column("text")), lettered)):
                for piece in stretches(letters_of(text)) if ok else ():
                    pieces.append(piece)
                    owner.append(i)
                    share.append(len(piece))
            total = np.zeros((batch.num_rows, len(model.languages)))
            size = np.full(batch.num_rows, 1e-9)
            if pieces:
                np.add.at(total, owner, model.scores(pieces, place) * np.array(share)[:, None])
                np.add.at(size, owner, share)
            mean = SHARPNESS * total / size[:, None]
            power = np.exp(mean - mean.max(axis=1, keepdims=True))
            power /= power.sum(axis=1, keepdims=True)
            best = mean.argmax(axis=1)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores = np.where(lettered, power[np.arange(len(best)), best], 0.0)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``.

    Learnt from the rows of :func:`sample` alone. ``und`` with score 0 if the text
    is null or has no letter, or if there is nothing to learn from. A null id has
    ``held_out`` false. Repeated rows each have a row. Other columns are not read.
    """
    prepare(docs.sparkSession)
    model = fit(*sample(docs))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    if model is None:
        found = rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")
