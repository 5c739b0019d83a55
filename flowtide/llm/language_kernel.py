"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of presence: the n-grams of one to three symbols that both
contain, over the root of the product of how many each contains. Landmarks give a Nyström map, a
one-versus-rest kernel ridge regression is fitted on it, and whole texts are scored in blocks: presence of
landmark n-grams times landmarks times weights, two matrix products for a block.

The fit takes a bounded sample on the driver: ``PER_LANGUAGE`` labelled texts of at most ``MAX_CHARS``
characters for each language. Scoring takes every text whole.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import materialize

#: Bounds of the sample the classifier is fitted on.
PER_LANGUAGE, MAX_CHARS = 300, 20_000
LANDMARKS = 16
RIDGE = 1e-3
UNDETERMINED = "und"
#: Texts that are scored in one product.
BLOCK = 128
_SPACE = 32
RESULT = "struct<lang_pred:string,score:double>"


@cache
def _symbols() -> np.ndarray:
    """A byte for every code point: ASCII letters as they are, other letters spread over the upper half,
    everything else a space."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint64)
    spread = 128 + ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57))
    table = np.where(points < 128, points, spread).astype(np.uint8)
    letter = np.fromiter((chr(p).isalpha() for p in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(letter, table, np.uint8(_SPACE))


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text as numbers; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbols()[points]
    if not len(symbols) or (symbols == _SPACE).all():
        return np.empty(0, np.uint32)
    line = np.concatenate(([_SPACE], symbols, [_SPACE, _SPACE])).astype(np.uint8)
    line = line[np.concatenate(([True], (line[1:-1] != _SPACE) | (line[:-2] != _SPACE), [True]))].astype(np.uint32)
    three = np.unique(line[:-2] << 16 | line[1:-1] << 8 | line[2:])
    two, one = three >> 8, three >> 16
    two = two[np.concatenate(([True], two[1:] != two[:-1]))]
    one = one[np.concatenate(([True], one[1:] != one[:-1]))]
    return np.concatenate((one, two | 1 << 24, three | 2 << 24)).astype(np.uint32)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted n-grams of the landmarks
    landmarks: np.ndarray  # presence, n-gram by landmark, over the root of the landmark's n-grams
    weights: np.ndarray  # landmark by language, one more row for the intercept

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of texts and landmarks."""
        present = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, found in enumerate(sets):
            place = np.searchsorted(self.vocabulary, found)
            place[place == len(self.vocabulary)] = 0
            present[row, place[self.vocabulary[place] == found]] = 1
        lengths = np.array([max(1, len(s)) for s in sets], np.float32)
        return (present @ self.landmarks) / np.sqrt(lengths)[:, None]

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights[:-1] + self.weights[-1]


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of labelled texts; the first ``landmarks`` of each language are the landmarks."""
    sets = [grams(t) for t in texts]
    rows = [i for i, s in enumerate(sets) if len(s)]
    if not rows:
        return None
    names = sorted({languages[i] for i in rows})
    chosen = [i for name in names for i in [r for r in rows if languages[r] == name][:landmarks]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    presence = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for column, i in enumerate(chosen):
        presence[np.searchsorted(vocabulary, sets[i]), column] = 1 / np.sqrt(len(sets[i]))
    model = Model(names, vocabulary, presence, np.zeros((len(chosen) + 1, len(names)), np.float32))
    among = model.kernel([sets[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > values.max() * 1e-6
    nystroem = vectors[:, good] / np.sqrt(values[good])
    blocks = [model.kernel([sets[i] for i in rows[k : k + BLOCK]]) for k in range(0, len(rows), BLOCK)]
    features = np.concatenate(blocks).astype(np.float64) @ nystroem
    target = np.array([[languages[i] == name for name in names] for i in rows], np.float64)
    # languages weigh the same, however many texts each has
    weight = (1 / target.sum(axis=0))[target.argmax(axis=1)] * len(rows) / len(names)
    centre, mean = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    x, y = features - centre, target - mean
    inner = (x * weight[:, None]).T @ x + ridge * len(rows) * np.eye(x.shape[1])
    slope = np.linalg.solve(inner, (x * weight[:, None]).T @ y)
    model.weights = np.vstack((nystroem @ slope, mean - centre @ slope)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> list:
    """Labelled texts to learn from, at most ``per_language`` each, by the hash of doc_id."""
    usable = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= max_chars)
    ).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    # written, so that its size is known and the texts stay where they are
    counts = materialize(usable.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")), "languages")
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    near = (
        usable.join(counts, F.col("lang") == F.col("of"))
        .where(share * F.col("n") < 2 * per_language)
        .groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= per_language).orderBy("lang", "place").select("lang", "text").collect()


def predictor(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """Fit on ``docs`` and give a function of a text column: lang_pred and score."""
    rows = sample(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in rows], [r["lang"] for r in rows]))

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        model: Model | None = shared.value
        names, scores = [], []
        for start in range(0, len(texts), BLOCK):
            sets = [grams(t.as_py() or "") for t in texts[start : start + BLOCK]]
            if model is None:
                names += [UNDETERMINED] * len(sets)
                scores += [0.0] * len(sets)
                continue
            values = np.clip(model.scores(sets), 0, 1)
            for found, row in zip(sets, values):
                names.append(model.languages[int(row.argmax())] if len(found) else UNDETERMINED)
                scores.append(float(row.max()) if len(found) else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learned value of lang, or ``und`` with score 0 for a null text, a text without a
    letter, and every text if there is nothing to learn from. A row without doc_id is not learned from and
    not held out. Repeated rows count once in the sample and are scored one by one; an empty table gives an
    empty result; columns other than doc_id, text and lang are left out.
    """
    predict = predictor(docs, per_language)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def in_known_language(docs: DataFrame, least: float = 0.0, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least this score, all columns."""
    predict = predictor(docs, per_language)
    packed = docs.select(F.struct("*").alias("row"), predict(F.col("text")).alias("p"))
    return packed.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least)).select("row.*")
