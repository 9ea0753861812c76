"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows (``PER_LANGUAGE`` rows
per language, chosen by a hash of the id) in Spark.  The matrix of log probabilities,
``BUCKETS`` rows and one column per language, is broadcast; its size does not depend
on the data.  Scoring works on Arrow batches: the n-grams of many texts are one sparse
array of buckets, whose matrix rows are gathered and summed per text in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm.tables import fresh, slices

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
# Labelled rows per language that the model is fitted on, about; fewer if there are fewer.
PER_LANGUAGE = 4_000
# Languages that one model can tell apart; bounds the broadcast matrix to 64 MB.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
UNDETERMINED = "und"
# The pipeline drops documents for which no language reaches this probability.
LEAST_SCORE = 0.5

# Characters whose n-grams are hashed in one numpy step.
WINDOW = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def _windows(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of a text with blanks around it, cut so that each n-gram starts in one window; and how many start there."""
    padded = f" {text.lower()} "
    for at in range(0, len(padded), WINDOW):
        part = padded[at : at + WINDOW + max(GRAMS) - 1]
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), min(WINDOW, len(padded) - at)


def _mixed(codes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each n-gram of ``size`` characters."""
    h = np.full(len(codes) - size + 1, size, np.uint32)
    for k in range(size):
        h = (h ^ codes[k : len(codes) - size + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of ``texts``, and for each which text it is of; in steps of bounded size."""
    held, owners, size = [], [], 0
    for owner, text in enumerate(texts):
        for codes, starts in _windows(text):
            for n in GRAMS:
                if len(codes) >= n:
                    found = _mixed(codes, n)[:starts]
                    held.append(found)
                    owners.append(np.full(len(found), owner, np.int32))
                    size += len(found)
            if size > 4 * WINDOW:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(owners)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: those with crc32 of the id's text 2 modulo 4, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


class Model:
    """Log probabilities: ``weights`` of each bucket by language, ``prior`` of the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        smoothed = counts + SMOOTHING
        self.languages = languages
        self.weights = np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32).T)
        self.prior = np.log(documents / documents.sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text in each language, up to a constant of the text."""
        total = np.tile(self.prior, (len(texts), 1))
        for found, owner in buckets(texts):
            cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for k in range(len(self.languages)):
                sums = np.add.reduceat(self.weights[k][found], cuts, dtype=np.float64)
                np.add.at(total[:, k], owner[cuts], sums)
        return total


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the rows of ``docs`` that have a ``lang`` and may be learned from; None if there are none."""
    rows = docs.where(F.col("lang").isNotNull() & learnable(F.col("doc_id")))
    numbers = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not numbers:
        return None
    if len(numbers) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(numbers)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / numbers[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("lang")]).select(F.col("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in slices(parts, "text"):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in set(langs):
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for found, _ in buckets([t for t, own in zip(texts, langs) if own == lang]):
                    counts += np.bincount(found, minlength=BUCKETS)
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows per language.
    found = counted.toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    column = {lang: k for k, lang in enumerate(languages)}
    counts[found["bucket"].to_numpy(), found["lang"].map(column).to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return Model(languages, counts, np.array([numbers[x] for x in languages], float))


def predicted(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two columns added at the end (replacing columns of that name).

    Prediction reads the whole ``text`` and nothing else.  ``lang`` is one of the
    learned languages, the first in order among equals, and ``score`` its posterior
    probability.  Null, empty and letterless texts, and every text where nothing could
    be learned, are ``und`` with score 0.
    """
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(parts, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            lettered = [known is not None and bool(_LETTER.search(t)) for t in texts]
            langs, chances = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rows = np.flatnonzero(lettered)
            if len(rows):
                logs = known.scores([texts[k] for k in rows])
                chance = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = chance.argmax(axis=1)
                chances[rows] = 1 / chance.sum(axis=1)
                for k, b in zip(rows.tolist(), best.tolist()):
                    langs[k] = known.languages[b]
            columns = [*part.columns, pa.array(langs, pa.string()), pa.array(chances, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([*rows.schema.fields]).add(lang, "string").add(score, "double")
    names = schema.fieldNames()
    return rows.mapInArrow(predict, schema)


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``least_score``, as they are."""
    found = predicted(docs, train(docs), *(names := (fresh(docs, "lang_pred"), fresh(docs, "score"))))
    lang, score = map(F.col, names)
    return found.where((lang != UNDETERMINED) & (score >= least_score)).drop(*names)
