"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the executors over a bounded sample of labelled rows; the matrix of log-probabilities
(buckets x languages) is broadcast. Scoring walks the whole text in blocks of characters and adds the matrix rows of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayframe.llm.common import remainder, sampled

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Labelled rows per language that the model is fitted on.
SAMPLE = 3000
SMOOTHING = 0.1
#: Characters scored at once.
BLOCK = 1 << 19
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; built once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def letters_only(text: str | None) -> np.ndarray:
    """Code points in lower case, every run of other characters turned into one blank, a blank at either end; empty without a letter."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return cp[:0]
    cp = np.where(letter, cp, np.uint32(32))
    cp = cp[letter | np.append(True, letter[:-1])]
    return np.concatenate([[32], cp[int(cp[0] == 32):], [32][: int(cp[-1] != 32)]]).astype(np.uint64)


def grams(cp: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram of ``order`` characters."""
    if len(cp) < order:
        return np.zeros(0, dtype=np.int64)
    h = np.full(len(cp) - order + 1, order, dtype=np.uint64)
    for k in range(order):
        h = (h ^ cp[k:len(cp) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1)


def blocks(cp: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, block by block: blocks overlap so that each n-gram falls into exactly one."""
    for at in range(0, len(cp), BLOCK):
        yield np.concatenate([grams(cp[at:at + BLOCK + order - 1], order) for order in ORDERS])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    prior: np.ndarray

    def scores(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and its posterior for each text."""
        names, sure = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            cp = letters_only(text)
            if not len(cp) or not self.langs:
                names.append(UNKNOWN)
                continue
            total = self.prior.copy()
            for ids in blocks(cp):
                # One row of the sparse batch: distinct buckets with their counts where that is shorter.
                counts = np.bincount(ids, minlength=BUCKETS)
                used = np.flatnonzero(counts)
                total += counts[used] @ self.weights[used]
            best = int(total.argmax())
            names.append(self.langs[best])
            sure[i] = 1.0 / np.exp(total - total[best]).sum()
        return names, sure


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", bound: int = SAMPLE) -> Model:
    """Fit on about ``bound`` rows of each language. Without labelled rows the model knows no language."""
    rows = sampled(labelled.where(F.col(text_col).isNotNull()), F.col(lang_col), [F.col(key_col), F.col(text_col)], bound).select(F.col("_class").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                mine = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for ids in blocks(letters_only(text.as_py())):
                    mine += np.bincount(ids, minlength=BUCKETS)
        for lang, mine in counts.items():
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(mine[used])], names=["lang", "bucket", "n"])

    table = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    where = {v: i for i, v in enumerate(langs)}
    counts[table.column("bucket").to_numpy(), [where[v] for v in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    smooth = counts + SMOOTHING
    # A flat prior: the sample is dealt evenly over languages.
    return Model(langs, np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32), np.zeros(len(langs)))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())


def identify(docs: DataFrame, model: Model, *keep: Column, text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``lang_pred``, ``score`` for every row.

    Null texts and texts without a letter are ``und`` with score 0; so is every text where no language was learned. Of languages with equal
    posteriors the first by name is predicted. Null and repeated ids are rows like others.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for at in range(0, b.num_rows, 256):  # a part at a time, so that a task holds few texts as strings
                part = b.slice(at, 256)
                names, sure = shared.value.scores(part.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(names, pa.string()), pa.array(sure)], names=[*b.schema.names[:last], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is recognised with a posterior of at least ``least``, with all their columns; others go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = identify(docs, fit(_learnable(docs)), row)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; the model learns from rows whose id's checksum mod 4 is not 2 and whose language is known."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(_learnable(docs))
    return identify(docs, model, F.col("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out")).select("doc_id", "held_out", "lang_pred", "score")
