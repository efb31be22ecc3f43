"""Document quality by supervised subword embeddings.

Words, and the character n-grams inside them, have learned vectors in hashed rows of one table; a document is the average of
its words, each the average of its pieces; a softmax layer gives the class. Table and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. For scoring, the table times the layer is one small matrix, and tasks add up its rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm.toxicity import score, training_rows

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (3, 4)
#: Labelled rows per class that the model is fitted on.
SAMPLE = 1500
PASSES, RATE, SEED, THRESHOLD = 12, 0.5, 11, 0.5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words whose values a worker remembers, and characters it scores at once; both only save time and memory.
REMEMBERED, CHARACTERS = 1 << 18, 1 << 20
#: Stands for a word that follows itself; no word holds a blank.
REPEAT = "= "


def pieces(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of every piece: the word and its n-grams, with marks at both ends; case and punctuation are kept."""
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    last = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(cp)) - (last - size)[owner]
    power = np.full(size.max(initial=1), MULTIPLIER, dtype=np.uint64)
    np.multiply.accumulate(power, out=power)
    owners, hashes = [np.arange(len(words))], [np.add.reduceat(cp * power[inside], last - size) if len(words) else cp]
    for n in ORDERS:
        at = np.flatnonzero(inside + n <= size[owner])
        owners.append(owner[at])
        hashes.append(sum((cp[at + k] * power_k for k, power_k in enumerate(_powers(n))), np.full(len(at), n, dtype=np.uint64)))
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return np.concatenate(owners), (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, MULTIPLIER, dtype=np.uint64))


def counted(text: str | None) -> Counter:
    """Words of the whole text with their counts; a word that follows itself also counts as the pair."""
    words = (text or "").split()
    return Counter(words) + Counter(REPEAT for a, b in zip(words, words[1:]) if a == b)


@dataclass
class Model:
    piece: np.ndarray  # buckets x 2: what each piece adds to the classes' log-odds
    bias: np.ndarray

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to the log-odds: the average of its pieces."""
        owner, bucket = pieces(words)
        slope = self.piece[:, 1] - self.piece[:, 0]
        return np.bincount(owner, slope[bucket], len(words)) / np.bincount(owner, minlength=len(words))

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of class 1. Words already met by this worker are looked up."""
        known, out = _known(self), np.full(len(texts), self.bias[1] - self.bias[0])
        done = 0
        while done < len(texts):
            raw, size, unseen = [], 0, set()
            while done + len(raw) < len(texts) and size < CHARACTERS:
                text = texts[done + len(raw)] or ""
                raw.append(text.split())
                size += len(text)
                unseen.update(set(raw[-1]).difference(known))
            fresh = sorted(unseen)
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                known[REPEAT] = float(self.values([REPEAT])[0])
                fresh = sorted(set().union(*raw))
            known.update(zip(fresh, self.values(fresh).tolist()))
            for i, words in enumerate(raw, done):
                if words:
                    again = sum(map(eq, words, words[1:]))
                    out[i] += (sum(map(known.__getitem__, words)) + again * known[REPEAT]) / (len(words) + again)
            done += len(raw)
        return 1 / (1 + np.exp(-out))


_KNOWN: list = [None, {}]


def _known(model: Model) -> dict[str, float]:
    """Values of the words met so far under this model."""
    if _KNOWN[0] is not model:
        _KNOWN[:] = [model, {REPEAT: float(model.values([REPEAT])[0])}]
    return _KNOWN[1]


def train(samples: Sequence[tuple[int, Counter]], weight: Sequence[float] = (1.0, 1.0)) -> Model:
    """SGD on (label, word counts). A row of each class stands for ``weight`` rows: their logarithms are added to the bias, which undoes
    an uneven sampling of the classes. Without both labels the score is flat: their share, or one half."""
    labels = [s[0] for s in samples]
    if len(set(labels)) < 2:
        share = np.clip(np.mean(labels), 0.01, 0.99) if labels else 0.5
        return Model(np.zeros((BUCKETS, 2)), np.array([0.0, np.log(share / (1 - share))]))
    rng = np.random.default_rng(SEED)
    table, layer, bias = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH, rng.uniform(-1, 1, (WIDTH, 2)) / WIDTH, np.zeros(2)
    docs = []
    for label, words in samples:
        total = sum(words.values())
        if total:
            owner, bucket = pieces(list(words))
            share = np.fromiter(words.values(), dtype=float) / total / np.bincount(owner)
            used, inverse = np.unique(bucket, return_inverse=True)
            docs.append((label, used, np.bincount(inverse, share[owner])))
    steps, done = PASSES * len(docs), 0
    for _ in range(PASSES):
        for k in rng.permutation(len(docs)):
            label, used, amount = docs[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = amount @ table[used]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            err = -p
            err[label] += 1
            back = layer @ err
            layer += rate * np.outer(mean, err)
            bias += rate * err
            # The gradient of a row is its share of the average; it is scaled up, as rows of long texts get tiny shares.
            table[used] += rate * np.outer(amount / amount.max(), back) * 0.1
    return Model(table @ layer, bias + np.log(weight))


def fit(labelled: DataFrame) -> Model:
    """Count words on the executors, train on the driver: the sample is bounded by SAMPLE rows of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, label, text, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words = counted(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([label], pa.int32()), pa.array([list(words)], pa.list_(pa.string())), pa.array([list(words.values())], pa.list_(pa.int32())), pa.array([weight.as_py()], pa.float64())],
                                                 names=["doc_id", "label", "words", "counts", "weight"])

    rows = labelled.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text", "weight").mapInArrow(run, "doc_id long, label int, words array<string>, counts array<int>, weight double")
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    weight = {label: w for label, w in zip(got.column("label").to_pylist(), got.column("weight").to_pylist())}
    return train([(label, Counter(dict(zip(w, c)))) for label, w, c in zip(got.column("label").to_pylist(), got.column("words").to_pylist(), got.column("counts").to_pylist())], (weight.get(0, 1.0), weight.get(1, 1.0)))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Null and empty texts get the score of the bias alone."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(training_rows(docs, labels, "quality", SAMPLE))
    return score(docs, model.scores, THRESHOLD)
