"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon (whole words, word starts, disguised words), how near its words stand to words that address the reader,
and rates of capitals, punctuation and disguise. The lexicon is learned: words and word starts that turn up in many more toxic than
other documents of the training sample, counted on the executors. Trees are fitted on two thirds of the sample, the calibration on the rest.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from assayframe.llm.common import durable, remainder, sampled

#: Labelled rows per class that the model is fitted on.
SAMPLE = 4000
#: A lexicon entry stands in at least SUPPORT toxic sample documents and this many times the share of the others.
SUPPORT, LIFT, ENTRIES = 4, 6.0, 2000
STARTS = (4, 5, 6, 7)
THRESHOLD = 0.7
#: Words that address the reader in the four languages of the tables.
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú usted ustedes vosotros ti tus su sus".split())
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
MARKS = string.punctuation + "«»“”„’‘…¿¡–—"
QUIET = ".,;:?\"'()[]«»“”„…¿¡–—"
INNER = re.compile(r"[\W\d_]+")
#: Words within this distance count as near.
NEAR = 5
FEATURES = ("word", "start", "hidden", "log_hits", "distinct", "weight", "log_weight", "top_weight", "near_you", "you", "capitals", "shouted", "marks", "exclaim", "inner_marks", "digits", "spelled", "repeats", "log_words")


def bare(word: str) -> str:
    return word.strip(MARKS).lower()


def revealed(word: str) -> set[str]:
    """What the word may read with stand-in signs taken as letters and marks inside taken out; empty for plain words."""
    cores = {word.strip(QUIET).lower(), word.strip(QUIET).rstrip("!" + QUIET).lower(), word.strip(MARKS).lower()}
    plain = {INNER.sub("", c.translate(DISGUISE)) for c in cores if not c.isalpha()}
    return {p for p in plain if len(p) >= 4}


def entries(text: str | None) -> set[str]:
    """Candidates for the lexicon in a text: its bare words, and the starts of longer ones (marked by a trailing ``*``)."""
    words = {bare(w) for w in (text or "").split()}
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in STARTS if len(w) > n}


class Words(dict):
    """Numbers of the words met so far; a new word is looked up once. Its facts stand in columns. A disguised word counts as a word, too."""

    COLUMNS = ("word", "start", "hidden", "strength", "you", "shouted", "inner", "single", "name")

    def __init__(self, lexicon: Mapping[str, float]):
        super().__init__()
        self.lexicon, self.rows, self.names = lexicon, [], {}

    def look_up(self, b: str) -> tuple[str | None, float]:
        """How a bare word matches, and the greatest weight of the entries it matches."""
        get = self.lexicon.get
        start = max([get(b[:k] + "*", 0.0) for k in STARTS if len(b) > k], default=0.0)
        return ("word", max(get(b), start)) if b in self.lexicon else ("start", start) if start else (None, 0.0)

    def __missing__(self, w: str) -> int:
        b = bare(w)
        match, strength = self.look_up(b)
        plain = b.isalpha()
        if not match and not (plain and w.isalpha()):
            for r in sorted(revealed(w)):
                found, strength = self.look_up(r)
                if found:
                    match = "hidden"
                    break
        self[w] = at = len(self.rows)
        name = self.names.setdefault(b, len(self.names))
        self.rows.append((match in ("word", "hidden"), match == "start", match == "hidden", strength, b in ADDRESS, len(b) > 1 and w.isupper(), len(b) > 2 and not plain, len(b) == 1, name))
        return at

    def spelled(self, letters: str) -> float:
        """Weight of a word spelled letter by letter."""
        return self.look_up(letters)[1]


def features(texts: Sequence[str | None], lexicon: Mapping[str, float]) -> np.ndarray:
    """Dense features of whole texts, a row each, in the order of FEATURES; all 0 without words."""
    known, out = Words(lexicon), np.zeros((len(texts), len(FEATURES)))
    split = [(t or "").split() for t in texts]
    numbers = [np.fromiter(map(known.__getitem__, raw), dtype=np.int64, count=len(raw)) for raw in split]
    table = np.array(known.rows, dtype=float).reshape(-1, len(Words.COLUMNS))
    for i, (text, raw, ids) in enumerate(zip(texts, split, numbers)):
        if not raw:
            continue
        n, size = len(raw), len(text)
        facts = table[ids]
        word, start, hidden, strength, you, shouted, inner, single, name = facts.T
        hit = strength > 0
        spelled = 0
        if single.sum() >= 4:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
            for first, last in zip(edges[::2], edges[1::2]):
                if last - first >= 4:
                    spelled += last - first
                    weight = known.spelled("".join(bare(w) for w in raw[first:last]))
                    if weight:
                        hit[first], word[first], hidden[first], strength[first] = True, 1, 1, weight
        at, addressed, near = np.flatnonzero(hit), np.flatnonzero(you), 0
        if len(at) and len(addressed):
            fenced = np.concatenate([[-10**9], addressed, [10**9]])
            k = np.searchsorted(fenced, at)
            near = int((np.minimum(at - fenced[k - 1], fenced[np.minimum(k, len(fenced) - 1)] - at) <= NEAR).sum())
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _kinds()[cp]
        letters, upper, digits, blanks = (kind <= 1).sum(), (kind == 1).sum(), (kind == 2).sum(), (kind == 3).sum()
        total = strength.sum()
        out[i] = [word.mean(), start.mean(), hidden.mean(), np.log1p(len(at)), np.log1p(len(np.unique(name[at]))), total / n, np.log1p(total), strength.max(), near / n, you.mean(),
                  upper / max(1, letters), shouted.mean(), (size - letters - digits - blanks) / size, text.count("!") / n, inner.mean(), digits / size, spelled / n, (np.diff(name) == 0).sum() / n, np.log1p(n)]
    return out


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point: 0 letter, 1 capital, 2 digit, 3 white space, 4 other; built once per worker."""
    if not _KINDS:
        chars = map(chr, range(0x110000))
        _KINDS.append(np.fromiter((1 if c.isupper() and c.isalpha() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 for c in chars), dtype=np.uint8, count=0x110000))
    return _KINDS[0]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    calibration: Isotonic

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(self.calibration(self.trees.margin(features(texts, self.lexicon))), 0.0, 1.0)


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries whose share of toxic documents is LIFT times that of the others, smoothed, with the logarithm of the ratio as weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = sorted(entries(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), label, dtype=np.int32))], names=["entry", "label"])

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = rows.select("label", "text").mapInArrow(run, "entry string, label int").groupBy("entry").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    lift = (F.col("toxic") / toxic) / ((F.col("other") + 0.5) / other)
    best = counts.where((F.col("toxic") >= SUPPORT) & (lift >= LIFT)).orderBy(F.desc(F.col("toxic") * F.log(lift)), "entry").limit(ENTRIES)
    return {r["entry"]: float(np.log(r["lift"])) for r in best.select("entry", lift.alias("lift")).collect()}


def fit(labelled: DataFrame) -> Model:
    """Fit on (doc_id, text, label, weight). Without labels of both kinds the score is the share of toxic labels, or one half."""
    rows = durable(labelled.select("doc_id", "text", F.col("label").cast("int").alias("label"), "weight"))
    lexicon = _lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = features(part.column(2).to_pylist(), lexicon)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["fold", "label", "weight", "x"])

    got = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int").alias("fold"), "label", "text", "weight").mapInArrow(run, "fold int, label int, weight double, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES))
    y, fold = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy()
    weight = got.column("weight").to_numpy()
    weight = weight / weight.mean() if len(weight) else weight  # one on average, as the fits weigh them against constants
    order = np.lexsort([*x.T, y, fold])  # the same model whatever the order of tasks
    x, y, fold, weight = x[order], y[order], fold[order], weight[order]
    inner = fold != 0
    trees = fit_trees(x[inner], y[inner], weight[inner])
    return Model(lexicon, trees, fit_isotonic(trees.margin(x[~inner]), y[~inner], weight=weight[~inner]))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, label, weight: rows of its class that it stands for) of a bounded sample of labelled rows with checksum mod 3 other than 1; labels other than 0 and 1 are left out.

    The sample of labels is bounded by two classes times ``bound`` (a document labelled twice with different labels counts for neither), so it may be broadcast.
    """
    known = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_top")).where("label = _top AND doc_id IS NOT NULL")
    known = known.where(remainder(F.col("doc_id"), 3) != 1)
    chosen = durable(sampled(known, F.col("label"), [F.col("doc_id")], bound).select("doc_id", "label", F.col("_weight").alias("weight")))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def score(docs: DataFrame, scores, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ``scores`` maps a list of texts to an array."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = shared.value(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Null and empty texts are scored like others, with all features 0."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(training_rows(docs, labels, "toxic", SAMPLE))
    return score(docs, model.scores, THRESHOLD)
