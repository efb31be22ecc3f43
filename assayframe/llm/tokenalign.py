"""Alignment of two tokenizers' tokens of the same text.

A tokenizer cuts the bytes of a text; where tokens of both end at one byte, both cuts agree. Such shared cuts part a text into groups, the smallest
stretches that both tokenizers spell with whole tokens. They are found by divide and conquer: a shared cut near the middle of an interval is
located by bisecting the one side's ends for the ends of the other, nearest to the middle first, and both halves are taken on; an interval in which
no cut is shared is a leaf, and a leaf is a group. All intervals of a batch of texts are worked on together, level by level, so that a
level is a few array operations.

Token pairs that end together are links. How often a pair is linked is counted over the whole corpus. Pairs met most often, a bounded number, are
held by every task when links are looked up; links of all other pairs are joined to their counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm.common import durable

#: Pairs whose counts every task holds, 17 bytes each; all others are joined.
FREQUENT = 500_000
#: Texts aligned together, in bytes.
BATCH = 1 << 20
#: Runs without white space beyond this length are left to the slower library, which needs no stack for them.
LONG_RUN = 20_000
_RUNS = re.compile(r"\s+|\S+")
#: How the byte-level vocabulary cuts a text into words before it merges bytes: a fixed value of that vocabulary.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_folder() -> Path:
    """Folder of the installed package of public tokenizers."""
    import public_tokenizers

    return Path(public_tokenizers.__file__).parent


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class ByteLevel:
    """A byte-level BPE vocabulary from its JSON text. Special tokens' strings in a text are plain text."""

    def __init__(self, text: str):
        spec, byte_of = json.loads(text), _byte_of()
        special = {t["id"] for t in spec["added_tokens"]}
        self.slow = tokenizers.Tokenizer.from_str(text)
        self.slow.encode_special_tokens = True
        vocab = {i: w for w, i in spec["model"]["vocab"].items()}
        self.bytes = [bytes(byte_of[c] for c in vocab[i]) if i in vocab and i not in special else b"" for i in range(max([*vocab, *special]) + 1)]
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        # Ids in the order of the merges are ranks, for which there is a faster library; other vocabularies go the plain way.
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        byte_pieces = len(ranks) - len(merges)
        self.fast = None
        if byte_pieces == 256 and all(len(self.bytes[i]) == 1 for i in range(256)) and all(vocab.get(256 + k) == m for k, m in enumerate(merges)):
            self.fast = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.fast is not None and (len(t) <= LONG_RUN or max(map(len, _RUNS.findall(t))) <= LONG_RUN):
                out.append(np.array(self.fast.encode_ordinary(t), dtype=np.int64))
            else:
                out.append(np.array(self.slow.encode(t, add_special_tokens=False).ids, dtype=np.int64))
        return out


class Pieces:
    """A piece vocabulary with byte fallback from its model file's bytes."""

    def __init__(self, proto: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(list(texts), num_threads=1)]


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, a_last: np.ndarray) -> np.ndarray:
    """Mask over the tokens of A: whether a group ends with the token.

    ``a_end`` and ``b_end`` rise strictly; text t covers tokens ``a_first[t]`` to ``a_last[t]`` of A, the last of which ends with its last token of B.
    """
    cut = np.zeros(len(a_end), dtype=bool)
    if not len(a_last):
        return cut
    cut[a_last] = True
    low, high = a_first.astype(np.int64), a_last.astype(np.int64)  # an interval's cuts are looked for at tokens low to high - 1
    probe = np.zeros(len(low), dtype=np.int64)
    while True:
        live = (high - low) > probe
        low, high, probe = low[live], high[live], probe[live]
        if not len(low):
            return cut
        # Tokens at distances 0, 1, 1, 2, 2, ... from the middle in turn; the last probe is an end of the interval.
        step = (probe + 1) // 2
        at = (low + high - 1) // 2 + np.where(probe % 2 == 1, step, -step)
        ends = a_end[at]
        found = np.searchsorted(b_end, ends)
        hit = b_end[np.minimum(found, len(b_end) - 1)] == ends
        cut[at[hit]] = True
        miss = ~hit
        low = np.concatenate([low[miss], low[hit], at[hit] + 1])
        high = np.concatenate([high[miss], at[hit], high[hit]])
        probe = np.concatenate([probe[miss] + 1, np.zeros(2 * int(hit.sum()), dtype=np.int64)])


@lru_cache(maxsize=2)
def _loaded(a_text: str, b_proto: bytes):
    """Both tokenizers with the lengths and the printed ids of their tokens, once per worker."""
    a, b = ByteLevel(a_text), Pieces(b_proto)
    size_a, size_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b))
    # Every id twice: followed by a comma, or by the end of its side of the group.
    names = [f"{i}{after}" for side, closing in ((a, "|"), (b, ";")) for i in range(len(side.bytes)) for after in (",", closing)]
    return a, b, size_a, size_b, names


class Aligned:
    """Tokens and groups of a batch of texts, end to end; a text that the tokenizers do not spell out has none."""

    def __init__(self, texts: Sequence[str | None], a_text: str, b_proto: bytes):
        a, b, size_a, size_b, self.names = _loaded(a_text, b_proto)
        self.names_a = 2 * len(a.bytes)
        wanted = [" " + t if t else "" for t in texts]
        ids_a, ids_b = a.encode(wanted), b.encode([t or "" for t in texts])
        for i, t in enumerate(wanted):
            raw = t.encode()
            if not t or b"".join(map(a.bytes.__getitem__, ids_a[i].tolist())) != raw or b"".join(map(b.bytes.__getitem__, ids_b[i].tolist())) != raw:
                ids_a[i] = ids_b[i] = np.zeros(0, dtype=np.int64)
        self.n_a, self.n_b = (np.fromiter(map(len, ids), dtype=np.int64, count=len(texts)) for ids in (ids_a, ids_b))
        self.a, self.b = np.concatenate([*ids_a, np.zeros(0, dtype=np.int64)]), np.concatenate([*ids_b, np.zeros(0, dtype=np.int64)])
        a_end, b_end = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        last = np.cumsum(self.n_a) - 1
        some = self.n_a > 0
        self.cut_a = shared_cuts(a_end, b_end, (last + 1 - self.n_a)[some], last[some])
        self.cut_b = np.zeros(len(self.b), dtype=bool)
        self.cut_b[np.searchsorted(b_end, a_end[self.cut_a])] = True
        #: Text of each group.
        self.owner = np.repeat(np.arange(len(texts)), self.n_a)[self.cut_a]
        self.n_groups = np.bincount(self.owner, minlength=len(texts))

    def groups(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        # Tokens of A stand behind the B tokens of all groups before, tokens of B behind the A tokens of their own group too.
        group_a, group_b = (np.cumsum(c) - c for c in (self.cut_a, self.cut_b))
        count_a, count_b = (np.bincount(g, minlength=len(self.owner)) for g in (group_a, group_b))
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        code[np.arange(len(self.a)) + (np.cumsum(count_b) - count_b)[group_a]] = 2 * self.a + self.cut_a
        code[np.arange(len(self.b)) + np.cumsum(count_a)[group_b]] = self.names_a + 2 * self.b + self.cut_b
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(map(self.names.__getitem__, code[at:at + n].tolist()))[:-1])
            at += n
        return out


#: Bits of an id within a pair's key, and of a pair's key.
_ID = 20


def _sums_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)


def align(docs: DataFrame, a_text: str, b_proto: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, links) for every row of ``docs``, as a written table.

    ``groups`` is the SHA-256 of the printed groups, empty without tokens. ``links`` holds each linked pair (a, b) of the text once, with the
    number m of its links. Groups end with one token of either side, as no token is empty, so a group is a link.
    """
    model = docs.sparkSession.sparkContext.broadcast((a_text, b_proto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH)))
                part = batch.slice(at, upto - at)
                at = upto
                yield _aligned_batch(part, *model.value)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return durable(rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, m array<int>"))


def _aligned_batch(part: pa.RecordBatch, a_text: str, b_proto: bytes) -> pa.RecordBatch:
    found = Aligned(part.column(2).to_pylist(), a_text, b_proto)
    keys = (found.owner << 2 * _ID) | (found.a[found.cut_a] << _ID) | found.b[found.cut_b]
    keys, m = np.unique(keys, return_counts=True)
    offsets = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) << 2 * _ID).astype(np.int32))
    ids = ((keys >> _ID) & ((1 << _ID) - 1), keys & ((1 << _ID) - 1), m)
    printed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
    return pa.RecordBatch.from_arrays(
        [part.column(0), part.column(1), pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups), pa.array(found.n_groups), pa.array(printed, pa.string()),
         *(pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in ids)],
        names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "m"])


def _lists(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    """Row number of each element of the lists, and the elements of each list column."""
    columns = [batch.column(batch.schema.names.index(n)) for n in names]
    sizes = columns[0].value_lengths().to_numpy(zero_copy_only=False)
    return [np.repeat(np.arange(len(sizes)), sizes), *(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            _, a, b, m = _lists(batch.slice(at, 1024), ["a", "b", "m"])
            keys, n = _sums_by_key(np.concatenate([keys, a << _ID | b]), np.concatenate([n, m]))
            if len(keys) > 2_000_000:
                yield _pair_rows(keys, n)
                keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    yield _pair_rows(keys, n)


def _pair_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((keys >> _ID).astype(np.int32)), pa.array((keys & ((1 << _ID) - 1)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) for every pair linked anywhere: how many links hold it, and whether no other pair of its b has more. A written table."""
    pairs = durable(aligned.select("a", "b", "m").mapInArrow(_count_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return durable(pairs.join(top.hint("merge"), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))


def link_figures(aligned: DataFrame, pairs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) for every row of ``aligned``."""
    top = pairs.orderBy(F.desc("n"), "a", "b").limit(frequent).toArrow()
    keys = top["a"].to_numpy().astype(np.int64) << _ID | top["b"].to_numpy()
    order = np.argsort(keys)
    held = aligned.sparkSession.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], top["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                owner, a, b, m = _lists(part, ["a", "b", "m"])
                wanted = a << _ID | b
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
                sums = [np.zeros(part.num_rows, dtype=np.int64) for _ in range(2)]
                for total, value in zip(sums, (best, n)):
                    np.add.at(total, owner[hit], m[hit] * value[at[hit]])
                rest = ~hit
                offsets = pa.array(np.searchsorted(owner[rest], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums), *(pa.ListArray.from_arrays(offsets, pa.array(v[rest].astype(np.int32))) for v in (a, b, m))],
                                                 names=["row", "n_best", "count_sum", "a", "b", "m"])

    found = durable(aligned.select("row", "a", "b", "m").mapInArrow(run, "row long, n_best long, count_sum long, a array<int>, b array<int>, m array<int>"))
    rest = found.select("row", F.inline(F.arrays_zip("a", "b", "m"))).join(pairs.hint("merge"), ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("_best"), F.sum(F.col("m") * F.col("n")).alias("_sum"))
    return found.select("row", "n_best", "count_sum").join(rest.hint("merge"), "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def aligned_figures(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_file`` (byte-level vocabulary) and ``b_file`` (pieces) are files on the driver; their contents are sent to the tasks. Without them those of the
    installed package of public tokenizers are taken. Null and empty texts, and texts that the two do not spell out byte by byte, have no tokens: zeros and an
    empty digest. Null and repeated ids are rows like others; other columns are ignored.
    """
    a_text = Path(a_file or tokenizer_folder() / "byte_bpe_50k.json").read_text()
    b_proto = Path(b_file or tokenizer_folder() / "piece_bpe_32k.model").read_bytes()
    aligned = align(docs, a_text, b_proto)
    figures = link_figures(aligned, pair_counts(aligned), frequent)
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256")).join(figures.hint("merge"), "row").drop("row")


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned_figures(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
