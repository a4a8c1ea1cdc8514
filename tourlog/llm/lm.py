"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A word is predicted in two steps.  Its class, told by its ending, by a
log-linear model over hashed features of the words before it: the last word, the
last but one (a skip), and both together.  Then the word in its class, by its
count.  The counts cover all training texts.  The weights of the features come
from distributed gradient updates: each task sums the gradient of its tokens per
hashed bucket, Spark adds them up, and each epoch makes one step with a step
size per weight; in the first epoch all tokens have the prior as prediction.

Size: weights are a table of BUCKETS x CLASSES whatever the input.  Counts of
words grow with the corpus and stay distributed: the TOP_WORDS most frequent
words are sent to the workers, every other word of a text meets its count in a
join (after adding up in its document).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.llm.storage import written
from tourlog.llm.words import LOWER, contents

FOLDS = 5
HELD_OUT = 1
TOP_WORDS = 65_536
BUCKETS = 1 << 14
CLASSES = 32
# classes with one ending of their own
OWN_CLASSES = 24
EPOCHS = 2
# added to the expected counts, which bounds the steps of rare buckets
DAMPING = 4.0
# entries of a task's table of counts before it is handed on
FLUSH = 300_000
# tokens scored at once
BLOCK = 1 << 16
# stands for the end of a text; no word contains a space
END = b" "


def held_out(doc_id) -> bool:
    """Whether a document is scored only; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def ending(word: bytes) -> bytes:
    return word[-2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the tokens of training texts (doc_id, text)."""
    table: Counter = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(table), pa.binary()), pa.array(table.values(), pa.int64())], ["word", "c"])
        table.clear()
        return b

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), contents(b.column(1))):
            if not held_out(doc_id):
                table.update(tokens(text))
                if len(table) >= FLUSH:
                    yield out()
    if table:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of all tokens of the training texts: (word, c)."""
    partial_counts = docs.select("doc_id", "text").mapInArrow(_count, "word binary, c long")
    return written(partial_counts.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


class Model:
    """What the workers need; its size does not depend on the corpus."""

    def __init__(self, top: list[tuple[bytes, int]], endings: list[tuple[bytes, float]], n: int, v: int):
        self.n, self.v = n, v
        self.norm = float(np.log10(n + 0.5 * (v + 1)))
        self.ids = {w: i for i, (w, _) in enumerate(top)}
        by_mass = sorted(endings, key=lambda e: (-e[1], e[0]))
        self.own = {e: k for k, (e, _) in enumerate(by_mass[:OWN_CLASSES])}
        mass = np.full(CLASSES, 0.5)  # an unknown word in each class
        for e, m in endings:
            mass[self.class_of(e)] += m
        self.log_mass = np.log10(mass)
        self.prior = np.log(mass / mass.sum()).astype(np.float32)
        self.word_class = np.array([self.class_of(ending(w)) for w, _ in top] or [0], np.int64)
        self.log_count = np.log10(np.array([c for _, c in top] or [0]) + 0.5)
        self.weights = np.zeros((BUCKETS, CLASSES), np.float32)

    def class_of(self, e: bytes) -> int:
        k = self.own.get(e)
        return OWN_CLASSES + zlib.crc32(e) % (CLASSES - OWN_CLASSES) if k is None else k

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the tokens; of a word that is not among the top ones minus 1 minus a hash."""
        codes = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(codes < 0):
            codes[i] = -1 - zlib.crc32(words[i])
        return codes

    def classes(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        out = self.word_class[np.maximum(codes, 0)]
        for i in np.flatnonzero(codes < 0):
            out[i] = self.class_of(ending(words[i]))
        return out

    def features(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Buckets of the features of each token; texts begin where ``first`` holds."""
        h = (codes + (1 << 33)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        start = np.uint64(0x5851F42D4C957F2D)
        one = np.where(first, start, np.concatenate([[start], h[:-1]]))
        two = np.where(first, start, np.concatenate([[start], one[:-1]]))
        both = (one ^ (two >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
        skip = two * np.uint64(0x165667B19E3779F9)
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        return np.stack([x >> shift for x in (one, skip, both)]).astype(np.int64)

    def probabilities(self, at: np.ndarray) -> np.ndarray:
        z = self.weights[at[0]] + self.weights[at[1]]
        z += self.weights[at[2]]
        z += self.prior
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z


def add_expected(p: np.ndarray, at: np.ndarray, into: np.ndarray) -> None:
    """Add the predictions ``p`` of all tokens to their buckets in ``into`` (classes x buckets), class by class."""
    for k, column in enumerate(np.ascontiguousarray(p.T, np.float64)):
        for f in at:
            into[k] += np.bincount(f, column, BUCKETS)


def _packs(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Texts in packs of about BLOCK tokens: places in the batch order and their tokens."""
    at, rows, texts, size = 0, [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), contents(b.column(1))):
            if not (training and held_out(doc_id)):
                words = tokens(text)
                rows.append(at)
                texts.append(words)
                size += len(words)
                if size >= BLOCK:
                    yield rows, texts
                    rows, texts, size = [], [], 0
            at += 1
    if rows:
        yield rows, texts


def _arrays(model: Model, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words = [w for t in texts for w in t]
    codes = model.coded(words)
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(words), bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    return words, codes, model.classes(words, codes), model.features(codes, first), ends - np.array([len(t) for t in texts])


def _gradient(batches: Iterator[pa.RecordBatch], shared, start: bool) -> Iterator[pa.RecordBatch]:
    """Observed minus expected counts, and expected counts, per bucket and class."""
    model: Model = shared.value
    observed = np.zeros((BUCKETS, CLASSES))
    expected = np.zeros((CLASSES, BUCKETS)).T
    tokens_of = np.zeros(BUCKETS)
    for _, texts in _packs(batches, training=True):
        _, _, cls, at, _ = _arrays(model, texts)
        for f in at:
            observed += np.bincount(f * CLASSES + cls, minlength=BUCKETS * CLASSES).reshape(BUCKETS, CLASSES)
        if start:
            tokens_of += sum(np.bincount(f, minlength=BUCKETS) for f in at)
            continue
        add_expected(model.probabilities(at), at, expected.T)
    if start:
        expected = tokens_of[:, None] * np.exp(model.prior)[None, :]
    used = np.flatnonzero(observed.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(list((observed - expected)[used].astype(np.float32)), pa.list_(pa.float32())), pa.array(list(expected[used].astype(np.float32)), pa.list_(pa.float32()))],
        ["bucket", "gradient", "expected"],
    )


def fit(docs: DataFrame, epochs: int = EPOCHS, top_words: int = TOP_WORDS) -> tuple[DataFrame, Model]:
    """Counts of the words (a table) and the model, from all training texts of ``docs`` (doc_id, text)."""
    counts = word_counts(docs)
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    # bounded: the most frequent words, and one row for each two-byte ending; the
    # quantile keeps each task from sending its own most frequent words
    often = counts
    if total[1] > top_words:
        often = counts.where(F.col("c") > counts.agg(F.percentile_approx("c", F.lit(1 - top_words / total[1]), F.lit(10_000))).first()[0])
    top = [(bytes(r.word), r.c) for r in often.orderBy(F.desc("c"), "word").limit(top_words).collect()]
    size = F.octet_length("word")
    tail = F.when(size > 2, F.substring("word", size - 1, F.lit(2))).otherwise(F.col("word"))
    endings = counts.groupBy(tail.alias("e")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()
    model = Model(top, [(bytes(r.e), r.m) for r in endings], total[0] or 0, total[1])
    spark = docs.sparkSession
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(model)
        rows = docs.select("doc_id", "text").mapInArrow(partial(_gradient, shared=shared, start=epoch == 0), "bucket int, gradient array<float>, expected array<float>")
        sums = rows.groupBy("bucket").agg(*[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("gradient", "expected") for k in range(CLASSES)])
        table = np.array(sums.toPandas(), dtype=np.float64).reshape(-1, 1 + 2 * CLASSES)  # at most BUCKETS rows
        at, g, e = table[:, 0].astype(np.int64), table[:, 1 : 1 + CLASSES], table[:, 1 + CLASSES :]
        # three features share the step
        model.weights[at] += np.clip(g / (3 * (e + DAMPING)), -1.5, 1.5).astype(np.float32)
    return counts, model


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Per text: what the top words give, and its other words with their number."""
    model: Model = shared.value

    def kept(source):
        for b in source:
            ids.extend(b.column(0).to_pylist())
            yield b

    ids: list = []
    done = 0
    for rows, texts in _packs(kept(batches), training=False):
        words, codes, cls, at, starts = _arrays(model, texts)
        p = model.probabilities(at)
        in_class = np.log10(p[np.arange(len(cls)), cls].astype(np.float64)) - model.log_mass[cls]
        known = codes >= 0
        log_count = np.where(known, model.log_count[np.maximum(codes, 0)], 0.0)
        base = np.add.reduceat(log_count, starts)
        score = base + np.add.reduceat(in_class, starts)
        n_known = np.add.reduceat(known.astype(np.int64), starts)
        lengths = [len(t) for t in texts]
        unknown = np.flatnonzero(~known)
        cuts = np.searchsorted(unknown, [*starts, len(words)])
        others = []
        for a, b in zip(cuts, cuts[1:]):
            rare = Counter(words[i] for i in unknown[a:b])
            others.append([{"word": w, "times": c} for w, c in rare.items()])
        own = [ids[r - done] for r in rows]
        del ids[: rows[-1] + 1 - done]
        done = rows[-1] + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own, pa.int64()),
                pa.array([held_out(i) for i in own]),
                pa.array(lengths, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array(base),
                pa.array(score),
                pa.array(others, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"],
        )


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, others array<struct<word:binary,times:bigint>>"
    first = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_score, shared=shared), schema)
    first = written(first.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = first.select("rid", F.inline("others"))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    return first.join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(model.norm)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def lm_scores(docs: DataFrame, epochs: int = EPOCHS, top_words: int = TOP_WORDS) -> DataFrame:
    """Learn from the training fold of ``docs`` (doc_id, text) and score all of it.

    Tokens are words with A-Z lower-cased, and an end.  A null text is empty and
    has the end alone.  A null id counts as an empty text when the fold is
    told.  Rows that repeat are learned from and scored each.  Other columns
    are ignored.  Without training texts every word is unknown.
    """
    counts, model = fit(docs, epochs, top_words)
    return score(docs, counts, model)
