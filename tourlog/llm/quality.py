"""Quality rules judged by an isolation forest.

Every text gets a few rule statistics.  An isolation forest grown on a bounded
sample of labelled rows measures how few random splits part a document from
the others; the threshold on that score is calibrated on the same labelled
rows.  A document fails if the plain limits fail or the forest finds it odd.

The forest is of fixed size (TREES trees of at most 2 * SAMPLE nodes) and is sent
to the workers; all documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.llm.words import contents, pieces

TREES = 100
SAMPLE = 256
# labelled rows that the forest and its threshold are made from, at most
LABELLED_ROWS = 20_000
# cost of a rejected clean document against a kept bad one
CLEAN_COST = 2.0
MIN_WORDS = 50
REPEAT_PERCENT = 50

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    v = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    pairs = v[:-2] * size + v[1:-1]
    if size >= 1 << 21:  # keep the product below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * size + v[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Counts in the order of STATS, and the features of the forest."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * 4
    raw = np.frombuffer(text, np.uint8)
    chars = int((~_SPACE[raw] & ((raw & 0xC0) != 0x80)).sum())
    symbols = int(_SYMBOL[raw].sum())
    lines = [x for x in text.split(b"\n") if x.split()]
    repeats = repeated_words(words)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    features = [min(symbols / n, 1.0), repeats / n, upper / (upper + lower + 1), min(chars / n, 20.0)]
    return [n, chars, symbols, len(lines) - len(set(lines)), repeats], features


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts (doc_id, quality, text)."""
    for b in pieces(batches):
        rows = [statistics(t) for t in contents(b.column(2))]
        failed = [base_failed(s) for s, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column(1), pa.array(failed), pa.array([f for _, f in rows], pa.list_(pa.float64()))], ["quality", "base_failed", "features"]
        )


def base_failed(stats: list[int]) -> bool:
    return stats[0] < MIN_WORDS or 100 * stats[4] > REPEAT_PERCENT * stats[0]


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes); a leaf has itself as child."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    threshold: float = math.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores: near 1 after short paths, below a half after long ones."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(SAMPLE))):
                right = x[rows, self.feature[t, node]] >= self.split[t, node]
                node = self.child[t, node, right.astype(np.int64)]
            total += self.length[t, node]
        return 2.0 ** (-total / max(len(self.feature), 1) / _path(SAMPLE))


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    depth, size = int(math.log2(SAMPLE)), 2 * SAMPLE
    f = Forest(np.zeros((TREES, size), np.int64), np.full((TREES, size), np.inf), np.zeros((TREES, size, 2), np.int64), np.zeros((TREES, size)))
    for t in range(TREES):
        start = x[rng.choice(len(x), min(SAMPLE, len(x)), replace=False)]
        todo, used = [(0, start, 0)], 1
        while todo:
            node, rows, level = todo.pop()
            f.child[t, node] = node
            f.length[t, node] = level + _path(len(rows))
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if level == depth or not len(spread):
                continue
            k = int(rng.choice(spread))
            at = rng.uniform(rows[:, k].min(), rows[:, k].max())
            low = rows[:, k] < at
            if not low.any() or low.all():
                continue
            f.feature[t, node], f.split[t, node], f.child[t, node] = k, at, (used, used + 1)
            todo += [(used, rows[low], level + 1), (used + 1, rows[~low], level + 1)]
            used += 2
    return f


def calibrated(scores: np.ndarray, good: np.ndarray, clean_cost: float) -> float:
    """The score above which documents go: most bad ones found for the clean ones lost."""
    if not good.any() or good.all():
        return math.inf
    order = np.argsort(-scores, kind="stable")
    found = np.cumsum(~good[order]) / (~good).sum() - clean_cost * np.cumsum(good[order]) / good.sum()
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # equal scores go together
    best = int(np.argmax(np.where(last, found, -np.inf)))
    if found[best] <= 0:
        return math.inf
    rest = scores[order][best + 1] if best + 1 < len(order) else scores[order][best] - 1e-9
    return float((scores[order][best] + rest) / 2)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, seed: int = 3, clean_cost: float = CLEAN_COST) -> Forest | None:
    """Forest and threshold from at most ``labelled_rows`` labelled documents, chosen by a hash of the id.

    Labels without id or quality are left out; of an id with several the
    smallest counts.  None if no labelled document is found.
    """
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(labelled_rows)
    # at most labelled_rows pairs of numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(_measure, "quality int, base_failed boolean, features array<double>").limit(2 * labelled_rows).collect()
    rows = sorted((tuple(r.features), r.quality == 1) for r in rows if not r.base_failed)
    if not rows:
        return None
    x = np.array([f for f, _ in rows])
    good = np.array([g for _, g in rows])
    forest = grow(x, seed)
    forest.threshold = calibrated(forest.scores(x), good, clean_cost)
    return forest


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with the statistics, base_failed, anomaly and kept.

    A null or empty text has no words and fails.  Columns of ``docs`` that have
    the name of an added one are replaced.  Without labelled rows only the plain
    limits decide.
    """
    forest = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [statistics(t) for t in contents(b.column(b.schema.get_field_index("text")))]
            if not rows:
                continue
            failed = np.array([base_failed(s) for s, _ in rows])
            odd = forest.value.scores(np.array([f for _, f in rows])) if forest.value else np.zeros(len(rows))
            limit = forest.value.threshold if forest.value else math.inf
            added = [pa.array([s[k] for s, _ in rows], pa.int64()) for k in range(5)]
            added += [pa.array(failed), pa.array(odd), pa.array(~failed & (odd <= limit))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + added, names + new)

    new = [*STATS, "base_failed", "anomaly", "kept"]
    names = [c for c in docs.columns if c not in new]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{s} bigint" for s in STATS] + ["base_failed boolean", "anomaly double", "kept boolean"])
    return docs.select(*names).mapInArrow(score, schema)
