"""Periodic runs of words: a passage said over and over.

A run is a stretch of words with smallest period q, of at least
max(``least``, ``times`` * q) words, that no neighbouring word extends with that
period.  Any run of period q holds three places q apart, the first a multiple
of 2 q; these places of the harmonic grid (n / 2 + n / 4 + n / 6 ... of them) are
the candidates, kept if the three words are equal.  How far a candidate's period
reaches to both sides is read off a recompression grammar of the words.  Texts
are handled where they are read, some at a time in one grammar, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tourlog.llm.recompression import Grammar
from tourlog.llm.words import contents, pieces

# places of the grid, and questions to the grammar, that are worked on at once
GRID_CHUNK = 1 << 20


def grid(n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid of n words, in chunks: multiples of 2 * period, for periods to n / times."""
    periods = np.arange(1, n // times + 1)
    count = (n - 1) // (2 * periods)
    after = np.cumsum(count)
    total = int(after[-1]) if len(after) else 0
    for at in range(0, total, GRID_CHUNK):
        end = min(at + GRID_CHUNK, total)
        low, high = np.searchsorted(after, [at, end - 1], "right")
        before = after[low : high + 1] - count[low : high + 1]
        size = np.minimum(after[low : high + 1], end) - np.maximum(before, at)
        p = np.repeat(periods[low : high + 1], size)
        yield 2 * p * (np.arange(at, end) - np.repeat(before, size)), p


def candidates(words: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grid with three equal words a period apart."""
    found = []
    for i, p in grid(len(words), times):
        hit = np.flatnonzero(words[i] == words[i + p])
        i, p = i[hit], p[hit]
        hit = words[i] == words[i + 2 * p]
        found.append((i[hit], p[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text (words as numbers from 0 on), by start, then period."""
    if times < 4:
        raise ValueError("the grid asks for runs of at least four periods")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts, places, periods, owner, size = [], [], [], [], 0
    for t, words in enumerate(texts):
        i, p = candidates(words, times)
        if len(i):
            parts += [np.array([-1 - len(owner)]), words]  # a mark that equals nothing stands between texts
            places.append(i + size + 1)
            periods.append(p)
            owner.append((t, size + 1))
            size += len(words) + 1
    if not parts:
        return out
    grammar = Grammar(np.concatenate([*parts, [-1 - len(owner)]]).astype(np.int64))
    i, p = np.concatenate(places), np.concatenate(periods)
    found = []
    for at in range(0, len(i), GRID_CHUNK):
        x, q = i[at : at + GRID_CHUNK], p[at : at + GRID_CHUNK]
        start = x - grammar.extensions(x, x + q, back=True)
        length = x + q + grammar.extensions(x, x + q) - start
        long = length >= np.maximum(least, times * q)
        found.append(np.column_stack([start, length, q])[long])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # of one stretch the smallest period; larger ones are multiples of it
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    begins = np.array([b for _, b in owner])
    for k, (start, length, q) in zip((np.searchsorted(begins, rows[:, 0], "right") - 1).tolist(), rows.tolist()):
        t, begin = owner[k]
        out[t].append((start - begin, length, q))
    for rows_of_text in out:
        rows_of_text.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what a run holds after its first period, joined by one space."""
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            cover[start + period] += 1
            cover[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period) and collapsed.

    Words are what white space (``[\\x20\\x09-\\x0D]``) parts, numbered from 0; runs
    are sorted by start, then period; ``collapsed`` has the words that no run
    repeats, joined by one space.  A null or empty text has no words, no runs and
    the empty text.  Runs may overlap; of one stretch only the smallest period
    counts.  Repeated rows each have their own result; an empty table gives an
    empty one; columns of ``docs`` with the name of an added one are replaced.
    """
    added = ["n_words", "runs", "collapsed"]
    names = [c for c in docs.columns if c not in added]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    carried = names if "text" in names else [*names, "text"]
    item = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = [t.split() for t in contents(b.column(b.schema.get_field_index("text")))]
            ids: dict[bytes, int] = {}
            coded = [np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64) for ws in words]
            found = runs_of(coded, least, times)
            listed = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]
            out = [
                pa.array([len(ws) for ws in words], pa.int64()),
                pa.array(listed, pa.list_(item)),
                pa.array([collapsed(ws, rs) for ws, rs in zip(words, found)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + out, names + added)

    schema = "".join(f"`{c}` {kinds[c]}, " for c in names)
    return docs.select(*carried).mapInArrow(
        run, schema + "n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
    )
