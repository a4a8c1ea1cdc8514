"""Licence scan of a tree of files.

Each line is searched for spans of words that licence notices use; a span is
compared with all templates by the cosine of their sparse TF-IDF vectors.  A
file has the licence of its best span (its header, wherever it stands).  A file
that is named like one, or whose words are licence words to a good part, is the
licence file of its directory.  A file without a licence inherits that of the
nearest directory above it that has one, found by joins on directory paths.

Texts are read twice where they lie (document frequencies of the template words,
then scores) and never shuffled; directories with their licences are one row
each, so a directory may hold most files.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.llm.storage import written
from tourlog.llm.words import contents

# fixed values: notices by licence
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
]
COMMON = frozenset(b"a all and any are by following for in is it may not of or that the this to under use with without work you".split())
WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9]+)*")
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
COSINE = 0.75
# licence words in all words, above which a file is a licence file
FILE_SHARE = 0.25
# words that a span may hold between two words of templates
GAP = 2


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _vocabulary(templates: list[tuple[str, str]]) -> frozenset[bytes]:
    return frozenset(w for _, t in templates for w in words_of(t.encode()))


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    n, df = 0, Counter()
    for b in batches:
        for text in contents(b.column(0)):
            n += 1
            df.update(vocabulary.intersection(words_of(text)))
    df[b""] = n
    yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(df.values(), pa.int64())], ["word", "n"])


class Scanner:
    """Templates as weighted vectors; a word outside all templates weighs like one that no file has."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[bytes, int], files: int):
        self.vocabulary = _vocabulary(templates)
        self.seeds = self.vocabulary - COMMON
        self.rare = 1 + math.log(1 + files)
        self.idf = {w: 1 + math.log((1 + files) / (1 + df.get(w, 0))) for w in self.vocabulary}
        self.templates = [(name, *self._vector(words_of(t.encode()))) for name, t in templates]
        self.having: dict[bytes, list[int]] = defaultdict(list)
        for k, (_, vector, _) in enumerate(self.templates):
            for w in vector:
                if w in self.seeds:
                    self.having[w].append(k)

    def _vector(self, words: list[bytes]) -> tuple[dict[bytes, float], float]:
        v = {w: c * self.idf.get(w, self.rare) for w, c in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def spans(self, words: list[bytes]) -> Iterator[list[bytes]]:
        """Runs of template words with at most GAP others between two, that hold a seed."""
        run: list[bytes] = []
        end = -1
        for i, w in enumerate(words):
            if w in self.vocabulary:
                if run and i - end <= GAP + 1:
                    run += words[end + 1 : i + 1]
                else:
                    if run and not self.seeds.isdisjoint(run):
                        yield run
                    run = [w]
                end = i
        if run and not self.seeds.isdisjoint(run):
            yield run

    def best(self, span: list[bytes]) -> tuple[float, str]:
        """Highest cosine and its licence; of equal ones the name that comes first."""
        v, norm = self._vector(span)
        found = (0.0, "")
        for k in {k for w in v for k in self.having.get(w, ())}:
            name, t, length = self.templates[k]
            cosine = sum(x * t[w] for w, x in v.items() if w in t) / (norm * length)
            if (-cosine, name) < (-found[0], found[1]):
                found = (cosine, name)
        return found

    def scan(self, text: bytes) -> tuple[str | None, float, float]:
        """Licence, cosine and share of licence words of a file; a line's span or a part of it may match."""
        total, matched, best = 0, 0, (0.0, "")
        for line in text.split(b"\n"):
            words = words_of(line)
            total += len(words)
            if self.seeds.isdisjoint(words):
                continue
            for span in self.spans(words):
                cosine, name, size = max(((*self.best(s), len(s)) for s in self._parts(span)), key=lambda x: x[:2])
                if cosine >= COSINE:
                    matched += size
                    if (-cosine, name) < (-best[0], best[1] or "~"):
                        best = (cosine, name)
        return (best[1] or None), best[0], matched / total if total else 0.0

    def _parts(self, span: list[bytes]) -> Iterator[list[bytes]]:
        """The span, and from its first seed to its last with the common words next to them cut."""
        yield span
        at = [i for i, w in enumerate(span) if w in self.seeds]
        yield span[at[0] : at[-1] + 1]


def _scan(batches: Iterator[pa.RecordBatch], scanner) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scanner.value.scan(t) for t in contents(b.column(2))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())],
            ["doc_id", "path", "own", "cosine", "share"],
        )


def directory(path):
    """The directory of a path; empty at the top."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def scan_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, licence, found, cosine, licence_file, inherited_from.

    found is header, inherited or none.  A null text is empty and has no licence
    of its own; a null path has no directory and inherits nothing.  Several
    licence files in a directory: the highest cosine counts, then the name
    that comes first.  Rows that repeat are files each.
    """
    vocabulary = _vocabulary(templates)
    counted = files.select("text").mapInArrow(partial(_frequencies, vocabulary=vocabulary), "word binary, n long")
    df = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # words of the templates alone
    scanner = files.sparkSession.sparkContext.broadcast(Scanner(templates, df, df.pop(b"", 0)))
    kind = files.schema["doc_id"].dataType.simpleString()
    hits = files.select("doc_id", F.col("path").cast("string").alias("path"), "text").mapInArrow(
        partial(_scan, scanner=scanner), f"doc_id {kind}, path string, own string, cosine double, share double"
    )
    named = F.col("path").rlike(LICENCE_FILE)
    is_file = F.col("own").isNotNull() & (F.coalesce(named, F.lit(False)) | (F.col("share") >= FILE_SHARE))
    hits = written(hits.select("*", is_file.alias("licence_file"), F.monotonically_increasing_id().alias("rid")), "licence-hits")

    grants = hits.where("licence_file and path is not null").groupBy(directory(F.col("path")).alias("dir"))
    grants = grants.agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("given"))).alias("g")).select("dir", "g.given")
    bare = hits.where("own is null and path is not null").select("rid", directory(F.col("path")).alias("at"))
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = bare.select("rid", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("dir"))
    nearest = above.join(grants, "dir").groupBy("rid").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "given")).alias("n")).select("rid", "n.dir", "n.given")
    return hits.join(nearest, "rid", "left").select(
        "doc_id",
        "path",
        F.coalesce("own", "given").alias("licence"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("found"),
        "cosine",
        "licence_file",
        F.col("dir").alias("inherited_from"),
    )
