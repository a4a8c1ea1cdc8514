"""N-gram Jaccard join by an index of count vectors.

A document's set holds the hashes of its distinct word n-grams.  The hashes are
dealt into groups; the counts per group are a point, and the size of an
intersection is at most the sum of the smaller coordinates.

The index has two levels.  A tree of boxes over all points can not part texts
of natural language (in hundreds of coordinates all boxes meet), so its upper
level is exact: with sizes in one band, two sets that link differ in at most D
elements, so of D + 1 groups (and half as many spare ones) they agree in at
least one of the larger groups of both.  Documents that agree in such a group
(count and content) are in the same cell; cells that share documents form a family.  Links run only inside
families, and only cells move, never pairs.  Below, each family is a tree:
its points are packed by size into leaves of bounded size, leaves have boxes
(largest counts, range of sizes), and leaf by leaf the bound discards points
whose summed minima fall short; what is left is verified on the whole sets.
A task stops comparing documents that a verified link has joined already, so a
group of k near copies costs about k verifications.

Equal sets are one class from the start, so copies of any number are one point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tourlog.llm.components import components
from tourlog.llm.likely import likely
from tourlog.llm.storage import written
from tourlog.llm.words import LOWER, WordHashes, contents, hashes, mixed, pieces

# coordinates of a point, as bits of the hash
GROUP_BITS = 6
# points of a leaf
LEAF = 256
# width of the bands of sizes (in the logarithm), at least one step of the threshold
BAND = 0.45
# sizes that differ by this factor lie in different leaves
LEAF_STEP = 1.02

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes, n: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words as one if they are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words, table)
    if len(h) < n:
        total = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            total = mixed(total * _ODD[0] + h[k : k + 1])
        return total
    size = len(h) - n + 1
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total = mixed(total * _ODD[0] + h[k : k + size])
    return np.unique(total)


def needed(a: float, b: float, percent: int) -> float:
    """The least intersection with which sets of these sizes link."""
    return percent * (a + b) / (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, D) of a set: a pair that can link shares one, and differs there in at most D elements.

    Bands follow each other without gaps; sets near a border also take part in
    a band around that border.
    """
    r = 100 / percent
    step = max(1, math.floor(BAND / math.log(r))) * math.log(r)
    k = math.floor(math.log(size) / step + 1e-12)
    out = [(2 * k, math.exp((k + 1) * step))]
    for border in (k, k + 1):
        at = math.exp(border * step)
        if at / r * 0.999 <= size <= at * r * 1.001:
            out.append((2 * border + 1, at * r * 1.001))
    # sets that link differ in at most (a + b)(1 - t) / (1 + t) elements
    return [(b, math.floor(2 * high * (100 - percent) / (100 + percent) + 1e-9)) for b, high in out]


def _spare(d: int) -> int:
    """Groups beyond what must agree, so that a set need not list its smallest groups."""
    return (d + 1) // 2


def cells(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the cells of a set: one for each of its larger groups in each band.

    With D + 1 + E groups, sets that link agree in E + 1 at least.  Each set lists
    its groups of at least m elements, m as large as leaves out E groups at most.
    So of E + 1 groups in which two sets agree the largest is listed by both, and
    small groups, in which unrelated texts agree by one common phrase, by none.
    """
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s), dtype=np.uint64)])
    for band, d in bands(len(s), percent):
        groups = d + 1 + _spare(d)
        edges = (np.arange(groups + 1, dtype=np.float64) / groups * 2.0**64)[1:-1].astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        count = np.diff(at).astype(np.uint64)
        content = sums[at[1:]] - sums[at[:-1]]
        place = np.uint64((band << 32) % 2**64) + np.arange(groups, dtype=np.uint64)
        keys = mixed(mixed(content + count * _ODD[1]) + place * _ODD[2])
        out.append(keys[count >= np.sort(count)[_spare(d)]])
    return np.concatenate(out)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Facts of each text: id, hash, size of its set and class key."""
    table = WordHashes()
    for b in pieces(batches):
        sets = [shingles(text, n, table) for text in contents(b.column(1))]
        keys = [class_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())],
            ["doc_id", "text_hash", "size", "c1", "c2"],
        )


def _cells(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Cells of texts: class key and keys of the cells, once for each class in the task."""
    table = WordHashes()
    seen: set[tuple[int, int]] = set()
    for b in pieces(batches):
        one, keys = [], []
        for text in contents(b.column(0)):
            s = shingles(text, n, table)
            key = class_key(s)
            if len(s) and key not in seen:
                seen.add(key)
                one.append(key[0])
                keys.append(cells(s, percent).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["c1", "cells"])


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    size = np.uint64(len(s))
    a, b = mixed(np.array([mixed(s * _ODD[3]).sum(dtype=np.uint64) + size, mixed(s * _ODD[4] + _ODD[1]).sum(dtype=np.uint64) ^ size], np.uint64)).view(np.int64)
    return int(a), int(b)


def _wanted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, c1, c2, facts of the point): the facts and the text, if it is of that class."""
    table = WordHashes()
    for b in pieces(batches):
        sets = [shingles(t, n, table) for t in contents(b.column(0))]
        right = [class_key(s) == key for s, key in zip(sets, zip(b.column(1).to_pylist(), b.column(2).to_pylist()))]
        out = pa.RecordBatch.from_arrays([b.column(c) for c in (*range(3, b.num_columns), 0)], [*b.schema.names[3:], "text"])
        yield out.filter(pa.array(right, pa.bool_()))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, c1) sorted by both: a link from each member of a cell to its first."""
    last, hub = None, None
    for b in batches:
        if not b.num_rows:
            continue
        cell, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        start = np.empty(len(cell), bool)
        start[0] = last is None or cell[0] != last
        start[1:] = cell[1:] != cell[:-1]
        run = np.cumsum(start)
        hubs = np.concatenate([[hub if hub is not None else 0], c[start]])[run]
        last, hub = cell[-1], hubs[-1]
        off = hubs != c
        pairs = np.unique(np.stack([hubs[off], c[off]], 1), axis=0) if off.any() else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _points(sets: list[np.ndarray]) -> np.ndarray:
    shift = np.uint64(64 - GROUP_BITS)
    return np.stack([np.bincount((s >> shift).astype(np.int64), minlength=1 << GROUP_BITS) for s in sets]).astype(np.int64)


def leaf_links(sets: list[np.ndarray], side: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links inside a leaf (sides 0), or between two (0 and 1): enough of them to join what links join.

    ``comp`` names components known before; pairs inside one are not looked at.
    """
    size = np.array([len(s) for s in sets])
    points = _points(sets)
    comp = comp.copy()
    order = np.argsort(size, kind="stable")
    out = []
    for place, i in enumerate(order):
        before = order[:place]
        before = before[(size[before] * 100 >= percent * size[i]) & (comp[before] != comp[i])]
        if side[i]:
            before = before[side[before] == 0]
        if not len(before):
            continue
        bound = np.minimum(points[before], points[i]).sum(1)
        near = bound * (100 + percent) >= percent * (size[before] + size[i])
        before, bound = before[near], bound[near]
        for j in before[np.argsort(-bound, kind="stable")]:
            if comp[j] == comp[i]:
                continue
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * both >= percent * (size[i] + size[j] - both):
                out.append((int(i), int(j)))
                comp[comp == comp[i]] = comp[j]
    return out


def _leaves(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, k, comp, side, text) sorted by leaf: links of each leaf."""
    table = WordHashes()
    rows: list = []
    leaf = None

    def links() -> pa.RecordBatch:
        sets = [r[3] for r in rows]
        found = leaf_links(sets, np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), percent)
        k = [r[0] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for i, _ in found], pa.int64()), pa.array([k[j] for _, j in found], pa.int64())], ["a", "b"])

    for b in pieces(batches):
        leaf_col = b.column(0).to_pylist()
        rest = zip(*(b.column(c).to_pylist() for c in range(1, 4)), contents(b.column(4)))
        for at, (k, comp, side, text) in zip(leaf_col, rest):
            if at != leaf:
                if len(rows) > 1:
                    yield links()
                rows, leaf = [], at
            if not rows or rows[-1][0] != k:
                rows.append((k, comp, side, shingles(text, n, table)))
    if len(rows) > 1:
        yield links()


def _boxes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, text): one box for each leaf in a batch, combined later."""
    table = WordHashes()
    for b in pieces(batches):
        leaf = np.array(b.column(0).to_pylist(), dtype=object)
        points = _points([shingles(x, n, table) for x in contents(b.column(1))]) if b.num_rows else None
        for at in dict.fromkeys(leaf):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([points[leaf == at].max(0)], pa.list_(pa.int64()))], ["leaf", "top"])


def _in_leaves(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of rows (leaf, k, comp, side, text); texts move, as their sets are larger and do not compress."""
    near = rows.select("leaf", "k", "comp", "side", "text").repartition("leaf").sortWithinPartitions("leaf", "k")
    return near.mapInArrow(partial(_leaves, n=n, percent=percent), "a long, b long")


def classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Facts of each row (doc_id, text_hash, size, c1, c2), and the classes of equal sets (k, c1, c2, size, doc_id, comp).

    comp is the smallest k that the links of the threshold reach; a class of the
    empty set is none.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    facts = written(texts.mapInArrow(partial(_sets, n=n), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, size long, c1 long, c2 long"), "sets")
    one_text = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash")
    groups = facts.where("size > 0").groupBy("c1", "c2").agg(F.min("size").alias("size"), F.min("doc_id").alias("doc_id"), one_text)
    groups = written(groups.withColumn("k", F.monotonically_increasing_id()), "classes")

    # cells are more than the texts they are of: they are made once more rather than kept
    rows = texts.select("text").mapInArrow(partial(_cells, n=n, percent=percent), "c1 long, cells array<long>").select(F.explode("cells").alias("cell"), "c1")
    stars = rows.repartition("cell").sortWithinPartitions("cell", "c1").mapInArrow(_stars, "a long, b long").distinct()
    families = components(written(stars, "stars"))

    # leaves: a small family is one; a large one is parted by size, then evenly by chance
    near = groups.join(families.select(F.col("node").alias("c1"), F.col("comp").alias("family")), "c1")
    near = near.join(near.groupBy("family").agg((F.count(F.lit(1)) > LEAF).alias("large")), "family")
    near = written(near.withColumn("bin", F.when(F.col("large"), F.floor(F.log("size") / math.log(LEAF_STEP))).otherwise(0).cast("int")), "near")
    bins = written(near.where("large").groupBy("family", "bin").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("parts")), "bins")
    leaf = lambda family, b, p: F.concat_ws("/", family, b, p)
    part = F.pmod(F.xxhash64("k"), F.coalesce("parts", F.lit(1))).cast("int")
    near = near.join(bins, ["family", "bin"], "left").withColumn("part", part).withColumn("leaf", leaf(F.col("family"), F.col("bin"), F.col("part")))

    # one text of each class carries its facts on; rows that repeat wholly come twice, and leaves pass over them
    kept = ["k", "size", "family", "bin", "part", "leaf", "large"]
    wanted = near.select("c1", "c2", *kept, F.col("doc_id").alias("want"), F.col("text_hash").alias("want_hash"))
    sought = likely(texts, near, "doc_id", "text_hash").join(wanted, F.col("text_hash").eqNullSafe(F.col("want_hash")) & F.col("doc_id").eqNullSafe(F.col("want")))
    shape = "k long, size long, family long, bin int, part int, leaf string, large boolean, text string"
    members = written(sought.select("text", "c1", "c2", *kept).mapInArrow(partial(_wanted, n=n), shape), "members")

    # each leaf in itself, and with the next one of its family as guests
    chain = Window.partitionBy("family").orderBy("bin", "part")
    before = bins.select("family", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    before = before.withColumn("before", F.lag(F.struct("bin", "part")).over(chain)).where("before is not null")
    rows = members.select("leaf", "k", F.col("k").alias("comp"), F.lit(0).alias("side"), "text")
    guests = members.where("large").drop("leaf").join(before, ["family", "bin", "part"])
    guests = guests.select(leaf(F.col("family"), F.col("before.bin"), F.col("before.part")).alias("leaf"), "k", F.col("k").alias("comp"), F.lit(1).alias("side"), "text")
    links = written(_in_leaves(rows.unionByName(guests), n, percent), "leaf-links")
    found = components(links)

    # what is left of large families: pairs of leaves whose boxes allow a link between two components
    large = members.where("large").select("k", "size", "family", "bin", "leaf")
    large = large.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    torn = large.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
    large = written(large.join(torn, "family", "left_semi"), "torn")
    if not large.isEmpty():
        more = written(_between_leaves(large, members.select("k", "leaf", "text"), n, percent), "more-links")
        found = components(links.unionByName(more))
    groups = groups.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    return facts, groups


def _between_leaves(large: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components in rows (k, size, family, bin, leaf, comp); members have (k, leaf, text)."""
    tops = members.join(large.select("leaf").distinct(), "leaf", "left_semi").select("leaf", "text").mapInArrow(partial(_boxes, n=n), "leaf string, top array<long>")
    tops = tops.select("leaf", F.posexplode("top")).groupBy("leaf", "pos").agg(F.max("col").alias("top"))
    tops = tops.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "top"))), lambda x: x["top"]).alias("top"))
    facts = large.groupBy("leaf").agg(
        *[F.first(c).alias(c) for c in ("family", "bin")], F.min("size").alias("least"), F.max("size").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    boxes = written(facts.join(tops, "leaf"), "boxes")
    reach = math.ceil(math.log(100 / percent) / math.log(LEAF_STEP)) + 1
    a = boxes.select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns], F.explode(F.sequence(F.col("bin"), F.col("bin") + reach)).alias("near_bin"))
    pairs = a.join(boxes, (F.col("a_family") == F.col("family")) & (F.col("near_bin") == F.col("bin")))
    pairs = pairs.where((F.col("a_bin") < F.col("bin")) | (F.col("a_leaf") <= F.col("leaf")))
    pairs = pairs.where(~((F.col("a_lo") == F.col("a_hi")) & (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("a_lo"))))
    pairs = pairs.where((F.col("least") * percent <= F.col("a_most") * 100) & (F.col("a_least") * percent <= F.col("most") * 100))
    bound = F.aggregate(F.zip_with("a_top", "top", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = pairs.where(bound * (100 + percent) >= percent * (F.col("a_least") + F.col("least")))
    pairs = written(pairs.select("a_leaf", "leaf"), "leaf-pairs")
    name = F.concat_ws("|", "a_leaf", "leaf")
    one = pairs.select(name.alias("pair"), F.col("a_leaf").alias("leaf"), F.lit(0).alias("side"))
    two = pairs.where("a_leaf <> leaf").select(name.alias("pair"), "leaf", F.lit(1).alias("side"))
    sides = large.select("leaf", "k", "comp").join(one.unionByName(two), "leaf").drop("leaf").withColumnRenamed("pair", "leaf")
    return _in_leaves(sides.join(members.select("k", "text"), "k"), n, percent)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Sets of word n-grams (A-Z lower-cased) link if 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links reach.  A text with
    fewer than n words is one n-gram of all its words.  Null and empty texts
    have no n-grams, link with nothing and keep their own id.  Ids that repeat
    get a row each; null ids never are the smallest if another is there.
    Elements are 64-bit hashes, sets are told by 128 bits.
    """
    facts, groups = classes(docs, n, percent)
    groups = written(groups.select("c1", "c2", "comp", "doc_id"), "class-components")
    smallest = groups.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(smallest, "comp").select("c1", "c2", "component_id")
    out = facts.drop("text_hash").join(named, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (doc_id, text), one of each component that links make.

    It is the row with the smallest doc_id, null ids last; of rows with that id
    the one whose text has the smallest hash, so ids may repeat or be null: a row
    is told by its id and its text, and of rows that are the same in both one
    stays.  Rows without words stay all.  Columns pass unchanged, but those
    named _id, _hash, _gone or _again may not be there.
    """
    facts, groups = classes(docs, n, percent)
    groups = written(groups.select("c1", "c2", "comp"), "class-components")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = facts.where("size > 0").groupBy("c1", "c2", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    firsts = rows.groupBy("c1", "c2").agg(F.min(place).alias("place")).join(groups, ["c1", "c2"])
    keep = firsts.groupBy("comp").agg(F.min("place").alias("stays"))
    named = firsts.join(keep, "comp").select("c1", "c2", "stays")
    marks = rows.join(named, ["c1", "c2"]).withColumn("gone", ~place.eqNullSafe(F.col("stays"))).where("gone or times > 1")
    marks = written(marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone")), "near-marks")

    here = F.xxhash64(F.coalesce("text", F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (here == F.col("_hash"))
    left = docs.join(marks.where("_gone"), same, "left_anti")
    again = marks.where("not _gone")
    if again.isEmpty():
        return left
    once = left.join(again, same, "left_semi").withColumn("_again", here).dropDuplicates(["doc_id", "_again"]).drop("_again")
    return left.join(again, same, "left_anti").unionByName(once)
