"""The training-data operators against plain versions, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tourlog.llm import bpe, exact_dedup, html_text, jaccard, licences, line_dedup, lm, mixing, quality, sharding
from tourlog.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")
BASE = [f"w{k}" for k in range(60)]


def words(text):
    return [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def odd_texts(seed=1, n=60):
    """Random texts with near copies, equal texts, nulls, empty and very long ones."""
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "One", "two words", "é́ ß", "x" * 70_000, "a b c " * 9_000]
    while len(out) < n:
        t = [rng.choice(BASE) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))]
        out.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            u = list(t)
            for _ in range(rng.randrange(4)):
                u[rng.randrange(len(u))] = "new"
            out.append(rng.choice([" ", "\n"]).join(u))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "junk", k % 3) for k, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, size int").repartition(3)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(odd_texts()))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# exact dedup

@pytest.mark.parametrize("block,buckets", [(16384, None), (5, None), (5, 3)])
def test_exact_dedup(docs, texts, block, buckets):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, block, buckets).collect()}
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[SPACE.sub("", t or "")].append(k)
    assert len(got) == len(texts)
    for content, ids in groups.items():
        keep = min(ids, key=lambda k: (-len(texts[k] or ""), k))
        sha = hashlib.sha256(content.encode()).hexdigest()
        for k in ids:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), k == keep, sha)


def test_exact_dedup_repeated_rows(spark, empty):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (None, None)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(1, True), (3, False), (3, False), (3, True)]
    assert exact_dedup.exact_dedup(empty).count() == 0


# BPE

@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_is_the_library(docs, texts, empty, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    for r in bpe.encode_texts(docs, vocabulary).collect():
        e = library.encode(texts[r.doc_id] or "", add_special_tokens=False)
        assert r.token_ids == e.ids and r.n_tokens == len(e.ids)
        assert r.decoded == library.decode(e.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert (r.name, r["size"]) == ("junk", r.doc_id % 3)
    assert bpe.encode_texts(empty, vocabulary).count() == 0


def test_bpe_hypothesis(vocabulary):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary), bpe.WordBpe(open(vocabulary, encoding="utf-8").read())
    letters = st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "M"), max_codepoint=0x2FFF)

    @settings(max_examples=150, deadline=None)
    @given(st.one_of(st.text(letters, max_size=60), st.text("abcdeinthro's<|>endoftext ", max_size=80)))
    def same(text):
        ids = b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
        assert own.encode(text.encode())[1] == ids

    same()


# LM

def test_lm_base_and_normal(docs, texts, empty):
    got = {r.doc_id: r for r in lm.lm_scores(docs, top_words=50).collect()}
    tokens = {k: [*words(t), " "] for k, t in texts.items()}
    train = Counter(w for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in t)
    n, v = sum(train.values()), len(train)
    for k, t in tokens.items():
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[k]
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(train[w] > 0 for w in t), n)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 1) and r.score < 0
    assert lm.lm_scores(empty).count() == 0


def test_lm_learns_order(spark):
    """A language of fixed word pairs: the model must beat single words on unseen texts, and sum to one."""
    rng = random.Random(3)
    pairs = [("ra", "to"), ("mi", "ke"), ("so", "lu"), ("ne", "va")]
    rows = [(k, " ".join(w for _ in range(40) for w in rng.choice(pairs))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, model = lm.fit(docs)
    held = [r for r in lm.score(docs, counts, model).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
    codes = model.coded([b"ra", b"to", lm.END])
    p = model.probabilities(model.features(codes, np.array([True, False, False])))
    assert p.sum(1) == pytest.approx(1, abs=1e-5)


# quality

def plain_statistics(text):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


@pytest.mark.parametrize("labelled", [True, False])
def test_quality_statistics(spark, docs, texts, empty, labelled):
    labels = spark.createDataFrame([(k, k % 2) for k in texts if labelled] + [(None, 1), (3, None)], "doc_id long, quality int")
    for r in quality.judge(docs, labels).collect():
        want = plain_statistics(texts[r.doc_id])
        assert [r[c] for c in quality.STATS] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        assert labelled or r.kept != r.base_failed
    assert quality.judge(empty, labels).count() == 0


def test_forest_finds_odd_rows(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        t = [rng.choice(BASE) + rng.choice(BASE) for _ in range(80)]
        rows.append((k, " ".join(x.upper() + "!!" for x in t) if k % 10 == 0 else " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 != 0)) for k in range(0, 200)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert sum(kept[k] for k in kept if k % 10 == 0) == 0
    # the threshold comes from 180 clean rows: nine in ten of all clean ones stay
    assert sum(kept[k] for k in kept if k % 10) >= 0.9 * 360


# mixing

def test_mix_deviates_by_less_than_a_block(spark):
    sources = ["a"] * 400 + ["b"] * 150 + [None] * 90 + ["unweighted"] * 20
    docs = spark.createDataFrame([(k, s, "n") for k, s in enumerate(sources)], "doc_id long, source string, note string").repartition(4)
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), (None, 0.2)], "source string, weight double")
    rows = mixing.mix(docs, weights, block_rows=4, period=10).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sources)))
    blocks = {r.mix_slot: r.source for r in rows if r.in_mix}
    assert sorted(blocks) == list(range(len(blocks)))
    share, seen = {"a": 0.5, "b": 0.3, None: 0.2}, Counter()
    for slot in range(len(blocks)):
        seen[blocks[slot]] += 1
        assert all(abs(seen[s] - share[s] * (slot + 1)) < 1 for s in share)
    assert len({(r.mix_slot, r.mix_at) for r in rows if r.mix_slot is not None}) == 640
    assert all(r.mix_slot is None and not r.in_mix for r in rows if r.source == "unweighted")
    # the first source that runs out ends the mix
    assert len(blocks) >= min(100 / 0.5, 38 / 0.3, 23 / 0.2) - 1
    assert mixing.mix(docs.where("doc_id < 0"), mixing.tempered_weights(docs.where("doc_id < 0"))).count() == 0


def test_mix_goes_on_when_a_source_runs_out(spark):
    """A source of one row and a share far below 1/1000 ends nothing, and each phase has its own shares."""
    sources = ["a"] * 700 + ["b"] * 300 + ["rare"]
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string").repartition(3)
    weights = spark.createDataFrame([("a", 0.4), ("b", 0.59999), ("rare", 0.00001)], "source string, weight double")
    rows = mixing.mix(docs, weights, block_rows=2).collect()
    assert sorted(r.doc_id for r in rows if r.mix_slot is not None) == list(range(1001))
    at = {r.mix_slot: r.source for r in rows}
    assert sorted(at) == list(range(501))
    seen = Counter()
    for slot in range(501):
        seen[at[slot]] += 1
        if slot < 249:  # b runs out at slot 250
            assert abs(seen["a"] - 0.4 * (slot + 1)) < 1 and abs(seen["b"] - 0.59999 * (slot + 1)) < 1
    assert seen["b"] == 150 and all(at[slot] != "b" for slot in range(251, 501))
    assert at[500] in ("a", "rare")


def test_pipeline_mix_keeps_every_document(spark):
    import corpus_pipeline

    rows = [(k, "t", s) for k, s in enumerate(["a"] * 70_000 + [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert corpus_pipeline.mix_stage(spark, docs, "").count() == 70_001


# html

def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html():
    article = "<article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text, with commas, and more.<p>Second &lt;one&gt;, it is long enough too.<ul><li>x</article>"
    around = "<nav><a href='/'>Home</a> | <a>About us, the company, and so on.</a></nav><div class=\"ad\">Buy now, today, cheap, cheap!</div>"
    after = "<div id='comments'><p>A comment, by a reader, of some length.</p></div><footer>&copy; me</footer>"
    want = "A & B\nFirst bold text, with commas, and more.\nSecond <one>, it is long enough too.\nx"
    assert html_text.main_text(page(around + article + after)) == want
    bare = "<div><h2>Head</h2><p>" + "Some text, with words. " * 9 + "</p><p>Short.</p></div>"
    assert html_text.main_text(page(around + bare + after)).split("\n") == ["Head", ("Some text, with words. " * 9).strip(), "Short."]
    assert html_text.main_text("") == "" and html_text.main_text("<<<>>&&;<p") is not None
    assert html_text.main_text("<p>" * 3000 + "deep, text.") == "deep, text."


def test_html_class_words_give_way():
    """Words about the page, parts of words and wrapping forms take no article away."""
    want = ("Some text, with words. " * 9).strip()
    text = f"<p>{want}</p>"
    for body in (
        f'<div class="has-sidebar">{text}</div>', f'<div id="page" class="no-header">{text}</div>', f'<article class="side-effects">{text}</article>',
        f'<article class="post related">{text}</article>', f"<form>{text}</form>", f"<noscript>{text}", f"<svg>{text}", f"<p hidden>x, y. Not to be seen here.</p>{text}",
        f'{text}<div style="display: none">Hidden, text. Very hidden.</div>', f'<div class="comments"><p>Hi there, all of you. Fine.</p></div>{text}',
        f'<div class="site-header">My site, it is. Good.</div>{text}',
        f'<form><nav>Home</nav><article>{text}</article><div class="cookie-notice">We use cookies, many. Yes, we do.</div></form>',
    ):
        assert html_text.main_text(page(body)) == want, body
    for start in ('<body class="has-sidebar">', '<body class="single comments-open">', '<main class="content comments">'):
        assert html_text.main_text(start + text) == want


def test_html_quotes_without_a_pair():
    assert html_text.main_text('<p>a, <a title="it>b</a> c.</p>') == "a, b c."
    assert html_text.main_text("<p>x <a title=it's>don't, and so</a>.</p>") == "x don't, and so."
    assert html_text.main_text('<p>x <a title="a > b">y, z</a>.</p>') == "x y, z."


def test_html_depth_costs_no_more_than_length():
    nested = html_text.main_text("<div>text, here " * 20_000)
    assert nested.count("text, here") >= 1 and html_text.main_text("</b>" * 20_000 + "<p>a, b." + "</x>" * 20_000) == "a, b."


def test_html_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, n_chars long, text string")
    assert html_text.extract_pages(empty).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract_pages(empty).isEmpty()


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", page("<p>a, b.</p>"), 2), (None, None, "", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.n_chars, r.text) for r in html_text.extract_pages(pages).collect()) == [(0, ""), (0, ""), (5, "a, b.")]


# lines

def test_line_dedup(spark, docs, texts, empty):
    rows = [(1, "own line of one\nCall 555 now or later today"), (2, "Call 777 now or later today\nx y"), (3, "Call 9 now or later today"), (4, None), (None, "Call 1 now or later today"), (5, "Call 2 now or later today\nother own line here")]
    rows += [(10 + k, f"user {n} went to the market and bought {'tea' if k else 'coffee'} there") for k, n in enumerate(("ann", "bob", "cy"))]
    got = {r.doc_id: r.clean_text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "x y" and got[3] == "" and got[4] == "" and got[None] == "" and got[5] == "other own line here"
    assert all(got[10 + k] == rows[6 + k][1] for k in range(3))  # two fields in the leading words: three leaves
    assert line_dedup.line_dedup(empty).count() == 0
    # lines that are in fewer than three documents stay as they are
    seen = Counter(line for t in texts.values() for line in {*(t or "").split("\n")})
    for r in line_dedup.line_dedup(docs).collect():
        t = texts[r.doc_id] or ""
        assert r.n_lines - r.n_dropped == len(r.clean_text.split("\n")) or not r.clean_text
        if all(seen[line] < 3 for line in t.split("\n")):
            assert r.clean_text == t


def test_equal_lines_of_two_documents(spark, tmp_path):
    """A passage in two documents, and lines without spaces, in the query and in the stage of the pipeline."""
    import corpus_pipeline
    from tourlog.llm.queries import op7_line_dedup

    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    han, thai = "今天天气很好我们去公园散步吧", "วันนี้อากาศดีมากเราไปเดินเล่น"
    rows = [(1, f"one alone here\n{passage}\n{han}"), (2, f"two by itself here\n{passage}\n短句"), (3, f"{han}\n{thai}\n短句"), (4, f"four\n{thai}")]
    want = {1: rows[0][1], 2: "two by itself here\n短句", 3: f"{thai}\n短句", 4: "four"}
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines_stage(spark, docs, "").collect()} == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.clean_sha256 for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


@pytest.mark.parametrize("times", [1, 3])
def test_line_templates_of_large_leaves(spark, times):
    """A template of few names and days is one at any size, next to a rarer one and to prose of the same leaf."""
    days = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
    names = [f"Name{chr(97 + k)}" for k in range(20)]
    lines = [f"Share this article about the local news with {n} on {d}" for n in names for d in days] * times
    lines += [f"Share this article about our own town with {n} on {d}" for n in names[:6] for d in days[:3]] * times
    rng = random.Random(4)
    prose = ["Share this article " + " ".join(rng.choice(BASE[:20]) for _ in range(8)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(lines + prose)), "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in line_dedup.line_dedup(docs).collect()}
    # the rarer template is told by its most frequent field as well, the day
    assert [k for k in range(len(lines)) if got[k]] == [0, *range(140 * times, 140 * times + 3)]
    assert all(got[len(lines) + k] == t for k, t in enumerate(prose))


# sharding

def test_shards(spark, docs, texts, empty):
    rows = sharding.document_shards(docs, bucket_bytes=4096).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    nine = {r.doc_id: r.shard for r in sharding.document_shards(docs, shards=9).collect()}
    assert all(nine[r.doc_id] == r.grown_shard for r in rows)
    assert sharding.document_shards(empty).count() == 0
    same = sharding.document_shards(spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 50, "doc_id long, text string"), bucket_bytes=16).collect()
    assert len(same) == 100 and len({r.shard for r in same}) <= 2


# licences

def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "p/LICENSE", "MIT License. Released under the MIT License."),
        (2, "p/a/b.txt", "some words of no licence at all"),
        (3, "p/a/c.txt", "first line\nthen inside a line: " + apache + " and on it goes with the text" + " of a story" * 20),
        (4, "p/q/COPYING", "All rights reserved."),
        (5, "p/q/r/s.txt", None),
        (6, "other/x.txt", "the license of the fish is under water"),
        (7, None, ""),
        (7, None, "w " * 20_000),
    ]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.licence, r.found, r.inherited_from) for r in got}
    assert by[1][:2] == ("MIT", "header") and by[2] == ("MIT", "inherited", "p") and by[3][:2] == ("Apache-2.0", "header")
    assert by[4][:2] == ("proprietary", "header") and by[5] == ("proprietary", "inherited", "p/q")
    assert by[6] == (None, "none", None) and by[7] == (None, "none", None)
    assert licences.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string").where("doc_id < 0")).count() == 0


# Jaccard

def plain_components(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("n,percent,leaf", [(3, 90, 256), (5, 80, 256), (1, 60, 3)])
def test_jaccard(docs, texts, n, percent, leaf, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, percent).collect()}
    assert got == plain_components(texts, n, percent)


def test_jaccard_odd_tables(spark, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    rows = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (None, "A b c d"), (1, None), (None, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(rows).collect())
    assert got == [(0, 0, 0), (0, 2, 2), (1, 0, 1), (2, 2, 2), (2, 2, 2)]


def test_cells_keep_every_link():
    """Pairs at the threshold, of sizes near the borders of bands, share a cell."""
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        for size in [*range(1, 60), 100, 317, 1000]:
            for _ in range(4):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
                least = math.ceil(percent * len(a) / 100)
                b = np.sort(rng.permutation(a)[:least])  # a subset at the threshold
                if len(b):
                    assert set(jaccard.cells(a, percent)) & set(jaccard.cells(b, percent))


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (60, 50), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 60: 50, 100: 50}


def test_lm_expected_counts_and_codes():
    """Sums of predictions by bucket are those of the tokens one by one, in double precision."""
    rng = np.random.default_rng(5)
    at = np.concatenate([np.zeros((3, 40_000), np.int64), rng.integers(0, lm.BUCKETS, (3, 2_000))], axis=1)
    p = rng.random((at.shape[1], lm.CLASSES), dtype=np.float32)
    want, got = np.zeros((lm.BUCKETS, lm.CLASSES)), np.zeros((lm.CLASSES, lm.BUCKETS))
    for f in at:
        np.add.at(want, f, p.astype(np.float64))
    lm.add_expected(p, at, got)
    assert got.T == pytest.approx(want, rel=1e-12)
    model = lm.Model([(b"ra", 5), (b"to", 5)], [(b"ra", 5.5), (b"to", 5.5)], 10, 2)
    assert (model.coded([b"to", b"xx", b"ra"]) == [1, -1 - zlib.crc32(b"xx"), 0]).all()
