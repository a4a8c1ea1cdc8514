"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that its encoding can end
with.  An automaton over all tokens gives the tokens that match up to each
place; the one whose predecessor (already known) it can follow is stored, and
the back pointers give the ids.  Two tokens can follow each other if no merge
that the encoder would have made earlier crosses the border between them, which
undoing their merges step by step tells.  Work is linear in the length of the
word times the tokens that match at a place, whatever the word.

Words are found in white space apart chunks, so a worker keeps the results of
a bounded number of chunks.  Texts are read where they lie, without a shuffle.
The vocabulary file is a parameter and is sent to the workers.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tourlog.llm.words import Recent, contents, pieces

# results that a worker keeps: of chunks, of words, and of pairs of tokens
CACHED_CHUNKS = 125_000
CACHED_WORDS = 150_000
CACHED_PAIRS = 1 << 18
# longer ones are not kept
KEPT_LENGTH = 64


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class WordBpe:
    """Encoder and decoder of a BPE vocabulary with word ends, from the text of its file."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = self.vocab
        # tokens in the order in which they are made; a letter is made before all merges
        self.pair = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.rank = {i: -1 for i in vocab.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.rank[made], self.parts[made] = rank, (vocab[a], vocab[b])
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            letters = self._letters(token)
            if i in self.parts or len(letters) == 1:
                self.automaton.add_word(letters, (i, len(letters)))
        self.automaton.make_automaton()
        self.fits = lru_cache(CACHED_PAIRS)(self._fits)
        self.chunk = Recent(self._chunk, CACHED_CHUNKS)
        self.known = Recent(self._word, CACHED_WORDS)
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}

    def _letters(self, token: str) -> str:
        """One letter per unit; the last unit of a word is a letter of its own."""
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return token

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no earlier merge crosses their border."""
        limit = len(self.pair)
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            # undo the later of the two merges; what is undone bounds what may cross
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.parts[a][1]
                # a merge of equal rank further left would have come first
            elif b in self.parts:
                limit, b = self.rank[b] + 1, self.parts[b][0]
            else:
                return True

    def word_ids(self, units: str) -> list[int]:
        """Ids of one word, given as byte letters."""
        letters = units[:-1] + chr(ord(units[-1]) + 0x10000)
        size = len(letters)
        last = [-1] * (size + 1)
        start = [0] * (size + 1)
        fits = self.fits
        for at, (token, length) in self.automaton.iter(letters):
            at += 1
            if last[at] < 0:
                begin = at - length
                if begin == 0 or fits(last[begin], token):
                    last[at], start[at] = token, begin
        out, at = [], size
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def text_ids(self, text: str) -> list[int]:
        """Ids of a text as the tokenizer file describes them."""
        ids: list[int] = []
        at = 0
        for m in self.special.finditer(text):
            ids += self._plain_ids(text[at : m.start()])
            ids.append(self.added[m[0]])
            at = m.end()
        return ids + self._plain_ids(text[at:])

    def _plain_ids(self, text: str) -> list[int]:
        if not text.isascii():
            # lower case letter by letter, so the place of a sigma does not matter
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        ids: list[int] = []
        for word in self.words.findall(text.lower()):
            ids += self.known(word) if len(word) <= KEPT_LENGTH else self._word(word)
        return ids

    def _word(self, word: str) -> list[int]:
        # printable ASCII letters stand for themselves
        return self.word_ids(word if word.isascii() and word.isprintable() else "".join(byte_letters()[b] for b in word.encode()))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def _chunk(self, chunk: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, ids as little-endian bytes and decoded bytes of a chunk without white space."""
        text = chunk.decode()
        ids = self.text_ids(text) if self.special.search(text) else self._plain_ids(text)
        return len(ids), b"".join([self.id_bytes[i] for i in ids]), b" ".join([self.token_bytes[i] for i in ids])

    def encode(self, text: bytes) -> tuple[int, bytes, bytes]:
        """The same of a whole text: no word and no composition crosses white space."""
        get, make = self.chunk.new.get, self.chunk
        parts = [get(c) or (make(c) if len(c) <= KEPT_LENGTH else self._chunk(c)) for c in text.split()]
        return sum([p[0] for p in parts]), b"".join([p[1] for p in parts]), b" ".join([p[2] for p in parts if p[0]])


_loaded: dict[str, WordBpe] = {}


def loaded(file_text: str) -> WordBpe:
    """One encoder per worker and vocabulary."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(file_text)
    return _loaded[key]


def encode_texts(docs: DataFrame, vocabulary: str, keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, and token_ids and decoded if ``keep_ids``.

    ``vocabulary`` is the path of a tokenizer file on the driver.  A null text
    counts as empty and has no ids.  Columns of ``docs`` that have the name of
    an added one are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    added = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids", "decoded"] if keep_ids else [])]
    names = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in pieces(batches):
            rows = [bpe.encode(t) for t in contents(b.column(b.schema.get_field_index("text")))]
            out = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
            ]
            if keep_ids:
                ends = pa.array([0, *_running(r[0] for r in rows)], pa.int32())
                flat = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(r[1] for r in rows))])
                out += [pa.ListArray.from_arrays(ends, flat), pa.array([r[2].decode() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + out, names + added)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    new = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded string" if keep_ids else "")
    carried = names if "text" in names else [*names, "text"]
    return docs.select(*carried).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in names) + new)


def _running(counts: Iterator[int]) -> Iterator[int]:
    total = 0
    for c in counts:
        total += c
        yield total
