"""Byte-level BPE encoding of whole corpora, in numpy.

Texts are cut into words on arrays of code points. The different words of a
chunk are encoded once: they lie, bucketed by length, as rows of padded
matrices of ids. Each round looks up the merge rank of all neighbouring pairs
in a hash table, and every row merges its minimum-rank pair, leftmost first;
rows without a pair to merge leave the matrix, and the rest is compacted.

A merged id only takes part in merges of a higher rank (checked when the
vocabulary is loaded), so after the leftmost occurrence of the minimum pair the
next merge of that row is the next occurrence of the same pair; a round does
all of them from left to right. That bounds the rounds of a very long word by
the different merges in it instead of by its length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetcube.arrow import ragged
from facetcube.llm.codes import Codes, Table, span_hashes, text_chunks, uniques

NONE = np.int32(1 << 30)
#: Words a worker remembers; beyond that it starts anew, with the same results.
REMEMBERED = 1_000_000
#: Cells of a matrix of words.
CELLS = 1 << 21


@dataclass
class Vocabulary:
    """Ids of the 256 bytes and a hash table from (left id, right id) to (rank, merged id)."""

    byte_ids: np.ndarray
    slots: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a ``tokenizers`` JSON file of a byte-level BPE model.

        The encoder does what such a file says with the byte-level
        pre-tokenizer and its own pattern, and nothing else: another
        pre-tokenizer, a normalizer, a prefix space, dropout, word ends or the
        like are an error, not a wrong encoding.
        """
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model, before = given["model"], given.get("pre_tokenizer") or {}
        kept = {
            "normalizer": given.get("normalizer") is None,
            "pre_tokenizer": before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True),
            "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        }
        if wrong := [k for k, ok in kept.items() if not ok]:
            raise ValueError(f"{path}: not a plain byte-level BPE: {', '.join(wrong)}")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: i for i, (a, b) in enumerate(merges)}
        if any(made.get(x, -1) >= i for i, pair in enumerate(merges) for x in pair):
            raise ValueError("a merge comes before the merges that make its parts")
        # bytes that print stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(shown)]
        symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
        bits = int(np.ceil(np.log2(len(merges) * 4)))
        slots, ranks, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        for i, (k, at) in enumerate(zip(keys.tolist(), cls._slot(keys, bits).tolist(), strict=True)):
            while slots[at] >= 0:
                at = (at + 1) & (1 << bits) - 1
            slots[at], ranks[at], merged[at] = k, i, vocab[merges[i][0] + merges[i][1]]
        return cls(np.array([vocab[symbol[b]] for b in range(256)], np.int32), slots, ranks, merged)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each neighbouring pair in the rows of ``ids`` (-1: padding); NONE where there is no merge."""
        left, right = ids[:, :-1].astype(np.int64), ids[:, 1:].astype(np.int64)
        flat = np.where(right >= 0, left << 32 | right, -2).ravel()
        bits = len(self.slots).bit_length() - 1
        at = self._slot(flat, bits)
        open_ = np.flatnonzero((self.slots[at] != flat) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[at[open_]]
            open_ = open_[(held != flat[open_]) & (held >= 0)]
        hit = self.slots[at] == flat
        return np.where(hit, self.ranks[at], NONE).reshape(left.shape), self.merged[at].reshape(left.shape)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        out: list[np.ndarray | None] = [None] * len(words)
        s = 0
        while s < len(words):
            width = max(4, int(sizes[order[s]] * 5 // 4))
            e = int(np.searchsorted(sizes[order], width, side="right"))
            e = min(max(e, s + 1), s + max(1, CELLS // width))
            rows = order[s:e]
            width = int(sizes[rows[-1]])
            ids = np.full((len(rows), width), -1, np.int32)
            lengths = sizes[rows]
            ids[np.repeat(np.arange(len(rows)), lengths), ragged(np.zeros(len(rows), np.int64), lengths)] = self.byte_ids[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
            self._merge(ids, rows, out)
            s = e
        counts = np.fromiter((len(x) for x in out), np.int64, len(words))
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _merge(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        while len(rows):
            if ids.shape[1] > 1:
                rank, merged = self.pairs(ids)
                least = rank.min(axis=1)
            else:
                least = np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for i, row in zip(rows[done], ids[done], strict=True):
                    out[i] = row[row >= 0]
                ids, rows = ids[~done], rows[~done]
                if not len(rows):
                    return
                rank, merged, least = rank[~done], merged[~done], least[~done]
            take = rank == least[:, None]
            # of pairs that overlap (runs of one id), every second from the left
            column = np.arange(take.shape[1])
            run = column - np.maximum.accumulate(np.where(take, -1, column), axis=1)
            take &= run % 2 == 1
            ids[:, :-1] = np.where(take, merged, ids[:, :-1])
            keep = ids >= 0
            keep[:, 1:] &= ~take
            r, c = np.nonzero(keep)
            to = (np.cumsum(keep, axis=1) - 1)[r, c]
            packed = np.full((len(rows), int(to.max()) + 1), -1, np.int32)
            packed[r, to] = ids[r, c]
            ids = packed


#: Code points of white space.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER = range(4)


def _kind(ch: str) -> int:
    if ord(ch) in SPACES:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(ch)[0], OTHER)


_kinds: list[Table] = []


def word_starts(c: Codes) -> np.ndarray:
    """Positions at which the vocabulary's pattern begins a word.

    The pattern: a contraction ('s 't 're 've 'm 'll 'd); or letters, or
    numbers, or other signs, each with one space before if there is one; or
    white space, which leaves its last character to what follows.
    """
    if not _kinds:
        _kinds.append(Table(_kind, np.int8))
    codes, first = c.codes, c.first_of_text()
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds[0][codes]
    space = kind == SPACE
    before = np.r_[np.int8(-1), kind[:-1]]
    before[first] = -1
    after_text = np.r_[first[1:], True]
    last = space & ~after_text & np.r_[~space[1:], True]
    blank_before = np.r_[False, codes[:-1] == 32] & ~first
    start = np.where(space, (before != SPACE) | last, ~blank_before & (kind != before))
    quote = np.flatnonzero((codes == 39) & start & ~after_text)
    if len(quote):
        padded = np.r_[codes, np.zeros(3, np.uint32)]
        ends = np.r_[first, True, True, True]  # a new text ends the contraction
        a, b = padded[quote + 1], np.where(ends[quote + 2], 0, padded[quote + 2])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        hit = quote[one | two]
        stop = hit + np.where(one[one | two], 2, 3)
        start[hit + 1] = False
        stop = stop[(stop < n)]
        letters = stop[kind[stop] == LETTER]
        start[letters] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes chunks of texts, remembering the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.offset = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def learn(self, hashes: list[int], words: list[bytes]) -> None:
        ids, counts = self.vocabulary.encode(words)
        n, used = len(self.number), int(self.offset[len(self.number)])
        while len(self.ids) < used + len(ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while len(self.offset) < n + len(words) + 1:
            self.offset = np.r_[self.offset, np.zeros_like(self.offset)]
        self.ids[used : used + len(ids)] = ids
        self.offset[n + 1 : n + len(words) + 1] = used + np.cumsum(counts)
        self.number.update(zip(hashes, range(n, n + len(words)), strict=True))

    def encode(self, c: Codes) -> pa.ListArray:
        """Lists of ids, one for each text."""
        start = word_starts(c)
        end = np.r_[start[1:], len(c.codes)] if len(start) else start
        word, different, first = uniques(span_hashes(c.codes, start, end))
        known = different.tolist()
        if len(self.number) + len(known) > REMEMBERED:
            self.forget()
        new = [i for i, h in enumerate(known) if h not in self.number]
        if new:
            self.learn([known[i] for i in new], [c.slice(start[first[i]], end[first[i]]) for i in new])
        at = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))[word] if known else np.zeros(0, np.int64)
        lengths = self.offset[at + 1] - self.offset[at]
        ids = self.ids[ragged(self.offset[at], lengths)]
        total = np.r_[0, np.cumsum(lengths)]
        return pa.ListArray.from_arrays(pa.array(total[np.searchsorted(start, c.starts)].astype(np.int32)), pa.array(ids))


def encode_texts(documents: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: ids of the whole text, without special tokens.

    Empty and null texts both give an empty list; strings that look like
    special tokens are ordinary text; a null key is kept. The vocabulary
    (about 1.5 MB) travels with the tasks, so executors read no file of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b, c in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), encoder.encode(c)], ["key", "ids"])

    kind = dict(documents.dtypes)[key]
    d = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return d.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
