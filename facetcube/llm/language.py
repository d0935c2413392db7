"""Languages of documents and paragraphs, from segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, which a
forward pass over the word's characters adds up. The piece probabilities are
fitted by expectation maximisation over the same sums on a small table of
sentences whose language is sure.

Words are scored once for each batch of texts (and remembered). A word votes
with its log-probability below the best language's, limited to ``LIMIT``: a
paragraph has the language of most of its words, and no odd word outvotes the
others. A document has the language of most of its paragraphs.

"None of these" is a tenth vote, of a model that knows characters but no pieces:
it wins for languages and scripts that were not fitted. Confidence is a
posterior over all ten, tempered so that it is right as often as it says on
sentences held out from the fit: words of one text are not independent, so
votes count for less the more there are.

Mixed paragraphs are cut into segments by the best path over their words, in
which a change of language costs ``SWITCH``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetcube.arrow import ragged
from facetcube.llm.codes import MULT, Codes, Table, mix, span_hashes, text_chunks, uniques

LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")
#: Other names of the languages in labels: three-letter codes and English names.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"), "pt": ("por", "portuguese"), "it": ("ita", "italian"),
    "ru": ("rus", "russian"), "zh": ("zho", "chi", "chinese"), "ja": ("jpn", "japanese"),
}
LONGEST_WORD, LONGEST_PIECE = 24, 12
LIMIT = 4.0
#: Cost of a change of language between two words, in votes: some four words must speak for it.
SWITCH = 15.0
#: Words of a paragraph that one path runs over.
WORDS_A_PATH = 2048
MARK = 0x2581  # begins a word in the vocabulary
REMEMBERED = 1_000_000

NO_LETTER, LATIN, CYRILLIC, CJK, OTHER_SCRIPT, DIGIT, JOINS = range(7)


def _script(ch: str) -> int:
    if unicodedata.category(ch)[0] not in "LM":
        return DIGIT if ch.isnumeric() or ch in "_\\{}^" else NO_LETTER
    c = ord(ch)
    if unicodedata.category(ch)[0] == "M":
        return JOINS
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return LATIN
    if 0x400 <= c < 0x530:
        return CYRILLIC
    if 0x3005 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0xFF66 <= c <= 0xFF9F or c >= 0x20000:
        return CJK
    return OTHER_SCRIPT


def _lower(ch: str) -> int:
    low = unicodedata.normalize("NFKC", ch).lower()
    return ord(low) if len(low) == 1 else ord(ch)


_tables: dict[str, Table] = {}


def words_of(c: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points; start, end and script of the words; number of the paragraph of each position.

    A word is a run of letters of one script, of at most ``LONGEST_WORD``;
    Chinese and Japanese runs are cut into pairs of characters. Letters next to
    digits and in formulas are no words. The number of a paragraph counts the
    blank lines since the text began.
    """
    if not _tables:
        _tables.update(script=Table(_script, np.int8), lower=Table(_lower, np.int64))
    script, first = _tables["script"][c.codes], c.first_of_text()
    low = _tables["lower"][c.codes]
    n = len(low)
    if (marks := script == JOINS).any():  # combining marks go on with the letter before
        last = np.maximum.accumulate(np.where(marks, 0, np.arange(n)))
        script = script[last]
    before, after = np.r_[np.int8(NO_LETTER), script[:-1]], np.r_[script[1:], np.int8(NO_LETTER)]
    before[first] = NO_LETTER
    after[np.r_[first[1:], True] if n else first] = NO_LETTER
    letter = (script >= LATIN) & (script <= OTHER_SCRIPT)
    start, end = np.flatnonzero(letter & (before != script)), np.flatnonzero(letter & (after != script)) + 1
    kind = script[start] if n else script
    cjk = kind == CJK
    near_digit = (before[start] == DIGIT) | (after[end - 1] == DIGIT) if len(start) else np.zeros(0, bool)
    ok = cjk | ~near_digit
    start, end, kind = start[ok], end[ok], kind[ok]
    size = np.where(kind == CJK, 2, LONGEST_WORD)
    parts = -(-(end - start) // size) if len(start) else start
    s = np.repeat(start, parts) + ragged(np.zeros(len(parts), np.int64), parts) * np.repeat(size, parts)
    e = np.minimum(s + np.repeat(size, parts), np.repeat(end, parts))
    line = c.codes == 10
    blank = line & ~(np.r_[False, line[:-1]] & ~first) & np.r_[line[1:] & ~first[1:], False] if n else line
    count = np.cumsum(blank)
    return low, s, e, np.repeat(kind, parts), count


@dataclass
class Model:
    """Hashes of the pieces, sorted, their probability in each language, and that of an unknown character of a script.

    ``chars``, ``char_logp`` and ``char_unknown`` are the model of none of the
    languages. ``tempering``: (weight of a vote, number of votes that it halves at).
    """

    hashes: np.ndarray
    probs: np.ndarray
    unknown: np.ndarray
    chars: np.ndarray
    char_logp: np.ndarray
    char_unknown: np.ndarray
    tempering: tuple[float, float] = (0.5, 8.0)

    def pieces(self, chars: np.ndarray) -> np.ndarray:
        """Number of the piece that begins at each place of the rows of ``chars`` (0: none), by length: (rows, places, lengths); -1: none."""
        n, width = chars.shape
        longest = min(LONGEST_PIECE, width)
        value = np.where(chars > 0, mix(chars), np.uint64(0))
        out = np.full((n, width, longest), -1, np.int32)
        running, power = np.zeros((n, width), np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(longest):
                running[:, : width - k] += value[:, k:] * power
                power = power * MULT
                h = running[:, : width - k][chars[:, k:] > 0]
                h = mix(h ^ np.uint64((k + 1) << 48))
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                here = out[:, : width - k, k]
                here[chars[:, k:] > 0] = np.where(self.hashes[at] == h, at, -1)
        return out

    def forward(self, chars: np.ndarray, scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over all segmentations of the beginnings of each row, (rows, places, languages); pieces; unknown mask."""
        n, width = chars.shape
        ids = self.pieces(chars)
        padded = np.vstack([self.probs, np.zeros((1, len(LANGS)))])
        total = np.zeros((n, width + 1, len(LANGS)))
        total[:, 0] = 1
        other = ids[:, :, 0] < 0
        for i in range(1, width + 1):
            for k in range(1, min(i, ids.shape[2]) + 1):
                piece = ids[:, i - k, k - 1]
                hit = piece >= 0
                if hit.any():
                    total[hit, i] += total[hit, i - k] * padded[piece[hit]]
            lost = other[:, i - 1]
            total[lost, i] += total[lost, i - 1] * self.unknown[scripts[lost]]
        return total, ids, other

    def score(self, chars: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        """Log-probability of each row in each language."""
        total, _, _ = self.forward(chars, scripts)
        lengths = (chars > 0).sum(axis=1)
        return np.log(total[np.arange(len(chars)), lengths] + 1e-300)


    def none(self, chars: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        """Log-probability of each row as characters alone."""
        at = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        p = np.where(self.chars[at] == chars, self.char_logp[at], self.char_unknown[scripts][:, None])
        return np.where((chars > 0) & (chars != MARK), p, 0).sum(axis=1) + np.where(scripts == CJK, np.log(0.5), np.log(0.125))

    def posterior(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probability of each language and of none, from the votes of that many words."""
        weight, half = self.tempering
        z = total * (weight / (1 + words / half))[:, None]
        x = np.exp(z - z.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def rows_of(low: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Words as rows of code points, with the mark that begins a word except in Chinese and Japanese."""
    lengths = end - start
    mark = (kind != CJK).astype(np.int64)
    out = np.zeros((len(start), int((lengths + mark).max(initial=1))), np.int64)
    out[mark == 1, 0] = MARK
    out[np.repeat(np.arange(len(start)), lengths), ragged(mark, lengths)] = low[ragged(start, lengths)]
    return out


def fit(sentences: list[tuple[str, str]], pieces: list[str], rounds: int = 6, prior: float = 400.0, floor: float = 2e-7) -> Model:
    """Piece probabilities of each language from (language, sentence) pairs.

    ``pieces`` is the vocabulary. Single characters that occur in the sentences
    and lack a piece become one. ``prior`` is the weight, in pieces, of all
    languages' common distribution, ``floor`` the least probability of a piece.
    """
    c = Codes(pa.array([s for _, s in sentences], pa.string()))
    low, start, end, kind, _ = words_of(c)
    lang = np.array([LANGS.index(x) for x, _ in sentences])[np.searchsorted(c.starts, start, side="right") - 1]
    names = {p for p in pieces if 0 < len(p) <= LONGEST_PIECE and p == p.lower()} | {chr(x) for x in np.unique(low[ragged(start, end - start)])} | {chr(MARK)}
    names_list = sorted(names)
    hashes = np.concatenate([span_hashes(np.array([ord(x) for x in p], np.int64), np.array([0]), np.array([len(p)])) for p in names_list])
    order = np.argsort(hashes)
    n = len(hashes)
    seen = np.zeros((7, len(LANGS)))
    np.add.at(seen, (np.repeat(kind, end - start), np.repeat(lang, end - start)), 1)
    unknown = 1e-3 * (seen + 0.01) / (seen.sum(axis=0) + 1) * np.array([1, 0.3, 0.3, 1, 1, 1, 1])[:, None]
    letters = ragged(start, end - start)
    of_script = np.repeat(kind, end - start)
    chars, first, counts = np.unique(low[letters], return_index=True, return_counts=True)
    ends = np.bincount(of_script, minlength=7) + np.bincount(kind, minlength=7) + 50
    model = Model(hashes[order], np.full((n, len(LANGS)), 1 / n), np.maximum(unknown, 1e-9), chars, np.log((counts + 0.5) / ends[of_script[first]]), np.log(0.5 / ends))
    rows = rows_of(low, start, end, kind)
    for _ in range(rounds):
        total, ids, _ = model.forward(rows, kind)
        width = rows.shape[1]
        lengths = (rows > 0).sum(axis=1)
        back = np.zeros_like(total)
        back[np.arange(len(rows)), lengths] = 1
        expected = np.zeros((n, len(LANGS)))
        own = np.arange(len(rows))
        whole = total[own, lengths, lang] + 1e-300
        for i in range(width - 1, -1, -1):
            for k in range(1, min(width - i, ids.shape[2]) + 1):
                piece = ids[:, i, k - 1]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    back[hit, i] += back[hit, i + k] * model.probs[piece[hit]]
                    gain = total[hit, i, lang[hit]] * model.probs[piece[hit], lang[hit]] * back[hit, i + k, lang[hit]] / whole[hit]
                    np.add.at(expected, (piece[hit], lang[hit]), gain)
        common = expected.sum(axis=1) + 0.01
        common /= common.sum()
        mixed = expected + prior * common[:, None]
        model.probs = np.maximum(mixed / mixed.sum(axis=0), floor)
    return model


class Scorer:
    """Votes of words for the languages and for none, remembered between batches."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[int, int] = {}
        self.votes = np.zeros((1 << 12, len(LANGS) + 1), np.float32)

    def __call__(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Vote of each word for each language, 0 for the best, down to -LIMIT; the last one for none of them, up to LIMIT."""
        word, different, first = uniques(span_hashes(low, start, end))
        known = different.tolist()
        if len(self.number) + len(known) > REMEMBERED:
            self.number = {}
        new = np.array([i for i, h in enumerate(known) if h not in self.number], np.int64)
        sizes = (end - start)[first[new]] if len(new) else new
        for low_size, high_size in ((0, 6), (6, 12), (12, LONGEST_WORD + 1)):  # little padding
            bucket = new[(sizes >= low_size) & (sizes < high_size)] if len(new) else new
            for s in range(0, len(bucket), 8192):
                part = bucket[s : s + 8192]
                at = first[part]
                chars = rows_of(low, start[at], end[at], kind[at])
                p = self.model.score(chars, kind[at])
                best = p.max(axis=1, keepdims=True)
                none = np.where(kind[at] == OTHER_SCRIPT, LIMIT, np.clip(self.model.none(chars, kind[at]) - best[:, 0], -LIMIT, LIMIT))
                n = len(self.number)
                while len(self.votes) < n + len(part):
                    self.votes = np.r_[self.votes, np.zeros_like(self.votes)]
                self.votes[n : n + len(part)] = np.c_[np.maximum(p - best, -LIMIT) * (kind[at] != OTHER_SCRIPT)[:, None], none]
                self.number.update(zip([known[i] for i in part], range(n, n + len(part)), strict=True))
        at = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))
        return self.votes[at[word]] if len(word) else np.zeros((0, len(LANGS) + 1), np.float32)


@dataclass
class Words:
    """Words of a chunk of texts in order: positions, text, paragraph, votes, weight, and where paragraphs begin."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    par: np.ndarray
    votes: np.ndarray
    weight: np.ndarray
    foreign: np.ndarray
    new: np.ndarray

    @classmethod
    def read(cls, c: Codes, scorer: Scorer) -> Words:
        low, start, end, kind, blank = words_of(c)
        votes = scorer(low, start, end, kind)
        weight = np.where(kind == CJK, 1.0, np.minimum((end - start) / 3.0, 1.0))
        text = np.searchsorted(c.starts, start, side="right") - 1
        base = np.r_[0, blank][c.starts[:-1]] if len(c.starts) > 1 else np.zeros(0, np.int64)
        par = blank[start] - base[text] if len(start) else start
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (par[1:] != par[:-1])][: len(start)])
        return cls(start, end, text, par, votes, weight, kind == OTHER_SCRIPT, new)


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, votes, weight of the words, and whether it has words in the languages' scripts, of every paragraph with a word.

    A word that counts for this has three letters or is Chinese or Japanese:
    letters that stand alone are variables and units more often than words.
    """
    if not len(w.new):
        return w.text, w.par, w.votes, w.weight, w.foreign
    total = np.add.reduceat(w.votes * w.weight[:, None], w.new, axis=0)
    any_word, own = (np.add.reduceat(x.astype(np.int64), w.new) > 0 for x in (w.weight == 1, (w.weight == 1) & ~w.foreign))
    at = w.new[any_word]
    return w.text[at], w.par[at], total[any_word], np.add.reduceat(w.weight, w.new)[any_word], own[any_word]


def segments_of(w: Words, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """First word of each segment, and its language (``len(LANGS)``: none): the path of most votes less the cost of its changes.

    All paragraphs go forward together, a word at a time. A path covers
    ``WORDS_A_PATH`` words at most; equal neighbours become one segment.
    """
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    votes = w.votes * w.weight[:, None]
    votes = votes - np.maximum(votes.max(axis=1, keepdims=True), 0)  # none may be above the best language
    length = np.diff(np.r_[w.new, n])
    parts = -(-length // WORDS_A_PATH)
    first = np.repeat(w.new, parts) + ragged(np.zeros(len(parts), np.int64), parts) * WORDS_A_PATH
    length = np.diff(np.r_[first, n])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # paths that have so many words
    changed, came = np.zeros(votes.shape, bool), np.zeros(n, np.int64)
    score = votes[first].astype(np.float64)
    for t in range(1, int(length[0])):
        k = alive[t]
        at, s = first[:k] + t, score[:k]
        came[at] = s.argmax(axis=1)
        other = s.max(axis=1, keepdims=True) - switch
        changed[at] = other > s
        score[:k] = np.maximum(s, other) + votes[at]
    lang, state = np.zeros(n, np.int64), score.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        lang[at] = state[:k]
        if t:
            state[:k] = np.where(changed[at, state[:k]], came[at], state[:k])
    begins = np.zeros(n, bool)
    begins[w.new] = True
    begins[1:] |= lang[1:] != lang[:-1]
    return np.flatnonzero(begins), lang[begins]


def temper(model: Model, held_out: list[tuple[str, str]]) -> tuple[float, float]:
    """The tempering under which runs of 1 to 16 words, and whole sentences, that the model was not fitted on are most likely."""
    w = Words.read(Codes(pa.array([s for _, s in held_out], pa.string())), Scorer(model))
    truth = np.array([LANGS.index(x) for x, _ in held_out])
    begin = np.flatnonzero(np.r_[True, w.text[1:] != w.text[:-1]][: len(w.text)])
    size = np.diff(np.r_[begin, len(w.text)])
    up, weights = np.vstack([np.zeros((1, len(LANGS) + 1)), np.cumsum(w.votes * w.weight[:, None], axis=0)]), np.r_[0, np.cumsum(w.weight)]
    total, words, right = [], [], []
    for k in (1, 2, 4, 8, 16, 1 << 30):
        n = np.minimum(size, k)
        for shift in (0, 5, 10) if k <= 16 else (0,):
            s = begin + np.minimum(shift, size - n)
            total.append(up[s + n] - up[s])
            words.append(weights[s + n] - weights[s])
            right.append(truth[w.text[begin]])
    total, words, right = np.concatenate(total), np.concatenate(words), np.concatenate(right)
    grid = [(a, b) for a in (0.125, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0) for b in (2.0, 4.0, 8.0, 16.0, 32.0, 1e9)]
    model = Model(**vars(model))

    def loss(t: tuple[float, float]) -> float:
        model.tempering = t
        return -float(np.log(model.posterior(total, words)[np.arange(len(right)), right] + 1e-12).mean())

    return min(grid, key=loss)


def label_names(label: str | None) -> str | None:
    """The language that a label names, in any spelling; None if it names none of LANGS."""
    parts = [p for p in re.split(r"[^a-z]+", (label or "").lower()) if p]
    if not parts:
        return None
    for code, names in NAMES.items():
        if parts[0] == code or parts[0] in names or any(p in names and len(p) > 3 for p in parts):
            return code
    return None


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Language of every document and paragraph: doc_id, par_no, lang, confidence, none, named, doc_lang.

    ``par_no`` is -1 for the document itself, else the paragraph's number.
    ``lang`` is the best of the languages; ``confidence`` its probability, for a
    document the mean over its words, and ``none`` that of none of the
    languages. ``named`` is the language that the label names (null: none).
    Every text with a word (of three letters, or Chinese or Japanese) has rows;
    null, empty and wordless texts have none. A paragraph that is in other scripts altogether
    has a row with null for its language, and so has a document of only such ones.
    One pass over the texts, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        labels: dict[str | None, str | None] = {}
        names = [*LANGS, None]
        for b, c in text_chunks(batches, "text"):
            text, par, total, words, own = paragraphs(Words.read(c, scorer))
            if not len(text):
                continue
            votes = total[:, :-1]
            chance = model.posterior(total, words)
            best = np.where(own, votes.argmax(axis=1), len(LANGS))
            new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            counts = np.add.reduceat(np.eye(len(LANGS) + 1)[best], new, axis=0)[:, :-1]
            sums = np.add.reduceat(votes, new, axis=0)
            # most paragraphs; of languages with as many, the one with the better votes
            tie = counts == counts.max(axis=1, keepdims=True)
            doc = np.where(counts.any(axis=1), np.where(tie, sums, -np.inf).argmax(axis=1), len(LANGS))
            mean = np.add.reduceat(chance * words[:, None], new, axis=0) / np.add.reduceat(words, new)[:, None]
            rows = np.r_[text[new], text]
            out = np.r_[doc, best]
            every = np.concatenate([mean, chance])
            given = b.column(1).take(pa.array(rows)).to_pylist()
            for g in set(given) - labels.keys():
                labels[g] = label_names(g)
            of_doc = np.r_[doc, doc[np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(text)]))]]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows)), pa.array(np.r_[np.full(len(new), -1), par].astype(np.int32)), pa.array([names[x] for x in out], pa.string()),
                pa.array(every[np.arange(len(out)), out]), pa.array(every[:, -1]), pa.array([labels[g] for g in given], pa.string()), pa.array([names[x] for x in of_doc], pa.string()),
            ], ["doc_id", "par_no", "lang", "confidence", "none", "named", "doc_lang"])

    d = documents.select("doc_id", documents["lang"].alias("label"), "text")
    return d.mapInArrow(run, "doc_id bigint, par_no int, lang string, confidence double, `none` double, named string, doc_lang string")


def wrong_labels(languages: DataFrame) -> DataFrame:
    """Of ``identify``: documents whose label does not name their language, and paragraphs in another language."""
    doc = "par_no = -1 and (named is null or named != lang)"
    return languages.filter(f"lang is not null and (({doc}) or (par_no >= 0 and lang != doc_lang))")


def mixed(documents: DataFrame, model: Model) -> DataFrame:
    """Segments of the paragraphs that have several: doc_id, par_no, seg_no, begins, ends, lang, confidence.

    ``begins`` and ``ends`` are positions in the text, in code points, from its
    first word to behind its last one; ``lang`` is null for none of the
    languages. Texts without such paragraphs, null and empty ones have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        names = [*LANGS, None]
        for b, c in text_chunks(batches, "text"):
            w = Words.read(c, scorer)
            first, lang = segments_of(w)
            if not len(first):
                continue
            chance = model.posterior(np.add.reduceat(w.votes * w.weight[:, None], first, axis=0), np.add.reduceat(w.weight, first))
            par = np.searchsorted(w.new, first, side="right") - 1
            at = np.flatnonzero(np.bincount(par)[par] > 1)
            head = np.flatnonzero(np.r_[True, par[1:] != par[:-1]])
            number = np.arange(len(first)) - head[np.searchsorted(head, np.arange(len(first)), side="right") - 1]
            last = np.r_[first[1:], len(w.start)] - 1
            text = w.text[first]
            base = c.starts[text]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(text[at])), pa.array(w.par[first][at].astype(np.int32)), pa.array(number[at].astype(np.int32)), pa.array((w.start[first] - base)[at]), pa.array((w.end[last] - base)[at]),
                pa.array([names[x] for x in lang[at]], pa.string()), pa.array(chance[at, lang[at]]),
            ], ["doc_id", "par_no", "seg_no", "begins", "ends", "lang", "confidence"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, par_no int, seg_no int, begins bigint, ends bigint, lang string, confidence double")


def load(samples: DataFrame, vocabulary: str, most: int = 20_000) -> Model:
    """Fit the model on at most ``most`` sentences of ``samples`` (lang, text) over the pieces of a sentencepiece file.

    The confidence is tempered on each fourth sentence, with a fit on the others.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    rows = samples.select("sample_id", "lang", "text").dropna().filter(samples["lang"].isin(*LANGS)).orderBy("sample_id").limit(most).collect()
    pairs = [(r.lang, r.text) for r in rows]
    model = fit(pairs, pieces)
    if len(pairs) >= 40:
        model.tempering = temper(fit([x for i, x in enumerate(pairs) if i % 4], pieces, rounds=3), pairs[::4])
    return model
