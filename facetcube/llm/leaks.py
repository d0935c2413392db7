"""Documents that contain passages of held-out items: BM25 retrieval with block-max pruning, then alignment.

Index. Texts are folded to a stream of letters and digits in which case,
accents, composition, garbled accents, look-alike characters, punctuation, spaces, markup and
invisible characters make no difference. The terms are its runs of eight
characters, which do not care where words are broken. An inverted index holds,
for each term, the items that have it with their BM25 impact, and for each
block of items the largest impact.

Retrieval. Every window of every document is a query. Its terms are ordered by
their largest impact: those that together cannot reach the smallest score asked
for of any item open no block (most windows end here). In the blocks that the
others open, the running bound is their blocks' largest impacts plus the most
that the first ones can add; while it reaches the smallest score asked for in
the block, the first ones' blocks are added, and then the items scored one by one. An item is a candidate if a window has ``SHARE`` of the score that the item has
with itself, and all windows together ``WHOLE`` of it.

Verification. The words of all windows with any of the candidate's terms are aligned with the item's
words (local alignment, twice, in the item's order, carried on over edits near the ends), which gives the words of
the item that the document contains and how many of them are changed, missing
or added.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetcube.arrow import ragged
from facetcube.llm.codes import Codes, Table, text_chunks

GRAM = 8
WINDOW = 512
BLOCK = 16
#: Of 240 items, passages of two fifths in one stretch or two, one word in six edited, kept at least 0.079 of the item's score in a window and 0.117 in all. Measured, not a proven bound.
SHARE, WHOLE = 0.05, 0.1
K1, B = 1.2, 0.75
#: Scores are sums in different orders.
SLACK = 1e-6

#: Look-alikes of Latin letters, capitals and small letters each by their own shape.
CYRILLIC_GREEK = str.maketrans("АВЕЅІЈКМНОРСТУХаеѕіјкмнорстухвԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικτυχ", "ABESIJKMHOPCTYXaesijkmhopctyxbdqwhABEZHIKMNOPTYXaopviktux")
SINGLE = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "p", "ı": "i", "ſ": "s", "ħ": "h"}
#: Characters beside the format characters that take no room.
INVISIBLE = (0xAD, 0x34F, 0x115F, 0x180E, 0x3164)
#: Signs that scans confuse with each other.
CONFUSED = {"0": "o", "1": "l", "5": "s", "8": "b", "e": "c", "i": "l"}


def fold(ch: str) -> int:
    """Letter or digit of the stream (1 to 63), 0 for what separates words, -1 for what vanishes."""
    cat = unicodedata.category(ch)
    if cat[0] == "M" or cat == "Cf" or ord(ch) in INVISIBLE:
        return -1
    base = unicodedata.normalize("NFKD", ch)[:1].translate(CYRILLIC_GREEK).lower()[:1]
    base = SINGLE.get(base, base)
    base = CONFUSED.get(base, base)
    if "a" <= base <= "z":
        return ord(base) - ord("a") + 1
    if "0" <= base <= "9":
        return ord(base) - ord("0") + 27
    if base.isalnum():
        return 37 + ord(base) % 27
    return 0


def _byte(ch: str) -> int:
    """The byte that a character stands for in a text whose UTF-8 was read as Windows-1252 or Latin-1, if it can follow a first byte; else 0."""
    if 0x80 <= ord(ch) <= 0xBF:
        return ord(ch)
    try:
        b = ch.encode("cp1252")[0]
    except UnicodeEncodeError:
        return 0
    return b if 0x80 <= b <= 0xBF else 0


_folds: list[Table] = []
LETTERS = np.frombuffer((" abcdefghijklmnopqrstuvwxyz0123456789" + "".join(chr(0xC0 + i) for i in range(27))).encode("latin-1"), np.uint8)


def _places(codes: np.ndarray, run: tuple[int, ...]) -> np.ndarray:
    """Where a run of code points begins."""
    n = max(len(codes) - len(run) + 1, 0)
    return np.flatnonzero(np.logical_and.reduce([codes[i : i + n] == x for i, x in enumerate(run)]))


def folded(c: Codes) -> np.ndarray:
    """``fold`` of every code point, with tags gone and entities as the characters that they stand for."""
    if not _folds:
        _folds.extend([Table(fold, np.int8), Table(_byte, np.int16)])
    f = _folds[0][c.codes]
    codes, n = c.codes, len(c.codes)
    first = np.flatnonzero((codes[:-1] == 0xC3) | (codes[:-1] == 0xC2)) if n else np.zeros(0, np.int64)
    if len(first):  # two characters that are one in UTF-8
        b = _folds[1][codes[first + 1]]
        first, b = first[b > 0], b[b > 0]
        f[first] = _folds[0][(((codes[first] & 0x1F) << 6) | (b.astype(np.uint32) & 0x3F)).astype(np.uint32)]
        f[first + 1] = -1
    opens, closes = np.flatnonzero(codes == 60), np.flatnonzero(codes == 62)
    if len(opens) and len(closes):
        k = np.searchsorted(closes, opens)
        ok = k < len(closes)
        opens, to = opens[ok], closes[k[ok]]
        nxt = f[np.minimum(opens + 1, n - 1)]
        sign = codes[np.minimum(opens + 1, n - 1)]
        same_text = np.searchsorted(c.starts, opens, side="right") == np.searchsorted(c.starts, to, side="right")
        # a tag ends before the next one opens; a long one has attributes, else it is two signs of a formula
        next_open = np.r_[np.flatnonzero(codes == 60), n]
        alone = next_open[np.searchsorted(next_open, opens, side="right")] > to
        quoted = np.r_[0, np.cumsum((codes[:-1] == 61) & ((codes[1:] == 34) | (codes[1:] == 39))), 0]
        attributes = quoted[np.minimum(to, n - 1)] > quoted[opens]
        tag = same_text & alone & ((to - opens <= 60) | attributes) & (((nxt >= 1) & (nxt <= 26)) | (sign == 47) | (sign == 33) | (sign == 63))
        f[ragged(opens[tag], to[tag] - opens[tag] + 1)] = -1
        begin, end = _places(codes, (60, 33, 45, 45)), _places(codes, (45, 45, 62)) + 2
        k = np.searchsorted(end, begin + 6)
        begin, k = begin[k < len(end)], k[k < len(end)]
        end = end[k]
        comment = np.searchsorted(c.starts, begin, side="right") == np.searchsorted(c.starts, end, side="right")
        for b, e in zip(begin[comment].tolist(), end[comment].tolist(), strict=True):
            f[b : e + 1] = -1
    opens, closes = np.flatnonzero(codes == 38), np.flatnonzero(codes == 59)
    if len(opens) and len(closes):
        k = np.searchsorted(closes, opens)
        ok = k < len(closes)
        for s, e in zip(opens[ok].tolist(), closes[k[ok]].tolist(), strict=True):
            if 2 < e - s <= 10:
                stands = html.unescape(c.slice(s, e + 1).decode())
                if not stands.startswith("&"):
                    f[s : e + 1] = -1
                    f[s] = fold(stands[0])
    return f


def grams(stream: np.ndarray) -> np.ndarray:
    """The run of eight that begins at each place of a stream, as one number."""
    if len(stream) < GRAM:
        return np.zeros(0, np.int64)
    x = stream.astype(np.int64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << 6 * k
    return x


def as_words(f: np.ndarray) -> list[str]:
    """Words of folded text."""
    return LETTERS[f[f >= 0]].tobytes().decode("latin-1").split()


@dataclass
class Item:
    """Words of an item and the pattern that takes runs of its words apart."""

    words: list[str]
    number: dict[str, int] = field(default_factory=dict)
    pattern: re.Pattern | None = None
    longest: int = 0

    def __post_init__(self) -> None:
        self.number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        longer = sorted(self.number, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, longer)) or "(?!)")
        self.longest = max(map(len, self.number), default=0)
        self.sequence = np.array([self.number[w] for w in self.words], np.int64)

    def read(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the item's words in the tokens; broken words are put together, joined ones parted; -1 for others."""
        out: list[int] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            own = self.number.get(t)
            if own is None or len(t) <= 2:
                s, best = t, 0
                for j in range(i + 1, min(len(tokens), i + 24)):
                    s += tokens[j]
                    if len(s) > self.longest:
                        break
                    if s in self.number:
                        best = j
                if best:
                    out.append(self.number["".join(tokens[i : best + 1])])
                    i = best + 1
                    continue
            if own is None and len(t) > 4:
                parts = list(self.pattern.finditer(t))
                if len(parts) > 1 and sum(len(p.group()) for p in parts) >= 0.7 * len(t):
                    end = 0
                    for p in parts:
                        out += [-1] * (p.start() > end)
                        out.append(self.number[p.group()])
                        end = p.end()
                    i += 1
                    continue
            out.append(-1 if own is None else own)
            i += 1
        return np.array(out, np.int64)


#: Costs of an edit that are tried in turn: a high one cuts a stretch short after an edit near its end, a low one runs on into other text.
COSTS = (3, 1)


#: Cells of an alignment that are held at once, for items of some hundred words; longer ones take 4 * words ** 2.
CELLS = 1 << 22


def align(a: np.ndarray, b: np.ndarray, cost: int = COSTS[0]) -> tuple[int, int, int, int, int] | None:
    """Best local alignment of two word sequences: (start, end) in ``a``, (start, end) in ``b``, number of equal words.

    It covers at most two words of ``b`` for each of ``a``: a long ``b`` is
    taken in parts that overlap by so many, with the same result in bounded memory.
    """
    width = max(4 * len(a), CELLS // (len(a) + 1))
    best, at = None, 0
    for s in range(0, max(len(b) - 2 * len(a), 1), width - 2 * len(a)):
        x = _align(a, b[s : s + width], cost)
        if x is not None and (best is None or x[0] > best[0]):
            best, at = x, s
    return None if best is None else (best[1], best[2], best[3] + at, best[4] + at, best[5])


def _align(a: np.ndarray, b: np.ndarray, cost: int) -> tuple[int, int, int, int, int, int] | None:
    """Score and what ``align`` gives."""
    n, m = len(a), len(b)
    if not n or not m:
        return None
    h = np.zeros((n + 1, m + 1), np.int32)
    same = np.where(b == a[:, None], 1, -cost).astype(np.int32) if n * m <= CELLS else None
    gap = cost * np.arange(1, m + 1, dtype=np.int32)
    for i in range(n):
        row = np.maximum(h[i, :-1] + (same[i] if same is not None else np.where(b == a[i], 1, -cost)), h[i, 1:] - cost)
        np.maximum(row, 0, out=row)
        row += gap
        np.maximum.accumulate(row, out=row)
        np.subtract(row, gap, out=h[i + 1, 1:])
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    if h[i, j] < 3:
        return None
    score, ie, je, equal = int(h[i, j]), int(i), int(j), 0
    while h[i, j] > 0:
        s = 1 if b[j - 1] == a[i - 1] else -cost
        if h[i, j] == h[i - 1, j - 1] + s:
            equal += s == 1
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - cost:
            i -= 1
        else:
            j -= 1
    return score, int(i), ie, int(j), je, equal


def run_after(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Words (of ``a``, of ``b``) of one edit at the beginning and the equal words after it; most equal words first."""
    best = (0, 0, 0)
    for i, j in ((1, 1), (1, 0), (0, 1)):
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        best = max(best, (k, i, j))
    return best[1], best[2], best[0]


def stretches(a: np.ndarray, b: np.ndarray, cost: int) -> tuple[int, int, int, int]:
    """Of the words ``a``: how many ``b`` contains in one or two stretches; edits in these; equal words; ends of the stretches.

    A local alignment leaves out few equal words behind an edit at its ends:
    the stretches are carried on over one edit at a time while it helps.
    """
    best = align(a, b, cost)
    if best is None:
        return 0, 0, 0, 0
    i0, i1, j0, j1, equal = best
    parts = [[i0, i1, j0, j1]]
    span, edits = i1 - i0, max(i1 - i0, j1 - j0) - equal
    if not is_leak(len(a), span, edits):
        before, after = align(a[:i0], b[:j0], cost), align(a[i1:], b[j1:], cost)
        second = [[*x[:4], x[4]] for x in (before, after and (after[0] + i1, after[1] + i1, after[2] + j1, after[3] + j1, after[4])) if x and x[4] >= 3]
        if second:
            *part, also = max(second, key=lambda x: x[4])
            parts = sorted([*parts, part])
            span, edits, equal = span + part[1] - part[0], edits + max(part[1] - part[0], part[3] - part[2]) - also, equal + also
    words, tokens = a.tolist(), b.tolist()
    while not is_leak(len(a), span, edits, 2 * len(parts)):
        moves = []
        for k, (i0, i1, j0, j1) in enumerate(parts):
            low = parts[k - 1][1::2] if k else (0, 0)
            high = parts[k + 1][::2] if k + 1 < len(parts) else (len(words), len(tokens))
            reach = len(words) // 2 + 2
            moves.append((*run_after(words[i1 : min(high[0], i1 + reach)], tokens[j1 : min(high[1], j1 + reach)]), k, 1))
            moves.append((*run_after(words[max(low[0], i0 - reach) : i0][::-1], tokens[max(low[1], j0 - reach) : j0][::-1]), k, 0))
        i, j, more, k, end = max(moves, key=lambda x: x[2])
        if not more or 6 * edits > len(a):
            break
        sign = 1 if end else -1
        parts[k][end] += sign * (i + more)
        parts[k][2 + end] += sign * (j + more)
        span, edits, equal = span + i + more, edits + 1, equal + more
    return span, edits, equal, 2 * len(parts)


def contained(item: Item, tokens: list[str]) -> tuple[int, int, int, int]:
    """Of the item's words: how many the tokens contain in one or two stretches; edits in these; equal words; ends of the stretches. The first cost at which it is a leak decides."""
    a, b = item.sequence, item.read(tokens)
    known = np.minimum(np.bincount(a, minlength=1), np.bincount(b[b >= 0], minlength=int(a.max(initial=0)) + 1)).sum()
    if not len(a) or 3 * known < len(a):  # is_leak asks for so many equal words
        return 0, 0, 0, 0
    other = b < 0  # a stretch that crosses more other words than the edits allowed is no leak: longer runs of them are cut to that
    place = np.arange(len(b))
    b = b[~other | (place - np.maximum.accumulate(np.where(other, -1, place)) <= len(a) // 6 + 3)]
    got = (0, 0, 0, 0)
    for cost in COSTS:
        x = stretches(a, b, cost)
        if is_leak(len(a), x[0], x[1], x[3]):
            return x
        got = max(got, x)
    return got


def is_leak(words: int, span: int, edits: int, ends: int = 2) -> bool:
    """Two fifths of the words, at most one in six of them edited; an edited word at each of the ``ends`` of the stretches is not seen, and counts as a word and an edit."""
    return any(5 * (span + x) >= 2 * words and 6 * (edits + x) <= span + x for x in range(ends + 1))


@dataclass
class Statistics:
    """Of all items: terms with the number of items that have them, number of items, mean number of terms."""

    terms: np.ndarray
    df: np.ndarray
    items: int
    mean: float

    @classmethod
    def of(cls, streams: Iterator[list[np.ndarray]]) -> Statistics:
        """Statistics of items that come in lists of folded texts."""
        terms, df, n, length = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        for parts in streams:
            got = [grams(p[p > 0]) for p in parts]
            more, count = np.unique(np.concatenate([np.unique(g) for g in got]) if got else terms[:0], return_counts=True)
            both, at = np.unique(np.r_[terms, more], return_inverse=True)
            df = np.bincount(at, weights=np.r_[df, count], minlength=len(both)).astype(np.int64)
            terms, n, length = both, n + len(parts), length + sum(map(len, got))
        return cls(terms, df, n, length / max(n, 1))


def folded_parts(texts: list[str]) -> list[np.ndarray]:
    """Folded texts, one by one."""
    c = Codes(pa.array(texts, pa.string()))
    f = folded(c)
    return [f[s:e] for s, e in zip(c.starts[:-1], c.starts[1:], strict=True)]


@dataclass
class Index:
    """Inverted index of the items' terms with BM25 impacts, item postings and block postings."""

    terms: np.ndarray
    post_start: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    least: np.ndarray
    block_least: np.ndarray
    ids: list[int]
    items: list[Item]
    filter: np.ndarray
    term_most: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: list[str], share: float = SHARE, known: Statistics | None = None) -> Index:
        """Index of items, weighted by the statistics of all items (default: of these)."""
        parts = folded_parts(texts)
        known = known or Statistics.of(iter([parts]))
        items = [Item(as_words(p)) for p in parts]
        n = len(ids)
        got = [np.unique(grams(p[p > 0]), return_counts=True) for p in parts]
        item = np.repeat(np.arange(n), [len(g) for g, _ in got])
        gram = np.concatenate([g for g, _ in got]) if got else np.zeros(0, np.int64)
        tf = np.concatenate([k for _, k in got]) if got else np.zeros(0, np.int64)
        terms, term = np.unique(gram, return_inverse=True)
        df = known.df[np.searchsorted(known.terms, terms)]
        length = np.bincount(item, weights=tf, minlength=n)
        idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(known.mean, 1)))
        order = np.lexsort([item, term])
        term, item, impact = term[order], item[order], impact[order]
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        least = share * np.bincount(item, weights=impact, minlength=n)
        blocks = -(-n // BLOCK)
        key = term * max(blocks, 1) + item // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        top = np.maximum.reduceat(impact, first) if len(key) else impact
        real = np.where(least > 0, least, np.inf)
        block_start = np.searchsorted(key[first] // max(blocks, 1), np.arange(len(terms) + 1))
        most = np.maximum.reduceat(top, block_start[:-1]) if len(top) else top
        index = cls(terms, start, item, impact, block_start, key[first] % max(blocks, 1), top, real, np.minimum.reduceat(real, np.arange(0, n, BLOCK)) if n else real, ids, items, np.zeros(1 << max(22, (32 * len(terms)).bit_length() - 1), bool), most)
        index.filter[index.slot(terms)] = True
        return index

    def slot(self, gram: np.ndarray) -> np.ndarray:
        """Place of each term in ``filter``."""
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.filter).bit_length())).astype(np.int64)

    def search(self, window: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose score reaches the item's least score; ``gram`` are the runs of each window."""
        keep = self.filter[self.slot(gram)]
        window, gram = window[keep], gram[keep]
        at = np.minimum(np.searchsorted(self.terms, gram), max(len(self.terms) - 1, 0))
        keep = self.terms[at] == gram if len(self.terms) else np.zeros(len(gram), bool)
        pair = np.unique(window[keep] * len(self.terms) + at[keep])
        if not len(pair):
            return pair, pair
        window, term = np.divmod(pair, len(self.terms))
        # a window's terms by their largest impact: the first ones open no block while they reach no least score together
        most = self.term_most[term]
        order = np.lexsort([most, window])
        window, term, most = window[order], term[order], most[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(window)]))
        up = np.cumsum(most)
        opening = up - np.r_[0, up][first][of] >= self.block_least.min() - SLACK
        rest = np.bincount(of, weights=np.where(opening, 0, most))
        blocks = len(self.block_least)

        def expanded(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = np.diff(self.block_start)[term[at]]
            rows = ragged(self.block_start[term[at]], n)
            return np.repeat(of[at], n) * blocks + self.block[rows], self.block_impact[rows]

        key, impact = expanded(np.flatnonzero(opening))
        alive, inverse = np.unique(key, return_inverse=True)
        bound = np.bincount(inverse, weights=impact, minlength=len(alive))
        keep = bound + rest[alive // blocks] >= self.block_least[alive % blocks] - SLACK
        alive, bound = alive[keep], bound[keep]
        if not len(alive):
            return alive, alive
        in_play = np.zeros(len(first), bool)
        in_play[alive // blocks] = True
        key, impact = expanded(np.flatnonzero(~opening & in_play[of]))
        at = np.minimum(np.searchsorted(alive, key), len(alive) - 1)
        bound += np.bincount(at, weights=np.where(alive[at] == key, impact, 0), minlength=len(alive))
        alive = alive[bound >= self.block_least[alive % blocks] - SLACK]
        if not len(alive):
            return alive, alive
        # exact scores within the blocks that are left
        in_play[:] = False
        in_play[alive // blocks] = True
        mine = np.flatnonzero(in_play[of])
        n = np.diff(self.post_start)[term[mine]]
        rows = ragged(self.post_start[term[mine]], n)
        w, item = np.repeat(of[mine], n), self.post_item[rows]
        want = w * blocks + item // BLOCK
        in_alive = alive[np.minimum(np.searchsorted(alive, want), len(alive) - 1)] == want
        key, inverse = np.unique(w[in_alive] * len(self.ids) + item[in_alive], return_inverse=True)
        score = np.bincount(inverse, weights=self.post_impact[rows[in_alive]])
        key = key[score >= self.least[key % len(self.ids)] - SLACK]
        return window[first[key // len(self.ids)]], key % len(self.ids)

    def holding(self, window: np.ndarray, gram: np.ndarray, base: np.ndarray, owner: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs of the (owner, item) pairs whose window has any term of the item; each run lies in ``window`` and the next one."""
        n = len(self.ids)
        pair = np.unique(owner * n + item)
        text = np.searchsorted(base, window, side="right") - 1
        mine = np.isin(text, pair // n)
        at = np.minimum(np.searchsorted(self.terms, gram[mine]), len(self.terms) - 1)
        known = self.terms[at] == gram[mine]
        at, window, text = at[known], window[mine][known], text[mine][known]
        count = np.diff(self.post_start)[at]
        to = self.post_item[ragged(self.post_start[at], count)]
        key = np.repeat(text, count) * n + to
        ok = pair[np.minimum(np.searchsorted(pair, key), len(pair) - 1)] == key
        w = np.repeat(window, count)[ok]
        both = np.unique(np.r_[w, w + 1] * n + np.r_[to[ok], to[ok]])
        return both // n, both % n

    def whole(self, text: np.ndarray, gram: np.ndarray, owner: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Mask of the (owner, item) pairs whose text has ``WHOLE`` of the item's score; (text, gram) are the runs of all texts."""
        n = len(self.ids)
        pair, back = np.unique(owner * n + item, return_inverse=True)
        mine = np.isin(text, pair // n)
        at = np.minimum(np.searchsorted(self.terms, gram[mine]), len(self.terms) - 1)
        known = self.terms[at] == gram[mine]
        owner, term = np.divmod(np.unique(text[mine][known] * len(self.terms) + at[known]), len(self.terms))
        count = np.diff(self.post_start)[term]
        rows = ragged(self.post_start[term], count)
        key = np.repeat(owner, count) * n + self.post_item[rows]
        place = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        score = np.bincount(place, weights=np.where(pair[place] == key, self.post_impact[rows], 0), minlength=len(pair))
        return (score >= self.least[pair % n] * WHOLE / SHARE)[back]


def candidates(index: Index, c: Codes, f: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, positions of the windows as (start, end) rows) for all texts of a chunk."""
    place = np.flatnonzero(f > 0)
    gram = grams(f[place])
    if not len(gram):
        return
    hit = np.flatnonzero(index.filter[index.slot(gram)])
    begin = np.searchsorted(place, c.starts)  # each text's part of the stream
    text = np.searchsorted(begin, hit, side="right") - 1
    whole = hit + GRAM <= begin[text + 1]
    hit, text = hit[whole], text[whole]
    half = WINDOW // 2
    # windows overlap by half: each run lies in two of them
    per_text = (np.diff(begin) // half) + 2
    base = np.r_[0, np.cumsum(per_text)]
    w = base[text] + (hit - begin[text]) // half
    window, item = index.search(np.r_[w, w + 1], np.r_[gram[hit], gram[hit]])
    if not len(window):
        return
    owner = np.searchsorted(base, window, side="right") - 1
    enough = index.whole(text, gram[hit], owner, item)
    window, item, owner = window[enough], item[enough], owner[enough]
    if not len(window):
        return
    window, item = index.holding(w, gram[hit], base, owner, item)
    owner = np.searchsorted(base, window, side="right") - 1
    low = np.maximum(begin[owner] + (window - base[owner] - 2) * half, begin[owner])
    high = np.minimum(begin[owner] + (window - base[owner] + 2) * half, begin[owner + 1])
    spans = np.stack([place[low], np.r_[place, len(f)][high]], axis=1)
    order = np.lexsort([window, item, owner])
    owner, item, spans = owner[order], item[order], spans[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])])
    for s, e in zip(new, np.r_[new[1:], len(owner)], strict=True):
        yield int(owner[s]), int(item[s]), spans[s:e]


def leaks_of(index: Index, c: Codes) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words of the item contained, edits, equal words) of the texts of a chunk that pass verification."""
    f = folded(c)
    for text, item, spans in candidates(index, c, f):
        tokens: list[str] = []
        s, e = spans[0]
        for a, b in spans[1:]:
            if a <= e:
                e = max(e, b)
            else:
                tokens += as_words(f[s:e])
                s, e = a, b
        tokens += as_words(f[s:e])
        span, edits, equal, ends = contained(index.items[item], tokens)
        if is_leak(len(index.items[item].words), span, edits, ends):
            yield text, item, span, edits, equal


def find_leaks(documents: DataFrame, index: Index | Sequence[Index]) -> DataFrame:
    """Leaked items of every document: doc_id, item_id, contained (share of the item's words), edits.

    An index goes to every task; of several, each makes a pass of its own over
    whole texts, without a shuffle. Null, empty and short texts have no rows;
    an item without words is never found; texts that occur under several ids
    give a row for each id.
    """

    def search(part: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, c in text_chunks(batches, "text"):
                rows = list(leaks_of(part, c))
                if rows:
                    text, item, span, edits, _ = (list(x) for x in zip(*rows, strict=True))
                    size = [len(part.items[i].words) for i in item]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array([part.ids[i] for i in item], pa.int64()), pa.array([s / n for s, n in zip(span, size, strict=True)]), pa.array(edits, pa.int32())], ["doc_id", "item_id", "contained", "edits"])

        return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, contained double, edits int")

    return reduce(DataFrame.unionByName, map(search, [index] if isinstance(index, Index) else index))


def index_of(items: DataFrame, most: int = 50_000, shard: int = 5_000) -> list[Index]:
    """Indexes of the held-out items (item_id, text), for ``shard`` items each, weighted by the statistics of all: the same results as of one.

    5,000 patents' passages take some 75 MB in a task. Raises for more than
    ``most`` items, as their texts and terms pass through the driver (5 KB an item).
    """
    rows = items.select("item_id", "text").dropna().orderBy("item_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} held-out items: search them in several runs")
    shards = [rows[i : i + shard] for i in range(0, max(len(rows), 1), shard)]
    known = Statistics.of(folded_parts([r.text for r in x]) for x in shards)
    return [Index.build([r.item_id for r in x], [r.text for r in x], known=known) for x in shards]
