"""The N best items of every group, by simultaneous bisection of per-group cutoffs.

Score and identifier form one order-preserving code: higher score first, then
the smaller identifier. All groups of a split are bisected together: a round
sets a midpoint for every group, counts the rows at or above it with one
segmented sum, and moves that group's bounds; a group is finished when exactly
N rows lie above its cutoff. The code is wider than a machine word (score, then
the identifier's bytes), so it is bisected a word at a time: where a whole word
leaves a tie across the N-th place, the tied rows go on to the next word.

Splits are equal shares of the rows by the hash of (group, identifier), so a
group with millions of items is spread over all of them; each split keeps at
most N rows a group, and a second bisection of those gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetcube.arrow import binary_rows, column, ragged, runs, whole_groups
from facetcube.operators.facts import hex_member, once

TOP = np.uint64(1 << 63)


def word_of(scores: np.ndarray) -> np.ndarray:
    """Order-preserving unsigned code of int64 or float64 scores; NaN sorts above all numbers."""
    if scores.dtype.kind == "f":
        bits = (scores + 0.0).view(np.uint64)  # -0.0 is 0.0
        bits = np.where(np.isnan(scores), np.uint64(0x7FF8 << 48), bits)
        return np.where(bits >= TOP, ~bits, bits | TOP)
    return scores.astype(np.int64).view(np.uint64) ^ TOP


def words_of_ids(ids: pa.Array, width: int) -> list[np.ndarray]:
    """Words of the identifiers, complemented, so that the smaller identifier has the larger code. Shorter ones sort first."""
    n = len(ids)
    padded = np.zeros((n, (width + 8) // 8 * 8), np.uint8)  # at least one byte after the longest: the length decides between equal prefixes
    data, starts, ends = binary_rows(ids)
    lengths = ends - starts
    padded[np.repeat(np.arange(n), lengths), ragged(np.zeros(n, np.int64), lengths)] = data[ragged(starts, lengths)]
    words = padded.view(">u8").astype(np.uint64)
    return [~words[:, i] for i in range(words.shape[1])] + [~lengths.astype(np.uint64)]


def bisect_top(groups: np.ndarray, words: list[np.ndarray], n: int) -> np.ndarray:
    """Mask of the ``n`` rows with the largest code in each group. ``groups``: sorted, dense numbers from 0.

    Equal codes are equal rows; of those any may be kept, and exactly n are.
    """
    keep = np.zeros(len(groups), bool)
    if not len(groups):
        return keep
    sizes = np.bincount(groups)
    want = np.full(len(sizes), n, np.int64)
    small = sizes <= n
    keep[small[groups]] = True
    rows = np.flatnonzero(~small[groups])
    for word in words:
        if not len(rows):
            return keep
        g, starts, local = np.unique(groups[rows], return_index=True, return_inverse=True)
        w, need = word[rows], want[g]
        low, high = np.minimum.reduceat(w, starts), np.maximum.reduceat(w, starts)
        # the cutoff is the largest c with at least `need` rows at or above it
        while (todo := low < high).any():
            mid = np.where(todo, low + (high - low) // np.uint64(2) + np.uint64(1), low)
            enough = np.add.reduceat((w >= mid[local]).astype(np.int64), starts) >= need
            low = np.where(todo & enough, mid, low)
            high = np.where(todo & ~enough, mid - np.uint64(1), high)
        above, tied = w > low[local], w == low[local]
        keep[rows[above]] = True
        want[g] -= np.add.reduceat(above.astype(np.int64), starts)
        decided = np.add.reduceat(tied.astype(np.int64), starts) == want[g]
        keep[rows[tied & decided[local]]] = True
        rows = rows[tied & ~decided[local]]
    if len(rows):  # equal in all words
        first = np.r_[True, groups[rows][1:] != groups[rows][:-1]]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        keep[rows[place < want[groups[rows]]]] = True
    return keep


def top_of_split(batches: Iterator[pa.RecordBatch], n: int, place: bool) -> Iterator[pa.RecordBatch]:
    """The ``n`` best rows of each group in a partition sorted by group; with ``place``, numbered from 1."""
    for t in whole_groups(batches, "grp", 1 << 18):
        ids, groups = column(t, "item"), runs(column(t, "grp"))
        width = pc.max(pc.binary_length(ids)).as_py() or 0
        words = [word_of(t["score"].to_numpy()), *words_of_ids(ids, width)]
        keep = np.flatnonzero(bisect_top(groups, words, n))
        if place:
            order = np.lexsort([*(~w[keep] for w in reversed(words)), groups[keep]])
            keep = keep[order]
            kg = groups[keep]
            first = np.r_[True, kg[1:] != kg[:-1]] if len(kg) else np.zeros(0, bool)
            places = np.arange(len(kg)) - np.maximum.accumulate(np.where(first, np.arange(len(kg)), 0)) + 1
            t = t.take(pa.array(keep)).append_column("place", pa.array(places.astype(np.int32)))
        else:
            t = t.take(pa.array(keep))
        yield from t.to_batches()


def top_items(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest score, ties by the smaller item: grp, item, score, place.

    ``rows``: grp (binary), item (binary), score (bigint or double). Rows with a
    null in any of these are left out; repeated rows take a place each; groups
    with fewer rows keep all. Empty input, empty result.
    """
    kind = dict(rows.dtypes)["score"]
    rows = rows.select("grp", "item", "score").dropna()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"grp binary, item binary, score {kind}"
    split = rows.sortWithinPartitions("grp").mapInArrow(lambda it: top_of_split(it, n, False), schema)
    best = split.repartition(parts, "grp").sortWithinPartitions("grp")
    return best.mapInArrow(lambda it: top_of_split(it, n, True), schema + ", place int")


def best_pairs(facts: DataFrame, n: int = 3) -> DataFrame:
    """For each dim1 member its ``n`` dim2 members with the largest click total of at least 1."""
    f = once(facts.filter("click is not null"), grp=hex_member(F.col("dim1")), item=hex_member(F.col("dim2")), click=F.col("click"))
    totals = f.filter("grp is not null and item is not null").groupBy("grp", "item").agg(F.sum("click").alias("score"))
    return top_items(totals.filter("score >= 1"), n)
