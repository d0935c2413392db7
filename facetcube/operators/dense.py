"""Per-key results with even load, however the records are spread over the keys.

The input lies in splits of equal size (facts are spread by their own id). Each
split dictionary-encodes its keys and adds up counts and amounts in dense
arrays with one slot a key (``bincount``). The arrays are cut into blocks by a
hash of the key, and the blocks of all splits are added up block by block. A
key that holds most records is one slot of an array in every split: it costs
no task more than any other key does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetcube.operators.facts import hex_member, once

#: Rows a dense array is built from, and the low bits of an amount that are added apart, so that sums in doubles stay exact.
ROWS_A_CHUNK = 1 << 19
LOW_BITS = 24
#: Slots of a block that are held before they are folded.
SLOTS = 1 << 18


def exact_bincount(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of int64 ``values`` by code. Low and high parts are added apart: doubles hold both sums exactly."""
    low = values & ((1 << LOW_BITS) - 1)
    total = np.bincount(codes, weights=low, minlength=size).astype(np.int64)
    high = values >> LOW_BITS
    if high.any():
        total += np.bincount(codes, weights=high, minlength=size).astype(np.int64) << LOW_BITS
    return total


def key_block(keys: pa.Array, blocks: int) -> np.ndarray:
    """Block of each key: FNV-1a over the key's length and bytes, column by column."""
    lengths = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    h = np.uint64(14695981039346656037) ^ lengths.astype(np.uint64)
    prime = np.uint64(1099511628211)
    offsets = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1 + keys.offset)[keys.offset :].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)
    for i in range(int(lengths.max(initial=0))):
        has = lengths > i
        h[has] = (h[has] ^ data[offsets[:-1][has] + i]) * prime
    h ^= h >> np.uint64(32)
    return (h % np.uint64(blocks)).astype(np.int32)


def split_blocks(batches: Iterator[pa.RecordBatch], fields: Sequence[str], amounts: Sequence[str], blocks: int) -> Iterator[pa.RecordBatch]:
    """Dense arrays of a split: a row for each field and block with its dictionary and one array for each amount."""

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for field in fields:
            coded = rows[field].combine_chunks()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.binary())
            coded = coded.dictionary_encode()
            has = coded.is_valid().to_numpy(zero_copy_only=False)
            codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)[has]
            size = len(coded.dictionary)
            if not size:
                continue
            arrays = [np.bincount(codes, minlength=size).astype(np.int64)]
            for a in amounts:
                column = rows[a]
                arrays.append(exact_bincount(codes, column.fill_null(0).to_numpy().astype(np.int64)[has], size))
                arrays.append(np.bincount(codes[column.is_valid().to_numpy()[has]], minlength=size).astype(np.int64))
            block = key_block(coded.dictionary, blocks)
            order = np.argsort(block, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
            keys = coded.dictionary.take(pa.array(order))
            out = [(b, s, e) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > s]
            stacked = np.stack([a[order] for a in arrays])
            yield pa.RecordBatch.from_arrays([
                pa.array([field] * len(out)), pa.array([b for b, _, _ in out], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0] + [int(x) for x in np.cumsum([e - s for _, s, e in out])], pa.int32()), keys),
                pa.array([np.ascontiguousarray(stacked[:, s:e]).tobytes() for _, s, e in out], pa.binary()),
            ], ["field", "block", "keys", "arrays"])

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS_A_CHUNK:
            yield from emit(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from emit(pa.Table.from_batches(held))


def sum_blocks(tables: Iterator[pa.RecordBatch], width: int, names: Sequence[str], slots: int = SLOTS) -> Iterator[pa.RecordBatch]:
    """Add up the blocks of a sorted partition: dictionaries are united, arrays scattered into the united slots.

    A block is folded while it is read, whenever ``slots`` slots, and twice as
    many as it has keys, are held: memory is that of the keys of one block,
    however many splits send to it.
    """

    def fold(keys: list[pa.Array], arrays: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        united = pa.concat_arrays(keys).dictionary_encode()
        codes, size = united.indices.to_numpy(), len(united.dictionary)
        stacked = np.concatenate(arrays, axis=1)
        return united.dictionary, np.stack([exact_bincount(codes, stacked[i], size) for i in range(width)])

    def finish(field: str) -> pa.RecordBatch:
        united, sums = fold(keys, arrays)
        return pa.RecordBatch.from_arrays([pa.array([field] * len(united)), united, *map(pa.array, sums)], ["field", "item", *names])

    at, keys, arrays, held, most = None, [], [], 0, slots
    for b in tables:
        fields, blocks, ks, xs = (b.column(i) for i in range(4))
        for i in range(b.num_rows):
            key = (fields[i].as_py(), blocks[i].as_py())
            if at is not None and key != at:
                yield finish(at[0])
                keys, arrays, held, most = [], [], 0, slots
            at = key
            keys.append(ks[i].values)
            arrays.append(np.frombuffer(xs[i].as_py(), np.int64).reshape(width, -1))
            held += arrays[-1].shape[1]
            if held >= most:
                united, sums = fold(keys, arrays)
                keys, arrays, held = [united], [sums], len(united)
                most = max(slots, 2 * held)
    if at is not None:
        yield finish(at[0])


def per_key(rows: DataFrame, fields: Sequence[str], amounts: Sequence[str], blocks: int | None = None, spread: int | None = None) -> DataFrame:
    """Results of every key of each binary column in ``fields``.

    Columns: field, item (the key), facts (rows with that key) and, for each
    amount, ``sum_a`` and ``n_a`` (non-null values). Null keys are no keys; null
    amounts add nothing; an empty input gives no rows. ``blocks`` (default: four
    times the shuffle partitions): a reducer holds the keys of one of them at a
    time. Load is even if the splits are: ``spread`` deals rows of an input
    with uneven ones into so many first.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or 4 * parts
    if spread:
        rows = rows.repartition(spread)
    names = ["facts", *(x for a in amounts for x in (f"sum_{a}", f"n_{a}"))]
    fields, amounts = list(fields), list(amounts)
    partial = rows.select(*fields, *(F.col(a).cast("bigint").alias(a) for a in amounts)).mapInArrow(lambda it: split_blocks(it, fields, amounts, blocks), "field string, block int, keys array<binary>, arrays binary")
    sorted_blocks = partial.repartition(parts, "field", "block").sortWithinPartitions("field", "block")
    return sorted_blocks.mapInArrow(lambda it: sum_blocks(it, len(names), names), "field string, item binary, " + ", ".join(f"{n} bigint" for n in names))


def member_results(facts: DataFrame, fields: Sequence[str] = ("dim1", "dim2")) -> DataFrame:
    """Facts, impCnt and click of each member of the binary dimensions of ``compiler_input``."""
    members: dict[str, Column] = {f: hex_member(F.col(f)) for f in fields}
    return per_key(once(facts, **members, impCnt=F.col("impCnt"), click=F.col("click")), fields, ["impCnt", "click"])


def holding_share(results: DataFrame, share: float) -> DataFrame:
    """The keys of ``per_key`` that hold at least ``share`` of the rows with a key in their field."""
    totals = results.groupBy("field").agg(F.sum("facts").alias("_total"))
    return results.join(F.broadcast(totals), "field").filter(F.col("facts") * 1_000_000 >= F.col("_total") * round(share * 1_000_000)).drop("_total")
