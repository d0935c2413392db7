"""Incremental compilation of facts into cuboids.

A batch of facts becomes, for each cuboid, one dataset of cells: the additive
state of every measure for every key. Facts are grouped once, at the finest
level, and written; each coarser level is made of the cells of the level below
it. Batches are appended and merged when they are read, which is right because
states add; compaction writes them as one.

Columns of a cell: each flat dimension; ``<h>_level`` and ``<h>_key`` of each
hierarchy (0 and '' for ALL); ``<measure>__<field>`` for each state field;
``_written``, the seconds of the write; and ``<h>_month`` of the first
hierarchy, the first six digits of its key ('-' for ALL).

Layout: a batch has a folder for each level, in which the files are sorted by
time and then by the other keys, so that a slice reads the pages of its time;
the manifest notes the time range of each batch, and a slice opens those that it
meets. Compaction cuts the levels into months besides, each in files sorted by
the leading keys: a slice opens the folders of its months.

A batch is written to a folder of its own attempt, which the manifest names when
all is there: readers see the batch as it was, or as it is, and a failed attempt
leaves nothing but unnamed files (``vacuum`` removes them).
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Collection, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from facetcube import storage
from facetcube.functions.aggregates import FIELDS, AggFunction, Field
from facetcube.functions.folding import Decaying, Plain, fold, step_of
from facetcube.model import Cube, Cuboid, Hierarchy, Measure, ModelError
from facetcube.sources.catalog import Catalog

CUBOIDS_AT_ONCE = 4


def key_columns(cube: Cube, cuboid: Cuboid) -> list[str]:
    return [k for d in cuboid.dims for k in ((f"{d}_level", f"{d}_key") if cube.dimensions[d].depth else (d,))]


def base_fields(m: Measure) -> list[str]:
    return ["cnt"] if m.samples else list(FIELDS)


def own_fields(cube: Cube, m: Measure) -> dict[str, tuple[AggFunction, Field]]:
    """Fields that the model's own functions keep of a measure, by column."""
    fns = [f for f in cube.functions.values() if isinstance(f, AggFunction) and not m.samples]
    return {f"{m.name}__{f.name}__{n}": (f, x) for f in fns for n, x in f.fields}


def state_columns(cube: Cube, m: Measure) -> list[str]:
    """Columns of a measure's state."""
    return [f"{m.name}__{f}" for f in base_fields(m)] + [*own_fields(cube, m)] + [f"{m.name}__{s.name}__{f}" for s in cube.summaries(m) for f in s.summarizer.fields]


def joined(parts: Iterable[Decaying]) -> list[Decaying]:
    """Sums with one time and equal steps as one."""
    out: dict[tuple[str, float], Decaying] = {}
    for p in parts:
        d = out.setdefault((p.time.rsplit("__", 2)[0], step_of(min(tau for _, _, tau in p.sums))), Decaying(p.time))
        d.sums += p.sums
        d.firsts += p.firsts
        d.times += p.times
    return list(out.values())


def encode(facts: DataFrame, cube: Cube, dims: Iterable[str], measures: Iterable[str]) -> DataFrame:
    """Facts as keys of the dimensions (of hierarchies the finest level) and converted measures."""
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    out: dict[str, Column] = {}
    for d in dims:
        if d not in kinds:
            raise ModelError(f"the facts have no column {d}")
        dim, c = cube.dimensions[d], facts[d]
        if dim.depth:
            out[f"{d}_key"] = dim.level_key(c, kinds[d], dim.depth)
        else:
            out[d] = dim.key_or_error(c, kinds[d])
    for m in measures:
        if m not in kinds:
            raise ModelError(f"the facts have no column {m}")
        for part, c in cube.measures[m].columns(facts[m], kinds[m]).items():
            out[f"{m}__{part}"] = c
    return facts.select(*(c.alias(n) for n, c in out.items()))


def merge_cells(cells: DataFrame, keys: list[str], cube: Cube, measures: Iterable[str], fields: dict[str, set[str]] | None = None, weight: Column | None = None, extra: Iterable[Plain] = ()) -> DataFrame:
    """Cells added up by ``keys``. ``fields``: those wanted of each measure (default: all). ``weight`` of -1 takes cells away."""
    plain: list[Plain] = []
    decaying: list[Decaying] = []
    present = set(cells.columns)
    for name in measures:
        m = cube.measures[name]
        wanted = fields[name] if fields else None
        for c, f, owner in [*((f"{name}__{f}", FIELDS[f], f) for f in base_fields(m)), *((c, f, fn.name) for c, (fn, f) in own_fields(cube, m).items())]:
            if c in present and (wanted is None or owner in wanted):
                x = F.col(f"`{c}`")
                plain.append(Plain(c, f.of_cells(x * weight if weight is not None and f.additive else x), f.of_cells))
        for s in cube.summaries(m):
            prefix = f"{name}__{s.name}__"
            if f"{prefix}t" in present and (wanted is None or s.name in wanted):
                decaying.append(s.summarizer.of_states(prefix, "_weight" if weight is not None else None))
    plain += extra
    if weight is not None and decaying:
        cells = cells.withColumn("_weight", weight)
    if not plain and not decaying:
        plain = [Plain("_cells", F.count(F.lit(1)), F.sum)]
    return fold(cells, keys, plain, joined(decaying))


def finest_cells(encoded: DataFrame, cube: Cube, cuboid: Cuboid, measures: list[str]) -> DataFrame:
    """Cells of a cuboid at the finest level of its hierarchies, from encoded facts."""
    hierarchies = cube.hierarchies(cuboid)
    keys = [d for d in cuboid.dims if not cube.dimensions[d].depth] + [f"{h.name}_key" for h in hierarchies]
    plain: list[Plain] = []
    decaying: list[Decaying] = []
    for name in measures:
        m, x = cube.measures[name], F.col(f"`{name}__x`")
        plain += [Plain(f"{name}__{f}", FIELDS[f].of_facts(x), FIELDS[f].of_cells) for f in base_fields(m)]
        plain += [Plain(c, f.of_facts(x).cast(f.kind), f.of_cells) for c, (_, f) in own_fields(cube, m).items()]
        decaying += [s.summarizer.of_samples(f"{name}__x", f"{name}__t", f"{name}__{s.name}__") for s in cube.summaries(m)]
    # no fact with the measure: no state
    made = {f"{h.name}_level": f"{h.depth} as `{h.name}_level`" for h in hierarchies} | {f"`{name}__cnt`": f"nullif(`{name}__cnt`, 0L) as `{name}__cnt`" for name in measures}
    return fold(encoded, keys, plain, joined(decaying)).selectExpr(*(made.get(c, c) for c in _all_columns(cube, cuboid, measures)))


def rolled_up(cells: DataFrame, cube: Cube, cuboid: Cuboid, measures: list[str], h: Hierarchy, level: int) -> DataFrame:
    """Cells of a coarser level of a hierarchy from those of the level below it."""
    below = cells.filter(F.col(f"{h.name}_level") == level + 1)
    up = below.withColumns({f"{h.name}_level": F.lit(level), f"{h.name}_key": h.up(F.col(f"{h.name}_key"), level)})
    return merge_cells(up, key_columns(cube, cuboid), cube, measures)


def _all_columns(cube: Cube, cuboid: Cuboid, measures: Iterable[str]) -> list[str]:
    return key_columns(cube, cuboid) + [f"`{c}`" for name in measures for c in state_columns(cube, cube.measures[name])]


def lattice(cuboids: list[Cuboid]) -> dict[Cuboid, Cuboid | None]:
    """For each cuboid the one to derive it from: the smallest that has all of its dimensions and more; None: from facts."""
    return {c: min((p for p in cuboids if set(p.dims) > set(c.dims)), key=lambda p: len(p.dims), default=None) for c in cuboids}


def derive_cells(cells: DataFrame, cube: Cube, parent: Cuboid, cuboid: Cuboid, measures: list[str]) -> DataFrame:
    """Cells of a cuboid from those of one with more dimensions; of hierarchies that it lacks, the cells of ALL.

    Facts are read for the roots of the lattice only. Levels are in the
    parent's cells already and need no rolling up.
    """
    for h in cube.hierarchies(parent):
        if h.name not in cuboid.dims:
            cells = cells.filter(F.col(f"{h.name}_level") == 0)
    return merge_cells(cells, key_columns(cube, cuboid), cube, measures)


def month_column(cube: Cube, cuboid: Cuboid) -> str | None:
    """Column of the folders that a cuboid is cut into beside the levels."""
    hierarchies = cube.hierarchies(cuboid)
    return f"{hierarchies[0].name}_month" if hierarchies else None


def cell_schema(cube: Cube, cuboid: Cuboid, measures: Iterable[str]) -> str:
    """Schema of the files of a cuboid, as DDL."""
    kinds = {k: "int" if k.endswith("_level") and k[:-6] in cube.dimensions else "string" for k in key_columns(cube, cuboid)}
    for name in measures:
        own = own_fields(cube, cube.measures[name])
        kinds |= {c: "bigint" if c == f"{name}__cnt" else own[c][1].kind if c in own else "double" for c in state_columns(cube, cube.measures[name])}
    kinds["_written"] = "bigint"
    if month := month_column(cube, cuboid):
        kinds[month] = "string"
    return ", ".join(f"`{k}` {t}" for k, t in kinds.items())


def chosen_cuboids(cube: Cube, groups: Collection[str] | None) -> list[Cuboid]:
    """Cuboids of the compiler groups; all without groups; an error if there are none."""
    found = [c for c in cube.cuboids if not groups or c.compiler_group in groups]
    if not found:
        raise ModelError(f"no cuboid in the compiler groups {sorted(groups or ())}")
    return found


def chosen_measures(cube: Cube, include: Collection[str] | None, exclude: Collection[str] | None) -> list[str]:
    """Measures to compile: of the included ones (default: all) those not excluded."""
    for m in (*(include or ()), *(exclude or ())):
        if m not in cube.measures:
            raise ModelError(f"Unknown measure {m}")
    found = [m for m in cube.measures if (not include or m in include) and m not in (exclude or ())]
    if not found:
        raise ModelError("no measure is left to compile")
    return found


def compile_batch(catalog: Catalog, cube: Cube, facts: DataFrame, batch: str, include: Collection[str] | None = None, exclude: Collection[str] | None = None, groups: Collection[str] | None = None, spread: int | None = None, keep: bool = False, absorbed: str = "error") -> list[str]:
    """Compile facts as the batch ``batch``; a batch of that name is replaced. The paths of the cuboids written.

    A batch that a compaction has absorbed cannot be replaced: its cells are
    one with others'. That is an error, or with ``absorbed="skip"`` leaves the
    batch as it is (right for the same facts delivered again, as by a stream).
    Cuboids whose dimensions another one has are derived from its cells.
    ``spread`` deals the facts into so many parts first: for inputs of a few
    splits, such as files of one row group, that would leave cores idle.
    ``keep`` holds the encoded facts, on disk if need be, while several roots of
    the lattice are made of them: for facts that cost more to make than to keep.
    """
    if not batch or "/" in batch or batch.startswith(("_", ".")):
        raise ModelError(f"{batch!r} is no name of a batch")
    spark, measures = facts.sparkSession, chosen_measures(cube, include, exclude)
    todo = []
    for cuboid in chosen_cuboids(cube, groups):
        if any(holds(b.get("absorbed", {}), batch) for b in catalog.manifest(cube, cuboid).values()):
            if absorbed != "skip":
                raise ModelError(f"batch {batch} of cuboid {cuboid.path} has been absorbed by a compaction and cannot be replaced")
            continue
        todo.append(cuboid)
    parents = lattice(todo)
    roots = [c for c in todo if parents[c] is None]
    if spread:
        facts = facts.repartition(spread)
    encoded = encode(facts, cube, dict.fromkeys(d for c in roots for d in c.dims), measures)
    keep = keep and len(roots) > 1
    if keep:
        encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)
    attempt = {c: f"_attempt={batch}-{uuid.uuid4().hex[:12]}" for c in todo}
    ranges: dict[str, list[str] | None] = {}  # of the hierarchies' finest keys in the facts, noted while they are written

    def noted(cells: DataFrame, cuboid: Cuboid) -> tuple[DataFrame, Observation | None]:
        if not (names := [h.name for h in cube.hierarchies(cuboid)]):
            return cells, None
        seen = Observation()
        return cells.observe(seen, *(f(f"{n}_key").alias(f"{k}_{n}") for n in names for k, f in (("a", F.min), ("b", F.max)))), seen

    def one(cuboid: Cuboid) -> Cuboid:
        path = f"{catalog.table(cube, cuboid)}/{attempt[cuboid]}"
        if (parent := parents[cuboid]) is None:
            cells, seen = noted(finest_cells(encoded, cube, cuboid, measures), cuboid)
            _write(cube, cuboid, cells, path)
            if seen:
                ranges.update({h.name: [seen.get[f"a_{h.name}"], seen.get[f"b_{h.name}"]] for h in cube.hierarchies(cuboid)})
            for h in cube.hierarchies(cuboid):
                for level in range(h.depth - 1, -1, -1):
                    _write(cube, cuboid, rolled_up(_read(spark, cube, cuboid, measures, path), cube, cuboid, measures, h, level), path)
        else:
            made = _read(spark, cube, parent, measures, f"{catalog.table(cube, parent)}/{attempt[parent]}")
            _write(cube, cuboid, derive_cells(made, cube, parent, cuboid, measures), path)
        span = ranges.get(cube.hierarchies(cuboid)[0].name) if cube.hierarchies(cuboid) else None
        entry = {"path": attempt[cuboid], "written": int(time.time()), "measures": measures, "range": span if span and span[0] else None}
        catalog.update_manifest(cube, cuboid, lambda batches: batches | {batch: entry})
        return cuboid

    written: list[Cuboid] = []
    try:
        with ThreadPoolExecutor(CUBOIDS_AT_ONCE) as pool:  # small cuboids leave cores idle: their jobs overlap
            while len(written) < len(todo):
                ready = [c for c in todo if c not in written and (parents[c] is None or parents[c] in written)]
                written += [j.result() for j in [pool.submit(inheritable_thread_target(spark)(one), c) for c in ready]]
    finally:
        if keep:
            encoded.unpersist()
    return [c.path for c in written]


def _write(cube: Cube, cuboid: Cuboid, cells: DataFrame, path: str, by_month: bool = False) -> None:
    """Add cells to a folder, by level and, if asked, by month.

    For months, rebalancing brings the rows of a folder together; the runtime
    splits what is large and joins what is small, so files have the advisory size.
    """
    keys, hierarchies, month = key_columns(cube, cuboid), cube.hierarchies(cuboid), month_column(cube, cuboid)
    more = {} if "_written" in cells.columns else {"_written": F.lit(int(time.time())).cast("bigint")}
    folders = [f"{h.name}_level" for h in hierarchies]
    rest = [k for k in keys if k not in folders]
    if month:
        first = f"{hierarchies[0].name}_key"
        more[month] = F.when(F.col(first) == "", F.lit("-")).otherwise(F.substring(first, 1, 6))
        if by_month:
            folders.append(month)
        else:
            rest = [first, *(k for k in rest if k != first)]
    cells = cells.withColumns(more) if more else cells
    if by_month and month:
        cells = cells.hint("rebalance", *folders)
    writer = cells.sortWithinPartitions(*folders, *rest).write.mode("append")
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def _read(spark: SparkSession, cube: Cube, cuboid: Cuboid, measures: Iterable[str], *paths: str) -> DataFrame:
    return spark.read.schema(cell_schema(cube, cuboid, measures)).option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths)


def read_cells(catalog: Catalog, cube: Cube, cuboid: Cuboid, batches: dict[str, dict] | None = None) -> DataFrame:
    """All live cells of a cuboid (or those of the given batches), unmerged. Measures missing in a batch are null."""
    batches = catalog.manifest(cube, cuboid) if batches is None else batches
    measures = [m for m in dict.fromkeys(m for b in batches.values() for m in b["measures"]) if m in cube.measures]
    if not batches:
        return catalog.spark.createDataFrame([], cell_schema(cube, cuboid, cube.measures))
    table = catalog.table(cube, cuboid)
    layouts = [[f"{table}/{b['path']}" for _, b in sorted(batches.items()) if b.get("by_month", False) == x] for x in (False, True)]
    return reduce(DataFrame.unionByName, (_read(catalog.spark, cube, cuboid, measures, *paths) for paths in layouts if paths))


def within(batches: dict[str, dict], low: str | None, high: str | None) -> dict[str, dict]:
    """Batches that may have cells of the first hierarchy's keys from ``low`` to ``high``."""
    out = {}
    for name, b in batches.items():
        first, last = b.get("range") or (None, None)
        if first is None or ((high is None or first[: len(high)] <= high) and (low is None or last[: len(low)] >= low)):
            out[name] = b
    return out


def _last_write() -> Plain:
    return Plain("_written", F.max("_written"), F.max)


def unexpired(cells: DataFrame, cube: Cube, cuboid: Cuboid, batches: dict[str, dict], now: int | None = None) -> DataFrame:
    """Cells that have not outlived the cuboid's TTL, which counts from a cell's last write in any batch.

    Only if a batch is that old, cells are merged by their whole key first.
    """
    now = int(time.time()) if now is None else now
    if not cuboid.ttl or all(b.get("oldest", b["written"]) >= now - cuboid.ttl for b in batches.values()):
        return cells
    measures = [m for m in cube.measures if f"{m}__cnt" in cells.columns]
    keys, month = key_columns(cube, cuboid), month_column(cube, cuboid)
    merged = merge_cells(cells, [*keys, month] if month else keys, cube, measures, extra=[_last_write()])
    return merged.filter(F.col("_written") >= now - cuboid.ttl)


def compact(catalog: Catalog, cube: Cube, cuboid: Cuboid, now: int | None = None) -> str | None:
    """Merge all batches of a cuboid into one, without cells older than its TTL; the new batch's name.

    A cell's age counts from its last write in any batch. Batches that come in
    meanwhile stay as they are; if one that is merged here is replaced
    meanwhile, this compaction ends with a ``Conflict`` and changes nothing.
    """
    batches = catalog.manifest(cube, cuboid)
    if not batches:
        return None
    cells = read_cells(catalog, cube, cuboid, batches)
    now = int(time.time()) if now is None else now
    measures = [m for m in cube.measures if f"{m}__cnt" in cells.columns]
    merged = merge_cells(cells, key_columns(cube, cuboid), cube, measures, extra=[_last_write()])
    if cuboid.ttl:
        merged = merged.filter(F.col("_written") >= now - cuboid.ttl)
    name = f"compacted-{time.time_ns()}"
    path = f"_attempt={name}"
    _write(cube, cuboid, merged, f"{catalog.table(cube, cuboid)}/{path}", by_month=True)
    ranges = [b.get("range") for b in batches.values()]
    entry = {"path": path, "by_month": month_column(cube, cuboid) is not None, "range": [min(r[0] for r in ranges), max(r[1] for r in ranges)] if all(ranges) else None, "written": max(b["written"] for b in batches.values()), "oldest": min(b.get("oldest", b["written"]) for b in batches.values()), "measures": measures}
    entry["absorbed"] = gathered([b.get("absorbed", {}) for b in batches.values()], [b for b in batches if not b.startswith("compacted-")])

    def swap(live: dict[str, dict]) -> dict[str, dict]:
        if any(live.get(b, {}).get("path") != v["path"] for b, v in batches.items()):
            raise storage.Conflict(f"a batch of cuboid {cuboid.path} was replaced during the compaction")
        return {b: v for b, v in live.items() if b not in batches} | {name: entry}

    catalog.update_manifest(cube, cuboid, swap)
    return name


def vacuum(catalog: Catalog, cube: Cube, cuboid: Cuboid, grace: float = 3600) -> list[str]:
    """Delete folders that the manifest does not name and that have not changed for ``grace`` seconds: replaced, absorbed and failed batches. Their names."""
    table, live = catalog.table(cube, cuboid), {b["path"] for b in catalog.manifest(cube, cuboid).values()}
    gone = [n for n in storage.folders(catalog.spark, table, older_than=time.time() - grace) if n not in live]
    for n in gone:
        storage.delete(catalog.spark, f"{table}/{n}")
    return gone


# Names of absorbed batches: names that end in a number, as those of micro-batches do, are kept as ranges of it.


def _stem(batch: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"(.*-)(0|[1-9]\d*)", batch)
    return (m[1], int(m[2])) if m else (batch, None)


def holds(absorbed: dict[str, list], batch: str) -> bool:
    stem, n = _stem(batch)
    return stem in absorbed and (n is None or any(a <= n <= b for a, b in absorbed[stem]))


def gathered(absorbed: Iterable[dict[str, list]], batches: Iterable[str]) -> dict[str, list]:
    out: dict[str, set] = {}
    for a in absorbed:
        for stem, ranges in a.items():
            out.setdefault(stem, set()).update(x for low, high in ranges for x in range(low, high + 1))
    for stem, n in map(_stem, batches):
        out.setdefault(stem, set()).update(() if n is None else (n,))
    ranges: dict[str, list] = {}
    for stem, numbers in out.items():
        ranges[stem] = []
        for n in sorted(numbers):
            if ranges[stem] and ranges[stem][-1][1] == n - 1:
                ranges[stem][-1][1] = n
            else:
                ranges[stem].append([n, n])
    return ranges
