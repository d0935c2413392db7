"""The engine: cubes in a warehouse, compiled from batches or streams, queried by builder or dialect."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
from collections.abc import Callable, Collection, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from facetcube.model import Cube
from facetcube.operators.compile import compact, compile_batch, vacuum
from facetcube.plans.dialect import PreparedQuery
from facetcube.plans.query import CubeQuery
from facetcube.sources.catalog import Catalog
from facetcube.sources.yaml_model import load_cube
from facetcube.streaming.ingest import compile_stream


def ship(spark: SparkSession) -> None:
    """Send this package to the session's executors, once. Not needed where it is installed on them."""
    if not getattr(spark.sparkContext, "_facetcube_shipped", False):
        root = pathlib.Path(__file__).parent
        at = shutil.make_archive(str(pathlib.Path(tempfile.mkdtemp()) / root.name), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(at)
        spark.sparkContext._facetcube_shipped = True


class Engine:
    """All operations on the cubes below ``warehouse``."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.catalog = spark, Catalog(spark, warehouse)

    def deploy(self, cube: Cube | str) -> Cube:
        """Deploy a cube, or a YAML model."""
        cube = load_cube(cube) if isinstance(cube, str) else cube
        self.catalog.deploy(cube)
        return cube

    def _cube(self, cube: Cube | str) -> Cube:
        return self.catalog.load_model(cube) if isinstance(cube, str) else cube

    def drop(self, cube: Cube | str) -> None:
        self.catalog.drop(self._cube(cube))

    def compile(self, cube: Cube | str, facts: DataFrame, batch: str, include: Collection[str] | None = None, exclude: Collection[str] | None = None, groups: Collection[str] | None = None, **more: Any) -> list[str]:
        return compile_batch(self.catalog, self._cube(cube), facts, batch, include, exclude, groups, **more)

    def compile_stream(self, cube: Cube | str, facts: DataFrame, name: str, checkpoint: str, **more: Any) -> StreamingQuery:
        return compile_stream(self.catalog, self._cube(cube), facts, name, checkpoint, **more)

    def compact(self, cube: Cube | str, now: int | None = None, grace: float = 3600) -> None:
        """Compact every cuboid of a cube, drop what has outlived its TTL, and delete folders that no manifest has named for ``grace`` seconds."""
        cube = self._cube(cube)
        for c in cube.cuboids:
            compact(self.catalog, cube, c, now)
            vacuum(self.catalog, cube, c, grace)

    def vacuum(self, cube: Cube | str, grace: float = 3600) -> None:
        """Delete folders that no manifest names and that have not changed for ``grace`` seconds."""
        cube = self._cube(cube)
        for c in cube.cuboids:
            vacuum(self.catalog, cube, c, grace)

    def query(self, cube: Cube | str | None = None, strict: bool = False) -> CubeQuery:
        return CubeQuery(self.catalog, cube, strict)

    def prepare(self, text: str, strict: bool = False) -> PreparedQuery:
        return PreparedQuery(self.catalog, text, strict)

    def sql(self, text: str, *values: Any) -> DataFrame:
        """Run a query of the dialect with its parameters."""
        return self.prepare(text).execute(*values)


def rows(result: DataFrame) -> Iterator[Row]:
    """The rows as a cursor that fetches a partition ahead; access by alias or position."""
    return result.toLocalIterator(prefetchPartitions=True)


def to_frame(result: DataFrame, convert: Callable[[Any], Any] | None = None, post: Callable[[DataFrame], DataFrame] | None = None):
    """A pandas frame: bytes as upper-case hex, other values through ``convert``; ``post`` is applied to the result before."""
    frame = (post(result) if post else result).toPandas()
    for c, kind in result.dtypes:
        if kind == "binary" and c in frame:
            frame[c] = frame[c].map(lambda b: None if b is None else bytes(b).hex().upper())
        elif convert and c in frame and kind not in ("int", "bigint", "double", "string"):
            frame[c] = frame[c].map(convert)
    return frame


def write_text(result: DataFrame, path: str) -> None:
    """Tab-separated text files."""
    result.write.mode("overwrite").option("sep", "\t").csv(path)
