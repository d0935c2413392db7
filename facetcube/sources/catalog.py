"""Cubes in a warehouse folder: models, and which batches each cuboid consists of.

    <warehouse>/models/<cube>/v<N>.yaml      every saved version; the highest counts
    <warehouse>/data/<table>/manifest-<n>.json   live batches of a cuboid; the highest n counts
    <warehouse>/data/<table>/_attempt=<batch>-<id>/  Parquet files of a batch

A batch becomes visible, or is replaced, when the next manifest is published.
Several writers may work on a cuboid: each publishes a change of the newest
manifest.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from facetcube import storage
from facetcube.model import Cube, Cuboid, ModelError
from facetcube.sources.yaml_model import dump_cube, load_cube

CACHE_SECONDS = 600


class Catalog:
    """Models and manifests below ``warehouse``. Models are cached for ten minutes."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self._cache: dict[str, tuple[float, Cube]] = {}

    def _model_dir(self, name: str) -> str:
        return f"{self.warehouse}/models/{name}"

    def table(self, cube: Cube, cuboid: Cuboid) -> str:
        return f"{self.warehouse}/data/{cuboid.table_name(cube.name)}"

    def versions(self, name: str) -> list[int]:
        return sorted(int(v[1:-5]) for v in storage.names(self.spark, self._model_dir(name)) if v.startswith("v") and v.endswith(".yaml"))

    def save_model(self, cube: Cube) -> int:
        """Save a new version of the model; the number of the version."""
        v = (self.versions(cube.name) or [0])[-1] + 1
        storage.write_text(self.spark, f"{self._model_dir(cube.name)}/v{v}.yaml", dump_cube(cube))
        self._cache[cube.name] = (time.time(), cube)
        return v

    def load_model(self, name: str) -> Cube:
        at, cube = self._cache.get(name, (0.0, None))
        if cube is None or time.time() - at > CACHE_SECONDS:
            versions = self.versions(name)
            if not versions:
                raise ModelError(f"Unknown cube {name}")
            cube = load_cube(storage.read_text(self.spark, f"{self._model_dir(name)}/v{versions[-1]}.yaml") or "")
            self._cache[name] = (time.time(), cube)
        return cube

    def cubes(self) -> list[str]:
        return storage.names(self.spark, f"{self.warehouse}/models")

    def deploy(self, cube: Cube) -> None:
        """Save the model and make an empty dataset for each cuboid that has none. Never touches data."""
        self.save_model(cube)
        for c in cube.cuboids:
            if not storage.published(self.spark, self.table(cube, c), "manifest")[0]:
                storage.publish(self.spark, self.table(cube, c), "manifest", 1, {})

    def drop(self, cube: Cube) -> None:
        """Delete all cuboids' data; the model stays. Goes on after an error and raises the last one."""
        last: Exception | None = None
        for c in cube.cuboids:
            try:
                storage.delete(self.spark, self.table(cube, c))
            except Exception as e:  # noqa: BLE001
                last = e
        if last:
            raise last

    def _manifest(self, cube: Cube, cuboid: Cuboid) -> tuple[int, dict[str, dict]]:
        n, batches = storage.published(self.spark, self.table(cube, cuboid), "manifest")
        if not n:
            raise ModelError(f"cuboid {cuboid.path} of {cube.name} is not deployed")
        return n, batches

    def manifest(self, cube: Cube, cuboid: Cuboid) -> dict[str, dict]:
        """Live batches: name -> folder, when it was written, with which measures, and the batches that it has absorbed."""
        return self._manifest(cube, cuboid)[1]

    def update_manifest(self, cube: Cube, cuboid: Cuboid, change: Callable[[dict[str, dict]], dict[str, dict]], tries: int = 20) -> None:
        """Publish ``change`` of the newest manifest; if another writer was faster, of its one."""
        for left in range(tries - 1, -1, -1):
            n, batches = self._manifest(cube, cuboid)
            try:
                return storage.publish(self.spark, self.table(cube, cuboid), "manifest", n + 1, change(batches))
            except storage.Published:
                if not left:
                    raise
