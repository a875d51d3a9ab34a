"""Durable state of a streaming job: batch parts that are merged as they age, behind a manifest.

A micro-batch adds one part. As soon as `fan` parts of one generation stand side by side they become
one part of the next generation, so after n batches a store has in the order of log n parts, and a
row is rewritten once per generation. What a version consists of is written down in its manifest,
one small file per batch, which appears under its name only when all its parts are there. A reader
takes one manifest and sees that version whole, whatever the writer does meanwhile. A batch that is
run again starts from the version before it and replaces its own parts and manifest.

Parts and manifests of the last `keep` versions stay, for readers that are still at work and for the
batch that is run again; older ones are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geovis.sources.files import Files

Part = tuple[int, int, int]  # first batch, last batch, generation


class Store:
    """Parts of `schema` (None: as its files say) below `folder`; `merge` adds up the rows of several
    parts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | None, merge: Callable[[DataFrame], DataFrame], fan: int = 4, keep: int = 3) -> None:
        self.spark, self.folder, self.schema, self.merge, self.fan, self.keep = spark, folder, schema, merge, fan, keep
        self.files = Files(spark, folder)

    def versions(self) -> list[int]:
        """The batches that have a manifest, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json"))

    def parts(self, version: int | None) -> list[Part]:
        if version is None:
            return []
        return [tuple(p) for p in json.loads(self.files.read(f"manifests/{version}.json"))]

    def part_path(self, part: Part) -> str:
        first, last, _ = part
        return f"{self.folder}/parts/{first}-{last}"

    def latest(self, before: int | None = None) -> int | None:
        """The newest version, or the newest one below a batch."""
        found = [v for v in self.versions() if before is None or v < before]
        return found[-1] if found else None

    def rows(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(*[self.part_path(p) for p in parts])

    def read(self, version: int | None = None) -> DataFrame:
        """The merged rows of a version, the newest one unless it is named."""
        return self.merge(self.rows(self.parts(self.latest() if version is None else version)))

    def before(self, batch: int) -> DataFrame:
        """The merged rows that the batches before this one left."""
        return self.merge(self.rows(self.parts(self.latest(batch))))

    def add(self, batch: int, rows: DataFrame) -> None:
        """Add the rows of a batch and write the version it makes."""
        columns = self.rows([]).columns if self.schema else rows.columns
        parts = [*self.parts(self.latest(batch)), (batch, batch, 0)]
        rows.select(*columns).write.mode("overwrite").parquet(self.part_path(parts[-1]))
        while len(parts) >= self.fan and len({p[2] for p in parts[-self.fan :]}) == 1:
            old = parts[-self.fan :]
            new = (old[0][0], old[-1][1], old[0][2] + 1)
            self.merge(self.rows(old)).select(*columns).write.mode("overwrite").parquet(self.part_path(new))
            parts = [*parts[: -self.fan], new]
        self.write_manifest(batch, parts)
        self.forget()

    def write_manifest(self, batch: int, parts: list[Part]) -> None:
        self.files.replace(f"manifests/{batch}.json", json.dumps(parts))

    def forget(self) -> None:
        """Delete what none of the last versions has."""
        versions = self.versions()
        used = {self.part_path(p).rsplit("/", 1)[-1] for v in versions[-self.keep :] for p in self.parts(v)}
        for version in versions[: -self.keep]:
            self.files.delete(f"manifests/{version}.json")
        for name in set(self.files.names("parts")) - used:
            self.files.delete(f"parts/{name}")
