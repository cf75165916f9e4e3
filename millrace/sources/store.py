"""A replica as versions of Parquet tables: rows, positions, row states and dead letters become visible together, by one
renamed manifest that names their paths.

Tables with a key are kept in buckets by its hash; a commit rewrites the buckets that it touches and keeps the others.
Every write goes to a path of its own, so a writer that loses a race has changed nothing that a manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class VersionedStore:
    """Tables under a path that any Hadoop file system reaches. A batch that is in a manifest isn't applied again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return 0
        return max((int(n.removesuffix(".json")) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"version": 0, "batch": None, "paths": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_manifest/{n}.json").collect()))

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, part: str, schema: object = None, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The current rows of a part, or of some of its buckets; None if it has none."""
        paths = (self.manifest() if manifest is None else manifest)["paths"].get(part, {})
        paths = [p for b, p in paths.items() if buckets is None or int(b) in buckets]
        if not paths:
            return None
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*[f"{self.path}/{p}" for p in paths])

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None, keys: dict[str, tuple[str, list[int]]] | None = None, append: tuple[str, ...] = (), base: dict | None = None) -> int:
        """Writes the tables, then makes them current; raises Conflict if someone else was first.

        keys: of a table in buckets, its key and the buckets that its rows replace; other tables are replaced whole, those
        of append added to. Tables that aren't given stay. base: the manifest that the tables were made from.
        """
        base = self.manifest() if base is None else base
        n, paths = base["version"] + 1, {p: dict(x) for p, x in base["paths"].items()}
        for part, table in tables.items():
            path = f"{part}/{uuid.uuid4().hex}"
            if keys and part in keys:
                key, touched = keys[part]
                table.withColumn(BUCKET, self.bucket(key)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{path}")
                rest = {b: p for b, p in paths.get(part, {}).items() if int(b) not in touched}
                names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{path}"))]
                paths[part] = rest | {x.partition("=")[2]: f"{path}/{x}" for x in names if x.startswith(f"{BUCKET}=")}
            else:
                table.write.parquet(f"{self.path}/{path}")
                paths[part] = (paths.get(part, {}) if part in append else {}) | {str(n if part in append else 0): path}
        final, temp = (self._path(f"{self.path}/_manifest/{name}") for name in (f"{n}.json", f"{n}.{uuid.uuid4().hex}.tmp"))
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"version": n, "batch": batch, "paths": paths}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise Conflict(f"version {n} is there already")
        return n
