"""A keyed table in hash parts, of which a change rewrites only those that hold its keys.

A version is a manifest: for each part, the version that wrote it last. Parts that a change does not touch stay where they
are, so a change of few keys writes few files, whatever the table holds. Beside each part lies a Bloom filter of its keys.
The manifest appears in one rename once all parts are written: a reader sees the old state or the new one, and a change applied twice ends in the
same state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import bloom
from ..storage import cut

#: Parts of a table. Fixed when it is made: about the store's size by that of a part, some hundred MB.
PARTS = 64


class KeyedTable:
    """One row for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "file_name", parts: int = PARTS, keep: int = 2):
        self.spark, self.path, self.key, self.parts, self.keep = spark, path.rstrip("/"), key, parts, keep

    # The manifests, through Spark's file system layer.

    def _fs(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *names):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))

    def versions(self) -> list[int]:
        _, fs = self._fs()
        if not fs.exists(self._at("manifest")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at("manifest"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """schema, parts (number of parts) and at (part -> version that wrote it) of the version, by default the last."""
        jvm, fs = self._fs()
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            return None
        file = fs.open(self._at("manifest", version))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _publish(self, version: int, manifest: dict) -> None:
        _, fs = self._fs()
        fs.mkdirs(self._at("manifest"))
        temporary = self._at("manifest", f"tmp-{uuid.uuid4().hex}")
        file = fs.create(temporary)
        file.write(bytearray(json.dumps(manifest).encode()))
        file.close()
        if not fs.rename(temporary, self._at("manifest", version)):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {version} is there already: one writer at a time")

    def _prune(self) -> None:
        """Manifests but the last ``keep``, and the parts that no manifest names any more."""
        _, fs = self._fs()
        versions = self.versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used = {(v, int(k)) for n in kept for k, v in self.manifest(n)["at"].items()}
        for n in old:
            for k, v in self.manifest(n)["at"].items():
                if (v, int(k)) not in used:
                    for kind in ("rows", "keys"):
                        fs.delete(self._at(kind, f"v={v}", f"part={k}"), True)
            fs.delete(self._at("manifest", n), False)

    # Reading.

    def part_of(self, key: Column) -> Column:
        return (bloom.words(key)[3] % self.parts).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows, of all parts or of some; none before the first change."""
        found = self.manifest()
        if found is None:
            return None
        schema = StructType.fromJson(found["schema"])
        paths = [f"{self.path}/rows/v={v}/part={k}" for k, v in found["at"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the keys: only their parts are read."""
        keys = keys.select(self.key).distinct()
        rows = self.read(self._touched(keys))
        return None if rows is None else rows.join(keys, self.key, "left_semi")

    def may_hold(self, rows: DataFrame, key: str | None = None, name: str = "may_hold") -> DataFrame:
        """rows with ``name``: false where the filters rule the key out, so that the table need not be read."""
        key, found = key or self.key, self.manifest()
        if found is None:
            return rows.withColumn(name, F.lit(False))
        paths = [f"{self.path}/keys/v={v}/part={k}" for k, v in found["at"].items()]
        schema = "part int, pages long, page long, bits binary"
        filters = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return bloom.ask(rows.withColumn("part", self.part_of(F.col(key))), filters, key, ("part",), name).drop("part")

    # Writing.

    def _touched(self, keys: DataFrame) -> list[int]:
        """The parts of the keys: at most ``parts`` numbers come to the driver."""
        return sorted(r[0] for r in keys.select(self.part_of(F.col(self.key)).alias("p")).where("p is not null").distinct().collect())

    def apply(self, upserts: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Rows of ``upserts`` (one for each key) replace or join the table's, keys of ``gone`` leave it unless they are among the
        upserts. Null keys are left out. Returns the parts that were rewritten."""
        upserts = cut(upserts.where(F.col(self.key).isNotNull()))
        keys = upserts.select(self.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(self.key))
        keys = cut(keys.where(F.col(self.key).isNotNull()).distinct())
        touched, found = self._touched(keys), self.manifest() or {"parts": self.parts, "at": {}}
        if found["parts"] != self.parts:
            raise ValueError(f"the table has {found['parts']} parts, not {self.parts}")
        version = max(self.versions(), default=0) + 1
        old = self.read(touched)
        rows = upserts if old is None else old.join(keys, self.key, "left_anti").unionByName(upserts, allowMissingColumns=True)
        if touched:
            # One task and one file for each part at most.
            dealt = rows.withColumn("part", self.part_of(F.col(self.key))).repartition(len(touched), "part").sortWithinPartitions("part")
            dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/v={version}")
            _, fs = self._fs()
            written = [int(s.getPath().getName()[5:]) for s in fs.listStatus(self._at("rows", f"v={version}")) if s.getPath().getName().startswith("part=")]
            paths = [f"{self.path}/rows/v={version}/part={k}" for k in written]
            if paths:
                held = self.spark.read.schema(rows.schema).parquet(*paths).select(self.part_of(F.col(self.key)).alias("part"), self.key)
                filters = bloom.build(held, self.key, ("part",)).withColumn("_p", F.col("part"))
                filters.repartition(len(written), "_p").sortWithinPartitions("_p").write.mode("overwrite").partitionBy("_p").parquet(f"{self.path}/keys/v={version}")
                for k in written:
                    fs.rename(self._at("keys", f"v={version}", f"_p={k}"), self._at("keys", f"v={version}", f"part={k}"))
        else:
            written = []
        at = {k: v for k, v in found["at"].items() if int(k) not in touched} | {str(k): version for k in written}
        self._publish(version, {"schema": json.loads(rows.schema.json()), "parts": self.parts, "at": at})
        self._prune()
        return touched
