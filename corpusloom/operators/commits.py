"""Several tables that change together.

A batch writes its rows of all tables beside the old ones, then one small file, the manifest of a new version, makes them
all visible at once. Readers follow the latest manifest, so that they see all tables before a batch or all after it. What
a batch that failed has written is in no manifest and is never read. A batch that is in the manifest already changes
nothing when it is run again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table of documents that a batch replaces.
REPLACED = "replaced"


class Tables:
    """Tables under one folder, which all executors must share. key tells documents."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id") -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def manifest(self) -> dict:
        """version, and the batches so far: each one's name, and the folder and schema of each of its tables."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "batches": []}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{names[-1]}").collect()))

    def commit(self, batch: str, tables: dict[str, DataFrame], replaces: DataFrame | None = None) -> bool:
        """Makes rows of some tables visible together; False if the batch is there already.

        The documents in replaces lose all rows that earlier batches gave them, in every table. Of two writers of one
        version the later one fails, and may be run again."""
        seen = self.manifest()
        if any(b["name"] == batch for b in seen["batches"]):
            return False
        written = {}
        if replaces is not None:
            tables = tables | {REPLACED: replaces.select(self.key).distinct()}
        for name, df in tables.items():
            folder = f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            written[name] = {"folder": folder, "schema": df.schema.jsonValue()}
        self._publish({"version": seen["version"] + 1, "batches": [*seen["batches"], {"name": batch, "tables": written}]})
        return True

    def _publish(self, manifest: dict) -> None:
        """Puts a manifest in place if no other has its version."""
        made, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{manifest['version']:012}.json")
        out = self._fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(made, final):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {manifest['version']} is there already")

    def _parts(self, manifest: dict, name: str) -> DataFrame | None:
        from pyspark.sql.types import StructType

        found = None
        for number, b in enumerate(manifest["batches"]):
            if name in b["tables"]:
                own = b["tables"][name]
                part = self.spark.read.schema(StructType.fromJson(own["schema"])).parquet(f"{self.root}/{own['folder']}").withColumn("batch_", F.lit(number))
                found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        return found

    def read(self, name: str) -> DataFrame | None:
        """A table as of the latest version, or None if no batch has written it. Rows without a document are never replaced."""
        manifest = self.manifest()
        rows, replaced = self._parts(manifest, name), self._parts(manifest, REPLACED)
        if rows is None or replaced is None:
            return None if rows is None else rows.drop("batch_")
        last = replaced.groupBy(self.key).agg(F.max("batch_").alias("last_"))
        return rows.join(last, self.key, "left").where(F.col("last_").isNull() | (F.col("batch_") >= F.col("last_"))).select(*[c for c in rows.columns if c != "batch_"])

    def compact(self) -> None:
        """Writes each table's visible rows as one batch and lets the manifest name it alone; files of before stay for readers of before."""
        seen = self.manifest()
        names = {n for b in seen["batches"] for n in b["tables"]} - {REPLACED}
        written = {}
        for name in sorted(names):
            df, folder = self.read(name), f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            written[name] = {"folder": folder, "schema": df.schema.jsonValue()}
        done = [{"name": b["name"], "tables": {}} for b in seen["batches"]]
        self._publish({"version": seen["version"] + 1, "batches": [*done, {"name": f"compacted-{seen['version']}", "tables": written}]})
