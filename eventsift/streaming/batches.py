"""Results of micro-batches as Parquet folders that readers see only when they are complete."""

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventsift.storage import discard


@dataclass
class BatchTable:
    """A growing table under ``path`` with one writer and any number of readers.

    Every batch is written to a folder of its own, and then a new version of the manifest, a list of batch numbers
    and their folders, takes its place by one rename. A batch that is written again replaces its rows; one that breaks off before
    its version is there has left nothing to be seen. ``compact`` joins old batches, ``clean`` removes folders
    that neither of the two newest versions lists, so that a reader of the version before can end.
    """

    path: str

    def write(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
        """Store ``rows`` as all there is of this batch."""
        folder = self._store(rows, f"batch-{batch_id}", partition_by)
        version, folders, schema = self._latest(rows.sparkSession)
        self._commit(rows.sparkSession, version + 1, folders | {str(batch_id): folder}, rows.schema.json() if schema is None else schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """All committed rows, as of now."""
        _, folders, schema = self._latest(spark)
        if schema is None:
            raise FileNotFoundError(f"no batch is committed under {self.path}")
        return self._rows(spark, sorted(set(folders.values())), schema)

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(map(int, self._latest(spark)[1]))

    def compact(self, spark: SparkSession, partition_by: tuple[str, ...] = (), files: int | None = None) -> None:
        """Join all batches but the newest, which a restart may write again, into one folder (of ``files`` files if given)."""
        version, folders, schema = self._latest(spark)
        numbers = sorted(map(int, folders))[:-1]
        old = sorted({folders[str(n)] for n in numbers})
        if len(old) < 2:
            return
        newest = str(max(map(int, folders)))
        whole = self._rows(spark, old, schema)
        folder = self._store(whole if files is None else whole.coalesce(files), f"until-{numbers[-1]}", partition_by)
        self._commit(spark, version + 1, {str(n): folder for n in numbers} | {newest: folders[newest]}, schema)

    def clean(self, spark: SparkSession) -> None:
        """Remove what neither the newest manifest nor the one before lists: replaced, joined and broken-off folders."""
        versions = self._versions(spark)
        listed = {f for v in versions[-2:] for f in self._manifest(spark, v)["folders"].values()}
        fs, root = self._files(spark, "data")
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in listed] if fs.exists(root) else []
        discard(spark, [str(p.toString()) for p in gone])
        discard(spark, [f"{self.path}/manifests/{v}" for v in versions[:-2]])

    def _rows(self, spark: SparkSession, names: list[str], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        parts = [spark.read.schema(kind).parquet(f"{self.path}/data/{n}") for n in names]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return table

    def _store(self, rows: DataFrame, label: str, partition_by: tuple[str, ...]) -> str:
        folder = f"{label}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/data/{folder}")
        return folder

    def _files(self, spark: SparkSession, *names: str):
        """The file system of the table and the path of ``names`` under it."""
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _versions(self, spark: SparkSession) -> list[int]:
        fs, root = self._files(spark, "manifests")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, spark: SparkSession, version: int) -> dict:
        fs, path = self._files(spark, "manifests", str(version))
        stream = fs.open(path)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self, spark: SparkSession) -> tuple[int, dict[str, str], str | None]:
        versions = self._versions(spark)
        if not versions:
            return 0, {}, None
        found = self._manifest(spark, versions[-1])
        return versions[-1], found["folders"], found["schema"]

    def _commit(self, spark: SparkSession, version: int, folders: dict[str, str], schema: str) -> None:
        fs, draft = self._files(spark, "manifests", f"_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"folders": folders, "schema": schema}).encode()))
        finally:
            stream.close()
        target = self._files(spark, "manifests", str(version))[1]
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} is there already: the table has another writer")
