"""A keyed table that a batch changes in part: hashed buckets, copied when they are written, and a manifest.

Each batch rewrites the buckets that hold its keys, in a folder of its own, and
then puts a manifest beside it that names the folder of every bucket. Readers
follow the newest manifest; the rename that puts it there is the commit. A
batch that comes again finds its manifest and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.core import latest

#: Buckets of a table: a batch that touches few keys rewrites few of them.
BUCKETS = 256


class BucketTable:
    """The newest version of each key, under ``path``. Keys may be null; equal versions: the row that was there."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], version: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.version, self.buckets = spark, path.rstrip("/"), schema, keys, version, buckets
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[int]:
        """Batches that were committed, ascending."""
        folder = self._at(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, batch: int | None = None) -> dict[int, int]:
        """The batch that wrote each bucket, as of a batch or the newest."""
        known = [k for k in self.manifests() if batch is None or k <= batch]
        if not known:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{known[-1]}").first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{batch}/_bucket={bucket}" for bucket, batch in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The table as of the newest manifest."""
        return self._read(self.manifest())

    def apply(self, batch: DataFrame, batch_id: int, changed: Callable[[DataFrame], None] | None = None) -> int:
        """Take in a batch; how many buckets were written.

        changed: is given (new, old) of the keys that the batch changes, old
        null for new keys, before the commit, so that what it writes under the
        batch's id is written again if the commit does not come about.
        """
        if batch_id in self.manifests():
            return 0
        held = self.manifest(batch_id)
        names = self.schema.names
        fresh = self._bucket(latest(batch.select(*names), self.keys, self.version)).persist()
        try:
            touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
            old = self._bucket(self._read({b: held[b] for b in touched if b in held}))
            one, two = fresh.select("_bucket", F.struct(*names).alias("new")), old.select("_bucket", F.struct(*names).alias("old"))
            same = [one["_bucket"] == two["_bucket"], *[one[f"new.{k}"].eqNullSafe(two[f"old.{k}"]) for k in self.keys]]
            both = one.join(two, same, "full").select(F.coalesce(one["_bucket"], two["_bucket"]).alias("_bucket"), "new", "old")
            newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col(f"new.{self.version}") > F.col(f"old.{self.version}")))
            if changed is not None:
                changed(both.where(newer).select("new", "old"))
            kept = both.select("_bucket", F.when(newer, F.col("new")).otherwise(F.col("old")).alias("row")).select("_bucket", "row.*")
            kept.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{batch_id}")
        finally:
            fresh.unpersist()
        self._commit(batch_id, held | dict.fromkeys(touched, batch_id))
        self._clean(held, held | dict.fromkeys(touched, batch_id))
        return len(touched)

    def _commit(self, batch_id: int, manifest: dict[int, int]) -> None:
        draft, final = self._at(f"{self.path}/manifest/_draft-{batch_id}"), self._at(f"{self.path}/manifest/{batch_id}")
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._files.rename(draft, final):
            raise OSError(f"manifest {batch_id} could not be put in place")

    def _clean(self, before: dict[int, int], now: dict[int, int]) -> None:
        """Delete bucket folders that neither this manifest nor the one before names, and manifests before that."""
        for k in self.manifests()[:-2]:
            for bucket, batch in self.manifest(k).items():
                if before.get(bucket) != batch and now.get(bucket) != batch:
                    self._files.delete(self._at(f"{self.path}/data/{batch}/_bucket={bucket}"), True)
            self._files.delete(self._at(f"{self.path}/manifest/{k}"), True)


def retractions(changes: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, sum, count) that a batch's changes add to a rollup: new rows count, the rows that they replace are taken back."""
    signed = [changes.select(*[F.col(f"{side}.{g}").alias(g) for g in groups], (F.col(f"{side}.{value}") * sign).alias("sum"), (F.col(f"{side}.{value}").isNotNull().cast("long") * sign).alias("count"), F.col(side).isNotNull().alias("there")) for side, sign in (("new", 1), ("old", -1))]
    return signed[0].unionByName(signed[1]).where("there").groupBy(*groups).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def retracting_rollup(table: BucketTable, path: str, groups: list[str], value: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps ``table`` and writes what each batch adds to its rollup under ``path``, one folder a batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id, lambda changes: retractions(changes, groups, value).write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))

    return each


def rolled_up(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """The rollup: what all batches added; groups that nothing is left of are gone."""
    return spark.read.parquet(path).groupBy(*groups).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count")).where("count > 0")
