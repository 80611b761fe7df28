"""Stored originals as a table: (id, original, media_type, metadata, created_at, ttl_seconds)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys

SCHEMA = "id string, original string, media_type string, metadata map<string,string>, created_at timestamp, ttl_seconds long"
TEXT = "text/plain; charset=utf-8"


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a deployment; ``from_env`` reads them from LECTERN_ variables."""

    originals_path: str | None = None
    ttl_seconds: int | None = 86_400
    capacity: int | None = None

    @classmethod
    def from_env(cls, env=os.environ) -> EngineConfig:
        ttl = env.get("LECTERN_TTL", "86400")
        if not ttl.isdigit():
            raise ValueError(f"LECTERN_TTL is not a number of seconds: {ttl!r}")
        capacity = env.get("LECTERN_CAPACITY", "")
        if capacity and not capacity.isdigit():
            raise ValueError(f"LECTERN_CAPACITY is not a number of entries: {capacity!r}")
        return cls(env.get("LECTERN_ORIGINALS") or None, int(ttl) or None, int(capacity) if capacity else None)

    def open(self, spark: SparkSession) -> TableStore:
        """The store at ``originals_path``."""
        if not self.originals_path:
            raise ValueError("no folder for originals: set originals_path or LECTERN_ORIGINALS")
        return TableStore(spark, self.originals_path, self.ttl_seconds, self.capacity)


def entries(rows: DataFrame, id_: str, original: str, ttl_seconds: int | None = None, media_type: str = TEXT) -> DataFrame:
    """Originals as new entries of the store."""
    return rows.select(F.col(id_).alias("id"), F.col(original).alias("original"), F.lit(media_type).alias("media_type"), F.lit(None).cast("map<string,string>").alias("metadata"), F.current_timestamp().alias("created_at"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"))


def save(store: DataFrame, new: DataFrame) -> DataFrame:
    """Both, and of entries with one id the newest."""
    newest = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("_new"))
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def live(store: DataFrame, now: Column | None = None) -> DataFrame:
    """Entries that haven't expired; without a time to live they never do."""
    now = F.current_timestamp() if now is None else now
    return store.where(F.col("ttl_seconds").isNull() | (F.unix_timestamp("created_at") + F.col("ttl_seconds") > F.unix_timestamp(now)))


def within_capacity(store: DataFrame, capacity: int, by: str = "created_at") -> DataFrame:
    """The ``capacity`` entries inserted last."""
    return store.orderBy(F.desc(by), F.desc("id")).limit(capacity)


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def retrieve(requests: DataFrame, request: str, store: DataFrame) -> DataFrame:
    """Requests with ``id`` and ``original``: a notice a model can read where nothing is stored."""
    asked = requests.withColumn("id", keys.requested(F.col(request)))
    met = asked.join(store.select(F.col("id").alias("s_id"), F.col("original").alias("s_original")), F.col("id") == F.col("s_id"), "left").drop("s_id")
    return met.withColumn("original", F.coalesce("s_original", F.concat(F.lit("[no content stored for "), F.col("id"), F.lit("]")))).drop("s_original")


TOOL = {
    "name": "retrieve_original",
    "description": "Return the original text that a <<ccr:...>> marker stands for.",
    "input_schema": {"type": "object", "properties": {"id": {"type": "string", "description": "The marker or the id inside it."}}, "required": ["id"]},
}


class TableStore:
    """Originals in a folder: every change is a new version, and the newest whole one counts.

    ``ttl_seconds`` and ``capacity`` are the engine's; a version is written next
    to the one it reads, so readers of the old one aren't disturbed, and older
    ones go.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int | None = None, capacity: int | None = None):
        self.spark, self.path, self.ttl, self.capacity = spark, path.rstrip("/"), ttl_seconds, capacity

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(root):
            return []
        done = [s.getPath() for s in self._fs.listStatus(root) if self._fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def table(self, now: Column | None = None) -> DataFrame:
        """What is stored and hasn't expired."""
        versions = self._versions()
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{versions[-1]}") if versions else self.spark.createDataFrame([], SCHEMA)
        return live(rows, now)

    def _write(self, rows: DataFrame) -> None:
        versions = self._versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/v{versions[-1] + 1 if versions else 0}")
        for old in versions[:-1]:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)

    def save(self, new: DataFrame) -> None:
        """(id, original) rows, or whole entries; of one id the newest stays."""
        rows = save(self.table(), new if "created_at" in new.columns else entries(new, "id", "original", self.ttl))
        self._write(rows if self.capacity is None else within_capacity(rows, self.capacity))

    def retrieve(self, requests: DataFrame, request: str) -> DataFrame:
        return retrieve(requests, request, self.table())

    def delete(self, ids: DataFrame) -> None:
        self._write(delete(self.table(), ids))


def collect_garbage(store: DataFrame, removed: DataFrame, remaining: DataFrame) -> DataFrame:
    """Ids that removed messages refer to and no remaining one does (both have content and ccr_id)."""
    of = lambda rows: rows.select(F.explode(keys.referenced(F.col("content"), F.col("ccr_id"))).alias("id")).distinct()
    return of(removed).join(of(remaining), "id", "left_anti").join(store.select("id").distinct(), "id", "left_semi")


def encode_payload(data: Column, media_type: Column, metadata: Column) -> Column:
    """A binary payload as JSON: text as it is, other bytes in hex."""
    text = F.is_valid_utf8(data.cast("string"))
    return F.to_json(F.struct(F.lit(1).alias("payload"), media_type.alias("media_type"), F.when(text, "utf8").otherwise("hex").alias("enc"), F.when(text, data.cast("string")).otherwise(F.lower(F.hex(data))).alias("data"), metadata.alias("metadata")))


def decode_payload(text: Column) -> Column:
    """Struct of data, media_type and metadata; other texts are plain payloads."""
    own = F.from_json(text, "payload int, media_type string, enc string, data string, metadata map<string,string>")
    raw = F.when(own["enc"] == "utf8", own["data"].cast("binary")).when(own["enc"] == "hex", F.try_to_binary(own["data"], F.lit("hex")))
    good = (own["payload"] == 1) & raw.isNotNull()
    plain = F.struct(text.cast("binary").alias("data"), F.lit(TEXT).alias("media_type"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return F.when(good, F.struct(raw.alias("data"), own["media_type"].alias("media_type"), own["metadata"].alias("metadata"))).otherwise(plain)


def read_messages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Messages from Parquet or JSON files."""
    return spark.read.parquet(path) if form == "parquet" else spark.read.schema("conv_id long, turn int, role string, content string, metadata map<string,string>").json(path)
