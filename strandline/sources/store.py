"""A record store: the last record of a user's millisecond stays, writes are whole or not there, reads skip what is not asked for.

Records lie in Parquet files by day and part of the users. A write merges what it brings with the folders that it
touches, into folders of a new version, and then puts down a manifest that says which version of each folder is the present one. A
write that fails leaves no manifest, so none of its rows; a batch that is written
again changes nothing. A read takes from the manifest the folders of the days and users asked for, and Spark reads of
their files the columns and row groups that it needs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.times import ms
from strandline.operators.ordering import latest
from strandline.sources.sinks import upsert_last, wipe

USER_PARTS = 16


@dataclass
class Store:
    """One writer at a time; readers see the version that was present when they began."""

    spark: SparkSession
    path: str
    user_parts: int = USER_PARTS

    def _fs(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self) -> dict:
        """version, last batch, schema, and the present version of each folder (day/part)."""
        fs, at = self._fs("log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "batch": None, "schema": None, "folders": {}}
        (row,) = self.spark.read.text(f"{self.path.rstrip('/')}/log/{names[-1]}", wholetext=True).collect()
        return json.loads(row[0])

    def _commit(self, manifest: dict) -> None:
        fs, part = self._fs("log", f"{manifest['version']:020d}.part")
        _, at = self._fs("log", f"{manifest['version']:020d}.json")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, at):
            raise RuntimeError(f"version {manifest['version']} is there already")

    def _part(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user.cast("string")), F.lit(self.user_parts)).cast("int")

    def _load(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path.rstrip('/')}/version={manifest['folders'][f]}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, df: DataFrame, batch: int | None = None, *, order: str = "seq") -> None:
        """Writes records with user_key, ts and ``order``; of one user and millisecond the last of a write stays, and later writes replace earlier ones.

        A ``batch`` whose number is not greater than that of the last one is not written
        again; ``foreachBatch(store.upsert)`` makes a stream's writes take effect once.
        """
        now = self._manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return
        schema = df.schema if now["schema"] is None else T.StructType.fromJson(now["schema"])
        now["schema"] = schema.jsonValue()
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        place = [F.date_format(F.timestamp_millis(ms("ts")), "yyyy-MM-dd").alias("_day"), self._part(F.col("user_key")).alias("_users")]
        new = upsert_last(df, order=order).select("*", *place, F.lit(1).alias("_new"))
        # At most a folder for each day and part of the users.
        touched = sorted(f"_day={r[0]}/_users={r[1]}" for r in new.select("_day", "_users").distinct().collect())
        if touched:
            old = self._load(now, [f for f in touched if f in now["folders"]]).select("*", *place, F.lit(0).alias("_new"))
            merged = latest(old.unionByName(new).withColumn("_at", ms("ts")), ["user_key", "_at"], [F.col("_new").desc(), F.col(order).desc()]).drop("_at", "_new")
            version = now["version"] + 1
            merged.hint("rebalance", "_day", "_users").sortWithinPartitions("_day", "_users", "user_key", "ts").write.mode("overwrite").partitionBy("_day", "_users").parquet(f"{self.path.rstrip('/')}/version={version}")
            self._commit({"version": version, "batch": batch if batch is not None else now["batch"], "schema": now["schema"], "folders": now["folders"] | dict.fromkeys(touched, version)})

    def read(self, *, user=None, since: datetime | None = None, until: datetime | None = None, columns: list[str] | None = None) -> DataFrame:
        """Records of a user, between two times, both inclusive; None does not bound. Naive times are UTC."""
        now = self._manifest()
        if now["schema"] is None:
            raise ValueError("nothing has been written")
        utc = lambda t: t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
        since, until = since and utc(since), until and utc(until)
        folders = sorted(now["folders"])
        day = lambda f: f.split("/")[0].removeprefix("_day=")
        folders = [f for f in folders if (since is None or day(f) >= f"{since:%Y-%m-%d}") and (until is None or day(f) <= f"{until:%Y-%m-%d}")]
        if user is not None:
            part = self.spark.range(1).select(self._part(F.lit(user))).first()[0]
            folders = [f for f in folders if f.endswith(f"/_users={part}")]
        out = self._load(now, folders)
        for bound in ([F.col("user_key") == F.lit(user)] if user is not None else []) + ([F.col("ts") >= F.lit(since)] if since else []) + ([F.col("ts") <= F.lit(until)] if until else []):
            out = out.filter(bound)
        return out.select(*columns) if columns else out

    def vacuum(self) -> None:
        """Deletes versions that the present manifest does not name; none may be being read."""
        now = self._manifest()
        fs, at = self._fs()
        for f in fs.listStatus(at) if fs.exists(at) else []:
            name = f.getPath().getName()
            if name.startswith("version=") and int(name.removeprefix("version=")) not in {*now["folders"].values(), now["version"]}:
                wipe(self.spark, f.getPath().toString())
