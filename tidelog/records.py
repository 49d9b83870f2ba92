"""Migration records as JSON files in a folder that outlives the driver: create if absent, overwrite, scan."""

from __future__ import annotations

import functools
import json
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The records' schema and settings, which come with the package.
PACKAGED = json.loads(Path(__file__).with_name("records.json").read_text())
SCHEMA = T.StructType.fromJson(PACKAGED["schema"])
#: Settings that an existing store keeps.
KEPT_SETTINGS = ("number_of_shards",)


#: Local file systems replace a file in two steps; threads of this driver don't see the time between.
LOCK = threading.RLock()


def alone(method):
    @functools.wraps(method)
    def run(*args):
        with LOCK:
            return method(*args)

    return run


class Files:
    """Small files of a folder, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")
        self.fs, self.gateway = self.path("").getFileSystem(self.conf), spark.sparkContext._gateway
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @alone
    def names(self) -> list[str]:
        if not self.fs.exists(self.path("")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path("")))

    @alone
    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @alone
    def write(self, name: str, text: str) -> None:
        """Written beside and renamed over, so that readers see the whole file or the one before."""
        self._moved(name, text, "OVERWRITE")

    @alone
    def create(self, name: str, text: str) -> bool:
        """False if there is one."""
        if self.fs.exists(self.path(name)):
            return False
        try:
            self._moved(name, text, "NONE")
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _moved(self, name: str, text: str, how: str) -> None:
        beside = self.path(f"_{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kinds, 1)
        options[0] = getattr(kinds, how)
        try:
            self.context.rename(beside, self.path(name), options)
        except Exception:
            self.fs.delete(beside, False)
            raise

    @alone
    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


class Records:
    """One record a migration, by id; the phase log, counts and settings are part of it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)
        self.open()

    def open(self) -> None:
        """Put the packaged schema, or reconcile with the one that is there: fields may be added, settings but KEPT_SETTINGS are replaced."""
        if self.files.create("_schema.json", json.dumps(PACKAGED)):
            return
        there = json.loads(self.files.read("_schema.json"))
        merged = {"schema": reconciled(T.StructType.fromJson(there["schema"]), SCHEMA).jsonValue(), "settings": there["settings"] | {k: v for k, v in PACKAGED["settings"].items() if k not in KEPT_SETTINGS}}
        if merged != there:
            self.files.write("_schema.json", json.dumps(merged))

    def create(self, record: dict) -> bool:
        return self.files.create(f"{record['migration_id']}.json", json.dumps(record))

    def put(self, record: dict) -> None:
        self.files.write(f"{record['migration_id']}.json", json.dumps(record))

    def get(self, migration_id: str) -> dict | None:
        text = self.files.read(f"{migration_id}.json")
        return json.loads(text) if text else None

    def texts(self) -> list[str]:
        with LOCK:
            return [self.files.read(n) for n in self.files.names() if n.endswith(".json") and not n.startswith("_")]

    def all(self) -> list[dict]:
        """All records: for the driver's own decisions, whose number is that of migrations."""
        return [json.loads(t) for t in self.texts()]

    def table(self) -> DataFrame:
        """All records as they are now, as a DataFrame of SCHEMA."""
        texts = self.spark.createDataFrame([(t,) for t in self.texts()], "t string")
        return texts.select(F.from_json("t", SCHEMA).alias("r")).select("r.*")

    def delete(self, migration_id: str) -> bool:
        return self.files.delete(f"{migration_id}.json")


def reconciled(there: T.StructType, wanted: T.StructType) -> T.StructType:
    """The fields that are there and those to be added; a field of another type is an error."""
    out = {f.name: f for f in there.fields}
    for f in wanted.fields:
        if f.name in out and out[f.name].dataType != f.dataType:
            raise ValueError(f"field {f.name} is {out[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        out.setdefault(f.name, f)
    return T.StructType(list(out.values()))
