"""Records of runs: entries that are added one by one and never changed, settings that a folder was made with, and tables added in one step.

An entry's file is created under a name that must not be there yet, which file systems decide, so of two writers one takes the next number and nothing is lost.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(settings: Mapping[str, object]) -> str:
    """A digest of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


class Log:
    """Numbered texts under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, jvm = spark, spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.folder = self.path(folder)
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, number: int):
        return self.path(self.folder, f"{number:08d}.json")

    def numbers(self) -> list[int]:
        """The numbers that entries have."""
        if not self.files.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)]
        return sorted(int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit())

    def _read(self, number: int) -> str:
        stream = self.files.open(self._place(number))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def entries(self) -> list[str]:
        """All entries, in their order."""
        return [self._read(n) for n in self.numbers()]

    def last(self) -> str | None:
        found = self.numbers()
        return self._read(found[-1]) if found else None

    def commit(self, text: str, number: int | None = None) -> int:
        """Adds text under the next free number and returns it; or under number, which one writer at a time may give, and which is an error if it is taken.

        The text is whole or not there: it is written beside and renamed. A number that a writer took and never filled stays out.
        """
        beside = self.path(self.folder, f".{uuid.uuid4().hex}")
        stream = self.files.create(beside, False)
        stream.write(text.encode())
        stream.close()
        if number is not None:
            if self.files.exists(self._place(number)) or not self.files.rename(beside, self._place(number)):
                self.files.delete(beside, False)
                raise FileExistsError(f"entry {number} of {self.folder} is there")
            return number
        at = max(self.numbers(), default=0) + 1
        while not self._taken(beside, at):
            at += 1
        return at

    def _taken(self, beside, number: int) -> bool:
        """Whether the name was free and is this entry's now."""
        place = self._place(number)
        claim = self.path(self.folder, f"{number:08d}.claim")
        try:
            self.files.create(claim, False).close()  # one writer gets it
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            return False
        return bool(self.files.rename(beside, place))


def checked_settings(spark: SparkSession, folder: str, settings: Mapping[str, object]) -> str:
    """The fingerprint of settings, if folder has none or the same; else an error that tells what differs."""
    log = Log(spark, folder)
    own = json.loads(json.dumps(settings, sort_keys=True, default=str))
    held = log.last()
    if held is None:
        log.commit(json.dumps(own, sort_keys=True))
        held = log.entries()[0]
    old = json.loads(held)
    if changed := {k: (old.get(k), own.get(k)) for k in sorted({*old, *own}) if old.get(k) != own.get(k)}:
        raise ValueError(f"{folder} was made with other settings: {changed}")
    return fingerprint(own)


class Runs:
    """A table of runs to which writers add at the same time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.log = spark, folder, Log(spark, f"{folder}/log")

    def add(self, rows: DataFrame) -> int:
        """Adds rows in one step, and returns its number: they are written first, and are part of the table once the log names them."""
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return self.log.commit(json.dumps({"part": part}))

    def read(self) -> DataFrame:
        """All rows with added, the number of the step that added them; columns that some lack are null."""
        parts = [(json.loads(text)["part"], n) for n, text in zip(self.log.numbers(), self.log.entries(), strict=True)]  # an entry a step
        if not parts:
            raise FileNotFoundError(f"no runs at {self.folder}")
        number = F.create_map(*[F.lit(x) for p, n in parts for x in (p, n)])
        table = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{p}" for p, _ in parts])
        return table.withColumn("added", number[F.regexp_extract(F.col("_metadata.file_path"), r"(part-[0-9a-f]{32})/", 1)])
