"""Tables of a run that later runs find again: keyed by the inputs, the rules, the controls and the stage."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from costweave.plans.sinks import json_value
from costweave.plans.stages import staged

#: Raise it when a change of the code changes the rows of a kept stage.
RULES = "2026.1"


def input_fingerprint(snapshot: DataFrame) -> str:
    """Identity of the files in a snapshot (:func:`costweave.plans.sinks.snapshot`): names, sizes and contents.

    Hashes of the files are combined where they are, by an operation without order, so that no list of
    files reaches the driver. Modification times do not count: a file that was copied anew is the same file.
    """
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.sha2(F.concat_ws("|", name, "bytes", "sha256"), 256)
    halves = [F.bit_xor(F.xxhash64(digest, F.lit(i))).alias(f"h{i}") for i in range(2)]
    sums = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(2)]
    row = snapshot.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), *halves, *sums).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()[:32]


class StageStore:
    """Stages under ``folder``: a Parquet folder each and, beside it, a marker that is written last.

    The key of a stage is a hash of the inputs' fingerprint, ``RULES``, the controls and the stage's name. A table is
    written under a name of its own and becomes visible with its marker, one small file; a run that dies
    before leaves files that :meth:`sweep` deletes. Two runs that build the same stage write two tables; the later
    marker stands and both tables are whole. ``folder`` may be any place that Spark can write to.
    """

    def __init__(self, spark: SparkSession, folder: str, fingerprint: str, controls: dict[str, Any]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.base = json.dumps(json_value({"inputs": fingerprint, "rules": RULES, "controls": controls}), sort_keys=True)
        self.hits: list[str] = []
        self.built: list[str] = []

    def key(self, stage: str) -> str:
        return hashlib.sha256(f"{self.base}|{stage}".encode()).hexdigest()[:32]

    def __call__(self, build: Callable[[], DataFrame], stage: str) -> DataFrame:
        """The table of a stage; ``build`` is called only if there is none."""
        marker = self._marker(stage)
        known = self._read(marker)
        if known is None:
            table = f"{stage}-{self.key(stage)}-{uuid.uuid4().hex}"
            df = build()
            df.write.parquet(f"{self.folder}/{table}")
            known = {"table": table, "schema": df.schema.json(), "stage": stage}
            self._write(marker, known)
            self.built.append(stage)
        else:
            self.hits.append(stage)
        return self.spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{self.folder}/{known['table']}")

    def invalidate(self, stage: str) -> None:
        """Forget a stage of these inputs and controls; its files go with the next :meth:`sweep`."""
        fs, path = self._place(self._marker(stage))
        fs.delete(path, False)

    def sweep(self, max_age_days: float) -> list[str]:
        """Delete markers older than that, then tables older than that which no marker names. Gives the deleted names.

        Choose an age above the length of the longest run: a table younger than that may be read or not yet have its marker.
        """
        fs, root = self._place(self.folder)
        if not fs.exists(root):
            return []
        limit = (time.time() - max_age_days * 86_400) * 1000
        entries = [(e.getPath().getName(), e.getPath(), e.getModificationTime()) for e in fs.listStatus(root)]
        gone, named = [], set()
        for name, path, modified in entries:
            if name.endswith(".json"):
                if modified < limit:
                    fs.delete(path, False)
                    gone.append(name)
                elif known := self._read(f"{self.folder}/{name}"):
                    named.add(known["table"])
        for name, path, modified in entries:
            if not name.endswith((".json", ".crc")) and name not in named and modified < limit:
                fs.delete(path, True)
                gone.append(name)
        return sorted(gone)

    def _marker(self, stage: str) -> str:
        return f"{self.folder}/{stage}-{self.key(stage)}.json"

    def _place(self, name: str) -> tuple[Any, Any]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> dict[str, Any] | None:
        """A marker's content; None where there is none or its table was deleted."""
        fs, path = self._place(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        known = json.loads(text)
        fs, table = self._place(f"{self.folder}/{known['table']}/_SUCCESS")
        return known if fs.exists(table) else None

    def _write(self, name: str, content: dict[str, Any]) -> None:
        """Written aside, then renamed, so that a marker is there whole or not at all."""
        fs, path = self._place(name)
        _, aside = self._place(f"{name}.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not fs.rename(aside, path):  # another run was first
            fs.delete(aside, False)


def each_time(build: Callable[[], DataFrame], stage: str) -> DataFrame:
    """A stage without a store: worked out in every run."""
    return staged(build(), stage)
