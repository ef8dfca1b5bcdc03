"""A run history in a folder that several jobs append to at once.

``data/segment=<id>/`` holds the entries of one append, numbered from 1 within it.
``versions/<number>.json`` is one committed action each: an append of a segment with the
``seq`` before its first, a trim, a removal or a clearing.  A commit makes the next
version's file only if there is none of that name (a hard link, or a rename that does not
overwrite); who comes second reads the new last version and tries again.  So ``seq`` is
given at the commit: appends that run side by side get numbers that do not overlap, none
is lost, and a job that fails before its commit leaves a segment that no version names.

A commit reads and writes one small file, whatever the history's length; readers fold the
versions with Spark.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.model import LEDGER_SCHEMA
from sheetlens.operators.ledger import LEDGER_COLUMNS, newest_threshold
from sheetlens.operators.numbering import global_row_number

_VERSION = "version long, action string, segment string, base long, n long, end long, floor long, cleared long, id string"
_DATA = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LEDGER_SCHEMA.fields if f.name != "seq")


class LedgerTable:
    """The history in ``path`` (any folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"
        self._fs.mkdirs(self._at("versions"))

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # ---------------------------------------------------------------- versions

    def version(self) -> int:
        """Number of the last committed version (0: none)."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _last(self) -> dict:
        n = self.version()
        if not n:
            return {"version": 0, "end": 0, "floor": 0, "cleared": 0}
        return self._versions(f"{n:012d}").first().asDict()

    def _versions(self, name: str = "*") -> DataFrame:
        return self.spark.read.schema(_VERSION).json(f"{self.path}/versions/{name}.json")

    def _create(self, number: int, action: dict) -> bool:
        """Make the file of a version, whole or not at all; False if there is one already."""
        text = json.dumps(action | {"version": number}) + "\n"
        name, tmp = f"versions/{number:012d}.json", f"versions/.{uuid.uuid4().hex}.tmp"
        if self._local:
            folder = self._fs.makeQualified(self._at("")).toUri().getPath()
            with open(f"{folder}/{tmp}", "w") as f:
                f.write(text)
            try:
                os.link(f"{folder}/{tmp}", f"{folder}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{folder}/{tmp}")
        out = self._fs.create(self._at(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._at("").toUri(), self._conf)
        none = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._at(tmp), self._at(name), none)
            return True
        except Exception as e:  # noqa: BLE001 - any other fault than a file of that name is raised
            self._fs.delete(self._at(tmp), False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def _commit(self, make) -> dict:
        """Commit ``make(last version)``; again on the new last version whenever another writer was first."""
        while True:
            last = self._last()
            action = make(last)
            if self._create(last["version"] + 1, {"end": last["end"], "floor": last["floor"], "cleared": last["cleared"]} | action):
                return action

    # ---------------------------------------------------------------- operations

    def append(self, entries: DataFrame, max_entries: int | None = None,
               order: Sequence[str | Column] = ("timestamp",)) -> int:
        """Add ``entries`` (numbered in ``order``, equal ones as they come), then keep the newest ``max_entries``.
        Returns the ``seq`` before the first of them."""
        segment = uuid.uuid4().hex
        numbered = global_row_number(entries.drop("seq").withColumn("_in", F.monotonically_increasing_id()), [*order, "_in"], "_k")
        where = f"{self.path}/data/segment={segment}"
        numbered.select("_k", *[c for c in LEDGER_COLUMNS if c != "seq"]).write.parquet(where)
        n = self.spark.read.schema(f"_k long, {_DATA}").parquet(where).count()
        done = self._commit(lambda last: {"action": "append", "segment": segment, "base": last["end"], "n": n, "end": last["end"] + n})
        if max_entries is not None:
            self.trim(max_entries)
        return done["base"]

    def read(self) -> DataFrame:
        """The entries of the last version (its number is taken now: later commits do not show)."""
        last = self._last()
        if not last["version"]:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        seen = self._versions().where(F.col("version").between(last["cleared"] + 1, last["version"]))
        adds = seen.where("action = 'append'").select("segment", "base")
        if adds.isEmpty():
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        data = self.spark.read.schema(f"_k long, {_DATA}, segment string").parquet(f"{self.path}/data")
        out = data.join(adds, "segment").withColumn("seq", F.col("base") + F.col("_k")).where(F.col("seq") > last["floor"])
        gone = seen.where("action = 'remove'").select("id")
        return out.join(gone, "id", "left_anti").select(*LEDGER_COLUMNS)

    def trim(self, n: int) -> None:
        """Keep the newest ``n`` entries: later reads leave out what is older."""
        if n <= 0:
            return self.clear()
        found = newest_threshold(self.read(), n)
        if found is not None:  # seq is unique here, so the threshold itself stays
            self._commit(lambda last: {"action": "trim", "floor": max(last["floor"], found[0] - 1)})

    def remove(self, entry_id: str) -> None:
        """Drop an entry; an unknown id is an error."""
        if self.read().where(F.col("id") == entry_id).isEmpty():
            raise KeyError(f"history entry {entry_id!r} not found")
        self._commit(lambda last: {"action": "remove", "id": entry_id})

    def clear(self) -> None:
        """Drop all entries; ``seq`` goes on from the last."""
        self._commit(lambda last: {"action": "clear", "cleared": last["version"] + 1})
