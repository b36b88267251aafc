"""Tables that change together: a folder for each version of a table, and one small file for each state of them all.

A state is a numbered file that names the folder of every table.  It is created
only if its number is free and is never changed, so of two writers one fails, and
a reader, who takes the highest number that is complete, sees all tables of one state and never none.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: states whose folders stay, for readers that began with them
KEPT = 3


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        at, fs = self.path(name)
        return fs.exists(at)

    def names(self, folder: str) -> list[str]:
        at, fs = self.path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Write a small file; False if it is there already."""
        at, fs = self.path(name)
        try:
            out = fs.create(at, False)
        except Exception:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        at, fs = self.path(name)
        data = fs.open(at)
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def delete(self, name: str) -> None:
        at, fs = self.path(name)
        fs.delete(at, True)

    def _states(self) -> list[int]:
        return [int(x) for x in self.names("states") if re.fullmatch("[0-9]{12}", x)]

    def _state(self, number: int) -> dict[str, str] | None:
        try:
            return json.loads(self.read(f"states/{number:012d}"))
        except ValueError:  # still being written
            return None

    def current(self) -> tuple[int, dict[str, str]]:
        """(number, folder by table) of the newest complete state; (0, {}) before the first."""
        for number in sorted(self._states(), reverse=True):
            state = self._state(number)
            if state is not None:
                return number, state
        return 0, {}

    def stage(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Write a version of a table that is not current yet: (its folder, the written table)."""
        folder = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")

    def commit(self, folders: dict[str, str | None]) -> int:
        """Make staged versions current, all at once; other tables stay as they are, and those without a folder go."""
        _, state = self.current()
        number = max(self._states(), default=0) + 1
        if not self.create(f"states/{number:012d}", json.dumps({name: at for name, at in {**state, **folders}.items() if at})):
            raise RuntimeError(f"{self.root} was changed by another writer")
        self._sweep()
        return number

    def _sweep(self) -> None:
        """Forget states before the last KEPT, and folders that only they name."""
        states = sorted(self._states())
        old, kept = states[:-KEPT], states[-KEPT:]
        used = {f for k in kept for f in (self._state(k) or {}).values()}
        for number in old:
            for folder in (self._state(number) or {}).values():
                if folder not in used:
                    self.delete(folder)
            self.delete(f"states/{number:012d}")

    def publish(self, **tables: DataFrame) -> int:
        return self.commit({name: self.stage(name, df)[0] for name, df in tables.items()})

    def table(self, name: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{self.current()[1][name]}")
