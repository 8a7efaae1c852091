"""A Pareto archive that grows with a stream of candidates.

`FrontState` keeps the front in the stream's own state and emits what changes.
`FrontArchive` keeps it as versions of a table, each written whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..functions.columns import known
from ..plans.dominance import front_mask, front_rows

# A row in state is its JSON; by default that cuts times to milliseconds.
_EXACT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FrontOfPart(StatefulProcessor):
    """The front of one key's rows as a map from row to its point and how often it came."""

    def init(self, handle) -> None:
        self.front = handle.getMapState("front", "row string", "point array<double>, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = {k[0]: (list(v[0]), v[1]) for k, v in self.front.iterator()}
        now = dict(held)
        for pdf in rows:
            for row, point in zip(pdf["row"], pdf["point"]):
                now[row] = (point, now[row][1] + 1 if row in now else 1)
            names = list(now)
            on_front = front_mask(np.array([now[row][0] for row in names], dtype=float))
            now = {row: now[row] for row, on in zip(names, on_front) if on}
        out = []
        for row in held.keys() - now.keys():
            self.front.removeKey((row,))
            out.append((row, False, held[row][1]))
        for row, (point, n) in now.items():
            before = held[row][1] if row in held else 0
            if n > before:
                self.front.updateValue((row,), ([float(x) for x in point], n))
                out.append((row, True, n - before))
        yield pd.DataFrame(out, columns=["row", "entered", "n"])

    def close(self) -> None:
        pass


class FrontState:
    """Front of everything seen so far, in keyed state of the stream.

    A batch touches only the keys it has rows for, and writes only rows that enter the front
    or leave it. A key is a group and one of `parts` parts, by hash of the row, so the rows
    of one big group are many tasks' work; a part holds the front of its own rows, and
    `read` joins the parts of a group. A task holds the front of a part at a time.

    Rows with a NULL objective are on no front. Copies of a row are counted. `schema` is
    that of the rows; it must hold nothing that JSON cannot (such as maps without string
    keys). The number of parts is fixed by the checkpoint of the stream.
    """

    def __init__(self, keys: Sequence[str], objs: Sequence[str], schema: T.StructType, parts: int = 8):
        self.keys, self.objs, self.schema, self.parts = list(keys), list(objs), schema, parts

    def changes(self, stream: DataFrame) -> DataFrame:
        """The rows with `entered` (false: dominated since, in its part) and `n`, how many copies.

        State of this kind needs the RocksDB provider, which the session is set to.
        """
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
        columns = [F.col(c) for c in self.schema.names]
        group = F.to_json(F.struct(*[F.col(k) for k in self.keys]), _EXACT) if self.keys else F.lit("")
        rows = stream.where(known(*self.objs)).select(
            # as text, since a NULL among numbers would reach Python as NaN, unlike itself
            group.alias("group"),
            F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int").alias("part"),
            F.to_json(F.struct(*columns), _EXACT).alias("row"),
            F.array(*[F.col(o).cast("double") for o in self.objs]).alias("point"),
        )
        changed = rows.groupBy("group", "part").transformWithStateInPandas(
            _FrontOfPart(), "row string, entered boolean, n long", "Append", "None"
        )
        return changed.select(self._row(F.col("row")).alias("row"), "entered", "n").select("row.*", "entered", "n")

    def _row(self, text: Column) -> Column:
        return F.from_json(text, self.schema, _EXACT)

    def read(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """The front as the last finished batch left it; read from the state, not from a log."""
        state = (
            spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "front").load()
        )
        held = state.select(
            self._row(F.col("user_map_key.row")).alias("_row"), F.col("user_map_value.n").cast("int").alias("_n")
        )
        rows = held.select(F.explode(F.array_repeat("_row", F.col("_n"))).alias("_row")).select("_row.*")
        return front_rows(rows, self.keys, self.objs).select(*self.schema.names)


class FrontArchive:
    """Front of everything seen so far, one stored version per micro-batch.

    A version is written first and then published, by a small table of its own that
    names it; readers and later batches use published versions only. A batch run again
    writes under a new name, so nothing that a reader may hold changes. Versions older
    than the one before the newest are deleted, so the archive holds two fronts, not
    one per batch.
    """

    def __init__(self, path: str, keys: Sequence[str], objs: Sequence[str]):
        self.path, self.keys, self.objs = path.rstrip("/"), list(keys), list(objs)

    def _list(self, spark: SparkSession, folder: str) -> list[str]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, spark: SparkSession, name: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _published(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(batch, attempt) of published versions, ascending; a name is a whole version."""
        names = [n for n in self._list(spark, "published") if n.startswith("v")]
        return sorted(tuple(map(int, n[1:].split("-"))) for n in names)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self._published(spark)
        earlier = [v for v in known if v[0] < batch_id]
        attempt = 1 + max((v[1] for v in known if v[0] == batch_id), default=-1)
        whole = batch
        if earlier:
            stored = spark.read.schema(batch.schema).parquet(self._rows(earlier[-1]))
            whole = batch.unionByName(stored)
        front = front_rows(whole, self.keys, self.objs).select(*batch.columns)
        version = (batch_id, attempt)
        front.write.mode("overwrite").parquet(self._rows(version))
        self._publish(spark, version)
        for old in [*earlier[:-1], *(v for v in known if v[0] == batch_id)]:
            self._delete(spark, f"published/v{old[0]}-{old[1]}")
            self._delete(spark, f"rows/v{old[0]}-{old[1]}")

    def _rows(self, version: tuple[int, int]) -> str:
        return f"{self.path}/rows/v{version[0]}-{version[1]}"

    def _publish(self, spark: SparkSession, version: tuple[int, int]) -> None:
        """Creating one empty file is one step of the file system."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            f"{self.path}/published/v{version[0]}-{version[1]}"
        )
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()

    def versions(self, spark: SparkSession) -> int:
        return len(self._published(spark))

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest published version."""
        return spark.read.parquet(self._rows(self._published(spark)[-1]))

    def attach(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
