"""Read tables against a declared schema; write results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns each operator's inputs are made from. A table may hold more columns.
TABLES = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
    "value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}


class SchemaMismatch(ValueError):
    pass


def check_schema(df: DataFrame, declared: T.StructType, what: str) -> None:
    """Every declared column must be there with its type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: want {f.dataType.simpleString()}, "
        f"have {have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in declared.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise SchemaMismatch(f"{what}: " + "; ".join(wrong))


def load(
    spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None
) -> DataFrame:
    """Read `folder/name.parquet` and check it against its declared schema."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    declared = schema or TABLES.get(name)
    if declared is not None:
        if isinstance(declared, str):
            declared = T._parse_datatype_string(declared)
        check_schema(df, declared, name)
    return df


def write(
    df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Partitioned Parquet, in files of bounded size and number.

    Rows are rebalanced by the partition columns: rows of a value come together, so a value
    has about one file, and a value with much of the data is split over several tasks, each
    writing about spark.sql.adaptive.advisoryPartitionSizeInBytes.

    mode="partitions" replaces the partitions that `df` holds and leaves the others: their
    files are written aside and moved in place when the whole job has succeeded, so a run
    that fails changes nothing and one that is repeated writes the same partitions again.
    Other modes are those of Spark's writer.
    """
    if mode == "partitions" and not partition:
        raise ValueError("replacing partitions needs partition columns")
    if partition:
        df = df.hint("rebalance", *partition)
    out = df.write
    if mode == "partitions":
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        out = out.mode(mode)
    (out.partitionBy(*partition) if partition else out).parquet(path)
