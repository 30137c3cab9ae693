"""Helpers shared by the pipeline operators: shared scratch tables, skew-proof lookups, batched texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: White space of every word rule here, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: Groups with at least 1 / HEAVY of all rows are looked up by broadcast; there are at most HEAVY of them.
HEAVY = 1000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting, as in tests, gets a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="merchgrid-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(col: Column | str, n: int) -> Column:
    """``crc32(col as text) mod n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")) % n


def bare(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns; a missing one becomes null.  Keeps helper names from clashing with extra columns."""
    have = {c.lower() for c in df.columns}
    types = {"doc_id": "bigint", "page_id": "bigint", "item_id": "bigint"}
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(types.get(c, "string")).alias(c) for c in cols])


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, salt: Column) -> DataFrame:
    """Left join of ``rows`` with one row per key, where one key may hold a third of all rows.

    ``groups`` has ``keys``, ``n`` (rows that hold the key) and the values to attach.  Keys
    with ``n >= total / HEAVY`` come by broadcast: the counts add up to ``total``, so there are
    at most ``HEAVY``.  Their rows then pass the shuffle join under a key that meets nothing
    and is dealt out by ``salt``; every other key is too small to weigh on a task.  (The zero of
    the other side is computed, or the optimizer would take the salt out of the join's keys.)
    """
    values = [c for c in groups.columns if c not in keys]
    big = groups.where(F.col("n") * HEAVY >= F.lit(total))
    small = groups.where(F.col("n") * HEAVY < F.lit(total))
    big = big.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.lit(True).alias("_big"), *[F.col(v).alias(f"_b_{v}") for v in values])
    small = small.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int").alias("_s_salt"), *[F.col(v).alias(f"_s_{v}") for v in values])
    out = rows.join(F.broadcast(big), [F.col(k) == F.col(f"_b_{k}") for k in keys], "left")
    out = out.withColumn("_salt", F.when(F.col("_big"), F.lit(1) + F.pmod(F.xxhash64(salt), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0)))
    out = out.join(small, [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.col("_salt") == F.col("_s_salt")], "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_b_{v}", f"_s_{v}").alias(v) for v in values])


def chunks(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``chars`` bytes at most (or one row)."""
    for b in batches:
        lo = 0
        step = max(1, min(b.num_rows, int(b.num_rows * chars / max(1, b.nbytes))))
        while lo < b.num_rows:
            yield b.slice(lo, step)
            lo += step


def widened(schema: StructType, **added: str) -> StructType:
    """``schema`` with columns added at its end; columns of the same names are replaced."""
    out = StructType([f for f in schema.fields if f.name not in added])
    for name, kind in added.items():
        out.add(name, DataType.fromDDL(kind))
    return out


def with_columns(b: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch laid out as ``widened`` says."""
    keep = [i for i, n in enumerate(b.schema.names) if n not in added]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *added.values()], names=[*(b.schema.names[i] for i in keep), *added])


def texts(b: pa.RecordBatch, col: str) -> list[str]:
    return [x or "" for x in b.column(col).to_pylist()]
