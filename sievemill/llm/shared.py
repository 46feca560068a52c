"""Shared folder, row identity and row bitmaps used by the corpus operators.

A row of a Parquet scan is named by ``(_sm_src, _sm_row)``: a 64-bit hash of its file's path and its
position in that file. The name does not depend on how the scan is split into tasks, so a set of rows
found by one job can be marked in a later scan without moving the rows' texts.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SRC, ROW = "_sm_src", "_sm_row"
#: Rows of one bitmap: 2**14 bits are 2 KB.
CHUNK_BITS = 14
#: Rows of an Arrow batch while a scratch table is written.
BATCH_ROWS = 1000
#: A broadcast holds this many bitmaps at most (64 MB); more are worked off in blocks of files.
MAX_BITMAPS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sievemill-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive executors. They go when Python ends, or when whoever wrote the result
    says so (``drop_since``)."""

    live: list[Scratch] = []  # noqa: RUF012  every one that still has tables

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sievemill/{what}-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        Scratch.live.append(self)

    @classmethod
    def drop_since(cls, mark: int) -> None:
        """Drops what was opened after ``len(Scratch.live)`` was ``mark``: once a result is written, nothing reads its makers' tables."""
        for s in cls.live[mark:]:
            s.drop()
        del cls.live[mark:]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back. Texts go to Python in batches of ``BATCH_ROWS`` meanwhile, so that memory is bounded."""
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            delete_path(self.spark, self.path(name) if name else self.root)
        except Exception:  # noqa: BLE001  the session may have ended before Python did
            if name:
                raise


def set_aside(df: DataFrame):
    """``df`` with columns whose names the operators use themselves under other names, and a function that gives those back."""
    clash = [c for c in df.columns if c.lower().startswith("_sm_")]
    other = {c: f"_set_aside_{i}_{c}" for i, c in enumerate(clash)}
    return df.withColumnsRenamed(other), lambda d: d.withColumnsRenamed({v: k for k, v in other.items()})


def identified(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` with ``_sm_src`` and ``_sm_row``. What is not a plain Parquet scan is written to ``scratch`` once."""

    def named(d: DataFrame) -> DataFrame:
        meta = d.metadataColumn("_metadata")
        return d.select("*", F.xxhash64(meta["file_path"]).alias(SRC), meta["row_index"].alias(ROW))

    try:
        out = named(df)
        out.schema  # noqa: B018  analysis happens here
        return out
    except AnalysisException:
        return named(scratch.put(df, f"rows-{uuid.uuid4().hex[:8]}"))


def row_bitmaps(rows: DataFrame) -> DataFrame:
    """``(_sm_src, chunk, bits)``: one array of 256 longs for each 16,384 rows of a file that hold any of ``rows``."""
    words = 1 << (CHUNK_BITS - 6)
    return (
        rows.groupBy(SRC, F.shiftright(ROW, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({ROW} & 63 as int))")).alias("bits"))
        .groupBy(SRC, F.shiftright("word", CHUNK_BITS - 6).alias("chunk"))
        .agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % words).cast("int"), "bits"))).alias("m"))
        .select(SRC, "chunk", F.expr(f"transform(sequence(0, {words - 1}), i -> coalesce(m[i], 0L))").alias("bits"))
    )


def split_rows(docs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` (identified) in and not in the set ``rows``, without a shuffle of ``docs``.

    The set travels as bitmaps, an eighth of a byte a row. Up to ``MAX_BITMAPS`` of them are broadcast;
    beyond that the files are dealt into blocks, each scanned once with the bitmaps of its own files.
    """
    bitmaps = scratch.put(row_bitmaps(rows), name)
    n = bitmaps.count()
    blocks = max(1, -(-n // MAX_BITMAPS))
    inside, outside = [], []
    for b in range(blocks):
        part, maps = docs, bitmaps
        if blocks > 1:
            mine = F.pmod(F.xxhash64(SRC), F.lit(blocks)) == b
            part, maps = docs.filter(mine), bitmaps.filter(mine)
        maps = maps.select(F.col(SRC).alias("_sm_s"), F.col("chunk").alias("_sm_c"), F.col("bits").alias("_sm_b"))
        joined = part.join(
            F.broadcast(maps),
            (F.col(SRC) == F.col("_sm_s")) & (F.shiftright(ROW, CHUNK_BITS) == F.col("_sm_c")),
            "left",
        )
        bit: Column = F.coalesce(
            F.expr(f"(shiftright(_sm_b[cast(shiftright({ROW}, 6) % {1 << (CHUNK_BITS - 6)} as int)], cast({ROW} & 63 as int)) & 1L) = 1L"),
            F.lit(False),
        )
        inside.append(joined.filter(bit).drop("_sm_s", "_sm_c", "_sm_b"))
        outside.append(joined.filter(~bit).drop("_sm_s", "_sm_c", "_sm_b"))
    ins, outs = inside[0], outside[0]
    for i, o in zip(inside[1:], outside[1:], strict=True):
        ins, outs = ins.unionByName(i), outs.unionByName(o)
    return ins, outs


def without_rows(docs: DataFrame, dropped: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``docs`` (identified) less the rows of ``dropped``, in the columns it had before."""
    return split_rows(docs, dropped, scratch, name)[1].drop(SRC, ROW)
