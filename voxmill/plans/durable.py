"""Shared plumbing: durable intermediate tables, distributed prefix sums, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOTS: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: a run folder below ``spark.checkpoint.dir``.

    All executors share that folder, so a table written there outlives any of them. Only
    a session that names none (tests, a laptop) gets a temporary folder of its own. The run
    folder goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="voxmill-")
            spark.conf.set("spark.checkpoint.dir", base)
            atexit.register(_remove, spark, base)
        _ROOTS[app] = f"{base.rstrip('/')}/voxmill-{uuid.uuid4().hex}"
        fs, path = _hadoop(spark, _ROOTS[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _ROOTS[app]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class _Scope:
    def __init__(self, outer: _Scope | None):
        self.outer, self.paths = outer, []


_SCOPE: ContextVar[_Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside are deleted at the end, save those with ``keep``, which an outer scope may delete."""
    scope = _Scope(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in scope.paths:
            fs, p = _hadoop(spark, path)
            fs.delete(p, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = table_path(spark, name)
    scope = _SCOPE.get()
    if keep and scope:
        scope = scope.outer
    if scope:
        scope.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    root = work_root(spark)
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if root.rsplit("/", 1)[1] in folder:
                fs, p = _hadoop(spark, folder)
                fs.delete(p, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores after it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _scans_files(df: DataFrame) -> bool:
    """Whether the rows of ``df`` are rows of Parquet files, each once at most and the same ones in every job."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and node.relation().toString().lower() == "parquet"


def with_row_key(df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """``df`` with two long columns that tell its rows apart, the same in every job, and their names.

    They are a hash of the file's path (two of a million files share one with a chance of
    3e-8) and the place in that file. A plain scan of Parquet files has both for nothing;
    anything else is written as a table first.
    """
    if not _scans_files(df):
        df = materialize(df, name)
    file, row = unused(df.columns, "row_file", "row_number")
    place = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row)), file, row


def _running(sums: list[str], schema: pa.Schema):
    def run(batches):
        import numpy as np

        part, row, acc = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            cols = list(b.columns) + [pa.array(np.full(n, part, "int32")), pa.array(np.arange(row, row + n))]
            for c in sums:
                v = b.column(b.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
                run = np.cumsum(v) + acc[c]
                cols.append(pa.array(run - v))
                acc[c] = int(run[-1]) if n else acc[c]
            row += n
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def with_prefix(df: DataFrame, keys: list[str], sums: list[str], name: str) -> DataFrame:
    """Add ``row_index`` and ``pre_<c>`` (sum of c over all earlier rows) in the order of ``keys``.

    Rows are range-partitioned on the keys, so equal leading keys spread over tasks as long
    as later keys differ. Only one total per partition reaches the driver. Nulls sort first
    and count as 0 in sums. ``keys`` should order the rows completely; rows that tie on all
    of them come in any order.
    """
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    flat = materialize(df, name)
    ordered = flat.repartitionByRange(*keys).sortWithinPartitions(*keys)
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType())]
    schema = T.StructType(list(df.schema.fields) + extra + [T.StructField(f"_run_{c}", T.LongType()) for c in sums])
    local = materialize(ordered.mapInArrow(_running(sums, to_arrow_schema(schema)), schema), name + "_run")
    drop_tables(spark, flat)
    ends = local.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(f"s_{c}") for c in sums])
    at, total, rows = {c: 0 for c in sums}, 0, []
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], total, *[at[c] for c in sums]))
        total += r["n"]
        for c in sums:
            at[c] += r[f"s_{c}"]
    off = spark.createDataFrame(rows, T.StructType([extra[0], T.StructField("_o", T.LongType())] + [T.StructField(f"_o_{c}", T.LongType()) for c in sums]))
    # one row per partition: small by construction
    out = local.join(F.broadcast(off), "_part")
    return out.select(*df.columns, (F.col("_row") + F.col("_o")).alias("row_index"), *[(F.col(f"_run_{c}") + F.col(f"_o_{c}")).alias(f"pre_{c}") for c in sums])


#: Rows of small keys that a group of ``in_groups`` has, about.
GROUP = 20_000


def in_groups(df: DataFrame, key: str, order: list[str], f, schema: str) -> DataFrame:
    """``f`` on the rows of each value of the long ``key``, sorted by ``order``: many values to a group, so that small ones cost no group each."""
    import pandas as pd

    df = materialize(df, "groups")
    groups = max(1, -(-df.count() // GROUP))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, *order], ignore_index=True)
        k = pdf[key].to_numpy()
        cuts = [0, *((k[1:] != k[:-1]).nonzero()[0] + 1).tolist(), len(k)]
        return pd.concat([f(pdf.iloc[i:j]) for i, j in zip(cuts, cuts[1:])], ignore_index=True)

    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group")).applyInPandas(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round's edges
    are a table in the shared folder; minima are pre-aggregated on the map side, so a hub
    costs one partial row per task, and joins on a hub are split by AQE.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct()
    e = materialize(e, "cc")
    last, ids = None, None
    for _ in range(max_rounds):
        ids = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if ids["n"] == 0 or (ids["n"], ids["h"]) == last:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a"), F.col("a")).distinct())
        last = (ids["n"], ids["h"])
        both = e.select(F.col("a").alias("s"), F.col("b").alias("d")).union(e.select("b", "a"))
        m = both.groupBy("s").agg(F.min("d").alias("m")).select("s", F.least("s", "m").alias("m"))
        large = both.where("d > s").join(m, "s").select(F.col("m").alias("a"), F.col("d").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(low, "b")
        small = star.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(low.select(F.col("m").alias("a"), "b")).distinct()
        new = materialize(small, "cc")
        drop_tables(spark, e)
        e = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
