"""What the corpus operators share: staging tables in the shared folder, skew-safe joins and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies made of the small side of a join whose large side may have hot keys.
SALTS = 32

_roots: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _roots[path] = spark
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _roots.pop(path, None)


@atexit.register
def sweep() -> None:
    """Delete every staged table of this process. Results that read them must have been consumed."""
    for path, spark in list(_roots.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            return


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column); a null id matches a null id."""
    key = free_name(docs, "kept_id")
    ids = ids.toDF(key)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[key]), "left_semi")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """``left`` LEFT JOIN ``right`` USING key, where many rows of ``left`` may share a key and ``right`` has one row a key.

    Rows of ``left`` with one key are dealt over ``salts`` tasks by ``spread``; ``right`` is copied as often.
    """
    left = left.withColumn("join_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("join_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "join_salt"], "left").drop("join_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps, O(log^2 n) rounds. Each round is a written table, so lineage stays
    short; minima are pre-aggregated and a hub's neighbours are dealt over tasks; only the number of edges and a checksum
    reach the driver.
    """
    cur = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    print_of = None
    while True:
        large = _star(cur, large=True)
        nxt = staged(_star(large, large=False), "cc")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(now) == print_of:
            break
        print_of = tuple(now)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select("b", "b").distinct()
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: neighbours above a node move to its least neighbour. Small: those below it, and itself, do."""
    down = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    sides = down.union(edges.select("b", "a")) if large else down
    least = sides.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    moved = salted_left_join(sides, least, "v", F.col("u"), salts=8)
    if large:
        moved = moved.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("u").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("v").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()
