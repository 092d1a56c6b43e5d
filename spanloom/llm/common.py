"""What the training-data operators share: tables, lineage cuts, running sums, union-find."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that split at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send a module's functions and classes to the Python workers by value, so that executors need no install.

    That holds for what a function's closure carries; broadcasts are pickled by reference, so they carry plain tuples, dicts and arrays only.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def slices(batches, rows: int = 512) -> Iterator:
    """Arrow batches in slices of a few rows, so that what Python holds of a batch at a time is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the folder that the session names (spark.checkpoint.dir).

    A local master without one gets a folder of the warehouse, which all its tasks share; on a cluster it is an error, as
    a folder of the driver alone would lose recovery.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


#: Rows of a narrow table that one task does as fast as many.
ALONE = 250_000


def gathered(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpointed table of few and narrow rows in one partition: joins and aggregations of such tables need no shuffle. Others as they are."""
    return df.coalesce(1) if (df.count() if rows is None else rows) <= ALONE else df


def fence(docs: DataFrame, *own: str) -> tuple:
    """docs with every column but ``own`` under a name of ours, so that no name of the caller clashes with one that an operator adds; and
    a function that selects docs' columns again, by their names, from what the operator returns."""
    inner = [n if n in own else f"c{k}" for k, n in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda df: df.select(*[F.col(i).alias(n) for i, n in zip(inner, docs.columns, strict=True)])


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def row_key(docs: DataFrame) -> list[Column]:
    """r1, r2 and at: a row's identity, 128 bits of its doc_id and text, and its place in the order of rows.

    The order is by doc_id; ids that are no integers, and null, come after by their hash and their text's. Rows with one doc_id
    go by the hash of their text. Rows equal in both are copies of one row.
    """
    name, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), F.col("text")
    late = F.lit(str(2**63)).cast("decimal(20,0)") + F.shiftrightunsigned(F.xxhash64(F.lit("at"), name, text), 1).cast("decimal(20,0)")
    own = F.col("doc_id").cast("decimal(20,0)") if dict(docs.dtypes)["doc_id"] in INTEGRAL else F.lit(None).cast("decimal(20,0)")
    place = F.coalesce(own, late.cast("decimal(20,0)")) * F.lit(10**8).cast("decimal(9,0)") + F.pmod(F.xxhash64(text), F.lit(10**8)).cast("decimal(8,0)")
    return [F.xxhash64(name, text).alias("r1"), F.xxhash64(text, F.lit("row"), name).alias("r2"), place.cast("decimal(28,0)").alias("at")]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def running_starts(lengths: Column, block: int = 64) -> Column:
    """Exclusive running sums of an array of long, by blocks: linear work where an array that grows
    element by element would be copied each time."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def with_arr(a: Column) -> Column:
        n = F.size(a)
        blocks = F.transform(upto(F.ceil(n / block).cast("int")), lambda k: total(F.slice(a, k * block + 1, F.lit(block))))
        offsets = let(blocks, lambda b: F.transform(upto(F.size(b)), lambda k: total(F.slice(b, F.lit(1), k))))
        return let(
            offsets,
            lambda o: F.transform(upto(n), lambda i: F.get(o, F.floor(i / block).cast("int")) + total(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block))),
        )

    return let(lengths, with_arr)


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """u, v: each edge from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("x")).select("x.u", "x.v")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Distributed union-find over edges of long ids: (node, component), the smallest id reachable.

    Alternates large-star and small-star rounds until the edges are stars around the smallest id.
    Each round aggregates a minimum per node (map-side combined) and joins it back, so no
    neighbourhood is ever gathered in one row; a hub's rows are split by AQE's skew join. Up to
    ALONE edges are done in one task, without a shuffle.
    Nodes without an edge to another node don't appear.
    """

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    seen = mark(e)
    if not seen[0]:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(max_rounds):
        # again after each join, whose result the planner deals out anew otherwise
        one = lambda df: gathered(df, seen[0])  # noqa: B023, E731
        both = both_ways(one(e), "hi", "lo")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = one(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        e = cut(one(small.select("x.hi", "x.lo").where("hi <> lo")).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"union-find did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
