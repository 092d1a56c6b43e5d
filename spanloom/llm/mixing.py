"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: tuple[int, int] = (3, 2), repeat: int = 2) -> DataFrame:
    """(source, source_size) -> + weight, target, virtual_end.

    Sources in code point order, null last, take the weights in turn. The budget is
    share[0]/share[1] of all sizes. A target stops at ``repeat`` times the source's size; what is
    over is shared again by weight until none is above. That level is the virtual time at which
    queues served at their weights have given out the whole budget (``virtual_end``): with sources by the time at which they
    run out, the level of the first one that lasts, which is the highest of those that do.
    One row per source; the windows run over sources, not documents.
    """
    num, den = share
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("_ratio", F.lit(repeat) * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_left", F.lit(num) * F.col("_total") - F.lit(den * repeat) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / (F.lit(float(den)) * F.col("_w")))
    )
    s = s.withColumn("virtual_end", F.coalesce(F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything), F.max("_ratio").over(everything)))
    target = F.least(F.lit(float(repeat)) * F.col("source_size"), F.col("weight") * F.col("virtual_end"))
    return s.select("source", "source_size", "weight", "virtual_end", target.alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: tuple[int, int] = (3, 2), repeat: int = 2, seed: str = "mix", rows_a_part: int = 20_000) -> DataFrame:
    """The mix, one row per document, turn and part: doc_id, source, ``size``, ``source_size``, ``target``, ``turn``, ``part``,
    ``virtual_finish``, ``position`` and ``taken``, and key, prefix and seat, which name the document where ids repeat.

    Each source's documents are shuffled (by a digest of seed and doc_id) and queue up to ``repeat`` times; a document's virtual finish
    time is its queue's cumulative words divided by the weight, kept exact as a whole number of 1/lcm(weights). All rows are range-sorted by
    finish time, ``position`` is the words of the mix before a row, and the stream is truncated at the total budget: a row's ``taken`` is what of it
    lies before the budget. So that a source isn't a long document away from its target at the end, the document that its queue is serving when the
    budget runs out (at ``virtual_end``, see source_targets) stands in the stream as two parts: the words served by then, and the rest.

    A hot source is dealt over prefixes of the digest, as many as make parts of about ``rows_a_part`` rows, and the global order over
    Spark's range partitions, whose numbers are checkpointed with the rows; the totals of the parts give the offsets. What is checkpointed
    isn't made again, so a lost executor's tasks are redone alike.
    Null text: size 0. Null source: a source of its own. Repeated rows: each is a document.
    Null doc_id: kept, shuffled as the empty string. Empty table: no rows. Extra columns are ignored.
    """
    num, den = share
    unit = lcm(*weights)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("source", "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("key"))
    rows = cut(rows)
    parts = 1 << max(0, (rows.count() // rows_a_part).bit_length())
    # the first 28 bits of the digest, as a number below ``parts``: it keeps the digests' order
    rows = rows.withColumn("prefix", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.lit(parts) / F.lit(1 << 28)).cast("long"))
    sums = rows.groupBy("source", "prefix").agg(F.sum("size").alias("part_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, repeat)
    targets = cut(targets.withColumn("budget", F.floor(F.sum("source_size").over(Window.partitionBy()) * F.lit(num) / F.lit(den))).withColumnRenamed("source", "s"))
    before = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "prefix", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s").withColumnRenamed("prefix", "p")
    queue = Window.partitionBy("source", "prefix").orderBy("key", "doc_id", "size")
    queued = rows.withColumn("before", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("seat", F.row_number().over(queue))
    queued = queued.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p"))).drop("s", "p")
    turns = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("before", F.col("before") + F.col("offset") + F.col("turn") * F.col("source_size"))
    served = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target").cast("long") - F.col("before")))
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("served").alias("words"), F.lit(0).cast("long").alias("skipped")), F.struct(F.lit(1).alias("part"), (F.col("size") - F.col("served")).alias("words"), F.col("served").alias("skipped")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("size").alias("words"), F.lit(0).cast("long").alias("skipped")))
    turns = turns.withColumn("served", served).withColumn("x", F.explode(F.when((F.col("served") > 0) & (F.col("served") < F.col("size")), both).otherwise(whole)))
    finish = (F.col("before") + F.col("x.skipped") + F.col("x.words")) * (F.lit(unit) / F.col("weight")).cast("long")
    stream = cut(turns.select("doc_id", "source", "size", "source_size", "target", "budget", "turn", "key", "prefix", "seat", "x.part", "x.words", finish.alias("virtual_finish")))
    order = ["virtual_finish", F.col("source").asc_nulls_last(), "turn", "key", "doc_id", "size", "part", "seat"]
    ranged = cut(stream.where("words > 0").repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    starts = ranged.groupBy("range").agg(F.sum("words").alias("in_range"))
    starts = starts.select("range", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("words").over(before), F.lit(0))).join(starts, "range")
    placed = placed.withColumn("position", F.col("start") + F.col("within")).drop("start", "within", "range")
    empty = stream.where("words = 0").withColumn("position", F.lit(None).cast("long"))
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("budget") - F.coalesce("position", F.col("budget"))))
    return placed.unionByName(empty.select(placed.columns)).withColumn("taken", left).drop("budget", "words")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken over all turns,
    and the position of its first words in the mix (null: the mix takes none)."""
    m = mix(docs, **options)
    # (source, prefix, seat) names the document, also where rows or ids repeat
    return (
        m.groupBy("source", "prefix", "seat", "doc_id", "size", "source_size", "target")
        .agg(F.sum("taken").alias("taken"), F.min(F.when(F.col("taken") > 0, F.col("position"))).alias("position"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "position")
    )
