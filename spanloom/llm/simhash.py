"""SimHash near-dedup: pivot distance tables find pairs, union-find joins them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fence, row_key, ship, slices

ship(__name__)

SEED = 42
BLOCKS = 4  # stretches of 16 bits
#: Shingles that are summed at a time; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(data: bytes | None, size: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; no words: 0."""
    ws = data.lower().split() if data else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    h = xxhash.xxh64_intdigest
    n = len(ws) - size + 1
    total = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        top = min(n, k + CHUNK)
        got = np.fromiter((h(joined[x:y], SEED) for x, y in zip(starts[k:top].tolist(), ends[k + size - 1 : top + size - 1].tolist(), strict=True)), np.uint64, top - k)
        total += np.unpackbits(got.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs without text + fp (long). Null, empty or wordless text: 0."""
    cols = [c for c in docs.columns if c not in ("text", "fp")]
    src = docs.select(*cols, "text")

    def run(batches):
        for b in slices(batches):
            got = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, size) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(np.array(got, np.uint64).view(np.int64))], names=[*cols, "fp"])

    return src.mapInArrow(run, docs.select(cols).schema.add("fp", "long"))


def pivots(extra: int = 24, seed: int = 11) -> np.ndarray:
    """The reference fingerprints: zero, the 64 with one bit, and ``extra`` random ones."""
    rng = np.random.default_rng(seed)
    return np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)), rng.integers(0, 2**64, extra, dtype=np.uint64)]).astype(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(blocks: int, kept: int) -> list[int]:
    width = 64 // blocks
    return [_signed(sum(((1 << width) - 1) << (width * k) for k in chosen)) for chosen in combinations(range(blocks), kept)]


def near_edges(fps: DataFrame, radius: int = 2, small: int = 64, extra: int = 24) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints at ``radius`` (1 or 2) or fewer bits; fps: distinct ``fp``.

    The pivot table gives each fingerprint its distances to zero and to the 64 one-bit pivots. The
    difference d(f, bit i) - d(f, 0) is 1 or -1 with the bit, so two fingerprints within 2 bits have
    equal coordinates over at least two of four stretches of 16 pivots: rows meet where those are
    equal (six keys of 32 coordinates). In a meeting of at most ``small``, pairs whose distances to any
    pivot, random ones included, differ by more than the radius are discarded, and the survivors
    verified. A larger meeting (a family of near copies) is never paired: each of its members goes to
    the 65 points within one bit, and members that share a point (at most 65 each) are within
    2 bits, and those within 2 share one. So no link is lost and no group pairs all its rows.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    met = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(BLOCKS, BLOCKS - 2)])).alias("band", "key"))
    sizes = met.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(met.join(sizes, ["band", "key"]))
    groups = shared.where(F.col("n") <= small).groupBy("band", "key").agg(F.collect_list("fp").alias("members")).select("members")
    table = fps.sparkSession.sparkContext.broadcast(pivots(extra))

    def pairs(batches):
        p = table.value
        for b in batches:
            left, right = [], []
            for row in b.column("members"):
                f = row.values.to_numpy().view(np.uint64)
                d = np.bitwise_count(f[:, None] ^ p[None, :]).astype(np.int8)
                x, y = np.triu_indices(len(f), 1)
                near = np.abs(d[x] - d[y]).max(1) <= radius
                x, y = x[near], y[near]
                real = np.bitwise_count(f[x] ^ f[y]) <= radius
                left.append(f[x[real]])
                right.append(f[y[real]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (left, right)], names=["a", "b"])

    edges = groups.mapInArrow(pairs, "a long, b long")
    dense = shared.where(F.col("n") > small).select("fp").distinct()
    reach = [0] + [_signed(1 << k) for k in range(64)]
    points = dense.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in reach])).alias("point"))
    if radius == 1:  # at one bit, a member's point is itself a member
        star = points.where("fp <> point").join(dense.withColumnRenamed("fp", "point"), "point", "left_semi").select(F.col("fp").alias("a"), F.col("point").alias("b"))
    else:
        star = points.groupBy("point").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
        star = star.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return edges.unionAll(star)


def _labels(fps: DataFrame, radius: int) -> DataFrame:
    """fp, component: each fingerprint and the smallest one (as a long) that links lead to."""
    comp = components(near_edges(fps, radius)).withColumnRenamed("node", "fp")
    return fps.join(comp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_components(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """docs without text + fp + component_id, the smallest doc_id reachable over links of ``radius`` bits.

    Exact copies share a fingerprint, so they are one row before any pairing. Null doc_id: kept; its
    component is the smallest non-null id in reach, null if there is none. Wordless texts have fingerprint zero and link
    like any other. Empty table: no rows. Repeated rows stay. Clashing columns are replaced.
    """
    base = docs.select([c for c in docs.columns if c not in ("fp", "component_id")])
    rows = cut(fingerprints(base, size))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = classes.join(_labels(classes.select("fp"), radius), "fp")
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = named.join(ids, "component").select("fp", "component_id")
    return rows.join(label, "fp")


def one_per_group(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """docs with one document of each group of near duplicates: the first in the order of rows (by doc_id, see row_key).

    Rows are known by id and text, so ids of any type, repeated or null, are fine: rows with one id and unlike texts are documents of their
    own. Of rows equal in both one stays. All wordless texts are one group. Empty table: no rows. Columns of any name stay as they are.
    """
    inner, back = fence(docs, "doc_id", "text")
    keys = row_key(inner)
    rows = cut(fingerprints(inner.select("text", *keys), size))
    classes = cut(rows.groupBy("fp").agg(F.min("at").alias("first")))
    named = classes.join(_labels(classes.select("fp"), radius), "fp")
    stays = cut(named.groupBy("component").agg(F.min("first").alias("at")).join(named.select("component", "fp"), "component").select("fp", "at"))
    kept = cut(rows.join(stays, ["fp", "at"], "left_semi").groupBy("r1", "r2").agg(F.count("*").alias("copies")))
    out = inner.select("*", *keys[:2])
    one = out.join(kept.where("copies = 1"), ["r1", "r2"], "left_semi")
    if not kept.where("copies > 1").isEmpty():
        one = one.unionByName(out.join(kept.where("copies > 1"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]))
    return back(one)
