"""Fuzzy line dedup by MinHash over character shingles (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import both_ways, components, cut, fence, gathered, let, row_key

SHINGLE = 8
BANDS, ROWS = 7, 4
MINIMA = BANDS * ROWS
#: Buckets of up to so many lines are paired line by line; the lines of larger ones meet by their rarest shingles.
PAIRED = 16
#: A pair is verified if its signatures agree in this many of the 28 places: one at a similarity of 0.8 does but for 0.007.
AGREE = 17
#: The same in the second round, whose pairs are mostly below 0.8: at 0.85 one fails this by a probability of 0.009, at 0.8 of 0.06.
AGREE_AGAIN = 19
#: Rows of ids (16 to 40 bytes each) that are broadcast at most; beyond, the join shuffles.
SMALL = 500_000
#: Shingles hashed in one row while signing.
STRIDE = 16
BLANK = " \t\n\x0b\x0c\r"
#: Longs of a line's parities: bit b says whether the number of its shingles that hash to b is odd.
WORDS = 8
#: Lines of large buckets, about, in which shingles are counted to put them in an order; any order is exact.
COUNTED = 1000
#: Odd constants, by a rule, that turn one 32-bit hash into many orders.
MIX = [((k + 1) * 0x9E3779B1 ^ (k * k + 7) * 0x85EBCA6B) & 0xFFFFFFFF for k in range(MINIMA)]


def _int(x: int) -> int:
    return x - (1 << 32) if x >= 1 << 31 else x


def _blank(line: Column) -> Column:
    # from the left only: from the right it takes every character's place first
    return F.ltrim(line, F.lit(BLANK)) == ""


def lines(docs: DataFrame) -> DataFrame:
    """at (order of the row), line_no (from 0), line, line_id: the lines that hold a word."""
    out = docs.select(row_key(docs)[2], F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(~_blank(F.col("line")))
    return out.select("at", "line_no", "line", F.xxhash64("line").alias("line_id"))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2, at, nos, ids, checks: the numbers, 64-bit ids and other hashes of each row's lines. Checkpointed: what is asked of lines
    but their texts is asked of this."""
    split = docs.select("doc_id", *row_key(docs), F.split(F.coalesce("text", F.lit("")), "\n").alias("split"))
    nos = F.filter(F.transform("split", lambda x, i: F.when(~_blank(x), i)), lambda i: i.isNotNull())
    held = split.select("doc_id", "r1", "r2", "at", "split", nos.alias("nos"))
    return cut(held.select("doc_id", "r1", "r2", "at", "nos", F.transform("nos", lambda i: F.xxhash64(F.get("split", i))).alias("ids"), F.transform("nos", lambda i: F.hash(F.get("split", i))).alias("checks")))


def _place(at: Column, line_no: Column) -> Column:
    """A line's place in the order of all: by row, then by line."""
    return ((at * F.lit(10**10).cast("decimal(11,0)")).cast("decimal(38,0)") + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def occurrences(rows: DataFrame) -> DataFrame:
    """r1, r2, line_no, at (place in the order), line_id, check of each line."""
    out = rows.select("r1", "r2", "at", "nos", "checks", F.posexplode("ids").alias("p", "line_id"))
    no = F.get("nos", F.col("p"))
    return out.select("r1", "r2", no.alias("line_no"), _place(F.col("at"), no).alias("at"), "line_id", F.get("checks", F.col("p")).alias("check"))


def _piece(u: Column, at: Column) -> Column:
    return F.substring(u, at * 2 - 1, F.lit(2 * SHINGLE))


def signatures(occurrences: DataFrame) -> DataFrame:
    """line_id, k0..k6: the 28 minima of each line's runs of 8 UTF-16 units, by their low 16 bits, the four of a band in one long.

    Every run is hashed, the set that the verification compares, several in one row (past a line's end its last run again, which
    changes no minimum); each minimum orders the hashes by its own XOR mask. The minima combine before the shuffle, which carries no text.
    """
    wide = occurrences.select("line_id", F.encode("line", "UTF-16BE").alias("u"))
    wide = wide.select("line_id", "u", F.greatest(F.lit(1), (F.octet_length("u") / 2).cast("int") - (SHINGLE - 1)).alias("last"))
    each = wide.select("line_id", "u", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(STRIDE))).alias("i"))
    hashes = [F.shiftright(F.xxhash64(_piece(F.col("u"), F.least(F.col("i") + k, F.col("last")))), 32).cast("int").alias(f"h{k}") for k in range(STRIDE)]
    minima = [F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(_int(MIX[m]))) for k in range(STRIDE)])).alias(f"m{m}") for m in range(MINIMA)]
    found = each.select("line_id", *hashes).groupBy("line_id").agg(*minima)

    def packed(b: int) -> Column:
        out = F.lit(0).cast("long")
        for r in range(ROWS):
            out = out.bitwiseOR(F.shiftleft(F.col(f"m{ROWS * b + r}").cast("long").bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * r))
        return out.alias(f"k{b}")

    return found.select("line_id", *[packed(b) for b in range(BANDS)])


def _lane(x: Column, place: int) -> Column:
    return F.shiftright(x, 16 * (place % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _small(ids: DataFrame) -> DataFrame:
    """A checkpointed table to join with: broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def meetings(sig: DataFrame) -> DataFrame:
    """line_id, key, head (the bucket's first), members: a row per line and bucket of two lines or more."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.col(f"k{b}")) for b in range(BANDS)])
    met = sig.select("line_id", F.explode(keys).alias("key"))
    heads = cut(met.groupBy("key").agg(F.min("line_id").alias("head"), F.count("*").alias("members")).where("members > 1"))
    return met.join(_small(heads), "key").select("line_id", "key", "head", "members")


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """line_id, comp: of linked lines the smallest id within two links. Lines with one label are linked; others may be."""
    n = edges.count()
    one = lambda df: gathered(df, n)
    both = both_ways(one(edges), "a", "b")
    near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    far = one(both.join(near.withColumnRenamed("u", "v"), "v")).groupBy("u").agg(F.min("m").alias("far"))
    return one(far.join(near, "u").select(F.col("u").alias("line_id"), F.least("far", "m").alias("comp")))


def open_lines(shared: DataFrame, label: DataFrame) -> DataFrame:
    """line_id, key, members, comp, stray: the lines of the buckets whose lines aren't known to be linked after the first round.

    A stray hasn't its head's label. Of two lines of a bucket with different labels, one is a stray.
    """
    label = _small(cut(label))
    rest = shared.where("members > 2").join(label, "line_id", "left").join(label.select(F.col("line_id").alias("head"), F.col("comp").alias("home")), "head", "left")
    rest = rest.select("line_id", "key", "members", F.coalesce("comp", "line_id").alias("comp"), (F.coalesce("comp", "line_id") != F.coalesce("home", "head")).alias("stray"))
    return rest.join(_small(cut(rest.where("stray").select("key").distinct())), "key", "left_semi")


def small_pairs(rest: DataFrame) -> DataFrame:
    """x, y: the pairs of a bucket with different labels."""
    x = rest.where("stray").select(F.col("line_id").alias("x"), "key", F.col("comp").alias("cx"))
    y = rest.select(F.col("line_id").alias("y"), "key", F.col("comp").alias("cy"))
    return x.join(y, "key").where("cx <> cy").select("x", "y")


def prefixes(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """line_id, size, w0..w7 (parities of the shingles), first: the shingles of each line that come first in one order of all; texts: n rows of line_id, line.

    Of two lines at the threshold, one of the first ``size - threshold * size + 1`` shingles of each is common, in any order of all shingles. Here those
    come last that are frequent in some lines, so that few lines meet by them. Which lines are counted changes what the search costs, not what it finds.
    """
    texts = texts.repartition("line_id")
    counted = texts.where(F.pmod(F.xxhash64(F.lit("counted"), "line_id"), F.lit(max(1, n // COUNTED))) == 0).select(F.explode(shingles(F.col("line"))).alias("token"))
    frequent = cut(counted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    each = texts.select("line_id", F.explode(shingles(F.col("line"))).alias("token")).join(_small(frequent), "token", "left")
    words = [F.bit_xor(F.when(F.pmod(F.shiftright("token", 6), F.lit(WORDS)) == w, F.expr("shiftleft(1L, CAST(token & 63 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    per = each.groupBy("line_id").agg(F.count("*").cast("int").alias("size"), *words, F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("t"))
    upto = F.floor(F.col("size") * F.lit(1 - threshold) + F.lit(1 + 1e-6)).cast("int")
    return per.select("line_id", "size", *[f"w{w}" for w in range(WORDS)], F.transform(F.slice("t", F.lit(1), upto), lambda e: e["token"]).alias("first"))


def meeting_shingles(first: DataFrame, own: DataFrame) -> DataFrame:
    """line_id, comp, size, w0..w7, pos, token, stray: a row for each of the first shingles of a line that is one of another label's line too; first: of
    prefixes(); own: line_id, comp. A stray hasn't the token's most frequent label; of two lines with different labels one is a stray."""
    crowds = own.groupBy("comp").agg(F.count("*").alias("crowd"))
    label = cut(own.join(crowds, "comp").select("line_id", "comp", "crowd"))
    rows = first.join(_small(label), "line_id")
    homes = rows.select("comp", "crowd", F.explode("first").alias("token")).groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", "crowd").alias("home"))
    homes = cut(homes.where("lo <> hi").select("token", "home"))
    kept = ["line_id", "comp", "size", *[f"w{w}" for w in range(WORDS)]]
    each = rows.select(*kept, F.posexplode("first").alias("k", "token")).join(_small(homes), "token")
    return each.select(*kept, (F.col("k") + 1).alias("pos"), "token", (F.col("comp") != F.col("home")).alias("stray"))


def _side(rows: DataFrame, n: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(n + c) for c in rows.columns if c not in ("token", "stray")])


def _possible(threshold: float) -> Column:
    """What holds of two lines of different labels at the threshold, where they first meet: enough shingles are left, and not too many are known to be in one line only."""
    sizes = F.col("xsize") + F.col("ysize")
    left = 1 + F.least(F.col("xsize") - F.col("xpos"), F.col("ysize") - F.col("ypos"))
    parted = [F.bit_count(F.col(f"xw{w}").bitwiseXOR(F.col(f"yw{w}"))) for w in range(WORDS)]
    return (F.col("xcomp") != F.col("ycomp")) & (left * F.lit(1 + threshold) >= F.lit(threshold) * sizes - F.lit(1e-6)) & (sum(parted[1:], parted[0]) * F.lit(1 + threshold) <= F.lit(1 - threshold) * sizes + F.lit(1e-6))


def star_pairs(hot: DataFrame, own: DataFrame) -> DataFrame:
    """a, b: lines and, of each of their large buckets, the line that is in the most and largest ones, as the origin of a family is, and one by chance;
    of different labels."""
    weights = hot.groupBy("line_id").agg(F.sum("members").alias("weight"))
    heads = hot.join(_small(cut(weights)), "line_id").groupBy("key").agg(F.max_by("line_id", "weight").alias("h0"), F.max_by("line_id", F.xxhash64("line_id", "key")).alias("h1"))
    met = hot.select("line_id", "key").join(_small(cut(heads)), "key").select(F.col("line_id").alias("x"), F.explode(F.array("h0", "h1")).alias("y")).where("x <> y")
    side = lambda n: own.select(F.col("line_id").alias(n), F.col("comp").alias(f"c{n}"))
    return _unordered(met).join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b")


def all_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """x, y: every pair of lines of different labels that may be at the threshold; y is the shorter line, of which fewer shingles do."""
    few = rows.where((1 + F.col("size") - F.col("pos")) * F.lit(1 + threshold) >= F.lit(2 * threshold) * F.col("size") - F.lit(1e-6))
    shorter = (F.col("ysize") < F.col("xsize")) | ((F.col("ysize") == F.col("xsize")) & (F.col("yline_id") < F.col("xline_id")))
    # lines of a token's most frequent label, which may be most of its lines, are not held against each other
    met = [_side(x, "x").join(_side(y, "y"), "token").where(shorter & _possible(threshold)) for x, y in ((rows.where("stray"), few), (rows.where("not stray"), few.where("stray")))]
    return met[0].unionAll(met[1]).select(F.col("xline_id").alias("x"), F.col("yline_id").alias("y"))


def hot_pairs(hot: DataFrame, edges: DataFrame, known: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b), similar pairs, and (x, y), pairs to verify: together they link all lines of the large buckets that are similar, whatever the size of a bucket.

    Exact: every pair with different labels is to be verified, unless its first shingles or parities show that it is below the threshold. Before that, each
    line is compared with two heads of its buckets, so that dense families leave few pairs; a label is then all that a line is known to be linked to.
    """
    own = cut(hot.groupBy("line_id").agg(F.min("comp").alias("comp")))
    ids = own.select("line_id")
    links = own.select(F.col("line_id").alias("a"), F.col("comp").alias("b")).unionAll(edges.join(_small(ids), F.col("a") == F.col("line_id"), "left_semi").join(_small(ids), F.col("b") == F.col("line_id"), "left_semi"))
    # these only spare the exact search pairs, so the signatures may speak first
    stars = cut(verified(star_pairs(hot, _small(own)).withColumn("least", F.lit(AGREE_AGAIN)), known, threshold))
    label = components(links.unionAll(stars)).withColumnRenamed("node", "line_id")
    own = cut(ids.join(label, "line_id", "left").select("line_id", F.coalesce("component", "line_id").alias("comp")))
    first = cut(prefixes(known.join(_small(ids), "line_id").select("line_id", "line"), own.count(), threshold))
    return stars, all_pairs(cut(meeting_shingles(first, own)), threshold)


def runs(line: Column) -> Column:
    """A line's runs of 8 UTF-16 units, each as its 64-bit hash, repeats included; a shorter line is its only one."""
    raw = F.encode(line, "UTF-16BE")

    def each(u: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(u) - (2 * SHINGLE - 1)), F.lit(2)), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * SHINGLE))))

    return let(raw, each)


def shingles(line: Column) -> Column:
    """The set of a line's runs."""
    return F.array_distinct(runs(line))


def verified(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, least) whose signatures agree in so many places and whose shingle sets have at least this Jaccard similarity;
    known: line_id, line, k0..k6."""
    side = lambda n: known.select(F.col("line_id").alias(n), F.col("line").alias(f"l{n}"), *[F.col(f"k{b}").alias(f"{n}{b}") for b in range(BANDS)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    agree = [(_lane(F.col(f"a{p // ROWS}").bitwiseXOR(F.col(f"b{p // ROWS}")), p) == 0).cast("int") for p in range(MINIMA)]
    likely = both.where(sum(agree[1:], agree[0]) >= F.col("least"))
    # a row of its own for the runs, then for the count, so that each is made once a pair and no filter is moved below them
    sets = likely.select("a", "b", F.explode(F.array(F.struct(runs(F.col("la")).alias("ra"), runs(F.col("lb")).alias("rb")))).alias("x"))
    sets = sets.select("a", "b", "x.ra", "x.rb").select("a", "b", "ra", "rb", F.explode(F.array(F.size(F.array_intersect("ra", "rb")))).alias("shared"))
    # J >= t is shared >= t * (sizes - shared); the runs are at least as many as their set, whose size is asked only of pairs that need it
    enough = lambda sizes: F.col("shared") * F.lit(1 + threshold) >= F.lit(threshold) * sizes - F.lit(1e-9)
    return sets.where(enough(F.size("ra") + F.size("rb")) | enough(F.size(F.array_distinct("ra")) + F.size(F.array_distinct("rb")))).select("a", "b")


def similar_lines(docs: DataFrame, order: DataFrame, threshold: float = 0.8) -> DataFrame:
    """node, component: lines with a similar one, and the smallest line_id that similar lines lead to.

    Lines meet in 7 bands of 4 minima. First each line is compared with the head of each of its buckets; then, in buckets whose lines
    aren't all linked by that, all pairs with different labels are: directly in buckets of up to 16 lines, by their rarest shingles in larger ones.
    """
    sig = cut(signatures(lines(docs)))
    shared = cut(meetings(sig))
    wanted = cut(order.select("line_id", "first").join(shared.select("line_id").distinct(), "line_id", "left_semi"))
    texts = lines(docs).join(_small(wanted), "line_id").where(_place(F.col("at"), F.col("line_no")) == F.col("first")).select("line_id", "line").dropDuplicates(["line_id"])
    known = cut(texts.join(sig.join(_small(wanted.select("line_id")), "line_id", "left_semi"), "line_id"))
    edges = cut(verified(shared.where("line_id <> head").select(F.col("head").alias("a"), F.col("line_id").alias("b"), F.lit(AGREE).alias("least")).distinct(), known, threshold))
    rest = gathered(cut(open_lines(shared, labels(edges))))
    if not rest.isEmpty():
        few, hot = rest.where(F.col("members") <= PAIRED), rest.where(F.col("members") > PAIRED)
        pairs = small_pairs(few).withColumn("least", F.lit(AGREE_AGAIN))
        if not hot.isEmpty():
            stars, met = hot_pairs(hot, edges, known, threshold)
            edges, pairs = edges.unionAll(stars), pairs.unionAll(met.withColumn("least", F.lit(0)))
        pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("least").alias("least"))
        edges = edges.unionAll(verified(pairs, known, threshold))
    return components(edges)


def dropped_lines(rows: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(r1, r2, dropped): per row that loses any, its sorted line numbers to drop; rows: numbered(docs).

    Of each component of equal or similar lines, the first occurrence in the order of rows and lines stays. Lines are equal
    if their 64-bit ids are; an id with two other hashes, which two lines share by chance, drops nothing.
    """
    occ = occurrences(rows)
    order = occ.groupBy("line_id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    order = cut(order.where("lo = hi").select("line_id", "n", "first"))
    label = similar_lines(docs, order, threshold)
    member = label.withColumnRenamed("node", "line_id")
    member = member.unionAll(member.select(F.col("component").alias("line_id"), "component").distinct())
    member = gathered(cut(_small(member).join(order.select("line_id", "first"), "line_id")))
    stays = member.groupBy("component").agg(F.min("first").alias("stay"))
    similar = member.join(stays, "component").select("line_id", "stay")
    equal = order.where("n > 1").join(_small(member.select("line_id")), "line_id", "left_anti").select("line_id", F.col("first").alias("stay"))
    lost = occ.select("r1", "r2", "line_no", "at", "line_id").join(similar.unionAll(equal), "line_id").where("at <> stay")
    return lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def _copies(rows: DataFrame) -> DataFrame:
    """r1, r2 of the rows that stand more than once, and how often."""
    return cut(rows.groupBy("r1", "r2").agg(F.count("*").alias("copies")).where("copies > 1"))


def line_report(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_lines (lines with a word), n_dropped, dropped (line numbers from 0).

    Null or blank text: no lines. Lines without a word are never dropped. Ids of any type, repeated or null, are fine: a row is known by its id and
    its text. Of rows equal in both, one is kept as if alone and the others lose every line. Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = numbered(docs)
    gone = dropped_lines(rows, docs, threshold).select(F.col("r1").alias("g1"), F.col("r2").alias("g2"), "dropped")
    one = rows.select("doc_id", "r1", "r2", "nos", F.lit(1).cast("long").alias("copy"))
    copied = _copies(rows)
    if not copied.isEmpty():
        # the copies beside the one that stays lose all
        again = one.drop("copy").join(copied, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).join(copied, ["r1", "r2"])
        again = again.select("doc_id", "r1", "r2", "nos", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        one = one.join(copied, ["r1", "r2"], "left_anti").select(again.columns).unionAll(again)
    out = one.join(gone, (F.col("r1") == F.col("g1")) & (F.col("r2") == F.col("g2")), "left")
    lost = F.when(F.col("copy") > 1, F.col("nos")).otherwise(F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select("doc_id", F.size("nos").cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_dropped"), lost.alias("dropped"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with the dropped lines cut out of text; a document that loses all its lines goes.

    Of rows equal in doc_id and text one stays. Rows without a line (null or blank text) stay as they are, but for such copies. A column
    n_chars, if docs has it, is counted again where lines went. Other columns, whatever their names, stay as they are. Empty table: no rows.
    """
    inner, back = fence(docs, "doc_id", "text")
    plain = inner.select("doc_id", "text")
    numbers = numbered(plain)
    gone = dropped_lines(numbers, plain, threshold)
    rows = inner.select("*", *row_key(inner)[:2])
    copied = _copies(numbers)
    if not copied.isEmpty():
        one = rows.join(copied, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
        rows = rows.join(copied, ["r1", "r2"], "left_anti").unionByName(one)
    kept = rows.join(gone, ["r1", "r2"], "left")
    all_lines = F.split("text", "\n")
    # the dropped numbers are sorted and few; array_except keeps the order of the rest, which are distinct
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "dropped")
    cleaned = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    out = kept.withColumn("text", cleaned).where(F.col("dropped").isNull() | ~_blank(F.translate("text", "\n", " ")))
    if "n_chars" in docs.columns:
        n = inner.columns[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.col("dropped").isNull(), F.col(n)).otherwise(F.length("text").cast(inner.schema[n].dataType)))
    return back(out)
