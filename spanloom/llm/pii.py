"""Personal data: base patterns, and bootstrapped contextual extraction (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running_starts

KINDS = ["email", "ip", "card", "phone"]
_L = r"A-Za-z0-9._%+-"
#: The base patterns, written so that a failing start is not tried again from each later character of its run:
#: possessive runs, and a start only where the run starts or the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Cheap tests without which a text has no match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Kinds that only the method finds, by the shape of their seeds: long hex digests and tokens with a known prefix.
MORE = {"secret": r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}"}
NAMES = [*KINDS, *MORE]
#: Identifier-like stretches: phones and cards with blanks, else a blank-separated token with a digit or @.
CANDIDATE = r"(?<![^\s])(?:\+[0-9][\x20().0-9-]+[0-9](?![0-9])|[0-9](?:[\x20-]?[0-9]){12,}+|[^\s0-9@]*+[0-9@][^\s]*+)"


def is_kind(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def found(text: Column, regex: str, keep, around=None) -> Column:
    """array of (start, end, value) of all matches in code points, and what ``around`` makes of the matches m, the gaps g and a match's number.
    Gaps and matches alternate, so running sums of their lengths give the places."""
    m, g = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex)

    def placed(x: Column) -> Column:
        n = F.size(x["m"])
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.length(F.get(x["g"], i)).cast("long") + F.length(F.get(x["m"], i)))
        starts = running_starts(each)
        rows = F.transform(
            starts,
            lambda s, i: F.struct(
                (s + F.length(F.get(x["g"], i))).alias("start"),
                (s + F.length(F.get(x["g"], i)) + F.length(F.get(x["m"], i))).alias("end"),
                F.get(x["m"], i).alias("value"),
                *(around(x, i) if around else ()),
            ),
        )
        return F.filter(rows, keep)

    some = F.transform(F.filter(F.array(F.struct(m.alias("m"), g.alias("g"))), lambda x: F.size(x["m"]) > 0), placed)
    return F.flatten(some)


def base_spans(text: Column) -> Column:
    """array of (start, kind number, end), sorted: the valid matches of the base patterns."""
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")

    def part(k: int, kind: str) -> Column:
        hits = found(text, PATTERNS[kind], lambda x: is_kind(kind, x["value"]))
        spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)

    return F.sort_array(F.concat(*[part(k, kind) for k, kind in enumerate(KINDS)]))


def counts(spans: str, kinds: int = len(KINDS)) -> list[Column]:
    """n_email and so on: spans of each kind."""

    def of(k: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")

    return [of(k).alias(f"n_{kind}") for k, kind in enumerate(NAMES[:kinds])]


def _neighbours(x: Column, i: Column) -> tuple[Column, Column]:
    """left and right: the text from the match before, itself included, to the one after, by blanks."""

    def part(k: Column) -> Column:
        return F.coalesce(F.get(x["m"], k), F.lit(""))

    plain = lambda t: F.translate(t, "\t\n\x0b\x0c\r", "     ")
    before = F.substring_index(F.rtrim(plain(F.concat(F.when(i > 0, part(i - 1)).otherwise(F.lit("")), F.get(x["g"], i)))), " ", -8)
    after = F.substring_index(F.ltrim(plain(F.concat(F.get(x["g"], i + 1), part(i + 1)))), " ", 1)
    return before.alias("left"), after.alias("right")


def candidates(text: Column) -> Column:
    """array of (start, end, instance, contexts, seed kind or null) of identifier-like tokens: those with an @ or four digits.

    Marks around a token aren't part of it; those before it end its left context, as the quote in ``token = "``. An instance of over 64
    code points is known by its digest. Contexts: the last word to the left if it has a letter, the last two and three, the first to
    the right, and the two at either side. They reach over neighbouring tokens, as far as eight blanks to the left.
    """
    hits = found(text, CANDIDATE, lambda x: F.contains(x["value"], F.lit("@")) | (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 4), _neighbours)

    def row(x: Column) -> Column:
        v = x["value"]
        headless = F.regexp_replace(v, r"^[^\p{L}\p{N}+]+", "")
        bare = F.regexp_replace(headless, r"[^\p{L}\p{N}]+$", "")
        start = x["start"] + F.length(v) - F.length(headless)
        seed = F.lit(None).cast("int")
        for k, kind in reversed(list(enumerate(NAMES))):
            fits = bare.rlike(f"^(?:{PATTERNS[kind]})$") & is_kind(kind, bare) if kind in PATTERNS else bare.rlike(f"^(?:{MORE[kind]})$")
            seed = F.when(fits, F.lit(k)).otherwise(seed)
        left = F.lower(F.btrim(F.regexp_replace(F.concat(x["left"], F.lit(" "), F.left(v, F.length(v) - F.length(headless))), " +", " ")))
        right = F.lower(x["right"])
        one, two, three = (F.substring_index(left, " ", -n) for n in (1, 2, 3))
        ctx = F.array(
            F.when(one.rlike(r"\p{L}"), F.concat(F.lit("L:"), one)),
            F.when(F.instr(left, " ") > 0, F.concat(F.lit("L:"), two)),
            F.when(three != two, F.concat(F.lit("L:"), three)),
            F.when(right.rlike(r"\p{L}"), F.concat(F.lit("R:"), right)),
            F.when((one != "") & (right != ""), F.concat(F.lit("B:"), one, F.lit(" _ "), right)),
        )
        inst = F.lower(bare)
        return F.struct(
            start.alias("start"), (start + F.length(bare)).alias("end"), F.when(F.length(inst) > 64, F.sha2(inst, 256)).otherwise(inst).alias("inst"), F.filter(ctx, lambda c: c.isNotNull()).alias("ctx"), seed.alias("seed")
        )

    rows = F.transform(hits, row)
    return F.when(text.rlike("[0-9@]"), rows).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,inst:string,ctx:array<string>,seed:int>>)"))


def bootstrap(cands: DataFrame, rounds: int = 3, min_seeds: int = 5, min_confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(instances, patterns): identifiers that contexts find beyond the base kinds' seeds, and these contexts.

    cands: inst, ctx, seed. The graph has an edge for each distinct (pattern, instance), a pattern being a lexical context. Each round
    scores a pattern for a kind: the scores s of its known instances of the kind against contradictions, s / (s + known ones of other
    kinds + half the unknown ones + 1); and an instance by its patterns (noisy or). Only patterns with ``min_seeds`` distinct
    instances of the kind and the confidence extend the set. Seeds of the kinds in MORE count as known, but are found only where a pattern says so.
    """
    edges = cands.where("inst <> ''").select(F.explode("ctx").alias("pattern"), "inst", "seed").groupBy("pattern", "inst").agg(F.min("seed").alias("seed"))
    edges = cut(edges)
    base = cut(edges.where("seed is not null").groupBy("inst").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0)))
    totals = cut(edges.groupBy("pattern").agg(F.count("*").alias("total")))
    known, patterns, best = base, None, None
    for _ in range(rounds):
        hits = edges.select("pattern", "inst").join(known, "inst").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("support"))
        told = hits.groupBy("pattern").agg(F.sum("support").alias("told"))
        scored = hits.where(F.col("support") >= min_seeds).join(totals, "pattern").join(told, "pattern")
        scored = scored.withColumn("confidence", F.col("s") / (F.col("s") + F.col("told") - F.col("support") + (F.col("total") - F.col("told")) / 2 + 1))
        patterns = cut(scored.where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence", "support"))
        fresh = edges.where(F.col("seed").isNull() | (F.col("seed") >= len(KINDS))).join(patterns, "pattern").where("seed is null or seed = kind")
        fresh = fresh.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = fresh.groupBy("inst").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("inst", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))
        best = cut(best.where(F.col("score") >= min_confidence))
        known = base.unionByName(best.join(base.select("inst"), "inst", "left_anti"))
    return best, patterns


def digest_form(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """docs without text + base (array of start, kind, end), added (the same, found by context alone).

    Kinds are numbers of NAMES (base spans of KINDS only); offsets are code points, end exclusive. Base spans are leftmost and
    non-overlapping for each kind and always stay; an added span overlaps none. Null text: empty. Empty table: no rows. Repeated rows each get
    their spans. Clashing columns are replaced. The text is scanned once; what follows has only spans and contexts.
    """
    cols = [c for c in docs.columns if c not in ("text", "base", "added", "_row")]
    text = F.coalesce("text", F.lit(""))
    spans = cut(docs.select(*cols, F.monotonically_increasing_id().alias("_row"), base_spans(text).alias("base"), candidates(text).alias("_c")))
    each = spans.select("_row", "base", F.explode("_c").alias("c"))
    new, _ = bootstrap(each.select("c.inst", "c.ctx", "c.seed"), **options)
    free = each.where(~F.exists("base", lambda x: (x["start"] < F.col("c.end")) & (F.col("c.start") < x["end"])))
    added = free.select("_row", "c.start", "c.end", "c.inst").join(new.select("inst", "kind"), "inst")
    added = added.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return spans.drop("_c").join(added, "_row", "left").withColumn("added", F.coalesce("added", none)).drop("_row")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        skip = x["start"] < acc["at"]
        grown = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.get(names, x["kind"]))
        return F.struct(F.when(skip, acc["out"]).otherwise(grown).alias("out"), F.when(skip, acc["at"]).otherwise(x["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
