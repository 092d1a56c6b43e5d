"""Line-first quality rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACES = " \t\n\x0b\x0c\r"
#: Phrases of page furniture (fixed values).
BOILERPLATE = [
    "all rights reserved", "click here", "cookie", "enable javascript", "javascript", "licensed under", "log in", "lorem ipsum", "newsletter",
    "privacy policy", "read more", "released under", "share this", "sign in", "sign up", "subscribe", "terms of service", "terms of use",
]


def words_of(text: Column) -> Column:
    flat = F.btrim(text, F.lit(SPACES))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, r"[\x20\x09-\x0D]+"))


def repeated_words(w: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the text.

    Window hashes are compared first: a text without equal ones, the common case, is done. Else hashes are
    sorted with their places, and equal neighbours give the places; no window is compared with all.
    """
    none = F.lit(0).cast("long")

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            def same(k: Column) -> Column:
                me = F.get(s, k)["h"]
                return (me == F.get(s, k - 1)["h"]) | (me == F.get(s, k + 1)["h"])

            at = F.filter(F.transform(s, lambda x, k: F.when(same(k), x["p"])), lambda p: p.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (size - 1)))))).cast("long")

        return let(placed, places)

    def of(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))

    return F.when(F.size(w) < size, none).otherwise(of(w))


def line_fails(line: Column, max_symbols: float = 0.1, plain_words: int = 15, menu_bars: int = 3, shout: float = 0.5) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule."""
    chars = F.length(line)
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>{}\\^~=]")) > F.lit(max_symbols) * chars
    shouting = F.regexp_count(line, F.lit(r"[!?]+")) > F.lit(shout) * n_words
    plain = (n_words >= plain_words) & ~line.rlike(r"[.,;:!?\u2026\u3002\uFF0C\u3001\uFF01\uFF1F\u061F\u060C\u0964]")
    menu = F.regexp_count(line, F.lit(r"[|\u00BB\u203A\u2022]")) >= menu_bars
    furniture = (chars <= 160) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return symbols | (shouting & (n_words >= 3)) | plain | menu | furniture


def rate(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.5, keep_text: bool = False) -> DataFrame:
    """docs without text + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_share, kept (and clean_text, if asked for).

    Each line that holds a word is judged by itself; failing lines go (clean_text is without them), and
    a document is rejected if they held more than ``max_lost`` of its characters in words, or if it has fewer than
    ``min_words`` words or over ``max_repeat`` per cent of them in repeated 3-word windows.
    Null or wordless text: all counts 0, rejected. Empty table: no rows. Clashing columns are replaced.
    One scan, no shuffle; work per document is n log n in its words.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept", "clean_text"]
    base = [c for c in docs.columns if c not in new and c != "text"]
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*base, text.alias("text"), words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    d = d.withColumn("judged", F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad"))))

    def letters(part: Column) -> Column:
        return F.length(F.translate(F.array_join(part, ""), SPACES, ""))

    d = d.select(
        *base,
        "judged",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        letters(F.transform(F.filter("judged", lambda x: x["bad"]), lambda x: x["line"])).alias("lost"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.lit(max_repeat) * F.col("n_words")))
    d = d.withColumn("lost_share", F.when(F.col("word_chars") > 0, F.col("lost") / F.col("word_chars")).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    if keep_text:
        d = d.withColumn("clean_text", F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"))
    return d.drop("judged", "lost")
