"""Checks before anything is written: the config linter, path guards, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Roots that nothing is ever written under (fixed values).
FORBIDDEN = ["~/.cargo/registry", "~/.cargo/git", "~/.rustup", "target"]
#: Which operations each query type takes (fixed values).
ALLOWED = {
    "text": ["replace"],
    "ast-grep": ["replace", "delete"],
    "tree-sitter": ["replace", "delete"],
    "toml": ["insert-section", "append-section", "replace-value", "delete-section", "replace-key"],
}


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def issues(patches: DataFrame) -> DataFrame:
    """(ord, patch_id, kind, message): every issue of every patch at once.

    patches has id, file, query and operation structs as in sources.configs.PATCH.
    """
    q, op = F.col("query"), F.col("operation")
    qt, ot = q["type"], op["type"]
    toml = qt == "toml"
    has_section, has_key = q["section"].isNotNull(), q["key"].isNotNull()
    takes = F.lit(False)
    for k, ops in ALLOWED.items():
        takes = takes | ((qt == k) & ot.isin(*ops))
    anchors = sum((c.cast("int") for c in (op["after_section"].isNotNull(), op["before_section"].isNotNull(), F.coalesce(op["at_end"], F.lit(False)), F.coalesce(op["at_beginning"], F.lit(False)))), F.lit(0))
    thr, exp = q["fuzzy_threshold"], q["fuzzy_expansion"]
    rules = [
        (_blank(F.col("id")), "blank-id", "id is blank"),
        (_blank(F.col("file")), "blank-file", "file is blank"),
        (toml & ~has_section & ~has_key, "no-target", "toml query needs section or key"),
        (toml & has_key & ~has_section, "key-without-section", "key requires section"),
        (toml & F.coalesce(q["ensure_absent"], F.lit(False)) & F.coalesce(q["ensure_present"], F.lit(False)), "exclusive", "ensure_absent and ensure_present exclude each other"),
        (qt.isin("ast-grep", "tree-sitter") & _blank(q["pattern"]), "blank-pattern", "pattern is blank"),
        ((qt == "text") & _blank(q["search"]), "blank-search", "search is blank"),
        ((qt == "text") & thr.isNotNull() & (F.isnan(thr) | (thr < 0) | (thr > 1)), "threshold", "fuzzy_threshold must be between 0 and 1"),
        ((qt == "text") & exp.isNotNull() & (exp > 200), "expansion", "fuzzy_expansion must be at most 200"),
        (ot.isin("replace", "insert-section", "append-section") & _blank(op["text"]), "blank-text", "text is blank"),
        ((ot == "replace-value") & _blank(op["value"]), "blank-value", "value is blank"),
        ((ot == "replace-key") & _blank(op["new_key"]), "blank-new-key", "new_key is blank"),
        ((ot == "insert-section") & (anchors > 1), "positioning", "at most one position"),
        (toml & ot.isin("replace-value", "replace-key") & ~has_key, "needs-key", "operation needs a key query"),
        (toml & (ot == "delete-section") & (~has_section | has_key), "needs-section", "delete-section needs a section query"),
        (~F.coalesce(takes, F.lit(False)), "combination", "operation doesn't fit the query"),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(m).alias("message"))) for c, k, m in rules])
    return patches.select("ord", F.col("id").alias("patch_id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("ord", "patch_id", "i.kind", "i.message")


def parts(path: Column) -> Column:
    """A path's names, with . and .. resolved (symbolic links are the driver's to resolve)."""
    return F.aggregate(
        F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )


def inside(path: Column, root: str) -> Column:
    """Whether a path lies under a root, name by name."""
    want = parts(F.lit(root))
    return F.slice(parts(path), F.lit(1), F.size(want)) == want


def guard(path: Column, root: str, forbidden: list[str] | None = None) -> Column:
    """'ok', 'outside' or 'forbidden'; asked again before a sink writes."""
    bad = F.lit(False)
    for f in forbidden or []:
        bad = bad | inside(path, f)
    return F.when(~inside(path, root), "outside").when(bad, "forbidden").otherwise("ok")


def resolve(file: Column, root: str, workspace_relative: Column) -> Column:
    return F.when(workspace_relative, F.concat_ws("/", F.lit(root.rstrip("/")), file)).otherwise(file)
