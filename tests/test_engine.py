import pytest
from pyspark.sql import functions as F

from spanloom.operators import edits as E
from spanloom.operators.locate import fuzzy_best, line_table
from spanloom.plans import engine
from spanloom.sources import configs

CONFIG = """
[meta]
name = "t"
version_range = ">=0.9.0"

[[patches]]
id = "one"
file = "a.rs"
query = { type = "text", search = "é = 1" }
operation = { type = "replace", text = "é = 2" }

[[patches]]
id = "later"
file = "a.rs"
version = ">=2.0.0"
query = { type = "text", search = "x" }
operation = { type = "replace", text = "y" }

[[patches]]
id = "gone"
file = "missing.rs"
query = { type = "text", search = "x" }
operation = { type = "replace", text = "y" }

[[patches]]
id = "twice"
file = "b.rs"
query = { type = "text", search = "ab" }
operation = { type = "replace", text = "cd" }

[[patches]]
id = "near"
file = "a.rs"
query = { type = "text", search = "fn  main() {  go(); }", fuzzy_threshold = 0.8 }
operation = { type = "replace", text = "fn main() { stop(); }" }
"""
STRUCT = """
[[patches]]
id = "del"
file = "s.rs"
query = { type = "ast-grep", pattern = "fn old() { $$$BODY }" }
operation = { type = "delete" }

[[patches]]
id = "tree"
file = "s.rs"
query = { type = "tree-sitter", pattern = "const MAX" }
operation = { type = "replace", text = "const MAX: u8 = 2;" }

[[patches]]
id = "odd"
file = "s.rs"
query = { type = "tree-sitter", pattern = "xyz q" }
operation = { type = "delete" }

[[patches]]
id = "opt"
file = "c.toml"
query = { type = "toml", section = "profile.release", key = "opt-level" }
operation = { type = "replace-value", value = "2" }

[[patches]]
id = "add"
file = "c.toml"
query = { type = "toml", section = "extra" }
operation = { type = "insert-section", text = "[extra]\\nk = 1", after_section = "package" }
constraint = { ensure_absent = true }
"""


def files(spark, **kw):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in kw.items()], "path string, content string")


def statuses(p):
    return {r.patch_id: (r.status, r.error_kind) for r in p["results"].collect()}


def test_text_patches(spark):
    f = files(spark, a_rs="let é = 1;\nfn main() { go(); }\n", b_rs="ab ab")
    p = engine.plan(configs.from_text(spark, CONFIG), f, "1.0.0")
    assert statuses(p) == {"one": ("Applied", None), "later": ("SkippedVersion", None), "gone": ("Failed", "NoMatch"), "twice": ("Failed", "AmbiguousMatch"), "near": ("Applied", None)}
    out = {r.path: r.content for r in p["files"].collect()}
    assert out == {"a.rs": "let é = 2;\nfn main() { stop(); }\n", "b.rs": "ab ab"}
    again = engine.plan(configs.from_text(spark, CONFIG), p["files"].select("path", "content"), "1.0.0")
    assert statuses(again)["one"] == ("AlreadyApplied", None) and statuses(again)["near"] == ("AlreadyApplied", None)
    old = engine.plan(configs.from_text(spark, CONFIG), f, "0.1.0")
    assert {s for s, _ in statuses(old).values()} == {"SkippedVersion"}


def test_structural_and_toml(spark):
    f = files(spark, s_rs="const MAX: u8 = 1;\nfn old() { a(); }\nfn new() {}\n", c_toml='[package]\nname = "a"\n\n[profile.release]\nopt-level = 3\n')
    p = engine.plan(configs.from_text(spark, STRUCT), f, "1.0.0")
    got = statuses(p)
    assert got["del"] == ("Applied", None) and got["tree"] == ("Applied", None) and got["odd"] == ("Failed", "Unsupported") and got["opt"] == ("Applied", None) and got["add"] == ("Applied", None)
    out = {r.path: r.content for r in p["files"].collect()}
    assert out["s.rs"] == "const MAX: u8 = 2;\n\nfn new() {}\n"
    assert out["c.toml"] == '[package]\nname = "a"\n\n[extra]\nk = 1\n\n[profile.release]\nopt-level = 2\n'


def edit_rows(spark, rows):
    return spark.createDataFrame([(*r, "exact", t, None) for *r, t in rows], "path string, ord int, byte_start bigint, byte_end bigint, new_text string, verify_kind string, verify_text string, verify_hash decimal(20,0)")


def test_fold_overlap_and_atomicity(spark):
    f = files(spark, a="äbcdef", b="abcdef", c="abc")
    e = edit_rows(spark, [("a", 0, 0, 2, "X", "ä"), ("a", 1, 3, 4, "YY", "c"), ("b", 2, 0, 3, "1", "abc"), ("b", 3, 2, 4, "2", "cd"), ("c", 4, 0, 1, "Z", "wrong"), ("c", 5, 1, 2, "B", "b")])
    done = E.run_edits(f, e)
    assert {r.ord: (r.status, r.error_kind) for r in done.collect()} == {0: ("Applied", None), 1: ("Applied", None), 2: ("Failed", "Overlap"), 3: ("Failed", "Overlap"), 4: ("Failed", "BeforeTextMismatch"), 5: ("Failed", "FileFailed")}
    f = f.unionByName(files(spark, d="untouched"))
    assert {r.path: (r.content, r.changed) for r in E.applied(f, e).collect()} == {"a": ("XbYYdef", True), "b": ("abcdef", False), "c": ("abc", False), "d": ("untouched", False)}


def test_equal_starts_keep_config_order(spark):
    f = files(spark, a="z")
    e = edit_rows(spark, [("a", 0, 0, 0, "1", ""), ("a", 1, 0, 0, "2", "")])
    assert E.applied(f, e).first().content == "21z"


def test_hash_verification(spark):
    long = "q" * 2000
    f = files(spark, a=long)
    e = spark.createDataFrame([("a", 0, 0, 2000, "r", "hash", None, None, long)], "path string, ord int, byte_start bigint, byte_end bigint, new_text string, verify_kind string, verify_text string, verify_hash decimal(20,0), expected string")
    assert E.run_edits(f, E.with_hashes(e).drop("expected")).first().status == "Applied"


def test_fuzzy_query_by_brute_force(spark, tmp_path):
    """The registered query over documents of any alphabet, long lines and null texts."""
    import random

    from spanloom.plans import queries  # noqa: F401  (registers)
    from spanloom.plans.registry import QUERIES

    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice("aeé日 ") for _ in range(rng.randint(1, 25))) for _ in range(5)) for _ in range(15)] + [None, "one line", "x\n\ny", "a\n" + "be" * 2500 + "\nc"]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    for name, more in (("fuzzy_fixed_best", 0), ("fuzzy_elastic_best", 2)):
        got = {r.path: (r.byte_start, r.window_lines, r.score) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        for k, t in enumerate(texts[:15]):
            lines = t.split("\n")
            needle, best = lines[1].replace("e", "E"), None
            for w in range(1, 2 + more):
                for i in range(len(lines) - w + 1):
                    text = "\n".join(lines[i : i + w])
                    score = 1 - edit_distance(needle, text) / max(len(needle), len(text))
                    if score >= 0.85 and (best is None or score > best[2] + 1e-9):
                        best = (len("\n".join([*lines[:i], ""]).encode()), w, round(score, 6))
            assert got.get(f"s/{k}.txt") == best, (name, k)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        prev, row[0] = row[0], x
        for y, cb in enumerate(b, 1):
            prev, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, prev + (ca != cb))
    return row[-1]


@pytest.mark.parametrize("expansion", [0, 2])
def test_fuzzy_against_brute_force(spark, expansion):
    import random

    rng = random.Random(4)
    cases = []
    for k in range(12):
        lines = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 12))) for _ in range(8)]
        i = rng.randint(0, 6)
        cases.append((k, lines[i] + "\n" + lines[i + 1][:-1] + "z", "\n".join(lines) + ("\n" if k % 2 else ""), 0.5, expansion))

    want = {}
    for k, needle, text, thr, exp in cases:
        lines, best = text.splitlines(), None
        for w in range(2, 3 + exp):
            for i in range(len(lines) - w + 1):
                got = "\n".join(lines[i : i + w])
                s = 1 - edit_distance(needle, got) / max(len(needle), len(got))
                if s >= thr and (best is None or s > best[0] + 1e-12):
                    best = (s, w, i)
        want[k] = best
    d = spark.createDataFrame(cases, "k int, search string, content string, threshold double, expansion int")
    got = {r.k: (r.score, r.window_lines, r.start_line) for r in fuzzy_best(d, ["k"]).collect()}
    assert got.keys() == {k for k, v in want.items() if v}
    for k, v in got.items():
        assert v[1:] == want[k][1:] and abs(v[0] - want[k][0]) < 1e-9


def test_lines_of_crlf(spark):
    rows = line_table(files(spark, a="é\r\nb\n")).orderBy("line_no").collect()
    assert [(r.line, r.byte_start, r.byte_end) for r in rows] == [("é", 0, 3), ("b", 4, 5), ("", 6, 6)]


def test_captures(spark):
    c = F.expr("map('A', '1', 'AB', '2', 'BODY', 'x, y')")
    assert spark.range(1).select(E.expand_captures(F.lit("f($AB, $A, $$$BODY)"), c)).first()[0] == "f(2, 1, x, y)"
