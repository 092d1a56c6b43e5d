import json

import pytest

from spanloom.operators import autofix, guards, structure, textops, toml_spans
from spanloom.plans import timeline
from spanloom.sources import configs
from spanloom.sources import files as src
from spanloom.streaming import flows

RUST = """use std::fmt;\n\n/// fn hidden() {}\npub struct Point { x: i32, y: i32 }\n\nimpl Point {\n    pub fn len(&self) -> f64 { let s = "fn no() {"; 0.0 }\n}\n\nimpl fmt::Display for Point {\n    fn fmt(&self) -> u8 { match self.x { 0 => 1, _ => 2 } }\n}\n\nconst MAX_SIZE: usize = 10;\nstatic NAME: &str = "a";\n\nfn main() { println!("{}", 1); foo(a, b); foo(c, c); }\n"""
DIFF = """noise
diff --git a/x.rs b/x.rs
--- a/x.rs
+++ b/x.rs
@@ -1,3 +1,3 @@
 a
-b
+c
+d
@@ -10 +11 @@ fn
-e
\\ No newline at end of file
diff --git a/old.rs b/new.rs
similarity index 90%
rename from old.rs
rename to new.rs
diff --git a/p.png b/p.png
new file mode 100644
Binary files /dev/null and b/p.png differ"""


def test_diff(spark):
    lines = timeline.diff_lines(spark.createDataFrame([("s", DIFF)], "commit_sha string, patch_text string"))
    f = {r.file_index: r for r in timeline.patch_files(lines).collect()}
    assert [(f[k].old_path, f[k].new_path, f[k].change_type, f[k].is_binary, f[k].additions, f[k].deletions) for k in (1, 2, 3)] == [("x.rs", "x.rs", "modify", 0, 2, 2), ("old.rs", "new.rs", "rename", 0, 0, 0), ("p.png", "p.png", "add", 1, 0, 0)]
    assert f[2].similarity == 90
    h = timeline.hunks(lines).orderBy("hunk_index").collect()
    assert [(r.old_start, r.old_lines, r.new_start, r.new_lines) for r in h] == [(1, 3, 1, 3), (10, 1, 11, 1)]
    b = timeline.blocks(lines).orderBy("hunk_index", "block_index").collect()
    assert [(r.op, r.start_old, r.start_new, r.line_count, r.content) for r in b] == [("del", 2, 2, 1, "b"), ("add", 3, 2, 2, "c\nd"), ("del", 10, 11, 1, "e")]


def test_warehouse_from_rows(spark, tmp_path):
    make = spark.createDataFrame
    t = timeline.warehouse(
        make([("v1", "r", "d")], "tag_name string, commit_sha string, commit_date string"), make([(1, 1, "v1", "v2", "v1..v2"), (2, 2, "v2", "v3", "v2..v3")], "range_id bigint, seq bigint, from_tag string, to_tag string, range_expr string"),
        make([(1, "s", 1)], "range_id bigint, commit_sha string, ordinal bigint"), make([("s", "", "n", "e", "2024", "subj", "")], "commit_sha string, parent_shas string, author_name string, author_email string, author_date string, subject string, body string"),
        make([("s", DIFF)], "commit_sha string, patch_text string"),
    )
    timeline.save(t, str(tmp_path))
    t = timeline.load(spark, str(tmp_path))
    r = timeline.range_summary(t).orderBy("seq").collect()
    assert [(x.commits, x.files_changed, x.hunks, x.line_additions) for x in r] == [(1, 3, 2, 2), (0, 0, 0, 0)]
    assert [e.event_id for e in timeline.every_event(t).collect()] == sorted(e.event_id for e in timeline.block_timeline(t).collect())
    assert timeline.key_violations(t).where("duplicates > 0").count() == 0
    assert "v1 to v2" in timeline.summary_markdown(t)
    timeline.register(t)
    assert spark.sql(timeline.QUERY_PACK["track_file"], args={"path": "x.rs"}).count() == 3


def test_rust_nodes(spark):
    n = structure.node_table(spark.createDataFrame([("a.rs", RUST)], "path string, content string"))
    names = sorted((r.kind, r.name) for r in n.collect())
    assert ("function_item", "hidden") not in names and ("function_item", "no") not in names
    find = lambda q: [r.name for r in structure.locate(n, q).collect()]
    assert find("fn main") == ["main"] and find("struct Point") == ["Point"] and find("fn Point::len") == ["len"] and find("const /MAX_.*/") == ["MAX_SIZE"] and find("static NAME") == ["NAME"]
    assert sorted(find("impl Point")) == ["Point", "Point"] and find("impl fmt::Display for Point") == ["Point"] and find("use std") == ["std::fmt"]
    assert find('((const_item name: (identifier) @n) @c (#match? @n "^MAX"))') == ["MAX_SIZE"]
    assert sum(r.kind == "match_arm" for r in n.collect()) == 2
    with pytest.raises(structure.Unsupported):
        structure.target("xyz a")


def test_patterns():
    hit = structure.find_pattern("fn f() { g(1, 2); } foo(a, a); foo(a, b)", "foo($X, $X)")
    assert [(a, b) for a, b, _ in hit] == [(20, 29)]
    assert structure.find_pattern("fn f(x: u8) { g(1, (2)); }", "fn f($$$P) { $$$B }")[0][2] == {"P": "x: u8", "B": "g(1, (2));"}
    assert structure.snippet_errors("fn f() { (") and not structure.snippet_errors('let a = "(";')


def test_toml():
    text = '[a]\nk = "v" # c\n\n[b.c]\nx = 1\n'
    p = lambda q, o, c=None: toml_spans.plan(text, q, o, c)
    assert p({"section": "a", "key": "k"}, {"type": "replace-value", "value": '"w"'}) == (8, 11, '"w"', None)
    assert p({"section": "a", "key": "z"}, {"type": "replace-value", "value": "1"})[3] == "key not found"
    with pytest.raises(toml_spans.TomlError):
        p({"section": "a", "key": "z"}, {"type": "replace-value", "value": "1"}, {"ensure_present": True})
    assert p({"section": "b.c"}, {"type": "delete-section"})[:3] == (17, 29, "")
    assert p({"section": "a"}, {"type": "append-section", "text": "[a]\n"})[3] == "section exists"
    assert toml_spans.parse_path("a.'b.c'.\"d\"") == ["a", "b.c", "d"]
    assert toml_spans.get_value(text, "b.c", "x") == "1" and toml_spans.get_value(text, None, "x") is None


def test_issues_and_guards(spark):
    text = '[[patches]]\nid = " "\nfile = "f"\nquery = { type = "text", search = "" , fuzzy_threshold = 2.0, fuzzy_expansion = 201 }\noperation = { type = "delete" }\n'
    got = {r.kind for r in guards.issues(configs.from_text(spark, text)).collect()}
    assert got == {"blank-id", "blank-search", "threshold", "expansion", "combination"}
    from pyspark.sql import functions as F

    r = spark.range(1).select(*[guards.guard(F.lit(p), "/w", ["/w/target"]).alias(str(k)) for k, p in enumerate(["/w/a", "/w/../a", "/w/target/x", "/wx/a"])]).first()
    assert tuple(r) == ("ok", "outside", "forbidden", "outside")


def test_autofix(spark):
    span = {"file_name": "a.rs", "byte_start": 0, "byte_end": 3, "is_primary": True, "suggested_replacement": "bar", "suggestion_applicability": "MachineApplicable"}
    line = lambda code, spans: json.dumps({"reason": "compiler-message", "message": {"message": "m", "level": "error", "code": {"code": code}, "spans": spans, "children": []}})
    other = dict(span, suggestion_applicability="MaybeIncorrect", suggested_replacement="std::x")
    rows = [(line("E1", [span, span]),), (line("E0433", [other]),), (line("E9", [dict(span, suggested_replacement=None)]),), ("noise",), (line("E0433", [dict(other, suggestion_applicability="HasPlaceholders")]),), (line("E2", [span]),), (line("E1", [dict(span, file_name="target/b.rs")]),)]
    d = src.parse_diagnostics(spark.createDataFrame(rows, "line string"))
    out = autofix.fixes(d, spark.createDataFrame([("a.rs", "foo()")], "path string, content string"))
    assert sorted((r.rule, r.new_text, r.expected) for r in out["edits"].collect()) == [("E0433", "std::x", "foo"), ("machine", "bar", "foo")]
    assert out["unfixed"].count() == 3


def test_stream_equals_batch(spark, tmp_path):
    events = [{"headers": {"X-Session-Id": f"s{k % 3}"} if k % 2 else {}, "request_headers": {"x-session-id": f"s{k % 3}"}, "connection_id": "c" * 20, "direction": "request" if k % 2 else "response", "host": "api.openai.com", "method": "POST", "url": "https://api.openai.com/v1?a=1", "status": 200, "body": "x" * k, "ts": float(k)} for k in range(10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps(e) for e in events] + ["{bad"]))
    stream = flows.messages(src.flow_stream(spark, str(tmp_path / "in")))
    q = flows.start(stream, str(tmp_path / "cp"), name="sessions_seen", once=True)
    q.awaitTermination(120)
    batch = flows.session_totals(flows.messages(spark.createDataFrame([json.dumps(e) for e in events], "string").selectExpr(f"from_json(value, '{src.FLOW_EVENT}') AS e").select("e.*")))
    assert sorted(map(tuple, spark.table("sessions_seen").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 3


def test_bodies(spark):
    from pyspark.sql import functions as F

    sse = 'event: x\ndata: {"usage":{"total_tokens":7}}\r\ndata: no "json"\ndata: {"usage":{"total_tokens":9}}\ndata: [DONE]\n'
    long = '{"usage":{"total_tokens":5},"x":"' + "é" * 40_000 + '"}'
    rows = [(1, "", ""), (2, sse, "text/event-stream"), (3, '{"usage":{"total_tokens":5}}', "application/json"), (4, "hello world!", None), (5, long, "application/json"), (6, sse, "")]
    d = spark.createDataFrame(rows, "k int, b string, t string")
    r = d.select("k", flows.tokens(F.col("b"), F.col("t")).alias("n"), flows.parsed_body(F.col("b"), F.col("t")).alias("p")).orderBy("k").collect()
    assert [(x.n, x.p.kind) for x in r] == [(0, "empty"), (9, "sse"), (5, "json"), (3, "text"), (len(long.encode()) // 4, "text"), (len(sse) // 4, "text")]
    assert json.loads(r[1].p.text) == [{"usage": {"total_tokens": 7}}, 'no "json"', {"usage": {"total_tokens": 9}}]
    assert r[4].p.text == long.encode()[:65_536].decode(errors="replace")
    many = "".join(f"data: {k}\n" for k in range(150))
    assert spark.createDataFrame([(many,)], "b string").select(F.size(flows.sse_chunks(F.col("b")))).first()[0] == 100


def test_insert_points():
    """By the rule: the braces from 50 bytes before on, strings aside, and the first field's indent."""
    at = lambda t, s=None, e=None: autofix._insert(t.encode(), t.index("P {") if s is None else s, t.index("}") + 1 if e is None else e)
    assert at("let p = P { x: 1 };") == (17, " ", "", False, True)
    assert at('  let p = P {\n      a: "}",\n  };', e=16) == (30, "      ", "  ", False, False)
    assert at("let p = P {};") == (11, "    ", "", True, False)
    assert at("} P { x: 1 }") is None and at("let p = P { x: 1", e=10) is None


def test_replacement_and_validation(spark):
    f = spark.createDataFrame([("a.rs", "fn main() { foo(é, foo(b, c)); }"), ("b.rs", "fn x() {}")], "path string, content string")
    out = {r.path: (r.content, r.changed) for r in structure.find_and_replace(f, "foo($A, $B)", "bar($B)").collect()}
    assert out == {"a.rs": ("fn main() { bar(foo(b, c)); }", True), "b.rs": ("fn x() {}", False)}
    one = structure.replace_capture(structure.matches(f, pattern="foo($A, $B)"), "A", "z")
    from spanloom.operators import edits

    assert edits.applied(f, one).where("changed").first().content == "fn main() { foo(z, foo(b, c)); }"
    assert {r.path: r.has_match for r in structure.has_match(f, "foo($A, $B)").collect()} == {"a.rs": True, "b.rs": False}
    assert [r.function for r in structure.find_in_function(f, "foo($A, $B)", "main").collect()] == ["main", "main"] and structure.find_in_function(f, "foo($A, $B)", "x").count() == 0
    bad = structure.replace_matches(structure.matches(f, pattern="foo($A, $B)"), "bar(($A)")
    checked = {r.path: (r.changed, r.rejected) for r in structure.validated(f, bad).collect()}
    assert checked == {"a.rs": (False, True), "b.rs": (False, False)}
    nodes = structure.node_table(f)
    assert structure.with_field(nodes, "function_item", "body").count() == 2 and structure.with_field(nodes, "function_item", "trait").count() == 0
    with pytest.raises(structure.Unsupported):
        structure.with_field(nodes, "function_item", "colour")


def test_guarded_write(spark, tmp_path):
    from spanloom.plans import engine

    f = spark.createDataFrame([("/w/a.rs", "x", True), ("/w/target/b.rs", "y", False)], "path string, content string, changed boolean")
    engine.write_files(f, str(tmp_path / "out"), "/w")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    for path in ("/w/target/b.rs", "/v/a.rs", "/w/../etc/x"):
        bad = spark.createDataFrame([(path, "x", True)], f.schema)
        with pytest.raises(PermissionError):
            engine.write_files(bad, str(tmp_path / "no"), "/w")
    assert not (tmp_path / "no").exists()


def test_log_and_lint(spark):
    log = ["     Running unittests src/lib.rs (t/a)", "test a::b ... FAILED", "test result: FAILED. 3 passed; 1 failed; 0 ignored", "x", "     Running tests/flow/mod.rs (t/b)", "test result: ok. 2 passed; 0 failed;"]
    s = textops.log_summary(spark.createDataFrame(list(enumerate(log)), "line_no int, line string"))
    assert sorted((r.binary, r.passed, r.failed, r.failed_tests) for r in s.collect()) == [("flow", 2, 0, []), ("src/lib", 3, 1, ["a::b"])]
    assert tuple(textops.log_totals(s).first()) == (5, 1)
    hits = textops.lint(spark.createDataFrame([("a.py", 0, "from x import *"), ("a.rs", 1, "x.unwrap() "), ("a.txt", 1, "eval x"), ("a.sh", 2, "eval x")], "path string, line_no int, line string"))
    assert sorted((r.path, r.rule) for r in hits.collect()) == [("a.py", "wildcard import"), ("a.rs", "bare unwrap()"), ("a.sh", "eval usage")]


def test_lifecycle_of_blocks_without_events(spark):
    t = {"code_blocks": spark.createDataFrame([("h1", "x", 1, 1), ("h2", "y", 1, 1)], "block_hash string, content string, line_count bigint, byte_count bigint"), "block_events": spark.createDataFrame([(5, 1, "c1", "add", 3, "h1")], "event_id bigint, range_id bigint, commit_sha string, op string, line_count bigint, block_hash string")}
    t |= {"range_commits": spark.createDataFrame([(1, "c1", 1)], "range_id bigint, commit_sha string, ordinal bigint"), "ranges": spark.createDataFrame([(1,)], "range_id bigint")}
    got = {r.block_hash: (r.add_events, r.del_events, r.first_commit) for r in timeline.block_lifecycle(t).collect()}
    assert got == {"h1": (1, 0, "c1"), "h2": (0, 0, None)}


def test_align_newline(spark):
    from pyspark.sql import functions as F

    from spanloom.functions.text import align_newline

    d = spark.createDataFrame([("a\n\n", "x"), ("a\n", "x\n"), ("a", "x\n")], "t string, c string")
    assert [r[0] for r in d.select(align_newline(F.col("t"), F.col("c"))).collect()] == ["a\n", "a\n", "a\n"]


def test_block_timeline_in_one_shuffle_of_events(spark, tmp_path):
    """Repeated orders, null keys, tied items and blocks that are missing or repeated, against the SQL; the line items are read and shuffled once."""
    from datetime import datetime

    import duckdb

    from spanloom.plans import queries  # noqa: F401
    from spanloom.plans.registry import ORACLES, QUERIES

    day = [datetime(1997, 12, 31), datetime(1998, 1, 1, 5), datetime(1998, 1, 1, 4), None, datetime(2001, 2, 3)]
    orders = [(k, 1, day[k % 5], f"p{k % 3}") for k in range(20)] + [(1, 1, day[2], "again"), (1, 1, day[0], "other year"), (None, 1, day[1], "no key")]
    items = [(k % 24 if k % 31 else None, (k * 7) % 10 if k % 29 else None, (k * 3) % 5 if k % 37 else None, k % 4, float(k % 6), 1.5 * (k % 2), 0.1, 0.2, "RAN"[k % 3], "OF"[k % 2], day[4]) for k in range(300)]
    items += [(5, 2, 3, 1, float(k), 9.0, 0.1, 0.2, "N", "O", day[4]) for k in range(4)]
    parts = [(k, f"name {k}", "b", "t", 1, 1.0) for k in [0, 1, 2, 3, 5, 6, 7, 7]]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = QUERIES["block_timeline"](spark, str(tmp_path))
    got = sorted(tuple(map(str, r)) for r in df.collect())
    assert got and got == sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['block_timeline']})").fetchall())
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1
