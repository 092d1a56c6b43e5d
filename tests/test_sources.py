import subprocess

import pytest
from pyspark.sql import functions as F

from spanloom.operators import textops
from spanloom.plans import engine, timeline
from spanloom.sources import configs, git
from spanloom.sources import files as src


def test_files_and_listing(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn é() {}\n")
    (tmp_path / "b.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "x.jsonl").write_text("{}")
    got = {r.path.rsplit("/", 1)[-1]: (r.content, r.error) for r in src.text_files(spark, str(tmp_path), "*.rs").collect()}
    assert got == {"a.rs": ("fn é() {}\n", None), "b.rs": (None, "Io")}
    files = src.listing(spark, str(tmp_path))
    assert [r.length for r in files.collect()] == [2]
    assert textops.older_than(files, 30, F.current_timestamp()).count() == 0
    assert src.log_lines(spark, str(tmp_path / "a.rs")).count() == 2


def test_configs(spark, tmp_path):
    (tmp_path / "patches").mkdir()
    text = '[meta]\nname = "n"\nunknown = 1\n[[patches]]\nid = "a"\nfile = "f"\ndescription = "dropped"\nquery = { type = "text", search = "x" }\noperation = { type = "replace", text = "y" }\n'
    for name in ("b.toml", "a.toml"):
        (tmp_path / "patches" / name).write_text(text)
    found = configs.discover(str(tmp_path))
    assert [p.name for p in found] == ["a.toml", "b.toml"] and [r.ord for r in configs.from_paths(spark, found).collect()] == [0, 1]
    for bad in ("x = [", "[meta]\n"):
        with pytest.raises(configs.ConfigError):
            configs.rows(bad)
    with pytest.raises(configs.ConfigError):
        configs.discover(str(tmp_path / "none"), str(tmp_path / "none"))
    (tmp_path / "Cargo.toml").write_text('[workspace.package]\nversion = "1.2.3"\n')
    assert configs.workspace_version(str(tmp_path)) == "1.2.3" and configs.workspace_version(str(tmp_path / "patches")) == "0.0.0"
    assert configs.workspace_root("w", None, ".") == "w"


def test_configs_one_after_the_other(spark):
    a = '[[patches]]\nid = "{0}"\nfile = "f"\nquery = {{ type = "text", search = "{0}" }}\noperation = {{ type = "replace", text = "{1}" }}\n'
    files = spark.createDataFrame([("f", "one")], "path string, content string")
    results, out = engine.run_configs([configs.from_text(spark, a.format("one", "two")), configs.from_text(spark, a.format("two", "three"))], files, "1.0.0")
    assert out.first().content == "three" and {r.status for r in results.collect()} == {"Applied"}
    assert engine.exit_code(results) == 0 and engine.exit_code(results, "verify") == 1


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for k, body in enumerate(("a\n", "a\nb\n", "b\n")):
        (tmp_path / "f.txt").write_text(body)
        run("add", "-A")
        run("commit", "-qm", f"c{k}")
        run("tag", f"v{k}")
    h = git.history(spark, str(tmp_path), ["v0", "v1", "v2"])
    t = timeline.warehouse(h["tags"], h["ranges"], h["range_commits"], h["commits"], h["patches"])
    got = [(r.commits, r.line_additions, r.line_deletions) for r in timeline.range_summary(t).orderBy("seq").collect()]
    assert got == [(1, 1, 0), (1, 0, 1)]
    assert [r.subject for r in timeline.commit_patch_summary(t).orderBy("range_seq").collect()] == ["c1", "c2"]
