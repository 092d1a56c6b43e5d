"""Rows of a git history for the timeline: the process boundary is here, on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

FIELDS = ["%H", "%P", "%an", "%ae", "%aI", "%s", "%b"]


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def history(spark: SparkSession, repo: str, tags: list[str]) -> dict[str, DataFrame]:
    """tags, ranges, range_commits, commits and patches (commit_sha, patch_text) for consecutive tags."""
    tag_rows = [(t, _git(repo, "rev-list", "-n", "1", t).strip(), _git(repo, "show", "-s", "--format=%cI", f"{t}^{{commit}}").strip()) for t in tags]
    ranges = [(k, k, a, b, f"{a}..{b}") for k, (a, b) in enumerate(zip(tags, tags[1:], strict=False), 1)]
    members, commits, patches = [], {}, {}
    for number, _, _, _, expr in ranges:
        for n, sha in enumerate(_git(repo, "rev-list", "--reverse", expr).split(), 1):
            members.append((number, sha, n))
            if sha not in commits:
                commits[sha] = tuple(x.strip() for x in _git(repo, "show", "-s", f"--format={'%x1f'.join(FIELDS)}", sha).split("\x1f", 6))
                patches[sha] = (sha, _git(repo, "show", "--format=", "--patch", "--find-renames", "--find-copies", "--full-index", "--unified=3", sha))
    make = spark.createDataFrame
    return {
        "tags": make(tag_rows, "tag_name string, commit_sha string, commit_date string"),
        "ranges": make(ranges, "range_id bigint, seq bigint, from_tag string, to_tag string, range_expr string"),
        "range_commits": make(members, "range_id bigint, commit_sha string, ordinal bigint"),
        "commits": make(list(commits.values()), "commit_sha string, parent_shas string, author_name string, author_email string, author_date string, subject string, body string"),
        "patches": make(list(patches.values()), "commit_sha string, patch_text string"),
    }
