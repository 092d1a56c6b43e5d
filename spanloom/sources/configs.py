"""Patch configs: TOML files on the driver -> rows. Unknown fields are ignored."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERY = ["type", "section", "key", "ensure_absent", "ensure_present", "pattern", "search", "fuzzy_threshold", "fuzzy_expansion"]
OPERATION = ["type", "text", "value", "new_key", "insert_comment", "after_section", "before_section", "at_end", "at_beginning"]
PATCH = (
    "ord int, config string, name string, version_range string, workspace_relative boolean, id string, file string, version string, "
    "query struct<type:string,section:string,key:string,ensure_absent:boolean,ensure_present:boolean,pattern:string,search:string,fuzzy_threshold:double,fuzzy_expansion:int>, "
    "operation struct<type:string,text:string,value:string,new_key:string,insert_comment:string,after_section:string,before_section:string,at_end:boolean,at_beginning:boolean>, "
    "verify struct<method:string,expected_text:string,algorithm:string,expected:string>, "
    "constraint struct<ensure_absent:boolean,ensure_present:boolean,function_context:string>"
)


class ConfigError(ValueError):
    pass


def rows(text: str, config: str = "<text>", start: int = 0) -> list[tuple]:
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{config}: {e}") from e
    meta, patches = doc.get("meta", {}), doc.get("patches", [])
    if not patches:
        raise ConfigError(f"{config}: no patches")
    out = []
    for k, p in enumerate(patches):
        q, o, v, c = p.get("query", {}), p.get("operation", {}), p.get("verify"), p.get("constraint")
        thr = q.get("fuzzy_threshold")
        out.append(
            (
                start + k, config, meta.get("name"), meta.get("version_range"), bool(meta.get("workspace_relative", False)), p.get("id", ""), p.get("file", ""), p.get("version"),
                tuple(float(thr) if n == "fuzzy_threshold" and thr is not None else q.get(n) for n in QUERY), tuple(o.get(n) for n in OPERATION),
                tuple(v.get(n) for n in ("method", "expected_text", "algorithm", "expected")) if v else None,
                tuple(c.get(n) for n in ("ensure_absent", "ensure_present", "function_context")) if c else None,
            )
        )
    return out


def from_text(spark: SparkSession, text: str, config: str = "<text>") -> DataFrame:
    return spark.createDataFrame(rows(text, config), PATCH)


def discover(workspace: str, here: str = ".") -> list[Path]:
    """The configs of the first of <workspace>/patches and ./patches that has any, sorted."""
    for folder in (Path(workspace, "patches"), Path(here, "patches")):
        if found := sorted(folder.glob("*.toml")):
            return found
    raise ConfigError("no patch configs found")


def from_paths(spark: SparkSession, paths: list) -> DataFrame:
    out: list[tuple] = []
    for p in paths:
        out += rows(Path(p).read_text(), str(p), len(out))
    return spark.createDataFrame(out, PATCH)


def workspace_root(given: str | None, env: str | None, start: str, markers: tuple[str, ...] = ("otel", "core")) -> str | None:
    """A flag, then an environment value, then the first folder upwards that has a Cargo.toml and the marker folders."""
    if given or env:
        return given or env
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (folder / "Cargo.toml").exists() and all((folder / m).is_dir() for m in markers):
            return str(folder)
    return None


def workspace_version(root: str) -> str:
    """package.version, else workspace.package.version, else 0.0.0."""
    try:
        doc = tomllib.loads(Path(root, "Cargo.toml").read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return "0.0.0"
    for table in (doc.get("package", {}), doc.get("workspace", {}).get("package", {})):
        if isinstance(table.get("version"), str):
            return table["version"]
    return "0.0.0"
