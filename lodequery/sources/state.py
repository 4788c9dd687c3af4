"""Saved state, data paths, a stopwatch, and tables as HTML."""

from __future__ import annotations

import os
import time
from itertools import product
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

KINDS = {"dataset": "DATASETS_DIR", "model": "MODELS_DIR"}


def save(df: DataFrame, path: str, if_exists: str = "overwrite") -> None:
    """Write a state table; if_exists: overwrite, raise (FileExistsError), anything else keeps what is there."""
    mode = {"overwrite": "overwrite", "raise": "errorifexists"}.get(if_exists, "ignore")
    try:
        df.write.mode(mode).parquet(path)
    except AnalysisException as e:
        if mode == "errorifexists" and "EXISTS" in str(e).upper():
            raise FileExistsError(path) from e
        raise


def load(spark: SparkSession, path: str, if_missing: str = "raise") -> DataFrame | None:
    """Read a state table; a missing one is FileNotFoundError, or None unless if_missing is raise."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if if_missing == "raise":
            raise FileNotFoundError(path) from e
        return None


def directories(kind: str, path: str | None = None, package_dir: str | None = None) -> list[str]:
    """Where data of a kind may lie, in order, each once: path, the environment's list, the package's, the home's, the current folder."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {tuple(KINDS)}")
    found = [path] if path else []
    found += [p for p in os.environ.get(KINDS[kind], "").split(":") if p]
    if package_dir:
        found.append(os.path.join(package_dir, f"{kind}s"))
    found += [os.path.join(os.path.expanduser("~"), ".lodequery", f"{kind}s"), os.getcwd()]
    return list(dict.fromkeys(found))


def expand(dirs: list[str], subpaths: list[str]) -> list[str]:
    """Every directory with every subpath."""
    return [os.path.join(d, s) for d, s in product(dirs, subpaths)]


def existing(name: str, kind: str, path: str | None = None, subdirs: list[str] | None = None) -> list[str]:
    """All files of this name in the directories and their subdirs; FileNotFoundError if there is none."""
    paths = [os.path.join(d, name) for d in expand(directories(kind, path), ["", *(subdirs or [])])]
    if not (found := [p for p in paths if Path(p).exists()]):
        raise FileNotFoundError(f"{name} isn't in any of {paths}")
    return found


class Stopwatch:
    """Adds up the time between start() and stop()."""

    def __init__(self):
        self.reset()

    def reset(self) -> Stopwatch:
        self.total, self.began = 0.0, None
        return self

    def start(self) -> Stopwatch:
        if self.began is not None:
            raise ValueError("it runs already")
        self.began = time.perf_counter()
        return self

    def stop(self) -> Stopwatch:
        if self.began is None:
            raise ValueError("it doesn't run")
        self.total += time.perf_counter() - self.began
        self.began = None
        return self

    def time(self) -> float:
        return self.total + (time.perf_counter() - self.began if self.began is not None else 0.0)


def html_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as an HTML table."""
    return df.limit(rows).toPandas().to_html(index=False)
