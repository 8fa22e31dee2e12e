"""Version control as a change feed (driver side, one process per call)."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    except OSError:
        return None
    except subprocess.TimeoutExpired as e:
        # no answer is not the answer that there is no repository
        raise RuntimeError(f"git gave no answer within {e.timeout:.0f} s") from e
    return done.stdout if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def head_commit(root: str) -> str | None:
    return (_git(root, "rev-parse", "HEAD") or "").strip() or None


def excludes_file(root: str) -> Path | None:
    """The user's ignore file: as configured, else where it lies by default; null outside a repository."""
    if not is_repository(root):
        return None
    set_ = (_git(root, "config", "--path", "--get", "core.excludesFile") or "").strip()
    return Path(set_) if set_ else Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config", "git", "ignore")


def prefix(root: str) -> str:
    """Where ``root`` lies in its work tree, ending with ``/`` or empty."""
    return (_git(root, "rev-parse", "--show-prefix") or "").strip()


def status_rows(lines: DataFrame, below: str = "") -> DataFrame:
    """``status, path`` of ``--name-status`` lines (column ``value``), relative to ``below``.

    A rename is a delete of the old and a change of the new path, a copy a
    change of the new path; paths outside ``below`` drop out, and so do lines
    without a path and null ones.
    """
    part = F.split("value", "\t")
    status, first, second = F.substring(part[0], 1, 1), F.get(part, F.lit(1)), F.get(part, F.lit(2))
    row = lambda s, p: F.struct(s.alias("status"), p.alias("path"))
    two = second.isNotNull()
    rows = (
        F.when((status == "R") & two, F.array(row(F.lit("D"), first), row(F.lit("M"), second)))
        .when((status == "C") & two, F.array(row(F.lit("M"), second)))
        .otherwise(F.array(row(status, first)))
    )
    found = lines.select(F.inline(rows)).where(F.col("path").startswith(below))
    return found.select("status", F.substring("path", len(below) + 1, 1 << 20).alias("path"))


def changes(spark: SparkSession, root: str, since: str) -> DataFrame:
    """``status, path`` since a commit; untracked files are not listed."""
    out = _git(root, "diff", "--no-relative", "--name-status", since)
    if out is None:
        raise RuntimeError(f"no changes since {since} can be read")
    return status_rows(spark.createDataFrame([(x,) for x in out.splitlines()], "value string"), prefix(root))
