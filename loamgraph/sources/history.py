"""Commits, changed paths, trees and branches of a git repository, as tables."""

import io
import subprocess
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _git(repo: str, *args: str, raw: bool = False):
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout
    return out if raw else out.decode("utf-8", "replace")


def check_branches(repo: str, branches: list[str]) -> list[str]:
    """The branches once each, sorted. RuntimeError for a shallow clone, ValueError for an unknown or option-like name."""
    if _git(repo, "rev-parse", "--is-shallow-repository").strip() == "true":
        raise RuntimeError("the clone is shallow; its history is incomplete")
    for b in branches:
        if not b or b.startswith("-"):
            raise ValueError(f"no branch can have the name {b!r}")
        if subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "--quiet", f"refs/heads/{b}^{{commit}}"], capture_output=True).returncode:
            raise ValueError(f"no such branch: {b}")
    return sorted(set(branches))


def has_commits(repo: str) -> bool:
    return bool(_git(repo, "rev-list", "--all", "-n", "1").strip())


def head(repo: str, branch: str) -> str:
    return _git(repo, "rev-parse", f"refs/heads/{branch}").strip()


def commits(spark: SparkSession, repo: str, *revisions: str) -> DataFrame:
    """commit_ord, source_commit, author, committed_at of all commits that a revision (HEAD, if none is named) reaches, each once; oldest first."""
    text = _git(repo, "log", "--reverse", "--topo-order", "--format=%H%x00%an <%ae>%x00%cI", *(revisions or ("HEAD",))) if has_commits(repo) else ""
    rows = [(i, *line.split("\x00")) for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "commit_ord long, source_commit string, author string, committed_at string")


def membership(spark: SparkSession, repo: str, branches: list[str]) -> DataFrame:
    """source_commit, branch: every commit that a branch reaches."""
    rows = [(sha, b) for b in check_branches(repo, branches) for sha in _git(repo, "rev-list", f"refs/heads/{b}").split()]
    return spark.createDataFrame(rows, "source_commit string, branch string")


def changed_paths(shas: DataFrame, repo: str) -> DataFrame:
    """source_commit, status, path. A first commit shows its whole tree, a merge nothing; a rename is a delete and an add.

    Runs on the executors, one call per commit; the repository must be readable there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sha in b["source_commit"]:
                parents = _git(repo, "rev-list", "--parents", "-n", "1", sha).split()[1:]
                if len(parents) > 1:
                    continue
                fields = _git(repo, "diff-tree", "--root", "-r", "-z", "--no-renames", "--no-commit-id", "--name-status", sha).split("\0")[:-1]
                if len(fields) % 2:
                    raise ValueError(f"odd number of fields in the changes of {sha}")
                out += [(sha, s, p) for s, p in zip(fields[::2], fields[1::2])]
            yield pd.DataFrame(out, columns=["source_commit", "status", "path"])

    return shas.select("source_commit").mapInPandas(run, "source_commit string, status string, path string")


#: Folders of other people's code and of build results, never read.
VENDORED = ("node_modules", "dist", "build", "vendor", "target", ".git", "__pycache__", ".venv", "venv", "site-packages", "out", ".next", ".svelte-kit", "coverage")


def trees(shas: DataFrame, repo: str, extensions: tuple[str, ...] = (".java", ".kt", ".py", ".go", ".rs", ".ts", ".js", ".tsx", ".jsx", ".svelte")) -> DataFrame:
    """source_commit, path, content: the source texts of each commit's tree, read from an archive, never checked out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha in b["source_commit"]:
                out = []
                with tarfile.open(fileobj=io.BytesIO(_git(repo, "archive", sha, raw=True))) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(extensions) and not set(m.name.split("/")[:-1]) & set(VENDORED):
                            out.append((sha, m.name, tar.extractfile(m).read().decode("utf-8", "replace")))
                yield pd.DataFrame(out, columns=["source_commit", "path", "content"])

    return shas.select("source_commit").mapInPandas(run, "source_commit string, path string, content string")


def modifies(changes: DataFrame, log: DataFrame, repo_name: str) -> DataFrame:
    """MODIFIES edges: commit to file id, without author."""
    c = changes.where(F.col("status") != "D").join(log.select("source_commit", "committed_at"), "source_commit")
    return c.select(F.lit("MODIFIES").alias("kind"), F.col("source_commit").alias("src"), F.concat(F.lit(repo_name + "/"), F.col("path")).alias("dst"), F.lit("deterministic").alias("edge_kind"), "source_commit", "committed_at").distinct()


def payloads(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Objects of JSON array files (one file or a folder), with `seq` as their order in the sorted files. Unreadable files fail."""
    df = spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("seq", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")))
