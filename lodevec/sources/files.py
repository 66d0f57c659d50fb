"""File trees: walking with ignore rules, bounded reads, and the incremental index over them."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.operators import chunking

MAX_BYTES = 25 << 20
EXTENSIONS = frozenset((*chunking.CODE, *chunking.PROSE, *"txt toml yaml yml json cfg ini".split()))
SKIPPED = frozenset("build coverage dist out node_modules __pycache__ .git .next .turbo .venv".split())
MANIFEST = "path string, mtime_ms bigint, size bigint, chunk_size int, chunk_mode string, ids array<bigint>"


@lru_cache(4096)
def _glob(pattern: str) -> re.Pattern:
    """A gitignore pattern's body as a regular expression over a relative path."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return re.compile(out)


class Ignore:
    """One .gitignore's rules; a later rule overrides an earlier one."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            only_dir, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.removeprefix("/")
            self.rules.append((negated, only_dir, _glob(line if anchored else "**/" + line)))

    def ignores(self, path: str, is_dir: bool) -> bool:
        """Whether a relative path, or a directory above it, is ignored."""
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            verdict, own_dir = False, is_dir or n < len(parts)
            for negated, only_dir, rx in self.rules:
                if (own_dir or not only_dir) and rx.fullmatch("/".join(parts[:n])):
                    verdict = not negated
            if verdict:
                return True
        return False


def _rules_at(*paths: str) -> str:
    out = []
    for p in paths:
        try:
            with open(p, encoding="utf-8") as f:
                out.append(f.read())
        except OSError:
            pass
    return "\n".join(out)


def git_root(path: str) -> str | None:
    at = os.path.realpath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        at, last = os.path.dirname(at), at
        if at == last:
            return None
    return at


def confined(path: str, roots: list[str]) -> str:
    """The real path, which must lie in one of the roots."""
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise ValueError(f"{path} is outside the allowed directories")
    return real


def walk(root: str, respect_gitignore: bool = True, extensions=EXTENSIONS) -> list[tuple[str, int, int]]:
    """(path, mtime in ms, size) of the files to index, sorted. Listing is the driver's work, reading isn't.

    Hidden and well-known build directories are skipped, links that leave the root aren't followed,
    and the repository's, nested and global ignore files apply.
    """
    root = os.path.realpath(root)
    frames = []
    if respect_gitignore and (top := git_root(root)):
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
        frames.append((top, Ignore(_rules_at(os.path.join(home, "git", "ignore"), os.path.join(top, ".gitignore"), os.path.join(top, ".git", "info", "exclude")))))
    out = []

    def enter(at: str, frames: list) -> None:
        if respect_gitignore and (own := _rules_at(os.path.join(at, ".gitignore"))):
            frames = [*frames, (at, Ignore(own))]
        for e in sorted(os.scandir(at), key=lambda e: e.name):
            is_dir = e.is_dir()
            if is_dir and (e.name in SKIPPED or e.name.startswith(".")):
                continue
            if any(f.ignores(os.path.relpath(e.path, d), is_dir) for d, f in frames):
                continue
            if e.is_symlink() and os.path.commonpath([os.path.realpath(e.path), root]) != root:
                continue
            if is_dir and not e.is_symlink():
                enter(e.path, frames)
            elif e.is_file() and (e.name.rpartition(".")[2].lower() in extensions or e.name.endswith(".env.example")):
                s = e.stat()
                out.append((e.path, int(s.st_mtime * 1000), s.st_size))

    enter(root, frames)
    return out


def read_texts(spark: SparkSession, root: str, most: int = MAX_BYTES) -> DataFrame:
    """Rows (path, mtime_ms, size, text) of a tree's files, read by the executors; larger files are left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.where(F.col("length") <= most).select("path", (F.col("modificationTime").cast("double") * 1000).cast("bigint").alias("mtime_ms"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def manifest_diff(files: DataFrame, manifest: DataFrame, root: str = "") -> DataFrame:
    """Rows (path, status, ids): 'new', 'unchanged', 'changed' or 'removed'; ids are those to delete of a changed or removed path.

    files has path, mtime_ms, size, chunk_size, chunk_mode; only manifest paths under root can be removed.
    """
    facts = ("mtime_ms", "size", "chunk_size", "chunk_mode")
    f, m = files.select("path", *facts, F.lit(True).alias("__f")), manifest.select("path", *(F.col(c).alias("__" + c) for c in facts), "ids", F.lit(True).alias("__m"))
    m = m.where(F.col("path").startswith(root)) if root else m
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col("__" + c))
    status = F.when(F.col("__m").isNull(), "new").when(F.col("__f").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    d = f.join(m, "path", "full_outer").withColumn("status", status)
    return d.select("path", "status", F.when(F.col("status").isin("changed", "removed"), F.col("ids")).alias("ids"))


def index_files(collection, files: DataFrame, manifest: DataFrame, embed, chunk_size: int = chunking.TARGET, mode: str = "auto", root: str = "") -> tuple[DataFrame, DataFrame]:
    """Bring a collection up to date with files (path, mtime_ms, size, text): (new manifest, summary by status).

    Changed and removed files' ids are deleted and the new chunks appended in one commit.
    """
    f = files.withColumns({"chunk_size": F.lit(chunking.clamp_size(chunk_size)), "chunk_mode": chunking.mode_of(F.col("path"), mode)})
    diff = manifest_diff(f, manifest, root).cache()
    summary = diff.groupBy("status").agg(F.count("*").alias("n_files"))
    dead = diff.where("ids IS NOT NULL").select(F.explode("ids").alias("id"))
    todo = f.join(diff.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")
    c = chunking.chunk(todo, F.col("chunk_mode"), keep=["path", "chunk_size"], target=chunking.clamp_size(chunk_size)).where("chunk <> ''")
    c = c.withColumn("text", T.file_label(F.col("path"), F.col("chunk_index") + 1, F.col("n_chunks"), F.col("chunk")))
    c = c.orderBy("path", "chunk_index").select(embed(F.col("chunk")).alias("vector"), "text", T.iso_now().alias("ts"))
    first = collection.count()
    n = len(collection.put_batch(c, dead=dead))
    paths = collection.all_rows().where((F.col("id") >= first) & (F.col("id") < first + n)).groupBy(T.label_path(F.col("text")).alias("path")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    fresh = todo.select("path", "mtime_ms", "size", "chunk_size", "chunk_mode").join(paths, "path", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    kept = manifest.join(diff.where("status = 'unchanged'").select("path"), "path", "left_semi")
    return fresh.unionByName(kept), summary
