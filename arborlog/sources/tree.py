"""Reading a source tree: which files count, and their content as text."""

from __future__ import annotations

import fnmatch
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlog.functions import text_or_envelope

#: Folders of tools and builds that hold no sources.
PRUNED = (".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "vendor", "obj", "bin", "_build", "deps", ".next", ".cache", "coverage")
GENERATED_NAMES = (".DS_Store", "Thumbs.db")
GENERATED_SUFFIXES = (".min.js", ".min.css", ".map", ".lock", ".pyc", ".class", ".o", ".so", ".dll")
MARKERS = ("@generated", "DO NOT EDIT", "Code generated by")
MARKER_BYTES = 8192


def ignored(path: str, rules: list[tuple[str, str]]) -> bool:
    """Do ignore rules, as (folder of the rule file, line), leave this path out? The last match counts, and a left-out folder takes all below."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        part, folder, out = "/".join(parts[:k]), k < len(parts), False
        for base, line in rules:
            rule = line.rstrip()
            if not rule or rule.startswith("#") or (base and not part.startswith(base + "/")):
                continue
            keep, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
            only_folder, rule = rule.endswith("/"), rule.rstrip("/")
            if only_folder and not folder:
                continue
            own = part[len(base) + 1 :] if base else part
            if "/" in rule:
                pattern = re.escape(rule.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
                hit = re.fullmatch(pattern, own) is not None
            else:
                hit = fnmatch.fnmatchcase(posixpath.basename(part), rule)
            if hit:
                out = not keep
        if out:
            return True
    return False


def generated(path: Column, content: Column) -> Column:
    """Files that a tool wrote, by name, ending, or a marker near their start."""
    name = F.element_at(F.split(path, "/"), -1)
    found = name.isin(*GENERATED_NAMES)
    for s in GENERATED_SUFFIXES:
        found = found | name.endswith(s)
    head = F.substring(content, 1, MARKER_BYTES)
    for m in MARKERS:
        found = found | F.coalesce(F.contains(head, F.lit(m)), F.lit(False))
    return found


def _hidden(spark: SparkSession, root: str, most: int = 5 * 1024 * 1024) -> list[tuple[str, bytearray]]:
    """Files that Spark's readers skip, as their name or a folder's begins with a dot or underscore; few and small, so the driver reads them."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    start = fs.makeQualified(base).toString().rstrip("/") + "/"
    found, it = [], fs.listFiles(base, True)
    while it.hasNext():
        status = it.next()
        path = status.getPath().toString().removeprefix(start)
        parts = path.split("/")
        if any(p[:1] in "._" for p in parts) and not any(p in PRUNED for p in parts[:-1]) and status.getLen() <= most:
            stream = fs.open(status.getPath())
            found.append((path, bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    return found


def read_source_files(spark: SparkSession, root: str, ignore_names: tuple[str, ...] = (".gitignore", ".arborlogignore")) -> DataFrame:
    """(path, content) of the files under a folder or of one file, by path relative to the root.

    Folders of tools, generated files, what ignore files leave out, and too large binary files don't count. Content is
    text, or base64 with a mark. Ignore files are small and few; their lines go to the tasks that judge the paths.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    bare = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    at = F.locate(re.sub("^[a-z]+:/*(?=/)", "", base), bare)
    files = raw.select(F.when(at > 0, F.substring(bare, at + F.lit(len(re.sub("^[a-z]+:/*(?=/)", "", base))), F.length(bare))).otherwise(F.element_at(F.split(bare, "/"), -1)).alias("path"), "content")
    hidden = _hidden(spark, root)
    if hidden:
        files = files.unionAll(spark.createDataFrame(hidden, "path string, content binary"))
    pruned = F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1)), lambda p: p.isin(*PRUNED))
    files = files.where(~pruned)
    own = files.where(F.element_at(F.split("path", "/"), -1).isin(*ignore_names)).select("path", F.col("content").cast("string").alias("text")).collect()
    rules = [(posixpath.dirname(r["path"]), line) for r in sorted(own, key=lambda r: (r["path"].count("/"), r["path"])) for line in (r["text"] or "").splitlines()]
    if rules:

        def run(batches):
            for pdf in batches:
                yield pdf[[not ignored(p, rules) for p in pdf["path"]]]

        keep = files.select("path").mapInPandas(run, "path string")
        files = files.join(keep, "path", "left_semi")
    text = files.select("path", text_or_envelope(F.col("content")).alias("content")).where("content is not null")
    return text.where(~generated(F.col("path"), F.col("content")))
