"""Scanning a tree of files under ignore rules.

Files are listed by Spark's own reader, so any file system works. Ignore files become rows of rules, and which rule decides
for a path is a join: the innermost frame that matches, in it the last rule. Hard exclusions come first and can't be undone;
a second kind of ignore file can only exclude more. Symbolic links aren't followed by the reader.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, content_hash, extension, forward_slashes

# Folders that are never entered. Folders of particular tools are the caller's to add (``more_dirs``).
HARD_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache", "dist", "build", "coverage", ".next", ".turbo", ".cache", "target", "vendor")
ALLOWED_HIDDEN = (".github",)
MOST_FILES = 500


def _relative(path: str, root: str) -> str:
    bare = lambda x: re.sub(r"^\w+:/*", "/", x)
    return bare(path).removeprefix(bare(root).rstrip("/") + "/")


def hidden_entries(spark: SparkSession, root: str, names: Sequence[str], dirs: Sequence[str] = ALLOWED_HIDDEN) -> tuple[list[tuple[str, str]], list[str]]:
    """Files of the given names, as (relative path, text), and the allowed hidden folders, as paths.

    Spark's file index never lists names that begin with a dot, so the driver walks the tree's names for these.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, folders, it = [], set(), fs.listFiles(where, True)
    while it.hasNext():
        path = it.next().getPath()
        relative = _relative(path.toString(), root)
        *parts, name = relative.split("/")
        for i, part in enumerate(parts):
            if part in dirs:
                folders.add("/".join([root.rstrip("/"), *parts[: i + 1]]))
        if name in names:
            stream = fs.open(path)
            try:
                files.append((relative, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return sorted(files), sorted(folders)


def outer_ignore_files(spark: SparkSession, root: str, name: str = ".gitignore", mark: str = ".git") -> list[tuple[str, str]]:
    """Ignore files of the folders above ``root``, up to the one that holds ``mark``, outermost first; none without it.

    Each is (``//`` and the way from its folder down to the root, text), which ``rules_of`` and ``ignored`` understand.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, way = [], []
    while not fs.exists(jvm.org.apache.hadoop.fs.Path(where, mark)):
        way, where = [where.getName(), *way], where.getParent()
        if where is None:
            return []
        file = jvm.org.apache.hadoop.fs.Path(where, name)
        if fs.exists(file):
            stream = fs.open(file)
            try:
                out.append((f"//{'/'.join(way)}", jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return out[::-1]


def listed(spark: SparkSession, root: str, with_content: bool = True, most_bytes: int | None = None, more_roots: Sequence[str] = ()) -> DataFrame:
    """path (relative, forward slashes), length, mtime and, if asked, content as text."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *more_roots])
    if most_bytes is not None:
        d = d.where(F.col("length") <= most_bytes)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^{re.escape(base)}", "")
    cols = [forward_slashes(relative).alias("path"), "length", F.col("modificationTime").alias("mtime")]
    return d.select(*cols, F.decode("content", "UTF-8").alias("content")) if with_content else d.select(*cols)


def not_excluded(path: Column | str, more_dirs: Sequence[str] = (), hidden: Sequence[str] = ALLOWED_HIDDEN) -> Column:
    """No part is a hard-excluded folder or hidden, the allowed hidden ones aside."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/", -1)
    return ~F.exists(parts, lambda x: x.isin(*HARD_DIRS, *more_dirs) | (F.startswith(x, F.lit(".")) & ~x.isin(*hidden)))


def pattern(rule: str) -> tuple[str, bool] | None:
    """Regular expression for paths below the rule's folder, and whether the rule takes back; none for comments and blanks."""
    rule = re.sub(r"(?<!\\)\s+$", "", rule.rstrip("\r\n"))
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[negated:]
    rule = rule[1:] if rule[:2] in ("\\#", "\\!") else rule
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            out, i = out + "[" + re.sub(r"^!", "^", rule[i + 1 : end]).replace("\\", "\\\\") + "]", end + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/' if folder else '(?:/|$)'}", negated


def rules_of(files: Sequence[tuple[str, str]]) -> list[tuple[str, int, int, str, bool]]:
    """(folder, depth, seq, regular expression, negated) of ignore files given as (folder, text), outermost first."""
    out = []
    for folder, text in files:
        depth = 1 - folder.count("/") if folder.startswith("//") else folder.count("/") + 1 if folder else 0
        for seq, line in enumerate(text.split("\n")):
            if p := pattern(line):
                out.append((folder, depth, seq, *p))
    return out


def ignored(files: DataFrame, rules: Sequence[tuple[str, int, int, str, bool]], additive: bool = False) -> DataFrame:
    """Paths that the rules leave out. ``additive`` rules never take back.

    The rules of a tree are few and are broadcast; they are as many as lines in ignore files.
    """
    spark = files.sparkSession
    table = spark.createDataFrame(list(rules), "folder string, depth int, seq int, pattern string, negated boolean")
    outer = F.startswith("folder", F.lit("//"))
    below = F.when(F.col("folder") == "", F.col("path")).when(outer, F.concat(F.substr("folder", F.lit(3)), F.lit("/"), F.col("path"))).when(F.startswith("path", F.concat("folder", F.lit("/"))), F.substr("path", F.length("folder") + 2))
    hits = files.select("path").crossJoin(F.broadcast(table)).withColumn("below", below).where(F.col("below").isNotNull() & F.regexp_like("below", F.col("pattern")))
    if additive:
        return hits.where("NOT negated").select("path").distinct()
    decided = hits.groupBy("path").agg(F.max_by("negated", F.struct("depth", "seq")).alias("kept"))
    return decided.where("NOT kept").select("path")


def scanned(spark: SparkSession, root: str, extensions: Sequence[str] | None = EXTENSIONS, most_files: int | None = MOST_FILES, ignore_name: str = ".gitignore", extra_name: str = ".indexignore", parents: Sequence[tuple[str, str]] = (), more_dirs: Sequence[str] = (), include_hidden: bool = True) -> DataFrame:
    """Files to index, by path, the first ``most_files``: path, length, mtime, content.

    ``parents`` has ignore files above the root, as ``outer_ignore_files`` finds them, or ("", text) for rules of the root.
    """
    hidden = ALLOWED_HIDDEN if include_hidden else ()
    found, folders = hidden_entries(spark, root, (ignore_name, extra_name), hidden)
    own = lambda n: [(p.rpartition("/")[0], text) for p, text in found if p.rpartition("/")[2] == n]
    d = listed(spark, root, more_roots=folders).where(not_excluded("path", more_dirs, hidden))
    if extensions is not None:
        d = d.where(F.lower(extension("path")).isin(*extensions))
    for rules, additive in ((rules_of([*parents, *own(ignore_name)]), False), (rules_of(own(extra_name)), True)):
        if rules:
            d = d.join(ignored(d, rules, additive), "path", "left_anti")
    return d.orderBy("path").limit(most_files) if most_files is not None else d


def bad_ignore_hashes(hashes: DataFrame, names: Sequence[str] = (".gitignore", ".indexignore")) -> DataFrame:
    """Rows (path, hash) of a stored list that can't be hashes of ignore files: another name, named twice, or no 16 hex digits."""
    twice = F.count("*").over(Window.partitionBy("path")) > 1
    d = hashes.withColumn("bad", F.coalesce(~F.col("path").isin(*names) | ~F.col("hash").rlike("^[0-9a-f]{16}$"), F.lit(True)) | twice)
    return d.where("bad").drop("bad")


def ignore_hashes(spark: SparkSession, root: str, names: Sequence[str] = (".gitignore", ".indexignore")) -> DataFrame:
    """path, hash of the root's ignore files."""
    found = [(p, text) for p, text in hidden_entries(spark, root, names)[0] if p in names]
    return spark.createDataFrame(found, "path string, content string").select("path", content_hash("content").alias("hash"))
