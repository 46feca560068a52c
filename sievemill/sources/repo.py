"""File trees as tables: discovery scans, manifests, text sniffing, refresh of changed paths."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C

MAX_BYTES = 10 << 20


#: Files that name what to leave out, in the order in which later ones count.
IGNORE_FILES = (".gitignore", ".ignore", ".opencodeignore")


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """``(regular expression over relative paths, ignored)`` of each line of an ignore file in ``folder``, later ones counting more.

    ``*`` and ``?`` stay within a name, ``**`` crosses folders, a slash that is not the last character ties a pattern to the folder, a last one to
    folders, ``!`` takes back, ``#`` starts a comment and a backslash takes the next character as it is.
    """
    rules, base = [], f"{folder}/" if folder else ""
    for line in text.split("\n"):
        line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        only_folders, line = line.endswith("/"), line.rstrip("/")
        tied = "/" in line
        line = line.lstrip("/")
        out, i = "", 0
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif line.startswith("**", i):
                out, i = out + ".*", i + 2
            elif c == "[" and (end := line.find("]", i + 2)) > 0:
                inner = line[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                if c == "\\" and i + 1 < len(line):
                    i, c = i + 1, re.escape(line[i + 1])
                    out += c
                else:
                    out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
                i += 1
        head = re.escape(base) + ("" if tied else "(?:.*/)?")
        rules.append((f"^{head}{out}{'/.*' if only_folders else '(?:/.*)?'}$", not keep))
    return rules


def is_ignored(path: Column | str, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides; none ignores nothing."""
    p, out = F.col(path) if isinstance(path, str) else path, F.lit(False)
    for rx, ignored in rules:
        out = F.when(p.rlike(rx), F.lit(ignored)).otherwise(out)
    return out


def _relative(root: str) -> Column:
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    return F.regexp_replace(F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 2, F.lit(1 << 20)), "^/+", "")


def read_ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """The rules of the ignore files in the folders that hold any listed file, and above them; those of deeper folders later.

    Spark's own listing leaves out names with a leading dot, so these few small files are opened one by one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = F.regexp_replace(_relative(root), "/?[^/]*$", "")
    seen = {""}
    for row in files.select(folder.alias("d")).distinct().toLocalIterator():
        parts = row.d.split("/") if row.d else []
        seen |= {"/".join(parts[: i + 1]) for i in range(len(parts))}
    jvm, conf, rules = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for d in sorted(seen, key=lambda d: (d.count("/") + bool(d), d)):
        for name in IGNORE_FILES:
            path = jvm.org.apache.hadoop.fs.Path("/".join(x for x in (root.rstrip("/"), d, name) if x))
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                stream = fs.open(path)
                try:
                    rules += ignore_rules(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace"), d)
                finally:
                    stream.close()
    return rules


def _linked(path: Column, root: str) -> Column:
    """Whether a file, or a folder between ``root`` and it, is a symbolic link (of a local file system, or one that is mounted as such)."""

    @F.pandas_udf("boolean")
    def look_all(paths: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def look(at: str) -> bool:
            if len(at) <= len(root) or not at.startswith(root):
                return False
            if at not in known:
                known[at] = os.path.islink(at) or look(os.path.dirname(at))
            return known[at]

        return paths.map(look).astype(bool)

    return look_all(path)


def scan(spark: SparkSession, root: str, *, glob: str | None = None, ignored: str | None = None, content: bool = True, ignore_files: bool = False) -> DataFrame:
    """``(path, kind, language, size_bytes, mtime, content, content_hash)`` of the files below ``root`` worth indexing.

    Engine folders, generated files, symbolic links, paths that match the regular expression ``ignored`` and, with ``ignore_files``,
    those that the tree's ignore files name are left out before contents are
    read; contents and hashes are taken of searchable files up to 10 MB without a zero byte at their start. Distributed by Spark's binary file source;
    ``ordered`` puts the result in path order. Names with a leading dot are beyond Spark's listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    kind = C.classify_path("rel")
    out = raw.withColumn("rel", _relative(root)).filter(~C.is_excluded("rel"))
    if ignored:
        out = out.filter(~F.col("rel").rlike(ignored))
    if ignore_files:
        out = out.filter(~is_ignored("rel", read_ignore_rules(spark, root)))
    out = out.withColumn("kind", kind).filter("kind != 'generated'")
    if re.match("^(file:/|/)", root):
        out = out.filter(~_linked(F.regexp_replace("path", "^file:/*", "/"), re.sub("^file:/*", "/", root.rstrip("/"))))
    readable = C.is_searchable("rel", F.col("kind")) & (F.col("length") <= MAX_BYTES)
    cols = [F.col("rel").alias("path"), F.col("kind"), C.detect_language("rel").alias("language"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")]
    if content:
        text = readable & (is_text("content") | _wide("content"))
        cols += [F.when(text, decode("content")).alias("content"), F.when(readable, F.sha2("content", 256)).alias("content_hash")]
    return out.select(*cols)


def ordered(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def _wide(content: Column | str) -> Column:
    """A byte-order mark of UTF-16, whose texts hold zero bytes."""
    b = F.col(content) if isinstance(content, str) else content
    return F.hex(F.substring(b, 1, 2)).isin("FFFE", "FEFF")


def decode(content: Column | str) -> Column:
    """Bytes to text: UTF-8, by byte-order mark UTF-16, else Latin-1 (which accepts all bytes)."""
    b = F.col(content) if isinstance(content, str) else content
    return F.when(_wide(b), F.decode(b, "UTF-16")).when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def is_text(content: Column | str) -> Column:
    """No zero byte in the first KiB."""
    b = F.col(content) if isinstance(content, str) else content
    return ~F.hex(F.substring(b, 1, 1024)).rlike("^(?:..)*?00")


def stats(files: DataFrame) -> DataFrame:
    """One row of counters."""
    kinds = ["source", "test", "doc", "config", "build", "unknown"]
    return files.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.sum("size_bytes").alias("total_bytes"), F.count_if(F.col("content_hash").isNull()).alias("unhashed"))


def parseable(files: DataFrame) -> DataFrame:
    """Files of a language with an extractor, each path once."""
    return files.filter("language != 'unknown'").dropDuplicates(["path"])


def refresh(old: DataFrame, dirty: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)`` of the dirty paths: added, changed, deleted or same, by content hash."""
    paths = dirty.select(C.normalise_path("path").alias("path")).filter("path is not null").distinct()
    j = paths.join(old.select("path", F.col("content_hash").alias("h1"), F.lit(1).alias("a")), "path", "left").join(now.select("path", F.col("content_hash").alias("h2"), F.lit(1).alias("b")), "path", "left")
    change = F.when(F.col("b").isNull(), F.when(F.col("a").isNotNull(), "deleted")).when(F.col("a").isNull(), "added").when(F.col("h1").eqNullSafe(F.col("h2")), "same").otherwise("changed")
    return j.select("path", change.alias("change")).filter("change is not null")


def dependencies(files: DataFrame) -> DataFrame:
    """``(path, name)`` of packages named in package.json, requirements files and pyproject.toml."""
    name = C.basename("path")
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    npm = F.array_union(F.coalesce(F.map_keys(deps["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(deps["devDependencies"]), F.array().cast("array<string>")))
    lines = F.transform(F.split("content", "\n"), lambda x: F.regexp_extract(F.trim(x), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    block = F.regexp_extract("content", r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\n?\]", 1)
    toml = F.regexp_extract_all(block, F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), 1)
    found = F.when(name == "package.json", npm).when(name.rlike(r"^requirements.*\.txt$"), F.filter(lines, lambda x: x != "")).when(name == "pyproject.toml", toml)
    return files.select("path", F.explode(found).alias("name")).distinct()
