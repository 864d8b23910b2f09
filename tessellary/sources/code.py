"""Source trees as tables of files, symbols and imports, and parsed diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from .declarations import declarations

LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "java": "java"}


def read_tree(spark: SparkSession, root: str, include: str = "**", exclude: tuple[str, ...] = ("node_modules", "dist", "build")) -> DataFrame:
    """(path, language, content) of source files below ``root``; globs choose, parts of a path exclude."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{ts,tsx,js,jsx,java}")
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rows = rows.where(F.col("path").rlike(glob_regex(include)))
    for part in exclude:
        rows = rows.where(~F.col("path").contains(f"/{part}/"))
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return rows.select("path", names[extension].alias("language"), "content")


def symbols(files: DataFrame, members: bool = False) -> DataFrame:
    """Declarations of ``files`` as ``declarations`` gives them: those that nothing holds, or all with their ``members``."""
    found = declarations(files).withColumns({c: F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in ("extends", "implements")})
    return found if members else found.where("parent is null")


def imports(files: DataFrame) -> DataFrame:
    """(path, source, external): imported modules; relative and absolute paths are internal."""
    pattern = r"""(?m)^\s*(?:import|export)\b[^'"\n]*['"]([^'"]+)['"]|^import\s+(?:static\s+)?([\w.]+);"""
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("statement"))
    source = F.coalesce(F.nullif(F.regexp_extract("statement", r"""['"]([^'"]+)['"]""", 1), F.lit("")), F.regexp_extract("statement", r"import\s+(?:static\s+)?([\w.]+);", 1))
    return found.select("path", source.alias("source")).withColumn("external", ~F.col("source").startswith(".") & ~F.col("source").startswith("/"))


def parse_diffs(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, old_path, new_path, change, additions, deletions) of each file of a git diff."""
    parts = diffs.select(key, F.explode(F.filter(F.split(F.concat(F.lit("\n"), text), r"\ndiff --git "), lambda x: x != "")).alias("d"))
    old, new = F.regexp_extract("d", r"^a/(\S+) b/\S+", 1), F.regexp_extract("d", r"^a/\S+ b/(\S+)", 1)
    change = F.when(F.col("d").contains("\nnew file mode"), "added").when(F.col("d").contains("\ndeleted file mode"), "deleted").when(old != new, "renamed").otherwise("modified")
    lines = F.split("d", "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return parts.select(key, old.alias("old_path"), new.alias("new_path"), change.alias("change"), count("+").alias("additions"), count("-").alias("deletions"))
