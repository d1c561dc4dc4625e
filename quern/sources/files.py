"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import EXTENSIONS, content_hash, decoded, detected_language
from quern.sources.ignore import DEFAULT_PATTERNS, ignored
from quern.sources.stores import _file_system


def scan_tree(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, language, content, file_hash) of the source files below a folder.

    Paths are relative to the root. Ignored files and unknown extensions are
    left out before their content is decoded; bytes that are no UTF-8 become
    replacement characters, and the hash is that of the bytes.
    """
    system, where = _file_system(spark, root.rstrip("/") or "/")
    base = system.makeQualified(where).toString().rstrip("/")
    # Extensions count in any mixture of cases.
    spelled = ("".join(f"[{c}{c.upper()}]" for c in e) for e in sorted(EXTENSIONS))
    glob = "*.{" + ",".join(spelled) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.expr(f"substring(path, {len(base) + 2})")
    rows = raw.select(path.alias("path"), "content").where(~ignored(F.col("path"), [*DEFAULT_PATTERNS, *(patterns or [])]))
    return rows.select("path", detected_language("path").alias("language"), decoded("content").alias("content"), content_hash("content").alias("file_hash"))
