"""Dependency edges between components: inference, merging, adjacency, neighbourhoods."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.extraction import IMPORT_KINDS
from quern.session import cut

#: Strength of the kinds of edge (fixed values).
KIND_RANK = {"same_file": 4, "import_resolved": 3, "qualified": 3, "import_disambiguated": 2}


def kind_rank(kind):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv)), kind), F.lit(0))


def merged_edges(edges: DataFrame) -> DataFrame:
    """(src, target, kind): one row per pair with its strongest kind; equal strength keeps the lesser name."""
    best = F.max_by("kind", F.struct(kind_rank(F.col("kind")), -F.ascii("kind")))
    return edges.where("src IS NOT NULL AND target IS NOT NULL").groupBy("src", "target").agg(best.alias("kind"))


def adjacency(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(a, b): every edge in both directions, once, between components that exist; no loops."""
    ids = components.select("id").distinct()
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    pairs = known.where("src <> target").select(F.col("src").alias("a"), F.col("target").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, direction, id, depth): what each root uses (before) and is used by (after), up to a depth.

    roots: (root). Every node appears once per root and direction, at its
    least depth; the root itself doesn't. Depth 0 gives no rows. Each step
    joins only the frontier and drops what was seen, so cycles end by
    themselves.
    """
    edges = edges.where("src IS NOT NULL AND target IS NOT NULL")
    steps = {
        "before": edges.select(F.col("src").alias("a"), F.col("target").alias("b")).distinct(),
        "after": edges.select(F.col("target").alias("a"), F.col("src").alias("b")).distinct(),
    }
    parts = []
    for direction, step in steps.items():
        seen = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct()
        frontier = seen
        for d in range(1, depth + 1):
            reached = frontier.join(step, frontier["id"] == step["a"]).select("root", F.col("b").alias("id")).distinct()
            frontier = cut(reached.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(d)))
            seen = seen.unionByName(frontier)
        parts.append(seen.where("depth > 0").withColumn("direction", F.lit(direction)))
    return parts[0].unionByName(parts[1]).select("root", "direction", "id", "depth")


# --- inference --------------------------------------------------------------------

_SANITIZE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_SANITIZE_PYTHON = re.compile(r"""#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_TOKEN = re.compile(r"(::)?\s*([A-Za-z_][A-Za-z0-9_]*)")


def sanitized(text: str, language: str) -> str:
    """A body without comments and literals; line ends stay."""
    pattern = _SANITIZE_PYTHON if language == "python" else _SANITIZE
    return pattern.sub(lambda m: "\n" * m.group(0).count("\n") or " ", text)


def body_tokens(components: DataFrame, files: DataFrame) -> DataFrame:
    """(src, file, language, token, qualified): identifiers in each component's sanitized body, once each.

    components: (id, file, language, start_line, end_line), import-like ones
    left out by the caller; files: (path, content). Bodies are gathered per
    file, as the components of one file.
    """
    spans = components.groupBy("file", "language").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("spans"))
    rows = spans.join(files.select(F.col("path").alias("file"), "content"), "file")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for file, language, spans, content in zip(
                *(batch.column(c).to_pylist() for c in ("file", "language", "spans", "content")), strict=True
            ):
                lines = sanitized(content or "", language or "").split("\n")
                for span in spans:
                    body = "\n".join(lines[max(0, span["start_line"] - 1) : span["end_line"]])
                    found: dict[str, bool] = {}
                    for m in _TOKEN.finditer(body):
                        found[m.group(2)] = found.get(m.group(2), False) or bool(m.group(1))
                    out += [(span["id"], file, language, token, q) for token, q in found.items()]
            data = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, kinds, strict=True)], ["src", "file", "language", "token", "qualified"])

    return rows.mapInArrow(run, "src string, file string, language string, token string, qualified boolean")


def inferred_edges(components: DataFrame, files: DataFrame) -> DataFrame:
    """(src, target, kind): edges read from the components' bodies.

    A token that names a component of the same file gives same_file. A token
    that the file imports, or that follows `::`, is looked up among all names
    of the language: the pick is one in the same folder, else the one with the
    shorter path, then the lesser id. import_resolved or qualified if the name
    is alone in its language, import_disambiguated otherwise. Import-like
    components supply imported names and take part in no edge; none depends
    on itself.

    For each key (file, folder, language) and name the pick is made before the
    join, so every join has one row per key and no name multiplies rows.
    """
    real = components.where(~F.col("type").isin(*IMPORT_KINDS))
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    real = real.withColumn("folder", folder)
    words = body_tokens(real, files).withColumn("folder", folder)
    order = F.struct(F.length("file"), F.col("file"), F.col("id"))
    pick = lambda keys, name: real.groupBy(*keys, F.col("name").alias("token")).agg(F.min_by("id", order).alias(name))
    same_file = pick(["file"], "in_file")
    in_folder = pick(["language", "folder"], "in_folder")
    anywhere = real.groupBy("language", F.col("name").alias("token")).agg(F.min_by("id", order).alias("anywhere"), F.count(F.lit(1)).alias("namesakes"))
    imports = components.where(F.col("type").isin(*IMPORT_KINDS)).select(
        "file", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("token"), F.lit(True).alias("imported")
    )
    rows = (
        words.join(same_file, ["file", "token"], "left")
        .join(imports.distinct(), ["file", "token"], "left")
        .join(in_folder, ["language", "folder", "token"], "left")
        .join(anywhere, ["language", "token"], "left")
    )
    elsewhere = F.coalesce("in_folder", "anywhere")
    kind = F.when(F.col("namesakes") > 1, "import_disambiguated").when(F.col("imported"), "import_resolved").otherwise("qualified")
    target = F.when(F.col("in_file").isNotNull(), F.col("in_file")).when(F.col("imported") | F.col("qualified"), elsewhere)
    edges = rows.select("src", target.alias("target"), F.when(F.col("in_file").isNotNull(), "same_file").otherwise(kind).alias("kind"))
    return merged_edges(edges.where("target IS NOT NULL AND src <> target"))


def uses(edges: DataFrame) -> DataFrame:
    """(id, uses, used_by): how many components each one uses and is used by."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("target").alias("uses"))
    back = edges.groupBy(F.col("target").alias("id")).agg(F.countDistinct("src").alias("used_by"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return reduce(lambda a, b: a.join(b, "id", "full"), (out, back)).select("id", zero("uses"), zero("used_by"))
