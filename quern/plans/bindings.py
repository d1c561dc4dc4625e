"""The index tables as the operators expect them, cleaned from the delivered ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.cleaning import instant, lower_trimmed, trimmed
from quern.session import table


def _newest(rows: DataFrame, key: str, time, columns: list[str]) -> DataFrame:
    """key and columns of each key's newest row as it stands; of several of one time the greatest."""
    return rows.groupBy(key).agg(F.max(F.struct(time.alias("_time"), *columns)).alias("_x")).select(key, *(f"_x.{c}" for c in columns))


_COMPONENT = ["language", "type", "name", "file", "start_line", "end_line", "death_status", "display_path", "errors", "warnings", "notes"]
_NOTE = ["component_type", "component_name", "file", "language", "content", "created_at", "updated_at"]


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in the index now: the row seen last of each id, those removed left out."""
    rows = table(spark, sf_dir, "components").where("removed_at IS NULL AND id IS NOT NULL")
    rows = rows.withColumn("display_path", F.coalesce("display_path", F.lit("")))
    rows = rows.withColumns({c: F.coalesce(f"faults.{c}", F.lit(0)) for c in ("errors", "warnings", "notes")})
    return _newest(rows, "id", F.col("first_seen_at"), _COMPONENT)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content): the row indexed last of each path."""
    rows = table(spark, sf_dir, "source_files").where("path IS NOT NULL")
    return _newest(rows, "path", F.col("indexed_at"), ["language", "content"])


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, file_hash): the hash stored with the row indexed last of each path."""
    rows = table(spark, sf_dir, "source_files").where("path IS NOT NULL")
    return _newest(rows, "path", F.col("indexed_at"), ["language", "content", "file_hash"]).select("path", F.lower(F.trim("file_hash")).alias("file_hash"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note updated last of each hash_id, tags and links of all its rows united."""
    rows = table(spark, sf_dir, "annotations").withColumn("hash_id", lower_trimmed("hash_id")).where("hash_id IS NOT NULL")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    newest = F.max(F.struct(F.coalesce(instant("updated_at"), instant("created_at")).alias("_time"), *_NOTE)).alias("_x")
    rows = rows.groupBy("hash_id").agg(newest, united("tags"), united("links"))
    return rows.select("hash_id", *(f"_x.{c}" for c in _NOTE), "tags", "links")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, target, kind), ids cleaned, repeats dropped."""
    rows = table(spark, sf_dir, "dep_edges").select(lower_trimmed("src").alias("src"), lower_trimmed("target").alias("target"), "kind")
    return rows.where("src IS NOT NULL AND target IS NOT NULL").distinct()


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component_id, path, pos) of the link store, repeats dropped."""
    rows = table(spark, sf_dir, "link_membership").select(lower_trimmed("component_id").alias("component_id"), trimmed("path").alias("path"), "pos")
    return rows.where("component_id IS NOT NULL AND path IS NOT NULL").groupBy("component_id", "path").agg(F.min("pos").alias("pos"))


def noted_links(resolved: DataFrame) -> DataFrame:
    """(component_id, path, pos) of the links in notes whose component is known."""
    rows = resolved.where("component_id IS NOT NULL").select("component_id", F.posexplode("links").alias("pos", "path"))
    return rows.groupBy("component_id", "path").agg(F.min("pos").alias("pos"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, component_id, origin) of the delivered index, cleaned and distinct."""
    rows = table(spark, sf_dir, "postings").select(lower_trimmed("token").alias("token"), "component_id", "origin")
    return rows.where("token IS NOT NULL").distinct()


def patterns(spark: SparkSession, sf_dir: str) -> list[str]:
    """Ignore patterns in order: a project's settings, a few lines."""
    return [r["pattern"] for r in table(spark, sf_dir, "ignore_patterns").orderBy("pos").collect() if r["pattern"]]


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): lines of the diagnostic reports among the documents."""
    rows = table(spark, sf_dir, "documents").where(F.lower(F.trim("source")).rlike("^diagnostic[_-]report$"))
    return rows.select(F.explode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)).alias("line"))


# --- the same in SQL -----------------------------------------------------------------

TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def sql_id(c: str) -> str:
    return f"nullif(lower({TRIM.format(c)}), '')"


def sql_ascii_lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_newest(key: str, time: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in (time, *(f'"{c}"' for c in columns)))
    return f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


_COMPONENT_SQL = ", ".join(f'"{c}"' for c in _COMPONENT[:7])
COMPS = f"""comps AS (
  SELECT id, {_COMPONENT_SQL}, display_path, errors, warnings, notes FROM (
    SELECT id, first_seen_at, {_COMPONENT_SQL}, coalesce(display_path, '') AS display_path,
      coalesce(faults.errors, 0) AS errors, coalesce(faults.warnings, 0) AS warnings, coalesce(faults.notes, 0) AS notes
    FROM components WHERE removed_at IS NULL AND id IS NOT NULL) {_sql_newest('id', 'first_seen_at', _COMPONENT)})"""
FILES = f"files AS (SELECT path, language, content FROM source_files WHERE path IS NOT NULL {_sql_newest('path', 'indexed_at', ['language', 'content'])})"
_NOTE_TIME = "coalesce(TRY_CAST(nullif(trim(updated_at), '') AS TIMESTAMPTZ), TRY_CAST(trim(created_at) AS TIMESTAMPTZ))"
NOTES = f"""anns AS (
  SELECT n.*, u.tags, u.links FROM (SELECT {sql_id('hash_id')} AS hash_id, {', '.join(_NOTE)} FROM annotations WHERE {sql_id('hash_id')} IS NOT NULL
    {_sql_newest(sql_id('hash_id'), _NOTE_TIME, _NOTE)}) n
  JOIN (SELECT {sql_id('hash_id')} AS hash_id, list_sort(list_distinct(flatten(list(tags)))) AS tags, list_sort(list_distinct(flatten(list(links)))) AS links
    FROM annotations GROUP BY 1) u ON u.hash_id = n.hash_id)"""
EDGES = f"""edges AS (SELECT DISTINCT {sql_id('src')} AS src, {sql_id('target')} AS target, kind FROM dep_edges
  WHERE {sql_id('src')} IS NOT NULL AND {sql_id('target')} IS NOT NULL)"""
STORE = f"""store AS (SELECT {sql_id('component_id')} AS component_id, {TRIM.format('path')} AS path, min(pos) AS pos FROM link_membership
  WHERE {sql_id('component_id')} IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)"""
POSTINGS = f"""post AS (SELECT DISTINCT {sql_id('token')} AS token, component_id, origin FROM postings WHERE {sql_id('token')} IS NOT NULL)"""
LINES = """report_lines AS (SELECT unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents
  WHERE regexp_matches(lower(trim(source)), '^diagnostic[_-]report$'))"""
RESOLVED = """one_lang AS (SELECT file, name, "type", language, min(id) AS id FROM comps GROUP BY ALL HAVING count(*) = 1),
one_file AS (SELECT file, name, "type", min(id) AS id FROM comps GROUP BY ALL HAVING count(*) = 1),
one AS (SELECT name, "type", min(id) AS id FROM comps GROUP BY ALL HAVING count(*) = 1),
resolved AS (
  SELECT a.*, coalesce(c.id, CASE WHEN a.file IS NULL THEN o.id WHEN a.language IS NOT NULL THEN l.id ELSE f.id END) AS component_id
  FROM anns a LEFT JOIN comps c ON c.id = a.hash_id
  LEFT JOIN one_lang l ON l.file = a.file AND l.name = a.component_name AND l."type" = a.component_type AND l.language = a.language
  LEFT JOIN one_file f ON f.file = a.file AND f.name = a.component_name AND f."type" = a.component_type
  LEFT JOIN one o ON o.name = a.component_name AND o."type" = a.component_type)"""


def sql_valid_path(c: str) -> str:
    """The trimmed path where it is one, else null."""
    p = f"trim({c})"
    return (
        f"CASE WHEN strlen({p}) <= 256 AND {p} <> '' AND NOT list_contains([trim(s) = '' FOR s IN string_split({p}, '/')], true) "
        f"AND (NOT starts_with({p}, '@') OR (contains({p}, '/') AND trim(substr(string_split({p}, '/')[1], 2)) <> '')) THEN {p} END"
    )


MERGED = f"""noted AS (SELECT component_id, path, min(pos) AS pos FROM (
    SELECT component_id, unnest(links) AS path, generate_subscripts(links, 1) - 1 AS pos FROM resolved WHERE component_id IS NOT NULL) GROUP BY 1, 2),
both_links AS (
  SELECT component_id, {sql_valid_path('path')} AS path, 0 AS rank, pos FROM store
  UNION ALL SELECT component_id, {sql_valid_path('path')}, 1, pos FROM noted),
firsts AS (SELECT component_id, {sql_ascii_lower('path')} AS key, min((rank, pos, path)) AS f FROM both_links WHERE path IS NOT NULL GROUP BY 1, 2),
merged AS (SELECT component_id, f[3] AS path, row_number() OVER (PARTITION BY component_id ORDER BY f) - 1 AS pos FROM firsts QUALIFY pos < 128)"""
DIAGS = """parsed_lines AS (SELECT string_split(line, ':') AS p, line FROM report_lines),
diags AS (
  SELECT replace(trim(p[1]), '\\', '/') AS file, try_cast(trim(p[2]) AS INTEGER) AS line, lower(CASE WHEN len(p) >= 5 THEN p[4] ELSE p[3] END) AS sev,
         trim(CASE WHEN len(p) >= 5 THEN array_to_string(p[5:], ':') ELSE p[4] END) AS message
  FROM parsed_lines WHERE len(p) >= 4 AND try_cast(trim(p[2]) AS INTEGER) IS NOT NULL),
diagnostics AS (SELECT file, line, CASE WHEN contains(sev, 'error') THEN 'error' WHEN contains(sev, 'warn') THEN 'warning'
    WHEN contains(sev, 'note') OR contains(sev, 'info') THEN 'note' ELSE 'warning' END AS severity, '' AS code, message FROM diags)"""
