"""Queries of the general data problems (4, 5 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators import hierarchy as H
from quern.operators import references as R
from quern.operators import snapshots as S
from quern.session import cut, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = S.snapshot_changes(table(spark, sf_dir, "file_snapshots"))
    return changes.select("root", "generated_at", "path", "change_kind")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.change_counts(S.snapshot_changes(table(spark, sf_dir, "file_snapshots")))


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = R.component_references(
        *(table(spark, sf_dir, t) for t in ("link_membership", "annotations", "dep_edges", "source_files"))
    )
    alive = R.lifetimes(table(spark, sf_dir, "components"), "id", "first_seen_at", "removed_at")
    return refs, alive


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, alive = _refs(spark, sf_dir)
    dangling = R.orphans(refs, alive)
    month = R.utc_month(dangling["at"]).alias("ref_month")
    return dangling.select("ref_table", month, dangling["id"].alias("component_id")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, alive = _refs(spark, sf_dir)
    return R.orphan_report(refs, R.orphans(refs, alive))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = H.catalog_nodes(table(spark, sf_dir, "link_catalog"))
    return H.hierarchy(nodes, H.membership_counts(table(spark, sf_dir, "link_membership")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The separation of cycles, with which the hierarchy begins; the stages after it see none of these paths.
    return H.cycle_nodes(H.catalog_entries(table(spark, sf_dir, "link_catalog")))


def p6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _hierarchy(spark, sf_dir).where("is_entry")
    return tree.selectExpr(
        "path", "status", "depth", "root", "array_join(parents, ' > ') AS chain", "n_below", "n_links", "n_members"
    )


def p6_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.below(_hierarchy(spark, sf_dir))


QUERIES = {
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_hierarchy": p6_hierarchy,
    "p6_below": p6_below,
}

_P4 = r"""
WITH cleaned AS (
  SELECT root, epoch_us(CAST(trim(generated_at) AS TIMESTAMPTZ)) AS t,
         regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path,
         lower(file_hash) AS hash, received_at
  FROM file_snapshots WHERE root IS NOT NULL AND path IS NOT NULL
), latest AS (
  SELECT root, t, path, hash FROM cleaned WHERE t IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY root, t, path ORDER BY received_at DESC NULLS LAST, hash DESC NULLS LAST) = 1
), idx AS (
  SELECT root, t, lag(t) OVER (PARTITION BY root ORDER BY t) AS prev_t FROM (SELECT DISTINCT root, t FROM latest)
), later AS (
  SELECT l.* FROM latest l JOIN idx i USING (root, t) WHERE i.prev_t IS NOT NULL
), earlier AS (
  SELECT l.root, i.t, l.path, l.hash FROM latest l JOIN idx i ON i.root = l.root AND i.prev_t = l.t
), changes AS (
  SELECT coalesce(n.root, o.root) AS root,
         strftime(make_timestamp(coalesce(n.t, o.t)), '%Y-%m-%dT%H:%M:%SZ') AS generated_at,
         coalesce(n.path, o.path) AS path,
         CASE WHEN o.root IS NULL THEN 'added' WHEN n.root IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM later n FULL JOIN earlier o ON n.root = o.root AND n.t = o.t AND n.path = o.path
  WHERE n.root IS NULL OR o.root IS NULL OR n.hash IS DISTINCT FROM o.hash
)
"""

_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_ID = "nullif(lower(" + _TRIM + "), '')"

_P5 = f"""
WITH refs AS (
  SELECT 'link_membership' AS ref_table, {_ID.format('component_id')} AS id, epoch_us(updated_at) AS at FROM link_membership
  UNION ALL SELECT 'annotations', {_ID.format('hash_id')}, epoch_us(CAST(trim(created_at) AS TIMESTAMPTZ)) FROM annotations
  UNION ALL SELECT 'dep_edges', {_ID.format('target')}, epoch_us(generated_at) FROM dep_edges
  UNION ALL SELECT 'source_files', {_ID.format('x')}, epoch_us(indexed_at) FROM (SELECT unnest(component_ids) AS x, indexed_at FROM source_files)
), alive AS (
  SELECT DISTINCT {_ID.format('id')} AS id, epoch_us(first_seen_at) AS a, epoch_us(removed_at) AS b FROM components
), judged AS (
  SELECT r.ref_table, strftime(make_timestamp(r.at), '%Y-%m') AS ref_month, r.id,
         EXISTS (SELECT 1 FROM alive c WHERE c.id = r.id AND c.a <= r.at AND (c.b IS NULL OR c.b > r.at)) AS ok
  FROM refs r WHERE r.id IS NOT NULL AND r.at IS NOT NULL
)
"""

_TOPIC = "nullif(lower(regexp_replace(regexp_replace({0}, '^[/\\s]+', ''), '[/\\s]+$', '')), '')"

_P6 = f"""
WITH RECURSIVE entries AS (
  SELECT {_TOPIC.format('path')} AS path, min({_TOPIC.format('parent_path')}) AS parent
  FROM link_catalog GROUP BY 1 HAVING path IS NOT NULL
), nodes AS (
  SELECT path, parent, true AS is_entry FROM entries
  UNION ALL
  SELECT DISTINCT parent, NULL, false FROM entries WHERE parent IS NOT NULL AND parent NOT IN (SELECT path FROM entries)
), walk AS (
  SELECT path, parent AS up, 1 AS dist, [path] AS seen FROM nodes WHERE parent IS NOT NULL
  UNION ALL
  SELECT w.path, n.parent, w.dist + 1, list_append(w.seen, w.up) FROM walk w JOIN nodes n ON n.path = w.up
  WHERE n.parent IS NOT NULL AND NOT list_contains(w.seen, w.up)
), anc AS (SELECT DISTINCT path, up FROM walk),
ends AS (SELECT a.path FROM anc a JOIN nodes n ON n.path = a.up WHERE n.parent IS NULL),
depths AS (SELECT path, max(dist) AS depth FROM walk GROUP BY 1),
marked AS (
  SELECT n.path, n.parent, n.is_entry,
    CASE WHEN n.parent IS NULL OR n.path IN (SELECT path FROM ends) THEN 'tree'
         WHEN n.path IN (SELECT path FROM anc WHERE path = up) THEN 'cycle' ELSE 'leads_to_cycle' END AS status
  FROM nodes n
), own AS (
  SELECT {_TOPIC.format('path')} AS path, count(*) AS links, count(DISTINCT {_ID.format('component_id')}) AS members
  FROM link_membership GROUP BY 1
), sums AS (
  SELECT a.up AS path, count(*) AS n_below, sum(coalesce(o.links, 0)) AS links, sum(coalesce(o.members, 0)) AS members
  FROM anc a LEFT JOIN own o ON o.path = a.path GROUP BY 1
), chains AS (
  SELECT w.path, string_agg(w.up, ' > ' ORDER BY w.dist DESC) AS chain, arg_max(w.up, w.dist) AS root FROM walk w GROUP BY 1
)
"""

ORACLE = {
    "p4_found": _P4 + "SELECT * FROM changes",
    "p4_counts": _P4 + "SELECT root, generated_at, change_kind, count(*) AS files FROM changes GROUP BY ALL",
    "p5_found": _P5 + "SELECT DISTINCT ref_table, ref_month, id AS component_id FROM judged WHERE NOT ok",
    "p5_report": _P5
    + """SELECT ref_table, ref_month, count(*) AS refs, count(*) FILTER (NOT ok) AS orphan_refs,
         count(DISTINCT id) FILTER (NOT ok) AS orphan_ids FROM judged GROUP BY ALL""",
    "p6_found": _P6 + "SELECT path FROM marked WHERE status = 'cycle'",
    "p6_hierarchy": _P6
    + """SELECT m.path, m.status,
         CASE WHEN m.status = 'tree' THEN coalesce(d.depth, 0) END::BIGINT AS depth,
         CASE WHEN m.status = 'tree' THEN coalesce(c.root, m.path) END AS root,
         CASE WHEN m.status = 'tree' THEN coalesce(c.chain, '') END AS chain,
         CASE WHEN m.status = 'tree' THEN coalesce(s.n_below, 0) END AS n_below,
         CASE WHEN m.status = 'tree' THEN CAST(coalesce(s.links, 0) + coalesce(o.links, 0) AS BIGINT) END AS n_links,
         CASE WHEN m.status = 'tree' THEN CAST(coalesce(s.members, 0) + coalesce(o.members, 0) AS BIGINT) END AS n_members
         FROM marked m LEFT JOIN depths d USING (path) LEFT JOIN chains c USING (path)
         LEFT JOIN sums s USING (path) LEFT JOIN own o ON o.path = m.path WHERE m.is_entry""",
    "p6_below": _P6 + "SELECT a.up AS path, a.path AS below FROM anc a JOIN marked m ON m.path = a.path WHERE m.status = 'tree'",
}
