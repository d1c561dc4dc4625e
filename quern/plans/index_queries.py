"""Queries over the code index: lists, search, links, notes, diagnostics, sync, graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import tokens as K
from quern.functions.cleaning import instant, micros_of, utc_text
from quern.operators import annotations as A
from quern.operators import diagnostics as D
from quern.operators import edges as E
from quern.operators import extraction as X
from quern.operators import graph as G
from quern.operators import links as L
from quern.operators import lists as W
from quern.operators import liveness as V
from quern.operators import search as S
from quern.operators import sync as Y
from quern.operators.snapshots import latest_rows
from quern.plans import bindings as B
from quern.session import cut, table
from quern.sources import stores
from quern.sources.ignore import ignored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- sources ---------------------------------------------------------------------------


#: The patterns the test tables hold, written out as SQL; the last one that matches decides.
_PARTS = "string_split(path, '/')"
_IGNORED_SQL = f"""CASE WHEN starts_with(path, 'vendor/') THEN true
  WHEN len([p FOR p IN {_PARTS} IF ends_with(p, '.bak')]) > 0 THEN true
  WHEN starts_with(path, 'build/out/') OR starts_with(path, 'tmp/') THEN true
  WHEN len([p FOR p IN {_PARTS} IF ends_with(p, '_pb2.py')]) > 0 THEN true
  WHEN list_contains({_PARTS}[:-2], 'legacy') THEN true
  WHEN starts_with(path, 'third_party/adapters/') THEN false
  WHEN list_contains({_PARTS}[:-2], 'third_party') THEN true
  WHEN len([p FOR p IN {_PARTS} IF ends_with(p, '.min.js')]) > 0 THEN true
  ELSE list_has_any({_PARTS}[:-2], ['node_modules', 'target', 'dist']) END"""


@query(f"WITH {B.FILES} SELECT path FROM files WHERE {_IGNORED_SQL}")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.files(spark, sf_dir).where(ignored(F.col("path"), B.patterns(spark, sf_dir))).select("path")


@query(f"WITH {B.FILES} SELECT path, sha256(content) AS content_hash, strlen(content) AS bytes FROM files")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.files(spark, sf_dir)
    return files.select("path", T.content_hash("content").alias("content_hash"), F.octet_length("content").cast("long").alias("bytes"))


_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"


@query(
    f"""WITH {B.FILES}, e AS (SELECT path, {_EXT} AS x FROM files)
    SELECT path, CASE WHEN x = 'rs' THEN 'rust' WHEN x IN ('js', 'jsx') THEN 'javascript' WHEN x IN ('ts', 'tsx') THEN 'typescript'
      WHEN x = 'py' THEN 'python' WHEN x IN ('go', 'zig', 'swift') THEN x WHEN x IN ('c', 'h') THEN 'c'
      WHEN x IN ('cpp', 'cc', 'cxx', 'hpp', 'hh', 'hxx') THEN 'cpp' END AS language FROM e"""
)
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.files(spark, sf_dir).select("path", T.detected_language("path").alias("language"))


@query(f"WITH {B.NOTES} SELECT hash_id, component_type, component_name, file, language, to_json(tags)::VARCHAR AS tags, to_json(links)::VARCHAR AS links, created_at, updated_at, rtrim(coalesce(content, ''), chr(10)) AS content FROM anns")
def notes_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note written as text and read back."""
    back = A.parsed(A.rendered(B.annotations(spark, sf_dir)))
    return back.withColumns({"tags": F.to_json("tags"), "links": F.to_json("links")})


# --- lists and counts --------------------------------------------------------------------


@query(f"WITH {B.COMPS} SELECT DISTINCT language FROM comps")
def list_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).select("language").distinct()


@query(f'WITH {B.COMPS} SELECT language, "type", count(*) AS n FROM comps GROUP BY ALL')
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {B.COMPS} SELECT language, count(*) AS total, count(*) FILTER (death_status <> 'alive') AS dead,
    count(*) FILTER (errors + warnings + notes > 0) AS faulty FROM comps GROUP BY ALL"""
)
def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).groupBy("language").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("death_status") != "alive").alias("dead"),
        F.count_if(F.col("errors") + F.col("warnings") + F.col("notes") > 0).alias("faulty"),
    )


@query(f"WITH {B.COMPS} SELECT file, start_line, \"type\", name, id FROM comps WHERE death_status <> 'alive' OR errors + warnings + notes > 0")
def dead_or_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.components(spark, sf_dir).where((F.col("death_status") != "alive") | (F.col("errors") + F.col("warnings") + F.col("notes") > 0))
    return rows.select("file", "start_line", "type", "name", "id").orderBy("file", "start_line", "type", "name", "id")


@query(f"WITH {B.COMPS} SELECT id, name, file FROM comps WHERE language = 'rust' AND lower(\"type\") = 'fn'")
def list_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.narrowed(B.components(spark, sf_dir), "rs", "fn").select("id", "name", "file")


@query(
    f"""WITH {B.COMPS} SELECT id, {B.sql_ascii_lower('name')} AS lowered, CASE WHEN display_path = '' THEN 0
      WHEN language IN ('python', 'javascript', 'typescript', 'go', 'swift') THEN len(string_split(display_path, '.')) - 1
      ELSE len(string_split(display_path, '::')) - 1 END::INTEGER AS depth,
    CASE WHEN len(n) > 40 THEN substr(n, 1, 37) || '...' ELSE n END AS shown, CASE WHEN len(n) <= 12 THEN n ELSE substr(n, 1, 9) || '...' END AS short,
    string_split(id, '-')[1] AS prefix FROM (SELECT *, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS n FROM comps)"""
)
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).select(
        "id",
        T.ascii_lower("name").alias("lowered"),
        T.nesting_depth("display_path", "language").alias("depth"),
        T.display_name("name").alias("shown"),
        T.ellipsis("name", 12).alias("short"),
        T.id_prefix("id").alias("prefix"),
    )


@query(
    f"""WITH {B.COMPS}, {B.FILES}, l AS (
      SELECT path, unnest(x) AS code, generate_subscripts(x, 1) AS line FROM (
        SELECT path, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS x FROM files WHERE content <> ''))
    SELECT c.id, l.line::INTEGER AS line, l.code FROM comps c JOIN l ON l.path = c.file AND l.line BETWEEN c.start_line AND c.end_line"""
)
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered source lines of every component."""
    lines = B.files(spark, sf_dir).select("path", F.posexplode(T.lines("content")).alias("at", "code"))
    lines = lines.select("path", (F.col("at") + 1).alias("line"), "code")
    spans = B.components(spark, sf_dir).select("id", "file", "start_line", "end_line")
    inside = (F.col("path") == F.col("file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return lines.join(spans, inside).select("id", "line", "code")


# --- search ------------------------------------------------------------------------------


def _hit_sql(q: str) -> str:
    return " OR ".join(f"contains({B.sql_ascii_lower(c)}, '{q}')" for c in ("name", "id", "file"))


@query(f"WITH {B.COMPS} SELECT id, name, file FROM comps WHERE {_hit_sql('parse')}")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.substring_search(B.components(spark, sf_dir), "Parse").select("id", "name", "file")


@query(f"WITH {B.COMPS} SELECT id, name FROM comps WHERE language = 'rust' AND lower(\"type\") = 'fn' AND ({_hit_sql('buffer')})")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    language, kind, text = S.parse_terms(["rs", "fn", "buffer"])
    return S.substring_search(S.narrowed(B.components(spark, sf_dir), language, kind), text).select("id", "name")


def _pieces_sql(c: str) -> str:
    x = f"regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"[{B.sql_ascii_lower('p')} FOR p IN regexp_extract_all({x}, '[A-Za-z0-9]+') IF len(p) > 1 OR regexp_matches(p, '^[0-9]$')]"


def _name_tokens_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) = '' THEN [] ELSE list_append({_pieces_sql(f'trim({c})')}, {B.sql_ascii_lower(f'trim({c})')}) END"


_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_NAME_TOKENS = f"nt AS (SELECT DISTINCT id, unnest({_name_tokens_sql('name')}) AS token FROM comps)"
_TEXT_TOKENS = f"""words AS (SELECT hash_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS w FROM anns),
tt AS (SELECT DISTINCT hash_id, token FROM (SELECT hash_id, unnest({_name_tokens_sql('w')}) AS token FROM words) WHERE len(token) >= 2 AND token NOT IN ({_STOP}))"""


@query(f"WITH {B.COMPS}, {_NAME_TOKENS} SELECT id, token FROM nt")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).select("id", F.explode(K.name_tokens("name")).alias("token"))


@query(f"WITH {B.NOTES}, {_TEXT_TOKENS} SELECT hash_id, token FROM tt")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.annotations(spark, sf_dir).select("hash_id", F.explode(K.content_tokens("content")).alias("token"))


@query(
    f"""WITH {B.STORE}, p AS (SELECT DISTINCT path, {B.sql_ascii_lower('trim(path)')} AS l FROM store)
    SELECT DISTINCT path, token FROM (SELECT path, l AS token FROM p UNION ALL
      SELECT path, unnest([regexp_replace(trim(s), '^@+', '') FOR s IN string_split(l, '/')]) FROM p) WHERE token = {B.sql_ascii_lower('trim(path)')} OR len(token) >= 2"""
)
def link_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = B.store(spark, sf_dir).select("path").distinct()
    return paths.select("path", F.explode(K.link_tokens("path")).alias("token"))


@query(
    f"""WITH {B.COMPS}, {_NAME_TOKENS}, {B.NOTES}, {_TEXT_TOKENS}, rows AS (
      SELECT token, id AS component_id FROM nt UNION SELECT token, hash_id FROM tt)
    SELECT token, count(*) AS n_components, min(component_id) AS first_id, max(component_id) AS last_id FROM rows GROUP BY token"""
)
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token index built anew from names and the text of notes, by the notes' own ids; whole_token_index has the rest too."""
    notes = B.annotations(spark, sf_dir).select(F.col("hash_id").alias("component_id"), "content", F.array().cast("array<string>").alias("tags"))
    none = B.store(spark, sf_dir).where(F.lit(False))
    return S.token_sets(S.build_postings(B.components(spark, sf_dir), notes, none))


@query(
    f"""WITH {B.COMPS}, {_NAME_TOKENS}, {B.NOTES}, {_TEXT_TOKENS}, {B.RESOLVED}, {B.STORE}, {B.MERGED},
    paths AS (SELECT component_id, path FROM merged WHERE component_id IN (SELECT id FROM comps) UNION SELECT component_id, path FROM noted WHERE path IS NOT NULL),
    lowered AS (SELECT component_id, {B.sql_ascii_lower('trim(path)')} AS l FROM paths),
    rows AS (
      SELECT token, id AS component_id FROM nt UNION SELECT token, component_id FROM tt JOIN resolved USING (hash_id) WHERE component_id IS NOT NULL
      UNION SELECT * FROM (SELECT {B.sql_ascii_lower('trim(tag)')} AS token, component_id FROM (
        SELECT component_id, unnest(tags) AS tag FROM resolved WHERE component_id IS NOT NULL)) WHERE token <> ''
      UNION SELECT l, component_id FROM lowered
      UNION SELECT * FROM (SELECT unnest([regexp_replace(trim(s), '^@+', '') FOR s IN string_split(l, '/')]) AS token, component_id FROM lowered) WHERE len(token) >= 2)
    SELECT token, count(*) AS n_components, min(component_id) AS first_id, max(component_id) AS last_id FROM rows GROUP BY token"""
)
def whole_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token index built anew from names, notes with their tags and links, and the link store, by component."""
    components = B.components(spark, sf_dir)
    resolved = cut(A.resolve(B.annotations(spark, sf_dir), components).where("component_id IS NOT NULL"))
    noted = B.noted_links(resolved).where("path IS NOT NULL")
    merged = L.merge(B.store(spark, sf_dir), noted).join(components.select(F.col("id").alias("component_id")), "component_id", "left_semi")
    # Links of notes count even where the merge leaves them out.
    links = merged.select("component_id", "path").unionByName(noted.select("component_id", "path"))
    return S.token_sets(S.build_postings(components, resolved, links))


def _grams_sql(c: str) -> str:
    return f"[substr({c}, i, 3) FOR i IN range(1, len({c}) - 1)]"


@query(f"WITH {B.POSTINGS}, toks AS (SELECT DISTINCT token FROM post) SELECT DISTINCT unnest({_grams_sql('token')}) AS trigram, token FROM toks")
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trigram_index(B.postings(spark, sf_dir).select("token").distinct())


@query(f"WITH {B.POSTINGS}, toks AS (SELECT DISTINCT token FROM post) SELECT token FROM toks WHERE list_has_any({_grams_sql('token')}, ['par', 'ars', 'rse', 'ser'])")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.candidate_tokens(B.postings(spark, sf_dir).select("token").distinct(), "parser")


@query(
    f"""WITH {B.POSTINGS}, toks AS (SELECT DISTINCT token FROM post)
    SELECT token, levenshtein(token, 'bufer') AS distance FROM toks WHERE levenshtein(token, 'bufer') <= 2 AND regexp_full_match(token, '[ -~]*')"""
)
def edit_distance_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.postings(spark, sf_dir).select("token").distinct()
    rows = tokens.withColumn("distance", F.levenshtein("token", F.lit("bufer"), 2))
    return rows.where("distance >= 0").withColumn("distance", F.col("distance").cast("long"))


def _match_sql(q: str, t: str = "token") -> str:
    """(score, kind) of name_match as two SQL expressions."""
    k = f"CASE WHEN len({q}) <= 2 THEN -1 WHEN len({q}) <= 5 THEN 1 ELSE 2 END"
    d = f"levenshtein({t}, {q})"
    kind = f"CASE WHEN {t} = {q} THEN 'exact' WHEN starts_with({t}, {q}) THEN 'prefix' WHEN contains({t}, {q}) THEN 'substring' WHEN {d} <= {k} THEN 'fuzzy' END"
    score = f"CASE WHEN {t} = {q} THEN 1.0 WHEN starts_with({t}, {q}) THEN 0.7 WHEN contains({t}, {q}) THEN 0.4 ELSE 0.2 * (1 - {d} / greatest(len({t}), len({q}))::DOUBLE) END"
    return f"{kind} AS kind, {score} AS score"


#: DuckDB's levenshtein counts bytes: the SQL is compared over ASCII tokens, the queries see all.
_ASCII = "regexp_full_match(token, '[ -~]*')"


@query(
    f"""WITH {B.POSTINGS}, toks AS (SELECT DISTINCT token FROM post WHERE {_ASCII}), m AS (SELECT token, {_match_sql("'parse'")} FROM toks)
    SELECT token, kind, round(score, 6) AS score FROM m WHERE kind IS NOT NULL"""
)
def name_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.postings(spark, sf_dir).select("token").distinct()
    rows = tokens.withColumn("m", S.name_match(F.col("token"), F.lit("parse"))).where("m IS NOT NULL")
    return rows.select("token", "m.kind", F.round("m.score", 6).alias("score"))


def _stem_sql(w: str) -> str:
    """The stem rules as SQL; every replacement is written out by hand."""
    end = lambda s: f"ends_with({w}, '{s}')"
    cut_ = lambda n, add="": f"left({w}, len({w}) - {n})" + (f" || '{add}'" if add else "")
    single = lambda x: f"CASE WHEN len({x}) >= 2 AND right({x}, 1) = substr({x}, len({x}) - 1, 1) THEN left({x}, len({x}) - 1) ELSE {x} END"
    n = f"len({w})"
    cases = [
        (end("nesses"), cut_(6)), (end("ities"), cut_(5, "ity")), (end("ments"), cut_(1)), (end("ations"), cut_(1)), (end("ences"), cut_(1)),
        (end("ances"), cut_(1)), (end("ables"), cut_(1)), (end("ibles"), cut_(1)), (end("iers"), cut_(1)), (f"({end('ious')} OR {end('eous')})", w),
        (f"{end('ies')} AND {n} > 4", cut_(3, "y")), (f"{end('ation')} AND {n} > 6", cut_(5)),
        (f"({' OR '.join(map(end, ('ness', 'ment', 'able', 'ible', 'tion', 'sion')))}) AND {n} > 5", cut_(4)),
        (f"({end('ence')} OR {end('ance')})", w), (f"{end('ings')} AND {n} > 5", cut_(4)), (f"{end('ers')} AND {n} > 4", cut_(3)),
        (f"{end('ing')} AND {n} > 4", single(cut_(3))), (f"{end('ed')} AND {n} > 4 AND NOT {end('eed')}", single(cut_(2))),
        (f"(({end('er')} AND NOT {end('eer')}) OR {end('ly')}) AND {n} > 4", cut_(2)),
        (f"{end('es')} AND {n} > 4", f"CASE WHEN {' OR '.join(map(end, ('sses', 'shes', 'ches', 'xes')))} THEN {w} ELSE {cut_(2)} END"),
        (f"{end('s')} AND {n} > 4 AND NOT {end('ss')}", cut_(1)),
    ]
    body = " ".join(f"WHEN {c} THEN {r}" for c, r in cases)
    return f"CASE WHEN {n} < 4 THEN {w} ELSE CASE {body} ELSE {w} END END"


_STEMS = f"""toks AS (SELECT DISTINCT token FROM post WHERE {_ASCII}), s1 AS (SELECT token, {_stem_sql('token')} AS s FROM toks),
s2 AS (SELECT token, CASE WHEN len(token) >= 4 AND len(s) > 4 AND ends_with(s, 'th') THEN left(s, len(s) - 2) ELSE s END AS s FROM s1),
stems AS (SELECT token, CASE WHEN len(token) >= 4 AND len(s) > 4 AND ends_with(s, 'e') THEN left(s, len(s) - 1) ELSE s END AS stem FROM s2)"""


@query(f"WITH {B.POSTINGS}, {_STEMS} SELECT token, stem FROM stems")
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.postings(spark, sf_dir).select("token").distinct()
    return tokens.select("token", K.stem("token").alias("stem"))


def _prefix_sql(a: str, b: str) -> str:
    return f"len([i FOR i IN range(1, least(len({a}), len({b})) + 1) IF substr({a}, 1, i) = substr({b}, 1, i)])"


def _related(word: str) -> list[str]:
    roots = [r for r, w in K.alias_groups() if w == word]
    return sorted({w for r, w in K.alias_groups() if r in roots})


def _sibling_sql(q: str) -> str:
    words = ", ".join(f"'{w}'" for w in _related(q)) or "''"
    return f"""SELECT token, CASE WHEN token IN ({words}) THEN 0.45 ELSE 0.35 END + 0.20 * {_prefix_sql('token', f"'{q}'")} / greatest(len(token), len('{q}'))::DOUBLE AS score
      FROM stems WHERE token <> '{q}' AND (token IN ({words}) OR stem = (SELECT max(x) FROM (SELECT {{stem}} AS x)))"""


_STEM_OF = {"parse": "pars", "buffer": "buff", "parse_buffer": "parse_buff", "config": "config"}


@query(f"WITH {B.POSTINGS}, {_STEMS} SELECT token, round(score, 6) AS score FROM ({_sibling_sql('parse').format(stem=repr(_STEM_OF['parse']))})")
def stem_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.postings(spark, sf_dir).select("token").distinct()
    return S.siblings(tokens, "parse").select("token", F.round("score", 6).alias("score"))


_QUERY, _ASKED = "parse_buffer", ("parse", "buffer", "parse_buffer")
_FUZZY_PARTS = " UNION ALL ".join(
    f"""SELECT '{q}' AS asked, token, kind, score, ['name'] AS origins FROM (SELECT token, {_match_sql(f"'{q}'")} FROM toks
        WHERE list_has_any({_grams_sql('token')}, {_grams_sql(f"'{q}'")})) WHERE kind IS NOT NULL
    UNION ALL SELECT '{q}', token, 'annotation', 0.3, ['annotation'] FROM toks WHERE contains(token, '{q}')
    UNION ALL SELECT '{q}', token, 'stem', score, ['name', 'annotation'] FROM ({_sibling_sql(q).format(stem=repr(_STEM_OF[q]))})"""
    for q in _ASKED
)
_FUZZY = f"""wanted AS (SELECT asked, token, kind, score, unnest(origins) AS origin FROM ({_FUZZY_PARTS})),
ranks(kind, rank) AS (VALUES ('exact', 0), ('prefix', 1), ('substring', 2), ('stem', 3), ('fuzzy', 4), ('annotation', 5)),
best AS (SELECT w.asked, p.component_id, arg_max((w.score, w.kind, -r.rank), (w.score, -r.rank)) AS b
  FROM wanted w JOIN post p USING (token, origin) JOIN ranks r USING (kind) GROUP BY 1, 2),
hits AS (SELECT component_id, sum(b[1]) AS score, arg_max(b[2], (b[1], b[3])) AS match_type FROM best GROUP BY 1)"""
_ASCII_POST = B.POSTINGS.replace("WHERE", f"WHERE regexp_full_match({B.sql_id('token')}, '[ -~]*') AND", 1)


@query(f"WITH {_ASCII_POST}, {_STEMS}, {_FUZZY} SELECT component_id, round(score, 6) AS score, match_type FROM hits")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.fuzzy_search(B.postings(spark, sf_dir), _QUERY)
    return found.select("component_id", F.round("score", 6).alias("score"), "match_type").orderBy(F.desc("score"), "component_id")


@query(
    f"""WITH {_ASCII_POST}, {_STEMS}, {_FUZZY}, {B.COMPS}, pool AS (SELECT * FROM comps WHERE language = 'python'),
    plain AS (SELECT id, 2.0 AS score, 'exact' AS match_type, 0 AS match_rank FROM pool WHERE {_hit_sql('parse_buffer')})
    SELECT * FROM plain UNION ALL
    SELECT p.id, round(h.score, 6), h.match_type, r.rank FROM pool p JOIN hits h ON h.component_id = p.id JOIN ranks r ON r.kind = h.match_type
    WHERE p.id NOT IN (SELECT id FROM plain)"""
)
def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.merged_search(B.components(spark, sf_dir), B.postings(spark, sf_dir), _QUERY, language="py")
    return rows.select("id", F.round("score", 6).alias("score"), "match_type", "match_rank")


# --- links -------------------------------------------------------------------------------

_LINK_BASE = f"{B.COMPS}, {B.NOTES}, {B.RESOLVED}, {B.STORE}, {B.MERGED}"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = A.resolve(B.annotations(spark, sf_dir), B.components(spark, sf_dir))
    return L.merge(B.store(spark, sf_dir), B.noted_links(resolved))


@query(
    f"""WITH {B.STORE}, p AS (SELECT DISTINCT path, {B.sql_valid_path('path')} AS valid FROM store)
    SELECT path, valid, CASE WHEN starts_with(valid, '@') THEN regexp_extract(valid, '^@([^/]+)/', 1) END AS scope,
    regexp_replace(valid, '^@[^/]+/', '') AS topic, (len(string_split(valid, '/')) - 1)::INTEGER AS depth FROM p"""
)
def link_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.store(spark, sf_dir).select("path").distinct().withColumn("valid", L.valid_path("path"))
    return rows.select("path", "valid", L.scope("valid").alias("scope"), L.topic("valid").alias("topic"), L.path_depth("valid").alias("depth"))


@query(f"WITH {_LINK_BASE} SELECT component_id, path, pos::INTEGER AS pos FROM merged")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(
    f"""WITH {B.STORE}, {B.NOTES}, s AS (SELECT path FROM store UNION ALL SELECT unnest(links) FROM anns), v AS (SELECT {B.sql_valid_path('path')} AS path FROM s)
    SELECT min(path) AS path FROM v WHERE path IS NOT NULL GROUP BY {B.sql_ascii_lower('path')}"""
)
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = B.annotations(spark, sf_dir).select(F.explode("links").alias("path"))
    return L.distinct_paths(B.store(spark, sf_dir), notes)


@query(f"WITH {_LINK_BASE} SELECT {B.sql_ascii_lower('path')} AS path, count(DISTINCT component_id) AS components FROM merged GROUP BY 1 ORDER BY components DESC, path LIMIT 32")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_paths(_merged(spark, sf_dir))


@query(
    f"""WITH {_LINK_BASE}, keys AS (SELECT {B.sql_ascii_lower('trim(path)')} AS key, min(sort_key) AS sort_key FROM link_catalog GROUP BY 1),
    p AS (SELECT min(path) AS path FROM merged GROUP BY {B.sql_ascii_lower('path')})
    SELECT p.path, coalesce(k.sort_key, '') AS sort_key, (len(string_split(p.path, '/')) - 1)::INTEGER AS depth FROM p LEFT JOIN keys k ON k.key = {B.sql_ascii_lower('p.path')}"""
)
def ordered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "link_catalog").select(F.trim("path").alias("path"), "sort_key")
    rows = L.ordered_paths(L.distinct_paths(_merged(spark, sf_dir)), catalog)
    return rows.orderBy("sort_key", T.ascii_lower("path"))


_AUTH = f"({B.sql_ascii_lower('path')} = '{{q}}' OR starts_with({B.sql_ascii_lower('path')}, '{{q}}/'))"


@query(
    f"""WITH {_LINK_BASE}, h AS (SELECT component_id, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM merged
      WHERE {_AUTH.format(q='pradar_00000')} GROUP BY 1)
    SELECT c.id, c.name, c.file, h.paths FROM h JOIN comps c ON c.id = h.component_id"""
)
def links_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.show(_merged(spark, sf_dir), B.components(spark, sf_dir), "pradar_00000")
    return rows.select("id", "name", "file", F.array_join("paths", "|").alias("paths"))


@query(
    f"""WITH {_LINK_BASE} SELECT component_id, path, 'scoped' AS match_source FROM merged WHERE {_AUTH.format(q='@pradar_00000/jobs-zadrilim')}
    UNION ALL SELECT component_id, path, 'peer_local' FROM merged WHERE NOT starts_with(trim(path), '@') AND {_AUTH.format(q='jobs-zadrilim')}"""
)
def peer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = cut(_merged(spark, sf_dir))
    return L.peer_matches(merged, merged, "@pradar_00000/jobs-zadrilim")


@query(f"WITH {B.COMPS}, {B.STORE} SELECT component_id, path FROM store WHERE component_id NOT IN (SELECT id FROM comps)")
def orphan_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.orphan_memberships(B.store(spark, sf_dir), B.components(spark, sf_dir)).select("component_id", "path")


@query(
    f"""WITH {B.STORE}, {B.NOTES}, n AS (SELECT hash_id AS component_id, unnest(links) AS path FROM anns)
    SELECT n.component_id, n.path FROM n WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.component_id = n.component_id
      AND {B.sql_ascii_lower('trim(s.path)')} = {B.sql_ascii_lower('trim(n.path)')})"""
)
def compacted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = B.annotations(spark, sf_dir).select(F.col("hash_id").alias("component_id"), F.explode("links").alias("path"))
    return L.compact(noted, B.store(spark, sf_dir))


# --- notes -------------------------------------------------------------------------------


@query(f"WITH {B.COMPS}, {B.NOTES}, {B.RESOLVED} SELECT hash_id, component_id FROM resolved")
def resolved_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resolve(B.annotations(spark, sf_dir), B.components(spark, sf_dir)).select("hash_id", "component_id")


@query(f"WITH {B.COMPS}, {B.NOTES}, {B.RESOLVED} SELECT hash_id, component_name, unnest(links) AS path FROM resolved WHERE component_id IS NULL")
def orphan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orphans = A.orphans(A.resolve(B.annotations(spark, sf_dir), B.components(spark, sf_dir)))
    return orphans.select("hash_id", "component_name", F.explode("links").alias("path"))


@query(
    f"""WITH {B.COMPS}, {B.NOTES}, k AS (SELECT * FROM anns WHERE list_has_any(tags, ['keep', 'public_api', 'entrypoint']))
    SELECT DISTINCT c.id FROM comps c JOIN k ON k.hash_id = c.id OR (k.file = c.file AND k.component_name = c.name AND k.component_type = c."type"
      AND (k.language IS NULL OR k.language = c.language))"""
)
def kept_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = B.annotations(spark, sf_dir).where(A.keeps("tags"))
    return A.applies(B.components(spark, sf_dir), keep).select("id").distinct()


@query(
    f"""WITH {B.COMPS}, {B.NOTES}, {B.RESOLVED}, last AS (SELECT component_id, arg_max(content, (component_type, component_name, hash_id)) AS content
      FROM resolved WHERE component_id IS NOT NULL GROUP BY 1), f AS (SELECT component_id, trim(string_split(content, chr(10))[1]) AS l FROM last)
    SELECT c.id, CASE WHEN len(f.l) > 80 THEN substr(f.l, 1, 77) || '...' ELSE f.l END AS annotation_preview FROM comps c LEFT JOIN f ON f.component_id = c.id"""
)
def component_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = B.components(spark, sf_dir)
    resolved = A.resolve(B.annotations(spark, sf_dir), components)
    return A.with_notes(components, resolved).select("id", "annotation_preview")


@query(
    f"""WITH {B.COMPS}, {B.NOTES}, {B.RESOLVED}
    SELECT coalesce(r.component_id, r.hash_id) AS hash_id, r.hash_id AS old_id, coalesce(c.file, r.file) AS file, coalesce(c.language, r.language) AS language
    FROM resolved r LEFT JOIN comps c ON c.id = r.component_id"""
)
def reconciled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = B.components(spark, sf_dir)
    rows = A.reconciled(A.resolve(B.annotations(spark, sf_dir), components), components)
    return rows.select("hash_id", "old_id", "file", "language")


@query(
    f"""WITH {B.NOTES}, new AS (SELECT * FROM anns WHERE list_contains(tags, 'hot'))
    SELECT a.hash_id, a.created_at, CASE WHEN n.hash_id IS NULL THEN a.content ELSE 'reviewed' END AS content, len(a.tags)::INTEGER AS n_tags
    FROM anns a LEFT JOIN new n USING (hash_id)"""
)
def upserted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes tagged hot get a new body and no tags: the old tags and creation time stay."""
    old = B.annotations(spark, sf_dir)
    new = old.where(F.array_contains("tags", "hot")).withColumns(
        {"content": F.lit("reviewed"), "tags": F.array().cast("array<string>"), "created_at": F.lit("2026-01-01T00:00:00Z")}
    )
    return A.upserted(old, new).select("hash_id", "created_at", "content", F.size("tags").alias("n_tags"))


# --- diagnostics -------------------------------------------------------------------------


@query(f"WITH {B.LINES}, {B.DIAGS} SELECT file, line, severity, code, message, count(*) AS n FROM diagnostics GROUP BY ALL")
def parsed_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_lines(B.report_lines(spark, sf_dir)).groupBy("file", "line", "severity", "code", "message").agg(F.count(F.lit(1)).alias("n"))


_FILE_TAIL = "regexp_extract(file, '^[^/]+/(.*)$', 1)"
_LOCATED = f"""spans AS (SELECT id, {_FILE_TAIL} AS file, start_line, end_line FROM comps),
found AS (SELECT s.id, d.* FROM (SELECT DISTINCT * FROM diagnostics) d JOIN spans s ON s.file = d.file AND d.line BETWEEN s.start_line AND s.end_line)"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Reports name files below their tree's folder.
    spans = B.components(spark, sf_dir).withColumn("file", F.regexp_extract("file", "^[^/]+/(.*)$", 1))
    return D.located(D.parse_lines(B.report_lines(spark, sf_dir)).distinct(), spans)


@query(
    f"""WITH {B.COMPS}, {B.LINES}, {B.DIAGS}, {_LOCATED} SELECT id, count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'note') AS notes FROM found GROUP BY id"""
)
def diagnostic_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.faults(_located(spark, sf_dir))


@query(
    f"""WITH {B.COMPS}, {B.LINES}, {B.DIAGS}, {_LOCATED} SELECT id, string_agg(line || ' ' || severity || ' ' || message, '|'
      ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, line, severity, message) AS diagnostics FROM found GROUP BY id"""
)
def diagnostic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.transform("diagnostics", lambda d: F.concat_ws(" ", d["line"], d["severity"], d["message"]))
    return D.lists(_located(spark, sf_dir)).select("id", F.array_join(texts, "|").alias("diagnostics"))


@query(
    f"""WITH {B.LINES}, {B.DIAGS} SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'note') AS notes FROM diagnostics"""
)
def diagnostic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.totals(D.parse_lines(B.report_lines(spark, sf_dir)))


# --- sync --------------------------------------------------------------------------------

_SNAP = r"""cleaned AS (
  SELECT root, epoch_us(CAST(trim(generated_at) AS TIMESTAMPTZ)) AS t, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path,
         lower(file_hash) AS hash, received_at FROM file_snapshots WHERE root IS NOT NULL AND path IS NOT NULL),
latest AS (SELECT root, t, path, hash FROM cleaned WHERE t IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY root, t, path ORDER BY received_at DESC NULLS LAST, hash DESC NULLS LAST) = 1),
numbered AS (SELECT root, t, row_number() OVER (PARTITION BY root ORDER BY t DESC) AS back FROM (SELECT DISTINCT root, t FROM latest)),
current AS (SELECT l.path, l.hash AS file_hash FROM latest l JOIN numbered n USING (root, t) WHERE n.back = 1),
indexed AS (SELECT l.path, l.hash AS file_hash FROM latest l JOIN numbered n USING (root, t) WHERE n.back = 2)"""


def _last_two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(indexed, current): each root's last but one and last snapshot."""
    from pyspark.sql import Window

    rows = latest_rows(table(spark, sf_dir, "file_snapshots"))
    back = rows.select("root", "at").distinct().withColumn("back", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("at"))))
    at = lambda n: rows.join(back.where(F.col("back") == n), ["root", "at"], "left_semi").select("path", F.col("hash").alias("file_hash"))
    return at(2), at(1)


@query(
    f"""WITH {_SNAP} SELECT i.path, CASE WHEN c.path IS NULL THEN 'missing' ELSE 'changed' END AS drift
    FROM indexed i LEFT JOIN current c USING (path) WHERE c.path IS NULL OR i.file_hash IS DISTINCT FROM c.file_hash"""
)
def content_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.drift(*_last_two(spark, sf_dir))


@query(
    f"""WITH {_SNAP} SELECT path, 'added' AS change FROM current WHERE path NOT IN (SELECT path FROM indexed)
    UNION ALL SELECT path, 'removed' FROM indexed WHERE path NOT IN (SELECT path FROM current)"""
)
def sync_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.delta(*_last_two(spark, sf_dir), key="path")


_STATUS = f"""asked AS (SELECT path FROM current UNION SELECT path FROM indexed UNION SELECT path FROM files),
judged AS (SELECT a.path, c.path IS NOT NULL AS here, i.path IS NOT NULL AS known, i.file_hash IS NOT DISTINCT FROM c.file_hash AS same,
    {_IGNORED_SQL} AS ign, {_EXT} IN ('rs','js','jsx','ts','tsx','py','go','zig','swift','c','h','cpp','cc','cxx','hpp','hh','hxx') AS known_type
  FROM (SELECT DISTINCT path FROM asked) a LEFT JOIN current c USING (path) LEFT JOIN indexed i USING (path)),
reasons AS (SELECT path, here, CASE WHEN NOT here AND NOT known THEN 'path does not exist' WHEN here AND ign THEN 'ignored'
    WHEN here AND NOT known_type THEN 'unsupported file extension' WHEN here AND known AND same THEN 'file hash unchanged' END AS reason FROM judged)"""


@query(
    f"WITH {_SNAP}, {B.FILES}, {_STATUS.replace('c.path IS NOT NULL AS here', 'c.path IS NOT NULL AS here')} "
    "SELECT path, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN NOT here THEN 'removed' ELSE 'indexed' END AS status, reason FROM reasons"
)
def partial_sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, current = _last_two(spark, sf_dir)
    asked = indexed.select("path").unionByName(current.select("path")).unionByName(B.files(spark, sf_dir).select("path"))
    return Y.partial_status(asked, indexed, current, B.patterns(spark, sf_dir))


@query(
    f"""WITH {_SNAP}, p AS (SELECT i.path AS a, c.path AS b FROM indexed i FULL JOIN current c USING (path) WHERE i.path IS NULL OR c.path IS NULL OR i.file_hash IS DISTINCT FROM c.file_hash)
    SELECT DISTINCT coalesce(a, b) AS path FROM p UNION SELECT DISTINCT a || '.moved' FROM p WHERE b IS NULL"""
)
def status_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the status lines the last deliveries amount to; what is gone counts as renamed."""
    indexed, current = _last_two(spark, sf_dir)
    both = indexed.select("path", F.struct("file_hash").alias("a")).join(current.select("path", F.struct("file_hash").alias("b")), "path", "full")
    line = F.when(F.col("a").isNull(), F.concat(F.lit("?? "), "path")).when(F.col("b").isNull(), F.concat(F.lit("R  "), "path", F.lit(" -> "), "path", F.lit(".moved")))
    line = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat(F.lit(" M "), "path")).otherwise(line)
    changed = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a.file_hash").eqNullSafe(F.col("b.file_hash"))
    return Y.status_paths(both.where(changed).select(line.alias("raw")))


@query(
    f"""WITH {_SNAP}, {B.FILES}, dirty AS (SELECT DISTINCT path FROM (SELECT path FROM current UNION ALL SELECT path FROM indexed)),
    judged AS (SELECT d.path, i.path IS NOT NULL AS known, c.path IS NOT NULL AS here, {_IGNORED_SQL} AS ign,
      {_EXT} IN ('rs','js','jsx','ts','tsx','py','go','zig','swift','c','h','cpp','cc','cxx','hpp','hh','hxx') AS known_type
      FROM dirty d LEFT JOIN (SELECT DISTINCT path FROM indexed) i USING (path) LEFT JOIN (SELECT DISTINCT path FROM current) c USING (path))
    SELECT path FROM judged WHERE (here AND known_type AND NOT ign) OR (known AND NOT here)"""
)
def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, current = _last_two(spark, sf_dir)
    dirty = indexed.select("path").unionByName(current.select("path"))
    return Y.dirty_to_sync(dirty, indexed, current, B.patterns(spark, sf_dir))


@query(
    f"""WITH {B.COMPS}, {B.FILES}, {_SNAP}, n AS (SELECT count(*) AS n FROM indexed i LEFT JOIN current c USING (path) WHERE c.path IS NULL OR i.file_hash IS DISTINCT FROM c.file_hash)
    SELECT (SELECT count(*) FROM comps) AS components, (SELECT count(*) FROM files) AS files, n AS changed,
    CASE WHEN n = 0 THEN '' ELSE n || ' indexed file' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' changed on disk' END AS reason FROM n"""
)
def staleness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and what is out of date, one row."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    changed = count(Y.drift(*_last_two(spark, sf_dir)), "changed").first()["changed"]  # one number
    counts = count(B.components(spark, sf_dir), "components").first()["components"], count(B.files(spark, sf_dir), "files").first()["files"]
    row = spark.range(1).select(F.lit(counts[0]).cast("long").alias("components"), F.lit(counts[1]).cast("long").alias("files"), F.lit(changed).cast("long").alias("changed"))
    return row.withColumn("reason", T.staleness_reason(F.lit(False), F.col("changed")))


@query(
    f"""WITH {B.NOTES} SELECT hash_id, strftime(make_timestamp(epoch_us(CAST(trim(created_at) AS TIMESTAMPTZ))), '%Y-%m-%dT%H:%M:%SZ') AS created_utc FROM anns"""
)
def note_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.annotations(spark, sf_dir).select("hash_id", utc_text(instant("created_at")).alias("created_utc"))


@query("SELECT path, strftime(indexed_at, '%Y-%m-%dT%H:%M:%SZ') AS indexed_utc, count(*) AS n FROM source_files GROUP BY ALL")
def indexed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").select("path", utc_text(micros_of("indexed_at")).alias("indexed_utc"))
    return rows.groupBy("path", "indexed_utc").agg(F.count(F.lit(1)).alias("n"))


# --- extraction --------------------------------------------------------------------------


#: Declarations as the test tables write them, a line each, told by their words; the engine reads them by its grammars.
_DECLARED = f"""rows_ AS (SELECT path, language, unnest(x) AS line, generate_subscripts(x, 1) AS nr FROM (
    SELECT path, language, string_split(replace(content, chr(13), ''), chr(10)) AS x FROM files)),
before AS (SELECT *, trim(coalesce(lag(line) OVER (PARTITION BY path ORDER BY nr), 'x')) = '' AS after_blank FROM rows_),
words AS (SELECT *, [x FOR x IN string_split_regex(trim(line), '\\s+') IF x <> '' AND NOT (starts_with(x, 'pub(') AND language = 'rust')
    AND x NOT IN ('export', 'default', 'async', 'pub', 'static', 'public', 'private', 'final', 'override')] AS w,
    contains(trim(line), 'export') AS exported FROM before),
named AS (SELECT *, w[1] AS word, regexp_extract(coalesce(w[2], ''), '^[A-Za-z_$][A-Za-z0-9_$]*') AS name, coalesce(array_to_string(w[2:], ' '), '') AS rest FROM words),
kinds(language, word, sign) AS (VALUES
    ('rust', 'struct', ''), ('rust', 'enum', ''), ('rust', 'trait', ''), ('rust', 'fn', ''), ('rust', 'mod', ''),
    ('javascript', 'class', ''), ('javascript', 'function', ''), ('javascript', 'const', '='), ('javascript', 'let', '='), ('javascript', 'var', '='),
    ('typescript', 'class', ''), ('typescript', 'function', ''), ('typescript', 'const', '='), ('typescript', 'let', '='), ('typescript', 'var', '='),
    ('typescript', 'interface', ''), ('typescript', 'type', '='), ('python', 'class', ''), ('python', 'def', ''), ('go', 'const', ''), ('go', 'var', ''),
    ('swift', 'struct', ''), ('swift', 'class', ''), ('swift', 'enum', ''), ('swift', 'protocol', ''), ('swift', 'func', '('), ('swift', 'import', ''),
    ('zig', 'fn', ''), ('zig', 'var', ''), ('c', 'struct', ''), ('c', 'enum', ''), ('c', '#define', ''), ('cpp', 'struct', ''), ('cpp', 'enum', ''),
    ('cpp', 'class', ''), ('cpp', 'namespace', ''), ('cpp', '#define', '')),
plain AS (SELECT path, ltrim(word, '#') AS "type", name FROM named JOIN kinds USING (language, word)
    WHERE name <> '' AND (sign = '' OR starts_with(ltrim(substr(rest, len(name) + 1)), sign) OR (sign = '=' AND language IN ('zig') AND contains(rest, ':')))),
types AS (SELECT path, x AS "type", name FROM (SELECT *, unnest(CASE
    WHEN language = 'go' AND word = 'type' AND w[3] IN ('struct', 'interface') THEN CASE WHEN after_blank THEN [w[3], 'type'] ELSE [w[3]] END
    WHEN language = 'go' AND word = 'type' AND w[3] IS NOT NULL THEN ['type']
    WHEN language = 'zig' AND word = 'const' AND w[4] IN ('struct', 'enum', 'union') THEN [w[4]]
    WHEN language = 'zig' AND word = 'const' AND starts_with(coalesce(w[4], ''), '@import(') THEN ['import'] ELSE [] END) AS x FROM named)),
consts AS (SELECT path, 'const' AS "type", name FROM named n WHERE language = 'zig' AND word = 'const' AND NOT EXISTS (SELECT 1 FROM types t WHERE t.path = n.path AND t.name = n.name)),
methods AS (SELECT path, 'func' AS "type", regexp_extract(regexp_replace(rest, '^\\([^)]*\\) *', ''), '^[A-Za-z_][A-Za-z0-9_]*') AS name FROM named WHERE language = 'go' AND word = 'func'),
imports AS (
    SELECT path, 'use' AS "type", rtrim(rest, '; ') AS name FROM named WHERE language = 'rust' AND word = 'use' AND ends_with(rest, ';')
    UNION ALL SELECT path, 'import', trim(split_part(rest, '#', 1)) FROM named WHERE language = 'python' AND word = 'import'
    UNION ALL SELECT path, 'from', w[2] || ' -> ' || trim(split_part(array_to_string(w[4:], ' '), '#', 1)) FROM named WHERE language = 'python' AND word = 'from' AND w[3] = 'import'
    UNION ALL SELECT path, 'include', w[2] FROM named WHERE language IN ('c', 'cpp') AND word = '#include'),
bodies AS (SELECT path, 'fn' AS "type", regexp_extract(rtrim(split_part(line, '(', 1)), '([A-Za-z_][A-Za-z0-9_]*)$', 1) AS name FROM named
    WHERE language IN ('c', 'cpp') AND regexp_matches(line, '^[A-Za-z_]') AND ends_with(rtrim(line), '{{') AND contains(rtrim(split_part(line, '(', 1)), ' ') AND contains(line, '('))"""


@query(
    f"""WITH {B.FILES}, {_DECLARED} SELECT DISTINCT * FROM (SELECT * FROM plain UNION ALL SELECT * FROM types UNION ALL SELECT * FROM consts
    UNION ALL SELECT * FROM methods UNION ALL SELECT * FROM imports UNION ALL SELECT * FROM bodies)"""
)
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind and name declared in each file, in all languages."""
    return X.raw_components(B.files(spark, sf_dir)).select(F.col("file").alias("path"), "type", "name").distinct()


@query()
def extracted_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_ids(X.raw_components(B.files(spark, sf_dir))).select("id", "language", "type", "name", "file", "start_line", "end_line", "display_path")


@query(
    f"""WITH {B.COMPS}, o AS (SELECT *, count(*) OVER (PARTITION BY file, "type", name) AS n,
      row_number() OVER (PARTITION BY file, "type", name ORDER BY start_line, start_line, end_line, id) - 1 AS ordinal FROM comps)
    SELECT id AS known_as, regexp_replace(regexp_replace({B.sql_ascii_lower('"type"')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '-' ||
      substr(sha256(concat_ws('|', language, "type", name, file, CASE WHEN n > 1 THEN ordinal::VARCHAR END)), 1, 16) AS id FROM o"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids computed anew for the components of the index, by the engine's own rule."""
    rows = B.components(spark, sf_dir).withColumnRenamed("id", "known_as").withColumn("offset", F.col("start_line"))
    return X.with_ids(rows, ("offset", "start_line", "end_line", "known_as")).select("known_as", "id")


# --- graph -------------------------------------------------------------------------------


@query(
    f"""WITH {B.EDGES}, r AS (SELECT *, CASE kind WHEN 'same_file' THEN 4 WHEN 'import_resolved' THEN 3 WHEN 'qualified' THEN 3 WHEN 'import_disambiguated' THEN 2 ELSE 0 END AS k FROM edges)
    SELECT src, target, arg_max(kind, (k, -ascii(kind))) AS kind FROM r GROUP BY 1, 2"""
)
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merged_edges(B.edges(spark, sf_dir))


@query(
    f"""WITH {B.EDGES}, {B.COMPS}, k AS (SELECT DISTINCT src AS a, target AS b FROM edges WHERE src <> target AND src IN (SELECT id FROM comps) AND target IN (SELECT id FROM comps))
    SELECT a, b FROM k UNION SELECT b, a FROM k"""
)
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjacency(B.edges(spark, sf_dir), B.components(spark, sf_dir))


@query(
    f"""WITH {B.EDGES}, o AS (SELECT src AS id, count(DISTINCT target) AS uses FROM edges GROUP BY 1), i AS (SELECT target AS id, count(DISTINCT src) AS used_by FROM edges GROUP BY 1)
    SELECT coalesce(o.id, i.id) AS id, coalesce(uses, 0) AS uses, coalesce(used_by, 0) AS used_by FROM o FULL JOIN i ON o.id = i.id"""
)
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.uses(B.edges(spark, sf_dir))


_STEP = """SELECT r.root, {a} AS id, 1 AS depth FROM roots r JOIN edges e ON {j}"""


@query(
    f"""WITH {B.EDGES}, {B.NOTES}, roots AS (SELECT hash_id AS root FROM anns WHERE list_contains(tags, 'entrypoint')),
    b1 AS (SELECT DISTINCT root, target AS id FROM roots JOIN edges ON src = root WHERE target <> root),
    b2 AS (SELECT DISTINCT b1.root, target AS id FROM b1 JOIN edges ON src = b1.id WHERE target <> b1.root AND (b1.root, target) NOT IN (SELECT (root, id) FROM b1)),
    a1 AS (SELECT DISTINCT root, src AS id FROM roots JOIN edges ON target = root WHERE src <> root),
    a2 AS (SELECT DISTINCT a1.root, src AS id FROM a1 JOIN edges ON target = a1.id WHERE src <> a1.root AND (a1.root, src) NOT IN (SELECT (root, id) FROM a1))
    SELECT root, 'before' AS direction, id, 1 AS depth FROM b1 UNION ALL SELECT root, 'before', id, 2 FROM b2
    UNION ALL SELECT root, 'after', id, 1 FROM a1 UNION ALL SELECT root, 'after', id, 2 FROM a2"""
)
def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every noted entry point uses and is used by, two steps deep."""
    roots = B.annotations(spark, sf_dir).where(F.array_contains("tags", "entrypoint")).select(F.col("hash_id").alias("root"))
    return E.neighbourhood(B.edges(spark, sf_dir), roots, 2)


@query()
def inferred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.files(spark, sf_dir)
    return E.inferred_edges(cut(X.with_ids(X.raw_components(files))), files)


#: Bodies by line: the test tables have no literal or comment of several lines.
_INFERRED = f"""real AS (SELECT *, regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder FROM comps WHERE "type" NOT IN ({', '.join(repr(k) for k in X.IMPORT_KINDS)})),
texts AS (SELECT path, unnest(x) AS line, generate_subscripts(x, 1) AS nr FROM (SELECT path, string_split(content, chr(10)) AS x FROM files)),
bodies AS (SELECT r.id AS src, r.file, r.language, r.folder, CASE WHEN r.language = 'python'
    THEN regexp_replace(t.line, '#[^\\n]*|"(\\\\.|[^"\\\\])*"|''(\\\\.|[^''\\\\])*''', ' ', 'g')
    ELSE regexp_replace(t.line, '//[^\\n]*|/\\*.*?(\\*/|$)|"(\\\\.|[^"\\\\])*"|''(\\\\.|[^''\\\\])*''', ' ', 'g') END AS line
  FROM real r JOIN texts t ON t.path = r.file AND t.nr BETWEEN r.start_line AND r.end_line),
found AS (SELECT src, file, language, folder, unnest(regexp_extract_all(line, '(?:::)?\\s*[A-Za-z_][A-Za-z0-9_]*')) AS m FROM bodies),
words AS (SELECT src, file, language, folder, regexp_extract(m, '[A-Za-z_][A-Za-z0-9_]*') AS token, bool_or(starts_with(m, '::')) AS qualified FROM found GROUP BY ALL),
in_file AS (SELECT file, name AS token, arg_min(id, (len(file), file, id)) AS id FROM real GROUP BY 1, 2),
in_folder AS (SELECT language, folder, name AS token, arg_min(id, (len(file), file, id)) AS id FROM real GROUP BY 1, 2, 3),
anywhere AS (SELECT language, name AS token, arg_min(id, (len(file), file, id)) AS id, count(*) AS namesakes FROM real GROUP BY 1, 2),
imports AS (SELECT DISTINCT file, unnest(regexp_extract_all(name, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM comps WHERE "type" IN ({', '.join(repr(k) for k in X.IMPORT_KINDS)})),
inferred AS (SELECT w.src, CASE WHEN f.id IS NOT NULL THEN f.id WHEN i.token IS NOT NULL OR w.qualified THEN coalesce(d.id, a.id) END AS target,
    CASE WHEN f.id IS NOT NULL THEN 'same_file' WHEN a.namesakes > 1 THEN 'import_disambiguated' WHEN i.token IS NOT NULL THEN 'import_resolved' ELSE 'qualified' END AS kind
  FROM words w LEFT JOIN in_file f ON f.file = w.file AND f.token = w.token LEFT JOIN imports i ON i.file = w.file AND i.token = w.token
  LEFT JOIN in_folder d ON d.language = w.language AND d.folder = w.folder AND d.token = w.token LEFT JOIN anywhere a ON a.language = w.language AND a.token = w.token)"""


@query(
    f"""WITH {B.COMPS}, {B.FILES}, {_INFERRED}, r AS (SELECT *, CASE kind WHEN 'same_file' THEN 4 WHEN 'import_resolved' THEN 3 WHEN 'qualified' THEN 3 ELSE 2 END AS k
      FROM inferred WHERE target IS NOT NULL AND src <> target)
    SELECT src, target, arg_max(kind, (k, -ascii(kind))) AS kind FROM r GROUP BY 1, 2"""
)
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read anew from the bodies of the components the index holds."""
    return E.inferred_edges(B.components(spark, sf_dir), B.files(spark, sf_dir))


_ISLANDS = """nodes AS (SELECT id FROM comps),
near AS (SELECT src AS a, target AS b FROM edges WHERE src <> target AND src IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)
  UNION SELECT target, src FROM edges WHERE src <> target AND src IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
reached AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, n.b FROM reached r JOIN near n ON n.a = r.other),
islands AS (SELECT id, min(other) AS island FROM reached GROUP BY id)"""


@query(f"WITH RECURSIVE {B.COMPS}, {B.EDGES}, {_ISLANDS} SELECT * FROM islands")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = B.components(spark, sf_dir)
    return G.islands(components.select("id"), E.adjacency(B.edges(spark, sf_dir), components))


@query(f"WITH {B.COMPS} SELECT id FROM comps WHERE (name IN ('main', 'run') AND \"type\" = 'fn') OR NOT contains(file, '/') OR contains(file, 'cmd/')")
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).where(V.is_seed(files=("cmd/",))).select("id")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.liveness(
        B.components(spark, sf_dir), B.edges(spark, sf_dir), B.files(spark, sf_dir), B.annotations(spark, sf_dir), seed_files=("cmd/",)
    )


#: Every name is held against every line and every word, as the rules say it; names without ASCII words, which the tables lack, are left to the tests.
_LIVENESS = f"""{_ISLANDS},
marked AS (SELECT c.*, i.island, (name IN ('main', 'run') AND "type" = 'fn') OR NOT contains(file, '/') OR contains(file, 'cmd/') AS seed FROM comps c JOIN islands i USING (id)),
sizes AS (SELECT island, bool_or(seed) AS seeded, count(*) AS size, min((language, file, start_line, "type", name)) AS first FROM marked GROUP BY 1),
mains AS (SELECT island FROM sizes WHERE seeded UNION ALL
  (SELECT island FROM sizes WHERE NOT (SELECT bool_or(seeded) FROM sizes) ORDER BY size DESC, first DESC LIMIT 1)),
stated AS (SELECT *, island IN (SELECT island FROM mains) AS in_main FROM marked),
used AS (SELECT src, target FROM edges WHERE src <> target),
facts AS (SELECT s.*, id IN (SELECT src FROM used UNION SELECT target FROM used) AS linked, coalesce(d.doomed, false) AS doomed FROM stated s
  LEFT JOIN (SELECT u.target, NOT bool_or(coalesce(p.in_main, false)) AS doomed FROM used u LEFT JOIN stated p ON p.id = u.src GROUP BY 1) d ON d.target = s.id),
judged AS (SELECT *, "type" NOT IN ({', '.join(repr(k) for k in X.IMPORT_KINDS)}) AND (NOT in_main OR NOT linked) AS candidate FROM facts),
cand AS (SELECT *, regexp_full_match(name, '[A-Za-z0-9_]+') AS single, regexp_extract(name, '[A-Za-z0-9_]+') AS word FROM judged WHERE candidate),
texts AS (SELECT path, strlen(content) AS bytes, line, nr FROM (SELECT path, content, unnest(x) AS line, generate_subscripts(x, 1) AS nr FROM (
  SELECT path, content, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM files))),
spoken AS (SELECT DISTINCT path, bytes, nr, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS word FROM texts),
shown AS (SELECT DISTINCT file FROM judged WHERE NOT candidate),
outside AS (
  SELECT id FROM cand WHERE single AND name IN (SELECT word FROM spoken WHERE path IN (SELECT file FROM shown))
  UNION SELECT c.id FROM cand c JOIN spoken s ON s.word = c.word JOIN texts t ON t.path = s.path AND t.nr = s.nr
    WHERE NOT c.single AND contains(t.line, c.name) AND t.path IN (SELECT file FROM shown)),
inside AS (SELECT c.id FROM cand c JOIN spoken s ON s.word = c.word AND s.path = c.file JOIN texts t ON t.path = s.path AND t.nr = s.nr
  WHERE (c.single OR contains(t.line, c.name)) AND t.bytes <= 512000 AND t.nr NOT BETWEEN c.start_line AND c.end_line),
kept AS (SELECT c.id FROM cand c JOIN anns k ON list_has_any(k.tags, ['keep', 'public_api', 'entrypoint']) AND (k.hash_id = c.id OR (k.file = c.file AND k.component_name = c.name
  AND k.component_type = c."type" AND (k.language IS NULL OR k.language = c.language)))),
known AS (SELECT j.*, f.path IS NOT NULL AND content IS NOT NULL AND trim(name) <> '' AS searched, coalesce(strlen(f.content) > 512000, false) AS large,
    j.id IN (SELECT id FROM outside UNION SELECT id FROM inside) AS rescued, j.id IN (SELECT id FROM kept) AS kept FROM judged j LEFT JOIN files f ON f.path = j.file),
live AS (SELECT id, CASE WHEN NOT candidate OR rescued OR kept THEN 'alive' WHEN searched AND large THEN 'maybe_dead' WHEN searched THEN 'definitely_dead' ELSE 'probably_dead' END AS death_status,
  CASE WHEN NOT candidate OR rescued THEN '' WHEN kept THEN 'annotated_keep' ELSE array_to_string(list_filter([CASE WHEN NOT in_main THEN 'not_reachable_from_seeds' END,
    CASE WHEN NOT linked THEN 'no_dependency_edges' END, CASE WHEN doomed THEN 'all_parents_dead_candidates' END, CASE WHEN searched AND large THEN 'scan_capped' END,
    CASE WHEN searched AND NOT large THEN 'no_local_scope_references' END], lambda x: x IS NOT NULL), '|') END AS reasons FROM known)"""


@query(f"WITH RECURSIVE {B.COMPS}, {B.EDGES}, {B.FILES}, {B.NOTES}, {_LIVENESS} SELECT * FROM live")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("id", "death_status", F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH RECURSIVE {B.COMPS}, {B.EDGES}, {B.FILES}, {B.NOTES}, {_LIVENESS} SELECT death_status, count(*) AS components FROM live GROUP BY 1")
def liveness_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tier_counts(_live(spark, sf_dir))


@query(
    f"""WITH {_LINK_BASE}, {B.FILES} SELECT (SELECT count(*) FROM comps) AS components, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM anns) AS annotations,
    (SELECT count(*) FROM merged) AS links, (SELECT count(DISTINCT language) FROM comps) AS languages"""
)
def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = B.components(spark, sf_dir)
    parts = [
        components.agg(F.count(F.lit(1)).alias("components"), F.countDistinct("language").alias("languages")),
        B.files(spark, sf_dir).agg(F.count(F.lit(1)).alias("files")),
        B.annotations(spark, sf_dir).agg(F.count(F.lit(1)).alias("annotations")),
        _merged(spark, sf_dir).agg(F.count(F.lit(1)).alias("links")),
    ]
    row = {k: v for part in parts for k, v in part.first().asDict().items()}  # five numbers
    return spark.range(1).select(*(F.lit(row[c]).cast("long").alias(c) for c in ("components", "files", "annotations", "links", "languages")))


@query(
    f"""WITH {B.COMPS}, l AS (SELECT string_split(file, '/')[1] AS project, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM comps GROUP BY 1),
    p AS (SELECT DISTINCT string_split(path, '/')[1] AS project FROM source_files) SELECT p.project, coalesce(l.languages, '') AS languages FROM p LEFT JOIN l USING (project)"""
)
def project_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project with the languages of its index, none where it has no index."""
    top = lambda c: F.substring_index(c, "/", 1).alias("project")
    languages = B.components(spark, sf_dir).groupBy(top("file")).agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    projects = table(spark, sf_dir, "source_files").select(top("path")).distinct()
    return projects.join(languages, "project", "left").select("project", F.coalesce("languages", F.lit("")).alias("languages"))


# --- lists, orders and output ----------------------------------------------------------------


@query(f"WITH {B.COMPS} SELECT id, name, file FROM comps WHERE id = (SELECT min(id) FROM comps)")
def component_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = B.components(spark, sf_dir)
    least = components.agg(F.min("id").alias("id")).first()["id"]  # one id
    return W.component(components, least).select("id", "name", "file")


@query(
    f"""WITH {B.COMPS}, r AS (SELECT *, death_status <> 'alive' AS dead, errors + warnings + notes > 0 AS faulty FROM comps WHERE language = 'rust')
    SELECT 'languages' AS mode, language AS item, NULL::BIGINT AS n FROM (SELECT DISTINCT language FROM comps)
    UNION ALL SELECT 'language_summary', "type", count(*) FROM r GROUP BY "type" UNION ALL SELECT 'language_all', id, NULL FROM r
    UNION ALL SELECT 'language_and_type', id, NULL FROM r WHERE "type" = 'struct' UNION ALL SELECT 'dead', id, NULL FROM r WHERE dead
    UNION ALL SELECT 'dead_or_faulty', id, NULL FROM r WHERE dead OR faulty"""
)
def list_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of a list."""
    components = B.components(spark, sf_dir)
    asked = {
        "languages": {}, "language_summary": {"language": "rs"}, "language_all": {"language": "rs", "everything": True}, "language_and_type": {"language": "rs", "kind": "Struct"},
        "dead": {"language": "rs", "dead": True}, "dead_or_faulty": {"language": "rs", "dead": True, "fault": True},
    }
    parts = []
    for name, options in asked.items():
        mode, rows = W.listing(components, **options)
        item = {"languages": "language", "language_summary": "type"}.get(mode, "id")
        n = F.col("n") if mode == "language_summary" else F.lit(None).cast("long")
        parts.append(rows.select(F.lit(name).alias("mode"), F.col(item).alias("item"), n.alias("n")))
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {_ASCII_POST}, {_STEMS}, {_FUZZY}, {_LINK_BASE}, {B.FILES}, pool AS (SELECT * FROM comps WHERE language = 'python'),
    plain AS (SELECT id, 2.0::DOUBLE AS score, 0 AS match_rank FROM pool WHERE {_hit_sql('parse_buffer')}),
    found AS (SELECT * FROM plain UNION ALL SELECT p.id, round(h.score, 6), r.rank FROM pool p JOIN hits h ON h.component_id = p.id JOIN ranks r ON r.kind = h.match_type
      WHERE p.id NOT IN (SELECT id FROM plain)),
    linked AS (SELECT * FROM comps WHERE id IN (SELECT component_id FROM merged WHERE {_AUTH.format(q='pradar_00000')}))
    SELECT 'index' AS list, id, row_number() OVER (ORDER BY language, file, start_line, "type", name, id) - 1 AS position FROM comps
    UNION ALL SELECT 'list', id, row_number() OVER (ORDER BY file, start_line, "type", name, id) - 1 FROM comps
    UNION ALL SELECT 'hits', id, row_number() OVER (ORDER BY match_rank, score DESC, language, file, start_line, "type", name, id) - 1 FROM found JOIN comps USING (id)
    UNION ALL SELECT 'links', id, row_number() OVER (ORDER BY file, start_line, name, id) - 1 FROM linked
    UNION ALL SELECT 'notes', hash_id, row_number() OVER (ORDER BY component_type NULLS FIRST, component_name NULLS FIRST, hash_id) - 1 FROM anns"""
)
def output_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row stands in the lists that are shown: the index, a full list, merged hits, components of a link path, notes."""
    components = B.components(spark, sf_dir)
    found = S.merged_search(components, B.postings(spark, sf_dir), _QUERY, language="py").withColumn("score", F.round("score", 6))
    linked = L.show(_merged(spark, sf_dir), components, "pradar_00000")
    parts = [
        ("index", W.positions(components, W.HIT_ORDER)),
        ("list", W.positions(components, W.LIST_ORDER)),
        ("hits", W.positions(found, W.MERGED_ORDER)),
        ("links", W.positions(linked, W.LINK_ORDER)),
        ("notes", W.positions(B.annotations(spark, sf_dir).withColumn("id", F.col("hash_id")), W.NOTE_ORDER)),
    ]
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("list"), "id", "position") for name, rows in parts))


@query(
    f"""WITH {B.COMPS}, {B.FILES}, {B.LINES}, {B.DIAGS}, {_LOCATED},
    hashes AS (SELECT path, lower(trim(file_hash)) AS h FROM source_files WHERE path IS NOT NULL {B._sql_newest('path', 'indexed_at', ['language', 'content', 'file_hash'])}),
    said AS (SELECT file, line, string_agg(severity || ' ' || message, '|' ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, severity, message) AS said FROM (SELECT DISTINCT * FROM diagnostics) GROUP BY 1, 2),
    l AS (SELECT path, unnest(x) AS code, generate_subscripts(x, 1) AS line FROM (
      SELECT path, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS x FROM files WHERE content <> ''))
    SELECT c.id, l.line::INTEGER AS line, l.code, coalesce(s.said, '') AS said, f.content IS NULL OR h.h IS DISTINCT FROM sha256(f.content) AS file_changed
    FROM comps c JOIN l ON l.path = c.file AND l.line BETWEEN c.start_line AND c.end_line JOIN files f ON f.path = c.file
    LEFT JOIN said s ON s.file = regexp_extract(c.file, '^[^/]+/(.*)$', 1) AND s.line = l.line LEFT JOIN hashes h ON h.path = c.file"""
)
def shown_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component's source by line with the messages on it, and whether its file is another than the indexed one."""
    said = D.parse_lines(B.report_lines(spark, sf_dir)).distinct()
    rows = W.shown(B.components(spark, sf_dir), B.files(spark, sf_dir), said, B.file_hashes(spark, sf_dir), F.regexp_extract("path", "^[^/]+/(.*)$", 1))
    texts = F.transform("diagnostics", lambda d: F.concat_ws(" ", d["severity"], d["message"]))
    return rows.select("id", "line", "code", F.array_join(texts, "|").alias("said"), "file_changed")


@query(
    f"""WITH {B.COMPS} SELECT '{{"id":"' || id || '","start_line":' || start_line || ',"death_status":"' || death_status || '"}}' AS value FROM comps WHERE death_status IS NOT NULL"""
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.components(spark, sf_dir).where("death_status IS NOT NULL").select("id", "start_line", "death_status")
    return stores.as_json(rows)


@query(
    f"""WITH {B.STORE} SELECT component_id, path, (row_number() OVER (PARTITION BY component_id ORDER BY pos NULLS FIRST, path) - 1)::INTEGER AS pos FROM store"""
)
def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link store written as JSON and read back; places are counted anew."""
    lines = stores.link_lines(B.store(spark, sf_dir), "2026-01-01T00:00:00Z")
    back = lines.select(F.from_json("value", "component_id string, paths array<string>").alias("x"))
    return back.select("x.component_id", F.posexplode("x.paths").alias("pos", "path"))


@query(
    f"""WITH {B.FILES}, t AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM files), w AS (SELECT path, regexp_extract(line, '^[ \\t]*') AS lead FROM t)
    SELECT path, max(len(lead) + 3 * (len(lead) - len(replace(lead, chr(9), ''))))::INTEGER AS deepest FROM w GROUP BY path"""
)
def deepest_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.files(spark, sf_dir).select("path", F.explode(F.split("content", "\n", -1)).alias("line"))
    return lines.groupBy("path").agg(F.max(T.indent_width("line")).alias("deepest"))


@query(
    f"""WITH {B.COMPS}, s AS (SELECT id, start_line / 4.0 AS s, end_line - start_line + 1 AS n FROM comps)
    SELECT id, CASE WHEN s >= 60 THEN floor(s / 60)::BIGINT || 'm ' || printf('%.2f', s - 60 * floor(s / 60)) || 's' ELSE printf('%.2fs', s) END AS took,
    n || ' line' || CASE WHEN n = 1 THEN '' ELSE 's' END AS lines FROM s"""
)
def readable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.components(spark, sf_dir)
    return rows.select("id", T.duration(F.col("start_line") / 4.0).alias("took"), T.plural(F.col("end_line") - F.col("start_line") + 1, "line").alias("lines"))


@query(
    f"""WITH RECURSIVE {B.COMPS}, {B.EDGES}, {_ISLANDS}, m AS (SELECT island, count(*) AS size, min((language, file, start_line, "type", name)) AS first FROM islands JOIN comps USING (id) GROUP BY 1)
    SELECT island FROM m ORDER BY size DESC, first DESC LIMIT 1"""
)
def largest_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reachability starts if nothing seeds it."""
    components = B.components(spark, sf_dir)
    island = G.islands(components.select("id"), E.adjacency(B.edges(spark, sf_dir), components))
    return V.main_islands(components.join(island, "id").withColumn("seed", F.lit(False)))
