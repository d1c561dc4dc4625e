"""Which components are reachable, referred to, kept or dead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import lines
from quern.operators import annotations as A
from quern.operators.edges import adjacency
from quern.operators.extraction import IMPORT_KINDS
from quern.operators.graph import islands
from quern.session import cut

#: Larger files are not searched for mentions inside them (a rule of the data model).
SCAN_LIMIT = 512_000
_WORD = "([A-Za-z0-9_]+)"
#: Characters of names, and those operators are made of.
_LETTER, _SIGN = r"[\p{L}\p{M}\p{N}_$]", r"[-=<>!+*/%&|^~?@]"


def is_seed(files: tuple[str, ...] = (), names: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> Column:
    """Where reachability starts: functions main and run, files in the root folder, and what the settings name."""
    tests = [
        F.col("name").isin("main", "run") & (F.col("type") == "fn"),
        ~F.contains("file", F.lit("/")),
        *(F.contains("file", F.lit(f)) for f in files),
    ]
    if names:
        tests.append(F.col("name").isin(*names))
    if types:
        tests.append(F.col("type").isin(*types))
    return reduce(lambda a, b: a | b, tests)


def main_islands(members: DataFrame) -> DataFrame:
    """(island): those with a seed; if there is none, the largest, the last in index order where several are.

    members: (island, seed, language, file, start_line, type, name).
    """
    order = F.struct("language", "file", "start_line", "type", "name")
    sizes = members.groupBy("island").agg(F.max("seed").alias("seeded"), F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))
    seeded = sizes.where("seeded").select("island")
    if not seeded.isEmpty():
        return seeded
    return sizes.orderBy(F.desc("size"), F.desc("first")).limit(1).select("island")


def _mentions(candidates: DataFrame, files: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids mentioned in one of the shown files, and ids mentioned in their own file outside their lines.

    candidates: (id, name, file, start_line, end_line); shown: (path). Lines
    become words, which go on without their lines: only words some candidate
    is named by, joined by equality. A name of several words, or with other
    signs in it, is found by its first two words and then looked for as a
    whole, in the lines these stand in.
    """
    wanted = candidates.select("id", "name", "file", "start_line", "end_line").where(F.col("name").rlike(_WORD))
    single = F.col("name").rlike("^[A-Za-z0-9_]+$")
    rows = files.select(F.col("path"), F.octet_length("content").alias("bytes"), F.posexplode(lines("content")).alias("at", "line"))
    words = F.regexp_extract_all("line", F.lit(_WORD), 1)
    place = ("path", "bytes", "at")

    def found(keys: Column, known: DataFrame) -> DataFrame:
        return rows.select(*place, F.explode(F.array_distinct(keys)).alias("key")).join(known.select("key").distinct(), "key", "left_semi")

    named = wanted.where(single).withColumn("key", F.col("name"))
    spoken = cut(found(words, named))
    plain = named.join(spoken.join(shown, "path", "left_semi").select("key").distinct(), "key", "left_semi").select("id")
    inside = named.join(spoken.withColumnRenamed("path", "file"), ["file", "key"])
    apart = (F.col("bytes") <= SCAN_LIMIT) & ~(F.col("at") + 1).between(F.col("start_line"), F.col("end_line"))
    inside = inside.where(apart).select("id")

    # The second word counts where the name goes on after it: then it is whole in the line too.
    pair = F.regexp_extract("name", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]+([A-Za-z0-9_]+)[^A-Za-z0-9_]", 1)
    second = F.regexp_extract("name", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]+([A-Za-z0-9_]+)[^A-Za-z0-9_]", 2)
    key = F.when(second != "", F.concat_ws(" ", pair, second)).otherwise(F.regexp_extract("name", _WORD, 1))
    phrases = wanted.where(~single).withColumn("key", key)
    # Whether there is any such name is one boolean.
    if phrases.isEmpty():
        return plain, inside.distinct()
    names = phrases.select("name", "key").distinct()
    some = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), some), F.slice(words, F.lit(2), some), lambda a, b: F.concat_ws(" ", a, b))
    hits = found(F.concat(words, pairs), names).join(rows.select("path", "at", "line"), ["path", "at"])
    hits = cut(hits.join(names, "key").where(F.contains("line", F.col("name"))).select(*place, "name"))
    elsewhere = phrases.join(hits.join(shown, "path", "left_semi").select("name").distinct(), "name", "left_semi").select("id")
    within = phrases.join(hits.withColumnRenamed("path", "file"), ["file", "name"]).where(apart).select("id")
    return plain.unionByName(elsewhere), inside.unionByName(within).distinct()


def _symbol_mentions(candidates: DataFrame, files: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_mentions of names without an ASCII word character, such as operators, $ and names in other scripts.

    They are contained in a line as they stand, with no neighbour that would
    make another name of them: a sign of operators beside such a sign, a letter
    or digit beside a letter. Distinct names are matched, by their first
    character, and joined back to the candidates.
    """
    none = candidates.select("id").limit(0)
    wanted = candidates.where((F.trim("name") != "") & ~F.col("name").rlike(_WORD))
    # Whether there is any such name is one boolean.
    if wanted.isEmpty():
        return none, none
    edge = lambda c: F.when(c.rlike(_LETTER), F.lit(_LETTER)).when(c.rlike(_SIGN), F.lit(_SIGN))
    name = F.trim("name")
    left, right = edge(F.substring(name, 1, 1)), edge(F.right(name, F.lit(1)))
    bound = lambda opening, c: F.coalesce(F.concat(F.lit(opening), c, F.lit(")")), F.lit(""))
    quoted = F.regexp_replace(name, r"([^\p{L}\p{M}\p{N}\s])", r"\\$1")
    names = wanted.select(F.col("name"), F.substring(name, 1, 1).alias("sign"), F.concat(bound("(?<!", left), quoted, bound("(?!", right)).alias("rx")).distinct()
    rows = files.select(F.col("path"), F.octet_length("content").alias("bytes"), F.posexplode(lines("content")).alias("at", "line"))
    spoken = rows.select("*", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([^A-Za-z0-9_\s])"), 1))).alias("sign"))
    hits = cut(spoken.join(names, "sign").where(F.regexp("line", F.col("rx"))).select("path", "bytes", "at", "name"))
    outside = wanted.join(hits.join(shown, "path", "left_semi").select("name").distinct(), "name", "left_semi").select("id")
    inside = wanted.join(hits.withColumnRenamed("path", "file"), ["file", "name"])
    inside = inside.where((F.col("bytes") <= SCAN_LIMIT) & ~(F.col("at") + 1).between(F.col("start_line"), F.col("end_line")))
    return outside, inside.select("id").distinct()


def liveness(
    components: DataFrame,
    edges: DataFrame,
    files: DataFrame,
    annotations: DataFrame,
    seed_files: tuple[str, ...] = (),
    seed_names: tuple[str, ...] = (),
    seed_types: tuple[str, ...] = (),
) -> DataFrame:
    """(id, death_status, reasons) of every component.

    components: (id, language, type, name, file, start_line, end_line); edges:
    (src, target); files: (path, content); annotations as in
    operators.annotations. Candidates are components outside the main islands
    or without edges, imports aside. One is alive if its name is mentioned in
    a file that has a component in use, in its own file outside its lines, or
    if a keep annotation fits it; else it is definitely_dead, maybe_dead where
    its file was too large to search, or probably_dead where there was nothing
    to search.
    """
    components = cut(components)
    near = cut(adjacency(edges, components))
    island = islands(components.select("id"), near)
    marked = components.join(island, "id").withColumn("seed", is_seed(seed_files, seed_names, seed_types))
    marked = cut(marked)
    mains = main_islands(marked)
    in_main = marked.join(mains.withColumn("in_main", F.lit(True)), "island", "left").withColumn("in_main", F.coalesce("in_main", F.lit(False)))
    used = edges.where("src <> target")
    linked = used.select(F.col("src").alias("id")).unionByName(used.select(F.col("target").alias("id"))).distinct()
    parents = used.select(F.col("target").alias("id"), F.col("src").alias("_p")).distinct()
    state = in_main.select(F.col("id").alias("_p"), F.col("in_main").alias("_pm"))
    doomed = parents.join(state, "_p", "left").groupBy("id").agg((~F.max(F.coalesce("_pm", F.lit(False)))).alias("doomed"))
    facts = in_main.join(linked.withColumn("linked", F.lit(True)), "id", "left").join(doomed, "id", "left")
    facts = cut(facts.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn(
        "candidate", ~F.col("type").isin(*IMPORT_KINDS) & (~F.col("in_main") | ~F.coalesce("linked", F.lit(False)))
    ))

    candidates = facts.where("candidate")
    shown = facts.where("NOT candidate").select(F.col("file").alias("path")).distinct()
    outside, inside = _mentions(candidates, files, shown)
    more_outside, more_inside = _symbol_mentions(candidates, files, shown)
    outside, inside = outside.unionByName(more_outside), inside.unionByName(more_inside)
    kept = A.applies(candidates.select(components.columns), annotations.where(A.keeps("tags"))).select("id").distinct()
    there = files.select(F.col("path").alias("file"), (F.octet_length("content") > SCAN_LIMIT).alias("large"))
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    rows = (
        facts.join(there, "file", "left")
        .join(flag(outside, "outside"), "id", "left")
        .join(flag(inside, "inside"), "id", "left")
        .join(flag(kept, "kept"), "id", "left")
    )
    searched = (F.trim("name") != "") & F.col("large").isNotNull()
    rescued = F.col("outside") | F.col("inside")
    status = (
        F.when(~F.col("candidate") | F.coalesce(rescued, F.lit(False)) | F.coalesce("kept", F.lit(False)), "alive")
        .when(searched & F.col("large"), "maybe_dead")
        .when(searched, "definitely_dead")
        .otherwise("probably_dead")
    )
    why = F.filter(
        F.array(
            F.when(~F.col("in_main"), "not_reachable_from_seeds"),
            F.when(~F.col("linked"), "no_dependency_edges"),
            F.when(F.coalesce("doomed", F.lit(False)), "all_parents_dead_candidates"),
            F.when(searched & F.col("large"), "scan_capped"),
            F.when(searched & ~F.col("large"), "no_local_scope_references"),
        ),
        lambda r: r.isNotNull(),
    )
    none = F.array().cast("array<string>")
    reasons = F.when(~F.col("candidate") | F.coalesce(rescued, F.lit(False)), none).when(F.col("kept"), F.array(F.lit("annotated_keep"))).otherwise(why)
    return rows.select("id", status.alias("death_status"), reasons.alias("reasons"))


def tier_counts(live: DataFrame) -> DataFrame:
    """(death_status, components)"""
    return live.groupBy("death_status").agg(F.count(F.lit(1)).alias("components"))
