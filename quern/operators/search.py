"""Exact and ranked search over components by tokens, trigrams, stems and aliases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ascii_lower, normal_language
from quern.functions.tokens import alias_groups, content_tokens, link_tokens, name_tokens, stem, trigrams
from quern.session import cut

#: Scores of the kinds of match, and their order where scores are equal (fixed values).
MATCH_RANK = {"exact": 0, "prefix": 1, "substring": 2, "stem": 3, "fuzzy": 4, "annotation": 5}
EXACT, PREFIX, SUBSTRING, ANNOTATION, FUZZY, ALIAS, STEM, SHARED = 1.0, 0.7, 0.4, 0.3, 0.2, 0.45, 0.35, 0.20
#: Kinds of components a search may be narrowed to (fixed values).
COMPONENT_TYPES = (
    "struct enum fn trait impl mod use class function const let var interface type export def async import from func protocol "
    "actor extension init deinit typealias subscript"
).split() + ["async def"]


def substring_search(components: DataFrame, query: str) -> DataFrame:
    """Components whose name, id or file contains the query, ASCII case aside."""
    q = F.lit(query).cast("string")
    q = ascii_lower(q)
    hit = reduce(lambda a, b: a | b, (F.contains(ascii_lower(c), q) for c in ("name", "id", "file")))
    return components.where(hit)


def parse_terms(terms: list[str]) -> tuple[str | None, str | None, str]:
    """(language, type, query): one term is the query, two are language and query, more may name a type."""
    if not terms:
        raise ValueError("a search needs a query")
    if len(terms) == 1:
        return None, None, terms[0]
    language = normal_language(terms[0])
    if len(terms) == 2:
        return language, None, terms[1]
    kind = terms[1].lower()
    kind, rest = (kind, terms[2:]) if kind in COMPONENT_TYPES else (None, terms[1:])
    query = " ".join(rest)
    if not query.strip():
        raise ValueError("a search needs a query")
    return language, kind, query


def narrowed(components: DataFrame, language: str | None = None, kind: str | None = None) -> DataFrame:
    if language:
        components = components.where(F.col("language") == normal_language(language))
    if kind:
        components = components.where(ascii_lower("type") == kind.lower())
    return components


def build_postings(components: DataFrame, annotations: DataFrame, links: DataFrame) -> DataFrame:
    """(token, component_id, origin): distinct postings of names, notes and links.

    components: (id, name); annotations: (component_id, content, tags); links:
    (component_id, path), those of notes among them. A tag is one token, in
    lower case. Notes and links count as origin annotation.
    """
    names = components.select(F.explode(name_tokens("name")).alias("token"), F.col("id").alias("component_id"), F.lit("name").alias("origin"))
    notes = annotations.select(F.explode(content_tokens("content")).alias("token"), "component_id", F.lit("annotation").alias("origin"))
    tags = annotations.select(F.explode("tags").alias("token"), "component_id", F.lit("annotation").alias("origin"))
    tags = tags.withColumn("token", ascii_lower(F.trim("token"))).where("token <> ''")
    paths = links.select(F.explode(link_tokens("path")).alias("token"), "component_id", F.lit("annotation").alias("origin"))
    return names.unionByName(notes).unionByName(tags).unionByName(paths).distinct()


def token_sets(postings: DataFrame) -> DataFrame:
    """(token, n_components, first_id, last_id) over all origins; ids stay rows, not arrays."""
    return postings.groupBy("token").agg(
        F.countDistinct("component_id").alias("n_components"),
        F.min("component_id").alias("first_id"),
        F.max("component_id").alias("last_id"),
    )


def trigram_index(tokens: DataFrame) -> DataFrame:
    """(trigram, token) of a table of tokens."""
    return tokens.select(F.explode(trigrams("token")).alias("trigram"), "token").distinct()


def candidate_tokens(tokens: DataFrame, query: str) -> DataFrame:
    """Tokens sharing a trigram with the query token; all of them where none does."""
    shared = F.arrays_overlap(trigrams("token"), trigrams(F.lit(query)))
    hits = tokens.where(shared)
    # Whether any token shares one is a single boolean.
    return hits if not hits.isEmpty() else tokens


def name_match(token: Column, query: Column) -> Column:
    """struct(score, kind) of a name token against a query token; null for no match.

    Equal, then beginning with, then containing it; else within an edit
    distance of 1 (queries of 3 to 5 signs) or 2 (longer ones).
    """
    longest = F.greatest(F.length(token), F.length(query))
    bounded = lambda k: F.levenshtein(token, query, k)
    distance = F.when(F.length(query) <= 2, F.lit(-1)).when(F.length(query) <= 5, bounded(1)).otherwise(bounded(2))
    case = lambda s, k: F.struct(s.cast("double").alias("score"), F.lit(k).alias("kind"))
    return (
        F.when(token == query, case(F.lit(EXACT), "exact"))
        .when(F.startswith(token, query), case(F.lit(PREFIX), "prefix"))
        .when(F.contains(token, query), case(F.lit(SUBSTRING), "substring"))
        .when(distance >= 0, case(FUZZY * (1 - distance / longest), "fuzzy"))
    )


def shared_prefix(a: Column, b: Column) -> Column:
    """How many characters two words begin with in common."""
    return F.aggregate(
        F.sequence(F.lit(1), F.least(F.length(a), F.length(b))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n),
    )


def alias_table(spark) -> DataFrame:
    """(root, word): a fixed table of some 170 rows."""
    return spark.createDataFrame(alias_groups(), "root string, word string")


def token_table(postings: DataFrame) -> DataFrame:
    """(token, stem, grams): the distinct tokens of an index with what searches compare."""
    tokens = postings.select("token").distinct()
    return tokens.select("token", stem("token").alias("stem"), trigrams("token").alias("grams"))


def _related_words(query: str) -> list[str]:
    """Words of the alias groups a word is in."""
    groups = [root for root, word in alias_groups() if word == query]
    return sorted({word for root, word in alias_groups() if root in groups})


def _sibling(query: str, same_stem: Column) -> tuple[Column, Column]:
    """Whether a token is a sibling of the query token, and its score if it is."""
    words = _related_words(query)
    token, q = F.col("token"), F.lit(query)
    related = token.isin(words) if words else F.lit(False)
    base = F.when(related, ALIAS).otherwise(STEM)
    score = base + SHARED * shared_prefix(token, q) / F.greatest(F.length(token), F.length(q))
    return (token != q) & (related | same_stem), score


def siblings(tokens: DataFrame, query: str) -> DataFrame:
    """(token, score): tokens with the query's stem or in one of its alias groups, the query itself left out."""
    related, score = _sibling(query, stem("token") == stem(F.lit(query)))
    return tokens.where(related).select("token", score.alias("score"))


def _rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in MATCH_RANK.items() for x in kv)), kind)


def _best(rows: DataFrame, key: list[str]) -> DataFrame:
    order = F.struct(F.col("score"), -_rank(F.col("kind")))
    return rows.groupBy(*key).agg(F.max_by(F.struct("score", "kind"), order).alias("b")).select(*key, "b.score", "b.kind")


@dataclass(frozen=True)
class SearchIndex:
    """What a search reads: postings (token, component_id, origin), tokens (token, stem) and grams (trigram, token)."""

    postings: DataFrame
    tokens: DataFrame
    grams: DataFrame


def search_index(postings: DataFrame) -> SearchIndex:
    """The tables of an index over postings, to be saved and loaded again."""
    tokens = postings.select("token").distinct()
    return SearchIndex(postings, tokens.select("token", stem("token").alias("stem")), trigram_index(tokens))


def fuzzy_search(postings: DataFrame | SearchIndex, query: str) -> DataFrame:
    """(component_id, score, match_type): ranked hits of a query over an index.

    postings: (token, component_id, origin), or a whole index: then only the
    rows of the query's trigrams and stems are read, where the token table is
    gone through otherwise. The query's tokens are matched one
    by one; a component's score is the sum of its best match for each, its
    match_type that of the best of them. The tokens of the index are filtered
    before the postings are joined, so only matching tokens' postings move.
    """
    index = postings if isinstance(postings, SearchIndex) else None
    postings = postings.postings if index else postings
    spark = postings.sparkSession
    asked = spark.range(1).select(name_tokens(F.lit(query)).alias("t")).first()["t"]
    if not asked:
        return postings.select("component_id", F.lit(0.0).alias("score"), F.lit("").alias("match_type")).limit(0)
    # The query's few words; every expression is built once, however many there are.
    facts = {r["w"]: r for r in spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("w")).select("w", stem("w").alias("stem"), trigrams("w").alias("grams")).collect()}
    stems = {i: facts[w]["stem"] for i, w in enumerate(asked)}
    grams = sorted({g for r in facts.values() for g in r["grams"]})
    words = sorted({w for q in asked for w in _related_words(q)})
    # More than the siblings of each word, so that every column is looked at once.
    related = F.col("stem").isin(list(stems.values())) | F.col("token").isin(words)
    if index is None:
        every = token_table(postings)
        pool = every.where(F.arrays_overlap("grams", F.array(*map(F.lit, grams)).cast("array<string>")) | related)
    else:
        every = index.tokens.withColumn("grams", trigrams("token"))
        near = index.grams.where(F.col("trigram").isin(grams)).select("token").distinct()
        pool = every.join(near, "token", "left_semi").unionByName(every.where(related)).distinct()
    tokens = cut(pool)
    shares = {w: F.arrays_overlap("grams", trigrams(F.lit(w))) for w in asked}
    # One boolean per word of the query: whether any token shares a trigram. Where none does, all tokens are looked at.
    known = tokens.agg(*(F.coalesce(F.max(shares[w]), F.lit(False)).alias(str(i)) for i, w in enumerate(asked))).first()
    if not all(known):
        tokens = every
    token, both = F.col("token"), F.array(F.lit("name"), F.lit("annotation"))
    found = []
    for i, word in enumerate(asked):
        q = F.lit(word)
        near = shares[word] if known[str(i)] else F.lit(True)
        name = name_match(token, q)
        related, score = _sibling(word, F.col("stem") == stems[i])
        item = lambda s, k, o, q=q: F.struct(q.alias("asked"), s.cast("double").alias("score"), k.alias("kind"), o.alias("origins"))
        found += [
            F.when(near & name.isNotNull(), item(name["score"], name["kind"], F.array(F.lit("name")))),
            F.when(near & F.contains(token, q), item(F.lit(ANNOTATION), F.lit("annotation"), F.array(F.lit("annotation")))),
            F.when(related, item(score, F.lit("stem"), both)),
        ]
    wanted = tokens.select("token", F.explode(F.filter(F.array(*found), lambda m: m.isNotNull())).alias("m"))
    wanted = wanted.select("token", "m.asked", "m.score", "m.kind", F.explode("m.origins").alias("origin"))
    hits = _best(postings.join(wanted, ["token", "origin"]), ["asked", "component_id"])
    order = F.struct(F.col("score"), -_rank(F.col("kind")))
    return hits.groupBy("component_id").agg(F.sum("score").alias("score"), F.max_by("kind", order).alias("match_type"))


def merged_search(components: DataFrame, postings: DataFrame | SearchIndex, query: str, language: str | None = None, kind: str | None = None) -> DataFrame:
    """Substring hits first (score 2, exact), then ranked hits among the other components.

    The order of the result is given by match_rank, score (descending) and the
    component's place; sort by them for output.
    """
    pool = narrowed(components, language, kind)
    plain = substring_search(pool, query).withColumn("score", F.lit(2.0)).withColumn("match_type", F.lit("exact")).withColumn("match_rank", F.lit(0))
    others = pool.join(plain.select("id"), "id", "left_anti")
    ranked = others.join(fuzzy_search(postings, query).withColumnRenamed("component_id", "id"), "id")
    ranked = ranked.withColumn("match_rank", _rank(F.col("match_type")))
    return plain.unionByName(ranked.select(plain.columns))

