"""Tokens of names, texts and link paths; all native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.cleaning import as_col
from quern.functions.text import ascii_lower

#: Words that never become tokens of a text (fixed values).
STOP_WORDS = (
    "a an and are as at be been being but by do does for from if in into is it its no not of on or our out over per so such than "
    "that the their them there these they this those to under up via was we were will with"
).split()
#: Pieces of an identifier: an acronym before a word, a word, an acronym, a number.
_PIECE = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def _pieces(text: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(text, F.lit(f"({_PIECE})"), 1), ascii_lower)
    return F.filter(parts, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))


def name_tokens(c: Column | str) -> Column:
    """Tokens of a name: its pieces in lower case, then the whole of it.

    Single letters are dropped, digits are not; each token once, in order.
    Blank names have none.
    """
    text = F.trim(as_col(c))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(_pieces(text), F.array(ascii_lower(text))))
    )


def content_tokens(c: Column | str) -> Column:
    """Tokens of a text: those of each word, without single signs and stop words."""
    words = F.regexp_extract_all(as_col(c), F.lit("([A-Za-z0-9_]+)"), 1)
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    tokens = F.flatten(F.transform(words, lambda w: F.concat(_pieces(w), F.array(ascii_lower(w)))))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))


def link_tokens(c: Column | str) -> Column:
    """Tokens of a link path: the whole in lower case and its parts of two signs and more, without @."""
    path = ascii_lower(F.trim(as_col(c)))
    parts = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.trim(s), "^@+", ""))
    return F.array_distinct(F.concat(F.array(path), F.filter(parts, lambda s: F.length(s) >= 2)))


def trigrams(c: Column | str) -> Column:
    """Distinct runs of three characters, sorted; none in shorter words."""
    word = as_col(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3)))
    return F.when(F.length(word) >= 3, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<string>"))


#: Suffix rules in order: suffix, what replaces it, the least length of the word
#: they apply to, whether a doubled last letter is then made single (fixed
#: values). The first whose suffix and length fit decides.
STEM_RULES = [
    ("nesses", "", 4, False), ("ities", "ity", 4, False), ("ments", "ment", 4, False), ("ations", "ation", 4, False),
    ("ences", "ence", 4, False), ("ances", "ance", 4, False), ("ables", "able", 4, False), ("ibles", "ible", 4, False),
    ("iers", "ier", 4, False), ("ious", "ious", 4, False), ("eous", "eous", 4, False), ("ies", "y", 5, False),
    ("ation", "", 7, False), ("ness", "", 6, False), ("ment", "", 6, False), ("able", "", 6, False), ("ible", "", 6, False),
    ("tion", "", 6, False), ("sion", "", 6, False), ("ence", "ence", 4, False), ("ance", "ance", 4, False),
    ("ings", "", 6, False), ("ers", "", 5, False), ("ing", "", 5, True), ("(?<!e)ed", "", 5, True),
    ("(?<!e)er", "", 5, False), ("ly", "", 5, False), ("cies", "cy", 5, False), ("(?<=ss|sh|ch|x)es", "es", 5, False),
    ("es", "", 5, False), ("(?<!s)s", "", 5, False),
]


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by_rules(word: Column) -> Column:
    out = word
    for suffix, instead, least, undouble in reversed(STEM_RULES):
        cut = F.regexp_replace(word, suffix + "$", instead)
        if undouble:
            cut = F.regexp_replace(cut, r"(.)\1$", "$1")
        out = F.when(word.rlike(suffix + "$") & (F.length(word) >= least), cut).otherwise(out)
    return out


def stem(c: Column | str) -> Column:
    """English stem of a lower-case word; words under four signs stay."""
    cut = _bound(as_col(c), _by_rules)
    cut = _bound(cut, lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("th")), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))
    cut = _bound(cut, lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("e")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.when(F.length(as_col(c)) < 4, as_col(c)).otherwise(cut)


#: Roots and words taken as forms of them (fixed values).
ROOT_ALIASES = {
    "config": "configuration configure configured configs",
    "dead": "death deaths",
    "delete": "deletion deleted deleting",
    "create": "creation created creating",
    "execute": "execution executed executing",
    "migrate": "migration migrated migrating migrations",
    "validate": "validation validated validating",
    "authenticate": "authentication authenticated auth",
    "authorize": "authorization authorized auth",
    "connect": "connection connected connections",
    "depend": "dependency dependencies dependent dependence",
    "register": "registration registered",
    "generate": "generation generated generator",
    "transform": "transformation transformed",
    "compile": "compilation compiled compiler",
    "serialize": "serialization serialized serializer",
    "deserialize": "deserialization deserialized",
    "optimize": "optimization optimized optimizer",
    "initialize": "initialization initialized init",
    "resolve": "resolution resolved resolver",
    "define": "definition defined definitions",
    "describe": "description described",
    "inject": "injection injected",
    "parse": "parser parsing parsed",
    "render": "renderer rendering rendered",
    "dispatch": "dispatcher dispatched dispatching",
    "subscribe": "subscription subscribed subscriber",
    "emit": "emitter emitting emitted emission",
    "destruct": "destruction destructor",
    "construct": "construction constructor",
    "compose": "composition composed composer",
    "assert": "assertion assertions asserted",
    "allocate": "allocation allocated allocator",
    "encrypt": "encryption encrypted",
    "decrypt": "decryption decrypted",
    "navigate": "navigation navigated",
    "iterate": "iteration iterator iterable",
    "mutate": "mutation mutable mutated",
    "aggregate": "aggregation aggregated aggregator",
    "annotate": "annotation annotated annotations",
    "deprecate": "deprecation deprecated",
    "synchronize": "synchronization synchronized sync",
}


def alias_groups() -> list[tuple[str, str]]:
    """(root, word) of every group, the root among its own words."""
    return [(root, word) for root, words in ROOT_ALIASES.items() for word in (root, *words.split())]
