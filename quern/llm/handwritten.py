"""Generated, minified, third-party and data files among source files.

Three kinds of evidence are weighed. Notices in comments are found by one
multi-pattern automaton over the file's comments; the shape of the code (the
same function over and over, lines without white space, nothing but literals,
identifiers that carry a library's name) comes from the whole content; path
rules and ignore patterns only ever add to evidence from the content, they
never decide alone. What a file can't show by itself, that it is a copy of a
library whose notice was cut off, comes from the other files by joins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import lookup_join, spread
from quern.session import cut
from quern.sources.ignore import ignored

# --- fixed values: notices, in lower case ---------------------------------------

#: Openings of a generation notice. 2: enough by itself; 1: needs a confirmation.
GENERATED_OPENINGS = {
    "code generated by": 2,
    "autogenerated": 2,
    "auto-generated": 2,
    "automatically generated": 2,
    "@generated by": 2,
    "this file was created automatically": 2,
    "this file was automatically": 2,
    "this file is automatically": 2,
    "this file was generated": 2,
    "this file is generated": 2,
    "this file has been generated": 2,
    "this code was generated": 2,
    "this is a generated file": 2,
    "generated file": 2,
    "generated by": 1,
    "generated from": 1,
    "@generated": 1,
    "output of": 1,
    "produced by": 1,
    "created by": 1,
    "built from": 1,
    "diese datei wurde automatisch": 2,
    "diese datei wurde generiert": 2,
    "automatisch erzeugt": 2,
    "automatisch generiert": 2,
    "erzeugt von": 1,
    "erzeugt aus": 1,
    "fichier produit par": 2,
    "fichier généré": 2,
    "ce fichier a été": 1,
    "ce fichier est généré": 2,
    "généré automatiquement": 2,
    "généré par": 1,
    "archivo generado": 2,
    "fichero generado": 2,
    "este archivo": 1,
    "este fichero": 1,
    "generado automáticamente": 2,
    "generado por": 1,
}
#: What confirms an opening in the same comment line.
GENERATED_CONFIRMATIONS = (
    "do not edit",
    "do not modify",
    "don't edit",
    "not be edited",
    "changes will be lost",
    "will be overwritten",
    "instead",
    "to refresh",
    "to regenerate",
    "automatically",
    "nicht von hand",
    "nicht ändern",
    "nicht bearbeiten",
    "automatisch",
    "ne pas modifier",
    "ne pas éditer",
    "automatiquement",
    "no editar",
    "no modificar",
    "automáticamente",
)
#: Signs of a third-party banner. 2: enough by itself; 1: two different ones are needed.
THIRD_PARTY_SIGNS = {
    "standalone build": 2,
    "upstream:": 2,
    "vendored from": 2,
    "local changes are tracked": 1,
    "permission is granted": 1,
    "permission is hereby granted": 1,
    "all rights reserved": 1,
    "released under": 1,
    "licensed under": 1,
    "license": 1,
    "licence": 1,
    "redistribution and use": 1,
    "contributors": 1,
    "the authors": 1,
    "copyright": 1,
    "(c)": 1,
    "©": 1,
}

#: Folders third-party code is often kept in, and marks of generated and minified files in names.
VENDOR_FOLDERS = r"(?:^|/)(?:vendor|vendored|vendors|third[-_]?party|3rd(?:party)?|extern|external|externals|deps|contrib|bundled|node_modules|bower_components|site-packages)/"
GENERATED_PATHS = r"(?:^|/)(?:generated|gen|codegen|proto|target/out|build/out|autogen)/|(?:\.pb|\.gen|\.g|_pb2|_pb2_grpc|_auto|_stubs|_generated|\.generated|\.designer)\.\w+$"
LOCKFILES = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum|[^/]*\.lock)$"
MINIFIED_PATHS = r"(?:[.\-](?:min|prod|bundle)|\.[0-9a-f]{8})\.(?:js|css|mjs)$|(?:^|/)(?:dist|static|public/js|docs/js|web/assets|build/out)/"

# --- patterns of code ------------------------------------------------------------

_COMMENT = re.compile(r"\s*+(?://++[/!]?|#++(?!\s*(?:include|define|if|ifdef|ifndef|endif|pragma|undef|else|elif)\b)|/\*++!?|\*++(?!/)|--+|;++|<!--)")
_HASH_COMMENT = re.compile(r"\s*+#++")
_SLASH_COMMENT = re.compile(r"\s*+(?://++[/!]?|/\*++!?|\*++(?!/)|#!)")
_SHORT = r'"(?:\\.|[^"\\\n])*+["\n]?|' + r"'(?:\\.|[^'\\\n])*+['\n]?"
_BLOCK = r"//[^\n]*|(?P<c>/\*.*?(?:\*/|\Z))"
_TRIPLE = r'"""(?:\\.|(?!""").)*+(?:"""|\Z)'
#: Per kind of source: what begins a comment line, and what is passed over whole: comments (c: of several lines) and strings (m: of several lines).
_SYNTAX = {
    "hash": (_HASH_COMMENT, re.compile(rf"#[^\n]*|(?P<m>{_TRIPLE}|{_TRIPLE.replace(chr(34), chr(39))})|{_SHORT}", re.S)),
    "slash": (_SLASH_COMMENT, re.compile(rf"{_BLOCK}|(?P<m>{_TRIPLE}|R\"(?P<d>[^(\s\"]{{0,16}})\(.*?(?:\)(?P=d)\"|\Z)|`(?:\\.|[^`\\])*+(?:`|\Z))|{_SHORT}", re.S)),
    "rust": (_SLASH_COMMENT, re.compile(_BLOCK + r'|(?P<m>r(?P<d>#{0,8})".*?(?:"(?P=d)|\Z)|"(?:\\.|[^"\\])*+(?:"|\Z))', re.S)),
}
#: Without one of these no string or comment has several lines; in Rust any string may.
_OPENERS = {"hash": ('"""', "'''"), "slash": ('"""', "`", "/*", 'R"'), "rust": ('r"', "r#", "/*")}
_KIND_OF = {"py": "hash", "pyi": "hash", "rs": "rust"} | dict.fromkeys("js jsx mjs cjs ts tsx go swift zig c h cc cpp cxx hpp hh hxx java kt scala".split(), "slash")
_FUNCTION = re.compile(
    r"(?:\b(?:fn|func|function|def|sub|fun)\s+|^(?:static\s+|inline\s+|const\s+|extern\s+)*(?:unsigned\s+)?(?:int|void|double|char|long|short|float|bool|size_t|auto|u?int\d+_t)\s+\**)"
    r"([A-Za-z_]\w*)\s*\(",
    re.M,
)
_DEFINED = re.compile(
    r"^[ \t]*(?:(?:export|default|public|pub(?:\([^)]*\))?|static|async|abstract|final|extern|inline)\s+)*"
    r"(?:fn|func|function|def|class|struct|enum|trait|type|interface|union|protocol|actor|mod|namespace|impl|(?:const|let|var)(?=\s+\w+\s*[:=])|#\s*define)\s+([A-Za-z_]\w*)"
    r"|^(?:static\s+|inline\s+|const\s+)*(?:int|void|double|char|long|short|float|bool|size_t|auto)\s+\**([A-Za-z_]\w*)\s*[(\[=]",
    re.M,
)
_PARTS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DATA_LINE = re.compile(
    r"""[\s\[\]{}(),;:]*+(?:(?>[+\-]?0[xX][0-9a-fA-F]++|[+\-]?\d[\d_.]*+(?:[eE][+\-]?\d++)?|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|true|false|null|None|nil)(?:[\s\[\]{}(),;:]++|$))++$"""
)
#: A name, perhaps with its type, that long rows of literals are assigned to.
_ASSIGNED = re.compile(r"\s*+[A-Za-z_$][\w\s$.:<>\[\];&*,'-]{0,200}=\s*(?:new\s+)?[\w.:!&]{0,80}(?:\[\w*\])?\s*(?=[\[{(])")
_VALUE = re.compile(r"""[+\-]?\d[\w.]*+|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|true|false|null|None|nil""")
#: So many values make an assignment on one line one of data.
ROW_VALUES = 16
#: Less than so much code or data shows nothing.
LEAST_DATA, LEAST_BODY = 240, 60
#: A file so much of whose functions follow one pattern is generated.
REPEATED = 0.6
_BLOB = re.compile(r"""["'`][A-Za-z0-9+/=_\\x-]{160,}["'`]""")
#: A file's claim to belong to the code base it stands in.
_OWN = re.compile(r"(?:part of|belongs to|teil von|partie de|parte de)(?: the)? (\w+) (?:itself|selbst|même|mismo)")
_LIBRARY = (
    re.compile(r"https?://[^\s/]+/(?:[\w.-]+/)*([\w-]+)"),
    re.compile(r"(?:the|by) ([\w-]+) (?:contributors|authors|developers|project|team)\b"),
    re.compile(r"authors of ([\w-]+)"),
    re.compile(r"\d ([\w-]+) project\b"),
    re.compile(r"^([a-z][\w-]*) v?\d+\.\d+"),
)

FEATURES = (
    "path string, top string, generated double, minified double, data double, banner double, library string, "
    "prefix string, prefix_share double, prefix_count int, body string"
)


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for group, words in (("open", GENERATED_OPENINGS), ("confirm", dict.fromkeys(GENERATED_CONFIRMATIONS, 1)), ("third", THIRD_PARTY_SIGNS)):
        for word, weight in words.items():
            kinds = found.get(word, [])
            found.add_word(word, [*kinds, (group, word, weight)])
    found.make_automaton()
    return found


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(name)]


def _functions(content: str):
    """(name, parameters) of a text's functions; parameters run to the first closing bracket, however far."""
    at = 0
    while m := _FUNCTION.search(content, at):
        end = content.find(")", m.end())
        if end < 0:
            return
        yield m.group(1), content[m.end() : end]
        at = end + 1


def repetition(content: str) -> float:
    """Share of a file's functions that follow one pattern, 0..1.

    Either their names end in numbers that go up in equal steps, or the names
    differ in one part only and the parameters are the same. Fewer than five
    functions show no pattern, unless all of four do.
    """
    functions = list(_functions(content))
    if len(functions) < 4:
        return 0.0
    names = [_parts(name) for name, _ in functions]
    numbers = [int(n[-1]) for n in names if n and n[-1].isdigit()]
    steps = Counter(b - a for a, b in zip(numbers, numbers[1:], strict=False) if b > a)
    ladder = (max(steps.values()) + 1) / len(functions) if steps and len(numbers) >= 4 else 0.0
    frames: Counter = Counter()
    for parts, (_, parameters) in zip(names, functions, strict=True):
        for i in range(len(parts)):
            frames[len(parts), i, *parts[:i], *parts[i + 1 :], parameters] += 1
    share = max(ladder, max(frames.values(), default=0) / len(functions))
    return min(share, 1.0) if len(functions) >= 5 or share >= 1 else 0.0


def _values(line: str) -> int:
    """Literals on a line of nothing else, 0 on others; long rows may be assigned to a name."""
    if _DATA_LINE.match(line):
        return max(1, len(_VALUE.findall(line)))
    head = _ASSIGNED.match(line) if len(line) >= 160 else None
    if not head or not _DATA_LINE.match(line[head.end() :]):
        return 0
    values = len(_VALUE.findall(line[head.end() :]))
    return values if values >= ROW_VALUES else 0


def _comment_lines(path: str, content: str) -> tuple[list[str], list[str | None]]:
    """A text's lines, and of each that is a comment the comment's text; what stands inside a string is none.

    Strings and comments of several lines are told by the kind of source the
    path's extension names; of other files every line that begins like a
    comment in some language is one.
    """
    lines = re.split(r"\r\n|\r|\n", content)
    kind = _KIND_OF.get(path.rsplit(".", 1)[-1].lower())
    marker, tokens = _SYNTAX[kind] if kind else (_COMMENT, None)
    inside = bytearray(len(lines))  # 1: begins inside a string, 2: inside a comment
    several = tokens is not None and (any(o in content for o in _OPENERS[kind]) or kind == "rust" and any(row.count('"') & 1 for row in lines))
    if several:
        text = "\n".join(lines)
        at, line = 0, 0
        for m in tokens.finditer(text):
            if m.lastgroup and "\n" in m.group(0):
                line += text.count("\n", at, m.start())
                many = m.group(0).count("\n")
                inside[line + 1 : line + 1 + many] = bytes([2 if m.groupdict().get("c") else 1]) * many
                line, at = line + many, m.end()
    comments: list[str | None] = []
    for row, state in zip(lines, inside, strict=True):
        m = None if state == 1 else marker.match(row)
        if m is None and state != 2:
            comments.append(None)
        else:
            comments.append(row[m.end() if m else 0 :].strip().removesuffix("*/").removesuffix("-->").rstrip())
    return lines, comments


def _shape(lines: list[str], comments: list[str | None]) -> tuple[float, float]:
    """Shares of a file's code, by length, that is minified and that is data."""
    total = dense = data = 0
    for line, comment in zip(lines, comments, strict=True):
        if comment is not None or not line.strip():
            continue
        n = len(line)
        total += n
        if n >= 160 and sum(map(line.count, " \t")) < 0.12 * n and sum(map(line.count, "(){};=,.")) > 0.1 * n:
            dense += n
        if n >= 2 and any(c.isdigit() or c in "\"'" for c in line) and _values(line):
            data += n
        elif n >= 160:
            data += sum(len(m.group(0)) for m in _BLOB.finditer(line))
    if not total:
        return 0.0, 0.0
    return dense / total, data / total if data >= LEAST_DATA else 0.0


def file_features(path: str, content: str, automaton, own_names: frozenset[str]) -> tuple:
    """What one file shows by itself; a row of FEATURES."""
    lines, comments = _comment_lines(path, content)
    generated = 0.0
    in_header, third, header_text = True, {}, []
    for line, comment in zip(lines, comments, strict=True):
        if comment is None:
            in_header = in_header and (not line.strip() or line.strip() in ('"use strict";', "'use strict';") or line.startswith("#!"))
            continue
        if not comment:
            continue
        text = comment.lower()
        opening = confirmed = 0
        for end, kinds in automaton.iter(text):
            for group, word, weight in kinds:
                if group == "open" and end + 1 == len(word):  # the comment starts with it
                    opening = max(opening, weight)
                elif group == "confirm":
                    confirmed = 1
                elif group == "third" and in_header:
                    third[word] = weight
        if in_header:
            header_text.append(text)
        if opening and opening + confirmed >= 2:
            generated = 1.0
    head = "\n".join(header_text)
    own = {m.group(1) for m in _OWN.finditer(head)} | {n for n in own_names if re.search(rf"\b{re.escape(n)}\b", head)}
    banner, library = 0.0, None
    if third and not own:
        banner = 1.0 if max(third.values()) == 2 or len(third) >= 2 else 0.4
        for pattern in _LIBRARY:
            for text in header_text:
                m = pattern.search(text)
                if m and library is None and len(m.group(1)) > 2:
                    library = m.group(1)
    minified, data = _shape(lines, comments)
    if minified < 0.5:
        generated = max(generated, repetition(content))
    defined = [a or b for a, b in _DEFINED.findall(content)]
    firsts = Counter(p[0] for p in map(_parts, defined) if p)
    prefix, count = min(firsts.items(), key=lambda x: (-x[1], x[0])) if firsts else (None, 0)
    code = "\n".join(line.strip() for line, comment in zip(lines, comments, strict=True) if comment is None and line.strip())
    body = hashlib.sha256(code.encode("utf-8", "replace")).hexdigest()[:32] if len(code) >= LEAST_BODY else None
    top = path.replace("\\", "/").split("/", 1)[0]
    return (path, top, generated, minified, data, banner, library, prefix, count / max(len(defined), 1), count, body)


def features(files: DataFrame, own_names: tuple[str, ...] = ()) -> DataFrame:
    """FEATURES of every distinct (path, content); rows with a null path are left out, null content is empty."""
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).where("path IS NOT NULL")
    own = frozenset(n.lower() for n in own_names)

    def run(batches):
        automaton = _automaton()
        schema = None
        for batch in batches:
            out = [
                file_features(p, c, automaton, own)
                for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)
            ]
            names = [f.split()[0] for f in FEATURES.split(", ")]
            kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
            schema = schema or pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FEATURES.split(", ")])
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    # Repeated rows are few: their features are dropped, so that no content is shuffled.
    return spread(rows).mapInArrow(run, FEATURES).distinct()


def own_prefixes(facts: DataFrame) -> list[str]:
    """What leads the identifiers of the code base's own files, from FEATURES: at most two names.

    In each top folder the name counts that leads the identifiers of most
    bodies which stand in no other top folder: a library's files are the same
    wherever they were copied to. A name that counts in at least half of the
    top folders, and in two, is the code base's.
    """
    rows = facts.where("body IS NOT NULL")
    bodies = rows.groupBy("body").agg(F.min("top").alias("top"), F.max("top").alias("other"), F.min("prefix").alias("prefix"), F.max("prefix_count").alias("n"))
    leading = bodies.where("top = other AND prefix IS NOT NULL AND n >= 2").groupBy("top", "prefix").agg(F.count(F.lit(1)).alias("n"))
    first = leading.groupBy("top").agg(F.max(F.struct("n", "prefix")).alias("x")).select("top", "x.prefix")
    counted = first.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    tops = rows.select("top").distinct().count()
    # One name per top folder: no more than two can have half of them.
    return sorted(r["prefix"] for r in counted.where((F.col("n") >= 2) & (2 * F.col("n") >= tops)).collect())


def _without_own_banners(facts: DataFrame) -> DataFrame:
    """FEATURES where the code base's own copyright lines are no banner: those that name it, or name no one in files it leads."""
    facts = cut(facts)
    own = [p for p in own_prefixes(facts) if len(p) >= 3]
    if not own:
        return facts
    library = F.lower("library")
    is_own = F.coalesce(F.when(library.isNull(), F.col("prefix").isin(own)).otherwise(library.rlike(f"^(?:{'|'.join(map(re.escape, own))})")), F.lit(False))
    return facts.withColumn("banner", F.when(is_own, 0.0).otherwise(F.col("banner"))).withColumn("library", F.when(~is_own, F.col("library")))


def not_handwritten(files: DataFrame, patterns: list[str], own_names: tuple[str, ...] = ()) -> DataFrame:
    """(path, reason, score) of source files nobody wrote by hand for this code base.

    files: (path, content, ...); patterns: the ignore patterns in order, a
    project's settings; own_names: further names of the code base itself, whose
    copyright lines are no third party's; what leads its identifiers is found
    in the table. reason is generated, minified, data
    or third_party, the one with most evidence.

    Evidence runs from 0 to 1 and 1 makes a case. Content alone can reach it;
    a matching ignore pattern or path rule adds a quarter to content evidence
    of a half or more, and nothing to less. Third-party copies without a
    banner are known by the names of libraries that banners elsewhere give
    (most identifiers start with one), by a body equal to that of a file with
    a banner, or by identifiers that start with a name which only files copied
    to several top folders carry. Those tables are
    joined, never collected. Repeated rows count once; a path whose contents
    differ is a case when one of them is. Empty files and empty tables give no
    rows.
    """
    facts = _without_own_banners(features(files, own_names))
    banners = facts.where("banner >= 1")
    named = banners.where("library IS NOT NULL").select(F.lower("library").alias("prefix")).distinct()
    # A banner may name a project otherwise than its code does: the code's own
    # prefix counts too where most of the file carries it.
    carried = banners.where("prefix_share >= 0.6 AND prefix_count >= 3").select("prefix").distinct()
    libraries = named.unionByName(carried).distinct().withColumn("is_library", F.lit(True))
    bodies = facts.where("body IS NOT NULL").groupBy("body").agg(
        F.max((F.col("banner") >= 1).cast("int")).alias("with_banner"),
        (F.min("top") != F.max("top")).alias("in_many"),
    )
    bodies = bodies.where("with_banner = 1 OR in_many")
    rows = lookup_join(lookup_join(facts, libraries, "prefix"), bodies, "body")
    carries = (F.col("prefix_count") >= 2) & (F.col("prefix_share") >= 0.4)
    # A name that only ever leads files found in several top folders is a library's.
    copied = rows.where(carries).groupBy("prefix").agg(F.min(F.coalesce("in_many", F.lit(False))).alias("only_copies"))
    rows = lookup_join(rows, copied.where("only_copies"), "prefix")

    path = F.col("path")
    third = F.greatest(
        F.col("banner"),
        F.when(carries & F.col("is_library"), 1.0).otherwise(0.0),
        F.when(F.col("with_banner") == 1, 1.0).when(F.col("in_many") & carries & F.col("only_copies"), 1.0).otherwise(0.0),
    )
    lock = path.rlike("(?i)" + LOCKFILES)
    listed = ignored(path, patterns)
    evidence = {
        "generated": (F.when(F.col("generated") >= REPEATED, 1.0).otherwise(F.col("generated")), path.rlike("(?i)" + GENERATED_PATHS) | lock),
        "minified": (F.when(F.col("minified") >= 0.6, 1.0).otherwise(F.col("minified")), path.rlike("(?i)" + MINIFIED_PATHS)),
        "data": (F.when(F.col("data") >= 0.75, 1.0).otherwise(F.col("data")), lock),
        "third_party": (third, path.rlike("(?i)" + VENDOR_FOLDERS)),
    }
    scores = [
        F.struct((content + F.when((content >= 0.5) & (rule | listed), 0.25).otherwise(0.0)).alias("score"), F.lit(reason).alias("reason"))
        for reason, (content, rule) in evidence.items()
    ]
    best = rows.select("path", F.greatest(*scores).alias("best"))
    best = best.groupBy("path").agg(F.max("best").alias("best"))
    return best.select("path", F.col("best.reason").alias("reason"), F.least(F.col("best.score"), F.lit(1.0)).alias("score")).where("score >= 1")
