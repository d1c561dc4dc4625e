"""Declarations of nine languages, read in one pass over a file.

Every line that isn't blank is looked at once: the words before a declaring
keyword (modifiers, in any order), the keyword, and what the keyword's rule
wants after it. A place that several lines would search for (the next brace,
the end of a run of words) is looked up once and remembered, so the work grows
with the file and not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_ID = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DOLLAR_ID = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_DOTTED_ID = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_SCOPED_ID = re.compile(r"[A-Za-z_][A-Za-z0-9_:]*")
_MODULE = re.compile(r"[A-Za-z0-9_.]+")
_OPERATOR = re.compile(r"[-+*/%=<>!&|^~?.]+")
_SPACE = re.compile(r"\s*")
_LINE_HEAD = re.compile(r"^[^\S\n]*+(?=\S)", re.M)


class Source:
    """A text that is read forward; places found once are remembered."""

    def __init__(self, text: str):
        self.text = text
        self._found: dict = {}

    def find(self, sign: str, at: int) -> int:
        """Where `sign` comes next, -1 if it doesn't."""
        began, place = self._found.get(sign, (at + 1, 0))
        if not (began <= at and (place < 0 or at <= place)):
            place = self.text.find(sign, at)
            self._found[sign] = at, place
        return place

    def find_one_of(self, signs: str, at: int) -> int:
        """Where the first of several signs comes next, -1 if none does."""
        places = [p for p in (self.find(s, at) for s in signs) if p >= 0]
        return min(places, default=-1)

    def past(self, run: re.Pattern, at: int) -> int:
        """Where a run of characters that reaches from `at` ends."""
        began, end = self._found.get(run, (at + 1, 0))
        if not began <= at <= end:
            end = run.match(self.text, at).end()
            self._found[run] = at, end
        return end

    def past_space(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()

    def heads(self) -> Iterator[tuple[int, int]]:
        """(lead, head) of every line with text: where the blank lines before it begin, and its first sign."""
        lead = 0
        for m in _LINE_HEAD.finditer(self.text):
            yield lead, m.end()
            following = self.text.find("\n", m.end())
            lead = following + 1 if following >= 0 else len(self.text)


#: Reads what follows a keyword: the names declared and where the declaration's head ends.
Reader = Callable[[Source, int], tuple[list[str], int] | None]


@dataclass(frozen=True)
class Rule:
    """What a keyword declares, which words may stand before it and which one must; flush: at the line's start only."""

    kind: str
    read: Reader
    before: frozenset[str] = frozenset()
    needs: str = ""
    flush: bool = False


@dataclass(frozen=True)
class Grammar:
    """A language: rules by keyword, its words, and which modifiers take a bracketed part."""

    rules: dict[str, tuple[Rule, ...]]
    modifiers: frozenset[str]
    word: re.Pattern = _ID
    brackets: dict[str, str] = field(default_factory=dict)
    flush: tuple[Rule, ...] = ()

    def keywords(self, source: Source, head: int) -> tuple[list[tuple[str, frozenset[str], int]], int]:
        """The declaring words a line begins with, each with the words before it and its end; and how far was read."""
        text, at, before, found = source.text, head, frozenset(), []
        while True:
            m = self.word.match(text, at)
            sign, end = (m.group(0), m.end()) if m else (text[at : at + 1], at + 1)
            if not m and sign in ("@", "#"):
                # An attribute's name, or a directive's, which may stand apart from the sign.
                begin = source.past_space(end) if sign == "#" else end
                m = self.word.match(text, begin)
                if not m:
                    return found, at
                sign, end = (sign + m.group(0) if sign == "#" else sign), m.end()
            if sign in self.rules:
                found.append((sign, before, end))
            if sign not in self.modifiers:
                return found, at
            opening = self.brackets.get(sign)
            begin = source.past_space(end) if opening == "<" else end
            if opening and text.startswith(opening, begin):
                end = source.find(">" if opening == "<" else ")", begin) + 1
                if not end:
                    return found, at
                sign += "" if sign == "@" else opening
            following = source.past_space(end)
            if following == end and opening != "<":
                return found, at
            at, before = following, before | {sign}


def _named(word: re.Pattern = _ID, then: tuple[str, ...] = (), whole: bool = False, apart: bool = True) -> Reader:
    """A name, then one of some signs; whole: no letter of another script may follow it."""

    def read(source: Source, at: int):
        begin = source.past_space(at)
        m = word.match(source.text, begin)
        if not m or apart and begin == at:
            return None
        end = m.end()
        if whole and source.text[end : end + 1].isalnum():
            return None
        if then:
            end = source.past_space(end)
            sign = next((s for s in then if source.text.startswith(s, end)), None)
            if sign is None:
                return None
            end += len(sign)
        return [m.group(0)], end

    return read


def _nameless(kind: str, then: str) -> Reader:
    def read(source: Source, at: int):
        if not then:
            return None if source.text[at : at + 1].isalnum() else ([kind], at)
        at = source.past_space(at)
        return ([kind], at + len(then)) if source.text.startswith(then, at) else None

    return read


def _followed(word: re.Pattern, *wanted: str, optional: tuple[str, ...] = (), sign: str = "") -> Reader:
    """A name, perhaps a sign, perhaps one of some words, then one of the wanted words."""

    def read(source: Source, at: int):
        got = _named(word, (sign,) if sign else ())(source, at)
        if not got:
            return None
        names, end = got
        begin = source.past_space(end)
        if not sign and begin == end:
            return None
        m = _ID.match(source.text, begin)
        if m and m.group(0) in optional:
            begin = source.past_space(m.end())
            m = _ID.match(source.text, begin)
        return (names, m.end()) if m and m.group(0) in wanted and not source.text[m.end() : m.end() + 1].isalnum() else None

    return read


def _upto(sign: str) -> Reader:
    """All up to a sign, over several lines if need be."""

    def read(source: Source, at: int):
        begin = source.past_space(at)
        end = source.find(sign, begin)
        return ([source.text[begin:end].strip()], end + 1) if at < begin < end else None

    return read


def _rest_of_line(source: Source, at: int):
    """What stands on the line before a comment."""
    begin = source.past_space(at)
    ends = [p for p in (source.find("\n", begin), source.find("#", begin)) if p >= 0]
    end = min(ends, default=len(source.text))
    name = source.text[begin:end].strip()
    return ([name], end) if at < begin and name else None


def _from_import(source: Source, at: int):
    module = _named(_MODULE)(source, at)
    if not module:
        return None
    begin = source.past_space(module[1])
    if begin == module[1] or not source.text.startswith("import", begin):
        return None
    names = _rest_of_line(source, begin + len("import"))
    return ([f"{module[0][0]} -> {names[0][0]}"], names[1]) if names else None


def _impl_header(source: Source, at: int):
    """The header up to its brace or the line's end; type parameters in front end at the first closing sign."""
    text = source.text
    line = source.find("\n", at)
    line = len(text) if line < 0 else line
    if text.startswith("<", at):
        closing = source.find(">", at)
        if at < closing < line:
            at = closing + 1
    elif not text[at : at + 1].isspace():
        return None
    brace = source.find("{", at)
    end = min(line, brace if brace >= 0 else line)
    name = text[at:end].strip()
    return ([name], end) if name else None


def _listed(source: Source, at: int):
    """First words of a list in braces."""
    begin = source.past_space(at)
    end = source.find("}", begin)
    if not source.text.startswith("{", begin) or end < 0:
        return None
    return [item.split()[0] for item in source.text[begin + 1 : end].split(",") if item.strip()], end + 1


def _receiver_and_name(source: Source, at: int):
    """A Go function: perhaps a receiver in brackets, a name, an opening bracket."""
    begin = source.past_space(at)
    if source.text.startswith("(", begin):
        at = source.find(")", begin) + 1
        if not at:
            return None
        return _named(then=("(",), apart=False)(source, at)
    return _named(then=("(",))(source, at)


def _go_type(source: Source, at: int):
    got = _named()(source, at)
    if not got:
        return None
    end = source.past_space(got[1])
    return (got[0], end) if end > got[1] else None


def _swift_function(source: Source, at: int):
    return _named(then=("(",))(source, at) or _named(_OPERATOR, ("(",))(source, at)


def _swift_import(source: Source, at: int):
    """The module, perhaps after the kind of thing that is imported from it."""
    got = _named(_DOTTED_ID)(source, at)
    if got and got[0][0] in ("typealias", "struct", "enum", "class", "protocol"):
        return _named(_DOTTED_ID)(source, got[1]) or got
    return got


def _quoted(opening: str, closing: str) -> Reader:
    def read(source: Source, at: int):
        begin = source.past_space(at)
        if begin == at or source.text[begin : begin + 1] not in opening or begin >= len(source.text):
            return None
        end = source.find_one_of(closing, begin + 1)
        if end < begin + 2:
            return None
        marks = 0 if opening == closing else 1
        return [source.text[begin + 1 - marks : end + marks].strip()], end + 1

    return read


def _typedef(source: Source, at: int):
    """The last word before the semicolon, if no brace comes first and something stands before it."""
    end = source.find_one_of(";{", at)
    if end < 0 or source.text[end] != ";":
        return None
    body = source.text[at:end].rstrip()
    last = len(body)
    while last and (body[last - 1] in "_" or body[last - 1].isascii() and body[last - 1].isalnum()):
        last -= 1
    name = body[last:]
    if not _ID.fullmatch(name) or not body[:last].strip() or not body[last - 1].isspace():
        return None
    return [name], end + 1


_C_RUN = re.compile(r"[A-Za-z0-9_*\s]*")
_TEMPLATE_RUN = re.compile(r"[A-Za-z0-9_*&\s<>:]*")


def _last_word(text: str, begin: int, end: int, stars: bool) -> str | None:
    """The word a run of words ends with, if white space (and stars) divide it from others before it."""
    at = end
    while at > begin and text[at - 1].isspace():
        at -= 1
    stop = at
    while at > begin and (text[at - 1] == "_" or text[at - 1].isascii() and text[at - 1].isalnum()):
        at -= 1
    name = text[at:stop]
    while stars and at > begin and text[at - 1] == "*":
        at -= 1
    apart = at > begin and text[at - 1].isspace()
    return name if apart and _ID.fullmatch(name) and text[begin:at].strip() else None


def _c_function(source: Source, head: int):
    """Words from the line's start up to a bracket, parameters, and a brace: a function with its body."""
    text = source.text
    bracket = source.past(_C_RUN, head)
    known = source._found.get("function")
    if known and known[0] == bracket:
        # Lines of one run of words share what follows it.
        body = known[1]
    else:
        body = -1
        if text.startswith("(", bracket):
            closing = source.find(")", bracket)
            brace = source.past_space(closing + 1) if closing >= 0 else -1
            if brace >= 0 and text.startswith("{", brace):
                body = brace
        source._found["function"] = bracket, body
    name = _last_word(text, head, bracket, True) if body >= 0 else None
    return ([name], body + 1) if name else None


def _template_function(source: Source, at: int):
    """A template's parameters, then words up to a bracket, the last one the name."""
    begin = source.past_space(at)
    closing = source.find(">", begin)
    if not source.text.startswith("<", begin) or closing < 0:
        return None
    begin = source.past_space(closing + 1)
    bracket = source.past(_TEMPLATE_RUN, begin)
    if not source.text.startswith("(", bracket) or not _ID.match(source.text, begin):
        return None
    name = _last_word(source.text, begin, bracket, False)
    return ([name], bracket + 1) if name else None


def _swift_type(source: Source, at: int):
    """`class func` declares a function, not a type."""
    got = _named()(source, at)
    return None if got and got[0][0] in ("func", "subscript", "var", "let") else got


def _zig_import(source: Source, at: int):
    got = _named(then=("=",))(source, at)
    end = source.past_space(got[1]) if got else 0
    return (got[0], end + 1) if got and source.text.startswith("@import(", end) else None


def _grammar(*rows: tuple[str, str, Reader, str], **options) -> Grammar:
    """Rows of (keyword, kind, what to read, words that may stand before; one with ! must)."""
    rules: dict[str, tuple[Rule, ...]] = {}
    for keyword, kind, read, before in rows:
        words = before.replace("!", "").split()
        needs = next((w[:-1] for w in before.split() if w.endswith("!")), "")
        rule = Rule(kind, read, frozenset(words), needs, keyword.startswith("#"))
        rules[keyword] = (*rules.get(keyword, ()), rule)
    used = {w.rstrip("(<") for rs in rules.values() for r in rs for w in r.before}
    return Grammar(rules, frozenset(used), **options)


_C_ROWS = (
    ("struct", "struct", _named(), "typedef"),
    ("enum", "enum", _named(), "typedef"),
    ("typedef", "typedef", _typedef, ""),
    ("#define", "define", _named(), ""),
    ("#include", "include", _quoted('<"', '>"'), ""),
)
#: Functions with their body begin a line without a keyword.
_C_FUNCTION = (Rule("fn", _c_function, flush=True),)
_JS_ROWS = (
    ("class", "class", _named(_DOLLAR_ID), "export default"),
    ("function", "function", _named(_DOLLAR_ID), "export default async"),
    *((k, k, _named(_DOLLAR_ID, ("=",)), "export") for k in ("const", "let", "var")),
    ("export", "export", _listed, ""),
)
_SWIFT_OPEN = "@ open public internal fileprivate private package"

GRAMMARS: dict[str, Grammar] = {
    "rust": _grammar(
        *((k, k, _named(), "pub") for k in ("struct", "enum", "trait", "mod")),
        ("fn", "fn", _named(), "pub pub( async"),
        ("use", "use", _upto(";"), ""),
        ("impl", "impl", _impl_header, ""),
        brackets={"pub": "("},
    ),
    "javascript": _grammar(*_JS_ROWS, word=_DOLLAR_ID),
    "typescript": _grammar(
        *_JS_ROWS,
        ("interface", "interface", _named(_DOLLAR_ID), "export"),
        ("type", "type", _named(_DOLLAR_ID, ("=",)), "export"),
        word=_DOLLAR_ID,
    ),
    "python": _grammar(
        ("class", "class", _named(whole=True), ""),
        ("def", "def", _named(whole=True), ""),
        ("def", "async def", _named(whole=True), "async!"),
        ("import", "import", _rest_of_line, ""),
        ("from", "from", _from_import, ""),
    ),
    "go": _grammar(
        ("type", "struct", _followed(_ID, "struct"), ""),
        ("type", "interface", _followed(_ID, "interface"), ""),
        ("func", "func", _receiver_and_name, ""),
        ("const", "const", _named(whole=True), ""),
        ("var", "var", _named(whole=True), ""),
        ("type", "type", _go_type, ""),
    ),
    "swift": _grammar(
        *((k, k, _swift_type, f"{_SWIFT_OPEN} indirect final") for k in ("struct", "class", "enum", "protocol", "actor")),
        ("extension", "extension", _named(_DOTTED_ID), _SWIFT_OPEN),
        ("import", "import", _swift_import, "@"),
        ("typealias", "typealias", _named(), _SWIFT_OPEN),
        ("func", "func", _swift_function, f"{_SWIFT_OPEN} static class mutating nonisolated override"),
        ("subscript", "subscript", _nameless("subscript", "("), f"{_SWIFT_OPEN} static class"),
        ("init", "init", _nameless("init", "("), f"{_SWIFT_OPEN} required convenience"),
        ("deinit", "deinit", _nameless("deinit", ""), _SWIFT_OPEN),
        brackets={"@": "("},
    ),
    "zig": _grammar(
        ("const", "struct", _followed(_ID, "struct", optional=("packed", "extern"), sign="="), "pub"),
        ("const", "enum", _followed(_ID, "enum", sign="="), "pub"),
        ("const", "union", _followed(_ID, "union", optional=("packed", "extern"), sign="="), "pub"),
        ("const", "import", _zig_import, "pub"),
        ("test", "test", _quoted('"', '"'), ""),
        ("fn", "fn", _named(), "pub export"),
        ("const", "const", _named(then=(":", "=")), "pub"),
        ("var", "var", _named(then=(":", "=")), "pub"),
    ),
    "c": _grammar(*_C_ROWS, flush=_C_FUNCTION),
    "cpp": _grammar(
        *_C_ROWS,
        ("class", "class", _named(), "template<"),
        ("namespace", "namespace", _named(_SCOPED_ID), ""),
        ("using", "using", _named(then=("=",)), ""),
        ("template", "fn", _template_function, ""),
        brackets={"template": "<"},
        flush=_C_FUNCTION,
    ),
}


def declared(language: str, content: str) -> list[tuple[int, str, str]]:
    """(offset, kind, name) of every declaration.

    A declaration begins where the blank lines before it do; directives and C
    functions begin at their own line. Of two that overlap and follow one rule
    the first holds. In Zig a type or import is a constant too: it is not
    listed twice. A Go type whose first line names a struct or interface is no
    plain type; where blank lines lead to it, its first line is blank.
    """
    grammar = GRAMMARS.get(language)
    if grammar is None:
        return []
    source = Source(content)
    found: list[tuple[int, str, str]] = []
    ends: dict[Rule, int] = {}
    read_to = 0

    def note(rule: Rule, lead: int, head: int, at: int) -> None:
        start = head if rule.flush else lead
        last = ends.get(rule, 0)
        if start < last:  # the first line that begins after the match before
            start = last if content[last - 1] == "\n" else content.find("\n", last) + 1
            if not 0 < start <= head:
                return
        got = rule.read(source, at)
        if got:
            ends[rule] = got[1]
            found.extend((start, rule.kind, name) for name in got[0])

    for lead, head in source.heads():
        flush = head == 0 or content[head - 1] == "\n"
        if flush:
            for rule in grammar.flush:
                note(rule, lead, head, head)
        if head < read_to:
            continue
        hits, read_to = grammar.keywords(source, head)
        for keyword, before, at in hits:
            for rule in grammar.rules[keyword]:
                if before <= rule.before and (not rule.needs or rule.needs in before) and (flush or not rule.flush):
                    note(rule, lead, head, at)
    if language == "zig":
        taken = {name for _, kind, name in found if kind not in ("fn", "const", "var")}
        found = [f for f in found if f[1] not in ("fn", "const", "var") or f[2] not in taken]
    if language == "go":
        line = lambda at: content[at : source.text.find("\n", at) % (len(content) + 1)]
        found = [f for f in found if f[1] != "type" or not re.search(" (?:struct|interface)", line(f[0]))]
    return found
