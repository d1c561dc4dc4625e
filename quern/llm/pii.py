"""Personal information in free text: found by a semi-Markov conditional random field.

A segmentation of a text is a set of spans that don't overlap, each an email
address, phone number, identity number, street address or name; everything
else is outside. A span scores by features of the whole span and of what
stands around it, and a segmentation by the sum; its probability is the
exponential of that sum over the sum for all segmentations. Spans come from
generators that propose every plausible boundary (an address with and without
its town, a name with and without a further word) and never more than
MAX_SPAN characters, so that the dynamic programs for training and decoding
are linear in the text.

The weights are fitted by conditional likelihood on sentences composed in
pii_training; fitting takes some seconds and always gives the same weights.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.operators.skew import spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
MAX_SPAN = 160

# --- fixed values -----------------------------------------------------------------

#: Parts of mailbox names that belong to teams, lists and machines.
ROLE_WORDS = frozenset(
    "admin alert alerts all announce billing bot bots bounce build builds ci contact daemon dev devs deploy do errors feedback git "
    "group hello help helpdesk hooks hostmaster info it jenkins jobs legal lint list lists mail mailer marketing moderator nightly "
    "no noc noreply not notifications notify office oncall ops postmaster press releases reply root sales security service "
    "staff status subscribe support svc abuse backend call donotreply everyone frontend hr monitoring notes on qa web sysadmin system team test user webmaster www core index robot cron sync".split()
)
TITLES = frozenset("mr mrs ms miss mx dr prof sir herr herrn frau mme mlle m monsieur madame sr sra srta don doña señor señora dra".split())
PARTICLES = frozenset("van von der den de del della la le du des di da dos af av zu zur zum ten ter bin el".split())
#: Words that begin sentences, by language; hardly ever part of a name.
STARTS = {
    "en": "A After All An And Any As At Before But By Each Even Every For From He Here How If In It Its Just Last Let Like Many Most My Next No Not Nothing Now Of Off On Once One Only Or Our Since So Some Still That The Then There These They This Those Though To Too Two Under Until We What When Where Which While Who Why With You Your".split(),
    "de": "Ab Alle Am An Auch Auf Aus Bei Bis Da Damit Das Dass Dem Den Der Des Die Diese Doch Ein Eine Er Es Für Hier Ich Im In Ist Jede Kein Man Mit Nach Nicht Noch Nur Ob Ohne Seit Sie So Über Um Und Unter Vom Von Vor Was Wenn Wer Wie Wir Zu Zum Zur Zwei".split(),
    "fr": "À Après Au Aucun Avant Avec Ce Ces Cette Comme Dans De Depuis Des Deux Donc Du Elle En Et Il Ils Je La Le Les Leur Mais Même Ni Nos Nous On Où Par Pas Pour Quand Que Qui Rien Sans Se Ses Si Son Sur Tous Tout Un Une Vers Vous".split(),
    "es": "Al Antes Aquí Así Aunque Bajo Cada Como Con Cuando De Del Desde Donde Dos El Ella En Entre Es Esta Este Hasta Hay La Las Lo Los Más Mi Nada Ni No Nos Para Pero Por Porque Que Quien Se Según Si Sin Sobre Solo Su También Todo Tras Un Una Y Ya".split(),
}
STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Court|Ct|Crescent|Cres|Terrace|Ter|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Gardens|Grove|Row|Walk|Hill|Parkway|Pkwy|Highway|Hwy|Mews|Quay)"
STREET_DE = r"(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Ww]eg|[Pp]latz|[Aa]llee|[Gg]asse|[Bb]ach|[Rr]ing|[Uu]fer|[Dd]amm|[Ss]teig|[Gg]raben|[Mm]arkt|[Hh]of|[Pp]fad|[Cc]haussee)"
STREET_ES = r"(?:C/|Calle|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Glorieta)"
STREET_FR = r"(?:rue|avenue|av\.|place|chemin|boulevard|bd|impasse|allée|quai|cours|route|square|passage|sentier|ruelle)"

# --- candidate spans ---------------------------------------------------------------

#: Family names that stand first or last, by custom (fixed values, common ones only).
_COMMON_FAMILIES = frozenset(
    "wang li zhang liu chen yang huang zhao wu zhou xu sun ma zhu hu lin guo he gao luo nguyen tran le pham hoang phan vu vo dang bui do ngo kim lee park choi jung kang cho yoon jang lim tanaka suzuki sato watanabe ito yamamoto nakamura kobayashi kato "
    "singh patel sharma kumar gupta khan ali hassan hussein ahmed rahman silva santos costa garcia lopez martinez gonzalez rodriguez fernandez perez sanchez smith jones brown taylor wilson davies evans thomas roberts johnson walker wright robinson "
    "müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann martin bernard dubois durand moreau laurent rossi russo ferrari esposito bianchi nowak kowalski novak horvat ivanov petrov yilmaz kaya demir".split()
)
_STARTS = frozenset(w for words in STARTS.values() for w in words)

_UP = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_CAP = rf"[{_UP}][\w'’]*(?:-[{_UP}][\w'’]*)*"
_AT = re.compile(r"@|＠|%40|&#64;|[  ]?(?:\[ ?at ?\]|\( ?at ?\)|\{ ?at ?\}|<at>)[  ]?|(?<=[\w])[  ](?:at|AT|arroba)[  ](?=[\w])", re.I)
_AT_SIGN = re.compile(r"[@＠%&\[({<]")
_AT_WORDS = tuple(f"{a}{w}{b}" for w in ("at", "AT", "At", "aT", "arroba", "ARROBA", "Arroba") for a in "  " for b in "  ")
_LOCAL = re.compile(r"[\w.+'’&=~^-]{1,64}$")
_DOT = r"(?:\.|[  ](?:dot|DOT|punto|punkt|point)[  ]|[  ]?(?:\[ ?(?:dot|\.) ?\]|\( ?(?:dot|\.) ?\)|\{dot\})[  ]?)"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?){{1,6}}", re.I)
_NUMBER = re.compile(r"(?<![\w])(?:\+|\(\+?|\d)(?:\d|[   ().\-/–‑](?=[\d(])|\)[   \-–‑]?(?=\d)){5,}+")
_IDS = re.compile(
    r"(?<![\w.])(?:"
    r"\d{3}[- ]\d{2}[- ]\d{4}"
    r"|[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]"
    r"|\d{2}-\d{6}-[A-Z]"
    r"|\d{2}\.\d{3}\.\d{3}-?[A-Z]"
    r"|\d{8}-?[A-Z]"
    r"|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]\d{8}[A-Z]?(?:<{1,2})?"
    r"|[A-Z]{1,2}\d{6,9}(?:<{1,2})?"
    r"|\d{2}[A-Z]{2}\d{5}"
    r"|[12][ .]?\d{2}[ .]?\d{2}[ .]?\d{2}[ .]?\d{3}[ .]?\d{3}(?:[ .]?\d{2})?"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|\d{9,13}"
    r")(?![\w]|[-.]\d)"
)
_WORD = re.compile(rf"(?:[OD]['’](?=[{_UP}]))?{_CAP}(?:\.(?=[  ,)\"]|$))?|[a-zà-ÿ]{{1,5}}(?=[  ])|\w+|\S")
_NL = r"[  ]?\r?\n?[  ]{0,4}"
_TOWN = rf"{_CAP}(?:[  ](?:{_CAP}|am|an der|upon|sur|de|la)){{0,2}}"
_EN_CORE = re.compile(
    rf"(?<![\w./-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|No\.?) \d{{1,4}}[A-Za-z]?,{_NL})?\d{{1,5}}[A-Za-z]? (?:(?:North|South|East|West|N\.|S\.|E\.|W\.) )?{_CAP}(?: {_CAP}){{0,2}}? {STREET_EN}\b(?: (?:NW|NE|SW|SE)\b)?"
)
_EN_UNIT = re.compile(rf",{_NL}(?:Flat|Apt\.?|Apartment|Unit|Suite|#) ?\d{{1,4}}[A-Za-z]?\b")
_EN_TOWN = re.compile(rf",{_NL}({_TOWN})(?![\w@])")
_EN_CODE = re.compile(rf",?{_NL}(?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}})\b")
_DE_CORE = re.compile(
    rf"(?<![\w./-])(?:(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den) )?(?:{_CAP}(?: {_CAP})?[ -]{STREET_DE}|[{_UP}]\w{{1,40}}?{STREET_DE}) \d{{1,4}}(?: ?[a-z])?(?![\w])"
)
_DE_TOWN = re.compile(rf",{_NL}(?:D-)?\d{{5}} ({_TOWN})")
_ES_CORE = re.compile(rf"(?<![\w./-]){STREET_ES}[  ](?:(?:de|del|de la|de los|de las) )?{_CAP}(?: (?:de |del |la )?{_CAP}){{0,2}}(?:,? (?:n\.º |nº |núm\. )?\d{{1,4}}[A-Za-z]?)(?![\w])")
_ES_UNIT = re.compile(rf",{_NL}\d{{1,2}}\.[ºª°](?: ?[A-Z](?![\w]))?|,{_NL}(?:bajo|ático|esc\.) ?[A-Z]?(?![\w])")
_FR_CORE = re.compile(
    rf"(?<![\w./-])\d{{1,4}}(?: (?:bis|ter|quater)| ?[A-D])?,? {STREET_FR} (?:(?:de la|de l['’]|du|des|de|d['’]|la|le) ?)?{_CAP}(?: {_CAP}){{0,2}}?(?![\w])"
)
_CODE_TOWN = re.compile(rf",{_NL}(?:\d{{5}} )({_TOWN})")
_ONLY_TOWN = re.compile(rf",{_NL}({_TOWN})(?![\w@])")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def fold(text: str) -> str:
    """Lower case without accents."""
    return _folded(text) if len(text) <= 40 else _folded.__wrapped__(text)


@functools.lru_cache(maxsize=1 << 16)
def _folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d").replace("ı", "i").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _shape(text: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[   ]", " ", re.sub(r"[–‑]", "-", re.sub(r"\d", "0", text)))))


_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\s\w]|_|\n")
_LETTERS = re.compile(r"[^\W\d_]{2,}")


def _left(text: str, start: int) -> list[str]:
    before = text[max(0, start - 48) : start]
    left = _PIECE.findall(before)[-4:]
    left = ["0" if w.isdigit() else fold(w) for w in ["^"] * (4 - len(left)) + left]
    out = [f"l1={left[-1]}", f"l2={left[-2]}", f"l12={left[-2]} {left[-1]}", f"l3={left[-3]}", f"l123={left[-3]} {left[-2]} {left[-1]}"]
    out += [f"near={w}" for w in sorted({fold(w) for w in _LETTERS.findall(before[-34:])})]
    touching = before[-1:] if before[-1:] and not before[-1:].isspace() else ""
    return [*out, f"tl={touching}"]


def _right(text: str, end: int) -> list[str]:
    after = text[end : end + 40]
    right = _PIECE.findall(after)[:3]
    right = ["0" if w.isdigit() else fold(w) for w in right + ["$"] * (3 - len(right))]
    touching = after[:1] if after[:1] and not after[:1].isspace() else ""
    return [f"r1={right[0]}", f"r12={right[0]} {right[1]}", *(f"after={fold(w)}" for w in sorted(set(_LETTERS.findall(after[:26])))), f"tr={touching}"]


def _at_marks(text: str):
    """Every sign or word that may stand for the at-sign, found by its rare first characters."""
    places = {max(0, m.start() - 1) for m in _AT_SIGN.finditer(text)}
    for word in _AT_WORDS:
        at = text.find(word)
        while at >= 0:
            places.add(at)
            at = text.find(word, at + 1)
    last = 0
    for place in sorted(places):
        m = _AT.match(text, place) or _AT.match(text, place + 1)
        if m and m.start() >= last:
            last = m.end()
            yield m


def _emails(text: str):
    for m in _at_marks(text):
        begin, at_end = m.start(), m.end()
        mark = m.group(0)
        spaced = 0
        while mark == "@" and begin > 0 and text[begin - 1] in "  " and spaced < 1:
            begin -= 1
            spaced += 1
        while mark == "@" and spaced and at_end < len(text) and text[at_end] in "  ":
            at_end += 1
            break
        if mark == "@" and spaced and at_end == m.end():
            continue  # "text @name" is no address
        local = _LOCAL.search(text, max(0, begin - 64), begin)
        domain = _DOMAIN.match(text, at_end)
        if not local or not domain:
            continue
        name = local.group(0).lstrip(".+-'’=&^~")
        start = begin - len(name)
        labels = re.split(r"\W+(?:dot|punto|punkt|point)?\W*", domain.group(0).lower())
        if not name or len(labels[-1]) < 2 or not labels[-1].isalpha():
            continue
        parts = [p for p in re.split(r"[._+\-\d'’]+", fold(name.split("+")[0])) if p]
        roles = [p for p in parts if p in ROLE_WORDS]
        features = [
            "email",
            f"at={fold(mark.strip())}",
            f"roles={min(len(roles), 2)}",
            f"allroles={bool(parts) and len(roles) == len(parts)}",
            f"parts={min(len(parts), 3)}",
            f"parts+roles={min(len(parts), 3)},{min(len(roles), 2)}",
            f"digits={any(c.isdigit() for c in name)}",
            f"long={max(map(len, parts), default=0) >= 7}",
            f"first={labels[0]}" if labels[0] in ("lists", "list", "code", "git", "hooks", "bots", "mail", "noreply") else "first=",
            f"repo={text[domain.end() : domain.end() + 1] == ':' and text[domain.end() + 1 : domain.end() + 2].isalnum()}",
            *(f"part={p}" for p in parts if p in ROLE_WORDS),
        ]
        yield start, domain.end(), "email", features


#: No number has fewer digits, or more than three other signs between two of them.
_DIGITS = re.compile(r"\d(?:\D{0,3}\d){5}")


def _numbers(text: str):
    if not _DIGITS.search(text):
        return
    for m in _NUMBER.finditer(text):
        run = m.group(0)
        # A run may hold more than the number: it is offered from and up to each gap.
        groups = [(g.start(), g.end()) for g in re.finditer(r"\(?\d+", run)]
        for i, (begin, _) in enumerate(groups):
            begin = begin if i else 0
            digits = 0
            for at, end in groups[i:]:
                digits += end - at - (run[at] == "(")
                if digits > 15:
                    break
                number = run[begin:end]
                if digits < 7 or number.count("(") != number.count(")"):
                    continue
                yield m.start() + begin, m.start() + end, "phone", [
                    f"shape={_shape(number)}",
                    f"n={digits}",
                    f"start={re.match(r'[+(]*(?:00|0)?', number).group(0)}",
                    f"whole={end == len(run)}",
                    f"seps={''.join(sorted(set(re.sub('[0-9]', '', number))))}",
                ]
    for m in _IDS.finditer(text):
        value = m.group(0)
        yield m.start(), m.end(), "id_number", [f"shape={_shape(value)}", f"n={sum(c.isdigit() for c in value)}", f"letters={bool(re.search('[A-Z]', value))}"]


def _tails(text: str, at: int, steps: list[re.Pattern], taken: tuple[str, ...] = (), step: int = 0):
    """(end, parts taken) of every prefix of optional tails."""
    yield at, taken
    for i in range(step, len(steps)):
        m = steps[i].match(text, at)
        if m:
            # A town of several words is also offered without the later ones, and what may follow it after each.
            town = next((g for g in range(1, (m.lastindex or 0) + 1) if m.group(g)), None)
            cuts = [c.start() for c in re.finditer(r"[  ]", m.group(town))] if town else []
            for c in cuts:
                yield from _tails(text, m.start(town) + c, steps, (*taken, str(i)), i + 1)
            yield from _tails(text, m.end(), steps, (*taken, str(i) + ("+" if cuts else "")), i + 1)
            return


_ADDRESS = {
    "en": (_EN_CORE, [_EN_UNIT, _EN_TOWN, _EN_CODE]),
    "de": (_DE_CORE, [_DE_TOWN]),
    "es": (_ES_CORE, [_ES_UNIT, re.compile(f"(?:{_CODE_TOWN.pattern})|(?:{_ONLY_TOWN.pattern})")]),
    "fr": (_FR_CORE, [re.compile(f"(?:{_CODE_TOWN.pattern})|(?:{_ONLY_TOWN.pattern})")]),
}
_DIGIT = re.compile(r"\d")


def _words_of(pattern: str) -> list[str]:
    """What a pattern of alternatives, character pairs and optional dots stands for."""
    words = [""]
    for part in re.findall(r"\[..\]|\\.\??|.", pattern):
        if part[0] == "[":
            words = [w + c for w in words for c in part[1:3]]
        elif part.endswith("?") and len(part) > 1:
            words = [*words, *(w + part[1] for w in words)]
        else:
            words = [w + part[-1] for w in words]
    return words


@functools.lru_cache(maxsize=1)
def _street_automaton():
    """Words that make an address of a language likely: none of its addresses lacks them."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for lang, before, pattern, after in (("en", " ", STREET_EN, ""), ("de", "", STREET_DE, " "), ("es", "", STREET_ES, ""), ("fr", " ", STREET_FR, " ")):
        for alternative in pattern.removeprefix("(?:").removesuffix(")").split("|"):
            for word in _words_of(alternative):
                found.add_word(before + word + after, lang)
    found.make_automaton()
    return found


def _likely_languages(text: str) -> set[str]:
    langs = set()
    for last, lang in _street_automaton().iter(text):
        if lang in langs:
            continue
        following = text[last + 1 : last + 2]
        if lang == "en" and (following.isalnum() or following == "_") or lang == "de" and not following.isdigit():
            continue
        langs.add(lang)
    return langs


def _addresses(text: str):
    langs = _likely_languages(text) if _DIGIT.search(text) else ()
    for lang, (core, tails) in _ADDRESS.items():
        if lang not in langs:
            continue
        for m in core.finditer(text):
            starts = [m.start()]
            ends = [m.end()]
            if text[m.end() : m.end() + 1] == "." and re.search(r"(?:St|Rd|Ave|Blvd|Dr|Ln|Ct|Sq|Pl|Cres|Ter)$", m.group(0)):
                ends.append(m.end() + 1)
            for core_end in ends:
                reached = sorted(set(_tails(text, core_end, tails)))
                for end, taken in reached:
                    if end - m.start() > MAX_SPAN:
                        continue
                    more = end != reached[-1][0]
                    last = text[core_end:end]
                    yield starts[0], end, "address", [
                        f"{lang}",
                        f"taken={lang}{','.join(taken)}",
                        f"more={lang}{more}",
                        f"dot={text[end - 1] == '.'}",
                        f"nextdot={text[end : end + 1] == '.'}{core_end == end}",
                        f"code={bool(re.search(r'[0-9]{5}', last))}",
                        f"several={bool(taken) and taken[-1].endswith('+')}",
                        f"several={bool(taken) and taken[-1].endswith('+')},{re.match(r'$|[  ](?=[^A-ZÀ-Þ])|[  ](?=[A-ZÀ-Þ])|.|', text[end : end + 2], re.S).group(0)!r},{text[end + 1 : end + 2].islower()}",
                        f"lastword={fold(re.split(r'[^\w]+', last)[-1])}" if taken else "core",
                        f"townstart={fold((re.findall(r'[^\W\d_]+', last) or [''])[0])}",
                    ]


_USEFUL = rf"(?>(?:[OD]['’])?[{_UP}][\w'’-]{{0,{MAX_SPAN}}}+(?![\w'’-])\.?+|(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})(?!\w))"
#: Two words or more that could belong to a name, one after the other.
_RUN = re.compile(rf"(?<!\w){_USEFUL}(?>[  ]{{0,2}}+(?>,|{_USEFUL}))++")


def _name_tokens(text: str):
    """Runs of words that could belong to a name, as lists of (start, end, word)."""
    for found in _RUN.finditer(text):
        run: list[tuple[int, int, str]] = []
        for m in _WORD.finditer(text, found.start()):
            if m.start() >= found.end():
                break
            word = m.group(0)
            gap = text[run[-1][1] : m.start()] if run else ""
            joined = gap in ("", " ", " ", "  ") if run else True
            capital = word[0].isupper() or word[:2] in ("O'", "D'", "O’", "D’")
            useful = (len(word) > 1 or word.isalpha()) and (capital or fold(word) in PARTICLES) or word == ","
            if run and (not joined or not useful):
                yield run
                run = []
            if useful and (run or word != ","):
                run.append((m.start(), m.end(), word))
        if len(run) > 1:
            yield run


@functools.lru_cache(maxsize=1 << 16)
def _word_kind(word: str) -> str:
    bare = word.rstrip(".")
    if word == ",":
        return ","
    if fold(word) in PARTICLES and (word.islower() or word.isupper() and len(word) > 1):
        return "p"
    if len(bare) == 1:
        return "I" if word.endswith(".") else "i"
    if any(c.isdigit() or c == "_" for c in bare):
        return "x"
    letters = bare.replace("-", "").replace("'", "").replace("’", "")
    if letters.isupper() and len(letters) > 1:
        return "U"
    rest = re.sub(r"^(?:Mac|Mc|O['’]|D['’]|Le|De|Van|Von)(?=[A-ZÀ-Þ])", "", bare)
    if all(re.fullmatch(r"[^\W\d_][^\W\d_A-ZÀ-Þ]*(?:['’][^\W\d_]+)?", p) for p in re.sub(r"^[OD]['’]", "", rest).split("-") if p):
        return "C"
    return "x"


_NAME_FORMS = re.compile(r"(?:C|I)(?:I|C){0,1}(?:p{0,3})[CU]|(?:p{0,3})[CU],C(?:I)?|(?:C|I)I{1,2}(?:p{0,3})[CU]|[CU],I")


def _names(text: str, given: frozenset[str], mailboxes: frozenset[str]):
    for run in _name_tokens(text):
        kinds = [_word_kind(w) for _, _, w in run]
        for i in range(len(run)):
            if kinds[i] not in "CIUp":
                continue
            for j in range(i + 1, min(len(run), i + 7)):
                form = "".join(kinds[i : j + 1])
                if "x" in form:
                    break
                if not _NAME_FORMS.fullmatch(form):
                    continue
                words = [w for _, _, w in run[i : j + 1]]
                end = run[j][1]
                if words[-1].endswith(".") and kinds[j] != "I":
                    end -= 1
                first_family = "," in form
                firsts = [words[form.index(",") + 1]] if first_family else [words[0]]
                family = words[form.index(",") - 1] if first_family else words[-1]
                names = [fold(p.rstrip(".")) for w in firsts for p in re.split("-", w)]
                last = fold(family.rstrip(".")).split("-")[-1]
                whole = fold(family.rstrip(".")).replace("-", "").replace("'", "").replace("’", "")
                previous = text[max(0, run[i][0] - 14) : run[i][0]]
                title = re.search(r"([^\W\d_]+)\.?[  ]$", previous)
                following = text[end : end + 24]
                features = [
                    f"form={form}",
                    f"given={sum(n in given for n in names)}/{len(names)}",
                    f"form+given={form},{any(n in given for n in names)}",
                    f"familygiven={last in given}",
                    f"title={bool(title) and fold(title.group(1)) in TITLES}",
                    f"istitle={fold(words[0].rstrip('.')) in TITLES}",
                    f"familyfirst={whole in _COMMON_FAMILIES},{fold(words[0]) in _COMMON_FAMILIES}",
                    f"starts={words[0] in _STARTS},{words[-1] in _STARTS}",
                    f"inner={any(len(w) > 2 and w[-1] == '.' for w in words[:-1])}",
                    f"suf3={last[-3:]}",
                    f"suf4={last[-4:]}",
                    f"suf5={last[-5:]}",
                    f"pre3={last[:3]}",
                    f"len={min(len(last), 10)}",
                    f"mailbox={len(whole) > 3 and whole in mailboxes}",
                    f"w1={fold(words[0].rstrip('.'))}",
                    f"nextcap={bool(re.match(r'[  ][A-ZÀ-Þ]', following))}",
                    f"nextlower={bool(re.match(r'[  ][a-zà-ÿ]', following))}",
                    f"street={bool(re.match(rf'[ -](?:{STREET_EN})\\b', following)) or bool(re.search(rf'{STREET_EN}$', family))}",
                    f"start={run[i][0] == 0 or bool(re.search(r'[.!?:]\s+$|\n\s*$', previous))},{any(n in given for n in names)}",
                ]
                yield run[i][0], end, "name", features


_LOWER_PAIR = re.compile(r"(?<![\w./@`'-])([^\W\d_]{2,}(?:-[^\W\d_]{2,})?)[  ]((?:[^\W\d_]\. |(?:van der|von|van|de la|de|di|du|del) |mac|mc|o['’])?[^\W\d_]{2,}(?:-[^\W\d_]{2,})*)(?![\w/@_(]|\.\w)")
_LOWER_FIRST = re.compile(r"(?<![\w./@`'-])([^\W\d_]{2,}(?:-[^\W\d_]{2,})*), ([^\W\d_]{2,})(?![\w/@_(]|\.\w)")


_FAMILY_BEFORE = re.compile(r"(?<![\w./@`'-])[^\W\d_]{2,}(?:-[^\W\d_]{2,})*$")
@functools.lru_cache(maxsize=4)
def _given_automaton(given: frozenset[str]):
    """Given names as they begin a name written small, and as they end one after a comma."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in given:
        for after in "  -":
            found.add_word(name + after, len(name) + 1)
        found.add_word(f", {name}", 0)
    found.make_automaton()
    return found if given else None


def _lower_names(text: str, given: frozenset[str], mailboxes: frozenset[str]):
    """Names written without capitals: only beside a given name that is known."""
    automaton = _given_automaton(given)
    if automaton is None:
        return
    found = set()
    for last, length in automaton.iter(text):
        if length:
            m, first = _LOWER_PAIR.match(text, last + 1 - length), 1
        else:
            comma = text.rfind(", ", 0, last + 1)
            family = _FAMILY_BEFORE.search(text, max(0, comma - MAX_SPAN), comma)
            m, first = (_LOWER_FIRST.match(text, family.start()), 2) if family else (None, 2)
        if not m or (m.start(), first) in found:
            continue
        found.add((m.start(), first))
        if not m.group(0).islower() or fold(m.group(first)).split("-")[0] not in given:
            continue
        last_name = fold(m.group(3 - first)).split("-")[-1]
        whole = re.sub("[^a-z]", "", fold(m.group(3 - first)))
        yield m.start(), m.end(), "name", [
            "form=lower", f"lowfirst={first}", f"suf3={last_name[-3:]}", f"suf4={last_name[-4:]}", f"suf5={last_name[-5:]}", f"pre3={last_name[:3]}",
            f"len={min(len(last_name), 10)}", f"lowsuf3={last_name[-3:]}", f"mailbox={len(whole) > 3 and whole in mailboxes}",
        ]


def candidates(text: str, given: frozenset[str]) -> list[Span]:
    """Every plausible span of a text with its features, by end and start."""
    spans: list[tuple] = list(_emails(text))
    pieces = {p for a, b, *_ in spans for p in re.split(r"[^a-z]+", fold(text[a:b]))}
    mailboxes = frozenset(pieces | {p[1:] for p in pieces})  # with and without an initial
    spans += _numbers(text)
    spans += _addresses(text)
    spans += _names(text, given, mailboxes)
    spans += _lower_names(text, given, mailboxes)
    out = []
    lefts: dict[int, list[str]] = {}
    rights: dict[int, list[str]] = {}
    for start, end, kind, features in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        if end - start <= MAX_SPAN:
            # What stands around a place is looked at once, however many spans begin or end there.
            left = lefts.get(start) or lefts.setdefault(start, _left(text, start))
            right = rights.get(end) or rights.setdefault(end, _right(text, end))
            out.append(Span(start, end, kind, tuple([f"{kind}|{f}" for f in (*features, *left, *right, "bias")])))
    return out


# --- the model ---------------------------------------------------------------------


def decode(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The best segmentation: the non-overlapping spans with the greatest sum of scores."""
    best, chosen, ends = [0.0], [None], [0]
    for span in spans:
        score = sum([weights[f] for f in span.features if f in weights])
        if score <= 0:
            continue
        at = bisect_right(ends, span.start) - 1
        if best[at] + score > best[-1]:
            if ends[-1] == span.end:
                best[-1], chosen[-1] = best[at] + score, (span, at)
            else:
                ends.append(span.end)
                best.append(best[at] + score)
                chosen.append((span, at))
    out, at = [], len(best) - 1
    while at > 0:
        span, at = chosen[at]
        out.append(span)
    return out[::-1]


def _lattice(spans: list[Span]) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """For every place where a span begins or ends, in order: (span, where it begins) of those that end there, (span, where it ends) of those that begin."""
    points = sorted({0, *(s.start for s in spans), *(s.end for s in spans)})
    place = {p: i for i, p in enumerate(points)}
    by_end: list = [[] for _ in points]
    by_start: list = [[] for _ in points]
    for k, s in enumerate(spans):
        by_end[place[s.end]].append((k, place[s.start]))
        by_start[place[s.start]].append((k, place[s.end]))
    return by_end, by_start


def _log_sum(items: list[float]) -> float:
    most = max(items)
    return most + math.log(sum([math.exp(x - most) for x in items]))


def _on_lattice(lattice, scores: list[float]) -> np.ndarray:
    """Probability of each span over all segmentations, by forward and backward sums."""
    by_end, by_start = lattice
    n = len(by_end)
    forward, backward = [0.0] * n, [0.0] * n
    for i in range(1, n):
        forward[i] = _log_sum([forward[i - 1], *[forward[j] + scores[k] for k, j in by_end[i]]]) if by_end[i] else forward[i - 1]
    for i in range(n - 2, -1, -1):
        backward[i] = _log_sum([backward[i + 1], *[backward[j] + scores[k] for k, j in by_start[i]]]) if by_start[i] else backward[i + 1]
    out = np.empty(len(scores))
    for i, spans in enumerate(by_end):
        for k, j in spans:
            out[k] = math.exp(forward[j] + scores[k] + backward[i] - forward[-1])
    return out


def _marginals(spans: list[Span], scores: np.ndarray) -> np.ndarray:
    return _on_lattice(_lattice(spans), list(scores))


def fit(examples: list[tuple[str, list[tuple[int, int, str]]]], given: frozenset[str], rounds: int = 6, rate: float = 0.3, decay: float = 2e-5) -> dict[str, float]:
    """Weights that maximise the likelihood of the labelled spans given the texts.

    AdaGrad over the examples in their order; deterministic. Labelled spans
    that no generator proposes are left out.
    """
    known: dict[str, int] = {}
    data = []
    for text, labels in examples:
        spans = candidates(text, given)
        if not spans:
            continue
        gold = {(a, b, k) for a, b, k in labels}
        ids = np.array([known.setdefault(f, len(known)) for s in spans for f in s.features])
        sizes = np.array([len(s.features) for s in spans])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data.append((ids, sizes, starts, _lattice(spans), np.array([(s.start, s.end, s.kind) in gold for s in spans], dtype=float)))
    weights, squares = np.zeros(len(known)), np.zeros(len(known))
    for _ in range(rounds):
        for ids, sizes, starts, lattice, gold in data:
            own = weights[ids]
            error = gold - _on_lattice(lattice, np.add.reduceat(own, starts).tolist())
            wrong = np.abs(error) >= 1e-4
            if not wrong.any():
                continue
            step = np.repeat(np.where(wrong, error, 0.0), sizes)
            step = np.where(step != 0, step - decay * own, 0.0)
            np.add.at(squares, ids, step * step)
            np.add.at(weights, ids, rate * step / np.sqrt(np.maximum(squares[ids], 1e-300)))
    return {f: float(weights[i]) for f, i in known.items() if abs(weights[i]) > 1e-3}


@functools.lru_cache(maxsize=2)
def trained(given: frozenset[str], examples: int = 12000, seed: int = 5) -> dict[str, float]:
    """Weights fitted on `examples` composed sentences; once per process."""
    from quern.llm.pii_training import compose

    return fit(compose(examples, seed, sorted(given)), given)


# --- operators ---------------------------------------------------------------------


def find_spans(text: str, weights: dict[str, float], given: frozenset[str]) -> list[Span]:
    return decode(candidates(text, given), weights)


FOUND = "doc_id long, pii_kind string, pii_text string, start int, end int"


def _names_of(given_names: DataFrame) -> frozenset[str]:
    # A small table that doesn't grow: a list of given names.
    from quern.llm.pii_training import GIVEN

    listed = (r["name"] for r in given_names.select("name").distinct().collect())
    names = {n for n in (*listed, *GIVEN) if n}
    # As they are written, for names in small letters, and without accents.
    return frozenset({fold(n) for n in names} | {n.lower() for n in names})


def find(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, pii_text, start, end): every span found, offsets in characters.

    documents: (doc_id, text). Whole texts are searched, whatever their
    length; null and empty texts hold nothing. A repeated row gives its spans
    again. The model is fitted on the driver and sent with the tasks (some
    hundred kilobytes); the texts are read once, and shuffled only where they lie in
    fewer partitions than there are cores.
    """
    given = _names_of(given_names)
    weights = trained(given)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc, s.kind, text[s.start : s.end], s.start, s.end) for s in find_spans(text or "", weights, given)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (doc_type, pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "pii_kind", "pii_text", "start", "end"]
            )

    source = spread(documents.select("doc_id", "text"))
    wide = source.schema["doc_id"].dataType
    doc_type = pa.string() if isinstance(wide, T.StringType) else pa.int64()
    source = source.withColumn("doc_id", source["doc_id"].cast("string" if doc_type == pa.string() else "long"))
    schema = FOUND if doc_type == pa.int64() else FOUND.replace("doc_id long", "doc_id string")
    return source.mapInArrow(run, schema)


def redact_text(text: str | None, weights: dict[str, float], given: frozenset[str]) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text, weights, given):
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """documents with every span in text replaced by its kind's placeholder, the rest unchanged.

    All other columns pass through. Null stays null.
    """
    given = _names_of(given_names)
    weights = trained(given)
    names = documents.columns

    def run(batches):
        for batch in batches:
            new = pa.array([redact_text(t, weights, given) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in names], names)

    return spread(documents).mapInArrow(run, documents.schema)
