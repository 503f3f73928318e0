"""Personal information in free text, by a semi-Markov conditional random field.

A text is segmented into stretches of ordinary text and whole entity spans of
a bounded number of tokens, and a log-linear model scores complete
segmentations. Features look at a whole candidate span: its grouping of digits,
check digits, the classes and endings of its words (``lexicon``), the words and
keys around it; entities close to each other add a score for their pair of
types. Candidates come from broad patterns that overlap and compete; the
dynamic programme over their boundaries chooses boundaries and types together
(Viterbi), and the same lattice gives the forward-backward sums the weights are
trained with (``pii_train``). The bounds are those of the method: eight groups
of digits and fifteen digits a number, five words a name, four words a street.

Texts are read through their encodings (percent, form, JSON and XML escapes,
however often applied) with the place of each character remembered, so
redaction replaces the raw characters of a span and leaves all else as it is.

A JVM pattern that every candidate satisfies keeps texts without any candidate
out of Python.

Defined results: null and empty fields have no findings and stay as they are;
repeated rows of a record give one row per field and type; records without id
have no findings.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.tokens import verhoeff_valid
from spanforge.llm.lexicon import classify
from spanforge.llm.pii_weights import WEIGHTS

TYPES = ("email", "phone", "national_id", "street_address", "person_name")

# ---------------------------------------------------------------- encodings

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\[nrt\"/\\]|&(?:#\d{1,6}|#x[0-9A-Fa-f]{1,5}|amp|lt|gt|quot|apos|nbsp|[A-Za-z]{4,6});|(?<=[\w.,!?;)\]'-])\+(?=[\w(%&+'\"\[])(?![\w.+-]*@)")
#: Signs that were escaped again and again: read as escaped once.
_NESTED = ((re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})"), "%"), (re.compile(r"&(?:amp;)+(?=#?\w{1,7};)"), "&"))
_SIMPLE = {"\\n": "\n", "\\r": "\r", "\\t": "\t", '\\"': '"', "\\/": "/", "\\\\": "\\"}


def _unescape(raw: str) -> str:
    c = raw[0]
    if c == "+":  # a blank of form encoding; the pattern leaves a plus before numbers and in addresses with a plain @
        return " "
    if c == "%":
        return bytes.fromhex(raw.replace("%", "")).decode("utf-8", "replace")
    if c == "&":
        return html.unescape(raw)
    if raw[1] == "u":
        units = bytes.fromhex(raw.replace("\\u", ""))
        return units.decode("utf-16-be", "replace")
    return _SIMPLE[raw]


def _pass(text: str, at: list[int] | None) -> tuple[str, list[int]]:
    out, places, last = [], [], 0
    here = at if at is not None else range(len(text) + 1)
    for m in _ESCAPE.finditer(text):
        new = _unescape(m[0])
        if new == m[0]:
            continue
        out += [text[last : m.start()], new]
        places += here[last : m.start()]
        n, width = len(new), m.end() - m.start()
        places += [here[m.start() + k * width // n] for k in range(n)]
        last = m.end()
    out.append(text[last:])
    places += here[last : len(text) + 1]
    return "".join(out), places


def _unnest(text: str, at: list[int] | None) -> tuple[str, list[int] | None]:
    for nested, sign in _NESTED:
        if not nested.search(text):
            continue
        out, places, last = [], [], 0
        here = at if at is not None else range(len(text) + 1)
        for m in nested.finditer(text):
            out += [text[last : m.start()], sign]
            places += [*here[last : m.start()], here[m.start()]]
            last = m.end()
        text, at = "".join(out) + text[last:], [*places, *here[last:]]
    return text, at


def decode(text: str) -> tuple[str, list[int] | None]:
    """The text as it reads and, if anything was escaped, the raw place of each character and of the end.

    A pass undoes one encoding and a chain of escaped escape signs at once, so
    the passes are as many as the encodings, each shorter than the one before.
    """
    at: list[int] | None = None
    first = True
    while ("%" in text or "\\" in text or "&" in text or (first and "+" in text)) and _ESCAPE.search(text):
        new, places = _pass(*_unnest(text, at))
        if new == text:
            break
        text, at, first = new, places, False
    return text, at


# ---------------------------------------------------------------- candidates

_AT = r"(?:@|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+%-]{{0,63}}{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]|{_DOT}(?=[A-Za-z0-9])){{1,80}}")
#: A run of digit groups of any length; the bound of eight groups is on a candidate within it.
GROUPS = re.compile(r"(?<![\w])(?:\+|\(\+?)?\d{1,14}\)?(?:(?:[ .\-/ ‐-―]|\) |\)-| \(|-\()?\(?\d{1,12}\)?)*(?![\w])")
_GROUP = re.compile(r"[+(]{0,2}\d+\)?")
PAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{5}[ -]?\d{4}[ -]?[A-Za-z](?![A-Za-z0-9])")
#: Capitals of the scripts that have them (Latin, Greek, Cyrillic, Armenian), and letters of those that have none.
_U = "".join(chr(c) for c in range(0x590) if chr(c).isupper())
_BARE = r"֐-ࣿऀ-࿿ᄀ-ᇿ぀-ヿ㐀-鿿가-힯"
_LETTER = r"[^\W\d_]"
_CAP = rf"[{_U}](?:{_LETTER}|['’](?={_LETTER}))*"
#: Words for kinds of streets, by the language of their word order.
STREETS = (
    "street st road rd avenue ave lane ln drive dr court ct way boulevard blvd place pl square sq terrace ter crescent close gardens grove hill mews row walk rise circle cir highway hwy parkway pkwy trail alley plaza quay wharf green embankment esplanade passage broadway"
)
ROADS = "rue avenue boulevard place chemin allée impasse quai cours route passage square sentier faubourg"
CALLES = "calle avenida avda plaza paseo camino carrer ronda travesía calzada vía via viale corso piazza largo vicolo rua travessa alameda praça strada bulevardul ulica ul. улица ул. проспект"
STEMS = "straße strasse str. weg gasse platz allee damm ufer ring steig chaussee markt straat laan gracht plein kade dijk gatan gata vägen gade vej veien katu utca"


def _alt(words: str) -> str:
    return "|".join(map(re.escape, words.split()))


_NAMED = rf"(?:(?-i:[{_U}])[\w'’-]*|\d{{1,3}}(?:st|nd|rd|th)|[NSEW]\.)"
_NUMBER = r"\d{1,5}(?:[-/]\d{1,4})? ?[a-zA-Z]?(?![\w])"
_LINK = r"(?:d[eu]s? (?:la |l['’])?|d['’]|of |the |de(?:l|i|gli|lla| la| los| las)? |da |do |dos |das )?"
ADDRESS = (
    re.compile(rf"(?<![\w])\d{{1,5}}(?:[-/]\d{{1,4}})?[a-zA-Z]?,? (?:{_NAMED} ){{1,3}}(?:{_alt(STREETS)})(?![\w])(?:(?<=st|rd|ln|dr|ct|pl|sq)\.|(?<=ave|ter|cir)\.|(?<=blvd|pkwy)\.)?(?: [NSEW]{{1,2}}(?![\w]))?(?:,? (?:apt|suite|unit|flat|#)\.? ?\w{{1,6}}(?![\w]))?|(?<![\w])\d{{1,5}}[a-zA-Z]? (?-i:Broadway|The [{_U}]\w+)(?![\w])", re.I),
    re.compile(rf"(?<![\w])(?-i:[{_U}])[\w-]*?(?:{_alt(STEMS)}) ?{_NUMBER}", re.I),
    re.compile(rf"(?<![\w])\d{{1,5}}(?: ?bis| ?ter|[a-zA-Z])?,? (?:{_alt(ROADS)}) {_LINK}(?-i:{_CAP})(?:[ -](?-i:{_CAP})){{0,2}}", re.I),
    re.compile(rf"(?<![\w])(?:{_alt(CALLES)}) {_LINK}(?-i:{_CAP})(?: {_LINK}(?-i:{_CAP})){{0,2}},? (?:n[º°o]?\.? ?|№ ?|д(?:ом|\.)? ?)?{_NUMBER}", re.I),
    re.compile(rf"(?<![\w])(?-i:[{_U}])[\w-]*(?: (?-i:[{_U}])[\w-]*)? (?:{_alt(STEMS)}) {_NUMBER}", re.I),
    re.compile(rf"(?<![\w])(?:am|an der|an den|auf der|auf dem|im|in der|unter den|zum|zur|hinter der|vor dem|aan de|op de) (?-i:{_CAP})(?: (?-i:{_CAP}))? {_NUMBER}", re.I),
)
ADDRESS_WORD = re.compile(rf"{_alt(STREETS)}|{_alt(STEMS)}|{_alt(ROADS)}|{_alt(CALLES)}", re.I)
#: Words between the parts of a name.
PARTICLES = "de la|de los|de las|van der|van den|von der|de|da|do|dos|das|del|della|di|du|la|le|van|von|den|der|ter|ten|zu|al|el|bin|ibn|ben|af|av"
_CAPS = rf"{_CAP}(?:[-‐]{_CAP})*"
#: Runs of capital words, initials and particles; every stretch of up to MOST_WORDS of them is a candidate.
RUN = re.compile(rf"(?<![\w.'’-])(?:[{_U}]\.|{_CAPS}(?![\w]))(?:(?:[ \xa0]{{1,2}}|(?<=\.))(?:[{_U}]\.|{_CAPS}(?![\w])|(?:{PARTICLES})(?=[ \xa0]{{1,2}}[{_U}])))+")
_RUN_WORD = re.compile(rf"[{_U}]\.|{_CAPS}|[a-z]+(?: (?:la|los|las|der|den)(?=[ \xa0]))?")
MOST_WORDS = 5
TURNED = re.compile(rf"(?<![\w.'’-])(?=({_CAPS}(?: {_CAPS})?, ?(?:[{_U}]\.|{_CAPS})(?: (?:[{_U}]\.|{_CAPS}))?)(?![\w]))")
#: Names in scripts without capitals: two words, or a few characters of Chinese, Japanese and Korean.
BARE = re.compile(r"(?<![^\W\d_])(?:[㐀-鿿]{2,4}(?:[ ・　][㐀-鿿]{1,3})?|[゠-ヿ]{2,8}[ ・　][゠-ヿ]{2,8}|[가-힯]{2,4}|[֐-ࣿ]{2,12} [֐-ࣿ]{2,12}|[ऀ-࿿]{2,16} [ऀ-࿿]{2,16})(?=様|さん|先生|氏|님|씨|[\W\d_]|$)")
_SOME_BARE = re.compile(rf"[{_BARE}]")
_SEVEN = re.compile(r"\d(?:[^\dA-Za-z]{0,3}\d){6}")
_FOUR = re.compile(r"\d{4}[ -]?[A-Za-z](?![A-Za-z0-9])")
_NUMBERED = re.compile(rf"\d[A-Za-z]?,? (?:[{_U}]|\d)")
_SPELT_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_ROADS, _CALLES, _STEMS = ROADS.split(), CALLES.split(), STEMS.split()
_AT_PLACE = re.compile(r"\b(?:am|an|auf|im|in|unter|zum|zur|hinter|vor|aan|op)(?: de[rnm]?)? [A-ZÄÖÜ]", re.I)

#: An escape that may read as a letter, a digit, an at sign, part of another escape or a character beyond ASCII. Texts with one, with digits beyond ASCII or with the
#: letters that re.I takes for s, k and i go to Python as they are, so the other branches meet plain characters and escapes of ASCII punctuation only.
_ODD = r"(?:25|26|5[cC]|[89a-fA-F][0-9a-fA-F]|3[0-9]|4[0-9a-fA-F]|5[0-9aA]|6[1-9a-fA-F]|7[0-9aA])"
_OPAQUE = (
    rf"%{_ODD}|\\(?:[\\%&+]|u(?:00{_ODD}|(?!00)[0-9A-Fa-f]{{4}}))",
    r"&(?:(?!(?:quot|apos|lt|gt|nbsp);)(?:#\w{1,7}|[A-Za-z]{2,6});|[#A-Za-z0-9]{0,7}(?:%|\\u00)(?:23|3[bB]))",
    rf"(?=[^\x00-\x7f])(?:[{_BARE}]|\p{{Nd}}|[ſKİı])",
)
#: The JVM pattern all candidates satisfy, on raw text, in groups by the kind of character they begin with.
#: Spark's \w, \d and (?i:) know ASCII only, so letters beyond are named.
_SEP = r"(?:[ +./()\-\xa0‐-― ]|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\/|&nbsp;)"
_BLANK = r"(?:[ +,\xa0]|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|&nbsp;)"
_SPACE = r"(?:[\s\x1c-\x1f\x85\p{Z}+]|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[nrt]|&nbsp;)?"
_BEFORE = r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[nrt])"
_DASH = r"(?:[ \-+]|%2[0bBdD]|\\u002[0bBdD])?"
_WORD = r"(?:[\p{L}\p{M}'’‐-]++|%2[7dD]|\\u002[7dD]|&apos;)"


def _anycase(words: str) -> str:
    both = re.sub(r"[^\x00-\x7f]", lambda m: f"[{m[0]}{m[0].upper() if len(m[0].upper()) == 1 else 'ẞ'}]", _alt(words))
    return both.replace(r"\.", r"(?:\.|%2[eE]|\\u002[eE])")


def _heads(words: str) -> str:
    return "".join(sorted({c for w in words.split() for c in (w[0], w[0].upper())}))


_ENDS = _anycase(" ".join(sorted({w[-2:] for w in STEMS.split()})))
_SEVEN_RAW = rf"\d(?:{_SEP}{{0,4}}\d){{6}}"
_CALLE = rf"(?i:(?:{_anycase(CALLES)}){_BLANK})"
_PREPOSITION = rf"(?i:am|an{_BLANK}de[rn]|auf{_BLANK}de[rm]|i[mn]|in{_BLANK}der|unter{_BLANK}den|zu[mr]|hinter{_BLANK}der|vor{_BLANK}dem|aan{_BLANK}de|op{_BLANK}de){_BLANK}{{1,3}}\p{{Lu}}{_WORD}*+(?:{_BLANK}{{1,3}}\p{{Lu}}{_WORD}*+)?{_BLANK}{{1,3}}\d"
_GLUED = r"\p{Lu}\.\p{Lu}"
CANDIDATE = "|".join((
    r"(?=\d)(?:"
    + rf"(?<![A-Za-z0-9]){_SEVEN_RAW}"
    + rf"|\d{{4}}{_DASH}[A-Za-z](?![A-Za-z0-9])(?<=[A-Za-z]{{5}}{_DASH}\d{{4}}{_DASH}[A-Za-z])"
    + rf"|\d(?:[A-Za-z]|{_BLANK}?(?i:bis|ter))?{_BLANK}{{1,4}}(?:\p{{Lu}}|\d{{1,3}}(?i:st|nd|rd|th)|(?i:{_anycase(ROADS)}))"
    + rf"|\d(?<=(?i:{_ENDS})(?: |%|\+|\\u)?\d)(?<=(?i:{_anycase(STEMS)})(?: |%|\+|\\u)?\d)"  # the ends alone are a cheap first look
    + ")",
    rf"(?=[A-Z]|[^\x00-\x7f])(?:\p{{Lu}}{_WORD}*+\.?{_BLANK}{{1,3}}(?:(?:{PARTICLES.replace(' ', _BLANK)}){_BLANK}{{1,3}})?\p{{Lu}}|(?<![A-Za-z0-9_]){_GLUED})",
    rf"(?<![A-Za-z])(?=[{_heads(CALLES)}aiuzhvoAIUZHVO])(?:{_CALLE}|{_PREPOSITION})",
    rf"@|(?:[\[({{]|(?:%|\\u00)(?:5[bB]|28|7[bB])){_SPACE}(?:at|AT|At|aT){_SPACE}(?:[\])}}]|(?:%|\\u00)(?:5[dD]|29|7[dD]))",
    # what begins behind an escape is reached from the escape
    rf"(?=[%\\])(?:{_OPAQUE[0]}|{_BEFORE}(?:{_SEVEN_RAW}|{_GLUED}|{_CALLE}|{_PREPOSITION}))",
    *_OPAQUE[1:],
))

#: What any text that satisfies the pattern has: a first, cheap test. All branches need a capital, a sign of an address or an escape, seven digits, an ordinal, or digits as in a permanent account number.
HINT = r"[A-Z@%&\\(\[{]|[^\x00-\x7f]|\d(?:[ +./\-)]{0,4}\d){6}|\d(?:st|nd|rd|th)|\d{4}[ \-+]?[a-z](?![a-z0-9])"


def _set(*parts: str) -> str:
    """A class with each sign listed; the parts az, AZ and 09 stand for all between. Java looks such signs up in one table, but calls functions for ranges, properties and negations."""
    return "[" + "".join(re.escape(chr(c)) for part in parts for c in (range(ord(part[0]), ord(part[1]) + 1) if part in ("az", "AZ", "09") else map(ord, part))) + "]"


def _by_head(words: list[str]) -> str:
    """The words as alternatives that branch at the first letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{h}(?:{_anycase(' '.join(rest))})" for h, rest in heads.items())


def _plain() -> tuple[str, str]:
    """HINT and CANDIDATE as they read for texts of ASCII only, nearly all there are: the same texts pass.

    What lies beyond ASCII is left out. A run of digits or capitals is tried
    from its first one only (any match from inside it is also one from there),
    and a repetition whose parts cannot begin what follows gives nothing back.
    """
    upper, letter, digit, sign = _set("AZ"), _set("AZ", "az"), _set("09"), _set("AZ", "az", "09")
    hexa = _set("09", "ABCDEFabcdef")
    escape = rf"%{hexa}{{2}}|\\u{hexa}{{4}}"
    sep = rf"(?:{_set(' +./()-')}|{escape}|\\/|&nbsp;)"
    blank = rf"(?:{_set(' +,')}|{escape}|&nbsp;)"
    word = rf"(?:{_set('AZ', 'az', "'-")}++|%2[7dD]|\\u002[7dD]|&apos;)"
    space = rf"(?:{_set(' +', ''.join(map(chr, range(9, 14))), ''.join(map(chr, range(28, 32))))}|{escape}|\\[nrt]|&nbsp;)?"
    stems, roads, calles = ([w for w in words.split() if w.isascii()] for words in (STEMS, ROADS, CALLES))
    seven = rf"{digit}(?:{sep}{{0,4}}+{digit}){{6}}"
    calle = rf"(?i:(?:{_by_head(calles)}){blank})"
    preposition = rf"(?i:a(?:m|n{blank}de[rn]|uf{blank}de[rm]|an{blank}de)|i(?:[mn]|n{blank}der)|unter{blank}den|zu[mr]|hinter{blank}der|vor{blank}dem|op{blank}de){blank}{{1,3}}{upper}{word}*+(?:{blank}{{1,3}}{upper}{word}*+)?{blank}{{1,3}}{digit}"
    glued = rf"{upper}\.{upper}"
    particles = PARTICLES.replace(" ", blank)
    behind = r"(?: |%|\+|\\u)?"
    hint = rf"{_set('AZ', '@%&\\([{')}|{digit}(?<!{digit}{digit})(?:(?:{_set(' +./-)')}{{0,4}}+{digit}){{6}}|{digit}{{3}}{digit}*+{_set(' -+')}?{_set('az')}(?!{_set('az', '09')})|{digit}*+(?:st|nd|rd|th))"
    return hint, "|".join((
        rf"(?={digit})(?:"
        + rf"(?<!{sign}){seven}"
        + rf"|{digit}{{4}}{_DASH}{letter}(?!{sign})(?<={letter}{{5}}{_DASH}{digit}{{4}}{_DASH}{letter})"
        + rf"|{digit}(?={_set('AZ', 'az', ' +,%&\\')})(?:{letter}|{blank}?(?i:bis|ter))?{blank}{{1,4}}(?:{upper}|{digit}{{1,3}}(?i:st|nd|rd|th)|(?i:{_by_head(roads)}))"
        + rf"|(?<={_set('AZ', 'az', '. %+')}){digit}(?<=(?i:{_anycase(' '.join(sorted({w[-2:] for w in stems})))}){behind}{digit})(?<=(?i:{_anycase(' '.join(stems))}){behind}{digit})"
        + ")",
        rf"(?={upper})(?:(?<!{upper}){upper}{word}*+\.?{blank}{{1,3}}+(?:{upper}|(?:{particles}){blank}{{1,3}}+{upper})|(?<!{_set('AZ', 'az', '09', '_')}){glued})",
        rf"(?={_set(_heads(' '.join(calles)) + 'aiuzhvoAIUZHVO')})(?<!{letter})(?:{calle}|{preposition})",
        rf"(?={_set('@%&([{\\')})(?:@|(?:[\[({{]|(?:%|\\u00)(?:5[bB]|28|7[bB])){space}(?:at|AT|At|aT){space}(?:[\])}}]|(?:%|\\u00)(?:5[dD]|29|7[dD]))"
        + rf"|(?=[%\\])(?:{_OPAQUE[0]}|{_BEFORE}(?:{seven}|{glued}|{calle}|{preposition}))|{_OPAQUE[1]})",
    ))


HINT_ASCII, CANDIDATE_ASCII = _plain()

# ---------------------------------------------------------------- features

#: Words before a span, and parts of the key it stands under, that go with a type. Common words of several languages.
CUES = {
    "person_name": frozenset(
        "dear hi hello hey hallo liebe lieber geehrte geehrter frau herr herrn bonjour madame monsieur hola señor señora don doña estimado estimada signor signora gentile mr mrs ms miss mx dr prof sir dame "
        "by with from cc attn attention contact author name named called client customer patient manager employee colleague regards sincerely thanks thank wishes best signed yours von mit an für par pour avec por para con de ask asked met saw told interview".split()
    ),
    "phone": frozenset("call phone telephone tel t f m mobile cell cellphone fax dial ring text sms whatsapp reach reached contact number hotline telefon telefonnummer handy mobil anrufen unter téléphone portable appeler appelez au teléfono móvil llamar llame al telefono cellulare chiamare on at".split()),
    "email": frozenset("email e-mail mail write contact to from cc".split()),
    "national_id": frozenset("ssn social security id identity pan aadhaar aadhar uid tax taxpayer tin itin national number no nr kyc citizen passport document identification ausweis personalausweis identité identidad".split()),
    "street_address": frozenset("at to in en an au a auf im chez near address street live lives living moved ship deliver visit office located residence von nach wohnhaft anschrift adresse habite domicile vive domicilio dirección abita indirizzo outside on".split()),
}
KEYS = {
    "person_name": ("name", "customer", "client", "person", "people", "contact", "recipient", "sender", "author", "owner", "user", "employee", "patient", "holder", "signer", "attn", "member", "passenger"),
    "phone": ("phone", "tel", "mobile", "cell", "fax", "msisdn", "contact", "call", "sms", "whatsapp"),
    "email": ("mail", "login", "user", "reply", "contact", "from", "to"),
    "national_id": ("ssn", "social", "tax", "tin", "identity", "idnumber", "id_number", "national", "pan", "aadhaar", "aadhar", "kyc", "passport", "citizen"),
    "street_address": ("addr", "street", "location", "residence", "home", "line1", "ship", "delivery", "billing"),
}
_DATE = re.compile(r"^(?:19|20)\d\d[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:[0-2]?\d|3[01])(?!\d)|^(?:[0-2]?\d|3[01])[-/. ](?:[0-2]?\d|3[01])[-/. ](?:19|20)\d\d(?!\d)")
_LAST_WORDS = re.compile(r"[^\W\d_][\w-]*")


def _tail(left: str, extra: str) -> str:
    """The run of letters, digits and ``extra`` at the end."""
    i = len(left)
    while i and (left[i - 1].isalnum() or left[i - 1] in extra):
        i -= 1
    return left[i:].lower()


def _near(text: str, start: int) -> tuple[list[str], str]:
    """The words before a place, nearest first, and the key if what stands before is ``key=``, ``"key": "``, ``<key>``, a header name or a path segment."""
    left = text[max(0, start - 40) : start]
    at = left.rstrip("\"' \t\n\r")
    key = _tail(at[:-1].rstrip("\"' \t\n\r"), "_.-") if at and at[-1] in "=:>\x1f/" else ""
    return _LAST_WORDS.findall(left.lower())[-3:][::-1], key


def _cues(kind: str, text: str, start: int) -> list[str]:
    words, key = _near(text, start)
    f = []
    if key and any(k in key for k in KEYS[kind]):
        f.append(f"{kind}:key")
    elif key and text[start - 1 : start] != " ":
        f.append(f"{kind}:other_key")
    if words and words[0] in CUES[kind]:
        f.append(f"{kind}:cue")
    elif any(w in CUES[kind] for w in words[1:]):
        f.append(f"{kind}:far_cue")
    return f


def _email(text: str, a: int, b: int) -> list[str]:
    span = text[a:b]
    last = re.split(_DOT, span)[-1]
    f = ["email:tld_alpha" if last.isalpha() and len(last) > 1 else "email:tld_other", "email:at" if "@" in span else "email:spelt_at"]
    return f + (["email:dotted"] if re.search(_DOT, re.split(_AT, span)[-1]) else ["email:undotted"])


def _signature(span: str) -> str:
    return re.sub(r"\d+", lambda m: str(len(m[0])), span)


def _numbers(text: str, a: int, b: int, inside: bool) -> dict[str, list[str]]:
    """Features of a run of digit groups as a phone number and as an identity number."""
    span = text[a:b]
    digits = re.sub(r"\D", "", span)
    n = len(digits)
    out = {}
    seps = set(re.sub(r"[\d+()]", "", span))
    sizes = [len(x) for x in re.findall(r"\d+", span)]
    if 7 <= n <= 15:
        f = [f"phone:n{min(n, 13)}"]
        if "+" in span:
            f.append("phone:plus")
        elif digits.startswith("00") and n >= 11:
            f.append("phone:zeros")
        elif digits[0] == "0":
            f.append("phone:zero")
        else:
            f.append("phone:bare")
        if "(" in span:
            f.append("phone:paren" if span.count("(") == span.count(")") else "phone:unbalanced")
        if len(sizes) == 1 and "+" not in span:
            f.append("phone:one_group")
        if sizes[-3:] == [3, 3, 4]:
            f.append("phone:334")
        if sizes == [3, 4, 4] and digits[0] == "0":
            f.append("phone:344")
        if len(sizes) == 5 and set(sizes) == {2}:
            f.append("phone:22222")
        if sizes in ([4, 4, 4], [3, 2, 4], [3, 2, 3], [4, 4, 2], [4, 4, 4, 4]) and "+" not in span:
            f.append("phone:code_shape")
        if _DATE.match(span):
            f.append("phone:date")
        if len(sizes) > 1 and min(sizes) == 1 and "+" not in span and sizes[0] != 1:
            f.append("phone:tiny_group")
        if inside:
            f.append("phone:part")
        out["phone"] = f + _cues("phone", text, a)
    if n in (9, 12) and "+" not in span and "(" not in span:
        f = []
        if sizes == [3, 2, 4]:
            ok = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
            f = ["national_id:324", "national_id:valid" if ok else "national_id:invalid"]
        elif n == 12 and sizes in ([12], [4, 4, 4]) and len(seps) <= 1:
            f = ["national_id:444", "national_id:checked" if digits[0] in "23456789" and verhoeff_valid(digits) else "national_id:unchecked"]
        elif n == 9 and sizes == [9]:
            f = ["national_id:nine"]
        if f:
            if inside:
                f.append("national_id:part")
            out["national_id"] = f + _cues("national_id", text, a)
    return out


def _pan(text: str, a: int, b: int) -> list[str]:
    span = re.sub(r"[ -]", "", text[a:b])
    f = ["national_id:pan", "national_id:pan_type" if span[3].upper() in "ABCFGHJLPTE" else "national_id:pan_other"]
    return f + ([] if span.isupper() or span.islower() else ["national_id:pan_mixed"])


def _address(text: str, a: int, b: int, way: int) -> list[str]:
    span = text[a:b]
    f = [f"street_address:way{way}"]
    names = [w for w in re.findall(rf"{_LETTER}+", span) if not ADDRESS_WORD.fullmatch(w)]
    long = [w for w in names if len(w) > 3]
    if long and all(w[0].isupper() for w in long):
        f.append("street_address:capital")
    kinds = {classify(w) for w in long}
    if kinds and kinds <= {"o", "q"}:
        f.append("street_address:ordinary")
    words, _ = _near(text, a)
    gap = text[max(0, a - 2) : a]
    if span[:1].isdigit() and words and gap.endswith(" ") and not gap.startswith((",", ":", ".", ";")) and words[0] not in CUES["street_address"]:
        f.append("street_address:counted")  # a thing with a number in front, such as a gate
    after = re.match(rf" ({_LETTER}+)", text[b : b + 30])
    if after and way in (0, 2):
        f.append("street_address:goes_on_capital" if after[1][0].isupper() else "street_address:goes_on")
    return f + _cues("street_address", text, a)


@lru_cache(1 << 16)
def _class(w: str) -> str:
    return classify(w)


_ANY_WORD = re.compile(rf"{_LETTER}+(?:['’-]{_LETTER}+)*")


def _name(text: str, a: int, b: int, way: str, cls=None) -> list[str]:
    """``cls`` gives the class of a word; training hides some of them."""
    span = text[a:b]
    cls = cls or _class
    parts = _ANY_WORD.findall(span)
    words = [p for p in parts if len(p) > 1 and p[0].isupper()] or parts
    first, last = (words[0], words[-1]) if way != "turned" else (words[-1], words[0])
    f = [f"person_name:{way}"]
    if len(words) > 1:
        f.append(f"person_name:pair_{cls(first)}{cls(last)}")
        f += [f"person_name:middle_{cls(w)}" for w in words[1:-1]]
    else:
        f.append(f"person_name:single_{cls(last)}")
    f.append(f"person_name:words{min(len(words), 4)}")
    upper = [w.isupper() for w in words]
    if all(upper):
        f.append("person_name:upper")
    elif any(upper):
        f.append("person_name:mixed")
    if words[-1].isupper() and len(words[-1]) < 5:
        f.append(f"person_name:acronym_{way}")
    if any(len(w) > 2 and not w.isupper() and any(c.isupper() for c in w[3:].split("-")[0]) for w in words):
        f.append("person_name:camel")
    if "-" in span:
        f.append("person_name:hyphen")
    if any(ADDRESS_WORD.fullmatch(w) for w in parts):
        f.append("person_name:street_word")
    if len(parts) > len(words) and way == "run":
        f.append("person_name:particle_or_initial")
    f += _cues("person_name", text, a)
    before = re.search(rf"({_LETTER}+)([.:!?]?)[ \xa0]{{1,2}}$", text[max(0, a - 24) : a])
    if before and not before[2]:
        if before[1][0].isupper():
            f.append(f"person_name:behind_{cls(before[1])}")
        elif before[1] not in CUES["person_name"]:
            f.append(f"person_name:behind_low_{way}")
    after = re.match(rf"[ \xa0]{{1,2}}({_LETTER}+)", text[b : b + 24])
    if after and after[1][0].isupper():
        f.append(f"person_name:ahead_{cls(after[1])}")
    if re.match(r"[ .#]{0,2}\d", text[b : b + 3]):
        f.append("person_name:before_number")
    if text[b : b + 1] == "," and re.match(rf", {_LETTER}+ \d", text[b : b + 20]):
        f.append("person_name:before_count")
    if re.search(r"\d ?$", text[max(0, a - 2) : a]):
        f.append("person_name:behind_number")
    return f


def candidates(text: str, cls=None) -> list[tuple[int, int, str, list[str]]]:
    """All candidate spans (start, end, type, features). Cheap tests spare the patterns that cannot match."""
    out = []
    low = text.lower()
    if "@" in text or _SPELT_AT.search(text):
        for m in EMAIL.finditer(text):
            out.append((m.start(), m.end(), "email", _email(text, m.start(), m.end())))
    for m in GROUPS.finditer(text) if _SEVEN.search(text) else ():
        if sum(map(str.isdigit, m[0])) < 7:
            continue
        gs = [(m.start() + g.start(), m.start() + g.end(), sum(map(str.isdigit, g[0]))) for g in _GROUP.finditer(m[0])]
        for i in range(len(gs)):
            digits = 0
            for j in range(i, min(len(gs), i + 8)):
                digits += gs[j][2]
                if digits > 15:
                    break
                a, b = gs[i][0], gs[j][1]
                for kind, f in _numbers(text, a, b, i > 0 or j < len(gs) - 1).items() if digits >= 7 else ():
                    out.append((a, b, kind, f))
    if _FOUR.search(text):
        for m in PAN.finditer(text):
            out.append((m.start(), m.end(), "national_id", _pan(text, m.start(), m.end())))
    stem = any(w in low for w in _STEMS)
    may = (_NUMBERED.search(text), stem, any(f"{w} " in low for w in _ROADS), any(w in low for w in _CALLES), stem, _AT_PLACE.search(text))
    for way, p in enumerate(ADDRESS):
        for m in p.finditer(text) if may[way] else ():
            out.append((m.start(), m.end(), "street_address", _address(text, m.start(), m.end(), way)))
    for m in RUN.finditer(text):
        ws = [(m.start() + w.start(), m.start() + w.end(), text[m.start() + w.start()].isupper()) for w in _RUN_WORD.finditer(m[0])]
        for i in range(len(ws)):
            if not ws[i][2]:
                continue
            full = ws[i][1] - ws[i][0] > 2
            for j in range(i + 1, min(len(ws), i + MOST_WORDS)):
                if ws[j][2] and text[ws[j][1] - 1] != "." and ws[j][1] - ws[j][0] > 1:
                    out.append((ws[i][0], ws[j][1], "person_name", _name(text, ws[i][0], ws[j][1], "run" if full else "initial", cls)))
    if "," in text:
        for m in TURNED.finditer(text):
            out.append((*m.span(1), "person_name", _name(text, *m.span(1), "turned", cls)))
    if not text.isascii() and _SOME_BARE.search(text):
        for m in BARE.finditer(text):
            out.append((m.start(), m.end(), "person_name", ["person_name:bare", *_cues("person_name", text, m.start())]))
    return out


# ---------------------------------------------------------------- the model


#: Entities at most so many characters apart score as neighbours.
CLOSE = 3


def score(features: list[str], weights: dict[str, float]) -> float:
    kind = features[0].split(":")[0]
    return weights.get(f"{kind}:bias", 0.0) + sum(weights.get(f, 0.0) for f in features)


def neighbours(order: list[tuple], ends: list[int], k: int) -> tuple[int, int]:
    """(far, near): of the spans in order of their ends, the first ``far`` end well before span ``k`` begins, those up to ``near`` close before."""
    a = order[k][0]
    return bisect.bisect_left(ends, a - CLOSE), bisect.bisect_right(ends, a)


def link(left: str, right: str) -> str:
    return f"{left}>{right}"


def viterbi(spans: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best segmentation; ordinary text scores 0. Its cost follows the number of candidates."""
    order = sorted(spans, key=lambda s: s[1])
    ends = [s[1] for s in order]
    best: list[float] = []  # of segmentations that end with span k
    back: list[int] = []
    top: list[tuple[float, int]] = [(0.0, -1)]  # the best of the first k spans, or none of them
    for k, (_, _, kind, f) in enumerate(order):
        far, near = neighbours(order, ends, k)
        value, where = top[far]
        for j in range(far, min(near, k)):
            v = best[j] + weights.get(link(order[j][2], kind), 0.0)
            if v > value:
                value, where = v, j
        best.append(value + score(f, weights))
        back.append(where)
        top.append(max(top[-1], (best[-1], k), key=lambda t: t[0]))
    found, k = [], top[-1][1]
    while k >= 0:
        found.append(order[k][:3])
        k = back[k]
    return found[::-1]


def marginals(spans: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> tuple[float, list[float], dict[tuple[int, int], float]]:
    """Log partition function, each candidate's probability and that of each pair of neighbours, by forward and backward sums over the lattice."""
    n = len(spans)
    place = sorted(range(n), key=lambda i: spans[i][1])
    order = [spans[i] for i in place]
    ends = [s[1] for s in order]
    own = [score(s[3], weights) for s in order]

    def total(xs: list[float]) -> float:
        high = max(xs)
        return high + math.log(sum(math.exp(x - high) for x in xs))

    before: list[list[tuple[int, float]]] = []
    fw: list[float] = []
    for k in range(n):
        far, near = neighbours(order, ends, k)
        before.append([(j, 0.0 if j < far else weights.get(link(order[j][2], order[k][2]), 0.0)) for j in range(min(near, k))])
        fw.append(own[k] + total([0.0, *(fw[j] + w for j, w in before[k])]))
    z = total([0.0, *fw])
    bw = [[0.0] for _ in range(n)]
    done = [0.0] * n
    for k in range(n - 1, -1, -1):
        done[k] = total(bw[k])
        for j, w in before[k]:
            bw[j].append(w + own[k] + done[k])
    p = [0.0] * n
    for k in range(n):
        p[place[k]] = math.exp(fw[k] + done[k] - z)
    pairs = {(place[j], place[k]): math.exp(fw[j] + w + own[k] + done[k] - z) for k in range(n) for j, w in before[k] if j >= neighbours(order, ends, k)[0]}
    return z, p, pairs


def find(text: str, weights: dict[str, float] = WEIGHTS) -> list[tuple[int, int, str]]:
    """(start, end, type) in the raw text."""
    plain, at = decode(text)
    spans = viterbi(candidates(plain), weights)
    return spans if at is None else [(at[a], at[b], k) for a, b, k in spans]


def redact(text: str | None, weights: dict[str, float] = WEIGHTS) -> str | None:
    """The text with each finding replaced by its type in brackets."""
    if not text:
        return text
    out, last = [], 0
    for a, b, k in find(text, weights):
        out += [text[last:a], f"[{k.upper()}]"]
        last = b
    return "".join(out) + text[last:]


# ---------------------------------------------------------------- tables

FIELD, PAIR = "\x1e", "\x1f"


def beyond(c: Column) -> Column:
    """Whether a text has signs beyond ASCII."""
    return F.octet_length(c) != F.length(c)


def has_hint(c: Column) -> Column:
    return beyond(c) | c.rlike(HINT_ASCII)


def joined(m: Column) -> Column:
    """Names and values of a map as one text, without entries that have no hint of a candidate."""
    hinted = F.filter(F.map_entries(m), lambda e: has_hint(e["value"]) | has_hint(e["key"]))
    return F.array_join(F.transform(hinted, lambda e: F.concat(e["key"], F.lit(PAIR), F.coalesce(e["value"], F.lit("")))), FIELD)


def hinted(c: Column) -> Column:
    return F.when(beyond(c), c.rlike(CANDIDATE)).otherwise(c.rlike(HINT_ASCII) & c.rlike(CANDIDATE_ASCII))


def fields(t: DataFrame, ident: str = "txn_id") -> DataFrame:
    """(id, field, text) of the four fields, those without any candidate left out."""
    all_ = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("body", F.col("req_body")), ("path", F.col("req_path")), ("query", joined(F.col("req_query"))), ("headers", joined(F.col("req_headers"))))))
    return t.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.explode(all_).alias("f")).select("id", "f.field", "f.text").where(hinted(F.col("text")))


@lru_cache(1 << 15)
def _short(text: str) -> frozenset[str]:
    return frozenset(k for _, _, k in find(text))


def kinds(field: str, text: str) -> frozenset[str]:
    """Types in a field; the entries of a map are read one by one."""
    if field == "body":
        return frozenset(k for _, _, k in find(text))
    if field == "path":
        return _short(text)
    return frozenset().union(*(_short(e) for e in text.split(FIELD)))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, names, types = [], [], []
        for i, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for k in kinds(f, t):
                ids.append(i)
                names.append(f)
                types.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(types, pa.string())], names=["txn_id", "field", "pii_type"])


def found(t: DataFrame) -> DataFrame:
    """(txn_id, field, pii_type), once each."""
    return fields(t).mapInArrow(_found, "txn_id long, field string, pii_type string").distinct()


def _redact_map(pairs: list[tuple[str, str]] | None, redact=redact) -> list[tuple[str, str]] | None:
    if pairs is None:
        return None
    out: dict[str, str | None] = {}
    for k, v in pairs:
        new = redact(f"{k}{PAIR}{v}") if v is not None else redact(k)
        name, _, value = new.partition(PAIR)
        while name in out:
            name += "_"
        out[name] = value if v is not None else None
    return list(out.items())


def _changed(column: pa.Array, hit: pa.Array, change) -> pa.Array:
    """The column with the rows that were hit changed; no other row is turned into an object."""
    rows = np.flatnonzero(hit.fill_null(False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return column
    new = pa.array([change(x) for x in column.take(pa.array(rows)).to_pylist()], column.type)
    place = np.arange(len(column))
    place[rows] = len(column) + np.arange(len(rows))
    return pa.concat_arrays([column, new]).take(pa.array(place))


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    short = lru_cache(1 << 15)(redact)
    ways = (short, redact, lambda m: _redact_map(m, short), lambda m: _redact_map(m, short))
    for b in batches:
        fields_ = [_changed(b.column(k), b.column(k + 4), change) for k, change in enumerate(ways, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *fields_], names=["id", "req_path", "req_body", "req_query", "req_headers"])


def redacted(t: DataFrame, ident: str = "txn_id") -> DataFrame:
    """(id, req_path, req_body, req_query, req_headers) of every row, findings replaced."""
    hit = [hinted(c).alias(f"_{k}") for k, c in enumerate((F.col("req_path"), F.col("req_body"), joined(F.col("req_query")), joined(F.col("req_headers"))))]
    rows = t.select(F.col(ident).cast("long").alias("id"), "req_path", "req_body", "req_query", "req_headers", *hit)
    return rows.mapInArrow(_redacted, "id long, req_path string, req_body string, req_query map<string,string>, req_headers map<string,string>")
