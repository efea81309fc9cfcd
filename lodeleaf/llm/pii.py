"""Personal information in free text: found by boosted trees over candidate spans, replaced by placeholders.

Generators with high recall propose spans, which may overlap: every stretch of up to five tokens inside a run of
capitalised words, initials and particles; "surname, given name"; in Chinese every family name with one or two
characters behind it, in Japanese every stretch of an ideographic run, in Hindi, Arabic and Thai the words around
common names and honorifics; and number, e-mail and street patterns of many countries.  Format and context
features of a span go to a model of its kind; the thresholds are calibrated on held-out sentences.  Of overlapping
spans above their thresholds the most probable stays.  The models are trained on ``TRAINING`` paragraphs that
``pii_training`` makes from templates and invented names (a documented bound), in a few seconds on the driver.

Null and empty texts have no mentions.  Texts are read whole, in code points; no span is cut off by a window.
Null ids have no mentions, equal rows give theirs once, further columns are ignored, empty tables give none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting as B
from . import common as C
from . import pii_lexicon as L
from . import pii_training as T

KINDS = ("person", "email", "phone", "id_number", "address")
TRAINING = 4000
PLACEHOLDERS = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
MOST_TOKENS = 5  # of a name in Latin script: a longer run is proposed in all its stretches of so many

# --- generators

# Wide digits and signs, and odd blanks and hyphens, one for one: offsets stay.
_FOLD = str.maketrans("０１２３４５６７８９＋－（）＠．／‐‑–−" + "\u00a0\u2009\u202f\u3000", "0123456789+-()@./----" + "    ")

_FOLDED = re.compile("[０-９＋－（）＠．／‐‑–−\u00a0\u2009\u202f\u3000]")

_UP, _LOW = "A-ZÀ-ÖØ-ÞŠŽ", "a-zà-öø-ÿšž"
# It begins with a class of characters, which the regular expression engine skips to; what may not stand before it comes behind.
_NAME_TOKEN = re.compile(
    rf"[{_UP}vdz](?<![\w@.+\-/].)(?:(?P<part>(?:(?<=v)[oa]n|(?<=d)(?:el|ella|e|i|a)|(?<=z)u)(?= [{_UP}]))|(?<=[{_UP}])(?:(?P<initial>\.)(?=[ \t]?[{_UP}]|[ \t,;|/<(]|$)"
    rf"|(?P<word>(?:(?<=[ODL])['’][{_UP}]|(?<=M)a?c[{_UP}])?(?:[{_LOW}]+|[{_UP}]{{2,}})(?:['’\-](?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}}))*)(?![\w@+]|[._\-][a-z0-9]|\(at\))))",
    re.M,
)
_EMAIL = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_.+\-@])[A-Za-zÀ-ÿ0-9_][A-Za-zÀ-ÿ0-9_.+\-]*(?:\s?[@＠]\s?|\s?[\[({]\s?(?:at|AT|At|a|arroba|ät)\s?[\])}]\s?)(?:[A-Za-zÀ-ÿ0-9\-]+(?:\s?[\[({]\s?(?:dot|DOT|Dot|punto|punkt|point)\s?[\])}]\s?|[.．]))+[A-Za-zÀ-ÿ]{2,}(?![A-Za-zÀ-ÿ0-9_@])")
_EMAIL_WORDS = re.compile(r"(?<![\w.+\-@])[a-z][\w.+\-]* (?:at|AT) [\w\-]+(?: (?:dot|DOT) [\w\-]+)+(?![A-Za-zÀ-ÿ0-9_])")
_PHONES = [
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])(?:[(（]?\+|00)\d{1,3}[)）]?[ .\-/]?(?:[(（]0?\d{1,4}[)）][ .\-/]?)?\d(?:[ .\-/]?\d){4,12}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])[(（]0?\d{2,4}[)）][ .\-/]?\d(?:[ .\-/]?\d){5,9}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]?\d{3,4}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])0\d{1,4}[ .\-/]\d(?:[ .\-]?\d){4,9}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])0\d(?:[ .\-]?\d\d){4}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])\d{9,11}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
]
_IDS = [
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])\d{3}([ .\-]?)\d{2}\1\d{4}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Za-z](?![A-Za-zÀ-ÿ0-9_])"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])(?:\d{2}\.\d{3}\.\d{3}|\d{8}|[XYZxyz]-?\d{7})[ \-]?[A-Za-z](?![A-Za-zÀ-ÿ0-9_])"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])[1-478] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-z\d+\-./])\d{17}[\dXx](?![A-Za-z\d])"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])\d{3}[ \-]\d{3}[ \-]\d{3}(?: ?\d{2})?(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])\d{4}[ \-]\d{4}[ \-]\d{4}(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_+\-./])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d-?\d{4}-?\d{5}-?\d{2}-?\d)(?![A-Za-zÀ-ÿ0-9_]|[.\-/]\d)"),
]
# Identity numbers with too few digits together to be met among the numbers.
_VERBS = frozenset("在于到是址至往向为住租寄送去回搬开位给了，。：、；（「")
_LETTERED = re.compile(r"(?<![A-Za-z0-9_\-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d)(?![A-Za-z0-9_])")
_TOWN = rf"[{_UP}][{_LOW}'’]+(?:-(?:[a-z]{{2,5}}-)?[{_UP}]\w+)*(?: [{_UP}][{_LOW}'’]+(?:-(?:[a-z]{{2,5}}-)?[{_UP}]\w+)*){{0,2}}"
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|[A-Z]{2} ?\d{5}(?:-\d{4})?|\d{5}(?:-\d{4})?)"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Way|Close|Crescent|Cres\.?|Terrace|Ter\.?|Row|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Ct\.?|Place|Pl\.?|Square|Sq\.?|Gardens|Grove|Hill|Mews|Parade|Walk|Park|View)"
_NAMES = rf"[{_UP}][\w'’\-]+"
_ADDRESSES = [
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[A-Za-z]? (?:{_NAMES} ){{1,3}}{_STREET}(?!\w)(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite|Floor|Room) \w+)?(?:, (?!(?:Tel|or)\b){_TOWN}(?:,? {_CODE})?|,? {_CODE})?(?!\w)"),
    re.compile(rf"(?<![\w.\-/])(?:[{_UP}][\w\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|steig|hof|stieg|chaussee)|{_NAMES} (?:Straße|Strasse|Str\.|Allee|Weg|Platz|Ring|Damm|Gasse|Ufer)|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der) {_NAMES}(?= \d{{1,4}} ?[a-z]?, \d{{5}} )) \d{{1,4}} ?[a-z]?(?!\w)(?:, (?:\d{{5}} {_TOWN}))?"),
    re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|bd\.|impasse|chemin|place|pl\.|allée|quai|cours|route|square|passage)(?: (?:de la|de l['’]|des|du|de|d['’]|la|le|les)| d['’]| l['’])? ?(?:{_NAMES})(?: {_NAMES}){{0,2}}(?:, (?:bât\.?|appt\.?|étage) ?\w+)?(?:,? \d{{5}} {_TOWN})?"),
    re.compile(rf"(?<![\w.\-])(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Ctra\.) ?(?:de la |de los |de las |del |de )?{_NAMES}(?: (?:de |del |de la )?{_NAMES}){{0,3}}(?:,? (?:n\.?º |núm\. |nº )?\d{{1,4}}|, s/n)(?!\d)(?:, \d{{1,2}}\.?º(?: ?[A-Z](?!\w))?)?(?:,? \d{{5}} {_TOWN})?"),
    re.compile(r"(?:〒 ?\d{3}[-－]\d{4}[ 　]?)?(?:[一-鿿々]{1,3}[都府県]|北海道)(?![了的])[一-鿿々]{1,6}[市区町村郡][一-鿿々ァ-ヶ]{0,8}?\d{1,4}(?:[-－丁目番地の]+\d{1,4}){0,3}(?:号(?!室))?(?:[ 　]?[一-鿿ァ-ヶー]{1,10}\d{1,4}号室)?"),
    re.compile(r"〒 ?\d{3}[-－]\d{4}[ 　]?[一-鿿々ぁ-んァ-ヶ]{2,16}?\d{1,4}(?:[-－丁目番地の]+\d{1,4}){0,3}号?"),
    re.compile(r"(?:[一-鿿]{2,4}省)?[一-鿿]{2,3}市(?:[一-鿿]{1,4}[区县镇])?[一-鿿]{1,6}?(?:路|街|巷|里|道|大道|弄|胡同)\d{1,5}号(?:院内|院|内)?(?:\d{1,4}(?:号楼|栋|楼|单元|层|室|号))*"),
]




_SINGLE = L.TITLES | L.GREETINGS | L.PREPOSITIONS | L.CONJUNCTIONS | L.LABELS | L.ROLES | L.BEFORE
_HAN = re.compile("[一-鿿]")
_KANA = re.compile("[ぁ-んァ-ヶ]")
_HAN_RUN = re.compile("[一-鿿々]+")
_JA_RUN = re.compile("[一-鿿々]{2,}(?:[ 　][一-鿿々ぁ-んァ-ヶ]{1,4})?")
_JA_NAMED = re.compile(rf"(?:{'|'.join(sorted(L.JA_SURNAMES, key=len, reverse=True))})[ 　]?[ぁ-んァ-ヶー]{{2,4}}?(?={'|'.join(L.JA_AFTER)}|[ 　、。（(,/|;<\t\n]|$)")
_JA_HONORIFIC = re.compile("|".join(L.JA_AFTER))
_WORDS_OF = {"hi": re.compile("[ऀ-ॿ]+[.]?"), "ar": re.compile("[؀-ۿ]+[.]?")}
_SCRIPTS = (("hi", re.compile("[ऀ-ॿ]"), frozenset(L.HI_GIVEN + L.HI_FAMILY), L.HI_BEFORE), ("ar", re.compile("[؀-ۿ]"), frozenset(L.AR_GIVEN + L.AR_FAMILY), L.AR_BEFORE))
_THAI = re.compile("[฀-๿]")
_TH_NAME = re.compile(rf"(?:(?:{'|'.join(L.TH_BEFORE)})[ ]?(?P<a>[ก-๏]{{2,}}(?: [ก-๏]{{2,}})?))|(?P<b>(?:{'|'.join(L.TH_GIVEN)})(?: [ก-๏]{{2,}})?)")
_TH_PARTS = frozenset(L.TH_GIVEN + L.TH_FAMILY)
_LAST_WORD = re.compile(r"(\S+)(\s*)$")


def _name_runs(text: str) -> list[list[tuple[int, int, str]]]:
    """Runs of name tokens with single blanks between them; function words and titles are in none."""
    runs: list[list[tuple[int, int, str]]] = []
    end = -9
    for m in _NAME_TOKEN.finditer(text):
        a, b, kind = m.start(), m.end(), m.lastgroup
        if kind == "word" and m.group().lower() in L.FUNCTION:
            continue
        if a == end + 1 and text[end] == " ":
            runs[-1].append((a, b, kind))
        else:
            runs.append([(a, b, kind)])
        end = b
    return runs


def _before(text: str, a: int) -> tuple[str, str]:
    """The word before a place, as far as 24 code points, and what lies between them."""
    part = text[max(0, a - 28) : a]
    bare = part.rstrip(" \t")
    gap = part[len(bare) :]
    if not bare or bare[-1].isspace():
        return "", gap
    return bare.split()[-1][-24:], gap


def _single(text: str, a: int, b: int) -> bool:
    """Whether a capitalised word by itself is proposed as a name."""
    if text[a:b].lower() in _NO_NAME:
        return False
    if text[a:b] in L.GIVEN_LATIN or text[b : b + 1] in "/<|;\t" or text[b : b + 3] in (" / ", " | ") or text[b : b + 2] in ("'s", "’s") or text[b : b + 2] == " <":
        return True
    word, gap = _before(text, a)
    if not word:
        return bool(gap == "" and a and text[a - 1] == "\n" and text[b : b + 1] in ",\n")
    if word[-1] in ":;|/,\t>(" or "\t" in gap:
        return True
    if word.lower().rstrip(".").rpartition("'")[2] in _SINGLE or (len(word) == 2 and word[1] == "."):
        return True
    after = text[b : b + 24].split(" ", 2)
    return len(after) > 1 and after[0] == "" and after[1].rstrip(",.;") in _SINGLE_AFTER


_NO_NAME = L.LABELS | L.ROLES | L.THINGS
_SINGLE_AFTER = L.CONJUNCTIONS | L.AFTER


def _latin_persons(text: str) -> list[tuple[int, int]]:
    runs, out = _name_runs(text), []
    for k, run in enumerate(runs):
        n = len(run)
        for i in range(n):
            word = False
            for j in range(i, min(n, i + MOST_TOKENS)):
                word = word or run[j][2] == "word"
                if not word or run[j][2] == "part":
                    continue
                if i == j and n <= MOST_TOKENS and not _single(text, run[i][0], run[i][1]):
                    continue
                out.append((run[i][0], run[j][1]))
        # surname, given name
        if k + 1 < len(runs) and run[-1][2] == "word" and text[run[-1][1] : runs[k + 1][0][0]] == ", ":
            given = runs[k + 1]
            ends, j = [], 0
            while j < min(len(given), 3) and given[j][2] != "part":
                ends.append(given[j][1])
                j += 1
            for end in ends:
                out += [(run[i][0], end) for i in range(max(0, n - 3), n)]
    return out


def _chinese_persons(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _HAN_RUN.finditer(text):
        s, at = run.group(), run.start()
        for i, ch in enumerate(s):
            for width in (2, 1):
                if width == 1 and ch not in L.ZH_SINGLE or width == 2 and s[i : i + 2] not in _ZH_DOUBLE:
                    continue
                if width == 1 and s[i : i + 2] in L.ZH_WORDS:
                    continue
                for n in (1, 2):
                    given = s[i + width : i + width + n]
                    if len(given) == n and not any(c in L.ZH_STOP for c in given):
                        out.append((at + i, at + i + width + n))
    return out


_ZH_DOUBLE = frozenset(L.ZH_DOUBLE)


def _japanese_persons(text: str) -> list[tuple[int, int]]:
    out = [m.span() for m in _JA_NAMED.finditer(text)]
    for run in _JA_RUN.finditer(text):
        a, b = run.span()
        blank = re.search("[ 　]", run.group())
        if blank:
            cut = a + blank.start()
            for i in range(1, min(4, cut - a + 1)):
                out += [(cut - i, e) for e in range(cut + 2, b + 1)]
            b = cut
        called = _JA_HONORIFIC.match(text, b) is not None
        n = b - a
        # stretches that end with the run, begin with it, or begin with a common family name
        for i in range(n):
            for size in range(1 if called else 3, 7):
                if i + size > n:
                    break
                named = any(text.startswith(s, a + i) for s in _JA_BY_FIRST.get(text[a + i], ()))
                honoured = _JA_HONORIFIC.match(text, a + i + size) is not None
                if i + size == n or i == 0 or named or honoured:
                    if size > 2 or honoured or i + size == n and called:
                        out.append((a + i, a + i + size))
    return out


_JA_BY_FIRST: dict[str, list[str]] = {}
for _s in L.JA_SURNAMES:
    _JA_BY_FIRST.setdefault(_s[0], []).append(_s)


def _spaced_persons(text: str, name: str, names: frozenset[str], before: frozenset[str]) -> list[tuple[int, int]]:
    """Stretches of up to three words that hold a common name or follow an honorific."""
    out, words = [], [(m.start(), m.end(), m.group()) for m in _WORDS_OF[name].finditer(text)]
    known = [_bare(w) in names for *_, w in words]
    led = [False] + [w in before and text[e] == " " for (_, e, w) in words[:-1]]
    starts = {i for k in range(len(words)) if known[k] for i in range(max(0, k - 2), k + 1)} | {k for k in range(len(words)) if led[k]}
    for i in sorted(starts):
        if words[i][2] in before:
            continue
        holds = led[i]
        for j in range(i, min(len(words), i + 3)):
            a, b, w = words[j]
            if j > i and text[words[j - 1][1] : a] != " " or w in before:
                break
            holds = holds or known[j]
            ended = w.endswith((".", "।", "،", "؟", "؛"))
            if holds:
                out.append((words[i][0], b - ended))
            if ended:
                break
    return out


def _bare(word: str) -> str:
    return word.rstrip(".।،؟؛")


def _thai_persons(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _TH_NAME.finditer(text):
        a, b = m.span("a") if m.group("a") else m.span("b")
        out.append((a, b))
        if " " in text[a:b]:
            out.append((a, a + text[a:b].index(" ")))
            # a common family name ends where it ends, whatever follows without a space
            rest = a + text[a:b].index(" ") + 1
            out += [(a, rest + len(f)) for f in L.TH_FAMILY if text.startswith(f, rest)]
        out += [(a, a + len(g)) for g in L.TH_GIVEN if text.startswith(g, a)]
    return out


def person_spans(text: str) -> list[tuple[int, int]]:
    out = _latin_persons(text)
    if not text.isascii():
        if _HAN.search(text):
            for m in _LINES.finditer(text):
                line = m.group()
                if _KANA.search(line):
                    out += [(a + m.start(), b + m.start()) for a, b in _japanese_persons(line)]
                elif _HAN.search(line):
                    both = _chinese_persons(line) + (_japanese_persons(line) if len(line) < 200 and not _ZH_LINE.search(line) else [])
                    out += [(a + m.start(), b + m.start()) for a, b in both]
        for name, sign, names, before in _SCRIPTS:
            if sign.search(text):
                out += _spaced_persons(text, name, names, before)
        if _THAI.search(text):
            out += _thai_persons(text)
    return sorted(set(out))


_LINES = re.compile("[^\n]+")
_ZH_LINE = re.compile("[的了是在这们个为与对请电]")
_NUMERIC = re.compile(r"\d[\d .\-/()]{5,}[A-Za-z]?")
_AT = re.compile(r"@|[\[({] ?(?:at|AT|At|a|arroba|ät) ?[\])}]")
_LOCAL = re.compile(r"[A-Za-zÀ-ÿ0-9_.+\-]")
_DOT = re.compile(r" (?:dot|DOT) ")
# Without a match of these in a line there is none of the address pattern in the same place.
_ADDRESS_SIGNS = [
    re.compile(rf"\d[A-Za-z]? [{_UP}][\w'’\-]+ [{_UP}]"),
    re.compile(r"(?<=[a-zß.]) \d{1,4} ?[a-z]?(?:, \d{5} |(?=[.,;:!?)\n]|$| [a-z(]))"),
    re.compile(r"(?:\d|bis|ter|quater),? (?:rue|av|bou|bd|imp|chem|pl|all|quai|cours|route|square|passage)"),
    re.compile(r"Calle|(?<!\w)C/|Avda\.|Av\.|Avenida|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Ctra\."),
    re.compile(r"[県府都道][^\n]{0,40}?\d"),
    re.compile(r"〒"),
    re.compile(r"市[^\n]{0,40}?号"),
]
_ADDRESS_HINTS = [(), ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ring", "ufer", "damm", "steig", "hof", "stieg", "chaussee", "Straße", "Strasse", "Str.", "Allee", "Weg", "Platz", "Ring", "Damm", "Am ", "An de", "Auf de", "Im ", "In der ", "Zum ", "Zur ", "Unter den ", "Hinter der "), (), ("Calle", "C/", "Avda.", "Av.", "Avenida", "Plaza", "Pza.", "Paseo", "P.º", "Camino", "Ronda", "Travesía", "Carretera", "Ctra."), ("県", "府", "都", "道"), ("〒",), ("号",)]


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, format, start, end)"""
    out = [(0, 0, a, b) for a, b in person_spans(text)]
    flat = text.translate(_FOLD) if _FOLDED.search(text) else text
    done = 0
    for m in _AT.finditer(flat):
        start = m.start()
        if start and flat[start - 1] == " ":
            start -= 1
        while start > done and _LOCAL.match(flat, start - 1):
            start -= 1
        while start < m.start():  # a local part begins with a letter or digit
            if x := _EMAIL.match(flat, start):
                out.append((1, 0, *x.span()))
                done = x.end()
                break
            start += 1
            while start < m.start() and flat[start - 1] not in ".+-":
                start += 1
    if _DOT.search(flat):
        out += [(1, 1, *x.span()) for x in _EMAIL_WORDS.finditer(flat)]
    for m in _NUMERIC.finditer(flat):
        if sum(map(str.isdigit, m.group())) < 6:
            continue
        a, b = max(0, m.start() - 4), m.end() + 4
        for kind, patterns in ((2, _PHONES), (3, _IDS)):
            for f, rx in enumerate(patterns):
                out += [(kind, f, *x.span()) for x in rx.finditer(flat, a, b)]
    out += [(3, len(_IDS), *x.span()) for x in _LETTERED.finditer(flat)]
    for f, (sign, rx) in enumerate(zip(_ADDRESS_SIGNS, _ADDRESSES, strict=True)):
        if (hints := _ADDRESS_HINTS[f]) and not any(h in text for h in hints):
            continue
        upto = 0
        for m in sign.finditer(flat):
            if m.start() < upto:
                continue  # its line is searched already
            upto = flat.find("\n", m.end())
            upto = len(flat) if upto < 0 else upto
            start = flat.rfind("\n", 0, m.start()) + 1
            for x in rx.finditer(flat, start, upto):
                out.append((4, f, *x.span()))
                if f in (4, 6):  # without spaces, where the town's name begins is for the model to say
                    out += [(4, f, y.start(), y.end()) for k in range(x.start() + 1, x.start() + 5) if (y := rx.match(flat, k)) and y.end() == x.end()]
    return sorted(set(out))


# --- features

# A left context has one class of the word before, a right one of the sign or word behind.
_LEFT_SETS = (L.TITLES, L.GREETINGS, L.DETERMINERS, L.PREPOSITIONS, L.CONJUNCTIONS, L.LABELS, L.ROLES, L.BEFORE)
_N_LEFT, _N_RIGHT = 18, 18
_BULLET = re.compile(r"(?:[#>*•\-–]+|\d{1,3}[.)]|[A-Za-z][.):])$")


def _categories() -> dict[str, int]:
    out: dict[str, int] = {}
    for k, words in enumerate(_LEFT_SETS):
        for w in words:
            out[w] = out.get(w, 0) | 1 << k
    return out


_LEFT_OF = _categories()


@cache
def _word_class(word: str) -> int:
    bare = word.lower().rstrip(".").lstrip("(„«\"'“‘¿¡")
    bits = _LEFT_OF.get(bare, 0) or _LEFT_OF.get(bare.rpartition("'")[2].rpartition("’")[2], 0)
    if bits:
        return bits
    if bare[:1].islower():
        return 1 << 8
    if bare[:1].isdigit():
        return 1 << 9
    return 1 << 10 if bare[:1].isalpha() else 0


def _left_bits(text: str, a: int) -> int:
    word, gap = _before(text, a)
    if not word:
        return 1 << 11 if "\t" not in gap else 1 << 11 | 1 << 15
    bits = 0
    end = word[-1]
    start = a - len(gap) - len(word)
    if _BULLET.fullmatch(word) and (start == 0 or text[start - 1] == "\n"):
        return 1 << 11 | 1 << 17
    if end in ".!?。！？…।":
        known = _word_class(word)
        bits = known & 0xFF if known & 1 else 1 << 12
    elif end in ",，、،":
        bits = 1 << 13 | _word_class(word[:-1]) & 0b10100011
    elif end in ":：":
        bits = 1 << 14 | _word_class(word[:-1]) & 0xFF
    elif end in ";|/\t<([（「【；":
        bits = 1 << 15
    elif end in "\"'“”«»„‘’":
        bits = 1 << 16
    else:
        bits = _word_class(word)
    return bits | (1 << 15 if "\t" in gap else 0)


_RIGHT_WORD = re.compile(r"[^\s.,;:!?()<>|/\"“”«»]+")


def _right_bits(text: str, b: int) -> int:
    tail = text[b : b + 32]
    if not tail or tail[0] in "\n\r":
        return 1 << 6
    gap = tail[0] in " \t"
    rest = tail.lstrip(" ")
    if not rest or rest[0] in "\n\r":
        return 1 << 6
    ch = rest[0]
    if ch in ",，、":
        return 1 << 7
    if ch in ".!?。！？।":
        return 1 << 8
    if ch in "([（":
        return 1 << 9
    if ch == "<":
        return 1 << 10
    if ch in ";|/\t；":
        return 1 << 11
    if ch in "'’":
        return 1 << 12
    if ch in ":：":
        return 1 << 13
    if ch in "\"”»)]）」":
        return 1 << 14
    if ch.isdigit():
        return 1 << 5
    m = _RIGHT_WORD.match(rest)
    if not m:
        return 1 << 15
    word = m.group()
    low = word.lower()
    bits = 0
    if low in L.AFTER:
        bits |= 1
    if low in L.CONJUNCTIONS:
        bits |= 1 << 2
    if low in L.PREPOSITIONS:
        bits |= 1 << 3
    if bits:
        return bits
    if word[0].isupper():
        return 1 << 4
    return (1 << 1) | (1 << 16 if not gap else 0) | (1 << 17 if low.endswith(("ed", "te", "ten", "s", "ó", "aba", "ait", "t")) else 0)


def _boundary(words: list[str]) -> re.Pattern[str]:
    latin = [re.escape(w) for w in words if w.isascii() or w[0].lower() in "abcdefghijklmnopqrstuvwxyzäöüéèñ"]
    other = [re.escape(w) for w in words if re.escape(w) not in latin]
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(latin, key=len, reverse=True))})(?![^\W\d_])|{'|'.join(sorted(other, key=len, reverse=True))}", re.I)


_NEAR = [_boundary(w) for w in (L.PHONE_WORDS, L.ID_WORDS, L.CODE_WORDS, L.ADDRESS_WORDS)]
_LOWER_WORDS = re.compile(rf"(?<![\w'’])[{_LOW}]{{2,}}")
_LINE_START = re.compile(r"(?:^|\n)[ \t]*$")
_N_OWN = 33
N_FEATURES = _N_OWN + _N_LEFT + _N_RIGHT
_ONES_LEFT = [1 << k for k in range(_N_LEFT)]
_ONES_RIGHT = [1 << k for k in range(_N_RIGHT)]


class _Line:
    """What is asked of a line once: whether it is German, and whether it is all in capitals or titled."""

    __slots__ = ("end", "german", "share")

    def __init__(self, text: str, a: int):
        start = text.rfind("\n", 0, a) + 1
        self.end = text.find("\n", a)
        if self.end < 0:
            self.end = len(text)
        words = text[start : min(self.end, start + 4000)].split()
        self.german = sum(w in L.GERMAN for w in words)
        self.share = sum(w[0].isupper() for w in words) / max(1, len(words))


def _latin_features(text: str, a: int, b: int, lower: set[str], line: _Line) -> list[float]:
    s = text[a:b]
    tokens = s.replace(",", " ").split()
    words = [t for t in tokens if not (len(t) == 2 and t[1] == ".")]
    low = [w.lower() for w in words]
    things = [w in L.THINGS for w in low]
    ends = [w.endswith(L.THING_ENDS) for w in low]
    given = [w.title() in L.GIVEN_LATIN for w in words]
    seen = [w in lower for w in low]
    next_capital = text[b : b + 1] == " " and text[b + 1 : b + 2].isupper()
    word, gap = _before(text, a)
    last_capital = gap == " " and word[:1].isupper() and word[-1:].isalpha() and word.lower() not in L.FUNCTION
    return [
        len(words), len(tokens) - len(words), "," in s, s.isupper(), any(t[0].islower() for t in tokens),
        sum(things), things[0], things[-1], sum(ends), ends[-1],
        sum(given), given[0], given[-1], sum(seen), seen[0], seen[-1],
        last_capital, next_capital, last_capital and word.lower().rstrip(",") in L.ROLES, last_capital and (word.title() in L.GIVEN_LATIN),
        min(line.german, 4), line.share, len(tokens[0]) == 2 and tokens[0][1] == ".", min(len(w) for w in words),
        last_capital and word.lower() in L.THINGS, low[0] in L.ROLES, next_capital and text[b + 1 : b + 24].split(" ")[0].rstrip(".,;:!?)").lower() in L.THINGS, any(len(w) < 3 for w in words), 0, 1, 0, 0, 0,
    ]


def _han_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    bare = s.replace(" ", "").replace("　", "")
    before, after = text[a - 1 : a], text[b : b + 1]
    japanese = _KANA.search(text, max(0, a - 40), b + 40) is not None
    double = s[:2] in _ZH_DOUBLE
    family = any(s.startswith(f) for f in _JA_BY_FIRST.get(s[0], ()))
    rest = bare[2:] if double or japanese else bare[1:]
    given = sum(c in (L.JA_GIVEN if japanese else L.ZH_GIVEN) for c in rest)
    honoured = text.startswith(tuple(L.JA_AFTER if japanese else L.ZH_AFTER), b)
    return [
        len(bare), len(bare) != len(s), double, family, given, given == len(rest) and len(rest) > 0, honoured, japanese,
        _HAN.match(before) is not None, before in "由请找向给对和与跟、，。：:「“(（是让为托经", before == "", before in L.ZH_STOP and before != "",
        _HAN.match(after) is not None, after in "，。、；！？：（(,;.|/<\t\n 　」”", after == "", after in "的说在是将已主负签提编审记住于会向对把和与为要曾来到打写表建发", after in "はがをにもとのでへ", before in "のはがをにでとへ、",
        s[-1] in L.JA_THINGS, bare[0] in L.ZH_SINGLE, bare[:2] in L.ZH_WORDS, sum(c in L.JA_THINGS for c in bare), s[-1] in L.JA_GIVEN, text[a - 2 : a] in ("担当", "係の", "姓名", "名：", "人：", "者：", "は、", "者は", "系人", "理人"),
        _KANA.search(bare) is not None, text[b : b + 2] in _ZH_AFTER_TWO, bare[-2:] in L.ZH_WORDS or text[b - 1 : b + 1] in L.ZH_WORDS, before == " " or before == "\t", 1, 0,
        sum(bare[k : k + 2] in _HAN_WORDS for k in range(len(bare) - 1)), before + bare[0] in _HAN_WORDS, bare[-1] + after in _HAN_WORDS,
    ]


_HAN_WORDS = frozenset(w[k : k + 2] for w in (*L.JA_COMMON, *L.ZH_COMMON, *L.ZH_WORDS) for k in range(len(w) - 1))
_ZH_AFTER_TWO = frozenset("负责 主持 签字 签署 签名 电话 表示 提出 提交 编写 起草 审核 审批 批准 住在 住址 说明 记录 已经 将于 参加 出席 同意 认为 担任 联系 通知 回复 修改 先生 女士".split())


def _other_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    words = s.split()
    out = [0.0] * _N_OWN
    out[0], out[28], out[29] = len(words), 2, 2
    for k, (_, sign, names, before) in enumerate(_SCRIPTS):
        if sign.match(s):
            word, gap = _before(text, a)
            out[10], out[11], out[12] = sum(_bare(w) in names for w in words), _bare(words[0]) in names, _bare(words[-1]) in names
            out[6], out[20] = word in before and gap == " ", k
            out[7] = text[b : b + 8].split(" ")[1:2] != [] and text[b : b + 8].split(" ")[1] in L.HI_AFTER
            nxt = text[b + 1 : b + 24].split(" ")[0] if text[b : b + 1] == " " else ""
            out[8] = _bare(nxt) in names
            out[9] = word in names and gap == " "
            return out
    out[20] = 3
    out[6] = text[:a].endswith(tuple(L.TH_BEFORE)) if a < 64 else text[a - 16 : a].rstrip().endswith(tuple(L.TH_BEFORE))
    out[10], out[11], out[12] = sum(w in _TH_PARTS for w in words), words[0] in _TH_PARTS, words[-1] in _TH_PARTS
    out[13], out[14] = max(len(w) for w in words), _THAI.match(text[b : b + 1]) is not None
    out[15] = text[b : b + 1] == " "
    return out


def features(text: str, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    if not spans:
        return np.zeros((0, N_FEATURES), dtype=np.float32)
    rows: list[list[float]] = []
    lower: set[str] | None = None
    line: _Line | None = None
    left: dict[int, list[bool]] = {}
    right: dict[int, list[bool]] = {}
    for kind, form, a, b in spans:
        if kind == 0:
            first = text[a]
            if first.isascii() or "À" <= first <= "ž":
                if lower is None:
                    lower = set(_LOWER_WORDS.findall(text))
                if line is None or a >= line.end:
                    line = _Line(text, a)
                own = _latin_features(text, a, b, lower, line)
            else:
                own = _han_features(text, a, b) if "一" <= first <= "鿿" or first == "々" else _other_features(text, a, b)
        else:
            s = text[a:b]
            far, near = text[max(0, a - 60) : a], text[max(0, a - 18) : a]
            far = far[far.rfind("\n") + 1 :]
            behind = text[b : b + 12]
            words = [rx.search(far) is not None for rx in _NEAR]
            close = [rx.search(near) is not None for rx in _NEAR]
            own = [
                form, sum(map(str.isdigit, s)), len(s), s[0] in "+(（＋", s[0] in "0０", sum(c in " .-/" for c in s), s.isdigit(), s[-1].isalpha(), s.count("-"), s.count("."),
                s.count(" "), "," in s, sum(map(str.isupper, s)), "@" in s or "＠" in s, *words, *close, text[a - 1 : a] in "#-/_=@№" and a > 0,
                behind[:1] in "%€$£" or behind.lstrip()[:2] in ("MB", "GB", "KB", "ms", "kg", "km"), a > 0 and text[a - 1].isalpha(), text[a - 1 : a] in "(（", s[0] in "12" and s[:3].isdigit(), s[0].isalpha(), s[0] == "〒", kind == 4 and (s[0] in L.ZH_STOP or s[0] in _VERBS or _KANA.match(s) is not None) + 2 * (_HAN.match(text[a - 1 : a]) is not None and text[a - 1] not in L.ZH_STOP and text[a - 1] not in _VERBS),
                0, 0, 0,
            ]
        if a not in left:
            bits = _left_bits(text, a)
            left[a] = [bits & k != 0 for k in _ONES_LEFT]
        if b not in right:
            bits = _right_bits(text, b)
            right[b] = [bits & k != 0 for k in _ONES_RIGHT]
        rows.append([*own, *left[a], *right[b]])
    return np.array(rows, dtype=np.float32)


# --- models


GROUPS = 7  # models: of persons in Latin script, in ideographs, in other scripts; of the other kinds


def groups_of(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The model that judges each span."""
    return np.where(kinds == 0, x[:, 28].astype(np.int64), kinds + 2)


@cache
def models(n: int = TRAINING) -> tuple[B.Boosted, ...]:
    """A model of each group of spans, calibrated on a fifth of the paragraphs."""
    x: list[np.ndarray] = []
    y: list[bool] = []
    kinds: list[int] = []
    held: list[bool] = []
    for i, (text, mentions) in enumerate(T.make(n)):
        true = {(KINDS.index(k), a, b) for k, a, b in mentions}
        spans = candidates(text)
        x.append(features(text, spans))
        y += [(s[0], s[2], s[3]) in true for s in spans]
        kinds += [s[0] for s in spans]
        held += [i % 5 == 0] * len(spans)
    fx, fy, fh = np.concatenate(x), np.array(y, dtype=np.float64), np.array(held)
    group = groups_of(np.array(kinds), fx)
    out = []
    for k in range(GROUPS):
        a, b = (group == k) & ~fh, (group == k) & fh
        out.append(B.calibrate(B.fit(fx[a], fy[a]), fx[b], fy[b]))
    return tuple(out)


def choose(spans: list[tuple[int, int, int, int]], p: np.ndarray) -> list[tuple[int, int, int]]:
    """Of overlapping spans the most probable one; longer ones where equal.  (kind, start, end)"""
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []  # in order of their starts
    for i in sorted(range(len(spans)), key=lambda i: (-round(float(p[i]), 3) - (0.5 if spans[i][0] in (1, 4) else 0.0), spans[i][2] - spans[i][3], spans[i])):
        kind, _, a, b = spans[i]
        at = bisect_left(starts, a)
        if (at == len(starts) or taken[at][1] >= b) and (at == 0 or taken[at - 1][2] <= a):
            starts.insert(at, a)
            taken.insert(at, (kind, a, b))
    return taken


def find(texts: list[str], trained: tuple[B.Boosted, ...]) -> list[list[tuple[int, int, int]]]:
    """The mentions of each text."""
    spans = [candidates(t) for t in texts]
    rows = [features(t, s) for t, s in zip(texts, spans, strict=True)]
    x = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))
    kind = groups_of(np.array([s[0] for own in spans for s in own], dtype=np.int64), x)
    p, least = np.zeros(len(x)), np.ones(len(x))
    for k, model in enumerate(trained):
        if (own := kind == k).any():
            p[own], least[own] = model.probability(x[own]), model.threshold
    out, at = [], 0
    for own in spans:
        q, t = p[at : at + len(own)], least[at : at + len(own)]
        at += len(own)
        kept = np.flatnonzero(q >= t)
        found = choose([own[i] for i in kept], q[kept])
        if any(k == 0 for k, _, _ in found):
            found = beside(own, q, t, found)
        out.append(found)
    return out


def beside(spans: list[tuple[int, int, int, int]], p: np.ndarray, least: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looks again at what stands right beside a person in a run of names, where where one ends is uncertain:
    there a tenth of the threshold is enough, and nothing is asked of what stands between two persons."""
    weak = [i for i in np.flatnonzero(p < least) if spans[i][0] == 0]
    while weak:
        starts, ends = {a for k, a, _ in found if k == 0}, {b for k, _, b in found if k == 0}
        near = [i for i in weak if (spans[i][2] - 1 in ends) + (spans[i][3] + 1 in starts) + (p[i] >= 0.1 * least[i]) >= 2]
        near = [i for i in near if all(b <= spans[i][2] or a >= spans[i][3] for _, a, b in found)]
        if not near:
            break
        best = max(near, key=lambda i: (spans[i][3] - spans[i][2], p[i]))
        found = sorted([*found, (0, spans[best][2], spans[best][3])], key=lambda t: t[1])
        weak = [i for i in weak if i != best]
    return found


def redact(text: str, mentions: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in mentions:
        out += [text[at:a], PLACEHOLDERS[KINDS[kind]]]
        at = b
    return "".join(out) + text[at:]


_FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])
_REDACTED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_mentions", pa.int32())])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def mentions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start_pos, end_pos)"""
    trained = models()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.rechunk(batches, 512):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = [(i, KINDS[k], a, b) for i, own in zip(ids, find(texts, trained), strict=True) if i is not None for k, a, b in own]
            yield C.batch_of(_FOUND, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 4))

    return _rows(df, id_col, text_col).mapInArrow(work, "doc_id long, kind string, start_pos int, end_pos int").distinct()


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_mentions): every row, its text with placeholders; null stays null."""
    trained = models()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.rechunk(batches, 512):
            texts = batch.column(1).to_pylist()
            found = find([t or "" for t in texts], trained)
            new = [None if t is None else redact(t, own) for t, own in zip(texts, found, strict=True)]
            yield C.batch_of(_REDACTED, batch.column(0), new, [len(own) for own in found])

    return _rows(df, id_col, text_col).mapInArrow(work, "doc_id long, text string, n_mentions int")
