"""Sentence units of texts in spaced and spaceless scripts.

A line break always ends a unit.  Within a line the places behind terminators (and in Thai behind spaces, in Chinese and
Japanese also between words) are the nodes of a lattice, and the units between two of them its edges.  A path through
it costs what its breaks cost, the marks they tear, and the units that have no letter or digit; the cheapest one
gives the units.

- A break costs less than nothing where its evidence is for a sentence end, and more where it is against it: the word
  before a full stop (abbreviation, initial, number, ordinal), what comes next (case, digit, address, opening
  mark, a word that opens sentences), and closing marks.
- A quotation or bracket that is closed in the line may be kept whole, which leaves out all breaks in it, or torn once at the
  cost ``TEAR``, after which the breaks in it stand for themselves; so a long one of many sentences is divided.
- Chinese and Japanese lines are segmented by a word lattice over their whole length: words of a dictionary of particles,
  final, reporting and opening words, found at once by an automaton, on the cheapest path.  Behind a closing mark a
  particle or a reporting clause goes on; without a terminator, a final word before an opening word ends a unit.
- Thai: a space before Thai text ends a unit, whatever the words, as the task's definition has it.

All steps are linear in the length of the line, but for a logarithm.

Markers of headings, list items, questions and answers belong to what follows them.  Null and blank texts
have no units.  Repeated rows of an id count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Abbreviations that end no sentence when lower case or a digit follows; those of TITLES
# end none before a capital either.
ABBREVIATIONS = frozenset(
    """a abb abs abt al anm app approx aprox apt art aufl av avda bd bldg bsp bspw bzw ca cap cf ch chap cía co col corp cr
    d dep dept dpt dr dra ed éd eds env esp etc evtl ex exp ext fa fam fig figs ff fn fol fr geb gem gen ggf gov hr hrsg
    inc incl inkl jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil okt dez ene abr ago dic jr kap kl
    l ltd m max mbl mel messrs mgr min mio mlle mm mme mr mrd mrs ms mt nº no nos nr núm núms op p pág págs par pct pos pp
    prof prov pt pta r rd rel rep resp rev rte s sec secc sect sen sgt sig sog sr sra srta srl ss st std str stv subj suppl t tab
    tel tél telf tlf u ud uds univ usw v var verf vgl vol vols vs w z zb ziff zit zzgl""".split()
)
TITLES = frozenset(
    """abb abs abt apt art av avda bd bzw ca cap capt cf ch chap col dept dr dra ed éd ext fa fam fig figs frau gem gen ggf hr
    kap lt maj mio mlle mm mme mr mrd mrs ms no nos nr núm núms p pág págs pp prof rd rev rte sec secc sect sen sgt sr sra srta st str
    tab tel tél telf tlf ud uds vgl vol vols vs z ziff cdt cpl ing lic mgr me""".split()
)
# Words before a German ordinal, and titles in caseless scripts.
BEFORE_ORDINAL = frozenset("am im zum vom beim der die das den dem des jeder jede jedes jeden dieser diese dieses und bis seit ab zur".split())
CASELESS_TITLES = frozenset("د أ م ص ش ط डॉ श्री श्रीमती प्रो पं कु".split())
# The dictionary of the word lattices.
PARTICLES = "と って との という といった とか と、 は が を に で も へ の から まで より など なら".split()
FINAL = "か よ ね な ぞ さ わ だ です ます した する 吗 呢 吧 啊 了 嘛".split()
SURE = frozenset("です ます した する 吗 呢 吧 啊 嘛".split())  # final by themselves; others behind one of these
REPORTING = "问道 说道 答道 写道 喊道 问 说 表示 指出 回答 回复 补充道 強調 尋ねた 言った 述べた 答えた 聞いた 書いた 話した 叫んだ".split()
OPENING = "但是 不过 因此 所以 然后 此外 另外 同时 并且 如果 为什么 しかし そして また なお ただし なぜ そのため さらに".split()
JOINING = "または なおさら".split()  # begin like opening words

SAYING = "尋ね 言っ 述べ 答え".split()
# Words that open sentences in spaced scripts and are no names; behind an abbreviation with inner full stops.
OPENERS = frozenset("the this these those that he she it we they you i there here but and so if when while after before in on at as however what why how who our their his her a an der die das es er sie wir ich und aber wenn le la les il elle nous vous ils on ce cette et mais si el los las ella ellos y pero en".split())

_DICTIONARY = {w: kind for kind, words in (("particle", PARTICLES), ("final", FINAL), ("report", REPORTING), ("opening", OPENING), ("joining", JOINING)) for w in words}
_VOWELS = frozenset("aeiouyáàâäãéèêëíìîïóòôöõúùûüœæ")
# Costs of the lattice.
SURELY, TEAR, EMPTY = 2.0, 12.0, 3.0

_LINES = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_CLOSE = "\"'”’»)]」』）】》"
_TERMINATED = re.compile(rf"[.!?。！？।؟…][.!?。！？।؟…]*(?:[\s  ]?»|[{re.escape(_CLOSE)}“])*")
_MARKER = re.compile(r"\s*(?:[>*•‣▪◦·\-–—]+\s+|#{1,6}\s+|\(?\d{1,3}[.)]\s+|\(?[A-Za-z][)]\s+|[A-Za-z]\.\s+(?=[^\W\d_]{2,}\s+[^\W\d_])|(?:[QA]|[FRP]|問|答|问|ถาม|ตอบ|س|ج|प्र|उ)\s?[:：.]\s*)+")
_QUESTION_MARKER = re.compile(r"(?:[QA]|[FRP]|問|答|问|ถาม|ตอบ|س|ج|प्र|उ)\s?[:：]$")
_THAI_GAP = re.compile(r"[^\S\n]+(?=[฀-๿])")
_WORD = re.compile(r"[^\s(\[{<\"“„«‘‚「『（]*$")
_NEXT = re.compile(r"\S+")
_ADDRESS = re.compile(r"[\w.+\-]+(?:@|\s?[\[(]at[\])])|https?://|www\.")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "（": "）", "(": ")"}
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_SPACES = re.compile(r"\s*")
_SPOKEN = re.compile(r"[。！？!?；]")


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in {*_DICTIONARY, *SAYING}:
        out.add_word(w, w)
    out.make_automaton()
    return out


class Words:
    """The cheapest segmentation of a line into dictionary words and single characters, by where its words start and end.

    A single character costs 1.5, a word 1, so that a word of n saves 1.5 n - 1."""

    def __init__(self, line: str):
        at, saved, chosen = [0], [0.0], [-1]  # the best that ends at or before a place, by places
        found: list[tuple[int, int]] = []
        self.saying: list[int] = []
        for last, w in _automaton().iter(line):
            end = last + 1
            start = end - len(w)
            if w in SAYING:
                self.saying.append(start)
            if w not in _DICTIONARY:
                continue
            value = saved[bisect_right(at, start) - 1] + 1.5 * len(w) - 1
            if value > saved[-1]:
                found.append((start, end))
                if at[-1] == end:
                    saved[-1], chosen[-1] = value, len(found) - 1
                else:
                    at.append(end)
                    saved.append(value)
                    chosen.append(len(found) - 1)
        self.starts: dict[int, str] = {}
        self.ends: dict[int, str] = {}
        k = len(at) - 1
        while k > 0:
            start, end = found[chosen[k]]
            self.starts[start] = self.ends[end] = line[start:end]
            k = bisect_right(at, start) - 1

    def kind_at(self, place: int) -> str | None:
        return _DICTIONARY.get(self.starts.get(place, ""))


def _spans(line: str) -> list[tuple[int, int]]:
    """(opening, closing) of quotations and brackets that are closed in the line."""
    out, stack = [], []
    for m in _MARKS.finditer(line):
        i, ch = m.start(), m.group()
        if stack and ch == stack[-1][1] and (ch not in "\"'’" or i + 1 == len(line) or not line[i + 1].isalnum()):
            out.append((stack.pop()[0], i))
        elif ch in _PAIRS and not (ch == "“" and stack and stack[-1][1] == "“"):
            stack.append((i, _PAIRS[ch]))
        elif ch == '"' and (i == 0 or not line[i - 1].isalnum() and line[i - 1] not in ".!?,।") and i + 1 < len(line) and not line[i + 1].isspace():
            stack.append((i, '"'))
        elif ch == "‘" and i + 1 < len(line) and not line[i + 1].isspace():
            stack.append((i, "’"))
    return out


_MARKS = re.compile("[" + re.escape("".join({*_PAIRS, *_PAIRS.values(), '"', "‘", "’", "'"})) + "]")


class _Marks:
    """The quotations and brackets of a line, and which outermost one holds a place."""

    def __init__(self, line: str):
        spans = _spans(line)
        self.opened = {b: a for a, b in spans}
        self.outer: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if not self.outer or a > self.outer[-1][1]:
                self.outer.append((a, b))
        self._starts = [a for a, _ in self.outer]

    def around(self, at: int, end: int) -> int:
        """The outermost one that holds line[at:end] and goes on behind it, or -1."""
        k = bisect_left(self._starts, at) - 1
        return k if k >= 0 and self.outer[k][1] >= end else -1


def _script(line: str) -> str:
    if _CJK.search(line):
        return "cjk"
    return "thai" if any("฀" <= c <= "๿" for c in line) else "spaced"


def _word_before(line: str, end: int) -> str:
    """The word that ends before a place, up to a blank."""
    while end and line[end - 1].isspace():
        end -= 1
    return line[line.rfind(" ", 0, end) + 1 : end]


def _full_stop(line: str, at: int, after: str, place: int) -> float:
    """What a break at a full stop costs; after: the next character behind spaces, at a place."""
    word = _WORD.search(line[max(0, at - 40) : at]).group()
    lower = word.lower().lstrip("'’")
    if "-" in lower and lower.rpartition("-")[2] in TITLES:
        lower = lower.rpartition("-")[2]
    if not word:
        return -SURELY
    if _ADDRESS.match(line, place):
        return -SURELY if lower not in TITLES and not (len(word) == 1 and word.isalpha()) else SURELY
    if word in CASELESS_TITLES:
        return SURELY
    opens = _NEXT.match(line, place).group().rstrip(".,;:!?").lower() in OPENERS
    single = len(word) == 1 and word.isalpha()
    if single or _DOTTED.fullmatch(word):
        before = _word_before(line, at - len(word))
        if single and word.isupper() and before[-1:].isdigit() and not after.isdigit():
            return -SURELY  # the last letter of a number
        if lower in ("a.m", "p.m"):
            return -SURELY if after.isupper() or not after.isalnum() else SURELY
        return -1.0 if not single and after.isupper() and opens else SURELY
    if after.islower():
        return -SURELY if lower not in ABBREVIATIONS and len(word) > 3 and not word[0].isdigit() else SURELY
    if after.isdigit():
        return -SURELY if lower not in ABBREVIATIONS else SURELY
    if word.isdigit() and len(word) <= 2 and after.isupper():
        before = _word_before(line, at - len(word)).lower().lstrip("(„\"«")
        return -SURELY if before not in BEFORE_ORDINAL else SURELY
    if lower in TITLES:
        return SURELY
    if word[0].isupper() and word.isalpha() and word.isascii() and 1 < len(word) < 6 and not word.isupper() and not _VOWELS & set(lower):
        return 1.0 if not opens else -1.0  # letters without a vowel are an abbreviation, unless a sentence plainly opens
    return -SURELY


def _goes_on(line: str, end: int, opened: int, words: Words, clauses: list[int]) -> bool:
    """Whether a sentence in a spaceless script goes on behind a closing mark: opened is where the mark opens."""
    place = _SPACES.match(line, end).end()
    if place == len(line) or place > end and not _CJK.match(line[place]):
        return False
    kind = words.kind_at(place)
    if kind == "particle":
        return True
    if kind == "opening":
        return False
    lead = opened
    while lead and line[lead - 1].isspace():
        lead -= 1
    before = line[lead - 1 : lead]
    if before and before in "：:，,、":
        return kind == "report"
    if line[opened] in "（(":
        while lead and line[lead - 1] not in "。！？!?」』）”":
            if line[lead - 1].isalnum():
                return not _MARKER.fullmatch(line, 0, opened)
            lead -= 1
        return False
    k = bisect_left(clauses, end)
    stop = clauses[k] if k < len(clauses) else len(line)
    said = bisect_left(words.saying, end)
    if said < len(words.saying) and words.saying[said] < stop:
        return True
    while stop > end and (line[stop - 1].isspace() or line[stop - 1] in "：:，,"):
        stop -= 1
    return any(line.endswith(w, end, stop) for w in REPORTING)


def _cost(line: str, at: int, end: int, marks: _Marks, words: Words | None, clauses: list[int]) -> float | None:
    """What a break behind line[at:end] costs, a run of terminators with closing marks; None if it is no place for one."""
    place = _SPACES.match(line, end).end()
    if place == len(line):
        return -SURELY
    gap, after = place - end, line[place]
    cjk = words is not None
    dots = at
    while dots < end and line[dots] in ".!?。！？।؟…":
        dots += 1
    ends, closers = line[at:dots], line[dots:end].strip()
    last = ends[-1]
    wide = last in "。！？" or cjk and last == "…"
    if not gap and not wide and last not in "।؟" and not closers and after not in "¿¡" and not _CJK.match(after):
        if last == "." or after.isalnum() or after in ",;:)]}’'\"/":
            return None
    if after in ",;:，；：、":
        return None
    if last == "…" or ends.endswith(".."):
        return -SURELY if after.isupper() or after in "¿¡«„“\"「" and not wide else SURELY
    if closers:
        opened = next((marks.opened[b] for b in range(at + 1, end) if b in marks.opened), None)
        if wide or _CJK.match(after):
            if opened is not None and cjk:
                return SURELY if _goes_on(line, end, opened, words, clauses) else -SURELY
            return SURELY if cjk and words.kind_at(place) in ("particle", "report") else -SURELY
        if after.islower():
            return -SURELY if _ADDRESS.match(line, place) else SURELY
        if last in "؟?!" and ("؀" <= after <= "ۿ" or "ऀ" <= after <= "ॿ"):
            # caseless: the quotation is all of it only if a colon doesn't open it and nothing follows
            return -SURELY if closers[-1] in ")）" else SURELY
        if last == "." and closers[-1] in ")]":
            return -SURELY if opened is not None and _SPACES.match(line).end() >= opened else _full_stop(line, at, after, place)
        return -SURELY
    if last in "!?":
        return -SURELY if not after.islower() or _ADDRESS.match(line, place) or gap and ends not in "!?" and len(ends) > 1 else SURELY
    if last == ".":
        return _full_stop(line, at, after, place)
    return -SURELY


def _bare_gaps(line: str, first: int, words: Words, clauses: list[int]) -> list[tuple[int, float]]:
    """Places in a spaceless script without terminator: what a break costs between a final and an opening word."""
    out = []
    for start in sorted(words.starts):
        if start <= first or _DICTIONARY[words.starts[start]] != "opening":
            continue
        lead = start
        while lead > first and line[lead - 1].isspace():
            lead -= 1
        k = bisect_left(clauses, lead) - 1
        begin = max(first, clauses[k] + 1 if k >= 0 else 0)
        if lead - begin < 4 or not _CJK.match(line[lead - 1]):
            continue
        end, n = lead, 0
        while end in words.ends and _DICTIONARY[words.ends[end]] == "final":
            w = words.ends[end]
            n += 1
            if w in SURE:
                out.append((lead, -SURELY))
                break
            end -= len(w)
        else:
            out.append((lead, SURELY))
    return out


def _cheapest(line: str, first: int, gaps: list[tuple[int, float]]) -> list[int]:
    """The breaks of the cheapest path over places (end, cost), in order: a unit without a letter or digit costs EMPTY."""
    # the best path that ends at each place; of those before, the best with a letter since, and those without one
    nodes: list[tuple[int, int]] = []  # (place, node before)
    best_cost, best_node = 0.0, -1
    near: list[tuple[float, int]] = []  # (cost, node), no letter since
    seen = first
    letters = False
    for place, cost in gaps:
        if any(c.isalnum() for c in line[seen:place]):
            for c, node in near:
                if c < best_cost:
                    best_cost, best_node = c, node
            near, letters = [], True
        seen = place
        options = [(c + EMPTY, node) for c, node in near]
        options.append((best_cost + (0.0 if letters else EMPTY), best_node))
        c, node = min(options)
        nodes.append((place, node))
        near.append((c + cost, len(nodes) - 1))
        near = sorted(near)[:2] if len(near) > 2 else near  # a dearer one of these can't become the best
    c, node = min([*near, (best_cost, best_node)])
    out = []
    while node >= 0:
        out.append(nodes[node][0])
        node = nodes[node][1]
    return out[::-1]


def _line_units(line: str) -> list[int]:
    """Offsets in the line behind its units."""
    stop = len(line.rstrip())
    if not stop:
        return []
    marker = _MARKER.match(line)
    first = marker.end() if marker and marker.end() < stop else 0
    script = _script(line)
    marks = _Marks(line)
    words = Words(line) if script == "cjk" else None
    clauses = [m.start() for m in _SPOKEN.finditer(line)] if words else []
    gaps: list[tuple[int, float, int]] = []  # (end, cost, the quotation or bracket it is in)
    for m in _TERMINATED.finditer(line, first):
        end = m.end()
        if line[end - 1] == "“" and end < stop and not line[end].isspace() and end - 1 not in marks.opened:
            end -= 1  # it opens the next quotation
            while end > m.start() + 1 and line[end - 1] == "“":
                end -= 1
        if end >= stop:
            break
        if (cost := _cost(line, m.start(), end, marks, words, clauses)) is not None:
            gaps.append((end, cost, marks.around(m.start(), end)))
    if words:
        gaps += [(end, cost, marks.around(end, end + 1)) for end, cost in _bare_gaps(line, first, words, clauses)]
    if script == "thai":
        lead = _SPACES.match(line).end()
        for m in _THAI_GAP.finditer(line, first):
            end = m.start()
            if m.end() > first and not (marker and m.end() <= marker.end()) and end > lead and not _QUESTION_MARKER.search(line, max(0, end - 12), end):
                gaps.append((end, -SURELY, -1))
    # a quotation is kept whole, or torn where the breaks in it are worth more than that
    worth: dict[int, float] = {}
    for _, cost, k in gaps:
        if k >= 0 and cost < 0:
            worth[k] = worth.get(k, 0.0) + cost
    kept = sorted((end, cost) for end, cost, k in gaps if end < stop and (k < 0 or worth.get(k, 0.0) + TEAR < 0))
    return sorted(set(_cheapest(line, first, kept))) + [stop]


def units(text: str) -> list[int]:
    """The offset behind the last non-whitespace character of each unit."""
    out = []
    for m in _LINES.finditer(text):
        at = m.start()
        out += [at + e for e in _line_units(m.group())]
    return out


_ENDS = pa.schema([("id", pa.string()), ("ends", pa.list_(pa.int32()))])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.rechunk(batches, 1024):
        ids, ends = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is not None and t and (e := units(t)):
                ids.append(i)
                ends.append(e)
        yield C.batch_of(_ENDS, ids, ends)


def unit_ends(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, unit_end)"""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter("t is not null")
    rows = C.spread(rows)
    ends = rows.mapInArrow(_units, "id string, ends array<int>").dropDuplicates(["id"])
    return ends.select("id", F.explode("ends").alias("unit_end"))


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, unit_no, unit_end, text): the units with their texts."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter("t is not null")
    rows = C.spread(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.rechunk(batches, 1024):
            kept = [(i, t, e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and t and (e := units(t))]
            parts = [[{"unit_end": b, "text": t[a:b].strip()} for a, b in zip([0, *e], e, strict=False)] for _, t, e in kept]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in kept], pa.string()), pa.array(parts, pa.list_(pa.struct([("unit_end", pa.int32()), ("text", pa.string())])))], names=["id", "units"])

    found = rows.mapInArrow(cut, "id string, units array<struct<unit_end:int,text:string>>").dropDuplicates(["id"])
    return found.select("id", F.posexplode("units").alias("unit_no", "u")).select("id", "unit_no", "u.unit_end", "u.text")
