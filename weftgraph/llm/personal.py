"""Personal information inside free text.

Method: generators of high recall propose spans, which may overlap; features of format and
context go to boosted trees, one model for each kind; the best of overlapping spans whose
probability passes the kind's calibrated threshold is replaced.

The trees are fitted on a labelled sample of bounded size: ``labelled_sample`` writes it from
frames of general knowledge (``personal_seeds``), so the model is the same at every corpus
size.  A threshold is calibrated on frames that the fit of that half didn't see.  Whether a
word is an everyday one is read off the whole words of public vocabularies (two files of
some 0.8 MB, a parameter); their set is sent to the executors with the trees.
The corpus passes once, in Arrow batches without an exchange, whole texts at a time.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.boosting import Boosted
from weftgraph.llm.personal_seeds import CUES, FUNCTION_WORDS, GIVEN_NAMES, LOWER_CUES, PARTICLES, PERSON_LABELS, PLACE_WORDS, ROADS, SURNAME_ENDINGS, TITLES, labelled_sample

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Public vocabularies whose whole words count as everyday ones.
DEFAULT_VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

_U, _L = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĢĪĮŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ", "a-zß-öø-ÿāăąćčďđēėęěģīįłńňōőœřśşšťūůűźżž"
_A = _U + _L
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*(?:@| @ |\(at\)|\[at\]| \[at\] | \(at\) )[A-Za-z0-9-]+(?:(?:\.| \[dot\] | \(dot\) |\[dot\])[A-Za-z0-9-]+)*")
#: Five digits or more, with single separators; what may stand around them is looked at after.
_NUMBER = re.compile(r"\d(?:(?:\)[ \u00a0]?|[ \u00a0]\(|[ \u00a0.\-/])?\d){4,18}")
_LEFT = re.compile(r"(?:(?<![A-Za-z0-9.,:/_#$€£-])(?:\+ ?|\()|(?<![A-Za-z0-9_-])[A-Z]{1,3}[ -]?|(?<![A-Za-z0-9.,:/_#$€£+(-]))$")
_RIGHT = re.compile(r"((?:[ -]?[A-Z])?)(?![A-Za-z0-9_]|[.:,\-/]\d)")
#: A word of an address has at most 60 letters and a number six digits, so the longest address
#: fits the windows on both sides of its road word.
_W = "{0,60}"
_BEFORE_ROAD, _AFTER_ROAD = 260, 300
_TOWN = rf"[{_A}][{_A}'-]{_W}(?: [{_U}][{_A}'-]{_W}){{0,2}}"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Suite|Unit|Room) \d{1,6}[A-Za-z]?|\d{1,3}º ?[A-Z]?)"
_TAIL = rf"(?:,[  ]{_UNIT})?,[  ](?:\d{{4,5}}[  ])?{_TOWN}(?:[  ][A-Z]{{1,2}}\d{{1,2}}[A-Z]?[  ]\d[A-Z]{{2}}|,?[  ]\d{{4,5}})?(?![A-Za-z0-9])"
_WORDS = rf"[{_A}][{_A}'-]{_W}(?:[  ][{_U}][{_A}'-]{_W}){{0,2}}"
_ADDRESS = [
    re.compile(rf"(?<![A-Za-z0-9])(?:{_UNIT},[  ])?\d{{1,6}}[a-z]?,?[  ]{_WORDS}[  ](?:{'|'.join(ROADS['after'])}|{'|'.join(w.lower() for w in ROADS['after'])})(?![{_A}])\.?(?:{_TAIL})?"),
    re.compile(rf"(?<![A-Za-z0-9])\d{{1,6}}[a-z]?(?:[  ]bis|[  ]ter)?,?[  ](?:{'|'.join(ROADS['before_fr'])})[  ](?:de[  ](?:la[  ])?|du[  ]|des[  ])?{_WORDS}(?:{_TAIL})?"),
    re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(ROADS['before_number'])})[  ](?:de[  ](?:la[  ])?)?{_WORDS}[  ]\d{{1,6}}[a-z]?(?:{_TAIL})?"),
    re.compile(rf"(?<![{_A}0-9])(?:[{_A}-]{{1,60}}(?:{'|'.join(ROADS['joined'])})|[{_A}-]{{1,60}}[  ](?:{'|'.join(ROADS['apart'])}))[  ]\d{{1,6}}[  ]?[a-z]?(?:{_TAIL})?(?![A-Za-z0-9])"),
]
_PARTICLES = {w for p in PARTICLES for w in p.split()}
_PART = "(?:" + "|".join(PARTICLES) + ")"
_BEFORE = re.compile(rf"[{_A}0-9@._-]")
_INITIAL = re.compile(rf"(?:[{_U}]\.[  ]){{1,2}}(?:{_PART}[  ])?[{_U}][{_L}]+(?:-[{_U}][{_L}]+)?(?![{_A}0-9@_])")
#: A word that may be part of a name, and what may stand between two.
_NAME_WORD = re.compile(rf"[{_U}](?<![{_A}0-9@._-].)(?:\.(?=[  ])|(?:(?:(?:(?<=M)a?c|(?<=[OD])['’])[{_U}])?[{_L}]+|[{_U}]+)(?:-(?:[{_U}][{_L}'’]+|[{_U}]{{2,}}))*(?![{_A}0-9@_]|\.[a-z]|-\d))")
_GAP = re.compile(rf",?[  ](?:{_PART}[  ])?")
_LEADING = re.compile(rf"(?<![{_A}0-9@._-])(?:{_PART})[  ]$")
#: Names in small letters are proposed only at the beginning of a line or right after a cue.
_PAIR = re.compile(rf"(?<![{_A}0-9@._-])([{_L}'’]{{2,}}(?:[  ]{_PART})?[  ][{_L}'’]{{2,}}(?:-[{_L}]{{2,}})?)(?![{_A}0-9@_(]|\.[a-z]|-\d)")
_CUE_BEFORE = re.compile(rf"([{_A}]+|[\u3040-\u9fff]+)[.\"'*  :=|：]*$")
_CUE_WORDS = {*LOWER_CUES, *FUNCTION_WORDS}
_MARKS = ".,;:!?\"'()[]{}|*<>`…。、"
_strip = methodcaller("strip", _MARKS)
_LABELS = {"ID", "NR", "NO", "TEL", "SSN", "FAX", "NIF", "DNI"}
_DIGIT = re.compile(r"\d")
_DATE = re.compile(r"(?:19|20)\d\d-[01]\d(?:-[0-3]\d)?")


@lru_cache(maxsize=1)
def _automaton():
    """One pass over a text finds road words and marks of addresses."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for mark in ("@", "(at)", "[at]"):
        a.add_word(mark, ("@", len(mark)))
    roads: dict[str, list[int]] = {}
    for words, pattern in zip(ROADS.values(), (0, 1, 2, 3, 3), strict=True):
        for w in words:
            for form in {w, w.capitalize(), w.lower() if len(w) > 3 else w}:
                roads.setdefault(form, []).append(pattern)
    for form, patterns in roads.items():
        a.add_word(form, (tuple(patterns), len(form)))
    a.make_automaton()
    return a


def word_counts(text: str) -> Counter:
    """How often each word of the text occurs, as it is written."""
    return Counter(map(_strip, text.split()))


def candidates(text: str, words: Words, counts: Counter) -> list[tuple[str, int, int]]:
    """``(generator, start, end)`` of all spans that may be personal; they may overlap."""
    found: set[tuple[str, int, int]] = set()
    for end, (kind, size) in _automaton().iter(text):
        at, end = end + 1 - size, end + 1
        if kind == "@":
            start = at - 1 if text[at - 1 : at] == " " else at
            while start and _LOCAL.match(text[start - 1]):
                start -= 1
            while text[start : start + 1] == ".":
                start += 1
            if (m := _EMAIL.match(text, start)) and m.start() <= at < m.end():
                found.add(("email", m.start(), m.end()))
        elif not text[end : end + 1].isalpha():
            left, right = max(0, at - _BEFORE_ROAD), min(len(text), end + _AFTER_ROAD)
            for pattern in kind:
                if (pattern == 3 or not text[at - 1 : at].isalpha()) and _DIGIT.search(text, *((left, at) if pattern < 2 else (end, right))):
                    for m in _ADDRESS[pattern].finditer(text, left, right):
                        if m.start() <= at < m.end():
                            found.add(("address", m.start(), m.end()))
                        elif m.start() > at:
                            break
    for m in _NUMBER.finditer(text):
        if _DATE.fullmatch(m[0]):
            continue
        at, end = m.span()
        left, right = _LEFT.search(text, max(0, at - 6), at), _RIGHT.match(text, end)
        if left and right and sum(map(str.isdigit, m[0])) >= 6:
            letters = left[0].strip(" -").isalpha()
            if letters and left[0].strip(" -") in _LABELS:
                letters = False
            else:
                at = left.start()
            stop = right.end(1) if not right[1] or letters or right[1][0] != " " else end
            found.add(("number", at, stop))
    for m in _INITIAL.finditer(text):
        if not _BEFORE.match(text[m.start() - 1 : m.start()] or " "):
            found.add(("name", m.start(), m.end()))
    found |= {("name", at, end) for at, end in _small_names(text, words, counts)}
    found |= {("name", at, end) for at, end in _runs(text)}
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _small_names(text: str, words: Words, counts: Counter) -> Iterator[tuple[int, int]]:
    """Two words in small letters, neither an everyday one, at the beginning of a line or after a cue."""
    rare = {w for w in counts if w.islower() and len(w) > 1 and not words.everyday(w)}
    for first in rare:
        at = text.find(first)
        while at >= 0:
            if (m := _PAIR.match(text, at)) and m[1].startswith(first + m[1][len(first)]) and m[1].split()[-1] in rare:
                line = text[max(text.rfind("\n", 0, at), text.rfind("\r", 0, at), at - 40) + 1 : at]
                before = _CUE_BEFORE.search(line)
                if not line.strip(" >*|-[]xX\xa0") or before and before[1].lower() in _CUE_WORDS:
                    yield m.span(1)
            at = text.find(first, at + 1)


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Any two to four capitalised words in a row, with particles and initials, or ``Surname, Given``."""
    words = list(_NAME_WORD.finditer(text))
    for i, first in enumerate(words):
        if first[0].lower() in FUNCTION_WORDS:  # no name begins with one
            continue
        full, comma = int(first[0][-1] != "."), False
        for j in range(i + 1, min(i + 4, len(words))):
            gap = text[words[j - 1].end() : words[j].start()]
            if len(gap) > 12 or not _GAP.fullmatch(gap) or comma or gap[0] == "," and (j > i + 1 or not full):
                break
            comma = gap[0] == ","
            if words[j][0][-1] != ".":
                full += 1
                if full > 1:
                    yield first.start(), words[j].end()
                    if m := _LEADING.search(text, max(0, first.start() - 10), first.start()):
                        yield m.start(), words[j].end()


_GENERATORS = {"email": ("email",), "number": ("phone", "identity_number"), "address": ("street_address",), "name": ("person_name",)}
_CUE = {k: re.compile(v, re.IGNORECASE) for k, v in CUES.items()}
_GIVEN = {n.lower() for n in GIVEN_NAMES}
_ENDS = tuple(sorted(SURNAME_ENDINGS, key=len))
_LETTERS = re.compile(rf"[{_A}]+")
_DIGIT_BELOW = re.compile(r"[^\S\n]*\r?\n.{0,40}\d")
_NOUN_ENDS = ("ere", "eren", "erer", "ige", "igen", "liche", "lichen", "ischen", "ung", "ungen", "heit", "keit", "schaft", "tion", "tät", "nis", "ismus", "lich", "ische", "ment", "ness", "ción", "dad")
_LABEL_BEFORE = re.compile(rf"([{_A}]+|[\u3040-\u9fff]+)[\"'*]{{0,3}}\s*[:=|：\t]\s*[\"'*]{{0,3}}$")
_NEXT = re.compile(rf"[  ]([{_A}]+)")
_AGENTS, _RECEIVERS = {"by", "von", "durch", "par", "por", "da"}, {"to", "from", "with", "except", "an", "à", "a", "de", "thanks", "owe", "of"}


def _previous(before: str) -> str:
    """The word right before, on the same line or the one above; none if a sentence ended there."""
    if before[-1:] not in (" ", "\xa0", "\n"):
        return ""
    own = before[:-2] if before[-2:] in ("\r\n", " \n") else before[:-1]
    dotted = own[-1:] == "."
    own = own[:-1] if dotted else own
    at = len(own)
    while at and own[at - 1].isalpha():
        at -= 1
    return own[at:] if not dotted or own[at:].lower() in TITLES else ""


@dataclass(frozen=True)
class Words:
    """Which words are everyday ones: whole words of public vocabularies in small letters."""

    small: frozenset[str]
    capital: frozenset[str]
    seen: dict[str, bool] = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def read(vocabularies: Sequence[str]) -> Words:
        small, capital = set(), set()
        for path in vocabularies:
            with open(path, "rb") as f:
                for line in f.read().splitlines():
                    token = base64.b64decode(line.split()[0]) if line else b""
                    if len(token) > 2 and token[:1] == b" ":
                        try:
                            w = token[1:].decode()
                        except UnicodeDecodeError:
                            continue
                        if w.isalpha():
                            (small if w.islower() else capital).add(w)
        return Words(frozenset(small), frozenset(capital))

    def everyday(self, w: str) -> bool:
        """In the vocabulary, or made from a word there: plural, or an agent in -er or -or; some are remembered."""
        known = self.seen.get(w)
        if known is None:
            known = self._everyday(w)
            if len(self.seen) < 200_000:
                self.seen[w] = known
        return known

    def _everyday(self, w: str) -> bool:
        if w in self.small or w in FUNCTION_WORDS:
            return True
        if w.endswith("s") and w[:-1] in self.small:
            return True
        stem = w[:-1] if w.endswith("s") else w
        if len(stem) > 4 and stem.endswith(("er", "or")):
            base = stem[:-2]
            return base in self.small or base + "e" in self.small or base[:-1] + "y" in self.small or base[-1] == base[-2] and base[:-1] in self.small or stem in self.small
        return False


def _around(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    before, after = text[max(0, start - 45) : start], text[end : end + 40]
    ends = [k for k in (after.find("\n"), after.find("\r")) if k >= 0]
    return before, after, before[max(before.rfind("\n"), before.rfind("\r")) + 1 :], after[: min(ends, default=len(after))]


def _alone(line_before: str, line_after: str) -> list[float]:
    return [float(not line_before.strip(" -*>|#\"'`[]()")), float(not line_after.strip(" -*|\"'`,.)]}")), float(line_after.lstrip()[:1] == "|"), float(line_before.rstrip().rstrip("\"'<").rstrip()[-1:] in ("=", ":", "|", "：") or line_before[-1:] == "\t")]


def value_features(text: str, start: int, end: int) -> list[float]:
    """Format of a span with digits or an at sign, and how far the nearest cues of the line are."""
    s = text[start:end]
    before, after, line_before, line_after = _around(text, start, end)
    near = line_before if line_before.strip() else before
    groups = re.findall(r"\d+", s)
    sizes = [len(g) for g in groups] or [0]
    letters = re.findall(r"[A-Za-z]+", s)
    words = _LETTERS.findall(s)
    return [
        len(s), sum(sizes), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), float(s.startswith("+")), float(s.startswith("0")), float(s.startswith("00")),
        float("(" in s), s.count("."), s.count("-"), s.count(" ") + s.count(" "), s.count("/"), s.count(","), s.count("\n"),
        float(bool(letters) and s[:1].isalpha()), float(bool(letters) and s[-1:].isalpha()), len(letters[0]) if letters else 0, len(words), float(s.islower()), float(s.isupper()),
        float(bool(re.search(r",\s(?:\d{4,5}\s)?[^\W\d]", s))), float(bool(re.search(r"\b\d{5}\b|\b[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}\b", s))),
        float("@" in s), float(bool(re.search(r"[@\])]\s?[A-Za-z0-9-]*\d+\.\d", s))), float(bool(re.search(r"(?:\.|\[dot\] ?|\(dot\) ?)[A-Za-z]{2,}$", s))), float(s.lower().startswith("git@")), float(after.startswith(":")),
        *_alone(line_before, line_after), float(bool(re.match(r"[^\S\n]*\r?\n.{0,14}\d", after))), float(bool({w.lower() for w in words} & PLACE_WORDS)),
        *[float(min((len(near) - m.end() for m in c.finditer(near)), default=99)) for c in _CUE.values()], *[float(m.start() if (m := c.search(line_after)) else 99) for c in _CUE.values()],
    ]


def name_features(text: str, start: int, end: int, words: Words, small: Counter) -> list[float]:
    """Form of a name, whether its words are everyday ones, and what stands next to it.

    ``small`` counts the words of the text.
    """
    s = text[start:end]
    before, after, line_before, line_after = _around(text, start, end)
    own = _LETTERS.findall(s)
    full = [w for w in own if len(w) > 1 and w not in _PARTICLES]
    low = [w.lower() for w in full]
    own_use = int(s.islower())
    daily = [words.everyday(w) or small[w] > own_use for w in low]
    proper = [w.capitalize() in words.capital and w not in words.small for w in low]
    following = _NEXT.match(line_after)
    p, q, lab = _previous(before), following[1] if following else "", ""
    if line_before.rstrip(" \xa0\"'*")[-1:] in (":", "=", "|", "：", "\t") and (label := _LABEL_BEFORE.search(line_before)):
        lab = label[1].lower()
    pl = p.lower()
    line = line_before + s + line_after
    return [
        len(s), len(full), len(own) - len(full), float(s.islower()), float(s.isupper()), float(any(w.isupper() and len(w) > 1 for w in own) and not s.isupper()), float("," in s), float("-" in s), float("." in s),
        float(bool(daily) and daily[0]), float(bool(daily) and daily[-1]), float(any(daily)), float(any(w in FUNCTION_WORDS for w in low)), float(low[0] in FUNCTION_WORDS if low else 0), float(bool(low) and small[low[-1]] > own_use), float(bool(low) and small[low[0]] > own_use),
        float(bool(proper) and proper[0]), float(bool(proper) and proper[-1]), float(bool(low) and low[0].capitalize() in words.capital), float(bool(low) and low[0] in _GIVEN), float(bool(low) and low[-1] in _GIVEN), float(any(w in _GIVEN for w in low)), float(bool(low) and low[-1].endswith(_ENDS)), float(bool(low) and low[0].endswith(_NOUN_ENDS)), float(bool(low) and low[-1].endswith(_NOUN_ENDS)),
        float(pl in TITLES), float(pl in _AGENTS), float(pl in _RECEIVERS), float(pl in ("the", "a", "der", "die", "das", "dem", "den", "le", "la", "el", "ein", "une", "un")), float(pl in FUNCTION_WORDS), float(bool(p) and p[0].isupper() and pl not in FUNCTION_WORDS and pl not in TITLES), float(bool(p) and p[0].islower()), float(bool(p) and pl in _PARTICLES),
        float(bool(q) and q[0].isupper()), float(bool(q) and q[0].islower()), float(q.endswith(("ed", "te", "ó", "é", "s", "t"))), float(q.lower() in ("and", "und", "et", "y", "or", "nor")), float(bool(q) and words.everyday(q.lower())), float(after[:1] in ("'", "’")), float(after[:1] == ":"), float(after[:1] in (".", ",", ";")), float(after[:1] in ("(", "[", "/", "_")),
        float(lab in PERSON_LABELS), float(bool(lab) and lab not in PERSON_LABELS), float(bool(_DIGIT_BELOW.match(after))), float(line_before.lstrip(" >").startswith("#")), float(line.isupper()), float(any("\u3040" <= c <= "\u9fff" for c in before[-2:])), float(any("\u3040" <= c <= "\u9fff" for c in after[:2])),
        float(before[-2:] in (". ", "! ", "? ", ".\n")), *_alone(line_before, line_after),
    ]


@dataclass
class Detector:
    """The fitted trees, thresholds and words; what is sent to the executors."""

    trees: dict[str, Boosted]
    thresholds: dict[str, float]
    words: Words

    def propose(self, text: str) -> Iterator[tuple[str, int, int, list[float]]]:
        """``(kind, start, end, features)`` of all candidates."""
        counts = word_counts(text)
        for generator, start, end in candidates(text, self.words, counts):
            if generator == "name":
                yield "person_name", start, end, name_features(text, start, end, self.words, counts)
            else:
                x = value_features(text, start, end)
                for kind in _GENERATORS[generator]:
                    yield kind, start, end, x


def _training_rows(detector: Detector, sample) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    rows: dict[str, list] = {k: [] for k in KINDS}
    labels: dict[str, list] = {k: [] for k in KINDS}
    for text, marks in sample:
        for kind, start, end, x in detector.propose(text):
            rows[kind].append(x)
            labels[kind].append(float((kind, start, end) in marks))
    return {k: np.array(v) for k, v in rows.items()}, {k: np.array(v) for k, v in labels.items()}


def _calibrated(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds whose F1 is the best or within half a percent of it."""
    grid = np.arange(0.2, 0.81, 0.02)
    hit = np.array([((p >= t) & (y > 0)).sum() for t in grid])
    f1 = 2 * hit / np.maximum(1, np.array([(p >= t).sum() for t in grid]) + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 0.005)
    return float(grid[best[len(best) // 2]])


@lru_cache(maxsize=2)
def fit_detector(vocabularies: tuple[str, ...] = DEFAULT_VOCABULARIES) -> Detector:
    """Trees on all frames; thresholds from trees that saw only the odd frames, on the even, and the other way round."""
    detector = Detector({}, {}, Words.read(vocabularies))
    words = sorted(w for w in detector.words.small if w.isascii() and w not in FUNCTION_WORDS)
    halves = [_training_rows(detector, labelled_sample(words, part=k)) for k in (0, 1)]
    for kind in KINDS:
        (x0, y0), (x1, y1) = ((x[kind], y[kind]) for x, y in halves)
        p = [Boosted().fit(a, b).probability(c) for a, b, c in ((x0, y0, x1), (x1, y1, x0))]
        detector.thresholds[kind] = _calibrated(np.concatenate(p), np.concatenate([y1, y0]))
        detector.trees[kind] = Boosted().fit(np.concatenate([x0, x1]), np.concatenate([y0, y1]))
    return detector


def spans(texts: list[str | None], detector: Detector) -> list[list[tuple[int, int, str]]]:
    """For each text, the spans to replace in their order: ``(start, end, kind)``."""
    proposed: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
    rows: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    for n, text in enumerate(texts):
        for kind, start, end, x in detector.propose(text) if text else ():
            proposed[kind].append((n, start, end))
            rows[kind].append(x)
    scored: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    for kind in KINDS:
        if rows[kind]:
            for (n, start, end), p in zip(proposed[kind], detector.trees[kind].probability(np.array(rows[kind])).tolist(), strict=True):
                if p >= detector.thresholds[kind]:
                    scored[n].append((p, start, end, kind))
    out = []
    for one in scored:
        taken: list[tuple[int, int, str]] = []  # in their order, apart from each other
        # emails hold their names; then the surer, then the longer span
        for _, start, end, kind in sorted(one, key=lambda x: (x[3] != "email", -round(x[0], 1), x[1] - x[2], x[1])):
            at = bisect_left(taken, (start, end, kind))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end, kind))
        out.append(taken)
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def find_personal(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: Sequence[str] = DEFAULT_VOCABULARIES) -> DataFrame:
    """``(key, text, found)`` of every row: the redacted text and the array of what it replaced.

    found holds ``kind, start, value``, value exactly as written.  Null and empty texts stay
    as they are with an empty array; repeated rows give repeated rows; a null key stays null.
    Other columns aren't read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit_detector(tuple(vocabularies)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("value", pa.string())])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = spans(texts, shared.value)
            clean = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            lists = [[{"kind": k, "start": s, "value": t[s:e]} for s, e, k in f] for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(lists, pa.list_(item))], names=["k", "t", "found"])

    own = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = own.mapInArrow(work, f"k {own.schema['k'].dataType.simpleString()}, t string, found array<struct<kind:string,start:int,value:string>>")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "found")
