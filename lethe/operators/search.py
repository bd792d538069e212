"""Searching one string for terms: the rule, an automaton for long lists, and what is made of the hits.

The rule is one expression a term. For long lists the terms' folded forms are the words of an automaton, which meets every
place where a term can occur in one pass over the folded text, whatever the number of terms; the rule then decides those places. Folding keeps a map
to the text's own offsets: case is folded character by character, a run of white space is one space, and numbers are looked for
in a second view from which their separators are left out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import ahocorasick

from ..functions.fixed import SPACE

WHITE = f"[{SPACE}]"
#: Terms from which on a list is searched by an automaton; below that each has its own expression.
MANY = 24
#: Letters that other than ASCII ones equal without regard to case.
_FOLDS = re.compile("[İıſK]")
_SEPARATORS = re.compile(rf"[{SPACE}.\-]+")
_ONE_WHITE, _SPACES = re.compile(WHITE), re.compile("  +")
Hit = tuple[int, int, int, int, str]


def _parsed(term: str) -> tuple[list[str], bool, str] | None:
    """(words, or the characters of a number; whether it is one; the bare term); None if blank."""
    raw = re.sub(rf"^{WHITE}+|{WHITE}+$", "", term)
    plain = unicodedata.normalize("NFKC", raw)
    words = [w for w in re.split(f"{WHITE}+", plain) if w]
    if not words:
        return None
    digits, solid = len(re.findall("[0-9]", plain)), len(re.sub(WHITE, "", plain))
    if digits >= 6 and digits * 10 >= solid * 6:
        return list(_SEPARATORS.sub("", plain)), True, raw
    return words, False, raw


def _shape(parts: list[str], number: bool) -> re.Pattern:
    """Any white space between words; in numbers at most one separator between characters."""
    return re.compile((rf"[{SPACE}.\-]?" if number else f"{WHITE}+").join(map(re.escape, parts)), re.I)


def _edges(raw: str) -> tuple[bool, bool, bool]:
    """Whether a letter or digit begins and ends a term, and whether its occurrences must be capital."""
    return raw[0].isalnum(), raw[-1].isalnum(), unicodedata.category(raw[0]) == "Lu" and not re.search(rf"[{SPACE}0-9@]", raw)


@lru_cache(maxsize=1 << 12)
def _compiled(term: str) -> tuple[re.Pattern, str, bool, bool, bool] | None:
    """(expression, a part every match holds, edges...); None if blank."""
    parsed = _parsed(term)
    if parsed is None:
        return None
    parts, number, raw = parsed
    part = "" if number else max(parts, key=len)
    return _shape(parts, number), part.lower() if part.isascii() else "", *_edges(raw)


def _stands(text: str, s: int, e: int, edges: tuple[bool, bool, bool]) -> bool:
    """Whether a match is a whole word where the term is one, and capital where it must be."""
    starts, ends, strict = edges
    if (starts and s and text[s - 1].isalnum()) or (ends and text[e : e + 1].isalnum()):
        return False
    return not strict or unicodedata.category(text[s]) == "Lu"


def occurrences(text: str, terms: list[tuple[int, str, str]]) -> list[Hit]:
    """(start, minus length, ord, end, label) of every occurrence of the terms (ord, text, label), by start, then longest, then ord.

    Matches of a term are left-most and do not overlap; one refused for its neighbours or its case has still used its text.
    """
    out, lower = [], None if _FOLDS.search(text) else text.lower()
    for order, term, label in terms:
        ready = _compiled(term)
        if ready is None or (lower is not None and ready[1] not in lower):
            continue
        for m in ready[0].finditer(text):
            s, e = m.span()
            if s != e and _stands(text, s, e, ready[2:]):
                out.append((s, s - e, order, e, label))
    return sorted(out)


class _Fold(dict):
    """Code point to the one character that stands for all it equals without regard to case."""

    def __missing__(self, point: int) -> str:
        upper = chr(point).lower()[0].upper()
        if len(upper) > 1:  # letters without a capital of their own
            upper = self.setdefault(upper, "\ue000" if upper == "SS" else chr(0xF0000 + len(self)))
        self[point] = upper
        return upper


_FOLD = _Fold()


def folded(text: str) -> str:
    """The text with case folded, character by character."""
    if text.isascii():
        return text.upper()
    lower = text.lower()
    if len(lower) == len(text):
        upper = lower.replace("ß", "\ue000").upper()
        if len(upper) == len(text):
            return upper
    return text.translate(_FOLD)


class _View:
    """A text in which stretches are replaced by something shorter, and where its characters were before."""

    def __init__(self, text: str, stretches: re.Pattern, by: str) -> None:
        out, self._at, self._lost, last, size = [], [], [], 0, 0
        for m in stretches.finditer(text):
            s, e = m.span()
            out += [text[last:s], by]
            size += s - last + len(by)
            last = e
            self._at.append(size)
            self._lost.append(e - size)
        self.text = "".join([*out, text[last:]]) if out else text

    def origin(self, at: int) -> int:
        i = bisect_right(self._at, at)
        return at + self._lost[i - 1] if i else at


class Automaton:
    """All terms (ord, text, label) of a list, built once and searched for at once; gives what ``occurrences`` gives."""

    def __init__(self, terms: tuple[tuple[int, str, str], ...]) -> None:
        self._views: dict[bool, ahocorasick.Automaton] = {}
        keys: dict[bool, dict[str, list]] = {False: {}, True: {}}
        for order, term, label in terms:
            parsed = _parsed(term)
            if parsed is not None:
                parts, number, raw = parsed
                key = folded(("" if number else " ").join(parts))
                keys[number].setdefault(key, []).append((order, label, parts, _edges(raw)))
        for number, own in keys.items():
            if own:
                self._views[number] = ahocorasick.Automaton()
                for i, (key, same) in enumerate(own.items()):
                    self._views[number].add_word(key, (i, len(key), key.isascii(), same))
                self._views[number].make_automaton()

    def matches(self, text: str):
        """(start, end, term) of the left-most matches of each term that do not overlap, whatever their neighbours."""
        upper = folded(text)
        for number, automaton in self._views.items():
            view = _View(upper, _SEPARATORS, "") if number else _View(_ONE_WHITE.sub(" ", upper), _SPACES, " ")
            used: dict[tuple[int, int], int] = {}
            for last, (i, size, plain, same) in automaton.iter(view.text):
                s, e = view.origin(last + 1 - size), view.origin(last) + 1
                sure = plain and not number and text[s:e].isascii()
                for j, term in enumerate(same):
                    if s < used.get((i, j), 0):
                        continue
                    if not sure:
                        m = _expression(number, *term[2]).match(text, s)
                        if not m:
                            continue
                        e = m.end()
                    used[i, j] = e
                    yield s, e, term

    def occurrences(self, text: str) -> list[Hit]:
        return sorted((s, s - e, order, e, label) for s, e, (order, label, _, edges) in self.matches(text) if _stands(text, s, e, edges))


@lru_cache(maxsize=1 << 12)
def _expression(number: bool, *parts: str) -> re.Pattern:
    return _shape(list(parts), number)


class Few:
    """A short list, each term with an expression of its own."""

    def __init__(self, terms: tuple[tuple[int, str, str], ...]) -> None:
        self._terms = list(terms)

    def matches(self, text: str):
        for order, term, label in self._terms:
            ready = _compiled(term)
            for m in ready[0].finditer(text) if ready else ():
                yield *m.span(), (order, label)

    def occurrences(self, text: str) -> list[Hit]:
        return occurrences(text, self._terms)


class Searcher:
    """A list of terms ready for searching many texts."""

    def __init__(self, terms: tuple[tuple[int, str, str], ...]) -> None:
        self.terms = terms
        self._how = (Few if len(terms) < MANY else Automaton)(terms)
        self.occurrences = self._how.occurrences
        self._within: set[int] | None = None

    def within_labels(self) -> set[int]:
        """The ord of the terms that some label of the list holds."""
        if self._within is None:
            self._within = {term[0] for label in {t[2] for t in self.terms} if label for _, _, term in self._how.matches(label)}
        return self._within


@lru_cache(maxsize=8)
def searcher(terms: tuple[tuple[int, str, str], ...]) -> Searcher:
    """The searcher of a list; a task builds that of a list it has seen no second time."""
    return Searcher(terms)


def islands(hits: list[Hit]) -> list[tuple[int, int, str]]:
    """(start, end, label): overlapping hits (not touching ones) are one span under the label of the longest."""
    out: list[list] = []
    for s, neg, _, e, label in hits:
        if out and s < out[-1][1]:
            if neg < out[-1][3]:
                out[-1][2:] = [label, neg]
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e, label, neg])
    return [(s, e, label) for s, e, label, _ in out]


def spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its label."""
    out, at = [], 0
    for s, e, label in spans:
        out += [text[at:s], label]
        at = e
    return "".join([*out, text[at:]])
