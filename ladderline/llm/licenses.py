"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is the wording of a licence, of its notice or of its header, with mark-up: [[ ... ]] is optional, {{n}} stands for up to n words of any kind. It
becomes an automaton over words; a text matches where its words lead from the automaton's start to its end, so that all mandatory
wording has to be there exactly and in order, whatever the punctuation, line breaks and case. The templates are a file beside this module; further ones can be
compiled by the same function. A text that is nothing but the licence is told from one that contains it. Beside it, phrases (base labels) are looked for as runs
of consecutive words.

Defined cases: a null or empty text has no words and no labels; first_word and last_word are null without a phrase; repeated rows
give repeated results; a long text is read once for each template whose mandatory words it has, with as many states as the template has words; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ladderline.llm.common import text_map

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_PHRASES = [(re.compile(_GAP.join(map(str.encode, phrase.split())) + rb"(?![0-9a-z\x80-\xff])"), label) for phrase, label in PHRASES.items()]
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def parsed_templates(text: str) -> dict[str, str]:
    """Templates by label from the text of a file: "== label" before each, lines that begin with # left out."""
    out: dict[str, list[str]] = {}
    for line in text.splitlines():
        if line.startswith("== "):
            lines = out[line[3:].strip()] = []
        elif out and not line.startswith("#"):
            lines.append(line)
    return {label: " ".join(lines) for label, lines in out.items()}


class Automaton:
    """States 0 to n; a state has the word that leads on, the states reached without a word, and whether any word leads on."""

    def __init__(self, template: str) -> None:
        self.word: list[bytes | None] = []
        self.any: list[bool] = []
        self.skips: list[set[int]] = []
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        for m in _MARK.finditer(template):
            if m[0] == "[[":
                opened.append(len(self.word))
            elif m[0] == "]]":
                if (begun := opened.pop()) < len(self.word):
                    self.skips[begun].add(len(self.word))
            elif m[1]:
                for _ in range(int(m[1])):
                    self._add(None, True)
                    self.skips[-1].add(len(self.word))
            else:
                word = m[0].encode().lower()  # bytes.lower() changes A-Z alone
                self._add(word, False)
                if not opened:
                    self.mandatory.append(word)
        self.end = len(self.word)
        #: one mandatory word that has to be in the text at all: the longest
        self.anchor = max(self.mandatory, key=len)

    def _add(self, word: bytes | None, anything: bool) -> None:
        self.word.append(word)
        self.any.append(anything)
        self.skips.append(set())

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[state] if (state := todo.pop()) < self.end else ():
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], whole: bool = False) -> bool:
        """Whether the words of the template stand somewhere in the text, or, with whole, are all of it; one pass, as many states as the template has words."""
        start = self._closed({0})
        states: set[int] = set(start)
        for word in words:
            states = self._closed({s + 1 for s in states if s < self.end and (self.any[s] or self.word[s] == word)})
            if whole and not states:
                return False
            if not whole:
                if self.end in states:
                    return True
                states |= start
        return whole and self.end in states


def compiled(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: Automaton(template) for label, template in templates.items()}


#: The templates of the file beside this module, which is read through the loader, so that it may be packed with the code.
TEMPLATES = parsed_templates(pkgutil.get_data(__package__, "license_templates.txt").decode())
_AUTOMATA = compiled(TEMPLATES)


def word_count(data: bytes) -> int:
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    return int(inside[:1].sum() + np.count_nonzero(inside[1:] & ~inside[:-1]))


def whole_licenses(text: str) -> set[str]:
    """The templates that the text is, from its first word to its last."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    return {label for label, automaton in _AUTOMATA.items() if automaton.accepts(words, whole=True)}


def scan_text(text: str) -> tuple:
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone
    places = [(m.start(), label) for pattern, label in _PHRASES for m in pattern.finditer(data) if not m.start() or not _IS_WORD[data[m.start() - 1]]]
    words, labels = None, set()
    for label, automaton in _AUTOMATA.items():
        if automaton.anchor in data and all(w in data for w in automaton.mandatory):
            words = _WORD.findall(data) if words is None else words
            if automaton.accepts(words):
                labels.add(label)
    base = {label for _, label in places}
    first = word_count(data[: min(places)[0]]) if places else None
    last = word_count(data[: max(places)[0]]) if places else None
    return word_count(data), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if labels else 0.5 if base else 0.0


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Labels of every document; the score is 1 for a matched template, 0.5 for a phrase alone, else 0."""
    return text_map(docs, [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())], scan_text)
