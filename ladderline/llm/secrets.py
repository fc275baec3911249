"""Secret scans: assignment-aware lexing over plain patterns.

Plain patterns (assign, access, hex) give the base spans. The lexer then reads every assignment of source or configuration
syntax (name = literal, name: literal, "name": "literal", name => literal, name := literal), follows names that are set to other names or
joined by +, and scores each literal by the most sensitive name that it reaches and by how random it looks, alone or as a piece of what
it is joined to. Literals at or above the threshold become spans of kind literal (the literal alone, without quotes).

What counts as random: the entropy of the characters, of values with at least 8 of them (shorter ones are not told from ordinary words);
a value with spaces counts only under a name that speaks of a phrase (passphrase, seed phrase, mnemonic).

Defined cases: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an empty table; a name set again keeps its
last value for what follows; every assignment is visited once, and the value of a name is kept as a histogram of its characters with a bin for each ASCII character and 128 bins for all
others (which share bins, so that the randomness of texts beyond ASCII may come out lower than it is), so that a join costs no more than 256 steps however long and varied a value gets, and a long text costs in
proportion to its length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from ladderline.llm.common import text_map

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this finds the runs of [0-9a-f]+ that are long enough
_OPERATOR = re.compile(r"=>|:=|[=:]")
_OPERAND = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|\$?\{?([A-Za-z_][A-Za-z0-9_.]*)\}?(?![A-Za-z0-9+/=_.-])|([A-Za-z0-9+/_.=-]+))[ \t]*(\+)?""")
#: How sensitive a part of a name is.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "seedphrase": 1.0, "mnemonic": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 0.9, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "key": 0.6}
_PHRASE = re.compile(r"phrase|mnemonic", re.IGNORECASE)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def name_weight(name: str) -> float:
    """The weight of the most sensitive part, or pair of parts written apart (api_key, privateKey), of a name."""
    parts = [p.lower() for p in _PART.findall(name)]
    return max((_SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


class Characters:
    """Characters of a value as weights: enough for its randomness, and joined in bounded time however long and varied the value gets."""

    MOST = 1e9
    OTHER_BINS = 128

    def __init__(self, text: str = "") -> None:
        self.size, self.weight = float(len(text)), Counter(text if text.isascii() else [c if c < "\x80" else 128 + ord(c) % self.OTHER_BINS for c in text])

    def joined(self, other: Characters) -> Characters:
        out = Characters()
        out.size, out.weight = self.size + other.size, self.weight + other.weight
        if out.size > self.MOST:
            out.weight = Counter({c: w * self.MOST / out.size for c, w in out.weight.items()})
            out.size = self.MOST
        return out

    def randomness(self, phrase: bool) -> float:
        """0 to 1: entropy against 3.5 bits, 0 for fewer than 8 characters, or with spaces where no phrase is meant."""
        if self.size < 8 or (" " in self.weight and not phrase):
            return 0.0
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.weight.values() if n)
        return min(1.0, entropy / 3.5)


def _name_before(text: str, at: int) -> str:
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME_CHARS:
        start -= 1
    return text[start:end].lstrip(".-")


def scored_literals(text: str) -> dict[tuple[int, int], float]:
    """Start and end of every assigned literal, with its score.

    Every assignment is a node that refers to literals and to earlier nodes. Scores of whole values, and the weights of names, pass down to the
    literals in one sweep from the last node to the first.
    """
    nodes: list[tuple[set[int], set[tuple[int, int]]]] = []
    own: list[list[float]] = []  # of each node: weight of a name, of a phrase's name, and score of a whole value, that reach it
    latest: dict[str, tuple[int, Characters]] = {}
    done = 0
    for op in _OPERATOR.finditer(text):
        if op.start() < done or not (name := _name_before(text, op.start())):
            continue
        at, value, refers, literals = op.end(), None, set(), set()
        while m := _OPERAND.match(text, at):
            at = m.end()
            part = None
            if m[3] is not None and m[3] in latest:
                node, part = latest[m[3]]
                refers.add(node)
            else:
                k = next(k for k in (1, 2, 3, 4) if m[k] is not None)
                if m.end(k) > m.start(k):
                    literals.add(m.span(k))
                    part = Characters(m[k])
            if part is not None:
                value = part if value is None else value.joined(part)
            if not m[5]:
                break
        if value is None:
            continue
        done = at
        latest[name] = len(nodes), value
        nodes.append((refers, literals))
        weight, phrase = name_weight(name), bool(_PHRASE.search(name))
        own.append([weight, weight * phrase, weight * value.randomness(phrase) if weight else 0.0])
    scores: dict[tuple[int, int], float] = {}
    for (refers, literals), reach in zip(reversed(nodes), reversed(own), strict=True):
        for earlier in refers:
            own[earlier] = [max(x) for x in zip(own[earlier], reach, strict=True)]
        for span in literals:
            alone = Characters(text[slice(*span)])
            scores[span] = max(scores.get(span, 0.0), reach[2], reach[0] * alone.randomness(False), reach[1] * alone.randomness(True))
    return scores


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def scan_text(text: str) -> tuple:
    base = base_spans(text)
    scores = scored_literals(text) if ":" in text or "=" in text else {}
    lexed = [("literal", *span) for span, score in scores.items() if score >= THRESHOLD]
    count = Counter(kind for kind, _, _ in base)
    found = base + lexed
    best = max((scores[s[1:]] for s in lexed), default=0.0)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(found, KINDS), [text[s:e] for _, s, e in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))], best


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of every document, the texts found, and the best score of a literal (secret_score)."""
    return text_map(docs, [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(pa.string())), ("secret_score", pa.float64())], scan_text)
