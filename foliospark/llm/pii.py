"""Operator 10: personal data by base rules and gradient-boosted candidates.

Base rules find e-mail addresses, IPv4 addresses, card numbers and international phone numbers. On top, high-recall
generators propose further spans, which may overlap: addresses written with (at) and (dot), IPv6 in all its compressed
forms and [.] addresses, cards with other separators or grouped 4-6-5, phone numbers without a plus. Features of their
format and of the words around them go to boosted trees, trained in numpy on the driver on a generated, labelled corpus of
TRAIN lines; a calibration on separate lines turns scores into probabilities and sets each kind's threshold for PRECISION.
Of the accepted candidates, the most probable ones that overlap neither a base span nor each other are added. Base spans
always stay.

All rules are linear in the text: none rescans a run of characters from each of its places. Overlaps are found by bisection
in sorted spans, so a text with very many spans costs little more than their sorting.

Defined cases: null text is empty; a very long text is scanned whole, its candidates scored SCORED at a time; repeated rows
are scanned one by one; equal probabilities go to the earlier, then longer span; an empty table gives an empty result;
further columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.common import bounded_batches, pick, read_table

KINDS = ("email", "ip", "card", "phone")
TRAIN, CALIBRATE, PRECISION = 9000, 4000, 0.98
#: Candidates whose features are in memory at a time.
SCORED = 4096
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never begins inside a run of digits: one that began at the run's start would match as well.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGITS = bytes(c for c in range(256) if c not in b"0123456789")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a local part has none, so each match has just one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)


def base_spans(text: str) -> list[Span]:
    """(start, index of the kind, end) by the base rules."""
    found: list[Span] = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


_AT, _DOT = r"(?:\x20?(?:\[at\]|\(at\)|\{at\}|<at>)\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\x20?|\x20dot\x20|\x20?\.\x20?)"
GENERATORS = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.IGNORECASE | re.ASCII)),
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{1,3}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.IGNORECASE | re.ASCII)),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){2}[./_\x20-]{1,2}[0-9]{1,7}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}[./_\x20-]{1,2}[0-9]{6}[./_\x20-]{1,2}[0-9]{5}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20./-]?|[0-9][\x20.-])?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,9}(?:[\x20./-][0-9]{2,5}){0,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])0[0-9]{8,13}(?![0-9])")),
)
CUES = (
    ("mail", "e-mail", "email", "contact", "write", "address", "reach"),
    ("ip", "host", "server", "client", "login", "peer", "from"),
    ("card", "visa", "credit", "payment", "debit", "mastercard", "amex"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "telephone", "telefon"),
    ("version", "order", "page", "isbn", "invoice", "ticket", "id", "no", "number", "total", "date", "price", "figure", "chapter", "ref", "serial", "section", "build"),
)


_SPELLED = re.compile(rb"(?:[\[({<]at[\])}>]| at ) ?[A-Za-z0-9-]+ ?(?:[\[({<]dot[\])}>]| dot |\.) ?[A-Za-z0-9-]{2}", re.IGNORECASE)
_COLONS = re.compile(rb"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|::[0-9A-Fa-f]")


def may_matter(raw: bytes) -> bool:
    """False only if the UTF-8 text has neither a base span nor a candidate."""
    if b"@" in raw or raw.translate(None, _NOT_DIGITS) or (b":" in raw and _COLONS.search(raw)):
        return True
    low = raw.lower()
    return (b" at " in low or b"at]" in low or b"at)" in low or b"at}" in low or b"at>" in low) and _SPELLED.search(low) is not None


def candidates(text: str) -> list[Span]:
    """Proposed spans, which may overlap. A proposal that is written like a base rule's but isn't one comes up, too.

    White space that a rule ends or begins with isn't part of the span.
    """
    found = set()
    for kind, rule in GENERATORS:
        for m in rule.finditer(text):
            own = m[0].strip(" ")
            start = m.start() + m[0].index(own)
            if kind != 3 or 7 <= len(_digits(own)) <= 15:
                found.add((start, kind, start + len(own)))
    return sorted(found)


def _is_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    own, digits = text[start:end], _digits(text[start:end])
    low = own.lower()
    near = text[max(0, start - 40) : start].lower()
    before = re.findall(r"[a-z-]+", near)[-4:]
    parts = [len(p) for p in re.split(r"[^0-9]+", own) if p]
    tail = re.split(r"[^a-z0-9]+", low)[-1]
    separators = {c for c in own if not c.isalnum()}
    left, right = text[start - 1 : start], text[end : end + 1]
    hexes = re.split(r":", low) if kind == 1 else []
    return [
        kind, len(own), len(digits), len(parts), max(parts, default=0), min(parts, default=0), parts[-1] if parts else 0, parts[0] if parts else 0,
        float(luhn(digits)) if 12 < len(digits) < 20 else 0.0, len(set(digits)), len(separators), float(own[:1] == "0"), float(own[:2] == "00"), float("(" in own),
        float(any(x in low for x in ("[at]", "(at)", "{at}", "<at>"))), float(" at " in low), float(any(x in low for x in ("[dot]", "(dot)", "{dot}", "<dot>"))), float(" dot " in low), float("@" in low),
        float(tail.isalpha()), len(tail), float(tail in ("com", "org", "net", "de", "fr", "es", "io", "edu", "info", "eu", "uk")), float("[.]" in low or "(.)" in low), float(" dot " in low and not re.search("[a-z]", low.replace("dot", ""))),
        len(hexes), float(kind == 1 and ":" in own and _is_ipv6(own)), float(near.rstrip().endswith(":")), float(re.search(r"(?:[\[({< ]dot[\])}> ]|\.) ?$", near) is not None), low.count(" dot "), float(bool(re.match("[0-9][ .-]", own))), float(any(p > 5 for p in parts)), float("::" in low), float(any(c in "abcdef" for c in low)), float(bool(hexes) and all(len(h) == 2 for h in hexes)), float(max(parts, default=0) <= 3 and len(parts) == 4),
        float(own[:1] in "3456"), float(left.isalnum() or left in ("$", "€", "#", ".")), float(right.isalnum() or right in ("%", "€")),
        *(float(any(w in cues for w in before)) for cues in CUES),
        *(float(bool(before) and before[-1] in cues) for cues in CUES),
    ]


class Trees:
    """Gradient-boosted regression trees on the logistic loss; features are cut between values or at quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _edges(self, v: np.ndarray) -> np.ndarray:
        """Between all values where they are few, so that rare ones are cut off, too; else at quantiles."""
        u = np.unique(v)
        return (u[1:] + u[:-1]) / 2 if len(u) <= self.bins else np.unique(np.quantile(v, np.linspace(0, 1, self.bins)[1:-1]))

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [self._edges(x[:, j]) for j in range(x.shape[1])]
        b, n_bins = self._cut(x), self.bins
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            nodes = 2 ** (self.depth + 1) - 1
            feature, edge, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            for level in range(self.depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.nonzero(node == k)[0]
                    if not len(own):
                        continue
                    gs, hs = g[own].sum(), h[own].sum()
                    value[k] = self.rate * gs / (hs + 1)
                    if level == self.depth or hs < 2 * self.least / 4:
                        continue
                    at = (b[own] + np.arange(b.shape[1]) * n_bins).ravel()
                    gb = np.bincount(at, np.repeat(g[own], b.shape[1]), b.shape[1] * n_bins).reshape(-1, n_bins).cumsum(1)[:, :-1]
                    hb = np.bincount(at, np.repeat(h[own], b.shape[1]), b.shape[1] * n_bins).reshape(-1, n_bins).cumsum(1)[:, :-1]
                    gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                    gain[(hb < self.least / 4) | (hs - hb < self.least / 4)] = -1
                    j, c = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, c] > 1e-6:
                        feature[k], edge[k] = j, c
                        node[own] = 2 * k + 1 + (b[own, j] > c)
            self.trees.append((feature, edge, value))
            score += self._leaf(b, feature, edge, value)
        return self

    def _leaf(self, b: np.ndarray, feature: np.ndarray, edge: np.ndarray, value: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > edge[node]), node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, out = self._cut(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += self._leaf(b, *tree)
        return out


def corpus(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated lines with the spans of the personal data in them; half the lines have look-alikes instead."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = "the of and to in is for with on by that this was are from at be have or an it not as they see new we our dot page found later since under code name time room".split()
    names = "anna b.meyer carlos dupont eva info j_smith k.lee mueller office sales team user99 x.y.z".split()
    hosts = "example mail web-host post uni firm shop blog provider inbox".split()
    tops = "com org net de fr es io edu".split()
    octets = lambda: [str(r.randrange(256)) for _ in range(4)]

    def card(sep: str) -> str:
        while True:
            s = r.choice("3456") + d(15)
            if luhn(s):
                return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def amex(sep: str) -> str:
        while True:
            x = "3" + r.choice("47") + d(13)
            if luhn(x):
                return sep.join((x[:4], x[4:10], x[10:]))

    def noisy_mail() -> str:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "), ("{at}", "{dot}"), (" @ ", "."), (" [at] ", " [dot] "), ("<at>", "<dot>"), (" AT ", " DOT "), (" at ", ".")])
        name = r.choice(names)
        if "." not in name and r.random() < 0.4:
            name += dot + r.choice(names).split(".")[-1]
        elif "." in dot and len(dot) > 1 or dot.strip(" ") != ".":
            name = name.replace(".", r.choice([".", dot]))
        return name + at + r.choice(hosts) + dot + r.choice(tops)

    def ipv6() -> str:
        g = lambda k: [f"{r.randrange(65536):x}" for _ in range(k)]
        return r.choice([
            ":".join(g(8)), "2001:db8::" + g(1)[0], "fe80::" + ":".join(g(r.randrange(1, 5))), "::" + ":".join(g(r.randrange(1, 3))), "::1", ":".join(g(r.randrange(1, 5))) + "::" + ":".join(g(r.randrange(1, 3))),
            "ff02::" + f"{r.randrange(1, 256):x}", ":".join(g(r.randrange(2, 5))) + "::", ":".join(x.zfill(4) for x in g(8)), "2001:0db8:" + ":".join(x.zfill(4) for x in g(2)) + "::" + g(1)[0],
        ])

    def phone() -> str:
        return r.choice([
            f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(8)}", f"0{d(3)}/{d(6)}", f"0{d(3)}-{d(7)}", f"00{r.randrange(1, 99)} {d(3)} {d(6)}",
            f"00{r.randrange(10, 99)}-{d(2)}-{d(8)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(10)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"1 {d(3)} {d(3)} {d(4)}", f"1.{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}",
            f"(0{d(2)}) {d(7)}", f"0{d(4)} {d(6)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)} {d(2)} {d(2)} {d(2)}",
        ])

    good = (
        (0, noisy_mail, CUES[0]),
        (1, lambda: r.choice(["[.]", "(.)", " dot ", "[dot]", "(dot)"]).join(octets()), CUES[1]),
        (1, ipv6, CUES[1]), (1, ipv6, CUES[1]),
        (2, lambda: r.choice([card, amex])(r.choice([".", "/", "_", "  "])), CUES[2]),
        (3, phone, CUES[3]), (3, phone, CUES[3]),
    )
    bad = (
        lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{r.randrange(10)}.{d(1)}.{d(2)}",
        lambda: f"{d(3)} {d(3)}", lambda: f"{d(2)} {d(3)} {d(3)}", lambda: d(13), lambda: d(16), lambda: d(18), lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"0{d(8)}", lambda: f"{d(3)}-{d(2)}",
        lambda: f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{r.choice(words)} at {r.choice(words)}. {r.choice(words)}", lambda: f"{r.choice(words)} at {r.choice(words)} dot {r.choice(words)}", lambda: f"{d(2)}.{d(2)}",
        lambda: f"std::{r.choice(['dec', 'add', 'be', 'cafe', 'fade', 'bad'])}", lambda: f"{r.choice(hosts)}::{r.choice(['a', 'b', 'ed', 'ace', 'face'])}", lambda: f"{r.randrange(24)}:{d(2)}:{d(2)}", lambda: f"a::{r.choice('bcdef')}", lambda: f"{d(1)}:{d(1)}:{d(1)}",
        lambda: f"{d(4)} {d(6)} {d(5)}", lambda: f"{d(4)}.{d(6)}.{d(5)}", lambda: f"{d(2)} {d(5)}", lambda: f"{d(3)} {d(7)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(2)}/{d(5)}", lambda: f"{d(2)}.{d(2)}.{d(4)} {d(2)}:{d(2)}",
        lambda: f"{r.choice(words)} at {r.choice(hosts)}. {r.choice(words).title()} {r.choice(words)}", lambda: f"{r.choice(names)} at {r.choice(hosts)} and {r.choice(words)}",
        lambda: f"{d(2)}-{d(2)} {d(2)}-{d(2)}", lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6)), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"@{r.choice(names)}",
    )
    lines = []
    for _ in range(n):
        head = [r.choice(words) for _ in range(r.randrange(1, 7))]
        tail = [r.choice(words) for _ in range(r.randrange(6))]
        spans = []
        if r.random() < 0.5:
            kind, make, cues = r.choice(good)
            own = make()
            head += [r.choice(cues) + r.choice(["", ":", " is"])] if kind in (2, 3) or r.random() < 0.6 else []
            text = " ".join(head) + " " + own
            spans = [(len(text) - len(own), kind, len(text))]
        else:
            head += [r.choice(CUES[4]) + r.choice(["", ":"])] if r.random() < 0.6 else []
            text = " ".join(head) + " " + r.choice(bad)()
        lines.append((" ".join([text, *tail]) + r.choice(["", ".", ","]), spans))
    return lines


class Model:
    """Trees, a logistic calibration of their scores, and a threshold for each kind."""

    def __init__(self, lines: int = TRAIN, held: int = CALIBRATE, precision: float = PRECISION):
        x, y, _ = self._labelled(corpus(lines, 1))
        self.trees = Trees().fit(x, y)
        x, y, kind = self._labelled(corpus(held, 2))
        self.a, self.b = self._calibrate(self.trees.score(x), y)
        p = self.probability(x)
        self.threshold = []
        for k in range(len(KINDS)):
            best, own = 1.0, kind == k
            order = np.argsort(-p[own])
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            enough = np.nonzero(right >= precision)[0]
            if len(enough):
                best = max(0.5, float(p[own][order][enough[-1]]))
            self.threshold.append(best)

    @staticmethod
    def _labelled(lines: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, kinds = [], [], []
        for text, spans in lines:
            for c in candidates(text):
                x.append(features(text, c))
                y.append(float(c in spans))
                kinds.append(c[1])
        return np.array(x), np.array(y), np.array(kinds)

    @staticmethod
    def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic regression on the score
            p = 1 / (1 + np.exp(-(a * score + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((y - p) * score).sum() - 1e-3 * (a - 1), (y - p).sum()])
            h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
            a, b = np.array([a, b]) + np.linalg.solve(h, g)
        return float(a), float(b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.trees.score(x) + self.b)))

    def spans(self, text: str, base: list[Span] | None = None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = sorted(base_spans(text) if base is None else base)
        free = apart(candidates(text), base)
        if not free:
            return base, base
        p = [q for at in range(0, len(free), SCORED) for q in self.probability(np.array([features(text, c) for c in free[at : at + SCORED]])).tolist()]
        best = sorted((-q, c[0], -c[2], c[1]) for q, c in zip(p, free) if q >= self.threshold[c[1]])
        return base, sorted([*base, *disjoint([(s, k, -e) for _, s, e, k in best])])


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of `taken`, which is sorted: the farthest end among those that begin before tells."""
    starts, ends = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    return [c for c in spans if not (k := bisect_left(starts, c[2])) or ends[k - 1] <= c[0]]


def disjoint(spans: list[Span]) -> list[Span]:
    """The spans that overlap no earlier one that stays."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for c in spans:
        k = bisect_right(starts, c[0])
        if (not k or ends[k - 1] <= c[0]) and (k == len(starts) or starts[k] >= c[2]):
            starts.insert(k, c[0])
            ends.insert(k, c[2])
            kept.append(c)
    return kept


@functools.lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find_pii(docs: DataFrame, trained: Model | None = None) -> DataFrame:
    """One row for each document: base counts, hash of the base spans, and all spans."""
    trained = trained or model()
    bounded_batches(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()):
                raw = raw.as_py() or b""
                if not may_matter(raw):
                    rows.append((0, 0, 0, 0, none, "", 0))
                    continue
                base, every = trained.spans(raw.decode())
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return pick(docs, "doc_id", "text").mapInArrow(report, SCHEMA)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
