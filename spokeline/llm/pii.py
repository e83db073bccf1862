"""Operator 11: personal data by fixed patterns, and by a semi-Markov conditional random field that adds what they miss.

Base spans are those of four patterns (email, ip, card, phone), read from left to right without overlaps within a kind. The field finds disguised ones: addresses with written
"at" and "dot", numbers with other separators, prefixes or brackets. Where a text has something that may be such a span, candidate segments with their
types are made: of numbers up to MAX_GROUPS groups of digits in a chain, of addresses up to MAX_LABELS parts on each side of an at sign. Each candidate is scored as a whole
(how many digits in which groups, check digit, range of the parts, which separators and whether they are all the same, what stands beside it); what lies
between segments is scored token by token, and changes between plain text and entities have weights of their own. Forward and backward sums over all
segmentations give each segment's probability, and the best segmentation by dynamic programming chooses boundaries and types together. A segment of it
is added if its probability is LEAST_P or more and it overlaps no base span. Stretches without candidates are plain in every segmentation, so each
cluster of candidates is worked on by itself with the same result.

The field is fitted by maximum likelihood on windows around base spans and other numbers of at most MAX_TEXTS texts (those of the smallest hashes), with base spans as labels,
disguised by rule, beside spans made by rule, and on decoys: dates, wrong check digits, plain numbers, at signs in prose.

Defined results: null and empty texts have no spans; offsets count code points; a null doc_id is kept; repeated rows are read each; other columns are not read; an empty table gives no rows. Whole texts are
read in linear time, however long. Equal segmentations: the one with the earlier, shorter segment stays.
"""

from __future__ import annotations

import heapq
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import exp, inf, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Texts that the field is fitted on, at most; windows of them, at most; code points of context on each side.
MAX_TEXTS, MAX_WINDOWS, CONTEXT = 3_000, 1_500, 24
#: Groups of digits in a numeric segment, parts on each side of an address, code points of such a part.
MAX_GROUPS, MAX_LABELS, MAX_PART = 8, 5, 63
LEAST_P = 0.85

# -- base spans -----------------------------------------------------------------------------------
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Addresses: the longest run of signs before an at sign that is still free, and the host after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            yield "email", start, free
        else:
            free = max(free, start) if start == at else start
        at = text.find("@", max(at + 1, free if host else 0))


def octets(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind as listed, then start."""
    out = list(emails(text))
    out += [("ip", m.start(), m.end()) for m in DOTTED.finditer(text) if octets(m[0].split("."))]
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = DIALLED.match(text, at)
        if m and 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# -- candidate segments ---------------------------------------------------------------------------
#: What may link two groups of digits, and what may stand before the first.
LINK = r"(?:[ ]?[\[({]?(?:[dD][oO][tT]|\.)[\])}]?[ ]?|[ ]?[-/_.][ ]?|[ ]|[ ]?[()][ .-]?)"
NUMBERS = re.compile(rf"(?<![0-9])[0-9]++(?:{LINK}[0-9]++)++")
DIGITS = re.compile(r"[0-9]+")
BEFORE = "+("
AT = re.compile(r"@|[\[({<][ ]?[aA][tT][ ]?[\])}>]|(?<=[ ])[aA][tT](?=[ ][A-Za-z0-9-]{1,63}(?:\.[A-Za-z]|[ ]?[\[({<]?[ ]?[dD][oO][tT]\b))")
DOT = re.compile(r"\.|[ ]?[\[({<][ ]?(?:\.|[dD][oO][tT])[ ]?[\])}>][ ]?|[ ][dD][oO][tT][ ]")
DOT_BACK = re.compile(r"(?:\.|[ ]?[\[({<][ ]?(?:\.|[dD][oO][tT])[ ]?[\])}>][ ]?|[ ][dD][oO][tT][ ])\Z")
PART = re.compile(r"[A-Za-z0-9-]+")
PART_BACK = re.compile(r"[A-Za-z0-9_%+-]+\Z")
ANY = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def beside(text: str, start: int, end: int) -> list[str]:
    """Classes of the signs beside a span, farther ones where they are separators of digits."""

    def of(at: int, step: int) -> str:
        c = text[at : at + 1] if at >= 0 else ""
        if not c or c.isspace():
            return "blank"
        if c.isalpha():
            return "letter"
        if c.isdigit():
            return "digit"
        further = text[at + step : at + step + 1] if at + step >= 0 else ""
        return "joined" if c in ".-/_:+=#,'" and further.isdigit() else "mark"

    return ["before " + of(start - 1, -1), "after " + of(end, 1)]


def number_segments(text: str) -> Iterator[Segment]:
    """Candidates in chains of digit groups."""
    for chain in NUMBERS.finditer(text):
        groups = [(m.start(), m.end()) for m in DIGITS.finditer(text, chain.start(), chain.end())]
        for i in range(len(groups)):
            total = most = 0
            for j in range(i, min(len(groups), i + MAX_GROUPS)):
                total += groups[j][1] - groups[j][0]
                if total > 19:
                    break
                most = max(most, groups[j][1] - groups[j][0])
                if j == i:
                    continue
                kinds = ["ip"] if j == i + 3 and most <= 3 else []
                kinds += ["phone"] if 8 <= total <= 15 and most >= 3 else ["card"] if total >= 16 and most >= 4 else []
                if not kinds:
                    continue
                parts = [text[a:b] for a, b in groups[i : j + 1]]
                links = [text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)]
                if kinds[0] == "ip" and not (octets(parts) and all(x.strip(" ") for x in links)):
                    del kinds[0]
                    if not kinds:
                        continue
                start, end = groups[i][0], groups[j][1]
                while start and text[start - 1] in BEFORE and start > groups[i][0] - 2:
                    start -= 1
                shapes = {re.sub(r"[a-zA-Z]+", "dot", x) for x in links}
                common = ["groups " + "-".join(str(len(p)) for p in parts), f"digits {total}", "same link" if len(shapes) == 1 else f"{min(len(shapes), 4)} links", *("link " + x for x in shapes), *beside(text, start, end)]
                common.append("begins " + (text[start] if text[start] in BEFORE else "00" if parts[0].startswith("00") else "1" if parts[0] == "1" else "digit"))
                for kind in kinds:
                    own = ["check digit " + str(luhn("".join(parts)))] if kind == "card" else ["no zero in front " + str(all(p == "0" or p[0] != "0" for p in parts))] if kind == "ip" else []
                    yield Segment(start, end, kind, tuple(f"{kind}: {f}" for f in (*common, *own, "any")))


def address_segments(text: str) -> Iterator[Segment]:
    """Candidates around at signs, plain or written."""
    for m in AT.finditer(text):
        sign = m[0].lower().replace(" ", "")
        lo = m.start() - (text[m.start() - 1 : m.start()] == " ")
        hi = m.end() + (text[m.end() : m.end() + 1] == " ")
        starts, at, pieces = [], lo, 0
        while pieces < MAX_LABELS:
            window = max(0, at - MAX_PART)
            part = PART_BACK.search(text[window:at])
            if not part:
                break
            at, pieces = window + part.start(), pieces + 1
            starts.append((at, pieces))
            dot = DOT_BACK.search(text[max(0, at - 7) : at])
            if not dot:
                break
            at = max(0, at - 7) + dot.start()
        ends, at, dots = [], hi, []
        while len(ends) <= MAX_LABELS:
            part = PART.match(text, at, at + MAX_PART)
            if not part:
                break
            ends.append((part.end(), tuple(dots), part[0]))
            dot = DOT.match(text, part.end())
            if not dot:
                break
            dots.append(dot[0].lower().replace(" ", ""))
            at = dot.end()
        for start, pieces in starts:
            for end, how, last in ends[1:]:
                spaced = "spaced " if text[m.start() - 1 : m.start()] == " " else ""
                features = ["at " + spaced + sign, f"parts {pieces}", f"labels {len(how) + 1}", *("dot " + x for x in set(how)), "same dots" if len(set(how)) == 1 else "other dots", f"ending of {min(len(last), 8)}",
                            "ending letters " + str(last.isalpha()), "written " + str(sign != "@") + " " + str(all(x != "." for x in how)), *beside(text, start, end), "last" if end == ends[-1][0] else "more follows",
                            "whole" if start == starts[-1][0] else "more before", "any"]
                yield Segment(start, end, "email", tuple("email: " + f for f in features))


def segments(text: str) -> list[Segment]:
    return [*number_segments(text), *address_segments(text)]


def clusters(found: list[Segment]) -> Iterator[list[Segment]]:
    """Candidates that touch or overlap, together; by place."""
    group: list[Segment] = []
    end = -1
    for s in sorted(found):
        if group and s.start > end:
            yield group
            group = []
        group.append(s)
        end = s.end if len(group) == 1 else max(end, s.end)
    if group:
        yield group


def plain_feature(token: str) -> str:
    """What a token counts as in plain text."""
    return f"plain: {min(len(token), 8)} digits" if token[0].isdigit() and token.isascii() else "plain: word" if token.isalpha() else "plain: " + token


class Lattice:
    """All segmentations of a cluster: places of token ends, plain steps, and candidates."""

    def __init__(self, text: str, group: list[Segment]):
        lo, hi = group[0].start, max(s.end for s in group)
        cuts = sorted({lo, hi, *(x for s in group for x in (s.start, s.end))})
        place = {x: k for k, x in enumerate(cuts)}
        self.plain = [tuple(plain_feature(m[0]) for m in TOKEN.finditer(text, a, b)) for a, b in zip(cuts, cuts[1:])]
        self.group = group
        self.ends: list[list[tuple[int, int]]] = [[] for _ in cuts]  # candidates that end at a place: start, number
        for k, s in enumerate(group):
            self.ends[place[s.end]].append((place[s.start], k))


# -- decoding -------------------------------------------------------------------------------------
def log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + log1p(exp(b - a)) if b > -inf else a


class Field:
    """Weights of features; states are plain text and entity."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.step = {(a, b): weights.get(f"from {a} to {b}", 0.0) for a in ("plain", "entity") for b in ("plain", *KINDS)}

    def score(self, features: Iterable[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    def decode(self, lattice: Lattice) -> list[tuple[Segment, float]]:
        """Segments of the best segmentation, with their probabilities."""
        step, group, ends = self.step, lattice.group, lattice.ends
        n = len(ends)
        own = [self.score(s.features) for s in group]
        plain = [self.score(f) for f in lattice.plain]
        best, back = [(-inf, -inf)] * n, [[None, None] for _ in range(n)]
        ahead = [(-inf, -inf)] * n
        best[0] = ahead[0] = (0.0, -inf)
        for t in range(1, n):
            (p, e), (q, f) = best[t - 1], ahead[t - 1]
            stay, leave = p + step["plain", "plain"], e + step["entity", "plain"]
            to_plain, back[t][0] = max(stay, leave) + plain[t - 1], (t - 1, None, int(leave > stay))
            sum_plain = log_sum(q + step["plain", "plain"], f + step["entity", "plain"]) + plain[t - 1]
            to_entity = sum_entity = -inf
            for s, k in ends[t]:
                kind = group[k].kind
                a, b = best[s][0] + step["plain", kind], best[s][1] + step["entity", kind]
                if max(a, b) + own[k] > to_entity:
                    to_entity, back[t][1] = max(a, b) + own[k], (s, k, int(b > a))
                sum_entity = log_sum(sum_entity, log_sum(ahead[s][0] + step["plain", kind], ahead[s][1] + step["entity", kind]) + own[k])
            best[t], ahead[t] = (to_plain, to_entity), (sum_plain, sum_entity)
        # after the last place comes plain text
        behind = [(-inf, -inf)] * n
        behind[-1] = (step["plain", "plain"], step["entity", "plain"])
        whole = log_sum(ahead[-1][0] + behind[-1][0], ahead[-1][1] + behind[-1][1])
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for t in range(n):
            for s, k in ends[t]:
                starts[s].append((t, k))
        for t in range(n - 2, -1, -1):
            after = plain[t] + behind[t + 1][0]
            p, e = step["plain", "plain"] + after, step["entity", "plain"] + after
            for z, k in starts[t]:
                kind = group[k].kind
                p, e = log_sum(p, step["plain", kind] + own[k] + behind[z][1]), log_sum(e, step["entity", kind] + own[k] + behind[z][1])
            behind[t] = (p, e)
        out = []
        t, state = n - 1, int(best[-1][1] + behind[-1][1] > best[-1][0] + behind[-1][0])
        while t > 0:
            s, k, before = back[t][state]
            if k is not None:
                kind = group[k].kind
                into = log_sum(ahead[s][0] + step["plain", kind], ahead[s][1] + step["entity", kind])
                out.append((group[k], exp(min(0.0, into + own[k] + behind[t][1] - whole))))
            t, state = s, before
        return out[::-1]

    def added(self, text: str, base: list[Span]) -> list[tuple[str, int, int, float]]:
        """Spans that the field adds to the base ones."""
        found = segments(text)
        if not found:
            return []
        taken = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in taken], []
        for _, b in taken:
            reach.append(max(b, reach[-1] if reach else 0))

        def free(a: int, b: int) -> bool:
            k = bisect_left(starts, b)
            return k == 0 or reach[k - 1] <= a

        out = []
        for group in clusters(found):
            if any(free(s.start, s.end) for s in group):
                out += [(s.kind, s.start, s.end, p) for s, p in self.decode(Lattice(text, group)) if p >= LEAST_P and free(s.start, s.end)]
        return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


# -- training windows -----------------------------------------------------------------------------
def windows(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, span, text after, kind) of base spans, and of other numbers with kind ''. """
    base = sorted(base_spans(text), key=lambda s: s[1])
    for kind, a, b in base:
        yield text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT], kind
    covered = [(a, b) for _, a, b in base]
    k = 0
    for m in NUMBERS.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if (k == len(covered) or covered[k][0] >= m.end()) and m.end() - m.start() <= 40:
            yield text[max(0, m.start() - CONTEXT) : m.start()], m[0], text[m.end() : m.end() + CONTEXT], ""


def made_span(rng: random.Random, kind: str) -> str:
    """A span by rule, in a base form."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    if kind == "email":
        return rng.choice([word(), word() + "." + word(), word() + digits(2), word() + "_" + word()]) + "@" + ".".join(word() for _ in range(rng.choice([1, 1, 2]))) + "." + rng.choice(["com", "org", "net", "de", "fr", "es", "io", "info", "edu", word()[:3] + "a"])
    if kind == "ip":
        return ".".join(str(rng.randint(1 if k == 0 else 0, 255)) for k in range(4))
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))
    area, rest = str(rng.randint(201, 989)), digits(7)
    return "+" + rng.choice(["1", "1", "44", "49", "33", "34"]) + rng.choice([" ({}) {}-{}", " {} {} {}", "-{}-{}-{}", ".{}.{}.{}"]).format(area, rest[:3], rest[3:])


def disguised(rng: random.Random, kind: str, span: str) -> str:
    """A base span as people write it to hide it, or in another custom."""
    if kind == "email":
        local, host = span.split("@", 1)
        at = rng.choice([" at ", " AT ", " [at] ", "[at]", " (at) ", "(at)", " @ ", "{at}", "<at>"])
        dot = rng.choice([" dot ", " DOT ", "[dot]", "(dot)", " [dot] ", " (dot) ", "[.]", "(.)", "{dot}", "."])
        if dot == ".":
            at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", "{at}"])
        return (local.replace(".", dot) if rng.random() < 0.5 and dot[0] == " " else local) + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", "(.)", " dot ", "[dot]", "(dot)", " [dot] ", "{.}"]))
    digits = NOT_DIGIT.sub("", span)
    if kind == "card":
        link = rng.choice([".", "/", "_", " - ", " / ", " . "])
        return link.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    country, area, a, b = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    link = rng.choice(["-", ".", " ", "/", " - "])
    form = rng.choice(["({1}) {2}-{3}", "({1}) {2} {3}", "{1}{l}{2}{l}{3}", "{0}{l}{1}{l}{2}{l}{3}", "00{0}{l}{1}{l}{2}{l}{3}", "+{0}/{1}/{2}/{3}", "+{0}_{1}_{2}_{3}", "{0} ({1}) {2}-{3}"])
    return form.format(country or "1", area, a, b, l=link)


def decoy(rng: random.Random) -> str:
    """Numbers and at signs that are nobody's data."""
    n = rng.randint
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = made_span(rng, "card")
    wrong = card[:-1] + str((int(card[-1]) + n(1, 9)) % 10)
    link = rng.choice([".", "/", "_", " - ", " ", "-"])
    day = rng.choice(["-", "/", ".", " "]).join([f"{n(1900, 2090)}", f"{n(1, 12):02}", f"{n(1, 28):02}"])
    return rng.choice([
        lambda: link.join(wrong[k : k + 4] for k in range(0, 16, 4)), lambda: day, lambda: f"{day} {n(0, 23):02}", lambda: f"{day} {n(0, 23):02}-{n(0, 59):02}", lambda: f"{n(1, 28):02}.{n(1, 12):02}.{n(1900, 2090)}",
        lambda: " ".join(digits(n(1, 4)) for _ in range(n(2, 9))), lambda: link.join(digits(n(1, 6)) for _ in range(n(2, 5))), lambda: f"978-{n(0, 9)}-{digits(2)}-{digits(6)}-{n(0, 9)}", lambda: digits(n(3, 20)),
        lambda: f"{n(1, 40)}.{n(0, 20)}.{n(0, 99)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{n(1900, 2090)}-{n(1900, 2090)}", lambda: f"{n(1, 99)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"{n(1, 999)} / {n(1, 999)} / {digits(4)}",
        lambda: f"look at example.{rng.choice(['com', 'org', 'net'])}", lambda: f"met at noon.{rng.choice('Then And We'.split())}", lambda: "points at the dot on the line", lambda: f"@user{n(1, 99)} at home", lambda: f"5 @ {n(1, 9)}.{digits(2)}",
        lambda: f"{n(256, 999)}[.]{n(0, 255)}[.]{n(0, 255)}[.]{n(0, 999)}", lambda: f"pages {digits(3)}-{digits(3)} and {digits(3)}-{digits(4)}",
    ])()


def training_set(found: list[tuple[str, str, str, str]], seed: int = 11) -> Iterator[tuple[str, int, int, str]]:
    """Texts with at most one labelled span (start, end, kind): spans as they are and disguised, decoys, and numbers of the texts."""
    rng = random.Random(seed)
    contexts = [(a, b) for a, _, b, _ in found] or [("", "")]
    spans = [(a, s, b, k) for a, s, b, k in found if k]
    spans += [(*rng.choice(contexts), k) for k in KINDS for _ in range(250)]
    for item in spans:
        a, s, b, k = item if len(item) == 4 else (item[0], made_span(rng, item[2]), item[1], item[2])
        a, b = a if not a or a[-1].isspace() or rng.random() < 0.3 else a + " ", b if not b or b[0] in " .,;:!?)\n" else " " + b
        for span in (s, disguised(rng, k, s), disguised(rng, k, s)):
            yield a + span + b, len(a), len(a) + len(span), k
        a, b = rng.choice(contexts)
        yield a + " " + decoy(rng) + " " + b, 0, 0, ""
    for a, s, b, k in found:
        if not k:
            yield a + s + b, 0, 0, ""


# -- fitting --------------------------------------------------------------------------------------
def fit(found: list[tuple[str, str, str, str]], rounds: int = 250, penalty: float = 0.004) -> Field:
    """Weights of greatest likelihood (with a Gaussian prior) by Adam over all windows; forward and backward sums go over all lattices at once."""
    number: dict[str, int] = {}
    of = lambda f: number.setdefault(f, len(number))
    kinds = ("plain", *KINDS)
    steps = np.array([[of(f"from {a} to {b}") for b in kinds] for a in ("plain", "entity")])
    arcs: list[tuple[int, int, int, int, bool]] = []  # lattice, start, end, kind, whether it is in the labelled segmentation
    used: list[tuple[int, int]] = []  # arc, feature
    last: list[int] = []
    for text, a, b, kind in training_set(found):
        for group in clusters(segments(text)):
            lo, hi = group[0].start, max(s.end for s in group)
            gold = next((s for s in group if (s.start, s.end, s.kind) == (a, b, kind)), None)
            if gold is None and kind and a < hi and b > lo:
                continue  # its span is no candidate here
            lattice = Lattice(text, group)
            me = len(last)
            last.append(len(lattice.ends) - 1)
            inside = range(0)
            for t, ends in enumerate(lattice.ends):
                for s, k in ends:
                    if group[k] is gold:
                        inside = range(s, t)
            for t, features in enumerate(lattice.plain):
                used += [(len(arcs), of(f)) for f in features]
                arcs.append((me, t, t + 1, 0, t not in inside))
            for t, ends in enumerate(lattice.ends):
                for s, k in ends:
                    used += [(len(arcs), of(f)) for f in group[k].features]
                    arcs.append((me, s, t, kinds.index(group[k].kind), group[k] is gold))
    if not arcs:
        return Field({})
    me, start, end, kind, gold = (np.array(c) for c in zip(*arcs, strict=True))
    arc, feature = (np.array(c) for c in zip(*used, strict=True))
    last = np.array(last)
    lattices, places = len(last), int(last.max()) + 1
    by_end = [np.flatnonzero(end == t) for t in range(1, places)]
    by_start = [np.flatnonzero(start == t) for t in range(places)]
    state = (kind > 0).astype(int)
    # the state before an arc of the labelled segmentation: entity only where another labelled segment ends
    observed = np.bincount(feature, gold[arc], len(number))
    entity_end = np.zeros((lattices, places), bool)
    entity_end[me[gold & (kind > 0)], end[gold & (kind > 0)]] = True
    before = entity_end[me[gold], start[gold]].astype(int)
    np.add.at(observed, steps[before, kind[gold]], 1.0)
    np.add.at(observed, steps[entity_end[np.arange(lattices), last].astype(int), 0], 1.0)

    def add_log(into: np.ndarray, at: tuple, values: np.ndarray) -> None:
        top = np.full(into.shape[0], -np.inf)
        np.maximum.at(top, at[0], values)
        sums = np.zeros(into.shape[0])
        np.add.at(sums, at[0], np.exp(values - top[at[0]]))
        hit = sums > 0
        into[hit] = np.logaddexp(into[hit], top[hit] + np.log(sums[hit]))

    w = np.zeros(len(number))
    m, v = np.zeros_like(w), np.zeros_like(w)
    with np.errstate(divide="ignore", invalid="ignore"):
        for it in range(1, rounds + 1):
            score = np.bincount(arc, w[feature], len(me))
            step = w[steps]
            ahead = np.full((places, lattices, 2), -np.inf)
            ahead[0, :, 0] = 0.0
            into = np.empty(len(me))
            for t, at in enumerate(by_end, 1):
                prior = ahead[start[at], me[at]]
                into[at] = np.logaddexp(prior[:, 0] + step[0, kind[at]], prior[:, 1] + step[1, kind[at]])
                for s in (0, 1):
                    k = at[state[at] == s]
                    add_log(ahead[t, :, s], (me[k],), into[k] + score[k])
            behind = np.full((places, lattices, 2), -np.inf)
            behind[last, np.arange(lattices)] = step[:, 0]
            for t in range(places - 2, -1, -1):
                at = by_start[t]
                rest = score[at] + behind[end[at], me[at], state[at]]
                for s in (0, 1):
                    add_log(behind[t, :, s], (me[at],), step[s, kind[at]] + rest)
            whole = behind[0, :, 0]
            p = np.exp(into + score + behind[end, me, state] - whole[me])
            expected = np.bincount(feature, p[arc], len(number))
            for s in (0, 1):
                way = np.exp(ahead[start, me, s] + step[s, kind] + score + behind[end, me, state] - whole[me])
                np.add.at(expected, steps[s, kind], way)
                np.add.at(expected, np.full(lattices, steps[s, 0]), np.exp(ahead[last, np.arange(lattices), s] + step[s, 0] - whole))
            g = observed - expected - penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w += 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    return Field({f: float(w[k]) for f, k in number.items()})


def learn(docs: DataFrame, text_col: str = "text", most: int = MAX_TEXTS) -> Field:
    """The field fitted on the texts with the smallest hashes; only hashes are compared over all texts."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").select("text", F.xxhash64("text").alias("h"))
    low = texts.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if low is None:
        return fit([])

    def cut(batches):
        best: list[tuple[int, tuple[str, str, str, str]]] = []
        for b in batches:
            for text, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True):
                rng = random.Random(h)
                best += [(rng.getrandbits(62), w) for w in windows(text)]
            best = heapq.nsmallest(MAX_WINDOWS, set(best))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in best], pa.int64()), *(pa.array([w[k] for _, w in best], pa.string()) for k in range(4))], ["r", "before", "span", "after", "kind"])

    rows = texts.where(F.col("h") <= low).mapInArrow(cut, "r long, before string, span string, after string, kind string").distinct()
    return fit([tuple(r)[1:] for r in rows.orderBy("r", "before", "span", "after").limit(MAX_WINDOWS).collect()])


# -- operator -------------------------------------------------------------------------------------
SPAN = "struct<kind:string,start:int,end:int,base:boolean,p:double>"
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("p", pa.float64())])


def spans_of(text: str | None, field: Field) -> list[tuple[str, int, int, bool, float]]:
    """All spans of a text, by kind as listed, then start."""
    if not text:
        return []
    base = base_spans(text) if ANY.search(text) else []
    out = [(*s, True, 1.0) for s in base] + [(k, a, b, False, p) for k, a, b, p in field.added(text, base)]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, base, p) of every row; the field is fitted on docs where none is given."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weights = rows.sparkSession.sparkContext.broadcast((field or learn(docs, text_col)).weights)  # features of a bounded number of windows

    def work(batches):
        model = Field(weights.value)
        for b in batches:
            found = [spans_of(v.as_py(), model) for v in b.column("text")]
            flat = [dict(zip(("kind", "start", "end", "base", "p"), s, strict=True)) for spans in found for s in spans]
            offsets = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, _SPAN_TYPE))], ["doc_id", "spans"])

    return rows.mapInArrow(work, f"doc_id long, spans array<{SPAN}>")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans, number of added ones."""
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with each span in text_col replaced by its kind in brackets; where spans overlap, the first one's kind stands for all of them."""
    weights = docs.sparkSession.sparkContext.broadcast((field or learn(docs, text_col)).weights)

    @F.pandas_udf("string")
    def hidden(texts):
        model = Field(weights.value)
        return texts.map(lambda t: masked(t, spans_of(t, model)), na_action="ignore")

    return docs.withColumn(text_col, hidden(F.col(text_col).cast("string")))


def masked(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
