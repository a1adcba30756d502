"""Personal data by a semi-Markov conditional random field on top of base patterns.

Base spans (e-mail, IP address, card, phone) come from linear-time patterns and always stay. The
model then labels segments of tokens in the neighbourhood of digits, "@" and spelled-out "at":
whole-span features (shape, length, separators, digit counts, checksum, left word) score each
candidate segment of at most as many tokens as the longest span of the training sample (``MAX_TOKENS``
at least), a transition weight scores neighbouring segments, and dynamic programming over segment
ends chooses boundaries and types jointly. A neighbourhood is never cut, whatever its length: segments
are scored as the programme comes to their ends, and only numbers are kept for each token.

There is no labelled personal data, so the model learns from a bounded sample of neighbourhoods: base
spans as they stand; written forms of them and of made ones that the patterns miss (a spelled-out
"at" and "dot", national phone numbers, cards and addresses with other separators), put where the
base spans stand or between words; and, as negatives, the other digit-bearing text and prose of the
sample with made dates, versions, amounts, keys and sentences with "at". Tokens are reduced to classes
(word, number, "at", "dot", the mark itself), so whole-span features are joins of class strings.
Model spans are added only where they touch no base span and clear a margin.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Least bounds of the longest segment, in tokens, and of the tokens kept on each side of a trigger.
MAX_TOKENS, REACH = 9, 6
BITS = 15
SIZE = 1 << BITS
#: Documented bounds of the training sample: documents read, clips of one document, written forms a kind, negatives; passes over them.
SAMPLE_DOCS, CLIPS, FORMS, NEGATIVES, EPOCHS = 4000, 4, 160, 500, 8
#: A model span is added when its log odds against leaving its tokens outside are at least this.
MARGIN = 1.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-z0-9À-ɏ]")
#: What a neighbourhood is taken around; a bare "at" only before a word and a dot.
_TRIGGER = re.compile(r"[0-9]+|@|[(\[] ?at ?[)\]]|(?<=[\w.%+-] )at(?= [\w-]+(?: dot |\.\w))")
#: Fewest digits near a number that make it worth looking at.
DIGITS = 4
#: What the clips of the training sample are taken around.
_CLIP = re.compile(r"[0-9][^\n]{0,40}|\S+@\S+|(?<=[\w.%+-]) at (?=[\w-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; looks only around each "@", so a long run costs once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at + 1)):
            lo = at
            while lo > last and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
                lo -= 1
            if lo < at:
                out.append((lo, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not any(c in text for c in "0123456789"):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


@dataclass
class Zone:
    """Tokens around triggers, with their places in the text, their classes and what lies before each."""

    text: str
    at: list[tuple[int, int]]

    def __post_init__(self):
        text, at = self.text, self.at
        self.cls, self.piece, self.run, self.digits, self.breaks = [], [], [], [0], [True]
        for k, (a, b) in enumerate(at):
            t = text[a:b]
            c = "9" if t.isascii() and t.isdigit() else {"at": "A", "dot": "D"}.get(t.lower(), "a") if t[0].isalpha() else t if t.isascii() else "?"
            gap = text[at[k - 1][1] : a] if k else ""
            self.cls.append(c)
            self.piece.append(" " + c if gap else c)
            self.run.append(f"{min(b - a, 5)}." if c == "9" else "")
            self.digits.append(self.digits[-1] + (b - a if c == "9" else 0))
            if k:
                self.breaks.append(gap not in ("", " "))

    def side(self, k: int, step: int) -> str:
        """The token ``k`` beyond the left (-1) or right (1) end of a segment: the word or class on the left, the class on the right, and whether it touches."""
        if not 0 <= k < len(self.at) or self.breaks[k + 1 if step < 0 else k]:
            return "|"
        (a, b), c = self.at[k], self.cls[k]
        touches = self.at[k + 1][0] == b if step < 0 else self.at[k - 1][1] == a
        word = self.text[a:b].lower() if step < 0 and c == "a" else c
        return word if touches else f"{word} "


def zones(text: str, longest: int = MAX_TOKENS, skip=None) -> Iterator[Zone]:
    """Neighbourhoods of triggers, joined where they overlap; text far from any trigger is never tokenised.

    Numbers with fewer than ``DIGITS`` digits around them are no triggers, nor are those that
    ``skip(start, end)`` names.
    """
    span, reach = None, max(REACH, longest - 1)
    for m in _TRIGGER.finditer(text):
        if skip is not None and skip(m.start(), m.end()):
            continue
        if "0" <= m[0][0] <= "9" and len(m[0]) < DIGITS and sum("0" <= c <= "9" for c in text[max(0, m.start() - 16) : m.end() + 16]) < DIGITS:
            continue
        lo, hi = max(0, m.start() - 12 * reach), min(len(text), m.end() + 12 * reach)
        if span and hi <= span[1]:
            continue
        while hi < len(text) and text[hi].isalnum() and text[hi - 1].isalnum():
            hi += 1
        if span and lo <= span[1]:
            span = (span[0], hi)
        else:
            if span:
                yield _zone(text, *span, reach)
            span = (lo, hi)
    if span:
        yield _zone(text, *span, reach)


def _zone(text: str, lo: int, hi: int, reach: int) -> Zone:
    while lo > 0 and lo < len(text) and text[lo].isalnum() and text[lo - 1].isalnum():
        lo += 1
    toks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    keep, done = [], 0
    for i, (a, b) in enumerate(toks):
        if text[a] in "0123456789@([" or text[a:b] == "at":
            end = min(len(toks), i + reach + 1)
            keep += toks[max(done, i - reach) : end]
            done = end
    return Zone(text, keep)


@lru_cache(1 << 16)
def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 3) % (SIZE // 8)


#: Class strings without spaces and brackets.
BARE = str.maketrans("", "", " ()[]")


@lru_cache(1 << 15)
def _shape_buckets(shape: str) -> tuple[int, ...]:
    """Features of a class string: itself, without repeats of a separator and class, and its marks."""
    coarse = re.sub(r"(\W?[a9])\1+", r"\1+", shape)
    mark = "".join(c for c in "@AD (+" if c in shape)
    return tuple(map(_bucket, ("b", f"s{shape[:40]}", f"c{coarse[:40]}", f"p{coarse.translate(BARE)[:40]}", f"m{mark}", f"e{shape[0]}{shape[-1]}{mark}", f"E{coarse[:3]}|{coarse[-3:]}")))


def features(z: Zone, i: int, j: int) -> list[int]:
    """Hashed whole-span features of tokens i..j-1 and of the tokens beyond its ends, without the kind."""
    shape = z.cls[i] + "".join(z.piece[i + 1 : j])
    n = z.digits[j] - z.digits[i]
    sum_ok = 16 <= n <= 19 and luhn("".join(z.text[a:b] for (a, b), c in zip(z.at[i:j], z.cls[i:j]) if c == "9"))
    parts = [z.text[a:b] for (a, b), c in zip(z.at[i:j], z.cls[i:j]) if c == "9"] if shape.count("9") == 4 else ()
    octets = bool(parts) and all(len(p) <= 3 and int(p) < 256 for p in parts)
    left, right = z.side(i - 1, -1), z.side(j, 1)
    mark = "A" if "A" in shape else "@" if "@" in shape else ""
    rest = (f"r{''.join(z.run[i:j])[:24]}|{mark}", f"n{min(n, 20)}|{mark}", f"k{sum_ok}|{n > 15}", f"o{octets}|{mark}", f"L{left}|{mark}", f"R{right}|{mark}", f"T{left[-1:] == ' ' or left == '|'}{right[-1:] == ' ' or right == '|'}{mark}")
    return [*_shape_buckets(shape), *map(_bucket, rest)]


class SemiCrf:
    """Segment weights by kind, and a transition weight for each pair of neighbouring labels (0: outside)."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), SIZE // 8)) if weights is None else weights[:-26].reshape(len(KINDS), -1)
        self.t = np.zeros((5, 5)) if weights is None else weights[-26:-1].reshape(5, 5)
        #: Most tokens of a segment.
        self.longest = MAX_TOKENS if weights is None else int(weights[-1])

    def flat(self) -> np.ndarray:
        return np.r_[self.w.ravel(), self.t.ravel(), self.longest]

    def ending(self, z: Zone, j: int) -> Iterator[int]:
        """Starts of the candidate segments that end at ``j``: bounded length, no line break, from a word, number or opening mark to a word or number.

        With letters they need an "@" or "at", and a space may stand beside "at", "dot" and brackets only;
        without, ``DIGITS`` digits, and more or a separator where they are as few.
        """
        cls, named, letters, loose = z.cls, False, False, False
        if cls[j - 1] not in "a9":
            return
        for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
            if i < j - 1 and z.breaks[i + 1]:
                break
            c = cls[i]
            loose |= i < j - 1 and z.piece[i + 1][0] == " " and c not in "AD()[]" and cls[i + 1] not in "AD()[]"
            named |= c in "@A"
            letters |= c == "a"
            if c not in "a9+([":
                continue
            n = z.digits[j] - z.digits[i]
            if named and letters and c in "a9" and not loose or not named and not letters and (n > DIGITS or n == DIGITS and j - i > 2):
                yield i

    def segments(self, z: Zone) -> dict[int, list[tuple[int, list[int]]]]:
        """By end, the candidate segments (start, features)."""
        found = {j: [(i, features(z, i, j)) for i in self.ending(z, j)] for j in range(1, len(z.at) + 1)}
        return {j: v for j, v in found.items() if v}

    def scores(self, segs) -> dict[int, list[tuple[int, list[int], np.ndarray]]]:
        return {j: [(i, f, self.w[:, f].sum(axis=1)) for i, f in v] for j, v in segs.items()}

    def best(self, z: Zone, barred: list[bool]) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, gain) of the segments on the best path, gain being the log odds against leaving their tokens outside; barred tokens stay there."""
        n = len(z.at)
        if not any(True for j in range(1, n + 1) for _ in self.ending(z, j)):
            return []
        top = np.full((n + 1, 5), -np.inf)
        top[0, 0] = 0
        start, label, score = np.zeros((n + 1, 5), np.int32), np.zeros((n + 1, 5), np.int8), np.zeros((n + 1, 5))
        # The best way from each place into each label, and the label it comes from.
        into, via = np.zeros((n + 1, 5)), np.zeros((n + 1, 5), np.int8)
        for j in range(n + 1):
            if j:
                top[j, 0], start[j, 0], label[j, 0] = into[j - 1, 0], j - 1, via[j - 1, 0]
                for i in self.ending(z, j):
                    if any(barred[i:j]):
                        continue
                    s = self.w[:, features(z, i, j)].sum(axis=1)
                    new = into[i, 1:] + s
                    better = np.flatnonzero(new > top[j, 1:])
                    if len(better):
                        y = better + 1
                        top[j, y], start[j, y], label[j, y], score[j, y] = new[better], i, via[i, y], s[better]
            ways = top[j][:, None] + self.t
            into[j], via[j] = ways.max(axis=0), ways.argmax(axis=0)
        out, j, y = [], n, int(top[n].argmax())
        while j > 0:
            i, k = int(start[j, y]), int(label[j, y])
            if y:
                outside = (j - i + 1) * self.t[0, 0]
                out.append((i, j, y - 1, float(score[j, y] + self.t[0, y] + self.t[y, 0] - outside)))
            j, y = i, k
        return out[::-1]

    def learn(self, z: Zone, gold: dict[tuple[int, int], int], rate: float, segs=None) -> None:
        """One step up the gradient of the log likelihood of ``gold`` ((start, end) to kind); ``segs`` are the candidates where they are known."""
        n = len(z.at)
        found = self.scores(self.segments(z) if segs is None else segs)
        fwd, bwd = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        fwd[0, 0], bwd[n] = 0, 0
        for j in range(1, n + 1):
            fwd[j, 0] = np.logaddexp.reduce(fwd[j - 1] + self.t[:, 0])
            for i, _, s in found.get(j, ()):
                fwd[j, 1:] = np.logaddexp(fwd[j, 1:], np.logaddexp.reduce(fwd[i][:, None] + self.t[:, 1:], axis=0) + s)
        starts: dict[int, list[tuple[int, list[int], np.ndarray]]] = {}
        for j, v in found.items():
            for i, f, s in v:
                starts.setdefault(i, []).append((j, f, s))
        for i in range(n - 1, -1, -1):
            bwd[i] = self.t[:, 0] + bwd[i + 1, 0]
            for j, _, s in starts.get(i, ()):
                bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(self.t[:, 1:] + s + bwd[j, 1:], axis=1))
        total = np.logaddexp.reduce(fwd[n])
        grad_t = np.zeros((5, 5))
        step = []
        for j in range(1, n + 1):
            grad_t[:, 0] -= np.exp(fwd[j - 1] + self.t[:, 0] + bwd[j, 0] - total)
            for i, f, s in found.get(j, ()):
                joint = np.exp(fwd[i][:, None] + self.t[:, 1:] + s + bwd[j, 1:] - total)
                grad_t[:, 1:] -= joint
                g = -joint.sum(axis=0)
                if (y := gold.get((i, j))) is not None:
                    g[y] += 1
                step.append((f, g))
        i, y = 0, 0
        ends = {a: (b, k) for (a, b), k in gold.items()}
        while i < n:
            b, k = ends.get(i, (i + 1, -1))
            grad_t[y, k + 1] += 1
            i, y = b, k + 1
        for f, g in step:
            if np.abs(g).max() > 1e-4:
                np.add.at(self.w, (slice(None), f), rate * g[:, None])
        self.t += 0.1 * rate * grad_t


class Writer:
    """Written forms of personal data that the base patterns miss, and texts that only look like some, from given spans and at random."""

    def __init__(self, words: list[str], seed: int = 5):
        self.rng, self.words = random.Random(seed), words or ["word"]

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def made(self, kind: str) -> str:
        """A span of the kind in a plain form."""
        r, w = self.rng, lambda: re.sub("[^a-z]", "", self.rng.choice(self.words).lower())[:12] or "x"
        if kind == "email":
            local = r.choice((w(), f"{w()}.{w()}", f"{w()}{self.digits(2)}", f"{w()}_{w()}", f"{w()}-{w()}"))
            return f"{local}@{r.choice((w(), f'{w()}.{w()}', f'mail{self.digits(1)}.{w()}'))}.{r.choice(('com', 'org', 'net', 'de', 'es', w()))}"
        if kind == "ip":
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == "card":
            body = r.choice("3456") + self.digits(14)
            return next(body + c for c in "0123456789" if luhn(body + c))
        return f"+{r.randint(1, 99)} {r.randint(20, 999)} {self.digits(r.choice((3, 4)))} {self.digits(r.choice((3, 4, 5)))}"

    def written(self, kind: str, plain: str) -> str:
        """Another form of a plain span, which no base pattern takes as a whole."""
        r = self.rng
        if kind == "email":
            local, domain = plain.split("@", 1)
            at = r.choice((" at ", " (at) ", "(at)", " [at] ", "[at]"))
            dot = r.choice((" dot ", "."))
            return local.replace(".", dot if r.random() < 0.3 else ".") + at + domain.replace(".", dot)
        if kind == "ip":
            return plain.replace(".", r.choice((" . ", "[.]", " dot ", "(.)")))
        if kind == "card":
            d = re.sub("[^0-9]", "", plain)
            return r.choice((".", "/", "_", " - ", " . ")).join(d[x : x + 4] for x in range(0, len(d), 4))
        d = re.sub("[^0-9]", "", plain)
        rest = d[-10:] if len(d) >= 10 else d
        a, b, c = rest[:-7], rest[-7:-4], rest[-4:]
        land = d[: -len(rest)] or str(r.randint(1, 99))
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}{c}", f"00 {land} {a} {b}{c}", f"00{land} {a} {b} {c}", f"+{land} (0) {a} / {b} {c[:2]} {c[2:]}", f"0{a} / {b} {c[:2]} {c[2:]}"]
        return r.choice(forms)

    def lookalike(self) -> str:
        """A text with digits or "at" that is no personal data."""
        r, d, w = self.rng, self.digits, lambda: self.rng.choice(self.words)
        return r.choice((
            f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1990, 2020)}-{r.randint(2021, 2030)}",
            f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}.{r.randint(300, 9999)}", f"{d(r.randint(5, 9))}", f"{d(r.randint(11, 15))}", f"{d(r.randint(20, 26))}",
            f"{r.randint(1, 999)},{d(3)}.{d(2)}", f"{d(3)}.{d(2)}, {d(2)}.{d(1)}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", f"{w()} at {w()}. {w().title()}", f"{w()} at {w()}.", f"{w()} at {r.randint(1, 12)}.{d(2)}",
            "".join(r.choice("0123456789abcdef") for _ in range(40)), "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{d(4)} {d(4)}", f"{d(3)}/{d(4)}", f"{w()} at {w()} and {w()}.{w()}", f"page {d(1)}, {w()} {d(4)}",
        ))


def lessons(texts: list[str], forms: int = FORMS, negatives: int = NEGATIVES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their spans to learn from: base spans as they stand, ``forms`` written ones of each kind (three times as many addresses), and ``negatives`` texts without any."""
    found = [(t, base_spans(t)) for t in texts]
    words = [w for t in texts[:400] for w in re.findall(r"[A-Za-zÀ-ɏ]{2,}", t)][:20_000]
    pen, rng = Writer(words), random.Random(9)
    plain = [t for t, spans in found if not spans] or [" ".join(rng.choice(pen.words) for _ in range(20))]
    out = [x for x in found if x[1]][: len(KINDS) * forms // 2]
    own = {k: [t[a:b] for t, spans in found for kind, a, b in spans if kind == k] for k in KINDS}

    def put(s: str) -> tuple[str, int, int]:
        """A clip without spans with ``s`` between two of its words or at its end; now and then ``s`` alone."""
        t = rng.choice(plain)
        if rng.random() < 0.1:
            t = ""
        at = rng.choice([m.end() for m in re.finditer(" ", t)] or [len(t)])
        lead, tail = rng.choice(("", "", "", "to ", "(", ": ")), rng.choice(("", " ", " ", ". ", ", ", "\n", ") ")) if t else ""
        return t[:at] + lead + s + tail + t[at:], at + len(lead), at + len(lead) + len(s)

    for kind in KINDS:
        for i in range(3 * forms if kind == "email" else forms):  # addresses have the most forms
            base = own[kind][i % len(own[kind])] if own[kind] and i % 2 else pen.made(kind)
            t, a, b = put(base if i % 5 == 4 else pen.written(kind, base))
            out.append((t, [(kind, a, b)]))
    for i in range(negatives):
        out.append((plain[i % len(plain)] if i % 2 else put(pen.lookalike())[0], []))
    return out


def fit_texts(texts: list[str], forms: int = FORMS, negatives: int = NEGATIVES, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from the neighbourhoods of ``lessons(texts)``."""
    made = lessons(texts, forms, negatives)
    longest = max([MAX_TOKENS, *(min(40, len(_TOKEN.findall(text, a, b))) for text, spans in made for _, a, b in spans)])
    data = []
    for text, spans in made:
        for z in zones(text, longest):
            index = {a: i for i, (a, _) in enumerate(z.at)}
            close = {b: i + 1 for i, (_, b) in enumerate(z.at)}
            gold = {(index[a], close[b]): KINDS.index(kind) for kind, a, b in spans if a in index and b in close}
            inside = [s for s in spans if z.at and s[1] < z.at[-1][1] and s[2] > z.at[0][0]]
            if len(gold) == len(inside):
                data.append((z, gold))
    model, rng = SemiCrf(), np.random.default_rng(3)
    model.t[:, 1:] = -2.0
    model.longest = longest
    known = [model.segments(z) for z, _ in data]
    data, known = zip(*[(x, s) for x, s in zip(data, known) if s]) if any(known) else ((), ())
    for e in range(epochs):
        for i in rng.permutation(len(data)):
            model.learn(*data[i], rate=0.3 / (1 + e / 4), segs=known[i])
    return model.flat()


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Weights from at most ``sample_docs`` documents that hold digits, "@" or "at", smallest id hash first.

    Only neighbourhoods of triggers are learned from, at most ``CLIPS`` of one document, as one task on an executor.
    """
    has = docs.where(F.col("text").rlike("[0-9]{4}|@| at ")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def drawn(text: str, doc_id: int) -> list[re.Match]:
        found = list(_CLIP.finditer(text))
        return found if len(found) <= CLIPS else random.Random(doc_id).sample(found, CLIPS)

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, h, t[max(0, m.start() - 150) : m.end() + 150]) for d, h, t in zip(pdf["doc_id"], pdf["h"], pdf["text"]) for m in drawn(t, d)]
            yield pd.DataFrame(rows, columns=["doc_id", "h", "text"])

    ids = has.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    clips = has.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("doc_id", "text")).mapInPandas(clip, "doc_id long, h long, text string")
    clips = clips.orderBy("h", "text").limit(4 * sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for pdf in batches for t in pdf["text"]]
        yield pd.DataFrame({"w": [fit_texts(texts).astype(np.float32).tobytes()]})

    got = clips.repartition(1).mapInPandas(run, "w binary").first()
    return np.frombuffer(bytes(got["w"]), np.float32).astype(float) if got else SemiCrf().flat()


def added_spans(text: str, base: list[tuple[str, int, int]], model: SemiCrf, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """Spans that the model adds: none touches a base span."""
    out, starts, ends = [], [], []
    for a, b in sorted((a, b) for _, a, b in base):  # as intervals that don't overlap
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def touched(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k < len(starts) and starts[k] < b

    for z in zones(text, model.longest, touched):
        barred = [touched(s, e) for s, e in z.at]
        if all(barred):
            continue
        for i, j, y, gain in model.best(z, barred):
            a, b = z.at[i][0], z.at[j - 1][1]
            if gain >= margin and not touched(a, b) and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                out.append((KINDS[y], a, b))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans)`` for every row of ``docs``.

    Spans read kind:start:end, ends exclusive, in code points, comma-joined by kind and start. A
    null text counts as empty and has none. Whole texts of any length are searched; time is linear
    in their length. Repeated rows, null ids and empty tables give as many rows as they have.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SemiCrf(weights)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                base = base_spans(text)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc, *n, _join(base), _join(base + added_spans(text, base, model))))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    id_type = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInPandas(run, f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def digest(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``find`` with a model fitted on ``docs``, base spans as their SHA-256."""
    out = find(docs, fit(docs, sample_docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
