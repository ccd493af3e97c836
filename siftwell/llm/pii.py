"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns give exact spans. The field adds what they miss: it scores whole candidate segments (up to
``LONGEST`` tokens) by features of the entire span - its shape, its digit count, Luhn, octets, its borders, the
cue word before it - for each kind, and a dynamic program over the tokens around digits and at-signs jointly
chooses boundaries and kinds. Its weights are fitted here by maximum likelihood, on made-up
sentences from a fixed seed; ``train_sentences`` bounds them. Base spans always stay; a segment that overlaps one is
not added.

Defined results: a null or empty text has no span; offsets are code points, end exclusive; repeated rows
get equal results; an empty table gives none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
#: Tokens and code points that an entity has at most.
LONGEST, LONGEST_CHARS = 14, 320

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_ANCHOR = re.compile(r"[0-9]+|@|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one at-sign and starts in the run of characters before it, so the at-signs are gone through in order."""
    free = 0
    for m in re.finditer("@", text):
        at = start = m.start()
        while start > free and text[start - 1] in _EMAIL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free


def _quads(text: str) -> Iterator[tuple[int, int]]:
    """Of numbers joined by single points, four after four."""
    for m in _DOTTED.finditer(text):
        ends = [x.end() for x in _NUMBER.finditer(text, m.start(), m.end())]
        begins = [m.start(), *(e + 1 for e in ends)]
        yield from ((begins[i], ends[i + 3]) for i in range(0, len(ends) - 3, 4))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed; in time linear in the text."""
    out = [(a, "email", b) for a, b in _emails(text)]
    for a, b in _quads(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[a:b].split(".")):
            out.append((a, "ip", b))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


_CUES = {
    "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "sms": "phone",
    "email": "email", "mail": "email", "contact": "email", "write": "email", "ip": "ip", "host": "ip", "server": "ip",
    "address": "ip", "card": "card", "visa": "card", "credit": "card", "payment": "card",
}


def features(s: str, before: str, after: str, left_word: str) -> tuple[str, ...]:
    """Of a whole segment, with the characters before and after it."""
    digits = _digits(s)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    groups = "-".join(str(min(len(x), 9)) for x in re.findall(r"[0-9]+", s))
    out = ["bias", f"shape={shape[:24]}", f"digits={min(len(digits), 20)}", f"groups={groups[:16]}", f"cue={_CUES.get(left_word, '-')}"]
    out.append(f"letters={'a' in shape}")
    out.append(f"open={not before or before.isspace()}{before == '('}")
    out.append(f"close={not after or after.isspace()}{after in set('.,;:!?)')}")
    if 13 <= len(digits) <= 19 and "a" not in shape:
        out.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
        out.append(f"octets={all(int(x) <= 255 for x in s.split('.'))}")
    if re.fullmatch(r"[\w.%+-]+\s?(@|\(at\)|\[at\])\s?[\w-]+(\s?(\.|\(dot\)|\[dot\])\s?[a-z-]{2,})+", s):
        out.append("mailbox")
    return tuple(out)


class Features(dict):
    """What ``features`` says, remembered; emptied when full. Each worker makes its own."""

    def __init__(self, most: int = 50_000):
        super().__init__()
        self.most = most

    def __missing__(self, segment: tuple[str, str, str, str]) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        got = self[segment] = features(*segment)
        return got


def candidates(text: str, tokens: list[tuple[int, int]], known: Features) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first token, token after the last, features) of the segments worth scoring."""
    out = []
    # the next token with a digit or an at-sign: without one among its tokens no segment counts
    following, last = [0] * len(tokens), len(tokens) + LONGEST
    digits = [0, *accumulate(b - a if "0" <= text[a] <= "9" else 0 for a, b in tokens)]
    for i in range(len(tokens) - 1, -1, -1):
        a, b = tokens[i]
        if text[a] == "@" or "0" <= text[a] <= "9" or text[a:b] == "at":
            last = i
        following[i] = last
    for i, (a, _) in enumerate(tokens):
        if following[i] - i >= LONGEST:
            continue
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        if a and text[a - 1].isalnum() and text[a].isalnum():
            continue
        left = ""
        for k in range(i - 1, max(-1, i - 3), -1):
            if text[tokens[k][0]].isalpha():
                left = text[tokens[k][0] : tokens[k][1]].lower()
                break
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            b = tokens[j - 1][1]
            if j > i + 1 and b - tokens[j - 2][1] > 0 and tokens[j - 1][0] - tokens[j - 2][1] > 1:
                break
            if b - a > LONGEST_CHARS:
                break
            if j <= following[i] or not text[b - 1].isalnum() or text[b : b + 1].isalnum():
                continue
            s = text[a:b]
            if digits[j] - digits[i] >= 7 or "@" in s or "(at)" in s or "[at]" in s:
                out.append((i, j, known[s, text[a - 1 : a] if a else "", text[b : b + 1], left]))
    return out


def _sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with their entities; half are of forms that the base patterns don't know."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def mail() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'example'])}"

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+44 {a} {b} {c}", f"{a}-{b}-{c}", f"+1.{a}.{b}.{c}"])

    make = {"card": card, "email": mail, "phone": phone, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))}
    cue = {k: [w for w, kind in _CUES.items() if kind == k] for k in KINDS}
    nothing = [
        lambda: number(rng.randint(7, 13)), lambda: f"{rng.randint(1900, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{number(3)}.{number(2)}", lambda: number(16), lambda: f"{number(4)}-{number(4)}", lambda: f"{word()}@{number(2)}",
        lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"{number(2)}:{number(2)}:{number(2)} {number(4)}",
        lambda: " ".join(number(3) for _ in range(5)),
    ]
    for _ in range(n):
        parts, gold, at = [], [], 0
        for _ in range(rng.randint(1, 3)):
            parts += [word() for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                if rng.random() < 0.5:
                    parts.append(rng.choice(cue[kind]))
                parts.append((kind, make[kind]()))
            else:
                parts.append(rng.choice(nothing)())
        text = ""
        for x in parts:
            text += " " if text else ""
            at = len(text)
            if isinstance(x, tuple):
                text += x[1]
                gold.append((at, len(text), x[0]))
            else:
                text += x
        yield text, gold


def _total(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


@lru_cache(maxsize=2)
def fit(train_sentences: int = 400, epochs: int = 6, seed: int = 7) -> dict[str, dict[str, float]]:
    """Weights by kind and feature: AdaGrad on the log-likelihood, by the forward-backward recursions."""
    cases, known = [], Features()
    for text, gold in _sentences(train_sentences, seed):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segments = candidates(text, tokens, known)
        true = {(a, b): kind for a, b, kind in gold}
        cases.append((len(tokens), [(i, j, f, true.get((tokens[i][0], tokens[j - 1][1]))) for i, j, f in segments]))
    w = {k: defaultdict(float) for k in KINDS}
    seen = {k: defaultdict(lambda: 1e-6) for k in KINDS}
    for _ in range(epochs):
        for n, segments in cases:
            scores = [[sum(map(w[k].__getitem__, f)) for k in KINDS] for _, _, f, _ in segments]
            ends, starts = defaultdict(list), defaultdict(list)
            for x, (i, j, _, _) in enumerate(segments):
                ends[j].append(x)
                starts[i].append(x)
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _total([alpha[j - 1], *(alpha[segments[x][0]] + v for x in ends[j] for v in scores[x])])
            for i in range(n - 1, -1, -1):
                beta[i] = _total([beta[i + 1], *(beta[segments[x][1]] + v for x in starts[i] for v in scores[x])])
            for x, (i, j, f, true) in enumerate(segments):
                for k, v in zip(KINDS, scores[x], strict=True):
                    g = (true == k) - math.exp(alpha[i] + v + beta[j] - alpha[n])
                    if abs(g) > 1e-4:
                        for name in f:
                            seen[k][name] += g * g
                            w[k][name] += 0.5 * g / math.sqrt(seen[k][name])
    return {k: dict(v) for k, v in w.items()}


class Scores(dict):
    """features -> the kinds they speak for, with scores; remembered, emptied when full."""

    def __init__(self, weights: dict[str, dict[str, float]], most: int = 50_000):
        super().__init__()
        self.weights, self.most, self.seen = weights, most, Features()

    def __missing__(self, features: tuple[str, ...]) -> list[tuple[float, str]]:
        if len(self) >= self.most:
            self.clear()
        every = ((sum(own.get(name, 0.0) for name in features), k) for k, own in self.weights.items())
        got = self[features] = [x for x in every if x[0] > 0]
        return got


def decode(text: str, tokens: list[tuple[int, int]], scores: Scores) -> list[tuple[int, str, int]]:
    """The best segmentation: its segments of some kind."""
    ends = defaultdict(list)
    for i, j, f in candidates(text, tokens, scores.seen):
        for score, k in scores[f]:
            ends[j].append((i, score, k))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, score, k in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            i, k = back[j]
            out.append((tokens[i][0], k, tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def all_spans(text: str | None, weights: dict[str, dict[str, float]] | Scores) -> tuple[list, list]:
    """Base spans; those and the field's."""
    text = text or ""
    scores = weights if isinstance(weights, Scores) else Scores(weights)
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    added, regions = [], []
    for m in _ANCHOR.finditer(text):
        if regions and m.start() - LONGEST_CHARS <= regions[-1][1]:
            regions[-1][1] = m.end() + LONGEST_CHARS
        else:
            regions.append([max(0, m.start() - LONGEST_CHARS), m.end() + LONGEST_CHARS])
    for a, b in regions:
        while a and text[a - 1].isalnum() and text[a].isalnum():  # whole tokens only
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        tokens = [m.span() for m in _TOKEN.finditer(text, a, min(b, len(text)))]
        for start, kind, end in decode(text, tokens, scores):
            # base spans by start: those before ``end``, and how far they reach
            before = bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                added.append((start, kind, end))
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[1])))


SPANS = "array<struct<kind:string,start:bigint,stop:bigint,is_base:boolean>>"


def find(documents: DataFrame, train_sentences: int = 400) -> DataFrame:
    """doc_id, spans: array of (kind, start, stop, is_base)."""
    weights = fit(train_sentences)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("is_base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(weights)
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py(), scores)
                base = set(base)
                out.append([{"kind": k, "start": a, "stop": b, "is_base": (a, k, b) in base} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")
