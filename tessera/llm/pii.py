"""Personal data: base patterns, and gradient-boosted candidates that add what the patterns miss.

The base finds e-mail addresses, IPv4 addresses, payment cards and phone numbers by fixed patterns and tests; those spans always stay. Beside
them, high-recall generators propose overlapping candidates (spans from any digit group of a run to any other within the
digits of a kind, obfuscated addresses). Boosted trees, one
model a kind, score each candidate by its format and its context; a threshold calibrated on held-out rows to a precision of 0.995 selects
spans, best score first, none overlapping another or a base span. The models are trained on generated rows with a fixed seed; nothing is
read from the corpus.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; every row gives a row, repeated ids included; of equal
scores the longer, then the earlier span; an empty table gives an empty result. Only the id and the text are read: further columns may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted, threshold_for_precision
from .common import in_batches, quoted, small_batches, spread, strings

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995

# Fixed patterns. A lookbehind stands where it cannot change a match and keeps long runs linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each match has one @: the run of local characters before it (not into the last match) and the domain after it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


# Candidates

#: What may stand between the digit groups of one number: blanks and dashes of any width, brackets and marks.
_BLANK, _DASH = " \u00a0\u2007\u2009\u202f", "\u2010\u2011\u2012\u2013\u2014\u2212-"
_RUN = re.compile(f"[0-9](?:[0-9()./_{_BLANK}{_DASH}]*[0-9])?")
_GROUP = re.compile("[0-9]+")
_PLAIN = str.maketrans({**dict.fromkeys(_BLANK, " "), **dict.fromkeys(_DASH, "-")})
_AT = re.compile(r" ?(?:\((?:at|@)\)|\[(?:at|@)\]|\{at\}) ?| at | @ ", re.I)
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]|\[\.\]|\{dot\}) ?| dot )[A-Za-z0-9-]+)+", re.I)
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_CONTEXT = {
    "phone": re.compile(r"(?:tel|phone|call|mobile|cell|fax|whatsapp|sms|contact)\W*(?:\w+\W+)?$", re.I),
    "card": re.compile(r"(?:card|visa|credit|debit|payment|amex|master)\W*(?:\w+\W+)?$", re.I),
    "ip": re.compile(r"(?:ip|host|server|address|addr|client|from)\W*(?:\w+\W+)?$", re.I),
    "email": re.compile(r"(?:mail|contact|write|reach|address|e-mail)\W*(?:\w+\W+)?$", re.I),
    "other": re.compile(r"(?:version|isbn|order|invoice|id|no|nr|number|ref|page|date|since|sku|serial|section|chapter)\W*$", re.I),
}
#: Digits of a phone number and of a card. They bound the spans from one start, so long runs stay linear.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (13, 19)


def _opened(text: str, a: int, b: int) -> int:
    """Where a number from the digit at ``a`` begins: with the signs before it, an opening bracket only if the number closes it."""
    for _ in range(2):
        if a and (text[a - 1] == "+" or (text[a - 1] == "(" and text.find(")", a, b) >= 0)):
            a -= 1
    return a


def candidates(text: str) -> list[Span]:
    out: list[Span] = []
    if _DIGIT.search(text):
        for run in _RUN.finditer(text):
            if run.end() - run.start() < PHONE_DIGITS[0]:
                continue
            groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
            for i, (first, _) in enumerate(groups):
                n = 0
                for left, b in groups[i : i + CARD_DIGITS[1]]:  # a group has a digit at least
                    n += b - left
                    if n > CARD_DIGITS[1]:
                        break
                    if n < PHONE_DIGITS[0]:
                        continue
                    a = _opened(text, first, b)
                    if n <= PHONE_DIGITS[1]:
                        out.append((a, b, "phone"))
                    if n >= CARD_DIGITS[0]:
                        out.append((a, b, "card"))
        out += [(*m.span(), "ip") for m in _DEFANGED.finditer(text)]
    for m in _AT.finditer(text):
        domain = _DOTTED.match(text, m.end())
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if domain and start < m.start():
            out.append((start, domain.end(), "email"))
    return out


# Common top-level domains.
_TOP_LEVEL = frozenset("com org net edu gov io info biz eu de fr es it nl uk us co ch at be se no dk pl pt ru jp cn in br au ca me tv".split())
_BRACKETED = re.compile(r"[\[({](?:at|@|dot|\.)[\])}]", re.I)
_BEFORE = re.compile("([^0-9a-z]*)([0-9]*)", re.I)
#: Separators to the number beside a span, by how closely they bind.
_BINDS = {"": 0, " ": 1, "-": 2, ".": 3, "/": 4, "_": 4, "(": 5, ")": 5, " (": 5, ") ": 5}


def _beside(text: str) -> tuple[int, int]:
    """Size of the digit group that ``text`` leads to without a letter between, and what separates it."""
    between, group = _BEFORE.match(text).groups()
    return (len(group), _BINDS.get(between, 6)) if group else (0, 7)


def _left_features(text: str, a: int) -> tuple[list[float], list[float]]:
    left = text[max(0, a - 24) : a].translate(_PLAIN)
    edge = [left[-1:].isalnum() or left[-1:] in ("+", "$", "€", "#", "."), left[-1:] == " " and left[-2:-1].isdigit(), *_beside(left[::-1])]
    return edge, [bool(_CONTEXT[k].search(left)) for k in ("phone", "card", "ip", "email", "other")]


def _right_features(text: str, b: int) -> list[float]:
    right = text[b : b + 24].translate(_PLAIN)
    return [right[:1].isalnum() or right[:1] in ("%", "."), right[:1] == "." and right[1:2].isalnum(), right[:1] == " " and right[1:2].isdigit(), *_beside(right)]


def features(text: str, spans: list[Span]) -> np.ndarray:
    """A row for each span; what lies to its left and to its right is looked at once for each start and each end."""
    lefts = {a: _left_features(text, a) for a in {a for a, _, _ in spans}}
    rights = {b: _right_features(text, b) for b in {b for _, b, _ in spans}}
    out = []
    for a, b, kind in spans:
        s = text[a:b].translate(_PLAIN)
        groups = _GROUP.findall(s)
        digits = "".join(groups)
        sizes = [len(g) for g in groups] or [0]
        number = kind in ("card", "phone")
        inner = _GROUP.split(s)[1:-1] if number else []
        domain = "" if number else s.rpartition(".")[2] if "." in s else s.split()[-1]
        low = "" if number else s.lower()
        edge, context = lefts[a]
        out.append([
            len(digits), len(groups), max(sizes), min(sizes), sizes[-1], len(s),
            s.startswith("+"), "(" in s and ")" in s, s.count("."), s.count("-"), s.count(" "), s.count("/") + s.count("_"),
            bool(digits) and luhn(digits), digits[:1] in ("3", "4", "5", "6"), len(set(digits)),
            len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 4), sum(1900 <= int(g) <= 2100 for g in groups if len(g) == 4),
            sizes[0], sizes[min(1, len(sizes) - 1)], sizes.count(2), sizes.count(3), sizes.count(4), digits[:2] == "00", digits[:1] == "0",
            len(set(inner)), max((_BINDS.get(x, 6) for x in inner), default=0), sum(x not in _BINDS for x in inner), inner[0] == inner[-1] if inner else 2,
            *edge, *rights[b], *context,
            domain.strip(" )]}").lower() in _TOP_LEVEL, low.count(" at ") + low.count(" dot "), len(_LOCAL.match(s)[0]) if kind == "email" and _LOCAL.match(s) else 0, s.count("@"),
            sum(c.isalpha() for c in domain), not number and bool(_BRACKETED.search(s)), " dot " in low, " at " in low, not number and "." in s and "@" in s,
        ])
    return np.array(out, float)


# Training rows


def _card(rng: random.Random) -> str:
    head = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(rng.choice((14, 14, 14, 13, 12))))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ter", "an", "lo", "si", "en", "du", "the", "ra", "mi")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _pairs(rng: random.Random, cc: str) -> tuple[str, ...]:
    """Phone numbers written in groups of two digits, national and international."""
    pairs = [_digits(rng, 2) for _ in range(4)]
    one, mark = rng.choice("123456789"), rng.choice((" ", " ", ".", "-"))
    return f"00{cc} {one} {' '.join(pairs)}", f"00 {rng.choice(('33', '44', '49'))} {rng.choice(('30', '40', '89', _digits(rng, 2)))} {' '.join(pairs)}", mark.join([f"0{one}", *pairs]), f"0{_digits(rng, 3)}/{''.join(pairs)}"


def _national(rng: random.Random) -> str:
    """An area code with its leading zero and a number of five to eight digits behind a mark."""
    area, n = "0" + _digits(rng, rng.randint(2, 4)), rng.randint(5, 8)
    return f"{area}{rng.choice('/- ')}{_digits(rng, n)}" if rng.random() < 0.7 else f"({area}) {_digits(rng, n)}"


def _mailbox(rng: random.Random) -> str:
    """A local part: one or two names or an initial, with and without marks and digits."""
    first, second = _words(rng, 1), _words(rng, 1)
    name = rng.choice((first, first, f"{first}{rng.choice('._-')}{second}", f"{first[0]}{rng.choice(('', '.', '_'))}{second}"))
    return name + (rng.choice(("", ".", "_")) + _digits(rng, rng.randint(1, 4)) if rng.random() < 0.35 else "")


def _domain(rng: random.Random, dot: str) -> str:
    """One or two names under a common top-level domain."""
    names = [_words(rng, 1) for _ in range(rng.choice((1, 1, 1, 2)))]
    return dot.join([*names, rng.choice(sorted(_TOP_LEVEL)) if rng.random() < 0.5 else rng.choice(("com", "org", "net"))])


def _no_address(rng: random.Random) -> str:
    """Words around an "at" that are no address: a site that is named, a sentence, other words behind the dot."""
    local, place = _mailbox(rng), _words(rng, 1)
    other = next(w for w in iter(lambda: _words(rng, 1)[: rng.randint(2, 9)], None) if w not in _TOP_LEVEL)
    return rng.choice((f"{local} at {place}.{other}", f"{local} at {place} dot {other}", f"{_words(rng, 1)} at {_domain(rng, '.')}", f"{local} at {place} dot {_words(rng, 2)}"))


def _respaced(rng: random.Random, value: str) -> str:
    """Now and then with the blanks or dashes that typesetting puts in."""
    if rng.random() < 0.1:
        return value.replace(" ", rng.choice(_BLANK[1:])).replace("-", rng.choice("\u2010\u2011\u2013")) if value[0] != "+" else value
    return value


def training_rows(seed: int = 5, n: int = 8000) -> list[tuple[str, list[Span]]]:
    """Texts with their true spans: written forms the base knows, forms it misses, and numbers that are nobody's data."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        kind = rng.choice((*KINDS, "none", "none", "none"))
        area, mid, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        if kind == "phone":
            cc = rng.choice(("1", "44", "49", "33"))
            value = rng.choice((f"+{cc} ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+{cc} {area} {mid} {last}", f"00{cc} {area} {mid}{last}", f"{cc} ({area}) {mid}-{last}", *_pairs(rng, cc), _national(rng)))
            hint = rng.choice(("", "", "call ", "tel: ", "phone ", "mobile: "))
        elif kind == "card":
            c = _card(rng)
            step = rng.choice(("", " ", "-", ".", "/"))
            value = step.join(c[i : i + 4] for i in range(0, len(c), 4)) if step else c
            hint = rng.choice(("", "", "card ", "visa: ", "credit card "))
        elif kind == "ip":
            dot = rng.choice((".", "[.]", "(.)", " [.] ", "[dot]"))
            value = dot.join(str(rng.randint(1, 255)) for _ in range(4))
            hint = rng.choice(("", "", "host ", "ip: ", "from "))
        elif kind == "email":
            at, dot = rng.choice((("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[.]"), (" @ ", "."), (" (at) ", " (dot) "), ("{at}", "."), ("[at]", "."), (" (at) ", "."), ("(@)", ".")))
            value = f"{_mailbox(rng)}{at}{_domain(rng, dot)}"
            hint = rng.choice(("", "", "mail ", "write to ", "contact: "))
        else:
            value = rng.choice((
                f"{rng.randint(1900, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2100)} {rng.randint(10, 23)}", f"{_digits(rng, 7)}", f"{_digits(rng, rng.randint(13, 19))}",
                f"{_digits(rng, 3)}.{_digits(rng, 6)}", " ".join(_digits(rng, rng.randint(1, 4)) for _ in range(rng.randint(3, 8))), f"97{rng.choice('89')}-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}",
                _no_address(rng), _no_address(rng), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{_digits(rng, 5)}", f"{_digits(rng, 3)}-{_digits(rng, 5)}", f"{_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}", f"{_digits(rng, 10)}", f"{_digits(rng, 3)},{_digits(rng, 3)}",
            ))
            hint = rng.choice(("", "", "version ", "order ", "id ", "since ", "ref ", "isbn "))
        before, after = _words(rng, rng.randint(0, 4)), _words(rng, rng.randint(0, 4))
        value = _respaced(rng, value) if kind in ("phone", "card") else value
        start = len(before) + 1 + len(hint)
        spans = [(start, start + len(value), kind)] if kind != "none" else []
        follows = rng.choice((" ", " ", ". ", ", "))
        if kind in ("phone", "card") and (chance := rng.random()) < 0.5:
            if chance < 0.3 or value.startswith("+"):  # one number straight after another
                other, of, between = _card(rng), "card", " "
            elif chance < 0.42:  # two of one kind with a mark between
                other = value[:-4] + re.sub("[0-9]", lambda _: _digits(rng, 1), value[-4:]) if kind == "phone" else _card(rng)
                of, between = kind, rng.choice(("/", " / ", ", ", ". "))
            else:  # a count or a year begins the next words
                other, of, between = rng.choice((_digits(rng, 1), _digits(rng, 2), str(rng.randint(1950, 2030)))), None, rng.choice((". ", ", ", " - "))
            at = start + len(value) + len(between)
            spans += [(at, at + len(other), of)] if of else []
            value += between + other
        text = f"{before} {hint}{value}{follows}{after}"
        out.append((text, spans))
    return out


@lru_cache(1)
def models() -> dict[str, tuple[Boosted, float]]:
    """A model and its threshold per kind: two thirds of the generated rows fit, one third calibrates."""
    rows = training_rows()
    cut = 2 * len(rows) // 3
    out = {}
    for kind in KINDS:
        sets = []
        for part in (rows[:cut], rows[cut:]):
            x, y = [], []
            for t, spans in part:
                own = [c for c in candidates(t) if c[2] == kind]
                if own:
                    x.append(features(t, own))
                    y += [float(c in spans) for c in own]
            sets.append((np.concatenate(x), np.array(y)))
        model = Boosted().fit(*sets[0])
        out[kind] = model, threshold_for_precision(model.predict(sets[1][0]), sets[1][1], PRECISION)
    return out


def added_spans(text: str, base: list[Span], trained: dict[str, tuple[Boosted, float]]) -> list[Span]:
    taken: list[tuple[int, int]] = []  # disjoint: base spans of different kinds may overlap
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    free = [c for c in set(candidates(text)) if not _overlaps(taken, c)]
    scored = []
    for kind in KINDS:
        own = sorted(c for c in free if c[2] == kind)
        if own:
            model, least = trained[kind]
            scored += [(-p, c) for p, c in zip(model.predict(features(text, own)).tolist(), own, strict=True) if p >= least]
    out: list[Span] = []
    chosen: list[tuple[int, int]] = []
    for _, c in sorted(scored, key=lambda x: (x[0], x[1][0] - x[1][1], x[1])):
        if not _overlaps(chosen, c):
            out.append(c)
            insort(chosen, c[:2])
    return out


def _overlaps(taken: list[tuple[int, int]], c: Span) -> bool:
    """taken: disjoint and sorted, so the last that begins before the end of ``c`` ends last."""
    k = bisect_left(taken, (c[1], 0))
    return k > 0 and taken[k - 1][1] > c[0]


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, spans (base and added) and n_added."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    trained = models()

    def run(batches):
        for batch in small_batches(batches):
            counts, sha, spans, added = {k: [] for k in KINDS}, [], [], []
            for text in strings(batch.column(1)):
                base = base_spans(text)
                more = added_spans(text, base, trained)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return in_batches(spread(rows), run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
