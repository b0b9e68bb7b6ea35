"""Personal data by candidate generation and gradient boosting.

Base spans are those of fixed formats (``base_spans``); they always count. High-recall generators propose further
spans, which may overlap: spelled-out addresses, colon-separated addresses, card-like and phone-like digit groups
that the fixed formats don't take. Boosted trees score each from its format and from the words beside it, with
probabilities calibrated and a threshold per kind chosen on examples that the trees have not seen. Accepted spans
don't overlap base spans or each other; the likelier wins.

The trees learn from ``examples``: sentences made from templates and a seed, in which each planted item is known to
be personal or not, so no labels of the corpus are used. Fitting takes a second on the driver and doesn't depend on
the corpus; scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts have no spans; positions are code points, end exclusive; any length of text is
taken whole, in time proportional to it; a null ``doc_id`` stays null; repeated rows stay; an empty table gives an
empty result; ``redact`` keeps all other columns as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted

KINDS = ("email", "ip", "card", "phone")

_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_host = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_not_digit = re.compile(r"[^0-9]+")

#: What every match of ``_spelled`` holds.
_spelled_sign = re.compile(r"(?:[\[({]at[\])}] ?| at |@ ?)[\w-]{1,63}+(?: ?[\[({]dot[\])}] ?| dot |\.)[\w-]", re.I)
_spelled = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+(?: ?[\[({]at[\])}] ?| at | ?@ ?)[\w-]{1,63}+(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[\w-]{1,63}+){1,6}", re.I)
_colons = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4})(?![\w:])")
_groups = re.compile(r"(?<![\w+.-])[0-9]{1,19}+(?:[ ./-][0-9]{1,19}+){0,6}(?![\w])")
_number = re.compile(r"(?<![\w+.-])(?:\(\+?[0-9]{1,5}\)|\+?[0-9]{2,5})(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w])")

# Words that stand beside personal data, and words that stand beside other numbers.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel", "kontakt", "schreiben"),
    "ip": ("ip", "address", "host", "server", "adresse", "client", "login", "dirección"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "amex", "karte", "carte", "tarjeta", "kreditkarte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "ring", "whatsapp"),
}
OTHER = ("version", "order", "invoice", "isbn", "serial", "token", "date", "page", "time", "total", "section", "chapter", "id", "ref", "build", "score", "bestellung", "rechnung", "commande", "pedido", "datum", "fecha")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, leftmost and non-overlapping per kind, by start and then kind."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _host.match(text, at)):
            found.append((start, last := m.end(), "email"))
        at = text.find("@", max(at + 1, last))
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= len(_not_digit.sub("", m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, of any kind and overlapping, base spans not left out."""
    found: set[Span] = set()
    if _spelled_sign.search(text):
        found |= {(m.start(), m.end(), "email") for m in _spelled.finditer(text)}
    if _digit.search(text):
        if text.count(":") > 1:
            found |= {(m.start(), m.end(), "ip") for m in _colons.finditer(text)}
        for m in _groups.finditer(text):
            if 13 <= len(_not_digit.sub("", m[0])) <= 19:
                found.add((m.start(), m.end(), "card"))
        for m in _number.finditer(text):
            if 7 <= len(_not_digit.sub("", m[0])) <= 15:
                found.add((m.start(), m.end(), "phone"))
    return sorted(found)


_words = re.compile(r"[^\W\d_][\w-]*")


def features(text: str, span: Span) -> list[float]:
    """Format of the span and words within 48 characters on either side."""
    a, b, kind = span
    s = text[a:b]
    groups = [g for g in _not_digit.split(s) if g]
    digits = "".join(groups)
    seps = {c for c in s if not c.isalnum()}
    left, right = text[max(0, a - 48) : a].lower(), text[b : b + 48].lower()
    before, after = _words.findall(left)[-4:], _words.findall(right)[:3]
    cue = lambda words, which: float(any(w == c or w.startswith(c) and len(c) > 3 for w in words for c in which))
    sizes = [len(g) for g in groups] or [0]
    first = int(groups[0][:4]) if groups else 0
    return [
        *(float(kind == k) for k in KINDS),
        *(cue(before, CUES[k]) for k in KINDS), cue(after, CUES[kind]), cue(before, OTHER),
        float(len(s)), float(len(digits)), float(len(seps)), float(len(groups)), float(max(sizes)), float(min(sizes)),
        float(luhn(digits)) if digits else 0.0, float(3 <= int(digits[0]) <= 6) if digits else 0.0,
        float("(" in s), float(s.startswith(("00", "0"))), float("." in s), float("-" in s), float("/" in s), float(s.count(":")),
        float(1900 <= first <= 2099 and sizes[0] == 4), float(len(set(digits))), float(bool(re.search(r"dot|\.", s, re.I))),
        float(bool(re.search(r"[\[({]at|at[\])}]| at ", s, re.I))), float(len(set(re.findall("[a-fA-F]", s)))),
        float(left[-1:] in "\"'=#$€"), float(right[:1] in "\"'%€$"), float(len(set(sizes)) == 1),
    ]


def examples(n: int, seed: int) -> list[tuple[str, Span | None]]:
    """``n`` sentences with the span of the personal item in each, or None where the planted item is not personal."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    word = lambda: "".join(pick("aeiounrstlmdchg") for _ in range(int(r.integers(2, 9))))

    def valid(k: int) -> str:
        s = pick("3456") + d(k - 2)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def spelled() -> str:
        at, dot = pick([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] "), ("{at}", "."), (" @ ", "."), (" at ", ".")])
        return f"{word()}{pick(['', '.', '_'])}{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de', 'fr', 'es'])}"

    def phone() -> str:
        return pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}"])

    colon = lambda: ":".join("".join(pick("0123456789abcdef") for _ in range(4)) for _ in range(8))
    good = {
        "email": spelled, "phone": phone, "ip": colon,
        "card": lambda: pick([grouped(valid(16), "."), grouped(valid(16), "/"), valid(13), grouped(d(16), " "), grouped(d(16), "-"), d(16)]),
    }
    bad = {
        "email": lambda: f"{word()} at {word()}{pick(['. ', ' dot '])}{word()}" if r.random() < 0.7 else f"{word()} @ {d(2)}.{d(2)}",
        "phone": lambda: pick([f"20{d(2)}-{pick(['01', '07', '11'])}-{pick(['03', '19', '28'])}", f"{pick(['03', '19'])}/{pick(['01', '11'])}/19{d(2)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)}.{d(2)}.{d(2)}", f"{d(3)}-{d(1)}{d(2)}-{d(5)}", f"{d(4)}-{d(4)}"]),
        "ip": lambda: pick([f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}:{d(2)}", f"{pick('abc')}{d(1)}:{d(2)}:{pick('ef')}{d(1)}"]),
        "card": lambda: pick([d(16), d(14), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"20{d(2)}{d(10)}", grouped(d(16), "."), f"{d(6)} {d(9)}"]),
    }
    out = []
    for _ in range(n):
        kind, real = pick(KINDS), bool(r.random() < 0.5)
        item = (good if real else bad)[kind]()
        told = kind == "email" or kind == "ip" or r.random() < 0.8
        if kind == "card" and real and not luhn(_not_digit.sub("", item)):
            told = True  # a number that fails its checksum is a card only beside a word that says so
        cue = pick(CUES[kind]) if real and told and r.random() < 0.95 else pick(OTHER) if r.random() < 0.6 else word()
        if kind == "card" and real and not luhn(_not_digit.sub("", item)):
            cue = pick(CUES["card"])
        if kind == "phone" and real and not told:
            item = f"({d(3)}) {d(3)}-{d(4)}"
        lead = " ".join(word() for _ in range(int(r.integers(0, 6)))) + f" {cue}{pick([' ', ': ', ' = ', ' # ' if not real else ' is '])}"
        text = lead + item + pick([" ", ". ", ", ", "; "]) + " ".join(word() for _ in range(int(r.integers(0, 6))))
        out.append((text, (len(lead), len(lead) + len(item), kind) if real else None))
    return out


def _table(rows: list[tuple[str, Span | None]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    x, y, kinds = [], [], []
    for text, real in rows:
        for c in candidates(text):
            near = real is not None and c[2] == real[2] and abs(c[0] - real[0]) <= 1 and abs(c[1] - real[1]) <= 1
            x.append(features(text, c))
            y.append(float(near))
            kinds.append(c[2])
    return np.array(x), np.array(y), kinds


@lru_cache(maxsize=4)
def model(n: int = 6000, seed: int = 4, precision: float = 0.97) -> tuple[Boosted, dict[str, float]]:
    """Trees, and per kind the least probability at which accepted examples are right in ``precision`` of cases."""
    rows = examples(n, seed)
    x, y, _ = _table(rows[: n // 2])
    cx, cy, _ = _table(rows[n // 2 : 3 * n // 4])
    trees = Boosted().fit(x, y).calibrate(cx, cy)
    tx, ty, kinds = _table(rows[3 * n // 4 :])
    p, limit = trees.predict(tx), {}
    for k in KINDS:
        own = np.array([x == k for x in kinds])
        order = np.argsort(-p[own])
        right = np.cumsum(ty[own][order]) / np.arange(1, own.sum() + 1)
        fits = np.flatnonzero(right >= precision)
        limit[k] = max(0.5, float(p[own][order][fits[-1]])) if len(fits) else 1.1
    return trees, limit


def all_spans(text: str, trees: Boosted, limit: dict[str, float], base: list[Span] | None = None) -> list[Span]:
    """Base spans and the accepted candidates, by start and then kind."""
    base = base_spans(text) if base is None else base
    proposed = candidates(text)
    if not proposed:
        return base
    p = trees.predict(np.array([features(text, c) for c in proposed]))
    starts, ends = union(base)
    added = []
    for _, (a, b, kind) in sorted((-q, c) for q, c in zip(p, proposed) if q >= limit[c[2]]):
        i = bisect_left(starts, b)
        if i == 0 or ends[i - 1] <= a:  # the last one that starts before this ends has ended by then
            starts.insert(i, a)
            ends.insert(i, b)
            added.append((a, b, kind))
    return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each covered stretch replaced by its first span's kind in brackets."""
    out, at = [], 0
    kinds = {}
    for a, _, kind in spans:
        kinds.setdefault(a, kind)
    for a, b in zip(*union(spans)):
        out += [text[at:a], f"[{kinds[a].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` (of the base spans) and ``spans`` (all)."""
    trees, limit = model()

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                n = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, trees, limit, base))))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.string(), pa.string()])], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans in ``text`` replaced; a null text stays null."""
    trees, limit = model()

    @F.pandas_udf(T.StringType())
    def clean(texts):
        return texts.map(lambda t: redacted(t, all_spans(t, trees, limit)) if t else t)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
