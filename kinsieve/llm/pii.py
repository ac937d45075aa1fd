"""Personal data by candidates and boosted trees (operator 7).

Base spans (email, ip, card, phone) follow fixed formats.  High-recall generators propose
further, overlapping candidates: written-out addresses, national phone and identity
numbers, account numbers, IPv6, dates of birth.  Boosted trees judge each candidate by
its format and its context; a calibrated threshold for each kind selects, and of
overlapping candidates the likeliest stays.  Base spans always stay.

The trees are fitted on examples put together here: formats drawn from a grammar, true
ones and look-alikes, set into contexts cut from a bounded sample of the documents
(CONTEXT_DOCS by a hash of the id).  All documents are searched, whole.

Defined results: null text counts as empty (no spans; the digest of the empty string);
repeated rows give repeated results; an empty table gives an empty result; only id and
text are read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import map_batches, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
CONTEXT_DOCS, EXAMPLES, PRECISION, SEED = 500, 4_000, 0.97, 17

_EMAIL_AFTER = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_AFTER.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


_WORDLIKE = re.compile(r"\w")

# Generators: pattern, and characters of which the text must hold one.
_GENERATORS = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s|\(@\)|\[@\])\s?[A-Za-z0-9-]{2,63}(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s)[A-Za-z]{2,24})+"), ("(at)", "[at]", "{at}", " at ", "(@)", "[@]")),
    "phone": (re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w])"), None),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), None),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])"), None),
    "ip6": (re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,5}+:[0-9A-Fa-f:]++(?:(?<=[0-9])(?:\.[0-9]{1,3}){3})?"), (":",)),
    "born": (re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-])"), None),
}
NAMES = tuple(_GENERATORS)

# Words of the context that speak for each kind.
_CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "cell", "llama", "appel"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "iban": ("iban", "account", "konto", "bank", "cuenta", "compte"),
    "ip6": ("ip", "host", "address", "server", "client"),
    "born": ("born", "birth", "dob", "geboren", "nacido", "naissance", "né"),
}


_HEX_WORDS = ("a", "ab", "add", "bad", "bed", "c", "cab", "dad", "dead", "beef", "face", "fade", "fed", "feed")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    out: list[Span] = []
    digits = _DIGIT.search(text) is not None
    for kind, (pattern, signs) in _GENERATORS.items():
        if signs is None and digits or signs is not None and any(s in text for s in signs):
            found = [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
            out += found if kind != "ip6" else [x for s, e, _ in found if (x := _ip6(text, s, e))]
    return out


def _ip6(text: str, s: int, e: int) -> Span | None:
    """The address in a run of groups and colons, which a single colon of the sentence may begin or end."""
    if "::" not in text[s:e] and text.count(":", s, e) < 7:
        return None
    for i in (s, s + 1) if text[s] == ":" else (s,):
        for j in (e, e - 1) if text[e - 1] == ":" else (e,):
            if not (i == s > 0 and _WORDLIKE.match(text[s - 1]) or j == e and _WORDLIKE.match(text[e : e + 1])):
                try:
                    ipaddress.IPv6Address(text[i:j])
                except ValueError:
                    continue
                return None if j - i < 3 else (i, j, "ip6")
    return None


def _iban(text: str) -> bool:
    t = text.replace(" ", "")
    return len(t) > 4 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    s, e, kind = span
    own, before, after = text[s:e], text[max(0, s - 40) : s].lower(), text[e : e + 20].lower()
    digits = only_digits(own)
    groups = re.findall("[0-9]+", own)
    marks = [c for c in own if not c.isalnum()]
    words = re.findall(r"[^\W\d_]+", before)[-4:]
    numbers = re.findall("[0-9]+", before)
    return [
        *(float(kind == k) for k in NAMES),
        len(own), len(digits), len(groups), len(marks), len(set(marks)), sum(c.isalpha() for c in own), sum(c == " " for c in own),
        float("(" in own), float(own[:1] in "0("), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(kind == "iban" and _iban(own)), float(kind == "ssn" and bool(groups) and groups[0] not in ("000", "666") and groups[0] < "900" and groups[1] != "00"),
        float("at" in re.split(r"\W+", own.lower())), float("dot" in re.split(r"\W+", own.lower())), float(bool(re.search(r"[\[({](?:at|@)", own.lower()))),
        sum(any(w.startswith(c) for c in _CUES[kind]) for w in words), float(bool(words) and any(words[-1].startswith(c) for c in _CUES[kind])),
        float(before.rstrip()[-1:] == ":"), float(before[-1:] == "$"), len(numbers), float(bool(after[:1]) and after[:1] in "%€$"), float(any(w in ("version", "v", "order", "page", "chapter", "price", "no", "nr", "figure", "isbn") for w in words)),
    ]


def _digits(r: random.Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))


def _example(r: random.Random, kind: str, real: bool) -> str:
    """A value of the kind's format, or one that only looks like it."""
    w, d = _word, _digits
    if kind == "email":
        at, dot = r.choice([" (at) ", "(at)", " [at] ", "[at]", " at ", "(@)"]), r.choice([" dot ", ".", " [dot] ", "(dot)"])
        if at == " at ":
            dot = r.choice([" dot ", " [dot] "])
        return f"{w(r)}{r.choice(['.', '_', ''])}{w(r)}{at}{w(r)}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if real else f"{w(r)} at {w(r)}.{w(r).title()}"
    if kind == "phone":
        if real:
            return r.choice([f"({d(r, 3)}) {d(r, 3)}-{d(r, 4)}", f"0{d(r, 3)} {d(r, 7)}"[:11], f"{d(r, 3)}-{d(r, 3)}-{d(r, 4)}", f"0{d(r, 2)}/{d(r, 4)}-{d(r, 3)}", f"0{d(r, 1)} {d(r, 2)} {d(r, 2)} {d(r, 2)} {d(r, 2)}"])
        return r.choice([f"{d(r, 4)} {d(r, 4)} {d(r, 4)}", f"{d(r, 2)}.{d(r, 2)}", f"{d(r, 3)}.{d(r, 3)}.{d(r, 3)}", f"{d(r, 2)}-{d(r, 3)}", f"{d(r, 4)}-{d(r, 2)}-{d(r, 2)}", f"{d(r, 5)} {d(r, 5)} {d(r, 5)}"])
    if kind == "ssn":
        return f"{r.randrange(1, 900):03d}-{r.randrange(1, 100):02d}-{d(r, 4)}" if real else f"{r.choice(['000', '9' + d(r, 2)])}-{d(r, 2)}-{d(r, 4)}"
    if kind == "iban":
        body = d(r, 18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check:02d}{body}" if real else f"{r.choice('ABX')}{r.choice('QRT')}{d(r, 2)} {d(r, 4)} {d(r, 4)} {d(r, 4)}"
    if kind == "ip6":
        if real:
            h = lambda n: ":".join(f"{r.randrange(1, 65536):x}" for _ in range(n))
            return r.choice([h(8), h(8), f"{h(r.randrange(1, 4))}::{h(r.randrange(1, 5))}", f"2001:db8::{r.randrange(1, 99):x}", f"fe80::{h(r.randrange(1, 5))}", f"fe80::{r.randrange(1, 16):x}", f"{h(r.randrange(2, 5))}::"])
        return f"{r.choice(_HEX_WORDS)}::{r.choice(_HEX_WORDS)}" if r.random() < 0.6 else f"{d(r, r.randrange(1, 3))}::{d(r, r.randrange(1, 3))}"
    return f"{r.randrange(1, 29):02d}{(p := r.choice('./-'))}{r.randrange(1, 13):02d}{p}{r.randrange(1930, 2012)}"


def examples(contexts: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kinds): half true values, most of them after a cue, and half look-alikes, few after one."""
    r, x, y, kinds = random.Random(seed), [], [], []
    while len(x) < n:
        kind, real = r.choice(NAMES), r.random() < 0.5
        left, right = (r.choice(contexts) if contexts else "" for _ in range(2))
        cue = r.random() < (0.6 if real else 0.05) or real and kind in ("born", "ip6", "phone")
        lead = f" {r.choice(_CUES[kind])}{r.choice([':', '', ' is', ' no'])} " if cue else r.choice([" ", " version ", " order ", " price $"]) if not real else " "
        value = _example(r, kind, real)
        text = left + lead + value + r.choice([" ", ". ", ", "]) + right
        start = len(left + lead)
        for span in candidates(text):
            if span[2] == kind and span[0] < start + len(value) and span[1] > start:
                x.append(features(text, span)), y.append(float(real)), kinds.append(NAMES.index(kind))
                break
    return np.array(x), np.array(y), np.array(kinds)


class Model:
    """Trees, and for each kind the log odds from which candidates are taken."""

    def __init__(self, trees: Boosted, least: dict[str, float]):
        self.trees, self.least = trees, least

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates past their threshold, the likeliest first, none across another or a base span."""
        found = [c for c in candidates(text) if not any(c[0] < e and s < c[1] for s, e, _ in base)]
        if not found:
            return []
        odds = self.trees.raw(np.array([features(text, c) for c in found]))
        out: list[Span] = []
        for _, c in sorted((-o, c) for o, c in zip(odds, found, strict=True) if o >= self.least[c[2]]):
            if not any(c[0] < e and s < c[1] for s, e, _ in out):
                out.append(c)
        return out


def fit(docs: DataFrame) -> Model:
    """Trees on one part of the examples; each kind's threshold on the other, the least that keeps PRECISION."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(1, n // CONTEXT_DOCS))) == 0)
    contexts = [r[0] for r in some.select(F.substring(text_or_empty(), 30, 120)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CONTEXT_DOCS).collect()]
    contexts = [" ".join(c.split(" ")[1:-1]) for c in contexts]
    x, y, _ = examples(contexts, EXAMPLES, SEED)
    trees = Boosted().fit(x, y)
    x, y, kinds = examples(contexts, EXAMPLES, SEED + 1)
    odds, least = trees.raw(x), {}
    for k, name in enumerate(NAMES):
        own = np.flatnonzero(kinds == k)
        order = own[np.argsort(-odds[own], kind="stable")]
        precision = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        least[name] = max(0.0, float(odds[order[good[-1]]])) if len(good) else float("inf")
    return Model(trees, least)


def _written(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order.get(x[2], 9), x[2], x[1])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal(docs: DataFrame, model: Model) -> DataFrame:
    """One row of SCHEMA for each document."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {x.split()[0]: [] for x in SCHEMA.split(", ")} | {"doc_id": batch.column(0)}
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            added = model.select(text, base)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for *_, k in base))
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(base + added))
            out["n_added"].append(len(added))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal(docs, fit(docs))
