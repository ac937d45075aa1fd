"""Secret scans through layers of encoding (operator 4).

Each text is a first layer.  A worklist takes layer after layer: it is scanned for
secrets, and its encoded regions (URL escapes, Unicode and HTML escapes, base64,
compressed bytes inside base64) are decoded into further layers, until nothing new
turns up; layers seen before are not taken again, so cycles end.  Every character of a
layer knows the span of the original text that it came from.

Defined results: null text counts as empty (no spans; the digest of the empty string);
repeated rows give repeated results; an empty table gives an empty result; only id and
text are read.  What lies below base64 is read as a stream, piece by piece, and again for
each pass over it, so that decompression bombs and streams packed in streams are scanned
to their end in bounded memory; ``cut_layers`` stays in the schema and is 0.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_or_empty

#: Bytes of a stream, or of a run of base64 in it, up to which it is held in memory; beyond, it is read anew for each pass.
LAYER_BYTES = 8 << 20

#: Most bytes that a decompressor returns at once.
PIECE = 1 << 20
KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ would give, of which 24 are needed
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_NULS = re.compile(rb"(?:[^\0]\0){6}|(?:\0[^\0]){6}")
#: A line break inside base64, by the least length of lines: lines of 60 or more are also joined without shorter ones before them, which may be prose.
_BREAK = r"(?<!-----)[ \t]{0,80}(?:\r\n|\n|\r)[ \t]{0,80}(?!-----)"
_BREAKS = {n: re.compile(rf"(?<=[A-Za-z0-9+/_-]{{{n}}}){_BREAK}(?=[A-Za-z0-9+/_-])") for n in (16, 60)}
_WRAPPED = [re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{{n},}}+{_BREAK})+[A-Za-z0-9+/_-]++={{0,2}}") for n in _BREAKS]
_GAPS = re.compile(r"\s+")
_SPACES = re.compile(r"\x20{2,}")

Span = tuple[int, int, str]


def scan(text: str) -> list[tuple[int, int, str]]:
    """Base spans of a text: (start, end, kind)."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if "passw" in low or "secret" in low or "token" in low or "key" in low:
            out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class Layer:
    """A decoded text; at[i] is the original span of its character i (None: the characters are the original's)."""

    def __init__(self, text: str, at: list[tuple[int, int]] | None, way: str):
        self.text, self.at, self.way = text, at, way

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.at is None:
            return start, end
        own = self.at[start:end]
        return min(a for a, _ in own), max(b for _, b in own)


def _url(layer: Layer) -> list[Layer]:
    found = list(_ESCAPES.finditer(layer.text)) if "%" in layer.text else []
    if not found:
        return []
    text, at, p = [], [], 0
    for m in found:
        text += layer.text[p : m.start()]
        at += [layer.span(i, i + 1) for i in range(p, m.start())]
        p, q = m.start(), 0
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"):  # an ill-formed byte becomes one sign
            size = 1 if c == "\ufffd" else len(c.encode())
            text.append(c), at.append(layer.span(p + 3 * q, min(m.end(), p + 3 * (q + size))))
            q += size
        p = m.end()
    text += layer.text[p:]
    at += [layer.span(i, i + 1) for i in range(p, len(layer.text))]
    return [Layer("".join(text), at, "url")]


def _escapes(layer: Layer) -> list[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return []
    found = list(_UNICODE.finditer(layer.text))
    if not found:
        return []
    text, at, p = [], [], 0
    for m in found:
        text += layer.text[p : m.start()]
        at += [layer.span(i, i + 1) for i in range(p, m.start())]
        text.append(_character(m[0])), at.append(layer.span(*m.span()))
        p = m.end()
    text += layer.text[p:]
    at += [layer.span(i, i + 1) for i in range(p, len(layer.text))]
    return [Layer("".join(text), at, "unicode")]


Read = Callable[[], Iterator]


def _packed(data: bytes) -> bool:
    """Whether the bytes begin as a zlib or gzip stream does."""
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0)


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed bytes of one stream after another, up to damage; bytes after these are passed on.  Nothing if there is no stream."""
    d, hold, some = zlib.decompressobj(47), b"", False
    for data in pieces:
        data, hold = hold + data, b""
        while data:
            if d is None:  # between streams, which NUL may pad
                data = data.lstrip(b"\0")
                if len(data) < 3:
                    hold = data
                    break
                if not _packed(data):
                    yield data
                    yield from pieces
                    return
                d = zlib.decompressobj(47)
            more, rest = True, data
            while more and not d.eof:
                before = d.copy()
                try:
                    out = d.decompress(rest, PIECE)
                except zlib.error:  # the bytes before the damage, then the rest as it is
                    for i in range(len(rest)):
                        try:
                            out = before.decompress(rest[i : i + 1])
                        except zlib.error:
                            break
                        if out:
                            some = True
                            yield out
                    if some:
                        yield rest
                        yield from pieces
                    return
                if out:
                    some = True
                    yield out
                rest = d.unconsumed_tail
                more = bool(rest) or len(out) == PIECE
            data, d = (d.unused_data, None) if d.eof else (b"", d)
    if hold:
        yield hold


def _held(read: Read) -> tuple[Read, bytes, bytes]:
    """(a reader, which has the bytes in memory if they are few; their head; their digest)."""
    parts, size, head, name = [], 0, b"", hashlib.blake2b(digest_size=16)
    for piece in read():
        name.update(piece)
        head = head if len(head) > 2 else head + piece[:3]
        size += len(piece)
        if size <= LAYER_BYTES:
            parts.append(piece)
    data = b"".join(parts)
    return (lambda: iter([data])) if size <= LAYER_BYTES else read, head, name.digest()


def _innermost(read: Read) -> tuple[Read, str]:
    """What is left of bytes once streams packed in streams are unpacked, and the way there."""
    way, (read, head, name) = "base64", _held(read)
    seen = {name}
    while _packed(head):
        inner, head, name = _held(lambda outer=read: _inflated(outer()))
        if not head or name in seen:  # no stream, or one that holds itself
            break
        seen.add(name)
        read, way = inner, way + "+zip"
    return read, way


def _text(read: Read, codec: str = "utf-8", skip: int = 0) -> Iterator[str]:
    """Bytes in pieces as text, ill-formed ones replaced."""
    d = codecs.getincrementaldecoder(codec)("replace")
    for piece in read():
        own = piece[skip:]
        skip = max(0, skip - len(piece))
        yield d.decode(own)
    yield d.decode(b"", True)


def _url_text(pieces: Iterator[str]) -> Iterator[str]:
    """A text in pieces with its URL escapes decoded."""
    d, hold = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        text, out, p = hold + piece, [], 0
        end = max(text.rfind("%", -2), 0) if "%" in text[-2:] else len(text)
        for m in _ESCAPES.finditer(text, 0, end):
            if m.start() > p:
                out += d.decode(b"", True), text[p : m.start()]
            out.append(d.decode(bytes.fromhex(m[0].replace("%", ""))))
            p = m.end()
        if p < end:
            out += d.decode(b"", True), text[p:end]
        hold = text[end:]
        yield "".join(out)
    yield d.decode(b"", True) + hold


def _character(escape: str) -> str:
    digits = escape.strip("\\uUx{}&#X;")
    code = int(digits, 10 if escape.startswith("&#") and escape[2] not in "xX" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _unicode_text(pieces: Iterator[str]) -> Iterator[str]:
    """A text in pieces with its Unicode and HTML escapes decoded; none is longer than 10 characters."""
    hold = ""
    for piece in pieces:
        text, out, p = hold + piece, [], 0
        for m in _UNICODE.finditer(text):
            if m.start() > len(text) - 11:
                break
            out += text[p : m.start()], _character(m[0])
            p = m.end()
        end = max(p, len(text) - 10)
        out.append(text[p:end])
        hold = text[end:]
        yield "".join(out)
    yield _UNICODE.sub(lambda m: _character(m[0]), hold)


def _bytes_of(run: str) -> bytes:
    """A run of base64 characters decoded; of a last group, whole bytes."""
    run = run.replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _encoded(text: str) -> Iterator[re.Match]:
    """The runs of base64 in a text: lines on their own, and joined over single line breaks."""
    yield from _BASE64.finditer(text)
    if "\n" in text or "\r" in text:
        for pattern in _WRAPPED:
            yield from pattern.finditer(text)


def _part(read: Read, start: int, end: int) -> Iterator[bytes]:
    """Characters start to end of a text in pieces, decoded from base64."""
    at, hold = 0, ""
    for piece in read():
        hold += piece[max(0, start - at) : max(0, end - at)]
        at += len(piece)
        whole = len(hold) // 4 * 4
        if whole:
            yield _bytes_of(hold[:whole])
        hold = hold[whole:]
        if at >= end:
            break
    yield _bytes_of(hold)


def _runs(read: Read) -> Iterator[Read]:
    """Readers of the bytes behind each run of 16 base64 characters or more of a text in pieces."""

    def reader() -> Read:
        if size > LAYER_BYTES:
            return lambda start=start, end=start + size: _part(read, start, end)
        data = _bytes_of("".join(parts))
        return lambda: iter([data])

    at, start, size, parts = 0, 0, 0, []  # the run that is open
    for piece in read():
        p = 0
        if size:
            m = _RUN.match(piece)
            p = m.end() if m else 0
            size += p
            if size <= LAYER_BYTES:
                parts.append(piece[:p])
            if p < len(piece):
                if size >= 16:
                    yield reader()
                size, parts = 0, []
        if not size:
            tail = max(p, len(piece.rstrip(_ALPHABET)))
            for m in _LONG.finditer(piece, p, tail):
                start, size, parts = at + m.start(), m.end() - m.start(), [m[0]]
                yield reader()
            start, size, parts = at + tail, len(piece) - tail, [piece[tail:]]
        at += len(piece)
    if size >= 16:
        yield reader()


def _unwrapped(pieces: Iterator[str], least: int) -> Iterator[str]:
    """A text in pieces without the line breaks after at least so many base64 characters that more of them follow."""
    hold, done = "", 0  # done: the characters of hold that are passed on and only seen by the lookbehind
    for piece in itertools.chain(pieces, [None]):
        text = hold + (piece or "")
        last = len(text) if piece is None else max(done, len(text) - 170)  # a break and what follows it take less
        out, p = [], done
        for m in _BREAKS[least].finditer(text, done):
            if m.start() > last:
                break
            out.append(text[p : m.start()])
            p = m.end()
        end = max(p, last)
        out.append(text[p:end])
        kept = max(0, end - 80)
        hold, done = text[kept:], end - kept
        yield "".join(out)


def _kinds(pieces: Iterator[str]) -> set[str]:
    """The kinds of secrets that scan() finds in the whole of a text in pieces; 24 characters settle each kind, once spaces are single."""
    found: set[str] = set()
    hold = ""
    for piece in pieces:
        text = _SPACES.sub(" ", hold + piece)
        found |= {kind for *_, kind in scan(text)}
        done = 0
        for m in _ASSIGN.finditer(text) if ":" in text or "=" in text else ():
            done = m.start() if m.end() == len(text) else m.end()
        hold = text[max(done, len(text) - 24) :]
    return found


def _inside(text: Read, way: str) -> Iterator[tuple[Read, str]]:
    """The layers right below a text in pieces, and their ways."""
    marks = {c for piece in text() for c in "%\\&\r\n" if c in piece}
    if "%" in marks:
        yield lambda: _url_text(text()), f"{way}>url"
    if marks & {"\\", "&"}:
        yield lambda: _unicode_text(text()), f"{way}>unicode"
    wrapped = [lambda n=n: _unwrapped(text(), n) for n in _BREAKS] if marks & {"\r", "\n"} else []
    for run in itertools.chain.from_iterable(map(_runs, [text, *wrapped])):
        for child, own in _texts(run):
            yield child, f"{way}>{own}"


def _alternate(pieces: Iterator[bytes]) -> bool:
    """Whether NUL takes turns with other bytes as it does in UTF-16, over 6 characters (no secret is shorter)."""
    hold = b""
    for piece in pieces:
        data = hold + piece
        if b"\0" in data and _NULS.search(data):
            return True
        hold = data[-12:]
    return False


def _texts(run: Read) -> Iterator[tuple[Read, str]]:
    """The texts that bytes behind base64 can be, and their ways.  Any bytes are text enough: the patterns of secrets reject noise."""
    read, way = _innermost(run)
    yield lambda: _text(read), way
    if _alternate(read()):
        for codec in ("utf-16-le", "utf-16-be"):
            for skip in (0, 1):  # it may begin after an odd number of bytes
                yield lambda codec=codec, skip=skip: _text(read, codec, skip), way


def _below(span: tuple[int, int], run: Read, above: str, seen: set[bytes]) -> Iterator[Span]:
    """The secrets in the bytes behind base64 and in all layers below; they all lie in the run's span."""
    stack = [((text, f"{above}>{way}".lstrip(">")) for text, way in _texts(run))]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            continue
        text, way = child
        name = hashlib.blake2b(repr(span).encode(), digest_size=16)
        for piece in text():
            name.update(piece.encode("utf-8", "replace"))
        if name.digest() not in seen:
            seen.add(name.digest())
            yield from ((*span, f"{kind}@{way}") for kind in sorted(_kinds(text())))
            stack.append(_inside(text, way))


def all_spans(text: str) -> tuple[list[Span], list[Span], int]:
    """(base spans, spans that the decoded layers add, layers cut: none).  The kind of an added span is its kind@way>way."""
    base = scan(text)
    added: set[Span] = set()
    seen = {hashlib.blake2b(text.encode(), digest_size=16).digest()}
    work = [Layer(text, None, "")]
    while work:
        layer = work.pop()
        if layer.at is not None:
            added |= {(*layer.span(s, e), f"{kind}@{layer.way}") for s, e, kind in scan(layer.text)}
        for m in _encoded(layer.text):
            data = _bytes_of(_GAPS.sub("", m[0]).rstrip("="))
            added |= set(_below(layer.span(*m.span()), lambda: iter([data]), layer.way, seen))
        for child in [*_url(layer), *_escapes(layer)]:
            name = hashlib.blake2b(child.text.encode("utf-8", "replace") + repr(child.at[:1] + child.at[-1:]).encode(), digest_size=16).digest()
            if name not in seen:
                seen.add(name)
                child.way = f"{layer.way}>{child.way}".lstrip(">")
                work.append(child)
    same = {(s, e, k) for s, e, k in base}
    return base, [x for x in added if (x[0], x[1], x[2].split("@")[0]) not in same], 0


def _written(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order.get(x[2].split("@")[0], 9), x[2], x[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, cut_layers long"


def secrets(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each document: counts and digest of the base spans, all spans, and how many were added."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {x.split()[0]: [] for x in SCHEMA.split(", ")} | {"doc_id": batch.column(0)}
        for text in batch.column(1).to_pylist():
            base, added, over = all_spans(text)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for *_, k in base))
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(base + added))
            out["n_added"].append(len(added))
            out["cut_layers"].append(over)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of secrets, of any layer, replaced in the text and counted in ``n_secrets``; null texts stay null."""

    @F.pandas_udf("text string, n long")
    def clean(texts):
        import pandas as pd

        out = []
        for text in texts:
            if text is None:
                out.append((None, 0))
                continue
            base, added, _ = all_spans(text)
            parts, last = [], 0
            for s, e, _ in sorted(base + added):
                if e > last:
                    parts += [text[last : max(s, last)], mark if s >= last else ""]
                    last = e
            out.append(("".join([*parts, text[last:]]), len(base) + len(added)))
        return pd.DataFrame(out, columns=["text", "n"])

    out = docs.withColumn("_kinsieve_s", clean("text"))
    return out.withColumn("text", F.col("_kinsieve_s.text")).withColumn("n_secrets", F.col("_kinsieve_s.n")).drop("_kinsieve_s")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
