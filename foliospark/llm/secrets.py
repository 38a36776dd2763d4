"""Operator 1: secret scan with a recursive decoding worklist.

A text is scanned for three kinds of secrets. Then nested layers are unwrapped: percent escapes, Unicode escapes, base64
runs and compressed streams. Every layer is kept as bytes, goes to a worklist, is scanned like the text itself and
unwrapped further by every decoder until nothing new appears; a layer with the same content for the same place has been
seen (cycle detection). A stream may begin anywhere in decoded bytes; members or frames that follow each other are one
layer. Base64 runs go on over line breaks, with or without indentation, also escaped ones, and are decoded from each of
their first four digits, since letters before them may belong to the run; bytes that are no UTF-8 are scanned as they are
(ASCII in Latin-1 and other single-byte codes) and as UTF-16. Each layer maps its offsets to its parent's, so findings are reported as spans of the original text; a finding in
a compressed stream stands for the stream's whole place. n_layers counts layers that are readable, decompressed or hold
a finding.

Memory: one text at a time and the layers on the way to the one at work. A layer of more than `max_layer` bytes goes to a
temporary file of the executor, is mapped from there and scanned to its end; n_cut counts the streams that are so long.
Where the disk can't take one the task fails: nothing is left out.

Defined cases: null text is empty; a very long text is scanned whole, as bytes in memory; spans that begin together go by
kind, then end, and a span found in several layers counts once; repeated rows are scanned one by one; an empty table gives
an empty result; further columns, also of clashing names, are ignored by the report and kept by the redaction.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.common import bounded_batches, numbered, pick, read_table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: A percent escape with all escapes of its own percent sign: %2541 is %41 is A. Taking them at once keeps chains of them
#: from making a layer for each; the layers between differ in nothing that a secret can hold.
URL = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE = re.compile(rb"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: The same where the escapes stand for bytes, with the short ones that byte strings are written with.
BYTES = re.compile(UNICODE.pattern + rb"""|\\[abfnrtv0\\'"/]""")
SHORT = dict(zip(b"abfnrtv0", b"\a\b\f\n\r\t\v\0"))
BREAK = re.compile(rb"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
#: At least 16 digits, from the first of the run, and line breaks between them.
BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-](?:(?:" + BREAK.pattern + rb")?[A-Za-z0-9+/_-]){15,}+={0,2}")
#: ASCII in UTF-16, as long as the shortest secret or base64 run at least.
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){11}|(?:\0[\t\n\r\x20-\x7e]){11}")
#: Where a zlib, gzip, bz2, xz or zstd stream may begin.
MAGIC = re.compile(rb"\x78[\x01\x5e\x9c\xda]|\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
MAX_LAYER = 32 << 20
#: Bytes that are decompressed or copied at once.
PIECE = 1 << 20
#: Byte classes, so that long runs can be looked for by substring search.
_HEX_RUN = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_B64_RUN = bytes(98 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))

Span = tuple[int, int, int]


def _scan(data) -> Iterator[Span]:
    for m in ASSIGN.finditer(data):
        if m.end(2) - m.start(2) >= 6:
            yield m.start(), 0, m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(data):
            yield m.start(), kind, m.end()


def _characters(raw: bytes) -> Callable[[int, int], tuple[int, int]]:
    """Byte offsets of UTF-8 to those of characters."""
    if raw.isascii():
        return lambda s, e: (s, e)
    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return lambda s, e: (int(at[s]) - 1, int(at[e - 1]))


def scan(text: str) -> list[Span]:
    """(start, index of the kind, end) of all secrets that stand in the text as it is."""
    raw = text.encode(errors="surrogatepass")
    of = _characters(raw)
    return sorted((a, kind, b) for s, kind, e in _scan(raw) for a, b in [of(s, e)])


def may_matter(raw: bytes) -> bool:
    """False only if neither a secret nor a layer can be in the UTF-8 text."""
    low = raw.lower()
    return (
        any(s in low for s in STEMS) or b"AKIA" in raw or b"h" * 24 in raw.translate(_HEX_RUN) or b"b" * 16 in raw.translate(_B64_RUN)
        or b"%" in raw or b"\\u" in low or b"\\x" in raw or b"&#" in raw or BASE64.search(raw) is not None
    )


class Layer:
    """Decoded bytes and how their offsets map to those of the original. In a flat layer all stand for the one place.

    `place` is that of the whole layer in the original; a layer that is not sure counts only if it holds a finding.
    """

    def __init__(self, data, to_root: Callable[[int, int], tuple[int, int]], place: tuple[int, int] | None = None, flat: bool = False, sure: bool = True, cut: bool = False):
        self.data, self.to_root, self.flat, self.sure, self.cut = data, (lambda s, e: place) if flat else to_root, flat, sure, cut
        self.stream = False  # whether the whole layer has turned out to be streams with their checksums
        self.place = place or (to_root(0, len(data)) if len(data) else (0, 0))


class Pieces:
    """Offsets of bytes in which escapes were replaced: runs of bytes, each `width` wide, `stride` apart."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.source: list[tuple[int, int, int]] = []
        self.length = 0

    def add(self, length: int, source: int, stride: int, width: int) -> None:
        if length:
            if not (stride and self.at and self.source[-1][1:] == (stride, width) and self.source[-1][0] + (self.length - self.at[-1]) * stride == source):
                self.at.append(self.length)
                self.source.append((source, stride, width))
            self.length += length

    def to_source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (s, stride, _), (t, step, width) = self.source[i], self.source[j]
        return s + (start - self.at[i]) * stride, t + (end - 1 - self.at[j]) * step + width


class Spool:
    """Bytes that are written piece by piece, beyond `most` of them to a temporary file."""

    def __init__(self, most: int):
        self.most, self.parts, self.size, self.file = most, [], 0, None

    def write(self, piece: bytes) -> None:
        self.size += len(piece)
        self.parts.append(piece)
        if self.size > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.writelines(self.parts)
            self.parts = []

    def done(self) -> bytes | mmap.mmap:
        if not self.file:
            return b"".join(self.parts)
        with self.file:
            self.file.flush()
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _readable(data) -> bool:
    """Whether the bytes, or the first 64 KB of them, are UTF-8 and nearly all printable."""
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(data[: 1 << 16], len(data) <= 1 << 16)
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.95 * len(text)


class _Zstd:
    """One zstd frame; input comes in pieces so small that what they expand to is bounded."""

    def __init__(self) -> None:
        import zstandard

        self.d = zstandard.ZstdDecompressor(max_window_size=128 << 20).decompressobj()
        self.error, self.needs_input = zstandard.ZstdError, True

    def decompress(self, piece: bytes, most: int) -> bytes:
        try:
            return self.d.decompress(piece)
        except self.error as e:
            raise ValueError from e

    eof = property(lambda self: self.d.eof)
    unused_data = property(lambda self: self.d.unused_data)


def _decoder(head: bytes):
    """A decompressor for the stream that begins so, and how many bytes it is fed at once."""
    if not MAGIC.match(head):
        return None
    if head[:1] in b"\x78\x1f":
        return zlib.decompressobj(47), 1 << 16
    if head[:1] == b"B":
        return bz2.BZ2Decompressor(), 1 << 16
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor(memlimit=256 << 20), 1 << 16
    return _Zstd(), 256


def _inflated(data, at: int, step: int, d) -> Iterator[tuple[bytes, int]]:
    """The stream's content and how far it was read for it; returns where the stream ends, or None if it is broken off."""
    pos = at
    while not d.eof and pos < len(data):
        piece = data[pos : pos + step]
        pos += len(piece)
        yield d.decompress(piece, PIECE), pos
        while not d.eof and (d.unconsumed_tail if hasattr(d, "unconsumed_tail") else not d.needs_input):
            yield d.decompress(getattr(d, "unconsumed_tail", b""), PIECE), pos
    if not d.eof and hasattr(d, "flush"):
        yield d.flush(), pos
    return pos - len(d.unused_data) if d.eof else None


def _expand(data, at: int, most: int) -> tuple[Spool, int, int]:
    """The content of the compressed streams that follow each other from `at`, the end of the last whole one, and of what was read."""
    out, end, reach = Spool(most), at, at
    while got := _decoder(data[end : end + 16]):
        had, stop = 0, None
        for step in (got[1], 1):  # where a stream breaks, again byte by byte for what is before the break
            content, skip = _inflated(data, end, step, got[0]), had
            try:
                while True:
                    piece, reach = next(content)
                    out.write(piece[skip:])
                    had += len(piece[skip:])
                    skip -= min(skip, len(piece))
            except StopIteration as e:
                stop = e.value
                break
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError) as e:
                if isinstance(e, OSError) and e.errno:  # not of bz2 but of the temporary file
                    raise
                got = _decoder(data[end : end + 16])
        if stop is None:
            break
        end = reach = stop
        while data[end : end + 1] == b"\0":  # padding between members
            end += 1
    return out, end, max(end, reach)


def _streams(layer: Layer, most: int) -> Iterator[Layer]:
    """Layers of compressed streams, wherever they begin."""
    data, at = layer.data, 0
    while m := MAGIC.search(data, at):
        out, end, stop = _expand(data, m.start(), most)
        layer.stream |= m.start() == 0 and end == len(data)
        if out.size:
            content = out.done()
            place = layer.place if (m.start(), stop) == (0, len(data)) else layer.to_root(m.start(), stop)
            yield Layer(content, layer.to_root, place, flat=True, sure=end > m.start() or _readable(content), cut=out.file is not None)
        at = max(end, m.start() + 2)


def _code(unit: bytes) -> int:
    """Code point of a Unicode escape."""
    if len(unit) == 12 and unit[:2] == b"\\u":
        return 0x10000 + ((int(unit[2:6], 16) & 0x3FF) << 10) + (int(unit[8:], 16) & 0x3FF)
    return int(unit[3:-1], 16) if unit[:3] in (b"&#x", b"&#X") else int(unit[2:-1]) if unit[:1] == b"&" else int(unit[2:], 16)


def _character(n: int) -> bytes:
    return (chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�").encode()


def _byte(unit: bytes) -> bytes:
    if len(unit) == 2:
        return bytes([SHORT.get(unit[1], unit[1])])
    n = _code(unit)
    return bytes([n]) if n < 256 else _character(n)


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], bytes], most: int, sure: bool = True) -> Layer:
    """The layer with each match replaced."""
    data, out, p, last = layer.data, Spool(most), None if layer.flat else Pieces(), 0

    def copy(start: int, end: int) -> None:
        for k in range(start, end, PIECE):
            out.write(data[k : min(k + PIECE, end)])
        if p is not None:
            p.add(end - start, start, 1, 1)

    for m in pattern.finditer(data):
        copy(last, m.start())
        last = m.end()
        got = decode(m)
        out.write(got)
        if p is not None:
            p.add(len(got), m.start(), 3 if len(got) == 1 and last - m.start() == 3 else 0, last - m.start())
    copy(last, len(data))
    return Layer(out.done(), (lambda s, e: layer.to_root(*p.to_source(s, e))), layer.place if layer.flat else None, layer.flat, sure)


def _escapes(layer: Layer, most: int) -> Iterator[Layer]:
    """Layers of percent and of Unicode escapes."""
    if URL.search(layer.data):
        yield _replaced(layer, URL, lambda m: bytes.fromhex(m[1].decode()), most)
    if UNICODE.search(layer.data):
        yield _replaced(layer, UNICODE, lambda m: _character(_code(m[0])), most)
        if any(0x80 <= _code(m[0]) < 0x100 for m in UNICODE.finditer(layer.data)):  # they may be the bytes of a stream
            child = _replaced(layer, BYTES, lambda m: _byte(m[0]), most, sure=False)
            if MAGIC.search(child.data):
                yield child


def _decoded(data, parts: list[tuple[int, int]], skip: int, most: int) -> bytes | mmap.mmap:
    """What the base64 digits between the offsets stand for, but for the first few."""
    out, rest, size = Spool(most), [], 0
    for start, end in parts:
        for k in range(start, end, PIECE):
            piece = data[k : min(k + PIECE, end)]
            left = min(skip, len(piece))
            skip -= left
            rest.append(piece[left:])
            size += len(rest[-1])
            if size >= PIECE:
                run = b"".join(rest).replace(b"-", b"+").replace(b"_", b"/")
                out.write(binascii.a2b_base64(run[: size // 4 * 4]))
                rest = [run[size // 4 * 4 :]]
                size = len(rest[0])
    run = b"".join(rest).replace(b"-", b"+").replace(b"_", b"/")
    run = run[:-1] if size % 4 == 1 else run
    out.write(binascii.a2b_base64(run + b"=" * (-len(run) % 4)))
    return out.done()


def _base64(layer: Layer, most: int) -> Iterator[Layer]:
    data = layer.data
    for m in BASE64.finditer(data):
        a, b = m.span()
        end = b - data[max(a, b - 2) : b].count(b"=")
        breaks = [x.span() for x in BREAK.finditer(data, a, end)]
        parts = list(zip([a, *[y for _, y in breaks]], [*[x for x, _ in breaks], end]))
        p = Pieces()
        for x, y in parts:
            p.add(y - x, x, 1, 1)
        for skip in range(4):
            raw = _decoded(data, parts, skip, most)
            sure = _readable(raw)
            if sure or isinstance(raw, mmap.mmap) or may_matter(raw) or MAGIC.search(raw) or WIDE.search(raw):

                def of(s: int, e: int, p: Pieces = p, skip: int = skip) -> tuple[int, int]:
                    return layer.to_root(*p.to_source(skip + s // 3 * 4 + s % 3, skip + (e - 1) // 3 * 4 + (e - 1) % 3 + 2))

                yield (child := Layer(raw, of, layer.to_root(min(p.to_source(skip, skip + 1)[0], b - 1), b), layer.flat, sure))
                if child.stream:  # the other alignments are noise; find() has unwrapped this one by now
                    break


def _wide(layer: Layer, most: int) -> Iterator[Layer]:
    """Layers of the ASCII characters of UTF-16 in either byte order, others replaced."""
    data = layer.data
    if not WIDE.search(data):
        return
    for odd in (0, 1):
        out = Spool(most)
        for k in range(odd, len(data), PIECE):
            piece = data[k : k + PIECE]
            units = np.frombuffer(piece + b"\0" * (len(piece) % 2), "<u2")
            out.write(np.where(units < 0x80, units, 0x7F).astype(np.uint8).tobytes())
        if out.size:
            yield Layer(out.done(), lambda s, e, odd=odd: layer.to_root(odd + 2 * s, min(odd + 2 * e, len(data))), layer.place if layer.flat else None, layer.flat, sure=False)


def _children(layer: Layer, most: int, top: bool = False) -> Iterator[Layer]:
    for unwrap in (_escapes, _base64) if top else (_streams, _escapes, _base64, _wide):
        yield from unwrap(layer, most)


def find(text: str, max_layer: int = MAX_LAYER) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, the number of layers unwrapped, and how many streams were longer than max_layer."""
    root = Layer(raw := text.encode(errors="surrogatepass"), _characters(raw))
    base = sorted((a, kind, b) for s, kind, e in _scan(raw) for a, b in [root.to_root(s, e)])
    every, layers, cuts = set(base), 0, 0
    seen, work = {(hashlib.sha256(raw).digest(), *root.place)}, [_children(root, max_layer, top=True)]
    while work:
        if (child := next(work[-1], None)) is None:
            work.pop()
        elif len(child.data):
            cuts += child.cut
            key = (hashlib.sha256(child.data).digest(), *child.place)
            if key not in seen:
                seen.add(key)
                found = {(a, kind, b) for s, kind, e in _scan(child.data) for a, b in [child.to_root(s, e)]}
                every |= found
                layers += child.sure or bool(found)
                work.append(_children(child, max_layer))
    return base, sorted(every), layers, cuts


def joined(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_cut bigint"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = []
        for raw in batch.column(1).cast(pa.binary()):
            raw = raw.as_py() or b""
            if not may_matter(raw):
                rows.append((0, 0, 0, none, "", 0, 0))
                continue
            base, every, layers, cuts = find(raw.decode())
            rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, cuts))
        columns = list(zip(*rows)) or [[]] * 7
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each document: base counts, hash of the base spans, all spans and the number of layers."""
    bounded_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(_report, SCHEMA)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, last = [], 0
    for s, _, e in sorted(spans):
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All documents with all their columns; secrets in the text are replaced, and n_chars, if there, counts anew."""
    bounded_batches(docs.sparkSession)
    frame, (text,) = numbered(docs, "text")
    at = frame.columns.index(text)
    length = next((i for i, c in enumerate(docs.columns) if c == "n_chars"), None)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = [], None if length is None else batch.column(length).to_pylist()
            for i, raw in enumerate(batch.column(at).cast(pa.binary())):
                raw = raw.as_py()
                if raw is not None and may_matter(raw) and (every := find(raw.decode())[1]):
                    new = redacted(raw.decode(), every)
                    raw = new.encode()
                    if lengths is not None:
                        lengths[i] = len(new)
                texts.append(raw)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if lengths is not None:
                columns[length] = pa.array(lengths, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(redact, frame.schema).toDF(*docs.columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))
