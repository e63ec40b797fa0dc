"""Secrets in texts and in what is encoded inside them.

Every layer is scanned for secrets and then unwrapped: percent escapes, Unicode,
octal and one-letter escapes, entities, base64 runs and compressed bytes each give
new layers, which are unwrapped in turn unless the same content was seen at its
place before.  Bytes are layers like texts: compressed data is looked for at every
place of decoded or unpacked bytes, so it may lie inside other compressed data.
Each layer carries the place in the first text of each of its characters, so that
a span found in any layer is reported as a span of the first text.

A base64 run goes on over line breaks, and over blanks between parts of 16 characters, and is decoded from each of its first four
characters, so that a payload is found wherever in the run it starts; bytes that
are no readable UTF-8 are looked at as Latin-1 and as UTF-16 and make a layer if
anything can be found in them.  All members of compressed data are unpacked as a
stream, whose layers are pieces cut where no match and no run can go on; a stream
inside a stream is opened anew from its start, so memory stays at some pieces.
Deflate data without a header is looked for at the start of a run or stream only.
"""

from __future__ import annotations

import base64
import bz2
import contextlib
import hashlib
import html
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import strings

#: The kinds in their order, their patterns and the least length of the part that counts.
KINDS = ["assign", "access", "hex"]
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: A run of 32 is needed for a hex match; looking for that finds the same matches sooner.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[nrtbf/\"'\\]|(?:\\[0-3][0-7]{2})+|&(?:#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})|[A-Za-z][A-Za-z0-9]{1,30});")
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "/": "/", '"': '"', "'": "'", "\\": "\\"}
#: A base64 run over line breaks, with the white space that indents its lines, and over blanks between long parts (the last one may be short if it is padded).
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]+(?:(?:\r?\n[ \t]*|(?<=[A-Za-z0-9+/_-]{16})[ \t]+(?=[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]+=))[A-Za-z0-9+/_-]+)*={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*|[ \t]+")
_TOKEN = re.compile(r"[^\s\"'<>]+")
LEAST_RUN = 16
#: What gzip, bzip2, xz and zlib data begins with.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x78[\x01\x5e\x9c\xda]")
LONGEST_MARK = 10
#: Readable characters of 16 bits, low or high byte first.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){8,}[\t\n\r\x20-\x7e]?|(?:\0[\t\n\r\x20-\x7e]){8,}")
#: What any match or any layer begins with, for the linear-time matcher.
_ANYTHING = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux0-3nrtbf/"'\\]|&#|&[a-z][a-z0-9]+;|(?:[a-z0-9+/_-](?:\r?\n[ \t]*)?){16}"""
#: The same for bytes that are no text: a secret or another layer in them.
_IN_BYTES = re.compile(
    rb"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]{8}|AKIA[a-z0-9]{12}|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux][0-9a-f{]|\\[0-3][0-7]{2}|\\[nrt/"\\]|&#[0-9x]|&[a-z]{2,8};|(?:[a-z0-9+/_-](?:\r?\n[ \t]*)?){16}"""
)
#: Unpacked bytes in one layer, and the bytes in which no match and no run can go on.
PIECE = 1 << 20
_APART = re.compile(rb"[^A-Za-z0-9+/_=%\\&#;{}:\"'.\s\x80-\xbf-]")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base matches in one layer."""
    out = []
    for k, kind in enumerate(KINDS):
        pattern, group, least = PATTERNS[kind]
        if kind == "hex":
            pattern = _LONG_HEX
        elif kind == "access" and "AKIA" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return out


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters with the places they come from inside the match."""
    data, out, at = bytes.fromhex(m.group().replace("%", "")), [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        n = 1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode())
        out += [(m.group()[3 * at : 3 * at + 3][j], 3 * at + j, 3 * at + j + 1) for j in range(3)] if 0xDC80 <= ord(c) <= 0xDCFF else [(c, 3 * at, 3 * (at + n))]
        at += n
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    t = m.group()
    if t[1] in _LETTERS and len(t) == 2:
        return [(_LETTERS[t[1]], 0, 2)]
    if t[0] == "\\" and t[1] in "0123":
        data = bytes(int(t[i + 1 : i + 4], 8) for i in range(0, len(t), 4))
        try:
            chars = data.decode()
        except UnicodeDecodeError:
            chars = data.decode("latin-1")
            return [(c, 4 * i, 4 * i + 4) for i, c in enumerate(chars)]
        ends = np.cumsum([len(c.encode()) for c in chars]).tolist()
        return [(c, 4 * lo, 4 * hi) for c, lo, hi in zip(chars, [0, *ends], ends)]
    if t.startswith("&"):
        c = html.unescape(t)
        return [(c, 0, len(t))] if len(c) == 1 else [(x, i, i + 1) for i, x in enumerate(t)]
    if t[1] == "u" and t[2] != "{":
        units, out, i = [int(t[j + 2 : j + 6], 16) for j in range(0, len(t), 6)], [], 0
        while i < len(units):
            u = units[i]
            if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                out.append((chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00), 6 * i, 6 * i + 12))
                i += 2
            else:
                out += [(t[6 * i + j], 6 * i + j, 6 * i + j + 1) for j in range(6)] if 0xD800 <= u < 0xE000 else [(chr(u), 6 * i, 6 * i + 6)]
                i += 1
        return out
    u = int(t.strip("\\uUx{}"), 16) if t.strip("\\uUx{}") else 0
    return [(chr(u), 0, len(t))] if u < 0x110000 and not 0xD800 <= u < 0xE000 else [(x, i, i + 1) for i, x in enumerate(t)]


def _decompressor(head: bytes):
    """A decompressor for data that begins like this, or None."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if head.startswith(b"BZh") else lzma.LZMADecompressor() if head.startswith(b"\xfd7zXZ\0") else None


def unpacked(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Content of all gzip, zlib, bzip2 or xz members of a stream in parts; of broken data what comes before the fault."""
    source, data = iter(parts), b""
    while True:
        for more in source if len(data) < 6 else ():
            data += more
            if len(data) >= 6:
                break
        d = _decompressor(data[:6])
        if d is None:
            return
        try:
            yield from _fed(d, data, source)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        if not d.eof:
            return
        data = d.unused_data.lstrip(b"\0")


def _fed(d, data: bytes, source: Iterator[bytes]) -> Iterator[bytes]:
    """What the decompressor makes of ``data`` and of as much of the source as it takes, in parts of at most ``PIECE``."""
    by_need = isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor))
    while data is not None:
        yield d.decompress(data, PIECE)
        while not d.eof and (not d.needs_input if by_need else d.unconsumed_tail):
            yield d.decompress(b"" if by_need else d.unconsumed_tail, PIECE)
        data = None if d.eof else next(source, None)
    if not by_need and not d.eof:
        yield d.flush()


def _bare(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Content of deflate data without a header."""
    source = iter(parts)
    with contextlib.suppress(zlib.error):
        yield from _fed(zlib.decompressobj(-15), next(source, b""), source)


def _chunks(data: bytes) -> Iterator[bytes]:
    return (data[i : i + PIECE] for i in range(0, len(data), PIECE))


def _skipped(parts: Iterator[bytes], n: int) -> Iterator[bytes]:
    for part in parts:
        if n < len(part):
            yield part[n:]
        n = max(0, n - len(part))


def _sound(head: bytes, d=None) -> bool:
    """Whether the first bytes may be those of compressed data."""
    try:
        d = d or _decompressor(head[:6])
        if d is not None:
            d.decompress(head, PIECE)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return False
    return d is not None


def pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of about ``PIECE``, cut before a byte that belongs to no match, run or character begun earlier."""
    held, looked = bytearray(), 0
    for part in parts:
        held += part
        while len(held) > PIECE:
            m = _APART.search(held, max(PIECE, looked))
            if m is None:
                looked = len(held)
                break
            yield bytes(held[: m.start()])
            del held[: m.start()]
            looked = 0
    if held:
        yield bytes(held)


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text) else None


def _as_text(data: bytes) -> str | None:
    """Readable UTF-8, else Latin-1 if anything can be found in it."""
    return _readable(data) or (data.decode("latin-1") if _IN_BYTES.search(data) else None)


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))


Layer = tuple[str, np.ndarray | None, np.ndarray | None]


def _wide_texts(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Readable UTF-16 in bytes, with the place of each character's byte."""
    for m in _WIDE.finditer(data):
        at = np.arange(m.start() + (m.group()[0] == 0), m.end(), 2)
        yield m.group().replace(b"\0", b"").decode(), at


def _stream_layers(opened: Callable[[], Iterator[bytes]], a: int, b: int, seen: set, plain: bool) -> Iterator[Layer]:
    """Layers of a stream's pieces and of what is packed in it, all standing at ``a`` to ``b``.

    Text in which nothing can be found is a layer only if ``plain``.  A piece seen at this place before is left out.
    """

    def layer(text: str) -> Layer:
        return text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text))

    at, tail = 0, b""
    for piece in pieces(opened()):
        key = (xxhash.xxh3_128_digest(piece), at, a, b)
        buffer, start = tail + piece, at - len(tail)
        first, at, before = at == 0, at + len(piece), len(tail)
        tail = buffer[-LONGEST_MARK:]
        if key in seen:
            continue
        seen.add(key)
        text = _as_text(piece) if plain or _IN_BYTES.search(piece) else None
        if text:
            yield layer(text)
        for wide, _ in _wide_texts(piece):
            yield layer(wide)
        for m in _PACKED.finditer(buffer):
            if m.end() > before and _sound(buffer[m.start() : m.start() + 1024]):
                yield from _stream_layers(lambda n=start + m.start(): unpacked(_skipped(opened(), n)), a, b, seen, False)
        if first and not (text and plain) and _sound(piece[:4096], zlib.decompressobj(-15)):
            yield from _stream_layers(lambda: _bare(opened()), a, b, seen, False)


def _base64_layers(layer: str, place: Callable, seen: set) -> Iterator[Layer]:
    for m in _WRAPPED.finditer(layer):
        if m.end() - m.start() < LEAST_RUN:
            continue
        whole = m.group().rstrip("=")
        breaks = [(b.start(), b.end()) for b in _BREAK.finditer(whole)]
        at = np.arange(len(whole), dtype=np.int64)
        if breaks:
            stays = np.ones(len(whole), bool)
            for a, b in breaks:
                stays[a:b] = False
            at, run = at[stays], _BREAK.sub("", whole)
        else:
            run = whole
        if len(run) < LEAST_RUN:
            continue
        at += m.start()

        def text_layer(text: str, begin: np.ndarray, end: np.ndarray, lo: int, hi: int, at=at) -> Layer:
            """A layer of characters that stand at these bytes of what ``run[lo:hi]`` decodes to."""
            first, last = lo + 4 * (begin // 3), np.minimum(hi, lo + 4 * ((end - 1) // 3) + 4)
            a, b = place(at[first], at[last - 1])
            return text, a, b

        # The run as it stands, else each of its lines, if that reads as text.
        read = set()
        for lo, hi in [(0, len(run))] if not breaks else [(0, len(run)), *_line_ends(whole, breaks)]:
            if hi - lo < LEAST_RUN or (0, len(run)) in read:
                continue
            data = _decoded(run[lo:hi])
            text = _readable(data)
            if text:
                read.add((lo, hi))
                b = np.frombuffer(data, np.uint8)
                ends = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
                yield text_layer(text, ends[:-1], ends[1:], lo, hi)
        # All alignments, so that the payload may start anywhere.
        for lo in range(4):
            data = _decoded(run[lo:])
            for c in _PACKED.finditer(data):
                if _sound(data[c.start() : c.start() + 1024]):
                    first = lo + 4 * (c.start() // 3)
                    a, b = place(at[first : first + 1], np.array([m.end() - 1]))
                    # Inside a run, chance can look like compressed data; it makes no layer of its own.
                    yield from _stream_layers(lambda d=data, n=c.start(): unpacked(_skipped(_chunks(d), n)), int(a[0]), int(b[0]), seen, c.start() + lo == 0)
            if (lo, len(run)) in read:
                continue
            if _IN_BYTES.search(data):
                every = np.arange(len(data))
                yield text_layer(data.decode("latin-1"), every, every + 1, lo, len(run))
            for text, i in _wide_texts(data):
                yield text_layer(text, i, i + 1, lo, len(run))
            if _sound(data[:4096], zlib.decompressobj(-15)):
                a, b = place(at[lo : lo + 1], np.array([m.end() - 1]))
                yield from _stream_layers(lambda d=data: _bare(_chunks(d)), int(a[0]), int(b[0]), seen, False)


def _line_ends(whole: str, breaks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of each line in the run without its breaks."""
    start = gone = 0
    for a, b in [*breaks, (len(whole), len(whole))]:
        yield start, a - gone
        start, gone = a - gone, gone + b - a


def _inner(layer: str, begin: np.ndarray | None, stop: np.ndarray | None, seen: set) -> Iterator[Layer]:
    """The layers right inside this one."""

    def place(lo, hi):
        """Where the characters from ``lo`` to ``hi``, both included, stand in the first text."""
        return (lo, hi + 1) if begin is None else (begin[lo], stop[hi])

    for pattern, decode, mark in ((_PERCENT, _percent, "%"), (_ESCAPE, _escape, "")):
        if mark not in layer or (not mark and "\\" not in layer and "&" not in layer):
            continue
        chars, a, b, at = [], [], [], 0
        for m in pattern.finditer(layer):
            chars.append(layer[at : m.start()])
            a.append(np.arange(at, m.start())), b.append(np.arange(at, m.start()))
            got = decode(m)
            chars += [c for c, _, _ in got]
            a.append(np.array([m.start() + lo for _, lo, _ in got], np.int64)), b.append(np.array([m.start() + hi - 1 for _, _, hi in got], np.int64))
            at = m.end()
        if at:
            chars.append(layer[at:])
            a.append(np.arange(at, len(layer))), b.append(np.arange(at, len(layer)))
            yield "".join(chars), *place(np.concatenate(a), np.concatenate(b))
    # Escaped bytes that are compressed data.
    for m in _TOKEN.finditer(layer) if "%" in layer else ():
        data = urllib.parse.unquote_to_bytes(m.group()) if "%" in m.group() else b""
        for c in _PACKED.finditer(data):
            if _sound(data[c.start() : c.start() + 1024]):
                a, b = place(np.array([m.start()]), np.array([m.end() - 1]))
                yield from _stream_layers(lambda d=data, n=c.start(): unpacked(_skipped(_chunks(d), n)), int(a[0]), int(b[0]), seen, False)
    yield from _base64_layers(layer, place, seen)


def layers(text: str) -> Iterator[Layer]:
    """The text and all layers inside it: content, and per character its start and end in the first text (None: itself)."""
    seen: set = set()
    open_: list[Iterator[Layer]] = [iter([(text, None, None)])]
    while open_:
        found = next(open_[-1], None)
        if found is None:
            open_.pop()
            continue
        content, begin, stop = found
        if not content and begin is not None:
            continue
        # The same content may stand at several places; a cycle comes back to its own place.
        place = (0, len(content)) if begin is None else (int(begin.min()), int(stop.max()))
        key = (xxhash.xxh3_128_digest(content.encode("utf-8", "surrogatepass")), *place)
        if key not in seen:
            seen.add(key)
            yield content, begin, stop
            open_.append(_inner(content, begin, stop, seen))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans and the number of layers; spans are (start, kind's number, end), sorted."""
    base: list[tuple[int, int, int]] = []
    every: set[tuple[int, int, int]] = set()
    n = 0
    for layer, begin, stop in layers(text):
        found = find(layer)
        if begin is None:
            base = sorted(found)
        every.update((s, k, e) if begin is None else (int(begin[s]), k, int(stop[e - 1])) for s, k, e in found)
        n += 1
    return base, sorted(every), n


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: base counts, a digest of the base spans, all spans, number of layers.

    Positions are code points, ends exclusive.  Null texts are empty and have no spans; null ids stay; repeated rows are
    scanned alike; a secret found in several layers at the same place counts once.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = strings(batch.column(1))
            n = np.zeros((3, len(texts)), np.int64)
            depth = np.ones(len(texts), np.int64)
            digest, spans = [empty] * len(texts), [""] * len(texts)
            hits = np.flatnonzero(pc.match_substring_regex(texts, _ANYTHING).to_numpy(zero_copy_only=False))
            for i in hits.tolist():
                base, every, depth[i] = scan(texts[i].as_py())
                for _, k, _ in base:
                    n[k, i] += 1
                digest[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, n), pa.array(digest), pa.array(spans), pa.array(depth)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
            )

    slim = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
