"""Secret scans by a recursive decoding worklist.

Every text is a first layer. A layer is scanned by the patterns; then its URL escapes, Unicode escapes and base64 runs
(plain, or holding gzip, zlib or zstandard data; each by itself and with the lines that go on with it) are unwrapped into
further layers, which go on the worklist. It is worked depth first: a layer is scanned and unwrapped before the next one is
made, so a task holds one layer of each depth, and of decompressed data one window, however much there is. Digests of layers
already seen stop cycles, so the list runs dry. Each character of a layer knows the stretch of the original text that it
came from, so a match in any layer maps back to a span of the original.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Fixed values of the query: kinds in the order of ties, their patterns, and the least length of group or match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is "[0-9a-f]+ of 32 or more"
LEAST_GROUP, LEAST_ACCESS = 8, 16

#: Decompressed data larger than this is scanned in overlapping windows, which end outside any base64 run that is shorter.
WINDOW_CHARS, OVERLAP_CHARS = 1 << 20, 1 << 14
MARK = "[SECRET]"
#: Characters skipped before a run is decoded, as a path or a name may stand before the payload.
OFFSETS = (0, 1, 2, 3)

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:(?:\\u|%u)[0-9A-Fa-f]{4})+|(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8})+|(?:\\x[0-9A-Fa-f]{2})+|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_WIDE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: No first line of a wrapped run is longer that isn't a run itself: 15 characters, line end and indent.
FIRST_CHARS = 256
#: Further lines of a wrapped run, also where line ends are written as escapes, and a short first line of it.
_LINES = re.compile(r"(?:(?:[ \t]*(?:\r?\n|(?:\\r)?\\n))+[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_RUN, _STANDARD = re.compile(r"[A-Za-z0-9+/_-]*"), str.maketrans("-_", "+/")
_RUN_CHARS = "".join(chr(i) for i in range(128) if re.match(r"[A-Za-z0-9+/_-]", chr(i)))
_LINE_END = re.compile(r"\\[rn]|\s")
_HEX_TABLE = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN_TABLE = bytes(120 if re.match(r"[A-Za-z0-9+/_-]", chr(i)) else 32 for i in range(256))
_ESCAPED = re.compile(rb"%u?[0-9A-Fa-f]{2}|\\[ux]\{?[0-9A-Fa-f]|\\U[0-9A-Fa-f]{8}|&#")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_OUTSIDE = re.compile(r"[^A-Za-z0-9+/_=\s\\-]|[A-Za-z0-9+/_=-][ \t]+(?=[A-Za-z0-9+/_-])")
COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches in one layer. Plain substring tests skip texts that can't match."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low, out = raw.lower(), []
    if any(x in low for x in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_GROUP]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * 32 in raw.translate(_HEX_TABLE):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: What follows a window that ends inside a base64 run, in pieces, from its end on; None for other windows.
More = Callable[[], Iterator[str]] | None


class Layer:
    """A text and the half-open stretch [lo, hi) of the original that each of its characters came from.

    lo and hi are arrays; or two numbers, where all of the layer came from one stretch. ``more`` gives what follows a window
    that ends inside a base64 run.
    """

    __slots__ = ("hi", "lo", "more", "text")

    def __init__(self, text: str, lo: np.ndarray | int, hi: np.ndarray | int, more: More = None):
        self.text, self.lo, self.hi, self.more = text, lo, hi, more

    @classmethod
    def original(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1)

    def stretch(self, start: int, end: int) -> tuple[int, int]:
        """Where text[start:end] came from."""
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[start]), int(self.hi[end - 1])

    def digest(self) -> bytes:
        """Equal for equal texts from the same places."""
        place = f"{self.lo} {self.hi}".encode() if isinstance(self.lo, int) else self.lo.tobytes()
        return hashlib.sha256(place + self.text.encode("utf-8", "surrogatepass")).digest()

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with each match decoded; a decoded character maps to its whole match. None if nothing changes."""
        parts, places, last = [], [], 0
        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is None or new == m[0]:
                continue
            parts += [self.text[last : m.start()], new]
            places.append((last, m.start(), m.end(), len(new)))
            last = m.end()
        if not parts:
            return None
        text = "".join([*parts, self.text[last:]])
        if isinstance(self.lo, int):
            return Layer(text, self.lo, self.hi)
        lo = [x for a, b, _, n in places for x in (self.lo[a:b], np.full(n, self.lo[b]))]
        hi = [x for a, b, c, n in places for x in (self.hi[a:b], np.full(n, self.hi[c - 1]))]
        return Layer(text, np.concatenate([*lo, self.lo[last:]]), np.concatenate([*hi, self.hi[last:]]))

    def inner(self, start: int, end: int, text: str, more: More = None) -> Layer:
        """A layer unwrapped from text[start:end]; all of it maps to that stretch."""
        return Layer(text, *self.stretch(start, end), more)


def _from_url(run: str) -> str | None:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(run: str) -> str | None:
    if run[0] == "&":
        n = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    if run[1] == "U" or run[2] == "{":
        points = [int(m[1] or m[2], 16) for m in _WIDE.finditer(run)]
        return "".join(chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd" for n in points)
    return bytes.fromhex(run.replace("\\u", "").replace("%u", "")).decode("utf-16-be", "replace")


def _to_the_damage(unzip, data: bytes) -> bytes:
    """All that damaged deflate data gives, in the smallest steps."""
    out = bytearray()
    try:
        for at in range(len(data)):
            rest = data[at : at + 1]
            while (piece := unzip.decompress(rest, 1)) or unzip.unconsumed_tail:
                out += piece
                rest = unzip.unconsumed_tail
    except zlib.error:
        pass
    return bytes(out)


class _Stream:
    """Bytes of pieces that are only asked for as they are read."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces = pieces

    def read(self, _: int = -1) -> bytes:
        return next((p for p in self.pieces if p), b"")


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip, zlib or zstandard data at the start gives, up to its end or first damage."""
    first = next(pieces, b"")
    if first[:1] == b"\x28":
        one_by_one = (bytes(p[k : k + 1]) for p in itertools.chain([first], pieces) for k in range(len(p)))
        try:
            yield from zstandard.ZstdDecompressor().read_to_iter(_Stream(one_by_one), read_size=1)  # blocks before the damage come out
        except zstandard.ZstdError:
            pass
        return
    unzip, rest = zlib.decompressobj(47), b""
    parts = (p[k : k + 4096] for p in itertools.chain([first], pieces) for k in range(0, len(p), 4096))
    while not unzip.eof:
        part = rest or next(parts, b"")
        before = unzip.copy()
        try:
            out = unzip.decompress(part, 1 << 16)
        except zlib.error:
            yield _to_the_damage(before, part)
            return
        if not (out or part):
            return
        yield out
        rest = unzip.unconsumed_tail


def _windows(make: Callable[[], Iterator[bytes]]) -> Iterator[tuple[str, More]]:
    """The text of the pieces that ``make`` gives, cut into overlapping windows where it is long.

    A window ends outside any base64 run, or, where a run is longer than a window, inside of it; what follows is then made
    anew if it is asked for, so that no more than a window is held.
    """

    def decoded() -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for piece in make():
            yield decoder.decode(piece)
        yield decoder.decode(b"", True)

    def after(place: int) -> Iterator[str]:
        for piece in decoded():
            if len(piece) > place:
                yield piece[place:]
            place = max(0, place - len(piece))

    held, begin, most = "", 0, WINDOW_CHARS
    for piece in decoded():
        held += piece
        if len(held) >= most:
            cut = next((ends[-1] for k in (1 << 12, len(held)) if (ends := [m.end() for m in _OUTSIDE.finditer(held, max(0, len(held) - k))])), 0)
            inside = cut <= OVERLAP_CHARS
            cut = len(held) if inside else cut
            yield held[:cut], (lambda place=begin + cut: after(place)) if inside else None
            begin += cut - OVERLAP_CHARS
            held = held[cut - OVERLAP_CHARS :]
            most = max(WINDOW_CHARS, 2 * len(held))
    if held:
        yield held, None


def _worth(raw: bytes) -> bool:
    """Whether a layer can hold a match or another layer; most runs are words, whose decoded bytes can't."""
    low = raw.lower()
    return any(x in low for x in (b"passw", b"secret", b"token", b"api", b"akia")) or bool(_ESCAPED.search(raw)) or b"x" * 16 in raw.translate(_RUN_TABLE)


def _run_bytes(chars: str, more: More) -> Iterator[bytes]:
    """The bytes of a base64 run: ``chars``, and what follows a window's end as far as the run goes."""
    whole = len(chars) - len(chars) % 4 if more else len(chars) - (len(chars) % 4 == 1)
    part, rest = chars[:whole], chars[whole:] if more else ""
    yield base64.b64decode(part + "=" * (-len(part) % 4))
    if more:
        for piece in more():
            run = _RUN.match(piece)[0]
            rest += run.translate(_STANDARD)
            if len(run) < len(piece):
                break
            yield base64.b64decode(rest[: len(rest) // 4 * 4])
            rest = rest[len(rest) // 4 * 4 :]
        rest = rest[: len(rest) - (len(rest) % 4 == 1)]
        yield base64.b64decode(rest + "=" * (-len(rest) % 4))


def _from_base64(run: str, more: More = None) -> Iterator[tuple[str, More]]:
    """The text of a base64 run, and what compressed data anywhere in it gives; a prefix of it may be no base64.

    ``more`` follows a run that a window cuts: compressed data that begins in the window is read on beyond its end.
    """
    body = run.rstrip("=").translate(_STANDARD)
    for skip in OFFSETS:
        data = next(_run_bytes(body[skip:], more))
        if _worth(data):
            yield data.decode("utf-8", "replace"), None
        for m in _PACKED.finditer(data):

            def packed(skip=skip, data=data, at=m.start()) -> Iterator[bytes]:
                yield memoryview(data)[at:]
                if more:
                    following = _run_bytes(body[skip:], more)
                    next(following)
                    yield from following

            for text, further in _windows(lambda packed=packed: _inflated(packed())):
                if _worth(text.encode("utf-8", "surrogatepass")):
                    yield text, further


def _first_line(text: str, end: int) -> int | None:
    """Where the short first line of a wrapped run begins, whose next line begins at ``end``; None if there is no such line."""
    low = max(0, end - FIRST_CHARS)
    before = text[low:end].rstrip(" \t")
    if before.endswith("\n"):
        line = before[:-1].removesuffix("\r")
    elif before.endswith("\\n"):
        line = before[:-2].removesuffix("\\r")
    else:
        return None
    line = line.rstrip(" \t")
    rest = line.rstrip(_RUN_CHARS)
    return low + len(rest) if len(rest) < len(line) else None


class Covered:
    """Stretches of one kind, of which those inside others are left out, so starts and ends both ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def has(self, lo: int, hi: int) -> bool:
        """Whether lo..hi lies inside one of the stretches."""
        k = bisect_right(self.starts, lo)
        return k > 0 and self.ends[k - 1] >= hi

    def add(self, lo: int, hi: int) -> None:
        if not self.has(lo, hi):
            k = bisect_left(self.starts, lo)
            n = bisect_right(self.ends, hi, k)
            self.starts[k:n], self.ends[k:n] = [lo], [hi]


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    text = layer.text
    if "%" in text and (new := layer.replaced(_URL, _from_url)):
        yield new
    if ("\\" in text or "&#" in text or "%u" in text) and (new := layer.replaced(_UNICODE, _from_unicode)):
        yield new
    joined = 0
    for m in _BASE64.finditer(text):
        for inner, more in _from_base64(m[0], layer.more if m.end() == len(text) else None):
            yield layer.inner(m.start(), m.end(), inner, more)
        if m.end() > joined:
            before, after = _first_line(text, m.start()), _LINES.match(text, m.end())
            start, joined = m.start() if before is None else before, after.end() if after else m.end()
            if before is not None or after:
                for inner, more in _from_base64(_LINE_END.sub("", text[start:joined])):
                    yield layer.inner(start, joined, inner, more)


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the base patterns in the text itself, and all spans with those of inner layers."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    base = scan(text, raw)
    if not (_ESCAPED.search(raw) or b"x" * 16 in raw.translate(_RUN_TABLE)):
        return base, base
    spans, seen, work = set(base), {hashlib.sha256(raw).digest()}, [unwrap(Layer.original(text))]
    covered = [Covered() for _ in KINDS]
    for s, kind, e in base:
        covered[kind].add(s, e)
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif new.text and (mark := new.digest()) not in seen:
            seen.add(mark)
            for s, kind, e in scan(new.text):
                lo, hi = new.stretch(s, e)
                if not covered[kind].has(lo, hi):
                    spans.add((lo, kind, hi))
                    covered[kind].add(lo, hi)
            work.append(unwrap(new))
    return base, sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans (code points, end exclusive) of secrets in each row's whole text.

    Null and empty texts have none (the digest is that of the empty string), a null id is kept. Repeated rows are scanned
    each by itself. Matches of the same start are told apart by kind. A text of any length is scanned whole. An empty table
    gives an empty result. Only the two named columns are read, so others cannot clash. No shuffle.
    """

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, text in zip(ids, texts):
            base, spans = find_secrets(text)
            count = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            yield i, *count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)

    return map_slices(docs.select(id_col, text_col), run, COLUMNS)


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by a mark; overlapping spans share one."""
    spans = find_secrets(text)[1]
    if not spans:
        return text
    parts, last = [], 0
    for start, _, end in spans:
        if start >= last:
            parts += [text[last:start], MARK]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets in ``text_col`` marked out; ``chars_col``, if there, is counted anew.

    Null and empty texts stay as they are, repeated rows are each treated alike, texts of any length are read whole. Other
    columns may have any name and pass through. An empty table gives an empty result.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                k = part.schema.get_field_index(text_col)
                yield part.set_column(k, part.schema.field(k), pa.array([redact(t) for t in part.column(k).to_pylist()], type=part.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return out
