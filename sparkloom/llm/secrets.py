"""Secret scan: base patterns over the whole text, then a worklist that unwraps nested encodings and scans each layer.

A layer is a text with a way back to its parent. Unwrapping a layer gives children: the text with its URL escapes
decoded (pluses as blanks, too, as in forms), the text with its Unicode and octal escapes decoded, the text with its HTML character references decoded, and for each base64
run (or run of escaped bytes) the text in it (UTF-8 or UTF-16), inflated first where its bytes begin like gzip, zlib, zstd, bzip2 or
xz data, or are one whole deflate stream. A run may be cut into lines by line ends, blanks or escaped line ends; short lines must be of equal length.
A base64 run may have letters, a path or a name before it: compressed data is looked for behind every mark, and
printable stretches at all four alignments. A worklist goes on until no layer gives
a new text; a text seen before in the document is not taken again, which ends cycles. What is found in a layer is
mapped back through the parents to code points of the document.

Defined results: null counts as an empty text; spans are ordered by start, kind, end and are distinct; base spans are
those of the document itself and always stay. Repeated rows each get a row; an empty table gives none; a column of the input that
has the name of the new one is replaced. Inflated data is read in windows of about WINDOW code points that overlap by
OVERLAP; a run that crosses the border is carried whole into the next window. Layers that wait hold about WINDOW code
points, and of texts seen only digests are kept, so memory stays bounded; the work isn't, it grows with what a document
decodes to. Only a run of over LONGEST_RUN code points in inflated data is read in parts: the document has complete = false,
and redaction covers the whole stretch that the run comes from.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, fresh

KINDS = ("assign", "access", "hex")
WINDOW, OVERLAP, LONGEST_RUN = 4_000_000, 4_096, 64_000_000
UNREAD = "unread"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # maximal runs, so the same matches as of AKIA[A-Z0-9]+ with 16+ characters
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # likewise
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: The same as in forms, where a plus stands for a blank; a run has an escape.
_FORM = re.compile(r"\+*(?:%[0-9A-Fa-f]{2}\+*)+|(?<=[A-Za-z0-9.])\++(?=[A-Za-z0-9%])")
_UNICODE = re.compile(r"(?:[\\%]u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2})+")
_ONE = re.compile(r"[\\%](?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))|\\([0-7]{3})")
_HTML = re.compile(r"(?:&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}(?:\r?\n[A-Za-z0-9+/]+)+|[A-Za-z0-9+/_-]{16,})={0,2}")
#: Base64 in short lines of equal length (4, 8 or 12 characters), cut by line ends or blanks; or in lines cut by escaped line ends.
_CUT = r"(?<![A-Za-z0-9+/_-])(?:{})[A-Za-z0-9+/]{{1,76}}={{0,2}}"
_SHORT = re.compile(_CUT.format("|".join(rf"(?:[A-Za-z0-9+/]{{{n}}}{end}){{{least},}}" for n, least in ((4, 6), (8, 3), (12, 2)) for end in (r"\r?\n", "\\x20"))))
_LITERAL = re.compile(_CUT.format(r"(?:[A-Za-z0-9+/]{4,}(?:\\r)?\\n){1,}|(?:[A-Za-z0-9+/]{16,}\x20){1,}"))
_MARKS = re.compile(r"(?:\\r)?\\n|[\r\n\x20]")
#: Bytes that a stretch of printable ones has at least.
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00")
#: What a border of windows must not cut; of assignments also the beginnings.
_RUNS = (_BASE64, _URL, _UNICODE, _HTML, _ACCESS, _HEX, re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*(?:[:=]\x20*["']?)?[A-Za-z0-9+/_.=-]*""", re.I | re.A))


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base spans of one text: leftmost non-overlapping matches of each kind, failing ones dropped."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Layer:
    """pieces: (start in this text, start in the parent, end in the parent); a piece of equal length maps point by point, any other as a whole."""

    def __init__(self, text: str, parent: Layer | None = None, pieces: list[tuple[int, int, int]] | None = None, how: str = ""):
        self.text, self.parent, self.pieces = text, parent, pieces or []
        self.how = f"{parent.how}/{how}" if parent else ""

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the document that start:end comes from."""
        layer = self
        while layer.parent is not None:
            ends = []
            for at, right in ((start, False), (end - 1, True)):
                lo, hi = 0, len(layer.pieces)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if layer.pieces[mid][0] <= at else (lo, mid)
                own, a, b = layer.pieces[lo]
                size = (layer.pieces[lo + 1][0] if lo + 1 < len(layer.pieces) else len(layer.text)) - own
                ends.append(a + at - own + right if size == b - a else b if right else a)
            (start, end), layer = ends, layer.parent
        return start, end


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of compressed data, piece by piece; nothing if the data isn't compressed or broken from the start."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        one = zlib.decompressobj(47)
        step = lambda x: one.decompress(x, WINDOW)
        rest = lambda: one.unconsumed_tail
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        reader = zstandard.ZstdDecompressor().stream_reader(data)
        while piece := reader.read(WINDOW):
            yield piece
        return
    elif data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00":
        many = bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
        while not many.eof and (piece := many.decompress(data, WINDOW)):
            yield piece
            data = b""
        return
    else:
        return
    while data:
        if piece := step(data):
            yield piece
        data = rest()


def _border(text: str) -> int:
    """The last place, OVERLAP before the end or earlier, that lies in no run; 0 if there is none."""
    spans = sorted((m.span() for p in _RUNS for m in p.finditer(text)), reverse=True)
    cut = len(text) - OVERLAP
    while inside := [a for a, b in spans if a < cut < b]:
        cut = min(inside)
    return cut


def _texts(data: bytes) -> Iterator[tuple[str, str]]:
    """(how, text) of what bytes hold: inflated windows, or plain printable UTF-8. UNREAD tells that a run had to be cut."""
    parts, size, least, any_piece = [], 0, WINDOW, False
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    try:
        for piece in _inflated(data):
            any_piece = True
            parts.append(decoder.decode(piece))
            size += len(parts[-1])
            if size > least:
                held = "".join(parts)
                if not (cut := _border(held)):
                    if size <= LONGEST_RUN:
                        parts, least = [held], 2 * size
                        continue
                    yield UNREAD, ""
                    cut = size - OVERLAP
                yield "inflate", held[: cut + OVERLAP]
                parts, size = [held[cut:]], size - cut
                least = max(WINDOW, 2 * size if size > OVERLAP else 0)
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError):
        pass
    if any_piece:
        yield "inflate", "".join([*parts, decoder.decode(b"", True)])
        return
    for code in ("utf-8", *(("utf-16-le", "utf-16-be") if b"\0" in data[:8] and len(data) % 2 == 0 else ())):
        try:
            text = data.decode(code).removeprefix("\ufeff")
        except UnicodeDecodeError:
            continue
        if text and all(c.isprintable() or c in "\t\n\r\x0b\x0c" for c in text):
            yield "bytes" if code == "utf-8" else "utf-16", text
            return
    if text := _deflated(data):
        yield "inflate", text


def _deflated(data: bytes) -> str:
    """The text in a whole deflate stream without a header, if it is printable: any bytes could be one, so that all must fit. Beyond WINDOW it isn't taken for one."""
    stream = zlib.decompressobj(-15)
    try:
        text = stream.decompress(data, WINDOW).decode("utf-8") if len(data) >= 10 else ""
    except (zlib.error, UnicodeDecodeError):
        return ""
    return text if stream.eof and len(text) >= 12 and all(c.isprintable() or c in "\t\n\r" for c in text) else ""


def _escaped(layer: Layer, how: str, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """One child with every run of escapes decoded, and a child for each run whose bytes are compressed."""
    out, pieces, size, last, changed = [], [], 0, 0, False
    for m in pattern.finditer(layer.text):
        text, data = decode(m[0])
        if data is not None and text is None:
            for kind, inner in _texts(data):
                yield Layer(inner, layer, [(0, m.start(), m.end())], UNREAD if kind == UNREAD else f"{how}/{kind}")
        if text is None:
            continue
        changed = True
        for part, a, b in ((layer.text[last : m.start()], last, m.start()), (text, m.start(), m.end())):
            if part:
                pieces.append((size, a, b))
                out.append(part)
                size += len(part)
        last = m.end()
    if changed:
        if last < len(layer.text):
            pieces.append((size, last, len(layer.text)))
            out.append(layer.text[last:])
        yield Layer("".join(out), layer, pieces, how)


def _from_url(run: str) -> tuple[str | None, bytes]:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return data.decode("utf-8"), data
    except UnicodeDecodeError:
        return None, data


def _from_unicode(run: str) -> tuple[str | None, bytes | None]:
    points = [int(o, 8) if o else int(a or b, 16) for a, b, o in _ONE.findall(run)]
    if any(p > 0x10FFFF for p in points):
        return None, None
    data = bytes(points) if max(points) < 256 else None
    if data and next(_inflated_once(data), None):
        return None, data
    try:
        return "".join(map(chr, points)).encode("utf-16", "surrogatepass").decode("utf-16"), data
    except UnicodeDecodeError:
        return None, None


def _inflated_once(data: bytes) -> Iterator[bytes]:
    try:
        yield from _inflated(data)
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The children of a layer."""
    text = layer.text
    if "%" in text:
        yield from _escaped(layer, "url", _URL, _from_url)
        if "+" in text and _URL.search(text):
            yield from _escaped(layer, "form", _FORM, _from_form)
    if "\\" in text or "%u" in text:
        yield from _escaped(layer, "unicode", _UNICODE, _from_unicode)
    if "&" in text:
        yield from _escaped(layer, "html", _HTML, _from_html)
    for m in _BASE64.finditer(text):
        yield from _from_base64(layer, m)
    for m in _SHORT.finditer(text):
        yield from _from_lines(layer, m)
    if "\\n" in text or " " in text:
        for m in _LITERAL.finditer(text):
            yield from _from_lines(layer, m)


def _from_lines(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """The children from base64 in lines: each comes from all of them. There are two whole lines of one length at least, and only the last may be shorter."""
    sizes = [len(x) for x in _MARKS.split(m[0])]
    if len(sizes) < 2 or len({*sizes[:-1]}) > 1 or sizes[-1] > sizes[0] or len(sizes) == 2 and sizes[1] < sizes[0]:
        return
    data = _bytes_of(_MARKS.sub("", m[0]).rstrip("="))
    for how, inner in _texts(data):
        yield Layer(inner, layer, [(0, *m.span())], UNREAD if how == UNREAD else f"base64/{how}" if how != "bytes" else "base64")
    for s in _PRINTABLE.finditer(data):
        if len(s[0]) < len(data):
            yield Layer(s[0].decode("ascii"), layer, [(0, *m.span())], "base64")


def _from_form(run: str) -> tuple[str | None, bytes | None]:
    return _from_url("".join(f"%{ord(c):02x}" for c in run.replace("+", " "))) if "%" not in run else _from_url(run.replace("+", "%20"))


def _from_html(run: str) -> tuple[str | None, None]:
    out = html.unescape(run)
    return (out, None) if out != run else (None, None)


def _bytes_of(body: str) -> bytes:
    """What base64 characters hold; a single one at the end holds nothing."""
    size = len(body) - (len(body) % 4 == 1)
    return base64.b64decode(body[:size] + "=" * (-size % 4))


def _from_base64(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """The children from one run: its whole text or compressed data, what is compressed behind a mark, and printable stretches at each alignment."""
    marked = re.sub(r"[\r\n]", "", m[0].rstrip("="))
    body, one_line = marked.replace("-", "+").replace("_", "/"), "\n" not in m[0]

    def pieces(at: int, first: int, size: int) -> list[tuple[int, int, int]]:
        # each group of 4 characters from at on holds 3 bytes
        if not one_line:
            return [(0, *m.span())]
        starts = [0, *range(3 - first % 3, size, 3)]
        return [(k, a := m.start() + at + (first + k) // 3 * 4, min(m.end(), a + 4)) for k in starts if k < size]

    for at in [0, *(x.end() for x in re.finditer(r"[-_/+]", marked))]:
        if at and not _bytes_of(body[at : at + 8]).startswith(_MAGIC):
            continue
        data = _bytes_of(body[at:])
        for how, inner in _texts(data):
            own = pieces(at, 0, len(inner)) if how == "bytes" and len(inner) == len(data) else [(0, *m.span())]
            yield Layer(inner, layer, own, {"bytes": "base64", UNREAD: UNREAD}.get(how, f"base64/{how}"))
    for at in range(4):
        data = _bytes_of(body[at:])
        for s in _PRINTABLE.finditer(data):
            if at or len(s[0]) < len(data):
                yield Layer(s[0].decode("ascii"), layer, pieces(at, s.start(), len(s[0])), "base64")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _found(text: str) -> tuple[list[dict], list[dict]]:
    """All spans of a document, base ones with an empty layer, and the stretches that hold a run which had to be cut."""
    found, unread = {s: "" for s in scan(text)}, set()
    # Children wait until their layer is through; once they hold much, the layer is suspended until they are through.
    seen, running, waiting, held = {_digest(text)}, [unwrapped(Layer(text))], [], 0
    while running:
        child = next(running[-1], None)
        if child is None:
            if waiting:
                layer = waiting.pop()
                held -= len(layer.text)
                running[-1] = unwrapped(layer)
            else:
                running.pop()
            continue
        if child.how.endswith(UNREAD):
            unread.add(child.origin(0, 1))
            continue
        if (digest := _digest(child.text)) in seen:
            continue
        seen.add(digest)
        for kind, a, b in scan(child.text):
            found.setdefault((kind, *child.origin(a, b)), child.how)
        waiting.append(child)
        held += len(child.text)
        if held > WINDOW // 2:
            running.append(iter(()))
    ordered = sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [{"kind": k, "start": a, "end": b, "layer": how} for (k, a, b), how in ordered], [{"kind": UNREAD, "start": a, "end": b} for a, b in sorted(unread)]


def spans_of(text: str) -> tuple[list[dict], bool]:
    """All spans of a document, base ones with an empty layer, and whether every run was read whole."""
    spans, unread = _found(text)
    return spans, not unread


SPANS = pa.struct([("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())]))), ("complete", pa.bool_())])
SPANS_SQL = "struct<spans:array<struct<kind:string,start:int,end:int,layer:string>>,complete:boolean>"


def _secret_spans(texts: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("spans", "complete"), spans_of(t or ""), strict=True)) for t in texts.to_pylist()], type=SPANS)


def with_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a column out: {spans: [{kind, start, end, layer}], complete}. Code points, end exclusive."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(_secret_spans, SPANS_SQL)(F.col(text)))


def _covered(text: str, spans: list[dict]) -> str:
    out, last = [], 0
    for s in spans:
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])


def _redacted(text: str) -> str:
    spans, unread = _found(text)
    return _covered(text, sorted([*unread, *spans], key=lambda s: s["start"]))


def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _redacted(t) for t in texts.to_pylist()], type=pa.string())


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each stretch of secret spans replaced by its kind in brackets; a null text stays null. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, F.arrow_udf(_redact, "string")(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, spans: str, kinds: tuple[str, ...], others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256, spans and others. Base spans have an empty layer."""
    base = F.filter(F.col(spans), lambda s: s["layer"] == "")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"), *others)


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest of every document's secrets, and complete: whether every run was read whole."""
    own = docs.select("doc_id", "text")
    name = fresh(own, "secrets")
    found = with_secrets(own, out=name).select("doc_id", F.col(name)["spans"].alias("found"), F.col(name)["complete"].alias("complete"))
    return digest(found, "found", KINDS, ("complete",))
