"""Media columns: signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass. A validator for each format then confirms
structure and lengths from the found place on. A confirmed format at the start corrects the declared type; confirmed formats
further in are carved as embedded media, with their bytes. Validators take the data, a place and a memo: what one of them finds out
about the whole data it keeps there, so that many marks don't cost a search each.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, slices, written

UNKNOWN = "application/octet-stream"


def riff(data: bytes, at: int, memo: dict) -> int:
    """Length of a WAVE file at this place, 0 if it isn't one: RIFF size, fmt and data chunks must fit."""
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 44:
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    return end - at if end <= len(data) and wave_chunks(data, at, end) else 0


def wave_data(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(sample rate, first byte, number of bytes) of 8-bit mono samples; None for other samples, or if chunks don't fit."""
    found = wave_chunks(data, at, end)
    return found[1:] if found and found[0] == (1, 1, 8) else None


def wave_chunks(data: bytes, at: int, end: int) -> tuple[tuple[int, int, int], int, int, int] | None:
    """((format, channels, bits), sample rate, first byte, number of bytes) of samples of any kind; None if chunks don't fit."""
    place, rate, kept = at + 12, 0, (0, 0, 0)
    while place + 8 <= end:
        kind, size = data[place : place + 4], struct.unpack_from("<I", data, place + 4)[0]
        if place + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, place + 8)
            if not channels:
                return None
            kept = form, channels, bits
        if kind == b"data":
            return (kept, rate, place + 8, size) if rate else None
        place += 8 + size + size % 2
    return None


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo CRC-32's, highest powers last."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(4096)
def _power(n: int) -> int:
    """x to the power of 8 * n, modulo CRC-32's polynomial."""
    out, base = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def crc_between(data: bytes, a: int, b: int, memo: dict) -> int:
    """The CRC-32 of data[a:b]; of a long part from checksums of what is before a and b, which are kept every STEP bytes."""
    view = memoryview(data)
    if b - a <= 2 * STEP:
        return zlib.crc32(view[a:b])
    if "crc" not in memo:
        memo["crc"] = [0]
        for k in range(0, len(data) - STEP, STEP):
            memo["crc"].append(zlib.crc32(view[k : k + STEP], memo["crc"][-1]))
    upto = lambda x: zlib.crc32(view[x // STEP * STEP : x], memo["crc"][x // STEP]) if x // STEP < len(memo["crc"]) else zlib.crc32(view[(len(memo["crc"]) - 1) * STEP : x], memo["crc"][-1])
    return upto(b) ^ _times(_power(b - a), upto(a))


STEP = 1 << 12


def png(data: bytes, at: int, memo: dict) -> int:
    """Chunks in order, IHDR first, each with its checksum, up to IEND. Where chunks from a place on lead is found out once."""
    place, end = at + 8, -1
    if data[place + 4 : place + 8] != b"IHDR":
        return 0
    ends, seen = memo.setdefault("png", {}), []
    while place + 12 <= len(data):
        if place in ends:
            end = ends[place]
            break
        seen.append(place)
        size, kind = struct.unpack_from(">I4s", data, place)
        behind = place + 12 + size
        if behind > len(data) or crc_between(data, place + 4, behind - 4, memo) != struct.unpack_from(">I", data, behind - 4)[0]:
            break
        if kind == b"IEND":
            end = behind
            break
        place = behind
    ends.update(dict.fromkeys(seen, end))
    return end - at if end > 0 else 0


def gif(data: bytes, at: int, memo: dict) -> int:
    """Screen descriptor, then extension and image blocks, up to the trailer. Where blocks from a place on lead is found out once: a file's
    end or -1, and for the parts of a block the block's end."""
    if len(data) < at + 13:
        return 0
    flags = data[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    if "gif" not in memo:
        memo["gif"] = array("i", bytes(4 * len(data))), array("i", bytes(4 * len(data)))
    ends, after = memo["gif"]

    def blocks(p: int) -> int:
        seen = []
        while p < len(data) and data[p] and not after[p]:
            seen.append(p)
            p += 1 + data[p]
        end = after[p] if p < len(data) and data[p] else p + 1
        for q in seen:
            after[q] = end
        return end

    seen, end = [], -1
    while place < len(data):
        if ends[place]:
            end = ends[place]
            break
        seen.append(place)
        kind = data[place]
        if kind == 0x3B:
            end = place + 1
            break
        if kind == 0x21:
            place = blocks(place + 2)
        elif kind == 0x2C and place + 10 < len(data):
            own = data[place + 9]
            place = blocks(place + 11 + (3 << (own & 7) + 1 if own & 128 else 0))
        else:
            break
    for p in seen:
        ends[p] = end
    return end - at if end > 0 else 0


def bmp(data: bytes, at: int, memo: dict) -> int:
    """File size, pixel offset and header size must agree."""
    if len(data) < at + 26:
        return 0
    size, _, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    return size if 26 <= pixels <= size <= len(data) - at and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels else 0


def gzip_member(data: bytes, at: int, memo: dict) -> int:
    """A whole member: header, deflate stream, checksum and length."""
    flags, place = data[at + 3] if at + 10 <= len(data) else 0xFF, at + 10
    if flags & 0xE0:
        return 0
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    if flags & 24 and "zeros" not in memo:
        memo["zeros"] = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
    for kind in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & kind:
            k = np.searchsorted(memo["zeros"], place)
            if k == len(memo["zeros"]):
                return 0
            place = int(memo["zeros"][k]) + 1
    start = place = place + (2 if flags & 2 else 0)
    reader, view, crc, size = zlib.decompressobj(-15), memoryview(data), 0, 0
    try:
        while not reader.eof and place < len(data):
            out = reader.decompress(view[place : place + (1 << 14)])
            place += 1 << 14
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return 0
    end = min(place, len(data)) - len(reader.unused_data)
    if not reader.eof or data[end : end + 8] != struct.pack("<II", crc, size & 0xFFFFFFFF):
        return 0
    if flags & 2 and data[start - 2 : start] != struct.pack("<H", zlib.crc32(view[at : start - 2]) & 0xFFFF):
        return 0
    return end + 8 - at


_PDF_MARK = re.compile(rb"%PDF-\d|startxref\s+(\d+)\s*%%EOF|startxref|%%EOF|(?<![A-Za-z])xref\b|\b\d+\s+\d+\s+obj\b")


def pdf_ends(data: bytes) -> dict[int, int]:
    """Where each PDF that begins somewhere ends. Its own end mark is the last one before the next PDF's header with a pointer to
    cross-references before it. A PDF may hold others: an end mark further on is of the PDF from whose start its pointer leads to the
    last cross-reference table, or the last object, before it."""
    heads: set[int] = set()
    ends: dict[int, int] = {}
    head, pointer, table, stream = -1, False, -1, -1
    for m in _PDF_MARK.finditer(data):
        found = m[0]
        if found.startswith(b"%PDF-"):
            head, pointer = m.start(), False
            heads.add(head)
        elif found == b"xref":
            table = m.start()
        elif found.endswith(b"obj"):
            stream = m.start()
        else:
            pointer |= found.startswith(b"startxref")
            if found.endswith(b"%%EOF"):
                if pointer and head >= 0:
                    ends[head] = m.end()
                if m[1] and len(m[1]) < 20:
                    for x in (table, stream):
                        if x - int(m[1]) in heads:
                            ends[x - int(m[1])] = m.end()
    return ends


def pdf(data: bytes, at: int, memo: dict) -> int:
    """See pdf_ends, which is called once for all places."""
    if "pdf" not in memo:
        memo["pdf"] = pdf_ends(data)
    return memo["pdf"].get(at, at) - at


#: Magic bytes, type and validator of each format. Fixed values of the formats.
FORMATS = [
    (b"RIFF", "audio/wav", riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gzip_member),
    (b"%PDF-", "application/pdf", pdf),
]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind, check in FORMATS:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    found.make_automaton()
    return found


def sniff(data: bytes, machine: ahocorasick.Automaton) -> tuple[str, int, list[tuple[str, int, int]]]:
    """The type at the start with its length, and (type, place, length) of media further in, those inside carved ones left out."""
    kind, size, inside, free, memo = UNKNOWN, len(data), [], 1, {}
    for end, (n, name, check) in machine.iter(data.decode("latin-1")):
        at = end - n + 1
        if at and at < free:
            continue
        if length := check(data, at, memo):
            if at:
                inside.append((name, at, length))
                free = at + length
            else:
                kind, size = name, length
    return kind, size, inside


_SNIFF = "{0} {1}, declared_type string, media_type string, corrected boolean, media_length bigint, embedded array<struct<type:string,offset:bigint,length:bigint,sha256:string>>"
_INSIDE = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))


def sniffed(media: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """One row a row of media: id, declared_type, media_type, corrected (they differ), media_length, embedded (type, place, length and
    the SHA-256 of the carved bytes).

    A null blob counts as empty and is of unknown type, application/octet-stream; a null declared type is corrected by any.
    Blobs of any length are searched whole. Repeated rows give repeated rows; other columns are not carried, whatever their names. An
    empty table gives an empty one.
    """
    kind = media.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in slices(batch, 1, 1 << 24):
                blobs = [x or b"" for x in part.column(1).to_pylist()]
                found = [sniff(x, machine) for x in blobs]
                types = [f[0] for f in found]
                told = part.column(2).to_pylist()
                inside = [[{"type": t, "offset": o, "length": n, "sha256": hashlib.sha256(memoryview(x)[o : o + n]).hexdigest()} for t, o, n in f[2]] for x, f in zip(blobs, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(types, pa.string()), pa.array([a != b for a, b in zip(told, types)], pa.bool_()), pa.array([f[1] for f in found], pa.int64()), pa.array(inside, _INSIDE)], [id_col, "declared_type", "media_type", "corrected", "media_length", "embedded"])

    return arrow_map(media.select(id_col, blob_col, declared_col), run, _SNIFF.format(f"`{id_col}`", kind))


def carved(media: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """One row a medium that is embedded in a blob: id, media_type, offset, media (its bytes). Blobs without any, null ones too, give none."""
    kind = media.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in slices(batch, 1, 1 << 24):
                for i, x in enumerate(part.column(1).to_pylist()):
                    if found := sniff(x, machine)[2] if x else []:
                        rows = [part.column(0).take(pa.array([i] * len(found))), *(pa.array(c) for c in zip(*((t, o, x[o : o + n]) for t, o, n in found)))]
                        yield pa.RecordBatch.from_arrays(rows, [id_col, "media_type", "offset", "media"])

    return arrow_map(media.select(id_col, blob_col), run, f"`{id_col}` {kind}, media_type string, offset bigint, media binary")


RATE, UNIT = 8000, 64
_MEDIA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("declared_type", pa.string()), ("media", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("corrected", pa.bool_())])


def wave(payload: bytes) -> bytes:
    """8-bit mono samples as a WAVE file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def declared(n: int) -> str | None:
    """What is told of a text of n bytes: the right type, a wrong one, or none at all in turn."""
    return ("audio/wav", "image/png", UNKNOWN, None)[n % 4]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as WAVE files: (id, n_bytes, declared_type, media). The UTF-8 bytes, zeros appended up to a positive multiple of 64,
    are the samples. The declared type is right for some lengths only, for sniffing to correct. A null text is empty, a null id stays
    null; repeated rows give repeated rows, an empty table an empty one. A text of any length is one file; WAVE has room for 4 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield record_batch(_MEDIA, part.column(0).cast(pa.int64()), [len(x) for x in raw], [declared(len(x)) for x in raw], [wave(x.ljust(max(1, -(-len(x) // UNIT)) * UNIT, b"\0")) for x in raw])

    return arrow_map(docs.select(F.col(id_col).cast("bigint").alias("id"), text_col), run, "id bigint, n_bytes bigint, declared_type string, media binary")


def text_media_digests(docs: DataFrame) -> DataFrame:
    """Write texts as media to the shared folder, read them back, sniff them, and take digests of what was read.

    feature: the declared and the sniffed type, the sample rate, mean and energy of the samples, and the embedded media found with
    the digests of their bytes. It is a function of the text alone. Nulls, empty and repeated rows: see text_media.
    """
    stored = written(text_media(docs), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in slices(batch, 3, 1 << 24):
                rows = []
                for key, n, told, media in zip(*(c.to_pylist() for c in part.columns)):
                    kind, length, inside = sniff(media, machine)
                    found = wave_data(media, 0, length) if kind == "audio/wav" else None
                    if found is None or length != len(media):
                        raise ValueError(f"the media of document {key} was not read back as it was stored")
                    rate, at, size = found
                    payload = media[at : at + size]
                    samples = np.frombuffer(payload, np.uint8).astype(np.float64)
                    feature = f"{told or '-'}>{kind} rate={rate} mean={samples.mean():.3f} energy={(samples * samples).mean():.3f} embedded={','.join(f'{t}@{o}+{m}:{hashlib.sha256(media[o : o + m]).hexdigest()}' for t, o, m in inside) or '-'}"
                    rows.append((key, n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind != told))
                yield record_batch(_DIGEST, *zip(*rows))

    return arrow_map(stored, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, corrected boolean")
