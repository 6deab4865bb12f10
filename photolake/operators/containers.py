"""Image containers as rows of segments: reading tags, and dropping metadata without touching pixels.

One walker per container yields (kind, start, end, keep); stripping joins what is kept, and the
segment table explodes the same walk. A walk that does not add up gives None and never raises.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: JPEG markers of metadata, and PNG chunks that belong to the picture.
JPEG_METADATA = {0xE1, *range(0xE3, 0xEE), 0xEF, 0xFE}
PNG_PICTURE = {b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"sBIT", b"bKGD", b"pHYs", b"acTL", b"fcTL", b"fdAT"}
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Segment:
    kind: str
    start: int
    end: int
    keep: bool


def walk_jpeg(data: bytes) -> list[Segment] | None:
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        return None
    out, at = [Segment("SOI", 0, 2, True)], 2
    while at + 1 < len(data):
        code = _after_padding(data, at)
        if data[at] != 0xFF or code >= len(data):
            return None
        marker = data[code]
        if marker in (0xDA, 0xD9):
            return [*out, Segment("SCAN" if marker == 0xDA else "EOI", at, len(data), True)]
        if code + 2 >= len(data):
            return None
        size = int.from_bytes(data[code + 1 : code + 3], "big")
        end = code + 1 + size
        if size < 2 or end > len(data):
            return None
        out.append(Segment(f"{marker:02X}", at, end, marker not in JPEG_METADATA))
        at = end
    return out


def _after_padding(data: bytes, at: int) -> int:
    while at < len(data) and data[at] == 0xFF:
        at += 1
    return at


def walk_png(data: bytes) -> list[Segment] | None:
    if data[:8] != PNG_SIGNATURE:
        return None
    out, at = [Segment("signature", 0, 8, True)], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data):
            return None
        out.append(Segment(kind.decode("latin-1"), at, end, kind in PNG_PICTURE))
        at = end
        if kind == b"IEND":
            break
    return out


def walk_webp(data: bytes) -> list[Segment] | None:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return None
    out, at = [Segment("RIFF", 0, 12, True)], 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        end = at + 8 + size + size % 2
        if end > len(data):
            return None
        out.append(Segment(kind.decode("latin-1"), at, end, kind not in (b"EXIF", b"XMP ")))
        at = end
    return out


WALKERS: dict[str, Callable[[bytes], list[Segment] | None]] = {"image/jpeg": walk_jpeg, "image/png": walk_png, "image/webp": walk_webp}


def strip(data: bytes) -> tuple[str, bytes] | None:
    """(MIME type, bytes without metadata) by the bytes' own container, or None."""
    for mime, walker in WALKERS.items():
        if (segments := walker(data)) is not None:
            break
    else:
        return None
    kept = b"".join(data[s.start : s.end] for s in segments if s.keep)
    if mime == "image/webp":
        if all(s.keep for s in segments):
            return mime, data
        kept = _mend_webp(kept)
    return mime, kept


def _mend_webp(data: bytes) -> bytes:
    """The RIFF size, and the flags that told of the dropped chunks."""
    out = bytearray(data)
    out[4:8] = struct.pack("<I", len(out) - 8)
    for s in walk_webp(bytes(out)) or []:
        if s.kind == "VP8X":
            out[s.start + 8] &= 0xFF ^ 0x0C
    return bytes(out)


def webp_chunk(data: bytes, kind: str) -> bytes | None:
    """A chunk's payload, without the prefix that some writers put before the TIFF block."""
    for s in walk_webp(data) or []:
        if s.kind == kind:
            body = data[s.start + 8 : s.start + 8 + int.from_bytes(data[s.start + 4 : s.start + 8], "little")]
            return body[6:] if body[:4] == b"Exif" else body
    return None


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF block that holds a file's EXIF tags."""
    for s in walk_jpeg(data) or []:
        at = data.find(b"Exif\0\0", s.start, s.start + 24)
        if s.kind == "E1" and at >= 0:
            return data[at + 6 : s.end]
    for s in walk_png(data) or []:
        if s.kind == "eXIf":
            return data[s.start + 8 : s.end - 4]
    return webp_chunk(data, "EXIF")


#: EXIF tag numbers.
_IFD = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist", 0x013C: "HostComputer", 0x8298: "Copyright"}
_EXIF = {0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x8827: "ISO", 0x9286: "UserComment", 0xA430: "OwnerName", 0xA431: "BodySerialNumber", 0xA434: "LensModel", 0xA435: "LensSerialNumber"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _entries(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, object]]:
    for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * n
        if not size or size > len(tiff):
            continue
        here = at + 10 + 12 * k
        if size > 4:
            here = struct.unpack_from(f"{order}I", tiff, here)[0]
        if here + size > len(tiff):
            continue
        if kind in (2, 7):
            yield tag, tiff[here : here + size].split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            pairs = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", tiff, here)
            yield tag, [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            values = struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind] }", tiff, here)
            yield tag, values[0] if n == 1 else list(values)


def read_exif(data: bytes) -> dict[str, object]:
    """Tags by name; malformed blocks give what could be read of them, mostly nothing."""
    found: dict[str, object] = {}
    try:
        tiff = tiff_block(data)
        if not tiff or tiff[:2] not in (b"II", b"MM"):
            return found
        order = "<" if tiff[:2] == b"II" else ">"
        gps: dict[str, object] = {}
        for tag, value in _entries(tiff, struct.unpack_from(f"{order}I", tiff, 4)[0], order):
            if tag in _IFD:
                found[_IFD[tag]] = value
            elif tag == 0x8769:
                found |= {_EXIF[t]: v for t, v in _entries(tiff, value, order) if t in _EXIF}
            elif tag == 0x8825:
                gps = {_GPS[t]: v for t, v in _entries(tiff, value, order) if t in _GPS}
        for name, ref, back in (("lat", "lat_ref", "S"), ("lon", "lon_ref", "W")):
            parts = gps.get(name)
            if parts and None not in parts:
                degrees = sum(p / 60**k for k, p in enumerate(parts[:3]))
                found["latitude" if name == "lat" else "longitude"] = -degrees if gps.get(ref) == back else degrees
    except (struct.error, TypeError, ValueError, IndexError):
        pass
    return found


def read_tags(photos: DataFrame) -> DataFrame:
    """(photo_id, tag, value) of all photos (photo_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, str(v)) for i, c in zip(batch["photo_id"].to_pylist(), batch["content"].to_pylist(), strict=True) for t, v in read_exif(c or b"").items()]
            ids, tags, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch["photo_id"].type), pa.array(tags, pa.string()), pa.array(values, pa.string())], ["photo_id", "tag", "value"])

    kind = photos.schema["photo_id"].dataType.simpleString()
    return photos.select("photo_id", "content").mapInArrow(run, f"photo_id {kind}, tag string, value string")


def container_segments(photos: DataFrame) -> DataFrame:
    """(photo_id, seq, kind, start, end, keep); a file of no known or sound container has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, data in zip(pdf["photo_id"], pdf["content"], strict=True):
                walks = (w(data or b"") for w in WALKERS.values())
                rows += [(i, k, s.kind, s.start, s.end, s.keep) for k, s in enumerate(next((w for w in walks if w is not None), []))]
            yield pd.DataFrame(rows, columns=["photo_id", "seq", "kind", "start", "end", "keep"])

    kind = photos.schema["photo_id"].dataType.simpleString()
    return photos.select("photo_id", "content").mapInPandas(run, f"photo_id {kind}, seq int, kind string, start long, end long, keep boolean")


def _stripped(contents: pd.Series) -> pd.DataFrame:
    found = [strip(c) if c is not None else None for c in contents]
    return pd.DataFrame({"mime": [f and f[0] for f in found], "content": [f and f[1] for f in found]})


def scrub(photos: DataFrame) -> DataFrame:
    """``photos`` with metadata dropped: content, mime, mode ('lossless' or 'unsupported'),
    removed_bytes. The container is told by bytes, not by MIME. Nothing is shuffled."""
    done = photos.withColumn("_s", F.pandas_udf(_stripped, "mime string, content binary")("content"))
    ok = F.col("_s.content").isNotNull()
    removed = F.when(ok, F.octet_length("content") - F.octet_length("_s.content")).otherwise(F.lit(0)).cast("long")
    return done.withColumns(
        {"mode": F.when(ok, "lossless").otherwise("unsupported"), "removed_bytes": removed, "mime": F.coalesce("_s.mime", "mime"), "content": F.coalesce("_s.content", "content")}
    ).drop("_s")


def drop_scrubbed_tags(tags: DataFrame, scrubbed: DataFrame) -> DataFrame:
    """Tags of photos whose metadata is gone go too."""
    return tags.join(scrubbed.filter("mode = 'lossless'").select("photo_id"), "photo_id", "left_anti")
