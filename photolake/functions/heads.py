"""What the first bytes of a file say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brands of the ISO base media format.
HEIC_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx", "mif1", "msf1")
AVIF_BRANDS = ("avif", "avis")
#: MIME types of HEIC files.
HEIC_MIMES = ("image/heic", "image/heif", "image/heic-sequence", "image/heif-sequence")
HEAD = 32



def _hex(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def heic_from_bytes(head: Column) -> Column:
    """An ``ftyp`` box at 4 with a HEIC brand at 8, 12, ... and no AVIF brand; 12 bytes at least."""
    data = F.substring(head, 1, HEAD)
    places = F.sequence(F.lit(8), F.greatest(F.lit(8), F.octet_length(data) - 4), F.lit(4))
    brands = F.transform(places, lambda at: F.hex(F.substr(data, at + 1, F.lit(4))))
    heic, avif = (F.array(*[F.lit(_hex(b)) for b in x]) for x in (HEIC_BRANDS, AVIF_BRANDS))
    found = (F.octet_length(data) >= 12) & (F.hex(F.substring(data, 5, 4)) == _hex("ftyp")) & ~F.arrays_overlap(brands, avif) & F.arrays_overlap(brands, heic)
    return F.coalesce(found, F.lit(False))


def sniff_format(content: Column) -> Column:
    """jpeg, png, webp, heic or null, by leading bytes alone."""
    head = lambda at, n: F.hex(F.substring(content, at, n))
    return (
        F.when(head(1, 2) == "FFD8", F.lit("jpeg"))
        .when(head(1, 8) == "89504E470D0A1A0A", F.lit("png"))
        .when((head(1, 4) == _hex("RIFF")) & (head(9, 4) == _hex("WEBP")), F.lit("webp"))
        .when(heic_from_bytes(content), F.lit("heic"))
    )


def is_heic(mime: Column, name: Column, head: Column) -> Column:
    by_type = F.lower(F.coalesce(mime, F.lit(""))).isin(*HEIC_MIMES)
    return by_type | F.coalesce(name, F.lit("")).rlike(r"(?i)\.(heic|heif)$") | heic_from_bytes(head)
