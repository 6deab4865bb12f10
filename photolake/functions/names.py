"""File names: what they tell, and the names derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name endings that count as images.
IMAGE_NAME = r"(?i)\.(jpe?g|png|webp|gif|bmp|tiff?|avif|heic|heif|svg)$"
#: File extensions of the output formats.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/avif": "avif", "image/webp": "webp"}


def looks_like_image(mime: Column, name: Column) -> Column:
    """A MIME type of images (case counts) or a known extension (case does not)."""
    return F.coalesce(mime, F.lit("")).startswith("image/") | F.coalesce(name, F.lit("")).rlike(IMAGE_NAME)


def default_format(mime: Column) -> Column:
    return F.when(mime.isin("image/png", "image/webp"), mime).otherwise(F.lit("image/jpeg"))


def extension_of(format_: Column) -> Column:
    cases = F.when(F.lit(False), F.lit(""))
    for mime, ext in EXTENSIONS.items():
        cases = cases.when(format_ == mime, F.lit(ext))
    return cases.otherwise(F.lit("jpg"))


def before_last_dot(name: Column) -> Column:
    """Up to the last dot; a leading dot starts an extension."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def stem_of(name: Column) -> Column:
    """Up to the last dot, unless the name starts with it."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def extension_with_dot(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]*)$", 1)


def format_filename(name: Column, width: Column, height: Column, format_: Column) -> Column:
    return F.concat(before_last_dot(name), F.lit("_"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("."), extension_of(format_))


def sanitise_filename(name: Column) -> Column:
    """Without path and control characters, trimmed, 120 characters at most; '' if nothing is left."""
    return F.left(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1F]', "")), F.lit(120))


def safe_stem(name: Column) -> Column:
    """A slug of the stem: lower case, others than a-z and 0-9 as single dashes."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(before_last_dot(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("image")).otherwise(slug)


def safe_file_name(name: Column) -> Column:
    clean = F.left(F.trim(F.regexp_replace(name, r"[\\/\x00-\x1F]", "")), F.lit(200))
    return F.when(clean == "", F.lit("image")).otherwise(clean)


def derive_name(name: Column, kind: str) -> Column:
    """``nobg`` and ``blurred`` copies are PNG files; ``heic`` becomes .jpg and ``svg`` .png."""
    if kind in ("nobg", "blurred"):
        return F.concat(stem_of(name), F.lit(f"-{kind}.png"))
    ext = {"heic": "jpg", "svg": "png"}[kind]
    pattern = {"heic": r"(?i)\.(heic|heif)$", "svg": r"(?i)\.svg$"}[kind]
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, f".{ext}")).otherwise(F.concat(name, F.lit(f".{ext}")))


def renamed(old_name: Column, derived: Column, new_stem: Column) -> Column:
    """``derived`` under a new stem: the old stem is swapped and the suffix stays; a name that does
    not start with the old stem keeps only its extension."""
    old = stem_of(old_name)
    return F.when(
        derived.startswith(old), F.concat(new_stem, F.substr(derived, F.length(old) + 1))
    ).otherwise(F.concat(new_stem, extension_with_dot(derived)))
