"""Attachment kinds and conversion outcomes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgrain.functions.text import suffix

# Text types and suffixes, image types, brands, outcomes.
TEXT_TYPES = ("text/plain", "text/markdown", "text/x-markdown")
TEXT_SUFFIXES = ("txt", "md", "markdown", "text")
IMAGE_TYPES = tuple(f"image/{t}" for t in ("jpeg", "jpg", "png", "gif", "tiff", "webp", "heic", "heif", "avif"))
HEIC_BRANDS = ("heic", "heix", "heim", "heis", "mif1", "msf1")
AVIF_BRANDS = ("avif", "avis")
REASONS = {
    "UNSUPPORTED_TYPE": "Dieser Dateityp wird nicht in die PDF übernommen.",
    "ENCRYPTED": "Die Datei ist verschlüsselt und konnte nicht geöffnet werden.",
    "CORRUPT": "Die Datei ist beschädigt und konnte nicht gelesen werden.",
    "TOO_LARGE": "Die Datei ist zu groß und wurde nicht in die PDF übernommen.",
    "TRANSCODE_FAILED": "Die Datei konnte nicht in eine PDF-Seite umgewandelt werden.",
    "EMPTY": "Die Datei ist leer.",
    "TIMEOUT": "Die Umwandlung hat zu lange gedauert und wurde abgebrochen.",
}
DEFAULT_MAX_BYTES = 400 * 1024 * 1024


def sniff_mime(content: Column) -> Column:
    """Type by leading bytes, null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    brand = F.substring(content, 9, 4).cast("string")
    is_iso = F.substring(head, 9, 8) == "66747970"
    return (
        F.when(F.startswith(head, F.lit("255044462D")), "application/pdf")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(F.substring(head, 1, 12).isin("474946383761", "474946383961"), "image/gif")
        .when(F.substring(head, 1, 8).isin("49492A00", "4D4D002A"), "image/tiff")
        .when((F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(is_iso & brand.isin(*HEIC_BRANDS), "image/heic")
        .when(is_iso & brand.isin(*AVIF_BRANDS), "image/avif")
    )


def effective_mime(content: Column, declared: Column) -> Column:
    """Sniffed type, else the declared one."""
    return F.coalesce(sniff_mime(content), F.lower(declared))


def classify(content: Column, declared: Column, filename: Column) -> Column:
    """PDF, IMAGE, TEXT or OPAQUE."""
    mime = effective_mime(content, declared)
    return (
        F.when(mime == "application/pdf", "PDF")
        .when(mime.isin(*IMAGE_TYPES), "IMAGE")
        .when(F.coalesce(mime.isin(*TEXT_TYPES), F.lit(False)) | F.coalesce(suffix(filename).isin(*TEXT_SUFFIXES), F.lit(False)), "TEXT")
        .otherwise("OPAQUE")
    )


def planned_outcome(size: Column, kind: Column, max_bytes: Column) -> Column:
    """Reason an attachment isn't converted, decided before any converter runs; null if it is tried.

    A cap of 0 switches the size test off.
    """
    cap = F.coalesce(max_bytes, F.lit(DEFAULT_MAX_BYTES))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY").when((cap > 0) & (size > cap), "TOO_LARGE").when(kind == "OPAQUE", "UNSUPPORTED_TYPE")
    )
