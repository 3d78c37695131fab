"""Scalar text functions as column expressions.

Python workers are used only where Spark has no built-in: Unicode composition,
RFC 5322 address lists and RFC 2047 words.
"""

from __future__ import annotations

import unicodedata
from email.header import decode_header, make_header
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
NAME_PATTERN, DATE_FORMAT, NAME_BYTES = "{date}_{profile}_{subject}", "YYYY-MM-DD_hh-mm-ss", 200
SIZE_UNITS = {"": 1, "B": 1, "K": 1024, "KB": 1024, "M": 1024**2, "MB": 1024**2, "G": 1024**3, "GB": 1024**3}


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def sanitize(text: Column) -> Column:
    """File-name-safe text: composed, reserved signs and runs of blanks as one underscore, none at the ends."""
    composed = F.when(text.rlike(r"[^\x00-\x7f]"), nfc(text)).otherwise(text)
    flat = F.regexp_replace(composed, r'[/\\:*?"<>|]', "_")
    return F.btrim(F.regexp_replace(flat, r"(?U)[\s\x1c-\x1f_]+", "_"), F.lit("_"))


def format_date(wall: Column, pattern: str = DATE_FORMAT) -> Column:
    """Literal replacement of YYYY, MM, DD, hh, mm, ss in that order; null gives ''."""
    out = F.lit(pattern)
    for token, part, width in (
        ("YYYY", F.year(wall), 4), ("MM", F.month(wall), 2), ("DD", F.day(wall), 2),
        ("hh", F.hour(wall), 2), ("mm", F.minute(wall), 2), ("ss", F.second(wall), 2),
    ):
        out = F.replace(out, F.lit(token), F.lpad(part.cast("string"), width, "0"))
    return F.coalesce(out, F.lit(""))


def truncate_bytes(text: Column, limit: int = NAME_BYTES) -> Column:
    """Longest prefix within ``limit`` UTF-8 bytes that ends at a character, without trailing blanks."""
    raw = text.cast("binary")
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")  # noqa: E731 - byte k + 1 continues a character
    end = F.when(~inside(limit), limit).when(~inside(limit - 1), limit - 1).when(~inside(limit - 2), limit - 2).otherwise(limit - 3)
    whole = F.substring(raw, F.lit(1), end).cast("string")
    return F.when(F.octet_length(text) <= limit, F.rtrim(text)).otherwise(F.rtrim(whole))


def base_name(wall: Column, profile: Column, subject: Column, pattern: str = NAME_PATTERN, date_format: str = DATE_FORMAT) -> Column:
    """File name of a message: placeholders filled, made safe, capped, 'email' if nothing is left."""
    out = F.replace(F.lit(pattern), F.lit("{date}"), format_date(wall, date_format))
    out = F.replace(out, F.lit("{profile}"), F.coalesce(profile, F.lit("")))
    out = F.replace(out, F.lit("{subject}"), F.coalesce(subject, F.lit("")))
    safe = truncate_bytes(sanitize(out))
    return F.when(F.length(safe) == 0, F.lit("email")).otherwise(safe)


def email_address(header: Column) -> Column:
    """First bracketed address, else the trimmed header."""
    inside = F.trim(F.regexp_extract(header, r"<([^>]+)>", 1))
    return F.when(header.rlike(r"<[^>]+>"), inside).otherwise(F.trim(header))


@F.pandas_udf(T.ArrayType(T.StringType()))
def email_addresses(header: pd.Series) -> pd.Series:
    """Addresses of a header by the strict RFC 5322 reader; empty ones dropped, null gives none."""
    return header.map(lambda h: [a for _, a in getaddresses([h]) if a] if h else [])


@F.pandas_udf(T.StringType())
def decode_words(header: pd.Series) -> pd.Series:
    """RFC 2047 words decoded; what can't be decoded stays as it is."""

    def one(h):
        if h is None:
            return None
        try:
            return str(make_header(decode_header(h)))
        except (ValueError, LookupError, UnicodeError):
            return h

    return header.map(one)


def size_bytes(text: str) -> int | None:
    """Bytes of a size such as '5 MB' (binary units, truncated), for settings; None for nonsense."""
    plain = text.strip().upper()
    number = plain.rstrip("BGKM").rstrip()
    factor = SIZE_UNITS.get(plain[len(number) :].strip())
    whole, dot, part = number.partition(".")
    if factor is None or not (whole.isascii() and whole.isdigit()) or (dot and not (part.isascii() and part.isdigit())):
        return None
    return int(float(number) * factor)


def parse_size(text: Column) -> Column:
    """``size_bytes`` of a column."""
    plain = F.upper(F.btrim(text, F.lit(" \t\n\r\f\x0b")))
    number = F.rtrim(F.regexp_replace(plain, "[BGKM]+$", ""))
    factors = F.create_map(*[F.lit(x) for pair in SIZE_UNITS.items() for x in pair])
    factor = F.try_element_at(factors, F.trim(F.substr(plain, F.length(number) + 1)))
    return F.when(number.rlike("^[0-9]+$|^[0-9]+[.][0-9]+$"), F.floor(number.try_cast("double") * factor).cast("long"))


def required_size(text: Column) -> Column:
    """``parse_size`` that fails the query for nonsense; null stays null."""
    got = parse_size(text)
    return F.when(text.isNull(), F.lit(None).cast("long")).when(got.isNull(), F.raise_error(F.concat(F.lit("not a size: "), text)).cast("long")).otherwise(got)


def header_message_id(content: Column, limit: int = 65_536) -> Column:
    """Message-ID of a raw message from its first ``limit`` bytes: header lines unfolded, nothing after the blank line."""
    head = F.regexp_extract(decode_bytes(F.substring(content, 1, limit)), r"(?s)^(.*?)(?:\r?\n\r?\n|\z)", 1)
    flat = F.regexp_replace(head, r"\r?\n[ \t]+", " ")
    return F.nullif(F.trim(F.regexp_extract(flat, r"(?im)^message-id:([^\r\n]*)", 1)), F.lit(""))


@F.pandas_udf(T.StringType())
def decode_header_bytes(raw: pd.Series) -> pd.Series:
    """Header bytes with RFC 2047 words decoded; Latin-1 where that fails, null stays null."""

    def one(b):
        if b is None:
            return None
        try:
            return str(make_header(decode_header(bytes(b).decode("utf-8"))))
        except (ValueError, LookupError, UnicodeError):
            return bytes(b).decode("latin-1")

    return raw.map(one)


def format_size(n: Column) -> Column:
    """Human size with one decimal, halves to even."""
    out = F.format_string("%d B", n)
    shown = F.when(n < 1024, out)
    for unit, step in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        value = F.format_string("%.1f " + unit, F.bround(n / F.lit(float(step)), 1))
        shown = shown.when(n < step * 1024, value) if unit != "GB" else shown.otherwise(value)
    return F.when(n.isNotNull(), shown)


def format_date_human(wall: Column) -> Column:
    """dd.mm.YYYY HH:MM; null gives ''."""
    return F.coalesce(F.date_format(wall, "dd.MM.yyyy HH:mm"), F.lit(""))


def safe_attachment_name(name: Column) -> Column:
    """Last path part without control characters; 'attachment' if nothing usable is left."""
    path = F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"(?:/+\.)*/*\z", "")
    last = F.regexp_extract(path, r"([^/]*)\z", 1)
    clean = F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1f\x7f]", ""), r"(?U)^\s+|\s+\z", "")
    return F.when(clean.isNull() | clean.isin("", ".", ".."), F.lit("attachment")).otherwise(clean)


def suffix(name: Column) -> Column:
    """Lower-case file suffix without the dot; '' for none."""
    return F.lower(F.regexp_extract(name, r"^(?:.*/)?[^/]+\.([^./]+)$", 1))


def move_target(destination: Column, prefix: Column, delimiter: Column) -> Column:
    """Server name of a move destination: split on '/' and the delimiter, rejoined, prefixed once."""
    d = F.when(F.length(delimiter) > 0, delimiter).otherwise(F.lit("/"))
    parts = F.filter(F.split(F.replace(destination, d, F.lit("/")), "/"), lambda p: F.length(p) > 0)
    joined = F.array_join(parts, "\x00")
    named = F.replace(joined, F.lit("\x00"), d)
    return F.when((F.length(prefix) == 0) | F.startswith(named, prefix), named).otherwise(F.concat(prefix, named))


def bare_id(value: Column) -> Column:
    """Content or message id without outer blanks and brackets; null if empty."""
    return F.nullif(F.regexp_replace(F.trim(value), r"^<+|>+$", ""), F.lit(""))


def data_uri(content: Column, content_type: Column) -> Column:
    """data: URI without line breaks in the base64 part."""
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def decode_bytes(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def is_remote(url: Column) -> Column:
    """http, https, protocol-relative or ftp."""
    return F.lower(url).rlike(r"^(https?://|//|ftp:)")


def is_allowed_url(url: Column, allow_remote: bool) -> Column:
    """What the page renderer may load."""
    low = F.lower(url)
    local = low.rlike(r"^(data|about):")
    return local | low.rlike(r"^https?://") if allow_remote else local


def escape_html(text: Column) -> Column:
    """Text safe inside markup."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
