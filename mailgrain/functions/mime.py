"""MIME messages to one struct per mail, and to one row per part."""

from __future__ import annotations

import email
import email.policy
import email.utils
import functools
import unicodedata
from email.headerregistry import HeaderRegistry

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("filename", "content_type")]
    + [T.StructField("content", T.BinaryType())]
    + [T.StructField(n, T.StringType()) for n in ("content_id", "content_location")]
    + [T.StructField("is_inline", T.BooleanType())]
)
_TEXTS = ("from_", "to", "cc", "bcc", "subject")
MAIL_TYPE = T.StructType(
    [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField("wall", T.TimestampNTZType()), T.StructField("offset_min", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("message_id", "html_body", "text_body")]
    + [T.StructField(n, T.ArrayType(_PART)) for n in ("attachments", "inline_parts")]
)


# Parsed headers are immutable texts; the same type and disposition lines come again and again.
_POLICY = email.policy.default.clone(header_factory=functools.lru_cache(maxsize=16_384)(HeaderRegistry()))


def _body(message, kind: str) -> tuple[object, str | None]:
    part = message.get_body(preferencelist=(kind,))
    if part is None or part.get_content_subtype() != kind:
        return None, None
    try:
        return part, part.get_content()
    except (LookupError, UnicodeError, KeyError):
        return part, (part.get_payload(decode=True) or b"").decode("latin-1")


def _content(part) -> bytes:
    if part.get_content_maintype() in ("message", "multipart"):
        inner = part.get_payload()
        inner = inner[0] if isinstance(inner, list) and inner else part
        return inner.as_bytes() if hasattr(inner, "as_bytes") else str(inner).encode()
    return part.get_payload(decode=True) or b""


def _bare(value) -> str | None:
    return (str(value).strip().lstrip("<").rstrip(">") or None) if value else None


def _leaves(message, bodies: set[int]) -> list:
    """Parts that are neither containers nor shown, in order.

    A container is entered unless it is attached as a whole; a message inside a
    mail stays whole.  What stands beside the shown form of an alternative
    (another text, a calendar entry) is that form again and goes, and so does
    the shown body; whatever is marked as attached stays.
    """
    out = []
    waiting = [(message, False)]
    while waiting:
        part, is_form = waiting.pop()
        attached = part.get_content_disposition() == "attachment"
        if part.get_content_maintype() == "multipart" and not attached:
            forms = part.get_content_subtype() == "alternative"
            waiting.extend((child, forms) for child in reversed(list(part.iter_parts())))
        elif attached or not (is_form or id(part) in bodies):
            out.append(part)
    return out


def read_mail(raw: bytes | None) -> dict:
    """Fields of MAIL_TYPE; malformed mail never raises."""
    empty = dict.fromkeys(_TEXTS, "") | dict.fromkeys(("wall", "offset_min", "message_id", "html_body", "text_body"))
    if raw is None:
        return empty | {"ok": False, "error": "no content", "attachments": [], "inline_parts": []}
    try:
        message = email.message_from_bytes(bytes(raw), policy=_POLICY)
        out = dict(empty)
        for field, name in (("from_", "From"), ("to", "To"), ("cc", "Cc"), ("bcc", "Bcc"), ("subject", "Subject")):
            out[field] = str(message.get(name, "") or "")
        out["message_id"] = str(message.get("Message-ID", "") or "").strip() or None
        try:
            when = email.utils.parsedate_to_datetime(str(message["Date"])) if message["Date"] else None
        except (TypeError, ValueError):
            when = None
        if when is not None:
            out["wall"] = when.replace(tzinfo=None)
            out["offset_min"] = None if when.utcoffset() is None else int(when.utcoffset().total_seconds() // 60)
        page, out["html_body"] = _body(message, "html")
        plain, out["text_body"] = _body(message, "plain")
        bodies = {id(p) for p in (page, plain) if p is not None}
        attachments, inline = [], []
        for number, part in enumerate(_leaves(message, bodies), 1):
            try:
                name = part.get_filename()
                name = unicodedata.normalize("NFC", name) if name else f"attachment-{number:02d}.{part.get_content_subtype()}"
                row = {
                    "filename": name, "content_type": part.get_content_type(), "content": _content(part),
                    "content_id": _bare(part.get("Content-ID")), "content_location": str(part.get("Content-Location") or "").strip() or None,
                }
                row["is_inline"] = bool(row["content_id"] or row["content_location"]) and part.get_content_disposition() != "attachment"
            except Exception:  # noqa: BLE001 - a malformed part is skipped
                continue
            (inline if row["is_inline"] else attachments).append(row)
        return out | {"ok": True, "error": None, "attachments": attachments, "inline_parts": inline}
    except Exception as e:  # noqa: BLE001 - one mail must not fail a task
        return empty | {"ok": False, "error": f"{type(e).__name__}: {e}"[:200], "attachments": [], "inline_parts": []}


@F.pandas_udf(MAIL_TYPE)
def parse_mail(raw: pd.Series) -> pd.DataFrame:
    """Struct of every raw mail; select it once and take its fields natively."""
    frame = pd.DataFrame([read_mail(r) for r in raw], columns=MAIL_TYPE.names)
    frame["wall"] = pd.to_datetime(frame["wall"], errors="coerce")
    frame["offset_min"] = frame["offset_min"].astype("Int32")
    return frame


def read_mails(mails, raw: str, keep: list[str]):
    """``keep`` and ``m`` (MAIL_TYPE) of every row.

    Unlike parse_mail this is an operator of its own: exploding parts or taking
    several fields can't make the optimiser parse a mail more than once.
    """
    source = mails.select(*keep, F.col(raw).alias("__raw"))

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch["__raw"]:
                mail = read_mail(content)
                rows.append({name: mail[name] for name in MAIL_TYPE.names})
            out = batch[keep].copy()
            out["m"] = pd.Series(rows, dtype=object, index=batch.index)
            yield out

    fields = [f for f in source.schema.fields if f.name in keep]
    return source.mapInPandas(run, T.StructType([*fields, T.StructField("m", MAIL_TYPE)]))


def resolvable_parts(mail):
    """All parts of a parsed mail that its page may refer to: inline ones and attachments (a column of MAIL_TYPE)."""
    return F.concat(mail["attachments"], mail["inline_parts"])


class MailParts:
    """Table function: one row per part of a mail, numbered from 1."""

    def eval(self, raw: bytes):
        got = read_mail(raw)
        for number, part in enumerate(got["attachments"] + got["inline_parts"], 1):
            yield number, part["filename"], part["content_type"], len(part["content"]), part["content_id"], part["is_inline"]


class HtmlReferences:
    """Table function: one row per reference that cleaning a page blocks or can't resolve."""

    def eval(self, markup: str):
        _, unresolved, blocked, _, _ = clean_page_of(markup)
        for url in unresolved:
            yield "unresolved", url
        for url in blocked:
            yield "blocked", url


def clean_page_of(markup: str):
    """Audit of a page without parts and without remote content."""
    from mailgrain.functions.markup import clean_page

    return clean_page(markup, [], False)


def register(spark) -> None:
    """Scalar and table functions for SQL text.

    Python functions run Arrow-batched.  Those that are one expression of
    built-ins are temporary SQL functions, which the optimiser inlines.
    """
    from mailgrain.functions import attachments, markup, text

    for name, function in (
        ("nfc", text.nfc), ("email_addresses", text.email_addresses), ("decode_words", text.decode_words),
        ("html_to_text", markup.html_to_text), ("html_is_trivial", markup.html_is_trivial), ("parse_mail", parse_mail), ("clean_html", markup.page_cleaner(False)), ("clean_html_remote", markup.page_cleaner(True)),
    ):
        spark.udf.register(name, function)
    parts = F.udtf(MailParts, returnType="part_no int, filename string, content_type string, size long, content_id string, is_inline boolean")
    refs = F.udtf(HtmlReferences, returnType="kind string, url string")
    spark.udtf.register("mail_parts", parts)
    spark.udtf.register("html_refs", refs)
    c = F.col
    wall, content, kind, name = c("w"), c("c"), c("k"), c("n")
    for function, parameters, column in (
        ("sanitize_name", "t string", text.sanitize(c("t"))), ("cap_bytes", "t string", text.truncate_bytes(c("t"))), ("email_address", "t string", text.email_address(c("t"))),
        ("format_stamp", "w timestamp_ntz", text.format_date(wall)),
        ("format_date_human", "w timestamp_ntz", text.format_date_human(wall)), ("parse_size", "t string", text.parse_size(c("t"))), ("format_size", "n bigint", text.format_size(c("n"))),
        ("safe_attachment_name", "t string", text.safe_attachment_name(c("t"))), ("file_suffix", "t string", text.suffix(c("t"))), ("bare_id", "t string", text.bare_id(c("t"))),
        ("data_uri", "c binary, k string", text.data_uri(content, kind)), ("decode_bytes", "c binary", text.decode_bytes(content)),
        ("is_remote_url", "t string", text.is_remote(c("t"))), ("is_allowed_url", "t string", text.is_allowed_url(c("t"), False)), ("escape_html", "t string", text.escape_html(c("t"))),
        ("sniff_mime", "c binary", attachments.sniff_mime(content)), ("effective_mime", "c binary, k string", attachments.effective_mime(content, kind)), ("classify_attachment", "c binary, k string, n string", attachments.classify(content, kind, name)),
        ("has_style_reference", "t string", c("t").rlike(r"(?i)url\(|@import")),
    ):
        _sql_function(spark, function, parameters, column)
    for statement in SQL_TEXTS:
        spark.sql(statement)


def _sql_function(spark, name: str, parameters: str, column) -> None:
    """Temporary SQL function whose body is the text of an expression over its parameters."""
    empty = spark.createDataFrame([], parameters).select(column.alias("x"))
    body = empty._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
    spark.sql(f"create or replace temporary function {name}({parameters}) returns {empty.schema['x'].dataType.simpleString()} return ({body})")


#: Functions made of others, or with a lambda, whose text can't be taken from an expression.
SQL_TEXTS = (
    """create or replace temporary function base_name(w timestamp_ntz, k string, t string) returns string return
      coalesce(nullif(cap_bytes(sanitize_name(concat_ws('_', format_stamp(w), k, t))), ''), 'email')""",
    """create or replace temporary function move_target(t string, k string, n string) returns string return (
      with d as (select if(length(n) > 0, n, '/') as d),
        j as (select array_join(filter(split(replace(t, d, '/'), '/'), p -> length(p) > 0), d) as j from d)
      select if(length(k) = 0 or startswith(j, k), j, concat(k, j)) from j)""",
)
