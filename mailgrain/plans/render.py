"""What a rendition consists of: pages, attachments and outcomes as relations.

Browsers, PDF tools and validators stay behind PageRenderer; the plan is the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.errors import MergeError
from mailgrain.functions import attachments as A
from mailgrain.functions import text as X
from mailgrain.functions.markup import page_facts
from mailgrain.operators import naming

# Page geometry in millimetres and pixels, section titles.
DPI, A4_WIDTH, A4_HEIGHT, MARGIN, LEFT_MARGIN = 96, 210.0, 297.0, 20.0, 25.0
FAITHFUL_WIDTH, LANDSCAPE_BELOW, WARN_HEIGHT = 800, 0.85, 14_000
REFLOWED_TITLE, TEXT_TITLE = "Umbrochene Fassung", "Nur-Text-Version"
# Labels of the header block in their order, words of separator and information pages.
LABELS = (("Von", "from_"), ("An", "to"), ("CC", "cc"), ("BCC", "bcc"), ("Datum", "date"), ("Betreff", "subject"))
ATTACHMENT, ORIGINAL, KEPT = "Anhang", "Original", "Die Originaldatei liegt im Ordner und ist in dieses PDF eingebettet."


class PageRenderer(Protocol):
    """Turns markup into pages; implemented outside this library."""

    def pages(self, markup: str, width_px: int) -> int: ...


def css_pixels(mm: Column) -> Column:
    """Millimetres at 96 dpi."""
    return mm / F.lit(25.4) * F.lit(DPI)


def fit(content_px: Column) -> Column:
    """Struct of scale and orientation that fits content of a measured width on A4."""
    portrait = css_pixels(F.lit(A4_WIDTH - MARGIN - LEFT_MARGIN))
    landscape = css_pixels(F.lit(A4_HEIGHT - MARGIN - LEFT_MARGIN))
    scale = F.least(F.lit(1.0), portrait / content_px)
    turned = scale < LANDSCAPE_BELOW
    return F.struct(F.when(turned, F.least(F.lit(1.0), landscape / content_px)).otherwise(scale).alias("scale"), turned.alias("landscape"))


@dataclass(frozen=True)
class Rendition:
    """How a body is laid out: viewport, left margin, and whether wide content may turn the page."""

    name: str
    width_px: int
    left_mm: float
    may_turn: bool


#: As the sender saw it, and reflowed to the page.
FAITHFUL = Rendition("faithful", FAITHFUL_WIDTH, MARGIN, True)
REFLOWED = Rendition("reflowed", round((A4_WIDTH - MARGIN - LEFT_MARGIN) / 25.4 * DPI), LEFT_MARGIN, False)


def carry_links(links: Column, placed: Column) -> Column:
    """Link rectangles (x0, y0, x1, y1) of a page after ``place`` moved and scaled it."""
    x = lambda v: v * placed["scale"] + placed["dx"]
    y = lambda v: v * placed["scale"] + placed["dy"]
    return F.transform(links, lambda r: r.withField("x0", x(r["x0"])).withField("y0", y(r["y0"])).withField("x1", x(r["x1"])).withField("y1", y(r["y1"])))


def resolved_references(references: DataFrame, parts: DataFrame) -> DataFrame:
    """References of pages (mail_id, url) with the part each means: by content id, else by place; null part_id if none.

    ``parts``: mail_id, part_id, content_id, content_location.  The first part wins.
    """
    is_cid = F.lower("url").startswith("cid:")
    key = F.when(is_cid, F.concat(F.lit("c:"), F.btrim(F.url_decode(F.substr("url", F.lit(5))), F.lit("<> ")))).otherwise(F.concat(F.lit("p:"), F.regexp_replace("url", r"^\./", "")))
    by_id = parts.where(F.length("content_id") > 0).select("mail_id", F.concat(F.lit("c:"), F.btrim("content_id", F.lit("<> "))).alias("__k"), "part_id")
    by_place = parts.where(F.length("content_location") > 0).select("mail_id", F.concat(F.lit("p:"), F.regexp_replace("content_location", r"^\./", "")).alias("__k"), "part_id")
    first = by_id.unionByName(by_place).groupBy("mail_id", "__k").agg(F.min("part_id").alias("part_id"))
    return references.withColumn("__k", key).join(first, ["mail_id", "__k"], "left").drop("__k")


class ImageConverter(Protocol):
    """Pictures to pages."""

    def pages(self, mime: str, content: bytes) -> bytes: ...


class DocumentTool(Protocol):
    """Documents: made readable (EncryptedError, DamagedError), joined, counted, made fit for archiving."""

    def normalise(self, content: bytes) -> bytes: ...

    def join(self, documents: list[bytes]) -> bytes: ...

    def count(self, content: bytes) -> int: ...

    def archive(self, content: bytes) -> bytes: ...


def converter(images: ImageConverter, documents: DocumentTool, texts: Callable[[str], bytes]) -> Callable[[str, str, bytes], int]:
    """Function for ``converted`` made of the tools for pictures, documents and texts."""

    def convert(kind: str, mime: str, content: bytes) -> int:
        if kind == "IMAGE":
            return documents.count(images.pages(mime, content))
        if kind == "TEXT":
            try:
                return documents.count(texts(content.decode("utf-8")))
            except UnicodeDecodeError:
                return documents.count(texts(content.decode("latin-1")))
        return documents.count(documents.normalise(content))

    return convert


def joined(documents: DocumentTool, pages: list[bytes]) -> bytes:
    """One archivable document of several; MergeError if there are none."""
    if not pages:
        raise MergeError("nothing to join")
    return documents.archive(documents.join(pages))


def place(source_w: Column, source_h: Column, w: Column, h: Column) -> Column:
    """Struct of the scale and offsets that centre one rectangle in another."""
    scale = F.least(w / source_w, h / source_h)
    return F.struct(scale.alias("scale"), ((w - source_w * scale) / 2).alias("dx"), ((h - source_h * scale) / 2).alias("dy"))


def body_plan(mails: DataFrame) -> DataFrame:
    """mail_id, page_no, part, title: the ordered body pages of every mail.

    Needs mail_id, text_body, html_body and html_pages (pages of the reflowed
    rendition; null if it failed, which leaves text only).
    """
    facts = mails.withColumn("__facts", page_facts("html_body"))
    text = F.coalesce(F.nullif("text_body", F.lit("")), F.col("__facts.text"))
    visual = (F.length(F.coalesce("html_body", F.lit(""))) > 0) & ~F.col("__facts.trivial") & F.col("html_pages").isNotNull()
    m = facts.select("mail_id", "html_pages", visual.alias("visual"), (F.length(F.coalesce(text, F.lit(""))) > 0).alias("has_text"))
    part = lambda name, title=None: F.struct(F.lit(name).alias("part"), F.lit(title).cast("string").alias("title"))
    several = F.col("visual") & (F.col("html_pages") > 1)
    pages = F.filter(
        F.array(
            F.when(several, part("faithful")), F.when(several, part("section", REFLOWED_TITLE)), F.when(F.col("visual"), part("reflowed")),
            F.when(F.col("visual") & F.col("has_text"), part("section", TEXT_TITLE)), F.when(F.col("has_text"), part("text")),
            F.when(~F.col("visual") & ~F.col("has_text"), part("header")),
        ),
        lambda p: p.isNotNull(),
    )
    return m.select("mail_id", F.posexplode(pages).alias("k", "p")).select("mail_id", (F.col("k") + 1).alias("page_no"), "p.part", "p.title")


def attachment_plan(parts: DataFrame, limits: Column) -> DataFrame:
    """Attachments with kind, mime, size and the reason they aren't converted (null: a converter is asked)."""
    size = F.octet_length("content").cast("long")
    kind = A.classify(F.col("content"), F.col("content_type"), F.col("filename"))
    return parts.select(
        "part_id", "hdr_id", "part_no", A.effective_mime(F.col("content"), F.col("content_type")).alias("mime"), kind.alias("kind"), size.alias("size"),
        A.planned_outcome(size, kind, limits).alias("reason"),
    )


def separator_title(index: Column, filename: Column, pages: Column, size: Column) -> Column:
    """Line on the page before an attachment."""
    unit = F.when(pages == 1, "Seite").otherwise("Seiten")
    return F.format_string("%d. %s (%d %s, %s)", index, X.escape_html(filename), pages, unit, X.format_size(size))


def _block(name: str, *content: Column) -> Column:
    return F.concat(F.lit(f'<div class="{name}">'), *content, F.lit("</div>"))


def page_markup(*content: Column, style: str = "") -> Column:
    """A page of its own that may load nothing but what it holds."""
    head = f"<!DOCTYPE html><html lang=\"de\"><head><meta charset=\"utf-8\"><meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; img-src data:; style-src 'unsafe-inline' data:; font-src data:\"><style>{style}</style></head><body>"
    return F.concat(F.lit(head), *content, F.lit("</body></html>"))


def header_markup(headers: dict[str, Column], show_bcc: bool = False) -> Column:
    """Header block: a row for every field that isn't empty, BCC only if asked."""
    rows = []
    for label, field in LABELS:
        if field in headers and (field != "bcc" or show_bcc):
            value = F.coalesce(headers[field], F.lit(""))
            rows.append(F.when(F.length(value) > 0, _block("row", F.lit(f"<b>{label}:</b> "), X.escape_html(value))).otherwise(""))
    return _block("header", *rows)


def separator_markup(index: Column, filename: Column, pages: Column, size: Column) -> Column:
    """Page before a converted attachment."""
    unit = F.when(pages == 1, "Seite").otherwise("Seiten")
    told = F.concat(pages.cast("string"), F.lit(" "), unit, F.lit(" &middot; "), X.format_size(size))
    return page_markup(_block("eyebrow", F.lit(f"{ATTACHMENT} "), index.cast("string")), _block("title", X.escape_html(filename)), _block("meta", told))


def info_markup(index: Column, filename: Column, mime: Column, size: Column, reason: Column) -> Column:
    """Page instead of an attachment that has no pages, with the reason."""
    told = F.concat(X.escape_html(F.coalesce(mime, F.lit(""))), F.lit(" &middot; "), X.format_size(size))
    return page_markup(
        _block("eyebrow", F.lit(f"{ATTACHMENT} "), index.cast("string"), F.lit(f" &middot; {ORIGINAL}")), _block("title", X.escape_html(filename)),
        _block("explain", X.escape_html(F.coalesce(reason, F.lit("")))), _block("explain", F.lit(KEPT)), _block("meta", told),
    )


def section_markup(title: Column) -> Column:
    """Page before another form of the body."""
    return page_markup(_block("title", X.escape_html(title)))


def text_markup(headers: dict[str, Column], text: Column, show_bcc: bool = False) -> Column:
    """Page of a plain body under its header block."""
    return page_markup(header_markup(headers, show_bcc), _block("text", X.escape_html(text)))


def text_attachment_markup(filename: Column, text: Column) -> Column:
    """Page of an attached text."""
    return page_markup(_block("header", F.lit(f"<b>{ATTACHMENT}:</b> "), X.escape_html(filename)), _block("text", X.escape_html(text)))


CONVERTED = "part_id long, ok boolean, pages int, reason string"


def converted(parts: DataFrame, limits: Column, convert: Callable[[str, str, bytes], int], jobs: int | None = None) -> DataFrame:
    """part_id, ok, pages, reason of every attachment; at most ``jobs`` converters run at once.

    What the plan already settles (empty, too large, no known type) isn't given
    to ``convert(kind, mime, content)``, which returns a number of pages or raises:
    ``TimeoutError``, ``PermissionError`` for an encrypted file, ``ValueError`` for
    a damaged one, anything else for a failed conversion.  No part fails a task.
    """
    size = F.octet_length("content").cast("long")
    kind = A.classify(F.col("content"), F.col("content_type"), F.col("filename"))
    asked = parts.select("part_id", kind.alias("kind"), A.effective_mime(F.col("content"), F.col("content_type")).alias("mime"), A.planned_outcome(size, kind, limits).alias("reason"), "content")
    settled = asked.where("reason is not null").select("part_id", F.lit(False).alias("ok"), F.lit(0).alias("pages"), "reason")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, kind, mime, content in zip(batch["part_id"], batch["kind"], batch["mime"], batch["content"], strict=True):
                reason, pages = None, 0
                try:
                    pages = int(convert(kind, mime, bytes(content)))
                except TimeoutError:
                    reason = "TIMEOUT"
                except PermissionError:
                    reason = "ENCRYPTED"
                except ValueError:
                    reason = "CORRUPT"
                except Exception:  # noqa: BLE001 - a converter's fault is an outcome
                    reason = "TRANSCODE_FAILED"
                out.append((part, reason is None, pages, reason))
            yield pd.DataFrame(out, columns=["part_id", "ok", "pages", "reason"])

    due = asked.where("reason is null").select("part_id", "kind", "mime", "content")
    return (due if jobs is None else due.coalesce(jobs)).mapInPandas(run, CONVERTED).unionByName(settled)


def attachment_pages(parts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """hdr_id, index, page, part_id, markup: what each attachment adds to its mail.

    A converted one gives a separator and its pages (markup null, they exist), any
    other an information page with the reason.
    """
    w = parts.select("hdr_id", "part_id", F.col("part_no").alias("index"), "filename", A.effective_mime(F.col("content"), F.col("content_type")).alias("mime"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"))
    both = w.join(outcomes, "part_id")
    reason = F.create_map(*[F.lit(x) for pair in A.REASONS.items() for x in pair])
    index, name, size = F.col("index"), F.coalesce("filename", F.lit("")), F.col("size")
    page = lambda kind, markup: F.struct(F.lit(kind).alias("page"), markup.alias("markup"))
    shown = F.array(page("separator", separator_markup(index, name, F.col("pages"), size)), page("pages", F.lit(None).cast("string")))
    info = F.array(page("info", info_markup(index, name, F.col("mime"), size, F.try_element_at(reason, F.col("reason")))))
    return both.select("hdr_id", "index", "part_id", F.posexplode(F.when(F.col("ok"), shown).otherwise(info)).alias("k", "p")).select("hdr_id", "index", F.col("k").alias("step"), "p.page", "part_id", "p.markup")


@dataclass
class RenderPlan:
    """Named results of a render run; nothing runs until one is used."""

    mails: DataFrame
    pages: DataFrame
    files: DataFrame


def render_plan(mails: DataFrame, parts: DataFrame, outcomes: DataFrame, existing: DataFrame | None = None) -> RenderPlan:
    """Plan a render run over all mails of all output folders.

    ``mails``: mail_id, folder, profile, subject, stamp, message_id, from_, content,
    text_body, html_body, html_pages.  ``parts``: attachments by hdr_id (the
    mail_id).  ``existing``: folder, name, identity of rendered folders.  A mail
    that a folder of its name chain holds is skipped; another one with its name
    gets the next.  Mails with attachments give two files, others one.
    """
    base = X.base_name(F.col("stamp"), F.col("profile"), F.col("subject"))
    shown = F.coalesce(F.date_format("stamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    ident = naming.identity(F.col("message_id"), F.col("from_"), F.col("subject"), shown, F.coalesce("content", F.lit("").cast("binary")))
    m = mails.select("mail_id", "folder", base.alias("base"), ident.alias("i")).select("mail_id", "folder", "base", F.col("i.primary").alias("primary"), F.col("i.sha256").alias("sha256"))
    if existing is None:
        keyed = m.withColumn("ident", F.col("sha256")).withColumn("turn", F.lit(1))
    else:
        lines = F.filter(F.transform(F.split("identity", "\n"), F.trim), lambda x: F.length(x) > 0)
        hashed = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("sha256:"))), 0)
        there = existing.select("folder", F.col("name").alias("base"), hashed.alias("hash"), F.get(lines, 0).alias("first"))
        # a folder without a content line is known by its first line
        plain = there.where("hash is null").select("folder", F.col("first").alias("primary")).distinct().withColumn("__plain", F.lit(True))
        m = m.join(plain, ["folder", "primary"], "left").withColumn("ident", F.when(F.col("__plain"), F.col("primary")).otherwise(F.col("sha256"))).drop("__plain")
        old = there.select(F.lit(None).cast(mails.schema["mail_id"].dataType).alias("mail_id"), "folder", "base", F.lit(None).cast("string").alias("primary"), F.lit(None).cast("string").alias("sha256"), F.coalesce("hash", "first", F.lit("?")).alias("ident"), F.lit(0).alias("turn"))
        keyed = m.withColumn("turn", F.lit(1)).unionByName(old)
    keyed = keyed.withColumn("__b", F.concat("folder", F.lit("\0"), "base")).withColumn("__g", F.regexp_replace("__b", r"(-\d+)+\z", ""))
    named = naming.unique_names_probe(keyed, "__g", "__b", "ident", ["turn", "mail_id"]).where("turn = 1")
    named = named.select("mail_id", "folder", F.regexp_extract("name", "\0(.*)", 1).alias("name"), "skip", F.concat("primary", F.lit("\n"), "sha256").alias("identity"))
    due = named.where("not skip").select("mail_id", "folder", "name")
    body = body_plan(mails.join(due.select("mail_id"), "mail_id", "left_semi")).select("mail_id", F.lit(0).alias("index"), F.col("page_no").alias("step"), F.col("part").alias("page"), "title")
    more = attachment_pages(parts.join(due.select(F.col("mail_id").alias("hdr_id")), "hdr_id", "left_semi"), outcomes)
    more = more.select(F.col("hdr_id").alias("mail_id"), "index", "step", "page", F.lit(None).cast("string").alias("title"))
    has = parts.select(F.col("hdr_id").alias("mail_id")).distinct().withColumn("__has", F.lit(True))
    pdf = lambda end, all_parts: F.struct(F.concat("name", F.lit(end)).alias("file"), F.lit(all_parts).alias("with_attachments"))
    both = F.when(F.col("__has"), F.array(pdf(".pdf", True), pdf("_mailonly.pdf", False))).otherwise(F.array(pdf(".pdf", False)))
    files = due.join(has, "mail_id", "left").select("mail_id", "folder", "name", F.explode(both).alias("f")).select("mail_id", "folder", "name", "f.file", "f.with_attachments")
    return RenderPlan(named, body.unionByName(more), files)


def adhoc_plan(files: DataFrame, profile: str, parts: DataFrame, outcomes: DataFrame, existing: DataFrame | None = None) -> RenderPlan:
    """``render_plan`` of single files: each directory is a folder of its own and a file's date stands in for a missing one.

    ``files``: mail_id, path, modified and the mail's columns, with ``wall`` for its date.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    mails = files.withColumn("folder", folder).withColumn("profile", F.lit(profile)).withColumn("stamp", F.coalesce("wall", F.col("modified").cast("timestamp_ntz")))
    return render_plan(mails, parts, outcomes, existing)


def run_report(results: DataFrame) -> DataFrame:
    """One row: written, skipped, incomplete, html_fallback (the last two among the written)."""
    done = F.col("written")
    return results.agg(
        F.count_if(done).alias("written"), F.count_if("skipped").alias("skipped"), F.count_if(done & ~F.col("complete")).alias("incomplete"),
        F.count_if(done & ~F.col("html_rendered")).alias("html_fallback"),
    )


def validation_results(reports: DataFrame, paths: str, json: str, check: Callable[[str], bool] | None = None) -> DataFrame:
    """batch, position, path, compliant of validator reports: paths and jobs are paired by position.

    A job without result counts as non-compliant.  A batch whose counts differ, or
    whose report can't be read, can't be paired: its files are given to ``check``
    one by one, and without it their verdict is null.
    """
    job = "struct<validationResult: array<struct<compliant: boolean>>>"
    parsed = F.from_json(json, f"struct<report: struct<jobs: array<{job}>>>")
    one = F.from_json(json, "struct<report: struct<jobs: array<struct<validationResult: struct<compliant: boolean>>>>>")
    listed = F.transform(parsed["report"]["jobs"], lambda j: F.get(j["validationResult"], 0)["compliant"])
    single = F.transform(one["report"]["jobs"], lambda j: j["validationResult"]["compliant"])
    verdicts = F.coalesce(F.when(F.exists(listed, lambda v: v.isNotNull()), listed), single, listed)
    r = reports.select("batch", F.col(paths).alias("paths"), verdicts.alias("verdicts"))
    paired = F.coalesce(F.size("paths") == F.size("verdicts"), F.lit(False))
    zipped = r.where(paired).select("batch", F.posexplode(F.arrays_zip("paths", "verdicts")).alias("position", "z"))
    out = zipped.select("batch", "position", F.col("z.paths").alias("path"), F.coalesce("z.verdicts", F.lit(False)).alias("compliant"))
    alone = r.where(~paired).select("batch", F.posexplode("paths").alias("position", "path"))
    if check is None:
        return out.unionByName(alone.withColumn("compliant", F.lit(None).cast("boolean")))
    tested = F.pandas_udf(lambda p: pd.Series([_passes(check, x) for x in p], dtype=bool), "boolean")
    return out.unionByName(alone.withColumn("compliant", tested("path")))


def _passes(check: Callable[[str], bool], path: str) -> bool:
    try:
        return bool(check(path))
    except Exception:  # noqa: BLE001 - a file that can't be checked isn't compliant
        return False
