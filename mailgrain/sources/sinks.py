"""Sinks of an archive: message files, mail folders, and what a run leaves behind.

Names and skips are planned as relations (``operators.naming``); only the bytes
are written here, by the tasks, onto a file system that every executor mounts
under the same path.  A write never replaces anything: bytes go to a temporary
file, reach the disk, and are linked to their name, which fails if it is taken.
A task that runs again finds what it wrote before and leaves it.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.functions.text import safe_attachment_name
from mailgrain.operators import naming

# Modes of files and folders, prefix of folders that aren't finished, name of the identity file.
FILE_MODE, FOLDER_MODE, STAGING, MANIFEST = 0o400, 0o700, ".staging-", "mail-manifest.txt"


def numbered(name: str, k: int) -> str:
    """The k-th name of a chain: name.eml, name-2.eml, name-3.eml."""
    stem, dot, suffix = name.rpartition(".")
    return name if k < 2 else f"{stem}-{k}.{suffix}" if dot and stem else f"{name}-{k}"


def free_name(folder: str, name: str) -> str:
    """First name of the chain that nothing in the folder has."""
    k = 1
    while os.path.lexists(os.path.join(folder, numbered(name, k))):
        k += 1
    return numbered(name, k)


def make_folder(path: str, private: bool = False) -> None:
    """Create a folder and those above it; a private one is its owner's alone."""
    os.makedirs(path, exist_ok=True)
    if private:
        os.chmod(path, FOLDER_MODE)


def write_once(folder: str, name: str, content: bytes) -> tuple[str, bool]:
    """(name, whether it was written): the first name of the chain that is free or holds these very bytes."""
    make_folder(folder)
    handle, temporary = tempfile.mkstemp(prefix=".part-", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, FILE_MODE)
        k = 1
        while True:
            target = os.path.join(folder, numbered(name, k))
            try:
                os.link(temporary, target)
                return numbered(name, k), True
            except FileExistsError:
                if holds(target, content):
                    return numbered(name, k), False
            k += 1
    finally:
        os.unlink(temporary)


def holds(path: str, content: bytes) -> bool:
    """Whether a file holds these bytes; sizes are compared first, and what can't be read doesn't."""
    try:
        if os.path.getsize(path) != len(content):
            return False
        with open(path, "rb") as f:
            return f.read() == content
    except OSError:
        return False


def delivery_names(mails: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``mails`` (folder, base, content, position) plus name and skip: the file of every message.

    Messages of one folder and base take the names of the chain in order of
    position.  A message whose bytes already have a name on it shares that name
    and is skipped.  ``existing``: folder, name (without suffix), content of files
    that are there.
    """
    digest = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.sha2(c, 256))
    lean = mails.select("folder", "base", digest(F.col("content")).alias("__ident"), "position", F.lit(1).alias("__turn"))
    if existing is not None:
        there = existing.select("folder", F.col("name").alias("base"), digest(F.col("content")).alias("__ident"), F.lit(None).cast(mails.schema["position"].dataType).alias("position"), F.lit(0).alias("__turn"))
        lean = there.unionByName(lean)
    lean = lean.withColumn("__group", F.concat("folder", F.lit("\0"), F.regexp_replace("base", r"(-\d+)+\z", "")))
    keyed = lean.withColumn("__base", F.concat("folder", F.lit("\0"), "base"))
    named = naming.unique_names_probe(keyed, "__group", "__base", "__ident", ["__turn", "position"]).where("__turn = 1")
    names = named.select("folder", "position", F.regexp_extract("name", "\0(.*)", 1).alias("name"), "skip")
    return mails.join(names, ["folder", "position"])


def deliver(planned: DataFrame, root: str, suffix: str = ".eml") -> DataFrame:
    """folder, name, written, error of every message of ``planned`` (folder, name, skip, content), once acted upon.

    A message that can't be written is a row with its error; the others are written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for folder, name, skip, content in zip(batch["folder"], batch["name"], batch["skip"], batch["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    done = (name + suffix, False) if skip else write_once(os.path.join(root, folder), name + suffix, bytes(content))
                    out.append((folder, *done, None))
                except (OSError, ValueError) as e:
                    out.append((folder, name + suffix, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["folder", "name", "written", "error"])

    return planned.select("folder", "name", "skip", "content").mapInPandas(run, "folder string, name string, written boolean, error string")


def store_folder(root: str, base: str, identity: str, files: list[tuple[str, bytes]]) -> str:
    """Write one mail's folder: built under a staging name and renamed as a whole, so a folder that is there is complete."""
    staging = os.path.join(root, STAGING + base)
    shutil.rmtree(staging, ignore_errors=True)
    make_folder(staging, private=True)
    write_once(staging, MANIFEST, identity.encode())
    for name, content in files:
        write_once(staging, free_name(staging, name), content)
    target = os.path.join(root, base)
    os.rename(staging, target)
    return target


def store(folders: DataFrame, root: str) -> DataFrame:
    """name, written, error of mail folders (name, identity, files array<struct<name, content>>), once acted upon."""
    safe = F.transform("files", lambda f: F.struct(safe_attachment_name(f["name"]).alias("name"), f["content"].alias("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, identity, files in zip(batch["name"], batch["identity"], batch["files"], strict=True):
                try:
                    known = read_manifest(os.path.join(root, name))
                    if known is None or known != identity.strip():
                        store_folder(root, name, identity, [(f["name"], bytes(f["content"] or b"")) for f in (files if files is not None else ())])
                    out.append((name, known != identity.strip(), None))
                except OSError as e:
                    out.append((name, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "written", "error"])

    return folders.select("name", "identity", safe.alias("files")).mapInPandas(run, "name string, written boolean, error string")


def read_manifest(folder: str) -> str | None:
    """Identity that a mail folder holds, None where there is none to read."""
    try:
        with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
            return f.read().strip()
    except (OSError, UnicodeDecodeError):
        return None


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """name, identity of all mail folders below ``root``, read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", MANIFEST).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("name"), F.trim(F.col("content").cast("string")).alias("identity"))


def sweep_staging(root: str) -> list[str]:
    """Delete what an interrupted run left, and say what."""
    left = sorted(n for n in (os.listdir(root) if os.path.isdir(root) else ()) if n.startswith(STAGING))
    for name in left:
        path = os.path.join(root, name)
        if os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path, ignore_errors=True)
        else:
            os.unlink(path)
    return left


def move_into_folder(message: str, folder: str) -> str | None:
    """Move a rendered mail's file into its folder under the folder's name; None if it has been moved before."""
    if not os.path.exists(message):
        return None
    target = os.path.join(folder, free_name(folder, os.path.basename(folder.rstrip("/")) + ".eml"))
    shutil.move(message, target)
    os.chmod(target, FILE_MODE)
    return target


def backup_name(path: str) -> str:
    """First free name of path.bak, path.bak.1, path.bak.2."""
    k, candidate = 0, f"{path}.bak"
    while os.path.exists(candidate):
        k += 1
        candidate = f"{path}.bak.{k}"
    return candidate


def rewrite_settings(path: str, text: str) -> str | None:
    """Replace a settings file and return its backup; the old file stays if the new one can't be written."""
    saved = None
    if os.path.exists(path):
        saved = backup_name(path)
        shutil.copy2(path, saved)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return saved


def server_outcomes(actions: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``actions`` (account, step, ...) with commands and error: what a server of these capabilities is told.

    ``capabilities``: account, capabilities array<string>.  A server that can't
    expunge a single message is told to mark it, and the rest is an error, as a
    general expunge would take other mail with it.
    """
    can = F.broadcast(capabilities.groupBy("account").agg(F.flatten(F.collect_list(F.transform("capabilities", F.upper))).alias("__can")))  # one row per account
    has = lambda name: F.coalesce(F.array_contains("__can", name), F.lit(False))
    mark = F.array(F.lit("STORE \\Deleted"))
    expunge = F.when(has("UIDPLUS"), F.concat(mark, F.array(F.lit("UID EXPUNGE")))).otherwise(mark)
    moved = F.when(has("MOVE"), F.array(F.lit("MOVE"))).otherwise(F.concat(F.array(F.lit("COPY")), expunge))
    create = F.array(F.lit("CREATE"), F.lit("SUBSCRIBE"))
    commands = F.when(F.col("step") == "label", F.array(F.lit("STORE"))).when(F.col("step") == "move", F.concat(create, moved)).when(F.col("step") == "upload", F.concat(create, F.array(F.lit("APPEND")))).otherwise(expunge)
    stuck = ~has("UIDPLUS") & ((F.col("step") == "delete") | ((F.col("step") == "move") & ~has("MOVE")))
    return actions.join(can, "account", "left").withColumn("commands", commands).withColumn("error", F.when(stuck, "no UIDPLUS: left marked as deleted")).drop("__can")


def digest_of(content: bytes) -> str:
    """Content line of an identity."""
    return "sha256:" + hashlib.sha256(content).hexdigest()
