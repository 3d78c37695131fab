"""Checks of the environment as rows."""

from __future__ import annotations

import importlib.metadata
import json
import os
import platform
import shutil
import tempfile
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from mailgrain.errors import SourceError, ToolMissing
from mailgrain.plans.rules import load_rules
from mailgrain.sources.config import load_accounts

OK, WARN, FAIL = "OK", "WARN", "FAIL"


def tool(name: str, *candidates: str) -> tuple[str, str, str]:
    """First of several programs on the path."""
    for c in candidates or (name,):
        found = shutil.which(c)
        if found:
            return name, OK, found
    return name, FAIL, "not found"


def browser_revision(text: str, name: str = "chromium") -> str | None:
    """Revision of a browser in a browsers file; None if absent or unreadable."""
    try:
        return next((str(b["revision"]) for b in json.loads(text)["browsers"] if b.get("name") == name), None)
    except (ValueError, KeyError, TypeError):
        return None


def probe(name: str, test: Callable[[], str]) -> tuple[str, str, str]:
    """Result of a test that returns a detail or raises."""
    try:
        return name, OK, test()
    except Exception as e:  # noqa: BLE001 - a failing check is a row
        return name, FAIL, f"{type(e).__name__}: {e}"


def tools(wanted: dict[str, tuple[str, ...]], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Path of every program (name -> candidates), an override first; ToolMissing names all that aren't there."""
    found = {name: next((p for c in ((overrides or {}).get(name), *candidates) if c and (p := shutil.which(c))), None) for name, candidates in wanted.items()}
    missing = sorted(n for n, p in found.items() if p is None)
    if missing:
        raise ToolMissing(", ".join(missing))
    return found


def _present(path: str) -> str:
    if not os.path.exists(path):
        raise SourceError(f"not found: {path}")
    return path


def _writable(path: str) -> str:
    with tempfile.TemporaryFile(dir=path):
        return path


def standard(rules_file: str, outputs: list[str], state: str, programs: dict[str, tuple[str, ...]], env: Mapping[str, str], login: Callable[[object], str] | None = None) -> list[tuple[str, str, str]]:
    """Rows of all usual checks: interpreter, engine, programs, rule file, accounts, state, outputs, and logins if a function for them is given."""
    rows = [probe("python", platform.python_version), probe("pyspark", lambda: importlib.metadata.version("pyspark"))]
    rows += [tool(name, *candidates) for name, candidates in programs.items()]
    rows += [probe("rules", lambda: f"{len(load_rules(rules_file))} profiles"), probe("accounts", lambda: ", ".join(sorted(load_accounts(env))) or "none"), probe("state", lambda: _present(state))]
    rows += [probe(f"output {path}", lambda path=path: _writable(path)) for path in outputs]
    if login is not None:
        rows += [probe(f"login {name}", lambda a=account: login(a)) for name, account in load_accounts(env).items()]
    return rows


def checks(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """name, status, detail."""
    return spark.createDataFrame(list(rows), "name string, status string, detail string")
