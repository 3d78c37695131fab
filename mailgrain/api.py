"""One object for everyday work: load rules, plan, audit, restore."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from mailgrain.functions import mime
from mailgrain.operators import audit
from mailgrain.operators import state as st
from mailgrain.plans import fetch, render
from mailgrain.plans import rules as R
from mailgrain.sources import checks, config, mailbox, sinks


class Archive:
    """A mail archive over tables of headers, scans and state.

    Every method returns lazy DataFrames or plans; a dry run is a plan that
    nobody writes.
    """

    def __init__(self, spark: SparkSession, rules: list[R.Rule], env: Mapping[str, str] | None = None):
        self.spark = spark
        self.rules = rules
        self.accounts = config.load_accounts(env or {})
        mime.register(spark)
        mailbox.register(spark)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, env: Mapping[str, str] | None = None) -> Archive:
        """Archive of a rule file; its accounts must be in ``env`` if one is given."""
        known = set(config.load_accounts(env)) if env else None
        return cls(spark, R.load_rules(path, known), env)

    def profiles(self) -> DataFrame:
        """ordinal, name, account, matches, action."""
        rows = [(i, r.name, r.account, R.match_summary(r), R.action_summary(r)) for i, r in enumerate(self.rules)]
        return self.spark.createDataFrame(rows, "ordinal int, name string, account string, matches string, action string")

    def folders(self, listed: DataFrame) -> DataFrame:
        """Folders each rule reads (listed: account, folder, delimiter, flags)."""
        open_ones = mailbox.selectable(listed)
        return R.folder_map(self.spark, self.rules, open_ones, mailbox.trash_folders(listed))

    def fetch(self, messages: DataFrame, state: DataFrame, listed: DataFrame, profile: str | None = None, server_actions: bool = True, archive: DataFrame | None = None, **more: DataFrame) -> fetch.FetchPlan:
        """Plan of a fetch of all rules, or of one; ``more`` are the optional tables of ``fetch.plan``."""
        if profile is not None:
            R.select_rules(self.rules, profile)
            keep = [i for i, r in enumerate(self.rules) if r.name == profile]
            scope = self.folders(listed).where(f"ordinal in ({', '.join(map(str, keep))})")
        else:
            scope = self.folders(listed)
        return fetch.plan(messages, st.migrate(state), self.rules, scope, archive, server_actions, **more)

    def reset(self, state: DataFrame, profile: str | None = None) -> tuple[DataFrame, int]:
        """(state that is kept, rows that go)."""
        kept, gone = st.clear(st.migrate(state), profile)
        return kept, st.migrate(state).where(gone).count()

    def verify(self, files: DataFrame, folders: DataFrame) -> DataFrame:
        """Findings about every profile."""
        profiles = self.spark.createDataFrame([(r.name, r.pdf) for r in self.rules], "profile string, pdf boolean")
        return audit.findings(files, folders, profiles).orderBy("profile", "kind", "detail")

    def deliver(self, messages: DataFrame, root: str, existing: DataFrame | None = None) -> DataFrame:
        """Write messages (folder, base, content, position) as files; rows tell what was written once acted upon."""
        return sinks.deliver(sinks.delivery_names(messages, existing), root)

    def render(self, mails: DataFrame, parts: DataFrame, outcomes: DataFrame, existing: DataFrame | None = None) -> render.RenderPlan:
        """Plan of a render run over the mails of all profiles."""
        return render.render_plan(mails, parts, outcomes, existing)

    def adhoc(self, files: DataFrame, name: str, parts: DataFrame, outcomes: DataFrame, existing: DataFrame | None = None) -> render.RenderPlan:
        """Plan of rendering single files beside themselves."""
        return render.adhoc_plan(files, name, parts, outcomes, existing)

    def doctor(self, rows: list[tuple[str, str, str]]) -> DataFrame:
        """Checks of the environment (see ``sources.checks.standard``)."""
        return checks.checks(self.spark, rows)

    def add_profile(self, path: str, rule: R.Rule) -> str | None:
        """Append a rule and rewrite the rule file; the name of the backup."""
        if any(r.name == rule.name for r in self.rules):
            raise R.ConfigError(f"profile {rule.name!r} is there already")
        self.rules = [*self.rules, rule]
        return self.sync_profiles(path)

    def sync_profiles(self, path: str) -> str | None:
        """Rewrite the rule file in its canonical form; the name of the backup."""
        return sinks.rewrite_settings(path, R.rules_text(self.rules))

    def restore(self, archive: DataFrame, box: DataFrame) -> DataFrame:
        """What a restore would upload and skip."""
        return audit.restore_plan(archive, box)
