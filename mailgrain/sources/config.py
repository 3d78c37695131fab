"""Accounts of an environment and small driver-side tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.errors import ConfigError

# Settings are named IMAP_<ACCOUNT>_<FIELD>; these words say yes.
PREFIX, FIELDS, YES = "IMAP_", ("HOST", "PORT", "USER", "PASSWORD", "SSL"), ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Account:
    """A mail account; the password stays on the driver."""

    name: str
    host: str
    user: str
    password: str
    port: int = 993
    ssl: bool = True

    def __repr__(self) -> str:
        return f"Account({self.name!r}, {self.host!r}, {self.port}, ssl={self.ssl})"


def setting_of(key: str) -> tuple[str, str] | None:
    """(account, field) that a setting belongs to, or None."""
    if not key.startswith(PREFIX):
        return None
    account, _, name = key[len(PREFIX) :].rpartition("_")
    return (account.lower(), name) if account and name in FIELDS else None


def load_accounts(env: Mapping[str, str]) -> dict[str, Account]:
    """Accounts by lower-case name; ConfigError for an incomplete one."""
    settings = {place: value for key, value in env.items() if (place := setting_of(key)) and value is not None}
    out = {}
    for name in dict.fromkeys(account for account, _ in settings):
        host, port, user, password, ssl = (settings.get((name, f)) for f in FIELDS)
        if host is None or user is None or password is None:
            raise ConfigError(f"account {name}: host, user and password are needed")
        if port is not None and not port.strip().isdigit():
            raise ConfigError(f"account {name}: bad port {port!r}")
        out[name] = Account(name, host, user, password, 993 if port is None else int(port), ssl is None or ssl.strip().lower() in YES)
    return out


def accounts_frame(spark: SparkSession, accounts: Mapping[str, Account]) -> DataFrame:
    """name, host, port, user, ssl; never the password."""
    return spark.createDataFrame([(a.name, a.host, a.port, a.user, a.ssl) for a in accounts.values()], "name string, host string, port int, user string, ssl boolean")


def pivot_accounts(pairs: DataFrame) -> DataFrame:
    """One row per account of key/value rows (key ``IMAP_<ACCOUNT>_<FIELD>``)."""
    inner = F.substr("key", F.lit(len(PREFIX) + 1))
    field = F.substring_index(inner, "_", -1)
    name = F.lower(F.substr(inner, F.lit(1), F.length(inner) - F.length(field) - 1))
    keyed = pairs.where(F.startswith("key", F.lit(PREFIX))).select(name.alias("name"), field.alias("field"), "value").where(F.length("name") > 0)
    wide = keyed.where(F.col("field").isin(*FIELDS)).groupBy("name").pivot("field", [f for f in FIELDS if f != "PASSWORD"]).agg(F.max("value"))
    return wide.select(
        "name", F.col("HOST").alias("host"), F.coalesce(F.col("PORT").try_cast("int"), F.lit(993)).alias("port"), F.col("USER").alias("user"),
        (F.col("SSL").isNull() | F.lower(F.trim("SSL")).isin(*YES)).alias("ssl"),
    )
