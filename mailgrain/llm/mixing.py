"""Mixing sources to target weights by balanced sampling (cube method).

A source whose target calls for ``r`` uses of each document gives every document
``floor(r)`` copies and one more with probability ``frac(r)``.  Those extra
copies are drawn by the cube method: inclusion probabilities move through the
null space of two constraints, documents and tokens, until they are 0 or 1.  The
flight runs in parallel blocks of each source; every block leaves at most two
open units, which fly again in the next, far smaller level.  Only the last one
or two units of a source are landed by rounding, so each source misses its token
target by less than two documents.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.runtime import materialise, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
BLOCK_UNITS = 4_096
SEED = 20
_EPS = 1e-9


def token_sizes(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document with a text; empty texts have 0 tokens.

    The vocabulary file lies with the driver and is sent to the executors once.
    """
    documents.sparkSession.sparkContext.addFile(os.path.join(tokenizers, vocabulary))
    source = spread(documents.select("doc_id", "source", "text").where(F.col("text").isNotNull()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(os.path.basename(vocabulary)))
        tokenizer.encode_special_tokens = True
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        for batch in batches:
            sizes = [len(e.ids) for e in encode(batch["text"].tolist(), add_special_tokens=False)] if len(batch) else []
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": pd.Series(sizes, dtype="int64", index=batch.index)})

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {id_type}, source string, tokens long")


def fly(tokens: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: chances moved to 0 or 1 keeping their sum and their token sum.

    At most two units stay open, unless their token counts are equal, then one.
    """
    p = chance.astype(float).tolist()
    t = tokens.astype(float).tolist()
    coins = rng.random(4 * len(p) + 8).tolist()
    waiting = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    waiting.reverse()
    live: list[int] = []

    def step(units: list[int], u: list[float]) -> None:
        up = down = math.inf
        for i, v in zip(units, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        move = up if coins.pop() * (up + down) < down else -down
        for i, v in zip(units, u, strict=True):
            p[i] += move * v
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0

    while True:
        live = [i for i in live if 0.0 < p[i] < 1.0]
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        if len(live) == 3:
            a, b, c = (t[i] for i in live)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            step(live, u)
        elif len(live) == 2 and t[live[0]] == t[live[1]]:
            step(live, [1.0, -1.0])
        else:
            return np.array(p)


def land(tokens: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase of the last open units: the count is kept as far as it is whole, then a coin decides."""
    p = chance.astype(float).copy()
    live = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    while len(live) > 1:
        a, b = live[:2]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        move = up if rng.random() * (up + down) < down else -down
        p[a] += move
        p[b] -= move
        live = [i for i in live if _EPS < p[i] < 1 - _EPS]
    for i in live:
        p[i] = float(rng.random() < p[i])
    return np.rint(p)


def uses_of_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame | None:
    """source, uses: how often each document of a source with a target is used; None if there is nothing to mix.

    Without ``total_tokens`` the mix is as large as the repeat caps allow.  Only
    that size reaches the driver.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    wanted = targets.where("target_share > 0 and source is not null").groupBy("source").agg(
        F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")
    )
    rows = materialise(wanted.join(have, "source"), "mix-sources").where("tokens > 0")
    largest = rows.agg(F.min(F.coalesce("cap", F.lit(1)) * F.col("tokens") / F.col("share"))).first()[0]
    if largest is None:
        return None
    total = largest if total_tokens is None else min(total_tokens, largest)
    return rows.select("source", (F.col("share") * F.lit(float(total)) / F.col("tokens")).alias("uses"))


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, copies of every document in the mix (copies >= 1).

    Documents without text, without tokens or without a target (a null source
    among them) aren't used.  Rows that repeat a doc_id are documents of their own.
    """
    spark = documents.sparkSession
    sizes = materialise(token_sizes(documents, tokenizers, vocabulary).where("tokens > 0"), "token-sizes")
    plan = uses_of_sources(sizes, targets, total_tokens)
    if plan is None:
        return spark.createDataFrame([], sizes.schema).withColumn("copies", F.lit(1))
    units = sizes.join(plan, "source").withColumn("whole", F.floor(F.col("uses") + F.lit(_EPS)).cast("int"))
    units = units.withColumn("chance", F.greatest(F.col("uses") - F.col("whole"), F.lit(0.0))).drop("uses")
    biggest = sizes.groupBy("source").count().agg(F.max("count")).first()[0]
    blocks = max(1, math.ceil(biggest / BLOCK_UNITS))
    done: list[DataFrame] = []
    level, open_units = 0, units
    while True:
        last = blocks == 1
        flown = materialise(_level(open_units, blocks, seed + level, last), f"flight-{level}")
        done.append(flown.where("chance = 0 or chance = 1"))
        if last:
            break
        open_units = flown.where("chance > 0 and chance < 1")
        blocks = max(1, math.ceil(2 * blocks / BLOCK_UNITS))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("copies", (F.col("whole") + F.col("chance")).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def _level(units: DataFrame, blocks: int, seed: int, last: bool) -> DataFrame:
    """One flight of every source in ``blocks`` blocks; the last level also lands."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[1]), *str(key[0]).encode()])
        part = part.sort_values(["order", "doc_id"], kind="stable")
        tokens, chance = part["tokens"].to_numpy(), part["chance"].to_numpy()
        chance = fly(tokens, chance, rng)
        if last:
            chance = land(tokens, chance, rng)
        part["chance"] = chance
        return part[["doc_id", "source", "tokens", "whole", "chance"]]

    fields = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in ("doc_id", "source", "tokens", "whole", "chance"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(blocks)).cast("int")
    return units.select("doc_id", "source", "tokens", "whole", "chance", block.alias("block"), order.alias("order")).groupBy("source", "block").applyInPandas(run, schema)


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """source, target_share, share, documents, tokens, most_copies reached by the mix."""
    used = mixed(documents, targets, total_tokens, tokenizers, vocabulary, seed)
    sums = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    sums = materialise(sums, "mix-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    joined = targets.select("source", "target_share").join(sums, "source", "left").withColumn("all_tokens", F.lit(total))
    return joined.select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
