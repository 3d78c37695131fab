"""Evaluation texts leaking into training text: latent semantic retrieval with exact checks.

Items and documents are cut into word passages.  TF-IDF weights (document
frequencies over all documents) restricted to the items' vocabulary are reduced
by a randomised SVD whose matrix products run as distributed sums; every
document passage is folded in and compared with all item passages in one block
product.  Document/item pairs above the cosine bound are then checked on the
whole document: longest common run of words, longest common subsequence, and the
share of the item's answer words found.  The passage geometry guarantees that
``RUN`` shared words lie in one passage of either side.

Texts are read once and kept as word numbers of the items' vocabulary; word
frequencies, the fit and the search work on these.  The fit is bounded: all item
passages and at most ``FIT_DOCUMENTS`` documents.  The search covers every
document that has a passage to fold in.  Items go through in blocks of
``ITEM_BLOCK``, so what is broadcast never exceeds the model of one block.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.runtime import materialise, spread

RUN = 13
DOC_WINDOW, DOC_STEP = 20, 8
ITEM_WINDOW, ITEM_STEP = 16, 4
RANK, OVERSAMPLE, POWER_STEPS = 256, 16, 2
MIN_COSINE = 0.6
#: Words of the items' vocabulary a document passage needs before it is folded in (below RUN, so no run is lost).
MIN_KNOWN = 8
ITEM_BLOCK = 2_000
FIT_DOCUMENTS = 4_096
#: Share of the item in common order, and of its answer words, from which a pair without a run is a paraphrase.
PARAPHRASE_LCS, PARAPHRASE_ANSWERS = 0.5, 0.8

_WORD = re.compile(r"[^\W_]+")
_FOOTER = re.compile(r"\n\s*\n")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower case, compatibility forms folded, invisible characters dropped."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text.lower())


def item_words(text: str) -> list[str]:
    """Words of an item without the footer after its first blank line."""
    return words(_FOOTER.split(text.strip(), maxsplit=1)[0])


def windows(n: int, width: int, step: int) -> list[tuple[int, int]]:
    """Spans such that every run of ``width - step + 1`` words lies in one of them."""
    return [(s, min(s + width, n)) for s in range(0, max(1, n - (width - step)), step)]


def weigh(ids: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector of word ids as (ids, weights)."""
    u, c = np.unique(np.asarray(ids, dtype=np.int64), return_counts=True)
    v = (1.0 + np.log(c)) * idf[u]
    return u, v / np.linalg.norm(v)


def numbered(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, ids, live: the words of every text by their numbers, -1 for words of no item.

    ``live`` says whether some passage holds enough known words to be folded in.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value.get
        for batch in batches:
            ids = [[number(w, -1) for w in words(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": pd.Series(ids, dtype=object, index=batch.index), "live": [bool(known_passages(x)) for x in ids]})

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInPandas(run, f"doc_id {id_type}, ids array<int>, live boolean")


def document_frequencies(tokens: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents holding each word of the vocabulary, and the number of documents; counted over all."""
    held = tokens.select(F.explode(F.array_distinct("ids")).alias("w")).where("w >= 0")
    df = np.zeros(size)
    for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["w"]] = r["n"]
    return df, tokens.count()


def gram_product(passages: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(AᵀA) @ right for the TF-IDF matrix A of the passages, summed over tasks in row blocks."""
    size, width, block = right.shape[0], right.shape[1], 256
    shared = passages.sparkSession.sparkContext.broadcast((idf, right.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, matrix = shared.value
        total = np.zeros((size, width), dtype=np.float64)
        for batch in batches:
            for ids in batch["ids"]:
                u, v = weigh(ids, weights)
                total[u] += np.outer(v, v @ matrix[u])
        yield pd.DataFrame([(b, total[b : b + block].tobytes()) for b in range(0, size, block)], columns=["b", "m"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, dtype=np.float64) for m in part["m"])
        return pd.DataFrame([(int(key[0]), np.asarray(total).tobytes())], columns=["b", "m"])

    rows = passages.mapInPandas(run, "b int, m binary").groupBy("b").applyInPandas(add, "b int, m binary").collect()
    out = np.zeros((size, width))
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), dtype=np.float64).reshape(-1, width)
        out[r["b"] : r["b"] + len(part)] = part
    return out


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix (randomised, power iterations)."""
    size = len(idf)
    rank = min(rank, size)
    width = min(size, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((size, width)))[0]
    for _ in range(POWER_STEPS):
        q = np.linalg.qr(gram_product(passages, idf, q))[0]
    small = q.T @ gram_product(passages, idf, q)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def fold_in(rows: list[list[int]], basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages given as word ids."""
    if not rows:
        return np.empty((0, basis.shape[1]), dtype=np.float32)
    size = len(idf)
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
    of = np.repeat(np.arange(len(rows), dtype=np.int64), [len(r) for r in rows])
    cells, counts = np.unique(of * size + flat, return_counts=True)
    row, word = np.divmod(cells, size)
    weights = ((1.0 + np.log(counts)) * idf[word]).astype(np.float32)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
    vectors = np.add.reduceat(weights[:, None] * basis[word], begins, axis=0)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def word_runs(ids: list[int]) -> dict[tuple[int, ...], list[int]]:
    """Where each run of RUN known words begins."""
    out: dict[tuple[int, ...], list[int]] = {}
    unknown = -1
    for k, x in enumerate(ids):
        if x < 0:
            unknown = k
        if k - unknown >= RUN:
            out.setdefault(tuple(ids[k - RUN + 1 : k + 1]), []).append(k - RUN + 1)
    return out


def longest_run(a: list[int], b: list[int], a_runs: dict, b_runs: dict) -> int:
    """Length of the longest run of words common to both sequences, 0 if it is under RUN."""
    best = 0
    for gram in a_runs.keys() & b_runs.keys():
        for i in a_runs[gram]:
            for j in b_runs[gram]:
                if i and j and a[i - 1] == b[j - 1] >= 0:
                    continue  # counted from where the run begins
                n = RUN
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
    return best


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        m = places.get(x)
        if m:
            kept = row & m
            row = ((row + kept) | (row - kept)) & full
    return len(b) - row.bit_count()


def leaks(documents: DataFrame, eval_items: DataFrame, rank: int = RANK, min_cosine: float = MIN_COSINE, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, cosine, run, lcs_share, answer_share, kind of every leaking document and item.

    ``kind`` is "verbatim" (RUN or more consecutive words) or "paraphrase" (``run``
    is 0 there).  Null and empty texts and items under RUN words give no row;
    repeated documents give repeated rows.  Other columns are not read.
    """
    spark = documents.sparkSession
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (eval_items, "item_id")))
    schema = f"doc_id {id_type}, item_id {item_type}, cosine float, run int, lcs_share double, answer_share double, kind string"
    rows = eval_items.select("item_id", "text").where("text is not null").distinct().collect()
    texts = sorted(((r["item_id"], w) for r, w in ((r, item_words(r["text"])) for r in rows) if len(w) >= RUN), key=lambda x: (str(x[0]), x[1]))
    if not texts:
        return spark.createDataFrame([], schema)
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, x in texts for w in x}))}
    source = spread(documents.select("doc_id", "text").where(F.length("text") > 0))
    tokens = materialise(numbered(source, vocabulary), "numbered-words")
    df, total = document_frequencies(tokens, len(vocabulary))
    idf = np.log((total + 1) / (df + 1)) + 1.0
    out = None
    for at in range(0, len(texts), item_block):
        block = [(i, [vocabulary[w] for w in x]) for i, x in texts[at : at + item_block]]
        part = _leaks_of_block(tokens, block, idf, schema, rank, min_cosine)
        out = part if out is None else out.unionByName(part)
    return out


def _leaks_of_block(tokens: DataFrame, block: list[tuple], idf_all: np.ndarray, schema: str, rank: int, min_cosine: float) -> DataFrame:
    spark = tokens.sparkSession
    # numbers within the block: its words only, so that the model is as large as the block
    used = np.unique(np.concatenate([np.asarray(x) for _, x in block]))
    local = np.full(len(idf_all) + 1, -1, dtype=np.int32)  # the last place serves -1
    local[used] = np.arange(len(used), dtype=np.int32)
    idf = idf_all[used]
    item_ids = [local[np.asarray(x)].tolist() for _, x in block]
    passages = [(k, ids[s:e]) for k, ids in enumerate(item_ids) for s, e in windows(len(ids), ITEM_WINDOW, ITEM_STEP)]
    numbers = spark.sparkContext.broadcast(local)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ids": [p for x in batch["ids"] for p in known_passages(numbers.value[x].tolist())]})

    slots = max(1, spark.sparkContext.defaultParallelism)
    sample = tokens.orderBy(F.xxhash64("doc_id")).limit(FIT_DOCUMENTS).where("live").select("ids").repartition(slots).mapInPandas(cut, "ids array<int>")
    fit_rows = spark.createDataFrame([(p,) for _, p in passages], "ids array<int>").unionByName(sample).repartition(slots)
    basis = latent_basis(materialise(fit_rows, "fit-passages"), idf, rank)

    owner = np.array([k for k, _ in passages])
    answers = [set(sorted(set(ids), key=lambda w: (-idf[w], w))[: max(3, len(set(ids)) // 8)]) for ids in item_ids]
    shared = spark.sparkContext.broadcast((basis, idf, fold_in([p for _, p in passages], basis, idf), owner, item_ids, answers, [i for i, _ in block]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, idf, latent, owner, item_ids, answers, names = shared.value
        item_runs = [word_runs(x) for x in item_ids]

        for batch in batches:
            out = []
            docs = [numbers.value[x].tolist() for x in batch["ids"]]
            rows, of = [], []
            for k, ids in enumerate(docs):
                for p in known_passages(ids):
                    rows.append(p)
                    of.append(k)
            best: dict[tuple[int, int], float] = {}
            for at in range(0, len(rows), 1024):
                cosine = fold_in(rows[at : at + 1024], basis, idf) @ latent.T
                for r, c in zip(*np.nonzero(cosine >= min_cosine), strict=True):
                    pair = of[at + r], int(owner[c])
                    best[pair] = max(best.get(pair, 0.0), float(cosine[r, c]))
            runs_of: dict[int, dict] = {}
            words_of: dict[int, set[int]] = {}
            for (k, item), cosine in best.items():
                if k not in runs_of:
                    runs_of[k], words_of[k] = word_runs(docs[k]), set(docs[k])
                run = longest_run(docs[k], item_ids[item], runs_of[k], item_runs[item])
                found = len(answers[item] & words_of[k]) / len(answers[item])
                if not run and found < PARAPHRASE_ANSWERS:
                    continue
                share = common_subsequence(docs[k], item_ids[item]) / len(item_ids[item])
                if not run and share < PARAPHRASE_LCS:
                    continue
                kind = "verbatim" if run else "paraphrase"
                out.append((batch["doc_id"].iloc[k], names[item], cosine, run, share, found, kind))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "run", "lcs_share", "answer_share", "kind"])

    return spread(tokens.where("live").select("doc_id", "ids")).mapInPandas(search, schema)


def known_passages(ids: list[int]) -> list[list[int]]:
    """Known words of each document window that holds at least MIN_KNOWN of them."""
    out = []
    for s, e in windows(len(ids), DOC_WINDOW, DOC_STEP):
        known = [i for i in ids[s:e] if i >= 0]
        if len(known) >= MIN_KNOWN:
            out.append(known)
    return out
