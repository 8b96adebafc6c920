"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets its share of the largest total that all sources can supply. A document's expected use is
the same ratio of its source's need to its source's tokens for all documents of the source; the whole part is certain,
the fraction is an inclusion probability. The cube method's flight moves these fractions along the null space of
the balancing constraints (number of documents, tokens), so both totals stay exactly as they are, until at most as many
fractions are left per block as there are constraints. Blocks of bounded size fly in parallel, their leftovers meet again in further
rounds, and only a landing problem of a few documents per source is left at the end.

A source that holds most of all rows is spread over many blocks; nothing but each block is held in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vedomost.llm.tokens import TOKENIZER_DIR, count_column
from vedomost.session import cut_lineage, spread

BLOCK_DOCS = 4_000
EPS = 1e-9
#: Targets are a short list; its length is checked before it is broadcast.
MAX_TARGETS = 10_000


def flight(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The cube method's flight phase: ``pi`` moved until at most as many fractions as constraints are left.

    ``balance`` has one row per document and one column per total that is to stay; totals of ``pi`` times
    balance are kept up to rounding, each step keeps every probability's expectation.
    """
    pi = pi.astype("float64").copy()
    width = balance.shape[1] + 1
    todo = list(np.flatnonzero((pi > EPS) & (pi < 1 - EPS)))
    active, todo = todo[:width], todo[width:]
    while len(active) == width or (active and len(active) > 0 and _rank(balance[active]) < len(active)):
        u = _null_vector(balance[active])
        p = pi[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > EPS, (1 - p) / u, np.where(u < -EPS, -p / u, np.inf)).min()
            down = np.where(u > EPS, p / u, np.where(u < -EPS, (p - 1) / u, np.inf)).min()
        pi[active] = np.clip(p + u * (up if rng.random() * (up + down) < down else -down), 0.0, 1.0)
        keep = [i for i in active if EPS < pi[i] < 1 - EPS]
        active = keep + todo[: width - len(keep)]
        todo = todo[width - len(keep) :]
    pi[pi <= EPS], pi[pi >= 1 - EPS] = 0.0, 1.0
    return pi


def _rank(a: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(a / np.maximum(np.abs(a).max(axis=0), 1e-300)))


def _null_vector(a: np.ndarray) -> np.ndarray:
    """A vector u with u @ a = 0."""
    if a.shape == (3, 2):
        u = np.cross(a[:, 0], a[:, 1])
        if (size := np.abs(u).max()) > 0:
            return u / size
    scaled = a / np.maximum(np.abs(a).max(axis=0), 1e-300)
    return np.linalg.svd(scaled.T)[2][-1]


def landing(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The few fractions left become 0 or 1 so that the token total is as near as can be, then the number of documents."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))  # the flight leaves as many as there are constraints at most
    want_t, want_n = (pi[open_] * tokens[open_]).sum(), pi[open_].sum()
    best = min(range(1 << len(open_)), key=lambda b: (abs(sum(tokens[i] for k, i in enumerate(open_) if b >> k & 1) - want_t), abs(bin(b).count("1") - want_n), b))
    out = np.round(pi)
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    return out


def plan_shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``(source, target_share, max_repeats, n_docs, available_tokens, need_tokens, ratio)``.

    The total is the largest that every present source can supply within its max_repeats. Sources without any token
    cannot contribute; the shares of the others keep their proportions. Of repeated target rows the greatest counts.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("available_tokens"))
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    t = t.join(have, "source", "left").fillna(0, ["n_docs", "available_tokens"])
    unit = F.min(F.when(F.col("available_tokens") > 0, F.col("available_tokens") * F.col("max_repeats") / F.col("target_share"))).over(Window.partitionBy(F.lit(1)))
    need = F.when(F.col("available_tokens") > 0, F.col("target_share") * unit).otherwise(F.lit(0.0))
    t = t.withColumn("need_tokens", need)
    return t.withColumn("ratio", F.when(F.col("available_tokens") > 0, F.col("need_tokens") / F.col("available_tokens")).otherwise(F.lit(0.0)))


def _fly(seed: int, last: bool):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("doc_id", kind="stable")
        tokens = docs["tokens"].to_numpy("float64")
        rng = np.random.default_rng([seed, *map(ord, str(key[0])), int(key[1])])
        order = rng.permutation(len(docs))  # the order of the flight must not follow the ids
        pi = np.empty(len(docs))
        pi[order] = flight(docs["pi"].to_numpy()[order], np.column_stack([np.ones(len(docs)), tokens])[order], rng)
        return docs.assign(pi=landing(pi, tokens) if last else pi)[["doc_id", "source", "tokens", "pi", "block"]]

    return run


def mix_documents(documents: DataFrame, targets: DataFrame, seed: int = 42, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """A mixture and its report: ``(doc_id, source, tokens, repeats)`` and
    ``(source, target_share, max_repeats, n_docs, available_tokens, need_tokens, used_docs, used_tokens, actual_share)``.

    Documents without tokens, without a source or of a source that is no target are never used; a target without documents
    stands in the report with share 0. No document is used more than max_repeats times. An
    empty table gives an empty mixture. Equal seeds give equal mixtures, whatever the partitioning.
    """
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError("more targets than MAX_TARGETS")
    sized = documents.where("source IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "source", count_column(tokenizer, directory)("text").cast("long").alias("tokens"))
    sized = cut_lineage(sized.where("tokens > 0"))  # ids and sizes only; the texts are read and encoded once
    shares = cut_lineage(plan_shares(sized, targets))
    whole = F.floor(F.col("ratio") + EPS)
    plan = shares.select("source", "n_docs", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("pi"))
    drawn = sized.join(F.broadcast(plan), "source")  # at most MAX_TARGETS rows
    blocks = F.ceil(F.col("n_docs") / F.lit(block_docs))
    todo = drawn.where(F.col("pi") > EPS).select("doc_id", "source", "tokens", "pi", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), blocks).alias("block"))
    most = shares.agg(F.max("n_docs")).first()[0] or 0
    n_blocks, chosen = max(1, -(-most // block_docs)), None
    while True:
        last = n_blocks == 1
        flown = cut_lineage(spread(todo, "source", "block").groupBy("source", "block").applyInPandas(_fly(seed, last), "doc_id long, source string, tokens long, pi double, block long"))
        done = flown.where("pi = 1").select("doc_id")
        chosen = done if chosen is None else chosen.unionByName(done)
        if last:
            break
        merged = max(2, block_docs // 4)  # leftovers of so many blocks fit one block again
        todo = flown.where("pi > 0 AND pi < 1").withColumn("block", F.floor(F.col("block") / merged))
        n_blocks = -(-n_blocks // merged)
    picked = drawn.join(chosen.withColumn("extra", F.lit(1)), "doc_id", "left")
    mixture = picked.select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("repeats")).where("repeats > 0")
    used = mixture.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    report = shares.drop("ratio").join(used, "source", "left").fillna(0, ["used_docs", "used_tokens"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return mixture, report.withColumn("actual_share", F.when(total > 0, F.round(F.col("used_tokens") / total, 6)).otherwise(F.lit(0.0)))
