"""Mixing sources to target weights.

Tokens are counted once per document and aggregated per source; repetition rates follow from them; each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as probability, a row a copy.
A draw depends on the document's id and the seed only: a lost task draws again the same.

The total size is free. Among the totals at which some source meets its cap (``max_repeats`` times its tokens) the one is
taken that brings the shares nearest to the targets (least sum of absolute differences, then the largest total); a
source beyond its cap is held at it, the others keep their targets relative to the total.

Source names are matched without case, outer blanks and spelling of separators. Documents with a null or
unlisted source, null id or null text are left out; empty texts have no tokens and are emitted like others.
Targets null or below zero count as zero, repeats null or below zero as zero; of repeated target rows the
largest counts. Documents that share an id are copies of their own with the same draw.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tables import Stage, load, small

#: Folder of the public tokenizers' files, and the vocabulary used; both are parameters of ``mix``.
TOKENIZER_DIR = os.environ.get("SPARKWRIGHT_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SEED = 20240229
# Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_batches(path: str, cols: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for pdf in batches:
            pdf["n_tokens"] = pd.Series([len(encode(t)) for t in pdf["text"]], dtype="int64", index=pdf.index)
            yield pdf[cols]

    return run


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Repetition rate of each source; ``targets`` has (share, most repeats)."""
    share = {s: max(0.0, t) for s, (t, _) in targets.items()}
    norm = sum(share.values()) or 1.0
    share = {s: x / norm for s, x in share.items()}
    cap = {s: tokens.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    names = sorted(share)
    want, most = np.array([share[s] for s in names]), np.array([float(cap[s]) for s in names])
    best = None
    for total in sorted({float(m / w) for w, m in zip(want, most) if w > 0 and m > 0}):
        used = np.minimum(most, want * total)
        size = float(used.sum())
        miss = round(float(np.abs(used / size - want).sum()), 9)
        if best is None or (miss, -size) < (best[0], -best[1]):
            best = (miss, size, used)
    used = dict(zip(names, best[2].tolist())) if best else {}
    return {s: used.get(s, 0.0) / tokens[s] if tokens.get(s) else 0.0 for s in share}


def counted(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, source, n_tokens), written once: counting is the expensive part."""
    d = docs.where("doc_id is not null and text is not null and source is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    cols = ["doc_id", "source", "n_tokens"]
    return Stage(spark, "tokens").put(d.mapInPandas(_count_batches(tokenizer_path, cols), "doc_id long, source string, n_tokens long"))


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, tokenizer_path: str = f"{TOKENIZER_DIR}/{TOKENIZER}", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(copies, report): a row per document with its number of copies, and the shares reached per source.

    Only one row per listed source comes to the driver (the targets, a fixed small table).
    """
    t = targets.where("source is not null").select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    tokens = counted(spark, docs, tokenizer_path)
    have = t.join(tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")), "source", "left").collect()
    rate = rates({r["source"]: r["n"] or 0 for r in have}, {r["source"]: (r["target_share"], r["max_repeats"]) for r in have})
    table = spark.createDataFrame([(r["source"], float(r["target_share"]), int(r["max_repeats"]), float(rate[r["source"]]), int(r["n"] or 0)) for r in have], "source string, target_share double, max_repeats int, rate double, available_tokens long")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40)) / float(2**40)
    rate_c = F.col("rate")
    copies = tokens.join(small(table.select("source", "rate", "max_repeats")), "source").select(
        "doc_id", "source", "n_tokens", (F.floor(rate_c) + F.when((draw < rate_c - F.floor(rate_c)) & (F.floor(rate_c) < F.col("max_repeats")), 1).otherwise(0)).cast("int").alias("n_copies")
    )
    sums = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("used_tokens"), F.sum(F.col("n_copies").cast("long")).alias("used_docs"), F.max("n_copies").alias("most_copies"))
    whole = Window.partitionBy(F.lit(1))  # over the few listed sources
    report = table.join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", "rate", "available_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.try_divide(F.coalesce("used_tokens", F.lit(0)), F.sum("used_tokens").over(whole)), F.lit(0.0)).alias("reached_share"),
    )
    return copies, report


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, each emitted as often as it is used: a row a copy, numbered from 1."""
    copies, _ = mix(spark, load(spark, sf_dir, "documents", "doc_id", "source", "text"), load(spark, sf_dir, "mixture_targets"))
    return copies.where("n_copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix(spark, load(spark, sf_dir, "documents", "doc_id", "source", "text"), load(spark, sf_dir, "mixture_targets"))[1]


def p9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source how many documents it has, and that none is used more often than it may and no source is used that has no target."""
    docs = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    copies, report = mix(spark, docs, load(spark, sf_dir, "mixture_targets"))
    have = copies.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    total = F.sum("reached_share").over(Window.partitionBy(F.lit(1)))  # over the few listed sources
    x = report.withColumn("all_shares", total).join(have, "source", "left")
    sound = (F.col("most_copies") <= F.col("max_repeats")) & (F.col("rate") <= F.col("max_repeats") + 1e-9) & (F.abs(F.col("all_shares") - 1) < 1e-9) & ((F.col("target_share") > 0) | (F.col("used_docs") == 0))
    return x.select("source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), sound.alias("sound"))
