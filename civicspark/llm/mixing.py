"""Mixes of sources with target shares of the tokens.

Tokens are counted with a public tokenizer and added up for each source.  The
repetition rate of a source is what the mix wants of it divided by what it
has, up to the cap; a document is emitted floor(rate) times, and once more
with the probability of the fraction, decided by a hash of its id, so the
result is the same however the data are partitioned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import cut

#: How the tokenizers of this kind cut text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_tokenizer() -> str:
    """The path of the installed byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id``, ``source`` and ``tokens`` of each document; a null or empty text has none.

    ``tokenizer`` is the path of a vocabulary file of ranks, readable on the executors.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "tokens"])

    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return given.where("doc_id is not null and source is not null").mapInArrow(run, "doc_id long, source string, tokens long")


def _rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The repetition rate of each source in each mix.

    A mix wants ``budget_ratio`` times the tokens of all documents, divided by
    the relative weights of its sources.  Null, negative and unknown numbers
    count as 0, a null cap as none; a source listed twice in a mix counts with
    the sum of its weights and the smaller cap.
    """
    have = counts.groupBy("source").agg(F.sum("tokens").alias("have"))
    total = have.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("total"))
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.min("max_repeats").alias("cap"), F.max(F.coalesce("budget_ratio", F.lit(0.0))).alias("ratio"),
    )
    weights = wanted.groupBy("mix_id").agg(F.sum("weight").alias("all"))
    share = F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(0.0)
    return (
        wanted.join(weights, "mix_id").join(F.broadcast(total)).join(have, "source", "left")
        .select("mix_id", "source", share.alias("target_share"), "cap", F.coalesce("have", F.lit(0)).alias("have"), (share * F.col("ratio") * F.col("total")).alias("wanted"))
        .withColumn("rate", F.when(F.col("have") > 0, F.least(F.col("wanted") / F.col("have"), F.coalesce(F.col("cap").cast("double"), F.lit(float("inf"))))).otherwise(0.0))
    )


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mixes and their report.

    The first table has a row for each copy: ``mix_id``, ``doc_id``,
    ``source``, ``copy`` (from 1) and ``tokens``.  The second one has for each
    mix and source ``target_share``, ``wanted_tokens``, ``rate``, ``documents``
    used, ``tokens`` reached and ``actual_share``.  A source that is absent or
    whose cap is reached falls short; its part isn't given to others, so theirs
    stays what was wanted.
    """
    counts = cut(token_counts(documents, tokenizer))
    # one row for each mix and source: bounded by the table of targets
    rates = cut(_rates(counts, targets))
    luck = F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    drawn = counts.join(rates.select("mix_id", "source", "rate"), "source").select("mix_id", "doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")
    mixed = drawn.select("mix_id", "doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")
    reached = drawn.groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    sums = reached.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    report = (
        rates.join(reached, ["mix_id", "source"], "left").join(sums, "mix_id", "left")
        .select(
            "mix_id", "source", "target_share", F.col("wanted").alias("wanted_tokens"), "rate", F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        )
    )
    return mixed, report
