"""Mixing sources to target weights, by Pareto order sampling.

Sizes are tokens of a public tokenizer. From the sizes of the sources, the
targets and the repeat limits follow the tokens each source must give. Inside a
source a document's expected copies are proportional to its size, at most the
repeat limit: ``least(max_repeats, rate * n_tokens)``, with the rate at which
the expected tokens of the source are the wanted ones. Whole copies are certain;
the remaining fraction is an inclusion probability p of its own for each
document, and documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)). The first documents in this order, up to the
source's remaining tokens (a fixed size), get one copy more.

A source's rate depends on its documents' sizes only, so it is found on counts
per distinct size, not on documents. The cut in the order is found without
sorting a source: ranks fall into ``BINS`` bins, bins are summed, and only the
bin in which the target is reached is looked at document by document, in finer
bins, until a bin holds few documents. Random numbers are hashes of the document
id and the seed, so a task that runs again draws the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.session import blank_to_null, reliable_checkpoint

#: Folder of the public tokenizers' vocabularies.
TOKENIZER_DIR = os.environ.get("VULNLAKE_TOKENIZERS", "/opt/tokenizers")
#: Bins per round of the search for the cut, and rounds: 4096**2 bins in all.
BINS, ROUNDS = 4096, 2
_UNIT = float(1 << 52)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE whose ranks are in ``path``."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # Fixed value: the public pattern that splits texts before byte-pair encoding.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str, stretch: int = 1 << 16) -> int:
    """Tokens of a whole text. Long texts are encoded stretch by stretch, cut where
    a space begins, at which no token goes over: the sum is exact."""
    if not text:
        return 0
    encoder, at, total = _encoder(path), 0, 0
    while at < len(text):
        end = min(len(text), at + stretch)
        if end < len(text):
            gap = text.rfind(" ", at + 1, end)
            gap = gap if gap > at else text.find(" ", end)
            end = gap if gap > at else len(text)
        total += len(encoder.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts_udf(path: str):
    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: count_tokens(text, path)).astype("int64")

    return count


def document_sizes(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents whose source has a target.

    Materialised in the shared checkpoint folder: the texts are read and
    tokenised once, and what follows works on three numbers per document.
    """
    path = tokenizer or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    named = documents.where("doc_id is not null").select("doc_id", blank_to_null(F.col("source")).alias("source"), "text")
    wanted = named.join(clean_targets(targets).select("source"), "source", "left_semi")
    return reliable_checkpoint(wanted.select("doc_id", "source", token_counts_udf(path)("text").alias("n_tokens")))


def clean_targets(targets: DataFrame) -> DataFrame:
    """One positive target per named source; of several rows the first by value counts."""
    good = targets.select(
        blank_to_null(F.col("source")).alias("source"),
        F.col("target_share").cast("double").alias("target_share"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"),
    ).where("source is not null and target_share > 0")
    return good.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")


def allocate(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: ``target_share, max_repeats, available, wanted``.

    ``wanted`` is the source's tokens in the mix, at most ``max_repeats`` times what
    is available. Without
    ``total_tokens`` the mix is the largest in which all sources that have
    tokens meet their targets relative to each other; with it, sources that
    cannot reach their share give what they can.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_documents"))
    plan = clean_targets(targets).join(have, "source", "left").fillna({"available": 0, "n_documents": 0})
    limit = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        reach = F.min(F.when(limit > 0, limit / F.col("target_share"))).over(Window.partitionBy(F.lit(1)))
    else:
        reach = F.lit(float(total_tokens))
    wanted = F.least(F.coalesce(reach, F.lit(0.0)) * F.col("target_share"), limit.cast("double"))
    return plan.withColumn("wanted", wanted)


def expected_copies(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, n_tokens, whole, p, rest``, one row per distinct size of a source.

    With documents in falling size, those at the limit come first. For each size
    as the first one below the limit follows a rate; the largest size that this
    rate keeps within the limit is the right one. ``rest`` is what remains of the
    source's wanted tokens after the whole copies. Documents of size 0 get none.
    """
    counts = sizes.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    known = counts.join(plan.where("wanted > 0").select("source", "wanted", F.col("max_repeats").cast("double").alias("most")), "source")
    by_size = Window.partitionBy("source").orderBy(F.col("n_tokens").desc())
    larger = by_size.rowsBetween(Window.unboundedPreceding, -1)
    others = by_size.rowsBetween(0, Window.unboundedFollowing)
    n, t = F.col("n").cast("double"), F.col("n_tokens").cast("double")
    rate = (F.col("wanted") - F.col("most") * F.coalesce(F.sum(n * t).over(larger), F.lit(0.0))) / F.sum(n * t * t).over(others)
    rated = known.withColumn("rate", F.greatest(rate, F.lit(0.0)))
    fits = F.when(F.col("rate") * t <= F.col("most") * (1 + 1e-9), F.struct("n_tokens", "rate"))
    whole_source = Window.partitionBy("source")
    found = rated.withColumn("found", F.max(fits).over(whole_source)["rate"])
    copies = F.least(F.col("most"), F.coalesce("found", F.col("most") / F.min(t).over(whole_source)) * t)
    whole = F.floor(copies + 1e-9)
    split = found.withColumns({"whole": whole.cast("bigint"), "p": F.when(copies - whole > 1e-9, copies - whole).otherwise(0.0)})
    rest = F.col("wanted") - F.sum(F.col("whole") * F.col("n") * F.col("n_tokens")).over(whole_source)
    return split.withColumn("rest", rest).select("source", "n_tokens", "whole", "p", "rest")


def _ordered(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents with their certain copies and their place in the Pareto order.

    The place is a whole number below 2**52 that grows with the order. Written
    once: the search for the cut and the selection read it several times.
    """
    joined = sizes.join(expected_copies(sizes, plan), ["source", "n_tokens"])
    random = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / F.lit(_UNIT)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return reliable_checkpoint(
        joined.withColumn("u", random)
        .withColumn("odds", F.when((F.col("p") > 0) & (F.col("rest") > 0), odds))
        .withColumn("place", F.floor(F.col("odds") / (1 + F.col("odds")) * F.lit(_UNIT)).cast("bigint"))
        .select("doc_id", "source", "n_tokens", "whole", "rest", "place")
    )


def _cuts(ordered: DataFrame) -> DataFrame:
    """``source, low, high, left``: the narrow bin in which the remaining tokens of a
    source are reached, and the tokens left for that bin."""
    width = 1 << 52
    state = ordered.where("place is not null").groupBy("source").agg(F.max("rest").alias("left")).withColumn("low", F.lit(0).cast("bigint"))
    for _ in range(ROUNDS):
        step = width // BINS
        inside = ordered.where("place is not null").select("source", "place", "n_tokens").join(state, "source")
        inside = inside.where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(width)))
        binned = inside.groupBy("source", F.floor((F.col("place") - F.col("low")) / F.lit(step)).cast("bigint").alias("bin")).agg(F.sum("n_tokens").alias("tokens"))
        before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        summed = binned.withColumn("before", before).join(state, "source")
        reached = summed.where(F.col("before") < F.col("left")).groupBy("source").agg(F.max(F.struct("bin", "before", "left", "low")).alias("s"))
        state = reached.select(
            "source", (F.col("s.left") - F.col("s.before")).alias("left"), (F.col("s.low") + F.col("s.bin") * F.lit(step)).cast("bigint").alias("low")
        )
        width = step
    return state.withColumn("high", (F.col("low") + F.lit(width)).cast("bigint"))


def select_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the selected documents.

    Documents without tokens add nothing to a share and are not selected; null or unlisted
    sources, and sources without documents, give nothing. A source's tokens miss
    its wanted size by less than one document. Empty tables give an empty result.
    """
    plan = reliable_checkpoint(allocate(sizes, targets, total_tokens))
    ordered = _ordered(sizes, plan, seed)
    cuts = reliable_checkpoint(_cuts(ordered))
    placed = ordered.join(cuts, "source", "left")
    # Inside the last bin (1 in 4096**2 of a source's order) documents are taken one by one.
    inside = placed.where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # A document over the end is taken if at least half of it is still wanted.
    taken = inside.withColumn("extra", ((running - F.col("n_tokens") / 2) <= F.col("left")).cast("bigint"))
    outside = placed.where(~F.coalesce((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")), F.lit(False)))
    outside = outside.withColumn("extra", F.coalesce((F.col("place") < F.col("low")).cast("bigint"), F.lit(0).cast("bigint")))
    chosen = outside.unionByName(taken).withColumn("copies", F.col("whole") + F.col("extra"))
    return chosen.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix_shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """What each target source really got: ``source, target_share, actual_share,
    available_tokens, mix_tokens, n_documents, max_copies``."""
    got = (
        select_mix(sizes, targets, total_tokens, seed)
        .groupBy("source")
        .agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("max_copies"))
    )
    plan = allocate(sizes, targets, total_tokens).select("source", "target_share", F.col("available").alias("available_tokens"))
    shares = plan.join(got, "source", "left").fillna({"mix_tokens": 0, "n_documents": 0, "max_copies": 0})
    total = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))
    share = F.when(total > 0, F.col("mix_tokens") / total).otherwise(F.lit(0.0))
    return shares.withColumn("actual_share", F.round(share, 6)).select(
        "source", "target_share", "actual_share", "available_tokens", "mix_tokens", "n_documents", "max_copies"
    )
