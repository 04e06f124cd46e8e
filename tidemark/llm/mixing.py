"""Mixing sources to target weights: subset-sum budget fitting on token lengths.

Documents are counted by source and exact token length. From the counts alone a plan is made for each
source: whole copies of all documents, then a proportional part of every length, then a bounded knapsack
by dynamic programming over the copies still allowed, which hits the remaining budget exactly where that is
possible. The plan says how often the documents of each length are used, no document more than once oftener
than another of its length; which ones get the one copy more is decided by a seeded hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

#: Budget left for the dynamic programming, in tokens; the part before it is taken proportionally. Where that
#: misses the budget, four times as much is tried, up to the most.
KNAPSACK_TOKENS = 32_768
MOST_KNAPSACK_TOKENS = 524_288
#: Part of the mix that may lack when its total is chosen.
TOLERATED_LACK = 0.05
#: A target is met when the share reached differs from it by no more than this.
SHARE_TOLERANCE = 0.005
_BUCKET_BITS = 12


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each length to take so that their sum is as near below ``budget`` as can be.

    Exact bounded knapsack on the set of reachable sums, kept as the bits of one integer for each group
    of equal items (counts split into powers of two) to trace the choice back.
    """
    groups = []
    for length, n in sorted(counts.items(), reverse=True):
        n = min(n, budget // length) if length else 0
        size = 1
        while n > 0:
            k = min(size, n)
            groups.append((length, k))
            n -= k
            size *= 2
    mask = (1 << (budget + 1)) - 1
    reached = [1]
    used = []
    for length, k in groups:
        if reached[-1] >> budget & 1:
            break
        reached.append((reached[-1] | reached[-1] << (length * k)) & mask)
        used.append((length, k))
    at = reached[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for i in range(len(used) - 1, -1, -1):
        if not reached[i] >> at & 1:
            length, k = used[i]
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def fit(counts: dict[int, int], budget: int, max_repeats: int, knapsack_tokens: int = KNAPSACK_TOKENS) -> dict[int, int]:
    """How many copies in all to use of the documents of each length, no document more than ``max_repeats`` times.

    Documents longer than the budget are out. The others are used as often as all of them fit, the rest of
    the budget is filled with as few repeats as hit it exactly, or else come nearest.
    """
    usable = {length: n for length, n in counts.items() if 0 < length <= budget and n > 0}
    total = sum(length * n for length, n in usable.items())
    if not total or max_repeats <= 0:
        return {}
    whole = min(budget // total, max_repeats)
    base = {length: n * whole for length, n in usable.items()}
    left = budget - whole * total
    if whole == max_repeats or left == 0:
        return {length: k for length, k in base.items() if k}
    step = math.gcd(*usable)
    best: tuple[int, dict[int, int]] | None = None
    window = knapsack_tokens
    while True:
        for cap in range(whole + 1, max_repeats + 1):
            extra = _fill({length: n * (cap - whole) for length, n in usable.items()}, left, window)
            lack = left - sum(length * k for length, k in extra.items())
            if best is None or lack < best[0]:
                best = lack, extra
            if lack < step:
                break
        # no sum lies nearer, or everything was in the knapsack
        if best[0] < step or window >= min(left, MOST_KNAPSACK_TOKENS):
            break
        window *= 4
    taken = {length: base[length] + best[1].get(length, 0) for length in usable}
    return {length: k for length, k in taken.items() if k}


def _fill(free: dict[int, int], left: int, knapsack_tokens: int) -> dict[int, int]:
    """So many of each length, of those ``free``, that their sum comes near ``left`` from below."""
    total = sum(length * n for length, n in free.items())
    head = max(0, left - knapsack_tokens)
    extra = {length: min(n, int(n * head / total)) for length, n in free.items()}
    left -= sum(length * k for length, k in extra.items())
    free = {length: n - extra[length] for length, n in free.items()}
    # with very many distinct lengths the rounding alone leaves more than the knapsack takes
    for length in sorted(free, reverse=True):
        k = min(free[length], max(0, left - knapsack_tokens) // length)
        extra[length] += k
        free[length] -= k
        left -= k * length
    for length, k in knapsack({length: n for length, n in free.items() if n}, left).items():
        extra[length] += k
    return extra


def greatest_total(targets: list[tuple[float, int, int]], tolerated_lack: float) -> int:
    """Size of the mix when none is asked for: the tokens there are, or less where too much would lack.

    ``targets``: (target share, available tokens, greatest number of repeats). What the sources that have
    documents cannot give is at most ``tolerated_lack`` of the total. With no tolerance at all one source
    of hardly any text would make the whole mix as small as itself; a source without any is not counted.
    """
    total = sum(available for _, available, _ in targets)
    most = sorted((available * repeats / share, share, available * repeats) for share, available, repeats in targets if available)
    share, given = 0.0, 0.0  # of the sources that lack something: shares, and what they give
    for i, (reach, s, gives) in enumerate(most):
        share, given = share + s, given + gives
        upto = most[i + 1][0] if i + 1 < len(most) else math.inf
        # lack of a total t is share - given / t, from this source's reach on
        if share > tolerated_lack:
            t = max(reach, given / (share - tolerated_lack))
            if t < upto:
                return min(total, math.floor(t))
    return total


def budgets(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None, tolerated_lack: float = TOLERATED_LACK) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, budget_tokens for every target.

    ``total_tokens`` None takes ``greatest_total``. Targets without share, repeats or source are left out;
    of several rows of one source the greatest share counts.
    """
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(F.col("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(totals.select(F.col("source").alias("_s"), "available_tokens"), F.col("source") == F.col("_s"), "left").drop("_s")
    t = t.withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    if total_tokens is None:
        total_tokens = greatest_total([tuple(r) for r in t.select("target_share", "available_tokens", "max_repeats").collect()], tolerated_lack)  # one row a target
    return t.withColumn("budget_tokens", F.floor(F.lit(float(total_tokens)) * F.col("target_share") + F.lit(1e-6)).cast("long"))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(budgets, plan): the plan has source, n_tokens, n_docs, whole, extra."""
    counts = written(sized.where("source IS NOT NULL AND n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "mix-counts")
    wanted = written(budgets(counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("available_tokens")), targets, total_tokens), "mix-budgets")
    rows = counts.join(wanted.select(F.col("source").alias("_s"), "budget_tokens", "max_repeats"), F.col("source") == F.col("_s")).drop("_s")

    def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:  # one row a distinct length
        n = {int(a): int(b) for a, b in zip(pdf["n_tokens"], pdf["n_docs"])}
        copies = fit(n, int(pdf["budget_tokens"].iloc[0]), int(pdf["max_repeats"].iloc[0]))
        of = [divmod(copies.get(a, 0), n[a]) for a in n]
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "n_docs": pdf["n_docs"], "whole": [w for w, _ in of], "extra": [x for _, x in of]})

    fitted = rows.groupBy("source").applyInPandas(fit_source, "source string, n_tokens long, n_docs long, whole long, extra long")
    return wanted, written(fitted, "mix-plan")


def mix(sized: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents of the mix with their number of copies, shares reached).

    ``sized`` as of ``tokens.sized``. Documents without tokens, without source or of a source without
    target are not in the mix; repeated rows are documents of their own. A source that cannot meet its
    budget gives all it may, and what it lacks raises the shares of the others: ``deviation`` is the share
    reached less the target, and ``met`` says whether it stays within ``SHARE_TOLERANCE``. Within a length the documents of least seeded hash are taken; the ranks are
    counted by hash bucket first, so no task sorts all documents of one length.
    """
    sized = written(sized, "mix-sized")
    wanted, planned = plan(sized, targets, total_tokens)
    p = planned.where("whole > 0 OR extra > 0").select(F.col("source").alias("_s"), F.col("n_tokens").alias("_n"), "n_docs", "whole", "extra")
    d = sized.join(p, (F.col("source") == F.col("_s")) & (F.col("n_tokens") == F.col("_n"))).drop("_s", "_n")
    d = d.withColumn("hash", F.xxhash64(F.lit(seed), "row", "doc_id")).withColumn("bucket", F.shiftrightunsigned("hash", 64 - _BUCKET_BITS))
    part = d.where("extra > 0 AND extra < n_docs")
    key = ["source", "n_tokens", "bucket"]
    by_bucket = part.groupBy(*key).agg(F.count(F.lit(1)).alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_bucket = by_bucket.withColumn("_before", upto - F.col("_in"))
    part = part.join(by_bucket, key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("hash", "doc_id", "row"))
    # only the bucket in which the last rank falls is sorted
    inside = part.where("_before < extra AND _before + _in > extra").withColumn("_rank", F.col("_before") + rank).withColumn("more", (F.col("_rank") <= F.col("extra")).cast("int")).drop("_rank")
    clear = part.where("_before >= extra OR _before + _in <= extra").withColumn("more", (F.col("_before") + F.col("_in") <= F.col("extra")).cast("int"))
    rest = d.where("extra = 0 OR extra >= n_docs").withColumn("more", (F.col("extra") > 0).cast("int"))
    columns = ["doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("copies")]
    mixed = inside.select(*columns).unionByName(clear.select(*columns)).unionByName(rest.select(*columns)).where("copies > 0")
    mixed = written(mixed, "mix")
    reached = mixed.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    shares = wanted.join(reached, F.col("source") == F.col("_s"), "left").drop("_s").fillna({"reached_tokens": 0, "most_copies": 0})
    total = F.sum("reached_tokens").over(Window.partitionBy())  # one row a target
    shares = shares.withColumn("reached_share", F.when(total > 0, F.col("reached_tokens") / total).otherwise(0.0)).withColumn("missing_tokens", F.col("budget_tokens") - F.col("reached_tokens"))
    shares = shares.withColumn("deviation", F.col("reached_share") - F.col("target_share"))
    return mixed, shares.withColumn("met", F.abs("deviation") <= SHARE_TOLERANCE)
