"""Thompson-sampling bandits over strategies.

Arms are rows: strategy, regime, alpha, beta, pulls, total_reward.  Draws are
seeded; nothing that is passed in is changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a regime's outcomes by time.
BUCKETS = 128
ARMS = "strategy string, regime string, alpha double, beta double, pulls int, total_reward double"


def fresh(strategies: DataFrame) -> DataFrame:
    """Arms at the prior for (strategy, regime)."""
    return strategies.select("strategy", "regime", F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).alias("pulls"), F.lit(0.0).alias("total_reward")).distinct()


def _decayed(name: str, decay: float, least: float):
    return F.greatest(F.lit(least), F.lit(least) + (F.col(name) - least) * decay)


def batch_update(arms: DataFrame, outcomes: DataFrame, *, decay: float = 0.995, min_alpha: float = 1.0, min_beta: float = 1.0) -> DataFrame:
    """Arms after all outcomes (strategy, regime, reward in 0..1) and one decay of every arm.

    The order of outcomes doesn't matter, so they are summed.
    """
    sums = outcomes.groupBy("strategy", "regime").agg(F.sum("reward").alias("_r"), F.count("reward").alias("_n"))
    joined = arms.join(sums, ["strategy", "regime"], "full_outer")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    new = joined.select("strategy", "regime", (zero("alpha", 1.0) + zero("_r", 0.0)).alias("alpha"), (zero("beta", 1.0) + zero("_n", 0) - zero("_r", 0.0)).alias("beta"), (zero("pulls", 0) + zero("_n", 0)).cast("int").alias("pulls"), (zero("total_reward", 0.0) + zero("_r", 0.0)).alias("total_reward"))
    return new.withColumns({"alpha": _decayed("alpha", decay, min_alpha), "beta": _decayed("beta", decay, min_beta)})


def replay(outcomes: DataFrame, *, decay: float = 0.995, min_alpha: float = 1.0, min_beta: float = 1.0) -> DataFrame:
    """Arms after outcomes (strategy, regime, reward, ts, and symbol if there are several) one by one, all arms of the regime decaying after each.

    Outcomes of one ts go by symbol, then strategy.

    Decay is geometric, so an outcome's part in the end is its reward times decay
    to the number of outcomes of the regime from it on: a sum, and no fold.  A
    regime's outcomes are counted from the end in buckets of time, of which each is
    ordered in a task of its own.
    """
    order = [c for c in ("ts", "symbol", "strategy") if c != "symbol" or c in outcomes.columns]
    timed = outcomes.withColumn("_t", F.col("ts").cast("timestamp").cast("double"))
    bounds = timed.groupBy("regime").agg(F.approx_percentile("_t", [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("_b"))
    timed = timed.join(bounds, "regime").withColumn("_k", F.size(F.filter("_b", lambda b: b < F.col("_t")))).drop("_b")
    sizes = timed.groupBy("regime", "_k").agg(F.count(F.lit(1)).alias("_n"))
    after = Window.partitionBy("regime").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("regime", "_k", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_after"))
    own = F.row_number().over(Window.partitionBy("regime", "_k").orderBy(*map(F.desc, order)))
    aged = timed.withColumn("_own", own).join(sizes, ["regime", "_k"]).withColumn("_w", F.pow(F.lit(decay), F.col("_own") + F.col("_after")))
    sums = aged.groupBy("strategy", "regime").agg(F.sum(F.col("reward") * F.col("_w")).alias("_a"), F.sum((1.0 - F.col("reward")) * F.col("_w")).alias("_b"), F.count(F.lit(1)).cast("int").alias("pulls"), F.sum("reward").alias("total_reward"))
    return sums.select("strategy", "regime", (F.col("_a") + min_alpha).alias("alpha"), (F.col("_b") + min_beta).alias("beta"), "pulls", "total_reward")


def flat_replay(outcomes: DataFrame) -> DataFrame:
    """name, alpha, beta, total_trials, total_reward, avg_reward of arms whose rewards are -1 to 1.

    Rewards are brought to 0..1; above a half they add to alpha, else (what is
    missing to 1) to beta.
    """
    r = (F.col("reward") + 1.0) / 2.0
    return outcomes.groupBy("name").agg((1.0 + F.sum(F.when(r > 0.5, r).otherwise(0.0))).alias("alpha"), (1.0 + F.sum(F.when(r > 0.5, 0.0).otherwise(1.0 - r))).alias("beta"), F.count(F.lit(1)).alias("total_trials"), F.sum("reward").alias("total_reward"), F.avg("reward").alias("avg_reward"))


def with_win_rate(arms: DataFrame) -> DataFrame:
    s = F.col("alpha") + F.col("beta")
    return arms.withColumn("win_rate", F.when(s <= 2, 0.5).otherwise(F.col("alpha") / s))


def summary(arms: DataFrame) -> DataFrame:
    """Ranked within the regime by win rate; the frame's order is regime, then rank."""
    place = Window.partitionBy("regime").orderBy(F.desc("win_rate"), "strategy")
    return with_win_rate(arms).withColumn("rank", F.row_number().over(place)).orderBy("regime", "rank")


def reset(arms: DataFrame, strategy: str, regime: str) -> DataFrame:
    hit = (F.col("strategy") == strategy) & (F.col("regime") == regime)
    return arms.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(t) for c, v, t in (("alpha", 1.0, "double"), ("beta", 1.0, "double"), ("pulls", 0, "int"), ("total_reward", 0.0, "double"))})


def with_draws(arms: DataFrame, draws: int = 1, seed: int = 42) -> DataFrame:
    """arms times draw (from 0) with sample from Beta(alpha, beta), the same for the same seed."""
    columns = [c for c in arms.columns]

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                own = np.random.default_rng(int.from_bytes(f"{seed}:{getattr(row, columns[0])}:{row.regime if 'regime' in columns else ''}".encode(), "little") % (1 << 63))
                part = pd.DataFrame([row] * draws, columns=columns)
                parts.append(part.assign(draw=range(draws), sample=own.beta(row.alpha, row.beta, draws)))
            yield pd.concat(parts) if parts else pdf.assign(draw=pd.Series(dtype=int), sample=pd.Series(dtype=float))

    schema = ", ".join(f"`{n}` {t}" for n, t in arms.dtypes) + ", draw int, sample double"
    return arms.mapInPandas(sample, schema)


def intervals(arms: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """strategy, regime, low, high: 95% of the draws."""
    drawn = with_draws(arms, draws, seed)
    return drawn.groupBy("strategy", "regime").agg(F.percentile("sample", 0.025).alias("low"), F.percentile("sample", 0.975).alias("high"))


def best_probability(arms: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """name (or strategy, regime) and the share of draws in which it is best, within the regime."""
    keys = [c for c in ("name", "strategy", "regime") if c in arms.columns]
    group = [c for c in ("regime",) if c in arms.columns]
    drawn = with_draws(arms, draws, seed)
    winners = drawn.groupBy(*group, "draw").agg(F.max_by(F.struct(*keys), "sample").alias("_w")).select("_w.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return arms.select(*keys).join(winners, keys, "left").select(*keys, (F.coalesce("_n", F.lit(0)) / float(draws)).alias("probability"))


def select(predictions: DataFrame, arms: DataFrame, n: int = 3, exploration: float = 0.1, seed: int = 42, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """n predictions of each key by Thompson sampling; with the probability ``exploration``, n at random."""
    drawn = with_draws(arms, 1, seed).select("strategy", "regime", "sample")
    rows = predictions.join(drawn, ["strategy", "regime"], "left")
    dice = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("sample", F.coalesce("sample", dice("strategy", "regime", *keys)))  # an arm not seen yet is uniform
    score = F.when(dice(*keys) < exploration, dice("strategy", *keys)).otherwise(F.col("sample"))
    place = Window.partitionBy(*keys).orderBy(F.desc("_s"), "strategy")
    return rows.withColumn("_s", score).withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= n).drop("_s", "_r", "sample")


def choose_arm(arms: DataFrame, method: str = "thompson", *, c: float = 2.0, epsilon: float = 0.1, seed: int = 42) -> DataFrame:
    """One row: the arm of name, alpha, beta, total_trials, avg_reward that the method picks."""
    every = Window.partitionBy()
    if method == "thompson":
        scored = with_draws(arms, 1, seed).withColumn("_s", F.col("sample"))
    elif method == "ucb":
        total = F.sum("total_trials").over(every)
        bound = F.when(F.col("total_trials") == 0, float("inf")).otherwise(F.col("avg_reward") + c * F.sqrt(F.log(F.greatest(total, F.lit(1))) / F.greatest(F.col("total_trials"), F.lit(1))))
        scored = arms.withColumn("_s", F.when(total == 0, 0.0).otherwise(bound))
    elif method == "epsilon_greedy":
        explore = np.random.default_rng(seed).random() < epsilon
        scored = arms.withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(1 << 30)).cast("double") if explore else F.col("avg_reward"))
    else:
        raise ValueError(f"unknown method: {method}")
    return scored.orderBy(F.desc("_s"), "name").limit(1).select(*arms.columns)
