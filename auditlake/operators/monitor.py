"""Batch monitors: authority changes, slot lag, skip rate, stress, snapshot invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import int_div, saturating_sub
from auditlake.operators.ordered import with_previous


def authority_changes(
    df: DataFrame, key: str = "program_id", authority: str = "authority", order=("detected_at",), bucket: Column | None = None
) -> DataFrame:
    """Rows where a key's authority is first seen, revoked or transferred."""
    seen = with_previous(df, key, list(order), [authority], bucket, "_prev")
    now, before = F.col(authority), F.col(f"_prev.{authority}")
    kind = (
        F.when(F.col("_prev").isNull(), "FirstSeen")
        .when(~now.eqNullSafe(before), F.when(now.isNull(), "Revoked").otherwise("Transferred"))
    )
    return (
        seen.withColumn("event_type", kind).filter("event_type is not null")
        .withColumn("previous_authority", before).withColumnRenamed(authority, "new_authority").drop("_prev")
    )


def current_authority(df: DataFrame, key: str = "program_id", authority: str = "authority", order=("detected_at",)) -> DataFrame:
    """Latest authority per key and the number of observations."""
    last = F.max_by(F.struct(F.col(authority).alias("a")), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_l"), F.count(F.lit(1)).alias("n_events")).select(
        key, F.col("_l.a").alias("current_authority"), "n_events"
    )


def authority_totals(state: DataFrame) -> DataFrame:
    """Tracked keys and those whose authority is still active."""
    return state.agg(F.count(F.lit(1)).alias("tracked"), F.count("current_authority").alias("active"))


# Target slot time, cap of a lag value, target transactions per slot, full load.
SLOT_MS = 400
LAG_CAP_MS = 5000
EXPECTED_TX = 3000.0
FULL_TX = 5000.0
STRESS_LIMIT = 70.0


def verification_lag(
    slots: DataFrame, key: str = "validator", slot: str = "slot", block_time: str = "block_time", bucket: Column | None = None
) -> DataFrame:
    """Excess of the time between consecutive slots over the target, in ms.

    A missing block time falls back to the sample's mean slot time (sample_period_secs / num_slots)
    where those columns exist, else 0. The first slot of a validator has nothing to compare with.
    """
    seen = with_previous(slots, key, [slot], [block_time], bucket, "_prev")
    delta = F.abs(F.col(block_time) - F.col(f"_prev.{block_time}")) * 1000
    capped = lambda ms: F.when(ms.isNotNull(), F.least(saturating_sub(ms, F.lit(SLOT_MS)), F.lit(LAG_CAP_MS)))
    lag = capped(delta)
    if {"num_slots", "sample_period_secs"} <= set(slots.columns):
        mean = int_div(F.col("sample_period_secs") * 1000, F.nullif(F.col("num_slots"), F.lit(0)))
        spare = F.coalesce(capped(mean), F.lit(0))
    else:
        spare = F.lit(0)
    return seen.filter("_prev is not null").withColumn("lag_ms", F.coalesce(lag, spare).cast("bigint")).drop("_prev")


def _last_n(samples: DataFrame, key: str, order, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def skip_rate(samples: DataFrame, key: str = "validator", order=("ts",), n: int = 10) -> DataFrame:
    """Shortfall of transactions per slot against the target over the last n samples, per cent."""
    per = F.try_divide(F.sum("num_transactions"), F.sum("num_slots"))
    rate = F.least(F.greatest((F.lit(EXPECTED_TX) - per) / EXPECTED_TX * 100, F.lit(0.0)), F.lit(100.0))
    return _last_n(samples, key, order, n).groupBy(key).agg(F.coalesce(rate, F.lit(0.0)).alias("skip_rate"))


def stress(samples: DataFrame, key: str = "validator", order=("ts",), n: int = 5) -> DataFrame:
    """Mean load over the last n samples (mean of ratios) and its band."""
    per = F.avg(F.try_divide(F.col("num_transactions"), F.col("num_slots")))
    level = F.when(per.isNotNull(), F.least(per / FULL_TX * 100, F.lit(100.0)))
    out = _last_n(samples, key, order, n).groupBy(key).agg(F.coalesce(level, F.lit(0.0)).alias("stress"))
    severity = F.when(F.col("stress") > 90, "Critical").when(F.col("stress") > 80, "High").when(
        F.col("stress") > STRESS_LIMIT, "Medium")
    return out.withColumn("severity", severity)


def monotone(
    snapshots: DataFrame, key: str, order, numerator: str, denominator: str | None = None, bucket: Column | None = None
) -> DataFrame:
    """Snapshots where numerator/denominator fell below its previous value (compared by cross-multiplication)."""
    cols = [numerator] + ([denominator] if denominator else [])
    seen = with_previous(snapshots, key, order, cols, bucket, "_prev")
    if denominator:
        now = F.col(numerator).cast("decimal(19,2)") * F.col(f"_prev.{denominator}").cast("decimal(19,2)")
        before = F.col(f"_prev.{numerator}").cast("decimal(19,2)") * F.col(denominator).cast("decimal(19,2)")
    else:
        now, before = F.col(numerator), F.col(f"_prev.{numerator}")
    return seen.filter(now < before).withColumn("previous", F.col(f"_prev.{numerator}")).drop("_prev")


def bounded_change(
    snapshots: DataFrame, key: str, order, value: str, max_bps: int, bucket: Column | None = None
) -> DataFrame:
    """Snapshots whose value moved by more than max_bps of the previous one."""
    seen = with_previous(snapshots, key, order, [value], bucket, "_prev")
    before = F.col(f"_prev.{value}")
    moved = F.abs(F.col(value) - before) * 10_000 > F.abs(before) * max_bps
    return seen.filter(moved).withColumn("previous", before).drop("_prev")


# Limits of the pool checks.
COLLATERAL_RATIO_BPS = 15_000
MIN_HEALTH = 100
MAX_FEE_BPS = 10_000


def check_invariants(snapshots: DataFrame, specs: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per (snapshot, violated invariant); a spec is a predicate that must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in specs.items()]))
    return snapshots.select(*keep, F.explode(broken).alias("invariant"))


def pool_specs(ratio_bps: int = COLLATERAL_RATIO_BPS, min_health: int = MIN_HEALTH, max_fee: int = MAX_FEE_BPS) -> dict[str, Column]:
    """Invariants of a lending/vault/AMM snapshot."""
    health = int_div(F.col("total_collateral") * 100, F.nullif(F.col("total_borrows"), F.lit(0)))
    return {
        "deposits_cover_borrows": F.col("total_deposits") >= F.col("total_borrows"),
        "collateral_ratio": F.col("total_collateral") * 10_000 >= F.col("total_borrows") * ratio_bps,
        "health_factor": health >= min_health,
        "fee_bound": (F.col("fee_bps") >= 0) & (F.col("fee_bps") <= max_fee),
        "zero_share_mint": ~((F.col("total_assets") > 0) & (F.col("total_shares") == 0)),
        "reserves_positive": (F.col("reserve_x") > 0) & (F.col("reserve_y") > 0),
    }


def _wide(value: Column) -> Column:
    """A whole number whose products with another stay exact."""
    return value.cast("decimal(19,0)")


def pool_history(snapshots: DataFrame, key: str, order, cols, bucket: Column | None = None) -> DataFrame:
    """Snapshots with `_prev`, the struct of the pool's previous one (null for the first), and `_first`, that of its first."""
    order, cols = list(order), list(cols)
    seen = with_previous(snapshots, key, order, cols, bucket, "_prev")
    first = snapshots.groupBy(F.col(key).alias("_pool")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
    return seen.join(first, F.col(key).eqNullSafe(F.col("_pool"))).drop("_pool")


def history_specs(at: str = "at") -> dict[str, Column]:
    """Invariants of a pool snapshot beside its first and previous one; they hold where there is none before.

    lp_proportional: when the LP supply changes, reserves change in proportion, within one unit of rounding. dead_shares: the first
    snapshot locks shares, and no later one locks fewer. emission_bound: rewards since the previous snapshot are at most the time
    in between times the rate."""
    now, before, first = F.col, lambda c: F.col(f"_prev.{c}"), lambda c: F.col(f"_first.{c}")
    step = lambda c: _wide(now(c) - before(c))
    gap = F.abs(step("total_reserves") * _wide(before("total_lp")) - step("total_lp") * _wide(before("total_reserves")))
    elapsed = F.greatest(now(at) - before(at), F.lit(0))
    return {
        "lp_proportional": (now("total_lp") == before("total_lp")) | (gap <= _wide(before("total_lp"))),
        "dead_shares": F.when(F.col("_prev").isNull(), (now("total_lp") <= 0) | (now("dead_shares") > 0)).otherwise(now("dead_shares") >= first("dead_shares")),
        "emission_bound": step("total_rewards") <= _wide(elapsed) * _wide(now("reward_rate")),
    }


def check_history(snapshots: DataFrame, key: str, order, keep, at: str = "at", bucket: Column | None = None) -> DataFrame:
    """One row per (snapshot, violated invariant of its history). snapshots: key, order, at (seconds), total_reserves, total_lp,
    dead_shares, total_rewards (so far), reward_rate (a second)."""
    cols = ["total_reserves", "total_lp", "dead_shares", "total_rewards", "reward_rate", at]
    return check_invariants(pool_history(snapshots, key, order, cols, bucket), history_specs(at), list(keep))


def stake_totals(stakes: DataFrame, pools: DataFrame, key: str = "pool") -> DataFrame:
    """Pools whose recorded total differs from the sum of their stakes."""
    summed = stakes.groupBy(key).agg(F.sum("amount").alias("staked"))
    joined = pools.join(summed, key, "left").withColumn("staked", F.coalesce("staked", F.lit(0)))
    return joined.filter(F.col("staked") != F.col("total_staked"))
