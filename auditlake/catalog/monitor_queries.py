"""Batch monitors over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import query, table
from auditlake.functions.numbers import band
from auditlake.operators import monitor
from auditlake.operators.ordered import fill_forward, nearest_marks, running_total

DAY = lambda c="ts": F.to_date(c)
WATCH_SQL = """w AS (SELECT user_id AS program_id, event_id, ts, nullif(event_type, 'error') AS a FROM events),
 l AS (SELECT *, lag(a) OVER o AS p, row_number() OVER o AS rn FROM w WINDOW o AS (PARTITION BY program_id ORDER BY ts, event_id))"""


def watched(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("program_id"), "event_id", "ts", F.nullif(F.col("event_type"), F.lit("error")).alias("authority"))


@query("authority_changes", f"""WITH {WATCH_SQL} SELECT program_id, event_id, a AS new_authority, p AS previous_authority,
 CASE WHEN rn = 1 THEN 'FirstSeen' WHEN a IS NULL THEN 'Revoked' ELSE 'Transferred' END AS event_type FROM l WHERE rn = 1 OR a IS DISTINCT FROM p""")
def authority_changes(spark, sf):
    out = monitor.authority_changes(watched(spark, sf), order=("ts", "event_id"), bucket=DAY())
    return out.select("program_id", "event_id", "new_authority", "previous_authority", "event_type")


@query("current_authority", f"""WITH {WATCH_SQL} SELECT program_id, arg_max({{'v': a}}, {{'a': ts, 'b': event_id}}).v AS current_authority, count(*) AS n_events FROM w GROUP BY program_id""")
def current_authority(spark, sf):
    return monitor.current_authority(watched(spark, sf), order=("ts", "event_id"))


@query("authority_totals", f"""WITH {WATCH_SQL}, c AS (SELECT program_id, arg_max({{'v': a}}, {{'a': ts, 'b': event_id}}).v AS a FROM w GROUP BY program_id) SELECT count(*) AS tracked, count(a) AS active FROM c""")
def authority_totals(spark, sf):
    return monitor.authority_totals(monitor.current_authority(watched(spark, sf), order=("ts", "event_id")))


@query("verification_lag", """WITH s AS (SELECT user_id AS validator, event_id AS slot, CASE WHEN event_type <> 'signup' THEN epoch_ms(ts) // 1000000 END AS bt, 2 + user_id % 3 AS n FROM events),
 l AS (SELECT *, lag(bt) OVER (PARTITION BY validator ORDER BY slot) AS p, row_number() OVER (PARTITION BY validator ORDER BY slot) AS rn FROM s)
 SELECT validator, slot, CAST(CASE WHEN bt IS NULL OR p IS NULL THEN least(greatest(3000 // n - 400, 0), 5000) ELSE least(greatest(abs(bt - p) * 1000 - 400, 0), 5000) END AS BIGINT) AS lag_ms FROM l WHERE rn > 1""")
def verification_lag(spark, sf):
    s = table(spark, sf, "events").select(
        F.col("user_id").alias("validator"), F.col("event_id").alias("slot"),
        F.when(F.col("event_type") != "signup", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000000)).alias("block_time"),
        (F.col("user_id") % 3 + 2).alias("num_slots"), F.lit(3).alias("sample_period_secs"))
    out = monitor.verification_lag(s, bucket=F.floor(F.col("slot") / 2000))
    return out.select("validator", "slot", "lag_ms")


SAMPLES_SQL = "s AS (SELECT user_id AS validator, event_id, ts, 1 + user_id % 4 AS num_slots, CAST(floor(value * 60) AS BIGINT) AS num_transactions FROM events)"


def samples(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("validator"), "event_id", "ts", (F.col("user_id") % 4 + 1).alias("num_slots"),
        F.floor(F.col("value") * 60).alias("num_transactions"))


@query("skip_rate", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY ts DESC, event_id DESC) AS rn FROM s)
 SELECT validator, round(least(greatest((3000.0::DOUBLE - sum(num_transactions) / sum(num_slots)) / 3000.0::DOUBLE * 100, 0), 100), 6) AS skip_rate FROM r WHERE rn <= 10 GROUP BY validator""")
def skip_rate(spark, sf):
    out = monitor.skip_rate(samples(spark, sf), order=("ts", "event_id"))
    return out.withColumn("skip_rate", F.round("skip_rate", 6))


@query("stress", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY ts DESC, event_id DESC) AS rn FROM s),
 v AS (SELECT validator, least(avg(num_transactions / num_slots) / 5000.0::DOUBLE * 100, 100) AS x FROM r WHERE rn <= 5 GROUP BY validator)
 SELECT validator, round(x, 6) AS stress, CASE WHEN x > 90 THEN 'Critical' WHEN x > 80 THEN 'High' WHEN x > 70 THEN 'Medium' END AS severity FROM v""")
def stress(spark, sf):
    return monitor.stress(samples(spark, sf), order=("ts", "event_id")).withColumn("stress", F.round("stress", 6))


@query("band", "SELECT event_id, CASE WHEN value > 60 THEN 'Critical' WHEN value > 40 THEN 'High' WHEN value > 20 THEN 'Medium' END AS severity FROM events")
def band_query(spark, sf):
    return table(spark, sf, "events").select("event_id", band(F.col("value"), 20.0).alias("severity"))


ORDERED_SQL = "o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_custkey + 1 AS share FROM orders)"


def snapshots(spark, sf):
    return table(spark, sf, "orders").withColumn("price", F.round(F.col("o_totalprice") * 100).cast("bigint"))


@query("monotone", f"""WITH {ORDERED_SQL}, l AS (SELECT *, lag(price) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM o)
 SELECT o_custkey, o_orderkey, price, previous FROM l WHERE price < previous""")
def monotone(spark, sf):
    out = monitor.monotone(snapshots(spark, sf), "o_custkey", ["o_orderdate", "o_orderkey"], "price", bucket=F.year("o_orderdate"))
    return out.select("o_custkey", "o_orderkey", "price", "previous")


@query("monotone_ratio", """WITH o AS (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS assets, 1 + o_orderkey % 1000 AS shares FROM orders), l AS (SELECT *, lag(assets) OVER w AS pa, lag(shares) OVER w AS ps FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
 SELECT o_custkey, o_orderkey, assets, shares FROM l WHERE assets::HUGEINT * ps < pa::HUGEINT * shares""")
def monotone_ratio(spark, sf):
    s = table(spark, sf, "orders").withColumns({"assets": F.round("o_totalprice").cast("bigint"), "shares": F.col("o_orderkey") % 1000 + 1})
    out = monitor.monotone(s, "o_custkey", ["o_orderdate", "o_orderkey"], "assets", "shares", F.year("o_orderdate"))
    return out.select("o_custkey", "o_orderkey", "assets", "shares")


@query("bounded_change", f"""WITH {ORDERED_SQL}, l AS (SELECT *, lag(price) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM o)
 SELECT o_custkey, o_orderkey, price, previous FROM l WHERE abs(price - previous) * 10000 > abs(previous) * 2500""")
def bounded_change(spark, sf):
    out = monitor.bounded_change(snapshots(spark, sf), "o_custkey", ["o_orderdate", "o_orderkey"], "price", 2500, F.year("o_orderdate"))
    return out.select("o_custkey", "o_orderkey", "price", "previous")


@query("check_invariants", """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS dep, o_custkey * 300 AS bor, CAST(floor(o_totalprice) AS BIGINT) + o_custkey * 100 AS col, o_custkey % 100 AS assets, o_orderkey % 10 AS shares, o_orderkey % 12000 AS fee, o_custkey AS rx, o_orderkey AS ry FROM orders),
 v AS (SELECT o_orderkey, unnest([CASE WHEN NOT dep >= bor THEN 'deposits_cover_borrows' END, CASE WHEN NOT col * 10000 >= bor * 15000 THEN 'collateral_ratio' END, CASE WHEN bor <> 0 AND col * 100 // bor < 100 THEN 'health_factor' END,
 CASE WHEN NOT (fee >= 0 AND fee <= 10000) THEN 'fee_bound' END, CASE WHEN assets > 0 AND shares = 0 THEN 'zero_share_mint' END, CASE WHEN NOT (rx > 0 AND ry > 0) THEN 'reserves_positive' END]) AS invariant FROM s) SELECT * FROM v WHERE invariant IS NOT NULL""")
def check_invariants(spark, sf):
    price = F.floor("o_totalprice")
    s = table(spark, sf, "orders").select(
        "o_orderkey", price.alias("total_deposits"), (F.col("o_custkey") * 300).alias("total_borrows"), (price + F.col("o_custkey") * 100).alias("total_collateral"),
        (F.col("o_custkey") % 100).alias("total_assets"), (F.col("o_orderkey") % 10).alias("total_shares"), (F.col("o_orderkey") % 12000).alias("fee_bps"),
        F.col("o_custkey").alias("reserve_x"), F.col("o_orderkey").alias("reserve_y"))
    return monitor.check_invariants(s, monitor.pool_specs(), ["o_orderkey"])


@query("pool_history", """WITH s AS (SELECT o_custkey AS pool, o_orderkey, o_orderdate, CAST(round(o_totalprice) AS BIGINT) AS r, 1 + o_orderkey % 7 AS l, o_orderkey % 3 AS d, CAST(round(o_totalprice) AS BIGINT) * 40 AS w, 1 + o_custkey % 5 AS rate, CAST(epoch(o_orderdate::TIMESTAMP) AS BIGINT) AS secs FROM orders),
 h AS (SELECT *, row_number() OVER o AS n, lag(r) OVER o AS pr, lag(l) OVER o AS pl, lag(w) OVER o AS pw, lag(secs) OVER o AS psecs, first_value(d) OVER o AS fd FROM s WINDOW o AS (PARTITION BY pool ORDER BY o_orderdate, o_orderkey)),
 v AS (SELECT o_orderkey, unnest([CASE WHEN n > 1 AND l <> pl AND abs((r - pr)::HUGEINT * pl - (l - pl)::HUGEINT * pr) > pl THEN 'lp_proportional' END, CASE WHEN (n = 1 AND d = 0) OR d < fd THEN 'dead_shares' END,
  CASE WHEN n > 1 AND w - pw > greatest(secs - psecs, 0)::HUGEINT * rate THEN 'emission_bound' END]) AS invariant FROM h) SELECT * FROM v WHERE invariant IS NOT NULL""")
def pool_history(spark, sf):
    price = F.round("o_totalprice").cast("bigint")
    s = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pool"), "o_orderkey", "o_orderdate", price.alias("total_reserves"), (F.col("o_orderkey") % 7 + 1).alias("total_lp"), (F.col("o_orderkey") % 3).alias("dead_shares"),
        (price * 40).alias("total_rewards"), (F.col("o_custkey") % 5 + 1).alias("reward_rate"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return monitor.check_history(s, "pool", ["o_orderdate", "o_orderkey"], ["o_orderkey"], bucket=F.year("o_orderdate"))


@query("stake_totals", """WITH s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS staked FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS pool, o_custkey % 150 AS total_staked, coalesce(staked, 0) AS staked FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE coalesce(staked, 0) <> o_custkey % 150""")
def stake_totals(spark, sf):
    stakes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pool"), F.col("l_quantity").cast("bigint").alias("amount"))
    pools = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pool"), (F.col("o_custkey") % 150).alias("total_staked"))
    return monitor.stake_totals(stakes, pools).select("pool", "total_staked", "staked")


@query("near", """WITH e AS (SELECT user_id, event_id, epoch_ms(ts) // 60000 AS m, event_type FROM events)
 SELECT user_id, event_id, NOT EXISTS (SELECT 1 FROM e v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.m >= e.m - 600 AND v.m < e.m + 300) AS unchecked FROM e WHERE event_type = 'purchase'""")
def near(spark, sf):
    """Purchases without a view of the same user from 600 minutes before to 300 after."""
    e = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000).alias("m"))
    out = nearest_marks(e, "user_id", "m", F.col("event_type") == "view", 600)
    close = (F.col("m") - F.col("prev_mark") <= 600) | (F.col("next_mark") - F.col("m") < 300)
    return out.filter("event_type = 'purchase'").select("user_id", "event_id", (~F.coalesce(close, F.lit(False))).alias("unchecked"))


@query("fill_forward", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events""")
def fill_forward_query(spark, sf):
    e = table(spark, sf, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return fill_forward(e, "user_id", ["ts", "event_id"], "mark", DAY(), "signup").select("user_id", "event_id", "signup")


@query("running_total", "SELECT user_id, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM events")
def running_total_query(spark, sf):
    out = running_total(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.round(F.col("value") * 100).cast("bigint"), DAY(), "cents")
    return out.select("user_id", "event_id", "cents")
