"""Queries: metrics over steps and workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import monitoring as mn
from tunedata.plans.ranks import SNAPSHOTS_SQL, snapshots
from tunedata.plans.registry import WEIGHT_STATE_SQL, query, r6, table, weight_state


def day_sql(ts: str = "ts") -> str:
    return f"date_diff('day', TIMESTAMP '2024-01-01', {ts})"


def events_by_day(spark, sf_dir):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", day.alias("epoch"))


def ema_sql(keys: str, decay: float, source: str) -> str:
    """Recursion over the position in the run, all runs side by side."""
    on = " AND ".join(f"n.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""
WITH RECURSIVE n AS (SELECT {keys}, event_id, value, row_number() OVER (PARTITION BY {keys} ORDER BY event_id) AS k FROM ({source})),
e AS (SELECT {keys}, event_id, k, value * (1 - {decay}::DOUBLE) AS ema FROM n WHERE k = 1
      UNION ALL SELECT {', '.join('n.' + k.strip() for k in keys.split(','))}, n.event_id, n.k, e.ema * {decay}::DOUBLE + (1 - {decay}::DOUBLE) * n.value
      FROM e JOIN n ON {on} AND n.k = e.k + 1)
"""


@query("mon_ema", ema_sql("user_id, epoch", 0.95, f"SELECT *, {day_sql()} AS epoch FROM events") + """
SELECT user_id, epoch, event_id, round(ema, 6) AS ema FROM e
""")
def mon_ema(spark, sf_dir):
    out = mn.ema(events_by_day(spark, sf_dir), "value", step="event_id", by=["user_id", "epoch"])
    return out.select("user_id", "epoch", "event_id", r6("ema", "ema"))


@query("mon_snapshot_ema", f"""
SELECT example_id, round(0.008::DOUBLE * (logit * 1.5 + 0.1) + 0.992::DOUBLE * logit, 6) AS logit FROM ({WEIGHT_STATE_SQL})
""")
def mon_snapshot_ema(spark, sf_dir):
    previous = weight_state(spark, sf_dir)
    current = previous.select("example_id", (F.col("logit") * 1.5 + 0.1).alias("logit"))
    return mn.snapshot_ema(previous, current).select("example_id", r6("logit", "logit"))


@query("mon_snapshot_chain", f"""
WITH RECURSIVE s AS ({SNAPSHOTS_SQL}),
k AS (SELECT example_id, logit, row_number() OVER (PARTITION BY example_id ORDER BY step) AS k, count(*) OVER (PARTITION BY example_id) AS n
      FROM s WHERE step % 20 = 0),
e AS (SELECT example_id, k, n, logit FROM k WHERE k = 1 UNION ALL
      SELECT e.example_id, k.k, k.n, 0.008::DOUBLE * k.logit + 0.992::DOUBLE * e.logit FROM e JOIN k ON e.example_id = k.example_id AND k.k = e.k + 1)
SELECT example_id, round(logit, 6) AS logit FROM e WHERE k = n
""")
def mon_snapshot_chain(spark, sf_dir):
    return mn.snapshot_average(snapshots(spark, sf_dir), every=20).select("example_id", r6("logit", "logit"))


@query("mon_reduce", f"""
WITH e AS (SELECT {day_sql()} AS step, event_type AS metric, value FROM events)
SELECT step, metric, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(sum(value), 6) AS sum FROM e GROUP BY step, metric
""")
def mon_reduce(spark, sf_dir):
    logged = events_by_day(spark, sf_dir).select(F.col("epoch").alias("step"), F.col("event_type").alias("metric"), "value")
    out = mn.reduce_all(logged, ("mean", "max", "sum"))
    return out.select("step", "metric", *[r6(c, c) for c in ("mean", "max", "sum")])


@query("mon_gather", """
SELECT event_id, value, 0 AS worker FROM events WHERE event_type = 'click' UNION ALL
SELECT event_id, value, 1 FROM events WHERE event_type = 'view' UNION ALL
SELECT event_id, value, 2 FROM events WHERE event_type NOT IN ('click', 'view')
""")
def mon_gather(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    kind = F.col("event_type")
    parts = [events.filter(kind == "click"), events.filter(kind == "view"), events.filter(~kind.isin("click", "view"))]
    return mn.gather(*[p.drop("event_type") for p in parts])


@query("mon_running_mean", """
SELECT user_id, event_id, round(avg(ln(1 + value)) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS running_mean FROM events
""")
def mon_running_mean(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select("user_id", "event_id", F.log1p("value").alias("loss"))
    out = mn.running_mean(losses, "loss", step="event_id", by=["user_id"])
    return out.select("user_id", "event_id", r6("running_mean", "running_mean"))


@query("mon_prefix", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'eval' END || '/' || event_type AS metric FROM events
""")
def mon_prefix(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric"))
    return mn.prefix_metrics(events, F.when(F.col("event_id") % 2 == 0, "train").otherwise("eval"))
