"""Splits, samples, thinning, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample, sampling
from .view import q, q_sql, telemetry, telemetry_sql

SAMPLE_ROWS = 500

# A multiplicative hash both engines compute alike, spread over 63 bits.
CASE_HASH = "((cast(case_id as bigint) * 2654435761) % 4294967296) * 2147483648"
_ROW_HASH = "(((cast(case_id as bigint) * 100003 + row_idx) * 2654435761) % 4294967296) * 2147483648"

# The same hash without the product, which leaves 64 bits from case_id 34,745 on: the factor in two halves, each reduced.
_ROW_KEY = "((cast(case_id as bigint) * 100003 + row_idx) % 4294967296)"
ROW_HASH = f"""((({_ROW_KEY} * {2654435761 >> 16}) % 65536 * 65536 + {_ROW_KEY} * {2654435761 & 0xFFFF}) % 4294967296)
 * 2147483648"""

_T = telemetry_sql()


def split(spark, sf_dir, rows=None):
    """Flight split within every replicate."""
    rows = telemetry(spark, sf_dir) if rows is None else rows
    return sampling.case_split(rows, ["replicate", "case_id"], ["replicate"], rank_by=F.expr(CASE_HASH))


def quota_sql(sizes: str, within: str, stratum: str, draws: str) -> str:
    """Largest-remainder quotas in the comparison engine."""
    part = f"partition by {within}" if within else ""
    return f"""select *, whole + case when row_number() over ({part} order by leftover desc, {stratum})
 <= draws - sum(whole) over ({part}) then 1 else 0 end as quota from (
 select *, (n * draws) // total as whole, (n * draws) % total as leftover from (
 select *, least({draws}, total) as draws from (
 select *, cast(sum(n) over ({part}) as bigint) as total from ({sizes}))))"""


def split_sql(source: str = _T) -> str:
    cases = f"select replicate, case_id, max(label) as case_label from ({source}) group by replicate, case_id"
    sizes = f"select replicate, case_label, count(*) as n from ({cases}) group by replicate, case_label"
    quotas = quota_sql(sizes, "replicate", "case_label", "total - cast(ceil(total * 0.2E0) as bigint)")
    return f"""select c.replicate, c.case_id, c.case_label, c.turn > q.quota as is_holdout from (
 select *, row_number() over (partition by replicate, case_label order by {CASE_HASH}, case_id) as turn
 from ({cases})) c join ({quotas}) q on c.replicate = q.replicate and c.case_label = q.case_label"""


def case_labels(spark, sf_dir):
    return sampling.case_labels(telemetry(spark, sf_dir))


def case_split(spark, sf_dir):
    return split(spark, sf_dir)


def holdout_rows(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    held = split(spark, sf_dir, rows).where(F.col("is_holdout"))
    return sampling.rows_of(rows, held, ["replicate", "case_id"]).select("replicate", "case_id", "row_idx", "label")


def stratified_sample(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("case_id", "row_idx", "label")
    return sampling.stratified_sample(rows, SAMPLE_ROWS, rank_by=F.expr(ROW_HASH))


def uniform_sample(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("case_id", "row_idx", "label")
    return sampling.uniform_sample(rows, SAMPLE_ROWS, rank_by=F.expr(ROW_HASH))


def thin(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    step = resample.sampling_interval(rows).first()["step"]
    return resample.thin(rows, step).select("case_id", "row_idx", "t_ms", "label", q("altitude").alias("altitude"))


def median_dt(spark, sf_dir):
    interval = resample.sampling_interval(telemetry(spark, sf_dir))
    return interval.select(q("median_dt_s", 1_000_000).alias("median_dt_s"), "step")


def class_weights(spark, sf_dir):
    return sampling.class_weights(telemetry(spark, sf_dir)).select("label", "n", q("weight", 1_000_000).alias("weight"))


_DELTA = f"select (t_ms - lag(t_ms) over (partition by case_id order by row_idx)) / 1000E0 as dt from ({_T})"
STEP_SQL = f"""select median(dt) as median_dt_s,
 greatest(1, cast(round_even(2.0E0 / median(dt), 0) as int)) as step from ({_DELTA})"""

QUERIES = {
    "case_labels": case_labels,
    "case_split": case_split,
    "holdout_rows": holdout_rows,
    "stratified_sample": stratified_sample,
    "uniform_sample": uniform_sample,
    "thin": thin,
    "median_dt": median_dt,
    "class_weights": class_weights,
}

ORACLE = {
    "case_labels": f"select case_id, max(label) as case_label from ({_T}) group by case_id",
    "case_split": split_sql(),
    "holdout_rows": f"""select t.replicate, t.case_id, t.row_idx, t.label from ({_T}) t
 join ({split_sql()}) s on t.replicate = s.replicate and t.case_id = s.case_id where s.is_holdout""",
    "stratified_sample": f"""select r.case_id, r.row_idx, r.label from (
 select case_id, row_idx, label, row_number() over (partition by label order by {_ROW_HASH}, case_id, row_idx) as turn
 from ({_T})) r join ({quota_sql(f"select label, count(*) as n from ({_T}) group by label", "", "label", str(SAMPLE_ROWS))}) q
 on r.label = q.label where r.turn <= q.quota""",
    "uniform_sample": f"""select case_id, row_idx, label from ({_T})
 order by {_ROW_HASH}, case_id, row_idx limit {SAMPLE_ROWS}""",
    "thin": f"""select case_id, cast(row_idx // step as int) as row_idx, t_ms, label, {q_sql("altitude")} as altitude
 from ({_T}), ({STEP_SQL}) where row_idx % step = 0""",
    "median_dt": f"select {q_sql('median_dt_s', 1_000_000)} as median_dt_s, step from ({STEP_SQL})",
    "class_weights": f"""select label, n, {q_sql("sum(n) over () / (count(*) over () * cast(n as double))", 1_000_000)}
 as weight from (select label, count(*) as n from ({_T}) group by label)""",
}
