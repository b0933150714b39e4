"""Label-free detector over the adapted foreign log, and its report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CONSISTENCY_FEATURES, MAD_TO_STD, MIN_PHASE_ROWS, MIN_SCALE, Z_THRESHOLD
from ..operators import detector, report, sketches
from ..operators.adapt import adapt_log
from ..operators.features import engineer_features
from ..session import materialize
from .feature_queries import features_sql
from .ingest_queries import _PHASE, adapted_sql
from .view import q, q_sql, raw_log, raw_log_sql

_COLUMNS = list(CONSISTENCY_FEATURES)
_RATE = detector.ALTITUDE_RATE
_JUDGED = [*_COLUMNS, _RATE]


def log_features(spark, sf_dir):
    """Features of the adapted log; `source` names the flight."""
    rows = adapt_log(raw_log(spark, sf_dir)).withColumn("source", F.format_string("log_%d", F.col("case_id")))
    return engineer_features(rows)


def _judged(spark, sf_dir, *keys):
    """What the statistics read, written once."""
    slim = log_features(spark, sf_dir).select(*keys, "row_idx", "phase", *_JUDGED)
    return materialize(detector.narrowed(slim.withColumn("pool", F.lit("all")), _JUDGED), "judged")


def phase_counts(spark, sf_dir):
    return detector.phase_counts(adapt_log(raw_log(spark, sf_dir)))


def robust_stats(spark, sf_dir):
    rows = _judged(spark, sf_dir, "case_id")
    stats = detector.phase_stats(rows, ["pool"], detector.pool_sizes(rows, ["pool"]))
    return stats.select("phase", *[q(c, 1_000_000).alias(c) for c in stats.columns if c not in ("pool", "phase")])


def robust_z(spark, sf_dir):
    rows = _judged(spark, sf_dir, "case_id")
    z = detector.robust_z(rows, ["pool"], detector.pool_sizes(rows, ["pool"]))
    return z.select("case_id", "row_idx", *[q(f"z_{c}").alias(f"z_{c}") for c in _COLUMNS])


def altitude_plausibility(spark, sf_dir):
    scored = detector.altitude_plausibility(_judged(spark, sf_dir, "case_id"), ["pool"])
    return scored.select("case_id", "row_idx", q(f"z_{_RATE}").alias("altitude_score"))


def _scored(spark, sf_dir, pool):
    return detector.score_baseline(log_features(spark, sf_dir), pool)


def _score_columns(scored):
    return scored.select("case_id", "row_idx", q("anomaly_score").alias("anomaly_score"), "worst_feature", "flagged")


def baseline_scores(spark, sf_dir):
    """Every flight judged against itself."""
    return _score_columns(_scored(spark, sf_dir, ["source"]))


def pooled_baseline(spark, sf_dir):
    """All flights judged together."""
    return _score_columns(_scored(spark, sf_dir, []))


def _near_middle(value, at, error, slack=0.0):
    """Whether the rank of `at` among the values is a half, give or take `error` of them and one."""
    known, width = F.count(value), F.abs(at) * slack
    below, up_to = F.count_if(value < at - width), F.count_if(value <= at + width)
    return (below <= known * (0.5 + error) + 1) & (up_to >= known * (0.5 - error) - 1)


def sketched_stats(spark, sf_dir):
    """Medians and scales from sketches of two halves of the logs, merged, against their exact ranks in all rows."""
    rows = _judged(spark, sf_dir, "case_id")
    halves = [detector.sketch_logs(rows.where(F.col("case_id") % 2 == side), ["pool"]) for side in (0, 1)]
    table = materialize(detector.merge_sketches(halves, ["pool"]), "sketches")
    by_phase = sketches.robust(table.where(F.col("phase").isNotNull()), ["phase"], _COLUMNS).where(F.col("rows") >= MIN_PHASE_ROWS)
    whole = sketches.robust(sketches.merged([table], ["pool"], _COLUMNS).withColumnRenamed("pool", "phase"), ["phase"], _COLUMNS)
    stats = materialize(by_phase.unionByName(whole).drop("rows"), "sketched")
    levels = rows.unionByName(rows.withColumn("phase", F.col("pool"))).join(stats, "phase")
    told = []
    for c in _COLUMNS:
        median, away = F.col(f"{c}_median"), F.abs(F.col(c) - F.col(f"{c}_median"))
        none, error = F.count(c) == 0, sketches.scale_error()
        level = F.count_if(away * MAD_TO_STD < MIN_SCALE) >= F.count(c) * (0.5 - error) - 1  # other scales apply
        near = _near_middle(away, F.col(f"{c}_scale") / MAD_TO_STD, error, 1e-9)
        told += [(none | _near_middle(F.col(c), median, sketches.rank_error())).alias(f"{c}_median"), (none | level | near).alias(f"{c}_scale")]
    return levels.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), *told)


def _sketched_sql() -> str:
    told = ", ".join(f"true as {c}_{part}" for c in _COLUMNS for part in ("median", "scale"))
    counted = f"select phase, count(*) as rows from ({adapted_sql()}) group by phase"
    return f"""select phase, rows, {told} from ({counted}) where phase is not null and rows >= {MIN_PHASE_ROWS}
 union all select 'all', count(*), {told} from ({adapted_sql()})"""


def flight_flag_rates(spark, sf_dir):
    rates = report.flight_flag_rates(_scored(spark, sf_dir, []))
    return rates.select("source", "rows", "flagged", q("pct", 10).alias("pct"))


def top_suspicious(spark, sf_dir):
    scored = _scored(spark, sf_dir, []).withColumn("anomaly_score", q("anomaly_score"))
    return report.top_suspicious(scored.select("source", "row_idx", "anomaly_score", "worst_feature"))


def _both_detectors(spark, sf_dir):
    """Scored rows of both pooling modes, as a scored-rows table holds them; features are computed once."""
    features = materialize(log_features(spark, sf_dir), "log_features")
    parts = [
        detector.score_baseline(features, pool).select(F.lit(name).alias("detector"), F.col("source").alias("flight"), "speed", "flagged")
        for name, pool in (("Pooled cross-flight baseline", []), ("Same-flight baseline", ["source"]))
    ]
    return parts[0].unionByName(parts[1])


_RATES = ["flag_rate", "stationary_flag_rate", "moving_flag_rate"]


def stationary_rates(spark, sf_dir):
    table = report.stationary_rates(_both_detectors(spark, sf_dir))
    return table.select(
        "detector", "flight", "rows", "flagged", "stationary_rows", *[q(c, 1_000_000).alias(c) for c in _RATES]
    )


def detector_ranges(spark, sf_dir):
    table = report.detector_ranges(report.stationary_rates(_both_detectors(spark, sf_dir)))
    return table.select("detector", "flagged", "stationary")


# Titles: padded text, a title that is not Latin-1, and flights without any.
_TITLES = {
    '"MissionName"': """case when row_idx % 5 = 2 and case_id % 4 = 0 then concat('  Survey ', cast(case_id % 7 as string), ' ')
 when row_idx % 5 = 3 and case_id % 4 = 1 then '정찰' end""",
    '"FlightLogName"': """case when row_idx % 9 = 4 and case_id % 4 in (0, 1)
 then concat('log of day ', cast(row_idx as string)) end""",
}


def ground_track(spark, sf_dir):
    titled = raw_log(spark, sf_dir).selectExpr(
        "*", *[f"{text} as {name}".replace('"', "`") for name, text in _TITLES.items()]
    )
    logs = adapt_log(titled).withColumn("source", F.format_string("log_%d", F.col("case_id")))
    scored = detector.score_baseline(engineer_features(logs.drop("MissionName", "FlightLogName")), ["source"])
    titles = materialize(report.mission_titles(logs), "titles")
    track = report.ground_track(scored, titles)
    return track.select(
        "source", "row_idx", q("longitude", 10_000_000).alias("longitude"), q("latitude", 10_000_000).alias("latitude"),
        "flagged", "title",
    )


# --- comparison SQL -------------------------------------------------------


def _each(text: str, names=_COLUMNS, sep: str = ", ") -> str:
    return sep.join(text.replace("{c}", c) for c in names)


def detector_cte(pool: str) -> str:
    """CTEs up to `scored`; `pool` is an expression over case_id."""
    narrow = _each("cast(cast({c} as float) as double) as {c}", _JUDGED)
    features = features_sql(adapted_sql())

    def stats(keys: str, source: str, name: str) -> str:
        return f"""{name}_c as (select {keys}, {_each("median({c}) as m_{c}, stddev_samp({c}) as s_{c}")}
 from {source} group by {keys}),
 {name}_d as (select {keys}, {_each("median(abs({c} - m_{c})) as d_{c}")}
 from {source} join {name}_c using ({keys}) group by {keys}),
 {name} as (select {keys}, {_each('''m_{c}, case when d_{c} * 1.4826E0 < 1E-6 then case when s_{c} > 1E-6 then s_{c} end
  else d_{c} * 1.4826E0 end as k_{c}''')} from {name}_c join {name}_d using ({keys}))"""

    return f"""with f as materialized (select case_id, row_idx, longitude, latitude, speed, phase, {pool} as pool, {narrow} from ({features})),
 sizes as (select pool, phase, count(*) as n from f where phase is not null group by pool, phase),
 {stats("pool, phase", "f", "own")}, {stats("pool", "f", "whole")},
 chosen as (select z.pool, z.phase, {_each(f'''case when n >= {MIN_PHASE_ROWS} then own.m_{{c}} else whole.m_{{c}} end as m_{{c}},
  case when n >= {MIN_PHASE_ROWS} then own.k_{{c}} else whole.k_{{c}} end as k_{{c}}''')}
  from sizes z join own using (pool, phase) join whole using (pool)),
 bound as (select pool, greatest(3.0E0, 2 * quantile_cont(abs({_RATE}), 0.995)) as b from f group by pool),
 z as (select f.*, {_each("case when k_{c} is null then 0E0 else (f.{c} - m_{c}) / k_{c} end as z_{c}")},
  {Z_THRESHOLD}E0 * abs({_RATE}) / b as z_{_RATE}
  from f left join chosen on f.pool = chosen.pool and f.phase = chosen.phase join bound on f.pool = bound.pool),
 a as (select *, {_each("coalesce(abs(z_{c}), 0E0) as a_{c}", _JUDGED)} from z),
 g as (select *, greatest({_each("a_{c}", _JUDGED)}) as anomaly_score from a),
 scored as (select *, concat('log_', cast(case_id as varchar)) as source,
  case {_each("when a_{c} = anomaly_score then '{c}'", _JUDGED, " ")} end as worst_feature,
  anomaly_score > {Z_THRESHOLD}E0 as flagged from g)"""


_POOLED = detector_cte("'all'")
_SAME = detector_cte("case_id")
_SCORES = f"select case_id, row_idx, {q_sql('anomaly_score')} as anomaly_score, worst_feature, flagged from scored"

_RATES_SQL = """count(*) as n_rows, cast(sum(case when flagged then 1 else 0 end) as bigint) as hits,
 avg(case when flagged then 1E0 else 0E0 end) as flag_rate,
 cast(sum(case when coalesce(abs(speed) <= 0.5E0, false) then 1 else 0 end) as bigint) as stationary_rows,
 avg(case when coalesce(abs(speed) <= 0.5E0, false) then case when flagged then 1E0 else 0E0 end end) as stationary_flag_rate,
 avg(case when not coalesce(abs(speed) <= 0.5E0, false) then case when flagged then 1E0 else 0E0 end end) as moving_flag_rate"""


def _rates_sql() -> str:
    parts = [
        f"select * from ({cte} select '{name}' as detector, source as flight, {_RATES_SQL} from scored group by source)"
        for name, cte in (("Pooled cross-flight baseline", _POOLED), ("Same-flight baseline", _SAME))
    ]
    return " union all ".join(parts)


def _span(name: str) -> str:
    return f"printf('%.1f%%', min({name}) * 100) || ' - ' || printf('%.1f%%', max({name}) * 100)"


QUERIES = {
    "sketched_stats": sketched_stats,
    "phase_counts": phase_counts,
    "robust_stats": robust_stats,
    "robust_z": robust_z,
    "altitude_plausibility": altitude_plausibility,
    "baseline_scores": baseline_scores,
    "pooled_baseline": pooled_baseline,
    "flight_flag_rates": flight_flag_rates,
    "top_suspicious": top_suspicious,
    "stationary_rates": stationary_rates,
    "detector_ranges": detector_ranges,
    "ground_track": ground_track,
}

ORACLE = {
    "sketched_stats": _sketched_sql(),
    "phase_counts": f"""select phase, count(*) as "rows" from (
 select {_PHASE} as phase from ({raw_log_sql()})) where phase is not null group by phase""",
    "robust_stats": f"""{_POOLED} select phase, {_each(
        f"{q_sql('m_{c}', 1_000_000)} as {{c}}_median, {q_sql('k_{c}', 1_000_000)} as {{c}}_scale"
    )} from chosen""",
    "robust_z": f"{_POOLED} select case_id, row_idx, {_each(f'{q_sql("z_{c}")} as z_{{c}}')} from z",
    "altitude_plausibility": f"{_POOLED} select case_id, row_idx, {q_sql(f'z_{_RATE}')} as altitude_score from z",
    "baseline_scores": f"{_SAME} {_SCORES}",
    "pooled_baseline": f"{_POOLED} {_SCORES}",
    "flight_flag_rates": f"""{_POOLED} select source, count(*) as "rows",
 cast(sum(case when flagged then 1 else 0 end) as bigint) as flagged,
 {q_sql("round_even(avg(case when flagged then 1E0 else 0E0 end) * 100, 1)", 10)} as pct from scored group by source""",
    "top_suspicious": f"""{_POOLED} select source, row_idx, {q_sql("anomaly_score")} as anomaly_score, worst_feature
 from scored order by {q_sql("anomaly_score")} desc, source, row_idx limit 10""",
    "stationary_rates": f"""select detector, flight, n_rows as "rows", hits as flagged, stationary_rows,
 {", ".join(f"{q_sql(c, 1_000_000)} as {c}" for c in _RATES)} from ({_rates_sql()})""",
    "detector_ranges": f"""select detector, {_span("flag_rate")} as flagged, {_span("stationary_flag_rate")} as stationary
 from ({_rates_sql()}) group by detector""",
    "ground_track": f"""{_SAME}, titled as (select concat('log_', cast(case_id as varchar)) as source, row_idx,
  {", ".join(f"{text} as {name}" for name, text in _TITLES.items())} from ({raw_log_sql()})),
 firsts as (select source,
  trim(arg_min("MissionName", row_idx) filter ("MissionName" is not null)) as mission,
  trim(arg_min("FlightLogName", row_idx) filter ("FlightLogName" is not null)) as log_name from titled group by source)
 select s.source, s.row_idx, {q_sql("s.longitude", 10_000_000)} as longitude, {q_sql("s.latitude", 10_000_000)} as latitude,
 s.flagged, case when regexp_full_match(mission, '[\\x{{1}}-\\x{{FF}}]+') then mission
  when regexp_full_match(log_name, '[\\x{{1}}-\\x{{FF}}]+') then log_name else s.source end as title
 from scored s join firsts t on s.source = t.source""",
}
