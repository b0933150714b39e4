"""Audit aggregations over all three profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .feature_queries import unclear_order, unclear_order_sql
from .view import all_profiles, all_profiles_sql, q, q_sql

_ALL = all_profiles_sql()
_BY = ["profile"]


def audit_summary(spark, sf_dir):
    table = audit.summary(all_profiles(spark, sf_dir), _BY, labels=(0, 1))
    return table.select(
        "profile",
        F.col("rows").alias("n_rows"),
        F.col("label_0_rows").alias("normal_rows"),
        F.col("label_1_rows").alias("tampered_rows"),
        q("anomaly_rate", 100_000).alias("anomaly_rate"),
        "cases",
        F.unix_millis("ts_min").alias("ts_min"),
        F.unix_millis("ts_max").alias("ts_max"),
        "epoch_rows",
    )


def audit_cases_approx(spark, sf_dir):
    """Flights per profile from merged sketches of its replicates, within 2 percent of the exact number."""
    rows = all_profiles(spark, sf_dir)
    told = audit.approximate_cases(audit.case_sketches(rows), _BY)
    exact = rows.select("profile", "replicate", "case_id").distinct().groupBy("profile").agg(F.count(F.lit(1)).alias("exact"))
    near = F.abs(F.col("cases") - F.col("exact")) <= 0.02 * F.col("exact")
    return told.join(exact, "profile").select("profile", F.col("rows").alias("n_rows"), F.col("exact").alias("cases"), near.alias("within"))


def audit_case_labels(spark, sf_dir):
    return audit.case_label_counts(all_profiles(spark, sf_dir), _BY)


def audit_type_cases(spark, sf_dir):
    return audit.type_cases(all_profiles(spark, sf_dir), _BY)


def audit_missing(spark, sf_dir):
    holes = F.when(F.col("row_idx") % 7 != 3, F.col("heading"))
    rows = all_profiles(spark, sf_dir).drop("timestamp").withColumn("heading", holes)
    return audit.missing(rows, _BY)


def audit_time_order(spark, sf_dir):
    return audit.time_order(all_profiles(spark, sf_dir), _BY).select(
        "profile",
        q("ts_decrease_frac", 1_000_000).alias("ts_decrease_frac"),
        q("ts_max_gap_s", 1000).alias("ts_max_gap_s"),
        "ts_gaps_gt_60s",
    )


def audit_duplicates(spark, sf_dir):
    """Every tampered row occurs twice."""
    rows = all_profiles(spark, sf_dir).drop("timestamp")
    return audit.duplicates(rows.unionByName(rows.where(F.col("label") == 1)), _BY)


def _with_holes(spark, sf_dir):
    holes = F.when(F.col("row_idx") % 7 != 3, F.col("heading"))
    return all_profiles(spark, sf_dir).withColumn("heading", holes)


def audit_records(spark, sf_dir):
    """The whole audit, a record per profile and replicate."""
    rows = _with_holes(spark, sf_dir)
    records = audit.audit(rows.unionByName(rows.where((F.col("label") == 1) & (F.col("row_idx") % 5 == 0))))
    held = lambda name, key: F.coalesce(F.try_element_at(name, F.lit(key)), F.lit(0))
    return records.select(
        "profile", "replicate", F.col("rows").alias("n_rows"), "cases", "epoch_rows",
        held("label_counts", "1").alias("tampered_rows"),
        held("case_label_counts", "1").alias("tampered_cases"),
        F.size("tamper_type_cases").alias("types"),
        held("missing", "heading").alias("missing_heading"),
        q("ts_max_gap_s", 1000).alias("ts_max_gap_s"),
        "exact_duplicate_rows", "duplicate_rows_ignoring_idx",
    )


def audit_places(spark, sf_dir):
    return audit.repeated_places(unclear_order(spark, sf_dir), ["replicate"])


_CONTENT = """replicate, label, tamper_type, case_name, t_ms, latitude, longitude, altitude, speed, heading,
 score_a, score_b, phase"""

QUERIES = {
    "audit_summary": audit_summary,
    "audit_case_labels": audit_case_labels,
    "audit_type_cases": audit_type_cases,
    "audit_missing": audit_missing,
    "audit_time_order": audit_time_order,
    "audit_duplicates": audit_duplicates,
    "audit_places": audit_places,
    "audit_records": audit_records,
    "audit_cases_approx": audit_cases_approx,
}

ORACLE = {
    "audit_records": f"""with t as (select * replace (case when row_idx % 7 <> 3 then heading end as heading) from ({_ALL})),
 a as (select * from t union all select * from t where label = 1 and row_idx % 5 = 0),
 m as (select profile, replicate, case_id, max(label) as label from a group by all),
 w as (select profile, replicate, t_ms - lag(t_ms) over (partition by profile, replicate, case_id order by row_idx) as delta from a),
 e as (select profile, replicate, count(*) as n from a group by profile, case_id, row_idx, {_CONTENT}),
 i as (select profile, replicate, count(*) as n from a group by profile, {_CONTENT})
 select s.profile, s.replicate, n_rows, cases, epoch_rows, tampered_rows, tampered_cases, types, missing_heading, ts_max_gap_s,
  exact_duplicate_rows, duplicate_rows_ignoring_idx from
 (select profile, replicate, count(*) as n_rows, count(distinct case_id) as cases,
   cast(sum(case when t_ms < 63072000000 then 1 else 0 end) as bigint) as epoch_rows, cast(sum(label) as bigint) as tampered_rows,
   count(distinct tamper_type) as types, count(*) - count(heading) as missing_heading from a group by all) s
 join (select profile, replicate, cast(sum(label) as bigint) as tampered_cases from m group by all) c using (profile, replicate)
 join (select profile, replicate, {q_sql("max(delta) / 1000E0", 1000)} as ts_max_gap_s from w group by all) g using (profile, replicate)
 join (select profile, replicate, cast(sum(n - 1) as bigint) as exact_duplicate_rows from e group by all) x using (profile, replicate)
 join (select profile, replicate, cast(sum(n - 1) as bigint) as duplicate_rows_ignoring_idx from i group by all) y using (profile, replicate)""",
    "audit_cases_approx": f"""select profile, sum(n) as n_rows, count(*) as cases, true as within
 from (select profile, replicate, case_id, count(*) as n from ({_ALL}) group by all) group by profile""",
    "audit_places": f"""select replicate, cast(sum(case when row_idx is not null then n - 1 else 0 end) as bigint) as repeated_places,
 cast(sum(case when row_idx is null then n else 0 end) as bigint) as missing_places,
 count(distinct case when row_idx is null or n > 1 then case_id end) as cases_with_unclear_order
 from (select replicate, case_id, row_idx, count(*) as n from ({unclear_order_sql()}) group by all) group by replicate""",
    "audit_summary": f"""select profile, count(*) as n_rows,
 cast(sum(case when label = 0 then 1 else 0 end) as bigint) as normal_rows,
 cast(sum(label) as bigint) as tampered_rows,
 {q_sql("avg(cast(label as double))", 100_000)} as anomaly_rate, count(distinct case_id) as cases,
 min(t_ms) as ts_min, max(t_ms) as ts_max,
 cast(sum(case when t_ms < 63072000000 then 1 else 0 end) as bigint) as epoch_rows
 from ({_ALL}) group by profile""",
    "audit_case_labels": f"""select profile, case_label, count(*) as cases from (
 select profile, case_id, max(label) as case_label from ({_ALL}) group by profile, case_id)
 group by profile, case_label""",
    "audit_type_cases": f"""select profile, tamper_type, count(distinct case_id) as cases from ({_ALL})
 group by profile, tamper_type""",
    "audit_missing": f"""select profile, 'heading' as "column",
 cast(sum(case when row_idx % 7 = 3 then 1 else 0 end) as bigint) as missing from ({_ALL}) group by profile""",
    "audit_time_order": f"""select profile,
 {q_sql("sum(case when delta < 0 then 1 else 0 end) / cast(count(*) as double)", 1_000_000)} as ts_decrease_frac,
 {q_sql("max(delta) / 1000E0", 1000)} as ts_max_gap_s,
 cast(sum(case when delta > 60000 then 1 else 0 end) as bigint) as ts_gaps_gt_60s
 from (select profile, t_ms - lag(t_ms) over (partition by profile, case_id order by row_idx) as delta
  from ({_ALL})) group by profile""",
    "audit_duplicates": f"""with t as (select * from ({_ALL})),
 d as (select * from t union all select * from t where label = 1)
 select a.profile, a.extra as exact_duplicate_rows, b.extra as duplicate_rows_ignoring_idx from
 (select profile, cast(sum(n - 1) as bigint) as extra from (
   select profile, count(*) as n from d group by profile, case_id, row_idx, {_CONTENT}) group by profile) a join
 (select profile, cast(sum(n - 1) as bigint) as extra from (
   select profile, count(*) as n from d group by profile, {_CONTENT}) group by profile) b on a.profile = b.profile""",
}
