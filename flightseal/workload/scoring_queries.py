"""Ranking metrics, flight and type tables, replicate summaries on the view's two scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TAMPER_TYPES
from ..operators import casewise, ranking, report
from ..plans import evaluation
from ..session import materialize
from .sampling_queries import split, split_sql
from .view import all_profiles, all_profiles_sql, q, q_sql, telemetry, telemetry_sql

MODELS = {"score_a": "GradientBoosting", "score_b": "LinearSVC"}
PREFIX = {"GradientBoosting": "gb", "LinearSVC": "svm"}
_M = 1_000_000
_VALUES = list(ranking.METRICS)


def profile_scores(spark, sf_dir):
    """Label and score of every row, model and profile."""
    rows = all_profiles(spark, sf_dir).select("profile", "label", *MODELS)
    return evaluation.long_scores(rows, MODELS)


_GROUP = ["profile", "model"]


def _ranked(spark, sf_dir):
    return ranking.ranked_scores(profile_scores(spark, sf_dir), _GROUP)


def pr_curve(spark, sf_dir):
    curve = ranking.pr_curve(_ranked(spark, sf_dir))
    return curve.select(
        *_GROUP, q("score").alias("score"), *[q(c, _M).alias(c) for c in ("precision", "recall", "f1")]
    )


def best_threshold(spark, sf_dir):
    best = ranking.best_thresholds(_ranked(spark, sf_dir), _GROUP)
    return best.select(*_GROUP, q("threshold").alias("threshold"))


def roc_auc(spark, sf_dir):
    table = ranking.ranking_quality(_ranked(spark, sf_dir), _GROUP)
    return table.select(*_GROUP, "n", "pos", q("roc_auc", _M).alias("roc_auc"))


def average_precision(spark, sf_dir):
    table = ranking.ranking_quality(_ranked(spark, sf_dir), _GROUP)
    return table.select(*_GROUP, q("pr_auc", _M).alias("pr_auc"))


def threshold_metrics(spark, sf_dir):
    table = ranking.threshold_metrics(profile_scores(spark, sf_dir), _GROUP, F.lit(0.4))
    names = ["f1", "prec", "rec", "bal_acc", "mcc"]
    return table.select(*_GROUP, "n", "pos", "tp", "fp", *[q(c, _M).alias(c) for c in names])


def scored(spark, sf_dir):
    """Long scores with datasets: holdout of balanced, all of strong and subtle; written, as tables are made from them several times."""
    rows = all_profiles(spark, sf_dir)
    held = split(spark, sf_dir)
    tagged = evaluation.with_dataset(rows, held, ["replicate", "case_id"])
    slim = tagged.select("dataset", "replicate", "case_id", "label", "tamper_type", "case_name", *MODELS)
    return materialize(evaluation.long_scores(slim, MODELS), "scored")


def _metric_columns(table, *keys):
    return table.select(*keys, "n", "pos", *[q(c, _M).alias(c) for c in _VALUES])


def metrics_table(spark, sf_dir):
    ranked = evaluation.rank(scored(spark, sf_dir))
    return _metric_columns(evaluation.metrics(ranked, evaluation.tune(ranked)), "dataset", "model")


def case_scores(spark, sf_dir):
    cases = casewise.case_scores(telemetry(spark, sf_dir), scores=list(MODELS))
    return cases.select("case_id", "label", *[q(c).alias(c) for c in MODELS])


def case_metrics(spark, sf_dir):
    ranked = evaluation.rank(evaluation.flights_of(scored(spark, sf_dir)))
    return _metric_columns(evaluation.metrics(ranked, evaluation.tune(ranked)), "dataset", "model")


def _type_rows(spark, sf_dir):
    rows = scored(spark, sf_dir)
    held = rows.where(F.col("dataset") == evaluation.HOLDOUT)
    long = evaluation.type_rows(rows, evaluation.tune(evaluation.rank(held)))
    return casewise.side_by_side(long, ["dataset", "tamper_type", "n_rows"], PREFIX, ["flag_rate", "pr_auc", "f1"])


def per_type_row(spark, sf_dir):
    names = [f"{p}_{f}" for f in ("flag_rate", "pr_auc", "f1") for p in PREFIX.values()]
    return _type_rows(spark, sf_dir).select("dataset", "tamper_type", "n_rows", *[q(c, _M).alias(c) for c in names])


def case_types(spark, sf_dir):
    return casewise.case_types(telemetry(spark, sf_dir), scores=["score_a"]).select(
        "case_id", "type", q("score_a").alias("score_a")
    )


def per_type_case(spark, sf_dir):
    rows = scored(spark, sf_dir)
    held = rows.where(F.col("dataset") == evaluation.HOLDOUT)
    thresholds = evaluation.tune(evaluation.rank(evaluation.flights_of(held)))
    table = casewise.side_by_side(
        evaluation.type_cases(rows, thresholds), ["dataset", "tamper_type", "n_cases"], PREFIX, ["flag_rate"]
    )
    return table.select("dataset", "tamper_type", "n_cases", *[q(f"{p}_flag_rate", _M).alias(f"{p}_flag_rate") for p in PREFIX.values()])


def replicate_metrics(spark, sf_dir):
    """The row protocol of every replicate, thresholds tuned per replicate."""
    by = ["replicate"]
    ranked = evaluation.rank(scored(spark, sf_dir), by)
    return evaluation.metrics(ranked, evaluation.tune(ranked, by), by)


def robustness_rows(spark, sf_dir):
    return _metric_columns(replicate_metrics(spark, sf_dir), "replicate", "dataset", "model")


_SUMMED = ["pr_auc", "roc_auc", "f1", "bal_acc"]


def robustness_summary(spark, sf_dir):
    table = report.summarise(ranking.rounded(replicate_metrics(spark, sf_dir)), ["dataset", "model"], _SUMMED)
    return table.select(
        "dataset", "model", *[q(f"{m}_{part}", _M).alias(f"{m}_{part}") for m in _SUMMED for part in ("mean", "std")]
    )


def robustness_parse(spark, sf_dir):
    table = report.summarise(replicate_metrics(spark, sf_dir), ["dataset", "model"], ["pr_auc"])
    parsed = report.parse_mean_std(table.select("dataset", "model", "pr_auc"), "pr_auc")
    return parsed.select("dataset", "model", q("mean").alias("mean"), q("std").alias("std"))


def pivot_metrics(spark, sf_dir):
    table = replicate_metrics(spark, sf_dir)
    wide = report.pivot_metric(table, ["dataset", "replicate"], "model", list(MODELS.values()), "pr_auc")
    return wide.select("dataset", "replicate", *[q(m, _M).alias(PREFIX[m]) for m in MODELS.values()])


def report_metrics(spark, sf_dir):
    ranked = evaluation.rank(scored(spark, sf_dir))
    table = report.row_report(evaluation.metrics(ranked, evaluation.tune(ranked)))
    shown = {"PR-AUC": "pr_auc", "ROC-AUC": "roc_auc", "F1": "f1", "MCC": "mcc"}
    return table.select("Dataset", "Model", *[q(F.col(f"`{a}`"), _M).alias(b) for a, b in shown.items()])


def report_types(spark, sf_dir):
    table = report.type_report(_type_rows(spark, sf_dir), "subtle")
    return table.toDF("tamper_type", "records", "gb_pr_auc", "svm_pr_auc", "gb_flagged", "svm_flagged")


def type_matrix(spark, sf_dir):
    table = report.type_matrix(_type_rows(spark, sf_dir), ["strong", "subtle"], ["gb_pr_auc", "svm_pr_auc"])
    return table.select("tamper_type", *[q(c, _M).alias(c) for c in table.columns if c != "tamper_type"])


# --- comparison SQL -------------------------------------------------------


def _long_sql(source: str, columns: str) -> str:
    return " union all ".join(
        f"select {columns}, '{name}' as model, {c} as score from ({source})" for c, name in MODELS.items()
    )


def _scored_sql() -> str:
    tagged = f"""select t.*, case when t.profile <> 'balanced' then t.profile else 'balanced_holdout' end as dataset
 from ({all_profiles_sql()}) t join ({split_sql()}) s on t.replicate = s.replicate and t.case_id = s.case_id
 where t.profile <> 'balanced' or s.is_holdout"""
    return _long_sql(tagged, "dataset, replicate, case_id, label, tamper_type, case_name")


def _ranked_cte(source: str, keys: str, name: str = "ranked") -> str:
    """CTEs with cumulative counts by descending score."""
    return f"""{name} as (select *,
 sum(pos) over w as cum_pos, sum(n) over w as cum_n,
 sum(pos) over (partition by {keys}) as total_pos, sum(n) over (partition by {keys}) as total_n from (
  select {keys}, score, cast(sum(label) as bigint) as pos, count(*) as n from ({source}) group by {keys}, score)
 window w as (partition by {keys} order by score desc)),
 {name}_curve as (select *, cum_pos / cast(cum_n as double) as p,
  case when total_pos = 0 then 1E0 else cum_pos / cast(total_pos as double) end as r from {name}),
 {name}_best as (select {keys}, score as threshold from (
  select *, row_number() over (partition by {keys} order by p * 2E0 * r / (p + r + 1E-12) desc, score) as best
  from {name}_curve) where best = 1)"""


_AUC = """1E0 - sum(pos * (cast(cum_n - cum_pos as double) - 0.5E0 * (n - pos)))
 / nullif(max(total_pos) * cast(max(total_n) - max(total_pos) as double), 0)"""
_AP = "coalesce(sum(pos * (cum_pos / cast(cum_n as double))) / nullif(cast(max(total_pos) as double), 0), 0)"


def _metrics_sql(cte: str, keys: str, join: str, threshold_table: str) -> str:
    """Metric record per group from the ranked CTE and a threshold table."""
    counted = f"""select {', '.join('r.' + k for k in keys.split(', '))}, cast(sum(n) as bigint) as n,
 cast(sum(pos) as bigint) as pos, {_AUC} as roc_auc, {_AP} as pr_auc,
 cast(sum(case when score >= threshold then pos else 0 end) as double) as tp,
 cast(sum(case when score >= threshold then n - pos else 0 end) as double) as fp
 from {cte} r join {threshold_table} b on {join} group by {', '.join('r.' + k for k in keys.split(', '))}"""
    return f"select *, {_THRESHOLD} from ({counted})"


_THRESHOLD = """coalesce(2 * tp / nullif(tp + fp + pos, 0), 0) as f1, coalesce(tp / nullif(tp + fp, 0), 0) as prec,
 coalesce(tp / nullif(cast(pos as double), 0), 0) as rec,
 case when pos = 0 then (n - pos - fp) / (n - pos) when n = pos then tp / pos
  else 0.5E0 * (tp / pos + (n - pos - fp) / (n - pos)) end as bal_acc,
 coalesce((tp * (n - pos - fp) - fp * (pos - tp))
  / nullif(sqrt(cast(tp + fp as double)) * sqrt(cast(pos as double)) * sqrt(cast(n - pos as double))
   * sqrt(cast(n - tp - fp as double)), 0), 0) as mcc"""


def _q_all(names, scale=_M) -> str:
    return ", ".join(f"{q_sql(n, scale)} as {n}" for n in names)


_LONG = _long_sql(all_profiles_sql(), "profile, label")
_LONG_CTE = "with " + _ranked_cte(_LONG, "profile, model")
_SCORED = f"s as ({_scored_sql()})"
_HOLD = "select * from s where dataset = 'balanced_holdout'"

_ROW_CTES = f"""with {_SCORED}, {_ranked_cte(_HOLD, 'model', 'hold')}, {_ranked_cte('select * from s', 'dataset, model')},
 m as ({_metrics_sql('ranked', 'dataset, model', 'r.model = b.model', 'hold_best')})"""

_REP_CTES = f"""with {_SCORED}, {_ranked_cte(_HOLD, 'replicate, model', 'hold')},
 {_ranked_cte('select * from s', 'replicate, dataset, model')},
 m as ({_metrics_sql('ranked', 'replicate, dataset, model', 'r.model = b.model and r.replicate = b.replicate', 'hold_best')})"""

_FLIGHTS = "select dataset, model, case_id, max(label) as label, max(score) as score from s group by all"
_CASE_CTES = f"""with {_SCORED}, flights as ({_FLIGHTS}),
 {_ranked_cte("select * from flights where dataset = 'balanced_holdout'", 'model', 'hold')},
 {_ranked_cte('select * from flights', 'dataset, model')},
 m as ({_metrics_sql('ranked', 'dataset, model', 'r.model = b.model', 'hold_best')})"""


def _types_cte() -> str:
    """Every type against normal, one filtered pass per type (independent of the one-pass plan)."""
    parts = []
    for t in TAMPER_TYPES:
        sub = f"""select dataset, model, case when tamper_type = '{t}' then 1 else 0 end as label, score from s
 where dataset <> 'balanced_holdout' and tamper_type in ('{t}', 'normal')"""
        parts.append(
            f"""select dataset, model, '{t}' as tamper_type, cast(sum(pos) as bigint) as n_rows,
 sum(case when score >= threshold then pos else 0 end) / cast(greatest(sum(pos), 1) as double) as flag_rate,
 {_AP} as pr_auc,
 cast(sum(case when score >= threshold then pos else 0 end) as double) as tp,
 cast(sum(case when score >= threshold then n - pos else 0 end) as double) as fp
 from (select *, sum(pos) over w as cum_pos, sum(n) over w as cum_n, sum(pos) over (partition by dataset, model) as total_pos
  from (select dataset, model, score, sum(label) as pos, count(*) as n from ({sub}) group by all)
  window w as (partition by dataset, model order by score desc)) r join hold_best b using (model)
 group by dataset, model"""
        )
    manipulated = " union all ".join(parts)
    return f"""types as (select dataset, model, tamper_type, n_rows, flag_rate, pr_auc,
 2 * (tp / greatest(tp + fp, 1)) * flag_rate / greatest(tp / greatest(tp + fp, 1) + flag_rate, 1E-12) as f1
 from ({manipulated}) union all
 select dataset, model, 'normal', count(*), avg(case when score >= threshold then 1E0 else 0E0 end), null, null
 from s join hold_best b using (model) where dataset <> 'balanced_holdout' and tamper_type = 'normal'
 group by dataset, model),
 wide as (select dataset, tamper_type, n_rows, {", ".join(
        f"max(case when model = '{m}' then {f} end) as {p}_{f}" for f in ("flag_rate", "pr_auc", "f1") for m, p in PREFIX.items()
    )} from types group by dataset, tamper_type, n_rows)"""


_TYPE_CTES = f"with {_SCORED}, {_ranked_cte(_HOLD, 'model', 'hold')}, {_types_cte()}"
_TYPE_NAMES = [f"{p}_{f}" for f in ("flag_rate", "pr_auc", "f1") for p in PREFIX.values()]


def _label_sql(column: str, labels: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in labels.items()) + f" else {column} end"


def _percent_sql(column: str) -> str:
    return f"printf('%.1f%%', {column} * 100)"


def _ap_sql(column: str) -> str:
    return f"case when {column} is null then '-' else printf('%.3f', {column}) end"


_TYPE_VALUES = ", ".join(f"('{t}')" for t in casewise.ALL_TYPES)

QUERIES = {
    "pr_curve": pr_curve,
    "best_threshold": best_threshold,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "threshold_metrics": threshold_metrics,
    "metrics_table": metrics_table,
    "case_scores": case_scores,
    "case_metrics": case_metrics,
    "per_type_row": per_type_row,
    "case_types": case_types,
    "per_type_case": per_type_case,
    "robustness_rows": robustness_rows,
    "robustness_summary": robustness_summary,
    "robustness_parse": robustness_parse,
    "pivot_metrics": pivot_metrics,
    "report_metrics": report_metrics,
    "report_types": report_types,
    "type_matrix": type_matrix,
}

ORACLE = {
    "pr_curve": f"""{_LONG_CTE} select profile, model, {q_sql("score")} as score, {q_sql("p", _M)} as "precision",
 {q_sql("r", _M)} as recall, {q_sql("p * 2E0 * r / (p + r + 1E-12)", _M)} as f1 from ranked_curve""",
    "best_threshold": f"{_LONG_CTE} select profile, model, {q_sql('threshold')} as threshold from ranked_best",
    "roc_auc": f"""select profile, model, count(*) as n, cast(sum(label) as bigint) as pos, {q_sql(
        "sum(case when label = 1 then below + 0.5E0 * tied end) / (sum(label) * cast(count(*) - sum(label) as double))", _M
    )} as roc_auc from (
 select *, sum(1 - label) over (partition by profile, model, score) as tied,
  sum(1 - label) over (partition by profile, model order by score) - tied as below
 from ({_LONG})) group by profile, model""",
    "average_precision": f"{_LONG_CTE} select profile, model, {q_sql(_AP, _M)} as pr_auc from ranked group by profile, model",
    "threshold_metrics": f"""select profile, model, n, pos, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
 {_q_all(["f1", "prec", "rec", "bal_acc", "mcc"])} from (select *, {_THRESHOLD} from (
 select profile, model, count(*) as n, cast(sum(label) as bigint) as pos,
  cast(sum(case when score >= 0.4E0 then label else 0 end) as double) as tp,
  cast(sum(case when score >= 0.4E0 then 1 - label else 0 end) as double) as fp
 from ({_LONG}) group by profile, model))""",
    "metrics_table": f"{_ROW_CTES} select dataset, model, n, pos, {_q_all(_VALUES)} from m",
    "case_scores": f"""select case_id, max(label) as label, {q_sql("max(score_a)")} as score_a,
 {q_sql("max(score_b)")} as score_b from ({telemetry_sql()}) group by case_id""",
    "case_metrics": f"{_CASE_CTES} select dataset, model, n, pos, {_q_all(_VALUES)} from m",
    "per_type_row": f"{_TYPE_CTES} select dataset, tamper_type, n_rows, {_q_all(_TYPE_NAMES)} from wide",
    "case_types": f"""select case_id, substr(min(case_name), 11) as type, {q_sql("max(score_a)")} as score_a
 from ({telemetry_sql()}) group by case_id""",
    "per_type_case": f"""{_CASE_CTES}, names as (select dataset, model, case_id, substr(min(case_name), 11) as type,
 max(score) as score from s where dataset <> 'balanced_holdout' group by all),
 listed as (select * from (select distinct dataset, model from names), (values {_TYPE_VALUES}) v(tamper_type)),
 long as (select l.dataset, l.model, l.tamper_type, count(n.case_id) as n_cases,
  avg(case when n.case_id is not null then case when n.score >= b.threshold then 1E0 else 0E0 end end) as flag_rate
  from listed l left join names n on l.dataset = n.dataset and l.model = n.model and l.tamper_type = n.type
  join hold_best b on b.model = l.model group by l.dataset, l.model, l.tamper_type)
 select dataset, tamper_type, n_cases,
 {", ".join(q_sql(f"max(case when model = '{m}' then flag_rate end)", _M) + f" as {p}_flag_rate" for m, p in PREFIX.items())}
 from long group by dataset, tamper_type, n_cases""",
    "robustness_rows": f"{_REP_CTES} select replicate, dataset, model, n, pos, {_q_all(_VALUES)} from m",
    "robustness_summary": f"""{_REP_CTES} select dataset, model, {", ".join(
        f'{q_sql(f"avg({c}4)", _M)} as {c}_mean, {q_sql(f"stddev_pop({c}4)", _M)} as {c}_std' for c in _SUMMED
    )} from (select *, {", ".join(f"round_even({c}, 4) as {c}4" for c in _SUMMED)} from m) group by dataset, model""",
    "robustness_parse": f"""{_REP_CTES} select dataset, model,
 {q_sql("cast(printf('%.4f', avg(pr_auc)) as double)")} as "mean",
 {q_sql("cast(printf('%.4f', stddev_pop(pr_auc)) as double)")} as std from m group by dataset, model""",
    "pivot_metrics": f"""{_REP_CTES} select dataset, replicate,
 {q_sql("max(case when model = 'GradientBoosting' then pr_auc end)", _M)} as gb,
 {q_sql("max(case when model = 'LinearSVC' then pr_auc end)", _M)} as svm from m group by dataset, replicate""",
    "report_metrics": f"""{_ROW_CTES} select {_label_sql("dataset", report.DATASET_LABELS)} as "Dataset",
 {_label_sql("model", report.MODEL_LABELS)} as "Model", {_q_all(["pr_auc", "roc_auc", "f1", "mcc"])} from m""",
    "report_types": f"""{_TYPE_CTES} select tamper_type, format('{{:,}}', n_rows) as records,
 {_ap_sql("gb_pr_auc")} as gb_pr_auc, {_ap_sql("svm_pr_auc")} as svm_pr_auc,
 {_percent_sql("gb_flag_rate")} as gb_flagged, {_percent_sql("svm_flag_rate")} as svm_flagged
 from wide where dataset = 'subtle'""",
    "type_matrix": f"""{_TYPE_CTES} select tamper_type, {", ".join(
        q_sql(f"max(case when dataset = '{d}' then {c} end)", _M) + f" as {d}_{c}"
        for d in ("strong", "subtle") for c in ("gb_pr_auc", "svm_pr_auc")
    )} from wide where tamper_type <> 'normal' group by tamper_type""",
}
