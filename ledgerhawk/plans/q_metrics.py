"""Evaluation-metric queries (D23-D31, B11) over rule scores of the
transaction table, one long (model, txn_id, label, score) frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators.rules import base_models as bm
from ..operators.sampling import time_split
from ..sources import adapters as ad
from . import q_rules as qr
from .catalog import finish, register
from .oracle_views import with_views

SCORED = ("scored", f"""
SELECT 'financial' AS model, txn_id, label, {qr.FIN_SCORE} AS score FROM txn
UNION ALL SELECT 'security', txn_id, label, {qr.SEC_SCORE} FROM txn
UNION ALL SELECT 'amount_ratio', txn_id, label, amount / (amount + 50000.0) FROM txn""")
COUNTS = ("sc", """SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos,
                          count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY model, score""")
DESC = ("dc", """SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER (PARTITION BY model) AS p,
                        sum(neg) OVER (PARTITION BY model) AS n
                 FROM sc WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


def scored_frame(spark, sf):
    t = bm.security_risk(bm.financial_risk(ad.transactions(spark, sf)))
    a = t.select(F.lit("financial").alias("model"), "txn_id", "label", F.col("financial_score").alias("score"))
    b = t.select(F.lit("security").alias("model"), "txn_id", "label", F.col("security_score").alias("score"))
    c = t.select(F.lit("amount_ratio").alias("model"), "txn_id", "label",
                 (F.col("amount") / (F.col("amount") + 50000.0)).alias("score"))
    return a.unionByName(b).unionByName(c)


def ms(sql, extra=None):
    return with_views(sql, ["txn"], [SCORED] + (extra or []))


CONF_SQL = """SELECT model, tp, fp, tn, fn,
  CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
FROM (SELECT model, count(*) FILTER (WHERE score > 0.5 AND label = 1) AS tp,
             count(*) FILTER (WHERE score > 0.5 AND label <> 1) AS fp,
             count(*) FILTER (WHERE NOT score > 0.5 AND label <> 1) AS tn,
             count(*) FILTER (WHERE NOT score > 0.5 AND label = 1) AS fn FROM scored GROUP BY model) g"""
CONF_F1 = f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
  AS f1 FROM ({CONF_SQL}) c"""


@register("confusion", ms(CONF_F1))
def q_confusion(spark, sf):
    return finish(mt.confusion(scored_frame(spark, sf)))


AUC_SQL = """SELECT model, positives, negatives,
  CASE WHEN positives * negatives > 0 THEN CAST(num AS DOUBLE) / (2.0 * CAST(positives AS DOUBLE) * CAST(negatives AS DOUBLE))
       ELSE 0.5 END AS auc
FROM (SELECT model, sum(CAST(pos AS HUGEINT) * (2 * coalesce(nb, 0) + neg)) AS num, sum(pos) AS positives,
             sum(neg) AS negatives
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   AS nb FROM sc) x GROUP BY model) g"""


@register("auc_exact", ms(f"SELECT model, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives,"
                          f" auc FROM ({AUC_SQL}) a", [COUNTS]))
def q_auc(spark, sf):
    return finish(mt.auc(scored_frame(spark, sf)))


AP_SQL = """SELECT model, round(coalesce(sum(CASE WHEN p > 0 THEN pos / p * (cum_pos / (cum_pos + cum_neg)) END), 0.0), 12)
  AS average_precision FROM dc GROUP BY model"""


@register("average_precision", ms(AP_SQL, [COUNTS, DESC]))
def q_ap(spark, sf):
    return finish(mt.average_precision(scored_frame(spark, sf)).withColumn(
        "average_precision", F.round("average_precision", 12)))


@register("roc_points", ms("""
SELECT model, score AS threshold, CASE WHEN n > 0 THEN cum_neg / n ELSE 0.0 END AS fpr,
       CASE WHEN p > 0 THEN cum_pos / p ELSE 0.0 END AS tpr,
       CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END AS precision,
       CASE WHEN p > 0 THEN cum_pos / p ELSE 0.0 END AS recall FROM dc""", [COUNTS, DESC]))
def q_roc(spark, sf):
    return finish(mt.curve_points(scored_frame(spark, sf)))


SWEEP_SQL = """SELECT model, threshold, precision, recall, tp, fp, tn, fn, flagged_transactions, false_positive_rate,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score
FROM (SELECT model, threshold, tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, tp + fp AS flagged_transactions,
             CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_positive_rate
      FROM (SELECT model, t.threshold, count(*) FILTER (WHERE score > t.threshold AND label = 1) AS tp,
                   count(*) FILTER (WHERE score > t.threshold AND label <> 1) AS fp,
                   count(*) FILTER (WHERE NOT score > t.threshold AND label <> 1) AS tn,
                   count(*) FILTER (WHERE NOT score > t.threshold AND label = 1) AS fn
            FROM scored, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) t
            GROUP BY model, t.threshold) g
      WHERE tp + fp > 0 AND tn + fn > 0) x"""


@register("threshold_sweep", ms(SWEEP_SQL))
def q_sweep(spark, sf):
    return finish(mt.threshold_sweep(scored_frame(spark, sf)))


@register("prediction_stats", ms("""
SELECT model, round(avg(score), 12) AS mean, round(stddev_pop(score), 12) AS std, min(score) AS min,
       max(score) AS max, count(DISTINCT round(score, 4)) AS unique_values,
       count(*) FILTER (WHERE score > 0.8) AS high_confidence, count(*) FILTER (WHERE score < 0.1) AS low_confidence
FROM scored GROUP BY model"""))
def q_pred_stats(spark, sf):
    s = mt.prediction_stats(scored_frame(spark, sf))
    return finish(s.withColumn("mean", F.round("mean", 12)).withColumn("std", F.round("std", 12)))


@register("model_comparison", ms(f"""
SELECT a.model, a.auc, round(p.average_precision, 12) AS average_precision, c.f1,
       arg_max(a.model, (a.auc, a.model)) OVER () AS best_by_auc, arg_max(a.model, (c.f1, a.model)) OVER () AS best_by_f1
FROM ({AUC_SQL}) a JOIN ({AP_SQL}) p USING (model) JOIN ({CONF_F1}) c USING (model)""", [COUNTS, DESC]))
def q_model_comparison(spark, sf):
    m = mt.model_comparison(scored_frame(spark, sf))
    return finish(m.select("model", "auc", F.round("average_precision", 12).alias("average_precision"), "f1",
                           "best_by_auc", "best_by_f1"))


@register("deployment_verdict", ms(f"""
SELECT a.model, a.auc, round(p.average_precision, 12) AS average_precision,
  CASE WHEN a.auc >= 0.85 AND p.average_precision >= 0.15 THEN 'EXCELLENT'
       WHEN a.auc >= 0.80 AND p.average_precision >= 0.10 THEN 'GOOD' WHEN a.auc >= 0.75 THEN 'FAIR'
       ELSE 'POOR' END AS recommendation,
  b.threshold AS optimal_threshold, b.precision AS expected_precision, b.recall AS expected_recall,
  b.f1_score AS expected_f1
FROM ({AUC_SQL}) a JOIN ({AP_SQL}) p USING (model) LEFT JOIN (
  SELECT model, arg_max(threshold, (f1_score, -threshold)) AS threshold,
         arg_max(precision, (f1_score, -threshold)) AS precision, arg_max(recall, (f1_score, -threshold)) AS recall,
         max(f1_score) AS f1_score FROM ({SWEEP_SQL}) s GROUP BY model) b USING (model)""", [COUNTS, DESC]))
def q_verdict(spark, sf):
    v = mt.deployment_verdict(scored_frame(spark, sf))
    return finish(v.withColumn("average_precision", F.round("average_precision", 12)))


@register("class_weights", with_views("""
SELECT positives, negatives, CASE WHEN positives > 0 THEN negatives / positives ELSE 1.0 END AS scale_pos_weight,
       CASE WHEN positives > 0 THEN (positives + negatives) / (2 * positives) ELSE 0.0 END AS weight_positive,
       CASE WHEN negatives > 0 THEN (positives + negatives) / (2 * negatives) ELSE 0.0 END AS weight_negative
FROM (SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label <> 1) AS negatives FROM txn) g""",
    ["txn"]))
def q_class_weights(spark, sf):
    return finish(mt.class_weights(ad.transactions(spark, sf)))


@register("time_split_counts", with_views("""
SELECT is_train, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives FROM (
  SELECT label, row_number() OVER (ORDER BY ts, txn_id) <= floor(count(*) OVER () * 0.8) AS is_train FROM txn) s
GROUP BY is_train""", ["txn"]))
def q_time_split(spark, sf):
    t = time_split(ad.transactions(spark, sf), "ts", "txn_id", 0.8)
    return finish(t.groupBy("is_train").agg(F.count(F.lit(1)).alias("rows"),
                                            F.count_if(F.col("label") == 1).alias("positives")))
