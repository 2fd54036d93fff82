"""Checkable queries for sampling and splitting (I), encoding and scaling (J)
and evaluation (N, H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import encode as J
from flowsift.operators import evaluate as N
from flowsift.operators import sample as I
from flowsift.plans import oracle_views as V
from flowsift.plans.catalog_core import labeled, raw
from flowsift.plans.registry import query
from flowsift.sources.views import flows, read_table

KEY = "md5('42:' || CAST(uid AS VARCHAR))"


def _cum_case(rank: str, n: str, names, fracs) -> str:
    acc, parts = 0.0, []
    for name, f in zip(names[:-1], fracs[:-1]):
        acc += f
        parts.append(f"WHEN {rank} < round({n} * CAST({acc!r} AS DOUBLE)) THEN '{name}'")
    return f"CASE {' '.join(parts)} ELSE '{names[-1]}' END"


def _ranked(view: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}) - 1 AS rk, "
            f"count(*) OVER (PARTITION BY label) AS n FROM {view}")


# ---------------------------------------------------------------- I: sampling

@query("sample_n", f"WITH {V.FLOWS} SELECT uid, proto FROM flows ORDER BY {KEY} LIMIT 500")
def q_sample_n(spark, d):
    """Exactly 500 rows by the seeded md5 order (the sampling operator's limit is its feature)."""
    return I.sample_n(flows(spark, d), 500, "uid", 42).select("uid", "proto")


@query("stratified_split", f"""WITH {V.LABELED}, r AS ({_ranked('labeled')})
SELECT uid, label, {_cum_case('rk', 'n', ['train', 'test'], [0.75, 0.25])} AS split FROM r""")
def q_stratified_split(spark, d):
    """75/25 per class, exact per-class counts."""
    return I.stratified_split(labeled(spark, d), "label", (0.75, 0.25)).select("uid", "label", "split")


@query("three_way_split", f"""WITH {V.LABELED}, r AS ({_ranked('labeled')})
SELECT uid, label, {_cum_case('rk', 'n', ['train', 'validation', 'test'], [0.7, 0.15, 0.15])} AS split FROM r""")
def q_three_way_split(spark, d):
    """I4: 70/15/15 stratified train / validation / test."""
    return I.stratified_split(labeled(spark, d), "label", (0.7, 0.15, 0.15),
                              ("train", "validation", "test")).select("uid", "label", "split")


@query("random_split", f"""WITH {V.FLOWS}
SELECT uid, CASE WHEN CAST('0x' || substr({KEY}, 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.75
            THEN 'train' ELSE 'test' END AS split FROM flows""")
def q_random_split(spark, d):
    """Plain seeded split, one independent draw per row (no shuffle)."""
    return I.random_split(flows(spark, d), (0.75, 0.25)).select("uid", "split")


@query("stratified_folds", f"""WITH {V.LABELED}, r AS ({_ranked('labeled')})
SELECT uid, label, CAST(rk % 5 AS INTEGER) AS fold FROM r""")
def q_stratified_folds(spark, d):
    """Shuffled, stratified 5-fold ids."""
    return I.assign_folds(labeled(spark, d), "label", 5).select("uid", "label", "fold")


@query("class_weights", f"""WITH {V.LABELED}, c AS (SELECT label, count(*) AS nc FROM labeled GROUP BY label)
SELECT l.uid, l.label, (SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * c.nc) AS weight
FROM labeled l JOIN c ON l.label = c.label""", doubles=("weight",))
def q_class_weights(spark, d):
    """I7: 'balanced' class weights as a row weight column."""
    return I.class_weights(labeled(spark, d), "label").select("uid", "label", "weight")


# ---------------------------------------------------------------- J: encoding

@query("label_encode", f"""WITH {V.RAW}, f AS (SELECT uid, coalesce(service, 'unknown') AS service, proto,
                                            conn_state FROM raw)
SELECT uid, CAST(dense_rank() OVER (ORDER BY service) - 1 AS INTEGER) AS service,
       CAST(dense_rank() OVER (ORDER BY proto) - 1 AS INTEGER) AS proto,
       CAST(dense_rank() OVER (ORDER BY conn_state) - 1 AS INTEGER) AS conn_state FROM f""")
def q_label_encode(spark, d):
    """Alphabetical codes from 0, NULL -> 'unknown' (StringIndexer, alphabetAsc)."""
    out, _ = J.label_encode(raw(spark, d).select("uid", "service", "proto", "conn_state"),
                            ["service", "proto", "conn_state"])
    return out


@query("category_codes", f"""WITH {V.RAW}
SELECT uid, CASE WHEN service IS NULL THEN -1
                 ELSE CAST(dense_rank() OVER (ORDER BY service) - 1 AS INTEGER) END AS service FROM raw""")
def q_category_codes(spark, d):
    """Category codes, NULL -> -1."""
    return J.category_codes(raw(spark, d).select("uid", "service"), ["service"])


@query("one_hot", f"""WITH {V.RAW}
SELECT uid, CAST(proto = 'tcp' AS INTEGER) AS proto_tcp, CAST(proto = 'udp' AS INTEGER) AS proto_udp,
       CAST(conn_state = 'RSTO' AS INTEGER) AS conn_state_RSTO, CAST(conn_state = 'S0' AS INTEGER) AS conn_state_S0,
       CAST(conn_state = 'S1' AS INTEGER) AS conn_state_S1, CAST(conn_state = 'SF' AS INTEGER) AS conn_state_SF,
       coalesce(CAST(service = 'dns' AS INTEGER), 0) AS service_dns,
       coalesce(CAST(service = 'http' AS INTEGER), 0) AS service_http,
       coalesce(CAST(service = 'ssl' AS INTEGER), 0) AS service_ssl FROM raw""")
def q_one_hot(spark, d):
    """Dummies with the alphabetically first level dropped; NULL -> all zeros."""
    return J.one_hot(raw(spark, d).select("uid", "proto", "conn_state", "service"),
                     ["proto", "conn_state", "service"])


@query("encode_auto", """WITH c AS (SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, c_name
                                     FROM customer),
m AS (SELECT DISTINCT c_mktsegment AS v FROM c ORDER BY v),
lv AS (SELECT list(v ORDER BY v) AS vs FROM m)
SELECT c_custkey, c_name,
       CAST(dense_rank() OVER (ORDER BY nation) - 1 AS INTEGER) AS nation,
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "c_mktsegment_BUILDING",
       CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS "c_mktsegment_FURNITURE",
       CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS "c_mktsegment_HOUSEHOLD",
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS "c_mktsegment_MACHINERY" FROM c""")
def q_encode_auto(spark, d):
    """Cardinality router over customer (5 values -> one-hot, 25 -> codes, 1,500 -> text)."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment",
                                                F.col("c_nationkey").cast("string").alias("nation"), "c_name")
    out, _ = J.encode_auto(c, ["c_mktsegment", "nation", "c_name"], 10, 100)
    return out


_DOCS_SPLIT = f"""docs AS (
  SELECT d.doc_id, d.source, d.lang, l.quality,
         CASE WHEN CAST('0x' || substr(md5('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT)
                   / CAST(4294967296 AS DOUBLE) < 0.75 THEN 'train' ELSE 'test' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("target_encode", f"""WITH {_DOCS_SPLIT},
s AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS source_te FROM docs WHERE split = 'train' GROUP BY source),
p AS (SELECT avg(CAST(quality AS DOUBLE)) AS prior FROM docs WHERE split = 'train')
SELECT docs.doc_id, docs.split, coalesce(s.source_te, p.prior) AS source_te
FROM docs LEFT JOIN s ON docs.source = s.source, p""", doubles=("source_te",))
def q_target_encode(spark, d):
    """Source -> mean quality on the training split (documents joined with labels)."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    lab = read_table(spark, d, "labels").select("doc_id", "quality")
    x = I.random_split(docs.join(lab, "doc_id"), (0.75, 0.25), id_col="doc_id")
    out = J.target_encode(x.filter(F.col("split") == "train"), x, "source", "quality")
    return out.select("doc_id", "split", "source_te")


@query("collapse_rare", """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
t AS (SELECT count(*) AS total FROM part)
SELECT p.p_partkey, CASE WHEN c.n >= 0.04 * t.total THEN p.p_brand ELSE 'other' END AS p_brand
FROM part p JOIN c ON p.p_brand = c.p_brand, t""")
def q_collapse_rare(spark, d):
    """Brands under a 4 % share become 'other'."""
    p = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return J.collapse_rare(p, "p_brand", 0.04)


@query("standard_scaler", f"""WITH {V.RAW}, r AS (
  SELECT uid, orig_pkts, resp_pkts, orig_bytes,
         CASE WHEN CAST('0x' || substr({KEY}, 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.75
              THEN 'train' ELSE 'test' END AS split FROM raw),
s AS (SELECT avg(orig_pkts) AS m1, stddev_pop(orig_pkts) AS s1, avg(resp_pkts) AS m2, stddev_pop(resp_pkts) AS s2,
             avg(orig_bytes) AS m3, stddev_pop(orig_bytes) AS s3 FROM r WHERE split = 'train')
SELECT uid, split, (orig_pkts - m1) / s1 AS orig_pkts, (resp_pkts - m2) / s2 AS resp_pkts,
       (orig_bytes - m3) / s3 AS orig_bytes FROM r, s""", doubles=("orig_pkts", "resp_pkts", "orig_bytes"))
def q_standard_scaler(spark, d):
    """Fit mean / population std on train, apply to both splits."""
    r = I.random_split(raw(spark, d).select("uid", "orig_pkts", "resp_pkts", "orig_bytes"), (0.75, 0.25))
    sc = J.fit_scaler(r.filter(F.col("split") == "train"), ["orig_pkts", "resp_pkts", "orig_bytes"])
    return J.apply_scaler(r, sc)


# ---------------------------------------------------------------- N: evaluation

_SCORED = f"""{V.LABELED}, scored AS (
  SELECT l.uid, CASE WHEN l.label = 'Malicious' THEN 1 ELSE 0 END AS label, f.score,
         CAST(f.score > 0.5 AS INTEGER) AS prediction, f.resp_p / 100.0 AS port_score,
         CAST(f.resp_p / 100.0 > 0.5 AS INTEGER) AS port_prediction
  FROM labeled l JOIN flows f ON l.uid = f.uid)"""  # the SQL may join; Spark reads the view once


def scored(spark, d):
    """Labelled connections with a ready-made score (the view's ``score``) and
    a second, weaker scorer (destination port / 100)."""
    f = C.clean_labels(flows(spark, d).select("uid", "label_raw", "detailed_label", "score", "resp_p"),
                       src="label_raw")
    x = C.binary_target(f, "label", "target")
    x = x.select("uid", F.col("target").alias("label"), "score",
                 (F.col("resp_p") / 100.0).alias("port_score"))
    x = N.scored_with_threshold(x, "score", 0.5, "prediction")
    return N.scored_with_threshold(x, "port_score", 0.5, "port_prediction")


@query("binary_metrics", f"""WITH {_SCORED}, c AS (
  SELECT CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp,
         CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn,
         CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp,
         CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn FROM scored),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, precision, recall,
       CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
       CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END AS fpr FROM m""",
       doubles=("accuracy", "precision", "recall", "f1", "fpr"))
def q_binary_metrics(spark, d):
    """Confusion counts, accuracy, precision, recall, F1 of class 1, FPR."""
    return N.binary_metrics(scored(spark, d))


@query("classification_report", f"""WITH {_SCORED},
cls AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
per AS (SELECT CAST(c AS VARCHAR) AS class,
               (SELECT count_if(label = c AND prediction = c) FROM scored) AS tp,
               (SELECT count_if(prediction = c) FROM scored) AS pred_n,
               (SELECT count_if(label = c) FROM scored) AS support FROM cls),
pr AS (SELECT class, tp, support, CASE WHEN pred_n = 0 THEN 0 ELSE tp / pred_n END AS precision,
              CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
      FROM pr)
SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""",
       doubles=("precision", "recall", "f1"))
def q_classification_report(spark, d):
    """Per-class and averaged precision / recall / F1 with support."""
    return N.classification_report(scored(spark, d))


@query("roc_curve", f"""WITH {_SCORED}, s AS (
  SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM scored GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM s),
t AS (SELECT count_if(label = 1) AS p, count_if(label = 0) AS n FROM scored)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT score, fp / n, tp / p FROM c, t""", doubles=("fpr", "tpr"))
def q_roc_curve(spark, d):
    """ROC points for every distinct score, from (0, 0)."""
    return N.roc_curve(scored(spark, d))


@query("auc", f"""WITH {_SCORED}, s AS (
  SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM scored GROUP BY score),
c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS tp_before FROM s)
SELECT sum(neg * (tp_before + pos / 2.0)) / (sum(pos) * sum(neg)) AS auc_trapezoid,
       sum(neg * tp_before) / (sum(pos) * sum(neg)) AS auc_rank FROM c""", doubles=("auc_trapezoid", "auc_rank"))
def q_auc(spark, d):
    """N6 (trapezoid, ties ½) and N7 (pair share with ties 0), without pairs."""
    return N.auc(scored(spark, d))


@query("log_loss", f"""WITH {_SCORED}, p AS (SELECT label, score, least(greatest(score, 1e-7), 1 - 1e-7) AS q FROM scored)
SELECT avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS bce,
       avg(CAST(CAST(score > 0.5 AS INTEGER) = label AS DOUBLE)) AS accuracy FROM p""", doubles=("bce", "accuracy"))
def q_log_loss(spark, d):
    """Mean binary cross-entropy and accuracy at 0.5."""
    return N.log_loss(scored(spark, d))


def _cmp_sql(pred: str, score: str, i: int, name: str) -> str:
    return f"""SELECT {i} AS seq, '{name}' AS model, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
FROM (SELECT count_if(label = 1 AND {pred} = 1) AS tp, count_if(label = 0 AND {pred} = 0) AS tn,
             count_if(label = 0 AND {pred} = 1) AS fp, count_if(label = 1 AND {pred} = 0) AS fn FROM scored)"""


@query("model_comparison", f"""WITH {_SCORED}, t AS ({_cmp_sql('prediction', 'score', 0, 'view_score')}
UNION ALL {_cmp_sql('port_prediction', 'port_score', 1, 'port_score')})
SELECT seq, model, accuracy, precision, recall, f1 FROM t""", doubles=("accuracy", "precision", "recall", "f1"))
def q_model_comparison(spark, d):
    """Model × metric table (two scorers over the same rows)."""
    s = scored(spark, d)
    a = s.select("label", "prediction", "score")
    b = s.select("label", F.col("port_prediction").alias("prediction"), F.col("port_score").alias("score"))
    t = N.comparison_table({"view_score": a, "port_score": b}, score=None)
    return t.select("seq", "model", "accuracy", "precision", "recall", "f1")


@query("best_model_per_metric", f"""WITH {_SCORED}, t AS ({_cmp_sql('prediction', 'score', 0, 'view_score')}
UNION ALL {_cmp_sql('port_prediction', 'port_score', 1, 'port_score')}),
l AS (SELECT seq, model, 'accuracy' AS metric, accuracy AS value FROM t
      UNION ALL SELECT seq, model, 'precision', precision FROM t
      UNION ALL SELECT seq, model, 'recall', recall FROM t UNION ALL SELECT seq, model, 'f1', f1 FROM t)
SELECT metric, model, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, seq) AS r FROM l) WHERE r = 1""",
       doubles=("value",))
def q_best_model_per_metric(spark, d):
    """Best model per metric, the first in table order on ties."""
    s = scored(spark, d)
    a = s.select("label", "prediction", "score")
    b = s.select("label", F.col("port_prediction").alias("prediction"), F.col("port_score").alias("score"))
    return N.best_per_metric(N.comparison_table({"view_score": a, "port_score": b}, score=None))


@query("threshold_predictions", f"""WITH {_SCORED}
SELECT uid, CAST(score > 0.3 AS INTEGER) AS prediction FROM scored""")
def q_threshold_predictions(spark, d):
    """Class from a probability and a threshold."""
    from flowsift.functions.columns import predict_label
    return predict_label(scored(spark, d).drop("prediction"), "score", 0.3).select("uid", "prediction")


@query("recommendation", f"""WITH {_SCORED}, t AS ({_cmp_sql('prediction', 'score', 0, 'view_score')}
UNION ALL {_cmp_sql('port_prediction', 'port_score', 1, 'port_score')}),
l AS (SELECT seq, model, 'f1' AS metric, f1 AS value FROM t UNION ALL SELECT seq, model, 'accuracy', accuracy FROM t)
SELECT metric, model, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, seq) AS r FROM l) WHERE r = 1""",
       doubles=("value",))
def q_recommendation(spark, d):
    """The model to recommend by F1 and by accuracy."""
    s = scored(spark, d)
    a = s.select("label", "prediction", "score")
    b = s.select("label", F.col("port_prediction").alias("prediction"), F.col("port_score").alias("score"))
    return N.recommendation(N.comparison_table({"view_score": a, "port_score": b}, score=None))
