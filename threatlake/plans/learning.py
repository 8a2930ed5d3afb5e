"""Queries over labelled indicators: labels, splits, weights, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.functions import fixed
from threatlake.operators import learning
from threatlake.plans import bridge, feeds
from threatlake.plans.registry import query
from threatlake.session import scratch_path

LABELLED = bridge.ansi(bridge.LABELLED)
_RISKY = "list_has_any(string_split(tags_bar, '|'), ['malware', 'apt', 'botnet', 'ransomware', 'phishing'])"
_LABELS = f"SELECT *, CASE WHEN {_RISKY} THEN 1 ELSE 0 END AS risk_label FROM ({LABELLED}) AS b"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.view(spark, sf, bridge.LABELLED)
    return rows.withColumn("tags", F.split("tags_bar", r"\|", -1)).withColumn(
        learning.LABEL, learning.risk_label(F.col("tags"))
    )


@query("ml_label", f"SELECT event_id, risk_label FROM ({_LABELS}) AS l")
def ml_label(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("event_id", learning.LABEL)


@query("ml_label_dist", f"SELECT risk_label, count(*) AS rows FROM ({_LABELS}) AS l GROUP BY risk_label")
def ml_label_dist(spark: SparkSession, sf: str) -> DataFrame:
    return learning.label_distribution(labelled(spark, sf))


@query(
    "ml_synth",
    "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id)"
    " <= greatest(2, (SELECT count(*) FROM events) // 3) THEN 1 ELSE 0 END AS risk_label FROM events",
)
def ml_synth(spark: SparkSession, sf: str) -> DataFrame:
    """A table without a risky row."""
    safe = bridge.table(spark, sf, "events").select(
        "event_id", learning.risk_label(F.array(F.col("event_type"))).alias(learning.LABEL)
    )
    return learning.synthesize_missing_class(safe, "event_id")


@query(
    "ml_impute",
    f"SELECT event_id, coalesce(indicator_type, 'missing') AS indicator_type, source FROM ({LABELLED}) AS b",
)
def ml_impute(spark: SparkSession, sf: str) -> DataFrame:
    return learning.impute(labelled(spark, sf).select("event_id", *fixed.MODEL_FEATURES))


_CATEGORIES = [("indicator_type", v) for v in ("domain", "ipv4", "missing", "url")] + [
    ("source", v) for v in ("alienvault", "virustotal")
]


@query(
    "ml_onehot",
    "SELECT event_id, "
    + ", ".join(
        f"CASE WHEN coalesce({c}, 'missing') = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat__{c}_{v}"
        for c, v in _CATEGORIES
    )
    + f" FROM ({LABELLED}) AS b",
)
def ml_onehot(spark: SparkSession, sf: str) -> DataFrame:
    """One column per category, in the order of the fitted encoder."""
    from pyspark.ml.functions import vector_to_array

    rows = learning.impute(labelled(spark, sf).select("event_id", *fixed.MODEL_FEATURES))
    model = learning.encoder().fit(rows)
    encoded = model.transform(rows).select("event_id", vector_to_array("features").alias("f"))
    names = learning.feature_names(model)
    return encoded.select("event_id", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])


@query(
    "ml_split",
    "SELECT event_id, risk_label, row_number() OVER (PARTITION BY risk_label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id)"
    f" <= count(*) OVER (PARTITION BY risk_label) * 80 // 100 AS is_train FROM ({_LABELS}) AS l",
)
def ml_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).select("event_id", learning.LABEL)
    return learning.split(rows, "event_id").select("event_id", learning.LABEL, "is_train")


@query(
    "ml_weight",
    "SELECT risk_label, count(*) AS n_class, round((SELECT count(*) FROM events) / (2.0::DOUBLE * count(*)), 6) AS weight"
    f" FROM ({_LABELS}) AS l GROUP BY risk_label",
)
def ml_weight(spark: SparkSession, sf: str) -> DataFrame:
    weights = learning.class_weights(labelled(spark, sf))
    return weights.withColumn("weight", F.round("weight", 6))


def _report_sql(rows: str) -> str:
    """Precision, recall, f1 and support of the rows' risk_label against their prediction."""
    cells = (
        "SELECT sum(CASE WHEN risk_label = 1 AND prediction = 1 THEN 1.0::DOUBLE ELSE 0 END) AS tp,"
        " sum(CASE WHEN risk_label = 0 AND prediction = 1 THEN 1.0::DOUBLE ELSE 0 END) AS fp,"
        " sum(CASE WHEN risk_label = 1 AND prediction = 0 THEN 1.0::DOUBLE ELSE 0 END) AS fn,"
        f" sum(CASE WHEN risk_label = 0 AND prediction = 0 THEN 1.0::DOUBLE ELSE 0 END) AS tn FROM ({rows}) AS l"
    )
    classes = (
        "SELECT '0' AS name, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS n, tn + tp AS hits, tn + tp + fn + fp AS total FROM cells"
        " UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn, tn + tp, tn + tp + fn + fp FROM cells"
    )
    rate = "round(any_value(hits / total), 6)"
    return (
        f"WITH cells AS ({cells}), classes AS (SELECT *, 2 * p * r / (p + r) AS f FROM ({classes}) AS c)"
        " SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(n AS BIGINT) AS support FROM classes"
        f" UNION ALL SELECT 'accuracy', {rate}, {rate}, {rate}, CAST(any_value(total) AS BIGINT) FROM classes"
        " UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(any_value(total) AS BIGINT) FROM classes"
        " UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6), round(sum(f * n) / sum(n), 6), CAST(any_value(total) AS BIGINT) FROM classes"
    )


def _rounded(report: DataFrame) -> DataFrame:
    return report.select("name", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support")


@query("ml_eval", _report_sql(_LABELS))
def ml_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation of a given prediction column."""
    return _rounded(learning.evaluation(labelled(spark, sf)))


@query(
    "ml_confusion",
    "SELECT risk_label, count(*) FILTER (WHERE prediction = 0) AS predicted_0,"
    f" count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM ({_LABELS}) AS l GROUP BY risk_label",
)
def ml_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return learning.confusion_matrix(labelled(spark, sf))


@query(
    "ml_guard",
    f"SELECT 'all' AS part, count(DISTINCT risk_label) >= 2 AS trainable FROM ({_LABELS}) AS l"
    " UNION ALL SELECT 'one class', false UNION ALL SELECT 'empty', false",
)
def ml_guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf)
    parts = {
        "all": rows,
        "one class": rows.where(F.col(learning.LABEL) == 0),
        "empty": rows.where(F.col("event_id") < 0),
    }
    found = [(name, learning.is_trainable(part)) for name, part in parts.items()]
    return spark.createDataFrame(found, "part string, trainable boolean")


# Forests are trained on rows whose class follows from the features, but for one row in ten.  A forest
# that learned anything predicts the rule, which SQL can state; a constant or a wrong one does not.
LEARNABLE = bridge.ansi(bridge.LEARNABLE)
_RULE = "CASE WHEN indicator_type = 'domain' OR (indicator_type = 'url' AND source = 'alienvault') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_KNOWN = f"SELECT *, CASE WHEN {_RISKY} THEN 1 ELSE 0 END AS risk_label, {_RULE} AS prediction FROM ({LEARNABLE}) AS b"
_HELD_OUT = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY risk_label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id)"
    f" <= count(*) OVER (PARTITION BY risk_label) * 80 // 100 AS is_train FROM ({_KNOWN}) AS k) AS s WHERE NOT is_train"
)
_FEATURES = "coalesce(indicator_type, 'missing') AS indicator_type, source"


def learnable(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.view(spark, sf, bridge.LEARNABLE)
    return rows.withColumn("tags", F.split("tags_bar", r"\|", -1)).withColumn(
        learning.LABEL, learning.risk_label(F.col("tags"))
    )


def _model(spark: SparkSession, sf: str):
    return learning.train(learnable(spark, sf))


@query("ml_predict", f"SELECT event_id, {_FEATURES}, prediction FROM ({_KNOWN}) AS k")
def ml_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a forest trained on the same table."""
    rows = learning.impute(learnable(spark, sf).select("event_id", *fixed.MODEL_FEATURES, learning.LABEL))
    return learning.predict(rows, _model(spark, sf)).select("event_id", *fixed.MODEL_FEATURES, "prediction")


@query("ml_train", _report_sql(_HELD_OUT))
def ml_train(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out evaluation of a forest trained on the first 80 percent of every class."""
    return _rounded(learning.train_and_evaluate(learnable(spark, sf), "event_id"))


_LEVEL = (
    "CASE WHEN indicator_type = 'domain' OR (indicator_type = 'url' AND coalesce(source, 'missing') = 'alienvault') THEN 'HIGH' ELSE 'LOW' END"
)
# Types and sources that the forest never saw encode as nothing, so SQL cannot state their level.
_SEEN = "coalesce(indicator_type, 'missing') IN ('domain', 'url', 'ipv4', 'missing') AND source IN ('alienvault', 'virustotal')"


@query(
    "ml_score",
    f"SELECT event_id, error, CASE WHEN error = '' THEN coalesce(value, 'N/A') END AS value, CASE WHEN error = '' AND {_SEEN} THEN {_LEVEL} END AS risk_level,"
    " CASE WHEN error = '' THEN true END AS sure_enough, CASE WHEN error = '' THEN 5 END AS factors, CASE WHEN error = '' THEN 'RandomForestClassifier' END AS model_type,"
    f" CASE WHEN error = '' THEN '1.0' END AS version FROM (SELECT *, {feeds.REQUEST_ERROR} AS error FROM ({bridge.ansi(bridge.REQUESTS)}) AS r) AS c",
)
def ml_score(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to requests; those that fail the check are not scored."""
    requests = bridge.view(spark, sf, bridge.REQUESTS).select(
        "event_id", "has_body", "indicator_type", "source", "value"
    )
    answers = learning.answer(requests, _model(spark, sf), F.col("has_body") == 1)
    seen = F.coalesce("indicator_type", F.lit("missing")).isin("domain", "url", "ipv4", "missing") & F.col(
        "source"
    ).isin("alienvault", "virustotal")
    return answers.select(
        "event_id",
        "error",
        "value",
        F.when(seen, F.col("risk_level")).alias("risk_level"),
        # The chosen one of two classes has half of the votes at least.
        F.col("confidence").between(50, 100).alias("sure_enough"),
        F.when(F.col("top_factors").isNotNull(), F.size("top_factors")).alias("factors"),
        "model_type",
        "version",
    )


@query("ml_topfeat")
def ml_topfeat(spark: SparkSession, sf: str) -> DataFrame:
    """The five most important features; a forest's importances are not for SQL to state."""
    return learning.top_features(spark, _model(spark, sf))


@query(
    "snk_model",
    f"SELECT indicator_type, source, prediction, count(*) AS rows FROM (SELECT {_FEATURES}, prediction FROM ({_KNOWN}) AS k) AS f"
    " GROUP BY indicator_type, source, prediction",
)
def snk_model(spark: SparkSession, sf: str) -> DataFrame:
    """What a model that was saved and loaded again predicts for every combination of features."""
    path = scratch_path(spark, "model")
    learning.save(_model(spark, sf), path)
    rows = learning.impute(learnable(spark, sf).select("event_id", *fixed.MODEL_FEATURES))
    counted = rows.groupBy(*fixed.MODEL_FEATURES).agg(F.count("*").alias("rows"))
    return learning.predict(counted, learning.load(path)).select(*fixed.MODEL_FEATURES, "prediction", "rows")


@query("ml_trainjob", _report_sql(_HELD_OUT))
def ml_trainjob(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, split, training, the saved model, and its held-out evaluation."""
    path = scratch_path(spark, "model")
    return _rounded(learning.train_job(learnable(spark, sf), "event_id", path))
