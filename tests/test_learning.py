"""Exact first-k flags, labels, the model and its evaluation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from threatlake.functions.ranking import mark_first
from threatlake.operators import learning


def table(spark, n=400):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ipv4", "domain", "url")]), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 11 != 0, kind).alias("indicator_type"),
        F.when(F.col("id") % 2 == 0, "alienvault").otherwise("virustotal").alias("source"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("malware"))).otherwise(F.array(F.lit("Malware"))).alias("tags"),
    )


@pytest.mark.parametrize("k", [0, 1, 37, 399, 400, 1000])
def test_first_rows_equal_sorting(spark, k):
    flagged = mark_first(spark.range(400), "id", [], F.least(F.lit(k), F.col("total")), "first").collect()
    order = sorted(range(400), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    assert {r.id for r in flagged if r["first"]} == set(order[:k])


def test_split_is_stratified(spark):
    rows = table(spark).withColumn(learning.LABEL, learning.risk_label(F.col("tags")))
    parts = learning.split(rows, "id").groupBy(learning.LABEL).agg(
        F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("train")
    ).collect()
    assert all(r.train == r.n * 80 // 100 for r in parts) and len(parts) == 2


def test_labels(spark):
    df = spark.createDataFrame([(["apt", None],), ([None],), (None,), (["APT"],), ([],)], "tags array<string>")
    assert [r[0] for r in df.select(learning.risk_label(F.col("tags"))).collect()] == [1, 0, 0, 0, 0]


@pytest.mark.parametrize("label, flipped", [(0, 1), (1, 0)])
def test_missing_class_is_made_up(spark, label, flipped):
    df = spark.range(10).withColumn(learning.LABEL, F.lit(label))
    labels = [r[learning.LABEL] for r in learning.synthesize_missing_class(df, "id").collect()]
    assert labels.count(flipped) == 3
    both = spark.range(10).withColumn(learning.LABEL, (F.col("id") % 2).cast("int"))
    assert learning.synthesize_missing_class(both, "id").exceptAll(both).count() == 0


def test_model(spark, tmp_path):
    rows = table(spark).withColumn(learning.LABEL, learning.risk_label(F.col("tags")))
    model = learning.train(rows, trees=10)
    path = str(tmp_path / "model")
    learning.save(model, path)
    requests = spark.createDataFrame(
        [("ipv4", "alienvault", None, None), ("url", "virustotal", "v", ["x"]), ("never", "seen", "w", None)],
        "indicator_type string, source string, value string, tags array<string>",
    )
    scored = learning.score(requests, learning.load(path)).collect()
    # Class 1 is exactly the rows of one type.
    assert [r.risk_level for r in scored[:2]] == ["HIGH", "LOW"]
    assert scored[0].value == "N/A" and scored[0].tags == []
    assert all(50 <= r.confidence <= 100 for r in scored)
    encoded = model.transform(learning.impute(requests)).collect()
    assert encoded[2].features.numNonzeros() == 0
    top = learning.top_features(spark, model).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance
    assert learning.feature_names(model)[:2] == ["cat__indicator_type_domain", "cat__indicator_type_ipv4"]


def test_one_class_is_refused(spark):
    one = table(spark).withColumn(learning.LABEL, F.lit(0))
    with pytest.raises(learning.UntrainableData):
        learning.train(one)
    with pytest.raises(ValueError, match="Unsupported model type"):
        learning.fit(one, model_type="Other")
    assert learning.train_and_evaluate(one, "id") is None


def test_train_job(spark, tmp_path):
    report = {r.name: r for r in learning.train_job(table(spark), "id", str(tmp_path / "m"), trees=5).collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"].support == 400 - sum(n * 80 // 100 for n in (134, 266))
    assert learning.train_job(table(spark).limit(0), "id", str(tmp_path / "m")) is None


def test_importances_name_what_decides(spark):
    """The class follows from one type alone, so that type is most important and sources say nothing."""
    rows = table(spark, 600).withColumn(
        learning.LABEL, F.coalesce((F.col("indicator_type") == "ipv4").cast("int"), F.lit(0))
    )
    top = learning.top_features(spark, learning.train(rows)).collect()
    assert top[0].feature == "cat__indicator_type_ipv4" and top[0].importance > 0.4
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    assert sum(r.importance for r in top) <= 1 + 1e-9
    assert sum(r.importance for r in top if "source" in r.feature) < 0.1
