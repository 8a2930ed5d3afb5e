"""Labels, features, training, evaluation and scoring of the risk model."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatlake.functions import fixed
from threatlake.functions.columns import empty_array, word_list
from threatlake.functions.ranking import mark_first
from threatlake.operators import routing
from threatlake.session import scratch_path

LABEL = "risk_label"


# --- labels ----------------------------------------------------------------------------------


def risk_label(tags: Column) -> Column:
    """1 when any tag is one of the high-risk tags, as written."""
    known = F.coalesce(tags, empty_array("string"))
    overlap = F.arrays_overlap(known, word_list(fixed.HIGH_RISK_TAGS))
    # Null elements make the overlap unknown rather than false.
    return F.coalesce(overlap, F.lit(False)).cast("int")


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def synthesize_missing_class(df: DataFrame, key: str, label: str = LABEL) -> DataFrame:
    """Where only one class occurs, the first third (at least two rows) becomes the other.

    "First" is the hash order of ``key``; a table has no row order of its own.
    """
    third = F.greatest(F.lit(2), F.floor(F.col("total") / 3))
    take = F.when(
        F.col("lo") == F.col("hi"), F.least(third, F.col("total"))
    ).otherwise(F.lit(0))
    flagged = mark_first(df, key, [], take, "_flip", value=label)
    flipped = F.when(F.col("_flip"), 1 - F.col(label)).otherwise(F.col(label))
    return flagged.withColumn(label, flipped).drop("_flip")


# --- features --------------------------------------------------------------------------------


def impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.fillna(fixed.MISSING_CATEGORY, subset=columns or fixed.MODEL_FEATURES)


def encoder(columns: list[str] | None = None) -> Pipeline:
    """One-hot encoding with alphabetical categories; unseen ones become all zeros."""
    names = columns or fixed.MODEL_FEATURES
    indexed = [f"{c}_index" for c in names]
    hot = [f"{c}_onehot" for c in names]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=names,
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            # The dropped last slot is the one for unseen values.
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
            VectorAssembler(inputCols=hot, outputCol="features"),
        ]
    )


def feature_names(model: PipelineModel, columns: list[str] | None = None) -> list[str]:
    names = columns or fixed.MODEL_FEATURES
    labels = model.stages[0].labelsArray
    return [f"cat__{c}_{value}" for c, values in zip(names, labels) for value in values]


# --- training --------------------------------------------------------------------------------


def split(
    df: DataFrame,
    key: str,
    label: str = LABEL,
    test_size: float = fixed.TEST_SIZE,
    stratified: bool = True,
) -> DataFrame:
    """Add ``is_train``: all but the test share of every class, the first in hash order of ``key``."""
    share = 1 - Fraction(str(test_size))
    take = F.expr(f"total * {share.numerator} div {share.denominator}")
    return mark_first(df, key, [label] if stratified else [], take, "is_train")


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights n / (classes * n_class), one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_class"))
    totals = F.struct(F.sum("n_class").alias("n"), F.count("*").alias("k"))
    return counts.withColumn("_t", counts.agg(totals.alias("t")).scalar()).select(
        label, "n_class", (F.col("_t.n") / (F.col("_t.k") * F.col("n_class"))).alias("weight")
    )


class UntrainableData(ValueError):
    """The training data is empty or has a single class."""


def combinations(
    df: DataFrame, label: str = LABEL, columns: list[str] | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """How often every combination of features and class occurs.

    The features are a few categories, so this is one map-side aggregation that leaves a handful
    of rows, whatever the table's size.
    """
    names = columns or fixed.MODEL_FEATURES
    return impute(df, names).groupBy(*names, label, *by).agg(F.count("*").alias("n"))


def train(
    df: DataFrame, label: str = LABEL, columns: list[str] | None = None, **options
) -> PipelineModel:
    """Fit encoder and forest with balanced class weights on the rows of a table."""
    combos = combinations(df, label, columns).persist()
    try:
        return fit(combos, label, columns, **options)
    finally:
        combos.unpersist()


def fit(
    combos: DataFrame,
    label: str = LABEL,
    columns: list[str] | None = None,
    model_type: str = "RandomForestClassifier",
    trees: int = 100,
    max_depth: int = 30,
) -> PipelineModel:
    """Fit encoder and forest on counted combinations.

    The default depth is the deepest that the library takes.

    Drawing as many rows as a large table has, with replacement, gives each combination its own
    share again; so the trees see the full weights and differ by the features they may use.
    """
    if model_type != "RandomForestClassifier":
        raise ValueError(f"Unsupported model type: {model_type}")
    names = columns or fixed.MODEL_FEATURES
    # One row per class of a binary label.
    per_class = combos.groupBy(label).agg(F.sum("n").alias("n_class")).collect()
    sizes = {row[label]: row["n_class"] for row in per_class}
    if len(sizes) < 2:
        raise UntrainableData(f"Need two classes to train, found {len(sizes)}")
    total = sum(sizes.values())
    weight = reduce(
        lambda chain, item: F.when(
            F.col(label) == item[0], F.lit(total / (len(sizes) * item[1]))
        ).otherwise(chain),
        sizes.items(),
        F.lit(0.0),
    )
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol="weight",
        numTrees=trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        bootstrap=False,
        seed=fixed.SEED,
    )
    stages = [*encoder(names).getStages(), forest]
    return Pipeline(stages=stages).fit(combos.withColumn("weight", F.col("n") * weight))


def is_trainable(df: DataFrame, label: str = LABEL) -> bool:
    """Whether there are rows of at least two classes; one aggregate row reaches the driver."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).first()
    return row["n"] > 0 and row["k"] >= 2


# --- evaluation ------------------------------------------------------------------------------


def confusion(
    df: DataFrame, label: str = LABEL, prediction: str = "prediction", count: str | None = None
) -> DataFrame:
    """Rows per class and prediction; ``count`` names a column with the rows a row stands for."""
    rows = F.sum(count) if count else F.count("*")
    return df.groupBy(label, prediction).agg(rows.alias("rows"))


def confusion_matrix(
    df: DataFrame, label: str = LABEL, prediction: str = "prediction", classes=(0, 1)
) -> DataFrame:
    cells = df.groupBy(label).pivot(prediction, list(classes)).agg(F.count(F.lit(1)))
    return cells.select(
        label, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"predicted_{c}") for c in classes]
    )


def evaluation(
    df: DataFrame, label: str = LABEL, prediction: str = "prediction", count: str | None = None
) -> DataFrame:
    """Accuracy, and precision, recall, f1 and support per class with their averages.

    One aggregation over the data; the rest works on the confusion counts.
    """
    cells = confusion(df, label, prediction, count)
    hit = F.when(F.col(label) == F.col(prediction), F.col("rows")).otherwise(0)
    by_class = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col(label).cast("int").alias("class"),
                    hit.alias("hits"),
                    F.col("rows").alias("actual"),
                    F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col(prediction).cast("int").alias("class"),
                    F.lit(0).cast("bigint").alias("hits"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("rows").alias("predicted"),
                ),
            )
        ).alias("c")
    ).groupBy("c.class").agg(
        *[F.sum(f"c.{n}").alias(n) for n in ("hits", "actual", "predicted")]
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    scored = by_class.select(
        F.col("class").cast("string").alias("name"),
        precision.alias("precision"),
        recall.alias("recall"),
        "hits",
        F.col("actual").alias("support"),
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    metrics = ("precision", "recall", "f1")
    macro = scored.agg(
        *[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support")
    ).withColumn("name", F.lit("macro avg"))
    weighted = scored.agg(
        *[
            F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")),
                       F.lit(0.0)).alias(m)
            for m in metrics
        ],
        F.sum("support").alias("support"),
    ).withColumn("name", F.lit("weighted avg"))
    rate = F.try_divide(F.sum("hits"), F.sum("support"))
    accuracy = scored.agg(
        *[rate.alias(m) for m in metrics], F.sum("support").alias("support")
    ).withColumn("name", F.lit("accuracy"))
    parts = [p.select("name", *metrics, "support") for p in (scored, accuracy, macro, weighted)]
    return reduce(DataFrame.unionByName, parts)


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


# --- scoring ---------------------------------------------------------------------------------


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df.select([c for c in df.columns if c not in _MODEL_COLUMNS]))


_MODEL_COLUMNS = ("features", "rawPrediction", "probability", "prediction")


def score(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """Risk level and confidence of every request; a request without a value gets ``N/A``."""
    columns = requests.columns
    value = F.coalesce("value", F.lit("N/A")) if "value" in columns else F.lit("N/A")
    none = empty_array("string")
    tags = F.coalesce("tags", none) if "tags" in columns else none
    ready = requests.withColumn("value", value).withColumn("tags", tags)
    scored = predict(impute(ready), model)
    chosen = F.get(vector_to_array("probability"), F.col("prediction").cast("int"))
    return scored.select(
        *dict.fromkeys([*columns, "value", "tags"]),
        F.when(F.col("prediction") == 1, "HIGH").otherwise("LOW").alias("risk_level"),
        F.round(chosen * 100, 2).alias("confidence"),
        F.lit("RandomForestClassifier").alias("model_type"),
        F.lit("1.0").alias("version"),
    )


def answer(requests: DataFrame, model: PipelineModel, body_present: Column) -> DataFrame:
    """Every request with its ``error``, or scored and with the model's top factors.

    Requests that fail the check are not scored; their other answer columns are null.
    """
    check = routing.check_request(body_present, F.col("indicator_type"), F.col("source"))
    checked = requests.withColumn("error", check["error"])
    top = top_features(requests.sparkSession, model).collect()  # five rows
    factors = F.create_map(*[F.lit(x) for row in top for x in (row["feature"], row["importance"])])
    scored = score(checked.where(F.col("error") == ""), model).withColumn("top_factors", factors)
    refused = checked.where(F.col("error") != "").withColumn("value", F.lit(None).cast("string"))
    return scored.unionByName(refused, allowMissingColumns=True)


def top_features(spark: SparkSession, model: PipelineModel, n: int = 5) -> DataFrame:
    """The n most important one-hot features, most important first."""
    importances = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(feature_names(model), importances))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_and_evaluate(
    labelled: DataFrame, key: str, model_path: str | None = None, **options
) -> DataFrame | None:
    """Split, train on the one part, evaluate on the other; None where there is one class.

    The table is read for the split; training and evaluation work on the counts per combination
    and part.
    """
    columns = [key, *fixed.MODEL_FEATURES, LABEL]
    classes = labelled.groupBy(LABEL).count().agg(F.count("*"), F.min("count")).first()
    if classes[0] < 2:
        return None
    parts = split(labelled.select(*columns), key, stratified=classes[1] >= 2)
    # Counts of a few combinations, written once: the result is read later, by the caller.
    kept = scratch_path(parts.sparkSession, "combinations")
    combinations(parts, by=("is_train",)).write.parquet(kept)
    combos = parts.sparkSession.read.parquet(kept)
    model = fit(combos.where("is_train"), **options)
    if model_path:
        save(model, model_path)
    return evaluation(predict(combos.where("NOT is_train"), model), count="n")


def train_job(indicators: DataFrame, key: str, model_path: str, **options) -> DataFrame | None:
    """Label, split, train, save; returns the evaluation of the held-out rows.

    Stops with None where there is nothing to learn from.
    """
    labelled = indicators.select(
        key, *fixed.MODEL_FEATURES, risk_label(F.col("tags")).alias(LABEL)
    )
    if labelled.isEmpty():
        return None
    return train_and_evaluate(synthesize_missing_class(labelled, key), key, model_path, **options)
