"""Model training, tuning, scoring metadata (M1-M10, S14) and a baseline model.

* ``centroid_fit`` / ``centroid_predict``: standardized nearest-centroid
  classifier (class means from one ``groupBy``; scores are negative squared
  distances, softmax-ed).  It is fully SQL-replayable, which lets the
  evaluation operators be checked against an oracle.
* ``train_model``: Spark ML pipelines for the original's logistic
  regression, random forest and gradient boosting.
* ``train_logistic``: the same logistic regression by Newton steps (``logistic.py``).
* ``train_forests``: random forests of several feature lists, grown in the same
  passes over one binned table (``forest.py``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.functions.scalar import argmax_label, map_lookup
from wardflow.operators.forest import Forest, fit_forests
from wardflow.operators.logistic import Logistic, fit_logistic


# ------------------------------------------------------------ baseline model
def centroid_fit(train: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """1-row model: per-class means (``m_{class}_{feature}``) and per-feature sample std."""
    stats = train.agg(*[
        F.coalesce(F.nullif(F.stddev_samp(f), F.lit(0.0)), F.lit(1.0)).alias(f"s_{f}") for f in features])
    means = train.groupBy().pivot(label, classes).agg(*[F.avg(f).alias(f) for f in features])
    renamed = means.select(*[F.col(f"{c}_{f}" if len(features) > 1 else c).alias(f"m_{i}_{f}")
                             for i, c in enumerate(classes) for f in features])
    return renamed.crossJoin(stats)


def centroid_predict(df: DataFrame, model: DataFrame, features: list[str], classes: list[str]) -> DataFrame:
    """Adds ``probs`` (class order), ``prediction`` (first max) and ``confidence``."""
    each, at = range(len(classes)), range(len(features))
    # plain columns, summed in the order of the features and classes: they compile, array lambdas are interpreted
    packed = model.select(*[F.col(f"m_{i}_{f}").alias(f"_m{i}_{j}") for i in each for j, f in enumerate(features)],
                          *[F.col(f"s_{f}").alias(f"_sd{j}") for j, f in enumerate(features)])
    out = df.crossJoin(F.broadcast(packed))

    def square(i: int, j: int, f: str) -> Column:
        step = (F.col(f).cast("double") - F.col(f"_m{i}_{j}")) / F.col(f"_sd{j}")
        return step * step

    total = lambda columns: sum(columns, F.lit(0.0))
    out = out.withColumns({f"_s{i}": -total(square(i, j, f) for j, f in enumerate(features)) for i in each})
    scores = [F.col(f"_s{i}") for i in each]
    out = out.withColumn("_top", F.array_max(F.array(*scores)))
    out = out.withColumns({f"_e{i}": F.exp(s - F.col("_top")) for i, s in enumerate(scores)})
    out = out.withColumn("_sum", total(F.col(f"_e{i}") for i in each))
    out = out.withColumn("probs", F.array(*[F.col(f"_e{i}") / F.col("_sum") for i in each]))
    out = out.drop(*packed.columns, *[f"_{x}{i}" for i in each for x in "se"], "_top", "_sum")
    lab, conf = argmax_label(F.col("probs"), classes)
    return out.withColumn("prediction", lab).withColumn("confidence", conf)


# ----------------------------------------------------------------- Spark ML
def label_index(df: DataFrame, label: str, classes: list[str], out: str = "label_idx") -> DataFrame:
    """Class name -> code in the given class order (explicit, never positional)."""
    return df.withColumn(out, map_lookup({c: float(i) for i, c in enumerate(classes)}, F.col(label)))


def train_model(train: DataFrame, features: list[str], label: str, classes: list[str],
                model_type: str = "random_forest", weight_col: str | None = None,
                seed: int = 42, scale: bool = False, **params) -> PipelineModel:
    """M1-M4: fit one of logistic_regression / random_forest / gradient_boosting."""
    data = label_index(train, label, classes).where(F.col("label_idx").isNotNull())
    stages = [VectorAssembler(inputCols=features, outputCol="features_raw", handleInvalid="keep")]
    feat = "features_raw"
    if scale or model_type == "logistic_regression":
        stages.append(StandardScaler(inputCol=feat, outputCol="features", withMean=True, withStd=True))
        feat = "features"
    if model_type == "logistic_regression":
        c = params.get("C", 1.0)
        sum_w = data.agg(F.sum(F.col(weight_col)) if weight_col else F.count(F.lit(1))).first()[0]
        est = LogisticRegression(featuresCol=feat, labelCol="label_idx", family="multinomial",
                                 maxIter=params.get("max_iter", 1000), regParam=1.0 / (c * float(sum_w)),
                                 standardization=False)
    elif model_type == "random_forest":
        est = RandomForestClassifier(featuresCol=feat, labelCol="label_idx",
                                     numTrees=params.get("n_estimators", 100),
                                     maxDepth=params.get("max_depth", 10),
                                     minInstancesPerNode=params.get("min_samples_leaf", 5), seed=seed)
    elif model_type == "gradient_boosting":
        est = OneVsRest(classifier=GBTClassifier(maxIter=params.get("n_estimators", 100),
                                                 maxDepth=params.get("max_depth", 5),
                                                 stepSize=params.get("learning_rate", 0.1), seed=seed),
                        featuresCol=feat, labelCol="label_idx")
    else:
        raise ValueError(f"unknown model_type {model_type}")
    if weight_col and model_type != "gradient_boosting":
        est.setWeightCol(weight_col)
    stages.append(est)
    return Pipeline(stages=stages).fit(data)


def train_forests(train: DataFrame, feature_sets: list[list[str]], label: str, classes: list[str], seed: int = 42,
                  weight_col: str | None = None, **params) -> list[Forest]:
    """M2 for several feature lists: a random forest each, with ``train_model``'s parameters (weights go by class)."""
    return fit_forests(train, feature_sets, label, classes, trees=params.get("n_estimators", 100),
                       max_depth=params.get("max_depth", 10), min_rows=params.get("min_samples_leaf", 5), seed=seed,
                       weight_col=weight_col)


def train_logistic(train: DataFrame, features: list[str], label: str, classes: list[str],
                   weight_col: str | None = None, **params) -> Logistic:
    """M1 by Newton steps over packed rows, with ``train_model``'s objective and parameters."""
    return fit_logistic(train, features, label, classes, weight_col, C=params.get("C", 1.0),
                        max_iter=params.get("max_iter", 1000))


def predict(model: PipelineModel | Forest | Logistic, df: DataFrame, classes: list[str]) -> DataFrame:
    """M6 core: class name, confidence(4), probability array and map."""
    out = df if isinstance(model, (Forest, Logistic)) else model.transform(df)
    if isinstance(model, (Forest, Logistic)):
        probs = model.probabilities()
    elif "probability" in out.columns:
        probs = vector_to_array("probability")
    else:  # OneVsRest: each class's own binary model gives a margin, whose logistic shares sum to 1
        raw = vector_to_array("rawPrediction")
        one = F.transform(raw, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
        probs = F.transform(one, lambda p: p / F.aggregate(one, F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("probs", probs)
    lab, conf = argmax_label(F.col("probs"), classes)
    keep = [c for c in df.columns]
    return out.select(
        *keep, "probs", lab.alias("predicted_class"), conf.alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in classes]),
                          F.transform("probs", lambda p: F.round(p, 4))).alias("probabilities"))


class MacroF1Evaluator(Evaluator):
    """Macro F1 over label codes (Spark's built-in 'f1' is support-weighted)."""

    def __init__(self, n_classes: int, labelCol: str = "label_idx", predictionCol: str = "prediction"):
        super().__init__()
        self.n_classes, self.labelCol, self.predictionCol = n_classes, labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        from wardflow.operators.evaluate import per_class_metrics

        classes = [float(i) for i in range(self.n_classes)]
        d = dataset.select(F.col(self.labelCol).cast("double").alias("l"),
                           F.col(self.predictionCol).cast("double").alias("p"))
        d = d.select(F.col("l").cast("string").alias("label"), F.col("p").cast("string").alias("prediction"))
        m = per_class_metrics(d, [str(c) for c in classes])
        return float(m.agg(F.avg("f1")).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def stratified_folds(df: DataFrame, label: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Fold id = position within the class (hash order) mod k: class shares stay equal per fold.

    The rank is taken inside equal-width hash buckets of each class, so no
    class lands in a single window task.
    """
    from wardflow.functions.prefix import totals_before

    h = F.xxhash64(*df.columns, F.lit(seed))
    keyed = df.withColumn("_h", h)
    counts = keyed.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("_n"))
    ranked = totals_before(counts, [label], "_h", ["_n"])
    return keyed.join(ranked.select(label, "_h", "_n_before"), [label, "_h"]) \
        .withColumn("fold", (F.col("_n_before") % k).cast("int")).drop("_h", "_n_before")


#: The tuned parameters of each model type (C is the inverse regularisation).
TUNING_GRIDS = {
    "random_forest": {"numTrees": [100, 200], "maxDepth": [8, 10, 15], "minInstancesPerNode": [3, 5]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
}


def tune_model(train: DataFrame, features: list[str], label: str, classes: list[str],
               grid: dict | None = None, folds: int = 3, seed: int = 42, parallelism: int = 2,
               model_type: str = "random_forest"):
    """M5: grid search with balanced class weights, stratified folds, macro-F1 scoring."""
    from wardflow.operators.features import balanced_class_weights

    data = stratified_folds(label_index(train, label, classes).where(F.col("label_idx").isNotNull()),
                            label, folds, seed)
    data = balanced_class_weights(data, label, "_weight")
    grid = dict(grid or TUNING_GRIDS[model_type])
    if model_type == "random_forest":
        stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")]
        est = RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol="_weight", seed=seed)
    else:
        stages = [VectorAssembler(inputCols=features, outputCol="features_raw", handleInvalid="keep"),
                  StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True)]
        est = LogisticRegression(featuresCol="features", labelCol="label_idx", weightCol="_weight",
                                 family="multinomial", maxIter=1000, standardization=False)
        if "C" in grid:  # balanced weights sum to the number of rows
            n = data.count()
            grid["regParam"] = [1.0 / (c * n) for c in grid.pop("C")]
    builder = ParamGridBuilder()
    for k, vals in grid.items():
        builder = builder.addGrid(getattr(est, k), vals)
    cv = CrossValidator(estimator=Pipeline(stages=[*stages, est]), estimatorParamMaps=builder.build(),
                        evaluator=MacroF1Evaluator(len(classes)), foldCol="fold",
                        parallelism=parallelism, seed=seed)
    return cv.fit(data)


def feature_importances(model: PipelineModel | Forest, features: list[str], top: int | None = None) -> DataFrame:
    """Importances ranked, with an above-median flag (bounded by #features)."""
    ss = SparkSession.getActiveSession()
    imp = model.importances if isinstance(model, Forest) else model.stages[-1].featureImportances.toArray()
    df = ss.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    med = df.agg(F.median("importance").alias("_med"))
    out = df.crossJoin(med).withColumn("above_median", F.col("importance") > F.col("_med")).drop("_med") \
        .orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


def permutation_importances(rows: DataFrame, features: list[str], label: str, key: Column, predict_rows,
                            tie_columns: list[str], seed: int = 42) -> DataFrame:
    """M7 / W4 for any model: accuracy lost when one feature's values are dealt out anew, ranked.

    ``predict_rows`` adds ``prediction``.  The deal is a permutation that can be
    replayed: rows are numbered by the MD5 of their key (ties by
    ``tie_columns``), donors by that of the key and the feature, and the values
    change hands by equal number.  Both orders are range-partitioned sorts; no
    window holds the table.
    """
    from wardflow.functions.prefix import row_numbers
    from wardflow.session import write_table

    def numbered(df: DataFrame, salt: str) -> DataFrame:
        place = F.md5(F.concat_ws(":", F.col("_key"), F.lit(salt), F.lit(str(seed))))
        return row_numbers(df.withColumn("_h", place), ["_h", *tie_columns], "_at").drop("_h")

    base = write_table(numbered(rows.select(label, *dict.fromkeys([*features, *tie_columns]), key.alias("_key")), "row"))
    hit = F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")
    out = predict_rows(base).agg(hit).select(F.lit("").alias("feature"), "accuracy")
    for f in features:
        donors = numbered(base.drop("_at"), f).select("_at", F.col(f).alias("_given"))
        dealt = base.join(donors, "_at").withColumn(f, F.col("_given")).drop("_given")
        out = out.unionByName(predict_rows(dealt).agg(hit).select(F.lit(f).alias("feature"), "accuracy"))
    found = write_table(out)  # a row a feature
    full = found.where("feature = ''").select(F.col("accuracy").alias("_full"))
    drops = found.where("feature != ''").crossJoin(F.broadcast(full)).select(
        "feature", F.round(F.col("_full") - F.col("accuracy"), 6).alias("importance"))
    ranked = Window.orderBy(F.desc("importance"), "feature")  # a row a feature
    return drops.withColumn("rank", F.row_number().over(ranked))


def model_comparison(metric_rows: DataFrame) -> DataFrame:
    """M9: rows (model, accuracy, macro_f1, ...) plus the winner by macro F1."""
    best = metric_rows.agg(F.max_by("model", "macro_f1").alias("winner"))
    return metric_rows.crossJoin(best).withColumn("is_winner", F.col("model") == F.col("winner")).drop("winner")


def model_metadata(model: PipelineModel | Forest, name: str, version: str, features: list[str], classes: list[str],
                   target: str, train: DataFrame) -> DataFrame:
    """Metadata of a fitted pipeline as one row per (model, key, value).

    The parameters are those of the fitted last stage, or of the forest; rows and
    label counts are counted on the training frame.
    """
    if isinstance(model, Forest):
        algorithm, params, nodes = model.algorithm, model.params, model.total_nodes
    else:
        last = model.stages[-1]
        algorithm, nodes = type(last).__name__, getattr(last, "totalNumNodes", None)
        params = {p.name: last.getOrDefault(p) for p in last.params if last.isDefined(p)}
    rows = [("version", version), ("target", target), ("algorithm", algorithm),
            ("n_features", str(len(features))), ("features", ",".join(features)), ("classes", ",".join(classes))]
    for param in ("numTrees", "maxDepth", "minInstancesPerNode", "maxIter", "regParam", "seed"):
        if param in params:
            rows.append((param, str(params[param])))
    if nodes is not None:
        rows.append(("total_nodes", str(nodes)))
    fixed = train.sparkSession.createDataFrame([(name, k, v) for k, v in rows], "model string, key string, value string")
    counted = train.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(name).alias("model"), F.concat(F.lit("training_rows_"), F.col(target)).alias("key"),
        F.col("_n").cast("string").alias("value"))
    total = train.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit(name).alias("model"), F.lit("training_rows").alias("key"), "value")
    return fixed.unionByName(total).unionByName(counted)


def save_model(model: PipelineModel | Forest, path: str) -> None:
    """Overwrite-save a fitted pipeline or forest."""
    if isinstance(model, Forest):
        model.save(SparkSession.getActiveSession(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | Forest:
    """Load a fitted pipeline or forest (error if absent)."""
    spark = SparkSession.getActiveSession()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/forest")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return Forest.load(spark, path)
    return PipelineModel.load(path)
