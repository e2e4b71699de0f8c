"""Distributed model training, thresholded scoring, gates and probes (pyspark.ml).

A ladder of random forest candidates with balanced class weights (``weightCol``
= n / (2 n_class)), sqrt feature subsets and a fixed seed.  Declared deviations:
Spark's binned splits have no ``min_samples_split``; the candidate is chosen on
a validation split of the training rows, not on the test split, and then fitted
again on all of them.

A model is fitted on every training row, unless the caller names ``max_train_rows``;
class weights are counted on the rows of the fit alone.  Up to ``K.ROW_FIT_ROWS``
rows are kept and dealt by key into a fixed number of partitions, and pyspark reads
them at every level of its trees.  More rows are counted in the cells of the forest's
bins once (``cells.py``), which no number of rows makes larger.  So a forest depends
neither on the number of cores nor on the files; the logistic coefficients of a large
table depend on them in the last digits, since their sums are made partition by partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import ensure_checkpoint_dir
from .analytics import binary_metrics, hash_unit
from .cells import ROWS, Cells, count_cells, fit_cells
from .features import prepare_features
from .forest import NODE_COLUMNS, node_table
from .profile import Profile, order_statistics

FIT_PARTITIONS = 16
#: Fits and writes that go on at once.  One fit has fewer tasks a level than a cluster has cores,
#: and none between levels; what a second one adds fills the gap.
AT_ONCE = 2
#: The cap's hash is apart from both splits': by one of theirs it would keep rows of one side only.
CAP_SEED = "cap"


@dataclass
class Fitted:
    """The selected forest, its parameters, the ladder's models and report, and the kept tables."""

    model: object
    params: dict
    models: list
    report: list
    train: DataFrame
    test: DataFrame

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


@contextmanager
def side_by_side(spark: SparkSession, at_once: int = AT_ONCE) -> Iterator[Callable[..., Future]]:
    """A ``start(function, *arguments)`` whose calls run on Spark side by side, begun in order.

    At the end of the block those that have not begun are dropped and the jobs of those that
    still run are cancelled: ask for the results that are needed before.
    """
    sc, tag, begun = spark.sparkContext, f"side-by-side-{uuid.uuid4().hex}", []

    def tagged(call: Callable, *args):
        sc.addJobTag(tag)
        try:
            return call(*args)
        finally:
            sc.removeJobTag(tag)

    def start(call: Callable, *args) -> Future:
        begun.append(pool.submit(inheritable_thread_target(spark)(tagged), call, *args))
        return begun[-1]

    pool = ThreadPoolExecutor(at_once)
    try:
        yield start
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
        # a call between two jobs has none to cancel yet
        while any(not f.done() for f in begun):
            sc.cancelJobsWithTag(tag)
            wait(begun, timeout=0.2)


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=K.FEATURES, outputCol="features").transform(prepare_features(df))


def with_class_weights(df: DataFrame, target: str = "congestion") -> DataFrame:
    """Balanced weights n / (2 * n_class) from one grouped count (2 rows, broadcast)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    w = counts.crossJoin(F.broadcast(total)).select(target, (F.col("_n") / (2.0 * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), target)


#: Share of the test rows, and of the validation rows among the training rows.
VALID_FRACTION = 0.2


def split(df: DataFrame, key_cols: list[str], seed: int = K.SPLIT_SEED, test_fraction: float = VALID_FRACTION) -> tuple[DataFrame, DataFrame]:
    u = hash_unit(seed, key_cols)
    return df.where(u >= test_fraction), df.where(u < test_fraction)


def stratified_cap(df: DataFrame, key_cols: list[str], max_rows: int, target: str = "congestion", seed: int | str = CAP_SEED) -> DataFrame:
    """At most ``max_rows`` rows with the classes' shares kept (a sampling operator).

    Each class keeps its rows of least key hash, below an exact order statistic
    of that hash: no sort and no shuffle of rows.  Rows without a class are
    dropped.  ``max_rows`` <= 0 means no bound.
    """
    labelled = df.where(F.col(target).isNotNull())
    if max_rows <= 0:
        return labelled
    counts = class_counts(labelled, target)
    total = sum(counts.values())
    if total <= max_rows:
        return labelled
    u = hash_unit(seed, key_cols)
    ranks = {c: max_rows * n // total for c, n in counts.items()}
    edges = order_statistics(labelled, {f"class {c}": (F.when(F.col(target) == c, u), [k]) for c, k in ranks.items()})
    keep = F.lit(False)
    for c in ranks:
        keep = keep | ((F.col(target) == c) & (u < F.lit(edges[f"class {c}"][0])))
    return labelled.where(keep)


def class_counts(df: DataFrame, target: str = "congestion") -> dict[int, int]:
    return {int(r[0]): r[1] for r in df.groupBy(target).agg(F.count(F.lit(1))).collect()}


def training_tables(df: DataFrame, key_cols: list[str], target: str = "congestion", max_train_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with assembled features; up to ``K.ROW_FIT_ROWS`` training rows are kept.

    All training rows, unless ``max_train_rows`` bounds them; class weights are counted on them.
    """
    return _training_tables(df, key_cols, target, max_train_rows)[:2]


def _training_tables(df: DataFrame, key_cols: list[str], target: str, max_train_rows: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Training and test rows, and the training rows by class."""
    train, test = split(assemble(df), key_cols)
    train = stratified_cap(train, key_cols, max_train_rows, target)
    counts = class_counts(train, target)
    if sum(counts.values()) > K.ROW_FIT_ROWS:
        weight = F.lit(None).cast("double")
        for c, w in balanced(counts).items():
            weight = F.when(F.col(target) == c, F.lit(w)).otherwise(weight)
        return train.withColumn("weight", weight), test, counts
    kept = train.repartition(FIT_PARTITIONS, *key_cols).sortWithinPartitions(*key_cols).persist(StorageLevel.MEMORY_AND_DISK)
    train = with_class_weights(kept, target).persist(StorageLevel.MEMORY_AND_DISK)
    train.count()
    kept.unpersist()
    return train, test, counts


def balanced(counts: dict[int, int]) -> dict[int, float]:
    """Class weights n / (2 * n_class)."""
    return {c: sum(counts.values()) / (2.0 * n) for c, n in counts.items()}


@dataclass
class CellRows:
    """Counted training rows in the place of a table of them."""

    sparkSession: SparkSession
    cells: Cells
    weights: tuple[float, float]


def fit_forest(train: DataFrame | CellRows, params: dict, target: str = "congestion"):
    """A forest; each row's node of every tree is kept between levels, so a level costs the same
    at any depth (without that, every level sends every row down all trees from the root)."""
    if isinstance(train, CellRows):
        return fit_cells(train.sparkSession, train.cells, train.weights, params, target)
    ensure_checkpoint_dir(train.sparkSession)
    rf = RandomForestClassifier(
        featuresCol="features",
        labelCol=target,
        weightCol="weight",
        numTrees=params["numTrees"],
        maxDepth=params["maxDepth"],
        minInstancesPerNode=params["minInstancesPerNode"],
        featureSubsetStrategy="sqrt",
        cacheNodeIds=True,
        seed=K.MODEL_SEED,
    )
    return rf.fit(train)


def predict(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class-1 probability and prediction = probability > threshold."""
    p = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    return p.withColumn("pred", (F.col("prob") > threshold).cast("int"))


def evaluate(model, test: DataFrame, target: str = "congestion", threshold: float = 0.5) -> dict:
    m = binary_metrics(predict(model, test, threshold), target, "pred", ROWS if ROWS in test.columns else None).collect()[0]
    return m.asDict()


def candidate_ladder(train: DataFrame | CellRows, valid: DataFrame, candidates=None, target: str = "congestion"):
    """Candidates in order up to the first with accuracy in the band or below it.

    While a candidate is fitted the next one is too, whose fit is given up if it is not
    needed.  Returns (chosen parameters, fitted models, report rows)."""
    candidates = candidates or K.RF_CANDIDATES
    lo, hi = K.ACCURACY_BAND
    report, models = [], []

    def fit(params):
        model = fit_forest(train, params, target)
        return model, evaluate(model, valid, target)

    with side_by_side(train.sparkSession) as start:
        for i, (params, fitted) in enumerate([(p, start(fit, p)) for p in candidates]):
            model, m = fitted.result()
            models.append(model)
            imp = dict(zip(K.FEATURES, model.featureImportances.toArray().tolist()))
            report.append((i, params["numTrees"], params["maxDepth"], params["minInstancesPerNode"], m["accuracy"], m["precision"], m["recall"], m["f1"],
                           imp["latency"], imp["throughput"], imp["packet_loss"]))
            if m["accuracy"] <= hi:
                break
    return params, models, report


def fit_selected(df: DataFrame, key_cols: list[str], candidates=None, target: str = "congestion", max_train_rows: int = 0) -> Fitted:
    """Choose a candidate on a validation split of the training rows, then fit it on all of them."""
    train, test, counts = _training_tables(df, key_cols, target, max_train_rows)
    part, valid = split(train, key_cols, seed=K.MODEL_SEED)
    rows = train
    if sum(counts.values()) > K.ROW_FIT_ROWS:
        if not set(counts) <= {0, 1}:
            raise ValueError(f"the classes are 0 and 1, not {sorted(counts)}")
        weights = tuple(balanced(counts).get(c, 0.0) for c in (0, 1))
        of_part, of_valid, of_all = count_cells(train.withColumn("_part", hash_unit(K.MODEL_SEED, key_cols) >= VALID_FRACTION), "_part", weights, target)
        part, rows = (CellRows(df.sparkSession, c, weights) for c in (of_part, of_all))
        # a forest's answer is one for all rows of a cell
        valid = of_valid.table(df.sparkSession, target)
    params, models, report = candidate_ladder(part, valid, candidates, target)
    return Fitted(fit_forest(rows, params, target), params, models, report, train, test)


#: Columns of the ladder's report, a row per candidate.
REPORT = (
    "candidate int, num_trees int, max_depth int, min_instances int, accuracy double, precision double, recall double, f1 double, "
    "importance_latency double, importance_throughput double, importance_packet_loss double"
)
#: Number of the selected forest among the candidates' in a run's node table.
SELECTED = -1


def save_run(spark: SparkSession, fitted: Fitted, path: str, profile: Profile | None = None) -> None:
    """A training run as a folder: the forest, all forests' nodes, the logistic
    coefficients, the ladder's report, the training and test rows, the feature
    means and, where given, the profile that made the features."""
    places = [f"{path}/model", *[f"{path}/candidates/{i}" for i in range(len(fitted.models))]]
    with side_by_side(spark) as start:
        logistic = start(fit_logistic, fitted.train)
        done = [start(lambda: fitted.test.write.parquet(f"{path}/test")), start(lambda: fitted.train.write.parquet(f"{path}/train"))]
        done += [start(save_model, model, place) for model, place in zip([fitted.model, *fitted.models], places)]
        model, importance = logistic.result()
        for f in done:
            f.result()
    nodes = node_table(spark, places[0]).withColumn("candidate", F.lit(SELECTED))
    for i, place in enumerate(places[1:]):
        nodes = nodes.unionByName(node_table(spark, place).withColumn("candidate", F.lit(i)))
    nodes.write.parquet(f"{path}/nodes")
    spark.createDataFrame(fitted.report, REPORT).write.parquet(f"{path}/report")
    terms = [float(model.intercept), *map(float, model.coefficients.toArray()), *[float(importance[c]) for c in K.FEATURES]]
    names = ["intercept", *[f"coefficient_{c}" for c in K.FEATURES], *[f"importance_{c}" for c in K.FEATURES]]
    spark.createDataFrame([tuple(terms)], ", ".join(f"{n} double" for n in names)).write.parquet(f"{path}/logistic")
    if profile is not None:
        profile.save(spark, f"{path}/profile")


def run_nodes(spark: SparkSession, path: str, candidate: int = SELECTED) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes").where(F.col("candidate") == candidate).select(*NODE_COLUMNS)


def logistic_probability(df: DataFrame, terms: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class-1 probability from a stored row of coefficients; its importances come along."""
    z = F.col("intercept")
    for c in K.FEATURES:
        z = z + F.col(f"coefficient_{c}") * F.col(c)
    # one row by construction
    out = df.crossJoin(F.broadcast(terms.limit(1))).withColumn("prob", 1 / (1 + F.exp(-z)))
    return out.withColumn("pred", (F.col("prob") > threshold).cast("int"))


def save_model(model, path: str) -> None:
    """Write a fitted forest to a folder (any file system Spark can write)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


METRICS = "tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double"


def save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """Metrics as one JSON document in a folder (any file system Spark can write)."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def metric_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The stored metrics of all runs under ``folder`` as one table.

    A run is a sub-folder that ``save_metrics`` or a JSON writer filled.  The
    schema is declared; a document that does not parse keeps its text in
    ``malformed`` and has no metrics.
    """
    schema = f"{METRICS}, malformed string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").option("recursiveFileLookup", True).json(folder)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(run.alias("run"), *rows.columns)


def gate_runs(runs: DataFrame, min_accuracy: float = K.MIN_ACCURACY) -> DataFrame:
    """Every stored run with its verdict: a run without a readable accuracy is
    reported as such and does not pass."""
    known = F.col("accuracy").isNotNull()
    problem = F.when(F.col("malformed").isNotNull(), F.lit("malformed")).when(~known, F.lit("no accuracy"))
    return metric_gate(runs, min_accuracy).withColumn("passed", known & F.col("malformed").isNull() & F.coalesce(F.col("passed"), F.lit(False))).withColumn("problem", problem)


def validate_metrics(metrics: dict, min_accuracy: float = K.MIN_ACCURACY) -> None:
    """Raise where stored metrics miss the gate."""
    if metrics["accuracy"] < min_accuracy:
        raise ValueError(f"accuracy {metrics['accuracy']:.4f} is below {min_accuracy:.2f}")


def feature_importance(model) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray().tolist()
    return sorted(zip(K.FEATURES, imp), key=lambda kv: -kv[1])


def fit_logistic(train: DataFrame, target: str = "congestion"):
    lr = LogisticRegression(featuresCol="features", labelCol=target, weightCol="weight")
    model = lr.fit(train)
    coef = [abs(c) for c in model.coefficients.toArray().tolist()]
    total = sum(coef)
    importance = [c / total if total else c for c in coef]
    return model, dict(zip(K.FEATURES, importance))


def sensitivity_probes(spark, model) -> DataFrame:
    """Five fixed probe states scored by the model, with deltas from healthy and checks."""
    probes = spark.createDataFrame(K.PROBES, "scenario string, latency double, throughput double, packet_loss double")
    scored = predict(model, assemble(probes)).select("scenario", "latency", "throughput", "packet_loss", "prob", "pred")
    base = scored.where(F.col("scenario") == "healthy").select(F.col("prob").alias("_base"), F.col("pred").alias("_base_pred"))
    out = scored.crossJoin(F.broadcast(base)).withColumn("delta_from_healthy", F.col("prob") - F.col("_base"))
    check = (
        F.when(F.col("scenario") == "high_latency", F.col("delta_from_healthy") >= K.MIN_PROBABILITY_DELTA["latency"])
        .when(F.col("scenario") == "high_packet_loss", F.col("delta_from_healthy") >= K.MIN_PROBABILITY_DELTA["packet_loss"])
        .when(F.col("scenario") == "healthy", F.col("pred") == 0)
        .when(F.col("scenario") == "combined_failure", F.col("pred") == 1)
    )
    return out.withColumn("ok", check).drop("_base", "_base_pred")


def importance_floors(spark, model) -> DataFrame:
    """Each feature's importance beside the least that the gate allows."""
    rows = [(f, float(v), K.MIN_IMPORTANCE[f], float(v) >= K.MIN_IMPORTANCE[f]) for f, v in feature_importance(model)]
    return spark.createDataFrame(rows, "feature string, importance double, floor double, ok boolean")


def learning_gate(spark, model) -> None:
    """Raise with every importance floor and probe that the model misses."""
    low = [r["feature"] for r in importance_floors(spark, model).collect() if not r["ok"]]
    wrong = [r["scenario"] for r in sensitivity_probes(spark, model).collect() if r["ok"] is False]
    if low or wrong:
        raise ValueError(f"importance below its floor: {low}; probes that fail: {wrong}")


def metric_gate(metrics: DataFrame, min_accuracy: float = K.MIN_ACCURACY) -> DataFrame:
    return metrics.withColumn("min_accuracy", F.lit(min_accuracy)).withColumn("passed", F.col("accuracy") >= min_accuracy)
