"""Features and patterns of groups of facts (correlation_id, kind, ts, success, plan_steps, duration, confidence), profiles, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAN, RUN, ERROR, OUTCOME = "Fact:Plan", "Fact:Execution", "Fact:Error", "Fact:Outcome"


def _first(column: str, kind: str) -> Column:
    """A column of the first fact of a kind: by time, then id."""
    return F.min_by(F.when(F.col("kind") == kind, F.col(column)), F.when(F.col("kind") == kind, F.struct("ts", "id")))


def feature_matrix(facts: DataFrame) -> DataFrame:
    """A row for each group that has an execution: plan_steps, avg_duration, max_duration, error_count, retry_count, outcome_success,
    outcome_confidence, execution_span_seconds and label: 1 if at least half of the executions succeeded.
    """
    run = F.col("kind") == RUN
    n = F.count_if(run)
    steps = F.coalesce(_first("plan_steps", PLAN), n)
    span = F.expr(f"timestampdiff(MICROSECOND, min(case when kind = '{RUN}' then ts end), max(case when kind = '{RUN}' then ts end))") / 1e6
    out = facts.where("correlation_id is not null").groupBy("correlation_id").agg(
        n.alias("__tm_n"), steps.alias("plan_steps"), F.avg(F.when(run, F.coalesce("duration", F.lit(0.0)))).alias("avg_duration"), F.max(F.when(run, F.coalesce("duration", F.lit(0.0)))).alias("max_duration"),
        F.count_if(F.col("kind") == ERROR).alias("error_count"), F.greatest(F.lit(0), n - steps).alias("retry_count"), F.max(F.when(F.col("kind") == OUTCOME, F.col("success").cast("int"))).alias("o"),
        F.coalesce(_first("confidence", OUTCOME), F.lit(0.0)).alias("outcome_confidence"), span.alias("execution_span_seconds"), F.when(F.count_if(run & F.col("success")) >= n / 2, 1).otherwise(0).alias("label"),
    )
    return out.where("__tm_n > 0").withColumn("outcome_success", F.coalesce("o", F.lit(0))).drop("__tm_n", "o")


def patterns(facts: DataFrame) -> DataFrame:
    """A row for each group that has a plan: pattern_type, its conditions, outcomes and confidence.

    Confidence is a tenth an execution, at most 1, less a tenth an error. success from 80 % of executions on; failure with errors or below 50 %; else, and without executions, neutral.
    """
    run, good = F.col("kind") == RUN, F.col("success")
    grouped = facts.where("correlation_id is not null").groupBy("correlation_id").agg(
        F.count_if(run).alias("runs"), F.count_if(run & good).alias("good"), F.count_if(F.col("kind") == ERROR).alias("errors"), F.count_if(F.col("kind") == PLAN).alias("plans"),
        F.coalesce(_first("plan_steps", PLAN), F.lit(0)).alias("plan_steps"),
    ).where("plans > 0")
    kind = F.when(F.col("runs") == 0, "neutral").when(F.col("good") >= F.col("runs") * 0.8, "success").when((F.col("errors") > 0) | (F.col("good") < F.col("runs") * 0.5), "failure").otherwise("neutral")
    rate = F.when(F.col("runs") > 0, F.col("good") / F.col("runs")).otherwise(0.0)
    return grouped.select(
        "correlation_id", kind.alias("pattern_type"), "plan_steps", (F.col("errors") > 0).alias("has_errors"), F.greatest(F.lit(0), F.col("runs") - F.col("plan_steps")).alias("retry_count"), rate.alias("success_rate"),
        F.col("errors").alias("error_count"), F.when(F.col("plan_steps") > 0, F.col("runs") / F.col("plan_steps")).otherwise(0.0).alias("completion_rate"),
        (F.greatest(F.lit(0), F.least(F.lit(10), F.col("runs")) - F.col("errors")) / 10).alias("confidence"),
    )


def pattern_groups(found: DataFrame, least_frequency: int = 5, least_confidence: float = 0.6) -> DataFrame:
    """Patterns by their conditions: frequency, mean outcomes and confidence; the type is that of the first group. Rare and unsure ones go.

    Confidences are tenths: they are added up as such, so that a mean at the threshold isn't lost to a last digit.
    """
    tenths = F.sum(F.round(F.col("confidence") * 10).cast("long"))
    out = found.groupBy("plan_steps", "has_errors", "retry_count").agg(
        F.count("*").alias("frequency"), F.min_by("pattern_type", "correlation_id").alias("pattern_type"), F.avg("success_rate").alias("success_rate"), F.avg("error_count").alias("error_count"),
        F.avg("completion_rate").alias("completion_rate"), (tenths / (10 * F.count("*"))).alias("confidence"), (tenths / 10 >= F.round(F.count("*") * least_confidence, 9)).alias("__tm_sure"),
    )
    named = F.substring(F.md5(F.to_json(F.struct("plan_steps", "has_errors", "retry_count")).cast("binary")), 1, 8)
    return out.where((F.col("frequency") >= least_frequency) & F.col("__tm_sure")).drop("__tm_sure").withColumn("pattern_id", named)


def forest(features: DataFrame, columns: list[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 42):  # noqa: ANN201  (a fitted model)
    """A random forest on the feature columns."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features)
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(made)


def current_profiles(versions: DataFrame) -> DataFrame:
    """The latest version of each profile (profile_id, version_id, ..)."""
    row = F.struct("version_id", *(c for c in versions.columns if c != "version_id"))
    return versions.groupBy("profile_id").agg(F.max(row).alias("__tm")).select(*(F.col("__tm")[c].alias(c) if c != "profile_id" else F.col(c) for c in versions.columns))


def activate(profiles: DataFrame, profile_id: str) -> DataFrame:
    """That profile is active and no other."""
    return profiles.withColumn("active", F.col("profile_id") == profile_id)


def rollback(versions: DataFrame, profile_id: str, version_id: int) -> DataFrame:
    """The rows to append: that version's content as the newest version."""
    newest = versions.where(F.col("profile_id") == profile_id).agg((F.max("version_id") + 1).alias("__tm_v"))
    old = versions.where((F.col("profile_id") == profile_id) & (F.col("version_id") == version_id))
    return old.crossJoin(F.broadcast(newest)).withColumn("version_id", F.col("__tm_v")).drop("__tm_v")


def decide(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """(request_id, decision, rules): deny without a profile or with an inactive one, else allow, with the keys of its rules."""
    joined = requests.join(profiles.select("profile_id", F.col("active").alias("__tm_a"), F.col("rules").alias("__tm_r")), "profile_id", "left")
    allowed = F.coalesce("__tm_a", F.lit(False))
    return joined.select("request_id", F.when(allowed, "allow").otherwise("deny").alias("decision"), F.when(allowed, F.array_sort(F.map_keys("__tm_r"))).otherwise(F.array().cast("array<string>")).alias("rules"))


def experiments(profiles: DataFrame) -> DataFrame:
    """(profile_id, experiment, weight) of profiles that have experiments."""
    return profiles.where(F.size("experiments") > 0).select("profile_id", F.explode("experiments").alias("experiment", "weight"))


def compare_profiles(candidate: Column, current: Column, margin: float = 0.01) -> Column:
    return F.when(candidate - current > margin, "candidate").otherwise("current")


def running_mean(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Adds n and mean: of each group's values so far."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n", F.count(value).over(w)).withColumn("mean", F.avg(value).over(w))


def folds(rows: DataFrame, by: str, n: int = 3) -> DataFrame:
    """Adds `fold`, from 0: by the hash of a group, so that no group is in two folds. (CRC-32 of the group as text, modulo n.)"""
    return rows.withColumn("fold", F.pmod(F.crc32(F.coalesce(F.col(by).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int"))


#: Trees, depths and least rows of a leaf that are tried: twelve combinations. (Spark's forests are at most 30 deep.)
TREES, DEPTHS, LEAVES = (100, 200), (5, 10, 30), (1, 2)


def cross_validated(features: DataFrame, columns: list[str], by: str, label: str = "label", n: int = 3, trees: tuple[int, ...] = TREES, depths: tuple[int, ...] = DEPTHS, leaves: tuple[int, ...] = LEAVES, seed: int = 42) -> tuple[DataFrame, dict]:
    """(rows with `fold` and `prediction`, what was chosen): each row is predicted by a forest that has seen no row of its fold.

    Spark's cross-validator chooses the combination of trees, depth and leaves with the best mean accuracy over the folds; then one forest a
    fold is fitted on the other folds. Groups (`by`) stay together. The choice has trees, depth, leaf, accuracy and `tried`, all means.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from ..shared import materialized

    rows = materialized(folds(features.select(by, *(c for c in columns if c != by), label), by, n), "folds")
    made = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows)
    tree = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed)
    some = ParamGridBuilder().addGrid(tree.numTrees, list(trees)).addGrid(tree.maxDepth, list(depths)).addGrid(tree.minInstancesPerNode, list(leaves)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    fitted = CrossValidator(estimator=tree, estimatorParamMaps=some, evaluator=judge, foldCol="fold", numFolds=n, parallelism=4).fit(made)
    place = max(range(len(some)), key=lambda k: (fitted.avgMetrics[k], -k))
    best = some[place]
    out = None
    for k in range(n):
        model = tree.copy(best).fit(made.where(F.col("fold") != k))
        one = model.transform(made.where(F.col("fold") == k)).select(*rows.columns, F.col("prediction").cast("int").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    chosen = {"trees": best[tree.numTrees], "depth": best[tree.maxDepth], "leaf": best[tree.minInstancesPerNode], "accuracy": fitted.avgMetrics[place], "tried": list(fitted.avgMetrics)}
    return out, chosen


def permutation_importance(model, data: DataFrame, columns: list[str], label: str = "label", repeats: int = 5, seed: int = 42) -> dict[str, float]:  # noqa: ANN001
    """How much accuracy a model loses, on average, when a column's values are dealt out anew among the rows.

    Rows and values are numbered by ranges (see `ranks.ranked`), values in the order of a hash: no task sees them all.
    """
    from pyspark.ml.feature import VectorAssembler

    from ..shared import materialized
    from .ranks import ranked

    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")

    def accuracy(df: DataFrame) -> float:
        return model.transform(assemble.transform(df)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0

    rows = materialized(data.select(*columns, label).withColumn("__tm_row", F.monotonically_increasing_id()), "rows")
    base, whole = ranked(rows, "__tm_row", out="__tm_at"), accuracy(rows)
    lost = {}
    for column in columns:
        drops = []
        for k in range(repeats):
            dealt = rows.select(F.col(column).alias("__tm_v"), F.xxhash64("__tm_row", F.lit(seed + k)).alias("__tm_h"), "__tm_row")
            other = ranked(dealt, "__tm_h", "__tm_row", out="__tm_at").select("__tm_at", "__tm_v")
            drops.append(whole - accuracy(base.join(other, "__tm_at").withColumn(column, F.col("__tm_v"))))
        lost[column] = sum(drops) / repeats
    return lost
