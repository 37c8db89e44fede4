"""Suitability models: feature sets, keyed training and audits of all species, selection and scoring.

The candidates are fitted by ``keyed_models``; the neural sidecar is MLlib's, trained by
``neural`` where it has many rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import (
    COORDINATE_FEATURES,
    FLAG_FEATURES,
    LOW_CONFIDENCE_RECORDS,
    MINIMUM_FEATURES,
    NULL_MODEL_FEATURES,
    OPTIONAL_FEATURES,
)
from ..functions.numbers import finite
from ..functions.suitability import rating_strict
from ..session import cut, held, small_side
from . import neural
from .audit import column_profile, keep_column, usable_columns
from .display import contrast_score, display_mask
from .keyed_models import BASELINES, CORRECTED, SALTS, TUNED, Effort, Estimator, candidate_id, fit_models, score_rows
from .metrics import confidence_tier, evaluate, pick_candidate, poor_result_reasons, rank_candidates
from .ranking import average_rank_percentile, column_quantiles, relative_score
from .sampling import downsample_background, downsample_unshuffled, min_depth, offshore

# fixed values: sets whose candidates are tuned, strategies of the corrected retrain
TUNED_SETS = ("full_available_oceanographic", "no_coordinates", "sst_bathy_season")
CORRECTED_STRATEGIES = ("offshore_constrained_background", "environment_stratified_background", "spatial_buffered_background")
RESULT_SCHEMA = (
    "species_id string, candidate_id string, model_name string, feature_set_name string, "
    "feature_count long, background_ratio long, train_roc_auc double, validation_roc_auc double, "
    "validation_pr_auc double, validation_top_10_hit_rate double, validation_brier_score double, "
    "test_roc_auc double, test_pr_auc double, test_top_10_hit_rate double, status string, reason string"
)


def candidate_sets() -> dict[str, tuple]:
    """The named feature lists."""
    groups = {
        "minimum_sst_bathy": MINIMUM_FEATURES,
        "sst_bathy_season": MINIMUM_FEATURES + FLAG_FEATURES,
        "full_available_oceanographic": MINIMUM_FEATURES + OPTIONAL_FEATURES + FLAG_FEATURES,
    }
    groups["no_coordinates"] = groups["full_available_oceanographic"]
    groups["coordinates_allowed_as_bias_check"] = groups["no_coordinates"] + COORDINATE_FEATURES
    return groups


def feature_sets(df: DataFrame) -> dict[str, list[str]]:
    """Named feature lists, screened in one pass over the union of all candidates."""
    groups = candidate_sets()
    kept = set(usable_columns(df, groups["coordinates_allowed_as_bias_check"]))
    return {name: [c for c in columns if c in kept] for name, columns in groups.items()}


@dataclass(frozen=True)
class Preprocessor:
    """Train-split medians, means and deviations of a few columns (one row of numbers)."""

    columns: tuple[str, ...]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], row_id: str) -> "Preprocessor":
        """Exact medians by narrowing ranges; mean and deviation after filling."""
        typed = train.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
        median = {columns[r["column"]]: r["value"] for r in column_quantiles(typed, [], columns).collect()}
        filled = [F.coalesce(c, F.lit(median.get(c, 0.0))).alias(c) for c in columns]
        stats = typed.select(*filled).agg(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(columns)],
        ).first()
        mean = {c: stats[f"m_{i}"] for i, c in enumerate(columns)}
        scale = {c: stats[f"s_{i}"] or 1.0 for i, c in enumerate(columns)}
        return cls(tuple(columns), median, mean, scale)

    def apply(self, df: DataFrame) -> DataFrame:
        """Filled and standardised columns; absent columns count as all missing."""
        def ready(c: str):
            raw = finite(F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double")
            filled = F.coalesce(raw, F.lit(self.median.get(c)).cast("double"))
            return F.coalesce(finite((filled - self.mean[c]) / self.scale[c]), F.lit(0.0)).alias(c)

        rest = [c for c in df.columns if c not in self.columns]
        return df.select(*rest, *[ready(c) for c in self.columns])


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """n / (2 * n_class): two counts reach the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = row["n"], row["p"]
    weight = F.when(F.col(label) == 1, n / (2 * max(p, 1))).otherwise(n / (2 * max(n - p, 1)))
    return df.withColumn(out, weight)


def neural_estimator(inputs: int, epochs: int = 100) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        layers=[inputs, 128, 64, 32, 2], maxIter=epochs, seed=42,
        labelCol="label", featuresCol="features",
    )


@dataclass
class Fitted:
    """A fitted candidate with the preprocessing it was trained under."""

    preprocessor: Preprocessor
    model: PipelineModel
    columns: list[str]

    def score(self, df: DataFrame, out: str = "raw_score", keep: list[str] | None = None) -> DataFrame:
        """Probability of presence; ``keep`` columns come back unchanged."""
        wanted = keep or df.columns
        inputs = [F.col(c).alias(f"_keep_{c}") for c in wanted]
        raw = [c for c in self.columns if c in df.columns]
        ready = self.preprocessor.apply(df.select(*inputs, *raw))
        scored = self.model.transform(ready)
        return scored.select(
            *[F.col(f"_keep_{c}").alias(c) for c in wanted],
            vector_to_array("probability")[1].alias(out),
        )


def fit_candidate(train: DataFrame, columns: list[str], estimator, row_id: str) -> Fitted:
    """Fit an MLlib estimator on the preprocessed and weighted training frame."""
    if isinstance(estimator, MultilayerPerceptronClassifier) and train.count() > neural.MLLIB_ROWS:
        # training reads its rows many times
        train = held(train.select("label", *columns))
        prep = Preprocessor.fit(train, columns, row_id)
        model = neural.fit(prep.apply(train), columns, estimator)
        return Fitted(prep, PipelineModel([VectorAssembler(inputCols=columns, outputCol="features"), model]), columns)
    prep = Preprocessor.fit(train, columns, row_id)
    ready = class_weights(prep.apply(train.select("label", *columns)))
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    vectors = assembler.transform(ready).select("label", "weight", "features").cache()
    fitted = Fitted(prep, PipelineModel([assembler, estimator.fit(vectors)]), columns)
    vectors.unpersist()
    return fitted


def training_reasons(data: DataFrame) -> DataFrame:
    """species_id, reason: why a species cannot be trained, or ``ready``; one pass for all species."""
    is_p, is_b = F.col("label") == 1, F.col("label") == 0
    in_val = F.col("split") == "validation"
    p, b = F.count_if(is_p), F.count_if(is_b)
    vp, vb = F.count_if(in_val & is_p), F.count_if(in_val & is_b)
    reason = (
        F.when(p < LOW_CONFIDENCE_RECORDS, "fewer than 100 presence records; rule-based only")
        .when(b == 0, "no background samples available")
        .when((vp == 0) | (vb == 0), "validation split is unavailable or single-class")
        .otherwise("ready")
    )
    return data.groupBy("species_id").agg(reason.alias("reason"))


def _columns_of(data: DataFrame, *lists) -> list[str]:
    """The names of ``lists`` that ``data`` has, each once, in order."""
    return [c for c in dict.fromkeys(c for some in lists for c in some) if c in data.columns]


def usable_by_group(data: DataFrame, columns: list[str], groups: list[str], strict: bool = True) -> DataFrame:
    """``groups`` and ``usable``, the names of the columns that pass the screening there."""
    rule = keep_column() if strict else (F.col("numbers") > 0) & F.col("varied")
    # a group has at most as many rows as there are columns
    return column_profile(data, columns, groups).where(rule).groupBy(*groups).agg(F.collect_set("column").alias("usable"))


def _places(names, columns: list[str]) -> Column:
    """Where the usable ones of ``names`` stand in ``columns``, in the order of ``names``."""
    known = F.array(*[F.lit(c) for c in columns])
    listed = F.array(*[F.lit(c) for c in names if c in columns]).cast("array<string>")
    return F.transform(F.filter(listed, lambda c: F.array_contains("usable", c)), lambda c: (F.array_position(known, c) - 1).cast("int"))


def keyed_sets(usable: DataFrame, sets: dict[str, tuple], columns: list[str], least: int) -> DataFrame:
    """A row per row of ``usable`` and named set that keeps at least ``least`` features."""
    named = F.array(*[F.struct(F.lit(n).alias("set_name"), _places(names, columns).alias("features")) for n, names in sets.items()])
    each = usable.withColumn("_s", F.explode(named))
    return each.select(*[c for c in usable.columns if c != "usable"], "_s.*").where(F.size("features") >= least)


def split_metrics(data: DataFrame, models: DataFrame, columns: list[str], row_id: str, keys: list[str] | None = None, split: str = "split",
                  salts: tuple[int, int] = (1, SALTS)) -> DataFrame:
    """species_id, candidate_id, split and all metrics of every model on all rows of its key.

    Models of one estimator, group and list of columns are equal: one of them is scored for all.
    """
    known = data.where(F.col(split).isNotNull()).withColumn("split", F.col(split))
    alike = Window.partitionBy("species_id", "grp", "name", "features").orderBy("candidate_id")
    named = models.select("species_id", "grp", "name", "features", candidate_id().alias("candidate_id"))
    named = small_side(named.select("species_id", "candidate_id", F.first("candidate_id").over(alike).alias("_as")))
    first = named.where("candidate_id = _as").select("species_id", F.col("_as").alias("_scored"))
    scorers = models.join(F.broadcast(first.withColumnRenamed("species_id", "_s")), (F.col("species_id") == F.col("_s")) & (candidate_id() == F.col("_scored"))).drop("_s", "_scored")
    scored = held(score_rows(known, scorers, columns, ["species_id", row_id, "label", "split"], keys=keys, salts=salts))
    found = evaluate(scored, ["species_id", "candidate_id", "split"], "label", "raw_score", row_id)
    return found.withColumnRenamed("candidate_id", "_as").join(named, ["species_id", "_as"]).drop("_as")


def candidate_results(models: DataFrame, found: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per trained model with its metrics by split, and one per species without any.

    ``found``: ``split_metrics``; ``reasons``: species_id, reason for the species that have no model.
    """
    def of(split: str, metric: str, name: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(metric))).alias(f"{split}_{name}")

    wide = found.groupBy("species_id", "candidate_id").agg(
        of("train", "roc_auc", "roc_auc"), of("validation", "roc_auc", "roc_auc"), of("validation", "pr_auc", "pr_auc"),
        of("validation", "top_10_hit_rate", "top_10_hit_rate"), of("validation", "brier_score", "brier_score"),
        of("test", "roc_auc", "roc_auc"), of("test", "pr_auc", "pr_auc"), of("test", "top_10_hit_rate", "top_10_hit_rate"),
    )
    trained = models.select(
        "species_id", candidate_id().alias("candidate_id"), F.col("name").alias("model_name"), F.col("set_name").alias("feature_set_name"),
        F.size("features").cast("long").alias("feature_count"), F.col("ratio").alias("background_ratio"),
        F.lit("trained").alias("status"), F.lit("").alias("reason"),
    ).join(wide, ["species_id", "candidate_id"], "left")
    empty = reasons.select(
        "species_id", F.concat("species_id", F.lit("__none")).alias("candidate_id"), F.lit("not_trained").alias("status"), "reason")
    columns = [f.name for f in StructType.fromDDL(RESULT_SCHEMA)]
    return trained.unionByName(empty, allowMissingColumns=True).select(*columns).withColumn("poor_result_reasons", poor_result_reasons())


@dataclass
class Trained:
    """The model table, the columns its places refer to, and the candidate table."""

    models: DataFrame
    columns: list[str]
    candidates: DataFrame


def train_all(data: DataFrame, row_id: str, effort: Effort = Effort(), ratios: tuple[int, ...] = (10, 5), tuned: bool = True,
              sets: dict[str, tuple] | None = None) -> Trained:
    """Every candidate of every species; ``data`` carries ``split``.

    A species that may not be trained has one row with the reason. Rows without a species belong
    to no model.
    """
    data = data.where(F.col("species_id").isNotNull())
    sets = sets or candidate_sets()
    columns = _columns_of(data, *sets.values())
    reasons = cut(training_reasons(data))
    able = data.join(reasons.where("reason = 'ready'"), "species_id", "left_semi")
    usable = usable_by_group(able, columns, ["species_id"])
    plain = cut(keyed_sets(usable, sets, columns, 3))
    named = plain.withColumn("ratio", F.explode(F.array(*[F.lit(r).cast("long") for r in ratios])))
    keyed = named.withColumns({
        "grp": F.concat(F.lit("br"), "ratio"), "prefix": F.concat("set_name", F.lit("__br"), "ratio"),
        "tuned": F.lit(tuned) & (F.col("ratio") == 10) & F.col("set_name").isin(*TUNED_SETS)})
    train = able.where(F.col("split") == "train").select("species_id", row_id, "label", *columns)
    drawn = reduce(DataFrame.unionByName, [
        downsample_background(train, r, ["species_id"], row_id).withColumn("grp", F.lit(f"br{r}")) for r in ratios])
    models = fit_models(drawn, keyed, columns, (*BASELINES, *(TUNED if tuned else ())), row_id, effort)
    ready = plain.select("species_id").distinct().withColumn("_sets", F.lit(True))
    has = models.select("species_id").distinct().withColumn("_models", F.lit(True))
    why = reasons.join(ready, "species_id", "left").join(has, "species_id", "left").where(F.col("_models").isNull()).select(
        "species_id", F.when(F.col("reason") != "ready", F.col("reason")).when(F.col("_sets").isNull(), "no usable environmental feature columns")
        .otherwise("training split is single-class").alias("reason"))
    return Trained(models, columns, cut(candidate_results(models, split_metrics(able, models, columns, row_id), why)))


def species_models(data: DataFrame, row_id: str, names: tuple[str, ...], estimator: Estimator = BASELINES[2], ratio: int = 5,
                   effort: Effort = Effort()) -> tuple[DataFrame, list[str]]:
    """One model of every species that may be trained, without a choice among candidates, and its columns."""
    data = data.where(F.col("species_id").isNotNull())
    columns = _columns_of(data, names)
    able = data.join(small_side(training_reasons(data).where("reason = 'ready'")), "species_id", "left_semi")
    keyed = keyed_sets(usable_by_group(able, columns, ["species_id"]), {"own": tuple(columns)}, columns, 3).withColumns({
        "grp": F.lit("own"), "prefix": F.lit("own"), "ratio": F.lit(ratio).cast("long"), "tuned": F.lit(False)})
    train = able.where(F.col("split") == "train").select("species_id", row_id, "label", *columns)
    # training reads its rows several times
    drawn = held(downsample_unshuffled(train, ratio, ["species_id"], row_id).withColumn("grp", F.lit("own")))
    return fit_models(drawn, keyed, columns, (estimator,), row_id, effort), columns


def own_models(trained: Trained, chosen: DataFrame) -> DataFrame:
    """The rows of the model table that ``chosen`` (species_id, candidate_id) names."""
    picked = chosen.select("species_id", F.col("candidate_id").alias("_chosen"))
    return trained.models.join(picked, "species_id").where(candidate_id() == F.col("_chosen")).drop("_chosen")


def select_models(candidates: DataFrame, presence: DataFrame) -> DataFrame:
    """Chosen candidate per species with its confidence; ``presence`` has (species_id, presence_count)."""
    trained = candidates.where(F.col("status") == "trained")
    chosen = pick_candidate(rank_candidates(trained)).join(presence, "species_id", "left")
    return chosen.withColumn("confidence_level", confidence_tier())


def null_models(data: DataFrame, row_id: str, sets: dict[str, tuple], effort: Effort, split: str = "split") -> DataFrame:
    """species_id, candidate_id (the set), split and metrics of logistic models on poor feature sets."""
    data = data.where(F.col("species_id").isNotNull())
    columns = _columns_of(data, *sets.values())
    usable = usable_by_group(data, columns, ["species_id"], strict=False)
    keyed = keyed_sets(usable, sets, columns, 1).withColumns({
        "grp": F.lit("all"), "prefix": F.col("set_name"), "ratio": F.lit(None).cast("long"), "tuned": F.lit(False)})
    train = data.where(F.col(split) == "train").select("species_id", row_id, "label", *columns).withColumn("grp", F.lit("all"))
    models = fit_models(train, keyed, columns, BASELINES[:1], row_id, effort)
    found = split_metrics(data, models, columns, row_id, split=split, salts=(SALTS, 1))
    return found.withColumn("candidate_id", F.regexp_replace("candidate_id", f"__{BASELINES[0].name}$", ""))


def bias_audit(data: DataFrame, row_id: str, chosen: DataFrame, importance: DataFrame, effort: Effort = Effort()) -> DataFrame:
    """A row per species and null model, with the verdict on the species' selected model.

    ``chosen``: ``select_models``; ``importance``: species_id, feature, importance of those models.
    A species without a null model has one row without metrics, and is judged by its features.
    """
    order = Window.partitionBy("species_id").orderBy(F.desc("importance"), "feature")
    top = importance.withColumn("_n", F.row_number().over(order)).where("_n <= 25")
    doubtful = top.where(F.col("feature").isin(*COORDINATE_FEATURES) | F.col("feature").contains("missing_flag"))
    listed = doubtful.groupBy("species_id").agg(F.array_sort(F.collect_list(F.struct("_n", "feature"))).alias("_f")).select(
        "species_id", F.concat_ws(",", "_f.feature").alias("suspicious_features"))
    nulls = null_models(data, row_id, NULL_MODEL_FEATURES, effort).where("split = 'validation'").select(
        "species_id", F.col("candidate_id").alias("null_model"), "roc_auc", "pr_auc")
    best = nulls.groupBy("species_id").agg(F.max("roc_auc").alias("_roc"), F.max("pr_auc").alias("_pr"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    verdict = chosen.join(best, "species_id", "left").join(listed, "species_id", "left").select(
        "species_id", F.coalesce("suspicious_features", F.lit("")).alias("suspicious_features"),
        ((zero("_roc") >= zero("validation_roc_auc") - 0.03) | (zero("_pr") >= zero("validation_pr_auc") - 0.03)
         | F.col("suspicious_features").isNotNull()).alias("model_likely_biased"))
    return verdict.join(nulls, "species_id", "left").select(
        "species_id", "null_model", "roc_auc", "pr_auc", "suspicious_features", "model_likely_biased")


def split_validation(data: DataFrame, row_id: str, splits: dict[str, str], features: tuple[str, ...], effort: Effort = Effort()) -> DataFrame:
    """The main booster of every species under several split columns, against null models on the
    first of them.

    ``splits`` maps a report name to a split column. ``beats_null_models`` needs 0.03 more ROC-AUC;
    ``passes`` is the verdict on a species: whether its spatial-temporal holdout beats them.
    """
    data = data.where(F.col("species_id").isNotNull())
    columns = _columns_of(data, features)
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("grp"), F.col(c).alias("part")) for n, c in splits.items()]))
    long = held(data.select("species_id", row_id, "label", *columns, cases.alias("_c")).select("species_id", row_id, "label", *columns, "_c.*").where("part IS NOT NULL"))
    nulls = null_models(data, row_id, {k: v for k, v in NULL_MODEL_FEATURES.items() if k != "sst_bathy_season_only"}, effort, split=next(iter(splits.values())))
    best = nulls.where("split = 'validation'").groupBy("species_id").agg(F.max(F.coalesce("roc_auc", F.lit(0.0))).alias("best_null_roc_auc"))
    classes = long.where(F.col("part").isin("train", "validation")).groupBy("species_id", "grp").agg(
        F.count_distinct("part", "label").alias("_kinds"))
    usable = usable_by_group(data, columns, ["species_id"], strict=False)
    sets = keyed_sets(usable, {"main": tuple(columns)}, columns, 2).join(classes.where("_kinds = 4").drop("_kinds"), "species_id")
    keyed = sets.withColumns({"prefix": F.col("grp"), "ratio": F.lit(None).cast("long"), "tuned": F.lit(False)})
    models = fit_models(long.where("part = 'train'"), keyed, columns, (BASELINES[2],), row_id, effort)
    found = split_metrics(long, models, columns, row_id, keys=["species_id", "grp"], split="part", salts=(SALTS, 1))
    wide = found.withColumn("grp", F.regexp_replace("candidate_id", f"__{BASELINES[2].name}$", "")).groupBy("species_id", "grp").agg(
        *[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s, m in (("validation", "roc_auc"), ("validation", "pr_auc"), ("test", "roc_auc"))])
    names = F.explode(F.array(*[F.lit(n) for n in splits]))
    every = data.select("species_id").distinct().withColumn("grp", names)
    done = models.select("species_id", "grp").withColumn("_done", F.lit(True))
    rows = every.join(done, ["species_id", "grp"], "left").join(wide, ["species_id", "grp"], "left").join(best, "species_id", "left").withColumns({
        "best_null_roc_auc": F.coalesce("best_null_roc_auc", F.lit(0.0)),
        "status": F.when(F.col("_done"), "evaluated").otherwise("skipped")})
    beats = F.coalesce(F.col("validation_roc_auc"), F.lit(0.0)) > F.col("best_null_roc_auc") + 0.03
    judged = rows.withColumn("beats_null_models", beats & (F.col("status") == "evaluated"))
    holds = F.bool_or(F.col("beats_null_models") & (F.col("grp") == "spatial_temporal_holdout")).over(Window.partitionBy("species_id"))
    return judged.select(
        "species_id", F.col("grp").alias("split_name"), "status", "validation_roc_auc", "validation_pr_auc", "test_roc_auc",
        "best_null_roc_auc", "beats_null_models", holds.alias("passes"))


def corrected_retrain(samples: DataFrame, row_id: str, effort: Effort = Effort(), strategies: tuple[str, ...] = CORRECTED_STRATEGIES,
                      species: DataFrame | None = None) -> Trained:
    """Depth-limited, coordinate-free candidates of every species over strategy x ratio sample sets.

    ``samples`` is the keyed table of strategy samples with ``split``. ``species`` lists its species
    where that is known at less cost than by reading all samples.
    """
    known = samples.where(F.col("species_id").isNotNull())
    species = (known if species is None else species.where(F.col("species_id").isNotNull())).select("species_id").distinct()
    group = F.concat_ws("__br", "audit_background_strategy", "audit_background_ratio")
    columns = _columns_of(known, MINIMUM_FEATURES, OPTIONAL_FEATURES)
    deep = known.where((F.col("depth_m") >= min_depth()) & F.col("audit_background_strategy").isin(*strategies))
    mine = held(deep.withColumn("grp", group).select(
        "species_id", "grp", "audit_background_strategy", "audit_background_ratio", row_id, "label", "split", *columns))
    viable = mine.groupBy("species_id", "grp").agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_b"),
        F.first("audit_background_strategy").alias("_strategy"), F.first("audit_background_ratio").cast("long").alias("ratio"),
    ).where((F.col("_p") >= LOW_CONFIDENCE_RECORDS) & (F.col("_b") >= LOW_CONFIDENCE_RECORDS))
    usable = usable_by_group(mine, columns, ["species_id", "grp"], strict=False).join(viable.drop("_p", "_b"), ["species_id", "grp"])
    keyed = keyed_sets(usable, {"corrected": tuple(columns)}, columns, 4).withColumns({
        "set_name": F.col("_strategy"), "prefix": F.col("grp"), "tuned": F.lit(False)})
    models = fit_models(mine.where("split = 'train'"), keyed, columns, CORRECTED, row_id, effort)
    reasons = species.join(models.select("species_id").distinct(), "species_id", "left_anti").withColumn(
        "reason", F.lit("no viable corrected candidates"))
    found = split_metrics(mine, models, columns, row_id, keys=["species_id", "grp"], salts=(SALTS, 1))
    return Trained(models, columns, cut(candidate_results(models, found, reasons)))


def corrected_status(candidates: DataFrame) -> DataFrame:
    """species_id, status of the corrected retrain for the audit roll-up."""
    trained = F.bool_or(F.col("status") == "trained")
    return candidates.groupBy("species_id").agg(F.when(trained, "selected_corrected_under_audit").otherwise("not_trained").alias("status"))


def batch_predictions(scored: DataFrame, keys: list[str], row_id: str, path: str = "fine") -> DataFrame:
    """Scores to display columns. Ranking reads its input several times, so pass scores that
    are already written (or ``cut``), not a model transform. ``path``: 'demo' ranks all cells, 'corrected' only masked
    cells by average rank, 'fine' adds the contrast score."""
    if path == "demo":
        ranked = relative_score(scored, keys, "raw_score", row_id, "score")
        return ranked.withColumn("rating", rating_strict("score"))
    if path == "corrected":
        visible = scored.where(offshore())
        ranked = average_rank_percentile(visible, keys, "raw_score", "score", row_id)
        return ranked.withColumn("rating", rating_strict("score"))
    whole = relative_score(scored, keys, "raw_score", row_id, "raw_global_percentile_score", flat=1e-12)
    shown = contrast_score(whole.where(display_mask()), keys, row_id)
    return shown.withColumns({
        "raw_global_percentile_score": F.round("raw_global_percentile_score", 2),
        "score": F.round("score", 2),
    }).withColumn("rating", rating_strict("score"))


def training_rollup(status: DataFrame, selected: DataFrame) -> DataFrame:
    """Species x status x model x confidence x metrics."""
    return status.join(
        selected.select(
            "species_id", "candidate_id", "model_name", "feature_set_name", "confidence_level",
            "validation_roc_auc", "validation_pr_auc", "validation_top_10_hit_rate",
        ),
        "species_id", "left",
    )
