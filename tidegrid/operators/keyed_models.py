"""Models of every species, feature set, ratio and strategy at once.

Training rows are keyed by (species_id, grp), where a group is one draw of background rows (a
ratio, a strategy, a split); feature sets name the columns that a model of a group may use. There
is no loop over species and no filter per candidate:

* **Preprocessing**: medians, means and deviations of all groups and columns together.
* **Logistic models**: weighted Newton steps with a ridge. A task adds up one Gram matrix and
  gradient per group and set over all its rows; the sums of a group are as many rows as there
  were tasks, and are solved by key. All models step together until the last one stands still.
* **Sets of the same columns** are fitted once: their models are equal.
* **Trees**: every row of a group is packed into blocks of bins, as bytes. Candidates are dealt to
  shares of their group; a task reads the blocks of a group and fits the candidates of its share from
  them, so fits run side by side whatever they belong to. All rows of a group are fitted, as all
  numbers (medians, counts, metrics, logistic models) cover all rows; only a caller that passes
  ``fit_rows`` gets a sample of larger groups, drawn by hash within each class.
* **Models are a table**: coefficients, bin edges and tree nodes, one row per model. Rows are
  scored in packed blocks: a task reads the models of a key, then the blocks that they score, so a
  model travels once per task and not per row.

Rows without a species belong to no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..session import cut, held, small_side
from .ranking import column_quantiles, hash_firsts, hash_key, hash_ranks
from .trees import BINS, Trees, bin_edges, binned, booster, forest

RIDGE = 1.0
STILL = 1e-7
KEY = ["species_id", "grp"]
SALTS = 16
#: rows that are packed together, and rows of a block at most
PACK_ROWS, BLOCK_ROWS = 100_000, 16_384
#: rows of a block that trees are fitted from
FIT_BLOCK_ROWS = 1 << 17
#: bytes of models that may travel with every block of their key, and models that a task keeps at hand
BESIDE_BYTES, RECENT_MODELS = 16 << 20, 16


@dataclass(frozen=True)
class Effort:
    """Size of the estimators; the defaults are the full settings."""

    trees: int = 300
    boosts: int = 300
    iterations: int = 50


@dataclass(frozen=True)
class Estimator:
    """A kind of model: ``logistic``, ``forest`` or ``booster``. ``tuned`` ones go only to sets that
    say so."""

    name: str
    kind: str
    depth: int = 0
    leaf: int = 0
    rate: float = 0.0
    l2: float = 0.0
    seed: int = 42
    tuned: bool = False


# --- fixed values: the estimators and their settings ---
BASELINES = (
    Estimator("logistic_regression_balanced", "logistic"),
    Estimator("random_forest_baseline", "forest", depth=12, leaf=5),
    Estimator("gradient_boosting_baseline", "booster", depth=5, leaf=20, rate=0.05),
)
TUNED = (
    *[Estimator(f"random_forest_tuned_{i:02d}", "forest", depth=depth, leaf=leaf, seed=100 + i, tuned=True)
      for i, (depth, leaf) in enumerate((d, n) for d in (30, 10, 20) for n in (5, 10))],
    *[Estimator(f"gradient_boosting_tuned_{i:02d}", "booster", depth=depth, leaf=20, rate=rate, l2=0.1, tuned=True)
      for i, (rate, depth) in enumerate((r, d) for r in (0.03, 0.05, 0.1) for d in (4, 5, 6))],
)
CORRECTED = (
    Estimator("logistic_regression_balanced", "logistic"),
    Estimator("random_forest_conservative", "forest", depth=8, leaf=10),
    Estimator("gradient_boosting_conservative", "booster", depth=4, leaf=25, rate=0.04),
)

#: What a feature set of a group carries; ``prefix`` begins its candidate ids.
SET_COLUMNS = [*KEY, "set_name", "prefix", "ratio", "tuned", "features"]
MODEL_SCHEMA = (
    "species_id string, grp string, set_name string, prefix string, ratio bigint, name string, kind string, features array<int>, "
    "median array<double>, mean array<double>, scale array<double>, coefficients array<double>, importance array<double>, base double, "
    "edges binary, feature binary, bin binary, left binary, value binary, roots binary"
)
_PACKED = ("edges", "feature", "bin", "left", "value", "roots")
_TYPES = {"edges": np.float64, "feature": np.int8, "bin": np.uint8, "left": np.int32, "value": np.float64, "roots": np.int32}


def preprocessing(rows: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """species_id, grp, n, p, and median, mean and scale of every column, as arrays."""
    typed = rows.select(*KEY, row_id, "label", *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    found = column_quantiles(typed, KEY, columns)
    medians = found.groupBy(*KEY).agg(*[F.max(F.when(F.col("column") == i, F.col("value"))).alias(f"_m{i}") for i in range(len(columns))])
    # a column without a number is all zeros
    medians = small_side(medians.fillna(0.0))
    filled = typed.join(medians, KEY).withColumns({f"_f{i}": F.coalesce(c, f"_m{i}") for i, c in enumerate(columns)})
    every = range(len(columns))
    deviation = lambda i: F.coalesce(F.nullif(F.stddev_samp(f"_f{i}"), F.lit(0.0)), F.lit(1.0))
    return filled.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"),
        F.array(*[F.first(f"_m{i}") for i in every]).alias("median"),
        F.array(*[F.avg(f"_f{i}") for i in every]).alias("mean"),
        F.array(*[deviation(i) for i in every]).alias("scale"),
    )


def _standard(columns: list[str]) -> Column:
    """The filled and standardised columns as one array."""
    def one(i: int, c: str) -> Column:
        filled = F.coalesce(finite(F.col(c).cast("double")), F.col("median")[i])
        return F.coalesce(finite((filled - F.col("mean")[i]) / F.col("scale")[i]), F.lit(0.0))

    return F.array(*[one(i, c) for i, c in enumerate(columns)])


def ready_rows(rows: DataFrame, prep: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Weighted and standardised rows of the groups that hold both classes."""
    both = prep.where("p > 0 AND p < n")
    share = F.when(F.col("label") == 1, F.col("p")).otherwise(F.col("n") - F.col("p"))
    return rows.join(small_side(both), KEY).select(
        *KEY, row_id, F.col("label").cast("double").alias("label"), (F.col("n") / (2 * share)).alias("weight"), "n", _standard(columns).alias("x"))


def fitting_rows(rows: DataFrame, row_id: str, fit_rows: int) -> DataFrame:
    """``rows`` with ``n``, the rows of their group; of larger groups about ``fit_rows``, drawn by hash within each class."""
    if rows.where(F.col("n") > fit_rows).isEmpty():
        return rows
    limit = F.ceil(F.col("_size") * F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("n")))
    return hash_firsts(rows, [*KEY, "label", "n"], hash_key(row_id, seed="fit"), lambda sizes: sizes.withColumn("_limit", limit))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def logistic_models(ready: DataFrame, sets: DataFrame, width: int, iterations: int) -> DataFrame:
    """species_id, grp, set_name, coefficients (the last one is the intercept) by Newton steps."""
    size = width + 1
    zero = F.array_repeat(F.lit(0.0), size)
    now = cut(sets.select(*KEY, "set_name", "features", zero.alias("coefficients"), F.lit(float("inf")).alias("step")))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = np.append(_matrix(batch.column("x"), width), np.ones((len(batch), 1)), axis=1)
            y, w = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            key = pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in KEY])
            code, names = key.factorize()
            for k, (species, grp) in enumerate(names):
                mine = np.flatnonzero(code == k)
                for s in batch.column("models")[int(mine[0])].as_py():
                    a, b = np.array(s["coefficients"]), x[mine]
                    p = _sigmoid(b @ a)
                    h = w[mine] * p * (1 - p)
                    found = np.append(b.T @ (w[mine] * (y[mine] - p)), (b * h[:, None]).T @ b)
                    at = (species, grp, s["set_name"])
                    sums[at] = sums.get(at, 0) + found
        if sums:
            species, grp, name = zip(*sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(species), pa.array(grp), pa.array(name), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=[*KEY, "set_name", "sums"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """One Newton step of one model, from as many sums as there were tasks."""
        head = pdf.iloc[0]
        total = np.sum(np.stack(pdf["sums"]), axis=0)
        used = np.append(np.asarray(head["features"], dtype=np.int64), width)
        a = np.array(head["coefficients"], dtype=float)
        ridge = np.append(np.full(len(used) - 1, RIDGE), 1e-9)
        gradient = total[:size][used] - ridge * a[used]
        gram = total[size:].reshape(size, size)[np.ix_(used, used)] + np.diag(ridge)
        step = np.linalg.solve(gram, gradient)
        step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))
        a[used] += step
        return pd.DataFrame({"species_id": [head["species_id"]], "grp": [head["grp"]], "set_name": [head["set_name"]], "features": [head["features"]],
                             "coefficients": [a.tolist()], "step": [float(np.abs(step).max())]})

    schema = "species_id string, grp string, set_name string, features array<int>, coefficients array<double>, step double"
    done = None
    for _ in range(iterations):
        # models that stand still step no more; at most one row a group, set and task is added up
        open_ = now.where(F.col("step") >= STILL)
        models = open_.groupBy(*KEY).agg(F.collect_list(F.struct("set_name", "coefficients")).alias("models"))
        sums = ready.select(*KEY, "label", "weight", "x").join(small_side(models), KEY).mapInArrow(
            add_up, "species_id string, grp string, set_name string, sums array<double>")
        stepped = sums.join(open_.drop("step"), [*KEY, "set_name"]).groupBy(*KEY, "set_name").applyInPandas(solve, schema)
        now = cut(stepped)
        still = now.where(F.col("step") < STILL)
        done = still if done is None else done.unionByName(still)
        if now.where(F.col("step") >= STILL).isEmpty():
            return done.drop("step", "features")
    return done.unionByName(now.where(F.col("step") >= STILL)).drop("step", "features")


def _edges(ready: DataFrame, width: int) -> DataFrame:
    """species_id, grp, edges: the bin edges of every column of a group; one column of a group is sorted in a task."""

    def split(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([_matrix(batch.column("x"), width) for batch in some])
        key = pd.MultiIndex.from_arrays([np.concatenate([batch.column(c).to_pandas() for batch in some]) for c in KEY])
        code, names = key.factorize()
        found = []
        for g, name in enumerate(names):
            mine = x[code == g]
            found += [(*name, k, np.ascontiguousarray(mine[:, k]).tobytes()) for k in range(width)]
        species, grp, place, values = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(species, pa.string()), pa.array(grp, pa.string()), pa.array(place, pa.int32()), pa.array(values, pa.binary())],
                                          names=[*KEY, "place", "values"])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            if len(batch):
                some.append(batch)
                n += len(batch)
            if n >= PACK_ROWS:
                yield split(some)
                some, n = [], 0
        if some:
            yield split(some)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(v) for v in pdf["values"]])
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in (*KEY, "place")}, "edges": [bin_edges(values[:, None]).tobytes()]})

    parts = ready.select(*KEY, "x").mapInArrow(columns, "species_id string, grp string, place int, values binary")
    found = parts.groupBy(*KEY, "place").applyInPandas(sort, "species_id string, grp string, place int, edges binary")
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("place", "edges"))), F.lit(b""), lambda done, e: F.concat(done, e["edges"]))
    return found.groupBy(*KEY).agg(whole.alias("edges"))


def _packed_groups(ready: DataFrame, width: int, row_id: str, fit_rows: int | None = None) -> DataFrame:
    """species_id, grp, part, edges, bins, y, w: the rows of every group in the order of ``row_id``, NULLs last, in blocks of at
    most ``FIT_BLOCK_ROWS``; of a larger group about ``fit_rows`` rows, where that is given.

    ``bins`` holds the rows of a block column after column. A task reads a group row by row and keeps one block of it.
    """
    if fit_rows is not None:
        ready = fitting_rows(ready, row_id, fit_rows)
    rows = ready.select(*KEY, row_id, "label", "weight", "x")
    tasks = 4 * ready.sparkSession.sparkContext.defaultParallelism
    both = _edges(rows, width).unionByName(rows, allowMissingColumns=True)
    ordered = both.repartition(tasks, *KEY).sortWithinPartitions(*KEY, F.col("edges").isNull(), F.col(row_id).asc_nulls_last()).drop(row_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, edges, some, size = None, 0, b"", [], 0

        def block() -> pa.RecordBatch:
            bins, y, w = (np.concatenate(x, axis=-1) for x in zip(*some))
            found = [[at[0]], [at[1]], [part], [edges], [bins.tobytes()], [y.tobytes()], [w.tobytes()]]
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=[*KEY, "part", "edges", "bins", "y", "w"])

        for batch in batches:
            if not len(batch):
                continue
            species, grp = (batch.column(c).to_pandas() for c in KEY)
            given = batch.column("edges").is_valid().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((species[1:].to_numpy() != species[:-1].to_numpy()) | (grp[1:].to_numpy() != grp[:-1].to_numpy())) + 1
            for lo, hi in zip([0, *ends], [*ends, len(batch)]):
                if (species[lo], grp[lo]) != at:
                    if some:
                        yield block()
                    at, part, some, size = (species[lo], grp[lo]), 0, [], 0
                if given[lo]:
                    edges = batch.column("edges")[lo].as_py()
                    lo += 1
                cuts = np.frombuffer(edges).reshape(width, BINS - 1)
                while lo < hi:
                    n = min(hi - lo, FIT_BLOCK_ROWS - size)
                    mine = batch.slice(lo, n)
                    some.append((binned(_matrix(mine.column("x"), width), cuts).T, mine.column("label").to_numpy().astype(float), mine.column("weight").to_numpy().astype(float)))
                    size += n
                    lo += n
                    if size == FIT_BLOCK_ROWS:
                        yield block()
                        part, some, size = part + 1, [], 0
        if some:
            yield block()

    return ordered.mapInArrow(pack, "species_id string, grp string, part int, edges binary, bins binary, y binary, w binary")


def tree_models(packed: DataFrame, sets: DataFrame, estimators: tuple[Estimator, ...], effort: Effort, width: int) -> DataFrame:
    """Every tree estimator of every set, each fitted by itself from all blocks of its group."""
    spark = packed.sparkSession
    wanted = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in asdict(e).items()]) for e in estimators])
    tasks = 8 * spark.sparkContext.defaultParallelism
    # the blocks of a group travel once for each share of its fits: as many shares as keep the cores busy
    shares = max(1, -(-tasks // max(1, sets.select(*KEY).distinct().count())))
    costly = Window.partitionBy(*KEY).orderBy(F.desc("e.depth"), "e.name", "set_name")
    jobs = sets.withColumn("e", F.explode(wanted)).where(~F.col("e.tuned") | F.col("tuned")).withColumn(
        "_s", (F.row_number().over(costly) - 1) % shares).select(*KEY, "_s", "set_name", "features", "e.*")
    jobs = cut(jobs.drop("tuned"))
    place = [*KEY, "_s"]
    # places have numbers, so that each has a task of its own or tasks have equally many: fits are long and hashes collide
    places = small_side(jobs.select(*place).distinct().withColumn("_id", F.row_number().over(Window.orderBy("_s", *KEY)) - 1))
    blocks = packed.join(places, KEY)
    both = jobs.join(places, place).unionByName(blocks, allowMissingColumns=True)
    tasks = max(1, min(tasks, places.count()))
    ordered = both.repartitionById(tasks, F.col("_id") % tasks).sortWithinPartitions(*place, F.col("part").isNull(), "part", "set_name", "name")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        at, some, whole = None, [], None
        for batch in batches:
            for k in range(len(batch)):
                job = {c: batch.column(c)[k] for c in batch.schema.names}
                here = tuple(job[c].as_py() for c in place)
                if here != at:
                    at, some, whole = here, [], None
                if job["part"].is_valid:
                    edges, bins, y, w = (job[c].as_py() for c in ("edges", "bins", "y", "w"))
                    some.append((np.frombuffer(bins, dtype=np.uint8).reshape(width, -1), np.frombuffer(y), np.frombuffer(w)))
                    continue
                if some:
                    # column after column
                    whole, some = [np.concatenate(x, axis=-1) for x in zip(*some)], []
                if whole is None:
                    continue
                yield fitted({c: job[c].as_py() for c in (*KEY, "set_name", "features", *asdict(estimators[0])) if c != "tuned"}, edges, *whole)

    def fitted(job: dict, edges: bytes, columns: np.ndarray, y: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        features = np.asarray(job["features"], dtype=np.int64)
        bins = (columns if np.array_equal(features, np.arange(width)) else columns[features]).T
        if job["kind"] == "forest":
            trees, gains = forest(bins, y, w, trees=effort.trees, depth=job["depth"], leaf=job["leaf"], seed=job["seed"])
            base = 0.0
        else:
            trees, base, gains = booster(bins, y, w, rounds=effort.boosts, depth=job["depth"], leaf=job["leaf"], rate=job["rate"], l2=job["l2"])
        whole = gains.sum()
        arrays = {"edges": np.frombuffer(edges), **vars(trees)}
        return pd.DataFrame([{
            **{k: job[k] for k in (*KEY, "set_name", "name", "kind")}, "base": base,
            "importance": (gains / whole if whole else gains).tolist(),
            **{k: arrays[k].astype(_TYPES[k]).tobytes() for k in _PACKED}}])

    def as_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in fit(batches):
            yield pa.RecordBatch.from_pandas(found, schema=shape, preserve_index=False)

    kinds = {"base": pa.float64(), "importance": pa.list_(pa.float64()), **{k: pa.binary() for k in _PACKED}}
    shape = pa.schema([(k, kinds.get(k, pa.string())) for k in (*KEY, "set_name", "name", "kind", *kinds)])
    schema = "species_id string, grp string, set_name string, name string, kind string, base double, importance array<double>, " + ", ".join(f"{k} binary" for k in _PACKED)
    return ordered.mapInArrow(as_arrow, schema)


def fit_models(rows: DataFrame, sets: DataFrame, columns: list[str], estimators: tuple[Estimator, ...], row_id: str,
               effort: Effort = Effort(), fit_rows: int | None = None) -> DataFrame:
    """The model table (``MODEL_SCHEMA``) of every set and estimator.

    ``rows``: species_id, grp, ``row_id``, label and ``columns``, the training rows. ``sets``: see
    ``SET_COLUMNS``; ``features`` are places in ``columns``. Groups of one class get no model. All rows
    of a group are fitted; with ``fit_rows``, trees of a larger group take about so many of them.
    """
    prep = cut(preprocessing(rows, columns, row_id))
    trees = tuple(e for e in estimators if e.kind != "logistic")
    # logistic models take steps over all rows, trees read them twice
    ready = held(ready_rows(rows, prep, columns, row_id)) if len(trees) < len(estimators) else None
    sets = cut(sets.select(*SET_COLUMNS))
    # sets of the same columns are fitted once, under the first of their names
    once = sets.groupBy(*KEY, "features").agg(F.min("set_name").alias("set_name"), F.bool_or("tuned").alias("tuned"))
    named = small_side(sets.join(once.select(*KEY, "features", F.col("set_name").alias("_as")), [*KEY, "features"]))
    once = cut(once)
    parts = []
    for e in [e for e in estimators if e.kind == "logistic"]:
        found = logistic_models(ready, once, len(columns), effort.iterations)
        weights = F.transform("features", lambda i: F.abs(F.get("coefficients", i)))
        parts.append(once.drop("tuned").join(found, [*KEY, "set_name"]).select(
            *KEY, "set_name", F.lit(e.name).alias("name"), F.lit(e.kind).alias("kind"), "coefficients", weights.alias("importance")))
    if trees:
        if ready is None:
            if fit_rows is not None:
                sized = rows.select(*KEY, row_id, "label", *columns).join(small_side(prep.select(*KEY, "n")), KEY)
                rows = fitting_rows(sized, row_id, fit_rows).drop("n")
            packed = _packed_groups(ready_rows(rows, prep, columns, row_id), len(columns), row_id)
        else:
            packed = _packed_groups(ready, len(columns), row_id, fit_rows)
        parts.append(tree_models(packed, once, trees, effort, len(columns)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    schema = T.StructType.fromDDL(MODEL_SCHEMA)
    tuned = F.col("name").isin([e.name for e in estimators if e.tuned])
    whole = found.withColumnRenamed("set_name", "_as").join(named, [*KEY, "_as"]).where(~tuned | F.col("tuned")).join(small_side(prep.drop("n", "p")), KEY)
    return cut(whole.select(*[F.col(f.name) if f.name in whole.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))


def candidate_id() -> Column:
    return F.concat_ws("__", "prefix", "name")


def model_scores(model: dict, raw: np.ndarray) -> np.ndarray:
    """Probabilities of presence of rows of raw values (NaN where missing) under one model row."""
    standard = (np.where(np.isfinite(raw), raw, model["median"]) - np.asarray(model["mean"])) / np.asarray(model["scale"])
    standard = np.where(np.isfinite(standard), standard, 0.0)
    if model["kind"] == "logistic":
        # term after term: equal rows have equal scores whatever block they are in
        a = np.asarray(model["coefficients"])
        return _sigmoid(sum((standard[:, k] * a[k] for k in range(len(a) - 1)), np.zeros(len(standard))) + a[-1])
    features = np.asarray(model["features"], dtype=np.int64)
    bins = binned(standard[:, features], np.frombuffer(model["edges"], dtype=_TYPES["edges"]).reshape(-1, BINS - 1)[features])
    # the trees of a model serve all blocks it scores
    if "trees" not in model:
        model["trees"] = Trees(**{k: np.frombuffer(model[k], dtype=_TYPES[k]) for k in _PACKED[1:]})
    total = model["trees"].sums(bins)
    return total if model["kind"] == "forest" else _sigmoid(model["base"] + total)


def _blocks(rows: DataFrame, keys: list[str], keep: list[str], columns: list[str]) -> DataFrame:
    """Rows of one key, packed by the batch: the key columns and ``block``, an Arrow stream."""
    values = [F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in columns]
    narrow = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
                         *[v.alias(f"_f{i}") for i, v in enumerate(values)])

    def split(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        code, names = pd.MultiIndex.from_arrays([whole.column(f"_k{i}").to_pandas() for i in range(len(keys))]).factorize()
        rest = whole.select([c for c in whole.schema.names if not c.startswith("_k") or c.startswith("_keep")])
        found, blocks = [], []
        for k in range(len(names)):
            mine = np.flatnonzero(code == k)
            for first in range(0, len(mine), BLOCK_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_table(rest.take(pa.array(mine[first : first + BLOCK_ROWS])).combine_chunks())
                found.append(names[k])
                blocks.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([*[pa.array([n[i] for n in found], pa.string()) for i in range(len(keys))], pa.array(blocks, pa.binary())],
                                          names=[*keys, "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            if len(batch):
                some.append(batch)
                n += len(batch)
            if n >= PACK_ROWS:
                yield split(some)
                some, n = [], 0
        if some:
            yield split(some)

    present = narrow.where(reduce(Column.__and__, [F.col(f"_k{i}").isNotNull() for i in range(len(keys))]))
    return present.mapInArrow(pack, ", ".join([*[f"{k} string" for k in keys], "block binary"]))


def score_rows(rows: DataFrame, models: DataFrame, columns: list[str], keep: list[str], *, keys: list[str] | None = None,
               out: str = "raw_score", salts: tuple[int, int] = (1, SALTS)) -> DataFrame:
    """``keep``, candidate_id and ``out`` for each row under each model of its key, in one pass.

    ``keys`` (species_id, and grp where models of a group see only its rows) match rows and models.
    ``salts`` spread the blocks and the models of one key over tasks: a block travels once for each
    share of the models, a model once for each share of the blocks. With several models a key spread
    the models, with one the blocks. A task holds its share of the models of one key and one block.
    Few models that need not be spread are broadcast to the blocks.
    """
    keys = keys or ["species_id"]
    by_block, by_model = salts
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = _blocks(rows, keys, keep, columns)
    needed = ["kind", "features", "median", "mean", "scale", "coefficients", "base", *_PACKED]
    known = models.withColumn("candidate_id", candidate_id()).select(*keys, "candidate_id", *needed)
    fields = [T.StructField(c, rows.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, T.StructField("candidate_id", T.StringType()), T.StructField(out, T.DoubleType())])

    def scored(block: pa.RecordBatch, model: dict) -> pa.RecordBatch:
        raw = np.stack([block.column(f"_f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
        return pa.RecordBatch.from_arrays(
            [*[block.column(f"_keep{i}") for i in range(len(keep))], pa.array([model["candidate_id"]] * len(block), pa.string()), pa.array(model_scores(model, raw), pa.float64())],
            names=[*keep, "candidate_id", out])

    def unpacked(block: pa.BinaryScalar) -> pa.RecordBatch:
        with pa.ipc.open_stream(block.as_buffer()) as stream:
            return stream.read_next_batch()

    if by_model == 1:
        size = known.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in _PACKED), F.lit(0)))).first()[0] or 0
        if size <= BESIDE_BYTES:
            # few models: each block meets them where it is made, nothing is shuffled

            def score_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                recent: dict[tuple, dict] = {}
                for batch in batches:
                    names = list(zip(*[batch.column(c).to_pylist() for c in (*keys, "candidate_id")]))
                    for k, name in enumerate(names):
                        if name not in recent:
                            if len(recent) == RECENT_MODELS:
                                recent.clear()
                            recent[name] = {c: batch.column(c)[k].as_py() for c in ("candidate_id", *needed)}
                        yield scored(unpacked(batch.column("block")[k]), recent[name])

            return blocks.join(F.broadcast(known), keys).mapInArrow(score_beside, schema)
    blocks = blocks.withColumn("_b", F.pmod(F.xxhash64("block"), F.lit(by_block)).cast("int")).withColumn("_m", numbers(by_model))
    # large and small models are dealt evenly; a key has as many rows here as models
    share = Window.partitionBy(*keys).orderBy(F.desc("_size"), "candidate_id")
    sized = known.select(*keys, "candidate_id", F.coalesce(F.length("left"), F.lit(0)).alias("_size"))
    dealt = small_side(sized.select(*keys, "candidate_id", ((F.row_number().over(share) - 1) % by_model).cast("int").alias("_m")))
    known = known.join(dealt, [*keys, "candidate_id"]).withColumn("_b", numbers(by_block))
    place = [*keys, "_b", "_m"]
    both = known.select(*place, "candidate_id", *needed).unionByName(blocks, allowMissingColumns=True)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    ordered = both.repartition(tasks, *place).sortWithinPartitions(*place, F.col("block").isNotNull(), "candidate_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for batch in batches:
            here = list(zip(*[batch.column(c).to_pylist() for c in place]))
            for k in range(len(batch)):
                if here[k] != at:
                    at, mine = here[k], []
                if not batch.column("block")[k].is_valid:
                    mine.append({c: batch.column(c)[k].as_py() for c in ("candidate_id", *needed)})
                elif mine:
                    block = unpacked(batch.column("block")[k])
                    for model in mine:
                        yield scored(block, model)

    return ordered.mapInArrow(score, schema)


def importances(models: DataFrame, columns: list[str]) -> DataFrame:
    """species_id, candidate_id, feature, importance: gain shares of trees, sizes of coefficients."""
    names = F.array(*[F.lit(c) for c in columns])
    each = F.explode(F.arrays_zip(F.col("features").alias("at"), F.col("importance").alias("size")))
    return models.select("species_id", candidate_id().alias("candidate_id"), each.alias("e")).select(
        "species_id", "candidate_id", F.get(names, F.col("e.at")).alias("feature"), F.col("e.size").alias("importance"))


def permutation_importance(rows: DataFrame, models: DataFrame, columns: list[str], row_id: str, evaluate, *, split: str = "split",
                           part: str = "validation", seed: int = 42) -> DataFrame:
    """species_id, feature, importance: what the ROC-AUC of a species' model loses when one column
    is permuted among the rows of ``part``.

    Two hash orders of a species' rows give every row a donor; a row is scored once as it is and
    once per feature with that one value of its donor. ``models`` holds one model per species.
    """
    mine = rows.where((F.col(split) == part) & F.col("species_id").isNotNull()).select("species_id", row_id, "label", *columns)
    here = hash_ranks(mine, ["species_id"], hash_key(row_id, seed=seed), "_rank", "_size").drop("_size")
    there = hash_ranks(mine, ["species_id"], hash_key(row_id, seed=f"donor{seed}"), "_rank", "_size")
    donors = there.select("species_id", "_rank", *[F.col(c).alias(f"_d{i}") for i, c in enumerate(columns)])
    both = here.join(donors, ["species_id", "_rank"])
    # a row for each permuted column, the first of them unchanged; features outside the model change nothing
    variant = F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1)))
    varied = both.withColumn("_variant", variant).withColumns(
        {c: F.when(F.col("_variant") == i, F.col(f"_d{i}")).otherwise(F.col(c)) for i, c in enumerate(columns)})
    scored = held(score_rows(varied, models, columns, ["species_id", row_id, "label", "_variant"], salts=(SALTS, 1)))
    found = evaluate(scored, ["species_id", "candidate_id", "_variant"], "label", "raw_score", row_id)
    of_model = Window.partitionBy("species_id", "candidate_id")
    whole = F.max(F.when(F.col("_variant") == -1, F.col("roc_auc"))).over(of_model)
    used = importances(models, columns).select("species_id", "candidate_id", "feature")
    names = F.array(*[F.lit(c) for c in columns])
    lost = found.withColumn("importance", whole - F.col("roc_auc")).where("_variant >= 0").select(
        "species_id", "candidate_id", F.get(names, F.col("_variant")).alias("feature"), "importance")
    return lost.join(used, ["species_id", "candidate_id", "feature"], "left_semi")
