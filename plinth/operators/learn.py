"""Clusters, imputation and price models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same row is always on the same side, on any cluster and partitioning."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < int(test_share * 10_000)
    return df.where(~h), df.where(h)


def fit_cells(df: DataFrame, lat: str, lon: str, k: int = 60, seed: int = 42) -> KMeansModel:
    """Centres of ``k`` cells over positions."""
    points = VectorAssembler(inputCols=[lat, lon], outputCol="__p", handleInvalid="skip").transform(df.select(lat, lon))
    return KMeans(k=k, seed=seed, featuresCol="__p").fit(points)


def cell_features(df: DataFrame, model: KMeansModel, lat: str, lon: str) -> DataFrame:
    """``df`` with ``cell`` and ``cell_km``, the distance to its centre in km; positions that are NULL are in no cell.

    Centres are a literal array in the plan, so the nearest one is found in column expressions.
    """
    from plinth.operators.geo import haversine_km

    centres = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c[0])).alias("y"), F.lit(float(c[1])).alias("x")) for i, c in enumerate(model.clusterCenters())])
    best = F.array_min(F.transform(centres, lambda c: F.struct(haversine_km(F.col(lat), F.col(lon), c["y"], c["x"]).alias("km"), c["i"].alias("i"))))
    return df.withColumn("__b", F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), best)).withColumns({"cell": F.col("__b.i"), "cell_km": F.col("__b.km")}).drop("__b")


def cluster_median_fill(df: DataFrame, features: list[str], columns: list[str], k: int = 10, seed: int = 42) -> DataFrame:
    """``df`` with gaps in ``columns`` filled by the median of the row's cluster over ``features``, else of all rows, and ``<column>_filled`` flags."""
    import uuid

    from plinth.session import written

    tag = f"__{uuid.uuid4().hex[:6]}"
    stages = [Imputer(inputCols=features, outputCols=[f"{tag}{c}" for c in features], strategy="median"), VectorAssembler(inputCols=[f"{tag}{c}" for c in features], outputCol=f"{tag}v"), StandardScaler(inputCol=f"{tag}v", outputCol=f"{tag}s", withMean=True), KMeans(k=k, seed=seed, featuresCol=f"{tag}s", predictionCol=f"{tag}k")]
    x = df.withColumns({c: F.col(c).cast("double") for c in features})
    x = written(Pipeline(stages=stages).fit(x).transform(x).select(*df.columns, f"{tag}k"), "clustered")
    med = x.groupBy(f"{tag}k").agg(*[F.median(c).alias(f"{tag}m{c}") for c in columns])
    every = x.agg(*[F.median(c).alias(f"{tag}a{c}") for c in columns])
    x = x.join(F.broadcast(med), f"{tag}k", "left").crossJoin(F.broadcast(every))  # k rows, and one row
    x = x.withColumns({f"{c}_filled": F.col(c).isNull() for c in columns} | {c: F.coalesce(c, f"{tag}m{c}", f"{tag}a{c}") for c in columns})
    return x.select(*df.columns, *[f"{c}_filled" for c in columns])


def _neighbours(df: DataFrame, key: str, block: list[str], features: list[str], target: str, k: int, salts: int) -> DataFrame:
    """a, d, y: the ``k`` nearest known rows of the same block for each row without ``target``.

    Known and unknown rows of a block meet in ``salts`` parts, so that one hot block is spread over tasks; each part keeps its best ``k`` before the parts are joined.
    """
    from pyspark.sql import Window as W

    num = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in features]
    x = df.select(F.col(key).alias("k"), *block, F.array(*num).alias("f"), F.col(target).alias("y"))
    need = x.where("y is null").select(F.col("k").alias("a"), *block, F.col("f").alias("fa"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
    have = x.where("y is not null").select(F.col("k").alias("b"), *block, F.col("f").alias("fb"), "y", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int").alias("part"))
    d = F.sqrt(F.aggregate(F.arrays_zip("fa", "fb"), F.lit(0.0), lambda s, p: s + F.pow(p["fa"] - p["fb"], 2)))
    pair = need.join(have, [*block, "part"]).select("a", "part", d.alias("d"), "b", "y")
    best = lambda p, by: p.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("d", "b"))).where(F.col("r") <= k)
    return best(best(pair, ["a", "part"]), ["a"]).select("a", "d", "y")


def knn_fill(df: DataFrame, key: str, block: list[str], features: list[str], target: str, k: int = 7, salts: int = 8) -> DataFrame:
    """key, value: for rows without ``target``, the mean over the ``k`` nearest rows of their block that have it, by 1 / distance; an equal row decides alone.

    Exact within a block (columns that must agree): known and unknown rows meet by an equi-join on the block and only the best ``k`` of a row are kept.
    """
    near = _neighbours(df.withColumn(target, F.col(target).cast("double")), key, block, features, target, k, salts)
    zero = F.avg(F.when(F.col("d") == 0, F.col("y")))
    w = F.sum(F.when(F.col("d") > 0, F.col("y") / F.col("d"))) / F.sum(F.when(F.col("d") > 0, 1 / F.col("d")))
    return near.groupBy("a").agg(F.coalesce(zero, w).alias("value")).select(F.col("a").alias(key), "value")


def knn_vote(df: DataFrame, key: str, block: list[str], features: list[str], target: str, k: int = 7, salts: int = 8) -> DataFrame:
    """key, value: for rows without the category ``target``, the one with the largest sum of 1 / distance among the ``k`` nearest rows that have it; equal rows decide alone, ties go to the first by name."""
    near = _neighbours(df, key, block, features, target, k, salts)
    votes = near.groupBy("a", "y").agg(F.count_if(F.col("d") == 0).alias("same"), F.sum(F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0)).alias("w"))
    return votes.groupBy("a").agg(F.min_by("y", F.struct((-F.col("same")).alias("s"), (-F.col("w")).alias("w"), "y")).alias("value")).select(F.col("a").alias(key), "value")


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with NULL and blank categories replaced by the commonest one, ties by name. One small aggregate for each column."""
    out = {}
    for c in columns:
        v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        top = df.groupBy(v.alias("v")).agg(F.count("*").alias("n")).where("v is not null").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v"))).first()[0]
        out[c] = F.coalesce(v, F.lit(top))
    return df.withColumns(out)


def mixed_preprocessor(numeric: list[str], categorical: list[str], out: str = "features") -> Pipeline:
    """Median-filled and standardised numbers beside one-hot categories, of which unseen ones are left out; categories first go through ``most_frequent``."""
    imputed = [f"{c}__i" for c in numeric]
    stages = [Imputer(inputCols=numeric, outputCols=imputed, strategy="median"), VectorAssembler(inputCols=imputed, outputCol="__n", handleInvalid="keep"), StandardScaler(inputCol="__n", outputCol="__s", withMean=True)]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__x", outputCol=f"{c}__h", dropLast=True)]  # the last one stands for unseen
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["__s", *[f"{c}__h" for c in categorical]], outputCol=out, handleInvalid="keep")])


def price_pipeline(numeric: list[str], categorical: list[str], target: str, model: str = "forest", trees: int = 60, seed: int = 42) -> Pipeline:
    """Median-filled numbers, indexed and one-hot categories (unseen ones kept apart), and a forest or boosted trees on log1p of the target."""
    imputed = [f"{c}__i" for c in numeric]
    stages = [Imputer(inputCols=numeric, outputCols=imputed, strategy="median")]
    hot = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__x", outputCol=f"{c}__h", handleInvalid="keep", dropLast=False)]
        hot.append(f"{c}__h")
    stages.append(VectorAssembler(inputCols=imputed + hot, outputCol="features", handleInvalid="keep"))
    learner = RandomForestRegressor(numTrees=trees, seed=seed, maxDepth=10, featureSubsetStrategy="all") if model == "forest" else GBTRegressor(maxIter=trees, seed=seed, maxDepth=5)
    stages.append(learner.setLabelCol("label").setFeaturesCol("features").setPredictionCol("log_prediction"))
    return Pipeline(stages=stages)


def with_label(df: DataFrame, target: str, per: str | None = None) -> DataFrame:
    """``df`` with ``label``: log1p of the target, or of its ratio to ``per``; rows without a positive one are left out."""
    v = F.col(target).cast("double") if per is None else F.try_divide(F.col(target).cast("double"), F.col(per).cast("double"))
    return df.where((v > 0) & ~F.isnan(v)).withColumn("label", F.log1p(v))


def fit_price_model(df: DataFrame, numeric: list[str], categorical: list[str], target: str, per: str | None = None, **options) -> PipelineModel:
    cast = with_label(df, target, per).withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical})
    return price_pipeline(numeric, categorical, target, **options).fit(cast)


def scored(model: PipelineModel, df: DataFrame, numeric: list[str], categorical: list[str], per: str | None = None) -> DataFrame:
    """``df`` with ``prediction`` in the target's own unit, times ``per`` for a model of a ratio to it."""
    cast = df.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical})
    return model.transform(cast).withColumn("prediction", F.expm1("log_prediction") * (F.lit(1.0) if per is None else F.col(per).cast("double")))


def select_by_cv(df: DataFrame, numeric: list[str], categorical: list[str], target: str, folds: int = 5, seed: int = 42) -> tuple[PipelineModel, list[float]]:
    """The best forest of a small grid by cross-validated R2, and the grid's scores."""
    pipe = price_pipeline(numeric, categorical, target, seed=seed, trees=30)
    grid = ParamGridBuilder().addGrid(pipe.getStages()[-1].maxDepth, [5, 10]).build()
    cast = with_label(df, target).withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical})
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="label", predictionCol="log_prediction", metricName="r2"), numFolds=folds, seed=seed)
    fit = cv.fit(cast)
    return fit.bestModel, fit.avgMetrics


def importances(model: PipelineModel) -> list[tuple[int, float]]:
    """(feature index, importance) of the last stage, largest first."""
    v = model.stages[-1].featureImportances
    return sorted(((int(i), float(x)) for i, x in zip(v.indices, v.values, strict=True)), key=lambda t: -t[1])


#: What each kind of model is trained on: its plausible rows (``filters.LIMITS``), its target, and what the target is a ratio to.
SEGMENTS = {
    "sale": {"limits": "sale", "target": "price_per_sqft", "per": "circle_rate"}, "apartment rent": {"limits": "apartment rent", "target": "rent", "per": None},
    "floor rent": {"limits": "floor rent", "target": "rent", "per": None}, "plot": {"limits": "plot", "target": "price_per_sqft", "per": None},
}


def train_segment(df: DataFrame, segment: str, numeric: list[str], categorical: list[str], key: str, columns: dict[str, str], **options) -> tuple[PipelineModel, DataFrame]:
    """A segment's model and its errors on held-out rows: plausible rows, a split by key, the segment's own target. ``columns`` maps the names in ``filters.LIMITS`` and the target to columns."""
    from plinth.operators import filters, stats

    s = SEGMENTS[segment]
    limits = {k: v for k, v in filters.LIMITS[s["limits"]].items() if columns.get(k, k) in df.columns}
    target = columns.get(s["target"], s["target"])
    rows = df.where(filters.within(limits, columns))
    if s["per"]:
        rows = rows.where(filters.plausible_ratio(F.col(target), F.col(s["per"])))
    train, test = hash_split(rows, key)
    model = fit_price_model(train, numeric, categorical, target, s["per"], **options)
    return model, stats.model_errors(scored(model, test, numeric, categorical, s["per"]), target, "prediction")


def random_search(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], target: str, area: str, draws: int = 8, seed: int = 42) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """The forest of ``draws`` random settings with the least mean error of the total price (rate times ``area``), and every setting's error, the plain one first; it wins ties."""
    rng = np.random.default_rng(seed)
    settings: list[dict] = [{}] + [{"maxDepth": int(rng.integers(4, 13)), "numTrees": int(rng.integers(10, 61)), "minInstancesPerNode": int(rng.integers(1, 9)), "subsamplingRate": float(rng.uniform(0.6, 1.0))} for _ in range(draws)]
    label = lambda df: with_label(df, target).withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical})
    best, tried = None, []
    for s in settings:
        pipe = price_pipeline(numeric, categorical, target, trees=20, seed=seed)
        pipe.getStages()[-1].setParams(**s)
        model = pipe.fit(label(train))
        gap = F.abs(F.col("prediction") - F.col(target)) * F.col(area)
        error = float(scored(model, test, numeric, categorical).agg(F.avg(gap)).first()[0])
        if best is None or error < min(e for _, e in tried):
            best = model
        tried.append((s, error))
    return best, tried


def learning_curve(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], target: str, key: str, shares: tuple[float, ...] = (0.25, 0.5, 1.0), trees: int = 20) -> list[tuple[float, float]]:
    """(share, mean absolute error) of models fitted on growing shares of the training rows, by a hash of the key."""
    from plinth.operators import stats

    out = []
    for s in shares:
        part = train.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(10_000)) < int(s * 10_000))
        model = fit_price_model(part, numeric, categorical, target, trees=trees)
        out.append((s, float(stats.model_errors(scored(model, test, numeric, categorical), target, "prediction").first()["mae"])))
    return out


class IsolationTrees:
    """Random-split trees; points that few splits set apart are outliers. Fitted on a bounded sample, applied to every row."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], rng, 0, int(np.ceil(np.log2(max(2, self.size))))) for _ in range(trees)] if len(sample) else []

    def _grow(self, x: np.ndarray, rng: np.random.Generator, depth: int, most: int):
        if depth >= most or len(x) <= 1 or (spread := x.max(0) - x.min(0)).max() <= 0:
            return len(x)
        j = int(rng.choice(np.flatnonzero(spread > 0)))
        at = rng.uniform(x[:, j].min(), x[:, j].max())
        low = x[:, j] < at
        return j, at, self._grow(x[low], rng, depth + 1, most), self._grow(x[~low], rng, depth + 1, most)

    @staticmethod
    def _rest(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _path(self, node, x: np.ndarray, depth: int, out: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out[rows] += depth + self._rest(node)
            return
        j, at, a, b = node
        low = x[rows, j] < at
        self._path(a, x, depth + 1, out, rows[low])
        self._path(b, x, depth + 1, out, rows[~low])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            self._path(t, x, 0, total, np.arange(len(x)))
        return np.power(2.0, -total / max(1, len(self.trees)) / max(1e-9, self._rest(self.size)))


def isolation_scores(df: DataFrame, key: str, features: list[str], *, sample: int = 20_000, trees: int = 100, seed: int = 42) -> DataFrame:
    """key, score: outlier score of every row, 0 to 1. The trees are fitted on at most ``sample`` rows, chosen by hash; NULL and NaN features count as 0."""
    x = df.select(F.col(key).alias("key"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in features])
    total = x.count()
    share = min(1.0, sample / max(1, total))
    got = x.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("key").limit(sample).toPandas()
    model = IsolationTrees(got[features].to_numpy(dtype=float), trees=trees, seed=seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "score": model.score(b[features].to_numpy(dtype=float))})

    return x.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def feature_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` in this order as doubles; missing columns, NULL, NaN and infinities are 0."""
    ok: list[Column] = []
    for c in columns:
        v = F.col(c).try_cast("double") if c in df.columns else F.lit(0.0)
        ok.append(F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(0.0)).alias(c))
    return df.select(*ok)
