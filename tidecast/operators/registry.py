"""Registry of models, their predictors, training rows and losses, as Parquet tables.

A fit run adds to every table once, for all targets together, and is published as a whole. Runs may overlap:
the one that is published later takes its model ids after the other's.
"""

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import add

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast import schemas
from tidecast.config import LOSS, MAX_HORIZON, N_LAGS, PREDICTORS
from tidecast.functions.expressions import horizons, is_finite, target_horizon, target_id, target_series
from tidecast.operators.features import future_limit, lagged_rows
from tidecast.operators.selection import in_sample
from tidecast.operators.sequence import with_lags
from tidecast.operators.split import purpose
from tidecast.sources.tables import shuffled

PUBLISH_ATTEMPTS = 20
PURPOSES = ["train", "validation"]


def next_model_ids(targets: DataFrame, model_storage: DataFrame) -> DataFrame:
    """One more than the last model id of each target, 1 for a target without models."""
    last = model_storage.groupBy("target").agg(F.max("model_id").alias("last"))
    return targets.join(shuffled(last), "target", "left").select(
        "target", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("model_id")
    )


def with_model_ids(fitted: DataFrame, model_storage: DataFrame) -> DataFrame:
    return fitted.join(shuffled(next_model_ids(fitted.select("target"), model_storage)), "target")


def model_rows(models: DataFrame) -> DataFrame:
    return models.select("target", "model_id", "family", "coef", "fill")


def predictor_rows(models: DataFrame, predictors: Sequence[str] = tuple(PREDICTORS)) -> DataFrame:
    names = F.array(*map(F.lit, predictors))
    return models.select(
        "target", "model_id", F.posexplode(names).alias("predictor_index", "predictor")
    )


def record_masks(
    ts: DataFrame, models: DataFrame, holdout: str = "fixed", max_rows: int | None = None
) -> DataFrame:
    """The rows each model was trained and held out on, all horizons of an observation in one row.

    A series' models are joined to its rows before anything is multiplied out. If its targets have
    different model ids, an observation has one row for each id.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.col("horizon") - 1)
    per_id = models.groupBy("series_id", "model_id").agg(F.bit_or(bit).alias("fitted"))
    per_series = per_id.groupBy("series_id").agg(F.collect_list(F.struct("model_id", "fitted")).alias("models"))
    usable = reduce(
        add,
        [F.when(F.get("lags", F.lit(h + N_LAGS - 1)).isNotNull(), 1 << (h - 1)).otherwise(0) for h in range(1, MAX_HORIZON + 1)],
    )
    rows = lagged_rows(ts, max_rows).where(
        (F.col("future_record_count") > future_limit(holdout)) & is_finite(F.col("tourism"))
    )
    rows = rows.select(
        "series_id",
        F.col("time_index").alias("observation_id"),
        usable.alias("usable"),
        purpose(F.col("series_id"), F.col("time_index")).alias("purpose"),
    )
    masks = rows.join(shuffled(per_series), "series_id").select("*", F.inline("models"))
    used = F.col("usable").bitwiseAND(F.col("fitted"))
    return masks.where(used != 0).select(
        "series_id",
        "model_id",
        "observation_id",
        *[F.when(F.col("purpose") == name, used).otherwise(0).alias(name) for name in ("train", "validation")],
    )


def has_bit(mask: Column, horizon: Column) -> Column:
    return F.call_function("shiftright", mask, horizon - 1).bitwiseAND(F.lit(1)) == 1


def recorded_rows(ts: DataFrame, masks: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows that stored models were fitted on, each once per model id, with all their lags and the masks.

    The masks meet the narrow rows of the series, one for one, before lags are built and before any horizon
    is written out.
    """
    used = F.struct("model_id", "train", "validation")
    used = masks.groupBy("series_id", F.col("observation_id").alias("time_index")).agg(F.collect_list(used).alias("used"))
    rows = in_sample(ts).select("series_id", "time_index", "tourism")
    rows = rows.join(shuffled(used), ["series_id", "time_index"], "left")
    lagged = with_lags(rows, range(1, N_LAGS + MAX_HORIZON + 1), max_rows=max_rows)
    return lagged.where(F.col("used").isNotNull()).select("series_id", "time_index", "tourism", "lags", F.inline("used"))


def per_horizon_of(rows: DataFrame) -> DataFrame:
    """Rows with a `mask`, once for each horizon whose bit is set."""
    written = rows.select("*", F.explode(horizons(F.col("series_id"))).alias("horizon"))
    return written.where(has_bit(F.col("mask"), F.col("horizon")))


def fingerprints(ts: DataFrame, masks: DataFrame, max_rows: int | None = None) -> DataFrame:
    """128 bits over the set of rows each model used, with their values and lags: target, model_id, purpose,
    rows, hash_a, hash_b.

    Hashes of rows are combined by exclusive or, so their order does not matter, and each task combines its
    own first.
    """
    parts = F.array(*[F.struct(F.lit(kind).alias("purpose"), F.col(kind).alias("mask")) for kind in PURPOSES])
    rows = recorded_rows(ts, masks, max_rows).select("series_id", "model_id", "time_index", "tourism", "lags", F.inline(parts))
    rows = per_horizon_of(rows)
    content = ["time_index", "tourism", F.slice("lags", F.col("horizon") + 1, N_LAGS)]
    return (
        rows.groupBy("series_id", "horizon", "model_id", "purpose")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.bit_xor(F.xxhash64(F.lit(i), *content)).alias(name) for i, name in ((1, "hash_a"), (2, "hash_b"))],
        )
        .select(
            target_id(F.col("series_id"), F.col("horizon")).alias("target"), "model_id", "purpose", "rows", "hash_a", "hash_b"
        )
    )


def record_ids(masks: DataFrame) -> DataFrame:
    """The masks written out: one row per target, model and observation."""
    purposes = F.array(*[F.struct(F.lit(name).alias("purpose"), F.col(name).alias("mask")) for name in PURPOSES])
    return (
        per_horizon_of(masks.select("series_id", "model_id", "observation_id", F.inline(purposes)))
        .select(target_id(F.col("series_id"), F.col("horizon")).alias("target"), "model_id", "purpose", "observation_id")
    )


def loss_rows(models: DataFrame) -> DataFrame:
    """Losses as scores, where higher is better: the negative mean absolute error."""
    losses = F.array(
        F.struct(F.lit("train").alias("purpose"), (-F.col("train_mae")).alias("performance")),
        F.struct(F.lit("validation").alias("purpose"), (-F.col("validation_mae")).alias("performance")),
    )
    return (
        models.select("target", "model_id", F.inline(losses))
        .where(F.col("performance").isNotNull())
        .select("target", "model_id", "purpose", F.lit(LOSS).alias("loss_function"), "performance")
    )


def meta_rows(models: DataFrame, create_date: str | None = None) -> DataFrame:
    """The given date, or today's in the session's time zone."""
    date = F.current_date() if create_date is None else F.lit(create_date).cast("date")
    return models.select("target", "model_id", date.alias("create_date"))


def latest_models(model_storage: DataFrame) -> DataFrame:
    """The newest model of each target."""
    return model_storage.groupBy("target").agg(F.max_by(F.struct("*"), "model_id").alias("model")).select("model.*")


def best_models(model_storage: DataFrame, fit_performance: DataFrame, loss_function: str = LOSS) -> DataFrame:
    """The model of each target with the highest validation score; the newer one on a tie."""
    scores = losses(fit_performance, "validation", loss_function)
    order = F.struct("performance", "model_id")
    return (
        model_storage.join(shuffled(scores), ["target", "model_id"])
        .groupBy("target")
        .agg(F.max_by(F.struct(*model_storage.columns), order).alias("model"))
        .select("model.*")
    )


def losses(fit_performance: DataFrame, purpose: str, loss_function: str = LOSS) -> DataFrame:
    return fit_performance.where(
        (F.lower("purpose") == purpose.lower()) & (F.lower("loss_function") == loss_function.lower())
    ).select("target", "model_id", "performance")


def predictor_names(predictors: DataFrame) -> DataFrame:
    """Each model's predictor names in order."""
    ordered = F.sort_array(F.collect_list(F.struct("predictor_index", F.trim("predictor").alias("predictor"))))
    return predictors.groupBy("target", "model_id").agg(ordered.getField("predictor").alias("predictors"))


def scoring_models(model_storage: DataFrame) -> DataFrame:
    """Stored models with the series and horizon their target id names."""
    return model_storage.withColumns(
        {"series_id": target_series(F.col("target")), "horizon": target_horizon(F.col("target"))}
    )


class Conflict(RuntimeError):
    """Another run was published since this one began."""


class Run:
    """Rows to be added to a registry together. They are seen by nobody before `publish`."""

    def __init__(self, registry: "Registry"):
        self.registry = registry
        self.runs = registry.published()
        self.name = uuid.uuid4().hex
        self.folder = f"{registry.folder}/runs/{self.name}"

    def read(self, name: str) -> DataFrame:
        """A table as it was when the run began."""
        return self.registry.read(name, self.runs)

    def add(self, name: str, rows: DataFrame) -> None:
        columns = [F.col(f.name).cast(f.dataType) for f in schemas.REGISTRY[name]]
        rows.select(*columns).write.parquet(f"{self.folder}/{name}")

    def publish(self) -> None:
        """Make the run the next one of the registry, or raise Conflict if another has that place.

        The manifest is written aside and renamed to its number, which fails where the number is taken. A
        run cut short before has no manifest and is never read.
        """
        if not self.registry.place(len(self.runs), self.name):
            raise Conflict(f"run {len(self.runs)} of {self.registry.folder} is taken")


class Registry:
    """Tables under one folder, which executors must be able to reach.

    Each run adds to the tables in a folder of its own. The log names the runs in order; tables are read
    from the runs that the log names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create(self) -> "Registry":
        self._files().mkdirs(self._path("log"))
        return self

    def published(self) -> list[str]:
        """Names of the published runs, in order."""
        names = [status.getPath().getName() for status in self._files().listStatus(self._path("log"))]
        if not any(name[0].isdigit() for name in names):
            return []
        rows = self.spark.read.text(f"{self.folder}/log/[0-9]*").collect()
        manifests = sorted((int(number), run) for number, run in (r.value.split(" ") for r in rows))
        return [run for _, run in manifests]

    def place(self, number: int, run: str) -> bool:
        """Publish a run under a number; False if the number is taken."""
        jvm = self.spark.sparkContext._jvm
        aside, final = self._path(f"log/_{run}"), self._path(f"log/{number:010d}")
        out = self._files().create(aside)
        try:
            out.write(bytearray(f"{number} {run}\n".encode()))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._files().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        try:
            files.rename(aside, final, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            self._files().delete(aside, False)
            return False
        return True

    def begin(self) -> Run:
        return Run(self)

    def read(self, name: str, runs: Sequence[str] | None = None) -> DataFrame:
        """A table over the given or all published runs; `record_ids` is its record masks written out."""
        if name == "record_ids":
            return record_ids(self.read("record_masks", runs))
        paths = [f"{self.folder}/runs/{run}/{name}" for run in (self.published() if runs is None else runs)]
        files = self._files()
        paths = [p for p in paths if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]
        if not paths:
            return self.spark.createDataFrame([], schemas.REGISTRY[name])
        return self.spark.read.schema(schemas.REGISTRY[name]).parquet(*paths)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to one table as a run of their own."""
        self._published(lambda run: run.add(name, rows))

    def _published(self, write):
        """Write a run and publish it, again from the newest state as long as another one comes first."""
        for _ in range(PUBLISH_ATTEMPTS):
            run = self.begin()
            result = write(run)
            try:
                run.publish()
                return result
            except Conflict:
                continue
        raise Conflict(f"no run of {PUBLISH_ATTEMPTS} came first in {self.folder}")

    def add_models(
        self,
        fitted: DataFrame,
        ts: DataFrame,
        predictors: Sequence[str] = tuple(PREDICTORS),
        holdout: str = "fixed",
        max_rows: int | None = None,
        create_date: str | None = None,
    ) -> DataFrame:
        """Give freshly fitted models their ids and store everything about them, all or nothing.

        `fitted` is read several times, so it should be a stored table. Ids follow the models published when
        the run begins. If another run is published meanwhile, the ids are taken anew and the rows written
        again; the fit is not repeated.
        """
        return self._published(lambda run: write_models(run, fitted, ts, predictors, holdout, max_rows, create_date))


def write_models(
    run: Run,
    fitted: DataFrame,
    ts: DataFrame,
    predictors: Sequence[str] = tuple(PREDICTORS),
    holdout: str = "fixed",
    max_rows: int | None = None,
    create_date: str | None = None,
) -> DataFrame:
    """Write fitted models, with the ids that follow the run's view of the registry, and all about them."""
    spark, path = run.registry.spark, f"{run.folder}/fitted"
    models = with_model_ids(fitted, run.read("model_storage"))
    models.write.parquet(path)
    models = spark.read.schema(models.schema).parquet(path)
    run.add("predictors", predictor_rows(models, predictors))
    run.add("record_masks", record_masks(ts, models, holdout, max_rows))
    masks = run.registry.read("record_masks", [run.name])
    run.add("fingerprints", fingerprints(ts, masks, max_rows))
    run.add("fit_performance", loss_rows(models))
    run.add("models", meta_rows(models, create_date))
    run.add("model_storage", model_rows(models))
    return models
