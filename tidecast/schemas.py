"""Schemas of the stored tables and their keys."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STRING, INT, LONG, DOUBLE, DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType()

TIME_SERIES = _schema(series_id=STRING, sample_type=STRING, time_index=INT, tourism=DOUBLE)
MODEL_STORAGE = _schema(
    target=STRING, model_id=INT, family=STRING, coef=T.ArrayType(DOUBLE), fill=T.ArrayType(DOUBLE)
)
PREDICTORS = _schema(target=STRING, model_id=INT, predictor_index=INT, predictor=STRING)
RECORD_IDS = _schema(target=STRING, model_id=INT, purpose=STRING, observation_id=INT)
# One row per series, model id and observation: bit h - 1 is set where the model of horizon h used the row.
RECORD_MASKS = _schema(series_id=STRING, model_id=INT, observation_id=INT, train=INT, validation=INT)
FIT_PERFORMANCE = _schema(
    target=STRING, model_id=INT, purpose=STRING, loss_function=STRING, performance=DOUBLE
)
FINGERPRINTS = _schema(
    target=STRING, model_id=INT, purpose=STRING, rows=LONG, hash_a=LONG, hash_b=LONG
)
MODELS = _schema(target=STRING, model_id=INT, create_date=DATE)

REGISTRY = {
    "model_storage": MODEL_STORAGE,
    "predictors": PREDICTORS,
    "record_masks": RECORD_MASKS,
    "fit_performance": FIT_PERFORMANCE,
    "fingerprints": FINGERPRINTS,
    "models": MODELS,
}

KEYS = {
    "time_series": ["series_id", "sample_type", "time_index"],
    "model_storage": ["target", "model_id"],
    "predictors": ["target", "model_id", "predictor_index", "predictor"],
    "record_ids": ["target", "model_id", "observation_id"],
    "fit_performance": ["target", "model_id", "purpose", "loss_function"],
    "fingerprints": ["target", "model_id", "purpose"],
    "models": ["target", "model_id", "create_date"],
}
