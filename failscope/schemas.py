"""Table schemas. Sources always read with one of these, never inferred."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
        "bool": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
        "strings": T.ArrayType(T.StringType()),
        "weights": T.MapType(T.StringType(), T.DoubleType()),
        "settings": T.MapType(T.StringType(), T.StringType()),
        "matrix": T.ArrayType(T.ArrayType(T.LongType())),
    }
    fields = [item.split(":") for item in spec.split()]
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields])


REQUEST = _struct(
    "pipeline_name:string task_name:string runtime:int retry_count:int rows_processed:int "
    "schema_change:bool upstream_failed:bool error_log:string timestamp:timestamp")

EVENT = T.StructType(
    REQUEST.fields[:-1] + [T.StructField("root_cause", T.StringType()), REQUEST.fields[-1]])

REQUIRED_COLUMNS = REQUEST.names

POD_LINE = _struct(
    "LineId:int Time:string Content:string EventId:string EventTemplate:string "
    "ParameterList:string")

SCENARIO = _struct("date_key:string root_cause:string faulty_pod_pattern:string")

FAILURE = T.StructType(
    [T.StructField("id", T.StringType())] + REQUEST.fields[:-1]
    + _struct("event_timestamp:timestamp created_at:timestamp").fields)

PREDICTION = _struct(
    "id:string failure_id:string pipeline_name:string predicted_root_cause:string "
    "confidence:double evidence:strings model_version:string created_at:timestamp")

DEPENDENCY = _struct(
    "id:string upstream_pipeline:string downstream_pipeline:string dependency_type:string "
    "is_active:bool created_at:timestamp")

EDGE = _struct("upstream:string downstream:string dependency_type:string")

TASK_RUN = _struct(
    "dag_id:string run_id:string task_id:string try_number:int start_date:timestamp "
    "end_date:timestamp state:string exception:string")

METRICS = _struct(
    "accuracy:double macro_f1:double weighted_f1:double avg_confidence:double "
    "per_class_confidence:weights per_class_f1:weights")

METADATA = T.StructType(
    _struct(
        "model_version:string model_filename:string created_at:string training_samples:long "
        "n_features:int n_classes:int class_names:strings feature_names:strings "
        "hyperparameters:settings").fields
    + [T.StructField("metrics", METRICS)]
    + _struct("confusion_matrix:matrix").fields)
