"""Table schemas. Nothing in the library infers a schema."""

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
_STRINGS = T.ArrayType(T.StringType())

# Fields of one change: null means "not provided".
PATCH_FIELDS = (
    T.StructField("name", _S),
    T.StructField("domain", _S),
    T.StructField("description", _S),
    T.StructField("status", _S),
    T.StructField("tags", _STRINGS),
    T.StructField("context", _S),
    T.StructField("files_involved", _STRINGS),
)
PATCH_NAMES = tuple(f.name for f in PATCH_FIELDS)

PATCH = T.StructType([T.StructField("id", _S), *PATCH_FIELDS])

#: One change document, as found in a JSON file.
UPDATE_DOC = T.StructType([
    T.StructField("project_id", _S),
    T.StructField("batch_seq", _L),
    T.StructField("batch_ts", _L),
    T.StructField("features", T.ArrayType(PATCH)),
    T.StructField("remove_features", _STRINGS),
])

UPSERT, REMOVE = 0, 1

#: Documents flattened to one row per change.
UPDATE_LOG = T.StructType([
    T.StructField("project_id", _S),
    T.StructField("batch_seq", _L),
    T.StructField("batch_ts", _L),
    T.StructField("op_rank", T.IntegerType()),
    T.StructField("pos", _L),
    T.StructField("id", _S),
    *PATCH_FIELDS,
])

#: Fields of a stored item, in output order.
FEATURE_BODY = T.StructType([
    T.StructField("id", _S),
    T.StructField("name", _S),
    T.StructField("domain", _S),
    T.StructField("tags", _STRINGS),
    T.StructField("status", _S),
    T.StructField("description", _S),
    T.StructField("context", _S),
    T.StructField("files_involved", _STRINGS),
    T.StructField("created_at", _L),
    T.StructField("last_updated", _L),
    T.StructField("recency_score", T.DoubleType()),
])

#: The registry: items of all projects. (ord_batch, ord_pos) is the creation order within a project.
FEATURE = T.StructType([
    T.StructField("project_id", _S),
    *FEATURE_BODY.fields,
    T.StructField("ord_batch", _L),
    T.StructField("ord_pos", _L),
])

PROJECT = T.StructType([
    T.StructField("project_id", _S),
    T.StructField("project_name", _S),
    T.StructField("created_at", _L),
    T.StructField("last_updated", _L),
])

SEARCH_QUERY = T.StructType([
    T.StructField("query_id", _L),
    T.StructField("keyword", _S),
    T.StructField("domain", _S),
    T.StructField("tag", _S),
    T.StructField("status", _S),
])

FILE_LISTING = T.StructType([T.StructField("project_id", _S), T.StructField("path", _S)])

KEY = ("project_id", "id")
STORED_ORDER = ("ord_batch", "ord_pos")
