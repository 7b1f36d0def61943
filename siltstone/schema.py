"""Schemas and codes of entries, mutations, log records and manifests."""

from pyspark.sql import types as T

PUT, DELETE_KEY, DELETE_RANGE = 0, 1, 2  # kinds of entries
OP_PUT, OP_INSERT, OP_DELETE, OP_DELETE_RANGE = 0, 1, 2, 3  # mutations
BEGIN, COMMIT, ROLLBACK, ENTRY = 1, 2, 3, 4  # log records


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


ENTRY_SCHEMA = _struct(
    ("seq", T.LongType(), False), ("kind", T.ByteType(), False), ("key", T.BinaryType(), False),
    ("value", T.BinaryType(), True), ("range_end", T.BinaryType(), True),
)
MUTATION_SCHEMA = _struct(
    ("ord", T.LongType(), False), ("op", T.ByteType(), False), ("key", T.BinaryType(), False),
    ("value", T.BinaryType(), True), ("range_end", T.BinaryType(), True),
)
WAL_SCHEMA = _struct(
    ("lsn", T.LongType(), False), ("type", T.ByteType(), False), ("txn_id", T.LongType(), False),
    ("seq", T.LongType(), True), ("kind", T.ByteType(), True), ("key", T.BinaryType(), True),
    ("value", T.BinaryType(), True), ("range_end", T.BinaryType(), True),
)
ROW_SCHEMA = _struct(("key", T.BinaryType(), False), ("value", T.BinaryType(), True))
MANIFEST_SCHEMA = _struct(
    ("level", T.IntegerType(), False), ("path", T.StringType(), False), ("seq_tag", T.LongType(), False),
    ("min_key", T.BinaryType(), True), ("max_key", T.BinaryType(), True),
    ("n_points", T.LongType(), False), ("n_ranges", T.LongType(), False), ("bytes", T.LongType(), False),
)
