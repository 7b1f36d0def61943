"""The mutation log that the catalog's queries run on, derived from `events`; and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import i64_key, to_hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str, modulus: int = 97, width: int = 3) -> DataFrame:
    """Every fifth kind of event deletes; some deletes are range deletes. Nothing is left out."""
    e = table(spark, sf_dir, "events")
    is_range = (F.col("event_type") == "error") & (F.col("event_id") % modulus == 0)
    kind = F.when(is_range, 2).when(F.col("event_type") == "error", 1).otherwise(0)
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        kind.cast("byte").alias("kind"),
        i64_key("user_id").alias("key"),
        F.when(kind == 0, F.col("value")).alias("value"),
        F.when(is_range, i64_key(F.col("user_id") + width)).alias("range_end"),
        F.floor(F.col("event_id") / 4).alias("txn_id"),
        F.floor(F.col("event_id") / 250).alias("file_id"),
    )


def log(spark: SparkSession, sf_dir: str, modulus: int = 97, width: int = 3) -> DataFrame:
    """The log's committed part: every seventh transaction was rolled back."""
    return raw_log(spark, sf_dir, modulus, width).filter(F.col("txn_id") % 7 != 0)


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of mutations: every event puts, inserts, deletes or (a few) deletes a range."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 77 == 0, 3).otherwise(F.col("event_id") % 3)
    return e.select(
        F.col("event_id").alias("ord"), op.cast("byte").alias("op"), i64_key(F.col("user_id") + 50).alias("key"),
        F.when(op < 2, F.col("value")).alias("value"), F.when(op == 3, i64_key(F.col("user_id") + 52)).alias("range_end"),
    )


def hexed(df: DataFrame) -> DataFrame:
    """key, range_end, start and end as hex, value as v."""
    out = df
    for c, name in (("key", "k"), ("range_end", "range_end"), ("start", "start"), ("end", "end")):
        if c in df.columns:
            out = out.withColumn(c, to_hex(c)).withColumnRenamed(c, name)
    return out.withColumnRenamed("value", "v") if "value" in df.columns else out


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siltstone-")
    return f"{root.rstrip('/')}/kv-{uuid.uuid4().hex[:12]}"


def i64(x: str) -> str:
    return f"lower(lpad(hex(xor(({x})::bigint, (-9223372036854775808)::bigint)), 16, '0'))"


def u64(x: str) -> str:
    return f"lower(lpad(hex(({x})::bigint), 16, '0'))"


def utf8(x: str) -> str:
    return f"lower(hex(encode({x})))"


def log_sql(modulus: int = 97, width: int = 3) -> str:
    """CTEs rawlog and log."""
    is_range = f"event_type = 'error' and event_id % {modulus} = 0"
    return f"""rawlog as (
  select event_id + 1 as seq, event_id // 4 as txn_id, event_id // 250 as file_id,
    case when {is_range} then 2 when event_type = 'error' then 1 else 0 end as kind,
    {i64('user_id')} as k, case when {is_range} then {i64(f'user_id + {width}')} end as range_end,
    case when event_type <> 'error' then value end as v
  from events),
log as (select * from rawlog where txn_id % 7 <> 0)"""


def batch_sql() -> str:
    return f"""batch as (
  select *, case when op < 2 then value end as v, case when op = 3 then {i64('user_id + 52')} end as range_end from (
    select event_id as ord, user_id, value, case when event_id % 77 = 0 then 3 else event_id % 3 end as op, {i64('user_id + 50')} as k
    from events))"""


def visible_sql(source: str = "log", name: str = "visible") -> str:
    """A CTE with the live (k, seq, v) of a log CTE."""
    return f"""{name} as (
  select k, seq, v from (select * from {source} where kind <> 2
    qualify row_number() over (partition by k order by seq desc, kind desc, v desc) = 1) w
  where kind = 0 and not exists (select 1 from {source} r where r.kind = 2 and r.k <= w.k and w.k < r.range_end and r.seq > w.seq))"""
