"""Named queries over the driver's tables, and the SQL that must agree with them.

Keys come out as hex strings, so that results don't depend on how binary is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import compaction, reads, telemetry, visibility, writes
from ..schema import DELETE_RANGE, OP_INSERT, PUT
from ..sources import wal
from .logs import batch, batch_sql, hexed, i64, log, log_sql, raw_log, scratch_dir, table, u64, utf8, visible_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LO, HI = 20, 60  # user ids that bound the range queries
AS_OF = 5000
BASE = 1_000_000  # sequence numbers of batches start above the log's


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def live(df: DataFrame) -> DataFrame:
    return hexed(df.select("key", "seq", "value"))


def scanned(sql_filter: str = "true", tail: str = "") -> str:
    return f"with {log_sql()}, {visible_sql()} select k, seq, v from visible where {sql_filter} {tail}"


# --- scans and lookups


@query(scanned())
def kv_scan_full(spark: SparkSession, sf: str) -> DataFrame:
    return live(visibility.visible_entries(log(spark, sf)).orderBy("key"))


def bounded(spark: SparkSession, sf: str, start: int | None, end: int | None) -> DataFrame:
    a, b = (None if x is None else K.encode(x) for x in (start, end))
    return live(visibility.visible_entries(log(spark, sf), a, b).orderBy("key"))


@query(scanned(f"k >= {i64(str(LO))} and k < {i64(str(HI))}"))
def kv_scan_range(spark, sf):
    return bounded(spark, sf, LO, HI)


@query(scanned(f"k >= {i64(str(LO))}"))
def kv_scan_start_only(spark, sf):
    return bounded(spark, sf, LO, None)


@query(scanned(f"k < {i64(str(HI))}"))
def kv_scan_end_only(spark, sf):
    return bounded(spark, sf, None, HI)


@query(scanned(tail="order by k limit 25"))
def kv_scan_limit(spark, sf):
    return live(visibility.visible_entries(log(spark, sf)).orderBy("key").limit(25))


@query(scanned(f"k = {i64('5')}"))
def kv_get(spark, sf):
    key = K.encode(5)
    return live(visibility.visible_entries(log(spark, sf), key, key + b"\x00"))


ASKED = f"asked as (select distinct {i64('c_custkey')} as k from customer)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(K.i64_key("c_custkey").alias("key"))


@query(f"with {log_sql()}, {visible_sql()}, {ASKED} select k, k in (select k from visible) as found from asked")
def kv_exists(spark, sf):
    return hexed(reads.multi_get(log(spark, sf), asked(spark, sf)).select("key", "found"))


@query(f"with {log_sql()}, {visible_sql()}, {ASKED} select a.k, v.k is not null as found, v.v from asked a left join visible v on a.k = v.k")
def kv_multi_get(spark, sf):
    return hexed(reads.multi_get(log(spark, sf), asked(spark, sf)))


CUSTOMERS = f"customers as (select {utf8('c_mktsegment')} || '00' || {i64('c_custkey')} as k, c_acctbal as v from customer)"


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = K.tuple_key(K.string_key("c_mktsegment"), K.i64_key("c_custkey"))
    return c.select(F.col("c_custkey").alias("seq"), F.lit(PUT).cast("byte").alias("kind"), key.alias("key"), F.col("c_acctbal").alias("value"), F.lit(None).cast("binary").alias("range_end"))


@query(f"with {CUSTOMERS} select k, v from customers where k >= {utf8(chr(39) + 'BUILDING' + chr(39))} || '00' and k < {utf8(chr(39) + 'BUILDING' + chr(39))} || '01'")
def kv_prefix_scan(spark, sf):
    return hexed(reads.prefix_scan(customers(spark, sf), "BUILDING"))


@query(f"with {CUSTOMERS} select k, v from customers where k >= {utf8(chr(39) + 'B' + chr(39))} || '00' and k < {utf8(chr(39) + 'B' + chr(39))} || 'ff'")
def kv_prefix_bracket(spark, sf):
    return hexed(reads.prefix_scan(customers(spark, sf), "B", strict=False))


@query(f"with {log_sql()}, past as (select * from log where seq <= {AS_OF}), {visible_sql('past')} select k, seq, v from visible")
def kv_as_of_scan(spark, sf):
    return live(visibility.visible_entries(log(spark, sf), as_of_seq=AS_OF))


# --- latest versions and range deletes; many ranges, so that masks matter

WIDE = log_sql(17, 10)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf, 17, 10)


@query(f"with {log_sql()} select k, seq, kind, v from log where kind <> 2 qualify row_number() over (partition by k order by seq desc) = 1")
def kv_latest_point(spark, sf):
    return hexed(visibility.latest_points(visibility.points(log(spark, sf))).select("key", "seq", "kind", "value"))


@query(f"with {log_sql()} select k, max(seq) as max_seq, max(seq) filter (kind = 1) as delete_seq from log where kind <> 2 group by k")
def kv_delete_max_seq(spark, sf):
    return hexed(visibility.delete_max_seq(log(spark, sf)))


@query(f"with {WIDE}, {visible_sql()} select k, seq, v from visible")
def kv_range_mask(spark, sf):
    return live(visibility.visible_entries(wide(spark, sf)))


@query(ORACLE["kv_range_mask"])
def kv_range_mask_fragments(spark, sf):
    return live(visibility.visible_entries(wide(spark, sf), few=0, buckets=7))


@query(f"with {WIDE} select p.k, (select max(seq) from log r where r.kind = 2 and r.k <= p.k and p.k < r.range_end) as cover_seq from (select distinct k from log where kind <> 2) p")
def kv_covering_seq(spark, sf):
    w = wide(spark, sf)
    return hexed(visibility.covering_seq(visibility.points(w).select("key").distinct(), visibility.ranges(w)))


RANGES = f"with {WIDE} select k as start, range_end as \"end\", seq as rseq from log where kind = 2"


@query(RANGES)
def kv_range_list(spark, sf):
    return hexed(visibility.ranges(wide(spark, sf)).orderBy("start", F.desc("rseq")))


@query(f"{RANGES} and k < {i64(str(HI))} and range_end > {i64(str(LO))}")
def kv_range_overlap(spark, sf):
    return hexed(visibility.overlapping(visibility.ranges(wide(spark, sf)), K.encode(LO), K.encode(HI)))


@query(f"with {WIDE} select greatest(k, {i64(str(LO))}) as start, range_end as \"end\", seq as rseq from log where kind = 2 and k < {i64(str(HI))} and range_end > {i64(str(LO))}")
def kv_range_clamp(spark, sf):
    return hexed(visibility.clamped(visibility.overlapping(visibility.ranges(wide(spark, sf)), K.encode(LO), K.encode(HI)), K.encode(LO)))


@query(f"with {WIDE} select kind, k, seq, range_end from log where kind <> 0")
def kv_tombstones(spark, sf):
    return hexed(wide(spark, sf).filter("kind <> 0").select("kind", "key", "seq", "range_end"))


TIED = f"""tied as (select event_id // 4 as seq, {i64('user_id % 10')} as k,
  case when event_type = 'error' and event_id % 17 = 0 then 2 when event_type = 'error' then 1 else 0 end as kind,
  case when event_type = 'error' and event_id % 17 = 0 then {i64('user_id % 10 + 2')} end as range_end,
  case when event_type <> 'error' then value end as v from events)"""


def tied(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    is_range = (F.col("event_type") == "error") & (F.col("event_id") % 17 == 0)
    kind = F.when(is_range, 2).when(F.col("event_type") == "error", 1).otherwise(0)
    return e.select(
        F.floor(F.col("event_id") / 4).alias("seq"), kind.cast("byte").alias("kind"), K.i64_key(F.col("user_id") % 10).alias("key"),
        F.when(kind == 0, F.col("value")).alias("value"), F.when(is_range, K.i64_key(F.col("user_id") % 10 + 2)).alias("range_end"),
    )


@query(f"with {TIED} select k, seq, kind, v from tied where kind <> 2 qualify row_number() over (partition by k order by seq desc, kind desc, v desc) = 1")
def kv_tie_delete_wins(spark, sf):
    return hexed(visibility.latest_points(visibility.points(tied(spark, sf))).select("key", "seq", "kind", "value"))


@query(f"with {TIED}, {visible_sql('tied')} select k, seq, v from visible")
def kv_tie_put_beats_range(spark, sf):
    return live(visibility.visible_entries(tied(spark, sf)))


# --- writes

STATE = f"""{log_sql()}, {visible_sql()}, {batch_sql()},
steps as (select *, lag(op) over (partition by k order by ord) as last_op, lag(ord) over (partition by k order by ord) as last_ord,
    (select max(ord) from batch r where r.op = 3 and r.k <= b.k and b.k < r.range_end and r.ord < b.ord) as wipe
  from (select * from batch where op <> 3) b),
before as (select *, case when coalesce(wipe > coalesce(last_ord, -1), false) then false when last_op is not null then last_op <> 2
    else k in (select k from visible) end as live_before from steps)"""


def live_keys(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.visible(log(spark, sf)).select("key")


@query(f"with {STATE} select ord, k from before where op = 1 and live_before")
def kv_insert_conflicts(spark, sf):
    return hexed(writes.insert_conflicts(batch(spark, sf), live_keys(spark, sf)))


@query(f"with {log_sql()}, {visible_sql()}, {batch_sql()} select ord, k, v from batch where op = 1 and k not in (select k from visible) qualify row_number() over (partition by k order by ord) = 1")
def kv_insert_if_absent(spark, sf):
    inserts = batch(spark, sf).filter(F.col("op") == OP_INSERT).select("ord", "key", "value")
    return hexed(writes.insert_if_absent(inserts, live_keys(spark, sf)))


@query(f"with {batch_sql()} select ord, op, k, {BASE} + row_number() over (order by ord) as seq from batch")
def kv_batch_assign_seq(spark, sf):
    return hexed(writes.assign_seq(batch(spark, sf), BASE, block=1000).select("ord", "op", "key", "seq"))


@query(f"with {STATE.replace('k in (select k from visible)', 'false')} select ord, k from before where op = 1 and live_before")
def kv_batch_duplicate_inserts(spark, sf):
    none = live_keys(spark, sf).filter(F.lit(False))
    return hexed(writes.insert_conflicts(batch(spark, sf), none))


@query(f"with {STATE} select ord, k, live_before as existed from before where op = 2")
def kv_delete_existed(spark, sf):
    return hexed(writes.delete_existed(batch(spark, sf), live_keys(spark, sf)))


STAGED = f"""staged as (select {AS_OF} + row_number() over (order by ord) as seq, case op when 0 then 0 when 1 then 0 when 2 then 1 else 2 end as kind, k, v, range_end from batch),
both_ as (select seq, kind, k, v, range_end from log where seq <= {AS_OF} union all select * from staged)"""


@query(f"with {log_sql()}, {batch_sql()}, {STAGED}, {visible_sql('both_')} select k, seq, v from visible")
def kv_txn_overlay(spark, sf):
    own = batch(spark, sf).withColumn("value", F.col("value").cast("string").cast("binary"))
    base = log(spark, sf).withColumn("value", F.col("value").cast("string").cast("binary"))
    out = visibility.visible_entries(writes.overlay(base, own, AS_OF))
    return hexed(out.select("key", "seq", F.col("value").cast("string").cast("double").alias("value")))


# --- the commit log


def records(spark: SparkSession, sf: str) -> DataFrame:
    return wal.to_wal(raw_log(spark, sf), rolled_back=F.col("txn_id") % 7 == 0)


@query(scanned())
def kv_txn_rollback(spark, sf):
    return live(visibility.visible_entries(wal.committed(records(spark, sf))))


@query(f"with {log_sql()} select seq, kind, k, range_end, v from log")
def kv_wal_replay(spark, sf):
    return hexed(wal.committed(records(spark, sf)))


@query(f"with {log_sql()} select txn_id, count(*) as entries from rawlog where txn_id % 7 = 0 group by txn_id")
def kv_wal_uncommitted(spark, sf):
    return wal.uncommitted(records(spark, sf))


@query(f"""with {log_sql()} select 4 as type, count(*) as records from rawlog union all select 1, count(distinct txn_id) from rawlog
union all select 2, count(distinct txn_id) from rawlog where txn_id % 7 <> 0 union all select 3, count(distinct txn_id) from rawlog where txn_id % 7 = 0""")
def kv_wal_record_counts(spark, sf):
    return wal.record_counts(records(spark, sf))


@query(f"with {log_sql()} select seq * 4 as lsn, seq, k from rawlog order by lsn desc limit 100")
def kv_wal_bounded_tail(spark, sf):
    return hexed(wal.bounded_tail(records(spark, sf).filter("type = 4"), 100).select("lsn", "seq", "key"))


# --- runs, levels, compaction


def as_binary(df: DataFrame) -> DataFrame:
    """Values as bytes that read back alike everywhere: thousandths, as text."""
    return df.withColumn("value", F.floor(F.col("value") * 1000).cast("string").cast("binary"))


VB = "floor(v * 1000)::bigint::varchar"


@query(f"with {log_sql()} select seq, kind, k, range_end, {VB} as v from log where seq > {AS_OF}")
def kv_flush_run(spark, sf):
    from ..sources.runs import ParquetRuns

    runs = ParquetRuns(spark, scratch_dir(spark))
    run = runs.write(as_binary(log(spark, sf).filter(F.col("seq") > AS_OF)), 0)
    out = runs.read([run] if run else [])
    return hexed(out.withColumn("value", F.col("value").cast("string")))


COMPACTED = f"""with {WIDE}, {visible_sql()}, newest as (select * from log where kind <> 2 qualify row_number() over (partition by k order by seq desc, kind desc) = 1)
select kind, k, seq, range_end, v from newest where kind = 1 or k in (select k from visible) union all select kind, k, seq, range_end, v from log where kind = 2"""


@query(COMPACTED)
def kv_compact(spark, sf):
    return hexed(compaction.compact(wide(spark, sf)).select("kind", "key", "seq", "range_end", "value"))


@query(f"with {WIDE}, {visible_sql()} select 0 as kind, k, seq, v from visible")
def kv_compact_bottom(spark, sf):
    return hexed(compaction.compact(wide(spark, sf), bottom=True).select("kind", "key", "seq", "value"))


@query(ORACLE["kv_range_mask"])
def kv_compact_then_scan(spark, sf):
    w = wide(spark, sf)
    old, new = w.filter(F.col("file_id") % 3 != 0), w.filter(F.col("file_id") % 3 == 0)
    return live(visibility.visible_entries(compaction.merge_runs(compaction.compact(old), new)))


@query(f"with {WIDE} select file_id % 3 as level, kind, count(*) as entries, count(distinct k) as keys from log group by all")
def kv_level_merge(spark, sf):
    w = wide(spark, sf)
    merged = compaction.merge_runs(*(w.filter(F.col("file_id") % 3 == i).withColumn("level", F.lit(i)) for i in range(3)))
    return merged.groupBy("level", "kind").agg(F.count("*").alias("entries"), F.countDistinct("key").alias("keys"))


FILES = """files as (select (file_id % 3)::int as level, 'run-' || file_id as path, max(seq) as seq_tag, min(k) as min_key, max(k) as max_key,
  count(*) filter (kind <> 2) as n_points, count(*) filter (kind = 2) as n_ranges from log group by file_id)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    is_range = F.col("kind") == DELETE_RANGE
    return wide(spark, sf).groupBy("file_id").agg(
        F.max("seq").alias("seq_tag"), K.to_hex(F.min("key")).alias("min_key"), K.to_hex(F.max("key")).alias("max_key"),
        F.count(F.when(~is_range, 1)).alias("n_points"), F.count(F.when(is_range, 1)).alias("n_ranges"),
    ).select((F.col("file_id") % 3).cast("int").alias("level"), F.concat(F.lit("run-"), F.col("file_id").cast("string")).alias("path"), "seq_tag", "min_key", "max_key", "n_points", "n_ranges")


@query(f"with {WIDE}, {FILES} select level, count(*) as files from files where level < 2 group by level having count(*) >= 4")
def kv_level_fanin(spark, sf):
    return compaction.fan_in(manifest(spark, sf), 4, 3)


@query(f"""with {WIDE}, {FILES} select * from files where level <> 0 union all
select 1, 'run-merged', max(seq_tag), min(min_key), max(max_key), sum(n_points), sum(n_ranges) from files where level = 0""")
def kv_manifest_install(spark, sf):
    m = manifest(spark, sf)
    inputs = m.filter("level = 0")
    output = inputs.agg(F.max("seq_tag").alias("seq_tag"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n_points").alias("n_points"), F.sum("n_ranges").alias("n_ranges"))
    return compaction.install(m, inputs, output.withColumns({"level": F.lit(1), "path": F.lit("run-merged")}))


@query(f"select {i64('user_id')} as k, arg_max(value, event_id) as v from events where value is not null group by user_id")
def kv_dedup_on_seal(spark, sf):
    e = table(spark, sf, "events").filter("value is not null")
    return hexed(compaction.dedup_on_seal(e.select(K.i64_key("user_id").alias("key"), "value", F.col("event_id").alias("ord"))))


INDEX = f"idx as (select {i64('p_partkey * 10')} as k, p_partkey as \"offset\" from part where p_partkey % 128 = 0)"


def index(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "part").select(K.i64_key(F.col("p_partkey") * 10).alias("key"), F.col("p_partkey").alias("offset"))
    return reads.sample_index(keyed, 128)


@query(f"with {INDEX} select * from idx")
def kv_index_sample(spark, sf):
    return hexed(index(spark, sf))


@query(f"""with {INDEX}, probes as (select o_orderkey, {i64('o_custkey * 7')} as k from orders)
select o_orderkey, p.k, coalesce(i."offset", 0) as floor_offset from probes p asof left join idx i on p.k >= i.k""")
def kv_index_floor(spark, sf):
    probes = table(spark, sf, "orders").select("o_orderkey", K.i64_key(F.col("o_custkey") * 7).alias("key"))
    return hexed(reads.floor_lookup(index(spark, sf), probes))


@query(f"with {log_sql()} select kind, count(*) as entries, count(*) * 8 as key_bytes, coalesce(sum(length({VB})), 0)::bigint as value_bytes, min(seq) as first_seq, max(seq) as last_seq from log group by kind")
def kv_telemetry(spark, sf):
    return telemetry.by_kind(as_binary(log(spark, sf)))


@query(f"with {WIDE} select kind, k, seq from log where kind <> 2 or (seq >= {AS_OF} and not k < {i64('10')})")
def kv_prune_ranges(spark, sf):
    pruned = compaction.prune_ranges(wide(spark, sf), AS_OF, F.col("key") < F.lit(K.encode(10)))
    return hexed(pruned.select("kind", "key", "seq"))


@query(f"with {WIDE}, {FILES} select * from files where level = 1")
def kv_take_level(spark, sf):
    return compaction.take_level(manifest(spark, sf), 1)[0]


@query(f"with {WIDE}, {FILES} select level, sum((n_points + n_ranges) * 17)::bigint as bytes from files group by level")
def kv_input_bytes(spark, sf):
    return compaction.input_bytes(manifest(spark, sf).withColumn("bytes", (F.col("n_points") + F.col("n_ranges")) * 17))


@query(f"with {log_sql()}, {visible_sql()} select k, seq, v from visible where seq % 3 <> 0 or seq > {AS_OF}")
def kv_ttl_scan(spark, sf):
    rows = visibility.visible_entries(log(spark, sf)).withColumn("expires_at", F.when(F.col("seq") % 3 == 0, F.col("seq")))
    return live(compaction.unexpired(rows, AS_OF))


# --- the key codec


@query(f"select n_nationkey, '{{\"k\":\"' || {utf8('n_name')} || '\"}}' as json from nation")
def kv_key_json(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.to_json(F.struct(K.to_hex(K.string_key("n_name")).alias("k"))).alias("json"))


@query(f"select o_orderkey, {i64('o_orderkey - 30000')} as k from orders")
def kv_key_i64(spark, sf):
    return hexed(table(spark, sf, "orders").select("o_orderkey", K.i64_key(F.col("o_orderkey") - 30000).alias("key")))


@query(f"select o_orderkey, {u64('o_orderkey')} as k from orders")
def kv_key_u64(spark, sf):
    return hexed(table(spark, sf, "orders").select("o_orderkey", K.u64_key("o_orderkey").alias("key")))


@query("select p_partkey, lower(lpad(hex(p_size::bigint), 2, '0')) as k from part")
def kv_key_u8(spark, sf):
    return hexed(table(spark, sf, "part").select("p_partkey", K.u8_key("p_size").alias("key")))


@query(f"select p_partkey, {utf8('p_name')} as k from part")
def kv_key_string(spark, sf):
    return hexed(table(spark, sf, "part").select("p_partkey", K.string_key("p_name").alias("key")))


@query("select c_custkey, case when c_acctbal > 0 then '01' else '00' end as k from customer")
def kv_key_bool(spark, sf):
    return hexed(table(spark, sf, "customer").select("c_custkey", K.bool_key(F.col("c_acctbal") > 0).alias("key")))


@query(f"select event_id, {i64('epoch_us(ts) * 1000')} as k from events")
def kv_key_timestamp(spark, sf):
    return hexed(table(spark, sf, "events").select("event_id", K.timestamp_key("ts").alias("key")))


@query(f"select o_orderkey, {i64('(epoch_us(o_orderdate) - epoch_us(timestamp ' + chr(39) + '1995-01-01' + chr(39) + ')) * 10')} as k from orders")
def kv_key_interval(spark, sf):
    gone = F.col("o_orderdate") - F.to_timestamp(F.lit("1995-01-01 00:00:00"))
    return hexed(table(spark, sf, "orders").select("o_orderkey", K.interval_key(gone).alias("key")))


@query("select c_custkey, lower(substr(md5(c_name), 1, 32)) as k from customer")
def kv_key_uuid(spark, sf):
    d = F.md5(F.col("c_name").cast("binary"))
    text = F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))
    return hexed(table(spark, sf, "customer").select("c_custkey", K.uuid_key(text).alias("key")))


@query(f"select c_custkey, {utf8('c_mktsegment')} || '00' || {i64('c_nationkey')} || '00' || {utf8('c_name')} as k from customer")
def kv_key_tuple(spark, sf):
    return hexed(table(spark, sf, "customer").select("c_custkey", K.tuple_key(K.string_key("c_mktsegment"), K.i64_key("c_nationkey"), K.string_key("c_name")).alias("key")))


@query(f"select n_nationkey, {utf8('n_name')} || '00' as first_key, {utf8('n_name')} || 'ff' as last_key from nation")
def kv_key_first_last(spark, sf):
    n = table(spark, sf, "nation")
    key = K.string_key("n_name")
    return n.select("n_nationkey", K.to_hex(K.first_key(key)).alias("first_key"), K.to_hex(K.last_key(key)).alias("last_key"))


@query(f"select p_partkey, {utf8('p_brand')} as k, true as same from part")
def kv_key_hex_roundtrip(spark, sf):
    key = K.string_key("p_brand")
    text = K.to_hex(key)
    return table(spark, sf, "part").select("p_partkey", text.alias("k"), (K.from_hex(text) == key).alias("same"))


@query(f"select event_id, case when value > 50 then '00' else {utf8('event_type')} end || '00' || {i64('user_id')} as k from events")
def kv_key_null(spark, sf):
    part = F.when(~F.coalesce(F.col("value") > 50, F.lit(False)), K.string_key("event_type"))
    return hexed(table(spark, sf, "events").select("event_id", K.tuple_key(part, K.i64_key("user_id")).alias("key")))


@query("select c_custkey, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as place from customer")
def kv_key_order(spark, sf):
    by_key = Window.partitionBy("c_nationkey").orderBy(K.tuple_key(K.double_key("c_acctbal"), K.i64_key("c_custkey")))
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(by_key).alias("place"))


@query("select c_custkey, rank() over (partition by c_nationkey order by c_acctbal::float) as place from customer")
def kv_key_float_order(spark, sf):
    by_key = Window.partitionBy("c_nationkey").orderBy(K.float_key("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", F.rank().over(by_key).alias("place"))


def double_sql(x: str) -> str:
    """The key of a finite double: sign, exponent and mantissa by arithmetic, then the bits that order like the value."""
    return float_sql(x, "double", 52, 1023, 16)


def float_sql(x: str, kind: str, mantissa: int, bias: int, digits: int) -> str:
    a = f"abs(({x})::{kind}::double)"
    low = f"(floor(log2({a})) - 1)::int"
    e = f"({low} + case when {a} >= pow(2.0, {low} + 2) then 2 when {a} >= pow(2.0, {low} + 1) then 1 else 0 end)"
    bits = f"(case when {a} = 0 then 0 else ({e} + {bias})::hugeint * {1 << mantissa} + (({a} / pow(2.0, {e}) - 1) * {1 << mantissa}.0)::hugeint end)"
    top = f"{1 << (63 if digits == 16 else 31)}::hugeint"
    ordered = f"(case when ({x})::{kind} < 0 then {top} - 1 - {bits} else {bits} + {top} end)"
    return f"lower(lpad(to_base(({ordered} // 4294967296)::bigint, 16), {max(0, digits - 8)}, '0') || lpad(to_base(({ordered} % 4294967296)::bigint, 16), 8, '0'))" if digits == 16 else f"lower(lpad(to_base(({ordered})::bigint, 16), 8, '0'))"


@query(f"select c_custkey, {double_sql('c_acctbal')} as k from customer")
def kv_key_double(spark, sf):
    return hexed(table(spark, sf, "customer").select("c_custkey", K.double_key("c_acctbal").alias("key")))


@query(f"select c_custkey, {float_sql('c_acctbal', 'float', 23, 127, 8)} as k from customer")
def kv_key_float(spark, sf):
    return hexed(table(spark, sf, "customer").select("c_custkey", K.float_key("c_acctbal").alias("key")))


FNV = """list_reduce(list_concat([2166136261::bigint], list_transform(range(strlen(n_name)), lambda i: ('0x' || substr(hex(encode(n_name)), (2 * i + 1)::int, 2))::bigint)),
  lambda h, b: ((xor(h, b)::hugeint * 16777619) % 4294967296)::bigint)"""


@query(f"select n_nationkey, {FNV} as hash from nation")
def kv_key_fnv1a(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", K.fnv1a(K.string_key("n_name")).alias("hash"))


# --- the store end to end


STORED = f"with {log_sql()}, {visible_sql()} select k, {VB} as v from visible"


def stored(spark: SparkSession, sf: str, path: str):
    """A store holding the log as two applied batches, flushed and compacted."""
    from ..store import Store

    store = Store.open(spark, path, memtable_threshold=1, fan_in=2)
    entries = as_binary(log(spark, sf))
    for part in (F.col("seq") <= AS_OF, F.col("seq") > AS_OF):
        op = F.when(F.col("kind") == PUT, 0).otherwise(F.col("kind") + 1).cast("byte")
        store.apply(entries.filter(part).select(F.col("seq").alias("ord"), op.alias("op"), "key", "value", "range_end"), inserts=False)
    return store


def text_rows(df: DataFrame) -> DataFrame:
    return hexed(df.withColumn("value", F.col("value").cast("string")))


@query(STORED)
def kv_store_reopen(spark, sf):
    from ..store import Store

    path = scratch_dir(spark)
    stored(spark, sf, path).close()
    return text_rows(Store.open(spark, path, read_only=True).scan())


@query(STORED)
def kv_backup_restore(spark, sf):
    from ..store import Store

    path = scratch_dir(spark)
    stored(spark, sf, path).backup(f"{path}-backup")
    return text_rows(Store.restore(spark, f"{path}-backup", f"{path}-restored").scan())


@query(STORED)
def kv_stream_tail(spark, sf):
    from ..streaming import tail

    path = scratch_dir(spark)
    records(spark, sf).withColumn("value", F.floor(F.col("value") * 1000).cast("string").cast("binary")).repartitionByRange(6, "lsn").write.parquet(f"{path}/log")
    tail.tail(tail.read_wal(spark, f"{path}/log", files_a_batch=2), f"{path}/entries", f"{path}/checkpoint").awaitTermination()
    return text_rows(visibility.visible(tail.tailed(spark, f"{path}/entries")))


@query(STORED)
def kv_wal_torn_tail(spark, sf):
    """The log in segments, with a torn one at its end."""
    from ..sources import wal
    from ..sources.files import Files

    path, entries = scratch_dir(spark), as_binary(log(spark, sf))
    writer = wal.SegmentWriter(spark, path)
    for i, part in enumerate((F.col("seq") <= AS_OF, F.col("seq") > AS_OF)):
        writer.append(entries.filter(part).select("seq", "kind", "key", "value", "range_end"), i)
    Files(spark).write_new(f"{path}/segment=999999999999/part-0.parquet", "\xff")
    return text_rows(visibility.visible(wal.committed(wal.read_segments(spark, path))))


@query(STORED)
def kv_open_skips(spark, sf):
    """A store with a run whose files are gone, opened without it."""
    from ..sources.files import Files
    from ..store import Store

    path = scratch_dir(spark)
    with stored(spark, sf, path) as store:
        store.options.auto_compact = False
        before = {r.path for r in store.manifest.runs}
        store.put(b"\x00lost", b"1")
        store.flush()
        for r in store.manifest.runs:
            if r.path not in before:
                Files(spark).delete(r.path)
    return text_rows(Store.open(spark, path, read_only=True, skip_unreadable=True).scan())
