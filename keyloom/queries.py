"""Queries over the driver's tables that exercise every operator, and the SQL that gives the same rows.

Arguments are cents (whole numbers), so that sums don't depend on order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.partition import jump, shard_column, slice_shard
from .operators import dense, feed, layout, pull, push, scan
from .operators.spec import MergeSpec, TableSpec, last_wins, sum_count
from .operators.udf import UserOperator
from .plans import files
from .plans.dense_table import DenseTable
from .plans.model import Model
from .plans.ship import ship
from .plans.table import StateTable, list_tables
from .sources import io
from .streaming.push_stream import SyncFeed, push_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SHARDS, NODES, REPLICAS = 8, 3, 2
KEYS, VALUES, MERGE = ["user_id"], ["sum", "count"], sum_count()
SPEC = TableSpec({"user_id": "bigint"}, {"sum": "bigint", "count": "bigint"}, SHARDS)
DEFAULTS = {"sum": "cast(0 as bigint)", "count": "cast(0 as bigint)"}

#: Shared pieces of the oracles.
C = "cast(round(value * 100) as bigint)"
STATE = f"select user_id, sum({C})::bigint as sum, count(*)::bigint as count from events group by user_id"
EVEN = STATE.replace("from events", "from events where event_id % 2 = 0")
REQUEST = "select c_custkey as pos, c_custkey as user_id from customer union all select -o_orderkey, o_custkey from orders"
#: Jump consistent hash of a column k into n buckets, as a recursive query over table src(k, n).
JUMP = """j as (
  select k, n, k::hugeint as s, -1::bigint as b, 0::bigint as p from src
  union all
  select k, n, (s * 2862933555777941757 + 1) % 18446744073709551616, p,
         floor((p + 1) * (2147483648.0::double / (((s * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::double))::bigint
  from j where p < n
), bucket as (select k, n, max(b)::int as shard from j group by k, n)"""


def query(sql: str | None = None):
    def put(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return run

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("arg"))


def _state(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return push.combine(events, keys, MERGE)


def _even_odd(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, d)
    return _state(e.where("event_id % 2 = 0")), e.where("event_id % 2 = 1")


def _request(spark: SparkSession, d: str) -> DataFrame:
    """Keys with duplicates and misses: each customer's number once, and again for each of its orders; a tenth of them are users."""
    once = _t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("user_id"))
    return once.unionByName(_t(spark, d, "orders").select((-F.col("o_orderkey")).alias("pos"), F.col("o_custkey").alias("user_id")))


def _table(spark: SparkSession, tag: str, spec: TableSpec = SPEC, merge: MergeSpec | None = MERGE) -> StateTable:
    return StateTable.create(spark, files.scratch(spark, tag), spec, merge)


# Push


@query(STATE)
def push_combine(spark, d):
    return _state(_events(spark, d))


@query(STATE)
def push_async_upsert(spark, d):
    base, odd = _even_odd(spark, d)
    return push.upsert(base, push.combine(odd, KEYS, MERGE), KEYS, VALUES, MERGE)


@query(f"""with a as ({EVEN.replace("event_id % 2 = 0", "event_id % 2 = 0 and user_id % 3 = 0")}), b as ({EVEN.replace("% 2 = 0", "% 2 = 1")})
select coalesce(a.user_id, b.user_id) as user_id, (coalesce(a.sum, 0) + coalesce(b.sum, 0))::bigint as sum, (coalesce(a.count, 0) + coalesce(b.count, 0))::bigint as count
from a full join b on a.user_id = b.user_id where a.user_id is not null or b.sum > 100000""")
def push_init_refused(spark, d):
    base, odd = _even_odd(spark, d)
    rule = MergeSpec(MERGE.combine, store=MERGE.store, accept="push.sum > 100000")
    return push.upsert(base.where("user_id % 3 = 0"), push.combine(odd, KEYS, rule), KEYS, VALUES, rule)


@query(EVEN)
def push_sync_not_visible(spark, d):
    e = _events(spark, d)
    t = _table(spark, "sync").push(e.where("event_id % 2 = 0")).push(e.where("event_id % 2 = 1"), mode="sync")
    return t.df().drop("shard_id")


@query(STATE)
def push_sync_store(spark, d):
    e = _events(spark, d)
    t = _table(spark, "store").push(e.where("event_id % 4 = 0"))
    for i in (1, 2, 3):
        t = t.push(e.where(f"event_id % 4 = {i}"), mode="sync")
    return t.store().df().drop("shard_id")


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def push_direct_last_wins(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "event_id")
    base = push.combine(e.where("event_id % 2 = 0"), KEYS, last_wins(["event_type"], "event_id")).drop("__seq")
    return push.overwrite(base, e, KEYS, ["event_type"], "event_id")


@query(f"select user_id, min({C}) as low, max({C}) as high from events group by user_id")
def push_min_max_merge(spark, d):
    rule = MergeSpec(
        {"low": "min(arg)", "high": "max(arg)"}, {"low": "min(low)", "high": "max(high)"}, store={"low": "least(base.low, push.low)", "high": "greatest(base.high, push.high)"}
    )
    e = _events(spark, d)
    base = push.combine(e.where("event_id % 2 = 0"), KEYS, rule)
    return push.upsert(base, push.combine(e.where("event_id % 2 = 1"), KEYS, rule), KEYS, ["low", "high"], rule)


@query(f"select user_id, sum(c)::bigint as sum, count(*)::bigint as count from (select user_id, {C} as c from events union all select o_custkey % 150, o_orderkey from orders) group by user_id")
def push_multi_package(spark, d):
    orders = _t(spark, d, "orders").select((F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderkey").alias("arg"))
    return _state(push.packages(_events(spark, d).select("user_id", "arg"), orders))


@query(f"select user_id, event_type, sum({C})::bigint as sum, count(*)::bigint as count from events group by user_id, event_type")
def push_composite_key(spark, d):
    e, keys = _events(spark, d), ["user_id", "event_type"]
    return push.upsert(_state(e.where("event_id < 5000"), keys), _state(e.where("event_id >= 5000"), keys), keys, VALUES, MERGE)


@query(f"select event_type, sum({C})::bigint as sum, count(*)::bigint as count from events group by event_type")
def push_string_key(spark, d):
    e, keys = _events(spark, d), ["event_type"]
    return push.upsert(_state(e.where("event_id < 100"), keys), _state(e.where("event_id >= 100"), keys), keys, VALUES, MERGE)


@query("select o_custkey, sum(o_orderkey)::bigint as sum, count(*)::bigint as count from orders group by o_custkey")
def push_orders_upsert(spark, d):
    o, keys = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("arg")), ["o_custkey"]
    return push.upsert(_state(o.where("arg % 3 = 0"), keys), _state(o.where("arg % 3 <> 0"), keys), keys, VALUES, MERGE)


@query("select l_partkey, sum(cast(l_quantity as bigint))::bigint as sum, count(*)::bigint as count from lineitem group by l_partkey")
def push_bulk_lineitem(spark, d):
    x, keys = _t(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("arg")), ["l_partkey"]
    return push.upsert(_state(x.where("l_linenumber = 1"), keys), _state(x.where("l_linenumber <> 1"), keys), keys, VALUES, MERGE)


@query(f"select user_id, sum({C})::bigint as sum, count(*)::bigint as count from events group by user_id")
def push_custom_rule(spark, d):
    """A rule given as a Python function over a key's stored rows and items."""
    import pandas as pd

    def rule(key, stored: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "sum": [int(stored["sum"].sum() + items["arg"].sum())], "count": [int(stored["count"].sum() + len(items))]})

    base, odd = _even_odd(spark, d)
    return push.push_with(base, odd.select("user_id", "arg"), KEYS, rule, "user_id long, sum long, count long")


# Pull


@query(f"with s as ({STATE}), r as ({REQUEST}) select r.pos, r.user_id, coalesce(s.sum, 0)::bigint as sum, coalesce(s.count, 0)::bigint as count from r left join s on r.user_id = s.user_id")
def pull_sparse(spark, d):
    return pull.pull(_state(_events(spark, d)), _request(spark, d), KEYS, DEFAULTS)


@query(f"with s as ({STATE}) select e.event_id as pos, e.user_id, s.sum from events e join s on e.user_id = s.user_id")
def pull_duplicate_keys(spark, d):
    e = _events(spark, d)
    return pull.pull(_state(e), e.select(F.col("event_id").alias("pos"), "user_id"), KEYS, {"sum": DEFAULTS["sum"]})


@query(f"with s as ({STATE}), r as ({REQUEST}) select count(*)::bigint as rows_before, count(*)::bigint as rows_after, (select count(*) from r where user_id not in (select user_id from s))::bigint as misses from s")
def pull_readonly_miss(spark, d):
    t = _table(spark, "readonly").push(_events(spark, d))
    got = t.pull(_request(spark, d), {"count": "cast(0 as bigint)"})
    before, after = t.for_each({"rows_before": "count(*)"}), t.refresh().for_each({"rows_after": "count(*)"})
    return before.join(after).join(got.where("count = 0").agg(F.count("*").alias("misses")))


@query(f"with s as ({STATE}), r as ({REQUEST}) select user_id, sum, count from s union all select distinct user_id, 0::bigint, 0::bigint from r where user_id not in (select user_id from s)")
def pull_insert_on_miss(spark, d):
    t = _table(spark, "insert").push(_events(spark, d))
    return t.pull_inserting(_request(spark, d), DEFAULTS)[1].df().drop("shard_id")


@query(f"with s as ({STATE}), r as ({REQUEST}) select r.pos, r.user_id, coalesce(s.sum // s.count, -1)::bigint as mean from r left join s on r.user_id = s.user_id")
def pull_projection(spark, d):
    return pull.pull(_state(_events(spark, d)), _request(spark, d), KEYS, {"mean": "cast(-1 as bigint)"}, {"mean": "sum div count"})


@query(f"with s as ({STATE}), r as ({REQUEST}) select r.pos, r.user_id, coalesce(s.sum, 0)::bigint as sum from r left join s on r.user_id = s.user_id")
def pull_replica_pick(spark, d):
    """Every replica of the table as rows of its node; the pull reads one node's copy of each shard."""
    state = _state(_events(spark, d)).withColumn("shard_id", F.pmod("user_id", F.lit(SHARDS)).cast("int"))
    nodes = layout.frame(spark, layout.place(list(range(NODES)), SHARDS, REPLICAS))
    pull.require_replicas(nodes, SHARDS)
    chosen = pull.pick_replica(nodes, request_id=7)
    one = state.join(nodes, "shard_id").join(chosen, ["shard_id", "node_id"], "left_semi")
    return pull.pull(one, _request(spark, d), KEYS, {"sum": DEFAULTS["sum"]})


@query(f"with s as ({STATE}), r as ({REQUEST}) select r.pos, r.user_id, coalesce(s.sum, 0)::bigint as sum, coalesce(s.count, 0)::bigint as count from r left join s on r.user_id = s.user_id")
def pull_native_broadcast(spark, d):
    return pull.pull(_state(_events(spark, d)), _request(spark, d), KEYS, DEFAULTS, small=True)


@query(f"with s as ({STATE}), r as (select 0 as pkg_id, user_id from ({REQUEST}) union all select 1, l_suppkey from lineitem) select r.pkg_id::int as pkg_id, r.user_id, coalesce(s.sum, 0)::bigint as sum from r left join s on r.user_id = s.user_id")
def pull_packages(spark, d):
    suppliers = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"))
    return _table(spark, "packages").push(_events(spark, d)).pull_packages([_request(spark, d).select("user_id"), suppliers], {"sum": DEFAULTS["sum"]})


# Dense


@query("select vec_id, i::int as slice_id, list_slice(embedding, i * 5 + 1, i * 5 + 5) as part from embeddings, unnest(range(0, 13)) t(i)")
def dense_push_slices(spark, d):
    return dense.slices(_t(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query("select vec_id, i::int as slice_id, list_transform(list_slice(list_transform(embedding, lambda x: floor(x * 1024)::bigint), i * 5 + 1, i * 5 + 5), lambda x: 3 * x) as part from embeddings, unnest(range(0, 13)) t(i)")
def dense_push_merge(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1024).cast("bigint")).alias("vec"))
    one = dense.slices(v, "vec_id", "vec", 5)
    return dense.upsert_slices(one, dense.merge_slices(one.unionByName(one), "vec_id", 5), "vec_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: F.floor(x * 1024).cast("bigint")).alias("vector"))


def _dense(spark: SparkSession, tag: str) -> DenseTable:
    return DenseTable.create(spark, files.scratch(spark, tag), 5)


WHOLE = "list_transform(embedding, lambda x: floor(x * 1024)::bigint)"


@query(f"select vec_id as key, list_transform({WHOLE}, lambda x: x * 2) as vector from embeddings")
def dense_async_push(spark, d):
    v = _vectors(spark, d)
    return _dense(spark, "dense-async").push(v).push(v).pull(v, F.lit(13))


@query(f"select vec_id as key, {WHOLE} as vector from embeddings")
def dense_sync_not_visible(spark, d):
    v = _vectors(spark, d)
    return _dense(spark, "dense-sync").push(v).push(v, mode="sync").pull(v, F.lit(13))


@query(f"select vec_id as key, list_transform({WHOLE}, lambda x: x * 4) as vector from embeddings")
def dense_sync_store(spark, d):
    v = _vectors(spark, d)
    return _dense(spark, "dense-store").push(v).push(v, mode="sync").push(v.unionByName(v), mode="sync").store().pull(v, F.lit(13))


@query("select vec_id, embedding as vector from embeddings")
def dense_pull_merge(spark, d):
    return dense.gather(dense.slices(_t(spark, d, "embeddings"), "vec_id", "embedding", 5), "vec_id", F.lit(13))


# Scan


@query(f"with s as ({STATE}) select count(*)::bigint as num, sum(sum)::bigint as sum, sum(count)::bigint as count from s")
def foreach_read(spark, d):
    return scan.for_each(_state(_events(spark, d)), {"num": "count(*)", "sum": "sum(sum)", "count": "sum(count)"})


@query(f"with s as ({STATE}) select count(*) filter (where count > 60)::bigint as over_limit, max(sum)::bigint as top from s")
def foreach_carried(spark, d):
    return scan.for_each(_state(_events(spark, d)), {"over_limit": "count_if(count > least_count)", "top": "max(sum)"}, {"least_count": 60})


@query(f"with s as ({STATE}) select (count(*) * {REPLICAS})::bigint as num, (sum(sum) * {REPLICAS})::bigint as sum from s")
def foreach_physical_replicas(spark, d):
    return scan.for_each(_state(_events(spark, d)), {"num": "count(*)", "sum": "sum(sum)"}, replicas=REPLICAS)


@query(f"with s as ({STATE}) select sum(abs(sum) % 97)::bigint as odd, count(*)::bigint as num from s")
def foreach_custom(spark, d):
    def partial(frames):
        for f in frames:
            yield f.assign(odd=f["sum"].abs() % 97, num=1)[["odd", "num"]].groupby(lambda _: 0).sum()

    return scan.for_each_with(_state(_events(spark, d)), partial, "odd long, num long", {"odd": "sum(odd)", "num": "sum(num)"})


@query(f"with s as ({STATE}) select user_id, (sum * 2 + 1)::bigint as sum, count from s")
def foreach_write(spark, d):
    return _table(spark, "write").push(_events(spark, d)).update({"sum": "sum * 2 + 1"}).df().drop("shard_id")


@query(f"with s as ({STATE}) select * from s where user_id % 2 = 0")
def erase_if(spark, d):
    return _table(spark, "erase").push(_events(spark, d)).erase_if("user_id % 2 = 1").df().drop("shard_id")


@query(f"with s as ({STATE}), r as ({REQUEST}) select r.pos, r.user_id, coalesce(s.sum, 0)::bigint as sum from r left join s on r.user_id = s.user_id and s.user_id % 2 = 0")
def erase_then_pull(spark, d):
    left = scan.erase_if(_state(_events(spark, d)), "user_id % 2 = 1")
    return pull.pull(left, _request(spark, d), KEYS, {"sum": DEFAULTS["sum"]})


@query(f"select (user_id % {SHARDS})::int as shard_id, count(distinct user_id)::bigint as item_number from events group by 1")
def storage_stats(spark, d):
    spec = TableSpec(SPEC.keys, SPEC.values, SHARDS, "pmod(user_id, {n})")
    return _table(spark, "stats", spec).push(_events(spark, d)).statistics()


@query("select 0::bigint as num")
def clear_storage(spark, d):
    return _table(spark, "clear").push(_events(spark, d)).clear().for_each({"num": "count(*)"})


# Files


#: Nodes are regions and shards nations, wherever a layout is asked for.
RING = "select ((n_nationkey + i) % (select count(*) from region))::int as node_id, n_nationkey::int as shard_id from nation, unnest(range(0, 2)) t(i)"


def _nodes(spark: SparkSession, d: str) -> list[int]:
    return sorted(r.n for r in _t(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("n")).collect())


def _ring(spark: SparkSession, d: str) -> layout.Layout:
    """Every nation's shard on two nodes, one behind the other."""
    n = len(_nodes(spark, d))
    copies = _t(spark, d, "nation").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return layout.from_frame(copies.select(F.expr(f"cast((n_nationkey + i) % {n} as int)").alias("node_id"), F.col("n_nationkey").cast("int").alias("shard_id")))


def _homes(spark: SparkSession, d: str) -> layout.Layout:
    """Every nation's shard on its region's node."""
    return layout.from_frame(_t(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("node_id"), F.col("n_nationkey").cast("int").alias("shard_id")))


@query(f"select node_id, shard_id, (shard_id % 2)::int as file_id from ({RING})")
def dump_file_plan(spark, d):
    return io.file_plan(layout.frame(spark, _ring(spark, d)), 2)


def _roundtrip(fmt: str, compression: str | None = None):
    def run(spark, d):
        ship(spark)
        t = _table(spark, f"dump-{fmt}").push(_events(spark, d))
        path = files.scratch(spark, f"files-{fmt}")
        t.dump(path, fmt, 2, compression)
        return _table(spark, f"load-{fmt}").load(path, fmt).df().drop("shard_id")

    return run


for _fmt, _codec in (("parquet", "zstd"), ("json", None), ("text", "gzip"), ("csv", None), ("orc", "snappy")):
    QUERIES[f"dump_load_roundtrip_{_fmt}"] = _roundtrip(_fmt, _codec)
    ORACLE_SQL[f"dump_load_roundtrip_{_fmt}"] = STATE


@query(f"with s as ({STATE}) select user_id, sum from s")
def load_project(spark, d):
    path = files.scratch(spark, "project")
    _table(spark, "dump").push(_events(spark, d)).dump(path)
    serving = TableSpec(SPEC.keys, {"sum": "bigint"}, 4)
    return _table(spark, "serve", serving, None).load(path, schema="user_id bigint, sum bigint", columns={"user_id": "user_id", "sum": "sum"}).df().drop("shard_id")


@query(f"with s as ({STATE}) select * from s where user_id % {SHARDS} in (1, 4)")
def restore_local_shards(spark, d):
    spec = TableSpec(SPEC.keys, SPEC.values, SHARDS, "pmod(user_id, {n})")
    path = files.scratch(spark, "restore")
    _table(spark, "full", spec).push(_events(spark, d)).dump(path)
    return _table(spark, "part", spec).restore(path, shards=[1, 4]).df().drop("shard_id")


@query(f"with a as ({EVEN.replace('event_id % 2 = 0', 'event_id % 2 = 0 and user_id % 3 = 0')}), s as ({STATE}) select * from a union all select * from s where user_id not in (select user_id from a)")
def restore_keep_first(spark, d):
    base, _ = _even_odd(spark, d)
    return io.restore(base.where("user_id % 3 = 0"), _state(_events(spark, d)), KEYS)


@query(f"with s as ({STATE}) select user_id, sum, count, (user_id % {SHARDS})::int as shard_id, ((row_number() over (partition by user_id % {SHARDS} order by user_id) - 1) // 5)::int as page from s")
def restore_paged(spark, d):
    return io.pages(_state(_events(spark, d)).withColumn("shard_id", F.pmod("user_id", F.lit(SHARDS)).cast("int")), KEYS, 5)


# Partitioning and layout


@query(f"with recursive src as (select distinct user_id as k, {SHARDS} as n from events), {JUMP} select k as user_id, shard as shard_id from bucket")
def shard_assign_jump(spark, d):
    return _events(spark, d).select("user_id").distinct().select("user_id", jump(F.col("user_id"), SHARDS).alias("shard_id"))


@query("select vec_id, i::int as slice_id, (xor(vec_id, i::bigint) % 7)::int as shard_id from embeddings, unnest(range(0, 13)) t(i)")
def shard_assign_dense(spark, d):
    s = dense.slices(_t(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return s.select("vec_id", "slice_id", slice_shard(F.col("vec_id"), F.col("slice_id"), 7).alias("shard_id"))


@query(f"select distinct user_id, (user_id % {SHARDS})::int as shard_id from events")
def shard_assign_mod(spark, d):
    return _events(spark, d).select("user_id").distinct().select("user_id", shard_column(KEYS, SHARDS, "pmod(user_id, {n})").alias("shard_id"))


@query(f"with recursive u as (select distinct user_id from events), src as (select user_id as k, {SHARDS} as n from u union all select user_id, 12 from u), {JUMP} select a.k as user_id, a.shard as old_shard, b.shard as new_shard from bucket a join bucket b on a.k = b.k and a.n = {SHARDS} and b.n = 12 where a.shard <> b.shard")
def reshard_moved(spark, d):
    u = _events(spark, d).select("user_id").distinct()
    both = u.select("user_id", jump(F.col("user_id"), SHARDS).alias("old_shard"), jump(F.col("user_id"), 12).alias("new_shard"))
    return both.where("old_shard <> new_shard")


@query(STATE)
def reshard_result(spark, d):
    return _table(spark, "reshard").push(_events(spark, d)).reshard(12).df().drop("shard_id")


@query(STATE)
def reshard_purged(spark, d):
    return _table(spark, "purge").push(_events(spark, d)).begin_reshard().purge().df().drop("shard_id")


@query(RING)
def replica_layout(spark, d):
    return layout.frame(spark, _ring(spark, d))


@query("select ((2 * n_nationkey + i) % (select count(*) from region))::int as node_id, n_nationkey::int as shard_id from nation, unnest(range(0, 2)) t(i)")
def place_least_loaded(spark, d):
    return layout.frame(spark, layout.place(_nodes(spark, d), _t(spark, d, "nation").count(), 2))


@query("select ((n_nationkey % (select count(*) - 1 from region)) + 1)::int as node_id, n_nationkey::int as shard_id from nation")
def place_running_first(spark, d):
    """The first node is dead, so none of the shards goes there."""
    return layout.frame(spark, layout.place(_nodes(spark, d), _t(spark, d, "nation").count(), 1, status={_nodes(spark, d)[0]: "DEAD"}))


@query("""with s as (select n_regionkey::int as node_id, n_nationkey::int as shard_id from nation), e as (select count(*) // count(distinct node_id) as each, max(shard_id) + 1 as top from s)
select * from s union all select (100 + n)::int, (top + n * each + i)::int from e, unnest(range(0, 2)) a(n), lateral (select unnest(range(0, each)) as i) b""")
def place_expand(spark, d):
    return layout.frame(spark, layout.expand(_homes(spark, d), [100, 101]))


@query("select (n_nationkey % (select count(*) from region))::int as node_id, n_nationkey::int as shard_id from nation")
def place_replica_change(spark, d):
    """From two copies of each shard to one: the fuller node gives its copy up."""
    return layout.frame(spark, layout.change_replicas(_ring(spark, d), 1))


@query("select (s % (select count(*) from region))::int as node_id, s::int as shard_id from unnest(range(0, (select 2 * count(*) from nation))) t(s)")
def place_shard_change(spark, d):
    """Twice as many shards: the new ones go round the nodes."""
    start = layout.place(_nodes(spark, d), _t(spark, d, "nation").count(), 1)
    return layout.frame(spark, layout.change_shards(start, 2 * _t(spark, d, "nation").count(), 1))


@query("select (n_nationkey % (select count(*) from region))::int as node_id, n_nationkey::int as shard_id from nation")
def place_balance(spark, d):
    """Shards by region, placed anew."""
    return layout.frame(spark, layout.balance(_homes(spark, d), _t(spark, d, "nation").count(), 1))


@query(f"with l as ({RING}) select n_nationkey::int as shard_id, (select count(*) from l where l.shard_id = n_nationkey and node_id not in (0, 1))::bigint as replicas from nation")
def node_failover(spark, d):
    before = _ring(spark, d)
    left, _ = layout.fail(before, {0, 1})
    shards = layout.frame(spark, before).select("shard_id").distinct()
    return shards.join(layout.frame(spark, left), "shard_id", "left").groupBy("shard_id").agg(F.count("node_id").alias("replicas"))


@query("select (case when n_regionkey = 0 then 9 else n_regionkey end)::int as node_id, n_nationkey::int as shard_id from nation")
def node_replace(spark, d):
    return layout.frame(spark, layout.replace(_homes(spark, d), 0, 9))


@query("select n_nationkey::int as shard_id, list_filter(list_sort([(n_nationkey % 5)::int, ((n_nationkey + 1) % 5)::int]), lambda x: x not in (0, 1)) as nodes from nation")
def serving_map(spark, d):
    """Which running nodes serve each shard; a shard whose nodes are both down has an empty list."""
    t = StateTable.create(spark, files.scratch(spark, "serving"), TableSpec(SPEC.keys, SPEC.values, _t(spark, d, "nation").count()), MERGE, _ring(spark, d))
    return t.set_node_status({0: "DEAD", 1: "LOADING"}).shard_map()


@query("select n_regionkey::int as node_id, case when n_regionkey = 2 then 'DEAD' else 'RUNNING' end as status, count(*)::int as shards from nation group by 1, 2")
def show_nodes(spark, d):
    return layout.show_nodes(spark, _homes(spark, d), {2: "DEAD"})


@query(f"select 'users' as table_name, 3::bigint as version, 'NORMAL' as status, {SHARDS}::int as shards, 1::int as pending, (select count(distinct user_id % {SHARDS}) from events where event_id % 2 = 0)::int as stored_shards union all select 'empty', 0, 'NORMAL', 2, 0, 0")
def show_tables(spark, d):
    folder, e = files.scratch(spark, "tables"), _events(spark, d)
    users = StateTable.create(spark, f"{folder}/users", TableSpec(SPEC.keys, SPEC.values, SHARDS, "pmod(user_id, {n})"), MERGE).push(e.where("event_id % 2 = 0"))
    users.push(e.where("event_id % 2 = 1"), mode="sync").set_uri("file:/model")
    StateTable.create(spark, f"{folder}/empty", TableSpec(SPEC.keys, SPEC.values, 2), MERGE)
    return list_tables(spark, folder)


@query(STATE)
def registered_reshard(spark, d):
    """The operator kept in the catalog under update_ctx, found and run by a later reader."""
    t = _table(spark, "registered").push(_events(spark, d)).register("update_ctx", {"library": "core", "operator": "reshard", "config": {"shards": 12}})
    return t.refresh().update_table().df().drop("shard_id")


# Sync, streams, user operators, models


@query(f"with s as ({STATE}) select * from s where user_id in (select user_id from events where event_id >= 9000 and user_id % 7 = 0)")
def sync_changed_keys(spark, d):
    e = _events(spark, d)
    late = "event_id >= 9000 and user_id % 7 = 0"
    t = _table(spark, "feed").push(e.where(f"not ({late})"))
    return t.push(e.where(late)).changes(after=t.version).drop("shard_id")


@query(f"with a as ({EVEN}), s as ({STATE}) select * from a where user_id not in (select user_id from events where event_id % 2 = 1 and user_id < 50) union all select * from s where user_id in (select user_id from events where event_id % 2 = 1 and user_id < 50)")
def sync_apply(spark, d):
    base, _ = _even_odd(spark, d)
    e = _events(spark, d)
    log = e.where("event_id % 2 = 1 and user_id < 50").select("user_id", F.lit(2).alias("version"))
    return feed.apply(base, feed.changed(log, _state(e), KEYS, 1, 2), KEYS, VALUES)


@query(STATE)
def sync_feed(spark, d):
    e = _events(spark, d)
    source, target = _table(spark, "source"), _table(spark, "target")
    link = SyncFeed(source, target)
    source = source.push(e.where("event_id % 2 = 0"))
    link.step()
    source.push(e.where("event_id % 2 = 1"))
    link.step()
    link.step()
    return link.target.df().drop("shard_id")


@query(f"with s as ({STATE}), a as ({EVEN}) select 'first' as target, * from s union all select 'second', * from s where user_id in (select user_id from events where event_id % 2 = 1) union all select 'third', * from a")
def sync_targets(spark, d):
    """Three targets of one table: from its beginning, from the second push on, and one that is removed before the second push."""
    e = _events(spark, d)
    source = _table(spark, "sync-source")
    targets = {n: _table(spark, f"sync-{n}") for n in ("first", "second", "third")}
    source = source.add_sync("first", targets["first"].root).add_sync("third", targets["third"].root).push(e.where("event_id % 2 = 0"))
    source = source.notify_sync().remove_sync("third").add_sync("second", targets["second"].root).push(e.where("event_id % 2 = 1"))
    source.notify_sync().notify_sync()
    return push.packages(*[t.refresh().df().drop("shard_id").select(F.lit(n).alias("target"), "*") for n, t in targets.items()])


@query(f"select user_id, 2 * sum({C})::bigint as sum, 2 * count(*)::bigint as count from events group by user_id")
def stream_push_twice(spark, d):
    """Two streams, each with a checkpoint of its own, into one table: every batch of both arrives."""
    t = _table(spark, "streams")
    static = spark.read.parquet(f"{d}/events.parquet")
    for i in (1, 2):
        stream = spark.readStream.schema(static.schema).parquet(f"{d}/events.parquet*")
        push_stream(stream.select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("arg")), t, files.scratch(spark, f"streams-{i}")).awaitTermination()
    return t.refresh().df().drop("shard_id")


@query(STATE)
def stream_push(spark, d):
    t = _table(spark, "stream")
    static = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/events.parquet*")
    items = stream.select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("arg"))
    push_stream(items, t, files.scratch(spark, "stream-checkpoint")).awaitTermination()
    return t.refresh().df().drop("shard_id")


@query(f"with s as (select *, user_id % {SHARDS} as shard from ({STATE})) select shard::int as shard_id, user_id, sum from (select *, row_number() over (partition by shard order by sum desc, user_id) as k from s) where k <= 3")
def udf_top_per_shard(spark, d):
    def top(rows):
        return rows.sort_values(["sum", "user_id"], ascending=[False, True]).head(3)[["shard_id", "user_id", "sum"]]

    state = _state(_events(spark, d)).withColumn("shard_id", F.pmod("user_id", F.lit(SHARDS)).cast("int"))
    return UserOperator("shard_id int, user_id long, sum long", top).call(state)


@query(f"with s as (select *, user_id % {SHARDS} as shard from ({STATE})) select sum(sum)::bigint as sum, count(*)::bigint as num, 25::int as least from s where count >= 25")
def udf_with_request(spark, d):
    """A parameter becomes the request that every shard gets; shards answer with partial sums, which are gathered with the call's state."""
    import pandas as pd

    def partial(rows, request):
        rows = rows[rows["count"] >= request["least"]]
        return pd.DataFrame({"sum": [int(rows["sum"].sum())], "num": [len(rows)]})

    op = UserOperator(
        "sum long, num long", partial, create_state=dict, generate=lambda least, state: state.update(least=least) or {"least": least},
        gather=lambda rows, state: rows.agg(F.sum("sum").alias("sum"), F.sum("num").alias("num")).withColumn("least", F.lit(state["least"])),
    )
    state = _state(_events(spark, d)).withColumn("shard_id", F.pmod("user_id", F.lit(SHARDS)).cast("int"))
    return op.prepare(25).send(state).wait()


@query("select m as model, t as table_name, p as placement from (values ('ctr', 'users', 'remote'), ('ctr/wide', 'crosses', 'local'), ('ctr/deep', 'embeddings', 'remote')) x(m, t, p)")
def model_catalog(spark, d):
    deep = Model("deep", {"embeddings": "remote"}, {"pull_embeddings": "embeddings"})
    return Model("ctr", {"users": "remote"}, {"push_users": "users"}, [Model("wide", {"crosses": "local"}), deep]).frame(spark)
