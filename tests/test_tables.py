"""State tables against closed forms: keys r*100 .. r*100+99 of client r, argument = key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.partition import jump_buckets
from keyloom.operators import dense, layout, pull, push, scan
from keyloom.operators.spec import MergeSpec, Registry, TableSpec, last_wins, sum_count
from keyloom.plans import files
from keyloom.plans.dense_table import DenseTable
from keyloom.plans.model import Model
from keyloom.plans.table import StaleVersion, StateTable, Unavailable
from keyloom.sources import io
from keyloom.streaming.push_stream import SyncFeed, push_stream

SPEC = TableSpec({"key": "int"}, {"sum": "bigint", "count": "bigint"}, 6)
ZERO = {"sum": "cast(0 as bigint)", "count": "cast(0 as bigint)"}


def items(spark, clients):
    return spark.range(100 * clients).select(F.col("id").cast("int").alias("key"), F.col("id").alias("arg"))


def even(df):
    return df.where("key div 100 % 2 = 0")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def table(spark, tmp_path):
    return StateTable.create(spark, f"file://{tmp_path}/t", SPEC, sum_count())


@pytest.mark.parametrize("clients", [1, 3])
def test_train_store_reload_erase_pull_reshard(spark, tmp_path, clients):
    x = items(spark, clients)
    t = StateTable.create(spark, f"file://{tmp_path}/a", SPEC, sum_count())
    t = t.push(x).push(x, "sync").push(even(x), "sync")
    assert t.for_each({"n": "sum(count)"}).first().n == 100 * clients  # pending pushes are not seen
    t = t.store()
    e = lambda k: 1 if (k // 100) % 2 == 0 else 0
    assert rows(t.df(), "key", "sum", "count") == [(k, k * (2 + e(k)), 2 + e(k)) for k in range(100 * clients)]
    for fmt, codec in (("json", None), ("parquet", "snappy"), ("text", "gzip")):
        t.dump(f"file://{tmp_path}/dump-{fmt}", fmt, 2, codec)
        again = t.clear()
        assert again.for_each({"n": "count(*)"}).first().n == 0
        t = again.load(f"file://{tmp_path}/dump-{fmt}", fmt)
        assert t.for_each({"n": "count(*)"}).first().n == 100 * clients
    t = t.erase_if("key % 2 = 1")
    wanted = spark.range(100 * clients).select(F.col("id").cast("int").alias("key"))
    expected = [(k, 0 if k % 2 else k * (2 + e(k))) for k in range(100 * clients)]
    assert rows(t.pull(wanted, {"sum": ZERO["sum"]}), "key", "sum") == expected
    assert rows(t.reshard(11).pull(wanted, {"sum": ZERO["sum"]}), "key", "sum") == expected


def test_store_without_pending_and_repeated_batches(spark, table):
    assert table.store().version == 0
    x = items(spark, 1)
    t = table.push(x, batch_id="4", query="q")
    assert t.push(x, batch_id="4", query="q").version == t.version
    assert t.push(x, batch_id="5", query="q").for_each({"n": "sum(count)"}).first().n == 200


def test_init_may_refuse_and_null_keys(spark):
    base = spark.createDataFrame([(1, 10), (None, 5)], "key int, v long")
    pushed = spark.createDataFrame([(1, 1), (2, 2), (3, 30), (None, 7)], "key int, v long")
    rule = MergeSpec({"v": "sum(arg)"}, store={"v": "base.v + push.v"}, accept="push.v >= 10")
    got = {r.key: r.v for r in push.upsert(base, pushed, ["key"], ["v"], rule).collect()}
    assert got == {1: 11, None: 12, 3: 30}


def test_last_wins_is_by_sequence_not_arrival(spark, tmp_path):
    t = StateTable.create(spark, f"file://{tmp_path}/l", TableSpec({"key": "int"}, {"v": "string"}, 2), last_wins(["v"], "seq"))
    t = t.push(spark.createDataFrame([(1, "new", 9), (1, "old", 3)], "key int, v string, seq int"), "sync")
    t = t.push(spark.createDataFrame([(1, "older", 1), (2, "b", 1)], "key int, v string, seq int"), "sync").store()
    assert rows(t.df(), "key", "v") == [(1, "new"), (2, "b")]


def test_commit_conflict(spark, table):
    x = items(spark, 1)
    table.push(x)
    with pytest.raises(StaleVersion):
        table.push(x)
    assert table.refresh().for_each({"n": "sum(count)"}).first().n == 100


def test_push_touches_only_its_shards(spark, table):
    t = table.push(items(spark, 1))
    after = t.push(items(spark, 1).where("key = 7"))
    assert sum(after.meta["shards"][s] != p for s, p in t.meta["shards"].items()) == 1


def test_reshard_refuses_writes_and_rolls_back(spark, table):
    t = table.push(items(spark, 1)).begin_reshard()
    with pytest.raises(Unavailable):
        t.push(items(spark, 1))
    assert t.pull(items(spark, 1), ZERO).count() == 100
    assert t.purge().push(items(spark, 1)).for_each({"n": "sum(count)"}).first().n == 200
    with pytest.raises(Unavailable):
        t.refresh().finish_reshard(3)


def test_pull_defaults_duplicates_inserts(spark, table):
    t = table.push(items(spark, 1))
    wanted = spark.createDataFrame([(0, 5), (1, 5), (2, 500)], "pos int, key int")
    assert rows(t.pull(wanted, ZERO), "pos", "sum", "count") == [(0, 5, 1), (1, 5, 1), (2, 0, 0)]
    got, after = t.pull_inserting(wanted, ZERO)
    assert rows(got, "pos", "sum") == [(0, 5), (1, 5), (2, 0)]
    assert after.df().count() == 101 and t.df().count() == 100
    assert t.pull(wanted.limit(0), ZERO).count() == 0


def test_broadcast_pull_of_any_size(spark, table, monkeypatch):
    """The bound is on distinct keys, and a pull above it is an ordinary one."""
    broadcasts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    table = table.push(items(spark, 1))
    wanted = spark.createDataFrame([(i, i % 3) for i in range(9)], "pos int, key int")
    expected = rows(table.pull(wanted, ZERO), "pos", "sum", "count")
    for bound, hints in ((3, 1), (2, 0)):
        monkeypatch.setattr(pull, "BROADCAST_KEYS", bound)
        got = pull.pull(table.df(), wanted, ["key"], ZERO, small=True)
        assert rows(got, "pos", "sum", "count") == expected and broadcasts(got) == hints


def test_empty_table(spark, table):
    assert table.df().count() == 0 and table.erase_if("key > 0").df().count() == 0
    assert rows(table.refresh().pull(spark.createDataFrame([(1,)], "key int"), ZERO), "sum") == [(0,)]


def test_scan_physical_custom_and_write(spark, tmp_path):
    spec = TableSpec({"key": "int"}, {"sum": "bigint", "count": "bigint"}, 3, replicas=3)
    t = StateTable.create(spark, f"file://{tmp_path}/s", spec, sum_count()).push(items(spark, 1))
    assert t.for_each({"n": "count(*)"}, physical=True).first().n == 300
    assert t.for_each({"n": "count_if(sum >= low)"}, {"low": 90}).first().n == 10
    assert t.update({"sum": "sum + 1"}).for_each({"s": "sum(sum)"}).first().s == 4950 + 100
    assert sum(r.item_number for r in t.statistics().collect()) == 100


def test_restore(spark, tmp_path):
    spec = TableSpec({"key": "int"}, {"sum": "bigint", "count": "bigint"}, 4, "pmod(key, {n})")
    t = StateTable.create(spark, f"file://{tmp_path}/f", spec, sum_count()).push(items(spark, 1))
    t.dump(f"file://{tmp_path}/d")
    part = StateTable.create(spark, f"file://{tmp_path}/p", spec, sum_count()).restore(f"file://{tmp_path}/d", shards=[1])
    assert rows(part.df(), "key") == [(k,) for k in range(1, 100, 4)]
    assert part.restore(f"file://{tmp_path}/d").df().count() == 100
    with pytest.raises(ValueError):
        part.refresh().restore(f"file://{tmp_path}/d", on_duplicate="error")
    with pytest.raises(Exception, match="(?i)exist"):
        t.dump(f"file://{tmp_path}/d")


def test_dense_slices(spark):
    v = spark.createDataFrame([(i, list(range(i, i + i))) for i in range(12)], "id int, vec array<bigint>")
    s = dense.slices(v, "id", "vec", 5)
    assert s.where("id = 0").count() == 0 and s.where("id = 11").count() == 3
    three = dense.upsert_slices(s, dense.merge_slices(s.unionByName(s), "id", 5), "id")
    assert {r.id: r.vector for r in dense.gather(three, "id").collect()} == {i: [3 * x for x in range(i, i + i)] for i in range(1, 12)}
    with pytest.raises(Exception, match="missing slice"):
        dense.gather(s.where("slice_id <> 1 or id <> 11"), "id").collect()


def test_jump_hash_moves_only_to_new_buckets():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 20_000)
    a, b = jump_buckets(keys, 8), jump_buckets(keys, 12)
    assert ((a >= 0) & (a < 8)).all() and (b[a != b] >= 8).all()
    assert abs((a != b).mean() - 1 / 3) < 0.02 and (jump_buckets(keys, 1) == 0).all()


def test_placement():
    placed = layout.place([0, 1, 2], 8, 2)
    assert sorted(map(len, placed.values())) == [5, 5, 6] and all(len(set(s)) == len(s) for s in placed.values())
    assert sorted(s for held in layout.change_replicas(placed, 1).values() for s in held) == list(range(8))
    left, lost = layout.fail(layout.change_replicas(placed, 1), {0})
    assert lost and not layout.fail(placed, {0})[1] and 0 not in left
    with pytest.raises(ValueError):
        layout.expand(placed, [9])
    with pytest.raises(RuntimeError):
        layout.place([0], 1, 2)


def test_replicas(spark):
    nodes = layout.frame(spark, layout.place([0, 1, 2], 6, 2))
    picked = pull.pick_replica(nodes, 3)
    assert rows(picked, "shard_id", "node_id") == rows(pull.pick_replica(nodes, 3), "shard_id", "node_id") and picked.count() == 6
    with pytest.raises(RuntimeError):
        pull.require_replicas(nodes.where("shard_id <> 4"), 6)
    assert scan.statistics(spark.createDataFrame([(0,)], "shard_id int"), nodes).count() == 12


def test_feed_stream_and_garbage(spark, table, tmp_path):
    x = items(spark, 2)
    path = f"{tmp_path}/in"
    x.write.parquet(path)
    stream = spark.readStream.schema(x.schema).parquet(path)
    for _ in range(2):
        push_stream(stream, table, f"{tmp_path}/cp").awaitTermination()
    t = table.refresh()
    assert t.for_each({"n": "sum(count)"}).first().n == 200
    target = StateTable.create(spark, f"file://{tmp_path}/target", SPEC, sum_count())
    link = SyncFeed(t, target)
    link.step()
    t = t.push(x.where("key = 3"))
    assert rows(t.changes(after=t.version - 1), "key", "count") == [(3, 2)]
    link.step()
    link.step()
    assert rows(link.target.df(), "key", "sum") == rows(t.df(), "key", "sum")
    assert t.collect_garbage() and t.df().count() == 200


def test_catalog(spark, table):
    t = table.register("pull", {"kind": "sparse"}).set_uri("file:///x").set_layout({0: [0, 1]})
    with pytest.raises(ValueError):
        t.register("pull", {})
    assert t.deregister("pull").meta["ops"] == {} and t.meta["uri"] == "file:///x" and t.meta["update_version"] == 1
    with pytest.raises(ValueError):
        StateTable.create(spark, table.root, SPEC)
    t.refresh().drop()
    with pytest.raises(FileNotFoundError):
        StateTable.open(spark, table.root)


def test_registry_and_models():
    r = Registry()
    r.register("lib", "op")(lambda x=1: x)
    assert r.create("lib", "op", x=3) == 3 and r.names() == [("lib", "op")]
    with pytest.raises(ValueError):
        r.register("lib", "op")(1)
    with pytest.raises(KeyError):
        r.create("lib", "none")
    with pytest.raises(ValueError):
        Model("a", {}, {"x": "t"}, [Model("b", {}, {"x": "t"})]).all_operators()
    with pytest.raises(ValueError):
        TableSpec({"k": "int"}, {"k": "int"})
    with pytest.raises(ValueError):
        io.dump(None, "x", "avro")


def test_two_streams_into_one_table(spark, table, tmp_path):
    spark.range(10).select((F.col("id") % 3).alias("key"), F.col("id").alias("arg")).write.parquet(f"{tmp_path}/in")
    for cp in ("one", "two", "one"):  # the third delivers nothing new
        push_stream(spark.readStream.schema("key long, arg long").parquet(f"{tmp_path}/in"), table, f"{tmp_path}/{cp}").awaitTermination()
    assert table.refresh().for_each({"n": "sum(count)"}).first().n == 20


def test_a_writer_that_dies_leaves_the_table_readable(spark, table):
    """It dies between creating the catalog file and giving it its name."""
    before = table.push(items(spark, 1))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{before.root}/_catalog/.v{before.version + 1:012d}.json-dead")
    fs, _ = files._fs(spark, before.root)
    fs.create(path, False).close()  # what is left behind
    assert StateTable.open(spark, before.root).version == before.version
    after = before.set_uri("file:///x")
    assert StateTable.open(spark, before.root).version == after.version == before.version + 1


def test_commits_are_exclusive_and_retried(spark, table):
    assert files.create_text(spark, f"{table.root}/name", "a") and not files.create_text(spark, f"{table.root}/name", "b")
    assert files.read_text(spark, f"{table.root}/name") == "a"
    assert not [n for n in files.names(spark, table.root) if n.startswith(".name")]
    stale = table
    table.set_uri("file:///a")
    with pytest.raises(StaleVersion):
        stale.push(items(spark, 1))
    assert stale.retrying(lambda t: t.push(items(spark, 1))).meta["uri"] == "file:///a"
    with pytest.raises(StaleVersion):
        table.retrying(lambda t: stale.set_uri("file:///b"), attempts=2)


def test_stored_rows_are_not_shuffled_by_a_small_push(spark, table, monkeypatch):
    from keyloom.plans import table as module

    t = table.push(items(spark, 3))
    logged = spark.read.parquet(f"{t.root}/{t.meta['log'][0]['dir']}")
    small = push.upsert_small(t.df(), logged, t.keys, t.values, t.merge, ["shard_id"])
    assert "Exchange hashpartitioning" not in small._jdf.queryExecution().executedPlan().toString()
    once = sorted(map(str, t.push(items(spark, 2)).df().collect()))
    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    other = StateTable.create(spark, t.root + "-other", t.spec, t.merge).push(items(spark, 3)).push(items(spark, 2))
    assert once == sorted(map(str, other.df().collect()))


def test_log_is_trimmed_behind_its_readers(spark, table, tmp_path):
    target = StateTable.create(spark, f"{tmp_path}/sync-target", table.spec, table.merge)
    t = table.add_sync("copy", target.root)
    for n in (1, 2):
        t = t.push(items(spark, n))
    assert len(t.trim_log().meta["log"]) == 2  # the target has none of them
    t = t.refresh().notify_sync().trim_log()
    assert not t.meta["log"] and t.meta["floor"] == t.sync_targets()["copy"]["cursor"]
    with pytest.raises(ValueError):
        t.changes(0)
    assert any(d.startswith("log/") for d in t.collect_garbage())
    assert sorted(map(str, target.refresh().df().collect())) == sorted(map(str, t.df().collect()))
    with pytest.raises(ValueError):
        t.add_sync("copy", target.root)


def test_dense_table(spark, tmp_path):
    t = DenseTable.create(spark, f"{tmp_path}/dense", 3)
    v = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [5])], "key long, vector array<long>")
    t = t.push(v).push(v, mode="sync").push(v.unionByName(v), mode="sync")
    assert {r.key: r.vector for r in t.pull(v).collect()} == {1: [1, 2, 3, 4], 2: [5]}
    t = t.store()
    assert {r.key: r.vector for r in t.pull(v).collect()} == {1: [4, 8, 12, 16], 2: [20]}
    with pytest.raises(Exception, match="no vector of key 9"):
        t.pull(spark.createDataFrame([(9,)], "key long")).collect()
    with pytest.raises(Exception, match="missing slice"):
        t.pull(v, F.lit(2)).collect()
    with pytest.raises(NotImplementedError):
        t.changes(0)


def test_node_status_and_registered_operators(spark, table):
    t = table.set_layout({0: [0, 1], 1: [1], 2: [2]}).set_node_status({1: "DEAD"})
    found = {r.shard_id: r.nodes for r in t.shard_map().collect()}
    assert found[0] == [0] and found[1] == [0] and found[2] == [2] and found[3] == []
    with pytest.raises(ValueError):
        t.set_node_status({1: "ASLEEP"})
    assert 1 not in [n for n, s in layout.place([0, 1, 2], 4, 1, status={1: "DEAD"}).items() if s]
    assert layout.place([0, 1], 1, 2, status={1: "DEAD"}) == {0: [0], 1: [0]}  # running ones first, not only
    t = t.push(items(spark, 2)).register("clean", {"library": "core", "operator": "erase_if", "config": {"predicate": "true"}})
    assert StateTable.open(spark, t.root).call("clean").df().count() == 0
    with pytest.raises(KeyError):
        t.call("unknown")
