"""State tables as immutable Parquet snapshots under a versioned catalog.

A version is a JSON file that names, for each shard, the folder of its rows; a commit is the exclusive creation of the
next version's file, so of two writers one fails and may try again on the new version.  Pushes rewrite only the shards
that they touch.  Readers keep the version they opened.  Writers never change a folder that a version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import TypeVar
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partition import with_shards
from ..operators import feed, layout, pull, push, scan
from ..operators.spec import MergeSpec, TableSpec, registry
from ..sources import io
from . import files

T = TypeVar("T")
#: Logged pushes of at most so many bytes on disk are broadcast to the stored rows.
BROADCAST_BYTES = 8 << 20


class StaleVersion(RuntimeError):
    """Another writer committed first."""


class Unavailable(RuntimeError):
    """The table's status doesn't allow the operation."""


class StateTable:
    def __init__(self, spark: SparkSession, root: str, meta: dict):
        self.spark, self.root, self.meta = spark, root.rstrip("/"), meta
        self.spec = TableSpec(**meta["spec"])
        self.merge = MergeSpec(**meta["merge"]) if meta["merge"] else None

    # Catalog

    @classmethod
    def create(cls, spark: SparkSession, root: str, spec: TableSpec, merge: MergeSpec | None = None, placed: Mapping[int, list[int]] | None = None) -> StateTable:
        meta = {
            "version": 0, "update_version": 0, "uuid": uuid.uuid4().hex, "status": "NORMAL", "spec": spec.to_dict(), "merge": merge and merge.to_dict(),
            "shards": {}, "pending": [], "log": [], "floor": 0, "nodes": {}, "batches": {}, "layout": {str(n): s for n, s in (placed or {}).items()}, "ops": {}, "uri": None,
        }
        table = cls(spark, root, meta)
        if not files.create_text(spark, table._path(0), json.dumps(meta)):
            raise ValueError(f"a table exists at {root}")
        return table

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> StateTable:
        found = [n for n in files.names(spark, f"{root.rstrip('/')}/_catalog") if n.endswith(".json")]
        if not found:
            raise FileNotFoundError(f"no table at {root}")
        name = found[-1] if version is None else f"v{version:012d}.json"
        return cls(spark, root, json.loads(files.read_text(spark, f"{root.rstrip('/')}/_catalog/{name}")))

    def _path(self, version: int) -> str:
        return f"{self.root}/_catalog/v{version:012d}.json"

    def _commit(self, **changes) -> StateTable:
        meta = self.meta | changes | {"version": self.meta["version"] + 1}
        if not files.create_text(self.spark, self._path(meta["version"]), json.dumps(meta)):
            raise StaleVersion(f"version {meta['version']} of {self.root} exists")
        return StateTable(self.spark, self.root, meta)

    def refresh(self) -> StateTable:
        return StateTable.open(self.spark, self.root)

    def retrying(self, change: Callable[[StateTable], T], attempts: int = 10) -> T:
        """change(table), again on the newest version whenever another writer committed first."""
        table = self
        for left in reversed(range(attempts)):
            try:
                return change(table)
            except StaleVersion:
                if not left:
                    raise
                table = self.refresh()
        raise ValueError("attempts is at least 1")

    @property
    def version(self) -> int:
        return self.meta["version"]

    def set_uri(self, uri: str) -> StateTable:
        return self._commit(uri=uri)

    def set_layout(self, placed: Mapping[int, list[int]]) -> StateTable:
        return self._commit(layout={str(n): s for n, s in placed.items()}, update_version=self.meta["update_version"] + 1)

    def set_node_status(self, status: Mapping[int, str]) -> StateTable:
        """RUNNING, LOADING, DEAD or UNAVAILABLE for some nodes; nodes never named are RUNNING."""
        return self._commit(nodes=self.meta["nodes"] | layout.checked_status(status), update_version=self.meta["update_version"] + 1)

    def shard_map(self) -> DataFrame:
        """shard_id and the running nodes that hold it, none for a shard that no running node has."""
        return layout.shard_map(self.spark, {int(n): s for n, s in self.meta["layout"].items()}, {int(n): s for n, s in self.meta["nodes"].items()}, self.spec.shards)

    def register(self, name: str, op: dict) -> StateTable:
        """op: the library and operator of the registry, and its config; call() runs it."""
        if name in self.meta["ops"]:
            raise ValueError(f"operator {name} is registered already")
        return self._commit(ops=self.meta["ops"] | {name: op})

    def call(self, name: str, *args):
        """What the operator registered under this name makes of the table."""
        if name not in self.meta["ops"]:
            raise KeyError(f"no operator {name}")
        op = self.meta["ops"][name]
        return registry.create(op["library"], op["operator"], **op.get("config", {}))(self, *args)

    def update_table(self) -> StateTable:
        """Runs the operator registered as ``update_ctx``."""
        return self.call("update_ctx")

    def deregister(self, name: str) -> StateTable:
        return self._commit(ops={k: v for k, v in self.meta["ops"].items() if k != name})

    def collect_garbage(self, keep: int = 1) -> list[str]:
        """Deletes folders that none of the last ``keep`` versions names; returns them."""
        used: set[str] = set()
        for v in range(max(0, self.version - keep + 1), self.version + 1):
            meta = StateTable.open(self.spark, self.root, v).meta
            used |= {*meta["shards"].values(), *meta["pending"], *(e["dir"] for e in meta["log"])}
        found = [f"log/{n}" for n in files.names(self.spark, f"{self.root}/log")]
        for name in files.names(self.spark, f"{self.root}/data"):
            found += [f"data/{name}/{n}" for n in files.names(self.spark, f"{self.root}/data/{name}") if n.startswith("in_shard=")]
        gone = [f for f in found if f not in used]
        for f in gone:
            files.delete(self.spark, f"{self.root}/{f}")
        return gone

    def trim_log(self, upto: int | None = None) -> StateTable:
        """Forgets changes up to a version; by default what all sync targets have (all, without a target).  Garbage collection then deletes their files."""
        least = min([t["cursor"] for t in self.sync_targets().values()], default=self.version)
        floor = max(self.meta["floor"], least if upto is None else min(upto, least))
        return self._commit(log=[e for e in self.meta["log"] if e["version"] > floor], floor=floor)

    def drop(self) -> None:
        files.delete(self.spark, self.root)

    # Rows

    @property
    def keys(self) -> list[str]:
        return list(self.spec.keys)

    @property
    def values(self) -> list[str]:
        return list(self.spec.values)

    def _schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in [*self.spec.keys.items(), *self.spec.values.items()]) + ", shard_id int"

    def df(self, shards: list[int] | None = None) -> DataFrame:
        """keys, values, shard_id: the rows of this version, or of some shards."""
        wanted = self.meta["shards"] if shards is None else {s: p for s, p in self.meta["shards"].items() if int(s) in set(shards)}
        reader = self.spark.read.schema(self._schema())
        return reader.parquet(*[f"{self.root}/{p}" for p in wanted.values()]) if wanted else self.spark.createDataFrame([], self._schema())

    def _write(self, rows: DataFrame, touched: list[int] | None) -> dict[str, str]:
        """New folders of the rows; shards not touched keep theirs, touched ones without rows lose theirs."""
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*self.keys, *self.values, "shard_id").withColumn("in_shard", F.col("shard_id"))
        rows.hint("rebalance", "in_shard").write.partitionBy("in_shard").parquet(f"{self.root}/{name}")
        new = {n.removeprefix("in_shard="): f"{name}/{n}" for n in files.names(self.spark, f"{self.root}/{name}") if n.startswith("in_shard=")}
        kept = {} if touched is None else {s: p for s, p in self.meta["shards"].items() if int(s) not in set(touched)}
        return kept | new

    def _merged(self, rows: DataFrame, touched: list[int]) -> dict[str, str]:
        """As _write, for rows that come from the touched shards' own files: they stay with the tasks that read them."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*self.keys, *self.values, "shard_id").withColumn("in_shard", F.col("shard_id")).write.partitionBy("in_shard").parquet(f"{self.root}/{name}")
        new = {n.removeprefix("in_shard="): f"{name}/{n}" for n in files.names(self.spark, f"{self.root}/{name}") if n.startswith("in_shard=")}
        return {s: p for s, p in self.meta["shards"].items() if int(s) not in set(touched)} | new

    def _sharded(self, rows: DataFrame) -> DataFrame:
        return with_shards(rows, self.keys, self.spec.shards, self.spec.partitioner)

    def _writable(self) -> None:
        if self.meta["status"] != "NORMAL":
            raise Unavailable(f"status is {self.meta['status']}")

    def _log(self, combined: DataFrame) -> str:
        """Combined pushes are written before they are applied: they are the delta log and the change feed."""
        name = f"log/{uuid.uuid4().hex}"
        typed = combined.withColumns({k: F.col(k).cast(t) for k, t in self.spec.keys.items()})  # shards are of the table's types
        self._sharded(typed).write.parquet(f"{self.root}/{name}")
        return name

    def _touched(self, logged: DataFrame) -> list[int]:
        return sorted(r.shard_id for r in logged.select("shard_id").distinct().collect())  # a row for each shard

    def _apply(self, name: str, merge: MergeSpec, **changes) -> StateTable:
        """Merges a logged push.  Rows keep the shard that their folder or the log has for them; a small log is broadcast, and stored rows aren't shuffled then."""
        logged = self.spark.read.parquet(f"{self.root}/{name}")
        touched = self._touched(logged)
        base = self.df(touched)
        if touched and files.size(self.spark, f"{self.root}/{name}") <= BROADCAST_BYTES:
            shards = self._merged(push.upsert_small(base, logged, self.keys, self.values, merge, ["shard_id"]), touched)
        else:
            shards = self._write(push.upsert(base, logged, self.keys, self.values, merge, ["shard_id"]), touched)
        return self._commit(shards=shards, **changes)

    # Push

    def push(self, items: DataFrame, mode: str = "async", batch_id: str | None = None, query: str = "") -> StateTable:
        """Combines items per key and merges them now (async) or at the next store (sync).

        A batch id not above the last one of the same query was applied before, and the push does nothing.
        """
        self._writable()
        if self.merge is None:
            raise ValueError("the table has no merge rule")
        if mode not in ("async", "sync"):
            raise ValueError("mode is async or sync")
        changes: dict = {}
        if batch_id is not None:
            if int(batch_id) <= int(self.meta["batches"].get(query, -1)):
                return self
            changes["batches"] = self.meta["batches"] | {query: int(batch_id)}
        name = self._log(push.combine(items, self.keys, self.merge))
        if mode == "sync":
            return self._commit(pending=[*self.meta["pending"], name], **changes)
        entry = {"version": self.version + 1, "dir": name}
        return self._apply(name, self.merge, log=[*self.meta["log"], entry], **changes)

    def store(self) -> StateTable:
        """Folds all pending pushes per key and merges them; without any it does nothing."""
        self._writable()
        if not self.meta["pending"]:
            return self
        pending = self.spark.read.parquet(*[f"{self.root}/{p}" for p in self.meta["pending"]])
        name = self._log(push.fold(pending, self.keys, self.merge))
        entry = {"version": self.version + 1, "dir": name}
        return self._apply(name, self.merge, pending=[], log=[*self.meta["log"], entry])

    def put(self, rows: DataFrame, seq: str | None = None) -> StateTable:
        """Direct push: rows replace stored ones."""
        self._writable()
        merge = MergeSpec({v: f"max_by(`{v}`, `{seq}`)" if seq else f"first(`{v}`)" for v in self.values})
        name = self._log(push.combine(rows, self.keys, merge))
        entry = {"version": self.version + 1, "dir": name}
        return self._apply(name, merge, log=[*self.meta["log"], entry])

    # Pull and scan

    def pull(self, request: DataFrame, defaults: Mapping[str, str], fetch: Mapping[str, str] | None = None) -> DataFrame:
        return pull.pull(self.df(), request, self.keys, defaults, fetch)

    def pull_packages(self, requests: Sequence[DataFrame], defaults: Mapping[str, str], fetch: Mapping[str, str] | None = None) -> DataFrame:
        """Several item sets in one pull; pkg_id tells which set a row belongs to."""
        return self.pull(pull.packages(requests), defaults, fetch)

    def pull_inserting(self, request: DataFrame, defaults: Mapping[str, str]) -> tuple[DataFrame, StateTable]:
        """A pull that also inserts the defaults of missing keys; a write."""
        self._writable()
        after = self.put(pull.missing(self.df(), request, self.keys, defaults))
        return after.pull(request, defaults), after

    def for_each(self, aggregates: Mapping[str, str], carried: Mapping[str, object] | None = None, physical: bool = False) -> DataFrame:
        return scan.for_each(self.df(), aggregates, carried, self.spec.replicas if physical else 1)

    def update(self, values: Mapping[str, str]) -> StateTable:
        self._writable()
        return self._commit(shards=self._write(scan.update(self.df(), values), None))

    def erase_if(self, predicate: str) -> StateTable:
        self._writable()
        return self._commit(shards=self._write(scan.erase_if(self.df(), predicate), None))

    def clear(self) -> StateTable:
        return self._commit(shards={}, pending=[])

    def statistics(self) -> DataFrame:
        return scan.statistics(self.df())

    # Files

    def dump(self, path: str, fmt: str = "parquet", number: int | None = None, compression: str | None = None) -> None:
        io.dump(self.df(), path, fmt, number, compression)

    def load(self, path: str, fmt: str = "parquet", schema: str | None = None, columns: Mapping[str, str] | None = None, drop: bool = False) -> StateTable:
        """Rows of files replace stored ones; ``columns`` projects file rows, ``drop`` clears the table in the same commit."""
        self._writable()
        rows = io.read(self.spark, path, fmt, schema or self._schema())
        rows = io.project(rows, columns) if columns else rows
        empty = StateTable(self.spark, self.root, self.meta | {"shards": {}}) if drop else self
        return empty.put(rows.select(*self.keys, *self.values))

    def restore(self, path: str, fmt: str = "parquet", schema: str | None = None, shards: list[int] | None = None, on_duplicate: str = "keep_first") -> StateTable:
        self._writable()
        rows = self._sharded(io.read(self.spark, path, fmt, schema or self._schema()).select(*self.keys, *self.values))
        return self._commit(shards=self._write(io.restore(self.df(), rows, self.keys, shards, on_duplicate), None))

    # Layout

    def begin_reshard(self) -> StateTable:
        """From here on writes are refused and reads go on."""
        self._writable()
        return self._commit(status="RESHARD", update_version=self.meta["update_version"] + 1)

    def finish_reshard(self, shards: int) -> StateTable:
        """Rows under a new number of shards; content is the same."""
        if self.meta["status"] != "RESHARD":
            raise Unavailable("no reshard has begun")
        spec = self.meta["spec"] | {"shards": shards}
        new = StateTable(self.spark, self.root, self.meta | {"spec": spec, "shards": {}})
        placed = new._sharded(self.df().drop("shard_id"))
        return self._commit(spec=spec, shards=new._write(placed, None), status="NORMAL", uuid=uuid.uuid4().hex)

    def reshard(self, shards: int) -> StateTable:
        return self.begin_reshard().finish_reshard(shards)

    def purge(self) -> StateTable:
        """Rolls an unfinished reshard back."""
        return self._commit(status="NORMAL") if self.meta["status"] == "RESHARD" else self

    # Change feed

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Current rows of the keys that pushes changed in versions (after, upto]."""
        if after < self.meta["floor"]:
            raise ValueError(f"changes up to version {self.meta['floor']} are forgotten; copy the table first")
        dirs = [e["dir"] for e in self.meta["log"] if after < e["version"] <= (self.version if upto is None else upto)]
        if not dirs:
            return self.df().limit(0)
        log = self.spark.read.parquet(*[f"{self.root}/{d}" for d in dirs]).select(*self.keys).withColumn("version", F.lit(after + 1))
        return feed.changed(log, self.df(), self.keys, after, after + 1)

    def sync_to(self, target: StateTable, after: int, columns: Mapping[str, str] | None = None) -> StateTable:
        """Ships the changed rows' values to another table; doing it again changes nothing."""
        rows = self.changes(after)
        return target.put(io.project(rows, columns) if columns else rows.select(*target.keys, *target.values))

    # Targets have files of their own, so that a cursor moves without a new version of the table.

    def sync_targets(self) -> dict[str, dict]:
        """name -> root and cursor of each target."""
        out = {}
        for folder in files.names(self.spark, f"{self.root}/_sync"):
            if found := [n for n in files.names(self.spark, f"{self.root}/_sync/{folder}") if n.endswith(".json")]:
                out[unquote(folder)] = json.loads(files.read_text(self.spark, f"{self.root}/_sync/{folder}/{found[-1]}"))
        return out

    def _move_cursor(self, name: str, root: str, cursor: int) -> None:
        files.create_text(self.spark, f"{self.root}/_sync/{quote(name, safe='')}/c{cursor:012d}.json", json.dumps({"root": root, "cursor": cursor}))

    def add_sync(self, name: str, root: str, after: int | None = None) -> StateTable:
        """A target that notify_sync() ships to, from a version on (default: this one)."""
        if name in self.sync_targets():
            raise ValueError(f"sync target {name} exists")
        self._move_cursor(name, root, self.version if after is None else max(after, self.meta["floor"]))
        return self

    def remove_sync(self, name: str) -> StateTable:
        files.delete(self.spark, f"{self.root}/_sync/{quote(name, safe='')}")
        return self

    def notify_sync(self, names: Sequence[str] | None = None, columns: Mapping[str, str] | None = None) -> StateTable:
        """Ships to the targets what changed since their cursors.  A cursor moves once its target has committed, so a failure ships the same again."""
        for name, at in self.sync_targets().items():
            if names is not None and name not in names or at["cursor"] >= self.version:
                continue
            if any(at["cursor"] < e["version"] <= self.version for e in self.meta["log"]):
                StateTable.open(self.spark, at["root"]).retrying(lambda target, at=at: self.sync_to(target, at["cursor"], columns))
            self._move_cursor(name, at["root"], self.version)
        return self


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, version, status, shards, pending, stored_shards of the tables in a folder; a row for each."""
    rows = []
    for name in files.names(spark, folder):
        if files.exists(spark, f"{folder.rstrip('/')}/{name}/_catalog"):
            t = StateTable.open(spark, f"{folder.rstrip('/')}/{name}")
            rows.append((name, t.version, t.meta["status"], t.spec.shards, len(t.meta["pending"]), len(t.meta["shards"])))
    return spark.createDataFrame(rows, "table_name string, version long, status string, shards int, pending int, stored_shards int")


registry.register("core", "reshard")(lambda shards: lambda table: table.reshard(shards))
registry.register("core", "erase_if")(lambda predicate: lambda table: table.erase_if(predicate))
registry.register("core", "for_each")(lambda aggregates: lambda table, carried=None: table.for_each(aggregates, carried))
