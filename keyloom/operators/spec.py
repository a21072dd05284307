"""What a state table is and how pushes merge into it.

Rules are SQL expressions, so that Catalyst compiles them and the catalog can keep them as text.  In them ``base`` is the
stored row and ``push`` the combined push of a key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """Key columns and value columns (name: SQL type), the number of shards, and how keys are dealt to them."""

    keys: Mapping[str, str]
    values: Mapping[str, str]
    shards: int = 8
    #: jump, modulo, or an SQL expression of the keys and ``{n}``, the number of shards.
    partitioner: str = "jump"
    replicas: int = 1

    def __post_init__(self) -> None:
        if not self.keys or set(self.keys) & set(self.values):
            raise ValueError("a table needs keys, and values with other names")
        if self.shards < 1 or self.replicas < 1:
            raise ValueError("shards and replicas are at least 1")
        if reserved := {"shard_id", "in_shard"} & (set(self.keys) | set(self.values)):
            raise ValueError(f"reserved column names: {reserved}")

    def to_dict(self) -> dict:
        return asdict(self) | {"keys": dict(self.keys), "values": dict(self.values)}


@dataclass(frozen=True)
class MergeSpec:
    """How items become rows.

    combine: push column -> aggregate over a batch's items of one key.
    merge:   push column -> aggregate over pending combined pushes of one key; default: sum of the column.
    init:    value -> expression of ``push``, for keys that the table lacks; default: the push column of that name.
    store:   value -> expression of ``base`` and ``push``, for keys that it has; default: as init.
    accept:  whether an absent key may be inserted, an expression of ``push``.
    """

    combine: Mapping[str, str]
    merge: Mapping[str, str] = field(default_factory=dict)
    init: Mapping[str, str] = field(default_factory=dict)
    store: Mapping[str, str] = field(default_factory=dict)
    accept: str = "true"

    def merge_of(self, name: str) -> str:
        return self.merge.get(name, f"sum(`{name}`)")

    def init_of(self, name: str) -> str:
        return self.init.get(name, f"push.`{name}`")

    def store_of(self, name: str) -> str:
        return self.store.get(name, self.init_of(name))

    def to_dict(self) -> dict:
        return {k: dict(v) if isinstance(v, Mapping) else v for k, v in self.__dict__.items()}


def sum_count(arg: str = "arg") -> MergeSpec:
    """Running sum and count of an argument."""
    return MergeSpec({"sum": f"sum({arg})", "count": "count(*)"}, store={"sum": "base.sum + push.sum", "count": "base.count + push.count"})


def last_wins(values: list[str], seq: str) -> MergeSpec:
    """Overwrite with the item of the highest sequence number; ``seq`` is kept as ``__seq`` to order pending pushes."""
    rule = {v: f"max_by(`{v}`, `{seq}`)" for v in values}
    return MergeSpec(rule | {"__seq": f"max(`{seq}`)"}, merge={v: f"max_by(`{v}`, __seq)" for v in values} | {"__seq": "max(__seq)"})


class Registry:
    """Named operators, by library and name; a second registration of a name is an error."""

    def __init__(self) -> None:
        self._found: dict[tuple[str, str], object] = {}

    def register(self, library: str, name: str):
        def put(op):
            if (library, name) in self._found:
                raise ValueError(f"operator {library}.{name} is registered already")
            self._found[library, name] = op
            return op

        return put

    def create(self, library: str, name: str, **config):
        if (library, name) not in self._found:
            raise KeyError(f"no operator {library}.{name}")
        op = self._found[library, name]
        return op(**config) if callable(op) else op

    def names(self) -> list[tuple[str, str]]:
        return sorted(self._found)


registry = Registry()
registry.register("core", "sum_count")(sum_count)
registry.register("core", "last_wins")(last_wins)
