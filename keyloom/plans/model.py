"""Models: submodels, tables and operators by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Model:
    name: str
    #: table -> placement (remote, local or none)
    tables: dict[str, str] = field(default_factory=dict)
    #: operator -> table
    operators: dict[str, str] = field(default_factory=dict)
    submodels: list[Model] = field(default_factory=list)

    def all_tables(self, prefix: str = "") -> list[tuple[str, str, str]]:
        """(model path, table, placement) of this model and all below it."""
        path = f"{prefix}{self.name}"
        return [(path, t, p) for t, p in self.tables.items()] + [x for m in self.submodels for x in m.all_tables(path + "/")]

    def all_operators(self) -> dict[str, str]:
        """Every operator; a name that occurs twice is an error."""
        found = dict(self.operators)
        for m in self.submodels:
            for k, v in m.all_operators().items():
                if k in found:
                    raise ValueError(f"operator {k} occurs twice")
                found[k] = v
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.all_tables(), "model string, table_name string, placement string")
