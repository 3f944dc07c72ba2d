"""Tables by name, and building tables from rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.errors import CatalogError, SchemaError


def column(name: str, kind: T.DataType, nullable: bool = True, unique: bool = False, primary_key: bool = False) -> T.StructField:
    """A column; unique and primary_key are notes in its metadata and aren't enforced."""
    return T.StructField(name, kind, nullable and not primary_key, {"unique": unique or primary_key, "primary_key": primary_key})


def ddl(field: T.StructField) -> str:
    """A column as it stands in a table's definition."""
    notes = field.metadata or {}
    words = [field.name, field.dataType.simpleString().upper()]
    if not field.nullable:
        words.append("NOT NULL")
    if notes.get("primary_key"):
        words.append("PRIMARY KEY")
    elif notes.get("unique"):
        words.append("UNIQUE")
    return " ".join(words)


class TableBuilder:
    """Collects rows for a small table of a given schema."""

    def __init__(self, schema: T.StructType):
        self.schema, self.rows = schema, []

    def insert_row(self, row: Sequence) -> TableBuilder:
        if len(row) != len(self.schema.fields):
            raise SchemaError(f"{len(row)} values for {len(self.schema.fields)} columns")
        self.rows.append(tuple(row))
        return self

    def insert_rows(self, rows: Iterable[Sequence]) -> TableBuilder:
        for row in rows:
            self.insert_row(row)
        return self

    def build(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


class Catalog:
    """The session's temporary views, under the engine's rules: a name is taken once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def add(self, name: str, table: DataFrame) -> bool:
        """Whether the table was added; a name that is taken stays as it is."""
        if name.lower() in self._tables:
            return False
        table.createOrReplaceTempView(name)
        self._tables[name.lower()] = table
        return True

    def create(self, name: str, schema: T.StructType) -> bool:
        """Add an empty table."""
        return self.add(name, self.spark.createDataFrame([], schema))

    def find(self, name: str) -> DataFrame | None:
        return self._tables.get(name.lower())

    def table(self, name: str) -> DataFrame:
        found = self.find(name)
        if found is None:
            raise CatalogError(f"no table {name}")
        return found

    def row_count(self, name: str) -> int:
        return self.table(name).count()

    def names(self) -> list[str]:
        return sorted(self._tables)

    def drop(self, name: str) -> bool:
        gone = self._tables.pop(name.lower(), None)
        if gone is not None:
            self.spark.catalog.dropTempView(name)
        return gone is not None

    def clear(self) -> None:
        for name in self.names():
            self.drop(name)
