"""Schema drift as lazy views: rename, replace and add columns, rename tables, chains of such changes.

A version of a database is a dict of table names to DataFrames. Changes give a new
dict; nothing is copied, so filters and column pruning still reach the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tables = dict[str, DataFrame]
NAME = re.compile(r"[A-Za-z0-9_-]+")


def _find(names: Iterable[str], wanted: str) -> str:
    """The name that equals ``wanted`` but for case."""
    for n in names:
        if n.casefold() == wanted.casefold():
            return n
    raise KeyError(f"there is no {wanted}")


def _free(names: Iterable[str], new: str) -> str:
    if any(n.casefold() == new.casefold() for n in names):
        raise ValueError(f"{new} is taken")
    return new


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    old = _find(df.columns, old)
    return df.withColumnRenamed(old, _free((c for c in df.columns if c != old), new))


def replace_column(df: DataFrame, old: str, new: str, kind: str) -> DataFrame:
    """Same type: renamed in place. Another type: the cast column moves to the end."""
    old = _find(df.columns, old)
    _free((c for c in df.columns if c != old), new)
    if df.schema[old].dataType.simpleString() == T._parse_datatype_string(kind).simpleString():
        return df.withColumnRenamed(old, new)
    return df.select(*(c for c in df.columns if c != old), F.col(old).try_cast(kind).alias(new))


def add_column(df: DataFrame, new: str, kind: str, default: object) -> DataFrame:
    """A column at the end, filled with a default that isn't null."""
    if default is None:
        raise ValueError("an added column needs a default")
    return df.withColumn(_free(df.columns, new), F.lit(default).cast(kind))


def apply_one(tables: Mapping[str, DataFrame], change: Mapping) -> Tables:
    """One change: a dict with ``type`` and its fields. A metric's new definition changes no table."""
    out = dict(tables)
    kind = change["type"]
    if kind == "metric_definition_change":
        return out
    name = _find(out, change["table"])
    if kind == "rename_table":
        _free((t for t in out if t != name), change["new_name"])
        out[change["new_name"]] = out.pop(name)
    elif kind == "rename_column":
        out[name] = rename_column(out[name], change["old_name"], change["new_name"])
    elif kind == "replace_column":
        out[name] = replace_column(out[name], change["old_name"], change["new_name"], change["declared_type"])
    elif kind == "add_column":
        out[name] = add_column(out[name], change["new_name"], change["declared_type"], change["default"])
    else:
        raise ValueError(f"unknown change: {kind}")
    return out


def apply_all(tables: Mapping[str, DataFrame], changes: Iterable[Mapping]) -> Tables:
    """Changes in order; none gives the tables as they are."""
    out = dict(tables)
    for change in changes:
        out = apply_one(out, change)
    return out


def schema_after(schema: T.StructType, changes: Iterable[Mapping]) -> T.StructType:
    """What changes of one table make of its schema, without any data."""
    fields = list(schema.fields)
    for c in changes:
        if c["type"] in ("rename_table", "metric_definition_change"):
            continue
        if c["type"] == "add_column":
            _free((f.name for f in fields), c["new_name"])
            fields.append(T.StructField(c["new_name"], T._parse_datatype_string(c["declared_type"]), False))
            continue
        at = [f.name for f in fields].index(_find([f.name for f in fields], c["old_name"]))
        kind = T._parse_datatype_string(c["declared_type"]) if c["type"] == "replace_column" else fields[at].dataType
        if kind.simpleString() == fields[at].dataType.simpleString():
            fields[at] = T.StructField(c["new_name"], kind, fields[at].nullable)
        else:
            fields.pop(at)
            fields.append(T.StructField(c["new_name"], kind, True))
    return T.StructType(fields)


@dataclass
class Versions:
    """Versions of databases: name and version to tables, each as temporary views of a session of its own."""

    spark: SparkSession
    known: dict[tuple[str, str], Tables] = field(default_factory=dict)

    def create(self, database: str, version: str, tables: Mapping[str, DataFrame]) -> None:
        if not (NAME.fullmatch(database) and NAME.fullmatch(version)):
            raise ValueError("names hold letters, digits, _ and - only")
        if (database, version) in self.known:
            raise ValueError(f"{database} {version} exists")
        self.known[database, version] = dict(tables)

    def evolve(self, database: str, old: str, new: str, changes: Iterable[Mapping]) -> None:
        """The next version by changes."""
        self.create(database, new, apply_all(self.known[database, old], changes))

    def columns(self, database: str, version: str) -> DataFrame:
        """table_name, position, column_name, data_type of a version."""
        rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(self.known[database, version].items()) for i, f in enumerate(df.schema)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")

    def query(self, database: str, version: str, sql: str) -> DataFrame:
        """A query over a version's tables, which stand for ``{name}`` in its text."""
        return self.spark.sql(sql, **self.known[database, version])
