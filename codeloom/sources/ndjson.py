"""Records of an external semantic helper, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "type string, docid string, name string, kind string, file string, start_line long, start_col long, end_line long, visibility string, scope string, "
    "line long, col long, is_definition boolean, available boolean, protocol_version long, dotnet_version string, roslyn_version string, message string"
)
# fixed values: the oldest protocol and runtime whose records are taken
MIN_PROTOCOL, MIN_RUNTIME = 1, 8


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records; one malformed line fails the whole read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def definitions(records: DataFrame) -> DataFrame:
    """Distinct definition sites."""
    cols = ("docid", "name", "kind", "file", "start_line", "start_col", "end_line", "visibility", "scope")
    return records.where("type = 'definition'").select(*cols).dropDuplicates(["docid", "file", "start_line", "start_col"])


def references(records: DataFrame) -> DataFrame:
    """Distinct usage sites of docids that are defined in the records."""
    own = records.where("type = 'definition'").select("docid").distinct()
    return records.where("type = 'reference'").select("docid", "file", "line", "col", "is_definition").join(own, "docid", "left_semi").distinct()


def indexed(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Records of indexed files: those whose ``file`` is a ``path`` of ``files``.

    Without ``files``, all within the root but build output and dot folders.
    Records without a file (null) drop out.
    """
    if files is not None:
        return records.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(*records.columns)
    return records.where(F.col("file").isNotNull() & ~F.col("file").rlike(r"(^|/)(bin|obj|\..*?)(/|$)"))


def mapped(definitions: DataFrame) -> DataFrame:
    """Definitions with the index's kinds and visibilities.

    A namespace is a ``mod`` and always ``pub``; types keep their kind; methods,
    constructors, properties and what else there is are ``fn``; only ``public``
    is ``pub``.  An empty scope is none.
    """
    kind = F.lower("kind")
    space = kind.isin("namespace", "mod")
    return definitions.withColumns({
        "kind": F.when(space, "mod").when(kind.isin("class", "struct", "interface", "enum"), kind).otherwise("fn"),
        "visibility": F.when(space | F.lower("visibility").isin("public", "pub"), "pub").otherwise("private"),
        "scope": F.nullif("scope", F.lit("")),
    })


def usable(records: DataFrame) -> DataFrame:
    """Whether the helper answered, speaks the protocol and runs on a runtime new
    enough (where it says which): one row, ``usable``."""
    runtime = F.split("dotnet_version", r"\.")[0].try_cast("int")
    ok = (F.col("type") == "ping") & F.col("available") & (F.col("protocol_version") >= MIN_PROTOCOL) & (F.col("dotnet_version").isNull() | F.coalesce(runtime >= MIN_RUNTIME, F.lit(False)))
    return records.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("usable"))
