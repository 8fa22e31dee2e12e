"""Queries over an index, as plans over its relations.

Every method returns a DataFrame (or takes and returns one), so filters and
projections reach the scans.  Listings are ordered with tie-breakers, so pages
are stable.
"""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import display_name, grep, line_slice, parent_dir, sqlite_like
from codeloom.session import materialize

ORDER = ("path", "line", "column", "name", "id")


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame | None = None
    references: DataFrame | None = None

    # -- scans ---------------------------------------------------------------
    def all_files(self) -> DataFrame:
        return self.files.orderBy("path")

    def visible_files(self) -> DataFrame:
        """Files not below a hidden top folder and not hidden themselves there."""
        return self.files.where(~F.col("path").startswith("."))

    def indexed(self, ids: DataFrame, column: str = "file_id") -> DataFrame:
        """The distinct ids of a table that are files of the index."""
        f = self.files.select(F.col("id").alias(column))
        return ids.select(column).distinct().join(f, column, "left_semi")

    def not_indexed(self, paths: DataFrame) -> DataFrame:
        """The distinct non-null ``path`` values of a table that the index has no file for."""
        return paths.select("path").where("path is not null").distinct().join(self.files.select("path"), "path", "left_anti")

    def file_by_path(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path)

    def located(self) -> DataFrame:
        """Symbols with path and language of their file."""
        f = self.files.select(F.col("id").alias("file_id"), "path", "language")
        return self.symbols.join(f, "file_id")

    def imports_with_source(self) -> DataFrame:
        f = self.files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path"), F.col("language").alias("source_language"))
        return self.imports.join(f, "source_file_id")

    def imports_of(self, file_id: int) -> DataFrame:
        return self.imports.where(F.col("source_file_id") == file_id).orderBy("import_path")

    # -- symbols -------------------------------------------------------------
    def _filtered(self, kind=None, scope=None, visibility=None, language=None, file=None, name=None, pattern=None) -> DataFrame:
        df = self.located()
        for column, value in (("kind", kind), ("scope", scope), ("visibility", visibility), ("language", language)):
            if value is not None:
                df = df.where(F.col(column) == value)
        if file is not None:
            df = df.where(sqlite_like(F.col("path"), f"%{file}%"))
        if name is not None:
            df = df.where(sqlite_like(F.col("name"), f"%{name}%"))
        return df if pattern is None else df.where(grep(F.col("name"), pattern))

    def list_symbols(self, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
        """Conjunctive optional filters, ordered, paged.  ``offset`` works alone."""
        df = self._filtered(**filters).orderBy(*ORDER)
        if offset:
            df = df.offset(offset)
        return df if limit is None else df.limit(limit)

    def count_symbols(self, **filters) -> DataFrame:
        return self._filtered(**filters).agg(F.count(F.lit(1)).alias("total_count"))

    def docid_ids(self) -> DataFrame:
        """``docid, n, first_id``: how many symbols share an identity, and the first of them."""
        return self.symbols.where("docid is not null").groupBy("docid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))

    def symbol_bodies(self, texts: DataFrame) -> DataFrame:
        """``id, body``: the lines of each symbol in ``file_id, content``.

        A text is split once, whatever the number of its symbols, which meet it
        as one list per file; null past the end of the text.
        """
        places = self.symbols.groupBy("file_id").agg(F.collect_list(F.struct("id", "line", "end_line")).alias("_s"))
        # the outer list has one entry, the lines: bound once for all symbols
        made = F.transform(
            F.array(F.split("content", "\r?\n")),
            lambda lines: F.transform("_s", lambda s: F.struct(s["id"].alias("id"), line_slice(lines, s["line"], s["end_line"]).alias("body"))),
        )
        return texts.select("file_id", "content").join(places, "file_id").select(F.inline(F.flatten(made)))

    def symbols_named(self, name: str) -> DataFrame:
        return self.located().where(F.col("name") == name)

    def definitions(self, name: str, scope: str | None = None, file: str | None = None) -> DataFrame:
        df = self.located().where(F.col("name") == name)
        if scope is not None:
            df = df.where(F.col("scope") == scope)
        if file is not None:
            df = df.where(sqlite_like(F.col("path"), f"%{file}%"))
        return df.select("id", "path", "line", "scope").orderBy("path", "line", "id")

    def symbols_in_dir(self, prefix: str = "") -> DataFrame:
        df = self.located()
        return (df.where(sqlite_like(F.col("path"), f"{prefix}%")) if prefix else df).orderBy(*ORDER)

    def symbols_of_file(self, path: str) -> DataFrame:
        return self.located().where(F.col("path") == path).orderBy(*ORDER)

    def functions(self, name: str, scope: str | None = None, file: str | None = None, line: int | None = None) -> DataFrame:
        """Candidates for a flow graph."""
        df = self.located().where((F.col("kind") == "fn") & (F.col("name") == name))
        if scope is not None:
            df = df.where(F.col("scope") == scope)
        if file is not None:
            df = df.where(sqlite_like(F.col("path"), f"%{file}%"))
        if line is not None:
            df = df.where((F.col("line") <= line) & (F.greatest("line", "end_line") >= line))
        return df.orderBy(*ORDER)

    # -- aggregates ----------------------------------------------------------
    def totals(self) -> DataFrame:
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one(self.files, "files").unionByName(one(self.symbols, "symbols"))
        return out if self.imports is None else out.unionByName(one(self.imports, "imports"))

    def symbols_by_kind(self) -> DataFrame:
        return self.symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")

    def files_by_language(self) -> DataFrame:
        return self.files.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy("language")

    def files_with_counts(self, language: str | None = None) -> DataFrame:
        """Each file with its numbers of symbols and imports, counted before joining."""
        f = self.files if language is None else self.files.where(F.col("language") == language)
        s = self.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbol_count"))
        i = self.imports.groupBy(F.col("source_file_id").alias("id")).agg(F.count(F.lit(1)).alias("import_count"))
        out = f.join(s, "id", "left").join(i, "id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return out.select("path", "language", zero("symbol_count"), zero("import_count"), "last_indexed_at").orderBy("path")

    def directories(self, prefix: str = "") -> DataFrame:
        """Symbols per directory: ``dir, n_files, n_symbols`` (root files: empty name)."""
        df = self.located().withColumn("dir", parent_dir(F.col("path")))
        if prefix:
            df = df.where(sqlite_like(F.col("path"), f"{prefix}%"))
        per_file = df.groupBy("dir", "path").agg(F.count(F.lit(1)).alias("n"))
        return per_file.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_symbols")).orderBy("dir")

    def export(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """``path, language, symbols, imports`` with lists; a page drops files without symbols on it."""
        paged = limit is not None or offset
        s = self.list_symbols(limit, offset) if paged else self.located()
        entry = F.struct("line", "column", F.col("name"), "kind", "end_line", "visibility", "scope")
        lists = s.groupBy("file_id").agg(F.sort_array(F.collect_list(entry)).alias("symbols"))
        imps = self.imports.groupBy("source_file_id").agg(F.sort_array(F.collect_list("import_path")).alias("imports"))
        f = self.files.join(lists, self.files.id == F.col("file_id"), "inner" if paged else "left")
        f = f.join(imps, self.files.id == F.col("source_file_id"), "left")
        none = F.array().cast("array<string>")
        return f.select("path", "language", F.coalesce("symbols", F.array()).alias("symbols"), F.coalesce("imports", none).alias("imports")).orderBy("path")

    def listing(self, **filters) -> DataFrame:
        """``path:line:col kind vis [scope.]name`` lines, ordered."""
        df = self.list_symbols(**filters)
        return df.select(
            F.format_string("%s:%d:%d %s %s %s", "path", "line", "column", "kind", "visibility", display_name(F.col("scope"), F.col("name"))).alias("text")
        )

    # -- dependencies --------------------------------------------------------
    def file_edges(self) -> DataFrame:
        """``source, target``: resolved path, else the raw specifier; distinct."""
        t = self.files.select(F.col("id").alias("resolved_file_id"), F.col("path").alias("_to"))
        e = self.imports_with_source().join(t, "resolved_file_id", "left")
        return e.select(F.col("source_path").alias("source"), F.coalesce("_to", "import_path").alias("target")).distinct()

    def dependencies(self, path: str) -> DataFrame:
        return self.file_edges().where(F.col("source") == path).select(F.col("target").alias("path")).orderBy("path")

    def dependents(self, target: str) -> DataFrame:
        """Of an indexed file by resolution; of anything else by the specifier's text."""
        src = self.imports_with_source()
        known = self.files.where(F.col("path") == target).select(F.col("id").alias("resolved_file_id"))
        by_file = src.join(known, "resolved_file_id", "left_semi")
        if known.isEmpty():
            by_file = src.where(sqlite_like(F.col("import_path"), f"%{target}%"))
        return by_file.select(F.col("source_path").alias("path")).distinct().orderBy("path")

    def transitive(self, start: str, depth: int, reverse: bool = False) -> DataFrame:
        """Breadth-first to ``depth``: ``path, depth, position`` in discovery order.

        One join per level; each level is written and only paths not yet seen go
        on, so cycles end.  Positions follow the parents' positions, then the
        path.
        """
        spark = self.files.sparkSession
        a, b = ("target", "source") if reverse else ("source", "target")
        edges = materialize(self.file_edges().select(F.col(a).alias("_from"), F.col(b).alias("path")), "edges")
        seen = spark.createDataFrame([(start, 0, 0)], "path string, depth int, position long")
        frontier, done = seen, 0
        for level in range(1, depth + 1):
            reached = frontier.select(F.col("path").alias("_from"), "position").join(edges, "_from")
            fresh = reached.groupBy("path").agg(F.min("position").alias("_parent")).join(seen.select("path"), "path", "left_anti")
            fresh = materialize(fresh, "level")
            n = fresh.count()
            if not n:
                break
            frontier = numbered(fresh, ["_parent", "path"], n, done).select("path", F.lit(level).alias("depth"), "position")
            seen, done = seen.unionByName(frontier), done + n
        return seen.where("depth > 0").orderBy("position")

    def symbol_dependencies(self, symbol_ids: DataFrame | None = None) -> DataFrame:
        """``symbol_id, import_path``: specifiers imported by the defining file; distinct."""
        s = self.symbols if symbol_ids is None else self.symbols.join(symbol_ids.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi")
        i = self.imports.select(F.col("source_file_id").alias("file_id"), "import_path").distinct()
        return s.select(F.col("id").alias("symbol_id"), "file_id").join(i, "file_id").select("symbol_id", "import_path").distinct()

    def attributed(self, symbol_ids: DataFrame | None = None) -> DataFrame:
        """Usage sites per symbol: ``symbol_id, path, line, column``, import-aware, distinct.

        A bare usage of a name that the file imports from another file which
        defines it belongs to that file.  Kept are qualified usages, usages in
        the defining file, usages in files that import the name from it, and
        usages where no import decides otherwise.

        The nested existence test is one aggregate: per (source file, name),
        the set of defining files it binds, made from imports x definitions
        once, then a single left join.
        """
        s = self.symbols.select(F.col("id").alias("symbol_id"), "name", F.col("file_id").alias("def_file"))
        if symbol_ids is not None:
            s = s.join(symbol_ids.select("symbol_id").distinct(), "symbol_id", "left_semi")
        defs = self.symbols.select(F.col("file_id").alias("resolved_file_id"), "name").distinct()
        named = self.imports.where("resolved_file_id is not null").select("source_file_id", "resolved_file_id", F.explode("names").alias("name"))
        bound = named.join(defs, ["resolved_file_id", "name"]).groupBy(F.col("source_file_id").alias("file_id"), "name").agg(F.collect_set("resolved_file_id").alias("bound"))
        r = self.references.select("symbol_id", "file_id", "line", "column", "qualified").distinct().join(s, "symbol_id").join(bound, ["file_id", "name"], "left")
        kept = r.where(F.col("qualified") | (F.col("def_file") == F.col("file_id")) | F.col("bound").isNull() | F.array_contains("bound", F.col("def_file")))
        f = self.files.select(F.col("id").alias("file_id"), "path")
        return kept.join(f, "file_id").select("symbol_id", "path", "line", "column").distinct()

    def summary(self) -> DataFrame:
        """Totals, kinds and languages as ``section, key, n``."""
        part = lambda df, section, key: df.select(F.lit(section).alias("section"), F.col(key).alias("key"), F.col("n").cast("long").alias("n"))
        return part(self.totals(), "totals", "relation").unionByName(part(self.symbols_by_kind(), "kinds", "kind")).unionByName(part(self.files_by_language(), "languages", "language"))


#: Rows up to which one task numbers them.
NUMBERED_AT_ONCE = 100_000


def numbered(df: DataFrame, order: list[str], n: int, after: int = 0) -> DataFrame:
    """``df`` (a written table of ``n`` rows) with ``position``: after + 1, ... in that order.

    Above ``NUMBERED_AT_ONCE`` rows the numbers come from a range sort and the
    sizes of its parts, so no task ever holds more.
    """
    if n <= NUMBERED_AT_ONCE:
        return df.withColumn("position", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + after).cast("long"))
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # the number of the part is in the upper bits, the place in it below
    starts: dict[int, int] = {}
    for part, size in sorted(tuple(r) for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()):
        starts[part], after = after, after + size
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), F.shiftright("_at", 33))
    return placed.withColumn("position", start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")


def bind_references(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidate symbols of raw references: ``symbol_id, file_id, line, column, qualified``.

    By name, over all files and languages; where the scope of the usage is known
    and a candidate has it, only those.  Exact repeats of a raw row count once;
    null names bind nothing.

    A usage joins on (name, scope) where that pair exists, else on the name
    alone, so it never carries candidates that fall away.  The result grows as
    usages times symbols of a name, which is what it is asked for; no list per
    name is gathered, and a hot name is split by AQE on its side of the join.
    """
    named = symbols.where("name is not null").select(F.col("name").alias("symbol_name"), F.col("scope").alias("from_scope"), F.col("id").alias("symbol_id"))
    pairs = named.where("from_scope is not null").select("symbol_name", "from_scope").distinct().withColumn("_scoped", F.lit(True))
    use = raw.select("file_id", "symbol_name", "line", "column", "from_scope", "qualified").distinct()
    use = use.join(pairs, ["symbol_name", "from_scope"], "left").withColumn("_key", F.when(F.col("_scoped"), F.col("from_scope")))
    any_scope = named.withColumn("_key", F.lit(None).cast("string")).drop("from_scope")
    in_scope = named.where("from_scope is not null").withColumnRenamed("from_scope", "_key")
    out = ["symbol_id", "file_id", "line", "column", "qualified"]
    parts = [
        use.where("_key is not null").join(in_scope, ["symbol_name", "_key"]).select(*out),
        use.where("_key is null").drop("_key").join(any_scope.drop("_key"), "symbol_name").select(*out),
    ]
    return reduce(DataFrame.unionByName, parts)
