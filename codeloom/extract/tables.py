"""From texts to the index's relations: one parse per file, three tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize, spread

_SYMBOL = "struct<name:string,kind:string,line:bigint,column:bigint,end_line:bigint,visibility:string,scope:string>"
_IMPORT = "struct<import_path:string,alias:string,names:array<string>>"
_REFERENCE = "struct<symbol_name:string,line:bigint,column:bigint,from_scope:string,qualified:boolean>"


def parse_files(texts: DataFrame) -> DataFrame:
    """``file_id, path, symbols, imports, references, error`` per row of
    ``file_id, path, language, content``; row by row, no shuffle.

    A text that can't be read gives empty lists and its ``error``, so a bad
    file is a row and not a failed job.  Null content counts as unreadable.
    """
    schema = f"file_id long, path string, symbols array<{_SYMBOL}>, imports array<{_IMPORT}>, references array<{_REFERENCE}>, error string"

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from codeloom.extract.scan import Parsed, parse

        s = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("column", pa.int64()), ("end_line", pa.int64()), ("visibility", pa.string()), ("scope", pa.string())])
        m = pa.struct([("import_path", pa.string()), ("alias", pa.string()), ("names", pa.list_(pa.string()))])
        r = pa.struct([("symbol_name", pa.string()), ("line", pa.int64()), ("column", pa.int64()), ("from_scope", pa.string()), ("qualified", pa.bool_())])
        for b in batches:
            made, errors = [], []
            for text, language in zip(b.column("content").to_pylist(), b.column("language").to_pylist(), strict=True):
                try:
                    if text is None:
                        raise ValueError("unreadable")
                    made.append(parse(text, language))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    made.append(Parsed())
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id"), b.column("path"), pa.array([p.symbols for p in made], pa.list_(s)), pa.array([p.imports for p in made], pa.list_(m)), pa.array([p.references for p in made], pa.list_(r)), pa.array(errors, pa.string())],
                names=["file_id", "path", "symbols", "imports", "references", "error"],
            )

    return spread(texts.select("file_id", "path", "language", "content")).mapInArrow(go, schema)


def relations(texts: DataFrame) -> dict[str, DataFrame]:
    """``symbols``, ``imports`` (unresolved) and ``raw_references`` of texts.

    The parse is written once.  Ids are hashes of what a row is, so parsing a
    file again gives the same ids and a refresh equals a rebuild.
    """
    parsed = materialize(parse_files(texts), "parsed")
    sym = parsed.select("file_id", "path", F.inline("symbols"))
    key = F.xxhash64("path", "kind", "name", "line", "column")
    symbols = sym.select(key.alias("id"), "name", "kind", "file_id", "line", "column", "end_line", "visibility", "scope", F.lit(None).cast("string").alias("docid"))
    imp = parsed.select("file_id", "path", F.posexplode("imports").alias("n", "i"))
    imports = imp.select(
        F.xxhash64("path", "n", "i.import_path").alias("id"), F.col("file_id").alias("source_file_id"), "i.import_path", "i.alias", "i.names", F.lit(None).cast("long").alias("resolved_file_id")
    )
    raw = parsed.select("file_id", F.inline("references"))
    return {"symbols": symbols, "imports": imports, "raw_references": raw.select("file_id", "symbol_name", "line", "column", "from_scope", "qualified"), "errors": parsed.where("error is not null").select("file_id", "path", "error")}
