"""Flow graphs of many functions at once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

GRAPH = (
    "symbol_id long, function struct<name:string,scope:string,file:string,line:long,end_line:long,language:string,params:array<string>,returns:string>, "
    "nodes array<struct<id:int,kind:string,label:string,line:long>>, edges array<struct<from:int,to:int,label:string>>, error string"
)


def flow_graphs(functions: DataFrame) -> DataFrame:
    """A graph per row of ``symbol_id, path, language, name, scope, line, content``.

    Where no graph can be made (other languages, no body, stale line, null
    text) the row has only its ``error``.  Rows of one text that follow each
    other share its scan; for all functions of many texts use ``file_graphs``.
    """

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from codeloom.flow.parse import flow, scan

        last, scanned = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    text = (r["language"], r["content"] or "")
                    if text != last:
                        last, scanned = None, scan(*text)
                        last = text
                    g = flow(*text, r["path"], r["name"], r["scope"], r["line"], scanned)
                    rows.append({"symbol_id": r["symbol_id"], **g, "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({"symbol_id": r["symbol_id"], "function": None, "nodes": None, "edges": None, "error": str(e)[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    f = pa.struct([("name", pa.string()), ("scope", pa.string()), ("file", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("language", pa.string()), ("params", pa.list_(pa.string())), ("returns", pa.string())])
    n = pa.struct([("id", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("line", pa.int64())])
    e = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("label", pa.string())])
    schema = pa.schema([("symbol_id", pa.int64()), ("function", f), ("nodes", pa.list_(n)), ("edges", pa.list_(e)), ("error", pa.string())])
    return functions.select("symbol_id", "path", "language", "name", "scope", "line", "content").mapInArrow(go, GRAPH)


def file_graphs(texts: DataFrame) -> DataFrame:
    """Graphs of every Rust and C# function with a body, straight from
    ``file_id, path, language, content``: texts stay where they are, nothing is
    joined.  ``file_id, line, name`` with ``nodes, edges, error`` as above."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from codeloom.flow.parse import functions

        for b in batches:
            rows = []
            for r in b.to_pylist():
                for g in functions(r["language"], r["content"] or "", r["path"]):
                    f = g["function"]
                    rows.append({"file_id": r["file_id"], "line": f["line"], "name": f["name"], "scope": f["scope"], "nodes": g["nodes"], "edges": g["edges"], "error": g["error"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    n = pa.struct([("id", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("line", pa.int64())])
    e = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("label", pa.string())])
    schema = pa.schema([("file_id", pa.int64()), ("line", pa.int64()), ("name", pa.string()), ("scope", pa.string()), ("nodes", pa.list_(n)), ("edges", pa.list_(e)), ("error", pa.string())])
    out = "file_id long, line long, name string, scope string, nodes array<struct<id:int,kind:string,label:string,line:long>>, edges array<struct<from:int,to:int,label:string>>, error string"
    use = texts.where(F.col("language").isin("rust", "csharp"))
    return spread(use.select("file_id", "path", "language", "content")).mapInArrow(go, out)


def node_rows(graphs: DataFrame) -> DataFrame:
    return graphs.where("error is null").select("symbol_id", F.inline("nodes"))


def edge_rows(graphs: DataFrame) -> DataFrame:
    return graphs.where("error is null").select("symbol_id", F.inline("edges"))


def rendered(graphs: DataFrame, how: str = "tree") -> DataFrame:
    """``graphs`` (with ``nodes``, ``edges``) and a column ``text``: each graph as ``tree`` or ``mermaid``; null where there is none."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from codeloom.flow import render

        draw = {"tree": render.tree, "mermaid": render.mermaid}[how]
        for b in batches:
            made = [None if n is None else draw({"nodes": n, "edges": e}) for n, e in zip(b.column("nodes").to_pylist(), b.column("edges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "text"])

    from pyspark.sql import types as T

    return graphs.mapInArrow(go, T.StructType([*graphs.schema, T.StructField("text", T.StringType())]))
