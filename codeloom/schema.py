"""Relations of the index."""

FILES = "id long, path string, content_hash string, language string, last_indexed_at timestamp"
SYMBOLS = "id long, name string, kind string, file_id long, line long, column long, end_line long, visibility string, scope string, docid string"
IMPORTS = "id long, source_file_id long, import_path string, alias string, names array<string>, resolved_file_id long"
REFERENCES = "id long, symbol_id long, file_id long, line long, column long, qualified boolean"
RAW_REFERENCES = "file_id long, symbol_name string, line long, column long, from_scope string, qualified boolean"
METADATA = "key string, value string"
RELATIONS = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "references": REFERENCES, "raw_references": RAW_REFERENCES, "metadata": METADATA}

# fixed values: what columns added later hold in older tables
DEFAULTS = {"symbols": {"end_line": 0, "visibility": "private", "scope": None, "docid": None}, "references": {"qualified": False}, "imports": {"alias": None, "resolved_file_id": None}}
KINDS = ("fn", "struct", "trait", "enum", "class", "interface", "type", "const", "mod")


def evolve(df, relation: str):
    """Add the columns an older table lacks, with their defaults, in schema order."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string as parse

    fields = parse(RELATIONS[relation]).fields
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(DEFAULTS.get(relation, {}).get(f.name))).cast(f.dataType).alias(f.name) for f in fields]
    )
