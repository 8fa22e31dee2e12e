"""Commands over the index of a folder: ``python -m codeloom.cli COMMAND``.

Exit codes: 0 done, 1 error, 2 no index.  With ``--json`` errors are objects on
standard error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.flow import render
from codeloom.flow.graph import FlowError
from codeloom.flow.parse import flow
from codeloom.operators.maintenance import stale_files, upsert_metadata
from codeloom.operators.snapshots import snapshot_diff
from codeloom.plans import refresh as R
from codeloom.plans.index import Index
from codeloom.schema import RELATIONS
from codeloom.sources import ndjson, vcs
from codeloom.sources.tree import LANGUAGES, read_tree
from codeloom.store import NoIndex, Store

FOLDER = ".codeloom"


@dataclass
class Target:
    name: str | None = None
    scope: str | None = None
    file: str | None = None
    #: the whole argument, to be read as a file where no symbol fits
    text: str = ""


def parse_target(text: str, scope: str | None = None, file: str | None = None) -> Target:
    """``path:name``, ``Scope.name``, a path, or a name.

    A last colon splits file and name; with ``scope`` or ``file`` given, or
    without slash, dot and known extension, the text is a name.
    """
    if scope or file:
        return Target(text, scope, file, text)
    head, colon, tail = text.rpartition(":")
    if colon and head and tail:
        return Target(tail, None, head, text)
    if "/" in text or text.rpartition(".")[2] in LANGUAGES and "." in text:
        return Target(None, None, text, text)
    parts = text.split(".")
    if len(parts) == 2 and all(parts):
        return Target(parts[1], parts[0], None, text)
    return Target(text, None, None, text)


class App:
    def __init__(self, spark: SparkSession, root: str, as_json: bool = False, compact: bool = False, quiet: bool = False):
        self.spark, self.root = spark, os.path.abspath(root)
        self.json, self.compact, self.quiet = as_json, compact, quiet
        self.store = Store(spark, f"file://{self.root}/{FOLDER}")

    # -- output --------------------------------------------------------------
    def say(self, value, text: str = "") -> None:
        if self.json:
            print(json.dumps(value, separators=(",", ":")) if self.compact else json.dumps(value, indent=2))
        elif text and not self.quiet:
            print(text)

    @staticmethod
    def rows(df: DataFrame) -> list[dict]:
        return [{k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in r.asDict(recursive=True).items()} for r in df.toLocalIterator()]

    def index(self) -> Index:
        if not self.store.exists():
            raise NoIndex("no index here; run init first")
        s = self.store
        return Index(s.read("files"), s.read("symbols"), s.read("imports"), s.read("references"))

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.store.read("metadata").collect()}

    # -- building ------------------------------------------------------------
    def _note(self, metadata: DataFrame, notes: dict) -> DataFrame:
        rows = [(k, v) for k, v in notes.items() if v]
        return upsert_metadata(metadata, self.spark.createDataFrame(rows, "key string, value string")) if rows else metadata

    def _commit(self, rel: dict, records: str | None = None, **notes) -> None:
        if records:
            rec = ndjson.read_records(self.spark, records)
            rel = R.with_semantic(rel, ndjson.definitions(rec), ndjson.references(rec))
        else:
            notes.setdefault("csharp_resolver", "treesitter")
        rel = {**rel, "metadata": self._note(rel["metadata"], notes)}
        self.store.write({k: v for k, v in rel.items() if k != "errors"})
        self.store.drop_old()

    def init(self, records: str | None = None) -> None:
        began = time.time()
        texts = read_tree(self.spark, self.root).persist()
        old = self.store.read("files") if self.store.exists() else self.spark.createDataFrame([], texts.select("path", "content_hash").schema)
        stats = texts.join(old.select("path", F.col("content_hash").alias("_o")), "path", "left").agg(
            F.count_if(F.col("content").isNotNull()).alias("files_indexed"),
            F.count_if(F.col("content").isNull()).alias("files_errored"),
            F.count_if(F.col("_o") == F.col("content_hash")).alias("files_unchanged"),
        ).first().asDict()
        self._commit(R.build(texts), records, last_indexed_commit=vcs.head_commit(self.root))
        texts.unpersist()
        out = {**stats, "symbols_found": self.store.read("symbols").count(), "imports_found": self.store.read("imports").count(), "seconds": round(time.time() - began, 2), "csharp_resolver": self.meta().get("csharp_resolver")}
        self.say(out, f"Indexed {out['files_indexed']} files ({out['symbols_found']} symbols) in {out['seconds']}s\nDatabase: {self.root}/{FOLDER}")

    def _stale(self) -> tuple[DataFrame, DataFrame] | None:
        commit = self.meta().get("last_indexed_commit")
        if not commit or not vcs.is_repository(self.root):
            return None
        current = read_tree(self.spark, self.root).select("path", "content_hash")
        return stale_files(self.store.read("files"), vcs.changes(self.spark, self.root, commit), current, list(LANGUAGES))

    def update(self) -> None:
        self.index()
        stale = self._stale()
        if stale is None:
            return self.init()
        modified, deleted = (d.persist() for d in stale)
        n, gone = modified.count(), deleted.count()
        commit = vcs.head_commit(self.root)
        warn = "semantic C# references are stale; run init" if self.meta().get("csharp_resolver") == "roslyn" and modified.where("path like '%.cs'").count() else None
        if n or gone:
            texts = read_tree(self.spark, self.root).join(modified, "path", "left_semi")
            self._commit(R.refresh(self.store.all(), texts, deleted), last_indexed_commit=commit, csharp_resolver=self.meta().get("csharp_resolver"))
        else:
            # only the commit moves: one small relation is written
            self.store.write({"metadata": self._note(self.store.read("metadata"), {"last_indexed_commit": commit})}, keep=[r for r in RELATIONS if r != "metadata"])
            self.store.drop_old()
        self.say({"files_indexed": n, "files_deleted": gone, "warning": warn}, f"Updated {n} files, deleted {gone}" + (f"\nwarning: {warn}" if warn else ""))

    # -- queries -------------------------------------------------------------
    def symbols(self, limit=None, offset=0, body=False, **filters) -> None:
        i = self.index()
        df = i.list_symbols(limit, offset, **filters)
        cols = ["name", "kind", "path", "line", "column", "end_line", "visibility", "scope"]
        found = self.rows(df.select(*cols))
        if body:
            cache: dict[str, list[str]] = {}
            for r in found:
                if r["path"] not in cache:
                    try:
                        with open(os.path.join(self.root, r["path"]), encoding="utf-8") as f:
                            cache[r["path"]] = f.read().splitlines()
                    except OSError:
                        cache[r["path"]] = []
                lines = cache[r["path"]][r["line"] - 1 : max(r["end_line"], r["line"])]
                r["body"] = "\n".join(lines) if lines else None
        text = "\n".join(f"{r['path']}:{r['line']}:{r['column']} {r['kind']} {r['visibility']} {r['scope'] + '.' if r['scope'] else ''}{r['name']}" + (f"\n{r['body']}" if r.get("body") else "") for r in found)
        if limit is None and not offset:
            return self.say(found, text)
        total = i.count_symbols(**filters).first()[0]
        self.say({"symbols": found, "total_count": total, "limit": limit, "offset": offset}, f"{text}\n({len(found)} of {total})")

    def deps(self, target: str, depth: int = 1, scope=None, file=None) -> None:
        i, t = self.index(), parse_target(target, scope, file)
        if t.name:
            defs = i.definitions(t.name, t.scope, t.file)
            found = self.rows(defs)
            if found or "." not in t.text:
                ids = self.spark.createDataFrame([(r["id"],) for r in found], "symbol_id long")
                uses = self.rows(i.attributed(ids).select("path", "line", "column").distinct().orderBy("path", "line", "column"))
                needs = [r["import_path"] for r in self.rows(i.symbol_dependencies(ids).select("import_path").distinct().orderBy("import_path"))]
                text = "\n".join([f"Definitions of {t.name}:", *(f"  {r['path']}:{r['line']}" for r in found), "Dependencies:", *(f"  {p}" for p in needs), "References:", *(f"  {r['path']}:{r['line']}:{r['column']}" for r in uses)])
                return self.say({"symbol": t.name, "definitions": found, "dependencies": needs, "references": uses}, text)
        path = t.text if not t.file or t.name else t.file
        out = {"file": path}
        for key, reverse in (("dependencies", False), ("dependents", True)):
            out[key] = [{"path": r["path"], "depth": r["depth"]} for r in self.rows(i.transitive(path, depth, reverse))] if depth > 1 or not reverse else [{"path": r["path"], "depth": 1} for r in self.rows(i.dependents(path))]
        lines = [line for key in ("dependencies", "dependents") for line in (f"{key.title()}:", *(f"  {r['path']}" + (f" (depth {r['depth']})" if depth > 1 else "") for r in out[key]))]
        self.say(out, "\n".join(lines))

    def flow(self, target: str, scope=None, file=None, line=None, mermaid=False) -> None:
        t = parse_target(target, scope, file)
        if not t.name:
            raise FlowError("flow needs a function name")
        found = self.rows(self.index().functions(t.name, t.scope, t.file, line).select("name", "scope", "path", "line", "language"))
        if len(found) != 1:
            where = ", ".join(f"{r['path']}:{r['line']}" for r in found)
            raise FlowError(f"no function {t.text}" if not found else f"{t.text} is ambiguous: {where}")
        r = found[0]
        with open(os.path.join(self.root, r["path"]), encoding="utf-8") as f:
            graph = flow(r["language"], f.read(), r["path"], r["name"], r["scope"], r["line"])
        self.say(graph, (render.mermaid if mermaid else render.tree)(graph).rstrip("\n"))

    def summary(self, prefix: str = "") -> None:
        i = self.index()
        s = self.rows(i.summary())
        part = lambda k: {r["key"]: r["n"] for r in s if r["section"] == k}
        dirs = self.rows(i.directories(prefix))
        lines = ["# Summary", *(f"- {k}: {v}" for k, v in part("totals").items()), "", "## Kinds", *(f"- {k}: {v}" for k, v in part("kinds").items()), "", "## Languages", *(f"- {k}: {v}" for k, v in part("languages").items()), "", "## Directories"]
        lines += [f"- {r['dir'] or '.'}/ ({r['n_files']} files, {r['n_symbols']} symbols)" for r in dirs]
        self.say({"totals": part("totals"), "total_symbols": sum(r["n_symbols"] for r in dirs), "kinds": part("kinds"), "languages": part("languages"), "directories": {r["dir"]: {"files": r["n_files"], "symbols": r["n_symbols"]} for r in dirs}}, "\n".join(lines))

    def diff(self) -> None:
        self.index()
        stale = self._stale()
        if stale is None:
            return self.say({"added": [], "removed": [], "modified": []}, "No changes")
        modified, deleted = stale
        texts = read_tree(self.spark, self.root).join(modified, "path", "left_semi")
        new = R.build(texts)
        at = lambda sym, files: sym.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        touched = modified.unionByName(deleted)
        old = at(self.store.read("symbols"), self.store.read("files").join(touched, "path", "left_semi"))
        found = self.rows(snapshot_diff(old, at(new["symbols"], new["files"]), ["path", "name"], ["line", "end_line", "kind", "visibility"], ["line"]).orderBy("path", "name"))
        out: dict[str, list] = {"added": [], "removed": [], "modified": []}
        for r in found:
            out[r["change_kind"]].append({"path": r["path"], "name": r["name"], "kind": r["new_kind"] or r["old_kind"], "line": r["old_line"] if r["change_kind"] == "removed" else r["new_line"], **({"old_line": r["old_line"]} if r["change_kind"] == "modified" else {})})
        mark = {"added": "+", "removed": "-", "modified": "~"}
        self.say(out, "\n".join(f"{mark[k]} {x['path']}:{x['line']} {x['kind']} {x['name']}" for k in out for x in out[k]) or "No changes")

    def status(self) -> None:
        if not self.store.exists():
            return self.say({"indexed": False}, "Not indexed")
        i, meta = self.index(), self.meta()
        stale = self._stale()
        n = (stale[0].count() + stale[1].count()) if stale else None
        totals = {r["relation"]: r["n"] for r in self.rows(i.totals())}
        langs = {r["language"]: r["n"] for r in self.rows(i.files_by_language())}
        head = vcs.head_commit(self.root)
        out = {"indexed": True, **totals, "languages": langs, "last_indexed_commit": meta.get("last_indexed_commit"), "head_commit": head, "stale_files": n, "csharp_resolver": meta.get("csharp_resolver")}
        lines = [f"Files: {totals['files']}", f"Symbols: {totals['symbols']}", f"Imports: {totals['imports']}", *(f"  {k}: {v}" for k, v in langs.items()), f"Indexed commit: {(meta.get('last_indexed_commit') or '-')[:7]}", f"HEAD: {(head or '-')[:7]}", f"Stale files: {n if n is not None else 'unknown'}", f"C# resolver: {meta.get('csharp_resolver')}"]
        self.say(out, "\n".join(lines))

    def files(self, language=None) -> None:
        found = self.rows(self.index().files_with_counts(language))
        wide = max([4, *(len(r["path"]) for r in found)])
        lines = [f"{'PATH':<{wide}}  {'LANGUAGE':<10}  SYMBOLS  IMPORTS", *(f"{r['path']:<{wide}}  {r['language']:<10}  {r['symbol_count']:>7}  {r['import_count']:>7}" for r in found)]
        self.say(found, "\n".join(lines))

    def export(self, limit=None, offset=0) -> None:
        found = self.rows(self.index().export(limit, offset))
        lines = ["# Index"]
        for r in found:
            lines += ["", f"## {r['path']} ({r['language']})", *(f"- {s['kind']} {s['scope'] + '.' if s['scope'] else ''}{s['name']} :{s['line']}" for s in r["symbols"]), *(f"- import {p}" for p in r["imports"])]
        self.say(found, "\n".join(lines))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--root", default=".")
    for flag in ("--json", "--compact", "--quiet"):
        p.add_argument(flag, action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--records", help="NDJSON of a semantic helper")
    sub.add_parser("update")
    c = sub.add_parser("symbols")
    for a in ("kind", "file", "scope", "visibility", "name", "language"):
        c.add_argument(f"--{a}")
    c.add_argument("--grep", dest="pattern")
    c.add_argument("--body", action="store_true")
    for x in (c, e := sub.add_parser("export")):
        x.add_argument("--limit", type=int)
        x.add_argument("--offset", type=int, default=0)
    c = sub.add_parser("deps")
    c.add_argument("target")
    c.add_argument("--depth", type=int, default=1)
    for x in (c, f := sub.add_parser("flow")):
        x.add_argument("--scope")
        x.add_argument("--file")
    f.add_argument("target")
    f.add_argument("--line", type=int)
    f.add_argument("--mermaid", action="store_true")
    sub.add_parser("summary").add_argument("prefix", nargs="?", default="")
    sub.add_parser("diff")
    sub.add_parser("status")
    sub.add_parser("files").add_argument("--language")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    as_json, compact, quiet, root, command = (args.pop(k) for k in ("json", "compact", "quiet", "root", "command"))
    spark = spark or SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        getattr(App(spark, root, as_json or compact, compact, quiet), command)(**args)
        return 0
    except Exception as e:  # noqa: BLE001
        code = 2 if isinstance(e, NoIndex) else 1
        print(json.dumps({"error": str(e), "code": code}) if as_json or compact else f"error: {e}", file=sys.stderr)
        return code


if __name__ == "__main__":
    sys.exit(main())
