"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import handwritten, mixing, packing, repetition, sourcecheck
from codeloom.llm.tokens import token_counts
from codeloom.session import materialize, table


def _detector(spark: SparkSession, d: str) -> handwritten.Detector:
    return handwritten.learn(*(table(spark, d, t) for t in ("source_tree", "files", "symbols", "package_files")))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return _detector(spark, d).apply(table(spark, d, "source_tree"), table(spark, d, "package_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).where("kind is not null").select("file_id")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d)


def p2_validation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each machine on repositories kept out of training."""
    found = _detector(spark, d).machines
    schema = "kind string, held_out_precision double, held_out_recall double, threshold double, gate double, gate_recall double"
    return spark.createDataFrame([(k, *(None if x is None else float(x) for x in (m.precision, m.recall, m.threshold, m.gate, m.gate_recall))) for k, m in found.items()], schema)


def p2_releases(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies of listed releases, those that are not found, and the vendored files with what their similarities say."""
    known = handwritten.with_known(table(spark, d, "source_tree").select("file_id", "content"), table(spark, d, "package_files")).where("release is not null").select("file_id")
    kinds = materialize(_kinds(spark, d), "kinds").select("file_id", "kind", "similarity")
    both = kinds.join(known.withColumn("known", F.lit(True)), "file_id", "left")
    vendored = F.col("kind").eqNullSafe("vendored")
    return both.agg(
        F.count_if("known").alias("copies"), F.count_if(F.col("known") & ~vendored).alias("missed"),
        F.count_if(vendored & (F.col("similarity") < handwritten.SIMILAR)).alias("unlike_any"), F.count(F.lit(1)).alias("files"),
    )


def _listed(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Files with symbols in the index, by language, and how many of them are in ``found``."""
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "language")
    s = table(spark, d, "symbols").select("file_id").distinct().join(f, "file_id")
    return s.join(found.distinct().withColumn("hit", F.lit(1)), "file_id", "left").groupBy("language").agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("found"))


def p2_listed(spark: SparkSession, d: str) -> DataFrame:
    """Only hand-written files have symbols in the index, so none of them may be found."""
    return _listed(spark, d, p2_found(spark, d))


def p5_listed(spark: SparkSession, d: str) -> DataFrame:
    """Only files that parse have symbols in the index, so none of them may be found."""
    return _listed(spark, d, p5_found(spark, d))


def _checked(spark: SparkSession, d: str, explain: bool = False) -> DataFrame:
    return sourcecheck.check_files(table(spark, d, "source_tree"), table(spark, d, "files"), explain)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("not valid").select("file_id")


def p5_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d, explain=True)


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return sourcecheck.rates(_checked(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.over_several(packing.packed_documents(table(spark, d, "documents")))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(table(spark, d, "documents"))


def p6_placement(spark: SparkSession, d: str) -> DataFrame:
    """Every document placed once and whole, no container overfull."""
    sizes = materialize(token_counts(table(spark, d, "documents"), ["doc_id"]), "sizes")
    return packing.placement_report(packing.pack(sizes), sizes)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.packed_documents(table(spark, d, "documents")))


def _mixed(spark: SparkSession, d: str):
    sizes = materialize(token_counts(table(spark, d, "documents"), ["doc_id", "source"]), "mix-sizes")
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p7_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mix: share within 0.5 % of its target, cap kept, every copy of a document of that source."""
    mixed, plan = _mixed(spark, d)
    mixed = materialize(mixed, "mixed")
    known = table(spark, d, "documents").select("doc_id", F.col("source").alias("_source"))
    stray = mixed.join(known, "doc_id", "left").groupBy("source").agg(
        (F.count(F.lit(1)) - F.count_if(F.col("source") == F.col("_source"))).alias("stray"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated")
    )
    report = mixing.shares(mixed, plan).join(stray, "source", "left")
    return report.select(
        "source", F.round("target_share", 9).alias("target_share"), "max_repeats", (F.abs(F.col("share") / F.col("target_share") - 1) <= 0.005).alias("share_met"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("cap_met"), "stray", "repeated",
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_kinds, p2_validation, p2_releases, p2_listed, p5_listed, p5_found, p5_verdicts, p5_rates, p6_found, p6_containers, p6_placement, p6_fill, p7_mix, p7_shares, p7_balance, p8_found, p8_shares)
}

# words, and the words of each sentence and paragraph with their places
_P8 = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\n[\t\r\f\v\x1c-\x1f\x85\p{Z}]*\n[\s\v\x1c-\x1f\x85\p{Z}]*', chr(1), 'g'), chr(1))) AS para,
    generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\n[\t\r\f\v\x1c-\x1f\x85\p{Z}]*\n[\s\v\x1c-\x1f\x85\p{Z}]*', chr(1), 'g'), chr(1)), 1) AS pi
  FROM documents),
sentences AS (
  SELECT doc_id, pi, unnest(string_split(regexp_replace(para, '([.!?])[\s\v\x1c-\x1f\x85\p{Z}]+', '\1' || chr(1), 'g'), chr(1))) AS sentence,
    generate_subscripts(string_split(regexp_replace(para, '([.!?])[\s\v\x1c-\x1f\x85\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), 1) AS si
  FROM parts),
split AS (SELECT doc_id, pi, si, regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+') AS ws FROM sentences),
placed AS (SELECT doc_id, pi, si, unnest(ws) AS w, generate_subscripts(ws, 1) AS wi FROM split),
words AS (SELECT doc_id, pi, si, w, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si, wi) AS k FROM placed),
runs AS (
  SELECT doc_id, k, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run,
    count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM words),
starts AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, run) >= 3 AS rep FROM runs WHERE n = 10),
phrases AS (
  SELECT doc_id, k, coalesce(bool_or(rep) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), false) AS ph
  FROM words LEFT JOIN starts USING (doc_id, k)),
"""

_LISTED = "SELECT language, count(DISTINCT file_id) AS listed, 0 AS found FROM symbols JOIN files ON files.id = file_id GROUP BY language"

SQL: dict[str, str] = {
    "p2_listed": _LISTED,
    "p5_listed": _LISTED,
    "p2_releases": """
SELECT count(*) FILTER (sha256(content) IN (SELECT lower(trim(content_hash)) FROM package_files)) AS copies, 0 AS missed, 0 AS unlike_any, count(*) AS files
FROM source_tree""",
    # words, numbers and marks, each of which takes a token at least; nothing lies near the limit
    "p6_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) > 4096",
    "p6_placement": "SELECT count(*) AS documents, 0 AS misplaced, 0 AS cut_needlessly, 0 AS overfull, 0 AS idle FROM documents",
    "p7_balance": """
WITH t AS (
  SELECT m.source, sum(m.weight) AS weight, min(m.max_repeats) AS max_repeats FROM mix_targets m
  WHERE m.weight > 0 AND m.max_repeats > 0 AND m.source IN (SELECT source FROM documents WHERE length(text) > 0) GROUP BY m.source)
SELECT source, round(weight / (SELECT sum(weight) FROM t), 9) AS target_share, max_repeats, true AS share_met, true AS cap_met, 0 AS stray, 0 AS repeated FROM t""",
    "p8_found": _P8 + "shares AS (SELECT doc_id, avg(CAST(ph AS INT)) AS s FROM phrases GROUP BY doc_id) SELECT doc_id FROM shares WHERE s >= 0.5",
    "p8_shares": _P8
    + r"""
s_text AS (SELECT doc_id, pi, si, count(*) OVER (PARTITION BY doc_id, ws) > 1 AS rep FROM split WHERE len(ws) > 0),
p_words AS (SELECT doc_id, pi, flatten(list(ws ORDER BY si)) AS ws FROM split GROUP BY doc_id, pi),
p_text AS (SELECT doc_id, pi, count(*) OVER (PARTITION BY doc_id, ws) > 1 AS rep FROM p_words WHERE len(ws) > 0),
marked AS (
  SELECT w.doc_id, CAST(ph AS INT) AS ph, CAST(s.rep AS INT) AS se, CAST(p.rep AS INT) AS pa FROM words w
  JOIN phrases USING (doc_id, k) JOIN s_text s USING (doc_id, pi, si) JOIN p_text p ON p.doc_id = w.doc_id AND p.pi = w.pi)
SELECT d.doc_id, count(ph) AS n_words, coalesce(avg(ph), 0) AS phrase_share, coalesce(avg(se), 0) AS sentence_share, coalesce(avg(pa), 0) AS paragraph_share,
  coalesce(avg(greatest(ph, se, pa)), 0) AS repeated_share
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
}
