"""Contributions of files to symbols, their survivors, and the queries over them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.jsonudf import strict_loads
from spandrel.functions.text import micros, plain_path
from spandrel.llm.survivorship import best_representatives
from spandrel.sources.tables import table

#: Values that say nothing (fixed values), compared without case and punctuation.
PLACEHOLDERS = ("todo", "none", "null", "unknown", "na", "tbd")


def _filled(v) -> str | None:
    if v is None:
        return None
    t = v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    bare = "".join(c for c in t if c.isalnum() or c.isspace()).strip().casefold()
    return None if not bare or bare in PLACEHOLDERS else t


def _contribution(text: str | None) -> tuple:
    try:
        d = strict_loads(text)
    except (ValueError, RecursionError, TypeError):
        return False, None, None, None, None
    d = d if isinstance(d, dict) else {}
    m = d.get("metadata")
    m = m if isinstance(m, dict) else {}
    decl = m.get("is_declaration")
    return (True, _filled(d.get("signature")), _filled(d.get("doc")), _filled(m.get("visibility")),
            decl is True or decl == "true" or (not isinstance(decl, bool) and isinstance(decl, (int, float)) and decl == 1))


def contribution(data: str) -> Column:
    """Fields of a contribution's JSON; a field that is not filled comes out null."""
    names = ["ok", "signature", "doc", "visibility", "declares"]

    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_contribution(x) for x in s], columns=names)

    # called nondeterministic so that the filter on its result doesn't have it evaluated twice
    return F.pandas_udf(parse, "ok boolean, signature string, doc string, visibility string, declares boolean").asNondeterministic()(data)


def survivors(node_files: DataFrame, *, values: bool, min_names: int) -> DataFrame:
    """Best representative per symbol over all its valid contributions."""
    c = node_files.select("symbol", plain_path("file").alias("file"), "is_def", "extracted_at", contribution("data").alias("c")).where("c.ok")
    trust = F.when(F.coalesce(F.col("is_def") == 1, ~F.col("c.declares")), 1).otherwise(0)
    fields = {f: F.col(f"c.{f}") for f in ("signature", "doc", "visibility")}
    return best_representatives(c, "symbol", fields, trust, micros("extracted_at"), F.col("file"), values=values, min_names=min_names)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = survivors(table(spark, d, "node_files", "symbol", "file", "is_def", "data", "extracted_at"), values=False, min_names=2)
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.source").alias("file")) for f in ("signature", "doc", "visibility")))
    return s.select("symbol", F.explode(pairs).alias("x")).select("symbol", "x.field_name", "x.file").where(F.col("file").isNotNull())


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every symbol, whatever its number of files."""
    s = survivors(table(spark, d, "node_files", "symbol", "file", "is_def", "data", "extracted_at"), values=True, min_names=1)
    return s.select("symbol", *(F.col(f"{f}.value").alias(f) for f in ("signature", "doc", "visibility")))


QUERIES = {"p3_found": p3_found, "p3_survivors": p3_survivors}

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"
_C = f"""
c0 AS (SELECT symbol, {_PLAIN.format('file')} AS file, extracted_at, CASE WHEN json_valid(data) THEN data END AS j, is_def FROM node_files),
c1 AS (SELECT symbol, file, extracted_at, is_def, json_extract_string(j, '$.signature') AS signature, json_extract_string(j, '$.doc') AS doc,
       json_extract_string(j, '$.metadata.visibility') AS visibility,
       coalesce(json_extract_string(j, '$.metadata.is_declaration') IN ('true', '1'), false) AS declares FROM c0 WHERE j IS NOT NULL),
c AS (SELECT symbol, file, extracted_at, CASE WHEN coalesce(is_def = 1, NOT declares) THEN 1 ELSE 0 END AS trust, signature, doc, visibility FROM c1),
u AS (SELECT symbol, file, extracted_at, trust, unnest(['signature', 'doc', 'visibility']) AS field_name, unnest([signature, doc, visibility]) AS v FROM c),
g AS (SELECT symbol FROM c GROUP BY 1 HAVING min(file) <> max(file)),
w AS (SELECT *, row_number() OVER (PARTITION BY symbol, field_name ORDER BY trust DESC, extracted_at DESC, file, v) AS rn FROM u
      WHERE lower(trim(regexp_replace(v, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'))) NOT IN ('', 'todo', 'none', 'null', 'unknown', 'na', 'tbd'))"""
_P3 = f"WITH {_C} SELECT symbol, field_name, file FROM w SEMI JOIN g USING (symbol) WHERE rn = 1"
_P3S = f"""WITH {_C}, a AS (SELECT DISTINCT symbol FROM c WHERE symbol IS NOT NULL)
SELECT a.symbol, s.v AS signature, d.v AS doc, x.v AS visibility FROM a
LEFT JOIN w s ON s.symbol = a.symbol AND s.rn = 1 AND s.field_name = 'signature'
LEFT JOIN w d ON d.symbol = a.symbol AND d.rn = 1 AND d.field_name = 'doc'
LEFT JOIN w x ON x.symbol = a.symbol AND x.rn = 1 AND x.field_name = 'visibility'"""


ORACLE = {"p3_found": _P3, "p3_survivors": _P3S}
