"""Queries of the general data-pipeline problems (quantities, differences, wide tables) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import reconcile, units, wide
from kgloom.session import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.measured_attributes(table(spark, sf, "entities")).select("entity_id", "attr_ix", "value_milli")


def p2_units(spark: SparkSession, sf: str) -> DataFrame:
    """All quantities, with whether another reading of the text would fit the record as well."""
    return units.measured_attributes(table(spark, sf, "entities"))


def p2_record_units(spark: SparkSession, sf: str) -> DataFrame:
    """The units that records mean, by the least log residuals against what their texts state."""
    got = units.record_units(table(spark, sf, "entities"))
    return got.withColumn("rms", F.round("rms", 4))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.differences(table(spark, sf, "triples"), table(spark, sf, "triples_copy"), "triple_id", ["s", "p", "o"], ("only_live", "only_copy"))


def _store(spark: SparkSession, sf: str) -> wide.WideStore:
    """The triples as a store of one run per month of loading."""
    store = wide.WideStore(spark, scratch(spark, "wide"), wide.datatype_properties(table(spark, sf, "tbox")))
    store.upsert(table(spark, sf, "triples"), F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("undated")))
    return store


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    return wide.cells(store.merged(), store.properties)


def p6_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table itself, with typed columns; dates, numbers and what is beyond their types as text for comparison."""
    store = _store(spark, sf)
    got = store.read()
    return got.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal") or t == "date" else F.col(c) for c, t in got.dtypes if c != "beyond"], F.map_keys("beyond").alias("beyond"))


P3_SQL = """
WITH a AS (SELECT DISTINCT triple_id, s, p, o FROM triples),
b AS (SELECT DISTINCT triple_id, s, p, o FROM triples_copy),
only_a AS (SELECT * FROM a WHERE triple_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.triple_id = a.triple_id)),
only_b AS (SELECT * FROM b WHERE triple_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.triple_id = b.triple_id)),
both_sides AS (SELECT a.triple_id, a.s AS s1, b.s AS s2, a.p AS p1, b.p AS p2, a.o AS o1, b.o AS o2 FROM a JOIN b ON a.triple_id = b.triple_id)
SELECT triple_id, 'only_live' AS diff FROM only_a x
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.triple_id IS NULL AND b.s IS NOT DISTINCT FROM x.s AND b.p IS NOT DISTINCT FROM x.p AND b.o IS NOT DISTINCT FROM x.o)
UNION ALL SELECT triple_id, 'only_copy' FROM only_b x
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.triple_id IS NULL AND a.s IS NOT DISTINCT FROM x.s AND a.p IS NOT DISTINCT FROM x.p AND a.o IS NOT DISTINCT FROM x.o)
UNION ALL SELECT triple_id, 's' FROM both_sides WHERE s1 IS DISTINCT FROM s2
UNION ALL SELECT triple_id, 'p' FROM both_sides WHERE p1 IS DISTINCT FROM p2
UNION ALL SELECT triple_id, 'o' FROM both_sides WHERE o1 IS DISTINCT FROM o2
"""

P6_SQL = r"""
WITH props AS (SELECT local_name, min(regexp_extract(range_iri, '[^#/:]*$')) AS r FROM tbox WHERE kind = 'datatype' AND local_name IS NOT NULL GROUP BY 1),
rows_ AS (
  SELECT regexp_extract(s, '[^#/:]*$') AS subject_local, local_name AS property_local, r,
         regexp_replace(o, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS t, loaded_at
  FROM triples JOIN props ON regexp_extract(p, '[^#/:]*$') = local_name
  WHERE o IS NOT NULL AND s IS NOT NULL),
parts AS (
  SELECT *, regexp_extract(t, '^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$', 1) AS sgn,
    regexp_extract(t, '^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$', 2) AS ip,
    regexp_extract(t, '^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$', 3) AS fp,
    coalesce(try_cast(nullif(regexp_extract(t, '^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$', 4), '') AS INT), 0) AS ex
  FROM rows_),
shifted AS (
  SELECT *, repeat('0', greatest(1 - (length(ip) + ex), 0)::BIGINT) || ip || fp || repeat('0', greatest(ex - length(fp), 0)::BIGINT) AS d,
    greatest(length(ip) + ex, 1) AS n FROM parts),
texts AS (
  SELECT subject_local, property_local, loaded_at, CASE
    WHEN r = 'integer' THEN CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN
      (CASE WHEN sgn = '-' AND ltrim(ip, '0') <> '' THEN '-' ELSE '' END) || coalesce(nullif(ltrim(ip, '0'), ''), '0') END
    WHEN r IN ('decimal', 'double') THEN CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN
      (CASE WHEN sgn = '-' AND trim(d, '0') <> '' THEN '-' ELSE '' END) || coalesce(nullif(ltrim(substr(d, 1, n), '0'), ''), '0')
      || CASE WHEN rtrim(substr(d, n + 1), '0') = '' THEN '' ELSE '.' || rtrim(substr(d, n + 1), '0') END END
    WHEN r = 'boolean' THEN CASE WHEN lower(t) IN ('true', '1') THEN 'true' WHEN lower(t) IN ('false', '0') THEN 'false' END
    WHEN r = 'date' THEN CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(t AS DATE) IS NOT NULL THEN t END
    ELSE nullif(t, '') END AS value_text
  FROM shifted)
SELECT subject_local, property_local, arg_max(value_text, {'v': loaded_at, 't': value_text}) AS value_text
FROM texts WHERE value_text IS NOT NULL AND subject_local <> '' GROUP BY 1, 2
"""

# The datatype properties of tbox, the same at every scale, by their ranges.
_WIDE = {
    "date": ("commissionedOn", "lastInspectedOn", "retiredOn"), "integer": ("cycleCount", "slotIndex", "spareCount", "trlLevel"), "decimal": ("doseKrad", "massKg", "powerDrawW"),
    "double": ("efficiency", "maxTempC"), "string": ("firmwareTag", "operatingMode", "serialNumber", "vendorName"), "boolean": ("flightProven", "isRedundant"),
}


def _wide_sql() -> str:
    columns, beyond = [], []
    for kind, names in _WIDE.items():
        for n in names:
            text = f"max(CASE WHEN property_local = '{n}' THEN value_text END)"
            if kind in ("integer", "decimal"):
                fits = f"regexp_full_match({text}, '{'-?[0-9]{1,26}(.[0-9]{1,12})?' if kind == 'decimal' else '-?[0-9]{1,38}'}')"
                columns.append(f"CASE WHEN {fits} THEN {text}::DECIMAL(38, {12 if kind == 'decimal' else 0})::VARCHAR END AS {n}")
                beyond.append(f"CASE WHEN NOT {fits} THEN '{n}' END")
            else:
                columns.append(f"{text}{'::' + kind.upper() if kind in ('double', 'boolean') else ''} AS {n}")
    return f"SELECT subject_local, {', '.join(columns)}, nullif(list_filter([{', '.join(beyond)}], lambda x: x IS NOT NULL), []) AS beyond FROM ({P6_SQL}) GROUP BY 1"


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_units": p2_units, "p2_record_units": p2_record_units, "p3_found": p3_found, "p6_found": p6_found, "p6_wide": p6_wide}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p6_found": P6_SQL, "p6_wide": _wide_sql()}
