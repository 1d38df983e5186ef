"""Queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.functions.lexical import OWL, RDF_TYPE, RDFS
from kgloom.functions import render
from kgloom.operators import align, conflicts, documents, evaluate, generate, graph, rules, synthesis
from kgloom.plans import pipelines
from kgloom.providers import functions as llm_functions
from kgloom.providers import get_provider
from kgloom.session import scratch, table
from kgloom.sources.files import with_markdown
from kgloom.sources.rdf import load_graph, read_ntriples, save_graph, to_ntriples

Query = Callable[[SparkSession, str], DataFrame]
FLEET = "http://kg.example.org/fleet#"
KG = "urn:kg#"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# The fleet graph: the instance rows of `triples` (or `triples_copy`) with prefixes expanded, and the
# schema rows of `tbox`.


def _expanded(c: str) -> Column:
    return F.when(F.col(c).startswith("kg:"), F.concat(F.lit(FLEET), F.substring(F.col(c), F.lit(4), F.length(c)))).otherwise(F.col(c)).alias(c)


def fleet(spark: SparkSession, sf: str, name: str = "triples") -> DataFrame:
    abox = table(spark, sf, name).where(F.col("o").isNotNull()).select(_expanded("s"), "s_kind", _expanded("p"), "o", "o_kind", "o_datatype", "o_lang")
    kind = F.when(F.col("kind") == "class", OWL + "Class").when(F.col("kind") == "datatype", OWL + "DatatypeProperty").otherwise(OWL + "ObjectProperty")
    iri = F.concat(F.lit(FLEET), F.col("local_name"))
    tbox = table(spark, sf, "tbox").select(F.inline(F.array(graph.triple(iri, RDF_TYPE, kind, "iri"), graph.triple(iri, RDFS + "range", F.col("range_iri"), "iri")))).where(F.col("o").isNotNull())
    return abox.unionByName(tbox).distinct()


def _graph_sql(name: str, source: str) -> str:
    def x(c: str) -> str:
        return f"CASE WHEN {c} LIKE 'kg:%' THEN '{FLEET}' || substr({c}, 4) ELSE {c} END AS {c}"

    return f"""{name} AS (
  SELECT {x('s')}, s_kind, {x('p')}, o, o_kind, o_datatype, o_lang FROM {source} WHERE o IS NOT NULL
  UNION SELECT '{FLEET}' || local_name, 'iri', '{RDF_TYPE}', CASE kind WHEN 'class' THEN '{OWL}Class' WHEN 'datatype' THEN '{OWL}DatatypeProperty' ELSE '{OWL}ObjectProperty' END, 'iri', NULL, NULL FROM tbox
  UNION SELECT '{FLEET}' || local_name, 'iri', '{RDFS}range', range_iri, 'iri', NULL, NULL FROM tbox WHERE range_iri IS NOT NULL)"""


_SCHEMA = "(" + ", ".join(f"'{t}'" for t in graph.SCHEMA_TYPES) + ")"


def _ind_sql(name: str, g: str) -> str:
    return f"""{name} AS (SELECT s FROM {g} WHERE p = '{RDF_TYPE}' GROUP BY s
  HAVING bool_or(o = '{graph.NAMED_INDIVIDUAL}') OR (bool_or(o NOT IN {_SCHEMA}) AND NOT bool_or(o IN {_SCHEMA})))"""


_G = _graph_sql("g", "triples")
_W = _graph_sql("w", "triples_copy")
_I = _ind_sql("ind", "g")
_ID = "left(sha256(s || '|' || p || '|' || o), 16)"


@query(f"WITH {_G}, {_I} SELECT s FROM ind")
def abox_individuals(spark: SparkSession, sf: str) -> DataFrame:
    return graph.individuals(fleet(spark, sf))


@query(f"WITH {_G} SELECT s FROM g WHERE p = '{RDF_TYPE}' AND s LIKE '{FLEET}%' GROUP BY s HAVING NOT bool_or(o IN {_SCHEMA})")
def abox_individuals_conflict_variant(spark: SparkSession, sf: str) -> DataFrame:
    return graph.individuals_in(fleet(spark, sf), FLEET)


def _bag(props: str = "props") -> Column:
    return F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("bag")


def _bag_sql(rows: str, sep: str) -> str:
    """Per s the sorted ``k=v`` texts of rows (s, k, v)."""
    return f"""SELECT s, string_agg(k || '=' || v, '|' ORDER BY k) AS bag FROM (
  SELECT s, k, string_agg(v, '{sep}' ORDER BY v) AS v FROM (SELECT DISTINCT s, k, v FROM ({rows})) GROUP BY s, k) GROUP BY s"""


@query(f"""WITH {_G}, t AS (SELECT DISTINCT s FROM g WHERE p = '{RDF_TYPE}' AND o = '{FLEET}Thruster'),
b AS ({_bag_sql(f"SELECT s, regexp_extract(p, '[^#/]*$') AS k, o AS v FROM g WHERE p <> '{RDF_TYPE}' AND s IN (SELECT s FROM t)", ', ')})
SELECT t.s, coalesce(bag, '') AS bag FROM t LEFT JOIN b USING (s)""")
def type_scan_bag(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_scan(fleet(spark, sf), FLEET + "Thruster").select("s", _bag())


@query(f"""WITH {_G}, i AS (SELECT s FROM g WHERE p = '{RDF_TYPE}' AND s LIKE '{FLEET}%' GROUP BY s HAVING NOT bool_or(o IN {_SCHEMA}))
{_bag_sql(f"SELECT s, CASE WHEN p = '{RDF_TYPE}' THEN 'rdf_type' ELSE regexp_extract(p, '[^#/]*$') END AS k, replace(o, '{FLEET}', '') AS v FROM g WHERE s IN (SELECT s FROM i)", '; ')}""")
def conflict_bags(spark: SparkSession, sf: str) -> DataFrame:
    return graph.conflict_bags(fleet(spark, sf), FLEET).select("s", _bag())


@query(f"WITH {_G}, {_I} SELECT DISTINCT s, p, o FROM g WHERE s IN (SELECT s FROM ind) AND NOT (p = '{RDF_TYPE}' AND o = '{graph.NAMED_INDIVIDUAL}')")
def subject_triples(spark: SparkSession, sf: str) -> DataFrame:
    g = fleet(spark, sf)
    return graph.subject_triples(g, graph.individuals(g))


@query(f"WITH {_G}, {_I} SELECT DISTINCT {_ID} AS id, s, p, o FROM g WHERE s IN (SELECT s FROM ind)")
def owl_to_delta_ids(spark: SparkSession, sf: str) -> DataFrame:
    return graph.to_delta(fleet(spark, sf)).select("id", "s", "p", "o").distinct()


@query(f"WITH {_G} SELECT p, count(*) AS n FROM g WHERE s_kind <> 'bnode' AND o_kind <> 'bnode' GROUP BY p")
def triple_pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.statements(fleet(spark, sf)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT s, p, o, o_kind FROM g WHERE s = '{FLEET}FleetRegistry' UNION ALL SELECT s, p, o, o_kind FROM g WHERE o = '{FLEET}FleetRegistry' AND o_kind = 'iri'")
def neighbors_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbors(fleet(spark, sf), FLEET + "FleetRegistry")


@query(f"WITH {_G} SELECT DISTINCT a.s AS x, a.o AS y, b.o AS z FROM g a JOIN g b ON a.o = b.s WHERE a.p = '{FLEET}partOf' AND b.p = '{FLEET}connectsTo'")
def bgp_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.match_patterns(fleet(spark, sf), [("?x", FLEET + "partOf", "?y"), ("?y", FLEET + "connectsTo", "?z")])


@query(f"WITH {_G}, {_W}, {_I} SELECT DISTINCT s, p, o FROM g WHERE s NOT IN (SELECT s FROM ind) AND o NOT IN (SELECT s FROM ind)")
def tbox_copy(spark: SparkSession, sf: str) -> DataFrame:
    """The schema of the fleet into an empty graph: every statement about no individual."""
    g = fleet(spark, sf)
    return graph.copy_tbox(g, graph.empty_graph(spark)).select("s", "p", "o").distinct()


@query(f"""SELECT kind, local_name, CASE WHEN kind = 'datatype' THEN regexp_extract(range_iri, '[^#/]*$') END AS range_local FROM tbox""")
def tbox_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tbox_summary(fleet(spark, sf), FLEET)


@query(f"""WITH {_G}, c AS (SELECT DISTINCT s FROM g WHERE p = '{RDF_TYPE}' AND o = '{OWL}Class'), n AS (SELECT CASE WHEN s LIKE '%#%' THEN regexp_extract(s, '^(.*#)', 1) ELSE regexp_extract(s, '^(.*/)', 1) END AS namespace, count(*) AS n FROM c GROUP BY 1)
SELECT namespace, n FROM n ORDER BY n DESC, namespace LIMIT 1""")
def namespace_tbox(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tbox_namespace(fleet(spark, sf))


@query(f"WITH {_G} SELECT regexp_extract(s, '^(.*#)', 1) AS namespace, count(*) AS n FROM g WHERE s NOT LIKE 'http://www.w3.org/%' AND s NOT LIKE 'http://purl.org/%' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def namespace_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_namespace(fleet(spark, sf))


@query(f"WITH {_G}, {_I}, d AS (SELECT s FROM ind), n AS (SELECT regexp_extract(s, '^(.*#)', 1) AS namespace, count(*) AS n FROM d GROUP BY 1) SELECT namespace, n FROM n WHERE n * 2 >= (SELECT sum(n) FROM n) ORDER BY n DESC, 1 LIMIT 1")
def namespace_individuals(spark: SparkSession, sf: str) -> DataFrame:
    g = fleet(spark, sf)
    named = graph.individuals(g).select("s", F.lit("iri").alias("s_kind"), F.lit(RDF_TYPE).alias("p"), F.lit(graph.NAMED_INDIVIDUAL).alias("o"))
    return graph.individual_namespace(named)


_BOTH = f"{_G}, {_W}, {_ind_sql('gi', 'g')}, {_ind_sql('wi', 'w')}, gt AS (SELECT DISTINCT s, p, o FROM g WHERE s IN (SELECT s FROM gi)), wt AS (SELECT DISTINCT s, p, o FROM w WHERE s IN (SELECT s FROM wi))"


def _prf_sql(level: str, a: str, b: str) -> str:
    return f"""SELECT '{level}' AS level, n_source, n_working, recovered, n_source - recovered AS missed, n_working - recovered AS extra,
  coalesce(recovered / nullif(n_working, 0), 0.0)::DOUBLE AS precision, coalesce(recovered / nullif(n_source, 0), 0.0)::DOUBLE AS recall,
  coalesce(2 * (recovered / nullif(n_working, 0)) * (recovered / nullif(n_source, 0)) / nullif((recovered / nullif(n_working, 0)) + (recovered / nullif(n_source, 0)), 0), 0.0)::DOUBLE AS f1
  FROM (SELECT (SELECT count(*) FROM {a}) AS n_source, (SELECT count(*) FROM {b}) AS n_working, (SELECT count(*) FROM (SELECT * FROM {a} INTERSECT SELECT * FROM {b})) AS recovered)"""


@query(f"WITH {_BOTH} {_prf_sql('individuals', 'gi', 'wi')} UNION ALL {_prf_sql('triples', 'gt', 'wt')}")
def eval_graphs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.evaluate(fleet(spark, sf), fleet(spark, sf, "triples_copy"))


@query(f"""WITH {_BOTH} SELECT *, 'recovered' AS side FROM (SELECT * FROM gt INTERSECT SELECT * FROM wt)
UNION ALL SELECT *, 'missed' FROM (SELECT * FROM gt EXCEPT SELECT * FROM wt) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM wt EXCEPT SELECT * FROM gt)""")
def missed_extra(spark: SparkSession, sf: str) -> DataFrame:
    g, w = fleet(spark, sf), fleet(spark, sf, "triples_copy")
    return evaluate.classify(graph.subject_triples(g, graph.individuals(g)), graph.subject_triples(w, graph.individuals(w)), ["s", "p", "o"])


_DIFF = f"{_G}, {_W}, a AS (SELECT DISTINCT s, p, o FROM g), b AS (SELECT DISTINCT s, p, o FROM w)"


@query(f"WITH {_DIFF} SELECT *, 'added' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def graph_diff(spark: SparkSession, sf: str) -> DataFrame:
    return graph.difference(fleet(spark, sf, "triples_copy"), fleet(spark, sf))


@query(f"WITH {_DIFF}, d AS (SELECT * FROM b EXCEPT SELECT * FROM a) SELECT {_ID} AS id, s, p, o FROM d WHERE {_ID} NOT IN (SELECT triple_id FROM triples WHERE triple_id IS NOT NULL)")
def snapshot_manual_entries(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "triples").select(F.col("triple_id").alias("id"))
    return graph.manual_entries(fleet(spark, sf), fleet(spark, sf, "triples_copy"), known).select("id", "s", "p", "o")


_F7 = "s, s_kind, p, o, o_kind, o_datatype, o_lang"


@query(f"""WITH {_G}, {_W}, u AS (SELECT {_F7} FROM g UNION SELECT {_F7} FROM w), r AS (SELECT {_F7} FROM g EXCEPT SELECT {_F7} FROM w)
SELECT 'added' AS op, count(*) AS n FROM u UNION ALL SELECT 'removed', count(*) FROM r""")
def graph_add_remove(spark: SparkSession, sf: str) -> DataFrame:
    g, w = fleet(spark, sf), fleet(spark, sf, "triples_copy")
    return graph.add(g, w).agg(F.lit("added").alias("op"), F.count(F.lit(1)).alias("n")).unionAll(graph.remove(g, w).agg(F.lit("removed"), F.count(F.lit(1))))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario 1 re-weighs every thruster that something is part of; scenario 2 sets one of an unknown subject."""
    g = fleet(spark, sf)
    thrusters = graph.match_patterns(g, [("?x", FLEET + "partOf", "?y"), ("?y", RDF_TYPE, FLEET + "Thruster")]).select(F.col("y").alias("s")).distinct()
    one = thrusters.select(F.lit("1").alias("scenario_id"), "s", F.lit(FLEET + "massKg").alias("p"), F.lit("999.5").alias("new_value"))
    return one.unionAll(spark.range(1).select(F.lit("2"), F.lit(FLEET + "Nowhere"), F.lit(FLEET + "massKg"), F.lit("1")))


_CHANGES = f"""ch AS (SELECT DISTINCT '1' AS scenario_id, y.s, '{FLEET}massKg' AS p, '999.5' AS new_value FROM g x JOIN g y ON x.o = y.s WHERE x.p = '{FLEET}partOf' AND y.p = '{RDF_TYPE}' AND y.o = '{FLEET}Thruster'
  UNION ALL SELECT '2', '{FLEET}Nowhere', '{FLEET}massKg', '1')"""


@query(f"""WITH {_G}, {_CHANGES}, k AS (SELECT DISTINCT c.scenario_id, g.s, g.p, g.o, g.o_datatype FROM g CROSS JOIN (SELECT DISTINCT scenario_id FROM ch) c
  WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.scenario_id = c.scenario_id AND ch.s = g.s AND ch.p = g.p)),
n AS (SELECT scenario_id, s, p, new_value AS o, coalesce((SELECT min(o_datatype) FROM g WHERE g.s = ch.s AND g.p = ch.p AND g.o_kind = 'literal'), 'http://www.w3.org/2001/XMLSchema#decimal') AS o_datatype FROM ch)
SELECT scenario_id, p, o_datatype, count(*) AS n, count(DISTINCT s) AS n_subjects FROM (SELECT * FROM k UNION SELECT * FROM n) GROUP BY 1, 2, 3""")
def apply_change(spark: SparkSession, sf: str) -> DataFrame:
    return graph.apply_changes(fleet(spark, sf), _changes(spark, sf)).groupBy("scenario_id", "p", "o_datatype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("n_subjects"))


@query(f"""WITH {_G}, m AS (SELECT DISTINCT s AS old, '{FLEET}' || replace(substr(s, {len(FLEET) + 1}), 'StarTracker', 'Tracker') AS new FROM g WHERE s LIKE '{FLEET}StarTracker%')
SELECT DISTINCT coalesce(a.new, g.s) AS s, g.p, CASE WHEN g.o_kind = 'iri' THEN coalesce(b.new, g.o) ELSE g.o END AS o, o_datatype FROM g LEFT JOIN m a ON a.old = g.s LEFT JOIN m b ON b.old = g.o""")
def iri_remap(spark: SparkSession, sf: str) -> DataFrame:
    g = fleet(spark, sf)
    local = F.substring(F.col("s"), F.lit(len(FLEET) + 1), F.length("s"))
    m = g.where(F.col("s").startswith(FLEET + "StarTracker")).select(local.alias("old"), F.replace(local, F.lit("StarTracker"), F.lit("Tracker")).alias("new")).distinct()
    return graph.remap_iris(g, m, FLEET).select("s", "p", "o", "o_datatype").distinct()


@query(f"""WITH {_G} SELECT CASE WHEN s_kind = 'bnode' THEN s ELSE '<' || s || '>' END || ' <' || p || '> ' || CASE WHEN o_kind = 'literal' THEN
  '"' || replace(replace(replace(replace(replace(o, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' || CASE WHEN o_datatype IS NOT NULL THEN '^^<' || o_datatype || '>' WHEN o_lang IS NOT NULL THEN '@' || o_lang ELSE '' END
  WHEN o_kind = 'bnode' THEN o ELSE '<' || o || '>' END || ' .' AS value FROM g""")
def ntriples_lines(spark: SparkSession, sf: str) -> DataFrame:
    return to_ntriples(fleet(spark, sf))


# The relational graph: rows of the star schema as individuals.

# table, class, key, attributes (property, SQL expression of its text, object kind)
_RELATIONAL = (
    ("region", "Region", "r_regionkey", (("name", "r_name", "literal"),)),
    ("nation", "Nation", "n_nationkey", (("name", "n_name", "literal"), ("inRegion", f"concat('{KG}Region_', n_regionkey)", "iri"))),
    ("supplier", "Supplier", "s_suppkey", (("name", "s_name", "literal"), ("acctBal", "CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING)", "literal"), ("inNation", f"concat('{KG}Nation_', s_nationkey)", "iri"))),
    ("part", "Part", "p_partkey", (("name", "p_name", "literal"), ("size", "CAST(p_size AS STRING)", "literal"), ("retailPrice", "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING)", "literal"))),
    ("customer", "Customer", "c_custkey", (("name", "c_name", "literal"), ("acctBal", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING)", "literal"), ("segment", "c_mktsegment", "literal"))),
)


def relational(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, cls, key, attributes in _RELATIONAL:
        s = F.expr(f"concat('{KG}{cls}_', {key})")
        rows = [graph.triple(s, RDF_TYPE, F.lit(KG + cls), "iri"), *[graph.triple(s, KG + p, F.expr(e), k) for p, e, k in attributes]]
        part = table(spark, sf, name).select(F.inline(F.array(*rows))).where(F.col("o").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


_R = "r AS (" + " UNION ALL ".join(
    f"SELECT concat('{KG}{cls}_', {key}) AS s, {prop} AS p, {e} AS o, '{k}' AS o_kind FROM {name} WHERE ({e}) IS NOT NULL"
    for name, cls, key, attributes in _RELATIONAL
    for prop, e, k in ((f"'{RDF_TYPE}'", f"'{KG}{cls}'", "iri"), *[(f"'{KG}{p}'", e, k) for p, e, k in attributes])
) + ")"


@query(f"WITH {_R} SELECT s, p, o, o_kind FROM r")
def kg_triples(spark: SparkSession, sf: str) -> DataFrame:
    return relational(spark, sf).select("s", "p", "o", "o_kind")


# rule_id, subject_type, object_type, attribute, operator, value, unit, severity, aggregate, expected_violated
_RULES = (
    ("r1", "Nation", "Supplier", "acctBal", "<", "0", "USD", "critical", "each", True),
    ("r2", "Region", "Part", "retailPrice", ">", "1900", "USD", "warning", "each", True),
    ("r3", "Customer", None, "acctBal", "<", "-900", "USD", "warning", "each", True),
    ("r4", None, "Supplier", "acctBal", ">=", "9900.5", "USD", "warning", "each", True),
    ("r5", "Nation", "Supplier", "acctBal", ">", "300000", "USD", "critical", "sum", True),
    ("r6", "Region", "Part", "size", ">", "50", None, "warning", "max", False),
    ("r7", "Region", "Part", "size", "!=", "1", None, "warning", "min", False),
    ("r8", "Customer", None, "segment", "==", "MACHINERY", None, "info", "each", True),
    ("r9", "Region", "Customer", "acctBal", "<=", "4000", "USD", "info", "avg", False),
    ("r10", "Nation", "Nowhere", "acctBal", "<", "0", "USD", "info", "each", False),
)
_RULE_COLUMNS = "rule_id, subject_type, object_type, attribute, operator, value, unit, severity, aggregate, expected_violated"


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "rule_id string, subject_type string, object_type string, attribute string, operator string, value string, unit string, severity string, aggregate string, expected_violated boolean").withColumn("ord", F.substring("rule_id", 2, 9).cast("int"))


def _values(rows: tuple, name: str, columns: str) -> str:
    def lit(x: object) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def _compare_sql(v: str, op: str, t: str) -> str:
    both = f"try_cast({v} AS DOUBLE) IS NOT NULL AND try_cast({t} AS DOUBLE) IS NOT NULL"
    return "CASE " + " ".join(f"WHEN {op} = '{o}' THEN CASE WHEN {both} THEN try_cast({v} AS DOUBLE) {q} try_cast({t} AS DOUBLE) ELSE {v} {q} {t} END" for o, q in ((">", ">"), ("<", "<"), (">=", ">="), ("<=", "<="), ("==", "="), ("!=", "<>"))) + " END"


_FACTS = f"""{_R}, ty AS (SELECT DISTINCT s, regexp_extract(o, '[^#/]*$') AS cls FROM r WHERE p = '{RDF_TYPE}'),
facts AS (SELECT DISTINCT cls, r.s, regexp_extract(p, '[^#/]*$') AS attribute, o AS value FROM r JOIN ty ON ty.s = r.s WHERE p <> '{RDF_TYPE}'),
{_values(_RULES, 'rules', _RULE_COLUMNS)},
one AS (SELECT cls, s, attribute, min(value) AS value FROM facts GROUP BY 1, 2, 3),
ov AS (SELECT rule_id, subject_type, object_type, ty.s AS object, one.value, coalesce({_compare_sql('one.value', 'operator', 'rules.value')}, FALSE) AS violated
  FROM rules JOIN ty ON ty.cls = coalesce(object_type, subject_type) LEFT JOIN one ON one.cls = ty.cls AND one.s = ty.s AND one.attribute = rules.attribute WHERE aggregate = 'each'),
pairs AS (SELECT rule_id, ty.s AS subject, object, value, violated FROM ov JOIN ty ON ty.cls = subject_type WHERE object_type IS NOT NULL
  UNION ALL SELECT rule_id, CASE WHEN object_type IS NULL THEN object END, CASE WHEN object_type IS NOT NULL THEN object END, value, violated FROM ov WHERE object_type IS NULL OR subject_type IS NULL)"""


def _each(spark: SparkSession) -> DataFrame:
    return rule_table(spark).where(F.col("aggregate") == "each")


@query(f"WITH {_FACTS} SELECT rule_id, subject, object, value, violated FROM pairs")
def rules_pairs(spark: SparkSession, sf: str) -> DataFrame:
    g = relational(spark, sf)
    return rules.check_pairs(_each(spark), rules.typed_subjects(g), rules.typed_facts(g))


@query(f"WITH {_FACTS} SELECT r.rule_id, count(p.rule_id) AS n_pairs, count(CASE WHEN violated THEN 1 END) AS n_violated FROM rules r LEFT JOIN pairs p ON p.rule_id = r.rule_id WHERE aggregate = 'each' GROUP BY 1")
def rules_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = relational(spark, sf)
    return rules.pair_counts(_each(spark), rules.typed_subjects(g), rules.typed_facts(g))


@query(f"WITH {_FACTS} SELECT rule_id, object, value, violated FROM ov WHERE object_type IS NULL")
def rules_single(spark: SparkSession, sf: str) -> DataFrame:
    g = relational(spark, sf)
    return rules.object_verdicts(_each(spark).where(F.col("object_type").isNull()), rules.typed_subjects(g), rules.typed_facts(g))


@query(f"""WITH {_FACTS}, a AS (SELECT rule_id, operator, r.value AS threshold, CASE aggregate WHEN 'sum' THEN sum(try_cast(f.value AS DOUBLE)) WHEN 'min' THEN min(try_cast(f.value AS DOUBLE)) WHEN 'max' THEN max(try_cast(f.value AS DOUBLE))
  WHEN 'avg' THEN avg(try_cast(f.value AS DOUBLE)) ELSE count(try_cast(f.value AS DOUBLE)) END AS value FROM rules r LEFT JOIN facts f ON f.cls = coalesce(object_type, subject_type) AND f.attribute = r.attribute WHERE aggregate <> 'each' GROUP BY rule_id, operator, r.value, aggregate)
SELECT rule_id, round(value, 2) AS value, coalesce({_compare_sql('CAST(value AS STRING)', 'operator', 'threshold')}, FALSE) AS violated FROM a""")
def rules_sum(spark: SparkSession, sf: str) -> DataFrame:
    got = rules.check_aggregates(rule_table(spark), rules.typed_facts(relational(spark, sf)))
    return got.select("rule_id", F.round("value", 2).alias("value"), "violated")


@query(f"""WITH {_FACTS} SELECT p.rule_id, p.object, regexp_extract(coalesce(p.object, p.subject), '[^#/]*$') || ' · ' || attribute || ' = ' || p.value || coalesce(' ' || unit, '') AS source_ref
FROM pairs p JOIN rules USING (rule_id) WHERE violated""")
def rule_source_refs(spark: SparkSession, sf: str) -> DataFrame:
    v = rules_pairs(spark, sf).where("violated")
    return rules.source_refs(v, rule_table(spark)).select("rule_id", "object", "source_ref")


@query(f"WITH {_FACTS} SELECT rule_id, count(*) AS n, count(CASE WHEN violated THEN 1 END) AS n_violated, bool_or(violated) AS any_violated FROM pairs GROUP BY 1")
def rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_summary(rules_pairs(spark, sf))


# Impact: what the rules say before and after changes of single values.
_IMPACT = (("s1", f"{KG}Supplier_1", f"{KG}acctBal", "-5.00"), ("s2", f"{KG}Supplier_2", f"{KG}acctBal", "9999.00"), ("s3", f"{KG}Customer_1", f"{KG}acctBal", "-950"), ("s4", f"{KG}Nobody_1", f"{KG}acctBal", "-1"))
_TRUTH = (("s1", "R1"), ("s1", "r3"), ("s2", "r4"), ("s2", "r9"), ("s3", "r3"))


def _impact(spark: SparkSession, sf: str) -> DataFrame:
    changes = spark.createDataFrame(_IMPACT, "scenario_id string, s string, p string, new_value string")
    return rules.violated_under(_each(spark), relational(spark, sf), changes)


_IMPACT_SQL = f"""{_FACTS}, {_values(_IMPACT, 'ch', 'scenario_id, s, p, new_value')}, {_values(_TRUTH, 'truth', 'scenario_id, rule_id')},
now AS (SELECT sc.scenario_id, ov.rule_id, coalesce({_compare_sql("coalesce(ch.new_value, ov.value)", 'operator', 'rules.value')}, FALSE) AS violated
  FROM ov JOIN rules USING (rule_id) CROSS JOIN (SELECT DISTINCT scenario_id FROM ch) sc LEFT JOIN ch ON ch.scenario_id = sc.scenario_id AND ch.s = ov.object AND regexp_extract(ch.p, '[^#/]*$') = rules.attribute),
hit AS (SELECT DISTINCT scenario_id, rule_id FROM now WHERE violated)"""


@query(f"WITH {_IMPACT_SQL} SELECT scenario_id, rule_id FROM hit")
def impact_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf)


@query(f"""WITH {_IMPACT_SQL}, p AS (SELECT scenario_id, lower(rule_id) AS r FROM hit), t AS (SELECT DISTINCT scenario_id, lower(rule_id) AS r FROM truth),
c AS (SELECT s.scenario_id, (SELECT count(*) FROM p WHERE p.scenario_id = s.scenario_id) AS n_predicted, (SELECT count(*) FROM t WHERE t.scenario_id = s.scenario_id) AS n_truth,
  (SELECT count(*) FROM p JOIN t USING (scenario_id, r) WHERE p.scenario_id = s.scenario_id) AS h FROM (SELECT DISTINCT scenario_id FROM hit) s)
SELECT scenario_id, n_predicted, n_truth, round(coalesce(h / nullif(n_predicted, 0), 0.0)::DOUBLE, 4) AS precision, round(coalesce(h / nullif(n_truth, 0), 0.0)::DOUBLE, 4) AS recall,
  round(coalesce(2.0 * h / nullif(n_predicted + n_truth, 0), 0.0)::DOUBLE, 4) AS f1 FROM c""")
def impact_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rule_set_score(_impact(spark, sf), spark.createDataFrame(_TRUTH, "scenario_id string, rule_id string"), ["scenario_id"])


# Arms: judges of candidate pairs are arms, a pair judged different is a violated rule.


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "align_judgments").select(F.col("candidate_id").alias("rule_id"), F.col("judged_by").alias("arm"), (~F.col("same_entity")).alias("violated"), F.col("confidence").alias("score")).distinct()


_ARMS = "arms AS (SELECT DISTINCT candidate_id AS rule_id, judged_by AS arm, NOT same_entity AS violated, confidence AS score FROM align_judgments)"


@query(f"""WITH {_ARMS}, h AS (SELECT rule_id, bool_or(arm = 'llm' AND violated) AS a, bool_or(arm = 'rule' AND violated) AS b FROM arms GROUP BY 1)
SELECT id AS rule_id, CASE WHEN coalesce(a, FALSE) AND coalesce(b, FALSE) THEN 'agree-both' WHEN coalesce(a, FALSE) THEN 'llm-only' WHEN coalesce(b, FALSE) THEN 'rule-only' ELSE 'agree-neither' END AS agreement
FROM (SELECT DISTINCT id FROM align_candidates) LEFT JOIN h ON h.rule_id = id""")
def rule_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.agreement(table(spark, sf, "align_candidates").select(F.col("id").alias("rule_id")), _arms(spark, sf), "llm", "rule")


@query(f"""WITH {_ARMS}, m AS (SELECT rule_id, arm, round(avg(score), 6) AS score FROM arms GROUP BY 1, 2), r AS (SELECT rule_id, arm, score, max(score) OVER (PARTITION BY rule_id) AS best FROM m)
SELECT rule_id, CASE WHEN count(CASE WHEN score = best THEN 1 END) = 1 THEN min(CASE WHEN score = best THEN arm END) END AS winner FROM r GROUP BY 1""")
def arm_winner(spark: SparkSession, sf: str) -> DataFrame:
    mean = _arms(spark, sf).groupBy("rule_id", "arm").agg(F.round(F.avg("score"), 6).alias("score"))
    return evaluate.winner(mean, ["rule_id"], "arm", "score")


@query("""WITH c AS (SELECT DISTINCT judged_by AS arm, surface_a AS subject, coalesce(surface_b, '') AS object FROM align_judgments j JOIN align_candidates c ON c.id = j.candidate_id WHERE NOT same_entity)
SELECT (SELECT count(*) FROM (SELECT subject, object FROM c WHERE arm = 'llm' INTERSECT SELECT subject, object FROM c WHERE arm = 'rule')) AS n_shared,
(SELECT count(*) FROM (SELECT subject, object FROM c WHERE arm = 'llm' EXCEPT SELECT subject, object FROM c WHERE arm = 'rule')) AS n_a,
(SELECT count(*) FROM (SELECT subject, object FROM c WHERE arm = 'rule' EXCEPT SELECT subject, object FROM c WHERE arm = 'llm')) AS n_b""")
def arm_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "align_candidates").select(F.col("id").alias("candidate_id"), F.col("surface_a").alias("subject"), F.col("surface_b").alias("object")).distinct()
    j = table(spark, sf, "align_judgments").where(~F.col("same_entity")).select("candidate_id", F.col("judged_by").alias("arm")).distinct()
    return evaluate.overlap(j.join(c, "candidate_id"), "llm", "rule")


@query("""WITH d AS (SELECT candidate_id, bool_or(status = 'rejected') AS bad FROM align_decisions GROUP BY 1), j AS (SELECT candidate_id, judged_by AS arm, bool_or(NOT same_entity) AS found FROM align_judgments GROUP BY 1, 2),
o AS (SELECT arm, count(CASE WHEN bad AND found THEN 1 END) AS tp, count(CASE WHEN NOT bad AND found THEN 1 END) AS fp, count(CASE WHEN bad AND NOT found THEN 1 END) AS fn, count(CASE WHEN NOT bad AND NOT found THEN 1 END) AS tn FROM d JOIN j USING (candidate_id) GROUP BY 1)
SELECT arm, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS recall,
coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0.0)::DOUBLE AS f1 FROM o""")
def outcome_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "align_decisions").groupBy("candidate_id").agg(F.bool_or(F.col("status") == "rejected").alias("bad"))
    j = table(spark, sf, "align_judgments").groupBy("candidate_id", F.col("judged_by").alias("arm")).agg(F.bool_or(~F.col("same_entity")).alias("found"))
    outcome = F.when(F.col("bad"), F.when(F.col("found"), "TP").otherwise("FN")).otherwise(F.when(F.col("found"), "FP").otherwise("TN"))
    return evaluate.outcome_prf(d.join(j, "candidate_id").select("arm", outcome.alias("outcome")), ["arm"])


# Alignment over the mentions of `entities`. The words that acronyms leave out are written here on their own.
_STOP = "('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with')"


def _initials_sql(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(regexp_extract_all({c}, '[A-Za-z]+'), lambda q: lower(q) NOT IN {_STOP}), lambda q: upper(left(q, 1))), '')"


def _tokens_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


_SURFACES = f"""sf AS (SELECT DISTINCT text_span AS x FROM entities WHERE text_span IS NOT NULL),
sk AS (SELECT x, lower(regexp_replace(x, '[_\\-\\s]+', '', 'g')) AS bare, {_initials_sql('x')} AS ini, {_tokens_sql('x')} AS tok FROM sf),
sim AS (SELECT a.x AS surface_a, b.x AS surface_b, lower(trim(a.x)) = lower(trim(b.x)) OR a.bare = b.bare AS same,
  (length(a.x) BETWEEN 2 AND 8 AND upper(a.x) = b.ini) OR (length(b.x) BETWEEN 2 AND 8 AND upper(b.x) = a.ini) AS acr,
  len(list_intersect(a.tok, b.tok)) AS i, len(a.tok) + len(b.tok) AS t FROM sk a JOIN sk b ON a.x < b.x),
pairs_ AS (SELECT surface_a, surface_b, CASE WHEN same OR acr THEN 1.0 WHEN i = 0 THEN 0.0 ELSE i / (t - i) END::DOUBLE AS score, CASE WHEN NOT same AND acr THEN 'acronym' ELSE 'string_sim' END AS method FROM sim)"""


@query(f"WITH {_SURFACES} SELECT surface_a, surface_b, score, method FROM pairs_ WHERE score >= 0.40")
def align_similar_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    return align.similar_surfaces(table(spark, sf, "entities").select(F.col("text_span").alias("surface")))


_CANDIDATES = f"""{_SURFACES}, e AS (SELECT ord, id, text_span FROM entities WHERE text_span IS NOT NULL),
ap AS (SELECT surface_a, surface_b, score, method FROM pairs_ WHERE score >= 0.40 UNION ALL SELECT surface_b, surface_a, score, method FROM pairs_ WHERE score >= 0.40 UNION ALL SELECT x, x, 1.0, 'string_sim' FROM sf),
cand AS (SELECT left(sha256(least(a.id, b.id) || '|' || greatest(a.id, b.id)), 16) AS id, a.ord AS ord_a, b.ord AS ord_b, a.id AS entity_id_a, b.id AS entity_id_b, surface_a, surface_b, score, method
  FROM ap JOIN e a ON a.text_span = surface_a JOIN e b ON b.text_span = surface_b WHERE a.ord < b.ord QUALIFY row_number() OVER (PARTITION BY least(a.id, b.id), greatest(a.id, b.id) ORDER BY a.ord, b.ord) = 1)"""


@query(f"WITH {_CANDIDATES} SELECT id, entity_id_a, entity_id_b, score, method FROM cand")
def align_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return align.candidates(table(spark, sf, "entities")).select("id", "entity_id_a", "entity_id_b", "score", "method")


@query("""WITH j AS (SELECT candidate_id, bool_or(same_entity) AS same FROM align_judgments GROUP BY 1), c AS (SELECT DISTINCT * FROM align_candidates WHERE surface_a IS NOT NULL AND surface_b IS NOT NULL)
SELECT id AS candidate_id, CASE WHEN length(surface_a) >= length(surface_b) THEN entity_id_a ELSE entity_id_b END AS canonical_entity_id, CASE WHEN length(surface_a) >= length(surface_b) THEN surface_b ELSE surface_a END AS alias,
CASE WHEN coalesce(similarity_score >= 0.85, FALSE) OR coalesce(same, FALSE) THEN 'approved' WHEN same IS NULL THEN 'proposed' ELSE 'rejected' END AS status FROM c LEFT JOIN j ON j.candidate_id = id""")
def align_decide(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "align_candidates").where(F.col("surface_a").isNotNull() & F.col("surface_b").isNotNull()).distinct().withColumnRenamed("similarity_score", "score")
    j = table(spark, sf, "align_judgments").groupBy("candidate_id").agg(F.bool_or("same_entity").alias("same_entity"))
    return align.decide(c, j).select("candidate_id", "canonical_entity_id", F.col("aliases")[0].alias("alias"), "status")


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    """Delta entries of the mentions: their type, under an IRI made of the surface."""
    e = table(spark, sf, "entities").where(F.col("text_span").isNotNull() & F.col("entity_type").isNotNull())
    s = T.make_iri(F.col("text_span"), KG)
    return e.select("ord", T.short_hash(s, F.lit(RDF_TYPE), F.col("entity_type")).alias("id"), s.alias("s"), F.lit(RDF_TYPE).alias("p"), F.col("entity_type").alias("o"), F.col("id").alias("source_entity_id"))


_DELTA = rf"""de AS (SELECT ord, '{KG}' || regexp_replace(regexp_replace(text_span, '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, entity_type AS o, id AS eid FROM entities WHERE text_span IS NOT NULL AND entity_type IS NOT NULL),
iris AS (SELECT eid AS id, arg_min(s, ord) AS iri FROM de GROUP BY 1),
um AS (SELECT ord, canonical_entity_id AS cid, unnest(merged_entity_ids) AS m FROM align_decisions WHERE status = 'approved'),
rw AS (SELECT b.iri AS old, arg_max(a.iri, {{'o': um.ord, 'n': a.iri}}) AS new FROM um JOIN iris a ON a.id = cid JOIN iris b ON b.id = m WHERE a.iri <> b.iri GROUP BY 1)"""


@query(f"WITH {_DELTA} SELECT old, new FROM rw")
def align_rewrite_map(spark: SparkSession, sf: str) -> DataFrame:
    return align.rewrite_map(table(spark, sf, "align_decisions"), align.entity_iris(_delta(spark, sf)))


@query(f"""WITH {_DELTA}, n AS (SELECT ord, coalesce(new, s) AS s, o FROM de LEFT JOIN rw ON rw.old = de.s),
k AS (SELECT left(sha256(s || '|{RDF_TYPE}|' || o), 16) AS id, s, o, ord FROM n)
SELECT id, s, o FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""")
def align_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    d = _delta(spark, sf)
    return align.rewrite(d, align.rewrite_map(table(spark, sf, "align_decisions"), align.entity_iris(d))).select("id", "s", "o")


@query(f"""WITH a AS (SELECT DISTINCT candidate_id, canonical_entity_id, aliases, ord FROM align_decisions WHERE status = 'approved'), e AS (SELECT id, arg_min(text_span, ord) AS t FROM entities GROUP BY 1), c AS (SELECT DISTINCT id, method, similarity_score FROM align_candidates)
SELECT a.candidate_id, e.t AS canonical_surface, array_to_string(aliases, ', ') AS merged, c.method, c.similarity_score AS score FROM a LEFT JOIN c ON c.id = a.candidate_id LEFT JOIN e ON e.id = a.canonical_entity_id""")
def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "align_decisions").select("candidate_id", "canonical_entity_id", "aliases", "status", "ord").distinct()
    c = table(spark, sf, "align_candidates").select("id", "method", F.col("similarity_score").alias("score")).distinct()
    return align.merge_report(d, c, table(spark, sf, "entities"))


_CAMEL = r"regexp_replace(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_\-]+', ' ', 'g')"


@query(f"""WITH w AS (SELECT DISTINCT entity_type AS n FROM entities WHERE entity_type IS NOT NULL AND entity_type NOT IN (SELECT local_name FROM tbox)), s AS (SELECT DISTINCT local_name AS n FROM tbox),
x AS (SELECT w.n AS w, s.n AS s, {_CAMEL.format(c='w.n')} AS ww, {_CAMEL.format(c='s.n')} AS ss FROM w CROSS JOIN s),
y AS (SELECT w, s, CASE WHEN lower(regexp_replace(w, '[_\\-\\s]+', '', 'g')) = lower(regexp_replace(s, '[_\\-\\s]+', '', 'g')) OR (length(w) BETWEEN 2 AND 8 AND upper(w) = {_initials_sql('ss')}) OR (length(s) BETWEEN 2 AND 8 AND upper(s) = {_initials_sql('ww')}) THEN 1.0
  ELSE len(list_intersect({_tokens_sql('ww')}, {_tokens_sql('ss')})) / len(list_distinct(list_concat({_tokens_sql('ww')}, {_tokens_sql('ss')}))) END::DOUBLE AS score FROM x)
SELECT w AS working, s AS source, score, CASE WHEN score >= 0.85 THEN 'auto' ELSE 'judge' END AS band FROM y WHERE score >= 0.40 QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, s) = 1""")
def iri_best_match(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "entities").where(F.col("entity_type").isNotNull()).select(F.col("entity_type").alias("name"))
    return align.best_match(w, table(spark, sf, "tbox").select(F.col("local_name").alias("name")))


# Conflicts against the rules above.
_CONFLICTS = (
    ("ontology", 0, "Nation_7", "Supplier3", "acctBal_<_threshold"), ("ontology", 1, "PartA", "Region_2", "retailPrice_>_threshold"), ("ontology", 2, "Customer12", None, "acctBal_<_threshold"),
    ("ontology", 3, "Warehouse", "Crane", "mass"), ("document", 0, "Supplier", "Nation", "balance"), ("document", 1, "Region", "Part", "size"), ("document", 2, "CustomerB", "", "segment_==_threshold"),
)


def _conflict_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CONFLICTS, "arm string, ix int, subject string, object string, conflict_type string")


def _iri_sim_sql(a: str, b: str) -> str:
    x, y = _CAMEL.format(c=a), _CAMEL.format(c=b)
    bare = lambda c: f"lower(regexp_replace({c}, '[_\\-\\s]+', '', 'g'))"
    return f"""CASE WHEN {bare(a)} = {bare(b)} OR (length({a}) BETWEEN 2 AND 8 AND upper({a}) = {_initials_sql(y)}) OR (length({b}) BETWEEN 2 AND 8 AND upper({b}) = {_initials_sql(x)}) THEN 1.0
  WHEN len(list_intersect({_tokens_sql(x)}, {_tokens_sql(y)})) = 0 THEN 0.0 ELSE len(list_intersect({_tokens_sql(x)}, {_tokens_sql(y)})) / len(list_distinct(list_concat({_tokens_sql(x)}, {_tokens_sql(y)}))) END"""


def _class_sim_sql(cls: str, instance: str, short: str) -> str:
    return f"""CASE WHEN coalesce({cls}, '') = '' OR coalesce({instance}, '') = '' THEN 0.0 ELSE greatest({_iri_sim_sql(cls, instance)}, {_iri_sim_sql(cls, short)},
  CASE WHEN starts_with(lower({short}), lower({cls})) OR starts_with(lower({cls}), lower({short})) THEN 1.0 ELSE 0.0 END) END"""


_CONFLICT_SCORES = f"""{_values(_RULES, 'rules', _RULE_COLUMNS)}, {_values(_CONFLICTS, 'cf', 'arm, ix, subject, object, conflict_type')},
cn AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(subject, '[0-9]+$', ''), '([a-z])[A-Z]$', '\\1'), ''), subject) AS s_short, coalesce(nullif(regexp_replace(regexp_replace(object, '[0-9]+$', ''), '([a-z])[A-Z]$', '\\1'), ''), object) AS o_short FROM cf),
cs AS (SELECT arm, ix, rule_id, attribute, conflict_type, expected_violated, substr(rule_id, 2)::INT AS ord,
  {_class_sim_sql('subject_type', 'subject', 's_short')} AS ss, {_class_sim_sql('object_type', 'object', 'o_short')} AS oo, {_class_sim_sql('subject_type', 'object', 'o_short')} AS so, {_class_sim_sql('object_type', 'subject', 's_short')} AS os FROM cn CROSS JOIN rules),
scored AS (SELECT arm, ix, rule_id, ord, expected_violated, CASE WHEN contains(conflict_type, attribute) THEN 0.5 + 0.5 * greatest((ss + oo) / 2, (so + os) / 2) ELSE 0.6 * greatest((ss + oo) / 2, (so + os) / 2) END::DOUBLE AS score FROM cs),
near_ AS (SELECT * FROM scored WHERE score >= 0.40)""".replace("\\\\", "\\")


@query(f"WITH {_CONFLICT_SCORES} SELECT arm, ix, rule_id, round(score, 6) AS score FROM near_")
def conflict_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.conflict_scores(_conflict_table(spark), rule_table(spark)).select("arm", "ix", "rule_id", F.round("score", 6).alias("score"))


# The greedy order taken one pair at a time: violated rules first, then what they left for the others.
@query(f"""WITH RECURSIVE {_CONFLICT_SCORES},
hard AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY expected_violated DESC, score DESC, ord, ix) AS n FROM near_),
step(arm, n, ixs, rids, got) AS (SELECT DISTINCT arm, 0::BIGINT, []::INT[], []::VARCHAR[], []::VARCHAR[] FROM cf
  UNION ALL SELECT step.arm, hard.n, CASE WHEN list_contains(ixs, hard.ix) OR list_contains(rids, hard.rule_id) THEN ixs ELSE list_append(ixs, hard.ix) END,
    CASE WHEN list_contains(ixs, hard.ix) OR list_contains(rids, hard.rule_id) THEN rids ELSE list_append(rids, hard.rule_id) END, got FROM step JOIN hard ON hard.arm = step.arm AND hard.n = step.n + 1),
last_ AS (SELECT arm, max_by(ixs, n) AS ixs, max_by(rids, n) AS rids FROM step GROUP BY 1)
SELECT arm, rule_id, CASE WHEN expected_violated THEN CASE WHEN list_contains(rids, rule_id) THEN 'TP' ELSE 'FN' END ELSE CASE WHEN list_contains(rids, rule_id) THEN 'FP' ELSE 'TN' END END AS outcome,
  CASE WHEN list_contains(rids, rule_id) THEN ixs[list_position(rids, rule_id)] END AS matched_ix FROM last_ CROSS JOIN rules""")
def conflict_match(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.score_rules(_conflict_table(spark), rule_table(spark)).select("arm", "rule_id", "outcome", "matched_ix")


# Synthesis.


@query(f"WITH {_G}, {_I}, d AS (SELECT DISTINCT {_ID} AS id FROM g WHERE s IN (SELECT s FROM ind)) SELECT id, format('[T-{{:03d}}]', row_number() OVER (ORDER BY id)) AS anchor FROM d")
def anchor_map(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.anchor_map(graph.to_delta(fleet(spark, sf)).select("id").distinct())


def _label_sql(c: str) -> str:
    return rf"trim(regexp_replace(replace(regexp_replace(regexp_extract({c}, '[^#:/]*$'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), '\s+', ' ', 'g'))"


@query(rf"""WITH {_G}, {_I}, d AS (SELECT DISTINCT {_ID} AS id, s, p, o FROM g WHERE s IN (SELECT s FROM ind)), m AS (SELECT id, format('[T-{{:03d}}]', row_number() OVER (ORDER BY id)) AS anchor FROM d GROUP BY id)
SELECT s, min(id) AS section_ix, {_label_sql('s')} AS title, string_agg({_label_sql('s')} || ': ' || {_label_sql('p')} || ' is ' || CASE WHEN o LIKE 'http%' THEN regexp_extract(o, '[^#/]*$') ELSE o END || ' ' || anchor || '.', ' ' ORDER BY id, p, o) AS paragraph
FROM d JOIN m USING (id) GROUP BY s""")
def synthesized_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = graph.to_delta(fleet(spark, sf)).select("id", "s", "p", "o").distinct().withColumn("ord", F.col("id"))
    return synthesis.template_sections(d, synthesis.anchor_map(d.select("id").distinct()))


_CHECKS = r"""k AS (SELECT DISTINCT chunk_id AS doc_id, a.name AS p, a.value AS o FROM (SELECT chunk_id, unnest(attributes) AS a FROM entities) WHERE a.value IS NOT NULL AND a.name IS NOT NULL),
t AS (SELECT DISTINCT id AS doc_id, text FROM chunks),
n AS (SELECT doc_id, p, o, text, try_cast(nullif(regexp_extract(o, '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'), '') AS DOUBLE) AS e, list_transform(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'), lambda z: try_cast(z AS DOUBLE)) AS ns FROM k JOIN t USING (doc_id) WHERE NOT (o LIKE 'http%' OR (o LIKE '%:%' AND o NOT LIKE '"%'))),
m AS (SELECT doc_id, p, o, contains(lower(text), lower(o)) OR (e IS NOT NULL AND len(list_filter(ns, lambda z: CASE WHEN e = 0 THEN z = 0 ELSE abs(z - e) / abs(e) <= 0.01 END)) > 0) AS match FROM n)"""


def _self_check(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "entities").select(F.col("chunk_id").alias("doc_id"), F.inline("attributes")).where(F.col("value").isNotNull() & F.col("name").isNotNull())
    entries = a.select("doc_id", F.concat("name", F.lit("="), "value").alias("id"), F.col("name").alias("p"), F.col("value").alias("o"), F.lit(None).cast("string").alias("o_datatype")).distinct()
    return synthesis.self_check(entries, table(spark, sf, "chunks").select(F.col("id").alias("doc_id"), "text").distinct())


@query(f"WITH {_CHECKS} SELECT doc_id, p || '=' || o AS triple_id, match FROM m")
def self_check(spark: SparkSession, sf: str) -> DataFrame:
    return _self_check(spark, sf).select("doc_id", "triple_id", "match")


@query(f"WITH {_CHECKS} SELECT doc_id, count(CASE WHEN match THEN 1 END) AS n_matched, count(match) AS n_total, count(CASE WHEN match THEN 1 END) / count(match) AS coverage FROM m GROUP BY 1")
def self_check_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.coverage(_self_check(spark, sf), ["doc_id"])


# Documents and chunks.
_LINES = "l AS (SELECT id, t.title AS s FROM (SELECT id, unnest(section_path) AS t FROM (SELECT DISTINCT id, section_path FROM chunks)) UNION ALL SELECT DISTINCT id, upper(text_span) FROM entities WHERE text_span IS NOT NULL)"


@query(rf"""WITH {_LINES}, v AS (SELECT id, s, CASE WHEN s = '' OR length(s) > 80 THEN NULL WHEN regexp_matches(s, '^\d+(\.\d+)*\s+[\p{{L}}\p{{N}}_]') THEN least(3, 1 + length(regexp_extract(s, '^\d+(\.\d+)*')) - length(replace(regexp_extract(s, '^\d+(\.\d+)*'), '.', '')))
  WHEN s = upper(s) AND length(s) >= 3 AND NOT regexp_matches(s, '[.,:;?!]$') AND regexp_full_match(replace(s, ' ', ''), '\p{{L}}+') THEN 2 END AS level FROM l)
SELECT id, level::INT AS level, count(*) AS n FROM v WHERE level IS NOT NULL GROUP BY 1, 2""")
def text_headings(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "chunks").select("id", "section_path").distinct().select("id", F.explode(F.col("section_path.title")).alias("line"))
    spans = table(spark, sf, "entities").where(F.col("text_span").isNotNull()).select("id", F.upper("text_span").alias("line")).distinct()
    lines = titles.unionAll(spans)
    return lines.select("id", documents.text_heading_level(F.col("line")).alias("level")).where(F.col("level").isNotNull()).groupBy("id", "level").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 2) AS title FROM l WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*$')),
open_ AS (SELECT a.doc_id, a.line_no, b.line_no AS place, b.title FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.line_no <= a.line_no AND (b.level < a.level OR b.line_no = a.line_no)
  WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level))
SELECT doc_id, line_no::INT AS line_no, string_agg(title, ' > ' ORDER BY place) AS path FROM open_ GROUP BY 1, 2""")
def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.replace(F.col("text"), F.lit("\r"), F.lit("")).alias("text"))
    return documents.heading_paths(documents.heading_lines(d, "doc_id", "text"), "doc_id").select("doc_id", "line_no", F.array_join("path", " > ").alias("path"))


@query("""SELECT DISTINCT id, CASE WHEN len(section_path) > 0 THEN array_to_string(list_transform(section_path, lambda x: x.title), ' > ') ELSE '(no section)' END AS context,
'file://' || locator.source_path || CASE WHEN locator.page IS NOT NULL THEN '#page=' || locator.page WHEN locator.line_start IS NOT NULL THEN '#L' || locator.line_start ELSE '' END AS uri,
greatest(1, length(text) // 4)::INT AS tokens FROM chunks""")
def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return c.select("id", T.section_context(F.col("section_path")).alias("context"), T.locator_uri(F.col("locator")).alias("uri"), T.estimate_tokens(F.col("text")).alias("tokens")).distinct()


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.when(F.col("source_format") == "md", ".md").otherwise(".txt"))
    return with_markdown(d.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")))


@query()
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return documents.chunk_documents(_raw(spark, sf))


@query(r"""SELECT '/data/' || doc_id || '.md' AS source_path, sha256(text) AS source_sha256, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS markdown FROM documents WHERE source_format = 'md' AND text IS NOT NULL""")
def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).where(F.col("source_format") == "md").select("source_path", "source_sha256", "markdown")


@query(rf"""WITH d AS (SELECT '/data/' || doc_id || CASE WHEN source_format = 'md' THEN '.md' ELSE '.txt' END AS source_path, coalesce(source_format = 'md', FALSE) AS md, sha256(text) AS source_sha256, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT source_path, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(text, '\n\z', ''), chr(10)), 1) AS i FROM d WHERE NOT md),
t AS (SELECT source_path, i, x, regexp_replace(x, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g') AS s FROM l),
v AS (SELECT source_path, i, x, s, CASE WHEN s = '' OR length(s) > 80 THEN NULL WHEN regexp_matches(s, '^\d+(\.\d+)*\s+[\p{{L}}\p{{N}}_]') THEN least(3, 1 + length(regexp_extract(s, '^\d+(\.\d+)*')) - length(replace(regexp_extract(s, '^\d+(\.\d+)*'), '.', '')))
  WHEN s = upper(s) AND length(s) >= 3 AND NOT regexp_matches(s, '[.,:;?!]$') AND regexp_full_match(replace(s, ' ', ''), '\p{{L}}+') THEN 2 END AS n FROM t),
b AS (SELECT source_path, string_agg(CASE WHEN n IS NULL THEN x ELSE repeat('#', n::BIGINT) || ' ' || s END, chr(10) ORDER BY i) AS body FROM v GROUP BY 1)
SELECT source_path, source_sha256, CASE WHEN md THEN regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) ELSE body END AS markdown FROM d LEFT JOIN b USING (source_path)""")
def converted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All texts of whatever format; markdown_documents has those that are markdown already."""
    return _raw(spark, sf).select("source_path", "source_sha256", "markdown")


@query("SELECT id, artifact_id, chunk_ix FROM chunks WHERE length(text) >= 30")
def chunk_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return documents.eligible(table(spark, sf, "chunks")).select("id", "artifact_id", "chunk_ix")


@query("SELECT id, artifact_id, chunk_ix FROM (SELECT * FROM (SELECT DISTINCT id, artifact_id, chunk_ix, text FROM chunks) QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY chunk_ix) <= 3) WHERE length(text) >= 30")
def chunk_first_three(spark: SparkSession, sf: str) -> DataFrame:
    return documents.eligible(table(spark, sf, "chunks").select("id", "artifact_id", "chunk_ix", "text").distinct(), first=3).select("id", "artifact_id", "chunk_ix")


@query("SELECT id, CASE WHEN char_start < 9000 THEN char_start // 3000 + 1 ELSE 3 END AS page FROM (SELECT DISTINCT id, char_start FROM chunks)")
def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.array(*[F.struct(F.lit(i * 3000).alias("char_start"), F.lit(i * 3000 + 3000).alias("char_end"), F.lit(i + 1).alias("page")) for i in range(3)])
    return table(spark, sf, "chunks").select("id", "char_start").distinct().select("id", documents.page_of(pages, F.col("char_start")).alias("page"))


_SPANS = (("d1", 1, 0, 0, 0, "1 Overview", 14.0, True), ("d1", 1, 1, 0, 0, "Plain body text", 10.0, False), ("d1", 1, 1, 1, 0, "and more of it", 10.04, False), ("d1", 2, 0, 0, 0, "2.1 Detail", 10.0, True), ("d1", 2, 0, 0, 1, "tiny", 3.0, False), ("d2", 1, 0, 0, 0, "only tiny", 3.9, False), ("d3", 1, 0, 0, 0, "a", 9.0, False), ("d3", 1, 0, 1, 0, "b", 11.0, False), ("d3", 9, 0, 1, 0, "late", 11.0, False))
_SPAN_COLUMNS = "doc, page, block, line, span, text, size, bold"


def _spans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SPANS, "doc string, page int, block int, line int, span int, text string, size double, bold boolean")


@query(f"""WITH {_values(_SPANS, 'sp', _SPAN_COLUMNS)}, n AS (SELECT doc, round(size, 1) AS size, count(*) AS n, min((page, block, line, span)) AS place FROM sp WHERE page <= 5 AND round(size, 1) > 4 GROUP BY 1, 2)
SELECT d.doc, coalesce((SELECT size FROM n WHERE n.doc = d.doc ORDER BY n DESC, place LIMIT 1), 10.0)::DOUBLE AS body_size FROM (SELECT DISTINCT doc FROM sp) d""")
def font_mode(spark: SparkSession, sf: str) -> DataFrame:
    return documents.body_sizes(_spans(spark))


@query(rf"""WITH {_values(_SPANS, 'sp', _SPAN_COLUMNS)}, n AS (SELECT doc, round(size, 1) AS size, count(*) AS n, min((page, block, line, span)) AS place FROM sp WHERE page <= 5 AND round(size, 1) > 4 GROUP BY 1, 2),
b AS (SELECT d.doc, coalesce((SELECT size FROM n WHERE n.doc = d.doc ORDER BY n DESC, place LIMIT 1), 10.0)::DOUBLE AS body FROM (SELECT DISTINCT doc FROM sp) d),
l AS (SELECT doc, page, block, line, trim(string_agg(text, '' ORDER BY span)) AS text, arg_max(struct_pack(size := size, bold := bold), (size, -span)) AS w FROM sp GROUP BY 1, 2, 3, 4),
v AS (SELECT l.*, CASE WHEN text = '' OR length(text) > 120 THEN NULL WHEN w.size / body >= 1.4 THEN 1 WHEN w.size / body >= 1.2 THEN 2 WHEN w.size / body >= 1.05 AND w.bold THEN 3
  WHEN w.bold AND regexp_matches(text, '^[0-9]+(\.[0-9]+)*\s') AND length(text) < 80 THEN 3 END AS level FROM l JOIN b USING (doc)),
k AS (SELECT doc, page, block, arg_min(level, line) FILTER (WHERE level IS NOT NULL) AS level, trim(string_agg(text, ' ' ORDER BY line)) AS text FROM v GROUP BY 1, 2, 3),
g AS (SELECT doc, page, string_agg(CASE WHEN level IS NULL THEN '' ELSE repeat('#', level) || ' ' END || text || chr(10) || chr(10), '' ORDER BY block) AS t FROM k WHERE text <> '' GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS first FROM g)
SELECT doc, string_agg(t, '' ORDER BY page) AS markdown, string_agg(page || ':' || first || '-' || (first + length(t)), ' ' ORDER BY page) AS pages FROM o GROUP BY 1""")
def layout_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown of laid-out pages; the characters of each page as text."""
    got = documents.blocks_to_documents(documents.spans_to_blocks(_spans(spark)))
    page = F.transform("page_map", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["char_start"].cast("string"), F.lit("-"), x["char_end"].cast("string")))
    return got.select("doc", "markdown", F.array_join(page, " ").alias("pages"))


# Taxonomy and generated systems.
_CLASSES = tuple((c.local, c.parent) for c in generate.taxonomy_classes())


@query(f"""WITH RECURSIVE {_values(_CLASSES, 'cl', 'local, parent')}, up(child, ancestor, distance) AS (SELECT local, parent, 1 FROM cl WHERE parent IS NOT NULL UNION ALL SELECT child, parent, distance + 1 FROM up JOIN cl ON ancestor = local WHERE parent IS NOT NULL)
SELECT child, ancestor, min(distance) AS distance FROM up GROUP BY 1, 2""")
def class_closure(spark: SparkSession, sf: str) -> DataFrame:
    return generate.class_closure(generate.taxonomy(spark))


@query(f"""WITH RECURSIVE {_values(_CLASSES, 'cl', 'local, parent')}, {_values(tuple((c.local, d) for c in generate.taxonomy_classes() for d in c.domains), 'dm', 'local, domain')},
up(child, ancestor) AS (SELECT local, parent FROM cl WHERE parent IS NOT NULL UNION SELECT child, parent FROM up JOIN cl ON ancestor = local WHERE parent IS NOT NULL)
SELECT child AS local FROM up WHERE ancestor = 'Component' AND child NOT IN (SELECT parent FROM cl WHERE parent IS NOT NULL) AND child IN (SELECT local FROM dm WHERE domain = 'orbit')""")
def concrete_components(spark: SparkSession, sf: str) -> DataFrame:
    return generate.concrete(generate.taxonomy(spark), "Component", "orbit")


@query()
def generated_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tree_to_graph(generate.systems_table(spark, "orbit", 3), KG)


# Scalars and small reports.


@query(rf"""SELECT DISTINCT text_span, lower(regexp_replace(text_span, '[_\-\s]+', '', 'g')) AS bare, {_initials_sql('text_span')} AS ini, {_CAMEL.format(c='text_span')} AS camel,
coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(text_span), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug,
regexp_replace(regexp_replace(text_span, '\d+$', ''), '([a-z])[A-Z]$', '\1') AS instance, '{KG}' || regexp_replace(regexp_replace(text_span, '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS iri,
try_cast(nullif(regexp_extract(text_span, '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'), '') AS DOUBLE) AS number, left(sha256(coalesce(chunk_id, '') || ':' || left(text_span, 32)), 16) AS entity_key
FROM entities WHERE text_span IS NOT NULL""")
def scalar_kernel(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text_span")
    return table(spark, sf, "entities").where(t.isNotNull()).select(
        "text_span", T.strip_separators(t).alias("bare"), T.initials(t).alias("ini"), T.split_camel(t).alias("camel"), T.slugify(t).alias("slug"), T.normalize_instance(t).alias("instance"),
        T.make_iri(t, KG).alias("iri"), T.first_number(t).alias("number"), T.short_hash(F.col("chunk_id"), F.left(t, F.lit(32)), sep=":").alias("entity_key"),
    ).distinct()


@query("""SELECT DISTINCT s, regexp_extract(regexp_extract(s, '[^#]*$'), '[^/]*$') AS local_a, regexp_extract(s, '[^#:/]*$') AS local_b,
trim(regexp_replace(replace(regexp_replace(regexp_extract(s, '[^#:/]*$'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '\\s+', ' ', 'g')) AS label FROM triples WHERE s IS NOT NULL""".replace("\\\\", "\\"))
def iri_names(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    return table(spark, sf, "triples").where(s.isNotNull()).select("s", T.local_hash_slash(s).alias("local_a"), T.local_any(s).alias("local_b"), T.label_from_iri(s).alias("label")).distinct()


@query("SELECT status, count(*) AS n, count(DISTINCT candidate_id) AS n_candidates FROM align_decisions GROUP BY 1")
def status_flow(spark: SparkSession, sf: str) -> DataFrame:
    return align.status_counts(table(spark, sf, "align_decisions"))


@query("""WITH l AS (SELECT candidate_id, arg_max(status, {'d': decided_at, 'o': ord}) AS status FROM align_decisions GROUP BY 1) SELECT DISTINCT c.id, CASE WHEN l.status IS NULL THEN 'proposed' ELSE l.status END AS status FROM align_candidates c LEFT JOIN l ON l.candidate_id = c.id""")
def review_join(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates as a proposed delta, the decisions as its reviews in order of their time."""
    none = F.lit(None).cast("string")
    delta = table(spark, sf, "align_candidates").select("id", F.lit("proposed").alias("status"), none.alias("o")).distinct()
    action = F.when(F.col("status") == "approved", "approve").when(F.col("status") == "rejected", "reject").otherwise("skip")
    reviews = table(spark, sf, "align_decisions").select(F.col("candidate_id").alias("id"), action.alias("action"), none.alias("new_object"), F.col("reviewer_note").alias("note"), F.struct("decided_at", "ord").alias("ord"))
    return pipelines.review(delta, reviews).select("id", "status")


@query("SELECT entity_type, count(*) AS n FROM entities WHERE entity_type IS NOT NULL GROUP BY 1")
def entities_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return align.counts_by(table(spark, sf, "entities"), "entity_type")


@query()
def extracted_entities(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entities").where(F.col("text_span").isNotNull()).distinct()
    facts = F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit(": "), F.coalesce(a["raw_text"], F.lit("")))), ", ")
    said = e.groupBy(F.col("chunk_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("text_span", F.lit(" has "), facts, F.lit(".")))), "\n").alias("text"))
    return llm_functions.extract_entities(said, get_provider)


@query()
def mapped_delta(spark: SparkSession, sf: str) -> DataFrame:
    return llm_functions.map_entities(table(spark, sf, "entities").distinct(), get_provider, KG)


@query("SELECT artifact_id, sum(length('{\"text\":' || to_json(text)::VARCHAR || '}') // 4)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens FROM (SELECT DISTINCT id, artifact_id, text FROM chunks WHERE length(text) >= 30) GROUP BY 1")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """What asking for extraction cost by artifact; the offline provider counts a token for four characters of the request."""
    c = documents.eligible(table(spark, sf, "chunks").select("id", "artifact_id", "text").distinct())
    return llm_functions.token_usage(llm_functions.ask(c, "extract", {"text": "text"}, get_provider), ["artifact_id"])


@query(f"""WITH {_DELTA} SELECT DISTINCT new AS s, 'http://www.w3.org/2004/02/skos/core#altLabel' AS p, regexp_extract(old, '[^#/]*$') AS o FROM rw""")
def alt_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = _delta(spark, sf)
    return pipelines.alt_labels(d, align.rewrite_map(table(spark, sf, "align_decisions"), align.entity_iris(d)))


@query(f"""WITH {_values(_RULES, 'rules', _RULE_COLUMNS)} SELECT rule_id, 'For ' || CASE WHEN object_type IS NULL THEN 'each ' || subject_type WHEN subject_type IS NULL THEN 'each ' || object_type ELSE 'each pair of ' || subject_type || ' and ' || object_type END
  || ': is ' || attribute || ' ' || operator || ' ' || value || coalesce(' ' || unit, '') || '?' AS question FROM rules""")
def rule_questions(spark: SparkSession, sf: str) -> DataFrame:
    return rule_table(spark).select("rule_id", render.rule_question(*[F.col(c) for c in ("subject_type", "object_type", "attribute", "operator", "value", "unit")]).alias("question"))


@query(f"""WITH {_G}, t AS (SELECT DISTINCT s FROM g WHERE p = '{RDF_TYPE}' AND o = '{FLEET}Thruster'),
v AS (SELECT s, k, string_agg(v, ', ' ORDER BY v) AS v FROM (SELECT DISTINCT s, regexp_extract(p, '[^#/]*$') AS k, o AS v FROM g WHERE p <> '{RDF_TYPE}' AND s IN (SELECT s FROM t)) GROUP BY 1, 2)
SELECT t.s, '* ' || regexp_extract(t.s, '[^#/]*$') || coalesce(chr(10) || b.x, '') AS block FROM t LEFT JOIN (SELECT s, string_agg('  - ' || k || ': ' || v, chr(10) ORDER BY k) AS x FROM v GROUP BY 1) b USING (s)""")
def individual_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_scan(fleet(spark, sf), FLEET + "Thruster").select("s", render.individual_block(F.col("s"), F.col("props")).alias("block"))


@query("""WITH n AS (SELECT CASE kind WHEN 'class' THEN 1 WHEN 'object' THEN 2 ELSE 3 END AS k, CASE kind WHEN 'class' THEN 'Classes: ' WHEN 'object' THEN 'Object properties: ' ELSE 'Datatype properties: ' END
  || string_agg(local_name || CASE WHEN kind = 'datatype' THEN ' (' || regexp_extract(range_iri, '[^#/]*$') || ')' ELSE '' END, ', ' ORDER BY local_name || CASE WHEN kind = 'datatype' THEN ' (' || regexp_extract(range_iri, '[^#/]*$') || ')' ELSE '' END) AS t FROM tbox GROUP BY kind)
SELECT string_agg(t, chr(10) ORDER BY k) AS text FROM n""")
def tbox_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return render.tbox_block(graph.tbox_summary(fleet(spark, sf), FLEET))


@query(f"WITH {_G}, {_I} SELECT substr(s, {len(FLEET) + 1}) AS name FROM ind WHERE s LIKE '{FLEET}%'")
def individual_names(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.locals_under(fleet(spark, sf), FLEET)


@query()
def graph_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.graph_hash(fleet(spark, sf))


# Sentences for the document arm: they break the rules on a balance below zero in every scenario.
_SAID = (("t1", "Supplier One of Nation Seven has an acctBal of -12.5 USD."), ("t2", "Customer Two shows an acctBal of 500 USD."), ("t3", "The Part list is complete."))


@query(f"""WITH {_IMPACT_SQL}, arms AS (SELECT scenario_id, 'ontology' AS arm, rule_id FROM hit UNION ALL SELECT scenario_id, 'document', unnest(['r1', 'r10']) FROM (SELECT DISTINCT scenario_id FROM ch)),
y AS (SELECT DISTINCT scenario_id, lower(rule_id) AS r FROM truth),
c AS (SELECT scenario_id, arm, count(*) AS p, (SELECT count(*) FROM y WHERE y.scenario_id = a.scenario_id) AS t, count(CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.scenario_id = a.scenario_id AND y.r = a.rule_id) THEN 1 END) AS h FROM arms a GROUP BY 1, 2),
f AS (SELECT *, round(coalesce(2.0 * h / nullif(p + t, 0), 0.0)::DOUBLE, 4) AS f1 FROM c)
SELECT scenario_id, CASE WHEN count(*) = 1 OR min(f1) < max(f1) THEN arg_max(arm, f1) END AS winner FROM f GROUP BY 1""")
def impact_winner(spark: SparkSession, sf: str) -> DataFrame:
    """The better arm of each scenario: rules on the changed graph, or on documents that do not change."""
    changes = spark.createDataFrame(_IMPACT, "scenario_id string, s string, p string, new_value string")
    truth = spark.createDataFrame(_TRUTH, "scenario_id string, rule_id string")
    texts = spark.createDataFrame(_SAID, "doc_id string, text string")
    asked = _each(spark).withColumn("plain_english", F.concat(F.lit("Is the "), "attribute", F.lit(" as it should be?")))
    return pipelines.analyze_impact(asked, relational(spark, sf), changes, truth, texts, get_provider)["winners"]


@query()
def document_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the document arm over the chunks: each stated mass, power and voltage against a limit."""
    limits = spark.createDataFrame([("m1", "mass", ">", "500"), ("m2", "power", ">=", "1000"), ("m3", "voltage", "<", "5")], "rule_id string, attribute string, operator string, value string")
    none = F.lit(None).cast("string")
    asked = limits.select("*", none.alias("subject_type"), none.alias("object_type"), F.lit("is it within its limit?").alias("plain_english"))
    texts = table(spark, sf, "chunks").where(F.col("text").isNotNull()).select(F.col("id").alias("doc_id"), "text").distinct()
    return pipelines.check_document_rules(asked, texts, get_provider).select("doc_id", "rule_id", "object", "subject", "value", "violated")


@query()
def discovered_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules proposed for the individuals of the fleet, by the offline provider."""
    return llm_functions.discover_rules(graph.conflict_bags(fleet(spark, sf), FLEET), get_provider)


@query()
def direct_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts that texts state themselves, in one step."""
    texts = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    return llm_functions.direct_conflicts(texts, get_provider)


@query(f"""WITH {_G}, {_I}, d AS (SELECT DISTINCT {_ID} AS id, s, p, o FROM g WHERE s IN (SELECT s FROM ind)), m AS (SELECT id, format('[T-{{:03d}}]', row_number() OVER (ORDER BY id)) AS anchor FROM (SELECT DISTINCT id FROM d)),
n AS (SELECT s, id, anchor, row_number() OVER (PARTITION BY s ORDER BY id, p, o) - 1 AS k FROM d JOIN m USING (id))
SELECT s AS doc_id, k AS paragraph_index, anchor AS citation, id AS triple_id FROM n""")
def section_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The triples that the paragraphs of synthesized documents cite: a document per individual, a paragraph per fact."""
    d = graph.to_delta(fleet(spark, sf)).select("id", "s", "p", "o").distinct().withColumn("ord", F.col("id"))
    anchors = synthesis.anchor_map(d.select("id").distinct())
    sections = synthesis.ask_sections(d, anchors, get_provider).select(F.col("s").alias("doc_id"), F.lit(0).alias("section_ix"), "paragraphs")
    cited = synthesis.provenance(synthesis.paragraphs(sections), anchors)
    return cited.select("doc_id", "paragraph_index", F.col("citation_anchors")[0].alias("citation"), F.col("triple_ids")[0].alias("triple_id"))


# Of a literal with both, its datatype is written.
_WRITTEN = "s, s_kind, p, o, o_kind, o_datatype, CASE WHEN o_datatype IS NULL THEN o_lang END AS o_lang"


@query(f"WITH {_G} SELECT DISTINCT {_WRITTEN} FROM g")
def ntriples_read(spark: SparkSession, sf: str) -> DataFrame:
    """The fleet graph written as N-Triples and read again."""
    path = scratch(spark, "nt")
    save_graph(fleet(spark, sf), path, "nt")
    return read_ntriples(spark, path).distinct()


@query(f"WITH {_G} SELECT DISTINCT {_WRITTEN} FROM g WHERE s_kind <> 'bnode' AND o_kind <> 'bnode'")
def turtle_read(spark: SparkSession, sf: str) -> DataFrame:
    """The fleet graph without blank nodes, whose labels are a document's own, written as Turtle documents and read again."""
    path = scratch(spark, "ttl")
    save_graph(graph.statements(fleet(spark, sf)), path, "turtle", {"kg": FLEET}, 8)
    return load_graph(spark, path, "turtle").distinct()


_FOUND_RULES = (("d1", "Nation_1", "Supplier_1", "acctBal", ">", "-1000"), ("d2", "Nation_1", "Supplier_2", "acctBal", "<", "-99999"), ("d3", "Customer_3", None, "segment", "!=", "none"), ("d4", "Nation_1", "Nobody", "acctBal", ">", "0"))


@query(f"""WITH {_R}, {_values(_FOUND_RULES, 'dr', 'rule_id, subject, object, attribute, operator, value')},
j AS (SELECT dr.*, r.o AS stated FROM dr JOIN r ON r.s = '{KG}' || coalesce(object, subject) AND r.p = '{KG}' || attribute)
SELECT subject, object, attribute || '_' || operator || '_threshold' AS conflict_type, attribute || ' = ' || stated AS evidence FROM j WHERE {_compare_sql('stated', 'operator', 'value')}""")
def detected_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = spark.createDataFrame(_FOUND_RULES, "rule_id string, subject string, object string, attribute string, operator string, value string")
    return pipelines.detect_conflicts(relational(spark, sf), KG, found).select("subject", "object", "conflict_type", "evidence")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["fleet", "oracle_sql", "queries", "relational", "rule_table"]
