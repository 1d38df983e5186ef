"""Triples as a table: instances and schema, patterns, set algebra, namespaces, rewriting.

A graph is a set of rows ``s, s_kind, p, o, o_kind, o_datatype, o_lang`` (plus ``graph_id``). Every
function takes and gives DataFrames; unknown kinds are taken for IRIs. Blank nodes are left out of
everything but :func:`copy_tbox` and :func:`neighbors`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.functions.lexical import OWL, RDF_TYPE, RDFS, XSD
from kgloom.functions.text import local_hash_slash, short_hash
from kgloom.session import cut, small_side

TRIPLE = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
FIELDS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]
NAMED_INDIVIDUAL = OWL + "NamedIndividual"

# Types whose instances are schema, not data.
SCHEMA_TYPES = tuple(
    OWL + x
    for x in ("AllDisjointClasses", "AllDisjointProperties", "AnnotationProperty", "AsymmetricProperty", "Class", "DatatypeProperty", "FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "ObjectProperty", "Ontology", "ReflexiveProperty", "Restriction", "SymmetricProperty", "TransitiveProperty")
) + (RDFS + "Class", RDFS + "Datatype", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property")
FOREIGN_NAMESPACES = ("http://www.w3.org/", "http://purl.org/")


def triple(s: Column, p: Column | str, o: Column, o_kind: str = "literal", datatype: str | None = None, lang: str | None = None) -> Column:
    """One triple as a struct, for ``inline``."""
    return F.struct(
        s.cast("string").alias("s"), F.lit("iri").alias("s_kind"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"),
        F.lit(o_kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(lang).cast("string").alias("o_lang"),
    )


def empty_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLE)


def _iris(triples: DataFrame) -> DataFrame:
    return triples.where(F.coalesce(F.col("s_kind"), F.lit("iri")) == "iri")


def _types(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == RDF_TYPE)


def statements(triples: DataFrame) -> DataFrame:
    """All triples without blank nodes."""
    return _iris(triples).where(F.coalesce(F.col("o_kind"), F.lit("iri")) != "bnode")


def individuals(triples: DataFrame) -> DataFrame:
    """s: declared individuals, and subjects of a type that are not schema themselves.

    One pass and one shuffle: per subject, whether it is declared, schema, typed by a data class.
    """
    kinds = _types(_iris(triples)).groupBy("s").agg(
        F.bool_or(F.col("o") == NAMED_INDIVIDUAL).alias("named"),
        F.bool_or(F.col("o").isin(*SCHEMA_TYPES)).alias("schema"),
        F.bool_or(~F.col("o").isin(*SCHEMA_TYPES) & (F.coalesce(F.col("o_kind"), F.lit("iri")) == "iri")).alias("typed"),
    )
    return kinds.where(F.col("named") | (F.col("typed") & ~F.col("schema"))).select("s")


def individuals_in(triples: DataFrame, namespace: str) -> DataFrame:
    """s: typed subjects of a namespace that are not schema (a declared one that is schema is none)."""
    kinds = _types(_iris(triples)).where(F.col("s").startswith(namespace)).groupBy("s").agg(F.bool_or(F.col("o").isin(*SCHEMA_TYPES)).alias("schema"))
    return kinds.where(~F.col("schema")).select("s")


def subject_triples(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """s, p, o of the subjects, as a set, without blank objects and declarations of individuals."""
    own = statements(triples).where(~((F.col("p") == RDF_TYPE) & (F.col("o") == NAMED_INDIVIDUAL)))
    return own.join(subjects.select("s"), "s", "left_semi").select("s", "p", "o").distinct()


def property_bags(rows: DataFrame, key: Column, value: Column, separator: str = ", ") -> DataFrame:
    """s, props: per subject a map from property to its values, in order, joined."""
    one = rows.select("s", key.alias("k"), value.alias("v")).groupBy("s", "k").agg(F.array_join(F.sort_array(F.collect_set("v")), separator).alias("v"))
    return one.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("props"))


def type_scan(triples: DataFrame, cls: str) -> DataFrame:
    """s, props: subjects of exactly this class with their properties by local name."""
    of = _types(_iris(triples)).where(F.col("o") == cls).select("s").distinct()
    rows = statements(triples).where(F.col("p") != RDF_TYPE).join(of, "s", "left_semi")
    bags = property_bags(rows, local_hash_slash(F.col("p")), F.col("o"))
    return of.join(bags, "s", "left").select("s", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def conflict_bags(triples: DataFrame, namespace: str) -> DataFrame:
    """s, props of the individuals of a namespace, the namespace left out of keys and values."""
    rows = statements(triples).join(individuals_in(triples, namespace), "s", "left_semi")
    key = F.when(F.col("p") == RDF_TYPE, "rdf_type").otherwise(local_hash_slash(F.col("p")))
    return property_bags(rows, key, F.replace(F.col("o"), F.lit(namespace), F.lit("")), "; ")


def neighbors(triples: DataFrame, iri: str) -> DataFrame:
    """Triples from and to a node; one from the node to itself comes twice."""
    own = triples.select("s", "p", "o", "o_kind")
    return own.where(F.col("s") == iri).unionAll(own.where((F.col("o") == iri) & (F.col("o_kind") == "iri")))


def match_patterns(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions of a basic graph pattern: terms beginning with ``?`` are variables.

    Each pattern is a pruned, filtered scan; patterns that share a variable are joined on it.
    """
    solution: DataFrame | None = None
    for terms in patterns:
        rows = triples.select("s", "p", "o")
        seen: dict[str, str] = {}
        for c, t in zip("spo", terms):
            if not t.startswith("?"):
                rows = rows.where(F.col(c) == t)
            elif t in seen:
                rows = rows.where(F.col(c) == F.col(seen[t]))
            else:
                seen[t] = c
        rows = rows.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()])
        shared = [] if solution is None else [c for c in rows.columns if c in solution.columns]
        if solution is not None and not shared:
            raise ValueError("a pattern shares no variable with those before it")
        solution = rows if solution is None else solution.join(rows, shared)
    if solution is None:
        raise ValueError("no pattern")
    return solution.distinct()


def copy_tbox(source: DataFrame, target: DataFrame) -> DataFrame:
    """Schema triples of ``source`` that ``target`` lacks: those with no individual at either end."""
    abox = individuals(source)
    schema = source.select(*FIELDS).join(abox, "s", "left_anti").join(abox.select(F.col("s").alias("o")), "o", "left_anti")
    return schema.select(*FIELDS).subtract(target.select(*FIELDS))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """s, p, o, side: ``added`` and ``removed`` triples, by one aggregation of both graphs."""
    both = new.select("s", "p", "o", F.lit(1).alias("n"), F.lit(0).alias("m")).unionAll(old.select("s", "p", "o", F.lit(0), F.lit(1)))
    sides = both.groupBy("s", "p", "o").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    return sides.where(F.col("n") != F.col("m")).select("s", "p", "o", F.when(F.col("n") == 1, "added").otherwise("removed").alias("side"))


def triple_id(s: str = "s", p: str = "p", o: str = "o") -> Column:
    return short_hash(F.col(s), F.col(p), F.col(o))


def manual_entries(snapshot: DataFrame, live: DataFrame, known: DataFrame) -> DataFrame:
    """id, s, p, o: triples added by hand since the snapshot, whose id is not among the known ones."""
    added = difference(live, snapshot).where(F.col("side") == "added").select(triple_id().alias("id"), "s", "p", "o")
    return added.join(known.select("id"), "id", "left_anti").withColumns({"change_source": F.lit("MANUAL"), "status": F.lit("approved"), "confidence": F.lit(1.0)})


def add(graph: DataFrame, entries: DataFrame) -> DataFrame:
    return graph.select(*FIELDS).unionAll(entries.select(*FIELDS)).distinct()


def remove(graph: DataFrame, entries: DataFrame) -> DataFrame:
    """Delete where present; datatype and language must agree."""
    return graph.select(*FIELDS).subtract(entries.select(*FIELDS))


def apply_changes(graph: DataFrame, changes: DataFrame) -> DataFrame:
    """scenario_id, s, p, o, o_datatype: the graph under every scenario of ``changes``.

    ``changes``: scenario_id, s, p, new_value. All values of (s, p) give way to the new ones, which
    keep the datatype of a literal they replace, else are decimals. An unknown subject gains a bare triple.
    The result is a graph per scenario by meaning; statements that no scenario touches are spread over the
    scenarios without a join on their keys, only the others are held against the changes.
    """
    changes = cut(changes.select("scenario_id", "s", "p", "new_value"))
    scenarios = changes.agg(F.collect_set("scenario_id").alias("scenario_id"))
    touched = changes.groupBy("s", "p").agg(F.collect_set("scenario_id").alias("__in"))
    known = graph.select("s", "p", "o", "o_kind", "o_datatype").join(small_side(touched), ["s", "p"], "left")
    # One row with the names of all scenarios; each statement goes to those that do not change it.
    every = known.join(F.broadcast(scenarios), F.lit(True))
    kept = every.select(F.explode(F.array_except("scenario_id", F.coalesce("__in", F.array().cast("array<string>")))).alias("scenario_id"), "s", "p", "o", "o_datatype")
    types = known.where((F.col("o_kind") == "literal") & F.col("__in").isNotNull()).groupBy("s", "p").agg(F.min("o_datatype").alias("t"))
    new = changes.join(types, ["s", "p"], "left").select("scenario_id", "s", "p", F.col("new_value").alias("o"), F.coalesce("t", F.lit(XSD + "decimal")).alias("o_datatype"))
    return kept.unionAll(new).distinct()


def remap_iris(triples: DataFrame, mapping: DataFrame, namespace: str) -> DataFrame:
    """Rename subjects and IRI objects of a namespace by ``mapping`` (old, new local names)."""
    m = mapping.select(F.concat(F.lit(namespace), F.col("old")).alias("__old"), F.concat(F.lit(namespace), F.col("new")).alias("__new"))
    by_s = triples.join(m.select(F.col("__old").alias("s"), F.col("__new").alias("__s")), "s", "left")
    by_o = by_s.join(m.select(F.col("__old").alias("o"), F.col("__new").alias("__o")), "o", "left")
    iri = F.when(F.col("o_kind") == "iri", F.coalesce("__o", "o")).otherwise(F.col("o"))
    return by_o.select(F.coalesce("__s", "s").alias("s"), "s_kind", "p", iri.alias("o"), "o_kind", "o_datatype", "o_lang").distinct()


def to_delta(triples: DataFrame) -> DataFrame:
    """Approved entries of all triples of individuals, declarations included, with their ids."""
    own = statements(triples).join(individuals(triples), "s", "left_semi")
    return own.select(triple_id().alias("id"), "s", "p", "o", "o_datatype", "o_lang").distinct().withColumns({"confidence": F.lit(1.0), "status": F.lit("approved")})


def namespace_of(iri: Column, cut_slash: bool = True) -> Column:
    """Up to and with the last ``#``, else the last ``/``."""
    return F.when(iri.contains("#"), F.regexp_extract(iri, "^(.*#)[^#]*$", 1)).when(F.lit(cut_slash) & iri.contains("/"), F.regexp_extract(iri, "^(.*/)[^/]*$", 1))


def _most_frequent(rows: DataFrame) -> DataFrame:
    """namespace, n of the most frequent namespace; ties go to the smaller."""
    n = rows.where(F.col("namespace") != "").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    best = n.agg(F.min_by("namespace", F.struct(-F.col("n"), F.col("namespace"))).alias("namespace"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.where(F.col("namespace").isNotNull())


def tbox_namespace(triples: DataFrame) -> DataFrame:
    """The ``#`` namespace of most classes, W3C ones apart."""
    classes = _types(_iris(triples)).where(F.col("o") == OWL + "Class").select("s").distinct()
    return _most_frequent(classes.where(~F.col("s").startswith("http://www.w3.org/")).select(namespace_of(F.col("s"), False).alias("namespace"))).select("namespace", "n")


def individual_namespace(triples: DataFrame) -> DataFrame:
    """The namespace of at least half of the declared individuals, if there is one."""
    named = _types(_iris(triples)).where(F.col("o") == NAMED_INDIVIDUAL).select("s").distinct()
    return _most_frequent(named.select(namespace_of(F.col("s")).alias("namespace"))).where(F.col("n") * 2 >= F.col("total")).select("namespace", "n")


def graph_namespace(triples: DataFrame) -> DataFrame:
    """The namespace of most triples' subjects, with multiplicity, well-known ones apart."""
    foreign = F.lit(False)
    for x in FOREIGN_NAMESPACES:
        foreign = foreign | F.col("s").startswith(x)
    return _most_frequent(_iris(triples).where(~foreign).select(namespace_of(F.col("s")).alias("namespace"))).select("namespace", "n")


def tbox_summary(triples: DataFrame, namespace: str) -> DataFrame:
    """kind, local_name, range_local: classes, object and datatype properties of a namespace."""
    kinds = _types(_iris(triples)).select("s", F.when(F.col("o") == OWL + "Class", "class").when(F.col("o") == OWL + "ObjectProperty", "object").when(F.col("o") == OWL + "DatatypeProperty", "datatype").alias("kind"))
    kinds = kinds.where(F.col("kind").isNotNull() & F.col("s").startswith(namespace)).distinct()
    ranges = triples.where(F.col("p") == RDFS + "range").groupBy("s").agg(F.min("o").alias("r"))
    xsd = F.when((F.col("kind") == "datatype") & F.col("r").startswith(XSD), local_hash_slash(F.col("r")))
    return kinds.join(ranges, "s", "left").select("kind", F.substring(F.col("s"), F.lit(len(namespace) + 1), F.length("s")).alias("local_name"), xsd.alias("range_local")).distinct()


def direct_graph(rows: DataFrame, namespace: str) -> DataFrame:
    """Triples of flat rows (subject, cls, property, value): every value a plain literal."""
    s = F.concat(F.lit(namespace), F.col("subject"))
    made = F.array(
        triple(s, RDF_TYPE, F.lit(NAMED_INDIVIDUAL), "iri"),
        triple(s, RDF_TYPE, F.concat(F.lit(namespace), F.col("cls")), "iri"),
        triple(s, F.concat(F.lit(namespace), F.col("property")), F.col("value")),
    )
    return rows.select(F.inline(made)).where(F.col("o").isNotNull() & F.col("p").isNotNull()).distinct()


def tree_to_graph(systems: DataFrame, namespace: str) -> DataFrame:
    """Triples of nested systems: ``name, cls, label, comment, attributes, subsystems`` (with components)."""

    def node(prefix: str, parent: str | None, link: str | None) -> list[Column]:
        iri = F.concat(F.lit(namespace), F.col(f"{prefix}.name"))
        out = [
            triple(iri, RDF_TYPE, F.lit(NAMED_INDIVIDUAL), "iri"),
            triple(iri, RDF_TYPE, F.concat(F.lit(namespace), F.col(f"{prefix}.cls")), "iri"),
            triple(iri, RDFS + "label", F.col(f"{prefix}.label")),
            triple(iri, RDFS + "comment", F.col(f"{prefix}.comment")),
        ]
        if parent:
            out.append(triple(F.concat(F.lit(namespace), F.col(f"{parent}.name")), namespace + link, iri, "iri"))
        return out

    known = ("decimal", "integer", "string", "boolean")

    def attributes(df: DataFrame, prefix: str) -> DataFrame:
        rows = df.select(F.concat(F.lit(namespace), F.col(f"{prefix}.name")).alias("s"), F.inline(F.col(f"{prefix}.attributes")))
        kind = F.when(F.col("datatype").isin(*known), F.col("datatype")).otherwise("string")
        return rows.select("s", F.lit("iri").alias("s_kind"), F.concat(F.lit(namespace), F.col("name")).alias("p"), F.col("value").alias("o"), F.lit("literal").alias("o_kind"), F.concat(F.lit(XSD), kind).alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))

    a = systems.select(F.struct(*systems.columns).alias("x"))
    b = a.select("x", F.explode("x.subsystems").alias("y"))
    c = b.select("y", F.explode("y.components").alias("z"))
    parts = [a.select(F.inline(F.array(*node("x", None, None)))), b.select(F.inline(F.array(*node("y", "x", "hasSubsystem")))), c.select(F.inline(F.array(*node("z", "y", "hasComponent"))))]
    parts += [attributes(a, "x"), attributes(b, "y"), attributes(c, "z")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("o").isNotNull()).distinct()


def first_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of every key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")
