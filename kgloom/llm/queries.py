"""Queries of the operators of this subpackage and, where it can be had, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import groups, leakage, names, packing, splitting, subjects, survivors
from kgloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variant_pairs(table(spark, sf, "align_candidates"))


def p1_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with the thing that it names: as p1_found, in one row per text."""
    return names.names(table(spark, sf, "align_candidates"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.chunk_boundaries(table(spark, sf, "chunks"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces themselves, with the default overlap."""
    return splitting.chunk_pieces(table(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.mention_groups(table(spark, sf, "align_decisions"), table(spark, sf, "align_candidates"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.surviving_mentions(table(spark, sf, "align_decisions"), table(spark, sf, "align_judgments"), table(spark, sf, "align_candidates"))


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    """The best whole decision of each group, the most complete first."""
    return survivors.surviving_records(table(spark, sf, "align_decisions"), table(spark, sf, "align_judgments"), table(spark, sf, "align_candidates"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in a container of 2,048 tokens, with its length."""
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with the verdict on their slots, also those with other names and numbers filled in."""
    return leakage.leaked_templates(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found = subjects.document_subjects(*(table(spark, sf, t) for t in ("documents", "doc_labels", "subject_areas", "eval_items")))
    return found.select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by subject: documents and sentences of each."""
    found = subjects.document_subjects(*(table(spark, sf, t) for t in ("documents", "doc_labels", "subject_areas", "eval_items")))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A carriage return with line feed is one line end: marked as such first, by as many characters.
_EOL = r"(\x{e000}\x{e001}|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"

P4_SQL = rf"""
WITH c AS (
  SELECT DISTINCT id AS chunk_id, text,
    '[Section: ' || CASE WHEN len(coalesce(list_filter(list_transform(section_path, lambda x: x.title), lambda t: t IS NOT NULL), [])) > 0
      THEN array_to_string(list_filter(list_transform(section_path, lambda x: x.title), lambda t: t IS NOT NULL), ' > ') ELSE '(no section)' END || ']' || chr(10) || chr(10) AS ctx
  FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
o AS (SELECT chunk_id, 2048 - length(ctx) AS room,
    regexp_replace(replace(text, chr(13) || chr(10), chr(57344) || chr(57345)), '{_EOL}([ \t]*{_EOL})+', chr(1), 'g') AS t1 FROM c WHERE length(ctx) + length(text) > 2048),
o2 AS (SELECT *, regexp_replace(t1, '{_EOL}', chr(1), 'g') AS t2 FROM o),
o3 AS (SELECT *, regexp_replace(t2, '([.!?]){_WS}+', '\1' || chr(1), 'g') AS t3 FROM o2),
o4 AS (SELECT *, regexp_replace(t3, '{_WS}+', chr(1), 'g') AS t4 FROM o3),
m AS (SELECT chunk_id, room,
  list_max(list_transform(string_split(t1, chr(1)), lambda u: length(regexp_replace(u, '^{_WS}+|{_WS}+$', '', 'g')))) AS m1,
  list_max(list_transform(string_split(t2, chr(1)), lambda u: length(regexp_replace(u, '^{_WS}+|{_WS}+$', '', 'g')))) AS m2,
  list_max(list_transform(string_split(t3, chr(1)), lambda u: length(regexp_replace(u, '^{_WS}+|{_WS}+$', '', 'g')))) AS m3,
  list_max(list_transform(string_split(t4, chr(1)), lambda u: length(u))) AS m4 FROM o4)
SELECT DISTINCT chunk_id, CASE WHEN m1 <= room THEN 'paragraph' WHEN m2 <= room THEN 'line' WHEN m3 <= room THEN 'sentence' WHEN m4 <= room THEN 'word' ELSE 'character' END AS boundary FROM m
"""

_GROUPS = """
last_ AS (
  SELECT * FROM align_decisions QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY decided_at DESC NULLS LAST, ord DESC) = 1),
approved AS (
  SELECT candidate_id AS key, canonical_entity_id AS canonical, aliases, decided_at, ord,
    list_distinct(list_filter(list_concat([canonical_entity_id], coalesce(merged_entity_ids, [])), lambda x: x IS NOT NULL)) AS own
  FROM last_ WHERE status = 'approved'),
members AS (
  SELECT key, unnest(own) AS id FROM approved
  UNION SELECT key, entity_id_a FROM approved JOIN align_candidates c ON c.id = key WHERE entity_id_a IS NOT NULL
  UNION SELECT key, entity_id_b FROM approved JOIN align_candidates c ON c.id = key WHERE entity_id_b IS NOT NULL),
star AS (SELECT key, id, min(id) OVER (PARTITION BY key) AS hub FROM members),
edges AS (SELECT hub AS a, id AS b FROM star WHERE hub <> id UNION SELECT id, hub FROM star WHERE hub <> id),
reach(node, root) AS (
  SELECT a, a FROM edges
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
found AS (SELECT node AS entity_id, min(root) AS group_id FROM reach GROUP BY 1)
"""

P5_SQL = f"WITH RECURSIVE {_GROUPS} SELECT DISTINCT group_id, entity_id FROM found"

P7_SQL = rf"""
WITH RECURSIVE {_GROUPS},
placed AS (SELECT DISTINCT a.*, f.group_id FROM approved a JOIN star s ON s.key = a.key AND s.id = s.hub JOIN found f ON f.entity_id = s.hub),
ent AS (SELECT group_id, canonical FROM placed WHERE canonical IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY decided_at DESC NULLS LAST, ord DESC) = 1),
surf AS (
  SELECT p.group_id, j.canonical_surface FROM placed p JOIN align_judgments j ON j.candidate_id = p.key AND j.same_entity
  WHERE trim(j.canonical_surface) <> '' AND EXISTS (SELECT 1 FROM align_candidates c WHERE c.id = p.key AND j.canonical_surface IN (c.surface_a, c.surface_b))
  QUALIFY row_number() OVER (PARTITION BY p.group_id ORDER BY CASE judged_by WHEN 'reviewer' THEN 0 WHEN 'rule' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END, judged_at DESC NULLS LAST, canonical_surface) = 1),
al AS (SELECT group_id, count(DISTINCT x)::INT AS n FROM (SELECT group_id, regexp_replace(unnest(aliases), '^{_WS}+|{_WS}+$', '', 'g') AS x FROM placed) WHERE x <> '' GROUP BY 1)
SELECT group_id, canonical AS canonical_entity_id, canonical_surface, coalesce(n, 0) AS n_aliases FROM ent JOIN surf USING (group_id) LEFT JOIN al USING (group_id)
"""


P7_RECORDS_SQL = rf"""
WITH RECURSIVE {_GROUPS},
placed AS (SELECT DISTINCT a.*, f.group_id FROM approved a JOIN star s ON s.key = a.key AND s.id = s.hub JOIN found f ON f.entity_id = s.hub),
merged AS (SELECT candidate_id AS key, len(list_filter(coalesce(merged_entity_ids, []), lambda x: x IS NOT NULL)) AS n_merged FROM last_ WHERE status = 'approved'),
named AS (SELECT p.*, n_merged, len(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '')))::INT AS n_aliases FROM placed p JOIN merged USING (key)),
judged AS (SELECT candidate_id AS key, min(CASE judged_by WHEN 'reviewer' THEN 0 WHEN 'rule' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END) AS t FROM align_judgments WHERE same_entity GROUP BY 1),
ranked AS (SELECT n.*, t, ((canonical IS NOT NULL)::INT + (n_merged > 0)::INT + (n_aliases > 0)::INT)::INT AS n_filled FROM named n LEFT JOIN judged USING (key))
SELECT group_id, key AS candidate_id, canonical AS canonical_entity_id, n_aliases, n_filled FROM ranked
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n_filled DESC, t NULLS LAST, decided_at DESC NULLS LAST, ord DESC) = 1
"""

P9_SQL = r"""
WITH d AS (SELECT doc_id AS k, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id AS k, text FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT k, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[\p{Cf}''’ʼ`*~]+', '', 'g')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM d),
iw AS (SELECT k, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[\p{Cf}''’ʼ`*~]+', '', 'g')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM i),
dx AS (SELECT k, array_to_string(w[n:n + 11], ' ') AS x FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS n FROM dw WHERE len(w) >= 12)),
ix AS (SELECT k, array_to_string(w[n:n + 11], ' ') AS x FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS n FROM iw WHERE len(w) >= 12))
SELECT DISTINCT dx.k AS doc_id, ix.k AS item_id FROM dx JOIN ix USING (x)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_names, p4_found, p4_pieces, p5_found, p7_found, p7_records, p8_containers, p9_found, p9_templates, p10_found, p10_composition)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL, "p7_records": P7_RECORDS_SQL, "p9_found": P9_SQL}
