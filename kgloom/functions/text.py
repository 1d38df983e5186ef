"""The scalar kernel: string functions as column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgloom.functions.lexical import RDF_TYPE, XSD, strip

# Words that an acronym leaves out.
ACRONYM_STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
#: At or above AUTO two names are the same; from BAND up to it a judge decides; below they differ.
BAND, AUTO = 0.40, 0.85
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def slugify(text: Column) -> Column:
    """Anchor of a heading: lower case, words joined by hyphens; ``section`` if nothing is left."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", "-"), r"^-+|-+$", "")
    return F.when(joined == "", "section").otherwise(joined)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """1-based first and last line of the characters from ``start`` up to ``end``."""
    first = 1 + newlines(F.substring(text, F.lit(1), start))
    return F.struct(first.alias("line_start"), (first + newlines(F.substring(text, start + 1, end - start))).alias("line_end"))


def section_context(path: Column) -> Column:
    """Titles from the outermost inwards, or ``(no section)``."""
    return F.when(F.size(path) > 0, F.array_join(F.transform(path, lambda x: x["title"]), " > ")).otherwise("(no section)")


def llm_context(path: Column, text: Column) -> Column:
    return F.concat(F.lit("[Section: "), section_context(path), F.lit("]\n\n"), text)


def locator_uri(locator: Column) -> Column:
    """``file://`` address with a page or line fragment where there is one."""
    return F.concat(
        F.lit("file://"),
        locator["source_path"],
        F.when(locator["page"].isNotNull(), F.concat(F.lit("#page="), locator["page"].cast("string")))
        .when(locator["line_start"].isNotNull(), F.concat(F.lit("#L"), locator["line_start"].cast("string")))
        .otherwise(""),
    )


def initials(text: Column) -> Column:
    """Capital first letters of the words that count in an acronym."""
    content = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1), lambda w: ~F.lower(w).isin(*ACRONYM_STOP_WORDS))
    return F.array_join(F.transform(content, lambda w: F.upper(F.left(w, F.lit(1)))), "")


def is_acronym(short: Column, long: Column) -> Column:
    """``short`` (2 to 8 characters) spells the initials of ``long``."""
    return F.length(short).between(2, 8) & (F.upper(short) == initials(long))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def strip_separators(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[_\-\s]+", ""))


def similarity(a: Column, b: Column) -> Column:
    """``struct<score, method>``: the same text, the same but for separators, an acronym, else shared words."""
    exact = F.lower(strip(a)) == F.lower(strip(b))
    same = strip_separators(a) == strip_separators(b)
    acronym = is_acronym(a, b) | is_acronym(b, a)
    score = F.when(exact | same | acronym, 1.0).otherwise(token_jaccard(a, b))
    return F.struct(score.alias("score"), F.when(~exact & ~same & acronym, "acronym").otherwise("string_sim").alias("method"))


def split_camel(name: Column) -> Column:
    """Words of a camel-case or underscored name, separated by spaces."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])(?=[A-Z])", "$1 "), "([A-Z])(?=[A-Z][a-z])", "$1 ")
    return F.regexp_replace(spaced, r"[_\-]+", " ")


def iri_similarity(a: Column, b: Column) -> Column:
    """Similarity of two local names: equal but for separators, acronym of the other's words, shared words."""
    x, y = split_camel(a), split_camel(b)
    same = strip_separators(a) == strip_separators(b)
    return F.when(same | is_acronym(a, y) | is_acronym(b, x), 1.0).otherwise(token_jaccard(x, y))


def normalize_instance(name: Column) -> Column:
    """Without a trailing number, then without a capital that follows a small letter; never empty."""
    short = F.regexp_replace(F.regexp_replace(name, r"\d+$", ""), "(?<=[a-z])[A-Z]$", "")
    return F.when(short == "", name).otherwise(short)


def class_instance_similarity(cls: Column, instance: Column) -> Column:
    """The best of the raw and the normalised name and of one starting with the other; 0 if one is empty."""
    n = normalize_instance(instance)
    c, i = F.lower(cls), F.lower(n)
    prefix = F.when(i.startswith(c) | c.startswith(i), 1.0).otherwise(0.0)
    best = F.greatest(iri_similarity(cls, instance), iri_similarity(cls, n), prefix)
    return F.when((F.coalesce(cls, F.lit("")) == "") | (F.coalesce(instance, F.lit("")) == ""), 0.0).otherwise(best)


def conflict_similarity(subject: Column, obj: Column, conflict_type: Column, subject_type: Column, object_type: Column, attribute: Column) -> Column:
    """How well a conflict fits a rule: both ends' names in the better order, and the attribute's name."""
    s, o = F.coalesce(subject, F.lit("")), F.coalesce(obj, F.lit(""))
    st, ot = F.coalesce(subject_type, F.lit("")), F.coalesce(object_type, F.lit(""))
    straight = (class_instance_similarity(st, s) + class_instance_similarity(ot, o)) / 2
    swapped = (class_instance_similarity(st, o) + class_instance_similarity(ot, s)) / 2
    name = F.greatest(straight, swapped)
    hit = F.contains(F.coalesce(conflict_type, F.lit("")), attribute) & (attribute != "")
    return F.when(hit, 0.5 + 0.5 * name).otherwise(0.6 * name)


def local_hash_slash(iri: Column) -> Column:
    """After the last ``#``, then the last ``/``."""
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def local_any(iri: Column) -> Column:
    """After the last ``#``, ``:`` and ``/``."""
    return F.substring_index(F.substring_index(F.substring_index(iri, "#", -1), ":", -1), "/", -1)


def local_first(iri: Column) -> Column:
    """After ``#`` if there is one, else after the last ``/``, else the whole."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")


def is_numeric(text: Column) -> Column:
    return first_number(text).isNotNull()


def found_in_text(value: Column, text: Column, tolerance: float = 0.01) -> Column:
    """Whether the text states the value: as a part, or as a number within 1 % (zero only as zero)."""
    e = first_number(value)
    near = F.exists(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda n: F.when(e == 0, n.try_cast("double") == 0).otherwise(F.abs(n.try_cast("double") - e) / F.abs(e) <= tolerance))
    return F.contains(F.lower(text), F.lower(value)) | F.coalesce(e.isNotNull() & near, F.lit(False))


def expand_datatype(datatype: Column) -> Column:
    """Full IRI of ``xsd:`` names; full IRIs stay; anything else is no datatype."""
    return F.when(datatype.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(datatype, F.lit(5), F.length(datatype)))).when(datatype.rlike("^https?://"), datatype)


def make_iri(local: Column, namespace: Column | str) -> Column:
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    cleaned = F.regexp_replace(F.regexp_replace(local, r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return (
        F.when(local.startswith("http"), local)
        .when(local == "rdf:type", RDF_TYPE)
        .when(local.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(local, F.lit(5), F.length(local))))
        .otherwise(F.concat(ns, cleaned))
    )


def resolve_iri(value: Column, namespace: str, aliases: Column) -> Column:
    """Full IRI, alias, prefixed name, else a name of the namespace, in this order."""
    return F.when(value.startswith("http"), value).otherwise(F.coalesce(F.try_element_at(aliases, value), F.when(value.contains(":"), value), F.concat(F.lit(namespace), value)))


def object_kind(o: Column, datatype: Column, lang: Column | None = None) -> Column:
    """``literal`` with a datatype or language, else ``iri`` for an address, else ``literal``."""
    lang = F.lit(None).cast("string") if lang is None else lang
    return F.when(datatype.isNotNull() | lang.isNotNull(), "literal").when(o.startswith("http"), "iri").otherwise("literal")


def looks_like_iri(value: Column, datatype: Column) -> Column:
    return datatype.isNull() & (value.startswith("http") | (value.contains(":") & ~value.startswith('"')))


def label_from_iri(iri: Column) -> Column:
    """Words of a local name: camel case split, underscores to spaces."""
    spaced = F.regexp_replace(local_any(iri), "([a-z0-9])(?=[A-Z])", "$1 ")
    return strip(F.regexp_replace(F.regexp_replace(spaced, "_", " "), r"\s+", " "))


def short_hash(*parts: Column, sep: str = "|") -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts; a null part is an empty one."""
    return F.left(F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(16))


def pair_hash(a: Column, b: Column) -> Column:
    return short_hash(F.least(a, b), F.greatest(a, b))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s*\[T-\d{3}\]", ""), "  +", " ")


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\[T-\d{3,}\])"), 1)


def title_from_stem(stem: Column, suffix: str = "") -> Column:
    words = F.split(F.regexp_replace(stem, "[-_]", " "), " ")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    return F.concat(titled, F.lit(suffix))


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """``value operator threshold`` as numbers where both are, else as text; null values give null."""
    x, y = value.try_cast("double"), threshold.try_cast("double")
    both = x.isNotNull() & y.isNotNull()

    def either(numeric: Column, textual: Column) -> Column:
        return F.when(both, numeric).otherwise(textual)

    return (
        F.when(operator == ">", either(x > y, value > threshold))
        .when(operator == "<", either(x < y, value < threshold))
        .when(operator == ">=", either(x >= y, value >= threshold))
        .when(operator == "<=", either(x <= y, value <= threshold))
        .when(operator == "==", either(x == y, value == threshold))
        .when(operator == "!=", either(x != y, value != threshold))
    )
