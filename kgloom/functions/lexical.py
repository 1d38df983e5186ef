"""Column expressions for lexical forms: white space, local names, typed literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space, and the four separators
# that are stripped with them.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
OWL = "http://www.w3.org/2002/07/owl#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"

#: Digits that an exponent may shift a number by; a number beyond keeps its exponent in its canonical text.
MAX_SHIFT = 100_000


def strip(c: Column) -> Column:
    """Without white space at either end (Spark's trim knows only the space)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def local_name(c: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:``."""
    return F.regexp_extract(c, r"[^#/:]*\z", 0)


_NUMBER = r"^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?\z"


def with_canonical(df: DataFrame, value: str, range_local: str, out: str) -> DataFrame:
    """Add ``out``: the canonical text of the literal ``value`` of the XSD type ``range_local``.

    Null where it is not valid for the type. integer: sign and digits; decimal, double, float: the
    same with fraction and exponent; both in plain notation without plus sign or needless zeros,
    minus zero as ``0``; where the exponent is beyond ``MAX_SHIFT``, as digits and exponent (``15e200000``). boolean: true or
    false. date: an existing day. Any other type is a string, valid unless blank.
    Written in steps, so that no step repeats the expression of the one before.
    """
    kept = df.columns
    kind, t = F.col(f"`{range_local}`"), F.col("__t")
    numeric = kind.isin("decimal", "double", "float", "integer", "int", "long")

    def part(i: int) -> Column:
        return F.regexp_extract(F.when(numeric, t), _NUMBER, i)

    steps = (
        df.withColumn("__t", strip(F.col(value)))
        .withColumns({"__sign": part(1), "__ip": part(2), "__fp": part(3), "__ex": part(4)})
        .withColumn("__shift", F.when(F.col("__ex") == "", 0).otherwise(F.col("__ex").try_cast("int")))
        .withColumn("__shift", F.when((F.col("__ip") != "") & (F.abs("__shift") <= MAX_SHIFT) & (~kind.isin("integer", "int", "long") | (F.concat("__ex", "__fp") == "") & ~t.contains("e") & ~t.contains("E")), F.col("__shift")))
        .withColumn("__point", F.length("__ip") + F.col("__shift"))
        .withColumn("__d", F.concat(F.repeat(F.lit("0"), F.greatest(1 - F.col("__point"), F.lit(0))), "__ip", "__fp", F.repeat(F.lit("0"), F.greatest(F.col("__shift") - F.length("__fp"), F.lit(0)))))
        .withColumn("__cut", F.greatest("__point", F.lit(1)))
        .withColumns({"__high": F.ltrim(F.substring("__d", F.lit(1), F.col("__cut")), F.lit("0")), "__low": F.rtrim(F.substring("__d", F.col("__cut") + 1, F.length("__d")), F.lit("0"))})
    )
    number = F.concat(
        F.when((F.col("__sign") == "-") & (F.concat("__high", "__low") != ""), "-").otherwise(""),
        F.when(F.col("__high") == "", "0").otherwise(F.col("__high")),
        F.when(F.col("__low") == "", "").otherwise(F.concat(F.lit("."), "__low")),
    )
    low = F.lower(t)
    # The digits without zeros at either end, and the exponent that belongs to them.
    digits = F.ltrim(F.rtrim(F.concat("__ip", "__fp"), F.lit("0")), F.lit("0"))
    zeros = F.length(F.concat("__ip", "__fp")) - F.length(F.rtrim(F.concat("__ip", "__fp"), F.lit("0"))) - F.length("__fp")
    exponent = F.col("__ex").try_cast("decimal(38,0)") + zeros
    far = F.when((F.col("__ip") != "") & (F.col("__ex") != "") & kind.isin("decimal", "double", "float"), F.when(digits == "", "0").otherwise(
        F.concat(F.when(F.col("__sign") == "-", "-").otherwise(""), digits, F.lit("e"), F.coalesce(exponent.cast("string"), F.concat(F.col("__ex"), F.lit("+"), zeros.cast("string"))))
    ))
    text = (
        F.when(numeric, F.when(F.col("__shift").isNotNull(), number).otherwise(far))
        .when(kind == "boolean", F.when(low.isin("true", "1"), "true").when(low.isin("false", "0"), "false"))
        .when(kind == "date", F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & t.try_cast("date").isNotNull(), t))
        .otherwise(F.when(t != "", t))
    )
    return steps.select(*[F.col(f"`{c}`") for c in kept if c != out], text.alias(out))
