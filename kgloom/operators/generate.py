"""A taxonomy of engineered systems and systems generated from it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.session import cut, drop

CLASS_SCHEMA = "local string, label string, parent string, domains array<string>, is_component boolean"
ATTRIBUTE = "array<struct<name:string,value:string,datatype:string>>"
NODE = f"name:string,cls:string,label:string,comment:string,attributes:{ATTRIBUTE}"
SYSTEM_SCHEMA = f"name string, cls string, label string, comment string, attributes {ATTRIBUTE}, subsystems array<struct<{NODE},components:array<struct<{NODE}>>>>"

# Our own small taxonomy; parent -> children, and the domains of each branch.
_TREE: dict[str, tuple[str, ...]] = {
    "System": ("Spacecraft", "Aircraft", "GroundSystem"),
    "Spacecraft": ("SmallSatellite", "Lander", "UpperStage"),
    "Aircraft": ("AirTaxi", "SurveyDrone"),
    "GroundSystem": ("GroundStation",),
    "Subsystem": ("PowerSubsystem", "PropulsionSubsystem", "ThermalSubsystem", "CommunicationSubsystem", "GuidanceSubsystem", "StructureSubsystem"),
    "PropulsionSubsystem": ("ColdGasPropulsion", "ElectricPropulsion"),
    "Component": ("Battery", "SolarPanel", "Thruster", "Tank", "Radiator", "Transceiver", "Antenna", "ReactionWheel", "StarTracker", "Computer"),
}
_DOMAINS: dict[str, tuple[str, ...]] = {"SmallSatellite": ("orbit",), "Lander": ("surface",), "UpperStage": ("launch",), "AirTaxi": ("air",), "SurveyDrone": ("air",), "GroundStation": ("ground",), "SolarPanel": ("orbit", "surface"), "StarTracker": ("orbit", "launch"), "ReactionWheel": ("orbit",)}
ALL_DOMAINS = ("air", "ground", "launch", "orbit", "surface")
DATA_PROPERTIES = {"massKg": "decimal", "powerW": "decimal", "trl": "integer", "maker": "string", "redundant": "boolean"}


@dataclass(frozen=True)
class TaxonomyClass:
    local: str
    label: str
    parent: str | None
    domains: tuple[str, ...]
    is_component: bool


def taxonomy_classes() -> list[TaxonomyClass]:
    parents = {c: p for p, cs in _TREE.items() for c in cs}
    names = sorted({*_TREE, *parents})

    def label(n: str) -> str:
        return "".join(f" {c}" if c.isupper() and i else c for i, c in enumerate(n))

    return [TaxonomyClass(n, label(n), parents.get(n), _DOMAINS.get(n, ALL_DOMAINS), parents.get(n) == "Component") for n in names]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.local, c.label, c.parent, list(c.domains), c.is_component) for c in taxonomy_classes()], CLASS_SCHEMA)


def classes_for_domain(classes: DataFrame, domain: str) -> DataFrame:
    return classes.where(F.array_contains("domains", domain))


def class_closure(classes: DataFrame, child: str = "local", parent: str = "parent") -> DataFrame:
    """child, ancestor, distance of every class and all above it, by the shortest way; a cycle ends where it closes.

    Every round joins the paths found so far with themselves, so their length doubles; the rounds end
    when no path is new or shorter, whatever the depth.
    """
    edges = classes.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct()
    paths, last = cut(edges.withColumn("distance", F.lit(1))), None
    while True:
        state = paths.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if state == last:
            return paths
        last = state
        on = paths.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("__a"), F.col("distance").alias("__d"))
        longer = paths.join(on, "ancestor").select("child", F.col("__a").alias("ancestor"), (F.col("distance") + F.col("__d")).alias("distance"))
        known, paths = paths, cut(paths.unionAll(longer).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))
        drop(known)


def concrete(classes: DataFrame, root: str, domain: str | None = None) -> DataFrame:
    """local: classes under ``root`` that no other class is under, of the domain if one is given."""
    under = class_closure(classes).where(F.col("ancestor") == root).select(F.col("child").alias("local"))
    leaves = classes.join(under, "local", "left_semi").join(classes.select(F.col("parent").alias("local")).where(F.col("local").isNotNull()).distinct(), "local", "left_anti")
    return (classes_for_domain(leaves, domain) if domain else leaves).select("local")


def generate_systems(domain: str, count: int, seed: int = 0) -> list[dict[str, Any]]:
    """Systems of the domain as nested values, the same ones for the same seed."""

    def pick(options: list[str], *key: Any) -> str:
        h = hashlib.sha256(repr((seed, *key)).encode()).digest()
        return options[int.from_bytes(h[:8], "big") % len(options)]

    classes = taxonomy_classes()
    parents = {c.parent for c in classes}
    here = [c for c in classes if domain in c.domains]
    roots = {"Spacecraft", "Aircraft", "GroundSystem"}
    systems = [c.local for c in here if c.parent in roots] or ["SmallSatellite"]
    subsystems = [c.local for c in here if c.local not in parents and c.parent in ("Subsystem", "PropulsionSubsystem")]
    components = [c.local for c in here if c.is_component]

    def node(cls: str, name: str) -> dict[str, Any]:
        number = int.from_bytes(hashlib.sha256(f"{seed}/{name}".encode()).digest()[:4], "big")
        attributes = [("massKg", f"{number % 900 / 10 + 0.1:.1f}"), ("powerW", f"{number // 7 % 500 / 10:.1f}"), ("trl", str(number % 9 + 1)), ("maker", pick(["Norvik", "Aurexa", "Tamsel"], name)), ("redundant", "true" if number % 2 else "false")]
        return {"name": name, "cls": cls, "label": name.replace("_", " "), "comment": f"A {cls} of the {domain} domain.", "attributes": [{"name": n, "value": v, "datatype": DATA_PROPERTIES[n]} for n, v in attributes]}

    out = []
    for i in range(count):
        top = node(cls := pick(systems, "system", i), f"{cls}_{i + 1}")
        top["subsystems"] = []
        for sub in subsystems:
            s = node(sub, f"{sub}_{i + 1}")
            s["components"] = [node(c := pick(components, sub, i, k), f"{c}_{i + 1}_{sub}_{k + 1}") for k in range(2)]
            top["subsystems"].append(s)
        out.append(top)
    return out


def systems_table(spark: SparkSession, domain: str, count: int, seed: int = 0) -> DataFrame:
    return spark.createDataFrame(generate_systems(domain, count, seed), SYSTEM_SCHEMA)
