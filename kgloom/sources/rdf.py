"""RDF text as a table: N-Triples natively, Turtle and RDF/XML through a Python data source; writers of all three.

Blank nodes are named within their file: their labels get a hash of the file's path, so that those of
different files stay apart. The ``part-`` files of one folder are parts of one document.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.lexical import OWL, RDF_TYPE, RDFS, XSD
from kgloom.operators.graph import TRIPLE
from kgloom.session import hadoop_path

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
Row = tuple[str, str, str, str, str, str | None, str | None]
_XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"
_SUFFIXES = {".owl": "xml", ".rdf": "xml", ".xml": "xml", ".ttl": "turtle", ".n3": "turtle", ".nt": "nt"}


def detect_format(path: str, text: str = "") -> str:
    """By suffix, but an XML declaration or element decides."""
    if text.lstrip("﻿ \t\r\n").startswith(("<?xml", "<rdf:RDF", "<!DOCTYPE")):
        return "xml"
    return _SUFFIXES.get("." + path.rsplit(".", 1)[-1].lower(), "turtle")


def _absolute(ref: str, base: str) -> str:
    """A reference resolved against a base; names of other schemes than the hierarchical ones stay as they are."""
    if re.match(r"[A-Za-z][\w+.-]*:", ref) or not base:
        return ref
    if not ref:
        return base.split("#")[0]
    if ref.startswith("#"):
        return base.split("#")[0] + ref
    return urljoin(base, ref) if base.lower().startswith(("http:", "https:", "file:", "ftp:")) else base[: base.rfind("/") + 1] + ref


def _unused(text: str) -> str:
    """A beginning of labels that no label of the text has."""
    stem = "b"
    while re.search(rf"(?:_:|nodeID\s*=\s*[\"'])(?:{stem})\d", text):
        stem += "b"
    return stem


def parse_xml(text: str, scope: str = "") -> Iterator[Row]:
    """Triples of RDF/XML: typed nodes, descriptions, resources, datatypes, languages, node ids, bases, parse types."""
    stem = _unused(text)
    if "<!DOCTYPE" in text and "<!ENTITY" in text:
        for name, value in re.findall(r'<!ENTITY\s+(\w+)\s+"([^"]*)"', text):
            text = text.replace(f"&{name};", value)
        text = re.sub(r"<!DOCTYPE[^\[>]*(\[[^\]]*\])?\s*>", "", text)
    root = ET.fromstring(text.encode())
    made = iter(range(1 << 62))

    def full(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(el: ET.Element, base: str, lang: str | None) -> Iterator[Row]:
        base, lang = el.get(_XML_BASE, base), el.get(_XML_LANG, lang) or None
        about, ident, blank = el.get(f"{{{RDF}}}about"), el.get(f"{{{RDF}}}ID"), el.get(f"{{{RDF}}}nodeID")
        if about is not None:
            s, kind = _absolute(about, base), "iri"
        elif ident is not None:
            s, kind = _absolute("#" + ident, base), "iri"
        else:
            s, kind = "_:" + scope + (blank or f"{stem}{next(made)}"), "bnode"
        el.set("__s", s)
        el.set("__k", kind)
        if full(el.tag) != RDF + "Description":
            yield s, kind, RDF_TYPE, full(el.tag), "iri", None, None
        for name, value in el.attrib.items():
            if name.startswith("{") and not name.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML")):
                yield s, kind, full(name), value, "literal", None, lang
        yield from properties(el, s, kind, base, lang)

    def properties(el: ET.Element, s: str, kind: str, base: str, lang: str | None) -> Iterator[Row]:
        for p in el:
            if not isinstance(p.tag, str):
                continue
            plang = p.get(_XML_LANG, lang) or None
            resource, pblank, kind_of = p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}nodeID"), p.get(f"{{{RDF}}}parseType")
            children = [c for c in p if isinstance(c.tag, str)]
            if resource is not None:
                yield s, kind, full(p.tag), _absolute(resource, base), "iri", None, None
            elif pblank is not None:
                yield s, kind, full(p.tag), "_:" + scope + pblank, "bnode", None, None
            elif kind_of == "Resource":
                inner = f"_:{scope}{stem}{next(made)}"
                yield s, kind, full(p.tag), inner, "bnode", None, None
                yield from properties(p, inner, "bnode", base, plang)
            elif kind_of == "Literal":
                inside = escape(p.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children)
                yield s, kind, full(p.tag), inside, "literal", RDF + "XMLLiteral", None
            elif kind_of == "Collection":
                previous = None
                for c in children:
                    yield from node(c, base, plang)
                    cell = f"_:{scope}{stem}{next(made)}"
                    yield (s, kind, full(p.tag), cell, "bnode", None, None) if previous is None else (previous, "bnode", RDF + "rest", cell, "bnode", None, None)
                    yield cell, "bnode", RDF + "first", c.get("__s"), c.get("__k"), None, None
                    previous = cell
                yield (s, kind, full(p.tag), RDF + "nil", "iri", None, None) if previous is None else (previous, "bnode", RDF + "rest", RDF + "nil", "iri", None, None)
            elif children:
                for c in children:
                    yield from node(c, base, plang)
                    yield s, kind, full(p.tag), c.get("__s"), c.get("__k"), None, None
            else:
                datatype = p.get(f"{{{RDF}}}datatype")
                yield s, kind, full(p.tag), p.text or "", "literal", datatype and _absolute(datatype, base), None if datatype else plang

    base = root.get(_XML_BASE, "")
    if full(root.tag) == RDF + "RDF":
        for el in root:
            if isinstance(el.tag, str):
                yield from node(el, base, root.get(_XML_LANG))
    else:
        yield from node(root, base, None)


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>\s]*>)|(?P<blank>_:[\w.-]*\w)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<num>[+-]?(?:\d+\.\d*|\.?\d+)(?:[eE][+-]?\d+)?(?=[\s;,.\])]|$))
    |(?P<name>[^\W\d]?[\w.-]*:(?:[\w%:-]|\.(?=[\w:%-]))*|[A-Za-z]\w*)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


class _Turtle:
    """A recursive-descent reader of Turtle."""

    def __init__(self, text: str, scope: str = ""):
        self.scope, self.stem = scope, _unused(text)
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"cannot read Turtle at {text[at:at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.made = 0, {}, "", 0
        self.rows: list[Row] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def expect(self, mark: str) -> None:
        if self.next()[1] != mark:
            raise ValueError(f"expected {mark} before token {self.at}")

    def iri(self, ref: str) -> str:
        return _absolute(_unescape(ref[1:-1]), self.base)

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.scope}{self.stem}{self.made}"

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, t = self.next()
        if kind == "iri":
            return self.iri(t), "iri", None, None
        if kind == "blank":
            return f"_:{self.scope}{t[2:]}", "bnode", None, None
        if kind in ("short", "long"):
            value, (k, u) = _unescape(t[3:-3] if kind == "long" else t[1:-1]), self.peek()
            if k == "lang":
                self.next()
                return value, "literal", None, u[1:]
            if k == "type":
                self.next()
                return value, "literal", self.term()[0], None
            return value, "literal", None, None
        if kind == "num":
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if t == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.statements(node, "bnode")
            self.expect("]")
            return node, "bnode", None, None
        if t == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.expect(")")
            rest: tuple[str, str] = (RDF + "nil", "iri")
            for o, k, d, g in reversed(items):
                cell = self.blank()
                self.rows += [(cell, "bnode", RDF + "first", o, k, d, g), (cell, "bnode", RDF + "rest", rest[0], rest[1], None, None)]
                rest = (cell, "bnode")
            return rest[0], rest[1], None, None
        if kind == "name":
            if t == "a":
                return RDF_TYPE, "iri", None, None
            if t in ("true", "false"):
                return t, "literal", XSD + "boolean", None
            prefix, _, local = t.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix}")
            return self.prefixes[prefix] + local, "iri", None, None
        raise ValueError(f"unexpected {t!r}")

    def statements(self, s: str, kind: str) -> None:
        while True:
            p = self.term()[0]
            while True:
                o, k, d, g = self.term()
                self.rows.append((s, kind, p, o, k, d, g))
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]", ""):
                return

    def read(self) -> list[Row]:
        while self.at < len(self.tokens):
            word = self.peek()[1].lower()
            if word in ("@prefix", "prefix"):
                self.next()
                name = self.next()[1].rstrip(":")
                self.prefixes[name] = self.iri(self.next()[1])
            elif word in ("@base", "base"):
                self.next()
                self.base = self.iri(self.next()[1])
            else:
                s, kind, _, _ = self.term()
                if self.peek()[1] != ".":
                    self.statements(s, kind)
                self.expect(".")
                continue
            if self.peek()[1] == ".":
                self.next()
        return self.rows


def parse_turtle(text: str, scope: str = "") -> list[Row]:
    return _Turtle(text, scope).read()


def parse(text: str, fmt: str, scope: str = "") -> Iterator[Row]:
    yield from parse_xml(text, scope) if fmt == "xml" else parse_turtle(text, scope)


def scope_of(path: str) -> str:
    """What sets the blank nodes of a file apart from those of other files."""
    folder, _, name = path.rpartition("/")
    return "f" + hashlib.sha256((folder if name.startswith("part-") else path).encode()).hexdigest()[:12] + "x"


def load_graph(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """The triples of a file, folder or pattern on any storage, as a set; a file per task.

    A missing path is an error. N-Triples, which can be cut between lines, are better read with
    :func:`read_ntriples`.
    """
    target, fs = hadoop_path(spark, path)
    if not fs.globStatus(target):
        raise FileNotFoundError(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                text = content.decode("utf-8-sig", "replace")
                rows = parse(text, detect_format(name, text) if fmt == "auto" else fmt, scope_of(name))
                while chunk := [r for _, r in zip(range(50_000), rows)]:
                    yield pd.DataFrame(chunk, columns=_COLUMNS)

    # Files are opened one at a time; what is repeated is sorted out by the set.
    files = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike(r"/[._][^/]*$")).select("path", "content")
    return files.mapInPandas(read, TRIPLE).distinct()


_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]
_NT = r'^[ \t]*(<[^<>"]*>|_:\S+)[ \t]*<([^<>"]*)>[ \t]*(?:<([^<>"]*)>|(_:[^\s.]+(?:\.+[^\s.]+)*)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^<>"]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)[ \t]*\.[ \t]*(?:#.*)?$'
_PIECE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"


def _resolved(text: Column) -> Column:
    """Escapes resolved in one pass, each once."""

    def one(x: Column) -> Column:
        mark = F.substring(x, 2, 1)
        out = F.when(mark == "u", F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE")).when(mark == "U", F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"))
        for c, to in _ESCAPES.items():
            out = out.when(mark == c, F.lit(to))
        return F.when(~x.startswith("\\"), x).otherwise(F.coalesce(out, mark))

    return F.when(text.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s){_PIECE}"), F.lit(0)), one), "")).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples line by line, splittable and without Python.

    Blank lines and comments are skipped; any other line that is no triple is an error, with the line.
    Blank node labels are those of the files: a folder is one document.
    """
    line = F.col("value")
    g = [F.regexp_extract(line, _NT, i) for i in range(1, 8)]
    blank = g[0].startswith("_:")
    lines = spark.read.text(path).where(~line.rlike(r"^\s*(?:#.*)?$"))
    checked = lines.select(F.when(line.rlike(_NT), line).otherwise(F.raise_error(F.concat(F.lit("no triple: "), line))).alias("value"))
    return checked.select(
        F.when(blank, g[0]).otherwise(_resolved(F.regexp_replace(g[0], "[<>]", ""))).alias("s"), F.when(blank, "bnode").otherwise("iri").alias("s_kind"), _resolved(g[1]).alias("p"),
        F.when(g[2] != "", _resolved(g[2])).when(g[3] != "", g[3]).otherwise(_resolved(g[4])).alias("o"), F.when(g[2] != "", "iri").when(g[3] != "", "bnode").otherwise("literal").alias("o_kind"),
        F.nullif(g[5], F.lit("")).alias("o_datatype"), F.nullif(g[6], F.lit("")).alias("o_lang"),
    )


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One column ``value`` of N-Triples lines."""
    def ref(c, kind):
        return F.when(kind == "bnode", c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).otherwise(""))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(ref(F.col("o"), F.col("o_kind")))
    return triples.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()).select(F.concat(ref(F.col("s"), F.coalesce("s_kind", F.lit("iri"))), F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" .")).alias("value"))


PREFIXES: dict[str, str] = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}
_LOCAL = re.compile(r"[A-Za-z_][\w-]*\Z")


def _turtle_lines(prefixes: Mapping[str, str]):
    def ref(x: str, kind: str) -> str:
        if kind == "bnode":
            return x
        for name, ns in prefixes.items():
            if x.startswith(ns) and _LOCAL.match(x[len(ns) :]):
                return f"{name}:{x[len(ns):]}"
        return "<" + re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", x) + ">"

    def literal(o: str, datatype: str | None, lang: str | None) -> str:
        text = '"' + re.sub(r'["\\\n\r\t]', lambda m: "\\" + {"\n": "n", "\r": "r", "\t": "t"}.get(m[0], m[0]), o) + '"'
        return text + (f"^^{ref(datatype, 'iri')}" if datatype else f"@{lang}" if lang else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [f"@prefix {name}: <{ns}> ." for name, ns in prefixes.items()]
        subject = None
        for b in batches:
            for s, sk, p, o, ok, dt, lang in b[_COLUMNS].where(b.notna(), None).itertuples(index=False):
                said = f"{ref(p, 'iri')} {literal(o, dt, lang) if ok == 'literal' else ref(o, ok)}"
                if (s, sk) == subject:
                    lines[-1] += " ;"
                    lines.append("    " + said)
                else:
                    if subject:
                        lines[-1] += " ."
                    lines.append(f"{ref(s, sk)} {said}")
                    subject = s, sk
            # The last line may yet get its end.
            yield pd.DataFrame({"value": lines[:-1]})
            lines = lines[-1:]
        yield pd.DataFrame({"value": [*lines[:-1], *(x + (" ." if subject else "") for x in lines[-1:])]})

    return run


def _xml_lines(prefixes: Mapping[str, str]):
    def label(x: str) -> str:
        return re.sub(r"[^A-Za-z0-9_.-]", "_", x[2:] if x.startswith("_:") else x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = "".join(f" xmlns:{name}={quoteattr(ns)}" for name, ns in prefixes.items())
        lines, subject = ['<?xml version="1.0" encoding="UTF-8"?>', f"<rdf:RDF{heads}>"], None
        for b in batches:
            for s, sk, p, o, ok, dt, lang in b[_COLUMNS].where(b.notna(), None).itertuples(index=False):
                m = re.search(r"[A-Za-z_][\w.-]*\Z", p)
                if m is None or not m.start():
                    raise ValueError(f"RDF/XML has no name for the property {p}")
                if (s, sk) != subject:
                    if subject:
                        lines.append("  </rdf:Description>")
                    lines.append(f"  <rdf:Description rdf:{'nodeID' if sk == 'bnode' else 'about'}={quoteattr(label(s) if sk == 'bnode' else s)}>")
                    subject = s, sk
                ns = p[: m.start()]
                known = next((name for name, x in prefixes.items() if x == ns), None)
                tag, extra = (f"{known}:{m[0]}", "") if known else (f"p:{m[0]}", f" xmlns:p={quoteattr(ns)}")
                if ok == "literal":
                    extra += f" rdf:datatype={quoteattr(dt)}" if dt else f" xml:lang={quoteattr(lang)}" if lang else ""
                    # Line ends would be normalised and would end the line that is written: they are references.
                    text = escape(o, {"\r": "&#13;", "\n": "&#10;"})
                    lines.append(f"    <{tag}{extra}>{text}</{tag}>")
                else:
                    lines.append(f"    <{tag}{extra} rdf:{'nodeID' if ok == 'bnode' else 'resource'}={quoteattr(label(o) if ok == 'bnode' else o)}/>")
            yield pd.DataFrame({"value": lines})
            lines = []
        yield pd.DataFrame({"value": [*lines, *(["  </rdf:Description>"] if subject else []), "</rdf:RDF>"]})

    return run


def to_document(triples: DataFrame, fmt: str, prefixes: Mapping[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """One column ``value`` of lines; those of a partition are a whole Turtle or RDF/XML document.

    Statements of a subject stand together. ``parts`` is the number of documents; triples with a null
    subject, property or object are left out. Rows are written as they come: no document is held in memory.
    """
    prefixes = PREFIXES | dict(prefixes or {})
    whole = triples.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()).select("s", F.coalesce("s_kind", F.lit("iri")).alias("s_kind"), "p", "o", F.coalesce("o_kind", F.lit("literal")).alias("o_kind"), "o_datatype", "o_lang").distinct()
    spread = whole.repartition(parts, "s") if parts else whole.repartition("s")
    return spread.sortWithinPartitions("s", "p", "o").mapInPandas((_xml_lines if fmt == "xml" else _turtle_lines)(prefixes), "value string")


def save_graph(triples: DataFrame, path: str, fmt: str = "parquet", prefixes: Mapping[str, str] | None = None, parts: int | None = None) -> None:
    """Parquet, N-Triples (``nt``), Turtle (``turtle``) or RDF/XML (``xml``), written in parallel; every part is a whole document."""
    if fmt == "parquet":
        triples.write.mode("overwrite").parquet(path)
    elif fmt == "nt":
        to_ntriples(triples).write.mode("overwrite").text(path)
    elif fmt in ("turtle", "xml"):
        to_document(triples, fmt, prefixes, parts).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")
