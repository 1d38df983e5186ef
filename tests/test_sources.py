"""Reading and writing graphs, files and artifacts; providers; streams; the driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom import providers
from kgloom.functions.lexical import RDF_TYPE, XSD
from kgloom.operators.wide import Property, WideStore
from kgloom.providers import functions as pf
from kgloom.sources import files, rdf
from kgloom.streaming import ingest

XML = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [<!ENTITY xsd "http://www.w3.org/2001/XMLSchema#">]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="urn:k#" xml:base="urn:k">
  <Pump rdf:about="#P1"><mass rdf:datatype="&xsd;decimal">3.5</mass><label xml:lang="en">Pump</label><on rdf:resource="#T1"/></Pump>
  <rdf:Description rdf:about="#P1"><note>plain &amp; simple</note><part><Valve rdf:about="#V1"/></part></rdf:Description>
  <Pump rdf:about="#P1"/>
</rdf:RDF>"""
TTL = """@prefix k: <urn:k#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
k:P1 a k:Pump ; k:mass "3.5"^^xsd:decimal ; k:label "Pump"@en ; k:on k:T1 ; k:note "plain & simple" ; k:part k:V1 .
k:V1 a k:Valve .
"""


def test_xml_and_turtle_say_the_same(spark, rows, tmp_path):
    (tmp_path / "a.owl").write_text(XML)
    (tmp_path / "b.ttl").write_text(TTL)
    a, b = rdf.load_graph(spark, str(tmp_path / "a.owl")), rdf.load_graph(spark, str(tmp_path / "b.ttl"))
    assert rows(a) == rows(b) and a.count() == 7
    assert ("urn:k#P1", "iri", "urn:k#mass", "3.5", "literal", XSD + "decimal", None) in rows(a)
    assert rdf.load_graph(spark, str(tmp_path)).count() == 7
    with pytest.raises(Exception):
        rdf.load_graph(spark, str(tmp_path / "none.ttl")).count()


def test_turtle_details():
    got = rdf.parse_turtle('@base <urn:b/> . <x> <p> 1, 2.5, 1e3, true, "a\\n\\"b", """long "x" text""" ; <q> [ <r> <s> ] , ( <i> "j" ) . _:n <p> <x> .')
    objects = [(o, k, d) for _, _, p, o, k, d, _ in got if p == "urn:b/p"]
    assert objects[:4] == [("1", "literal", XSD + "integer"), ("2.5", "literal", XSD + "decimal"), ("1e3", "literal", XSD + "double"), ("true", "literal", XSD + "boolean")]
    assert objects[4][0] == 'a\n"b' and objects[5][0] == 'long "x" text' and got[-1][:2] == ("_:n", "bnode")
    assert sum(p.endswith("first") for _, _, p, *_ in got) == 2
    with pytest.raises(ValueError):
        rdf.parse_turtle("k:a k:b k:c .")


def test_ntriples_round_trip(spark, rows, tmp_path):
    data = [("urn:a", "iri", "urn:p", 'say "x"\n\tback\\slash', "literal", None, None), ("urn:a", "iri", "urn:p", "5", "literal", XSD + "int", None), ("_:b", "bnode", "urn:p", "urn:o", "iri", None, None), ("urn:a", "iri", "urn:p", "hé", "literal", None, "fr")]
    df = spark.createDataFrame(data, "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
    rdf.save_graph(df, str(tmp_path / "nt"), "nt")
    back = rows(rdf.read_ntriples(spark, str(tmp_path / "nt")))
    assert [r[:3] + r[4:] for r in back] == [r[:3] + r[4:] for r in sorted(data, key=repr)]
    read = rows(rdf.load_graph(spark, str(tmp_path / "nt" / "*.txt")))
    assert len(read) == len(data) and set(read) - set(back) == {r for r in read if r[1] == "bnode"}
    rdf.save_graph(df, str(tmp_path / "pq"))
    assert rows(spark.read.parquet(str(tmp_path / "pq"))) == sorted(data, key=repr)


ALPHABET = st.text(alphabet=st.sampled_from(list("aé\\\"'\n\r\t #.<>&]é\U0001F600")) | st.characters(blacklist_categories=("Cs", "Cc", "Cn")), max_size=30)


def test_all_texts_survive_every_format(spark, rows, tmp_path):
    texts = ["C:\\new", "\\", '"', "a\\u0041", "]]>", "<b>&amp;</b>", "\n\r\t", "é\U0001F600", " lead", "x" * 100_000, "\\\\n" * 2000]

    @given(st.lists(ALPHABET, min_size=30, max_size=30))
    @settings(max_examples=1, deadline=None)
    def more(found):
        texts.extend(found)

    more()
    data = sorted({("urn:a#s" + str(i), "iri", "urn:v#p", t, "literal", None, ("en" if i % 3 == 0 else None)) for i, t in enumerate(texts)} | {("urn:a#s1", "iri", "urn:v#q", "5", "literal", XSD + "int", None), ("urn:a#s1", "iri", RDF_TYPE, "urn:v#C", "iri", None, None)}, key=repr)
    df = spark.createDataFrame(data, "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
    for fmt in ("nt", "turtle", "xml"):
        rdf.save_graph(df, str(tmp_path / fmt), fmt, {"v": "urn:v#"}, 3)
        back = rdf.read_ntriples(spark, str(tmp_path / fmt)) if fmt == "nt" else rdf.load_graph(spark, str(tmp_path / fmt), fmt)
        assert rows(back) == data, fmt
    with pytest.raises(Exception, match="no name for the property"):
        rdf.save_graph(df.selectExpr("s", "s_kind", "'urn:v#1' AS p", "o", "o_kind", "o_datatype", "o_lang"), str(tmp_path / "bad"), "xml")


def test_ntriples_lines_are_read_or_refused(spark, rows, tmp_path):
    p = tmp_path / "a.nt"
    p.write_text('# head\n\n<urn:a> <urn:p> "x" . # behind\n_:b1 <urn:p> _:b2.\n<urn:a><urn:p><urn:\\u0062>.\n<urn:a> <urn:p> "\\u00e9\\U0001F600\\\\n"@en-GB .\n')
    assert rows(rdf.read_ntriples(spark, str(p)), "o") == sorted([("x",), ("_:b2",), ("urn:b",), ("é\U0001F600\\n",)], key=repr)
    p.write_text('<urn:a> <urn:p> "x" .\nrubbish\n')
    with pytest.raises(Exception, match="no triple"):
        rdf.read_ntriples(spark, str(p)).collect()


def test_blank_nodes_are_those_of_their_file(spark, rows, tmp_path):
    for i in (1, 2):
        (tmp_path / f"f{i}.ttl").write_text(f'_:x <urn:p> "{i}" . [] <urn:p> "m{i}" .')
    got = rows(rdf.load_graph(spark, str(tmp_path)), "s", "o")
    assert len({s for s, _ in got}) == 4
    made = rdf.parse_turtle("_:b1 <urn:p> [ <urn:q> 1 ] .")
    assert len({s for s, *_ in made}) == 2


def test_parse_types_and_relative_references():
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="urn:v#" xml:base="http://x.org/d/doc">'
    got = list(rdf.parse_xml(head + '<rdf:Description rdf:about="../e"><v:size rdf:parseType="Resource"><v:unit>m</v:unit><v:value>3</v:value></v:size><v:note rdf:parseType="Literal">a<b>c</b></v:note></rdf:Description></rdf:RDF>'))
    assert got[0][0] == "http://x.org/e" and got[0][4] == "bnode" and {(r[0] == got[0][3], r[2], r[3]) for r in got[1:3]} == {(True, "urn:v#unit", "m"), (True, "urn:v#value", "3")}
    assert got[3][3].startswith("a<b") and got[3][5].endswith("XMLLiteral")
    assert rdf.parse_turtle("@base <http://x.org/d/doc> . <../e> <#f> <g?h> .")[0][:4] == ("http://x.org/e", "iri", "http://x.org/d/doc#f", "http://x.org/d/g?h")


def test_documents(spark, rows, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\n\n\nx\n")
    (tmp_path / "b.txt").write_text("1 One\nbody\n")
    got = {r["source_format"]: r["markdown"] for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"md": "# A\n\nx\n", "txt": "# 1 One\nbody"}
    with pytest.raises(FileNotFoundError):
        files.load_documents(spark, str(tmp_path / "no"))
    (tmp_path / "p.pdf").write_text("x")
    with pytest.raises(ValueError, match="PDF"):
        files.load_documents(spark, str(tmp_path))
    (tmp_path / "p.pdf").unlink()
    (tmp_path / "c.doc").write_text("x")
    with pytest.raises(ValueError):
        files.load_documents(spark, str(tmp_path))


def test_rule_and_knowledge_files(spark, rows, tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("namespace: urn:n#\nrules:\n- {id: r1, name: N, subject_type: A, object_type: null, when: {attribute: m, operator: '>', value: 3}}\n- {id: r2, name: M, when: {attribute: c, operator: '==', value: red, unit: u}, severity: critical}\n")
    r = files.load_rules(spark, str(p))
    assert rows(r, "rule_id", "namespace", "value", "severity", "aggregate") == [("r1", "urn:n#", "3", "warning", "each"), ("r2", "urn:n#", "red", "critical", "each")]
    p.write_text("")
    assert files.load_rules(spark, str(p)).count() == 0 and files.load_scenarios(spark, str(p))[1].count() == 0
    p.write_text("rules:\n- {id: r1, name: N}\n")
    with pytest.raises(KeyError):
        files.load_rules(spark, str(p))
    p.write_text("namespace: urn:n#\nscenarios:\n- {id: s, description: d, component_local: C, changes: [{property_local: m, new_value: 4}], ground_truth: [r1]}\n")
    ns, s = files.load_scenarios(spark, str(p))
    assert ns == "urn:n#" and s.first()["changes"][0]["new_value"] == "4"
    p.write_text("namespace: urn:n#\npredicates: {is: urn:is}\nrules:\n- {id: k1, subject: A, predicate: is, object: B}\n- {id: k2, subject: A, predicate: m, object: 4, datatype: 'xsd:decimal'}\n")
    assert rows(files.load_org_knowledge(spark, str(p)), "id", "s", "p", "o", "o_datatype") == [("k1", "urn:n#A", "urn:is", "urn:n#B", None), ("k2", "urn:n#A", "urn:n#m", "4", XSD + "decimal")]


def test_artifacts_and_changelog(spark, rows, tmp_path):
    path, schema = str(tmp_path / "art"), "id string, x int"
    assert files.load_artifacts(spark, path, schema).count() == 0 and files.newest_artifact(spark, path) is None
    files.save_artifacts(spark.createDataFrame([("a", 1), ("b", 2)], schema), path)
    files.save_artifacts(spark.createDataFrame([("b", 3)], schema), path)
    assert rows(files.load_artifacts(spark, path, schema)) == [("a", 1), ("b", 3)] and files.list_artifacts(spark, path) == ["a", "b"]
    assert rows(files.load_artifacts(spark, path, schema, ["a"])) == [("a", 1)] and files.newest_artifact(spark, path) == "b"
    log = str(tmp_path / "log")
    assert files.latest_version(files.load_changelog(spark, log)).first()[0] is None
    for v in ("1", "2"):
        files.record_change(spark, log, v, "s", 1, 0)
    assert files.latest_version(files.load_changelog(spark, log)).first()[0] == "2"


# Providers


def test_registry_and_replay():
    assert providers.list_providers() == ["replay", "rule"]
    with pytest.raises(ValueError):
        providers.get_provider("nobody")
    with pytest.raises(providers.ProviderError):
        providers.get_provider("replay").complete(providers.Request("map", "", ""))
    from kgloom.providers.offline import ReplayProvider

    q = providers.Request("map", "s", "u")
    assert ReplayProvider({q.key(): '{"a": 1}'}).complete(q).value == {"a": 1}


def _broken():
    """A provider that fails on some rows; a local class, so that tasks get it by value."""

    class Broken:
        name = "broken"

        def complete(self, request):
            from kgloom import providers as p

            if "bad" in request.user:
                raise p.ProviderError("no answer")
            return p.get_provider("rule").complete(request)

    return Broken


def test_extraction_skips_short_and_failed_chunks(spark, rows):
    text = "The Main Pump has mass of 3.5 kg. PumpUnit2 is near."
    chunks = spark.createDataFrame([("c1", text), ("c2", "bad " + text), ("c3", "Short One.")], "id string, text string")
    got = pf.extract_entities(chunks, _broken(), ["Pump"])
    assert {r["chunk_id"] for r in got.collect()} == {"c1"}
    pump = got.where("text_span = 'The Main Pump'").first() or got.where("text_span like '%Pump%'").first()
    assert pump["entity_type"] == "Pump" and pump["attributes"][0]["value"] == "3.5" and pump["extraction_method"] == "llm"


def test_mapping(spark, rows):
    schema = "id string, chunk_id string, text_span string, entity_type string, confidence double, section_context string, attributes array<struct<name:string,raw_text:string,value:string,unit:string>>, relationships array<struct<predicate:string,target:string,raw_text:string>>"
    e = spark.createDataFrame([("e1", "c", "Main Pump", "Pump", 0.9, None, [("mass", "3.5 kg", "3.5", "kg")], [("feeds", "Tank_1", ""), ("type", "X", "")])], schema)
    got = rows(pf.map_entities(e, providers.get_provider, "urn:n#"), "s", "p", "o", "o_datatype", "ord")
    assert [r[0] for r in got] == ["urn:n#Main_Pump"] * 3
    assert {(r[1], r[2], r[3]) for r in got} == {(RDF_TYPE, "urn:n#Pump", None), ("urn:n#mass", "3.5", XSD + "decimal"), ("urn:n#feeds", "urn:n#Tank_1", None)}


def test_judging_documents_and_rules(spark, rows):
    pairs = spark.createDataFrame([("1", "main pump", "pump", 0.5), ("2", "pump a", "valve a", 0.41), ("3", "x", "x", 1.0), ("4", "p", "q", 0.1)], "id string, surface_a string, surface_b string, score double")
    assert rows(pf.judge_pairs(pairs, providers.get_provider), "candidate_id", "same_entity") == [("1", True), ("2", False)]
    r = spark.createDataFrame([("r1", "A", "B", "massKg", None), ("r2", "A", None, "x", "given")], "rule_id string, subject_type string, object_type string, attribute string, plain_english string")
    done = dict(rows(pf.plain_english(r, providers.get_provider), "rule_id", "plain_english"))
    assert done["r2"] == "given" and "massKg" in done["r1"]
    docs = spark.createDataFrame([("d", "Intro. The mass kg is 4.5 here.")], "doc_id string, text string")
    assert rows(pf.check_documents(r, docs, providers.get_provider), "rule_id", "value")[0] == ("r1", "4.5")
    assert pf.extract_direct(docs, providers.get_provider).count() == 0
    with pytest.raises(Exception, match="no answer"):
        pf.raise_errors(pf.ask(docs.withColumn("text", F.lit("bad")), "extract_direct", {"text": "text"}, _broken())).collect()


# Streams


def test_stream_of_documents(spark, rows, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.md").write_text("# A\none two three\n")
    (src / "b.md").write_text("# A\none two three\n")
    q = ingest.stream_chunks(spark, str(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(60)
    assert rows(spark.read.parquet(out), "text") == [("one two three",)]


def test_stream_of_upserts(spark, rows, tmp_path):
    import datetime as dt

    schema = "s string, p string, o string, loaded_at timestamp"
    src = str(tmp_path / "in")
    for i, v in enumerate(["1", "2"]):
        spark.createDataFrame([("x#A", "x#level", v, dt.datetime(2025, 1, 1 + i))], schema).coalesce(1).write.mode("append").parquet(src)
    store = WideStore(spark, str(tmp_path / "store"), [Property("level", "integer")])
    q = ingest.stream_upserts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), store, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [int(r["level"]) for r in store.read().collect()] == [2]


def test_provider_over_http(spark, rows):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from kgloom.providers.base import ProviderError, Request
    from kgloom.providers.http import ChatProvider

    states, asked = [503, 429, 200, 400, 200], []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(states[len(asked) - 1])
            self.end_headers()
            text = '```json\n{"same": true}\n```' if len(asked) == 3 else "[1]"
            self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = ChatProvider(f"http://127.0.0.1:{server.server_port}/", "m", lambda: {"X-Key": "k"}, wait=0.01)
    got = p.complete(Request("same_entity", "system", "user"))
    assert got.value == {"same": True} and (got.usage.input_tokens, got.usage.output_tokens) == (7, 2) and len(asked) == 3
    assert asked[0]["messages"][1] == {"role": "user", "content": "user"} and asked[0]["model"] == "m"
    for message in ("state 400", "no JSON object"):
        with pytest.raises(ProviderError, match=message):
            p.complete(Request("same_entity", "system", "user"))
    server.shutdown()
    with pytest.raises(ProviderError, match="no answer"):
        ChatProvider("http://127.0.0.1:9/", "m", tries=2, wait=0.01, timeout=1).complete(Request("x", "s", "u"))


def test_answers_keep_the_rows_columns_as_they_are(spark, rows):
    import datetime as dt

    df = spark.createDataFrame([(1, "long enough a text to be asked about", dt.datetime(2025, 1, 1, 1, 2, 3, 456789), [{"a": 1.5, "b": None}], None, bytearray(b"x"))], "id int, text string, t timestamp, xs array<struct<a:double,b:string>>, n decimal(10,2), raw binary")
    got = pf.ask(df, "extract", {"text": "text"}, providers.get_provider)
    assert got.columns[:6] == df.columns and rows(got, *df.columns) == rows(df) and got.first()["error"] is None


# The driver's contract


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and {"p2_found", "p3_found", "p6_found", "rules_pairs"} <= set(e.queries())


def test_nothing_but_the_entry_knows_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent / "kgloom"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "kgloom.llm" in p.read_text()]
    assert users == []


def test_the_rest_imports_without_it():
    code = "import sys; sys.modules['kgloom.llm'] = None\nimport __spark_entry__ as e\nassert 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, timeout=120).returncode == 0
