"""The commands, end to end on small files."""

from __future__ import annotations

import pyspark.sql.functions as F

from kgloom import cli


def test_commands(spark, tmp_path, capsys):
    ns, a, b = "urn:k#", str(tmp_path / "a"), str(tmp_path / "b")
    assert cli.main(["generate", "--domain", "orbit", "--namespace", ns, "--save", a]) == 0
    assert cli.main(["generate", "--domain", "orbit", "--namespace", ns, "--save", b, "--count", "2"]) == 0
    assert cli.main(["evaluate", "--source", f"{b}/*.txt", "--working", f"{a}/*.txt"]) == 0
    assert "individuals" in capsys.readouterr().out
    assert cli.main(["diff", "--old", f"{a}/*.txt", "--new", f"{b}/*.txt"]) == 0
    assert "added" in capsys.readouterr().out
    (tmp_path / "r.yaml").write_text("namespace: urn:k#\nrules:\n- {id: r1, name: n, subject_type: SmallSatellite, object_type: Battery, when: {attribute: massKg, operator: '>', value: 0}}\n")
    (tmp_path / "s.yaml").write_text("namespace: urn:k#\nscenarios:\n- {id: s1, description: d, component_local: X, changes: [{property_local: massKg, new_value: 1}], ground_truth: [r1]}\n")
    assert cli.main(["check-rules", "--rules", str(tmp_path / "r.yaml"), "--owl", f"{a}/*.txt", "--save", str(tmp_path / "v")]) == 0
    assert cli.main(["impact", "--rules", str(tmp_path / "r.yaml"), "--scenarios", str(tmp_path / "s.yaml"), "--owl", f"{a}/*.txt"]) == 0
    (tmp_path / "k.yaml").write_text("namespace: urn:k#\nrules:\n- {id: k1, subject: A, predicate: is, object: B}\n")
    assert cli.main(["apply-knowledge", "--yaml", str(tmp_path / "k.yaml"), "--owl", f"{a}/*.txt", "--save", str(tmp_path / "k"), "--dry-run"]) == 0
    assert not (tmp_path / "k").exists()


def test_ingest(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Pumps\nThe Main Pump has mass of 3.5 kg. PumpUnit2 stands near it.\n")
    assert cli.main(["ingest", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--namespace", "urn:k#"]) == 0
    out = capsys.readouterr().out
    assert "chunks 1" in out and "entities 0" not in out


def test_review_conflicts_and_reconstruction(spark, tmp_path, capsys):
    ns = "urn:k#"
    from kgloom.plans import pipelines

    pipelines.sample_delta(spark, ns).withColumn("status", F.lit("proposed")).write.parquet(str(tmp_path / "d"))
    ident = spark.read.parquet(str(tmp_path / "d")).first()["id"]
    (tmp_path / "r.csv").write_text(f"ord,id,action,new_object,note\n1,{ident},reject,,no\n")
    assert cli.main(["review", "--delta", str(tmp_path / "d"), "--reviews", str(tmp_path / "r.csv"), "--save", str(tmp_path / "e"), "--auto-approve"]) == 0
    assert "rejected" in capsys.readouterr().out
    assert cli.main(["generate", "--domain", "orbit", "--namespace", ns, "--save", str(tmp_path / "g")]) == 0
    (tmp_path / "p.json").write_text('{"rule_id": "r", "subject": "SmallSatellite_1", "attribute": "massKg", "operator": ">", "value": "-1"}\n')
    (tmp_path / "r.yaml").write_text("rules:\n- {id: r1, name: n, subject_type: SmallSatellite, when: {attribute: massKg, operator: '>', value: 0}, expected_violated: true}\n")
    owl = str(tmp_path / "g" / "*.txt")
    assert cli.main(["detect-conflicts", "--owl", owl, "--namespace", ns, "--proposed", str(tmp_path / "p.json"), "--rules", str(tmp_path / "r.yaml")]) == 0
    assert "massKg_>_threshold" in capsys.readouterr().out
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Pumps\nThe Main Pump has mass of 3.5 kg here and now.\n")
    assert cli.main(["reconstruct", "--owl", owl, "--docs", str(tmp_path / "docs"), "--namespace", ns]) == 0
    assert "pipeline" in capsys.readouterr().out


def test_demo_and_the_whole_run(spark, tmp_path, capsys):
    assert cli.main(["demo"]) == 0
    out = capsys.readouterr().out
    assert "# Sample" in out and "[T-001]" in out and "facts found (100.0 %)" in out
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Pumps\nThe Main Pump has mass of 3.5 kg. PumpUnit2 stands near it.\n")
    (tmp_path / "t.ttl").write_text('@prefix k: <urn:k#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . k:Pump a owl:Class .')
    (tmp_path / "r.yaml").write_text("namespace: urn:k#\nrules:\n- {id: r1, name: n, subject_type: Pump, when: {attribute: the_main_pump_has_mass, operator: '>', value: 0}}\n")
    (tmp_path / "s.yaml").write_text("namespace: urn:k#\nscenarios:\n- {id: s1, description: d, component_local: X, changes: [{property_local: massKg, new_value: 1}], ground_truth: [r1]}\n")
    out_dir = str(tmp_path / "out")
    assert cli.main(["run", "--input", str(tmp_path / "in"), "--tbox", str(tmp_path / "t.ttl"), "--output", out_dir, "--namespace", "urn:k#", "--rules", str(tmp_path / "r.yaml"), "--scenarios", str(tmp_path / "s.yaml")]) == 0
    assert "graph" in capsys.readouterr().out and spark.read.parquet(f"{out_dir}/verdicts").count() > 0
    assert cli.main(["evaluate", "--source", f"{out_dir}/graph.owl/part-*", "--working", f"{out_dir}/graph.owl/part-*"]) == 0
    rules_, docs = str(tmp_path / "r.yaml"), str(tmp_path / "in")
    assert cli.main(["check-rules", "--rules", rules_, "--doc", docs, "--mode", "document"]) == 0
    assert "document" in capsys.readouterr().out
    assert cli.main(["detect-conflicts", "--doc", docs, "--namespace", "urn:k#", "--mode", "document", "--save", str(tmp_path / "c")]) == 0
    assert cli.main(["align", "--entities", f"{out_dir}/entities", "--delta", f"{out_dir}/delta", "--apply", "--save", str(tmp_path / "aligned")]) == 0
    assert spark.read.parquet(str(tmp_path / "aligned")).count() > 0
