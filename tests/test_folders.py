"""Project folders of all versions, their logs, and report documents."""

import json

import pytest

from gaugeworks.sources import folders

CHAR = {"id": "c1", "number": 1, "kind": "linear", "requirement_text": "10", "nominal": "10.0", "upper_limit": "10.1", "lower_limit": None, "quantity": 1, "status": "accepted", "inspect": True}
SHEET = {"id": "s1", "index": 0, "size": {"width": 100.5, "height": 50}, "rotation": "deg0", "kind": "vector_text", "unit": "mm"}


def project(version):
    sheet = SHEET | ({"zone_grid": {"frame": {"origin": {"x": 1, "y": 2}, "size": {"width": 3.5, "height": 4}}}, "views": [{"label": "A"}]} if version > 1 else {})
    p = {"info": {"part_number": f"P-{version}", "part_name": "n", "customer": "", "order_reference": ""}, "revisions": [{"id": "r1", "label": "A", "sheets": [sheet]}], "characteristics": [CHAR | ({} if version < 2 else {"number": "1.2", "derivation": {"rule": {"type": "explicit"}}})], "balloons": [{"id": "b1", "characteristic": "c1", "sheet": "s1", "position": {"x": 1, "y": 2}, "anchor": {"x": 0.5, "y": 0}}]}
    p["settings"] = {"numbering": {"strategy": "reading_order"}}
    if version > 2:
        p["characteristics"][0]["result_type"] = "attribute"
        p |= {"samples": [{"id": "x", "serial": "1"}], "results": [{"sample": "x", "characteristic": "c1", "value": "10.05"}], "issued_reports": [], "report_info": {"report_number": "R7", "company_name": "Co"}}
    if version > 3:
        p["revisions"][0]["source"] = {"type": "image"}
    return p


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("projects")
    for v in (1, 2, 3, 4, 5):
        (top / f"p{v}").mkdir()
        (top / f"p{v}" / "manifest.json").write_text(json.dumps({"schema_version": v, "created": "2026-03-01T08:00:00Z"}, indent=1))
        (top / f"p{v}" / "project.json").write_text(json.dumps(project(v), indent=1))
    old = {"entry_no": 1, "timestamp": "2026-03-01T08:00:00Z", "user": "u", "action": {"type": "command", "command": {"type": "update_sample", "sample": {"serial": "7", "date": "", "inspector": "i", "gauges": "g", "comment": None}}}, "changes": [{"type": "sample_changed"}]}
    new = old | {"action": {"type": "undo", "command": {"type": "update_sample", "fields": [{"field": "serial", "value": "8"}]}}}
    (top / "p3" / "audit.jsonl").write_text(json.dumps(old) + "\n" + json.dumps(old)[:40])
    (top / "p4" / "audit.jsonl").write_text(json.dumps(new) + "\n")
    for name, manifest, doc in (("q1", None, "{}"), ("q2", '{"schema_version": 4}', None), ("q3", '{"schema_version": 4}', "{ broken"), ("q4", '{"schema_version": 0}', "{}"), ("q5", '{"schema_version": 4}', "{}")):
        (top / name).mkdir()
        for file, text in (("manifest.json", manifest), ("project.json", doc)):
            if text is not None:
                (top / name / file).write_text(text)
    return str(top)


def test_versions_come_to_one_shape(spark, tree):
    f = folders.Folders(spark, tree)
    assert {r["project_id"]: r["reason"] for r in f.refused.collect()} == {"p5": "unknown_version", "q1": "no_manifest", "q2": "no_document", "q3": "unreadable_document", "q4": "unknown_version"}
    got = {r["project_id"]: r for r in f.projects().collect()}
    assert {p: (r["part_number"], r["strategy"], r["report_number"]) for p, r in got.items()} == {"p1": ("P-1", "manual", ""), "p2": ("P-2", "reading_order", ""), "p3": ("P-3", "reading_order", "R7"), "p4": ("P-4", "reading_order", "R7"), "q5": (None, None, None)}
    chars = {r["project_id"]: (r["pos"], r["number"], r["rule"], r["result_type"], r["upper_limit"], r["lower_limit"]) for r in f.table("characteristics").collect()}
    assert chars == {"p1": (0, "1", "manual", "auto", "10.1", None), "p2": (0, "1.2", "explicit", "auto", "10.1", None), "p3": (0, "1.2", "explicit", "attribute", "10.1", None), "p4": (0, "1.2", "explicit", "attribute", "10.1", None)}
    assert {r["project_id"]: r["source_type"] for r in f.table("revisions").collect()} == {"p1": "pdf", "p2": "pdf", "p3": "pdf", "p4": "image"}
    assert sorted((r["project_id"], r["serial"]) for r in f.table("samples").collect()) == [("p3", "1"), ("p4", "1")] and f.table("issued_reports").count() == 0 and f.table("results").count() == 2
    assert {r["project_id"]: (r["width"], r["frame_w"], r["n_views"]) for r in f.sheets().collect()} == {"p1": (100.5, None, 0), "p2": (100.5, 3.5, 1), "p3": (100.5, 3.5, 1), "p4": (100.5, 3.5, 1)}
    assert [r["anchor_x"] for r in f.table("balloons").collect()] == [0.5] * 4


def test_logs_come_to_one_shape(spark, tree):
    got = {r["project_id"]: r for r in folders.Folders(spark, tree).audit().collect()}
    assert set(got) == {"p3", "p4"}
    assert [tuple(f) for f in got["p3"]["fields"]] == [("serial", "7"), ("date", ""), ("inspector", "i"), ("gauges", "g"), ("comment", None)]
    assert [tuple(f) for f in got["p4"]["fields"]] == [("serial", "8")] and got["p4"]["action"] == "undo" and len(got["p3"]["changes"]) == 1


def test_report_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "project_id int, pos int, number string")
    heads = spark.createDataFrame([(1, "R1", None), (2, "R2", "Co")], "project_id int, report_number string, company_name string")
    folders.write_report_documents(rows, heads, str(tmp_path / "out"), "de")
    docs = {d["project_id"]: d for f in (tmp_path / "out").glob("*.json") for d in map(json.loads, f.read_text().splitlines())}
    assert docs[1]["header"] == {"report_number": "R1", "company_name": ""} and [r["number"] for r in docs[1]["rows"]] == ["a", "b"] and docs[2]["rows"] == [] and docs[1]["language"] == "de"
    assert [s["role"] for s in docs[2]["signatures"]] == ["inspected_by", "approved_by"]
    with pytest.raises(ValueError, match="no header"):
        folders.write_report_documents(rows, heads.where("project_id = 2"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
