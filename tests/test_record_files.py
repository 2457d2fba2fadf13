"""Record files of three kinds, sound and broken."""

from __future__ import annotations

import json

import pytest

from tidemill.sources import records


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def shown(df):
    return sorted(((r["file"], r["position"], r["status"], None if r["record"] is None else json.loads(r["record"].toJson())) for r in df.collect()), key=str)


def test_json_of_both_forms_and_broken_files(spark, tmp_path):
    folder = tmp_path / "many.json"
    folder.mkdir()
    write(folder / "a.json", '[{"x": 1},\n {"x": "é"}, 3]')
    write(folder / "b.json", '{"records": [{"y": null}], "more": 1}')
    write(folder / "c.json", '{"records": 5}')
    write(folder / "d.json", '{"x": ')
    write(folder / "e.json", "[]")
    assert shown(records.load_records(spark, str(folder))) == sorted(
        [("a.json", 0, "ok", {"x": 1}), ("a.json", 1, "ok", {"x": "é"}), ("a.json", 2, "not_object", 3), ("b.json", 0, "ok", {"y": None}), ("c.json", None, "no_records", {"records": 5}), ("d.json", None, "invalid_json", None)], key=str
    )


def test_lines_and_csv(spark, tmp_path):
    lines = write(tmp_path / "r.jsonl", '{"x": 1}\n\n  \n[1]\n{"x"\n"s"\n')
    assert [x[2:] for x in shown(records.load_records(spark, lines))] == [("invalid_json", None), ("not_object", "s"), ("not_object", [1]), ("ok", {"x": 1})]
    cells = write(tmp_path / "r.csv", 'id,name\n007,"a ""b"",\nc"\n,\n')
    assert [x[2:] for x in shown(records.load_records(spark, cells))] == [("ok", {"id": "", "name": ""}), ("ok", {"id": "007", "name": 'a "b",\nc'})]


def test_other_endings_are_refused(spark):
    with pytest.raises(ValueError):
        records.load_records(spark, "/tmp/x.parquet")
