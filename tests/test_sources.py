"""Readers and writers on small files."""

import json

import pytest
from motionlake.sources import lists, staging


def test_key_value_json(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"_note": "x", "a": "1", "b": {"c": 2}}))
    path = str(tmp_path / "kv.json")
    assert {tuple(r) for r in lists.read_kv_json(spark, path).collect()} == {("_note", "x"), ("a", "1"), ("b", '{"c":2}')}
    assert {r.key for r in lists.read_patch_json(spark, path).collect()} == {"a", "b"}
    assert lists.read_kv_json(spark, str(tmp_path / "none.json")).count() == 0


def test_lists(spark, tmp_path):
    (tmp_path / "skip.txt").write_text("# a remark\n\nclip-1 # too short\nclip-2\n")
    assert [(r.key, r.reason) for r in lists.read_key_list(spark, str(tmp_path / "skip.txt")).orderBy("line_no").collect()] == [("clip-1", "too short"), ("clip-2", None)]
    (tmp_path / "trim.txt").write_text("a 3\nb 0 # none\n")
    with pytest.raises(ValueError, match="line 2"):
        lists.read_trim_list(spark, str(tmp_path / "trim.txt"))
    good, bad = lists.read_trim_list(spark, str(tmp_path / "trim.txt"), strict=False)
    assert [tuple(r) for r in good.collect()] == [("a", 3)] and bad.count() == 1


def test_flags(spark, tmp_path):
    (tmp_path / "flags.txt").write_text("wolf # facing: turned\nowl # odd\nwolf # verified_ok: fine\nghost\n")
    rigs = spark.createDataFrame([("wolf",), ("owl",)], "rig string")
    flags, problems = lists.read_flag_list(spark, str(tmp_path / "flags.txt"), rigs)
    assert {tuple(r) for r in flags.collect()} == {("wolf", "verified_ok", "fine"), ("owl", "flagged", "odd"), ("ghost", "flagged", "")}
    assert {tuple(r) for r in problems.collect()} == {("ghost", "unknown rig"), ("wolf", "overridden")}


def test_csv_hints_markers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("object_id,file\nabc,\n,dir/def.glb\n")
    assert {r.key for r in lists.read_exclude_csv(spark, str(tmp_path / "x.csv")).collect()} == {"abc", "def"}
    (tmp_path / "h.json").write_text(json.dumps({"a.glb": "A object_name runs", "b.glb": {"prompt": "p", "description": "the object_name"}, "c": {"prompt": "only"}}))
    assert {tuple(r) for r in lists.read_hints(spark, str(tmp_path / "h.json")).collect()} == {("a", "An animal runs"), ("b", "the animal"), ("c", "only")}
    marks = tmp_path / "marks"
    marks.mkdir()
    (marks / "1.json").write_text(json.dumps({"asset": "x", "n_frames": 3, "joint_names": ["a"]}))
    (marks / "2.json").write_text("{broken")
    (marks / "3.json").write_text(json.dumps({"asset": "y"}))
    assert [r.asset for r in lists.read_markers(spark, str(marks)).collect()] == ["x"]


def test_versions_and_report(spark, tmp_path):
    root = str(tmp_path / "table")
    for k in (1, 2):
        lists.write_version(spark.range(k), root, f"{k:04d}")
    assert lists.read_latest(spark, root).count() == 2
    changes = spark.createDataFrame([("label", "r2", "a", "b"), ("label", "r1", "c", None)], "kind string, key string, old string, new string")
    lists.write_change_report(changes, str(tmp_path / "report"))
    assert [r.key for r in spark.read.csv(str(tmp_path / "report"), sep="\t", header=True).collect()] == ["r1", "r2"]


def test_versions_become_visible_whole(spark, tmp_path):
    path = str(tmp_path / "vocab")
    with pytest.raises(FileNotFoundError):
        staging.read_current(spark, path)
    staging.write_vocab(spark.createDataFrame([("leg", "Leg")], "key string, part string"), path, made="by rule", purity="0.9")
    staging.write_atomic(spark.createDataFrame([("arm", "Arm")], "key string, part string"), path)
    (tmp_path / "vocab" / "v000003").mkdir()  # a write that broke off
    assert [tuple(r) for r in staging.read_current(spark, path).collect()] == [("arm", "Arm")]
    (tmp_path / "vocab" / "v000002" / "_SUCCESS").unlink()
    vocab, meta = staging.read_vocab(spark, path)
    assert [tuple(r) for r in vocab.collect()] == [("leg", "Leg")] and meta == {"made": "by rule", "purity": "0.9"}


def test_load_motions(spark, tmp_path):
    spark.createDataFrame([("c", "r", None, [[1.0], [2.0]]), ("d", "r", 60, [])], "clip string, rig string, fps int, frames array<array<double>>").write.parquet(str(tmp_path / "m"))
    clips, frames = staging.load_motions(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in clips.collect()} == {("c", "r", 30, 2), ("d", "r", 60, 0)}
    assert sorted((r.clip, r.frame, r.pose) for r in frames.collect()) == [("c", 0, [1.0]), ("c", 1, [2.0])]
