"""Readers and writers of single documents, job tables and notes."""

import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from talkloom.functions import fields as fl
from talkloom.functions import text as tx
from talkloom.session import temporary_folder
from talkloom.sources import notes, readers, sinks


def test_documents_are_read_whole_and_strictly(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "names": ["x", "y"]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"id": 2}))
    rows = readers.read_document(spark, f"{tmp_path}/*.json", "id int, names array<string>").orderBy("id").collect()
    assert [(r["id"], r["names"]) for r in rows] == [(1, ["x", "y"]), (2, None)]
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(Exception):
        readers.read_document(spark, f"{tmp_path}/c.json", "id int").collect()


def test_notes_are_written_in_order(spark, tmp_path):
    lines = [("b.md", 1, k, f"line {k}") for k in range(300)] + [("a.md", 2, 0, "last"), ("a.md", 1, 0, "first")]
    frame = spark.createDataFrame(lines, "path string, section int, ordinal int, line string").repartition(5)
    notes.write_lines_as_text(frame, f"{tmp_path}/notes")
    read = {}
    for name in ("a.md", "b.md"):
        files = sorted(glob.glob(f"{tmp_path}/notes/path={name}/part-*"))
        read[name] = [line for file in files for line in open(file).read().splitlines()]
    assert read["a.md"] == ["first", "last"] and read["b.md"] == [f"line {k}" for k in range(300)]
    sinks.write_notes(spark.createDataFrame([("x.md", "body")], "path string, body string"), f"{tmp_path}/rows")
    assert spark.read.json(f"{tmp_path}/rows").collect()[0].asDict() == {"path": "x.md", "body": "body"}


def test_fingerprints_and_joins(spark):
    row = spark.createDataFrame([(1, None, ["a", "", None, "b"])], "n int, a string, l array<string>")
    got = row.select(fl.fingerprint("n", "a").alias("f"), tx.join_array(F.col("l"), "-").alias("j")).first()
    assert got["f"] == hashlib.sha256(b'{"a":null,"n":1}').hexdigest() and got["j"] == "a-b"


@pytest.mark.parametrize("master,local", [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://x:7077", False)])
def test_only_local_masters_get_a_temporary_folder(master, local):
    if local:
        assert temporary_folder(master)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            temporary_folder(master)


def test_bundle_files_do_not_grow_with_videos(spark, tmp_path):
    path = f"{tmp_path}/bundle"
    rows = [(f"v{v}", k, f"text {v} {k} \n\"x\"" if k else None) for v in range(2000) for k in range(3)]
    odd = [(None, 0, "no video"), ("", 0, "empty name"), ("a/b=c", 0, "name of signs")]
    frame = spark.createDataFrame(rows + odd, "video_id string, token_index long, text string")
    sinks.write_lines(frame, path)
    files = glob.glob(f"{path}/**/part-*", recursive=True)
    assert len(files) <= sinks.PARTS * sinks.SPREAD < 2000
    assert all(list(json.loads(line)) == ["text", "token_index", "video_id"] for file in files for line in open(file, newline="\n"))
    read = lambda: sorted(((r["video_id"], r["token_index"], r["text"]) for r in readers.read_table(spark, path, "speech_tokens").collect()), key=str)
    assert read() == sorted(rows + odd, key=str)
    again = [(f"v{v}", 7, "new") for v in range(0, 2000, 50)] + [("v9999", 0, "added"), (None, 1, "still no video")]
    sinks.write_lines(spark.createDataFrame(again, frame.schema), path)
    names = {r[0] for r in again}
    assert read() == sorted([r for r in rows + odd if r[0] not in names] + again, key=str)
