"""Labelled sets that no single task can hold."""

import gzip
import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from scorelake.plans.queries import QUERIES
from scorelake.sources import readers, sinks
from scorelake.sources.arrays import BrokenDocument
from tests.test_functions import request

NASTY = ["}", '"', "\\", '\\"}', '{"entries":[', '],"stats":{}}', ",", "é😀\n\t}", "}" * 300]


@contextmanager
def splits(spark, size):
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in conf:
            spark.conf.unset(k)


def entries(n):
    return [{"expected_approved": i % 3 == 0, "request": request(id=f"{NASTY[i % len(NASTY)]}{i}")} for i in range(n)]


def read(spark, path):
    return [(r.idx, r.expected_approved, r.request and r.request.id) for r in readers.read_labelled(spark, f"file://{path}").orderBy("idx").collect()]


def wanted(rows):
    return [(i, e["expected_approved"], e["request"]["id"]) for i, e in enumerate(rows)]


@pytest.mark.parametrize("size", ["1500", "128m"])
@pytest.mark.parametrize("indent", [None, 3])
def test_a_document_is_read_in_splits(spark, tmp_path, size, indent):
    """Before, one task held the whole document, however many splits it had."""
    rows = entries(30)
    doc = {"other": [{"entries": [1, "}"]}], "entries": rows, "stats": {"total": 30, "x": [[], {}, "]"]}}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None))
    with splits(spark, size):
        assert read(spark, tmp_path / "t.json") == wanted(rows)
        if size == "1500":
            got = readers.read_labelled(spark, f"file://{tmp_path}/t.json")
            assert got.select(F.spark_partition_id()).distinct().count() > 4


def test_the_query_is_spread(spark):
    """Before, all events were gathered in one row."""
    with splits(spark, "64k"):
        got = QUERIES["labelled_set"](spark, "/root/testdata/sf0.001").withColumn("part", F.spark_partition_id()).orderBy("idx").collect()
    ids = sorted(r.event_id for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").collect())
    assert [(r.idx, r.expected_approved, r.event_id) for r in got] == [(i, e % 3 != 0, str(e)) for i, e in enumerate(ids)]
    assert len({r.part for r in got}) > 1


def test_files_are_numbered_through(spark, tmp_path):
    rows = entries(7)
    for name, part in (("a", rows[:3]), ("b", []), ("c", rows[3:])):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump({"entries": part}, f)
    assert read(spark, tmp_path) == wanted(rows)


def test_written_sets_are_whole_documents(spark, tmp_path):
    keys = [5, 3, 3, None, 9, 1, 7, 2]
    rows = spark.createDataFrame([(k, k is None or k > 3, (str(k),)) for k in keys], "i long, expected_approved boolean, request struct<id: string>")
    with splits(spark, "1m"):
        sinks.write_labelled(rows, "i", f"file://{tmp_path}/out")
        assert [x[2] for x in read(spark, tmp_path / "out")] == ["1", "2", "3", "3", "5", "7", "9", "None"]
        sinks.write_labelled(rows.where("false"), "i", f"file://{tmp_path}/none")
        assert read(spark, tmp_path / "none") == []
    docs = [json.loads(t) for p in (tmp_path / "out").glob("part-*") if (t := p.read_text())]
    assert len(docs) > 1 and sum(d["stats"]["total"] for d in docs) == len(keys)


@pytest.mark.parametrize("text", ['{"entries":[{"expected_approved":true}]', '{"entries":[{"expected_approved":true', '{"entries":[],"entries":[]}', '{"entries":[{"x":"}]}'])
def test_broken_documents_are_refused(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(BrokenDocument):
        read(spark, tmp_path / "t.json")


@pytest.mark.parametrize("text", ['{"entries":[{"expected_approved":tru}]}', '{"entries":[{"expected_approved":true},]}', '[{"entries":[]}]'])
def test_broken_entries_are_refused(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="broken entry|lacks an element|isn't one object"):
        read(spark, tmp_path / "t.json")


def test_odd_entries(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"\\u0065ntries" : [null, {"expected_approved": "yes"}, {}, {"expected_approved": true, "request": {"id": 5}}]}\n')
    assert read(spark, tmp_path / "t.json") == [(0, None, None), (1, None, None), (2, None, None), (3, True, "5")]
