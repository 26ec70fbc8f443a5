"""Splits of quoted text against Python's csv module over whole files."""

import csv
import io
import random
import uuid

import pytest

from peakview import session as _session
from peakview.sources import csv_events as CE
from peakview.sources import quoted_lines as QL


def _splitting(spark, size):
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    s.conf.set("spark.sql.files.openCostInBytes", "0")
    return s


def _land(spark, text, suffix="csv"):
    folder = _session.scratch_path(spark, f"quoted-{uuid.uuid4().hex}").removeprefix("file:")
    import os
    os.makedirs(folder)
    with open(f"{folder}/f.{suffix}", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return folder


def _read(spark, folder, sep=","):
    records, _ = QL.read_records(spark, folder, lambda header: sep)
    return sorted(tuple(r.fields) for r in records.collect())


def _rows(seed, n, fields):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["", "plain", "two\nlines", 'a "quoted" word', "x,y", "\n\n", "é 漢字", '"', "long " * 30, "a\r\nb", "1"])
    return [[pick() for _ in range(fields)] for _ in range(n)]


@pytest.mark.parametrize("sep,end,size", [(",", "\n", 300), (";", "\r\n", 157)])
def test_splits_equal_the_whole_read(spark, sep, end, size):
    rows = [r for r in _rows(size, 90, 4)]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    writer.writerow(["a", "b", "c", "d"])
    writer.writerows(rows)
    folder = _land(spark, out.getvalue())
    splitting = _splitting(spark, size)
    assert splitting.read.text(folder).rdd.getNumPartitions() > 4
    want = sorted(tuple(r) for r in csv.reader(io.StringIO(out.getvalue(), newline=""), delimiter=sep))
    want.remove(("a", "b", "c", "d"))
    assert _read(splitting, folder, sep) == [r for r in want if r]


def test_one_field_over_many_splits_and_no_end(spark):
    long = "\n".join(f"line {i}" for i in range(500))
    folder = _land(spark, f'a,b\n1,"{long}"\n2,x\n')
    assert _read(_splitting(spark, 64), folder) == [("1", long), ("2", "x")]
    folder = _land(spark, 'a,b\n1,x\n2,"never closed\n3,y\n')
    assert _read(_splitting(spark, 8), folder) == [("1", "x"), ("2", "never closed\n3,y")]


def test_a_quote_inside_an_unquoted_field_is_text(spark):
    folder = _land(spark, 'a,b\n1,5" screen\n2,"two\nlines"\n3,a"b"c\n4,d')
    assert _read(_splitting(spark, 10), folder) == [("1", '5" screen'), ("2", "two\nlines"), ("3", 'a"b"c'), ("4", "d")]


def test_state_after_a_line():
    for line, outside, inside in (('a,b', False, True), ('a,"b', True, False), ('"a","b"', False, False), ('"a""b', True, False),
                                  ('x"y,"z', True, True), ('",', True, False), ("", False, True), ('""', False, True)):
        assert (QL.still_inside(line, False, ","), QL.still_inside(line, True, ",")) == (outside, inside), line
    assert QL.still_inside('end", next', True, ",") is False
    assert QL.still_inside('still ""open""', True, ",") is True


def test_folder_of_mixed_headers(spark):
    head = "content_id,title,video_type,category"
    folder = _land(spark, f"{head}\n1,A,live,x\n2,\"B, b\",vod,y\n")
    with open(f"{folder}/g.csv", "w", encoding="utf-8") as f:
        f.write("CATEGORY;video_type;Title;content_id;show_name;extra\nz;live;C;3;S;?\nz;vod;D;-4;S;?\nshort;row\n")
    with open(f"{folder}/empty.csv", "w", encoding="utf-8"):
        pass
    good, counts, shape = CE.content_from_csv(spark, folder)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "A", "live", "x", ""), (2, "B, b", "vod", "y", ""), (3, "C", "live", "z", "S")]
    assert {r["status"]: r["rows"] for r in counts.collect()} == {"good": 3, "negative": 1, "ragged": 1}
    with open(f"{folder}/bad.csv", "w", encoding="utf-8") as f:
        f.write("content_id,title\n9,X\n")
    with pytest.raises(ValueError, match="video_type"):
        CE.content_from_csv(spark, folder)
