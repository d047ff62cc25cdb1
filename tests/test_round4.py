"""What the review of round 4 found: padding of workbooks, spread rows, lines that tie, sounds beyond four gigabytes."""

import json
import struct
from collections import Counter

import duckdb

from quarry.plans.metadata import entries, gathered
from quarry.queries import ORACLE_SQL, QUERIES
from quarry.sources import sheets
from quarry.sources.chunks import parts

from .test_queries import SF_DIR
from .test_sheets import record


def test_zeros_that_fill_a_stream_are_no_records():
    one, two = record(sheets.LABEL, b"abc"), record(0x0A)
    stream = bytes(8) + one + bytes(40_000) + two + bytes(4_094)
    assert list(sheets._records(stream)) == [(8, sheets.LABEL, [b"abc"]), (40_015, 0x0A, [b""])]
    assert [r[0] for r in sheets._records(one + bytes(6) + b"\1\0x")] == [0, 11]  # the last zeros belong to the next record


def test_workbooks_are_built_and_read_on_all_cores(spark, monkeypatch):
    read, met = sheets.records, []
    monkeypatch.setattr(sheets, "records", lambda files, key: met.append(files.rdd.getNumPartitions()) or read(files, key))
    assert QUERIES["biff_cells"](spark, SF_DIR).count() == 4 * spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert met == [spark.sparkContext.defaultParallelism]


def test_first_read_line_counts_of_those_with_one_number(spark, tmp_path):
    """Spark deals out larger files first, SQL reads them by name."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table orders as select range as o_orderkey from range(6)")
    con.execute("create table first as select * from (values (0, 1, 'A'), (1, 2, 'A'), (1, 2, 'N'), (1, 1, 'R'), (2, 3, null), (2, 1, 'N'), (3, null, 'R')) as t(l_orderkey, l_linenumber, l_returnflag)")
    con.execute("create table second as select (range % 2)::int l_orderkey, (range % 2)::int + 1 l_linenumber, case when range % 3 = 0 then 'R' else 'N' end l_returnflag from range(20000) union all values (2, 1, 'R'), (4, 1, 'R')")
    (tmp_path / "lineitem.parquet").mkdir()
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    for number, name in enumerate(("first", "second")):
        con.execute(f"copy {name} to '{tmp_path}/lineitem.parquet/part-{number}.parquet'")
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = Counter(con.execute(ORACLE_SQL["merge_last_wins"]).fetchall())
    assert Counter(map(tuple, QUERIES["merge_last_wins"](spark, str(tmp_path)).collect())) == want


def test_sizes_of_rf64_files_stand_in_their_first_chunk(spark):
    ones, info = b"\xff" * 4, b"INFOIART" + struct.pack("<I", 4) + b"Ann\0"
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16)
    table = b"LIST" + struct.pack("<Q", len(info))
    first = lambda size: b"RF64" + ones + b"WAVEds64" + struct.pack("<IQQQI", 40, 0, size, 0, 1) + table
    files = {
        "long": first(176400 * 90_061) + fmt + b"data" + ones,
        "high": first(2**64 - 1) + fmt + b"data" + ones,
        "behind": first(6) + fmt + b"data" + ones + b"sounds" + b"LIST" + ones + info,
        "cut": (first(6) + fmt)[:40],
        "plain": b"RIFF" + ones + b"WAVE" + fmt + b"data" + ones,
    }
    rows = spark.createDataFrame([(k, "wav", v) for k, v in files.items()], "id string, extension string, content binary")
    got = {r["id"]: json.loads(r["deepMeta"]) for r in gathered(entries(parts(rows), extensions=["wav"])).collect()}
    assert {k: (v.get("duration"), v.get("artist")) for k, v in got.items()} == {"long": ("1501:01", None), "high": ("1742889651711:01", None), "behind": ("0:00", "Ann"), "plain": ("405:47", None)}


def test_wav_header_of_sounds_beyond_four_gigabytes_equals_its_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table customer as select unnest([0, 1, 10737, 10738, 14999, 899999]::bigint[]) as c_custkey, 'BUILDING' as c_mktsegment")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet'")
    want = con.execute(ORACLE_SQL["wav_header"]).fetchall()
    assert sorted(map(tuple, QUERIES["wav_header"](spark, str(tmp_path)).collect())) == sorted(want)
