import random

import pytest

from terrasieve.sources.summary_csv import Fault, SummaryFiles, load_files, load_lines, parse_file, parse_geometry, parse_record

H = "ImageId,BuildingId,PolygonWKT_Pix,Confidence"
P = '"POLYGON ((0 0, 1 0, 1 1, 0 0))"'
CASES = [
    (f"a,1,{P},0.5", None), (f'"a ""b""",-1,{P},8.05e-02', None), ("a,1,POLYGON EMPTY,1", None), (f'"a, b","1",{P},"1."', None),
    ('a,1,"multipolygon z(((0 0 1,1 0 1,1 1 1,0 0 1)),((5 5 1,6 5 1,6 6 1,5.0 5e0 1)))",1', None), ('a,1,"Polygon  ( (0 0 , 1 0 , 1 1 , 0 0) ) ",1', None),
    (f'a,1,"POLYGON ((0 0,{P},1', "quoting"), (f'a",1,{P},1', "quoting"), (f"a,1,{P}x,1", "quoting"), (f'a,1,{P},"1', "quoting"), (f'a "b",1,{P}', "quoting"),
    (f"a,1,{P}", "column_count"), ("", "column_count"), (f"a,1,{P},1,", "column_count"), ("a;1;POLYGON EMPTY;1", "column_count"), (None, "column_count"),
    (f",1,{P},1", "value"), (f"a,--2,{P},1", "value"), (f"a,1.0,{P},1", "value"), (f"a,,{P},1", "value"), (f"a,1,{P},NaN", "value"), (f"a,1,{P},1e999", "value"), (f"a,1,{P},", "value"), (f"a,1,{P},0x1", "value"),
    ("a,1,POINT (1 2),1", "value"), ('a,1,"POLYGON ((0 0, 1 0, 0 0))",1', "value"), ('a,1,"POLYGON ((0 0, 1 0, 1 1, 0 1))",1', "value"), ('a,1,"POLYGON (0 0, 1 0, 1 1, 0 0)",1', "value"),
    ('a,1,"POLYGON ((0 0, 1 0, inf 1, 0 0))",1', "value"), ('a,1,"POLYGON ((0 0, 1 0, 1e999 1, 0 0))",1', "value"), ('a,1,"POLYGON ((0 0, 1 0, 1 1, 0 0)))",1', "value"), ('a,1,"POLYGON ((0 0, 1 0, 1 1, 0 0)",1', "value"),
    ('a,1,"POLYGON ((0, 1 0, 1 1, 0))",1', "value"), ('a,1,"POLYGON ((0 0 0 0, 1 0 0 0, 1 1 0 0, 0 0 0 0))",1', "value"), ('a,1,"MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))",1', "value"), ("a,1,POLYGON,1", "value"), ("a,1,LineString EMPTY,1", "value"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, H, line, "x") for i, (line, _) in enumerate(CASES)], "line_id long, header_line string, line_text string, reason string")
    got = {r.line_id: r.reason for r in load_lines(df, "line_id", "header_line", "line_text").collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_typed_record_and_located_fault(spark):
    df = spark.createDataFrame([(1, H, f"a,7,{P},2e-1"), (2, H, 'a,7,"POLYGON ((0 0, x 1))",1'), (3, H, "a,99999999999999999999,POLYGON EMPTY,1"), (4, None, "a")], "i long, h string, l string")
    a, b, c, d = sorted(load_lines(df, "i", "h", "l").collect())
    assert (a.image_id, a.building_id, a.confidence, a.geometries) == ("a", 7, 0.2, {"PolygonWKT_Pix": P.strip('"')})
    assert b.reason == "value" and b.error_at > 4 and "PolygonWKT_Pix" in b.error_detail
    assert c.reason is None and c.building_id is None and c.others == {"BuildingId": "9" * 20}
    assert d.reason is None  # a header of one nameless column
    assert load_lines(df.limit(0), "i", "h", "l").count() == 0


def test_long_geometry():
    ring = ", ".join(f"{i} {i % 7}" for i in range(200_000))
    assert parse_geometry(f"POLYGON (({ring}, 0 0))") == "POLYGON"
    with pytest.raises(Fault):
        parse_geometry(f"POLYGON (({ring}, 0 1))")
    with pytest.raises(Fault):
        parse_record('"' + '""' * 500_000)


def test_files_recover_at_record_starts(spark):
    text = "\n".join([H, f"a,1,{P},1", 'b,2,"POLYGON ((0 0, 1 0', "1 1,5 5", f"c,3,{P},1", f'd,4,{P},"1', f'"e\nf",5,{P},1', "g,x,POLYGON EMPTY,1", ""])
    got = [(x["line_no"], x["record"] and x["record"]["image_id"], x["fault"] and x["fault"].reason) for x in parse_file(text)]
    assert got == [(2, "a", None), (3, None, "quoting"), (5, "c", None), (6, None, "quoting"), (9, None, "value")] or got[:4] == [(2, "a", None), (3, None, "quoting"), (5, "c", None), (6, None, "quoting")]
    covered = "\n".join(x["text"] for x in parse_file(text))
    assert covered == text.split("\n", 1)[1].rstrip("\n")  # nothing is lost
    df = spark.createDataFrame([("f.csv", text), ("empty.csv", ""), ("none.csv", None)], "n string, t string")
    assert {r.file_name for r in load_files(df, "n", "t").collect()} == {"f.csv"}


def test_other_columns_come_out(spark):
    df = spark.createDataFrame([(1, "ImageId,roof,ImageId2", "a,flat,\"b,\"\"c\"\"\"")], "i long, h string, l string")
    assert load_lines(df, "i", "h", "l").first().others == {"roof": "flat", "ImageId2": 'b,"c"'}


@pytest.mark.parametrize("size", [40, 97, 1000, 1 << 25])
def test_files_of_any_split_hold_each_record_once(spark, tmp_path, size):
    """Broken quotes, quoted line breaks and long records at the borders of splits of any size."""
    rng = random.Random(size)
    ring = lambda n: ", ".join(f"{i} {i * i}" for i in range(n))
    lines = [H]
    for i in range(300):
        kind = rng.random()
        lines.append(f'é{i},{i},"POLYGON (({ring(rng.randint(3, 60))}, 0 0))",0.5' if kind < 0.5 else f'x{i},{i},"POLYGON ((0 0, 1' if kind < 0.6 else f"y{i},no,POLYGON EMPTY,1" if kind < 0.7 else f'"z\n{i}",{i},"POLYGON\n((0 0, 1 0, 1 1, 0 0))",1' if kind < 0.8 else f"w{i},{i},POLYGON EMPTY,1")
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(lines[:40]))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.txt").write_text("no table")
    spark.dataSource.register(SummaryFiles)
    rows = spark.read.format("summary_csv").option("split_bytes", size).load(str(tmp_path)).collect()
    for name in ("a.csv", "b.csv"):
        mine = sorted((r for r in rows if r.file_name == name), key=lambda r: (r.split_at, r.record_no))
        want = list(parse_file((tmp_path / name).read_text()))
        assert [(r.line_text, r.image_id, r.reason) for r in mine] == [(x["text"], x["record"] and x["record"]["image_id"], x["fault"] and x["fault"].reason) for x in want]
    assert {r.file_name for r in rows} == {"a.csv", "b.csv"}
