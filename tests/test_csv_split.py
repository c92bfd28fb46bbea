"""Files with quoted line breaks, read in many ranges, against Spark's multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from gleaner.sources import csv_files, csv_split

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def cell(rng, newline):
    bits = ["a", "word", ",", '""', newline, newline + newline, "\u00e9\u4e2d", " ", "x" * rng.randint(0, 30)]
    return '"' + "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) + '"'


def write(path, rng, rows, newline, last=True, blank=False):
    lines = ["id,title,text"]
    for i in range(rows):
        lines.append(f"{i},{rng.choice(['', 'plain', cell(rng, newline)])},{cell(rng, newline)}")
        if blank and i % 17 == 0:
            lines.append("")
    path.write_bytes((newline.join(lines) + (newline if last else "")).encode())


@pytest.fixture
def small_ranges(spark, monkeypatch):
    monkeypatch.setattr(csv_split, "CHUNK_BYTES", 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_rows_equal_the_multi_line_reader(spark, tmp_path, small_ranges, newline):
    rng = random.Random(len(newline))
    write(tmp_path / "a.csv", rng, 300, newline)
    write(tmp_path / "b.csv", rng, 120, newline, last=False)
    write(tmp_path / "c.csv", rng, 0, newline)
    write(tmp_path / "d.csv", rng, 60, newline, blank=True)
    path = str(tmp_path)
    want = sorted(map(repr, csv_files.read_csv(spark, path, SCHEMA).collect()))
    split = csv_files.read_csv(spark, path, SCHEMA, file_order=True, split=True)
    rows = split.collect()
    assert len(want) == 480 and sorted(repr(r) for r in split.select(*SCHEMA.fieldNames()).collect()) == want
    # The order columns give the order in the file.
    a = sorted((r[csv_files.ROW_COLUMN], r["id"]) for r in rows if r[csv_files.FILE_COLUMN].endswith("a.csv"))
    assert [i for _, i in a] == list(range(300))
    ranges = {(r[csv_files.FILE_COLUMN], r[csv_files.ROW_COLUMN]["block"]) for r in rows}
    assert len(ranges) > 8  # one file, many tasks


def test_long_cells_and_headers_over_many_chunks(spark, tmp_path, small_ranges):
    text = "line \n" * 2_000
    (tmp_path / "a.csv").write_text(f'id,"ti\ntle {"h" * 700}\n",text\n1,t,"{text}"\n2,"{text}",""\n3,"say ""hi""\n",z\n')
    split = csv_files.read_csv(spark, str(tmp_path), SCHEMA, split=True).orderBy("id").collect()
    whole = csv_files.read_csv(spark, str(tmp_path), SCHEMA).orderBy("id").collect()
    assert split == whole and [r["id"] for r in split] == [1, 2, 3] and split[0]["text"] == text and split[2]["title"] == 'say "hi"\n'


def test_rows_of():
    assert csv_split.rows_of(b'a\nb', False) == (None, [b"a", b"b"], None)
    assert csv_split.rows_of(b'a"\nb,"c', True) == (b'a"', [], b'b,"c')
    assert csv_split.rows_of(b"x\ny", True) == (b"x\ny", [], None)
    assert csv_split.rows_of(b'"\n\nq', True) == (b'"', [b"", b"q"], None)


def test_empty_file_and_bad_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,title,text\nx,n/a,t\n7,u\n")
    rows = csv_files.read_csv(spark, str(tmp_path), SCHEMA, split=True)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, csv_files.read_csv(spark, str(tmp_path), SCHEMA).collect()))


def test_numbered_appends_keep_their_order(spark, tmp_path):
    for batch, name in ((3, "late"), (1, "early")):
        folder = tmp_path / f"{csv_files.BATCH_COLUMN}={batch}"
        folder.mkdir()
        (folder / "a.csv").write_text(f"id,title,text\n1,{name},t\n")
    rows = csv_files.read_csv(spark, str(tmp_path), SCHEMA, file_order=True, split=True)
    assert [r["title"] for r in rows.orderBy(*[F.col(c) for c in csv_files.INGEST_ORDER]).collect()] == ["early", "late"]
