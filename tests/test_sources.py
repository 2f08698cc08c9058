import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import files as fs


@pytest.mark.parametrize("name, kind", [
    ("a.xlsx", "excel"), ("a.XLS", "excel"), ("/x.y/b.Csv", "csv"), ("c.tar.pdf", "pdf"), ("d.txt", "text"), ("e.doc", "word"),
    ("f.docx", "word"), ("noext", "unknown"), (".csv", "unknown"), ("/x.csv/plain", "unknown"), ("g.", "unknown"), ("..h.csv", "csv"),
])
def test_routing(spark, name, kind):
    assert spark.range(1).select(fs.file_kind(F.lit(name))).first()[0] == kind


def test_batch_status(spark):
    df = spark.createDataFrame([("a.csv", 10), ("b.exe", 10), ("c.pdf", fs.MAX_FILE_SIZE), ("d.pdf", fs.MAX_FILE_SIZE + 1)], "path string, length bigint")
    status = fs.scan_status(df)
    assert [r.message for r in status.orderBy("path").collect()] == ["Success", "Invalid file type", "Success", "File too large"]
    assert tuple(fs.batch_totals(status).first()) == (4, 2, 2)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿préz".encode())
    (tmp_path / "b.txt").write_bytes("préz".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b" \n\t ")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in fs.read_text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("préz", "SUCCESS") and got["b.txt"] == ("préz", "SUCCESS") and got["c.txt"][1] == "EMPTY"
    sizes = {r.path.rsplit("/", 1)[1]: r.length for r in fs.list_directory(spark, str(tmp_path)).collect()}
    assert sizes == {"a.txt": 8, "b.txt": 4, "c.txt": 4}
    assert fs.read_bytes(spark, str(tmp_path), max_size=4).count() == 2
    hashes = {r.h for r in fs.read_bytes(spark, str(tmp_path)).select(fs.content_hash(F.col("content")).alias("h")).collect()}
    assert len(hashes) == 3


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,amount,flag\n1,"a ""q"", b",1.5,true\n2,N/A,,false\n3,None,7,True\n')
    df = fs.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "amount": "double", "flag": "boolean"}
    assert sorted(map(tuple, df.collect())) == [(1, 'a "q", b', 1.5, True), (2, None, None, False), (3, None, 7.0, True)]
    typed = fs.read_csv(spark, str(tmp_path / "t.csv"), "id int, name string, amount decimal(9,2), flag string")
    assert dict(typed.dtypes)["amount"] == "decimal(9,2)"


def grid_of(cells):
    return {(r.sheet, r.row, r.col): r.value for r in cells.collect()}


def test_csv_grid(spark, tmp_path):
    (tmp_path / "g.csv").write_text('a,"x,y",,\n\n   ,  z\n,,,1\n')
    assert grid_of(fs.csv_to_cells(spark, str(tmp_path))) == {
        ("g.csv", 0, 0): "a", ("g.csv", 0, 1): "x,y", ("g.csv", 2, 1): "  z", ("g.csv", 3, 3): "1"}


def test_csv_grid_rows_count_through_all_splits(spark, tmp_path):
    lines = ["" if i % 5 == 0 else f"v{i},{i}" for i in range(3000)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = grid_of(fs.csv_to_cells(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n, i, c): v for n in ("a.csv", "b.csv") for i in range(3000) if i % 5 for c, v in ((0, f"v{i}"), (1, str(i)))}
    assert got == want


def test_csv_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"two\nlines, ""quoted"""\n2,x\n')
    got = fs.read_csv(spark, str(tmp_path)).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 'two\nlines, "quoted"'), (2, "x")]
    (tmp_path / "b.csv").write_text("t,k\ny,3\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        fs.read_csv(spark, str(tmp_path), "k int, t string").collect()


def test_grid_with_one_wide_line(spark, tmp_path):
    (tmp_path / "g.csv").write_text('a,"b, ""c""",,d\n' + "," * 20_000 + "end\n\n, ,z\n")
    got = sorted((r.row, r.col, r.value) for r in fs.csv_to_cells(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "a"), (0, 1, 'b, "c"'), (0, 3, "d"), (1, 20_000, "end"), (3, 2, "z")]


def test_every_listed_file_has_a_status(spark, tmp_path):
    for name, size in (("a.txt", 3), ("b.txt", 30), ("c.txt", 0)):
        (tmp_path / name).write_text("x" * size or " ")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in fs.read_text_files(spark, str(tmp_path), max_size=10).collect()}
    assert got == {"a.txt": ("xxx", "SUCCESS"), "b.txt": (None, "FAILED"), "c.txt": (" ", "EMPTY")}
    assert fs.read_text_files(spark, str(tmp_path)).count() == 3


def plain_records(text):
    """Cells of a CSV text by one pass over its characters."""
    rows, cells, cell, quoted, i = [], [], "", False, 0
    text = text.replace("\r\n", "\n")
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + c, i + 1
            elif c == '"':
                quoted = False
                while i + 1 < len(text) and text[i + 1] not in ",\n":
                    i += 1
            else:
                cell += c
        elif c == '"' and (i == 0 or text[i - 1] in ",\n"):
            quoted = True
        elif c == ",":
            cells, cell = [*cells, cell], ""
        elif c == "\n":
            rows, cells, cell = [*rows, [*cells, cell]], [], ""
        else:
            cell += c
        i += 1
    return [*rows, [*cells, cell]] if cells or cell else rows


@pytest.mark.parametrize("split", [40, 700, 1 << 20])
def test_records_of_several_lines_in_split_files(spark, tmp_path, split):
    rnd = random.Random(split)
    pool = ["a", "", 'say "x"', "two\nlines", "a,b", '5" pipe', "\n", "three\n\nlines, \"q\"\n", "ü漢", '"']
    texts = {}
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [[rnd.choice(pool) for _ in range(rnd.randrange(1, 5))] for _ in range(150)]
        cell = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set(',\n') or v[:1] == '"' or rnd.random() < 0.3 else v
        texts[name] = ("\r\n" if name == "b.csv" else "\n").join(",".join(map(cell, r)) for r in rows) + "\n"
        (tmp_path / name).write_bytes(texts[name].encode())
    (tmp_path / "stray.csv").write_text('x,"open\ny,z\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        cells = fs.csv_to_cells(spark, str(tmp_path))
        assert split > 1000 or cells.rdd.getNumPartitions() > 1
        got = grid_of(cells)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n, r, c): v for n, t in texts.items() for r, row in enumerate(plain_records(t)) for c, v in enumerate(row) if v.strip()}
    assert {k: v for k, v in got.items() if k[0] != "stray.csv"} == want
    assert {k[1:]: v for k, v in got.items() if k[0] == "stray.csv"} == {(0, 0): "x", (0, 1): '"open', (1, 0): "y", (1, 1): "z"}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "t.csv", "w") as f:
        f.write("k,t\n")
        f.writelines(f'{i},"line {i}\nnext ""{i}"""\n' for i in range(60_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        df = fs.read_csv(spark, str(tmp_path))
        assert df.agg(F.count("*"), F.sum("k"), F.count_if(F.col("t") == F.concat(F.lit("line "), "k", F.lit('\nnext "'), "k", F.lit('"')))).first() == (60_000, 60_000 * 59_999 // 2, 60_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_cell_of_many_doubled_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,"' + '""x' * 3000 + '"\n"' + '""\n' * 2000 + '",b\n')
    got = {(r.row, r.col): r.value for r in fs.csv_to_cells(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): "a", (0, 1): '"x' * 3000, (1, 0): '"\n' * 2000, (1, 1): "b"}


def test_csv_columns_without_a_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffa,,A\n1,2\n\n3,4,5,6\n")
    df = fs.read_csv(spark, str(tmp_path))
    assert df.columns == ["a0", "_c1", "A2"] and sorted(map(tuple, df.collect()), key=str) == [(1, 2, None), (3, 4, 5)]
