"""CSV with quoted line breaks, cut at every byte, against Spark's own multi-line reader and Python's."""
import csv
import io
import random

import pytest

from patchlens.sources import io as IO
from patchlens.sources import ranged_csv as R

SCHEMA = "a string, b string, n int"


@pytest.fixture
def cut(spark):
    """Splits of the given number of bytes while a test runs."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def at(size):
        for n, v in zip(names, (size, size, 1)):
            spark.conf.set(n, str(v))
    yield at
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def struct(spark):
    return spark.createDataFrame([], SCHEMA).schema


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXT = 'a,b,n\n"x\ny","say ""hi""\n\n""",1\nplain,,2\n\n"","""",3\n"a,b","\n",4\n"é\nü","😀",5\nlast,"open ""\n"" end",6'


@pytest.mark.parametrize("newline,final", [("\n", ""), ("\r\n", "end")])
def test_every_cut_gives_the_same_rows(spark, tmp_path, cut, newline, final):
    text = TEXT.replace("\n", newline) + (newline if final else "")
    (tmp_path / "f.csv").write_bytes(text.encode())
    want = [tuple((v or None) if i < 2 else int(v) for i, v in enumerate(r)) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r]
    lines = len(text.splitlines()) - 1
    for size in (1, 4, 11, 23, 64):
        cut(size)
        assert rows_of(R.read(spark, str(tmp_path), struct(spark))) == sorted(want, key=repr), size
        assert tuple(R.count(spark, str(tmp_path)).first()) == (lines, len(want)), size


def test_random_files_equal_the_multi_line_reader(spark, tmp_path, cut):
    rng = random.Random(4)
    for n in range(2):
        for part in range(2):
            with open(tmp_path / f"{n}-{part}.csv", "w", newline="") as f:
                out = csv.writer(f, lineterminator="\n")
                out.writerow(["a", "b", "n"])
                for i in range(rng.choice([0, 1, 20])):
                    out.writerow(["".join(rng.choices('ab",\n é', k=rng.randrange(12))) or "e", "".join(rng.choices('"\nz', k=rng.randrange(40))) or "e", i])
        whole = spark.read.options(**IO.CSV_OPTIONS).schema(struct(spark)).csv(str(tmp_path / f"{n}-*.csv"))
        for size in (40, 1 << 20):
            cut(size)
            assert rows_of(R.read(spark, str(tmp_path / f"{n}-*.csv"), struct(spark))) == rows_of(whole)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, cut):
    with open(tmp_path / "big.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["a", "b", "n"])
        out.writerows([f"row {i}\nof\n\"many\"", "x" * (i % 50), i] for i in range(3000))
    cut(8192)
    rows = R.read(spark, str(tmp_path / "big.csv"), struct(spark))
    assert rows.rdd.getNumPartitions() > 15 and spark.read.options(**IO.CSV_OPTIONS).csv(str(tmp_path / "big.csv")).rdd.getNumPartitions() == 1
    got = rows.selectExpr("count(*)", "sum(n)", "count(distinct a)", "min(length(a))").first()
    assert tuple(got) == (3000, 2999 * 1500, 3000, len('row 1\nof\n"many"'))


def test_nothing_but_headers_and_blanks(spark, tmp_path, cut):
    (tmp_path / "1.csv").write_text("a,b,n\n")
    (tmp_path / "2.csv").write_text("\n\na,b,n\n\n")
    (tmp_path / "3.csv").write_text('\n"a","b\nb",n\n\nx,y,1\n')
    for size in (4, 100):
        cut(size)
        assert rows_of(R.read(spark, str(tmp_path), struct(spark))) == [("x", "y", 1)]


def test_written_tables_come_back(spark):
    df = spark.createDataFrame([("a\r\nb", 'q"', 1), (None, " lead ", 2), ("tab\t", "x,y", None), ("\\", "back\\\"", 4)], SCHEMA)
    assert rows_of(IO.csv_round_trip(df)) == rows_of(df)
