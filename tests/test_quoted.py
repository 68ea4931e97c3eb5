"""CSV records across split borders, beside the reader that takes a file in one task."""

import random

import pytest

from threadloom.sources import delimited as D
from threadloom.sources.quoted import quoted_records

SCHEMA = "Id bigint, Title string, Body string"


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(rng):
    words = ["plain", 'a "quoted" word', "two\nlines", "three\n\n\nbreaks", "comma, here", "", "caf\xe9", "tab\there", "carriage\r\nreturn", '"', '"\n"', " blank "]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(6)))


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def written_file(folder, name, rng, rows, end="\n", last=True):
    lines = ["Id,Title,Body"] + [f"{i},{quoted(field(rng))},{quoted(field(rng))}" for i in range(rows)]
    (folder / name).write_bytes((end.join(lines) + (end if last else "")).encode("latin-1"))


def test_same_rows_as_one_task_per_file(spark, tmp_path, small_splits):
    rng = random.Random(5)
    written_file(tmp_path, "a.csv", rng, 400)
    written_file(tmp_path, "b.csv", rng, 3)
    written_file(tmp_path, "c.csv", rng, 300, last=False)
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.csv").write_bytes(b"Id,Title,Body\n")
    found = D.csv_dump(spark, str(tmp_path), SCHEMA)
    known = D.csv_dump_by_file(spark, str(tmp_path), SCHEMA)
    assert quoted_records(spark, f"{tmp_path}/a.csv", "ISO-8859-1").rdd.getNumPartitions() > 20
    rows = sorted(map(repr, found.collect()))
    assert len(rows) == 703
    assert rows == sorted(map(repr, known.collect()))


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, with \"quotes\"" for i in range(1000))
    rows = [f"1,{quoted('short')},{quoted(long)}", f"2,{quoted(long)},{quoted('x')}", "3,,", "", "4,a,b"]
    (tmp_path / "long.csv").write_bytes(("Id,Title,Body\n" + "\n".join(rows)).encode("latin-1"))
    found = {r["Id"]: r for r in D.csv_dump(spark, str(tmp_path), SCHEMA).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    assert found[1]["Body"] == long and found[2]["Title"] == long
    assert (found[2]["Body"], found[3]["Title"], found[4]["Body"]) == ("x", None, "b")


def test_a_header_over_split_borders(spark, tmp_path, small_splits):
    names = ["Id", "Title\n" * 300, "Body"]
    (tmp_path / "h.csv").write_bytes((",".join(map(quoted, names)) + "\n7,a,b\n").encode("latin-1"))
    assert [tuple(r) for r in D.csv_dump(spark, str(tmp_path), SCHEMA).collect()] == [(7, "a", "b")]


def test_line_ends_of_two_characters(spark, tmp_path, small_splits):
    rng = random.Random(8)
    written_file(tmp_path, "w.csv", rng, 200, end="\r\n")
    rows = sorted(map(repr, D.csv_dump(spark, str(tmp_path), SCHEMA).collect()))
    assert rows == sorted(map(repr, D.csv_dump_by_file(spark, str(tmp_path), SCHEMA).collect()))


def test_an_open_quote_ends_with_its_file(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes(b'Id,Title,Body\n1,a,b\n2,"open\nstill')
    (tmp_path / "p.csv").write_bytes(b"Id,Title,Body\n3,c,d\n")
    values = sorted(r["value"] for r in quoted_records(spark, str(tmp_path)).where("not header").collect())
    assert values == ["1,a,b", '2,"open\nstill', "3,c,d"]
