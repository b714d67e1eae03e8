"""The stack data source: page ranges, pushed filters, the bytes it reads, and what it writes."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from framelake.sources import stack, tiff


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    return {f"a{k}.tif": [rng.integers(-32768, 32767, (50, 70)).astype(np.int16) for _ in range(n)] for k, n in enumerate((40, 2, 7))}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, images):
    path = tmp_path_factory.mktemp("stacks")
    for name, pages in images.items():
        (path / name).write_bytes(tiff.stack_bytes(pages, "SI4.channelsSave = [1;2]\n" + name))
    (path / "notes.txt").write_text("no stack")
    return path


def frames_of(rows):
    return {(r.path.rpartition("/")[2], r.frame_in_movie): np.array(r["values"]).reshape(r.width, r.height).T for r in rows}


def same(found, images, wanted):
    want = {(n, k): p for n, pages in images.items() for k, p in enumerate(pages) if wanted(n, k)}
    return found.keys() == want.keys() and all((found[k] == want[k]).all() for k in want)


def test_reads_all_pages_in_many_partitions(spark, folder, images):
    stack.register(spark)
    rows = spark.read.format("imagestack").option("partitionBytes", 60_000).load(str(folder))
    assert rows.rdd.getNumPartitions() >= 5
    got = rows.collect()
    assert len(got) == 49 and same(frames_of(got), images, lambda n, k: True)
    # The same rows as by reading whole files.
    assert {(r.path, r.frame_in_movie, r.height, tuple(r["values"][:9])) for r in got} == {(r.path, r.frame_in_movie, r.height, tuple(r["values"][:9])) for r in tiff.read_stacks(spark, str(folder / "*.tif")).collect()}
    assert same(frames_of(stack.read_frames(spark, f"{folder}/a[12].tif").collect()), images, lambda n, k: n != "a0.tif")


def test_filters_reach_the_reader(spark, folder, images):
    rows = stack.read_frames(spark, str(folder))
    cases = [
        (F.col("frame_in_movie").isin(3, 39, 100), lambda n, k: k in (3, 39)),
        ((F.col("frame_in_movie") >= 5) & (F.col("frame_in_movie") < 7), lambda n, k: 5 <= k < 7),
        (F.col("path").endswith("a2.tif") & (F.col("frame_in_movie") == 6), lambda n, k: (n, k) == ("a2.tif", 6)),
        ((F.col("frame_in_movie") > 37) & (F.col("height") == 50), lambda n, k: k > 37),
        (F.col("frame_in_movie") == 1000, lambda n, k: False),
        ((F.col("frame_in_movie") == 3) & (F.col("frame_in_movie") == 4), lambda n, k: False),
        (F.col("path").contains("a1") | (F.col("frame_in_movie") == 0), lambda n, k: n == "a1.tif" or k == 0),
    ]
    for condition, wanted in cases:
        assert same(frames_of(rows.where(condition).collect()), images, wanted)
        # A query without filters, over the same DataFrame, has all rows.
        assert rows.count() == 49


def counted(monkeypatch):
    """Bytes read from each file through the source."""
    seen = collections.Counter()
    plain = stack.reads_of

    def counting(file):
        read = plain(file)

        def one(at, n):
            out = read(at, n)
            seen["bytes"] += len(out)
            return out

        return one

    monkeypatch.setattr(stack, "reads_of", counting)
    return seen


def test_three_frames_of_many_leave_the_others_unread(monkeypatch, folder, images):
    seen = counted(monkeypatch)
    reader = stack.FilteredReader(str(folder), 60_000)
    left = list(reader.pushFilters([In(("frame_in_movie",), (3, 20, 38)), StringContains(("path",), "a")]))
    assert [type(f) for f in left] == [StringContains]
    parts = reader.partitions()
    # Ranges of the long stack without a wanted page are no partitions; the last range is open, as page counts are estimates.
    assert len([p for p in parts if p.files and p.files[0].endswith("a0.tif")]) <= 4
    got = [(p.rpartition("/")[2], f) for part in parts for batch in reader.read(part) for p, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    assert sorted(got) == [("a0.tif", 3), ("a0.tif", 20), ("a0.tif", 38), ("a2.tif", 3)]
    page = 50 * 70 * 2
    # Four pages' pixels, and of the directories before them a small read each.
    assert 4 * page <= seen["bytes"] <= 4 * page + 120 * tiff.DIRECTORY_READ + 200 and seen["bytes"] < 49 * page / 3


def test_named_files_are_the_only_ones_opened(monkeypatch, folder):
    reader = stack.FilteredReader(str(folder), 1 << 20)
    assert list(reader.pushFilters([EqualTo(("path",), f"file:{folder}/a1.tif"), GreaterThanOrEqual(("frame_in_movie",), 1), LessThan(("frame_in_movie",), 2)])) == []
    assert [p.files for p in reader.partitions()] == [[f"file:{folder}/a1.tif"]]
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]


def test_writes_stacks_that_are_read_back(spark, tmp_path, images):
    rows = [(n, k, 50, 70, p.T.reshape(-1).astype(float).tolist()) for n, pages in images.items() for k, p in enumerate(pages)]
    rows[0][4][0], rows[0][4][1] = 1e9, float("nan")
    table = spark.createDataFrame(rows, "name string, frame_in_movie long, height int, width int, values array<double>").repartition(6)
    stack.write_stacks(table, str(tmp_path / "out"), "name")
    found = frames_of(stack.read_frames(spark, str(tmp_path / "out")).collect())
    assert found["a0.tif", 0][0, 0] == 32767 and found["a0.tif", 0][1, 0] == 0
    found["a0.tif", 0][:2, 0] = images["a0.tif"][0][:2, 0]
    assert same(found, images, lambda n, k: True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(images)
    # Whole files read through Spark give the same pages of this format.
    assert tiff.read_stacks(spark, str(tmp_path / "out"), [1]).count() == 3
    stack.write_stacks(table.where("name = 'a1.tif'").withColumn("values", F.transform("values", lambda v: v / 4)), str(tmp_path / "real"), "name", "<f8")
    back = frames_of(stack.read_frames(spark, str(tmp_path / "real")).collect())
    assert (back["a1.tif", 1] == images["a1.tif"][1] / 4).all()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("x.tif", k, 2, 2, [1.0] * (4 if k < 5 else 3)) for k in range(6)], "file string, frame_in_movie long, height int, width int, values array<double>")
    with pytest.raises(Exception, match="reshape"):
        stack.write_stacks(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not any(p.suffix == ".tif" for p in (tmp_path / "out").rglob("*"))


def test_headers_of_first_files_only(spark, monkeypatch, folder):
    files = spark.createDataFrame([("m1", f"{folder}/a0.tif"), ("m1", f"{folder}/gone.tif"), ("m2", f"{folder}/a2.tif")], "acquisition string, path string")
    got = {r.acquisition: r.head for r in stack.first_headers(files).collect()}
    assert got["m1"].startswith("SI4.channelsSave") and "a0.tif" in got["m1"] and "a2.tif" in got["m2"]
    fields = {r.path.rpartition("/")[2]: r.fields for r in tiff.header_fields(stack.first_headers(files)).collect()}
    assert {k: v["SI4.channelsSave"] for k, v in fields.items()} == {"a0.tif": 2.0, "a2.tif": 2.0}
    seen = counted(monkeypatch)
    system, inner, _ = stack.opened(str(folder / "a0.tif"))
    with system.open_input_file(inner) as file:
        assert tiff.description(stack.reads_of(file)).startswith("SI4")
    assert seen["bytes"] < 1000
