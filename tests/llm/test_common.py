import glob

import pyarrow as pa
import pytest

from tracewinnow.llm import common


def test_slices_hold_whole_rows():
    texts = ["a" * n for n in (3, 50, 0, 10, 200, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["n", "text"])
    out = list(common.slices(iter([batch, batch.slice(0, 0)]), limit=60))
    assert [b.column("n").to_pylist() for b in out] == [[0, 1, 2], [3], [4], [5, 6, 7]]
    assert common.utf8(out[-1].column("text")) == [b"a", b"a", b""]


def test_tables_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == folder.rstrip("/")
    df = common.materialise(spark.range(5), "some-name")
    assert df.count() == 5 and glob.glob(f"{folder}/winnow-some-name-*")
    common.clean(spark)
    assert not glob.glob(f"{folder}/winnow-*")
    with pytest.raises(Exception):  # noqa: B017 - what is removed can't be read
        df.count()


def test_batches_are_bounded_in_bytes(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    long = spark.range(4000, numPartitions=1).selectExpr("repeat('x', 10000) AS text")
    assert max(r.n for r in common.map_batches(long, count, "n long").collect()) < 12 << 20
