import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import block_codec as codec
from tidemark.sources.block_files import BlockFiles, metrics_of


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**60 - 1)), max_size=300))
@settings(max_examples=200, deadline=None)
def test_packed_numbers_round_trip(values):
    data = b"xx" + codec.pack(np.array(values, np.uint64)) + b"tail-of-more-than-8"
    out, at = codec.unpack(data, 2, len(values))
    assert out.tolist() == values and data[at:] == b"tail-of-more-than-8"


def test_packed_words_are_those_of_the_format():
    assert codec.pack(np.array([181, 806, 95])).hex() == f"{9 << 60 | 181 << 50 | 806 << 40 | 95 << 30:016x}"  # six places of 10 bits, three of them used
    assert codec.pack(np.array([7] * 1000)).hex() == f"{15 << 60 | 1000 << 32 | 7:016x}"
    assert codec.pack(np.array([1] * 60)).hex() == f"{(1 << 60) | ((1 << 60) - 1):016x}"
    with pytest.raises(codec.FormatError):
        codec.pack(np.array([1 << 60], np.uint64))
    with pytest.raises(codec.FormatError):
        codec.unpack(codec.pack(np.array([1, 2, 3])), 0, 31)  # a word of two bits has thirty places


@given(st.lists(st.floats(), min_size=1, max_size=60), st.lists(st.sampled_from([1.0, 1.5, 1e300, -0.0]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_floats_round_trip(some, few):
    values = np.array(some + few)
    data = b"x" + codec.pack_floats(values) + b"tail"
    out, at = codec.unpack_floats(data, 1, len(values))
    assert out.view(np.uint64).tolist() == values.view(np.uint64).tolist() and data[at:] == b"tail"


@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=50), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(times, n_fields):
    ts = np.sort(np.array(times, np.int64))
    fields = [np.arange(len(ts)) % 3 == 0 if i % 2 else np.sqrt(np.arange(len(ts))) for i in range(n_fields)]
    data = codec.encode_block(ts, fields)
    got, columns = codec.decode_block(data)
    assert got.tolist() == ts.tolist() and [c.tolist() for c in columns] == [f.tolist() for f in fields]
    if n_fields > 1:
        _, columns = codec.decode_block(data, {1})
        assert columns[0] is None and columns[1].tolist() == fields[1].tolist()
    with pytest.raises((codec.FormatError, IndexError)):
        codec.decode_block(data[: len(data) // 2])


def test_whole_seconds_and_varints():
    ts = np.array([5, 5, 7, 100]) * codec.SECOND
    assert codec.decode_block(codec.encode_block(ts, []))[0].tolist() == ts.tolist()
    for x in (0, 1, 127, 128, 300, 2**63):
        assert codec.read_varint(codec.varint(x) + b"\xff", 0) == (x, len(codec.varint(x)))
    assert codec.varint(300).hex() == "ac02"
    with pytest.raises(codec.FormatError):
        codec.read_varint(b"\xff\xff", 0)


def test_lists_round_trip():
    listed = codec.BlockList(123, np.array([10, 21, 23]), np.array([20, 22, 23]), np.array([3, 4, 3]))
    got = codec.decode_list(codec.encode_list(listed))
    assert (got.updated_nanos, got.since.tolist(), got.until.tolist(), got.timestamps.tolist()) == (123, [10, 21, 23], [20, 22, 23], [3, 4, 3])


def test_data_source(spark, tmp_path):
    spark.dataSource.register(BlockFiles)
    root = str(tmp_path / "db")
    rows = [(1_632_735_700_736_777_900 + i * 3 * 10**9, i % 2 == 0, i / 4) for i in range(100)]
    df = spark.createDataFrame(rows, "ts_nanos bigint, c0 boolean, c1 double").repartitionByRange(3, "ts_nanos")
    df.write.format("tidemark_blocks").option("metric", "m.x").mode("append").save(root)
    assert metrics_of(root) == ["m.x"]
    back = spark.read.format("tidemark_blocks").option("metric", "m.x")
    assert sorted(tuple(r) for r in back.load(root).collect()) == rows
    low, high = rows[40][0], rows[60][0]
    assert sorted(tuple(r) for r in back.option("since", low).option("until", high).load(root).collect()) == rows[40:60]
    later = [(r[0] + 10**12, r[1], r[2]) for r in rows]
    spark.createDataFrame(later, df.schema).coalesce(1).write.format("tidemark_blocks").option("metric", "m.x").mode("append").save(root)
    assert spark.read.format("tidemark_blocks").option("metric", "m.x").load(root).count() == 200
