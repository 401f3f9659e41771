from types import SimpleNamespace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import _util


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=6), max_size=5), st.integers(1, 30))
def test_chunks_lose_nothing(batches, most):
    made = [pa.RecordBatch.from_arrays([pa.array(b, pa.string()), pa.array(range(len(b)), pa.int64())], ["text", "k"]) for b in batches]
    out = list(_util.chunks(iter(made), most=most))
    assert [x for t in out for x in t["text"].to_pylist()] == [x for b in batches for x in b]
    for t in out:
        sizes = [len((x or "").encode()) for x in t["text"].to_pylist()]
        assert sum(sizes) <= most or len(t) == 1 or sum(sizes[:-1]) <= most


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=10)), max_size=12), st.integers(0, 5), st.integers(0, 8))
def test_text_buffer_of_slices(texts, start, size):
    part = pa.chunked_array([pa.array(texts[:3], pa.string()), pa.array(texts[3:], pa.string())]).slice(start, size)
    raw, at = _util.text_buffer(part)
    data = raw.tobytes()
    assert [data[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [x or "" for x in texts[start : start + size]]


def test_segment_hashes_depend_on_bytes_alone():
    import numpy as np

    raw = np.frombuffer(b"abcabcxabd", np.uint8)
    h = _util.segment_hashes(raw, np.array([0, 3, 7, 0]), np.array([3, 6, 10, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_shared_folder_is_the_session_setting(spark):
    def session(at, master):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: at))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=context)

    assert _util.shared_dir(session("hdfs://x/shared/", "yarn")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _util.shared_dir(session(None, "yarn"))
    own = spark.conf.get("spark.checkpoint.dir", None)
    assert _util.shared_dir(spark) == own.rstrip("/") if own else _util.shared_dir(spark).startswith("file:")


def test_batches_are_held_small(spark):
    _util.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == _util.BATCH_BYTES
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    _util.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("1m", "1048576b")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_large_files_are_not_broadcast(spark, tmp_path):
    big = tmp_path / "big"
    with open(big, "wb") as f:
        f.truncate((64 << 20) + 1)
    with pytest.raises(ValueError, match="too large"):
        _util.ship(spark, str(big))
