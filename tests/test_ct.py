import numpy as np
import pytest

from quarry.operators import voxels
from quarry.plans import ct
from quarry.sources import volumes


def test_segmentation(spark):
    r = np.random.default_rng(3)
    volume = r.integers(0, 20, (10, 12, 14)).astype("uint16")
    volume[2:5, 3:6, 2:12] = 200
    volume[8, 10, 1] = 210
    chunks = spark.createDataFrame(list(volumes.chunked(volume, "v", 5)), volumes.CHUNK)
    labels, _ = voxels.label_26(volume > 100)
    for least, want in ((1, 91), (2, 90)):
        got = ct.segmented(chunks, least).collect()
        assert len(got) == want and {(x.z, x.y, x.x) for x in got} <= {tuple(map(int, c)) for c in np.argwhere(labels)} and {x.threshold for x in got} == {19.0}
        assert {x["size"] for x in got} == ({1, 90} if least == 1 else {90})


def test_skeleton_points(spark):
    cells = spark.createDataFrame([(0, 1, 2, 1.0), (3, 4, 5, 0.0), (6, 7, 8, float("nan")), (6, 7, 9, None)], "z int, y int, x int, v double")
    assert [tuple(x) for x in ct.skeleton_points(cells).collect()] == [(2, 1, 0)]


def test_compared_lattices(spark):
    shape = ("id long, x double, y double, z double", "id long, junction0 long, junction1 long, thickness double")
    left = [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0), (4, 5.0, 0.0, 0.0)], [(10, 1, 2, 0.5), (11, 1, 3, 0.5), (12, 3, 4, None), (13, 2, 4, 1.0)]
    right = [(1, 0.0, 0.0, 1e-7), (2, 1.0, 0.5, 0.0), (3, 1.0, 0.0, 0.0), (9, 7.0, 0.0, 0.0)], [(10, 2, 1, 0.5), (11, 1, 2, 0.5), (12, 3, 9, 0.1), (14, 1, 9, 1.0)]
    made = [tuple(spark.createDataFrame(rows, s) for rows, s in zip(side, shape, strict=True)) for side in (left, right)]
    counts, details = ct.compared_lattices(*made, details=1)
    assert {x.kind: x.n for x in counts.collect()} == {"junction_left_only": 1, "junction_right_only": 1, "junction_moved": 1, "strut_left_only": 1, "strut_right_only": 1, "strut_rewired": 2, "strut_thickness": 1, "left_welded_nodes": 3, "left_welded_edges": 2, "right_welded_nodes": 4, "right_welded_edges": 3}
    assert {(x.kind, x.id) for x in details.collect()} == {("junction_left_only", 4), ("junction_right_only", 9), ("junction_moved", 2), ("strut_left_only", 13), ("strut_right_only", 14), ("strut_rewired", 11), ("strut_thickness", 12)}


def test_looks_into_documents(spark):
    df = spark.createDataFrame([('{"a": {"b": [10, 20]}}', "# T\n\n## Alignment\nfine\n\n## Next\nmore")], "doc string, report string")
    [row] = ct.document_value(df, "doc", "/a/b/1").collect()
    assert (row.value, row.length, row.cut) == ("20", 2, False)
    [row] = ct.document_value(df, "doc", most=5).collect()
    assert (row.value, row.cut) == ('{"a":', True)
    headings = {"alignment": ("Alignment", 2)}
    assert ct.methodology(df, "report", "alignment", headings).first().markdown == "fine"
    assert ct.methodology(df, "report", "full", headings, 3).first().markdown == "# T"
    with pytest.raises(ValueError, match="section must be"):
        ct.methodology(df, "report", "other", headings)
