"""The work on written files is dealt over tasks, and lookups within a file shuffle nothing."""

import pytest

from isoframe.plans import carried
from isoframe.plans import container as ct
from isoframe.plans import samples
from isoframe.sources import heif

SF = "/root/testdata/sf0.001"

#: Shuffles of each query once its files are stored, at most.
SHUFFLES = {
    "file_exif": 16,
    "file_sample_bytes": 13,
    "file_iptc": 16,
    "file_colours": 23,
    "file_auxiliary": 10,
    "file_frames": 10,
    "file_property_sharing": 2,
    "file_top_level": 8,
    "file_wanted": 14,
    "file_xmp": 16,
    "file_sizes": 1,
    "file_track_seconds": 10,
    "file_thumbnails": 4,
}


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", SHUFFLES)
def test_query_is_spread(spark, monkeypatch, tmp_path, no_broadcast, name):
    tasks, empty = [], heif.Containers(heif.parse(carried.files(spark, SF).limit(0))).write(str(tmp_path / "empty"))
    monkeypatch.setattr(heif.Containers, "stored", lambda self: tasks.append(self.parsed.rdd.getNumPartitions()) or empty)
    monkeypatch.setattr(carried, "TASK_FILES", 20)
    rows = carried.QUERIES[name](spark, SF)
    assert tasks == [10]  # 200 files; one task before
    assert shuffles(rows) <= SHUFFLES[name]


def test_first_in_a_file_needs_no_shuffle(spark):
    c = heif.Containers(heif.parse(samples.files(spark)))
    for rows in (ct.unique_items(c), ct.linked_properties(c), ct.references(c), ct.item_data(c)):
        assert shuffles(rows) == 0 and "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_mark_first():
    rows = [{"item_id": i, "entry": e} for i, e in ((1, 0), (2, 1), (2, 0), (1, 0), (3, 5))]  # a second ipma box counts from 0 again
    heif.mark_first(rows, ("item_id",), "entry")
    assert [x["first"] for x in rows] == [True, False, True, True, True]


def test_item_data_of_odd_extents(spark):
    def place(location, item_id, method, offset, length):
        return (location, item_id, 0, method, offset, length, 0)

    places = [
        place(0, 1, "file", 2, 3), place(0, 1, "file", 8, 0), place(1, 1, "file", 0, 1), place(2, 2, "idat", 1, 2), place(3, 3, "file", 9, 2), place(4, 4, "item", 0, 1),
        place(5, 5, "file", 10, 0), place(6, 6, "file", 11, 0), place(7, 7, "file", 0, 1), place(7, 7, "file", 4, 7),
    ]
    kinds = heif.schema(spark)
    row = dict.fromkeys(kinds.names) | {"path": "odd", "content": bytearray(b"0123456789"), "idat": bytearray(b"abc"), "extents": places, "items": [(0, 2, "Exif", "", True, None, True)]}
    c = heif.Containers(spark.createDataFrame([tuple(row[n] for n in kinds.names)], kinds))
    assert {r.item_id: r.data and bytes(r.data) for r in ct.item_data(c).collect()} == {1: b"23489", 2: b"bc", 3: None, 5: b"", 6: None, 7: None}
    assert [r.item_id for r in ct.item_data(c, ("Exif",)).collect()] == [2]
