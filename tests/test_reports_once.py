"""Reports of one job read one written table, and a session is compared along with itself in one sort."""

from beatspark import fixtures, queries
from beatspark.operators import quality
from beatspark.plans import jobs

SF = "/root/testdata/sf0.001"


def test_clean_and_report_makes_the_beats_once(spark):
    made = jobs.clean_and_report(fixtures.beats(spark, SF))
    for name in ("before", "after", "changes", "removed", "verdict"):
        assert not [f for f in made[name].inputFiles() if "testdata" in f], name


def test_profile_makes_the_beats_once(spark):
    made = jobs.profile_dataset(fixtures.beats(spark, SF), queries._RANGES, ["dx", "sex", "position"])
    assert [name for name in made if any("testdata" in f for f in made[name].inputFiles())] == ["nulls"]


def test_temporal_integrity_across_ranges(spark):
    """Each range's first row is compared with the last one before it, whatever the span; missing values and keys count."""
    rows = [("s", 0.8 * k + (7 if k > 50 else 0) - (9 if k == 80 else 0), k + (k > 60)) for k in range(120)] + [("s", None, 30_000), ("s", 1.0, None), (None, 5.0, 3), (None, 5.0, 4)]
    frame = spark.createDataFrame(rows, "session_id string, timestamp double, cycle_index int")
    found = {span: sorted(map(tuple, quality.temporal_integrity(frame, span).collect()), key=str) for span in (1, 7, 10_000, 100_000)}
    assert all(x == found[100_000] for x in found.values())
    assert quality.temporal_integrity(frame, 1).columns == ["session_id", "n", "duplicates", "backward", "gaps", "breaks"]
    # the missing time counts as a duplicate, as n is of rows and the times are of values
    assert dict((r[0], r[1:]) for r in found[1]) == {"s": (122, 1, 2, 2, 2), None: (2, 1, 1, 0, 0)}
