"""Randomised properties (one Spark job per generated batch)."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hotspot.functions import calendar as cal
from hotspot.functions import clean as cl
from hotspot.functions.waypoints import pack_waypoints, parse_waypoints

DATES = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(DATES, st.integers(0, 6)), min_size=1, max_size=60))
def test_week_start_matches_python(spark, rows):
    df = spark.createDataFrame(rows, "d date, a int")
    got = [(r[0], r[1], r[2]) for r in df.select("d", "a", cal.week_start("d", "a")).collect()]
    for d, a, w in got:
        assert w == d - dt.timedelta(days=(d.weekday() - a) % 7)
        assert w.weekday() == a


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-18_000_000, 18_000_000), min_size=1, max_size=60))
def test_round_key_matches_numpy(spark, ints):
    vals = [i / 1e5 for i in ints]  # 5-decimal positions, ties at 4 decimals included
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(cl.round_key("x")).collect()]
    assert got == [float(np.rint(v * 1e4) / 1e4) for v in vals]


NAME = st.text(alphabet="ABCxyz ", min_size=1, max_size=6).map(str.strip).filter(bool)
COORD = st.integers(-9000, 9000).map(lambda i: str(i / 100))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(NAME, COORD, COORD, st.sampled_from(["circle", "star", "x"])), min_size=1, max_size=5))
def test_pack_parse_round_trip(spark, wps):
    row = (1, ";".join(w[0] for w in wps), ";".join(w[1] for w in wps), ";".join(w[2] for w in wps), ";".join(w[3] for w in wps))
    p = spark.createDataFrame([row], "project_id bigint, wpt_names string, wpt_lats string, wpt_lons string, wpt_symbols string")
    once = [tuple(r) for r in parse_waypoints(p).orderBy("pos").collect()]
    twice = [tuple(r) for r in parse_waypoints(pack_waypoints(parse_waypoints(p))).orderBy("pos").collect()]
    assert once == twice and len(once) == len(wps)
    assert [(r[2], r[3], r[4], r[5]) for r in once] == [(w[0], float(w[1]), float(w[2]), w[3]) for w in wps]
