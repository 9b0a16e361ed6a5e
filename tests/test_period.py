from datetime import datetime

import pytest
from costweave.sources.period import Period
from hypothesis import given, settings, strategies as st
from rows import billing


def test_span_crosses_years():
    assert Period.span((1997, 11), (1998, 2)).months == (
        (1997, 11), (1997, 12), (1998, 1), (1998, 2))


def test_range_is_half_open():
    p = Period.range(datetime(1998, 1, 31), datetime(1998, 3, 1))
    assert p.months == ((1998, 1), (1998, 2))
    assert p.runs() == [(datetime(1998, 1, 31), datetime(1998, 3, 1))]


def test_runs_of_separate_months():
    p = Period(((1998, 1), (1998, 3), (1998, 4)))
    assert p.runs() == [(datetime(1998, 1, 1), datetime(1998, 2, 1)),
                        (datetime(1998, 3, 1), datetime(1998, 5, 1))]


@pytest.mark.parametrize("bad", [(), ((1998, 13),), ((98, 1),)])
def test_bad_months(bad):
    with pytest.raises(ValueError):
        Period(bad)


def test_bad_spans():
    with pytest.raises(ValueError):
        Period.span((1998, 2), (1998, 1))
    with pytest.raises(ValueError):
        Period.range(datetime(1998, 1, 2), datetime(1998, 1, 2))


def test_paths_are_padded():
    assert Period.month(1998, 3).paths("/x/") == ["/x/year=1998/month=03"]


def test_straddle_keeps_both_months(spark):
    df = billing(spark, [{"at": "1997-12-31T23:59:59.999999"}, {"at": "1998-01-01"},
                         {"at": "1997-01-15"}, {"at": "1998-12-15"}])
    kept = Period.span((1997, 12), (1998, 1)).scope(df).select("year", "month").collect()
    assert sorted((r.year, r.month) for r in kept) == [("1997", "12"), ("1998", "01")]


def test_end_is_exclusive(spark):
    df = billing(spark, [{"at": "1998-03-31T23:59:59.999999"}, {"at": "1998-04-01"}])
    assert Period.month(1998, 3).scope(df).count() == 1


def test_unpadded_partition_matches_nothing(spark):
    df = billing(spark, [{"at": "1998-03-05", "month": "3"}])
    assert Period.month(1998, 3).scope(df).count() == 0


def test_zoned_timestamps_compare_in_utc(spark):
    df = billing(spark, [{"at": "1998-03-01"}, {"at": "1998-03-31T23:00:00"}], ntz=True)
    zoned = df.withColumn("line_item_usage_start_date",
                          df.line_item_usage_start_date.cast("timestamp"))
    assert Period.month(1998, 3).scope(zoned).count() == 2


months = st.tuples(st.integers(1990, 2030), st.integers(1, 12))


@settings(max_examples=60, deadline=None)
@given(st.sets(months, min_size=1, max_size=30))
def test_runs_cover_exactly_the_months(chosen):
    p = Period(tuple(chosen))
    covered = set()
    for lo, hi in p.runs():
        at = lo
        while at < hi:
            covered.add((at.year, at.month))
            at = datetime(at.year + at.month // 12, at.month % 12 + 1, 1)
    assert covered == chosen
    assert all(a[1] < b[0] for a, b in zip(p.runs(), p.runs()[1:]))
