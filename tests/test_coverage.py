import datetime as dt

import pytest

from cairnwise.operators import coverage as cov


def finds_on(spark, days):
    return spark.createDataFrame([(1, i, d) for i, d in enumerate(days)], "user_id long, item_id long, found_date date")


def all_days(year=2001):
    return [dt.date(year, 1, 1) + dt.timedelta(days=i) for i in range(366 if year % 4 == 0 else 365)]


def test_calendar_full_year_has_tours(spark):
    days = all_days() * 2 + [dt.date(2001, 5, 5)]
    row = cov.calendar_coverage(cov.calendar_day_counts(finds_on(spark, days))).first()
    assert (row.completed_365, row.completed_366, row.missing_days, row.tours) == (365, 365, "02-29", 2)


def test_calendar_leap_day_counts_for_tours(spark):
    row = cov.calendar_coverage(cov.calendar_day_counts(finds_on(spark, all_days() * 2 + [dt.date(2004, 2, 29)]))).first()
    assert (row.completed_365, row.completed_366, row.missing_count, row.tours) == (365, 366, 0, 1)


def test_calendar_user_without_finds(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    rows = {r.user_id: r for r in cov.calendar_coverage(cov.calendar_day_counts(finds_on(spark, [dt.date(2001, 1, 1)])), users).collect()}
    assert rows[2].completed_366 == 0 and rows[2].missing_count == 366
    assert rows[1].completed_366 + rows[1].missing_count == 366


@pytest.mark.parametrize("raw,rounded", [(1.01, 1.0), (1.49, 1.5), (2.24, 2.0), (2.26, 2.5), (2.25, 2.0), (2.75, 3.0)])
def test_matrix_rounding(spark, raw, rounded):
    matched = spark.createDataFrame([(1, raw, 1.0)], "user_id long, difficulty double, terrain double")
    assert cov.matrix_cell_counts(matched).first().difficulty == rounded


def test_matrix_all_cells(spark):
    cells = [(1, 1 + d / 2, 1 + t / 2) for d in range(9) for t in range(9)]
    matched = spark.createDataFrame(cells * 2 + cells[:3], "user_id long, difficulty double, terrain double")
    row = cov.matrix_coverage(cov.matrix_cell_counts(matched)).first()
    assert (row.completed, row.missing_cells, row.tours, row.next_round_completed) == (81, "", 2, 3)
    assert cov.matrix_grid(cov.matrix_cell_counts(matched)).count() == 81


def test_unknown_label_matches_nothing(spark):
    dim = spark.createDataFrame([("T", "Trad", ["classic"])], "type_code string, name string, aliases array<string>")
    assert cov.resolve_label(dim, "type_code", "CLASSIC", ("name", "aliases")).count() == 1
    assert cov.resolve_label(dim, "type_code", "none", ("name", "aliases")).count() == 0
