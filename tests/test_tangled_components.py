"""Components whose rows conflict on shared keys: one task per component, steps of bounded size for larger ones."""

import pytest
from helpers import as_dict, brute_resolve, record, records
from test_resolve import comparable, random_rows

from listwright.operators import matching, rounds
from listwright.operators.resolve import group_rows, resolve

PLACES = ["Leeds", "Bath", "York"]


def chain(n: int) -> list[dict]:
    """One link, rows of three places that conflict, and every fourth row at all places unites their groups."""
    return [
        record(
            ord=i, id=f"r{i}", source_identifier=str(i), title=f"T{i}", canonical_url=f"https://y.test/{i}",
            location="Any" if i % 4 == 3 else PLACES[i % 4], location_type="multi_location" if i % 4 == 3 else "onsite",
            source_authority="official_careers_page" if i % 7 else "official_ats", listing_publisher=None, division=None, application_method=None,
        )
        for i in range(n)
    ]


def spied(monkeypatch) -> list[str]:
    labels, write = [], rounds.cut

    def spy(df, label="cut"):
        labels.append(label)
        return write(df, label)

    monkeypatch.setattr(rounds, "cut", spy)
    return labels


@pytest.mark.parametrize("n", [12, 48])
def test_tables_do_not_grow_with_the_conflicts(spark, monkeypatch, n):
    labels = spied(monkeypatch)
    assert group_rows(records(spark, chain(n))).select("root").distinct().count() == 1
    assert len(labels) <= 4


@pytest.mark.parametrize("rows,limit", [(random_rows(3, 11, hot=True), 6), (random_rows(4, 40, hot=True), 400), (chain(9), 5)])
def test_any_part_size_equals_row_by_row(spark, monkeypatch, rows, limit):
    monkeypatch.setattr(rounds, "SERIAL_ROWS", limit, raising=False)
    df = records(spark, rows)
    keys = {r["ord"]: set(r["k"]) for r in df.select("ord", matching.match_keys().alias("k")).collect()}
    expected = comparable(brute_resolve(rows, keys))
    assert comparable([as_dict(r) for r in resolve(df).collect()]) == expected
