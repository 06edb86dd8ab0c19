"""Queries over whole rows store the columns that they read, and keys and pairs once."""

import pytest

import __spark_entry__ as entry
from listwright.operators import lifecycle, matching, resolve
from listwright.queries import relations

SF = "/root/testdata/sf0.001"
UNREAD = {"relevance_reasons", "match_components", "degree_restrictions", "description_excerpt"}


@pytest.mark.parametrize(
    "name,module,label",
    [("snapshot_lifecycle", relations, "life"), ("change_detection", relations, "life"), ("resolve_listings", resolve, "records")],
)
def test_unread_columns_are_not_stored(spark, monkeypatch, name, module, label):
    kept, write = {}, module.cut

    def spy(df, as_label="cut"):
        kept[as_label] = set(df.columns)
        return write(df, as_label)

    monkeypatch.setattr(module, "cut", spy)
    entry.queries()[name](spark, SF)
    assert kept[label] and not kept[label] & UNREAD


def test_keys_and_pairs_of_a_snapshot_are_made_once(spark, monkeypatch):
    labels = []
    for module in (matching, lifecycle):
        write = getattr(module, "cut", None)
        monkeypatch.setattr(
            module, "cut", lambda df, label="cut", write=write or matching.cut: labels.append(label) or write(df, label), raising=False
        )
    entry.queries()["snapshot_lifecycle"](spark, SF)
    assert labels.count("keyed") == 1 and labels.count("pairs") == 1
