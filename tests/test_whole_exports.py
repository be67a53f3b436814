"""Exports and upserts take all notices."""

from __future__ import annotations

import pytest

from procura import plans
from procura.sources.notices import bids


@pytest.mark.parametrize(("name", "share"), [("s14_csv_export_all", 1.0), ("s13_json_export_all", 1.0), ("s12_insert_new_all", 0.05), ("s11_upsert_all", 0.8)])
def test_rows_grow_with_the_table(spark, sf_dir, name, share):
    assert plans.QUERIES[name](spark, sf_dir).count() >= share * bids(spark, sf_dir).count()
