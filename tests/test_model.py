from datetime import datetime

import pytest

from coldkeep import LifecyclePolicy, Rule, Selection, TableRule, UnknownTable
from coldkeep.model import check_rules, check_run_id, find_rule

T1 = TableRule("orders", "created_at", 30, ("id",))


@pytest.mark.parametrize("change", [
    {"name": ""}, {"date_column": ""}, {"days_online": 0}, {"days_online": -1}, {"key": ()},
])
def test_table_rule_rejects(change):
    with pytest.raises(ValueError):
        TableRule(**{"name": "t", "date_column": "d", "days_online": 1, "key": ("id",), **change})


@pytest.mark.parametrize("change", [
    {"name": ""}, {"database": ""}, {"tables": ()}, {"tables": (T1, T1)}, {"batch_size": 0}, {"batch_size": -5},
    {"encoding": "csv"},
])
def test_rule_rejects(change):
    with pytest.raises(ValueError):
        Rule(**{"name": "r", "database": "db", "tables": (T1,), **change})


def test_defaults_and_lookup():
    rule = Rule("r", "db", (T1,))
    assert rule.batch_size == 10_000
    assert rule.selected_tables() == (T1,)
    assert rule.selected_tables("orders") == (T1,)
    with pytest.raises(UnknownTable):
        rule.selected_tables("nope")
    assert find_rule([rule], "r") is rule
    with pytest.raises(KeyError):
        find_rule([rule], "x")
    with pytest.raises(ValueError):
        check_rules([rule, rule])
    with pytest.raises(ValueError):
        check_rules([])


def test_cutoff_keeps_time_of_day():
    assert T1.cutoff(datetime(2024, 3, 1, 8, 30)) == datetime(2024, 1, 31, 8, 30)


def test_run_ids_and_selection():
    assert check_run_id("12e45678") == "12e45678"
    for bad in ("", "a/b", "a_b", "a b"):
        with pytest.raises(ValueError):
            check_run_id(bad)
    with pytest.raises(ValueError):
        Selection(cutoff_date="yesterday")
    with pytest.raises(ValueError):
        LifecyclePolicy(-1, 0)
