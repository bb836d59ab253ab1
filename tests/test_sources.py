"""Source specs: faults of a configuration, and what each field does to the plan."""

import datetime as dt
from dataclasses import replace

import pytest

from wardspark.operators import sources as S
from wardspark.spec import SpecError, TableSpec, sources_from_config

T0 = dt.datetime(2020, 1, 1)
BASE = {"name": "s", "flavour": "absolute", "min_events": 1, "window_minutes": 1000, "tables": [
    {"name": "LAB", "time_column": "charttime", "id_column": "SUBJ", "code_column": "itemid", "selected": ["itemid", "value", "unit"]}]}


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [(i, 1 + i % 2, T0 + dt.timedelta(minutes=10 * i + 1), T0, "a" if i % 3 else "b", str(i) if i % 4 else "neg", "mg", 5) for i in range(30)]
    lab = spark.createDataFrame(rows, "event_id int, SUBJ int, charttime timestamp, storetime timestamp, itemid string, value string, unit string, row_id int")
    stays = spark.createDataFrame([(1, T0), (2, T0)], "id int, intime timestamp")
    return S.Inputs({"LAB": lab}, stays=stays, dictionary=spark.createDataFrame([("a", "Label A")], "ITEMID string, LABEL string"))


def compiled(inputs, source=None, **table):
    spec = sources_from_config([{**BASE, **(source or {})}])[0]
    return S.compile_source(replace(spec, tables=(replace(spec.tables[0], **table),)), inputs)


def test_every_field_changes_the_plan(inputs):
    def rows(df, c):
        return {r["event_id"]: r[c] for r in df.collect()}

    base = compiled(inputs)
    assert set(base.columns) == {"event_id", "ID", "TIME", "TABLE_NAME", "itemid", "value", "unit", "n_events", "ORDER", "time_gap", "source"}
    assert rows(base, "TIME")[4] == 41 and rows(base, "ORDER")[4] == 3 and rows(base, "time_gap")[4] == 20
    assert set(compiled(inputs, selected=("itemid",)).columns) == set(base.columns) - {"value", "unit"}
    everything = compiled(inputs, selected=())
    assert {"storetime", "row_id"} <= set(everything.columns)
    assert "storetime" not in compiled(inputs, selected=(), time_excluded=("storetime",)).columns
    assert "row_id" not in compiled(inputs, selected=(), id_excluded=("row_id",)).columns
    assert rows(compiled(inputs, value_columns=("value",)), "value") == {i: float(i) if i % 4 else None for i in range(30)}
    assert rows(compiled(inputs, category_columns=("unit",)), "unit")[3] == "unit_mg"
    labels = rows(compiled(inputs, dictionary=True), "itemid")
    assert set(labels.values()) == {"Label A"} and len(labels) == 20
    assert rows(compiled(inputs, time_column="storetime", selected=("itemid",)), "TIME") == {}   # at the stay's start, so outside the window
    assert len(rows(compiled(inputs, id_column="row_id", selected=("itemid",)), "ID")) == 0      # no stay of that number
    assert rows(compiled(inputs, code_column=None), "itemid") == rows(base, "itemid")
    assert max(rows(compiled(inputs, {"window_minutes": 100}), "TIME").values()) < 100
    assert compiled(inputs, {"min_events": 16}).count() == 0
    assert {r["source"] for r in compiled(inputs, {"name": "x"}).collect()} == {"x"}


def test_relative_times_and_renamed_tables(spark):
    t = spark.createDataFrame([(1, 7, 5), (2, 7, 0), (3, 7, 99), (4, 7, 12)], "event_id int, pid int, t int")
    spec = sources_from_config([{"name": "r", "flavour": "relative", "relative_time": True, "window_minutes": 50, "min_events": 1,
                                 "tables": [{"name": "other", "time_column": "t", "id_column": "pid"}]}])[0]
    out = {r["event_id"]: (r["TIME"], r["ORDER"], r["time_gap"], r["TABLE_NAME"]) for r in S.compile_source(spec, S.Inputs({"other": t})).collect()}
    assert out == {1: (5, 1, 0, "other"), 4: (12, 2, 7, "other")}


def test_all_faults_are_told_at_once(inputs):
    with pytest.raises(SpecError) as e:
        sources_from_config([{**BASE, "flavor": "x", "flavour": "odd", "cohort": {"gap": 3}}, {"name": "s", "flavour": "absolute", "tables": [{"name": "a", "time": "t"}]}])
    for text in ("unknown key flavor", "unknown flavour odd", "s.cohort: unknown key gap", "s.a: unknown key time", "time_column", "two sources of one name"):
        assert text in str(e.value)
    with pytest.raises(SpecError) as e:
        compiled(inputs, time_column="nope", id_excluded=("gone",), value_columns=("value", "what"), category_columns=("value",), selected=("itemid",))
    for text in ("time_column names unknown column nope", "id_excluded names unknown column gone", "value_columns names unknown column what",
                 "value is a value and a category", "value is used but not selected"):
        assert text in str(e.value)
    spec = sources_from_config([BASE])[0]
    with pytest.raises(SpecError, match="no such table"):
        S.compile_events({replace(spec, tables=(TableSpec("X", "t", "i"),)): inputs})
    with pytest.raises(SpecError, match="need stays"):
        S.compile_events({spec: S.Inputs(inputs.events)})
    with pytest.raises(SpecError, match="dictionary needs"):
        S.compile_events({replace(spec, tables=(replace(spec.tables[0], dictionary=True),)): S.Inputs(inputs.events, stays=inputs.stays)})
