import json

import pytest
from pyspark.sql import functions as F

from corpusgraph.jobs import reports as D
from tests.conftest import rows


def table(spark, *docs):
    return spark.createDataFrame([(f"r{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "path string, raw string")


@pytest.mark.parametrize(("text", "number"), [("3", 3.0), (" 3.5 ", 3.5), ("1_000", 1000.0), ("1__0", None), ("_1", None), ("1d", None), ("abc", None), ("", None), (None, None), ("1e3", 1000.0), ("-.5", -0.5), ("inf", float("inf")), ("5.", 5.0)])
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(D.parse_value(F.col("t"))).first()[0] == number


def test_nodes_anywhere_and_the_last_one_counts(spark):
    doc = {"A": [{"Tag": "Filling_X", "Statistics_Max": 0, "History_Y_YMax": "0", "Statistics_Min": "", "History_Y_YMin": 2, "Unit": " mm "}, {"B": {"Tag": "Warpage_T", "Statistics_Max": "1", "Deeper": {"Tag": "Warpage_T", "Statistics_Max": "2"}}}], "C": {"Tag": "warpage_T", "Statistics_Max": 9}, "D": {"Tag": 5}, "E": {"Tag": "Cooling_Y", "Statistics_Max": "n/a"}}
    got = rows(D.stage_stats(table(spark, doc)), "stage", "field", "max", "max_raw", "min", "unit")
    assert got == [("cooling", "Y", None, "n/a", None, ""), ("filling", "X", 0.0, "0", 2.0, "mm"), ("warpage", "T", 2.0, "2", None, "")]
    assert rows(D.bad_reports(table(spark, "{broken", {}))) == [("r0",)]


def run(spark, **values):
    base = {"run_key": "r", "gate_freeze_time_s": None, "packing_gate_freeze": None, "packing_time_s": 5.0, "mold_temperature_C": 60.0, "warpage_mm": 0.3, "residual_stress": None, "mold_temp_diff": None} | values
    schema = ", ".join(f"{k} {'string' if k == 'run_key' else 'double'}" for k in base)
    return spark.createDataFrame([tuple(base.values())], schema)


@pytest.mark.parametrize(
    ("values", "least", "most", "action"),
    [({}, None, None, "MAINTAIN"), ({"gate_freeze_time_s": 0.0, "packing_gate_freeze": 6.0}, 6.3, None, "MAINTAIN"), ({"gate_freeze_time_s": 5.0}, None, 6.0, "MAINTAIN"), ({"mold_temp_diff": 20.0, "residual_stress": 11.0}, None, None, "MAINTAIN"), ({"mold_temp_diff": 21.0, "residual_stress": 10.5}, None, None, "INCREASE")],
)
def test_rules(spark, values, least, most, action):
    d = D.diagnose(run(spark, **values)).first()
    c = d.hard_constraints
    assert (c.packing_time_s_min, c.packing_time_s_max, c.mold_temperature_action) == (least, most, action)
    assert d.is_converged and len(d.active_causal_paths) == 2
    assert f">= {least if least is not None else 5} 秒" in d.llm_prompt_context
    assert ("[70.0, 75.0]" if action == "INCREASE" else "[60]") in d.llm_prompt_context


def test_header_summary_and_quarantine(spark):
    full = {"CBASE": {"Value_Run_ID": "Run01", "Value_Process_PackingTime": "3.0", "Value_GateFreezeTime": " 2 "}, "X": [{"Tag": "Warpage_TotalDisplacement", "Statistics_Max": "0.42"}, {"Tag": "Filling_XY_SpruePressure", "History_Y_YMax": 88}]}
    r = table(spark, full, {"CBASE": {"Value_Process_PackingTime": "3"}}, {}, "{broken")
    header = D.run_header(r)
    assert rows(header, "run_key", "run_information.run_id", "process_settings.packing_time_s")[0] == ("r0", "Run01", 3.0)
    runs = D.run_summary(header, D.stage_stats(r))
    assert rows(runs.filter("run_key = 'r0'"), "warpage_mm", "max_sprue_pressure_MPa", "gate_freeze_time_s", "volume_filled_percent") == [(0.42, 88.0, 2.0, 100.0)]
    assert rows(D.undiagnosed(runs)) == [("r1", "no warpage"), ("r2", "no warpage"), ("r3", "no warpage")]


def test_deep_documents_are_listed_and_end_no_job(spark):
    deep = '{"a":' * 100_000 + "1" + "}" * 100_000
    tagged = {"Tag": "Warpage_T", "Statistics_Max": 4}
    for _ in range(300):
        tagged = {"x": [tagged]}
    r = table(spark, deep, tagged, "", "null", "[]")
    assert rows(D.stage_stats(r), "run_key", "max") == [("r1", 4.0)]
    assert rows(D.bad_reports(r)) == [("r0",), ("r2",)]


def test_round_one_is_that_of_exact_binary_values(spark):
    values = [x / 20 for x in range(-400, 400)] + [0.05, 0.15, 0.25, 0.35, 1.05, 3.15, 2.675, 1e14 + 0.25, 1e16, -0.05, 123456.75, 0.1 + 0.2, 5e-324]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", D.round_one(F.col("x")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [round(v, 1) for v in values]
