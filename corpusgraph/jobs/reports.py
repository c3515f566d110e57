"""Simulation reports: header, stage statistics, summary and diagnosis for any number of runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ("filling", "packing", "cooling", "warpage")
# Output field, report key, and whether the value is parsed as a number.
HEADER = {
    "run_information": [("project_name", "Value_Project_Name", 0), ("run_id", "Value_Run_ID", 0), ("project_date", "Value_Project_Date", 0), ("studio_version_name", "Value_Studio_VersionName", 0), ("run_analysis_sequence", "Value_Run_Analysis", 0)],
    "mesh_information": [
        ("run_meshname", "Value_Run_MeshName", 0), ("mesh_part_dimensions", "Value_Mesh_PartDimension", 0), ("mesh_part_volume", "Value_Mesh_PartVolume", 1), ("cold_runner_volume_cc", "Value_Mesh_ColdRunnerVolume", 1), ("total_volume_cc", "Value_Mesh_TotalVolume", 1),
        ("thickness_max_mm", "Max_Mesh_Thickness", 1), ("thickness_min_mm", "Min_Mesh_Thickness", 1), ("thickness_avg_mm", "Avg_Mesh_Thickness", 1), ("thickness_sd_mm", "SD_Mesh_Thickness", 1),
        ("element_count", "Value_Mesh_ElementNumber", 1), ("part_element_count", "Value_Mesh_PartElementNumber", 1), ("gate_count", "Value_Mesh_GateCount", 1),
    ],
    "material_information": [
        ("grade_name", "Value_Material_PartGenericName", 0), ("polymer_type", "Value_Material_PartType", 0), ("supplier", "Value_Material_PartSupplier", 0), ("density_g_cm3", "Value_Material_Density", 1), ("mfi", "Value_Material_MFIInfo", 0),
        ("glass_transition_temp_C", "Value_Material_GlassTransitionTemperature", 1), ("freeze_temp_C", "Value_Material_PartFreezeTemperature", 1), ("ejection_temp_C", "Value_Material_PartEjectionTemperature", 1),
        ("recommended_melt_temp_range_C", "Value_Material_PartMeltTemperatureRange", 0), ("recommended_mold_temp_range_C", "Value_Material_PartMoldTemperatureRange", 0),
    ],
    "process_settings": [
        ("melt_temperature_C", "Value_Process_MeltTemperature", 1), ("mold_temperature_C", "Value_Process_MoldTemperature", 1), ("filling_time_s", "Value_Process_FillingTime", 1), ("packing_time_s", "Value_Process_PackingTime", 1), ("cooling_time_s", "Value_Process_CoolingTime", 1),
        ("mold_open_time_s", "Value_Process_MoldOpeningTime", 1), ("cycle_time_s", "Value_Process_CycleTime", 1), ("vp_switch_percent", "Value_Process_VPSwitchOver", 1), ("machine_max_injection_pressure_MPa", "Value_Process_MaxInjectionPressure", 1), ("machine_max_packing_pressure_MPa", "Value_Process_MaxPackingPressure", 1),
        ("air_temperature_C", "Value_Process_AirTemperature", 1), ("packing_pressure_profile_percent", "Value_Process_PressureOfPackPressure", 0), ("packing_time_profile_s", "Value_Process_TimeOfPackPressure", 0),
    ],
    "summary": [("gate_freeze_time_s", "Value_GateFreezeTime", 1), ("part_weight_g", "Value_Result_TotalPartWeight", 1), ("runner_weight_g", "Value_Result_TotalRunnerWeight", 1)],
}
_NUMBER = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_WORD = r"(?i)^[+-]?(nan|inf|infinity)$"


def parse_value(raw: Column) -> Column:
    """Number of a text (spaces around it and single underscores between digits are fine), null for anything else."""
    t = F.regexp_replace(raw.cast("string"), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    bare = F.regexp_replace(F.lower(t), "^[+]", "")
    return F.when(t.rlike(_NUMBER), F.regexp_replace(t, "_", "").try_cast("double")).when(t.rlike(_WORD), F.regexp_replace(bare, "^(-?)inf(inity)?$", "$1Infinity").try_cast("double")).when(raw.cast("string") == "true", F.lit(1.0)).when(raw.cast("string") == "false", F.lit(0.0))


def run_header(reports: DataFrame, key_col: str = "path") -> DataFrame:
    """run_key and one struct for each section; numbers as doubles beside their raw text (``<field>_raw``), missing keys null."""
    cbase = F.from_json("raw", "struct<CBASE:map<string,string>>")["CBASE"]
    base = reports.select(F.col(key_col).alias("run_key"), cbase.alias("c"))
    # One lambda parses all values: a copy of the rule for each field would outgrow compiled code.
    base = base.select("run_key", "c", F.transform_values("c", lambda k, v: parse_value(v)).alias("numbers"))
    structs = []
    for section, fields in HEADER.items():
        cells = []
        for field, key, number in fields:
            value = F.try_element_at("c", F.lit(key))
            cells += [F.try_element_at("numbers", F.lit(key)).alias(field), F.when(value != "", value).alias(f"{field}_raw")] if number else [value.alias(field)]
        structs.append(F.struct(*cells).alias(section))
    return base.select("run_key", *structs)


_CELLS = ("ord", "stage", "field", "max_raw", "min_raw", "avg_raw", "unit")


def _first_truthy(*values):
    for v in values[:-1]:
        if v:
            return v
    return values[-1]


def _parsed(raw: str | None):
    """The document, None for one that is no JSON or nested deeper than a reader follows."""
    try:
        return None if raw is None else (json.loads(raw),)
    except (ValueError, RecursionError):
        return None


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _stat_nodes(raw: str | None) -> list[tuple]:
    """Cells of a document's statistic nodes in the order a reader meets them."""
    stack, out = list(_parsed(raw) or ()), []
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            tag = node.get("Tag")
            stage = next((s for s in STAGES if isinstance(tag, str) and tag.startswith(s.capitalize() + "_")), None)
            if stage:
                most = _first_truthy(node.get("Statistics_Max"), node.get("History_Y_YMax"), node.get("Y_SpecificTime"))
                least = _first_truthy(node.get("Statistics_Min"), node.get("History_Y_YMin"))
                out.append((len(out), stage, tag[len(stage) + 1 :], _text(most), _text(least), _text(node.get("Statistics_Avg")), str(node.get("Unit") or "").strip()))
            stack += reversed(list(node.values()))
        elif isinstance(node, list):
            stack += reversed(node)
    return out


def _flatten(reports: DataFrame, key_col: str) -> DataFrame:
    """run_key and the cells of every statistic node, a row each."""
    kinds = [pa.int32(), *[pa.string()] * (len(_CELLS) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_stat_nodes(raw) for raw in batch.column(1).to_pylist()]
            at = pa.array([i for i, nodes in enumerate(found) for _ in nodes], pa.int64())
            cells = list(zip(*[node for nodes in found for node in nodes], strict=True)) or [()] * len(_CELLS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=["run_key", *_CELLS])

    key = reports.schema[key_col].dataType.simpleString()
    return reports.select(F.col(key_col).alias("run_key"), "raw").mapInArrow(run, f"run_key {key}, ord int, " + ", ".join(f"{c} string" for c in _CELLS[1:]))


@F.pandas_udf(T.BooleanType())
def _readable(raw: pd.Series) -> pd.Series:
    return raw.map(lambda text: _parsed(text) is not None).astype(bool)


def stage_stats(reports: DataFrame, key_col: str = "path") -> DataFrame:
    """run_key, stage, field, max, min, avg, max_raw, min_raw, avg_raw, unit: the last node of a tag in the document counts."""
    cells = F.struct("ord", "max_raw", "min_raw", "avg_raw", "unit")
    last = _flatten(reports, key_col).groupBy("run_key", "stage", "field").agg(F.max(cells).alias("l"))
    raw = lambda c: F.when(F.col(f"l.{c}_raw") != "", F.col(f"l.{c}_raw"))
    return last.select("run_key", "stage", "field", *[parse_value(raw(c)).alias(c) for c in ("max", "min", "avg")], *[raw(c).alias(f"{c}_raw") for c in ("max", "min", "avg")], "l.unit")


def bad_reports(reports: DataFrame, key_col: str = "path") -> DataFrame:
    """run_key of the reports that are no readable JSON."""
    return reports.filter(~_readable("raw")).select(F.col(key_col).alias("run_key"))


def _stat(stage: str, field: str) -> Column:
    return F.max(F.when((F.col("stage") == stage) & (F.col("field") == field), F.col("max")))


def run_summary(header: DataFrame, stats: DataFrame) -> DataFrame:
    """run_key, process_settings and the summary fields; the same shuffle by run serves all statistics."""
    picked = stats.groupBy("run_key").agg(
        _stat("filling", "MeltFrontTime").alias("actual_filling_time_s"),
        _stat("filling", "XY_ClampingForce").alias("max_clamping_force_ton"),
        _stat("filling", "XY_SpruePressure").alias("max_sprue_pressure_MPa"),
        _stat("warpage", "TotalDisplacement").alias("warpage_mm"),
        _stat("warpage", "ThermallyInducedResidualVonMisesStress").alias("residual_stress"),
        _stat("cooling", "MoldTemperatureDifference").alias("mold_temp_diff"),
        _stat("packing", "GateFreezeTime").alias("packing_gate_freeze"),
    )
    s = header.select("run_key", F.col("summary.gate_freeze_time_s").alias("gate_freeze_time_s"), F.col("summary.part_weight_g").alias("part_weight_g"), F.col("summary.runner_weight_g").alias("runner_weight_g"), F.col("process_settings.packing_time_s").alias("packing_time_s"), F.col("process_settings.mold_temperature_C").alias("mold_temperature_C"))
    # The filled volume is a constant of the report format.
    return s.join(picked, "run_key", "left").withColumn("volume_filled_percent", F.lit(100.0))


def stats_pivot(stats: DataFrame) -> DataFrame:
    """run_key and one map (field -> struct) for each stage."""
    cell = F.struct("field", F.struct("max", "min", "avg", "unit").alias("v"))
    return stats.groupBy("run_key").pivot("stage", list(STAGES)).agg(F.map_from_entries(F.collect_list(cell)))


def round_one(x: Column) -> Column:
    """Half to even on the exact binary value, one decimal.

    Twenty times the number, in two exact parts, against the odd number in the middle
    tells on which side of the half it lies; from 1e15 on a double has no decimals.
    """
    size = F.abs(x)
    low = F.floor(size * 10.0).cast("double")
    coarse = size.cast("float").cast("double")
    side = (coarse * 20.0 - (low * 2.0 + 1.0)) + (size - coarse) * 20.0
    up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))
    return F.when(size < 1e15, F.signum(x) * F.when(up, low + 1.0).otherwise(low) / 10.0).otherwise(x)


def number_text(x: Column) -> Column:
    """Whole numbers without a decimal point; others in their shortest form."""
    return F.when(x.isNull(), "None").when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def float_text(x: Column) -> Column:
    return x.cast("string")


def diagnose(runs: DataFrame, target: float = 0.30) -> DataFrame:
    """run_key, is_converged, current_warpage_mm, active_causal_paths, hard_constraints, llm_prompt_context.

    runs: rows of run_summary. Runs without warpage or packing time are left out;
    undiagnosed() lists them. Zero counts as missing for freeze time, temperature
    difference and stress.
    """
    usable = runs.filter(F.col("warpage_mm").isNotNull() & F.col("packing_time_s").isNotNull())
    freeze = F.coalesce(F.nullif("gate_freeze_time_s", F.lit(0.0)), F.nullif("packing_gate_freeze", F.lit(0.0)))
    d = usable.withColumn("f", freeze).withColumn("dt", F.coalesce("mold_temp_diff", F.lit(0.0))).withColumn("rs", F.coalesce("residual_stress", F.lit(0.0)))
    blocked = F.col("f").isNotNull() & (F.col("packing_time_s") < F.col("f"))
    hot = (F.col("dt") > 20.0) & (F.col("rs") > 10.0)
    d = d.withColumn("least", F.when(blocked, round_one(F.col("f") * 1.05))).withColumn("most", F.when(~blocked, round_one(F.col("f") * 1.2)))
    n = number_text
    # The wording of the findings.
    gate = F.when(blocked, F.concat(F.lit("【因果阻断】保压时间("), n(F.col("packing_time_s")), F.lit("s) < 浇口冻结时间("), n(F.col("f")), F.lit("s)。浇口未封闭即撤压，引发熔体倒流，导致型腔严重失压与体积收缩不均！"))).otherwise("【保压有效】保压时间已覆盖浇口冻结，补缩通道正常。")
    heat = F.when(hot, F.concat(F.lit("【热应力主导】动定模温差达 "), n(F.col("dt")), F.lit("℃，诱发了高达 "), n(F.col("rs")), F.lit(" MPa 的热残余应力，为翘曲的第一致因！优先消除温差而非盲目加大压力。"))).otherwise("【比容收缩主导】模温场基本平衡，翘曲主要受体积收缩各向异性控制。")
    action = F.when(hot, "INCREASE").otherwise("MAINTAIN")
    interval = F.when(hot, F.lit("[70.0, 75.0]")).otherwise(F.concat(F.lit("["), n(F.col("mold_temperature_C")), F.lit("]")))
    ok = F.col("warpage_mm") <= target
    context = F.concat(
        F.lit("\n=== CAUSAL DIAGNOSIS & ACTION BOUNDS ===\n- 状态判定: "), F.when(ok, "【已收敛 / PASS】").otherwise("【未达标 / NEED OPTIMIZATION】"),
        F.lit("\n- 当前实际翘曲量: "), n(F.col("warpage_mm")), F.lit(f" mm (设计目标: <= {target} mm)\n- 物理瓶颈因果链:\n  * "), gate, F.lit(" "), heat,
        F.lit("\n\n[PHYSICAL HARD CONSTRAINTS] (大模型严禁违背的可行域边界):\n1. 保压时间 (Packing Time): 必须设定为 >= "), F.coalesce(float_text(F.col("least")), n(F.col("packing_time_s"))),
        F.lit(" 秒\n2. 模具温度 (Mold Temperature): 策略为 "), action, F.lit(" (建议设定区间: "), interval, F.lit(" ℃)\n========================================\n"),
    )
    constraints = F.struct(F.col("least").alias("packing_time_s_min"), F.col("most").alias("packing_time_s_max"), action.alias("mold_temperature_action"), F.when(hot, F.array(F.lit(70.0), F.lit(75.0))).alias("target_mold_temp_range_C"))
    return d.select("run_key", ok.alias("is_converged"), F.col("warpage_mm").alias("current_warpage_mm"), F.array(gate, heat).alias("active_causal_paths"), constraints.alias("hard_constraints"), context.alias("llm_prompt_context"))


def undiagnosed(runs: DataFrame) -> DataFrame:
    """run_key and reason of the runs that cannot be diagnosed."""
    reason = F.when(F.col("warpage_mm").isNull(), "no warpage").when(F.col("packing_time_s").isNull(), "no packing time")
    return runs.select("run_key", reason.alias("reason")).filter("reason is not null")
