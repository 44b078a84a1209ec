"""Reshaping between flat vectors, long tables and padded path tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite, power
from ..functions.text import natural_key
from .ordering import bounded_join, positions, text_positions

D = "dataset_id"


def unflatten(flat: DataFrame, keys: list[str], values: str, shape: list[int], names: list[str]) -> DataFrame:
    """Column-major flat values to index columns; a wrong length raises."""
    size = 1
    for n in shape:
        size *= n
    checked = F.when(F.size(values) == size, F.col(values)).otherwise(
        F.raise_error(F.lit(f"flat vector does not hold {size} values")))
    cells = flat.select(*keys, F.posexplode(checked).alias("_at", "value"))
    stride = 1
    for name, n in zip(names, shape):
        cells = cells.withColumn(name, F.pmod(F.floor(F.col("_at") / stride), F.lit(n)).cast("int"))
        stride *= n
    return cells.drop("_at")


def flatten(long_rows: DataFrame, keys: list[str], names: list[str], shape: list[int], value: str) -> DataFrame:
    """Long rows to one column-major vector per key. The tensor of a key is bounded by its shape."""
    at: Column = F.lit(0)
    stride = 1
    for name, n in zip(names, shape):
        at = at + F.col(name) * stride
        stride *= n
    cell = F.struct(at.alias("at"), F.col(value).alias("v"))
    packed = long_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return packed.select(*keys, F.col("c.v").alias("values"), F.array(*[F.lit(n) for n in shape]).alias("shape"))


def assemble_complex(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Zip re and im vectors; a length mismatch gives one error row."""
    same = F.size("re") == F.size("im")
    cells = F.when(same, F.arrays_zip("re", "im"))
    rows = parts.select(*keys, same.alias("_same"), F.posexplode_outer(cells).alias("k", "v"))
    return rows.select(*keys, "k", F.col("v.re").alias("re"), F.col("v.im").alias("im"),
                       F.when(F.col("_same"), "ok").otherwise("shape_mismatch").alias("status"))


def expand_field(rows: DataFrame, field: DataFrame, axes: list[str]) -> DataFrame:
    """Join a field on its non-singleton axes only."""
    return bounded_join(rows, field, axes, "left")


def pack_folder(files: DataFrame, name: str, values: str, bandwidth_hz: float | None = None,
                step_s: float | None = None) -> DataFrame:
    """One file per sample in natural name order, taps to delays; sizes must agree.

    Gives sample, tap, delay_s, value and `sizes`, the number of different
    vector sizes; anything but 1 is an error.
    """
    if bandwidth_hz is None and step_s is None:
        raise ValueError("the tap delay needs a bandwidth or a step")
    step = step_s if step_s is not None else 1.0 / bandwidth_hz
    # Only the names are sorted; the vectors join their position afterwards.
    names = files.select(D, name, natural_key(name).alias("_key"))
    ranks = text_positions(names, [D], "_key", [name], "sample").drop("_key")
    sizes = files.groupBy(D).agg(F.countDistinct(F.size(values)).alias("sizes"))
    ranked = bounded_join(bounded_join(files, ranks, [D, name]), sizes, [D])
    cells = ranked.select(D, "sample", name, "sizes", F.posexplode(values).alias("tap", "value"))
    return cells.withColumn("delay_s", F.col("tap") * F.lit(step))


def remap_legacy(rows: DataFrame, sequence_axis: str, interval_s: float | None = None) -> DataFrame:
    """The fourth legacy axis `seq` becomes sample or time."""
    if sequence_axis == "sample":
        return rows.withColumn("sample", F.col("seq") + 1).withColumn("t", F.lit(0).cast("long")).withColumn(
            "time_s", F.lit(None).cast("double")).drop("seq")
    if sequence_axis != "time":
        raise ValueError("the sequence axis is sample or time")
    if interval_s is None or interval_s <= 0:
        raise ValueError("time conversion needs a positive interval")
    return rows.withColumn("sample", F.lit(1).cast("long")).withColumn("t", F.col("seq")).withColumn(
        "time_s", F.col("seq") * F.lit(interval_s)).drop("seq")


def reorder_axes(rows: DataFrame) -> DataFrame:
    """[Rx, Tx, path, snapshot] to the canonical order; invalid without finite delay and amplitude."""
    ok = is_finite("delay_s") & is_finite("re") & is_finite("im") & (power() > 0)
    return rows.withColumnsRenamed({"tx": "_rx", "rx": "_tx"}).withColumnsRenamed(
        {"_rx": "rx", "_tx": "tx"}).withColumn("path_valid", ok)


def pad_paths(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Every key gets the same number of paths; added paths are zero and invalid.

    Paths of a key are renumbered 1..n in path order. The paths of one key are
    one instrument reading, so they are bounded.
    """
    cell = F.struct("path", *fields, "path_valid")
    packed = rows.groupBy(D, *keys).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    top = packed.groupBy(D).agg(F.max(F.size("c")).alias("n"))
    grid = bounded_join(packed, top, [D]).withColumn("path", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = F.get("c", F.col("path") - 1)
    return grid.select(
        D, *keys, "path", *[F.coalesce(at[f], F.lit(0.0)).alias(f) for f in fields],
        F.coalesce(at["path_valid"], F.lit(False)).alias("path_valid"))


def combine_targets(parts: list[DataFrame], requested: list[str], optional: list[str], keys: list[str]) -> DataFrame:
    """Per-target path tables in requested order; optional fields only if all parts have them."""
    if len(parts) != len(requested) or not parts:
        raise ValueError("all requested targets must be present before combination")
    shared = [f for f in optional if all(f in p.columns for p in parts)]
    fields = ["re", "im", "delay_s", *shared]
    tagged = [p.select(D, *keys, "path", *fields, "path_valid").withColumn("target", F.lit(i + 1)).withColumn(
        "target_name", F.lit(name)) for i, (p, name) in enumerate(zip(parts, requested))]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return pad_paths(union, ["target", "target_name", *keys], fields)


def canonical_axes(rows: DataFrame, axes: list[str], value_columns: list[str]) -> DataFrame:
    """Antenna x delay x snapshot table from at most three non-singleton axes per dataset, densely indexed.

    Each dataset has the layout that its own axis sizes give: one axis is the
    delay, two are antenna and delay. The roles are a column made from those
    sizes, so datasets of different layouts share one plan.
    """
    sizes = rows.groupBy(D).agg(*[F.countDistinct(a).alias(f"_n_{a}") for a in axes]).persist()
    many = sum(((F.col(f"_n_{a}") > 1).cast("int") for a in axes), F.lit(0))
    worst = sizes.select(D, many.alias("k")).filter("k > 3").orderBy(D).first()
    if worst is not None:
        raise ValueError(f"dataset {worst[D]} has {worst['k']} non-singleton axes; at most 3 are possible")
    longest = sizes.agg(*[F.max(f"_n_{a}").alias(a) for a in axes]).first().asDict()
    placed = bounded_join(rows, sizes, [D])
    for a in axes:
        if (longest[a] or 0) > 1:  # elsewhere the index is one in every dataset
            index = positions(rows.select(D, a).distinct(), [D], [a], a, f"_i_{a}")
            placed = bounded_join(placed, index, [D, a])
        else:
            placed = placed.withColumn(f"_i_{a}", F.lit(1).cast("long"))
    roles = F.array_compact(F.array(*[F.when(F.col(f"_n_{a}") > 1, F.col(f"_i_{a}")) for a in axes]))
    k = F.size("_roles")
    at = lambda i: F.coalesce(F.get("_roles", F.lit(i)), F.lit(1).cast("long"))
    return placed.withColumn("_roles", roles).select(
        D, F.when(k >= 2, at(0)).otherwise(F.lit(1).cast("long")).alias("antenna"),
        F.when(k >= 2, at(1)).otherwise(at(0)).alias("delay"), at(2).alias("snapshot"), *value_columns)


# Recommended fields and texts of the record conversion.
RECORD_FIELDS = ["alpha", "doa", "delay", "cir_e", "likelihood"]
NO_CHANNEL = "No usable CIR, estimated CIR, or path amplitude is present."
MISSING_FIELDS = "Missing recommended SAGE fields: "


def flatten_records(records: DataFrame, keys: list[str], record: str) -> DataFrame:
    """Status and missing-field text of nested measurement records."""
    lost = F.array_compact(F.array(*[F.when(F.col(f"{record}.{f}").isNull(), f) for f in RECORD_FIELDS]))
    usable = F.coalesce(*[F.col(f"{record}.{f}").cast("string") for f in ("cir", "cir_e", "alpha")]).isNotNull()
    return records.select(
        *keys, F.col(f"{record}.alpha").alias("alpha"), F.col(f"{record}.delay").alias("delay"),
        F.col(f"{record}.likelihood").alias("likelihood"),
        F.when(~usable, "FAIL").when(F.size(lost) > 0, "WARNING").otherwise("PASS").alias("validation_status"),
        F.when(~usable, NO_CHANNEL)
        .when(F.size(lost) > 0, F.concat(F.lit(MISSING_FIELDS), F.array_join(lost, ", ")))
        .otherwise("").alias("warning"))


def with_record_ids(records: DataFrame, file_no: str, record_no: str) -> DataFrame:
    """Adds record_id from the 1-based file and record numbers, and the warning under that id."""
    ided = records.withColumn("record_id", F.format_string("sage_%04d_%04d", F.col(file_no).cast("long"), F.col(record_no).cast("long")))
    return ided.withColumn("record_warning", F.when(F.col("warning") != "", F.concat_ws(": ", "record_id", "warning")).otherwise(""))


def conversion_status(files: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: records, warnings and the worst status of its records; a file without records fails."""
    worst = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("warning") != "").alias("warnings"),
        F.bool_or(F.col("validation_status") == "FAIL").alias("_f"), F.bool_or(F.col("validation_status") == "WARNING").alias("_w"))
    zero = F.lit(0).cast("long")
    return files.select(*keys).distinct().join(worst, keys, "left").select(
        *keys, F.coalesce("records", zero).alias("records"), F.coalesce("warnings", zero).alias("warnings"),
        F.when(F.col("records").isNull() | F.col("_f"), "FAIL").when(F.col("_w"), "WARNING").otherwise("PASS").alias("status"))


def prediction_request(ex: DataFrame, params: list[str], task: str, layout: tuple[int, int, int]) -> DataFrame:
    """Target-free request rows: inputs in units, input index rebuilt from the target start."""
    left, right, target = layout
    offsets = list(range(-left, 0)) + list(range(target, target + right))
    start = F.col("targets")[0]["idx"]
    index = F.array(*[start + o for o in offsets])
    return ex.select(
        D, "group_id", F.lit(task).alias("task_type"), index.alias("input_index"),
        F.transform("inputs", lambda c: F.struct(*[c[p].alias(p) for p in params])).alias("input_parameters"),
        F.col("targets.idx").alias("target_index"), F.lit(False).alias("contains_target_ground_truth"))


def select_example(batch: DataFrame, example: Column, axis_values: DataFrame | None = None) -> DataFrame:
    """Target rows of the chosen examples with their axis values (the index itself without an axis)."""
    rows = batch.filter(example)
    if axis_values is None:
        return rows.withColumn("axis_value", F.col("idx").cast("double"))
    return rows.join(axis_values, [D, "group_id", "idx"], "left")
