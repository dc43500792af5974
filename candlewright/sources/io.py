"""Readers and writers: bars, scale logs, records, datasets, split-named files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_BARS = "Open double, High double, Low double, Close double"
ROW_KINDS = {frozenset({"prompt", "completion"}): "text", frozenset({"prompt", "future_bins", "symbol", "window_id"}): "prompts"}
RECORDS = (
    "task_id string, trend string, action_type string, intended_action_type string, well_formed boolean, semantic_passed boolean, task_passed boolean, "
    "sl_valid boolean, rr int, outcome_status string, r_multiple double, reward double"
)


def file_stem(path=None):
    return F.regexp_extract(path if path is not None else F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def bars_from_csv(spark: SparkSession, path: str, order: str | None = None, schema: str = RAW_BARS, atr: str | None = None) -> DataFrame:
    """Bars of one file for each symbol, named by the file. ``order`` is the column that orders them; without one the line's place in its file does.

    atr: the column of a preprocessed file that holds the average true range; then rows have atr and row_idx, ready for windows.
    """
    raw = spark.read.csv(path, header=True, schema=schema if atr is None or atr in schema else f"{schema}, {atr} double")
    key = F.col(order) if order else F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    more = [] if atr is None else [F.col(atr).alias("atr")]
    out = raw.select(file_stem(F.col("_metadata.file_path")).alias("symbol"), key.alias("ts"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close")], *more)
    return out if atr is None else out.withColumn("row_idx", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("int"))


def bars_to_csv(rows: DataFrame, path: str, atr: str = "ATR_100") -> None:
    """Preprocessed bars as CSV with a header, a folder for each symbol, in order of row_idx."""
    named = [F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close")]
    rows.repartition("symbol").sortWithinPartitions("symbol", "row_idx").select("symbol", *named, F.col("atr").alias(atr)).write.mode("overwrite").partitionBy("symbol").csv(path, header=True)


def preprocess_files(spark: SparkSession, path: str, out: str, scale_log: str, version: int, period: int = 100, order: str | None = None) -> None:
    """Raw files to preprocessed files and a line of the scale log for each symbol; the period is that of the range and of the trailing window."""
    from candlewright.operators import bars

    rows = bars.preprocess(bars_from_csv(spark, path, order), period)
    bars_to_csv(rows, out, f"ATR_{period}")
    append_scales(bars.scales(rows, period), scale_log, version)


def encode_files(rows: DataFrame, scale, out: str, size: int, stride: int = 50) -> None:
    """Windows of preprocessed rows (bars_from_csv with atr) as text, a CSV line a window, in a folder for each symbol. scale: one, or a table symbol, scale."""
    from candlewright.operators.windows import encoded_windows, plain_text

    w = encoded_windows(rows, F.lit(float(scale)) if isinstance(scale, (int, float)) else scale, size, stride)
    w.select("symbol", "start_idx", plain_text(F.col("candles")).alias("text")).write.mode("overwrite").partitionBy("symbol").csv(out, header=True)


def bars_from_events(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of each event type: first, greatest, least and last value in each hour. (An extension: the library starts from bars.)"""
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close")
    )


def scales_from_text(log: DataFrame, line: str = "line", place: str = "place") -> DataFrame:
    """symbol, scale of an append-only log of ``name: number`` lines: the last line of a name holds; lines without a colon are passed over."""
    parts = F.split(F.col(line), ":", 2)
    kept = log.where(F.contains(F.col(line), F.lit(":"))).select(F.trim(parts[0]).alias("symbol"), F.trim(parts[1]).cast("double").alias("scale"), place)
    return kept.groupBy("symbol").agg(F.max_by("scale", place).alias("scale"))


def scale_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a scale file, in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("place", "line"))


def append_scales(scales: DataFrame, path: str, version: int) -> None:
    """Scales with both the exact value and the two digits that a log shows; appended, never rewritten."""
    scales.select("symbol", "scale", F.format_string("%.2f", "scale").alias("shown"), F.lit(version).alias("version")).write.mode("append").parquet(path)


def records_from_json(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of all files that the paths and globs name; a file is a list or an object with ``records``. Columns that a file lacks are null.

    A path that names nothing is passed over. A file that can't be read raises an error with its name: no record is lost in silence.
    """
    there = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
        for empty in (f for f in found if f.isFile() and not f.getLen()):  # Spark reads no row of an empty file
            raise ValueError(f"records can't be read: {empty.getPath()}")
        if len(found):
            there.append(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")))
    if not there:
        return spark.createDataFrame([], RECORDS)
    text = there[0]
    for more in there[1:]:
        text = text.unionByName(more)
    kind = f"array<struct<{_struct()}>>"
    whole = F.when(F.ltrim(F.col("value")).startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<records:{kind}>")["records"])
    # an object without records is an empty log; anything else that gives no list is broken
    empty = F.ltrim(F.col("value")).startswith("{") & F.json_object_keys("value").isNotNull() & F.get_json_object("value", "$.records").isNull()
    listed = F.when(empty, F.from_json(F.lit("[]"), kind)).otherwise(F.coalesce(whole, F.raise_error(F.concat(F.lit("records can't be read: "), F.col("file"))).cast(kind)))
    return text.select(F.inline(listed))


def _struct() -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in RECORDS.split(","))


def row_kind(spark: SparkSession, path: str) -> str:
    """Kind of a dataset by its top-level columns alone; no row is read."""
    names = frozenset(spark.read.parquet(path).columns)
    if names not in ROW_KINDS:
        raise ValueError(f"unknown columns: {sorted(names)}")
    return ROW_KINDS[names]


def write_split(rows: DataFrame, path: str, by: tuple[str, ...] = ("split", "symbol")) -> None:
    rows.write.mode("errorifexists").partitionBy(*by).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def split_name(name: str, split: str) -> str:
    """The name that a file is published under: the split before it, unless its word is anywhere in the name."""
    return name if split in name else f"{split}_{name}"


def publish_verified(rows: DataFrame, violations: DataFrame, path: str, dry_run: bool = False) -> int:
    """Writes rows only if no rule is broken and it is no dry run; returns the number of broken rules."""
    bad = violations.count()
    if not bad and not dry_run:
        rows.write.mode("errorifexists").parquet(path)
    return bad


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def publish_split(rows: DataFrame, folder: str, name: str, split: str, dry_run: bool = False) -> str:
    """Writes rows under the name of their split, with a warning where one of that name is replaced; returns the name. A dry run writes nothing."""
    named = split_name(name, split)
    if exists(rows.sparkSession, f"{folder}/{named}"):
        warnings.warn(f"{named} is there already and {'would be' if dry_run else 'is'} replaced", stacklevel=2)
    if not dry_run:
        rows.write.mode("overwrite").parquet(f"{folder}/{named}")
    return named


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of the folders that is there (a local checkpoint, then one kept elsewhere), or None."""
    return next((p for p in paths if p and exists(spark, p)), None)


def append_records(records: DataFrame, path: str, round_id: str) -> None:
    """Adds scored records to the log, by round and step. Nothing is cleared: a period is a range of steps."""
    records.withColumn("round_id", F.lit(round_id)).write.mode("append").partitionBy("round_id", "step").parquet(path)


def logged_records(spark: SparkSession, path: str, round_id: str, after: int | None = None) -> DataFrame:
    """Records of a round, or those of the steps after ``after``; other rounds and steps are not read."""
    rows = spark.read.parquet(path).where(F.col("round_id") == round_id)
    return rows if after is None else rows.where(F.col("step") > after)


def export_records(records: DataFrame, path: str) -> None:
    """Records as JSON, an object a line."""
    records.write.mode("overwrite").json(path)


def write_eval(records: DataFrame, rates: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation rows, one row of rates and the summary by trend and action, as JSON in three folders."""
    for part, rows in (("records", records), ("rates", rates), ("summary", summary)):
        rows.write.mode("overwrite").json(f"{path}/{part}")


def write_state(state: DataFrame, path: str) -> None:
    """A controller's state (namespace, grp, ema, buff, prev_error), a line a group."""
    state.coalesce(1).write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state at a path; None where there is none or it can't be read. An error before, where it is missing, counts as 0."""
    from pyspark.errors import PySparkException

    from candlewright.operators.control import STATE

    if not exists(spark, path):
        return None
    try:
        rows = spark.read.schema(f"{STATE}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    except PySparkException:
        return None
    whole = rows.select("namespace", "grp", "ema", "buff", F.coalesce("prev_error", F.lit(0.0)).alias("prev_error"))
    needed = F.col("grp").isNull() | F.col("ema").isNull() | F.col("buff").isNull()
    found = rows.select("broken", needed.alias("lacks")).agg(F.count("*"), F.count_if(F.col("lacks") | F.col("broken").isNotNull())).first()
    return whole if found[0] and not found[1] else None


def restored_or_seeded(spark: SparkSession, path: str | None, settings: DataFrame) -> DataFrame:
    """The state to go on from: what a resumed round left at ``path``; for a new round (no path), or with a warning where nothing can be read, the settings' start."""
    from candlewright.operators.control import seeded

    state = read_state(spark, path) if path else None
    if path and state is None:
        warnings.warn(f"no state can be read at {path}: the controller starts anew", stacklevel=2)
    return seeded(settings) if state is None else state
