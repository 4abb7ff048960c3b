"""Drawing tables derived from the order-processing tables, with integer arithmetic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators.numbering import with_position

# All that drawings are made of, in order; rows that are equal in these draw the same line, whichever comes first.
_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``lineitem`` with ``plan_id`` (eight orders each) and the position ``seq`` in the plan."""
    lines = table(spark, folder, "lineitem").select(*_LINE_ORDER).withColumn(
        "plan_id", F.expr("l_orderkey div 8").cast("bigint")
    )
    return with_position(lines, "plan_id", [F.col(c) for c in _LINE_ORDER], "seq")


def _drawn(lines: DataFrame) -> DataFrame:
    """Segment columns from the key columns of ``lineitem``."""
    x0 = 12 * ((F.col("l_suppkey") * 7) % 100)
    y0 = 12 * ((F.col("l_partkey") * 13) % 83)
    size = 96 * (F.col("l_quantity").cast("bigint") % 6 + 1)
    turn = (F.col("l_partkey") + F.col("l_suppkey")) % 4
    unit = F.when(F.col("plan_id") % 11 == 0, 1000).when(F.col("plan_id") % 7 == 0, 100).otherwise(1)
    zero = F.lit(0).cast("bigint")

    def metres(centimetres):
        return (centimetres * unit) / F.lit(100.0)

    part = F.col("l_partkey") % 20
    layer = (
        F.when((part < 14) & (F.col("plan_id") % 50 == 0), "DIMENSIONS")
        .when(part < 14, "A-WALL")
        .when(part < 17, "DOOR")
        .when(part < 19, "Fenster")
        .otherwise("FURNITURE")
    )
    return lines.select(
        "plan_id",
        *(["seq"] if "seq" in lines.columns else []),
        layer.alias("layer"),
        F.lit("LINE").alias("source_type"),
        metres(x0 + F.when(turn == 2, size).otherwise(zero)).alias("x1"),
        metres(y0).alias("y1"),
        metres(x0 + F.when(turn.isin(0, 3), size).otherwise(zero)).alias("x2"),
        metres(y0 + F.when(turn.isin(1, 3), size).otherwise(zero)).alias("y2"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return _drawn(numbered_lineitem(spark, folder))


def pixel_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = numbered_lineitem(spark, folder)
    x1 = (F.col("l_partkey") * 7) % 1200
    y1 = (F.col("l_suppkey") * 11) % 900
    return lines.select(
        "plan_id",
        F.lit(1400).alias("img_w"),
        F.lit(1000).alias("img_h"),
        F.col("seq").alias("line_no"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        (x1 + F.col("l_quantity").cast("int") * 3).cast("int").alias("x2"),
        (y1 + F.when(F.col("l_linenumber") % 2 == 1, 60).otherwise(0)).cast("int").alias("y2"),
    )


def polyline_points(spark: SparkSession, folder: str) -> DataFrame:
    """One polyline per order; ``pos`` is the order of its points."""
    lines = numbered_lineitem(spark, folder)
    return lines.select(
        F.col("l_orderkey").alias("plan_id"),
        F.lit(0).alias("rec"),
        F.col("seq").alias("pos"),
        (12 * ((F.col("l_suppkey") * 7) % 100) / F.lit(100.0)).alias("x"),
        (12 * ((F.col("l_partkey") * 13) % 83) / F.lit(100.0)).alias("y"),
        (F.col("l_orderkey") % 2 == 0).alias("closed"),
    )


def arcs(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("plan_id"),
        F.lit(0).alias("rec"),
        F.lit("DOOR").alias("layer"),
        F.col("p_size").cast("double").alias("cx"),
        (F.col("p_partkey") % 50).cast("double").alias("cy"),
        (F.col("p_size") / F.lit(10.0)).alias("radius"),
        ((F.col("p_partkey") * 37) % 360).cast("double").alias("start_deg"),
        ((F.col("p_partkey") * 53) % 360).cast("double").alias("end_deg"),
    )


def rooms(spark: SparkSession, folder: str) -> DataFrame:
    """Room lists: one plan per customer, rooms in order-key order."""
    kinds = ("living", "bedroom", "kitchen", "bathroom", "hallway", "dining", "office", "storage")
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("order_key")
    )
    numbered = with_position(orders, "plan_id", [F.col("order_key")], "room_no")
    return numbered.select(
        "plan_id",
        "room_no",
        F.element_at(
            F.array(*(F.lit(k) for k in kinds)), (F.col("order_key") % 8 + 1).cast("int")
        ).alias("room_type"),
        ((F.col("order_key") % 30 + 15) / F.lit(10.0)).alias("w"),
        ((F.col("order_key") % 25 + 20) / F.lit(10.0)).alias("h"),
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    suffixes = (".dxf", ".PNG", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".pdf", ".txt", ".svg")
    suffix = F.element_at(
        F.array(*(F.lit(s) for s in suffixes)), (F.col("doc_id") % 10 + 1).cast("int")
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("job"),
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("filename"),
        (F.col("n_chars") * 2000).alias("size_bytes"),
    )


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "signup", "uploaded")
        .when(F.col("event_type").isin("click", "view"), "processing")
        .when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "error", "error")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job"), "ts", "event_id", status.alias("status")
    )


def request_ids(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events").select((F.col("user_id") * 2).alias("job")).distinct()
    )


def mixed_drawings(spark: SparkSession, folder: str) -> DataFrame:
    """Drawing texts of ten parts each: lines, closed polylines, arcs, texts and lines in paper space."""
    x, y = F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string")
    far = (F.col("p_size") + 4).cast("string")

    def record(kind: str, *pairs) -> Column:
        values = [F.lit(f"  0\n{kind}\n  8\nWALL\n")]
        for code, value in pairs:
            values += [F.lit(f"{code:3d}\n"), value if isinstance(value, Column) else F.lit(str(value)), F.lit("\n")]
        return F.concat(*values)

    ends = ((10, x), (20, y), (11, far), (21, y))
    entity = (
        F.when(F.col("p_partkey") % 5 == 0, record("LINE", *ends))
        .when(F.col("p_partkey") % 5 == 1, record("LWPOLYLINE", (70, 1), (10, x), (20, y), (10, far), (20, y), (10, far), (20, "99")))
        .when(F.col("p_partkey") % 5 == 2, record("ARC", (10, x), (20, y), (40, "2.5"), (50, 0), (51, 90)))
        .when(F.col("p_partkey") % 5 == 3, record("TEXT", (1, "ENTITIES"), (10, x), (20, y)))
        .otherwise(record("LINE", (67, 1), *ends))
    )
    rows = table(spark, folder, "part").select(
        F.expr("p_partkey div 10").alias("plan_id"), F.struct("p_partkey", entity.alias("text")).alias("item")
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda r: r["text"]), "")
    head = F.concat(
        F.lit("  0\nSECTION\n  2\nHEADER\n  9\n$INSUNITS\n 70\n"), (F.col("plan_id") % 8).cast("string"),
        F.lit("\n  0\nENDSEC\n  0\nSECTION\n  2\nENTITIES\n"),
    )
    return rows.groupBy("plan_id").agg(body.alias("body")).select(
        "plan_id", F.concat(head, "body", F.lit("  0\nENDSEC\n  0\nEOF\n")).alias("text")
    )
