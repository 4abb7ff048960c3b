"""Text drawings: read whole files into entities and segments, and write segments back as text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions.layers import unit_name
from planweave.operators.entities import segment_array
from planweave.operators.jobs import admit

# Lines of one drawing text row; larger plans continue in further parts.
TEXT_PART_LINES = 50_000

_ENTITIES = r"(?s)(?:^|\n)[ \t]*2[ \t]*\n[ \t]*ENTITIES[ \t]*\n(.*?\n|)[ \t]*0[ \t]*\n[ \t]*ENDSEC"
_OPENING = r"(?s)(?:^|\n)[ \t]*2[ \t]*\n[ \t]*ENTITIES[ \t]*\n(.*)$"
_CLOSING = r"(?s)(?:(?<=\n)|^)[ \t]*0[ \t]*\n[ \t]*ENDSEC.*$"
_UNITS = r"\$INSUNITS[ \t]*\n[ \t]*70[ \t]*\n[ \t]*(\d+)"

# Names that may be drawings, in either case, as a pattern for the file listing.
_VECTOR_NAMES = "{" + ",".join(
    "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in K.VECTOR_SUFFIXES
) + "}"


def drawing_name_filter() -> str:
    """Pattern of file names that may be drawings, for a reader's ``pathGlobFilter``."""
    return _VECTOR_NAMES


def read_drawings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``plan_id`` (the full path), ``name``, ``source_type``, ``reject_reason``, ``text``.

    Two scans: one lists all files and decides by name and size, the other opens only files that the first
    admits as drawings. Its name pattern is applied while listing and its size limit is pushed into the
    scan, so a rejected file is never opened, whatever its size. Files of one name in two folders are two
    plans, so the full path is the id.
    """
    listed = listed_drawings(spark.read.format("binaryFile").load(path))
    opened = spark.read.format("binaryFile").option("pathGlobFilter", _VECTOR_NAMES).load(path)
    return opened_drawings(listed, opened)


def read_listed(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The same from a listing of bounded size, such as the new files of one micro-batch.

    The paths of the admitted drawings pass through the driver, which lists files in any case.
    """
    paths = [r.plan_id for r in listed.filter(_is_drawing()).select("plan_id").collect()]
    if not paths:
        return listed.withColumn("text", F.lit(None).cast("string"))
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
    return opened_drawings(listed, spark.read.format("binaryFile").load(plain))


def listed_drawings(files: DataFrame, *also: str) -> DataFrame:
    """Admission of a scan of binary files, batch or stream, by path and length; ``also`` columns are kept.

    A drawing that is larger than this session may read into a row is rejected too.
    """
    limit = _reader_limit(files.sparkSession)
    admitted = admit(
        files.select(
            "path", F.col("length").alias("size_bytes"),
            F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), *also,
        )
    )
    too_large = (F.col("source_type") == "dxf") & (F.col("size_bytes") > limit)
    reason = F.when(too_large, F.lit(f"413: larger than the reader's limit of {limit} bytes"))
    return admitted.select(
        F.col("path").alias("plan_id"),
        F.regexp_extract("filename", r"^(.+?)(?:\.[^.]*)?$", 1).alias("name"),
        F.coalesce("source_type", F.lit("dxf")).alias("source_type"),
        F.coalesce("reject_reason", reason).alias("reject_reason"),
        *also,
    )


def opened_drawings(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Texts of the admitted drawings among ``files``, and the other listed files without text."""
    limit = min(_reader_limit(files.sparkSession), K.MAX_FILE_MB << 20)
    opened = listed_drawings(files.filter(F.col("length") <= F.lit(limit)), "content").filter(_is_drawing())
    text = F.regexp_replace(F.col("content").cast("string"), "\r", "")
    told = listed.filter(~_is_drawing()).withColumn("text", F.lit(None).cast("string"))
    return told.unionByName(opened.withColumn("text", text).drop("content"))


def _is_drawing() -> Column:
    return F.col("reject_reason").isNull() & (F.col("source_type") == "dxf")


def _reader_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))


def decoded_path(path: Column) -> Column:
    """A file path as it was named; file metadata hold it with percent signs. A plus stays one."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def _in_parts(drawings: DataFrame) -> bool:
    """Whether the texts are parts of drawings (``part_no``), as ``write_dxf_text`` makes them."""
    return "part_no" in drawings.columns


def _earlier(drawings: DataFrame, size: Column) -> Column:
    """Items in the parts before this one; a window over the parts of a plan, none for whole files."""
    if not _in_parts(drawings):
        return F.lit(0).cast("bigint")
    before = Window.partitionBy("plan_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0).cast("bigint"))


def _numbered(drawings: DataFrame, items: Column, number: str, item: str) -> DataFrame:
    """One row per item of an array, numbered through all parts of a plan in order."""
    listed = drawings.withColumn("_items", items)
    listed = listed.withColumn("_before", _earlier(drawings, F.greatest(F.size("_items"), F.lit(0))))
    return listed.select("plan_id", "_before", F.posexplode("_items").alias(number, item)).select(
        "plan_id", (F.col("_before") + F.col(number)).alias(number), item
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tag_array(text: Column) -> Column:
    """Code and value lines as pairs."""

    def pairs(lines: Column) -> Column:
        codes = F.filter(lines, lambda line, k: k % 2 == 0)
        values = F.filter(lines, lambda line, k: k % 2 == 1)
        whole = F.zip_with(
            codes,
            values,
            lambda code, value: F.struct(
                code.try_cast("int").alias("code"), F.trim(value).alias("value")
            ),
        )
        # An odd last line has no value.
        return F.filter(whole, lambda t: t["value"].isNotNull())

    return _bound(F.split(text, "\n"), pairs)


def dxf_tags(drawings: DataFrame) -> DataFrame:
    """All code/value pairs: ``plan_id, tag_no, code, value``."""
    tags = _numbered(drawings, _tag_array(F.col("text")), "tag_no", "tag")
    return tags.select("plan_id", F.col("tag_no").cast("int").alias("tag_no"), "tag.code", "tag.value")


def dxf_units(drawings: DataFrame) -> DataFrame:
    """Unit name of the header; only reported, never used to choose a scale."""
    code = F.regexp_extract("text", _UNITS, 1).try_cast("int")
    if _in_parts(drawings):
        return drawings.groupBy("plan_id").agg(unit_name(F.max(code)).alias("units"))
    return drawings.select("plan_id", unit_name(code).alias("units"))


def _values(tags: Column, code: int) -> Column:
    return F.transform(F.filter(tags, lambda t: t["code"] == code), lambda t: t["value"])


def _numbers(tags: Column, *codes: int) -> Column:
    return F.transform(
        F.filter(tags, lambda t: t["code"].isin(*codes)), lambda t: t["value"].try_cast("double")
    )


def _first_number(tags: Column, code: int) -> Column:
    return F.get(_values(tags, code), F.lit(0)).try_cast("double")


def entity_of_tags(tags: Column) -> Column:
    """One entity from its tags; the first tag names the type."""
    kind = F.get(tags, F.lit(0))["value"]
    is_line, is_arc = kind == "LINE", kind == "ARC"
    # An old-style polyline starts with a dummy point; its points are the vertex records.
    vertex = F.array_position(F.transform(tags, lambda t: (t["code"] == 0) & (t["value"] == "VERTEX")), True)
    points = F.when(
        kind == "POLYLINE",
        F.when(vertex > 0, F.slice(tags, vertex.cast("int"), F.size(tags))).otherwise(
            F.filter(tags, lambda t: F.lit(False))
        ),
    ).otherwise(tags)
    flags = F.coalesce(F.get(_values(tags, 70), F.lit(0)).try_cast("int"), F.lit(0))
    return F.struct(
        kind.alias("type"),
        F.coalesce(F.get(_values(tags, 8), F.lit(0)), F.lit("0")).alias("layer"),
        F.when(is_line, _numbers(points, 10, 11)).otherwise(_numbers(points, 10)).alias("xs"),
        F.when(is_line, _numbers(points, 20, 21)).otherwise(_numbers(points, 20)).alias("ys"),
        F.when(is_arc, _first_number(tags, 40)).alias("radius"),
        F.when(is_arc, _first_number(tags, 50)).alias("start_deg"),
        F.when(is_arc, _first_number(tags, 51)).alias("end_deg"),
        (flags.bitwiseAND(F.lit(1)) == 1).alias("closed"),
        (F.coalesce(F.get(_values(tags, 67), F.lit(0)).try_cast("int"), F.lit(0)) == 1).alias("paper"),
    )


def opens_record(code: Column, value: Column) -> Column:
    """Whether a tag starts a record of its own; vertices belong to their polyline."""
    return (code == 0) & ~value.isin("VERTEX", "SEQEND")


def _records(tags: Column) -> Column:
    """Tags cut at every record start; vertices stay with their polyline."""

    def starts(t: Column, k: Column) -> Column:
        return F.when(opens_record(t["code"], t["value"]), k)

    def cut(opens: Column) -> Column:
        ends = F.concat(F.slice(opens, 2, F.size(opens)), F.array(F.size(tags)))
        return F.zip_with(opens, ends, lambda start, end: F.slice(tags, start + 1, end - start))

    opens = F.filter(F.transform(tags, starts), lambda k: k.isNotNull())
    return F.when(F.size(opens) > 0, _bound(opens, cut))


def _with_entities(drawings: DataFrame) -> DataFrame:
    """Add the model-space entities as an array; the text outside ENTITIES is cut first.

    A later part of a drawing continues the section of the part before it, and the section may go on
    in the next part.
    """
    span = F.regexp_extract("text", _ENTITIES, 1)
    if _in_parts(drawings):
        opened = F.when(F.col("text").rlike(_OPENING), F.regexp_extract("text", _OPENING, 1)).otherwise(F.col("text"))
        span = F.regexp_replace(opened, _CLOSING, "")
    records = _bound(_tag_array(span), _records)
    return drawings.withColumn(
        "entities", F.filter(F.transform(records, entity_of_tags), lambda e: ~e["paper"])
    )


def dxf_entities(drawings: DataFrame) -> DataFrame:
    """Entity table; ``rec`` is the position in the file. A file is one row, so nothing shuffles."""
    found = _numbered(_with_entities(drawings), F.col("entities"), "rec", "e")
    return found.select("plan_id", F.col("rec").cast("int").alias("rec"), "e.*").drop("paper")


def parsed_drawings(drawings: DataFrame) -> DataFrame:
    """One row per whole drawing, its text read once: ``plan_id, source_type, parse_error, units, segments``."""
    found = _with_entities(drawings)
    return found.select(
        "plan_id", *_plan_columns(drawings.columns, F.coalesce(F.col("text").rlike(_ENTITIES), F.lit(False))),
        unit_name(F.regexp_extract("text", _UNITS, 1).try_cast("int")).alias("units"),
        F.flatten(F.transform("entities", lambda e: segment_array(e))).alias("segments"),
    )


def parsed_segments(parsed: DataFrame) -> DataFrame:
    """Segment table of parsed drawings; ``seq`` is dense in file order."""
    listed = parsed.select("plan_id", F.posexplode("segments").alias("seq", "s"))
    return listed.select("plan_id", F.col("seq").cast("bigint").alias("seq"), "s.*")


def _plan_columns(columns: list[str], readable: Column) -> list[Column]:
    kind = F.col("source_type") if "source_type" in columns else F.lit("dxf")
    rejected = F.col("reject_reason") if "reject_reason" in columns else F.lit(None)
    error = F.coalesce(rejected, F.when(~readable, "no ENTITIES section"))
    return [kind.alias("source_type"), error.alias("parse_error")]


def dxf_segments(drawings: DataFrame) -> DataFrame:
    """Segment table of a drawing corpus; ``seq`` is dense in file order."""
    all_segments = F.flatten(F.transform("entities", lambda e: segment_array(e)))
    return _numbered(_with_entities(drawings), all_segments, "seq", "s").select("plan_id", "seq", "s.*")


def drawing_plans(drawings: DataFrame) -> DataFrame:
    """One row per drawing with its reason of rejection or read error, if any, for ``process(plans=...)``."""
    readable = F.coalesce(F.col("text").rlike(_ENTITIES), F.lit(False))
    if _in_parts(drawings):
        drawings = drawings.groupBy("plan_id").agg(
            (F.bool_or(F.col("text").rlike(_OPENING)) & F.bool_or(F.col("text").rlike(_CLOSING))).alias("_readable")
        )
        readable = F.col("_readable")
    return drawings.select("plan_id", *_plan_columns(drawings.columns, readable))


def _pair(code: int, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{code:3d}\n"), value, F.lit("\n"))


def _number(name: str) -> Column:
    """``%.6f`` of a column. Where a decimal gives the same text it is taken, at a third of the time."""
    value = F.col(name) + 0.0
    plain = (value == 0) | F.abs(value).between(1e-6, 1e9)
    return F.when(plain, value.cast("decimal(18,6)").cast("string")).otherwise(F.format_string("%.6f", value))


def line_record(layer: Column) -> Column:
    return F.concat(
        _pair(0, "LINE"), _pair(8, layer),
        _pair(10, _number("x1")), _pair(20, _number("y1")),
        _pair(11, _number("x2")), _pair(21, _number("y2")),
    )


def drawing_frame(unit_code: int = 6) -> tuple[str, str]:
    """What stands before and after the entities of a drawing."""
    head = f"  0\nSECTION\n  2\nHEADER\n  9\n$INSUNITS\n 70\n{unit_code}\n  0\nENDSEC\n"
    head += "  0\nSECTION\n  2\nENTITIES\n"
    return head, "  0\nENDSEC\n  0\nEOF\n"


def write_dxf_text(
    segments: DataFrame, unit_code: int = 6, part_lines: int = TEXT_PART_LINES
) -> DataFrame:
    """Drawing text per plan: ``plan_id, part_no, text``.

    A plan of up to ``part_lines`` segments is one row. A larger one continues in further
    rows; the texts in ``part_no`` order are the file.
    """
    head, tail = drawing_frame(unit_code)
    part = F.floor(F.col("seq") / part_lines).cast("bigint")
    spans = segments.groupBy("plan_id").agg(F.min(part).alias("first"), F.max(part).alias("last"))
    item = F.struct("seq", line_record(F.col("layer")).alias("text"))
    parts = segments.groupBy("plan_id", part.alias("part_no")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )
    body = F.array_join(F.transform("items", lambda r: r["text"]), "")
    return parts.join(spans, "plan_id").select(
        "plan_id",
        "part_no",
        F.concat(
            F.when(F.col("part_no") == F.col("first"), head).otherwise(""),
            body,
            F.when(F.col("part_no") == F.col("last"), tail).otherwise(""),
        ).alias("text"),
    )


def write_drawings(texts: DataFrame, path: str) -> None:
    """Store drawing texts of any size as parts: ``plan_id, part_no, text``."""
    texts.select(F.col("plan_id").cast("string").alias("plan_id"), "part_no", "text").write.mode("overwrite").parquet(path)


def read_stored_drawings(spark: SparkSession, path: str) -> DataFrame:
    """Stored drawing parts, for all readers of drawings."""
    return spark.read.schema("plan_id string, part_no bigint, text string").parquet(path)
