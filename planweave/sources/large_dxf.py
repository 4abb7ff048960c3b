"""Text drawings of any size, read by line ranges: one drawing is many rows and many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave.operators.entities import segment_array
from planweave.operators.running import running_total
from planweave.sources.dxf import _reader_limit, decoded_path, drawing_name_filter, entity_of_tags
from planweave.storage import TASK_ROWS, materialize

# Lines of a block, which is one row and is taken apart in memory. Even, so that a code line and its value line stand together.
CHUNK_LINES = 65_536
# Bytes of text behind which a block of a larger file ends earlier, at the next Arrow batch.
_BLOCK_BYTES = 4 << 20
# Files of up to so many bytes, if they are one range, are handed over whole; of larger ones each line is a row first.
_WHOLE_BYTES = 32 << 20
# Blocks of one stored file. A reader of columns takes up to 4,096 rows of a file at once.
_FILE_BLOCKS = 16

_BLOCK = "file string, start bigint, row bigint, n int, head binary, after binary, text binary"
_TAGS = "array<struct<code:int,value:string>>"
_FIELDS = "type:string,layer:string,xs:array<double>,ys:array<double>,xs_text:array<string>,ys_text:array<string>,radius:string,start_deg:string,end_deg:string,closed:string,paper:string"

# The blocks that lines were read in.
_read_blocks: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def _blocks_of_files(most_lines: int) -> Callable[[Iterator], Iterator]:
    """Whole files (``file, content``) as blocks of up to ``most_lines`` lines; see ``_blocks_of_ranges``."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                # What Spark's reader of lines does too: no mark of the encoding, no line behind the last line end.
                data = content.as_buffer().to_pybytes().removeprefix(b"\xef\xbb\xbf")
                if not data:
                    continue
                data = (data if data.endswith(b"\n") else data + b"\n").replace(b"\r", b"")
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                rows = range(0, len(ends), most_lines)
                # Where each block begins, and the end of the text.
                at = [0, *(ends[[r - 1 for r in rows[1:]]] + 1).tolist(), len(data)]
                heads = [data[a:data.index(b"\n", a)] for a in at[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.as_py()] * len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()),
                        pa.array(rows, pa.int64()), pa.array([min(most_lines, len(ends) - r) for r in rows], pa.int32()),
                        pa.array(heads, pa.binary()), pa.array([*heads[1:], None], pa.binary()),
                        pa.array([data[a:b - 1] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    ["file", "start", "row", "n", "head", "after", "text"],
                )

    return cut


def _blocks_of_ranges(most_lines: int, most_bytes: int) -> Callable[[Iterator], Iterator]:
    """Neighbouring lines of a range (``file, start, line``) as blocks of up to ``most_lines`` lines.

    A task reads its ranges one after the other and each in order. ``row`` counts the lines of the range before the
    block, ``head`` is its first line and ``after`` the line behind it, null where the range ends. Bytes stay as they are.
    """

    def put_together(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key, row, held, count, size = None, 0, [], 0, 0

        def block(after):
            lines = pa.concat_arrays(held)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), lines), b"\n")
            columns = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([row], pa.int64()),
                       pa.array([count], pa.int32()), lines.slice(0, 1), pa.nulls(1, lines.type) if after is None else after, text]
            return pa.RecordBatch.from_arrays(columns, ["file", "start", "row", "n", "head", "after", "text"])

        for batch in batches:
            if not batch.num_rows:
                continue
            file, start, line = batch.columns
            turn = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
            turns = (np.flatnonzero(turn.to_numpy(zero_copy_only=False)) + 1).tolist()
            for at, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                here = (file[at].as_py(), start[at].as_py())
                if here != key:
                    if held:
                        yield block(None)
                    key, row, held, count, size = here, 0, [], 0, 0
                while at < end:
                    if count >= most_lines or size >= most_bytes:
                        yield block(line.slice(at, 1))
                        row, held, count, size = row + count, [], 0, 0
                    held.append(line.slice(at, min(end - at, most_lines - count)))
                    at, count = at + len(held[-1]), count + len(held[-1])
                    size += pc.sum(pc.binary_length(held[-1])).as_py()
        if held:
            yield block(None)

    return put_together


def read_lines(spark: SparkSession, path: str | list[str], folders: bool = False) -> DataFrame:
    """Numbered lines of drawings: ``plan_id, line_no, line``. Spark cuts large files into ranges.

    The full path is the id. With ``folders`` a folder is one drawing, whose text files in the order of their
    names are its parts, as ``DataFrame.write.text`` leaves them; parts may be cut between any two lines.
    Sizes are not limited here: ``read_drawings`` holds the limit for uploads. Lines are stored once, in blocks,
    because their place in a range is known only while the file is read. An empty file has no rows.
    """
    lines, files = spark.read.option("lineSep", "\n"), spark.read.format("binaryFile")
    if not folders:
        lines, files = (r.option("pathGlobFilter", drawing_name_filter()) for r in (lines, files))
    file, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    most = min(_WHOLE_BYTES, _range_bytes(spark), _reader_limit(spark))
    # Compressed parts are read by lines, which unpacks them.
    packed = file.rlike(r"\.(deflate|gz|bz2|zst|lz4|snappy)$")
    whole = files.load(path).filter((F.col("length") <= F.lit(most)) & ~packed).select(file.alias("file"), "content")
    ranges_of_lines = lines.text(path).filter((size > F.lit(most)) | packed).select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.replace("value", F.lit("\r"), F.lit("")).cast("binary").alias("line"),
    )
    stored = materialize(
        whole.mapInArrow(_blocks_of_files(CHUNK_LINES), _BLOCK).unionByName(
            ranges_of_lines.mapInArrow(_blocks_of_ranges(CHUNK_LINES, _BLOCK_BYTES), _BLOCK)
        ),
        _FILE_BLOCKS,
    )
    # One row per range of a file, so this window is bounded by the size of a drawing over that of a range, and a path is made
    # out once per range.
    named = decoded_path(F.col("file"))
    in_order = Window.partitionBy("plan_id").orderBy("name", "start")
    before = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = materialize(
        stored.groupBy("file", "start")
        .agg(F.sum("n").alias("n"), F.min_by("head", "row").alias("head"))
        .withColumns({"plan_id": F.regexp_extract(named, r"(?s)^(.*)/[^/]*$", 1) if folders else named, "name": named})
        .select("plan_id", "file", "start", F.coalesce(before, F.lit(0)).alias("shift"), F.lead("head").over(in_order).alias("next"))
    )
    blocks = stored.join(ranges, ["file", "start"]).select(
        "plan_id", (F.col("row") + F.col("shift")).alias("line_no"), "n", F.coalesce("after", "next").alias("after"), "text"
    )
    numbered = blocks.select("plan_id", "line_no", "text").mapInArrow(
        _lines(), "plan_id string, line_no bigint, line string"
    )
    _read_blocks[numbered] = blocks
    return numbered


def _range_bytes(spark: SparkSession) -> int:
    """Bytes of the ranges into which Spark cuts files."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def _lines() -> Callable[[Iterator], Iterator]:
    """Lines of blocks, their bytes as they are."""

    def listed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for k in range(batch.num_rows):
                found = pc.split_pattern(batch.column(2).slice(k, 1), b"\n").flatten()
                for at in range(0, len(found), 10_000):
                    some = found.slice(at, 10_000)
                    plan = pa.concat_arrays([batch.column(0).slice(k, 1)]).take(pa.array(np.zeros(len(some), np.int64)))
                    number = pa.array(batch.column(1)[k].as_py() + at + np.arange(len(some)))
                    text = pa.concat_arrays([some]).view(pa.string())
                    yield pa.RecordBatch.from_arrays([plan, number, text], ["plan_id", "line_no", "line"])

    return listed


def _blocks(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """Lines in blocks: ``plan_id, line_no`` of the first line, ``n, after, text``; ``after`` is the line behind the block.

    Lines as ``read_lines`` returns them come in the blocks they were read in, and nothing moves. Others are gathered.
    """
    if lines in _read_blocks:
        return _read_blocks[lines]
    gathered = lines.groupBy("plan_id", F.floor(F.col("line_no") / chunk_lines).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("items")
    )
    stored = materialize(
        gathered.select(
            "plan_id", F.col("items")[0]["line_no"].alias("line_no"), F.size("items").alias("n"),
            F.col("items")[0]["line"].cast("binary").alias("head"),
            F.array_join(F.transform("items", lambda i: i["line"]), "\n").cast("binary").alias("text"),
        ),
        _FILE_BLOCKS,
    )
    # One row per block.
    after = stored.select(
        "plan_id", "line_no", F.lead("head").over(Window.partitionBy("plan_id").orderBy("line_no")).alias("after")
    )
    return stored.join(after, ["plan_id", "line_no"]).select("plan_id", "line_no", "n", "after", "text")


def entity_sections(lines: DataFrame) -> DataFrame:
    """First and last line of the section of entities: ``plan_id, first, stop`` (exclusive).

    The same rule as for whole texts: the first line ``ENTITIES`` after a line ``2``, up to the next line ``ENDSEC``
    after a line ``0``. A drawing without both has no row.
    """
    return _sections(_blocks(lines, CHUNK_LINES))


def _sections(blocks: DataFrame) -> DataFrame:
    def told(text: Column) -> Column:
        return text.contains("ENTITIES") | text.contains("ENDSEC")

    # Few blocks hold one of the words, and only those are looked through line by line.
    text, after = F.col("text").cast("string"), F.col("after").cast("string")
    some = blocks.filter(told(text) | told(after)).select("plan_id", "line_no", F.split(text, "\n").alias("lines"), after.alias("after"))
    behind = F.concat(F.slice("lines", F.lit(2), F.size("lines")), F.array("after"))
    found = F.transform(behind, lambda word, k: F.when(told(word), F.struct(k.alias("k"), word.alias("word"))))
    marks = some.select(
        "plan_id", "line_no", "lines", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("m")
    ).select(
        "plan_id", (F.col("line_no") + F.col("m.k")).alias("line_no"),
        F.btrim(F.get("lines", "m.k"), F.lit(" \t")).alias("code"), F.btrim("m.word", F.lit(" \t")).alias("word"),
    )
    opens = (F.col("code") == "2") & (F.col("word") == "ENTITIES")
    marks = materialize(
        marks.filter(opens | ((F.col("code") == "0") & F.col("word").startswith("ENDSEC"))).select(
            "plan_id", "line_no", opens.alias("opens")
        )
    )
    opened = marks.filter("opens").groupBy("plan_id").agg((F.min("line_no") + 2).alias("first"))
    return (
        marks.filter("not opens")
        .join(opened, "plan_id")
        .filter(F.col("line_no") >= F.col("first"))
        .groupBy("plan_id", "first")
        .agg(F.min("line_no").alias("stop"))
    )


def _taken_apart(chunk_lines: int) -> Callable[[Iterator], Iterator]:
    """Records of the part of a block that lies in the section, for up to ``chunk_lines`` lines at once.

    The fields of all records but the last, the tags before the first record (``head``), and those of the last one, which
    may go on behind the lines (``tail``). Works on whole columns; values stay the text they are.
    """
    # What Spark takes for a whole number, around which it skips blanks and control characters.
    blanks = bytes([*range(33), 127])

    def number(code: bytes) -> int:
        code = code.strip(blanks)
        sign, digits = (code[:1], code[1:]) if code[:1] in (b"+", b"-") else (b"", code)
        small = digits.lstrip(b"0") or b"0"
        if not digits.isdigit() or len(small) > 10:
            return -1
        found = int(sign + small)
        return found if -(1 << 31) <= found < 1 << 31 else -1

    def parsed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def codes_and_values(lines):
            codes, values = lines.take(pa.array(np.arange(0, len(lines), 2))), lines.take(pa.array(np.arange(1, len(lines), 2)))
            coded = codes.dictionary_encode()
            known = np.array([number(c) for c in coded.dictionary.to_pylist()], np.int32)
            return known[coded.indices.to_numpy()], pc.ascii_trim(values.view(pa.string()), " ")

        def records(code, value, opens):
            """Fields of the records that begin at ``opens``, but the last."""
            n, start, end = len(opens) - 1, opens[0], opens[-1]
            code, value, opens = code[start:end], value.slice(start, end - start), opens - start
            of = np.repeat(np.arange(n), np.diff(opens))
            kind = value.take(pa.array(opens[:-1]))

            def first(wanted):
                at = np.flatnonzero(code == wanted)
                there, k = np.unique(of[at], return_index=True)
                found = np.full(n, -1)
                found[there] = at[k]
                return value.take(pa.array(found, mask=found < 0))

            def is_kind(name):
                return pc.equal(kind, name).to_numpy(zero_copy_only=False)

            # An old-style polyline starts with a dummy point; its points are the vertex records.
            vertex = np.flatnonzero(code == 0)
            vertex = vertex[pc.equal(value.take(pa.array(vertex)), "VERTEX").to_numpy(zero_copy_only=False)]
            since = np.where(is_kind("POLYLINE"), len(code), 0)
            there, k = np.unique(of[vertex], return_index=True)
            since[there] = np.where(since[there] > 0, vertex[k], 0)
            points = np.arange(len(code)) >= since[of]
            is_line = is_kind("LINE")[of]

            def numbers(wanted, other):
                """Numbers where all are plain, else their texts, which Spark reads in more ways."""
                at = np.flatnonzero(points & ((code == wanted) | ((code == other) & is_line)))
                bounds = pa.array(np.searchsorted(of[at], np.arange(n + 1)).astype(np.int32))
                texts = value.take(pa.array(at))
                try:
                    found = texts.cast(pa.float64())
                except pa.ArrowInvalid:
                    found = None
                if found is None or not np.isfinite(found.to_numpy()).all():
                    return pa.nulls(n, pa.list_(pa.float64())), pa.ListArray.from_arrays(bounds, texts)
                return pa.ListArray.from_arrays(bounds, found), pa.nulls(n, pa.list_(pa.string()))

            (xs, xs_text), (ys, ys_text) = numbers(10, 11), numbers(20, 21)
            fields = [kind, first(8), xs, ys, xs_text, ys_text, *(first(c) for c in (40, 50, 51, 70, 67))]
            names = ["type", "layer", "xs", "ys", "xs_text", "ys_text", "radius", "start_deg", "end_deg", "closed", "paper"]
            return pa.StructArray.from_arrays(fields, names)

        def tags(code, value):
            return pa.StructArray.from_arrays([pa.array(code, mask=code < 0), value], ["code", "value"])

        def one(items):
            return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)

        for batch in batches:
            for k in range(batch.num_rows):
                plan, at, first, stop, after, text = (c.slice(k, 1) for c in batch.columns)
                at, first, stop = (c[0].as_py() for c in (at, first, stop))
                # The line behind the block too, so that every pair is whole; behind the section a value is empty.
                lines = pc.split_pattern(text, b"\n").flatten()
                end = min(at + len(lines), stop)
                behind = after if at + len(lines) < stop else pa.array([b""], after.type)
                lines = pa.concat_arrays([lines.slice(0, end - at), behind])
                for low in range(at, end, chunk_lines):
                    high = min(low + chunk_lines, end)
                    begin = max(low, first)
                    begin += (begin - first) % 2
                    if begin >= high:
                        continue
                    code, value = codes_and_values(lines.slice(begin - at, high - begin + (high - begin) % 2))
                    zero = np.flatnonzero(code == 0)
                    inner = pc.is_in(value.take(pa.array(zero)), pa.array(["VERTEX", "SEQEND"]))
                    opens = zero[~inner.to_numpy(zero_copy_only=False)]
                    cut = len(opens) > 0
                    head = opens[0] if cut else len(code)
                    tail = one(tags(code[opens[-1]:], value.slice(opens[-1]))) if cut else None
                    whole = one(records(code, value, opens)) if len(opens) > 1 else None
                    yield plan, low, cut, one(tags(code[:head], value.slice(0, head))), tail, whole

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tag = pa.list_(pa.struct([("code", pa.int32()), ("value", pa.string())]))
        text, texts, numbers = pa.string(), pa.list_(pa.string()), pa.list_(pa.float64())
        fields = pa.list_(pa.struct([
            ("type", text), ("layer", text), ("xs", numbers), ("ys", numbers), ("xs_text", texts), ("ys_text", texts),
            *((name, text) for name in ("radius", "start_deg", "end_deg", "closed", "paper")),
        ]))
        for plan, low, cut, head, tail, whole in parsed(batches):
            yield pa.RecordBatch.from_arrays(
                [plan, pa.array([low], pa.int64()), pa.array([cut]), head, pa.nulls(1, tag) if tail is None else tail,
                 pa.nulls(1, fields) if whole is None else whole],
                ["plan_id", "line_no", "opens", "head", "tail", "records"],
            )

    return rows


def _entity_of_fields(r: Column) -> Column:
    """The same entity as ``entity_of_tags`` makes of tags."""
    is_arc = r["type"] == "ARC"

    def numbers(name: str) -> Column:
        return F.coalesce(r[name], F.transform(r[f"{name}_text"], lambda v: v.try_cast("double"))).alias(name)

    def arc(name: str) -> Column:
        return F.when(is_arc, r[name].try_cast("double")).alias(name)

    def whole(name: str) -> Column:
        return F.coalesce(r[name].try_cast("int"), F.lit(0))

    return F.struct(
        r["type"].alias("type"), F.coalesce(r["layer"], F.lit("0")).alias("layer"),
        numbers("xs"), numbers("ys"), arc("radius"), arc("start_deg"), arc("end_deg"),
        (whole("closed").bitwiseAND(F.lit(1)) == 1).alias("closed"), (whole("paper") == 1).alias("paper"),
    )


def _made_of_entities(lines: DataFrame, chunk_lines: int, made: Callable[[Column], Column]) -> DataFrame:
    """What ``made`` makes of every entity of the section, an array each: ``plan_id, line_no, cut, n, items``.

    Vertices stay with their polyline. A block makes one row, in order, of the records that lie in it (``cut`` 0). The
    last one may go on in the next blocks, so only it and what blocks begin with move to meet (``cut`` 1).
    """
    if chunk_lines % 2:
        raise ValueError("a chunk holds whole pairs, so its number of lines is even")
    blocks = _blocks(lines, chunk_lines)
    body = (
        blocks.join(materialize(_sections(blocks)), "plan_id")
        .filter((F.col("line_no") < F.col("stop")) & (F.col("line_no") + F.col("n") > F.col("first")))
        .select("plan_id", "line_no", "first", "stop", "after", "text")
    )
    apart = body.mapInArrow(
        _taken_apart(chunk_lines),
        f"plan_id {body.schema['plan_id'].dataType.simpleString()}, line_no bigint, opens boolean, head {_TAGS}, tail {_TAGS}, "
        f"records array<struct<{_FIELDS}>>",
    )
    # Entities are bound by the inner step, because they are read many times.
    entities = F.transform("records", _entity_of_fields)
    pieces = apart.select(
        "plan_id", "line_no", "opens", "head", "tail", F.flatten(F.transform(entities, made)).alias("items")
    )
    pieces = materialize(pieces.withColumn("n", F.coalesce(F.size("items"), F.lit(0))), _FILE_BLOCKS)
    # One row per block.
    earlier = Window.partitionBy("plan_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = pieces.select(
        "plan_id", "line_no", F.last(F.when(F.col("opens"), F.col("line_no")), ignorenulls=True).over(earlier).alias("opened")
    ).filter("opened is not null")
    heads = pieces.filter(F.size("head") > 0).select("plan_id", "line_no", F.col("head").alias("tags"))
    tails = pieces.filter("opens").select("plan_id", F.col("line_no").alias("opened"), "line_no", F.col("tail").alias("tags"))
    cut = (
        heads.join(opened, ["plan_id", "line_no"])
        .unionByName(tails)
        .groupBy("plan_id", "opened")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "tags"))).alias("pieces"))
        .select("plan_id", F.col("opened").alias("line_no"), F.flatten(F.transform("pieces", lambda p: p["tags"])).alias("tags"))
        .select("plan_id", "line_no", F.flatten(F.transform(F.array(entity_of_tags(F.col("tags"))), made)).alias("items"))
    )
    cut = materialize(cut.withColumn("n", F.size("items")), _FILE_BLOCKS)
    return pieces.select("plan_id", "line_no", F.lit(0).alias("cut"), "n", "items").unionByName(
        cut.select("plan_id", "line_no", F.lit(1).alias("cut"), "n", "items")
    )


def _in_file_order(made: DataFrame, number: str, item: str) -> DataFrame:
    """One row per item, numbered densely from 0 in file order."""
    # Two rows per block.
    earlier = Window.partitionBy("plan_id").orderBy("line_no", "cut").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(
        made.filter("n > 0").select(
            "plan_id", "line_no", "cut", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
        )
    )
    listed = made.join(before, ["plan_id", "line_no", "cut"]).select("plan_id", "before", F.posexplode("items").alias("k", item))
    return listed.select("plan_id", (F.col("before") + F.col("k")).alias(number), item)


def _records(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """Entity of every record of the section: ``plan_id, record, e``; vertices stay with their polyline."""
    return _in_file_order(_made_of_entities(lines, chunk_lines, lambda e: F.array(e)), "record", "e")


def entities_of_lines(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Entities of numbered lines, as ``dxf_entities`` finds them in whole texts; ``rec`` is a long here.

    A task holds a range, a chunk of lines or one entity, never a drawing.
    """
    found = materialize(_records(lines, chunk_lines).filter(~F.col("e.paper")))
    return running_total(found, ["plan_id"], "record", F.lit(1).cast("bigint"), "rec").select(
        "plan_id", "rec", "e.*"
    ).drop("paper")


def segments_of_lines(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Segments of numbered lines, as ``dxf_segments`` finds them in whole texts; ``seq`` is dense in file order."""

    def drawn(e: Column) -> Column:
        return F.filter(segment_array(e), lambda s: ~e["paper"])

    return _in_file_order(_made_of_entities(lines, chunk_lines, drawn), "seq", "s").select("plan_id", "seq", "s.*")


def write_lines(segments: DataFrame, path: str, head: str, tail: str, record: str | Column, *order: str) -> None:
    """One drawing as a folder of text parts: ``head``, the ``record`` texts in ``order``, ``tail``.

    The rows are sorted by ranges over all tasks, so no task writes the whole drawing. A ``record`` that is given as an
    expression is made when its row has come to its place, so its text does not move.
    """
    ends = segments.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("_part"))
    both = segments.withColumn("_part", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    sorted_rows = both.repartitionByRange("_part", *order).sortWithinPartitions("_part", *order)
    value = F.when(F.col("_part") == 0, F.lit(head)).when(F.col("_part") == 2, F.lit(tail)).otherwise(
        F.col(record) if isinstance(record, str) else record
    )
    text = F.when(F.endswith("value", F.lit("\n")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    sorted_rows.select(value.alias("value")).select(text.alias("value")).write.option("maxRecordsPerFile", TASK_ROWS).text(path)
