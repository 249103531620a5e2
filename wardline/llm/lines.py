"""Line deduplication: range-partitioned hashes, first occurrences, and keep bitmaps instead of texts.

DataFrame functions only. What travels between tasks is 32 bytes per line and one bit per line of a
document; a text moves once, to meet its bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import SPACE, Scratch, ascii_lower

MIN_CHARS = 10        # code points a line's key needs to be compared at all
HOT_ROWS = 2_000      # rows of one line from which its first document is looked up instead of streamed


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, id, part, pos) of every line whose key is long enough.

    A key is the line stripped of ASCII white space with A-Z in lower case; h1 and h2 are 128 bits of it.
    ``part`` tells apart rows that repeat an id with another text. Rows without an id are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("part"),
                     F.posexplode(_lines(text)).alias("pos", "line")))
    keys = (lines.withColumn("line", F.btrim("line", F.lit(SPACE)))
            .where(F.length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line"))))
    return keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                       "id", "part", "pos")


def repeated_lines(hashes: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, part, pos) of lines whose key stands in a document with a smaller id.

    Lines are partitioned by ranges of their hash and sorted within by document and position; the first
    document of each hash is carried along that order. A line with ``hot_rows`` rows or more would fill one
    partition: its first document is taken from counts that every task combines first, and its rows are
    cut into as many ranges as they need. The hot list is as long as the table divided by ``hot_rows``.
    """
    hot = scratch.keep(hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hot_first"))
                       .where(F.col("n") >= hot_rows)
                       .select("h1", "h2", "hot_first", F.ceil(F.col("n") / hot_rows).alias("cuts")))
    cut = (hashes.join(hot, ["h1", "h2"], "left")
           .withColumn("cut", F.coalesce(F.pmod(F.xxhash64("id"), F.col("cuts")), F.lit(0)))
           .repartitionByRange("h1", "h2", "cut"))
    order = Window.partitionBy("h1", "h2", "cut").orderBy("id", "pos")
    streamed = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce("hot_first", F.first("id").over(streamed))
    return cut.select("id", "part", "pos", first.alias("first")).where("id > first").select("id", "part", "pos")


def keep_bitmaps(repeated: DataFrame) -> DataFrame:
    """(id, part, dropped): one bit per line, set where the line goes, up to the last such line.

    64 lines make one number; only documents that lose a line have a row. Numbers without a set bit
    are filled in by the gap to the next one, so that the array is addressed directly.
    """
    bits = (repeated.groupBy("id", "part", F.expr("pos div 64").cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")))
    words = bits.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    filled = F.expr("flatten(transform(w, (x, i) -> concat("
                    "array_repeat(0L, x.word - if(i = 0, -1, w[i - 1].word) - 1), array(x.bits))))")
    return words.select("id", "part", filled.alias("dropped"))


def is_dropped(dropped: Column, pos: Column) -> Column:
    """Whether the bitmap has the bit of a line position."""
    word = F.get(dropped, F.shiftright(pos, 6))
    return F.coalesce(F.getbit(word, pos.bitwiseAND(F.lit(63))) == 1, F.lit(False))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``docs`` with the columns ``_lines``, ``_dropped`` (counts) and ``_kept`` (the text left).

    A null or empty text is one empty line, which is too short to go. Lines of a row without an id stay
    and count for nobody. Rows that repeat an id are the same document: none of them loses a line to
    another. An empty table stays empty. Other columns pass through, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    hashes = scratch.keep(line_hashes(docs, id_col, text_col, min_chars))
    bitmaps = scratch.keep(keep_bitmaps(repeated_lines(hashes, scratch, hot_rows)))
    # the caller's columns travel in one struct, so that their names meet no name of this operator
    names = [c for c in docs.columns if c not in ("_lines", "_dropped", "_kept")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("own_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("own_text"))
    joined = rows.join(bitmaps, (F.col("own_id") == F.col("id")) & (F.xxhash64("own_text") == F.col("part")), "left")
    lines = _lines(F.col("own_text"))
    kept = F.array_join(F.filter(lines, lambda _, pos: ~is_dropped(F.col("dropped"), pos)), "\n")
    gone = F.expr("aggregate(dropped, 0L, (n, bits) -> n + bit_count(bits))")
    found = joined.select(
        "row", F.size(lines).cast("long").alias("_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("_dropped"),
        F.when(F.col("dropped").isNull(), F.col("own_text")).otherwise(kept).alias("_kept"))
    return found.select(*[F.col("row")[c].alias(c) for c in names], "_lines", "_dropped", "_kept")
