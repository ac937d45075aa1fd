"""Removal of repeated line runs (operator 5).

Lines become ids; the suffixes of the line-id sequences are sorted by distributed prefix
doubling: rank 0 orders suffixes by their first line, and each round refines the ranks of
tied suffixes by the rank 1, 2, 4, ... lines further on.  Only repeated lines take part (a
unique line ends every common prefix), and only blocks of consecutive repeated lines that
hold enough words.  Suffixes that tie at level k form an interval of the suffix array whose
longest common prefix is at least 2**k lines; an interval for any other number of lines is
named by the ranks of two overlapping power-of-two runs.  A run of at least ``min_words``
words is a copy if its interval holds an earlier position.  Every such run is covered by
its smallest sufficient sub-runs (forwards from its first line, backwards from each later
one), so marking those deletes exactly the later copies of all maximal runs.

Defined results: null text stays null and has no lines; rows with the same id and text are
one document (none is a copy of the other) and get the same result; a document may repeat
its own runs, of which the first stays; documents are ordered by id, null ids first, then
by a digest of the text; an empty table gives an empty result; further columns are kept, whatever their names
(n_lines and n_removed are replaced).

Hot lines, hot pairs of ranks and hot runs are broadcast apart from the others (join_counted).  A worker holds
the lines of one block, the repeated lines of one text that follow on each other, about 500 bytes for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, cut, flat_batches, join_counted, map_batches, maybe_broadcast, on_texts, packed, release, table

MIN_WORDS = 50
POS = ["d", "t", "i"]  # id, digest of the text, line number


def _digest(c: Column | str) -> Column:
    return F.xxhash64(c)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, i, h, g, w): each line once, with 128 bits of hash and its number of words."""

    def run(batch: pa.RecordBatch) -> dict:
        rows, at, h, g, w = [], [], [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            own = text.encode().split(b"\n")
            rows.append(np.full(len(own), k)), at.append(np.arange(len(own)))
            for line in own:
                name = xxhash.xxh3_128_digest(line)
                h.append(name[:8]), g.append(name[8:]), w.append(len(line.split()))
        row = pa.array(np.concatenate(rows))
        bits = lambda x: np.frombuffer(b"".join(x), "<i8")
        return {"d": batch.column(0).take(row), "t": batch.column(1).take(row), "i": np.concatenate(at).astype(np.int32), "h": bits(h), "g": bits(g), "w": w}

    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), _digest(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    return map_batches(own, run, "d long, t long, i int, h long, g long, w long")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """(h, g, r, c): for each repeated line the number of repeated lines that sort before it, and how often it occurs.

    The prefix sum runs in 1024 ranges of the hash, which are even, and over one row for each range.
    """
    counted = cut(lines.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").withColumn("b", F.shiftright("h", 54)))
    ranges = counted.groupBy("b").agg(F.sum("c").alias("c"))
    base = ranges.select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("base"))  # at most 1024 rows
    inside = F.sum("c").over(Window.partitionBy("b").orderBy("h", "g")) - F.col("c")
    return cut(counted.withColumn("r", inside).join(F.broadcast(base), "b").select("h", "g", (F.col("r") + F.col("base")).alias("r"), "c"))


def _suffixes(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(d, t, i, w, left, ranks): suffixes in blocks of consecutive repeated lines with enough words.

    left: lines from here to the end of the block.
    """
    once = docs.where(F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("d"), _digest(text_col).alias("t")).count().where("count > 1").limit(1).count()
    lines = lines_of(docs, id_col, text_col)
    lines = cut(lines.dropDuplicates(POS) if once else lines)
    own = join_counted(lines, _first_ranks(lines), ["h", "g"], "c", lines.count()).select(*POS, "w", "r")
    by_doc = Window.partitionBy("d", "t").orderBy("i")
    block = own.withColumn("b", F.col("i") - F.row_number().over(by_doc))
    whole = Window.partitionBy("d", "t", "b")
    block = block.withColumn("words", F.sum("w").over(whole)).withColumn("left", F.max("i").over(whole) - F.col("i") + 1)
    return cut(block.where(F.col("words") >= min_words).select(*POS, "w", "left", F.array("r").alias("ranks")))


def _refined(s: DataFrame, step: int, total: int) -> DataFrame:
    """One doubling: a tied suffix gets its rank plus the number of its group that sort before it by the rank ``step`` lines on."""
    now = F.element_at("ranks", -1)
    later = s.select(F.col("d").alias("ld"), F.col("t").alias("lt"), (F.col("i") - step).alias("li"), now.alias("lr"))
    same = F.col("d").eqNullSafe(F.col("ld")) & (F.col("t") == F.col("lt")) & (F.col("i") == F.col("li"))
    own = s.join(later, same & (F.col("left") > step), "left").select(*POS, "w", "left", "ranks", F.coalesce("lr", F.lit(-1)).alias("r2")).withColumn("r", now)
    own = cut(own)
    part = F.floor(F.col("r2") * F.lit(64) / F.lit(max(1, total)))  # so that one common first line isn't one task
    pairs = own.groupBy("r", "r2").agg(F.count("*").alias("c")).withColumn("p", part)
    parts = pairs.groupBy("r", "p").agg(F.sum("c").alias("c"))
    base = parts.select("r", "p", (F.sum("c").over(Window.partitionBy("r").orderBy("p")) - F.col("c")).alias("base"))
    inside = F.sum("c").over(Window.partitionBy("r", "p").orderBy("r2")) - F.col("c")
    placed = cut(pairs.withColumn("o", inside).join(base, ["r", "p"]).select("r", "r2", (F.col("r") + F.col("o") + F.col("base")).alias("new"), "c"))
    return join_counted(own, placed, ["r", "r2"], "c", total).select(*POS, "w", "left", F.array_append("ranks", F.col("new")).alias("ranks"))


def suffix_array(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """Suffixes with their ranks at each level; ties are equal to their blocks' ends.

    With ``whole`` the last level is the place in the suffix array.  Otherwise doubling ends when the
    suffixes are sorted by as many lines as the longest run has that must be told from others.
    """
    s, step = _suffixes(docs, id_col, text_col, min_words), 1
    release(docs.sparkSession)
    total = s.count()
    depth = total if whole else flat_batches(_by_block(s), _longest(min_words), "m int").agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    while total and 2 * step <= depth:
        tied = s.groupBy(F.element_at("ranks", -1).alias("r")).agg(F.count("*").alias("c"), F.max("left").alias("m"))
        if not tied.where((F.col("c") > 1) & (F.col("m") > step)).limit(1).count():
            break
        s, step = cut(_refined(s, step, total)), step * 2
        release(docs.sparkSession)
    return s


def _by_block(s: DataFrame) -> DataFrame:
    """Suffixes with all of a document in one partition, in order."""
    return s.repartition("d", "t").sortWithinPartitions(*POS).select(*POS, "w", "left", "ranks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block of a sorted partition."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[-1][0] or row[1] != held[-1][1] or held[-1][4] == 1):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sufficient(rows: list[tuple], min_words: int) -> set[tuple[int, int]]:
    """Smallest sufficient runs (first line, end) of a block: forwards from each line and backwards from each."""
    words = np.cumsum([0, *(r[3] for r in rows)])
    ends = np.searchsorted(words, words[:-1] + min_words)
    starts = np.searchsorted(words, words[1:] - min_words, side="right") - 1
    return {(i, int(e)) for i, e in enumerate(ends) if e <= len(rows)} | {(int(s), e + 1) for e, s in enumerate(starts) if s >= 0}


def _longest(min_words: int):
    """Lines of the longest run that _windows will name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        yield {"m": [max((e - i for rows in _blocks(batches) for i, e in _sufficient(rows, min_words)), default=0)]}

    return run


def _windows(min_words: int):
    """Smallest sufficient runs of each block: (d, t, i, m, a, b), m lines from i, named by two ranks."""

    def of_block(rows: list[tuple]) -> list[tuple]:
        out = []
        for i, e in _sufficient(rows, min_words):
            m = e - i
            k = min(m.bit_length() - 1, len(rows[i][5]) - 1)
            # all ranks from the last level on are the same, so a longer run is named by the last level too
            out.append((rows[i][0], rows[i][1], rows[i][2], m, rows[i][5][k], rows[e - (1 << k)][5][k] if (1 << k) <= m else -1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names, out = ["d", "t", "i", "m", "a", "b"], []
        for rows in _blocks(batches):
            out += of_block(rows)
            if len(out) > 20_000:
                yield dict(zip(names, zip(*out, strict=True), strict=True))
                out = []
        if out:
            yield dict(zip(names, zip(*out, strict=True), strict=True))

    return run


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, drop): for each document with later copies the lines to delete, as ranges: first line, end, first line, end, ..."""
    s = suffix_array(docs, min_words, id_col, text_col, whole=False)
    runs = cut(flat_batches(_by_block(s), _windows(min_words), "d long, t long, i int, m int, a long, b long"))
    place = F.struct("d", "t", "i")
    first = cut(runs.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1"))
    copies = join_counted(runs, first, ["m", "a", "b"], "c", runs.count()).where(~place.eqNullSafe(F.col("first")))
    spans = copies.groupBy("d", "t").agg(F.collect_list("i").alias("i"), F.collect_list(F.col("i") + F.col("m")).alias("e"))  # of one document
    return map_batches(spans, _merged, "d long, t long, drop array<int>")


def _merged(batch: pa.RecordBatch) -> dict:
    """For each document its runs as ranges that don't touch: first line, end, first line, end, ..."""
    out = []
    for starts, ends in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        own: list[int] = []
        for i, e in sorted(zip(starts, ends, strict=True)):
            if own and i <= own[-1]:
                own[-1] = max(own[-1], e)
            else:
                own += [i, e]
        out.append(own)
    return {"d": batch.column(0), "t": batch.column(1), "drop": out}


def _rest(texts: list, drops: list) -> list:
    """The texts without the lines in the given ranges; null where there are none to drop."""
    out = []
    for text, drop in zip(texts, drops, strict=True):
        if text is not None:
            lines = text.split("\n")
            ends = [0, *drop, len(lines)]
            text = "\n".join(x for a, b in zip(ends[::2], ends[1::2], strict=True) for x in lines[a:b])
        out.append(text)
    return out


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of repeated line runs deleted from the text, and the columns n_lines and n_removed."""
    names = ["_kinsieve_d", "_kinsieve_t", "_kinsieve_drop"]
    gone = cut(later_copies(docs, min_words, id_col, text_col).toDF(*names))
    release(docs.sparkSession)
    gone = maybe_broadcast(gone)
    drop = F.col(names[2])
    joined = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[names[0]]) & (_digest(docs[text_col]) == gone[names[1]]), "left")
    kept = on_texts(_rest, pa.string(), F.when(drop.isNotNull(), F.col(text_col)), drop, once=True)  # only texts that lose lines are passed to Python
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = joined.withColumns({"n_lines": n_lines, "n_removed": F.when(drop.isNull(), F.lit(0)).otherwise(F.aggregate(drop, F.lit(0), lambda s, x: x - s)).cast("long")})
    return out.withColumn(text_col, F.when(drop.isNull(), F.col(text_col)).otherwise(kept)).drop(*names)


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the same columns: texts without later copies, n_chars to match, and documents dropped that were copies throughout."""
    out = remove_repeated_lines(packed(docs, "doc_id", "text"), min_words)
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    kept = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return out.where(left).select(*kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were deleted as later copies, and the text that stays."""
    return remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
