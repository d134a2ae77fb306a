"""Line deduplication within an edit bound, by the deletion neighbourhood, in SQL expressions.

Two lines are alike if one character inserted, deleted or changed makes them equal. Lines that
are alike share a variant: the line itself or the line with one character deleted. A line's
variants are keyed by (hash of everything outside a block of characters, the block with one
character deleted), which makes all of them cheap also for very long lines.

Emitting every variant of every line would multiply the input, so a lossless filter comes first:
with one edit, the first or the second half of a line is untouched. Only lines that share a half,
cut as for their own length or for one character more, with another distinct line emit variants.
Lines too short for an edit to be an accident (``min_chars``) are compared for equality alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACES, stored
from webloom.operators.joins import lookup

#: Characters per block of the variant keys.
BLOCK = 64


KEY = ["row", "id_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row as ``record``, with the key that tells documents apart: hash of id and text, and the id."""
    return docs.select(F.struct("*").alias("record")).select(
        "record", F.xxhash64("record.doc_id", "record.text").alias("row"), F.coalesce(F.col("record.doc_id").cast("string"), F.lit("")).alias("id_key"))


def _lines(rows: DataFrame) -> DataFrame:
    """Every line that holds a word, with its digest and its place."""
    split = rows.select("record.doc_id", *KEY, F.posexplode(F.split("record.text", "\n")).alias("pos", "line"))
    return split.filter(F.btrim("line", F.lit(SPACES)) != "").select(
        F.unhex(F.md5("line")).alias("id"), F.struct("doc_id", *KEY, "pos").alias("place"), "line")


def _halves(line: Column) -> Column:
    """Keys of both halves, cut as for the line's own length and for one character more."""
    n = F.length(line)
    keys = []
    for longer in (0, 1):
        of = n + longer
        half = F.floor(of / 2).cast("int")
        keys.append(F.xxhash64(of, F.lit(1), F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(of, F.lit(2), F.substring(line, half + 1 - longer, n)))
    return F.array(*keys)


def _variants(line: Column) -> Column:
    """Keys of the line with one character deleted, and of the line as such a remainder of a longer one."""
    n = F.length(line)
    blocks = lambda of: F.sequence(F.lit(0), F.floor((of - 1) / BLOCK).cast("int"))
    left = lambda j: F.substring(line, F.lit(1), j * BLOCK)

    def deleted(j: Column) -> Column:
        block = F.substring(line, j * BLOCK + 1, F.lit(BLOCK))
        outside = F.xxhash64(n, j, left(j), F.substring(line, (j + 1) * BLOCK + 1, n))
        return F.get(F.transform(F.array(F.struct(block.alias("b"), outside.alias("o"))), lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s["b"])),
            lambda i: F.xxhash64(s["o"], F.concat(F.substring(s["b"], F.lit(1), i - 1), F.substring(s["b"], i + 1, F.lit(BLOCK)))))), F.lit(0))

    def remainder(j: Column) -> Column:
        of = n + 1
        size = F.least(F.lit(BLOCK), of - j * BLOCK)  # of the longer line's block
        block = F.substring(line, j * BLOCK + 1, size - 1)
        return F.xxhash64(F.xxhash64(of, j, left(j), F.substring(line, j * BLOCK + size, n)), block)

    return F.array_distinct(F.concat(F.flatten(F.transform(blocks(n), deleted)), F.transform(blocks(n + 1), remainder)))


def _dropped(rows: DataFrame, min_chars: int) -> DataFrame:
    """``row, id_key, pos`` of the lines that an earlier line makes superfluous."""
    lines = _lines(rows)
    halves = F.when(F.length("line") >= min_chars, _halves(F.col("line")))
    seen = lines.select("id", "place", F.xxhash64("line").alias("short"), halves.alias("halves"))
    # The hashes are functions of the line: any row of an id will do.
    distinct = stored(seen.groupBy("id").agg(
        F.min("place").alias("first"), F.count("*").alias("n"), F.min("short").alias("short"), F.min("halves").alias("halves")), "lines")
    keyed = distinct.select("short", F.explode(F.array_distinct("halves")).alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    near = keyed.join(shared, "half", "left_semi").select("short").distinct()
    # The text of a candidate comes from its first place.
    spots = distinct.join(near, "short", "left_semi").groupBy("first.row", "first.id_key").agg(
        F.collect_list(F.struct("id", "first")).alias("spots"))
    texts = lookup(rows.select(*KEY, "record.text"), spots, KEY).select(
        F.split("text", "\n").alias("lines"), F.explode("spots").alias("s")).select(
        "s.id", "s.first", F.get("lines", F.col("s.first.pos")).alias("line"))
    texts = stored(texts, "texts").dropDuplicates(["id"])
    variants = texts.select("id", "first", F.explode(_variants(F.col("line"))).alias("key"))
    met = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    both = stored(variants.join(met, "key", "left_semi"), "variants")
    # Lines of one variant differ in one place: a group holds an alphabet's worth at most.
    a, b = both.alias("a"), both.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.first") < F.col("b.first"))).select(
        F.col("a.id").alias("early"), F.col("b.id").alias("id")).distinct()
    side = lambda id_, line: texts.select(F.col("id").alias(id_), F.col("line").alias(line))
    alike = pairs.join(side("early", "x"), "early").join(side("id", "y"), "id").filter(
        F.levenshtein("x", "y", 1) >= 0).select("id").distinct().withColumn("late", F.lit(True))
    marked = stored(distinct.select("id", "first", "n").join(alike, "id", "left"), "marked")
    # A late line goes everywhere, any other line everywhere but in its first place.
    firsts = marked.filter("late").select("first.row", "first.id_key", "first.pos")
    copies = lookup(lines.select("id", "place", F.xxhash64("place").alias("spread")), marked.filter("n > 1").select("id", "first"), "id", spread_on="spread").filter(
        F.col("place") != F.col("first")).select("place.row", "place.id_key", "place.pos")
    return firsts.unionByName(copies)


def deduplicate(docs: DataFrame, min_chars: int = 20, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines removed that repeat an earlier line or differ from one by a single edit.

    Lines are the parts between line feeds. Earlier means a smaller (doc_id, hash of id and text,
    line number) over all documents, null doc_ids first; being dropped itself does not stop a line
    from making later ones superfluous. Lines with fewer than ``min_chars`` characters go only if
    they repeat exactly; lines without a word always stay. A null text stays null, an empty one
    empty; a text that loses every line becomes empty. Repeated rows (equal doc_id and text) are
    one document and all look alike afterwards; an empty table gives no rows. Columns are kept;
    the numbers of lines and of dropped lines are added under the names ``counts`` and replace
    columns of these names.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be positive")
    rows = _keyed(docs)
    gone = _dropped(rows, min_chars).groupBy(*KEY).agg(F.collect_set("pos").alias("gone"))
    text = F.col("record.text")
    lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i))
    names = [c for c in docs.columns if c.lower() not in {n.lower() for n in counts}]
    joined = rows.join(gone, KEY, "left").withColumn("lines", lines)
    return joined.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else F.col(f"record.`{c}`").alias(c) for c in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(counts[1]))
