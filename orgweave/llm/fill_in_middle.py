"""Fill-in-the-middle examples, cut between units (lines) found by a pattern.

Units are a relation: the matches of every text are exploded with their positions, a window sums
their lengths to the place where each ends, the cut requests of a document (two unit ordinals drawn
by its id) are joined with these ends, and the two offsets of each document are aggregated and
joined back to its text, which is cut by substring. Only ids, ordinals and lengths are shuffled for
that; texts move once, to meet their offsets. Copies of a row are combined before they are shuffled,
and rows that share an id but not the text are keyed apart by a hash of the text.

Defined cases: a null text is empty; an empty text, and one that contains a mark, stays plain (its
offsets are null); a null id draws as an empty one; repeated rows give repeated results; the
input's columns come back in the struct `row`, so no name can clash; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.llm.common import read

#: A unit is a line with its line feed; the pattern must match every character of a text.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of documents that are rearranged at all, and of these the percent with the suffix first.
RATE = 100
SUFFIX_FIRST = 50


def _draw(doc_id: Column, k: int, seed: int) -> Column:
    """The k-th group of eight hexadecimal digits of the id's hash, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), _id_text(doc_id)), 256)
    return F.conv(F.substring(digest, 8 * (k - 1) + 1, 8), 16, 10).cast("long")


def _id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks that overlap one another could not be found again in an output."""
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if a != b and a in b or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def unit_ends(docs: DataFrame, unit: str) -> DataFrame:
    """id, key, ordinal (from 1) and the code points up to the end of each unit; copies of a text count once.

    docs: id, key and text.
    """
    lengths = F.transform(F.regexp_extract_all("text", F.lit(unit), 0), F.length)
    units = docs.select("id", "key", F.posexplode(lengths).alias("pos", "len")).groupBy("id", "key", "pos").agg(F.max("len").alias("len"))
    upto = Window.partitionBy("id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.select("id", "key", (F.col("pos") + 1).alias("ordinal"), F.sum("len").over(upto).alias("end"))


def cut_requests(docs: DataFrame, unit: str, seed: int) -> DataFrame:
    """id, key, n units, and the ordinals of the units after which prefix and middle end."""
    counted = docs.select("id", "key", F.regexp_count("text", F.lit(unit)).alias("n")).groupBy("id", "key").agg(F.max("n").cast("long").alias("n"))
    one, two = (F.pmod(_draw(F.col("id"), k, seed), F.col("n") + 1) for k in (1, 2))
    return counted.select("id", "key", "n", F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def offsets(docs: DataFrame, unit: str, seed: int) -> DataFrame:
    """id, key, n, and the code points before the first and the second cut."""
    asked, ends = cut_requests(docs, unit, seed), unit_ends(docs, unit).select(F.col("id").alias("of"), F.col("key").alias("text_key"), "ordinal", "end")
    met = asked.join(ends, (F.col("id") == F.col("of")) & (F.col("key") == F.col("text_key")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))), "left")
    at = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0))
    return met.groupBy("id", "key", "n", "first", "second").agg(at("first").alias("a"), at("second").alias("b")).select("id", "key", "n", "a", "b")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """Per row: row (the input's columns), n, form (plain, psm or spm), prefix_chars, middle_chars and output."""
    _checked(marks)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = _id_text(F.col(id_col)).alias("id"), F.xxhash64(text).alias("key")
    known = offsets(docs.select(*keys, text.alias("text")), unit, seed)
    # a text travels once, within its row
    rows = docs.select(*keys, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    cut = rows.join(known, ["id", "key"], "left").withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))
    p, s, m = marks
    plain = (F.col("text") == "") | F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m)) | (_draw(F.col("id"), 3, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("id"), 4, seed) % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.select("row", "text", "n", form.alias("form"), "a", "b")
    prefix, middle = F.substr("text", F.lit(1), F.col("a").cast("int")), F.substr("text", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    suffix = F.substr("text", (F.col("b") + 1).cast("int"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    return cut.select("row", "n", "form", F.when(moved, F.col("a")).alias("prefix_chars"), F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A text with a mark is plain, so its marks are never taken for cuts."""
    quoted = "|".join("\\Q" + x + "\\E" for x in marks)
    part = lambda k: F.get(F.split(output, quoted), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
