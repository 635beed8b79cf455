"""Fill-in-middle by relations over a text's units.

A unit is a run of white space with the visible characters after it, or white
space at the end. Units are exploded with their positions, a window adds up
their lengths, and a document's two cut requests meet the units with the
ordinals that they name. The largest sums per document are the offsets, in code
points, at which the text is cut; no Python runs.

Which documents are cut, where and in which order follows from the digest of
seed and doc_id alone. Marks can't be met by chance: texts that hold one stay
plain, and no end of a mark is a beginning of another, so ``restored`` finds the
text again from output and form.

Rows that are cut are numbered in a written table, so repeated and missing ids stay apart:
null text counts as empty; rows without doc_id draw from the digest of the seed
alone; repeated rows give repeated results; other columns are ignored; an empty
table gives no rows. A text of any length is one group of the window, which
Spark sorts and spills; partitions are made for UNITS units each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Units that one partition of the window is meant to hold.
UNITS = 2_000_000
SPACE = r"[\x20\x09-\x0D]"
UNIT = rf"{SPACE}*[^\x20\x09-\x0D]+|{SPACE}+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(digest: Column, number: int) -> Column:
    """The ``number``-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def _units(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def planned(docs: DataFrame, id_col: str, text_col: str, seed: int, rate: int, spm: int) -> DataFrame:
    """(doc_id, text, form, h) of every row."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = named.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(F.col("h"), 2) % 100 >= rate)
    return drawn.withColumn("form", F.when(plain, "plain").when(_draw(F.col("h"), 3) % 100 < spm, "spm").otherwise("psm"))


def _count() -> Column:
    return F.size(_units("text")).cast("long")


def cut(rows: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, n, form, text, low_end, high_end) of ``rows`` (row, doc_id, text, n,
    form, low, high): where the units named by the cut requests end, in code
    points; 0 where no unit is before the cut."""
    dealt = rows.select("row", "text").repartition(partitions, "row")
    # the first unit brings the text along, so it is shuffled once and never joined
    units = dealt.select("row", "text", F.posexplode(_units("text")).alias("at", "unit")).select("row", (F.col("at") + 1).alias("ordinal"), F.length("unit").cast("long").alias("size"), F.when(F.col("at") == 0, F.col("text")).alias("text"))
    ends = units.withColumn("end", F.sum("size").over(Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    asked = rows.select(F.col("row").alias("_row"), "doc_id", "n", "form", "low", "high")
    # one request row a document and no equality of ordinals: the join keeps the window's partitioning
    met = ends.join(asked, (F.col("row") == F.col("_row")) & ((F.col("ordinal") == F.col("low")) | (F.col("ordinal") == F.col("high")) | (F.col("ordinal") == 1)))
    at = lambda c: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))), F.lit(0)).cast("int").alias(f"{c}_end")
    return met.groupBy("row", "doc_id", "n", "form").agg(F.max("text").alias("text"), at("low"), at("high")).drop("row")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text, from output and form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.
    ``rate`` per cent of the documents are cut, ``spm`` per cent of those with
    the suffix first."""
    spark, found = docs.sparkSession, planned(docs, id_col, text_col, seed, rate, spm)
    n = F.col("n") + 1
    one, two = _draw(F.col("h"), 0) % n, _draw(F.col("h"), 1) % n
    asking = found.where("form <> 'plain'").withColumns({"row": F.monotonically_increasing_id(), "n": _count()})
    asking = asking.select("row", "doc_id", "text", "n", "form", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    # written once: the row numbers hold for every later scan, whichever tasks are run again
    rows = Scratch(spark).keep(asking, "infill", "zstd")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum("n")).first()[0] or 0) // UNITS + 1)
    part = lambda start, size: F.substring("text", start + 1, size)
    done = cut(rows, partitions)
    done = done.withColumns({"p": part(F.lit(0), F.col("low_end")), "m": part(F.col("low_end"), F.col("high_end") - F.col("low_end")), "s": part(F.col("high_end"), F.length("text"))})
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm_form = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    done = done.select(
        "doc_id", "n", "form", F.col("low_end").cast("long").alias("prefix_chars"), (F.col("high_end") - F.col("low_end")).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).otherwise(spm_form).alias("output"),
    )
    none = F.lit(None).cast("long")
    return done.unionByName(found.where("form = 'plain'").select("doc_id", _count().alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output")))


def digests(found: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(infill(table(spark, sf_dir, "documents")))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda x: CAST('0x' || substr(h, CAST(x AS BIGINT), 8) AS BIGINT)) AS h FROM d),
f AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
c AS (SELECT doc_id, text, n, form, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
