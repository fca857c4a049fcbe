"""Line deduplication over windows of three consecutive lines.

Lines end at \\n and are compared without blanks, tabs and carriage returns at their ends. Each run of three lines
of a text is a window, except where all three are empty. A window that occurs more than once in all texts is kept
where it occurs first (by doc_id, nulls last, then by row key and line); each later occurrence is removed, and the
lines that removed windows cover, merged, are cut from their text. Windows are identified by two 64-bit hashes.

DataFrame functions only. Windows are pre-aggregated by hash; the occurrences meet the few repeated windows in an
inner join whose heavy partitions adaptive execution splits; a document's removed positions are bounded by its lines.

Defined results: a null text stays null, an empty one empty, texts of fewer than three lines are left alone; a text
may become empty, its row stays. Rows that repeat both doc_id and text count as one document and get one result.
Lines that repeat on end (a, a, a, a) leave their first line. Further columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import narrow, positional, row_key, stored


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(docs: DataFrame) -> DataFrame:
    """A row for each window: where (order, key, line) and its two hashes. docs: doc_id, text."""
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.transform(_lines(F.col("text")), lambda s: F.trim(s, F.lit(" \t\r"))).alias("ls"))
    at = lambda i, k: F.element_at("ls", i + k)
    window = lambda i: F.struct(
        i.alias("pos"), *[F.xxhash64(F.lit(n), at(i, 0), at(i, 1), at(i, 2)).alias(f"w{n}") for n in (1, 2)], ((at(i, 0) == "") & (at(i, 1) == "") & (at(i, 2) == "")).alias("blank")
    )
    each = rows.where(F.size("ls") >= 3).select("doc_id", "__k1", "__k2", F.explode(F.transform(F.sequence(F.lit(1), F.size("ls") - 2), window)).alias("w"))
    return each.where("NOT w.blank").select("w.w1", "w.w2", F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "__k1", "__k2", F.col("w.pos").alias("pos")).alias("place"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """__k1, __k2 (the row's key), starts: the lines (from 1) at which removed windows start. docs: doc_id, text."""
    places = stored(_windows(docs), "windows")
    first = places.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    # other names for the keys, so that the join deals its two sides out itself and can split hot windows
    first = first.select(F.col("w1").bitwiseXOR(F.lit(1)).alias("j1"), "w2", "first")
    later = places.join(first, (places["w1"].bitwiseXOR(F.lit(1)) == first["j1"]) & (places["w2"] == first["w2"])).where("place > first")
    return later.groupBy("place.__k1", "place.__k2").agg(F.collect_set("place.pos").alias("starts"))


def _deduplicated(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    flat, name = positional(docs)
    doc_id, text = F.col(name["doc_id"]).cast("long"), F.col(name["text"]).cast("string")
    gone = removed_lines(narrow(docs, doc_id="long", text="string"))
    joined = flat.withColumns({k: c for k, c in zip(("__k1", "__k2"), row_key(doc_id, text), strict=True)}).join(gone, ["__k1", "__k2"], "left")
    split = joined.withColumn("__lines", _lines(text))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + 2)))
    kept = split.withColumn("__kept", F.when(F.col("starts").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size("__lines")), covered)))
    out = F.when(F.col("__kept").isNull(), text).otherwise(F.array_join(F.transform("__kept", lambda i: F.element_at("__lines", i)), "\n"))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    return kept.withColumns({"__n": n, "__gone": F.coalesce(n - F.size("__kept"), F.lit(0)), "__text": out}), name


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, with repeated windows cut from text and, where there is such a column, n_chars counted again."""
    rows, name = _deduplicated(docs)
    new = {name["text"]: F.col("__text")} | ({name["n_chars"]: F.length("__text").cast("long")} if "n_chars" in name else {})
    return rows.select(*[new.get(f"__c{i}", F.col(f"__c{i}")).alias(f"__c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_md5 (of the text that is left)."""
    rows, name = _deduplicated(docs)
    return rows.select(F.col(name["doc_id"]).alias("doc_id"), F.col("__n").alias("n_lines"), F.col("__gone").alias("n_removed"), F.length("__text").alias("n_chars"), F.md5("__text").alias("text_md5"))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
n AS (SELECT doc_id, raw, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13))) AS ls FROM d),
w AS (SELECT doc_id, i AS pos, ls[i] || chr(10) || ls[i+1] || chr(10) || ls[i+2] AS k FROM n, unnest(range(1, len(ls) - 1)) AS u(i)
      WHERE NOT (ls[i] = '' AND ls[i+1] = '' AND ls[i+2] = '')),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS o FROM w),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE o > 1) GROUP BY doc_id),
j AS (SELECT n.doc_id, raw, coalesce(gone, []) AS gone FROM n LEFT JOIN g USING (doc_id)),
o AS (SELECT doc_id, raw, gone, array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(gone, i)), lambda i: raw[i]), chr(10)) AS t FROM j)
SELECT doc_id, coalesce(len(raw), 0)::INT AS n_lines, len(gone)::INT AS n_removed,
       CASE WHEN raw IS NOT NULL THEN length(coalesce(t, ''))::INT END AS n_chars, CASE WHEN raw IS NOT NULL THEN md5(coalesce(t, '')) END AS text_md5 FROM o
"""
