"""License phrases and notices, found by voting on the diagonals of matching word pairs.

Every text becomes its words; every rolling pair of words is joined by hash to
the positions that the pair has in the templates. A match votes for the
diagonal ``word position - template position``, which is where the template
would start. Votes are counted per diagonal. Inserted and missing words move the
rest of a notice to neighbouring diagonals, so each diagonal is merged with those
up to ``2 + pairs / 10`` behind it, never further, and merged spans with enough
votes are verified: the score is the longest run of matches in which template
positions and word positions both ascend, as a share of the template's pairs.

* A base phrase counts wherever all its words stand consecutively, that is, on
  each single diagonal with all of its pairs.
* A notice gives its label if its best span has a score of SHARE or more.

Notices come from a table (label, text) of any length: headers as well as full
license texts. One pass over the texts without Python: the pairs are generated,
joined with the templates' pairs, and only matches and one row per document are
shuffled. Rows are told apart by their place in the input: pass a stored table.

Null text is empty. Each input row gives one row, repeated rows repeated ones;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
Templates that are null or have fewer than two words are left out, equal ones
count once.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewatch.operators.scale import is_small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.7
UNIT = 1_000_000

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Notices of well-known licenses and the labels they give.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under the gnu general public license", "gnu-gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _next(words: Column) -> Column:
    return F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))


def _templates(spark: SparkSession, notices: DataFrame | None) -> DataFrame:
    """(template, label, base, position, pairs, reach, a, b, h) of every pair of all templates."""
    told = [(label, text, True) for text, label in BASE]
    if notices is None:
        told += [(label, text, False) for text, label in NOTICES]
    given = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("label", "text", "base"), row, strict=True)]) for row in told]
    rows = spark.range(1).select(F.inline(F.array(*given)))
    if notices is not None:
        rows = rows.unionByName(notices.select(F.col("label").cast("string"), F.col("text").cast("string"), F.lit(False).alias("base")))
    rows = rows.select("label", "base", words_of(F.col("text")).alias("w")).where((F.col("label") != "") & (F.size("w") > 1)).distinct()
    pairs = (F.size("w") - 1).cast("long")
    rows = rows.select(
        F.xxhash64("label", "base", "w").alias("template"), "label", "base", pairs.alias("pairs"),
        (F.floor(pairs / 10) + 2).alias("reach"), F.posexplode(F.slice(F.arrays_zip(F.col("w").alias("a"), _next(F.col("w")).alias("b")), F.lit(1), pairs.cast("int"))),
    )
    rows = rows.select("template", "label", "base", "pairs", "reach", F.col("pos").cast("long").alias("position"), "col.a", "col.b")
    # The empty pair stands for the document itself, so that every document has a match.
    own = {"template": 0, "label": "", "base": False, "pairs": 1, "reach": 2, "position": 0, "a": "", "b": ""}
    itself = spark.range(1).select(*[F.lit(v).cast(rows.schema[n].dataType).alias(n) for n, v in own.items()])
    return rows.unionByName(itself).withColumn("h", F.xxhash64("a", "b"))


def _in_order(matches: Column) -> Column:
    """Length of the longest run of matches whose positions and places both ascend (patience sorting)."""

    def earlier(x: Column, y: Column) -> Column:
        up = (x["position"] < y["position"]) | ((x["position"] == y["position"]) & (x["at"] > y["at"]))
        return F.when(up, -1).when((x["position"] == y["position"]) & (x["at"] == y["at"]), 0).otherwise(1)

    def place(tails: Column, match: Column) -> Column:
        below = F.filter(tails, lambda t: t < match["at"])
        rest = F.slice(tails, F.size(below) + 2, F.size(tails))
        return F.concat(below, F.array(match["at"]), rest)

    # Of one position, places descend, so a run takes one of them.
    return F.size(F.aggregate(F.array_sort(matches, earlier), F.array().cast("array<bigint>"), place)).cast("long")


def scan(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), words_of(docs["text"]).alias("w"))
    key = ["row", "doc_id", "n_words"]
    rows = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w", _next(F.col("w")).alias("v"))
    own = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = rows.select(*key, F.posexplode(F.concat(own, F.arrays_zip(F.col("w").alias("a"), F.col("v").alias("b")))).alias("at", "pair"))
    pairs = pairs.select(*key, (F.col("at") - 1).cast("long").alias("at"), "pair.a", "pair.b", F.xxhash64("pair.a", "pair.b").alias("h"))
    templates = _templates(docs.sparkSession, notices)
    # The built-in table has a fixed number of rows; a given one is measured.
    hits = pairs.join(F.broadcast(templates) if notices is None or is_small(templates) else templates, ["h", "a", "b"])
    told = ["template", "label", "base", "pairs", "reach"]
    diagonals = hits.groupBy(*key, *told, (F.col("at") - F.col("position")).alias("start")).agg(
        F.collect_list(F.struct("position", "at")).alias("matches")
    ).withColumn("votes", F.size("matches").cast("long"))
    # In units of the reach, rounded down, so that one frame fits templates of all lengths.
    scaled = F.expr(f"(start * {UNIT} - pmod(start * {UNIT}, reach)) div reach")
    span = Window.partitionBy("row", "template").orderBy(scaled).rangeBetween(0, UNIT)
    merged = diagonals.withColumn("span_votes", F.sum("votes").over(span))
    place = F.col("base") & (F.col("votes") == F.col("pairs"))
    enough = ~F.col("base") & (F.col("label") != "") & (F.col("span_votes") >= SHARE * F.col("pairs"))
    merged = merged.withColumn("span", F.when(enough, F.flatten(F.collect_list("matches").over(span))))
    verified = merged.withColumn("share", F.when(enough, _in_order(F.col("span")) / F.col("pairs")).otherwise(F.lit(0.0)))
    found = F.col("share") >= SHARE
    join = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    return verified.groupBy(*key).agg(
        F.sum(place.cast("long")).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"), join(F.when(place, F.col("label"))).alias("base_labels"),
        join(F.when(place | found, F.col("label"))).alias("labels"),
        F.max(F.when(place, F.lit(1.0)).when(found, F.col("share")).otherwise(F.lit(0.0))).alias("score"),
    ).drop("row")


def _values() -> str:
    out = []
    for number, (phrase, label) in enumerate([*BASE, *NOTICES]):
        words = phrase.split()
        n = len(words) - 1
        for at in range(n):
            out.append(f"({number}, '{label}', {str(number < len(BASE)).lower()}, {at}, {n}, {n // 10 + 2}, '{words[at]}', '{words[at + 1]}')")
    return ", ".join(out)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
t(template, label, base, tpos, pairs, reach, a, b) AS (VALUES {_values()}),
g AS (SELECT r, unnest(w) AS a, unnest(list_slice(w, 2, len(w))) AS b, unnest(range(len(w))) AS i FROM d),
diagonals AS (
  SELECT r, template, label, base, pairs, reach, i - tpos AS start, count(*) AS votes, list(struct_pack(p := tpos, i := i)) AS matches
  FROM g JOIN t USING (a, b) GROUP BY ALL),
merged AS (
  SELECT *, base AND votes = pairs AS place, sum(votes) OVER span AS span_votes, flatten(list(matches) OVER span) AS all_matches
  FROM (SELECT *, (start * {UNIT} - (start * {UNIT} % reach + reach) % reach) // reach AS scaled FROM diagonals)
  WINDOW span AS (PARTITION BY r, template ORDER BY scaled RANGE BETWEEN CURRENT ROW AND {UNIT} FOLLOWING)),
verified AS (
  SELECT *, CASE WHEN NOT base AND span_votes >= {SHARE} * pairs THEN len(list_reduce(
      [[m.i] for m in list_sort([struct_pack(p := m.p, back := -m.i, i := m.i) for m in all_matches])],
      lambda tails, v : list_concat(list_concat([x for x in tails if x < v[1]], v), tails[len([x for x in tails if x < v[1]]) + 2:]),
      []::BIGINT[])) / pairs ELSE 0 END AS share
  FROM merged),
totals AS (
  SELECT r, count(*) FILTER (place) AS n_base, min(start) FILTER (place) AS first_word, max(start) FILTER (place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR share >= {SHARE}) AS labels,
    max(CASE WHEN place THEN 1.0 WHEN share >= {SHARE} THEN share ELSE 0.0 END) AS score
  FROM verified GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN totals USING (r)
"""
