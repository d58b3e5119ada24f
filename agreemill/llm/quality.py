"""Quality rules: document statistics and cross-document line frequency.

DataFrame functions only. Each document first passes base rules on its words.
Then lines are normalised (lower case, digits as 0, white space as one space),
hashed, and counted over the distinct documents of their host. A line in more
documents of a host than the limit (``LEAST_DOCS``, and ``SHARE`` of the host's
documents) is removed wherever it stands on that host, and a document whose rest
is too short (``MIN_WORDS``) or too small a part of it (``LEFT``) is depleted and
rejected.

Exact copies are one document of their host: copies don't make their own lines
frequent, and they share a verdict. So counts run over classes (host, 128-bit
hash of the text), written once with their line hashes, not over texts; equal
classes meet in a partial aggregate, and a hot line is counted before the
shuffle. Lines go to the limits by a join of plain tables, whose hot keys an
adaptive plan splits.

Edge cases. A null text has no words; a null host is the host "". Lines without a
word are never counted or removed. Texts under ``MIN_WORDS`` words and texts of
mostly repeated windows fail the base rules, but their lines still count, since
the host shows them. Repeated rows are copies: each gets its row. Texts are read
whole at any length, in time that grows as n log n. An empty table gives an
empty result. Extra columns of any name are ignored; ``cleaned`` keeps all
columns and replaces the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.llm.common import col, free_name, table, written

#: White space of the word rule: blank and the five ASCII controls.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED = 50
#: A line is frequent in more than so many documents of a host and more than this percentage of them.
LEAST_DOCS = 20
SHARE = 2
#: Percentage of words that must be left after frequent lines are removed.
LEFT = 50

_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def _characters(text: Column, which: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, which, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    r"""The \n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def normalised(line: Column) -> Column:
    """A line as it is compared across documents."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), _GAP, " "), F.lit(" "))


def _with_repeats(df: DataFrame, words_name: str, name: str) -> DataFrame:
    """Add the number of words in windows that a text holds twice or more.

    Windows are hashed and sorted with their places; equal neighbours are
    repeated; then the stretches of their places are added up. Each step is a
    column of its own, read more than once by the next one, so that no step is
    computed again inside a lambda.
    """
    a, b, c = (free_name(df, f"{name}_{x}") for x in "abc")
    w, last = F.col(words_name), F.size(words_name) - WINDOW
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]).alias("h"), i.alias("i"))))
    df = df.withColumn(a, F.sort_array(F.coalesce(hashes, F.array().cast("array<struct<h: bigint, i: int>>"))))
    sorted_ = F.col(a)
    same = lambda x, k: F.coalesce(F.get(sorted_, k)["h"] == x["h"], F.lit(False))
    df = df.withColumn(b, F.when(F.size(a) > 1, F.filter(sorted_, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1)))))
    df = df.withColumn(c, F.sort_array(F.transform(F.coalesce(F.col(b), F.array().cast("array<struct<h: bigint, i: int>>")), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("to"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.col(c), start, lambda s, i: F.struct(i.alias("to"), (s["n"] + F.least(F.lit(WINDOW), i - s["to"])).alias("n")), lambda s: s["n"])
    return df.withColumn(name, covered).drop(a, b, c)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and base_failed, which replace columns of these names."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    keep = [c for c in docs.columns if c.lower() not in names]
    out = docs.select(*[col(c) for c in keep])
    t, w, lines = col(text), free_name(out, "w_"), free_name(out, "lines_")
    out = out.withColumn(w, words(t)).withColumn(lines, worded_lines(t))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(F.coalesce(t, F.lit("")), SPACES, "")).cast("long"),
        "n_symbols": _characters(t, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    out = _with_repeats(out, w, "n_repeat_words").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return out.select(*[col(c) for c in keep], *names)


def _class(host: Column, text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.xxhash64(t).alias("c1"), F.xxhash64(F.lit(1), t).alias("c2")]


def line_classes(docs: DataFrame, host: Column, text: str = "text") -> DataFrame:
    r"""(host, c1, c2, lines): one row a distinct text of a host, with the hash
    and the number of words of each \n-split line in order (null without a word)."""
    each = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n", -1), lambda x: F.when(n_words(x) > 0, F.struct(F.xxhash64(normalised(x)).alias("h"), n_words(x).alias("n"))))
    return docs.select(*_class(host, col(text)), each.alias("lines")).groupBy("host", "c1", "c2").agg(F.first("lines").alias("lines"))


def frequent_lines(classes: DataFrame, least: int = LEAST_DOCS, share: int = SHARE) -> DataFrame:
    """(host, h, n_docs) of the lines above the limits of their host."""
    hosts = classes.groupBy("host").agg(F.count("*").alias("host_docs"))
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: x["h"]))
    counts = classes.select("host", F.explode(own).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least)
    return counts.join(hosts, "host").where(100 * F.col("n_docs") > share * F.col("host_docs")).select("host", "h", "n_docs")


def removals(classes: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, c1, c2, removed_words, removed): the frequent lines of each class,
    ``removed`` being their places from 0. Classes without one are left out."""
    lines = classes.select("host", "c1", "c2", F.posexplode("lines").alias("place", "line")).where("line is not null")
    hit = lines.select("host", "c1", "c2", "place", F.col("line.h").alias("h"), F.col("line.n").alias("n")).join(frequent.select("host", "h"), ["host", "h"])
    return hit.groupBy("host", "c1", "c2").agg(F.sum("n").cast("long").alias("removed_words"), F.sort_array(F.collect_list("place")).alias("removed"))


def judged(docs: DataFrame, host: Column, text: str = "text", least: int = LEAST_DOCS, share: int = SHARE, left: int = LEFT) -> DataFrame:
    """All rows with the columns of ``base_rules``, removed_words, removed (places
    of removed lines) and kept, which replace columns of these names."""
    classes = written(line_classes(docs, host, text))
    found = removals(classes, frequent_lines(classes, least, share))
    own = [free_name(docs, x) for x in ("host_", "c1_", "c2_")]
    rows = docs.select("*", *[c.alias(n) for c, n in zip(_class(host, col(text)), own, strict=True)])
    rows = base_rules(rows, text)
    rows = rows.select(*[col(c) for c in rows.columns if c.lower() not in ("removed_words", "removed", "kept")])
    keys = dict(zip(("host", "c1", "c2"), own, strict=True))
    joined = rows.join(found.withColumnsRenamed(keys), own, "left").drop(*own)
    rest = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    kept = ~F.col("base_failed") & (rest >= MIN_WORDS) & (100 * rest >= left * F.col("n_words"))
    return joined.withColumns({"removed_words": F.coalesce(F.col("removed_words"), F.lit(0)), "removed": F.coalesce(F.col("removed"), F.array().cast("array<int>")), "kept": kept})


def cleaned(docs: DataFrame, host: Column, text: str = "text", **limits: int) -> DataFrame:
    """The kept documents without their frequent lines, with the caller's columns."""
    nested = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text).alias("text"), host.alias("host_of"))
    rows = judged(nested, F.col("host_of"), **limits).where("kept").withColumn("lines", F.split("text", "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    rest = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    whole = F.when(F.size("removed") == 0, F.col("text")).otherwise(rest)
    return rows.select(*[(whole if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; a source is a host."""
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.col("source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT uid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), b AS (
  SELECT uid, doc_id, t, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d JOIN w USING (uid)
), win AS (
  SELECT uid, p, w[p:p + 2] AS x FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) > 2)
), rep AS (
  SELECT uid, p FROM win QUALIFY count(*) OVER (PARTITION BY uid, x) > 1
), r AS (
  SELECT uid, count(DISTINCT q) AS n_repeat_words FROM (SELECT uid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY uid
), l AS (
  SELECT uid, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT uid, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT uid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY uid
), h AS (
  SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host
), f AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n_docs FROM l GROUP BY host, norm) JOIN h USING (host)
  WHERE n_docs > {LEAST_DOCS} AND 100 * n_docs > {SHARE} * host_docs
), x AS (
  SELECT uid, CAST(sum(n) AS BIGINT) AS removed_words FROM l JOIN f USING (host, norm) GROUP BY uid
), s AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(removed_words, 0) AS removed_words FROM b LEFT JOIN r USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN x USING (uid)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
  AND n_words - removed_words >= {MIN_WORDS} AND 100 * (n_words - removed_words) >= {LEFT} * n_words AS kept FROM s
"""
