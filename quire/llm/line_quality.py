"""Line-first cleaning with DataFrame expressions only.

Each line is judged by itself: a line of running text ends with terminal punctuation and is not
crowded with exclamation marks or symbols; a navigation line is a row of separated entries; a
boilerplate line is a short one with a licence, rights or site phrase. Lines that fail are
removed, then documents that lose too much of their text are rejected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ASCII_SPACE, table

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|•·»›"
#: What a line of running text may end with.
TERMINAL = ".!?…。！？:;\"'”’»)]"
#: Phrases of licence, rights and site lines (they count in short lines only).
BOILERPLATE = ["all rights reserved", "licensed under", "released under", "public license", "creative commons", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "subscribe to our", "copyright", "©", "powered by", "click here", "read more", "back to top", "skip to content"]
BOILERPLATE_CHARS = 200
MAX_LOST = 0.5


def split_words(c: Column) -> Column:
    trimmed = F.btrim(c, F.lit(ASCII_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def removed(c: Column, chars: str) -> Column:
    """How many characters of ``chars`` the text holds."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def line_fails(line: Column) -> Column:
    """True for lines that the punctuation, navigation or boilerplate rules remove.

    Words of a line are taken as its white space characters plus one. The cheap tests come first.
    """
    words = removed(line, ASCII_SPACE) + 1
    ends = F.instr(F.lit(TERMINAL), F.right(F.rtrim(line, F.lit(ASCII_SPACE)), F.lit(1))) > 0
    crowded = line.contains("!") & (removed(line, "!") * 10 > words * 5) & (words > 2)
    symbols = line.rlike("[#*$%&|<>]") & (removed(line, SYMBOLS) * 10 > words * 5)
    navigation = line.rlike("[|•·»›]") & (removed(line, SEPARATORS) >= 2) & (removed(line, SEPARATORS) * 5 >= words)
    boilerplate = (F.length(line) < BOILERPLATE_CHARS) & F.exists(F.array(F.lower(line)), lambda low: reduce(or_, [low.contains(x) for x in BOILERPLATE]))
    return ~ends | crowded | symbols | navigation | boilerplate


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """The id and these columns, each computed once.

    Array lambdas read their array many times; were the optimiser to put the array's expression
    in its place, it would be computed anew for each element. A generator of one row stops that.
    """
    return df.select("doc_id", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("z")).select("doc_id", "z.*")


def clean(docs: DataFrame, max_lost: float = MAX_LOST, text: str = "text") -> DataFrame:
    """Adds the base counts, the cleaned text, its share lost and the verdict to each document.

    Null and empty texts have counts of 0, fail the base rules and are not kept. Repeated rows and
    null ids stay as they are. All work is inside a row, so no key can be hot, and the memory needed
    is in proportion to the longest text. A window of three words is identified by its 64-bit
    hash within its own document.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    a = evaluated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t")), t=F.col("t"), words=split_words(F.col("t")), lines=F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0))
    a = evaluated(a, t=F.col("t"), lines=F.col("lines"), w=F.transform("words", lambda x: F.xxhash64(x)), word_chars=F.length(F.concat_ws("", "words")).cast("long"))
    windows = F.expr("case when size(w) > 2 then zip_with(slice(w, 1, size(w) - 2), zip_with(slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2), (b, c) -> xxhash64(b, c)), (a, bc) -> xxhash64(a, bc)) else cast(array() as array<bigint>) end")
    b = evaluated(a, t=F.col("t"), lines=F.col("lines"), n_words=F.size("w").cast("long"), word_chars=F.col("word_chars"), h=windows, good=F.filter("lines", lambda x: ~line_fails(x)))
    # the windows found twice or more: in hash order, those that equal the one before
    c = evaluated(b, t=F.col("t"), lines=F.col("lines"), n_words=F.col("n_words"), word_chars=F.col("word_chars"), good=F.col("good"), h=F.col("h"), s=F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")).otherwise(F.array().cast("array<bigint>")))
    d = evaluated(c, t=F.col("t"), lines=F.col("lines"), n_words=F.col("n_words"), word_chars=F.col("word_chars"), good=F.col("good"), h=F.col("h"), again=F.expr("array_distinct(filter(s, (x, k) -> x = get(s, k - 1)))"))
    # their places: by looking each window up in a short list, else by sorting windows with their places
    d = evaluated(d, t=F.col("t"), lines=F.col("lines"), n_words=F.col("n_words"), word_chars=F.col("word_chars"), good=F.col("good"), h=F.col("h"), again=F.col("again"), s=F.expr("case when size(again) > 24 then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end"))
    places = """case when size(again) = 0 then cast(array() as array<int>)
        when s is null then filter(transform(h, (x, i) -> case when array_contains(again, x) then i end), i -> i is not null)
        else sort_array(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h or x.h = get(s, k + 1).h), x -> x.i)) end"""
    c = evaluated(d, t=F.col("t"), lines=F.col("lines"), n_words=F.col("n_words"), word_chars=F.col("word_chars"), good=F.col("good"), p=F.expr(places))
    repeat = "coalesce(aggregate(transform(p, (x, k) -> least(3, get(p, k + 1) - x)), 0L, (acc, x) -> acc + x), 0L)"
    d = c.select(
        "doc_id",
        "n_words",
        "word_chars",
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat).alias("n_repeat_words"),
        F.concat_ws("\n", "good").alias("clean_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("good").cast("long").alias("n_good_lines"),
        F.length(F.concat_ws("", "lines")).cast("long").alias("line_chars"),
        F.length(F.concat_ws("", "good")).cast("long").alias("kept_chars"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("kept_chars") >= (1 - max_lost) * F.col("line_chars")))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents")).drop("clean_text")


def _sql_fails(x: str) -> str:
    def gone(chars):
        return f"(length({x}) - length(translate({x}, {chars}, '')))"

    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words, ends = f"({gone(space)} + 1)", TERMINAL.replace("'", "''")
    return f"""(instr('{ends}', right(rtrim({x}, {space}), 1)) = 0 OR ({gone("'!'")} * 10 > {words} * 5 AND {words} > 2) OR {gone(f"'{SYMBOLS}'")} * 10 > {words} * 5
      OR ({gone(f"'{SEPARATORS}'")} >= 2 AND {gone(f"'{SEPARATORS}'")} * 5 >= {words}) OR (length({x}) < {BOILERPLATE_CHARS} AND regexp_matches(lower({x}), '{'|'.join(BOILERPLATE)}')))"""


ORACLE = f"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM a),
u AS (SELECT r, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM u),
v AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM n WHERE c > 1) GROUP BY r),
d AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, lines,
             list_filter(lines, lambda x: NOT {_sql_fails("x")}) AS good FROM b LEFT JOIN v USING (r)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             length(array_to_string(good, '')) AS kept_chars, length(array_to_string(lines, '')) AS line_chars FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(len(good) AS BIGINT) AS n_good_lines, base_failed, CAST(kept_chars AS BIGINT) AS kept_chars,
       CAST(line_chars AS BIGINT) AS line_chars, NOT base_failed AND kept_chars >= {1 - MAX_LOST} * line_chars AS kept
FROM e
"""
