"""Line dedup across documents, in DataFrame operations only.

Hashes of line keys are range-partitioned and sorted by hash, document and position within each partition; a
window over them in that order tells each line the first occurrence of its key, which owns it. What comes out is not text but a
compressed keep bitmap per document: words of 63 lines, one bit for each line that stays, in order, without the words
that keep all their lines; documents that keep every line have none. Bitmaps are joined to the documents once.

Keys that hold more than one line in ``HOT_SHARE`` of all, or more than ``HOT_LINES`` however many there are, are found by a map-side
combined count before, with their owner, and their lines are salted: a group of the window holds about as many lines as that at most, whatever the
corpus. The table of these keys is broadcast if a count shows it to be small, else joined by a shuffle whose skewed side adaptive execution splits.

Defined results: a null text is one empty line; documents with a null id keep all their lines and own none;
repeated rows (same id, same text) get the same result, and rows with one id and different texts each keep their own
positions; texts of any length are split whole; an empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LIGHT, WS, materialize, texts

MIN_CHARS = 10
HOT_SHARE, HOT_LINES = 2000, 100_000
BITS = 63
ALL = (1 << BITS) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space of the contract stripped at both ends, A-Z lower-cased. lower() does it for ASCII alone, and faster."""
    key = F.btrim(line, F.lit(WS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (hash of the text), pos and the 128-bit hash h1, h2 of each line's key of at least min_chars code points."""
    # short lines drop out before trimming and hashing: a key is never longer than its line
    lines = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.octet_length("line") >= min_chars)
    keys = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, n_dropped, keeps): for each document with lines to drop, the words (word, bits) of its bitmap that lack a bit, in order."""
    spark = rows.sparkSession
    keys = materialize(keyed_lines(rows, min_chars))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    most = float(min(HOT_LINES, max(keys.count() / HOT_SHARE, 50)))
    hot = materialize(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where(F.col("n") > most))
    # at most HOT_SHARE keys in a small corpus, one for each HOT_LINES lines in a large one
    few = F.broadcast(hot) if hot.count() <= LIGHT else hot
    salted = keys.join(few, ["h1", "h2"], "left").withColumn("salt", F.when(F.col("owner").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / most))))
    ranged = salted.repartitionByRange(parts, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    first = F.first("doc_id").over(Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dropped = ranged.select("doc_id", "th", "pos", F.coalesce("owner", first).alias("keeper")).where("doc_id != keeper")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(BITS)).cast("int"))
    words = dropped.groupBy("doc_id", "th", F.expr(f"pos div {BITS}").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc_id", "th").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.lit(ALL).bitwiseXOR(F.col("gone")).alias("bits")))).alias("keeps"))


def dense(keeps: Column) -> Column:
    """All words up to the last one that lacks a bit, in time linear in their number."""
    before = lambda i: F.coalesce(F.get(keeps, i - 1)["word"], F.lit(-1))
    return F.flatten(F.transform(keeps, lambda x, i: F.concat(F.array_repeat(F.lit(ALL), x["word"] - before(i) - 1), F.array(x["bits"]))))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, keeps (bitmap words, null if every line stays) and the text that is kept.

    Columns in ``keep``, whatever their names, come along in a struct ``row``.
    """
    own = [F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []
    rows = docs.select(*own, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    maps = keep_bitmaps(texts(docs, id_col, text_col), min_chars).select(F.col("doc_id").alias("of"), "th", "n_dropped", "keeps")
    both = rows.join(maps, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("th")), "left")
    stays = lambda words, i: F.getbit(F.coalesce(F.get(words, (i / BITS).cast("int")), F.lit(ALL)), F.pmod(i, F.lit(BITS))) == 1
    # the outer transform holds the bitmap, so that it is unpacked once and not for every line
    shorter = F.get(F.transform(F.array(dense(F.col("keeps"))), lambda words: F.array_join(F.filter(_lines(F.col("text")), lambda _, i: stays(words, i)), "\n")), F.lit(0))
    kept = F.when(F.col("keeps").isNull(), F.col("text")).otherwise(shorter)
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return both.select(*(["row"] if keep else []), "doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keeps", kept.alias("kept_text"))


ORACLE_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (
  select r, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
owners as (
  select k, min(doc_id) as keeper, count(distinct doc_id) as n from keyed where length(k) >= 10 group by k),
marked as (
  select keyed.*, coalesce(n >= 2 and doc_id <> keeper, false) as gone from keyed left join owners using (k))
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by r, doc_id
"""
