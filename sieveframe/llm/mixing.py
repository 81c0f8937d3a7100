"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

1. Sizes in words, once per document; everything after works on (doc_id, hash of the text, source, size) alone.
2. Targets: sources in code point order (null last) get the weights in turn; together they take ``share`` of all words;
   a target stops at ``cap`` times its source, the excess goes to the others by weight. In closed form: with sources
   sorted by size / weight, the first k are at their cap for the smallest k that lets the rest stay below theirs.
3. Words go first to sources by target. Each source's words are cut into shards of about ``SHARD_WORDS`` (by a seeded hash of the
   document) and these into blocks of equal tokens: ``SOURCE_BLOCKS`` to a source, of 1 to ``BLOCK_WORDS`` words. Blocks go to
   a source's shards by size. Both times each seat goes to the highest quotient v / (2 s + 1). Only quotients that can be near the last seat are made: with n parties, N seats and a share p of
   the votes, the seats are within p * n / 2 + 1 of p * N, so all candidates together are a few for each party. They are ranked by a
   range-partitioned sort: no task holds all sources, or all shards of one.
4. A shard's quota of q of its n blocks takes every block q div n times and q mod n more, chosen by a seeded hash.

A document's words lie in one run in its shard's order; ``taken`` counts its words in the chosen blocks with repeats. It
is at most cap times its size. The same input and seed give the same result, however it is partitioned. A shard's rows are sorted in
one task; it holds about SHARD_WORDS words, more only if one document does.

Defined results: a null text has no words; documents without words take none; a null source is a source of its own; rows
with a null or repeated id count each for themselves, and so do equal rows, which are numbered and dealt to shards one by one; without any
words all targets are 0; texts of any length are counted whole; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LIGHT, WS, in_order, join_groups, materialize

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
SHARD_WORDS = 250_000
BLOCK_WORDS = SOURCE_BLOCKS = 4096


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources(source, source_size) with rank and target."""
    ranked = in_order(sources, [F.col("source").isNull(), F.col("source")]).withColumnRenamed("__rank", "rank")
    weighted = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    levels = in_order(weighted, [F.col("source_size") / F.col("w"), F.col("rank")], ("source_size", "w"))
    all_ = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    # level: words per unit of weight if all sources before this one stop at their cap and no other does
    level = (F.lit(share * all_["size"]) - F.lit(cap) * (F.col("__to_source_size") - F.col("source_size"))) / (F.lit(all_["w"]) - F.col("__to_w") + F.col("w"))
    water = levels.withColumn("level", level).where(F.col("level") * F.col("w") <= F.lit(cap) * F.col("source_size")).agg(F.min(F.struct("__rank", "level")).alias("least")).first()["least"]
    most = F.lit(cap) * F.col("source_size")
    return weighted.select("source", "source_size", "rank", (F.least(F.lit(float(water["level"])) * F.col("w"), most) if water else most).cast("double").alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """parties with ``quota``: within each group, ``seats`` go to the highest quotients votes / (2 s + 1), ties by key.

    Groups and keys aren't null; a group is given by its columns, a party by those and its key.
    """
    own = [k for k in key if k not in group]
    wide = join_groups(parties, parties.groupBy(*group).agg(F.sum(votes).alias("__total"), F.count("*").alias("__n")), group)
    p = F.when(F.col("__total") > 0, F.col(votes) / F.col("__total")).otherwise(F.lit(0.0))
    wide = wide.withColumn("__p", p).withColumn("__low", F.greatest(F.lit(0).cast("long"), F.floor(p * F.col(seats) - p * F.col("__n") / 2 - 1)))
    wide = materialize(wide.withColumn("__high", F.ceil(F.col("__p") * F.col(seats) + F.col("__p") * F.col("__n") / 2 + 1)))
    tries = wide.where(F.col(votes) > 0).select(*group, *own, votes, F.explode(F.sequence("__low", "__high")).alias("__s"))
    ranked = in_order(tries, [*[F.col(g) for g in group], (F.col(votes) / (2 * F.col("__s") + 1)).desc(), *[F.col(k) for k in key], F.col("__s")])
    spare = wide.groupBy(*group).agg((F.max(seats) - F.sum("__low")).alias("__spare")).join(ranked.groupBy(*group).agg(F.min("__rank").alias("__first")), group)
    won = join_groups(ranked, spare, group).where(F.col("__rank") - F.col("__first") < F.col("__spare")).groupBy(*group, *own).agg(F.count("*").alias("__won"))
    return wide.join(won, [*group, *own], "left").select(*parties.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).cast("long").alias("quota"))


def _each(sizes: DataFrame) -> DataFrame:
    """One row per row of sizes with ``copy``, its number among equal rows: equal rows are counted and made anew, a few thousand at a time."""
    step = 4096
    counted = sizes.groupBy(*sizes.columns).agg(F.count("*").alias("__n"))
    parts = counted.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / step))))
    return parts.withColumn("copy", F.explode(F.sequence(F.col("__k") * step, F.least(F.col("__n"), (F.col("__k") + 1) * step) - 1))).drop("__n", "__k")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, full (times it is taken whole), pieces and taken.

    ``pieces`` holds (start, words) runs of words, from 0, that are taken once more; null if there are none. Light columns in
    ``keep`` come along.
    """
    sizes = docs.select(*[F.col(c) for c in keep], F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("th"), n_words(F.col(text_col)).alias("size"))
    sizes = materialize(_each(sizes))
    per = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    want = per.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("want")).first()["want"]
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK_WORDS).cast("long"), F.floor(F.col("source_size") / SOURCE_BLOCKS)))
    seats = per.withColumn("__all", F.lit(0)).withColumn("__seats", F.lit(round(want)).cast("long"))
    quotas = apportion(seats, ["__all"], ["rank"], "target", "__seats").withColumn("block", block)
    quotas = materialize(quotas.select(F.col("source").alias("__source"), "rank", "source_size", "target", "block", F.round(F.col("quota") / F.col("block")).cast("long").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards")))
    few = F.broadcast(quotas) if quotas.count() <= LIGHT else quotas
    dealt = sizes.join(few, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("shard", F.pmod(seeded(seed, F.col("doc_id"), F.col("th"), F.col("copy")), F.col("n_shards")))
    worded = dealt.where("size > 0")
    shards = materialize(worded.groupBy("rank", "shard", "source_quota", "block").agg(F.sum("size").alias("words")))
    filled = apportion(shards, ["rank"], ["shard"], "words", "source_quota")
    n = F.ceil(F.col("words") / F.col("block"))
    filled = filled.withColumn("n_blocks", n).withColumn("quota", F.least("quota", F.floor(F.lit(cap) * n)))
    filled = materialize(filled.select("rank", "shard", "n_blocks", F.floor(F.col("quota") / F.col("n_blocks")).alias("full"), F.pmod("quota", "n_blocks").alias("more")))
    blocks = filled.where("more > 0").select("rank", "shard", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    chosen = blocks.withColumn("r", F.row_number().over(Window.partitionBy("rank", "shard").orderBy(seeded(seed + 1, F.col("rank"), F.col("shard"), F.col("block")), "block"))).where("r <= more").groupBy("rank", "shard").agg(F.array_sort(F.collect_list("block")).alias("chosen"))
    fates = materialize(filled.join(chosen, ["rank", "shard"], "left").select("rank", "shard", "full", "chosen"))
    line = Window.partitionBy("rank", "shard").orderBy(seeded(seed + 2, F.col("doc_id"), F.col("th"), F.col("copy")), "doc_id", "th", "copy", *keep)
    placed = worded.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = placed.join(fates, ["rank", "shard"], "left").withColumn("start", F.col("end") - F.col("size"))
    b = F.col("block")
    # the chosen blocks that meet the run of words from start to end, by their numbers' places in the sorted list
    touched = F.when(F.col("chosen").isNotNull(), F.filter("chosen", lambda k: (k * b < F.col("end")) & ((k + 1) * b > F.col("start"))))
    pieces = F.transform(touched, lambda k: F.struct((F.greatest(k * b, F.col("start")) - F.col("start")).alias("start"), (F.least((k + 1) * b, F.col("end")) - F.greatest(k * b, F.col("start"))).alias("words")))
    out = out.withColumn("pieces", pieces)
    extra = F.coalesce(F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
    light = [*keep, "doc_id", "source", "size", "source_size", "target"]
    taking = out.select(*light, F.col("full").cast("long").alias("full"), F.when(F.size("pieces") > 0, F.col("pieces")).alias("pieces"), (F.col("full") * F.col("size") + extra).cast("long").alias("taken"))
    none = dealt.where("size = 0").select(*light, F.lit(0).cast("long").alias("full"), F.lit(None).cast(taking.schema["pieces"].dataType).alias("pieces"), F.lit(0).cast("long").alias("taken"))
    return taking.unionByName(none)


def mix(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """The mixture itself: rows like those of docs (doc_id, text, lang, source, n_chars), as often as the plan takes them.

    A text taken whole is repeated as it is; the words of its chosen blocks make one more row, in their order. Rows that are equal in
    every column have each their share in the plan; they meet its rows as one text, which is then taken for all of them.
    """
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = whole.select("row", "row.doc_id", "row.text", "row.source", F.xxhash64("row").alias("key"))
    fates = plan(rows, seed=seed, keep=("key",), **options).where("taken > 0").select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "full", "pieces")
    # the text travels once, within the row
    both = rows.select("row", "doc_id", "key").dropDuplicates(["doc_id", "key"]).join(fates, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
    words = F.regexp_extract_all("row.text", F.lit("([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)"), 1)
    # the outer transform holds the words, so that they are split once and not for every piece
    joined = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(w, (p["start"] + 1).cast("int"), p["words"].cast("int")))), ""))
    part = F.btrim(F.get(joined, F.lit(0)), F.lit(WS))
    taken = F.concat(F.array_repeat("row.text", F.col("full").cast("int")), F.when(F.col("pieces").isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>")))
    own = {"text": F.col("one"), "n_chars": F.char_length("one").cast("long")}
    return both.select("row", F.explode(taken).alias("one")).select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
