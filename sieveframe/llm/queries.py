"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, html_text, licenses, linededup, mixing, ngram_join, pii, quality, sentencepiece, toxicity
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(read(spark, sf_dir, "documents")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids, decoded_sha256 and whether decoding gives the text again."""
    out = sentencepiece.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=("text",))
    return out.select("doc_id", "n_tokens", "n_bytes", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rate_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


# Those columns of four operators that SQL can say, for comparison with it.
def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.coalesce("last_word", F.lit(-1)).alias("last_word"), "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).drop("kept", "score")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def _places(label: str, phrase: str) -> str:
    here = " and ".join(f"a[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_transform(list_filter(range(1, len(a) + 1), lambda i: {here}), lambda i: struct_pack(at := i - 1, label := '{label}'))"


LICENSE_SQL = rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as a from documents),
p as (select r, doc_id, len(a) as n_words, list_concat({", ".join(_places(label, phrase) for label, phrase in PHRASES.items())}) as p from w)
select doc_id, n_words, len(p) as n_base, coalesce(list_min(list_transform(p, lambda x: x.at)), -1) as first_word, coalesce(list_max(list_transform(p, lambda x: x.at)), -1) as last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') as base_labels from p
"""

QUALITY_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as a from d),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
dups as (select r, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
u as (select r, unnest(a) as x, unnest(range(1, len(a) + 1)) as i from w),
g as (select r, i, x, lead(x) over (partition by r order by i) as y, lead(x, 2) over (partition by r order by i) as z from u),
h as (select r, i, count(*) over (partition by r, x, y, z) as n from g where z is not null),
m as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from h where n > 1) x group by r)
select doc_id, len(a) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dups.n, 0) as n_dup_lines, coalesce(m.n, 0) as n_repeat_words, len(a) < 50 or 100 * coalesce(m.n, 0) > 50 * len(a) as base_failed
from d join w using (r) left join dups using (r) left join m using (r)
"""

PII_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as emails, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') as ips,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) as phones from d)
select doc_id, len(emails) as n_email, len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: try_cast(p as hugeint))) <= 255)) as n_ip,
  len(list_filter(cards, lambda c: length(c) between 13 and 19 and list_sum(list_transform(range(1, length(c) + 1), lambda i: case when (length(c) - i) % 2 = 0 then cast(substr(c, i, 1) as int) else (2 * cast(substr(c, i, 1) as int)) // 10 + (2 * cast(substr(c, i, 1) as int)) % 10 end)) % 10 = 0)) as n_card,
  len(list_filter(phones, lambda n: n between 9 and 15)) as n_phone from f
"""

MIXING_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, cast(sum(size) as bigint) as z from d group by source),
k as (select *, [3.0::double, 1, 2][((row_number() over (order by source nulls last) - 1) % 3) + 1] as w from s),
l as (select *, row_number() over (order by z / w, source) as place, (1.5 * sum(z) over () - 2 * (sum(z) over (order by z / w, source) - z)) / (sum(w) over () - sum(w) over (order by z / w, source) + w) as level from k),
v as (select arg_min(level, place) as level from l where level * w <= 2 * z)
select doc_id, size, z as source_size, round(cast(coalesce(least(v.level * w, 2 * z), 2 * z) as double), 3) as target from d join k on d.source is not distinct from k.source left join v on true
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = (license_base, quality_base, pii_base, mixing_targets)
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {f.__name__: f for f in more}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": linededup.ORACLE_SQL, "license_base": LICENSE_SQL, "quality_base": QUALITY_SQL, "pii_base": PII_SQL, "mixing_targets": MIXING_SQL}
