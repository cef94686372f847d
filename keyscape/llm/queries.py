"""The queries of this package, one for each operator, and their reference SQL."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.llm import (
    decontamination,
    digest_index,
    fill_middle,
    filter_audit,
    line_dedup,
    mixing,
    ngram_join,
    quality_crf,
    sharding,
    suffix_tree,
    token_counts,
    token_files,
    weighted_sampling,
)

TOKEN_LIMIT = 512
SHARDS = 40
END_ID = 1
INDEX_BATCHES = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, for
    sessions whose driver found it on a path of its own; and, unless the session has
    its own limit, send them batches of ``ARROW_BYTES``, so that JVM and worker hold
    little of long texts at a time."""
    if spark.conf.get(ARROW_BATCH, None) in (None, "64MB", "64m", "67108864b", "67108864"):
        spark.conf.set(ARROW_BATCH, f"{ARROW_BYTES}b")
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(
        _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_crf.Crf:
    """The line classifier learnt from the labels that are not held out."""
    return quality_crf.train(docs, labels, ~_held_out(3, 1))


def _held_out(parts: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", _held_out(3, 1).alias("held_out"),
        quality_crf.score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(
        _table(spark, sf_dir, "documents"), ~_held_out(7, 2))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.tempered_weights(docs)).drop("h")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark, "token-files")
    token_files.write_token_files(
        _table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), END_ID,
        folds=True)
    return token_files.read_token_files(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated(_table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda r: F.concat_ws(
        ":", r["start"].cast("string"), r["end"].cast("string"), r["keep_id"].cast("string"),
        r["keep_unit"].cast("string")))
    return out.select(
        "doc_id", F.col("n_units").cast("bigint").alias("n_units"),
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(spans, ",").alias("removed_spans"),
        F.array_join(F.array_distinct(F.transform("removed", lambda r: r["keep_id"])), ",").alias(
            "kept_in"),
        F.sha2("text", 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(
        _table(spark, sf_dir, "documents"), digest_index.DigestIndex(spark), INDEX_BATCHES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality, op3_suffix_tree, op4_ngram_jaccard, op5_mix_sources, op6_shards, op7_token_files, op8_line_dedup,
              op9_exact_dedup, op10_decontamination, op11_filter_audit, op12_weighted_sampling,
              op13_fill_middle)
}

SQL = {
    "op4_ngram_jaccard": r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
    select distinct doc_id, array_to_string(w[p:p + 4], ' ') as g
    from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as p
          from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as k
    from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
    select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * k >= 80 * (x.n + y.n - k)),
reach as (
    select doc_id, doc_id as other from documents
    union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id
from reach left join sizes using (doc_id) group by doc_id
""",
    "op8_line_dedup": r"""
with pieces as (
    select doc_id, k, piece, length(piece) as chars,
        regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as w
    from (select doc_id, u.k as k, u.piece as piece from (
        select doc_id, unnest(list_transform(string_split(
            regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)),
            lambda x, k: {'k': k, 'piece': x})) as u from documents))
    where piece <> ''),
grouped as (
    select *, coalesce(sum(case when len(w) >= 5 or suffix(piece, chr(10)) then 1 else 0 end) over (
        partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as unit
    from pieces),
units as (
    select doc_id, unit, string_agg(piece, '' order by k) as u, sum(chars)::bigint as chars,
        flatten(list(w order by k)) as w from grouped group by doc_id, unit),
placed as (
    select *, len(w) as n, array_to_string(w, ' ') as norm, coalesce(sum(chars) over (partition by doc_id
        order by unit rows between unbounded preceding and 1 preceding), 0)::bigint as first from units),
ranked as (
    select *, row_number() over r as k, first_value(doc_id) over r as keep_id,
        first_value(unit) over r as keep_unit, row_number() over (partition by doc_id order by unit) as p
    from placed where n >= 5
    window r as (partition by norm order by doc_id, unit)),
runs as (
    select *, p - row_number() over (partition by doc_id order by unit) as run from ranked where k > 1),
gone as (
    select * from (select *, sum(n) over (partition by doc_id, run) as words from runs) where words >= 30),
kept as (
    select doc_id, string_agg(u, '' order by unit) as text from placed
    where (doc_id, unit) not in (select (doc_id, unit) from gone) group by doc_id),
spans as (
    select doc_id, count(*) as n, string_agg(concat_ws(':', first, first + chars, keep_id,
        keep_unit), ',' order by unit) as spans, list(keep_id order by unit) as ids
    from gone group by doc_id),
counted as (select doc_id, count(*) as n_units from units group by doc_id)
select d.doc_id, coalesce(c.n_units, 0)::bigint as n_units,
    coalesce(s.n, 0)::bigint as n_removed, coalesce(s.spans, '') as removed_spans,
    coalesce(array_to_string(list_transform(list_filter(list_zip(s.ids, generate_series(1, s.n)),
        lambda x: list_position(s.ids, x[1]) = x[2]), lambda x: x[1]), ','), '') as kept_in,
    case when d.text is not null then sha256(coalesce(k.text, '')) end as text_sha256
from documents d left join kept k using (doc_id) left join spans s using (doc_id)
    left join counted c using (doc_id)
""",
    "op9_exact_dedup": r"""
with e as (
    select doc_id, length(coalesce(text, '')) as n,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
    from documents),
r as (
    select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
        count(*) over (partition by text_sha256) as group_size from e)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r
""",
    "op10_decontamination": r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
    select distinct item_id, array_to_string(w[p:p + 9], ' ') as window, least(len(w), 10) as n
    from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as p
          from items where len(w) > 0)),
lengths as (select distinct n from windows),
places as (
    select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as p
    from words, lengths where len(w) >= n),
hits as (
    select doc_id, p, x.n, item_id from places d
    join windows x on x.n = d.n and x.window = array_to_string(w[p:p + d.n - 1], ' ')),
hit_words as (
    select doc_id, count(distinct q) as n_hit
    from (select doc_id, unnest(generate_series(p, p + n - 1)) as q from hits) group by doc_id),
hit_items as (
    select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
    from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
    coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
""",
    "op11_filter_audit": r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (
    select doc_id, part,
        case when len(w) < 100 then 1 else 0 end
        + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
        + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end
        + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
        + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask from d),
l as (
    select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
c as (
    select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
    from m left join l using (doc_id) group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(f, bit)),
o as (
    select a.f || b.f || c.f || d.f || e.f as filter_order
    from f a, f b, f c, f d, f e
    where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (
    select filter_order, x.step, f.bit, coalesce((select sum(g.bit) from f g
        where position(g.f in filter_order) < x.step), 0)::integer as earlier
    from o, generate_series(1, 5) as x(step), f where f.f = substr(filter_order, x.step, 1))
select part, filter_order, step::integer as step,
    sum(case when mask & (bit | earlier) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & bit <> 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit <> 0 and mask & earlier <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit <> 0 and mask & earlier = 0 and good then n else 0 end)::bigint as good_lost,
    sum(case when mask & bit <> 0 and mask & earlier = 0 and toxic then n else 0 end)::bigint as toxic_lost,
    sum(case when mask & bit <> 0 then n * 120 // bit_count(mask) else 0 end)::bigint as shapley
from c, s group by part, filter_order, step
""",
    "op13_fill_middle": r"""
with h as (
    select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as x,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
    from documents),
k as (
    select doc_id, t, u, len(u) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2,
        ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from h),
c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
            or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from k),
p as (
    select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle,
        array_to_string(u[b + 1:], '') as suffix from c)
select doc_id, n::bigint as n, form,
    case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
    case when form <> 'plain' then length(middle) end::bigint as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(t) as restored_sha256
from p
""",
}
