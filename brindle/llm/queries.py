"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    exact_dedup,
    pii,
    quality,
    sentencepiece_bpe,
    sharding,
    simhash,
    substring_dedup,
    transcripts,
    url_rules,
)
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHARDS = [1.0] * 40
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.recover(table(spark, sf_dir, "conversations"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, RULES))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_exact_dedup,
        op3_byte_bpe,
        op4_chat_format,
        op5_sharding,
        op6_simhash,
        op7_url_filter,
        op8_decontaminate,
        op9_quality,
        op10_substring_dedup,
    )
}

WHITE = r"[\x20\x09-\x0D]+"
SQL = {
    "op2_exact_dedup": f"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g') as t from documents),
        g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)""",
    "op7_url_filter": """
        with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
        h as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
              regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from u),
        rules(rhost, rpath, rverdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
              ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(rverdict, length(rhost || rpath)) as v
              from h join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict from h left join m using (page_id)""",
    "op8_decontaminate": """
        with recursive w(id, item, words) as (
            select 'd' || doc_id, false, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') from documents
            union all
            select cast(item_id as varchar), true, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') from benchmark),
        b as (select distinct id as item_id, least(len(words), 13) as n,
              unnest([array_to_string(words[i + 1 : i + least(len(words), 13)], ' ') for i in range(0, greatest(len(words) - 13, 0) + 1)]) as win
              from w where item and len(words) > 0),
        lens as (select distinct n from b),
        spots as (select id, n, unnest(range(0, len(words) - n + 1)) as i, words from w, lens where not item and len(words) >= n),
        hits as (select id, i, spots.n, item_id from spots join b on spots.n = b.n and array_to_string(words[i + 1 : i + spots.n], ' ') = win),
        cover as (select id, count(distinct k) as n_hit from (select id, unnest(range(i, i + n)) as k from hits) group by id),
        items as (select id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed
                  from (select distinct id, item_id from hits) group by id)
        select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(listed, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
        from documents join w on w.id = 'd' || doc_id and not item left join cover using (id) left join items using (id)""",
    "op10_substring_dedup": f"""
        with w as (select doc_id, row_number() over () as u, list_filter(string_split_regex(coalesce(text, ''), '{WHITE}'), lambda x: x <> '') as words
                   from documents),
        k as (select u, i, array_to_string(words[i + 1 : i + 35], ' ') as win
              from (select u, words, unnest(range(0, len(words) - 34)) as i from w where len(words) >= 35)),
        twice as (select win from k group by win having count(*) > 1),
        gone as (select u, list(p) as places, count(*) as n from
                 (select distinct u, unnest(range(i, i + 35)) as p from k join twice using (win)) group by u)
        select doc_id, len(words) as n_words, coalesce(n, 0) as n_removed,
               sha256(array_to_string(case when n is null then words else list_filter(words, lambda x, i: not list_contains(places, i - 1)) end, ' ')) as kept_sha256
        from w left join gone using (u)""",
}
