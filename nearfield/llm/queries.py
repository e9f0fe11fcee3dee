"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, chat, embed_dedup, hilbert, htmlblocks, lm_trie, mixing, quality, simhash, substring

SHARDS = 40


def tokenizer_path() -> str:
    """The word-BPE file: ``NEARFIELD_TOKENIZER`` names another one."""
    if named := os.environ.get("NEARFIELD_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.score_documents(table(spark, sf_dir, "documents"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.main_text(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = chat.probe(conversations, -1, [("user", PROBE), ("assistant", PROBE)])
    return chat.read_back(chat.format_turns(conversations.unionByName(probe)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_hilbert_sharding, op3_html_extraction, op4_substring_dedup, op5_source_mixing, op6_quality_rules, op7_bpe, op8_embedding_dedup, op9_simhash_dedup, op10_chat_formatting)
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The queries whose whole result DuckDB can express: windows as joined words, all pairs of vectors,
#: digests of ordered turns.  The others need XXH64, CRC-32, a trained model or BPE.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 12], chr(1)) as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
first as (select k, min(doc_id) as least from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from (select win.doc_id, win.i from win join first using (k) where win.doc_id > first.least)),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from word anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op8_embedding_dedup": """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v where len(e) > 0),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and a.norm > 0 and b.norm > 0 and list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r as (select vec_id, vec_id as c from embeddings union select p.b, r.c from r join p on p.a = r.vec_id),
l as (select a, count(*) as n from p group by a), m as (select vec_id, min(c) as c from r group by vec_id)
select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept from m left join l on a = vec_id""",
    "op10_chat_formatting": rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
e as (select *, len(regexp_replace(text, '<(\\*\|im_(start|end)\|>)', '<\\\1', 'g')) as escaped from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
sum(len('<|im_start|>') + len(role) + 1 + escaped + len('<|im_end|>') + 1)::bigint as formatted_chars from e group by conv_id""",
}
