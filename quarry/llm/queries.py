"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import repair
from .decontam import contamination
from .lattice import score_texts
from .merkle import proof_digest, tampered_proofs
from .oracles import MORE_SQL
from .packing import pack, token_pieces
from .quality import judge
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import near_duplicates
from .sstable import read_tables, write_tables
from .substring import remove_repeats
from .tokens import tokenizer_path
from .toxicity import score_toxicity
from .urls import filter_urls


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "lm_score", "lm_threshold")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, keep=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, ["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op2_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = read_tables(write_tables(docs, tokenizer_path("word_bpe_49k.json"), end_id=2))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)
    packed = pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, ["doc_id"], digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    found = tampered_proofs(docs, keep=["doc_id"])
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sorted_tables, op3_packing, op4_quality_rules, op5_simhash, op6_secret_scan, op7_url_filter, op8_substring_dedup, op9_decontamination, op10_sharding, op11_conversation_repair, op12_merkle_manifest, op13_lm_scoring)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = MORE_SQL | {
    "op9_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
p as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') phrase
      from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) where len(w) > 0),
g as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') phrase
      from d, (select distinct n from p) k, unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n),
m as (select distinct doc_id, i, p.n, item_id from g join p using (phrase)),
h as (select doc_id, count(distinct i + j) n_hit from m, unnest(range(0, n)) t(j) group by 1),
s as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) items from m group by 1),
q as (select doc_id, unnest(w) term, generate_subscripts(w, 1) pos from d),
u as (select distinct phrase, n, unnest(string_split(phrase, ' ')) term, generate_subscripts(string_split(phrase, ' '), 1) o from p),
f as (select term, count(*) df from q group by 1),
r as (select phrase, n, arg_min(term, (df, o)) term from u join f using (term) group by 1, 2 having count(*) = n),
a as (select phrase, n, doc_id, pos from r join q using (term)),
z as (select distinct phrase, doc_id from (
      select phrase, n, a.doc_id, a.pos from a join u using (phrase, n) join q on q.doc_id = a.doc_id and q.term = u.term and abs(q.pos - a.pos) <= 16
      group by 1, 2, 3, 4 having count(distinct o) = n)),
e as (select doc_id, count(distinct item_id) n_near from z join p using (phrase) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0)::bigint n_near_items
from d left join h using (doc_id) left join s using (doc_id) left join e using (doc_id)""",
    "op8_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') s from d, unnest(range(1, len(w) - 18)) t(i) where len(w) >= 20),
f as (select doc_id, i, row_number() over (partition by s order by doc_id, i) r from g),
c as (select distinct doc_id, i + j p from f, unnest(range(0, 20)) t(j) where r > 1),
o as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
k as (select doc_id, string_agg(word, ' ' order by p) kept, count(*) n from o anti join c using (doc_id, p) group by 1)
select doc_id, len(w)::bigint n_words, len(w)::bigint - coalesce(n, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join k using (doc_id)""",
}
