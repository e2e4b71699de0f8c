"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sqlchecks
from .common import cut, read, scratch

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import lookup, unkeyed, write_shards

    docs = read(spark, sf_dir, "documents")
    shards = write_shards(docs, scratch(spark, "tokens"), tokenizer_path())
    return lookup(docs, shards).unionByName(unkeyed(shards))


def _rot(page_id: int, raw: bytes) -> bytes:
    """Damage that the audit is to find: a byte of every 97th page is flipped."""
    if page_id % 97 != 13:
        return raw
    at = len(raw) // 2
    return raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]


def op3_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files, a damaged replica, and where the audit finds it damaged."""
    from pyspark.sql import functions as F

    from .fixity import copy_files, differences, digests, store, tree

    first, second = scratch(spark, "warc"), scratch(spark, "warc")
    index = store(read(spark, sf_dir, "pages"), first)
    copy_files(index, first, second, _rot).agg(F.sum("records")).collect()
    found = differences(tree(digests(index, first)), tree(digests(index, second)))
    at = index.select("file", F.col("number").alias("node"), "page_id", "length")
    return found.join(at, ["file", "node"]).select("page_id", (F.col("hash_a") != F.col("hash_b")).alias("differs"), (F.col("high") - F.col("low") == F.col("length")).alias("range_fits"))


def op4_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .onepermutation import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge(read(spark, sf_dir, "pages"), rules)


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudolikelihood import scores

    return scores(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import classes

    return classes(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards_by_bytes

    return shards_by_bytes(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import grafted, sequences, trie

    return trie(grafted(cut(sequences(read(spark, sf_dir, "conversations")))))


def op12_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_copies

    return near_copies(read(spark, sf_dir, "embeddings"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    return repair(damaged(read(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rule_quality, op2_token_index, op3_fixity_audit, op4_one_permutation, op5_url_rules,
        op6_pseudo_likelihood, op7_packing, op8_simhash_windows, op9_jaccard_join, op10_byte_shards,
        op11_prefix_trie, op12_pivot_index, op13_structure_repair,
    )
}

ORACLE = {
    "op10_byte_shards": sqlchecks.BYTE_SHARDS,
    "op11_prefix_trie": sqlchecks.PREFIX_TRIE,
    "op12_pivot_index": sqlchecks.PIVOT_INDEX,
    "op13_structure_repair": sqlchecks.STRUCTURE_REPAIR,
    "op3_fixity_audit": "select page_id, true as differs, true as range_fits from pages where page_id % 97 = 13",
    "op5_url_rules": """
with cut as (
    select page_id,
        case when url like '%://%' then translate(regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when url like '%://%' then regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
    from pages
), rules(rhost, rpath, action) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
    select page_id, host, path, rhost || rpath as rule, action
    from cut left join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
), best as (
    select *, row_number() over (partition by page_id order by length(rule) desc nulls last) as place from fits
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from best where place = 1
""",
}
