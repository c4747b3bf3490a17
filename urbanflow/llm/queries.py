"""The registered query of each operator: it applies the operator to its whole table and derives digest columns."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.llm import (bpe, counts, divergence, exact, manifest, mixing, packing, passages, pii, quality, rules,
                           simhash, toxicity)
from urbanflow.llm.common import documents, labels
from urbanflow.session import ensure_checkpoint_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Score from which a document counts as toxic.
TOXIC = 0.5


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).drop("text")
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    text = exact.lower_ascii(F.coalesce("text", F.lit("")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.sha2(text, 256).alias("text_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.score(docs, quality.train(docs, labels(spark, sf_dir)))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/packed-{uuid.uuid4().hex}"
    packing.write(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER, folder)
    found = packing.read(spark, folder)
    return found.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    numbers = [F.expr(f"cast(size(filter(base_spans, s -> startswith(s, '{kind}:'))) as bigint)").alias(f"n_{kind}")
               for kind in pii.BASE]
    return found.select("doc_id", *numbers, F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in manifest.FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = [F.when(tampered, f + 1).otherwise(f) if c == "n_chars" else f for c, f in zip(manifest.FIELDS, fields)]
    found = manifest.manifest(docs, fields, claimed)
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("proof")).alias("proof_sha256"),
                        "folded_root", "verified")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= TOXIC).cast("int").alias("predicted"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_exact_dedup": op2_exact_dedup, "op3_quality": op3_quality,
           "op4_packed_ids": op4_packed_ids, "op5_token_counts": op5_token_counts, "op6_simhash": op6_simhash,
           "op7_personal_data": op7_personal_data, "op8_passages": op8_passages,
           "op9_quality_rules": op9_quality_rules, "op10_source_mix": op10_source_mix, "op11_divergence": op11_divergence,
           "op12_manifest": op12_manifest,
           "op13_toxicity": op13_toxicity}

#: CRC-32 of a decimal number's text, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _leaf_sql(n_chars: str = "n_chars") -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


SQL = {"op2_exact_dedup": """
    with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
               from documents)
    select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from d""",
       "op11_divergence": f"""
    with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t,
                      row_number() over () as r from documents),
    w as materialized (select lang, source, r, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
    k as materialized (select lang, term, count(*)::hugeint as total from w group by lang, term having count(distinct r) >= 30),
    v as (select lang, count(*)::hugeint as v, sum(total)::hugeint as n from k group by lang),
    g as materialized (select distinct lang, source from d),
    c as materialized (select lang, source, term, count(*)::hugeint as c from w semi join k using (lang, term) group by all),
    gn as (select lang, source, sum(c)::hugeint as n from c group by all),
    p as materialized (
      select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (coalesce(gn.n, 0) + 5 * v.v) as p,
             1 + (1000000000 * (k.total + 5)) // (v.n + 5 * v.v) as q
      from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join gn using (lang, source)),
    s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
             from g a join g b on a.lang = b.lang and a.source <> b.source
             left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    term as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where c > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
               from (select * from pair union all select * from term))
    select * from ranked where part = 'pair' or rank <= 50""",
       "op12_manifest": f"""
    with recursive d as (
      select doc_id, lang, {_leaf_sql()} as leaf, {_leaf_sql(f"n_chars + case when {CRC32} % 7 = 0 then 1 else 0 end")} as claim,
             row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n
      from documents),
    nodes(lang, lvl, pos, n, h) as (
      select lang, 0, pos, n, leaf from d
      union all
      select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where n > 1
      group by lang, lvl, pos // 2, n),
    kept as materialized (select * from nodes),
    subroots as materialized (
      select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from kept where n = 1),
    tops(lvl, pos, n, h) as (
      select 0, pos, n, h from subroots
      union all
      select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where n > 1
      group by lvl, pos // 2, n),
    upper_nodes as materialized (select * from tops),
    steps as materialized (
      select doc_id, o.lvl as step, (d.pos >> o.lvl) & 1 as is_right, s.h
      from d join kept o on o.lang is not distinct from d.lang and o.pos = d.pos >> o.lvl and o.n > 1
      left join kept s on s.lang is not distinct from d.lang and s.lvl = o.lvl and s.pos = xor(o.pos, 1)
      union all
      select doc_id, 1000 + o.lvl, (r.pos >> o.lvl) & 1, s.h
      from d join subroots r on r.lang is not distinct from d.lang join upper_nodes o on o.pos = r.pos >> o.lvl and o.n > 1
      left join upper_nodes s on s.lvl = o.lvl and s.pos = xor(o.pos, 1)),
    turns as materialized (select *, row_number() over (partition by doc_id order by step) as turn from steps),
    fold(doc_id, turn, h) as (
      select doc_id, 0::BIGINT, claim from d
      union all
      select t.doc_id, t.turn, sha256(case when is_right = 1 then coalesce(t.h, '') || f.h else f.h || coalesce(t.h, '') end)
      from fold f join turns t on t.doc_id = f.doc_id and t.turn = f.turn + 1),
    ends as (select doc_id, arg_max(h, turn) as folded_root from fold group by doc_id),
    proofs as (select doc_id, sha256(coalesce(string_agg(h, '' order by turn), '')) as proof_sha256 from turns group by doc_id)
    select d.doc_id, leaf, r.h as subroot, u.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root,
           folded_root = u.h as verified
    from d join subroots r on r.lang is not distinct from d.lang join upper_nodes u on u.n = 1 join ends using (doc_id)
    left join proofs using (doc_id)"""}
