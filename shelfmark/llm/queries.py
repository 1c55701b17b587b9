"""The registered queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import align, exact, golay, grammar, licences, mixing, packing, repair, rules, surrogates, toxicity, warc, weak
from shelfmark.llm.common import ORACLE, QUERIES, documents, query

__all__ = ["ORACLE", "QUERIES"]


@query("op1_toxicity_factorization")
def toxicity_factorization(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.scores(docs, machine).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _rules_sql() -> str:
    names = ", ".join(f"'{n}'" for n in rules.COMMON)
    common = " ".join(f"when '{n}' then [{', '.join(repr(w) for w in words)}]" for n, words in rules.COMMON.items())
    cut = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    term = lambda x: f"case when {x} > 0 then 0.5 * {x} * log2(2 * {x} / (p + q)) else 0 end"
    distance = lambda own, key: f"""
        select doc_id, sqrt(greatest(0, sum({term('p')} + {term('q')}))) dist from (
          select doc_id, v / greatest(sum(v) over (partition by doc_id), 1)::double p, r / greatest(sum(r) over (partition by doc_id), 1)::double q
          from (select doc_id, lang, unnest({own}) v, generate_subscripts({own}, 1) pos from c) a
          join (select lang, pos, sum(v) r from (select lang, unnest({own}) v, generate_subscripts({own}, 1) pos from c) group by 1, 2) b
          using (lang, pos)) group by 1"""  # noqa: E731
    return rf"""
    with d as (select doc_id, case when lang in ({names}) then lang else 'other' end lang, coalesce(text, '') t from documents),
    w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') words,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) lines,
                 case lang {common} else []::varchar[] end common from d),
    win as (select doc_id, i, array_to_string(words[i:i + 4], ' ') s from (select doc_id, words, unnest(range(1, len(words) - 3)) i from w)),
    rep as (select doc_id, count(distinct i + k) n from (select doc_id, i, count(*) over (partition by doc_id, s) m from win), range(5) r(k)
            where m > 1 group by 1),
    b as (select doc_id, lang, t, words, common, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars,
                 ({cut('[#*$%&|<>]')})::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
                 coalesce(rep.n, 0)::bigint n_repeat_words from w left join rep using (doc_id)),
    k as (select *, {cut('[A-Z]')} up, {cut('[0-9]')} dig, length(t) - word_chars sp, {cut(PUNCTUATION)} - n_symbols pt,
                 {cut('[^\x00-\x7F]')} wide from b),
    u as (select *, list_transform(common, lambda c: len(list_filter(words, lambda w: w = c))) used from k),
    c as (select *, [up, dig, sp, n_symbols, pt, wide, length(t) - up - dig - sp - n_symbols - pt - wide] classes,
                 list_append(used, n_words - coalesce(list_sum(used), 0)) uses from u),
    dc as ({distance('classes', 'c')}), dw as ({distance('uses', 'w')}),
    v as (select c.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
                 case when length(t) >= {rules.LIMITS['chars']} then dc.dist end class_distance,
                 case when n_words >= {rules.LIMITS['words']} and lang <> 'other' then dw.dist end word_distance
          from c left join dc using (doc_id) left join dw using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
           not base_failed and coalesce(class_distance <= {rules.LIMITS['class_distance']}, true)
                           and coalesce(word_distance <= {rules.LIMITS['word_distance']}, true) kept from v"""


@query("op2_divergence_rules", _rules_sql())
def divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.verdicts(documents(spark, folder))


# A key for trials; production passes its own secret.
TRIAL_KEY = b"trial key, not a secret"


@query("op3_surrogates")
def surrogates_of(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.pseudonymised(documents(spark, folder), TRIAL_KEY)


@query("op4_simhash_golay")
def simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    return golay.near_groups(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_secret_grammars")
def secret_grammars(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.scan(documents(spark, folder))


@query("op6_weak_label_quality")
def weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    return weak.label_and_score(documents(spark, folder))


@query("op7_exact_dedup", """
    with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) h
               from documents),
    g as (select h, max(doc_id) keep_id, count(*) n from t group by h)
    select doc_id, keep_id, n group_size, doc_id = keep_id kept, h text_sha256 from t join g using (h)""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(documents(spark, folder))


@query("op8_licence_index")
def licence_index(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(documents(spark, folder))


@query("op9_cost_packing")
def cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), path("byte_bpe_50k.json"))


# With sources in order of ceiling / weight, the level is that of the first one that stays under its ceiling.
@query("op10_source_mixing", r"""
    with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                    lambda w: w <> '')) size from documents),
    s as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight from d group by 1),
    c as (select *, row_number() over (order by 3 * source_size / weight, source nulls last) k, sum(source_size) over () total, sum(weight) over () weights,
                 coalesce(sum(3 * source_size) over before, 0) stopped, coalesce(sum(weight) over before, 0) gone
          from s window before as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
    l as (select arg_min((total - stopped)::bigint / (weights - gone)::bigint, k) level from c
          where (total - stopped)::bigint / (weights - gone)::bigint * weight <= 3 * source_size),
    t as (select s.*, least(3.0::double * source_size, (select level from l) * weight) target from s),
    p as (select d.*, row_number() over (partition by source order by size, doc_id) - 1 k from d)
    select doc_id, size, source_size, target,
           (floor((k + 1) * (target / source_size) + u) - floor(k * (target / source_size) + u))::bigint * size taken
    from (select p.doc_id, p.size, p.k, t.source_size, t.target,
                 ('0x' || substr(md5('7:' || coalesce(p.source, '')), 1, 8))::bigint / 4294967296.0::double u
          from p join t on p.source is not distinct from t.source)""")
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(documents(spark, folder))


@query("op11_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.aligned(documents(spark, folder), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


@query("op13_warc_histories", f"""
    with p as (select page_id, coalesce(html, '') t from pages), q as (select page_id, octet_length(encode(t)) payload_bytes, sha1(t) payload_digest, t from p),
    g as (select t, max(page_id) last from q where payload_bytes >= {warc.LEAST} group by 1)
    select page_id, payload_bytes, payload_digest, case when last <> page_id then 'revisit' else 'response' end record_type,
           case when last <> page_id then last end refers_to from q left join g using (t)""")
def warc_histories(spark: SparkSession, folder: str) -> DataFrame:
    # Pages carry no time; the trial counts hours from a fixed day.
    hours = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(24 * 365 * 50))
    found = warc.archived(spark.read.parquet(f"{folder}/pages.parquet"), F.timestamp_seconds(1696118400 + 3600 * hours))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
