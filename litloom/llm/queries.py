"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.plans.lineage import cut
from litloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import author_names as op

    return op.pairs(op.authors(table(spark, sf_dir, "extract_results"), F.col("metadata.authors")))


def _journals(spark: SparkSession, sf_dir: str):
    from litloom.llm import canonical_list as op

    return op.entries(table(spark, sf_dir, "journal_metrics"), "journal_id", "name", "notes", table(spark, sf_dir, "journal_abbrev"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import canonical_list as op

    got = op.mapped(table(spark, sf_dir, "extract_results"), "rec_id", F.col("metadata.journal"), _journals(spark, sf_dir))
    return got.select("rec_id", F.col("entry_id").alias("journal_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import keyless_match as op

    hits, records = op.sides(table(spark, sf_dir, "papers"), table(spark, sf_dir, "extract_results"))
    return op.cascade(hits, records).select(F.col("id").alias("hit_id"), F.col("id_b").alias("rec_id"))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import keyless_match as op

    hits, records = op.sides(table(spark, sf_dir, "papers"), table(spark, sf_dir, "extract_results"))
    sure = op.confidences(records, table(spark, sf_dir, "result_groups"))
    found = op.cascade(hits, records).join(F.broadcast(sure), "rule")
    return found.select(F.col("id").alias("hit_id"), F.col("id_b").alias("rec_id"), "rule", "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import best_record as op

    return op.best(table(spark, sf_dir, "result_groups"), table(spark, sf_dir, "extract_results"), _journals(spark, sf_dir))


def _scans(spark: SparkSession, sf_dir: str):
    from litloom.llm import scan_noise as op

    texts = op.corpus(table(spark, sf_dir, "sections"), table(spark, sf_dir, "captions"))
    return texts, op.Corpus(texts, table(spark, sf_dir, "journal_metrics"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import scan_noise as op

    return op.noise(*_scans(spark, sf_dir))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import scan_noise as op

    return op.repair(*_scans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import exact_copies as op

    got = op.copies(table(spark, sf_dir, "result_files"), op.canonical_key(F.col("body")), "file_id")
    return got.select(F.col("first_id").alias("first_file_id"), F.col("id").alias("file_id"))


def p6_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import exact_copies as op

    got = op.representatives(table(spark, sf_dir, "result_files"), op.canonical_key(F.col("body")), "file_id")
    return got.select(F.col("first_id").alias("first_file_id"), "n_copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import sentences as op

    born_digital = table(spark, sf_dir, "sections").where("not scanned")
    return op.segment(born_digital, "sec_id", "full_text", "lang")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import byte_bpe as op

    return op.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import mixing as op

    return op.mix(cut(op.sized(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import mixing as op

    texts, targets = cut(op.sized(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets")
    return op.shares(texts, targets, op.mix(texts, targets))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import personal_data as op

    return op.find(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litloom.llm import personal_data as op

    return op.redact(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_PLAIN = r"regexp_replace(lower(upper(coalesce({0}, ''))), '[^\p{{L}}\p{{M}}\p{{N}}\p{{S}}]+', '', 'g')"

#: The other results can't be stated in SQL; tests/llm holds them against brute force, the tokenizer library or true cases.
_P6 = f"""
with f as (select file_id, json_extract(body, '$.metadata') as m from result_files where json_valid(body)),
     k as (select file_id, concat_ws(chr(31), {_PLAIN.format("m->>'$.title'")}, array_to_string(list_transform(from_json(m->'$.authors', '["VARCHAR"]'), lambda a: {_PLAIN.format('a')}), chr(30)),
                                     {_PLAIN.format("m->>'$.journal'")}, {_PLAIN.format("m->>'$.year'")}, {_PLAIN.format(r"regexp_replace(lower(m->>'$.doi'), '^.*?(10\.)', '\1')")}) as key from f where m is not null)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"{_P6} select first_file_id, file_id from (select min(file_id) over (partition by key) as first_file_id, file_id from k) where first_file_id <> file_id",
        "p6_representatives": f"{_P6} select min(file_id) as first_file_id, cast(count(*) as bigint) as n_copies from k group by key",
    }
