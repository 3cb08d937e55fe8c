"""The queries over the core operators and their SQL.

Every query runs over its whole tables; where a column is null, a query may ask for the rows that have a value. Lists of names and patterns come from ``functions.vocabulary``; where the
tables hold none of a default list's words, the query passes words that they do hold and says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V
from litloom.operators import blocks as B
from litloom.operators import figures as G
from litloom.operators import insights as I
from litloom.operators import journals as J
from litloom.operators import library as L
from litloom.operators import outline as O
from litloom.operators import pages as P
from litloom.operators import search as S
from litloom.operators import validate
from litloom.plans.lineage import hinted
from litloom.sources.sinks import joined_values
from litloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from litloom.plans import documents  # noqa: F401  (registers its queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


# SQL fragments -----------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _any(c: str, words) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"


def _strip(c: str) -> str:
    return _STRIP.format(c)


def _squeeze(c: str) -> str:
    return _SQUEEZE.format(c)


def _hits(text: str, words) -> str:
    keep = f"list_filter(regexp_split_to_array({text}, '[.!?]\\s+'), lambda s: {_any('lower(s)', words)})"
    return f"list_transform({keep}, lambda s: {_strip('s')})"


def _compact(text: str, words, limit: int) -> str:
    items = f"list_filter(list_transform({_hits(text, words)}, lambda s: {_squeeze('s')}), lambda s: length(s) >= 30)"
    return f"list_slice(list_filter({items}, lambda s, i: list_position(list_transform({items}, lambda t: lower(substr(t, 1, 120))), lower(substr(s, 1, 120))) = i), 1, {limit})"


def _ladder(c: str, steps, otherwise: str) -> str:
    return "case " + " ".join(f"when {_any(c, words)} then '{label}'" for words, label in steps) + f" else '{otherwise}' end"


def _section(name: str) -> str:
    pattern = I.heading_pattern(*V.HEADINGS[name])
    following = I.heading_pattern(r"\d+\.?\s+", V.NEXT_HEADING)
    low = "lower(full_text)"
    start = f"length(regexp_split_to_array({low}, '{pattern}')[1])"
    rest = f"substr({low}, {start} + {I.SKIP} + 1)"
    split = f"regexp_split_to_array({rest}, '{following}')"
    end = f"case when len({split}) > 1 then {start} + {I.SKIP} + length({split}[1]) else length(full_text) end"
    return f"case when len(regexp_split_to_array({low}, '{pattern}')) > 1 then substr(full_text, {start} + 1, {end} - {start}) end"


_SECTIONS = "(select sec_id, full_text, " + ", ".join(f"{_section(n)} as {n}" for n in V.HEADINGS) + " from sections where full_text is not null)"


def _digital(spark: SparkSession, d: str) -> DataFrame:
    return I.sections(table(spark, d, "sections").where("full_text is not null"), "sec_id", "full_text")


# flagship ----------------------------------------------------------------------------------------------------------------


@query(f"""
with hits as (
  select source, lang, doc_id, len(regexp_split_to_array(text, '[.!?]\\s+')) as n,
         len({_compact('text', V.RESEARCH['limitations'], 5)}) as h
  from documents where text is not null)
select source, cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as sentences, cast(sum(h) as bigint) as hits,
       cast(sum(case when h = 0 then 0 else least(10, 5 + 2 * (h > 1)::int) end) as bigint) as score_tenths
from hits group by source
""")
def sentence_insight_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with signs of a limitation, each once, by source: scan, higher-order functions, aggregate."""
    docs = table(spark, d, "documents").where("text is not null").select("source", F.size(T.sentences(F.col("text"))).alias("n"), F.size(T.compact_hits(F.col("text"), V.RESEARCH["limitations"], 5)).alias("h"))
    score = F.when(F.col("h") == 0, 0).otherwise(F.least(F.lit(10), 5 + 2 * (F.col("h") > 1).cast("int")))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("sentences"), F.sum("h").alias("hits"), F.sum(score).alias("score_tenths"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_insight_by_source(spark, sf_dir)


# text to insights ----------------------------------------------------------------------------------------------------------


@query(f"""
select doc_id, cast(len({_hits('text', V.RESEARCH['results'])}) as int) as n_hits, list_extract({_hits('text', V.RESEARCH['results'])}, 1) as first_hit
from documents where text is not null
""")
def fl1_sentence_keyword_filter(spark, d):
    h = T.keyword_sentences(F.col("text"), V.RESEARCH["results"])
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(h).alias("n_hits"), F.get(h, F.lit(0)).alias("first_hit"))


@query(f"""
select doc_id, array_to_string(list_filter(list_slice({_hits('text', V.RESEARCH['results'])}, 1, 5), lambda s: regexp_matches(s, '\\d')), ' | ') as key_results
from documents where text is not null
""")
def fl2_first_k_digit_sentences(spark, d):
    h = F.filter(F.slice(T.keyword_sentences(F.col("text"), V.RESEARCH["results"]), 1, 5), lambda s: s.rlike(r"\d"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", joined_values(h).alias("key_results"))


@query(f"select doc_id, array_to_string({_compact('text', V.REVIEW['controversies'], 4)}, ' | ') as field from documents where text is not null")
def fl3_review_field(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", joined_values(T.compact_hits(F.col("text"), V.REVIEW["controversies"], 4)).alias("field"))


_CAPS = f"list_transform(regexp_extract_all(full_text, '({V.KEY_CAPTION})', 1), lambda c: {_squeeze('c')})"
#: The texts speak of signals and tables of other things than reviews do.
CAPTION_WORDS = (*V.KEY_CAPTION_TERMS, "lists", "shows")


@query(f"select sec_id, array_to_string(list_slice(list_filter({_CAPS}, lambda c: {_any('lower(c)', CAPTION_WORDS)}), 1, 6), ' | ') as captions from sections where full_text is not null")
def fl4_key_captions(spark, d):
    return table(spark, d, "sections").where("full_text is not null").select("sec_id", joined_values(I.key_captions(F.col("full_text"), CAPTION_WORDS)).alias("captions"))


_SIGNS = " + ".join(f"regexp_matches(low, '{T.word(s)}')::int" for s in V.REVIEW_SIGNS)


@query(f"""
with t as (select doc_id, lower(substr(text, 1, 8000)) as low from documents where text is not null),
     c as (select doc_id, {_SIGNS} as hits, len(regexp_extract_all(low, '{V.RESEARCH_SIGN}')) as research from t)
select doc_id, case when hits >= 1 and hits >= research then 'review' else 'research' end as paper_type from c
""")
def fl5_paper_type(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", I.paper_type(F.col("text")).alias("paper_type"))


@query(f"select review_type, cast(count(*) as bigint) as n from (select {_ladder('lower(substr(text, 1, 12000))', V.REVIEW_TYPES, V.NO_REVIEW_TYPE)} as review_type from documents where text is not null) group by 1")
def fl6_review_type(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(I.review_type(F.col("text")).alias("review_type")).agg(F.count(F.lit(1)).alias("n"))


_BLOCK = "case " + " ".join(f"when regexp_matches(lower(content), '{p}') then '{n}'" for n, p, _ in V.BLOCK_TYPES) + " else 'other' end"
_BASE = "case type " + " ".join(f"when '{n}' then {w}" for n, _, w in V.BLOCK_TYPES) + f" else {V.OTHER_BLOCK[1]} end"
_BLOCKS = f"""
(with p as (select doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as raw, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) - 1 as pos from documents where text is not null),
     c as (select doc_id, pos, {_strip('raw')} as content from p),
     t as (select *, {_BLOCK} as type from c where content <> '')
 select doc_id, pos, type, content, substr(regexp_replace({_strip("split_part(content, chr(10), 1)")}, '^\\d+(\\.\\d+)*\\s*', ''), 1, 100) as title,
        least(100, {_BASE} + case when length(content) > 600 then 10 else 0 end) as importance,
        len(regexp_extract_all(content, '\\$([^$]+)\\$')) as n_formulas from t)
"""


@query(f"select type, cast(count(*) as bigint) as n, cast(sum(n_formulas) as bigint) as formulas, cast(max(length(title)) as int) as longest_title from {_BLOCKS} group by type")
def fl7_ag22_pr24_pr25_block_types(spark, d):
    b = B.blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return b.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_formulas").cast("long").alias("formulas"), F.max(F.length("title")).alias("longest_title"))


@query(f"select doc_id, cast(pos as int) as pos, type, title, cast(importance as int) as importance, cast(rank as int) as rank from (select *, row_number() over (partition by doc_id order by importance desc, pos) as rank from {_BLOCKS}) where rank <= 12")
def pr26_so1_block_importance_top12(spark, d):
    return B.top_blocks(B.blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id").select("doc_id", "pos", "type", "title", "importance", "rank")


@query("select doc_id, array_to_string(regexp_extract_all(text, '\\$([^$]+)\\$', 1), ' | ') as formulas from documents where regexp_matches(text, '\\$([^$]+)\\$')")
def pr25_formulas(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"\$([^$]+)\$")).select("doc_id", joined_values(B.formulas(F.col("text"))).alias("formulas"))


@query(f"""
select doc_id,
  array_to_string(list_slice(coalesce(regexp_extract_all(list_extract(list_filter(list_slice(string_split(text, chr(10)), 1, 50), lambda s: {_any('lower(s)', ('author', 'by ', 'from '))}), 1), '([A-Z][a-z]+ [A-Z][a-z]+)', 1), []), 1, 3), ' | ') as authors,
  cast(nullif(regexp_extract(substr(text, 1, 1000), '(?:^|[^\\p{{L}}\\p{{N}}_])(20\\d{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') as int) as year,
  nullif(regexp_extract(substr(text, 1, 2000), '(?:DOI|doi)[\\s:]*([^\\s\\n]+)', 1), '') as doi_loose,
  nullif(regexp_extract(substr(text, 1, 2000), '(10\\.\\d{{4,9}}/[^\\s"<>]+)', 1), '') as doi_strict
from documents where text is not null
""")
def pr7_pr8_metadata_extract(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", joined_values(I.byline_names(t)).alias("authors"), I.year_of(t).alias("year"), I.doi_of(t).alias("doi_loose"), I.doi_of(t, strict=True).alias("doi_strict"))


@query("select sec_id, " + ", ".join(f"cast(length({n}) as int) as {n}" for n in V.HEADINGS) + f" from {_SECTIONS}")
def wn6_section_slices(spark, d):
    return _digital(spark, d).select("sec_id", *(F.length(n).alias(n) for n in V.HEADINGS))


def _together(*cols: str) -> str:
    return " || ' ' || ".join(f"coalesce({c}, '')" for c in cols)


def _summary(text: str, n: int) -> str:
    return f"case when length({text}) > 0 then array_to_string(list_slice(regexp_split_to_array({text}, '[.!?]\\s+'), 1, {n}), '. ') || '.' end"


def _scalar(hits: str, n: int) -> str:
    return _summary(f"array_to_string({hits}, ' ')", n)


_PROBLEM = _hits("coalesce(introduction, '')", V.RESEARCH["problem"])
_RESEARCH = f"""
(select sec_id, introduction, methodology as m_section, results, discussion, conclusion,
  {_scalar(f"list_slice({_PROBLEM}, greatest(len({_PROBLEM}) - 1, 1), greatest(len({_PROBLEM}) - 1, 1) + 1)", 2)} as research_problem,
  {_scalar(f"list_slice({_hits("coalesce(methodology, '')", V.RESEARCH['methodology'])}, 1, 3)", 3)} as methodology,
  list_filter(list_slice({_hits("coalesce(results, '')", V.RESEARCH['results'])}, 1, 5), lambda s: regexp_matches(s, '\\d')) as key_results,
  list_slice({_hits(_together('discussion', 'conclusion'), V.RESEARCH['innovation'])}, 1, 3) as innovation,
  {_scalar(f"list_slice({_hits(_together('conclusion', 'discussion'), V.RESEARCH['application'])}, 1, 2)", 2)} as application,
  list_slice({_hits(_together('discussion', 'conclusion'), V.RESEARCH['limitations'])}, 1, 2) as limitations
 from {_SECTIONS})
"""


@query(f"""
select sec_id, coalesce(research_problem, '') as research_problem, coalesce(methodology, '') as methodology, array_to_string(key_results, ' | ') as key_results,
       array_to_string(innovation, ' | ') as innovation, coalesce(application, '') as application, array_to_string(limitations, ' | ') as limitations from {_RESEARCH}
""")
def research_insight_fields(spark, d):
    """The six recipes of a research paper over its sections."""
    found = I.research_insights(_digital(spark, d), "sec_id")
    return found.select("sec_id", *(joined_values(F.col(c)).alias(c) for c in found.columns[1:]))


def _tenth(value: str, sec: str, many: bool) -> str:
    rich = "2" if many else f"case when length({value}) > 50 then 2 else 0 end"
    empty = f"len({value}) = 0" if many else f"{value} is null"
    return f"cast(case when {empty} then 0 else least(10, 5 + {rich} + case when {sec} is not null then 3 else 0 end) end as int)"


_COVER = {"research_problem": ("introduction", False), "methodology": ("m_section", False), "key_results": ("results", True), "innovation": ("discussion", True), "application": ("conclusion", False), "limitations": ("discussion", True)}


@query("select sec_id, " + ", ".join(f"{_tenth(f, s, m)} as {f}" for f, (s, m) in _COVER.items()) + f" from {_RESEARCH}")
def ag8_research_coverage(spark, d):
    return I.research_coverage(_digital(spark, d), "sec_id")


def _review_field(f: str) -> str:
    if f == "review_type":
        return f"[{_ladder('lower(substr(full_text, 1, 12000))', V.REVIEW_TYPES, V.NO_REVIEW_TYPE)}]"
    if f == "key_tables_figures":
        return f"list_slice(list_filter({_CAPS}, lambda c: {_any('lower(c)', V.KEY_CAPTION_TERMS)}), 1, 6)"
    scope, words, n = I.REVIEW_SCOPES[f]
    return _compact(_together(*scope), V.REVIEW[words], n)


@query("select sec_id, " + ", ".join(f"array_to_string({_review_field(f)}, ' | ') as {f}" for f in I.REVIEW_FIELDS) + f" from {_SECTIONS}")
def review_insight_fields(spark, d):
    """The eleven fields of a review over its sections."""
    found = I.review_insights(_digital(spark, d), "sec_id")
    return found.select("sec_id", *(joined_values(F.col(c)).alias(c) for c in I.REVIEW_FIELDS))


@query("""
select kind, cast(count(*) as bigint) as n from (
  select """ + _ladder("m", I.ERROR_KINDS, "unknown") + """ as kind
  from (select lower(text) as m from documents where text is not null)) group by kind
""")
def fl16_error_kinds(spark, d):
    """The ladder over all texts: the tables hold no error messages, but addresses that end in ``.invalid``."""
    return table(spark, d, "documents").where("text is not null").groupBy(I.error_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# extraction results -----------------------------------------------------------------------------------------------------------


@query("""
select status, origin, cast(count(*) as bigint) as n, cast(sum(case when len(map_keys(coverage_scores)) > 0 then 1 else 0 end) as bigint) as scored, cast(max(extraction_time) as int) as slowest
from extract_results group by status, origin
""")
def ag10_ag14_status_counts(spark, d):
    e = table(spark, d, "extract_results")
    return e.groupBy("status", "origin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce(F.size("coverage_scores"), F.lit(0)) > 0).cast("long")).alias("scored"), F.max("extraction_time").alias("slowest"))


@query("""
with x as (select paper_type, unnest(map_entries(coverage_scores)) as e from extract_results where coverage_scores is not null)
select paper_type, e.key as field, cast(count(*) as bigint) as n, cast(sum(cast(round(e.value * 100) as bigint)) as bigint) as hundredths from x group by 1, 2
""")
def sk5_coverage_by_field(spark, d):
    x = table(spark, d, "extract_results").where("coverage_scores is not null").select("paper_type", F.explode("coverage_scores").alias("field", "value"))
    return x.groupBy("paper_type", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


@query("""
with x as (select rec_id, unnest(map_entries(core_insights)) as e from extract_results where core_insights is not null),
     v as (select rec_id, e.key as field, list_filter(e.value, lambda s: s is not null and lower(s) <> 'not found') as vals from x)
select field, cast(count(*) as bigint) as n, cast(sum(len(vals)) as bigint) as n_values, cast(sum(case when len(vals) = 0 then 1 else 0 end) as bigint) as empty, cast(sum(length(array_to_string(vals, ' | '))) as bigint) as chars from v group by field
""")
def pr12_pr13_insight_values(spark, d):
    """Stated values without the sentinel, joined for a sheet."""
    x = table(spark, d, "extract_results").where("core_insights is not null").select("rec_id", F.explode("core_insights").alias("field", "value"))
    v = x.select("field", F.filter(F.coalesce("value", F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.lower(s) != "not found")).alias("vals"))
    return v.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vals")).alias("n_values"), F.sum((F.size("vals") == 0).cast("long")).alias("empty"), F.sum(F.length(joined_values(F.col("vals")))).alias("chars"))


# journals ---------------------------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select journal_id, {_NORM.format('name')} as norm, coalesce(jcr_partition, 'N/A') as jcr_partition, coalesce(impact_factor, 'N/A') as impact_factor, coalesce(is_top_journal, false) or lower(name) in ('nature', 'science') or contains(lower(name), 'advanced materials') as is_top_journal from journal_metrics")
def pr1_pr2_normalised_metrics(spark, d):
    m = table(spark, d, "journal_metrics")
    n = J.normalised_metrics(m).select("name", "jcr_partition", "impact_factor", F.col("is_top_journal"))
    return n.join(hinted(m.select("name", "journal_id")), "name").select("journal_id", T.normalised_name(F.col("name")).alias("norm"), "jcr_partition", "impact_factor", "is_top_journal")


@query(f"""
with m as (select *, nullif({_NORM.format('name')}, '') as norm from journal_metrics),
     exact as (select * from (select *, row_number() over (partition by name order by journal_id) as r from m) where r = 1),
     alike as (select * from (select *, row_number() over (partition by norm order by journal_id) as r from m) where r = 1),
     short as (select * from (select {_NORM.format('abbrev')} as norm2, m.*, row_number() over (partition by {_NORM.format('abbrev')} order by journal_id) as r from journal_abbrev join m on full_name = name) where r = 1)
select p.hit_id, case when e.name is not null then 'name' when s.name is not null then 'normalised' when a.name is not null then 'abbreviation' else 'none' end as matched_by,
       coalesce(e.name, s.name, a.name) as name, case when e.name is not null then e.impact_factor when s.name is not null then s.impact_factor else a.impact_factor end as impact_factor
from papers p left join exact e on p.journal = e.name left join alike s on nullif({_NORM.format('p.journal')}, '') = s.norm left join short a on nullif({_NORM.format('p.journal')}, '') = a.norm2
""")
def jn1_journal_metrics_join(spark, d):
    m = table(spark, d, "journal_metrics")
    found = J.with_metrics(table(spark, d, "papers"), m, table(spark, d, "journal_abbrev"), F.col("journal"))
    return found.select("hit_id", "matched_by", F.col("metrics.name").alias("name"), F.col("metrics.impact_factor").alias("impact_factor"))


@query("""
with o as (select name, jcr_partition from journal_metrics), b as (select full_name as name, min(abbrev) as jcr_partition from journal_abbrev group by full_name)
select * from o union all select * from b where name not in (select name from o)
""")
def sc20_se2_journal_overlay(spark, d):
    """The abbreviated journals as the base, the metrics laid over it by name."""
    base = table(spark, d, "journal_abbrev").groupBy(F.col("full_name").alias("name")).agg(F.min("abbrev").alias("jcr_partition"))
    return J.overlay(base, table(spark, d, "journal_metrics").select("name", "jcr_partition"))


# search -----------------------------------------------------------------------------------------------------------------------

_KEY = f"coalesce(source, ''), coalesce(url, ''), coalesce(doi, ''), lower({_strip("coalesce(title, '')")})"


@query(f"select hit_id, source, title from (select *, row_number() over (partition by {_KEY} order by hit_id) as r from papers) where r = 1")
def ag1_pr3_first_seen(spark, d):
    return S.first_seen(table(spark, d, "papers"), "hit_id").select("hit_id", "source", "title")


@query(f"""
select hit_id from (select hit_id, row_number() over (partition by work order by hit_id) as r from (select hit_id, coalesce(nullif(lower(doi), ''), nullif(lower({_squeeze('title')}), '')) as work from papers) where work is not null) where r = 1
""")
def tr1_dedupe_works(spark, d):
    """Beyond the source's own key: one row per DOI or title."""
    return S.best_of_works(table(spark, d, "papers"), "hit_id").select("hit_id")


@query("""
select source, coalesce(doi, '') as doi, arg_max(title, hit_id) as title, arg_max(coalesce(year, ''), hit_id) as year, cast(min(hit_id) as bigint) as position, cast(max(hit_id) as bigint) as updated
from papers group by source, coalesce(doi, '')
""")
def ag2_library_upsert(spark, d):
    p = table(spark, d, "papers").select("source", F.coalesce("doi", F.lit("")).alias("doi"), "title", F.coalesce("year", F.lit("")).alias("year"), "hit_id")
    return S.upsert(p.where("hit_id % 2 = 0"), p.where("hit_id % 2 = 1"), ["source", "doi"], "hit_id")


@query("""
select cast(0 as int) as src_rank, hit_id as pos, title, year, null as doi_strict from papers where source = 'arxiv'
union all select 1, hit_id, title, year, null from papers where source = 'pubmed'
union all select 2, hit_id, title, year, nullif(doi, '') from papers where source = 'wos'
""")
def se1_union_of_sources(spark, d):
    p = table(spark, d, "papers")
    part = lambda s: p.where(F.col("source") == s).select("hit_id", "title", "year")
    wos = p.where("source = 'wos'").select("hit_id", "title", "year", F.nullif("doi", F.lit("")).alias("doi_strict"))
    return S.union_sources([part("arxiv"), part("pubmed"), wos], "hit_id").select("src_rank", "pos", "title", "year", "doi_strict")


_NAMED = "list_filter(authors, lambda a: a is not null)"
_LINE = f"case when len({_NAMED}) > 3 then array_to_string(list_slice({_NAMED}, 1, 3), ', ') || ' et al.' else array_to_string({_NAMED}, ', ') end"


@query(f"""
select hit_id, '## ' || cast(hit_id as varchar) || '. ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || '**Authors**: ' || coalesce(nullif({_LINE}, ''), 'Unknown') || chr(10)
  || '**Journal**: ' || coalesce(nullif(journal, ''), 'Unknown') || ' (' || coalesce(nullif(year, ''), 'n.d.') || ')'
  || case when length(abstract) > 0 then chr(10) || '**Abstract**: ' || case when length(abstract) > 300 then substr(abstract, 1, 300) || '...' else abstract end else '' end as entry
from papers
""")
def sk2_sk3_report_entries(spark, d):
    return table(spark, d, "papers").select("hit_id", S.entry_markdown(F.col("hit_id"), F.col("title"), F.col("authors"), F.col("journal"), F.col("year"), F.col("abstract"), F.lit(False)).alias("entry"))


@query("select hit_id, regexp_replace(url || '?api_key=' || cast(hit_id as varchar) || '&q=1', '(api_key=)[^&\\s]+', '\\1[REDACTED]', 'g') as url from papers where url is not null")
def pr4_redacted_keys(spark, d):
    url = F.concat(F.col("url"), F.lit("?api_key="), F.col("hit_id").cast("string"), F.lit("&q=1"))
    return table(spark, d, "papers").where("url is not null").select("hit_id", T.redacted_keys(url).alias("url"))


# library ----------------------------------------------------------------------------------------------------------------------


@query("select rec_id, exists(select 1 from captions c where c.rec_id = e.rec_id) as has_captions from extract_results e")
def jn2_se3_has_children(spark, d):
    return L.flag_children(table(spark, d, "extract_results").select("rec_id"), table(spark, d, "captions"), "rec_id", "has_captions")


@query("select rec_id, metadata.doi as doi from extract_results e where metadata.doi <> '' and not exists(select 1 from sections s where s.rec_id = e.rec_id)")
def jn3_fl17_doi_without_text(spark, d):
    items = table(spark, d, "extract_results").where("metadata.doi <> ''").select("rec_id", F.col("metadata.doi").alias("doi"))
    return L.has_children(items, table(spark, d, "sections"), "rec_id", present=False)


@query("""
with t as (select rec_id, metadata.title as title, lower(coalesce(metadata.title, '')) as low from extract_results),
     lib as (select low, max(rec_id) as rec_id from t group by low),
     c as (select hit_id, lower(title) as low, length(title) as n, coalesce(', ' || year, '') as tail from papers)
select hit_id, l.rec_id is not null as in_library, l.rec_id as rec_id
from c left join lib l on c.low = l.low and c.low <> '' and 2.0 * n / (2 * n + length(tail)) > 0.6
""")
def jn4_u1_checked_citations(spark, d):
    """Hits as citations (title and year) whose title is the resolved one, against the records; the ratio of a text and its beginning has a formula."""
    p = table(spark, d, "papers").select("hit_id", F.concat(F.col("title"), F.coalesce(F.concat(F.lit(", "), "year"), F.lit(""))).alias("citation"), F.col("title").alias("resolved"))
    e = table(spark, d, "extract_results").select("rec_id", F.col("metadata.title").alias("title"))
    got = L.checked_citations(p, "citation", "resolved", e, "title", "rec_id")
    return got.select("hit_id", "in_library", F.col("_item.rec_id").alias("rec_id"))


@query()
def jn5_u1_completed_dois(spark, d):
    """Records without a DOI, the other records of their groups as candidates. No SQL states the ratio."""
    e = table(spark, d, "extract_results").select("rec_id", F.col("metadata.title").alias("title"), F.col("metadata.doi").alias("doi"), "paper_type")
    g = table(spark, d, "result_groups")
    other = e.select(F.col("rec_id").alias("other"), F.col("title").alias("c_title"), F.col("doi").alias("c_doi"))
    pairs = L.without_doi(e, "doi", "paper_type").join(g, "rec_id").join(g.select("group_id", F.col("rec_id").alias("other")), "group_id").where("rec_id <> other").join(other, "other")
    return L.completed_dois(pairs, "title", "doi", "paper_type", "c_title", "c_doi").select("rec_id", "other", "found_doi")


_LAST = "list_transform(list_slice(authors, 1, 3), lambda n: coalesce(nullif(list_extract(string_split(trim(n), ' '), -1), ''), '?'))"


@query(f"select hit_id, '[' || cast(hit_id as varchar) || '] ' || coalesce(array_to_string({_LAST}, ', ') || case when len(authors) > 3 then ' et al.' else '' end, '') || ' (' || coalesce(nullif(regexp_extract(coalesce(year, ''), '^(\\d{{4}})', 1), ''), '') || ') ' || coalesce(title, 'untitled') || ' [' || source || ']' as line from papers")
def pr5_pr6_item_lines(spark, d):
    return table(spark, d, "papers").select("hit_id", L.item_line(F.col("hit_id").cast("string"), F.col("authors"), F.col("year"), F.col("title"), F.col("source")).alias("line"))


@query("""select rec_id, regexp_replace(substr(metadata.title, 1, 60), '[\\\\/:*?"<>|]', '_', 'g') || '.pdf' as file_name, substr(md5(coalesce(metadata.title || '_', '') || paper_type), 1, 12) as cache_key from extract_results where metadata.title is not null and paper_type is not null""")
def pr37_sk17_names_and_keys(spark, d):
    e = table(spark, d, "extract_results").where("metadata.title is not null and paper_type is not null")
    return e.select("rec_id", L.attachment_name(F.col("metadata.title")).alias("file_name"), L.cache_key(F.col("metadata.title"), F.col("paper_type")).alias("cache_key"))


# captions and boxes -----------------------------------------------------------------------------------------------------------

_KINDS = "case " + " ".join(f"when regexp_extract(caption_text, '{p}', 1) <> '' then '{k}'" for p, k in V.CAPTIONS) + " end"
_NUMBERS = "case " + " ".join(f"when regexp_extract(caption_text, '{p}', 1) <> '' then cast(regexp_extract(caption_text, '{p}', 1) as int)" for p, k in V.CAPTIONS) + " end"


@query(f"select caption_id, {_NUMBERS} as number, {_KINDS} as type from captions where caption_text is not null")
def fl11_caption_kinds(spark, d):
    return table(spark, d, "captions").where("caption_text is not null").select("caption_id", G.caption_kind(F.col("caption_text")).alias("x")).select("caption_id", "x.number", "x.type")


@query("select rec_id, figure_type, number, caption_id, caption_text from (select *, row_number() over (partition by rec_id, figure_type, number order by coalesce(length(caption_text), -1) desc, coalesce(page, -1), caption_id) as r from captions) where r = 1")
def ag4_longest_captions(spark, d):
    c = table(spark, d, "captions").select("rec_id", "figure_type", "number", "caption_id", "caption_text", "page")
    return G.longest_per_key(c.withColumn("_p", F.coalesce("page", F.lit(-1))), ["rec_id", "figure_type", "number"], "caption_text", ["_p", "caption_id"]).select("rec_id", "figure_type", "number", "caption_id", "caption_text")


@query("""
with s as (select caption_id, list_sort(list_distinct(list_transform(sublabels, lambda x: lower(x)))) as l from captions where sublabels is not null),
     r as (select caption_id, list_filter(l, lambda x, i: x = chr(96 + cast(i as int))) as run from s)
select caption_id, case when len(run) >= 2 then array_to_string(run, '') else '' end as run from r
""")
def wn7_consecutive_labels(spark, d):
    return table(spark, d, "captions").where("sublabels is not null").select("caption_id", F.array_join(G.consecutive_labels(F.col("sublabels")), "").alias("run"))


@query("""
select rec_id, page, min(bbox.x0) as x0, min(bbox.y0) as y0, max(bbox.x1) as x1, max(bbox.y1) as y1, cast(count(*) as bigint) as n_boxes, round((max(bbox.x1) - min(bbox.x0)) * (max(bbox.y1) - min(bbox.y0)), 4) as area
from captions where bbox is not null group by rec_id, page
""")
def ag11_page_boxes(spark, d):
    return G.group_box(table(spark, d, "captions").where("bbox is not null"), ["rec_id", "page"], "bbox")


@query("select caption_id, cast(row_number() over (partition by rec_id, page order by floor(bbox.y0 / 60), bbox.x0, caption_id) as int) as reading_pos from captions where bbox is not null")
def so4_so5_reading_order(spark, d):
    return G.reading_order(table(spark, d, "captions").where("bbox is not null").select("rec_id", "page", "caption_id", "bbox"), ["rec_id", "page"], "bbox", 60.0).select("caption_id", "reading_pos")


_OVER = "case when c.bbox.x1 - c.bbox.x0 > 0 then greatest(0.0, least(c.bbox.x1, i.bbox.x1) - greatest(c.bbox.x0, i.bbox.x0)) / (c.bbox.x1 - c.bbox.x0) else 0.0 end"
_NEAR = "greatest(0.0, 1 - greatest(0.0, c.bbox.y0 - i.bbox.y1) / (792.0 * 0.3))"
_ALIGN = "greatest(0.0, 1 - 2 * abs((i.bbox.x0 + i.bbox.x1) / 2 - (c.bbox.x0 + c.bbox.x1) / 2) / 612.0)"


@query(f"""
with p as (select c.rec_id, c.page, c.caption_id, i.caption_id as image_id, round(0.4 * {_OVER} + 0.4 * {_NEAR} + 0.2 * {_ALIGN}, 6) as score
  from captions c join captions i on c.rec_id = i.rec_id and c.page = i.page and c.caption_id <> i.caption_id where c.bbox is not null and i.bbox is not null and i.bbox.y0 <= c.bbox.y0 + 5)
select caption_id, image_id, cast(round(score * 1000) as bigint) as score_mille from (select *, row_number() over (partition by rec_id, page, caption_id order by score desc, image_id) as r from p where score > 0.3) where r = 1
""")
def jn6_best_box_above(spark, d):
    """Boxes of other captions stand for images: the tables hold no others."""
    c = table(spark, d, "captions").where("bbox is not null").select("rec_id", "page", "caption_id", F.col("bbox").alias("caption_box"))
    i = c.select("rec_id", "page", F.col("caption_id").alias("image_id"), F.col("caption_box").alias("image_box"))
    pairs = G.best_above(c, i, ["rec_id", "page"], "caption_id", "image_id", 612.0, 792.0, other=True)
    return pairs.select("caption_id", "image_id", F.round(F.col("score") * 1000).cast("long").alias("score_mille"))


@query("select p.caption_id, min(c.caption_id) as cell_id from captions p join captions c on p.rec_id = c.rec_id and p.page = c.page where p.bbox is not null and c.bbox is not null and p.column_hint between c.bbox.x0 and c.bbox.x1 and p.bbox.y0 between c.bbox.y0 and c.bbox.y1 group by p.rec_id, p.page, p.caption_id")
def jn8_first_containing_box(spark, d):
    c = table(spark, d, "captions").where("bbox is not null")
    points = c.select("rec_id", "page", "caption_id", F.col("column_hint").alias("x"), F.col("bbox.y0").alias("y"))
    cells = c.select("rec_id", "page", F.col("caption_id").alias("cell_id"), F.col("bbox").alias("cell"))
    return G.first_cell(points, cells, ["rec_id", "page"], "caption_id", "cell_id").select("caption_id", "cell_id")


@query("select column_no, cast(count(*) as bigint) as n from (select case when column_hint >= 0 and column_hint <= 300 then 0 when column_hint >= 300 and column_hint <= 612 then 1 else 0 end as column_no from captions) group by 1")
def jn9_columns(spark, d):
    return table(spark, d, "captions").groupBy(G.column_of(F.col("column_hint"), [(0.0, 300.0), (300.0, 612.0)]).alias("column_no")).agg(F.count(F.lit(1)).alias("n"))


@query("select caption_id, greatest(0.0, least(612.0, bbox.x0 - 5)) as x0, greatest(0.0, least(792.0, bbox.y0 - 5)) as y0, greatest(0.0, least(612.0, bbox.x1 + 5)) as x1, greatest(0.0, least(792.0, bbox.y1 + 5)) as y1, cast(trunc(bbox.x0 * 300 / 72) as int) as x0_px from captions where bbox is not null")
def pr21_pr22_refined_boxes(spark, d):
    c = table(spark, d, "captions").where("bbox is not null").select("caption_id", G.refined(F.col("bbox"), 612.0, 792.0).alias("b"), G.to_pixels(F.col("bbox.x0"), 300).alias("x0_px"))
    return c.select("caption_id", "b.x0", "b.y0", "b.x1", "b.y1", "x0_px")


_BOXED = "bbox is not null and rec_id is not null and page is not null"
_NEAR_GROUP = "b.x0 - g.x1 <= 40 and g.x0 - b.x1 <= 40 and b.y0 - g.y1 <= 40 and g.y0 - b.y1 <= 40"
_FOUND = f"coalesce(list_position(list_transform(r.groups, lambda g: {_NEAR_GROUP}), true), 0)"


@query(f"""
with recursive b as (select rec_id, page, bbox.x0 as x0, bbox.y0 as y0, bbox.x1 as x1, bbox.y1 as y1, row_number() over (partition by rec_id, page order by bbox.y0, bbox.x0, bbox.y1, bbox.x1) as n from captions where {_BOXED}),
     r as (select rec_id, page, n, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': 1}}] as groups from b where n = 1
       union all
       select b.rec_id, b.page, b.n, case when {_FOUND} = 0 then list_append(r.groups, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'n': 1}})
         else list_transform(r.groups, lambda g, i: case when i = {_FOUND} then {{'x0': least(g.x0, b.x0), 'y0': least(g.y0, b.y0), 'x1': greatest(g.x1, b.x1), 'y1': greatest(g.y1, b.y1), 'n': g.n + 1}} else g end) end
       from r join b on r.rec_id = b.rec_id and r.page = b.page and b.n = r.n + 1),
     l as (select rec_id, page, unnest(groups) as g, generate_subscripts(groups, 1) - 1 as group_no from r where n = (select max(n) from b where b.rec_id = r.rec_id and b.page = r.page))
select rec_id, page, cast(group_no as int) as group_no, g.x0 as x0, g.y0 as y0, g.x1 as x1, g.y1 as y1, cast(g.n as int) as n_boxes from l
""")
def ag17_merged_boxes(spark, d):
    """Neighbouring boxes of a page merged; the growing boxes are the SQL's recursion."""
    c = table(spark, d, "captions").where(_BOXED).select("rec_id", "page", "bbox.*")
    return G.merged_boxes(c, ["rec_id", "page"], 40.0)


@query(f"""
with recursive s as (select c.rec_id, c.page, c.caption_id, i.caption_id as image_id, round(0.4 * {_OVER} + 0.4 * {_NEAR} + 0.2 * {_ALIGN}, 6) as score
       from captions c join captions i on c.rec_id = i.rec_id and c.page = i.page and c.caption_id <> i.caption_id where c.bbox is not null and i.bbox is not null and i.bbox.y0 <= c.bbox.y0 + 5),
     o as (select rec_id, page, caption_id, list({{'i': image_id, 's': score}} order by score desc, image_id) as wanted, row_number() over (partition by rec_id, page order by caption_id) as n from s where score > 0.3 group by rec_id, page, caption_id),
     r as (select rec_id, page, caption_id, n, wanted[1] as got, [wanted[1].i] as taken from o where n = 1
       union all
       select o.rec_id, o.page, o.caption_id, o.n, list_filter(o.wanted, lambda w: not list_contains(r.taken, w.i))[1], list_append(r.taken, list_filter(o.wanted, lambda w: not list_contains(r.taken, w.i))[1].i)
       from r join o on r.rec_id = o.rec_id and r.page = o.page and o.n = r.n + 1)
select rec_id, page, caption_id, got.i as image_id, got.s as score from r where got is not null
""")
def wn9_claimed_boxes(spark, d):
    """Captions claim their best box in turn; what is taken is the SQL's recursion."""
    c = table(spark, d, "captions").where(_BOXED).select("rec_id", "page", "caption_id", F.col("bbox").alias("caption_box"))
    i = c.select("rec_id", "page", F.col("caption_id").alias("image_id"), F.col("caption_box").alias("image_box"))
    scored = c.join(i, ["rec_id", "page"]).where("caption_id <> image_id").withColumn("score", G.above_score(F.col("caption_box"), F.col("image_box"), 612.0, 792.0)).where("score > 0.3").select("rec_id", "page", "caption_id", "image_id", "score")
    return G.claimed_images(scored, ["rec_id", "page"], "caption_id", "image_id")


@query(f"""
with recursive w as (select rec_id, page, coalesce(figure_type, '') as text, bbox.x0 as x0, bbox.y0 as y0, bbox.x1 as x1, bbox.y1 as y1, row_number() over (partition by rec_id, page order by bbox.y0, bbox.x0, coalesce(figure_type, '')) as n from captions where {_BOXED}),
     r as (select *, y0 as anchor, 0 as line_no from w where n = 1
       union all
       select w.*, case when abs(w.y0 - r.anchor) <= 30 then r.anchor else w.y0 end, case when abs(w.y0 - r.anchor) <= 30 then r.line_no else r.line_no + 1 end
       from r join w on r.rec_id = w.rec_id and r.page = w.page and w.n = r.n + 1)
select rec_id, page, cast(line_no as int) as line_no, string_agg(text, ' ' order by x0, n) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from r group by rec_id, page, line_no
""")
def ag15_wn1_text_lines(spark, d):
    """Boxes of a page gathered to lines by the anchor rule; the anchor is the SQL's recursion."""
    c = table(spark, d, "captions").where(_BOXED).select("rec_id", "page", F.coalesce("figure_type", F.lit("")).alias("text"), "bbox.*")
    return G.text_lines(c, ["rec_id", "page"], 30.0)


# outlines and decks -----------------------------------------------------------------------------------------------------------

_OUTLINE = "(select doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) - 1 as line_no from documents where text is not null)"
_TITLE = f"nullif({_strip(f"regexp_extract(line, '{O.SECTION_LINE}', 1)")}, '')"
_BULLET = f"case when regexp_matches(line, '{O.BULLET}') then {_strip(f"regexp_replace(line, '{O.BULLET}', '')")} end"
_CARRIED = f"(select doc_id, line_no, line, last_value({_TITLE} ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from {_OUTLINE})"


@query(f"select doc_id, section, cast(count(*) as bigint) as n_lines, cast(min(line_no) as int) as first_line from {_CARRIED} group by doc_id, section")
def wn2_wn4_carried_sections(spark, d):
    ls = O.carried(O.lines(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id", "line_no", O.section_title(F.col("line")))
    return ls.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


_PAGES = f"""
(with b as (select doc_id, section, line_no, {_BULLET} as item from {_CARRIED} where section is not null),
      n as (select *, (row_number() over (partition by doc_id, section order by line_no) - 1) // 6 as chunk, min(line_no) over (partition by doc_id, section) as first_at from b where item is not null),
      p as (select doc_id, section, chunk, first_at, list(item order by line_no) as items from n group by all)
 select doc_id, row_number() over (partition by doc_id order by first_at, section, chunk) as page, case when chunk > 0 then section || ' (' || cast(chunk + 1 as varchar) || ')' else section end as title, items from p)
"""


@query(f"select doc_id, cast(page as int) as page, title, array_to_string(items, ' | ') as items from {_PAGES}")
def wn5_pr27_outline_pages(spark, d):
    p = O.outline_pages(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return p.select("doc_id", "page", "title", joined_values(F.col("items")).alias("items"))


@query(f"select doc_id, array_to_string(list(title order by first_page), ' | ') as toc from (select doc_id, title, min(page) as first_page from {_PAGES} group by doc_id, title) group by doc_id having count(*) > 1")
def ag7_wn11_table_of_contents(spark, d):
    toc = O.table_of_contents(O.outline_pages(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id", "title", "page")
    return toc.select("doc_id", joined_values(F.col("toc")).alias("toc"))


@query(f"""
with b as (select doc_id, 1 as part, page as place, 'content' as type, title from {_PAGES}), dk as (select distinct doc_id from b),
     f as (select doc_id, 0 as part, 0 as place, 'cover' as type, null as title from dk union all select * from b union all select doc_id, 2, 0, 'ending', null from dk)
select doc_id, cast(row_number() over (partition by doc_id order by part, place) as int) as slide_no, type, title from f
""")
def wn11_framed_decks(spark, d):
    return O.framed(O.outline_pages(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id", "page", "title")


_T = "coalesce(title, '')"
_N = lambda cls: f"(length({_T}) - length(regexp_replace({_T}, '{cls}', '', 'g')))"
_S, _IDEOGRAPHIC, _WIDE = _N(r"[\s\x0b]"), _N("　"), _N("[ᄀ-ᇿ⺀-꓏가-힯豈-﫿＀-￯]")
_W = f"cast(({_S} + {_IDEOGRAPHIC}) * 35 + ({_WIDE} - {_IDEOGRAPHIC}) * 100 + (length({_T}) - {_S} - {_WIDE}) * 55 as int)"


@query(f"select hit_id, case when {_W} >= 8200 then 'title-fit-xxlong' when {_W} >= 5800 then 'title-fit-xlong' when {_W} >= 3800 then 'title-fit-long' else 'title-fit-normal' end as fit from papers")
def pr18_title_fit(spark, d):
    return table(spark, d, "papers").select("hit_id", O.title_fit(F.col("title")).alias("fit"))


@query(f"""
select motif, cast(count(*) as bigint) as n from (select coalesce(nullif({_ladder("lower(title)", O.MOTIF_STEPS, "")}, ''), {_ladder("lower(title || ' ' || coalesce(abstract, ''))", O.MOTIF_STEPS, "motif-general")}) as motif from papers where title is not null) group by motif
""")
def pr19_motifs(spark, d):
    return table(spark, d, "papers").where("title is not null").groupBy(O.motif(F.col("title"), F.coalesce("abstract", F.lit(""))).alias("motif")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select hit_id, case when length(abstract) <= 90 then abstract else regexp_replace(substr(abstract, 1, 89), '\\s+$', '') || '...' end as short,
  case """ + " ".join(f"when strpos(lower(abstract), '{w}') > 0 then substr(abstract, 1, strpos(lower(abstract), '{w}') - 1) || '**' || substr(abstract, strpos(lower(abstract), '{w}'), {len(w)}) || '**' || substr(abstract, strpos(lower(abstract), '{w}') + {len(w)})" for w in V.EMPHASIS) + """ else abstract end as emphasised
from papers where abstract is not null
""")
def pr14_pr15_shorten_emphasise(spark, d):
    return table(spark, d, "papers").where("abstract is not null").select("hit_id", T.shorten(F.col("abstract"), 90).alias("short"), T.emphasised(F.col("abstract"), V.EMPHASIS).alias("emphasised"))


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""select doc_id, md5(regexp_replace(regexp_replace({_ESC}, '\\*\\*([^\\n]+?)\\*\\*', '<span class="text-highlight">\\1</span>', 'g'), '==([^\\n]+?)==', '<span class="text-highlight">\\1</span>', 'g')) as html from documents where text is not null""")
def pr17_inline_markup(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.inline_markup(F.col("text"))).alias("html"))


@query("select doc_id, cast(least((n_chars * 7) // 4000, 6) as int) as section from documents where n_chars is not null")
def jn10_proportional_sections(spark, d):
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", O.proportional_section(F.col("n_chars"), F.lit(4000), F.lit(7)).alias("section"))


@query("""
select hit_id, array_to_string(list_filter([case when trim(coalesce(title, '')) = '' then 'missing title' end, case when len(coalesce(authors, [])) = 0 then 'missing author' end, case when coalesce(length(abstract), 0) = 0 then 'missing sections' end], lambda x: x is not null), ', ') as warnings
from papers
""")
def fl20_warnings(spark, d):
    p = table(spark, d, "papers")
    return p.select("hit_id", F.array_join(O.warnings(F.col("title"), F.when(F.coalesce(F.size("authors"), F.lit(0)) > 0, "x"), F.coalesce(F.length("abstract"), F.lit(0))), ", ").alias("warnings"))


# rules ------------------------------------------------------------------------------------------------------------------------

#: The corpus has no phrases of the default lists; these stand in it.
SECTION_RULES = {"section": (("Introduction", "Method", "Result", "Conclusion"), ("we did not expect", "hard to follow"))}
_PLAIN = f"lower({_squeeze("coalesce(full_text, '')")})"


@query(f"""
with n as (select sec_id, list_filter(['Introduction', 'Method', 'Result', 'Conclusion'], lambda p: not contains({_PLAIN}, lower(p))) as missing, list_filter(['we did not expect', 'hard to follow'], lambda p: contains({_PLAIN}, p)) as banned from sections)
select sec_id, array_to_string(missing, ', ') as missing_required, array_to_string(banned, ', ') as banned_phrases, len(missing) = 0 and len(banned) = 0 as passed from n
""")
def fl18_u5_rules(spark, d):
    v = validate.validated(table(spark, d, "sections").select("sec_id", "full_text"), F.col("full_text"), "section", SECTION_RULES)
    return v.select("sec_id", F.array_join("missing_required", ", ").alias("missing_required"), F.array_join("banned_phrases", ", ").alias("banned_phrases"), "passed")


# events: windows of the sequential kind -------------------------------------------------------------------------------------------


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as r from events where value is not null) where r = 1")
def x_best_per_label(spark, d):
    e = table(spark, d, "events").where("value is not null")
    top = e.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct((-F.col("value")).alias("a"), "event_id")).alias("x"))
    return top.select("user_id", "event_type", "x.event_id", "x.value")


@query("""
with dd as (select distinct user_id, cast(ts as date) as day from events), g as (select *, date_diff('day', date '1970-01-01', day) - row_number() over (partition by user_id order by day) as island from dd)
select user_id, cast(min(day) as varchar) as first_day, cast(count(*) as bigint) as days from g group by user_id, island having count(*) >= 2
""")
def x_islands(spark, d):
    """Extension: runs of days without a gap, two at least."""
    from pyspark.sql import Window

    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    g = days.withColumn("island", F.datediff("day", F.lit("1970-01-01").cast("date")) - F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return g.groupBy("user_id", "island").agg(F.min("day").cast("string").alias("first_day"), F.count(F.lit(1)).alias("days")).where("days >= 2").select("user_id", "first_day", "days")


@query("select cast(date_trunc('hour', ts) as varchar) as hour, event_type, cast(count(*) as bigint) as n from events group by 1, 2")
def x_events_tumbling(spark, d):
    """Extension: tumbling windows, as the streaming counterpart counts them."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("""
select n_name, l_returnflag, cast(count(*) as bigint) as n, cast(sum(cast(round(l_quantity * 100) as bigint)) as bigint) as quantity_hundredths
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name, l_returnflag
""")
def x_star_quantities(spark, d):
    """Extension: the star joined and summed by nation."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("quantity_hundredths"))


# pages and regions ----------------------------------------------------------------------------------------------------------------

_LINES = "list_filter(string_split(text, chr(10)), lambda l: l <> '')"


@query(f"""
with p as (select doc_id, lower(coalesce(source, '') || ' ' || array_to_string({_LINES}, ' ')) as joined, len(list_filter({_LINES}, lambda l: regexp_matches(l, '(^|[^A-Za-z0-9_])20[0-9][0-9]([^A-Za-z0-9_]|$)'))) as dated from documents where text is not null)
select page_type, cast(count(*) as bigint) as n from (select case when {_any('joined', V.TIMELINE)} or dated > 0 then 'timeline' when {_any('joined', V.DETAIL)} then 'content_detail' else 'content_list' end as page_type from p) group by page_type
""")
def fl8_page_types(spark, d):
    ls = F.filter(F.split("text", "\n"), lambda l: l != "")
    return table(spark, d, "documents").where("text is not null").groupBy(P.page_type(F.coalesce("source", F.lit("")), ls).alias("page_type")).agg(F.count(F.lit(1)).alias("n"))


@query("select slide_type, cast(count(*) as bigint) as n from (select case when layout in ('cover', 'toc', 'section', 'figure', 'split', 'summary', 'ending') then layout when length(image) > 0 then 'figure' when t in ('thank you', 'thanks', 'questions', 'q&a') then 'ending' when contains(t, 'conclusion') or contains(t, 'summary') then 'summary' else 'content' end as slide_type from (select lower(coalesce(caption_text, '')) as t, case when page % 5 = 0 then cast(page as varchar) end as image, figure_type as layout from captions)) group by 1")
def fl9_slide_types(spark, d):
    """Captions as slides: their figure types as layouts, some pages as images."""
    c = table(spark, d, "captions").select(F.coalesce("caption_text", F.lit("")).alias("t"), F.when(F.col("page") % 5 == 0, F.col("page").cast("string")).alias("image"), F.col("figure_type").alias("layout"))
    return c.groupBy(P.slide_type(F.col("t"), F.col("image"), F.col("layout")).alias("slide_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with x as (select caption_id, split_part(caption_text, chr(10), 1) as line from captions where caption_text is not null)
select caption_id, regexp_extract(line, '^(\\S+)\\s*[:\\-]\\s*(.+)', 1) as date, substr(case when regexp_extract(line, '^(\\S+)\\s*[:\\-]\\s*(.+)', 2) <> '' then regexp_extract(line, '^(\\S+)\\s*[:\\-]\\s*(.+)', 2) else line end, 1, 20) as title from x
""")
def pr28_timeline_events(spark, d):
    e = P.timeline_event(F.element_at(F.split("caption_text", "\n"), 1))
    return table(spark, d, "captions").where("caption_text is not null").select("caption_id", e.alias("e")).select("caption_id", "e.date", "e.title")


_BARE = lambda c: f"regexp_replace({c}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


@query(f"select sec_id, list_extract(list_filter(list_transform(string_split(full_text, chr(10)), lambda l: {_BARE('l')}), lambda l: length(l) > 10), 1) as title from sections where full_text is not null")
def pr29_first_long_lines(spark, d):
    return table(spark, d, "sections").where("full_text is not null").select("sec_id", P.first_long_line(F.col("full_text")).alias("title"))


_PRESENT = "list_filter([" + ", ".join(f"case when regexp_matches(full_text, '(?i){T.word(p)}') then '{label}' end" for label, p in V.PRESENT) + "], lambda x: x is not null)"


@query(f"select sec_id, array_to_string({_PRESENT}, ', ') as present, len({_PRESENT}) = 0 as without_structure from sections where full_text is not null")
def fl25_present_sections(spark, d):
    p = P.present_sections(F.col("full_text"))
    return table(spark, d, "sections").where("full_text is not null").select("sec_id", F.array_join(p, ", ").alias("present"), (F.size(p) == 0).alias("without_structure"))


_ITEMS = f"list_filter(list_transform(string_split(regexp_replace(full_text, '([.。!！?？]){T.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_BARE('s')}), lambda s: length(s) >= 20 and not regexp_matches(s, '^\\[?\\d+[\\].,]') and not regexp_matches(s, '(?i)^(Fig|Figure|Table|Scheme)\\s*\\d+'))"


@query(f"select sec_id, array_to_string(list_slice(list_transform({_ITEMS}, lambda s: case when length(s) > 120 then substr(s, 1, 120) || '...' else s end), 1, 8), ' | ') as items from sections where full_text is not null")
def fl12_outline_items(spark, d):
    return table(spark, d, "sections").where("full_text is not null").select("sec_id", joined_values(P.outline_items(F.col("full_text"))).alias("items"))


@query("select hit_id, source, title from papers where contains(lower(coalesce(title, '') || ' ' || coalesce(journal, '') || ' ' || coalesce(array_to_string(authors, ' '), '')), 'acoustic')")
def fl19_search(spark, d):
    p = table(spark, d, "papers").withColumn("title", F.col("title"))
    return P.searched(p, ["title", "journal", "authors"], "Acoustic").select("hit_id", "source", "title")


_R = "(bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) / (612.0 * 792.0)"


@query(f"""
select caption_id, cast(round(1000 * round(0.3 * case when share < 0.05 then share / 0.05 when share > 0.6 then greatest(0.0, 1 - (share - 0.6) / 0.3) else 1.0 end + 0.2 * least(1.0, share / 0.5) + 0.25 * case when page % 2 = 0 then 1.0 else 0.5 end + 0.15 * case when aspect between 0.3 and 3.0 then 1.0 else 0.5 end + 0.1 * case when y > 0.05 and y < 0.9 then 1.0 else 0.5 end, 6)) as bigint) as score_mille,
  share between 0.001 and 0.85 and not (x0 < 612 * 0.02 and w < 612 * 0.3 or y0 < 792 * 0.02 and h < 792 * 0.1) and aspect between 0.1 and 6.0 as plausible
from (select caption_id, coalesce(page, 1) as page, {_R} as share, (bbox.x1 - bbox.x0) / (bbox.y1 - bbox.y0) as aspect, bbox.y0 / 792.0 as y, bbox.x0 as x0, bbox.y0 as y0, bbox.x1 - bbox.x0 as w, bbox.y1 - bbox.y0 as h from captions where bbox is not null and bbox.y1 > bbox.y0)
""")
def fl13_pr41_region_scores(spark, d):
    b = F.col("bbox")
    c = table(spark, d, "captions").where("bbox is not null and bbox.y1 > bbox.y0")
    share = G.area(b) / (612.0 * 792.0)
    score = G.region_score(share, share, F.coalesce("page", F.lit(1)) % 2 == 0, G.width(b) / G.height(b), b["y0"] / 792.0)
    return c.select("caption_id", F.round(1000 * score).cast("long").alias("score_mille"), G.plausible_region(b, 612.0, 792.0, least=0.001).alias("plausible"))


@query("""
with a as (select caption_id, bbox.y0 - 3 as bottom, greatest(20.0, bbox.x0 - 10) as l, least(592.0, bbox.x1 + 10) as r from captions where bbox is not null), b as (select *, greatest(10.0, bottom - 792 * 0.35) as top, r - l < 612 * 0.3 as narrow, (l + r) / 2 as m from a)
select caption_id, round(case when narrow then greatest(20.0, m - 612 * 0.2) else l end, 4) as x0, round(top, 4) as y0, round(case when narrow then least(592.0, m + 612 * 0.2) else r end, 4) as x1, round(bottom, 4) as y1 from b where top < bottom
""")
def pr23_caption_anchored_boxes(spark, d):
    c = table(spark, d, "captions").where("bbox is not null").select("caption_id", G.caption_anchored(F.col("bbox"), 612.0, 792.0).alias("b")).where("b is not null")
    return c.select("caption_id", *(F.round(f"b.{k}", 4).alias(k) for k in ("x0", "y0", "x1", "y1")))


@query("select doc_id, cast(num as int) as num, title, cast(len(items) as int) as n_items from (select doc_id, row_number() over (partition by doc_id order by page) as num, title, items from " + _PAGES + ")")
def pr49_previews(spark, d):
    return P.preview(O.outline_pages(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id", "page", "title", "items")
