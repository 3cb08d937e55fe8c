"""Queries over decks, reports, plain-text outlines and regions, with their SQL; they register in ``plans.catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V
from litloom.operators import blocks as B
from litloom.operators import decks as D
from litloom.operators import figures as G
from litloom.operators import insights as I
from litloom.operators import library as L
from litloom.operators import outline_text as X
from litloom.operators import reports as R
from litloom.operators import search as S
from litloom.plans.catalogue import _BARE, _BLOCKS, _CAPS, _COVER, _NEAR, _OVER, _RESEARCH, _SECTIONS, _digital, _review_field, _tenth, query
from litloom.sources.sinks import joined_values
from litloom.sources.tables import table

# SQL fragments -------------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{T.SPACE}+', ' ', 'g'))"


def _list(lines) -> str:
    return "[" + ", ".join(_q(x) for x in lines) + "]"


def _stated(v: str) -> str:
    return f"list_filter(list_transform(coalesce({v}, []), lambda v: {_clean('v')}), lambda v: v <> '' and lower(v) <> 'not found')"


def _shorten(c: str, most: int) -> str:
    return f"case when length({c}) <= {most} then {c} else regexp_replace(substr({c}, 1, {most - 1}), '\\s+$', '') || '...' end"


def _emphasised(c: str) -> str:
    return "case " + " ".join(f"when strpos(lower({c}), '{w}') > 0 then substr({c}, 1, strpos(lower({c}), '{w}') - 1) || '**' || substr({c}, strpos(lower({c}), '{w}'), {len(w)}) || '**' || substr({c}, strpos(lower({c}), '{w}') + {len(w)})" for w in V.EMPHASIS) + f" else {c} end"


def _bullets(v: str, fallback: str, most: int = 5) -> str:
    short = f"list_transform(case when len({v}) > 0 then list_slice({v}, 1, {most}) else [{_q(fallback)}] end, lambda v: {_shorten('v', 260)})"
    return f"list_transform({short}, lambda v: '- ' || {_emphasised('v')})"


def _core(f: str) -> str:
    return f"core_insights['{f}']"


def _slides(parts) -> list[str]:
    out = []
    for part in parts:
        if len(part) == 2:
            out.append(_list(["---", "layout: section", f"subtitle: {part[0]}", "", f"# {part[1]}", ""]))
        else:
            title, fields, fallback, *most = part
            merged = _stated(_core(fields[0])) if len(fields) == 1 else "list_concat(" + ", ".join(_stated(_core(f)) for f in fields) + ")"
            if len(fields) == 3:
                merged = f"list_concat(list_concat({_stated(_core(fields[0]))}, {_stated(_core(fields[1]))}), {_stated(_core(fields[2]))})"
            out += [_list(["---", "", f"# {title}", ""]), _bullets(merged, fallback, *most), _list([""])]
    return out


def _flat(*lists: str) -> str:
    return "flatten([" + ", ".join(lists) + "])"


def _figures(of: str) -> str:
    lines = f"['---', '', '# Figure ' || coalesce(cast(f.number as varchar), ''), '', '- **Role**: Visual evidence extracted from the source {of}.', '- **Page**: ' || coalesce(cast(f.page as varchar), 'Unknown') || '.', '- **Caption**: ' || coalesce(nullif({_shorten(_clean('f.caption'), 220)}, ''), 'Caption unavailable.'), '', '![Figure ' || coalesce(cast(f.number as varchar), '') || '](' || f.image_path || ')', '']"
    return f"flatten(list_transform(figures, lambda f: {lines}))"


_NAME = "regexp_extract(pdf_path, '([^/\\\\]*)$', 1)"
_TITLE_OF = f"coalesce(nullif({_clean('metadata.title')}, ''), regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1'))"
_PEOPLE = f"array_to_string(list_filter(list_transform(coalesce(metadata.authors, []), lambda a: {_clean('a')}), lambda a: a <> ''), ', ')"


def _deck(review: bool) -> str:
    said = lambda c, d: f"coalesce(nullif({_clean(c)}, ''), '{d}')"
    kind = f"coalesce(list_extract({_stated(_core('review_type'))}, 1), 'Review literature')" if review else "'research'"
    head = [
        "['---', 'title: ' || " + _TITLE_OF + "]",
        _list(["author: Anna Berg", "affiliation: Institute", "date: 2024-01-31", "theme: academic-blue", "---", "", "# Paper Snapshot", ""]),
        f"['- **Title**: ' || {_TITLE_OF} || '.', '- **Authors**: ' || coalesce(nullif({_PEOPLE}, ''), 'Unknown') || '.', '- **Source**: ' || {said('metadata.journal', 'Unknown')} || ', ' || coalesce(nullif(cast(metadata.year as varchar), '0'), 'Unknown') || '.', '- **DOI**: ' || {said('metadata.doi', 'N/A')} || '.', '- **Paper Type**: ' || {kind} || '.', '']",
    ]
    last = [_list(["---", "", "# Take-Home Message", ""]), f"['- This deck was generated by **litloom** from `' || {_NAME} || '`.']"]
    if not review:
        mid = [*_slides(V.RESEARCH_DECK), f"case when len(figures) > 0 then list_concat({_list(['---', 'layout: section', 'subtitle: 03', '', '# Key Figures', ''])}, {_figures('paper')}) else [] end", *_slides(V.RESEARCH_DECK_END)]
        end = [_list(["- The workflow integrates **paper insight extraction**, **figure extraction**, and **HTML slide rendering**.", V.DECK_CAUTION])]
    else:
        tables = _stated(_core("key_tables_figures"))
        mid = [
            *_slides(V.REVIEW_DECK),
            f"case when len({tables}) > 0 or len(figures) > 0 then {_list(['---', 'layout: section', 'subtitle: 04', '', '# Important Figures and Tables', ''])} else [] end",
            f"case when len({tables}) > 0 then {_flat(_list(['---', '', '# Key Tables and Figures', '']), _bullets(tables, ''), _list(['']))} else [] end",
            _figures("review"),
            *_slides(V.REVIEW_DECK_END),
        ]
        end = [_list(["- The workflow detected review-literature structure and organized the deck around scope, taxonomy, evidence, controversy, and gaps.", V.DECK_CAUTION])]
    return f"array_to_string({_flat(*head, *mid, *last, *end)}, chr(10)) || chr(10)"


# decks and reports ------------------------------------------------------------------------------------------------------------


@query(f"""
with c as (select * from (select rec_id, number, page, caption_text as caption, 'figures/' || cast(caption_id as varchar) || '.png' as image_path, caption_id, row_number() over (partition by rec_id order by number nulls first, caption_id) as r from captions) where r <= 6),
     g as (select rec_id, list({{'number': number, 'page': page, 'caption': caption, 'image_path': image_path}} order by r) as figures from c group by rec_id),
     e as (select x.rec_id, x.pdf_path, x.metadata, x.paper_type, x.core_insights, coalesce(g.figures, []) as figures from extract_results x left join g on x.rec_id = g.rec_id where x.pdf_path is not null)
select rec_id, case when coalesce(paper_type, '') = 'review' then md5({_deck(True)}) else md5({_deck(False)}) end as deck from e
""")
def pr42_se4_pr13_paper_decks(spark, d):
    """The deck of every result with its first figures, as a digest of its Markdown."""
    c = table(spark, d, "captions")
    figures = D.first_figures(c, "rec_id", "number", "page", "caption_text", F.concat(F.lit("/deck/figures/"), F.col("caption_id").cast("string"), F.lit(".png")), "caption_id")
    e = table(spark, d, "extract_results").where("pdf_path is not null").join(figures, "rec_id", "left")
    deck = D.deck_markdown(F.coalesce(F.col("paper_type") == "review", F.lit(False)), F.col("metadata"), lambda f: F.col("core_insights")[f], F.col("figures"), F.col("pdf_path"), theme="academic-blue", author="Anna Berg", affiliation="Institute", date="2024-01-31", base="/deck")
    return e.select("rec_id", F.md5(deck).alias("deck"))


def _cover(f: str, kind: str) -> str:
    if kind == "research":
        return _tenth(f, *_COVER[f])
    sec, many = I.REVIEW_FIELDS[f]
    value = _review_field(f)
    rich = "2" if many else f"case when length(list_extract({value}, 1)) > 50 then 2 else 0 end"
    return f"cast(case when len({value}) = 0 then 0 else least(10, 5 + {rich} + case when length({sec}) > 0 then 3 else 0 end) end as int)"


_KIND = "case when " + " + ".join(f"regexp_matches(low, '{T.word(s)}')::int" for s in V.REVIEW_SIGNS) + f" >= greatest(1, len(regexp_extract_all(low, '{V.RESEARCH_SIGN}'))) then 'review' else 'research' end"


@query(f"""
with k as (select s.sec_id, {_KIND} as paper_type from (select sec_id, lower(coalesce(e.metadata.title, '') || chr(10) || substr(full_text, 1, 8000)) as low from sections x left join extract_results e on x.rec_id = e.rec_id where full_text is not null) s),
     r as (select sec_id, {', '.join(f'{_cover(f, "research")} as {f}' for f in V.RESEARCH_KEYS)} from {_RESEARCH}),
     v as (select sec_id, {', '.join(f'{_cover(f, "review")} as {f}' for f in V.REVIEW_KEYS)} from {_SECTIONS})
select k.sec_id, k.paper_type, {', '.join(f"case when k.paper_type = 'research' then r.{f} else 0 end as {f}" for f in V.RESEARCH_KEYS)}, {', '.join(f"case when k.paper_type = 'review' then v.{f} else 0 end as {f}" for f in V.REVIEW_KEYS)}
from k join r on k.sec_id = r.sec_id join v on k.sec_id = v.sec_id
""")
def ag8_ag9_fl5_batch_summary(spark, d):
    """The batch summary: a paper's type by title and text, and the coverage of all seventeen fields."""
    titles = table(spark, d, "extract_results").select("rec_id", F.col("metadata.title").alias("_title"))
    s = table(spark, d, "sections").where("full_text is not null").select("sec_id", "rec_id", "full_text").join(titles, "rec_id", "left")
    secs = I.sections(s, "sec_id", "full_text", "_title")
    found = I.insights(secs, "sec_id", I.paper_type(F.col("full_text"), F.col("_title")) == "review")
    return I.batch_summary(found, "sec_id")


def _hundredths(c: str) -> str:
    return f"printf('%.2f', coalesce({c}, 0))"


@query("""
select rec_id, coalesce(metadata.title, '') as "Title", array_to_string(list_filter(coalesce(metadata.authors, []), lambda a: a is not null), '; ') as "Authors", coalesce(metadata.journal, '') as "Journal", coalesce(cast(metadata.year as varchar), '') as "Year",
  case when coalesce(paper_type, '') = 'review' then 'review' else 'research' end as "Paper_Type", """ + ", ".join(f"cast(cast(round(coalesce(coverage_scores['{f}'], 0) * 10) as int) // 10 as varchar) || '.' || cast(cast(round(coalesce(coverage_scores['{f}'], 0) * 10) as int) % 10 as varchar) || '0' as \"{name}\"" for f, (_, name) in V.FIELD_LABELS.items()) + """, coalesce(status, '') as "Status", cast(coalesce(extraction_time, 0) as int) as "Seconds"
from extract_results
""")
def sk5_tr13_summary_sheet(spark, d):
    e = table(spark, d, "extract_results")
    tenths = lambda f: F.round(F.coalesce(F.col("coverage_scores")[f], F.lit(0.0)) * 10).cast("int")
    sheet = R.summary_sheet(F.col("metadata"), F.coalesce(F.col("paper_type") == "review", F.lit(False)), tenths, F.col("status"), F.col("extraction_time"))
    return e.select("rec_id", *sheet).withColumnRenamed("Time(s)", "Seconds")


_VALUES = lambda f: f"list_filter(coalesce({_core(f)}, []), lambda v: v is not null)"


def _field_markdown(f: str) -> str:
    v = _VALUES(f)
    tenths = f"cast(round(coalesce(coverage_scores['{f}'], 0) * 10) as int)"
    return f"flatten([['### {V.FIELD_LABELS[f][0]}'], case when len({v}) > 0 then list_transform({v}, lambda v: '  - ' || v) else ['  - Not found'] end, ['  - Coverage: ' || cast({tenths} // 10 as varchar) || '.' || cast({tenths} % 10 as varchar) || '0', '']])"


_AUTHORS = "list_filter(coalesce(metadata.authors, []), lambda a: a is not null)"


@query(f"""
select rec_id, md5(regexp_replace(array_to_string(flatten([['# Core Insights: ' || coalesce(nullif(metadata.title, ''), 'Unknown Title'), '', '## Metadata', '- **Authors:** ' || coalesce(nullif(array_to_string({_AUTHORS}, ', '), ''), 'Unknown'), '- **Journal:** ' || coalesce(nullif(metadata.journal, ''), 'Unknown'), '- **Year:** ' || coalesce(cast(metadata.year as varchar), 'Unknown'), '- **DOI:** ' || coalesce(nullif(metadata.doi, ''), 'N/A'),
  '- **Paper Type:** ' || case when coalesce(paper_type, '') = 'review' then 'review' else 'research' end, '- **Status:** ' || coalesce(status, 'unknown'), '- **Extraction Time:** ' || cast(coalesce(extraction_time, 0) as varchar) || 's', '', '## Core Insights'],
  case when coalesce(paper_type, '') = 'review' then flatten([{', '.join(_field_markdown(f) for f in V.REVIEW_KEYS)}]) else flatten([{', '.join(_field_markdown(f) for f in V.RESEARCH_KEYS)}]) end]), chr(10)), '\\s+$', '') || chr(10)) as markdown
from extract_results
""")
def sk4_result_markdown(spark, d):
    e = table(spark, d, "extract_results")
    core = lambda f: F.filter(F.col("core_insights")[f], lambda v: v.isNotNull())
    tenths = lambda f: F.round(F.coalesce(F.col("coverage_scores")[f], F.lit(0.0)) * 10).cast("int")
    text = R.result_markdown(F.col("metadata"), F.coalesce(F.col("paper_type") == "review", F.lit(False)), core, tenths, F.col("status"), F.col("extraction_time"))
    return e.select("rec_id", F.md5(text).alias("markdown"))


@query("""
select -1::bigint as place, '# Search Results: reef' || chr(10) as value union all
select hit_id, chr(10) || coalesce(title, '') || chr(10) || chr(10) || repeat('-', 40) from papers
""")
def sk2_report_lines(spark, d):
    p = table(spark, d, "papers").select("hit_id", F.coalesce("title", F.lit("")).alias("entry"))
    return R.report_lines(p, "reef", "hit_id", "entry")


@query("""
select cast(0 as int) as src_rank, hit_id from papers where source = 'arxiv' union all
select 1, hit_id from (select hit_id from papers where source = 'wos' order by hit_id limit 10)
""")
def sc6_so6_chosen_sources(spark, d):
    """All hits of one source and, as its limit has it, the first ten of another."""
    p = table(spark, d, "papers")
    part = lambda s: p.where(F.col("source") == s).select("hit_id")
    return S.chosen_sources({"arxiv": part("arxiv"), "wos": part("wos")}, "hit_id").select("src_rank", "hit_id")


_FIRST_LAST = "list_transform(list_filter(coalesce(authors, []), lambda a: a is not null), lambda a: split_part(a, ' ', 1) || '|' || case when strpos(a, ' ') > 0 then substr(a, strpos(a, ' ') + 1) else '' end)"


@query(f"""select hit_id, coalesce(title, '') as title, array_to_string({_FIRST_LAST}, '; ') as creators, coalesce(doi, '') as doi, coalesce(year, '') as date, coalesce(journal, '') as publication from papers""")
def pr11_summary_items(spark, d):
    """Hits written as summaries and read back as items: names part at their first space."""
    p = table(spark, d, "papers")
    people = F.transform(F.filter("authors", lambda a: a.isNotNull()), lambda a: F.struct(a.alias("name"), F.lit("Author").alias("authtype")))
    body = F.to_json(F.struct("title", F.col("journal").alias("fulljournalname"), F.col("year").alias("pubdate"), F.array(F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value"))).alias("articleids"), people.alias("authors")))
    i = p.select("hit_id", L.summary_item(body).alias("i"))
    names = F.array_join(F.transform("i.creators", lambda c: F.concat(c["lastName"], F.lit("|"), c["firstName"])), "; ")
    return i.select("hit_id", "i.title", names.alias("creators"), F.col("i.DOI").alias("doi"), "i.date", F.col("i.publicationTitle").alias("publication"))


# outlines ---------------------------------------------------------------------------------------------------------------------

_ROWS = f"list_transform(string_split(regexp_replace({_BARE('text')}, '{T.LINE_END}', chr(1), 'g'), chr(1)), lambda l: {_BARE('l')})"
_FIG = V.OUTLINE_FIGURE
_OUTLINES = f"""
(with t as (select doc_id, {_ROWS} as ls from documents where text is not null),
      k as (select doc_id, list_filter(ls, lambda l: l <> '' and (regexp_matches(l, '{_FIG}') or not (contains(l, ':') or contains(l, '：')))) as kept from t),
      l as (select doc_id, unnest(kept) as line, generate_subscripts(kept, 1) as n from k),
      h as (select *, regexp_matches(line, '{V.OUTLINE_HEADER}') and not regexp_matches(line, '{_FIG}') as header, sum((regexp_matches(line, '{V.OUTLINE_HEADER}') and not regexp_matches(line, '{_FIG}'))::int) over (partition by doc_id order by n) as part from l)
 select doc_id, part, max(case when header then coalesce(nullif({_BARE("regexp_extract(line, '^[0-9]+\\.\\s+([^\\n]+)', 1)")}, ''), nullif({_BARE("regexp_extract(line, '^[Pp][Aa][Rr][Tt]\\s+[0-9]+\\s*[:\\-]?\\s*([^\\n]*)', 1)")}, ''), line) end) as title,
        list(regexp_replace(line, '{V.OUTLINE_BULLET}', '') order by n) filter (where not header and not regexp_matches(line, '{_FIG}')) as plain, cast(count(*) filter (where regexp_matches(line, '{_FIG}')) as int) as n_figures
 from h where part > 0 group by doc_id, part)
"""


@query(f"""
with p as (select doc_id, part, title, list_filter(coalesce(plain, []), lambda x: x <> '') as items, n_figures, lower(title || ' ' || array_to_string(coalesce(plain, []), ' ')) as joined, len(list_filter(coalesce(plain, []), lambda l: regexp_matches(l, '(^|[^A-Za-z0-9_])20[0-9][0-9]([^A-Za-z0-9_]|$)'))) as dated from {_OUTLINES})
select doc_id, cast(part as varchar) as part_num, title, case when {' or '.join(f"contains(joined, '{w}')" for w in V.TIMELINE)} or dated > 0 then 'timeline' when {' or '.join(f"contains(joined, '{w}')" for w in V.DETAIL)} then 'content_detail' else 'content_list' end as page_type,
       cast(len(items) as int) as n_items, md5(array_to_string(items, chr(10))) as items, n_figures from p
""")
def fl10_wn2_tr9_pr46_outline_sections(spark, d):
    """Texts read as outlines: sections, page types and items; lines with a colon are no content."""
    o = X.outlines(table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", F.explode("sections").alias("s"))
    texts = X.page_texts(F.col("s.page.items"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))
    return o.select("doc_id", "s.part_num", "s.title", "s.page.page_type", F.size("s.page.items").alias("n_items"), F.md5(F.array_join(texts, "\n")).alias("items"), F.size("s.page.figures").alias("n_figures"))


def _head_field(name: str) -> str:
    kind = "case " + " ".join("when " + " or ".join(f"contains(k, '{w}')" for w in words) + f" then '{f}'" for f, words in V.OUTLINE_KEYS) + " else '' end"
    return f"coalesce(max_by(case when {kind} = '{name}' then v end, case when {kind} = '{name}' then n end), '') as {name}"


@query(f"""
with t as (select doc_id, {_ROWS} as ls from documents where text is not null),
     l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as n from t),
     p as (select doc_id, n, case when contains(line, ':') then lower({_BARE("substr(line, 1, strpos(line, ':') - 1)")}) else lower({_BARE("substr(line, 1, strpos(line, '：') - 1)")}) end as k, case when contains(line, ':') then {_BARE("substr(line, strpos(line, ':') + 1)")} else {_BARE("substr(line, strpos(line, '：') + 1)")} end as v from l where contains(line, ':') or contains(line, '：')),
     h as (select doc_id, {', '.join(_head_field(f) for f, _ in V.OUTLINE_KEYS)} from p group by doc_id)
select t.doc_id, {', '.join(f"coalesce(h.{f}, '') as {f}" for f, _ in V.OUTLINE_KEYS)} from t left join h on t.doc_id = h.doc_id
""")
def pr43_outline_heads(spark, d):
    """The head of each text read as an outline; the last line that names a field counts."""
    o = X.outlines(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return o.select("doc_id", *(F.col(f"head.{f}").alias(f) for f, _ in V.OUTLINE_KEYS))


@query(f"""
with m as (select caption_id, '<!-- fig: ' || coalesce(figure_type, 'figure') || ' ' || coalesce(cast(number as varchar), '?') || ' | path=' || coalesce(caption_text, '') || ' | position=' || case when caption_id % 2 = 0 then 'left' else 'top right' end || ' -->' as line from captions)
select caption_id, {_BARE(f"regexp_extract(line, '{_FIG}', 1)")} as label, {_BARE(f"regexp_extract(line, '{_FIG}', 2)")} as path, regexp_extract(line, '{_FIG}', 3) as position from m
""")
def pr48_figure_marks(spark, d):
    """Captions written as marks and read back; a place of two words is no mark, nor is a path with a bar."""
    mark = F.concat(F.lit("<!-- fig: "), F.coalesce("figure_type", F.lit("figure")), F.lit(" "), F.coalesce(F.col("number").cast("string"), F.lit("?")), F.lit(" | path="), F.coalesce("caption_text", F.lit("")), F.lit(" | position="), F.when(F.col("caption_id") % 2 == 0, F.lit("left")).otherwise(F.lit("top right")), F.lit(" -->"))
    return table(spark, d, "captions").select("caption_id", X.figure_mark(mark).alias("m")).select("caption_id", "m.*")


_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(content, '([.!?]){T.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_BARE('s')}), lambda s: length(s) > 20)"


@query(f"""
with r as (select *, row_number() over (partition by doc_id order by importance desc, pos) as rank from {_BLOCKS}),
     l as (select doc_id, rank, array_to_string(flatten([[cast(rank as varchar) || '. ' || coalesce(nullif(title, ''), 'Section ' || cast(rank as varchar))], list_transform(list_slice({_SENTENCES}, 1, 3), lambda s: '- ' || substr(s, 1, 160))]), chr(10)) as part from r where rank <= 12)
select doc_id, md5(string_agg(part, chr(10) order by rank)) as outline from l group by doc_id
""")
def pr47_block_outlines(spark, d):
    """The most important paragraphs of a text as an outline of sentences."""
    o = X.blocks_outline(B.blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id")
    return o.select("doc_id", F.md5("outline").alias("outline"))


@query("""
select hit_id, '[SEC0]' || coalesce(title, '') || coalesce(chr(10) || array_to_string(list_transform(list_filter(authors, lambda a: a is not null), lambda a, i: '[S0I' || cast(i - 1 as varchar) || ']' || a), chr(10)), '') as tagged, coalesce(title, '') as title_again from papers where len(list_filter(coalesce(authors, []), lambda a: a is not null)) > 0
""")
def pr38_tagged_sections(spark, d):
    """A hit's title and authors as a section: tagged, and brought back by their tags."""
    sec = F.array(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.filter("authors", lambda a: a.isNotNull()).alias("items")))
    p = table(spark, d, "papers").where(F.size(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.isNotNull())) > 0).select("hit_id", sec.alias("s"))
    tagged = X.tag_lines(F.col("s"))
    return p.select("hit_id", tagged.alias("tagged"), F.get(X.untagged(F.col("s"), tagged), F.lit(0))["title"].alias("title_again"))


@query("""
with x as (select caption_id, coalesce(length(caption_text), 0) as n, 300 + 10 * coalesce(number, 0) as w, 100 + 5 * coalesce(page, 0) as h from captions),
     y as (select *, greatest(1, w * 10 // 155) as per, greatest(1, h // 28) as room, greatest(1, cast(ceil(n * 1.0 / greatest(1, w * 10 // 155)) as bigint)) as need from x)
select caption_id, cast(case when n = 0 then 16 when need <= room then least(floor(least(16.0 * room / need, 20.8)), 28) else greatest(floor(16.0 * room / need), 10) end as int) as font,
  cast(case when n = 0 then 22 when n <= w * 28 // 1000 then 24 when n * 2 <= (w * 28 // 1000) * 3 then 22 else 18 end as int) as title_font from y
""")
def pr35_layout_fonts(spark, d):
    """Font sizes of captions in boxes of different sizes."""
    c = table(spark, d, "captions")
    w, h = F.lit(300) + 10 * F.coalesce("number", F.lit(0)), F.lit(100) + 5 * F.coalesce("page", F.lit(0))
    return c.select("caption_id", X.text_font(F.coalesce(F.length("caption_text"), F.lit(0)), w, h).alias("font"), X.title_font(F.coalesce("caption_text", F.lit("")), w).alias("title_font"))


# regions ----------------------------------------------------------------------------------------------------------------------

_SURE = "(i.caption_id % 10) / 10.0"
_MIDDLE = "(i.bbox.x0 + i.bbox.x1) / 2"
_OFF = f"greatest(0.0, 1 - 2 * abs({_MIDDLE} - (c.bbox.x0 + c.bbox.x1) / 2) / 612.0)"


@query(f"""
with p as (select c.rec_id, c.page, c.caption_id, i.caption_id as region_id, round(0.4 * {_OVER} + 0.4 * {_NEAR} + (0.1 * {_OFF} + 0.1 * {_SURE}), 6) as score
  from captions c join captions i on c.rec_id = i.rec_id and c.page = i.page and c.caption_id <> i.caption_id where c.bbox is not null and i.bbox is not null and i.bbox.y0 <= c.bbox.y0 and {_MIDDLE} between 0.0 and 400.0)
select caption_id, region_id, cast(round(score * 1000) as bigint) as score_mille from (select *, row_number() over (partition by rec_id, page, caption_id order by score desc, region_id) as r from p where score > 0.3) where r = 1
""")
def jn7_jn6_best_region(spark, d):
    """Boxes of other captions stand for regions, each with a confidence, within a column."""
    c = table(spark, d, "captions").where("bbox is not null").select("rec_id", "page", "caption_id", F.col("bbox").alias("caption_box"))
    i = c.select("rec_id", "page", F.col("caption_id").alias("region_id"), F.col("caption_box").alias("image_box"), ((F.col("caption_id") % 10) / 10.0).alias("confidence"))
    pairs = G.best_above(c, i, ["rec_id", "page"], "caption_id", "region_id", 612.0, 792.0, other=True, slack=0.0, confidence="confidence", column=(0.0, 400.0))
    return pairs.select("caption_id", "region_id", F.round(F.col("score") * 1000).cast("long").alias("score_mille"))


@query("""
select rec_id, page, greatest(0.0, min(bbox.x0) - 15) as x0, greatest(0.0, min(bbox.y0) - 15) as y0, least(612.0, max(bbox.x1) + 15) as x1, least(792.0, max(bbox.y1) + 15) as y1, cast(count(*) as bigint) as n_boxes
from captions where bbox is not null and bbox.x1 - bbox.x0 > 612 * 0.05 and bbox.y1 - bbox.y0 > 792 * 0.05 group by rec_id, page
""")
def ag20_padded_union(spark, d):
    return G.padded_union(table(spark, d, "captions").where("bbox is not null"), ["rec_id", "page"], "bbox", 612.0, 792.0)


@query("select caption_id, number, figure_type, row_number() over (partition by rec_id order by number nulls first, figure_type nulls first, caption_id)::int as pos from captions")
def so2_captions_by_number(spark, d):
    """Captions by number and type, with their place in their paper."""
    from pyspark.sql import Window

    c = G.by_number(table(spark, d, "captions"), "number", "figure_type", "caption_id")
    return c.select("caption_id", "number", "figure_type", F.row_number().over(Window.partitionBy("rec_id").orderBy("number", "figure_type", "caption_id")).alias("pos"))


@query("select caption_id, coalesce(column_hint, 0.0) as confidence from captions order by confidence desc, caption_id")
def so3_regions_by_confidence(spark, d):
    c = table(spark, d, "captions").select("caption_id", F.coalesce("column_hint", F.lit(0.0)).alias("confidence"))
    return G.by_confidence(c, "confidence", "caption_id")


@query("""
with x as (select rec_id, page, caption_id, lower(unnest(sublabels)) as letter, coalesce(column_hint, 0.0) % 100 as confidence from captions where sublabels is not null)
select rec_id, page, letter, caption_id, confidence from (select *, row_number() over (partition by rec_id, page, letter order by confidence desc, caption_id) as r from x where confidence > 35 and letter is not null) where r = 1
""")
def ag5_best_per_letter(spark, d):
    """The surest reading of each letter of a page; the place of a caption stands for a confidence."""
    c = table(spark, d, "captions").select("rec_id", "page", "caption_id", F.explode("sublabels").alias("_l"), (F.coalesce("column_hint", F.lit(0.0)) % 100).alias("confidence"))
    x = c.where("_l is not null").select("rec_id", "page", "caption_id", F.lower("_l").alias("letter"), "confidence")
    return G.best_per_letter(x, ["rec_id", "page"], "letter", "confidence", "caption_id").select("rec_id", "page", "letter", "caption_id", "confidence")


@query("select caption_id from captions where bbox is not null and (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) >= 0.02 * 612 * 792 and caption_id not in (select caption_id from captions where figure_type = 'figure')")
def fl14_large_unclaimed(spark, d):
    """Boxes of some size that no figure has claimed."""
    c = table(spark, d, "captions")
    return G.large_unclaimed(c.where("bbox is not null"), c.where("figure_type = 'figure'"), ["caption_id"], "bbox", 612.0, 792.0).select("caption_id")


@query("select rec_id, caption_id, caption_text from (select *, row_number() over (partition by rec_id order by caption_id) as r from captions where number = 2 and rec_id is not null) where r = 1")
def fl21_figure_of_number(spark, d):
    c = table(spark, d, "captions").where("rec_id is not null").select("rec_id", "caption_id", "number", "caption_text")
    return G.of_number(c, ["rec_id"], "number", 2, "caption_id").select("rec_id", "caption_id", "caption_text")


@query("select caption_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(coalesce(sublabels, []), lambda x: lower(x)), list_transform(coalesce(regexp_extract_all(caption_text, '\\(([a-h])\\)', 1), []), lambda x: lower(x))))), '') as labels from captions")
def se5_label_sets(spark, d):
    """A caption's labels and those in brackets in its text, as one set."""
    found = F.regexp_extract_all("caption_text", F.lit(r"\(([a-h])\)"), F.lit(1))
    return table(spark, d, "captions").select("caption_id", F.array_join(G.labels_of(F.filter("sublabels", lambda x: x.isNotNull()), found), "").alias("labels"))


@query(f"select type, cast(count(*) as bigint) as n, cast(sum(length(content)) as bigint) as chars from {_BLOCKS} where type = 'experiment' group by type")
def fl28_blocks_of_type(spark, d):
    b = B.of_type(B.blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "experiment")
    return b.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("""select rec_id, metadata.title as title, paper_type from extract_results where coalesce(metadata.doi, '') = '' and coalesce(paper_type, '') not in ('attachment', 'note')""")
def fl17_works_without_doi(spark, d):
    e = table(spark, d, "extract_results").select("rec_id", F.col("metadata.title").alias("title"), F.col("metadata.doi").alias("doi"), "paper_type")
    return L.without_doi(e, "doi", "paper_type").select("rec_id", "title", "paper_type")


@query(f"select sec_id, array_to_string(list_slice(list_filter({_CAPS}, lambda c: {'(' + ' or '.join(f'''contains(lower(c), '{w}')''' for w in V.KEY_CAPTION_TERMS) + ')'}), 1, 6), ' | ') as captions from sections where full_text is not null")
def fl4_so6_default_key_captions(spark, d):
    """The default terms, which few of these texts have."""
    return table(spark, d, "sections").where("full_text is not null").select("sec_id", joined_values(I.key_captions(F.col("full_text"))).alias("captions"))
