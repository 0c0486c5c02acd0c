"""The registered queries in SQL, for the side-by-side check on another engine."""

_q = lambda s: s.replace("'", "''")

# The common words of the text-quality test, as in the functions but stated on their own.
COMMON = "the and of to in for a is on as at by with that from are was were be this group company year its has have"


def _same(a: str, b: str) -> str:
    return f"{a}.club is not distinct from {b}.club and {a}.company_number is not distinct from {b}.company_number and {a}.year = {b}.year"


_PAGES = """
pages as (
  select club, company_number, year, page, page_id, coalesce(text, '') as text from (select distinct on (page_id) * from ocr_pages)
  qualify row_number() over (partition by club, company_number, year, page order by scanned_at desc nulls last, page_id desc) = 1
)
"""

LATEST_PAGES = f"with {_PAGES} select club, company_number, year, page, page_id from pages"

PAGE_QUALITY = f"""
with {_PAGES},
q as (
  select club, company_number, year, page, len(regexp_extract_all(text, '[A-Za-z]+')) as n_words,
    len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains(string_split('{COMMON}', ' '), w))) as n_common,
    length(text) as chars, length(regexp_replace(text, '[^\\pL\\pN\\s]+', '', 'g')) as alpha
  from pages
)
select club, company_number, year, page, n_words,
  case when n_words > 0 then format('{{:.4f}}', n_common / n_words)::double else 0.0 end as common_word_ratio,
  case when n_words > 0 then format('{{:.4f}}', alpha / greatest(chars, 1))::double else 0.0 end as alpha_ratio
from q
"""

# The headings, stated anew in this engine's dialect.
_GROUP = r"(consolidated\s+|group\s+|company\s+)?"
_TIME = r"(\s+for\s+the\s+(year|period).*)?"
_HEADINGS = [
    ("strategic_report", r"(the\s+)?strategic\s+report(\s+and\s+(the\s+)?(report\s+of\s+the\s+)?directors[’'`]?s?\s*(report)?)?"),
    ("directors_report", r"(the\s+)?(report\s+of\s+the\s+directors|directors[’'`]?s?\s+report)(\s+for\s+the\s+year.*)?"),
    ("auditors_report", r"(independent\s+)?auditors?[’'`]?s?\s+report.*|report\s+of\s+the\s+(independent\s+)?auditors.*"),
    ("profit_and_loss", _GROUP + r"(profit\s+and\s+loss\s+account|income\s+statement|statement\s+of\s+(comprehensive\s+income|profit\s+or\s+loss)(\s+and\s+other\s+comprehensive\s+income)?)"
        r"(\s+and\s+(the\s+)?statement\s+of\s+other\s+comprehensive\s+income)?" + _TIME),
    ("notes", r"notes\s+(to|forming\s+part\s+of)\s+the\s+(consolidated\s+|group\s+)?(financial\s+statements|accounts)" + _TIME),
    ("balance_sheet", _GROUP + r"(balance\s+sheet|statement\s+of\s+financial\s+position)(\s+as\s+at.*)?"),
    ("cash_flow", _GROUP + r"(statement\s+of\s+)?cash\s*flow(\s+statement|s?)" + _TIME),
    ("changes_in_equity", _GROUP + r"statement\s+of\s+changes\s+in\s+(equity|shareholders[’'`]?\s*funds).*"),
    ("company_information", r"company\s+information|officers\s+and\s+professional\s+advis(e|o)rs|directors\s+and\s+advis(e|o)rs"),
    ("contents", "contents"),
]
_RULES = " ".join(f"when regexp_full_match(core, '(?i)(?:{_q(p)})') then '{n}'" for n, p in _HEADINGS)
_LINES = rf"""
{_PAGES},
split as (
  select club, company_number, year, page, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
    len(string_split(text, chr(10))) as n
  from pages
),
numbered as (select *, trim(line, ' ' || chr(9) || chr(13)) as t from split where not (line_no = n - 1 and line = '')),
cores as (
  select *, case when length(t) between 3 and 90 and not regexp_matches(t, '\.{{3,}}|\s\.\s\.\s') then
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\d{{1,2}}[.)]?\s+', ''), '\s\d{{1,3}}$', ''), '(?i)[\s(\[]*\bcontinued\b[)\]\s]*$', ''), '^[^0-9A-Za-z(]+|[^0-9A-Za-z)]+$', '', 'g') end as core
  from numbered
),
lines as (select *, case {_RULES} end as heading from cores)
"""
HEADINGS = f"with {_LINES} select club, company_number, year, page, line_no, t as line, heading from lines where heading is not null"

_DENSE = rf"""
{_LINES},
dense as (
  select club, company_number, year, page from lines group by all
  having (count(heading) >= 4 and count(*) filter (t <> '') < 40) or (bool_or(lower(t) = 'contents') and count(heading) >= 3)
)
"""
DENSE_PAGES = f"with {_DENSE} select club, company_number, year, page from dense"

_CARRIED = f"""
{_DENSE},
opened as (
  select l.*, case when d.page is null and l.heading <> 'contents' then l.heading end as opens
  from lines l left join dense d on l.club is not distinct from d.club and l.company_number is not distinct from d.company_number and l.year = d.year and l.page = d.page
),
carried as (
  select *, coalesce(last_value(opens ignore nulls) over (partition by club, company_number, year order by page, line_no rows between unbounded preceding and current row), 'front_matter') as section
  from opened
)
"""
SECTIONS = rf"""
with {_CARRIED}
select club, company_number, year, section, md5(regexp_replace(string_agg(line, chr(10) order by page, line_no), '^\s+|\s+$', '', 'g')) as text_md5
from carried where opens is null group by club, company_number, year, section
"""
EVENTS = f"""
with {_CARRIED}
select club, company_number, year, page, line_no, opens as section, t as line from carried where opens is not null
qualify opens <> lag(opens, 1, 'front_matter') over (partition by club, company_number, year order by page, line_no)
"""

_PARSED = rf"""
{_CARRIED},
quality as (
  select club, company_number, year, count(*) as n_pages, sum(n_words) as total_words, coalesce(sum(r * n_words) / nullif(sum(n_words), 0), 0.0) as ratio
  from (
    select *, case when n_words > 0 then format('{{:.4f}}', n_common / n_words)::double else 0.0 end as r from (
      select club, company_number, year, len(regexp_extract_all(text, '[A-Za-z]+')) as n_words, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains(string_split('{COMMON}', ' '), w))) as n_common from pages
    )
  ) group by club, company_number, year
),
skipped as (select club, company_number, year, string_agg(page::varchar, ';' order by page) as contents_pages_skipped from dense group by all),
texts as (
  select club, company_number, year, section, length(regexp_replace(string_agg(line, chr(10) order by page, line_no), '^\s+|\s+$', '', 'g')) as n
  from carried where opens is null group by club, company_number, year, section
),
sizes as (
  select club, company_number, year, string_agg(section || '=' || n, ';' order by section) as section_chars, coalesce(max(n) filter (section = 'strategic_report'), 0) as n_strategic,
    coalesce(max(n) filter (section = 'directors_report'), 0) as n_directors, coalesce(max(n) filter (section = 'profit_and_loss'), 0) as n_profit, coalesce(max(n) filter (section = 'notes'), 0) as n_notes
  from texts group by all
),
joint as (
  select distinct club, company_number, year, true as c from opened where opens = 'strategic_report'
    and regexp_full_match(regexp_replace(regexp_replace(t, '^\d{{1,2}}[.)]?\s+', ''), '^[ .:\-–—]+|[ .:\-–—]+$', '', 'g'), '(?i)(the\s+)?strategic\s+report\s+and\s+(the\s+)?(report\s+of\s+the\s+)?directors[’''`]?s?\s*(report)?')
),
events as (
  select club, company_number, year, page, line_no, opens as section, t as line from carried where opens is not null
  qualify opens <> lag(opens, 1, 'front_matter') over (partition by club, company_number, year order by page, line_no)
),
hits as (
  select club, company_number, year, string_agg(page || '|' || section || '|' || line, ';' order by page, line_no) as heading_hits from events group by all
),
firsts as (
  select club, company_number, year, string_agg(section, ';' order by page, line_no) as sections_detected from (
    select * from events qualify row_number() over (partition by club, company_number, year, section order by page, line_no) = 1
  ) group by all
),
parsed as (
  select q.club, q.company_number, q.year, n_pages, total_words, format('{{:.4f}}', ratio)::double as common_word_ratio, coalesce(n_strategic, 0) as n_strategic, coalesce(n_directors, 0) as n_directors,
    coalesce(n_profit, 0) as n_profit, coalesce(n_notes, 0) as n_notes,
    concat_ws(';', case when total_words < 500 then 'empty_text_layer' when ratio < 0.08 then 'suspect_text_layer' end, case when coalesce(n_strategic, 0) = 0 then 'missing_section:strategic_report' end,
      case when coalesce(n_directors, 0) = 0 then 'missing_section:directors_report' end, case when coalesce(n_profit, 0) = 0 then 'missing_section:profit_and_loss' end,
      case when coalesce(n_notes, 0) = 0 then 'missing_section:notes' end, case when coalesce(n_strategic, 0) < 2000 then 'short_strategic_report' end) as flags,
    coalesce(sections_detected, '') as sections_detected, coalesce(c, false) as combined_strategic_and_directors_report, coalesce(heading_hits, '') as heading_hits,
    coalesce(contents_pages_skipped, '') as contents_pages_skipped, coalesce(section_chars, '') as section_chars
  from quality q
  left join skipped k on {_same("q", "k")} left join sizes z on {_same("q", "z")} left join joint j on {_same("q", "j")}
  left join hits h on {_same("q", "h")} left join firsts f on {_same("q", "f")}
)
"""
PARSED = f"with {_PARSED} select * exclude (n_strategic, n_directors, n_profit, n_notes) from parsed"
FILING_CHECK = f"""
with {_PARSED}
select club, company_number, year, n_pages, n_strategic as strategic_report, n_directors as directors_report, n_profit as profit_and_loss, n_notes as notes, replace(flags, ';', ',') as flags,
  n_strategic < 2000 as short from parsed
"""

CORPUS = """
with s as (
  select *, length(coalesce(text, '')) as n_chars from (select distinct on (section_id) * from sections)
  qualify row_number() over (partition by club, company_number, year, section order by parsed_at desc nulls last, section_id desc) = 1
)
select section, count(*) as n_filings, sum(n_chars) as n_chars, count(*) filter (n_chars < 2000) as n_short from s group by section
"""

_TABLES = r"""
len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z]{3,}') and len(regexp_extract_all(x, '\(?-?\d[\d,]*\)?')) >= 2))
"""
_ORPHANS = _TABLES.replace("regexp_matches(x", "not regexp_matches(x")
SPLIT_TABLES = f"""
with {_PAGES}, t as (select *, {_TABLES} as table_rows, {_ORPHANS} as orphan_rows from pages)
select club, company_number, year, page, table_rows, orphan_rows, orphan_rows >= 3 and table_rows < orphan_rows as looks_split from t
"""
BETTER = f"""
with {_PAGES},
earlier as (
  select club, company_number, year, page, text, {_TABLES} as n from (select distinct on (page_id) * from ocr_pages) o where page_id not in (select page_id from pages)
  qualify row_number() over (partition by club, company_number, year, page order by scanned_at desc nulls last, page_id desc) = 1
),
raw as (select page_id, any_value(text) as raw_text from ocr_pages group by page_id),
t as (select *, {_TABLES} as table_rows, {_ORPHANS} as orphan_rows from pages join raw using (page_id))
select t.club, t.company_number, t.year, t.page, coalesce(e.text is not null and e.n > table_rows, false) as repaired,
  md5(case when e.text is not null and e.n > table_rows then e.text else t.raw_text end) as text_md5
from t left join earlier e on t.club is not distinct from e.club and t.company_number is not distinct from e.company_number and t.year = e.year and t.page = e.page
where orphan_rows >= 3 and table_rows < orphan_rows
"""

NUMBERS = r"""
with tokens as (select distinct unnest(regexp_split_to_array(text, '[ \n]+')) as raw from sections where section = 'profit_and_loss'),
t as (
  select raw, replace(replace(replace(trim(raw, '()'), ',', ''), '−', '-'), '–', '-') as inner_text from tokens where raw <> ''
),
u as (select *, starts_with(inner_text, '-') as minus, case when starts_with(inner_text, '-') then substr(inner_text, 2) else inner_text end as body from t)
select raw,
  case when raw in ('-', '–', '—') then 0.0
    when not regexp_full_match(body, '\d+(?:\.\d+)?') then null
    when minus or (starts_with(raw, '(') and ends_with(raw, ')')) then -(body::double) else body::double end as value,
  regexp_full_match(raw, '\d{4}') and coalesce(try_cast(raw as int) between 1990 and 2100, false) as is_year
from u
"""

UNITS = rf"""
with t as (
  select distinct section_id, text from sections where section = 'profit_and_loss' and text is not null
),
u as (
  select section_id, len(regexp_extract_all(text, '(?i)[£€E]\s*[’''`]?\s*m\b|£\s*million|in\s+millions')) as m,
    len(regexp_extract_all(text, '(?i)[£€E]\s*[’''`7]?\s*0{{3}}(?:[^\d,]|$)|in\s+thousands')) as k
  from t
)
select section_id, case when m + k > 0 and m >= k then 1000000 else 1000 end as multiplier,
  case when m + k = 0 then 'default: £''000 (no unit marker found)' when m >= k then 'section: £m' else 'section: £''000' end as evidence
from u
"""

_ITEM_ROWS = "items as (select distinct * exclude (cross_check, restated_next_year) from line_items)"
_CHECKED = """
checked as (
  select a.club, a.company_number, a.year, a.item, a.value_gbp, b.comparative_gbp as later, a.confidence,
    a.value_gbp is not null and b.comparative_gbp is not null as known,
    abs(a.value_gbp::double - b.comparative_gbp) / greatest(abs(a.value_gbp::double), abs(b.comparative_gbp::double), 1.0) <= 0.01 as agrees
  from items a left join items b
    on a.club is not distinct from b.club and a.company_number is not distinct from b.company_number and a.item = b.item and b.year = (a.year::int + 1)::varchar
),
said as (
  select club, company_number, year, item, value_gbp,
    case when known and agrees then 'agrees with ' || year || '+1 comparative'
      when known then 'MISMATCH: ' || (year::int + 1) || ' filing restates this as ' || format('{:,.0f}', later::double) end as cross_check,
    case when known and not agrees then later end as restated_next_year,
    case when known and not agrees then 'low' else confidence end as confidence
  from checked
)
"""
CROSS_CHECK = f"with {_ITEM_ROWS}, {_CHECKED} select * from said"
_SAID_SERIES = """
middle as (
  select club, company_number, item, median(abs(value_gbp::double)) as mid from said
  where item in ('revenue', 'wages', 'player_amortisation') and value_gbp is not null group by all having count(*) >= 2 and mid <> 0
),
r as (
  select s.*, m.mid, abs(s.value_gbp::double) / m.mid as ratio
  from said s left join middle m on s.club is not distinct from m.club and s.company_number is not distinct from m.company_number and s.item = m.item
),
tested as (
  select club, company_number, year, item, value_gbp,
    case when coalesce(ratio < 0.25 or ratio > 4.0, false)
      then coalesce(cross_check || '; ', '') || 'OUTLIER: ' || format('{:.2f}', ratio) || 'x this club''s median ' || item || ' (' || format('{:,.0f}', mid) || ')'
      else cross_check end as cross_check,
    restated_next_year, case when coalesce(ratio < 0.25 or ratio > 4.0, false) then 'low' else confidence end as confidence
  from r
)
"""
SERIES_CHECK = f"with {_ITEM_ROWS}, {_CHECKED}, {_SAID_SERIES} select * exclude (restated_next_year) from tested"

_TOKENS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[£$€]?\d[\d,.]*%?', ' ', 'g'), '[a-z][a-z''’-]*')"
TOKENS = f"select section_id, len({_TOKENS}) as n_tokens, len(list_distinct({_TOKENS})) as n_terms from (select distinct section_id, text from sections)"

_REPORTS = f"""
reports as (
  select club, company_number, year, section_id as doc, length(coalesce(text, '')) as chars, {_TOKENS} as tokens
  from (select distinct on (section_id) * from sections where section = 'strategic_report')
  qualify row_number() over (partition by club, company_number, year order by parsed_at desc nulls last, section_id desc) = 1
),
scored as (select * from reports where chars >= 2000 and len(tokens) >= 200)
"""
EXCLUDED = f"""
with {_REPORTS}
select club, company_number, year, case when chars < 2000 then 'short_strategic_report' else 'too_few_tokens' end as reason
from reports where chars < 2000 or len(tokens) < 200
"""
BLOCKED = f"""
with {_PARSED}, {_REPORTS},
r as (
  select r.*, coalesce(list_filter(string_split(p.flags, ';'), lambda x: list_contains(['empty_text_layer', 'suspect_text_layer', 'short_strategic_report'], x)),
    case when chars < 2000 then ['short_strategic_report'] else [] end) as blocking
  from reports r left join parsed p on {_same("r", "p")}
)
select club, company_number, year, case when len(blocking) > 0 then array_to_string(blocking, ',') else 'too_few_tokens' end as reason from r where len(blocking) > 0 or len(tokens) < 200
"""
_PAIRS = f"""
{_REPORTS},
pairs as (
  select club, company_number, lag(year) over w as year_prev, year, lag(doc) over w as doc_prev, doc, lag(tokens) over w as a, tokens as b
  from scored window w as (partition by club, company_number order by year) qualify doc_prev is not null
)
"""
YEAR_PAIRS = f"with {_PAIRS} select club, company_number, year_prev, year, doc_prev, doc from pairs"
_TFIDF = f"""
{_PAIRS},
counts as (select club, company_number, doc, term, count(*) as n from (select club, company_number, doc, unnest(tokens) as term from scored) group by all),
dfs as (select club, company_number, term, count(*) as df from counts group by all),
sizes as (select club, company_number, count(*) as n_docs from scored group by all),
raw as (
  select c.doc, c.term, (1 + ln(n)) * (ln((1.0 + n_docs) / (1.0 + df)) + 1) as w
  from counts c join dfs d on c.club is not distinct from d.club and c.company_number is not distinct from d.company_number and c.term = d.term
  join sizes s on c.club is not distinct from s.club and c.company_number is not distinct from s.company_number
),
norms as (select doc, sqrt(sum(w * w)) as norm from raw group by doc),
weights as (select doc, term, w / norm as weight from raw join norms using (doc))
"""
TFIDF = f"with {_TFIDF} select doc, term, format('{{:.6f}}', weight)::double as weight from weights"
DRIFT = f"""
with {_TFIDF},
dots as (
  select p.doc_prev, p.doc, sum(x.weight * y.weight) as dot
  from pairs p join weights x on x.doc = p.doc_prev join weights y on y.doc = p.doc and y.term = x.term group by all
),
m as (
  select club, company_number, year_prev, year, len(a) as n_tokens_prev, len(b) as n_tokens, coalesce(dot, 0.0) as cos,
    len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as jac
  from pairs left join dots using (doc_prev, doc)
)
select club, company_number, year_prev, year, n_tokens_prev, n_tokens,
  format('{{:.6f}}', cos)::double as cosine_similarity, format('{{:.6f}}', 1 - cos)::double as cosine_novelty,
  format('{{:.6f}}', jac)::double as jaccard_similarity, format('{{:.6f}}', 1 - jac)::double as jaccard_novelty
from m
"""
_SURPRISAL = """
seqs as (select doc, list_concat(['<s>', '<s>'], tokens, ['</s>']) as s from scored),
grams as (select doc, s[i] as w1, s[i + 1] as w2, s[i + 2] as w3 from (select doc, s, unnest(range(1, len(s) - 1)) as i from seqs)),
tri as (select doc, w1, w2, w3, count(*) as c from grams group by all),
two as (select doc, w2, w3, count(*) as n2 from tri group by all),
one as (select doc, w3, count(*) as n1 from (select doc, w2, w3 from two union all select doc, '<s>', '<s>' from scored) group by all),
c3 as (select doc, w1, w2, sum(c) as d3, count(*) as f3 from tri group by all),
c2 as (select doc, w2, sum(n2) as d2, count(*) as f2 from two group by all),
c1 as (select doc, sum(n1) as d1, count(*) as f1 from one group by all),
v as (select doc, count(distinct w3) + 1 as v from tri group by doc),
p as (
  select p.doc_prev, p.doc, t.c as times, greatest(coalesce(m3.c, 0) - 0.75, 0) as o3, d3, f3, greatest(coalesce(n2, 0) - 0.75, 0) as o2, d2, f2,
    greatest(coalesce(n1, 0) - 0.75, 0)::double / d1 + 0.75 * f1 / d1 / v as p1, v
  from pairs p join tri t on t.doc = p.doc
  left join tri m3 on m3.doc = p.doc_prev and m3.w1 = t.w1 and m3.w2 = t.w2 and m3.w3 = t.w3
  left join c3 on c3.doc = p.doc_prev and c3.w1 = t.w1 and c3.w2 = t.w2
  left join two on two.doc = p.doc_prev and two.w2 = t.w2 and two.w3 = t.w3
  left join c2 on c2.doc = p.doc_prev and c2.w2 = t.w2
  left join one on one.doc = p.doc_prev and one.w3 = t.w3
  join c1 on c1.doc = p.doc_prev join v on v.doc = p.doc_prev
),
q as (select *, case when d2 is null then p1 else o2::double / d2 + 0.75 * f2 / d2 * p1 end as p2 from p),
r as (select *, case when d3 is null then p2 else o3::double / d3 + 0.75 * f3 / d3 * p2 end as p3 from q),
bits as (select doc_prev, doc, sum(-log2(greatest(p3, 1.0 / (v * 64))) * times) / sum(times) as mean_bits from r group by all)
"""
SURPRISAL = f"""
with {_PAIRS}, {_SURPRISAL}
select club, company_number, year_prev, year, format('{{:.6f}}', mean_bits)::double as surprisal_bits from pairs join bits using (doc_prev, doc)
"""
FULL_DRIFT = f"""
with lexical as ({DRIFT}), bits as ({SURPRISAL})
select l.*, b.surprisal_bits from lexical l join bits b on l.club is not distinct from b.club and l.company_number is not distinct from b.company_number and l.year = b.year
"""
SANITY = f"""
with {_REPORTS},
sample as (
  select club, company_number, year, tokens as t, len(tokens) as n from scored
  qualify row_number() over (order by club nulls first, company_number nulls first, year desc) = 1
),
pairs as (
  select 1 as doc_prev, 1 as doc from sample union all select 1, 2 from sample
),
docs as (select 1 as doc, t as tokens from sample union all select 2, list_transform(range(n), lambda i: t[(i * 7) % n + 1]) from sample),
{_SURPRISAL.replace("scored", "docs")}
select club, company_number, year, n as n_tokens, 0.0::double as identical_cosine_novelty, 1.0 - len(list_intersect(t, t)) / len(list_distinct(t)) as identical_jaccard_novelty,
  format('{{:.6f}}', a.mean_bits)::double as identical_surprisal_bits, format('{{:.6f}}', b.mean_bits)::double as shuffled_surprisal_bits,
  true as identical_cosine_novelty_near_zero, true as identical_jaccard_novelty_zero, b.mean_bits > a.mean_bits as shuffled_more_surprising_than_identical
from sample, (select mean_bits from bits where doc = 1) a, (select mean_bits from bits where doc = 2) b
"""

_RANKING = """
r as (
  select club, count(*) as n_pairs, format('{:.6f}', sum(cosine_novelty::decimal(20,6))::double / count(cosine_novelty))::double as mean_cosine_novelty, max(cosine_novelty) as max_cosine_novelty,
    format('{:.6f}', sum(jaccard_novelty::decimal(20,6))::double / count(jaccard_novelty))::double as mean_jaccard_novelty, format('{:.6f}', sum(surprisal_bits::decimal(20,6))::double / count(surprisal_bits))::double as mean_surprisal_bits, max(surprisal_bits) as max_surprisal_bits
  from (select distinct * from drift) group by club
)
"""
RANKING = f"with {_RANKING} select * from r"
ORDERED = f"with {_RANKING} select row_number() over (order by mean_cosine_novelty desc, club) as place, club, mean_cosine_novelty from r"
RANKING_TABLE = f"""
with {_RANKING}
select row_number() over (order by mean_cosine_novelty desc, club) as place, club, format('{{:.3f}}', mean_cosine_novelty) as mean_cosine_novelty,
  format('{{:.3f}}', max_cosine_novelty) as max_cosine_novelty, format('{{:.2f}}', mean_surprisal_bits) as mean_surprisal_bits from r
"""
DRIFT_TABLE = """
select club, company_number, year_prev || '→' || year as pair, format('{:.3f}', cosine_novelty) as cosine_novelty,
  format('{:.3f}', jaccard_novelty) as jaccard_novelty, format('{:.2f}', surprisal_bits) as surprisal_bits from (select distinct * from drift)
"""

_KINDS = ["group", "full", "medium", "small", "total-exemption-full", "micro-entity", "dormant"]
_RANK = "case accounts_type " + " ".join(f"when 'accounts-with-accounts-type-{k}' then {i}" for i, k in enumerate(_KINDS)) + " end"
_FILINGS = f"filings as (select distinct club, company_number, company_name, filing_date, accounts_type, transaction_id, made_up_date, {_RANK} as kind from manifest)"
_SUMMARY = f"""
{_FILINGS},
ranked as (
  select *, row_number() over (partition by company_number order by coalesce(filing_date, '') desc, transaction_id) as rn, count(*) over (partition by company_number) as total
  from filings where kind is not null
),
summary as (
  select company_number, any_value(total) as accounts_filings, string_agg(accounts_type, ',' order by rn) as recent_descriptions, min(kind) as best_rank,
    count(*) filter (kind < 3) as n_usable_recent, arg_min(filing_date, rn) as latest_date
  from ranked where rn <= 6 group by company_number
)
"""
ACCOUNTS = f"with {_SUMMARY} select * from summary"
RESOLVE = f"""
with {_SUMMARY},
c as (
  select c.*, coalesce(best_rank, 7) as best_rank, coalesce(n_usable_recent, 0) as n_usable_recent, latest_date
  from (select club, company_number, min(company_name) as title from filings group by all) c left join summary using (company_number)
)
select *, row_number() over (partition by club order by best_rank, n_usable_recent desc, coalesce(try_cast(replace(latest_date, '-', '') as int), 0) desc, company_number) as place, place = 1 as chosen from c
"""
CANDIDATES = r"""
with f as (select distinct club, company_number, company_name as title, lower(company_name) as name, replace(club, '-', ' ') as q from manifest where coalesce(company_number, '') <> ''),
ok as (
  select * from f where not regexp_matches(name, 'supporters|fan club|ladies|travel club|foundation|charitable|community sports')
    and (regexp_split_to_array(regexp_replace(name, '^the\s+', ''), '[\s,.]+')[1] = string_split(q, ' ')[1] or contains(name, string_split(q, ' ')[1]) or contains(name, q))
)
select club, company_number, coalesce(min(title) filter (contains(name, string_split(q, ' ')[1])), min(title)) as title from ok group by all
"""
PICKED = f"""
with {_FILINGS},
periods as (
  select * from filings where kind < 3
  qualify row_number() over (partition by club, company_number, coalesce(nullif(made_up_date, ''), filing_date, '') order by coalesce(filing_date, '') desc, transaction_id desc) = 1
)
select club, company_number, transaction_id, substr(coalesce(nullif(made_up_date, ''), filing_date, ''), 1, 4) as year,
  row_number() over (partition by club, company_number order by coalesce(filing_date, '') desc, transaction_id desc) as place
from periods qualify place <= 3
"""
LABELS = """
select transaction_id, substr(coalesce(nullif(made_up_date, ''), filing_date, ''), 1, 4) as year_label,
  coalesce(try_cast(replace(made_up_date, '-', '') as int), 0) as date_key, nullif(string_split(rtrim(path, '/'), '/')[-1], '') as document
from (select distinct * from manifest)
"""
UPSERT = """
select club, company_number, year, transaction_id from (select distinct * from manifest)
where accounts_type is not null
qualify row_number() over (partition by club, company_number, year order by (accounts_type = 'accounts-with-accounts-type-group') desc, filing_date desc, transaction_id desc) = 1
"""
NOT_SCORED = """
select distinct club, company_number, year from manifest m
where not exists (select 1 from drift s where s.club = m.club and s.company_number is not distinct from m.company_number and s.year = m.year)
"""
WORK = """
with done as (select distinct club, company_number, year, year::int % 2 + 1 as method from ocr_pages),
w as (
  select m.club, m.company_number, m.year, case when d.club is null then 'missing' when method <> 2 then 'method ' || method || ' != 2' end as reason
  from (select distinct club, company_number, year from manifest) m
  left join done d on d.club = m.club and d.company_number is not distinct from m.company_number and d.year = m.year
)
select *, starts_with(reason, 'method ') as reuse_text from w where reason is not null
"""
COMPLETE = """
with c as (select distinct club from ocr_pages), e as (select distinct club from manifest),
f as (select club, count(*) as n from (select distinct club, transaction_id, bytes from manifest) where bytes > 0 group by club)
select coalesce(bool_and(c.club is not null and e.club is not null and coalesce(n, 0) >= 3), false) as complete
from c full join e on c.club = e.club left join f on f.club = coalesce(c.club, e.club)
"""

_MONEY = lambda c: f"coalesce(format('{{:,.1f}}', {c}::double / 1000000), '—')"
ITEMS_TABLE = f"""
with i as (select distinct * from line_items),
w as (
  select club, company_number, year, {", ".join(f"min(value_gbp) filter (item = '{n}') as {n}" for n in ("revenue", "wages", "player_amortisation", "profit_on_disposal"))}
  from i group by all
)
select club, company_number, year, {", ".join(f"{_MONEY(n)} as {n}" for n in ("revenue", "wages", "player_amortisation", "profit_on_disposal"))} from w
"""
_CORRECTED = "with i as (select distinct * replace (coalesce(restated_next_year, value_gbp) as value_gbp) from line_items)"
VALIDATED_TABLE = ITEMS_TABLE.replace("with i as (select distinct * from line_items)", _CORRECTED)
ALIGNMENT = f"""
with i as (select distinct * from line_items), d as (select distinct * from drift),
y as (select club, company_number, year, min(value_gbp) filter (item = 'profit_on_disposal') as v from i group by all)
select y.club, y.company_number, y.year, {_MONEY("v")} as profit_on_disposal,
  coalesce(format('{{:.3f}}', d.cosine_novelty), '— (no prior year)') as cosine_novelty, coalesce(format('{{:.2f}}', d.surprisal_bits), '—') as surprisal_bits
from y left join d on d.club = y.club and d.company_number is not distinct from y.company_number and d.year = y.year
"""
VALIDATED_ALIGNMENT = ALIGNMENT.replace("with i as (select distinct * from line_items)", _CORRECTED)
VALIDATION = r"""
select club, company_number, year, item, coalesce('£' || format('{:,.0f}', value_gbp::double), '—') as value, confidence,
  coalesce(case when starts_with(cross_check, 'agrees') and contains(cross_check, 'OUTLIER') then 'ok; **' || regexp_extract(cross_check, 'OUTLIER.*') || '**'
    when starts_with(cross_check, 'agrees') then 'ok' when starts_with(cross_check, 'MISMATCH') then '**' || cross_check || '**' else nullif(cross_check, '') end, '—') as "check",
  coalesce(nullif(source_section, ''), '—') as section, coalesce(nullif(replace(source_snippet, '|', '\|'), ''), '—') as source_row
from (select distinct * from line_items)
"""
CONFIDENCE = "select confidence, count(*) as n, count(value_gbp) as disclosed from (select distinct * from line_items) group by confidence"
