"""Line items in SQL: rows that wrap, rule tables, figures, totals and checks, stated anew.

The dialect has no look-ahead: what must not follow a label is a second test, and a dash that stands
alone is replaced by a sign of its own, in two passes, before figures are read.
"""

from .sql import _CARRIED, _CHECKED, _SAID_SERIES

# Signs that stand for a lone dash of each kind, and units.
_DASHES = [("–", "\ue000"), ("—", "\ue001"), ("-", "\ue002")]
_WORD = r"\pL\pN_-"
_MILLIONS = r"(?i)[£€E]\s*[’''`]?\s*m\b|£\s*million|in\s+millions"
_THOUSANDS = r"(?i)[£€E]\s*[’''`7]?\s*0{3}(?:[^\d,]|$)|in\s+thousands"
_NOTE = r"(?i)[(\[]?\s*(?:see\s+)?notes?\s+\d{1,2}\s*[)\]]?"
_FIGURE = r"\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?|[" + "".join(s for _, s in _DASHES) + "]"


def _marked(x: str) -> str:
    """``x`` with lone dashes replaced; neighbours overlap, so every pass runs twice."""
    for dash, sign in _DASHES:
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^{_WORD}]){dash}([^{_WORD}]|$)', '\1{sign}\2', 'g')"
    return x


def _no_notes(x: str) -> str:
    return f"regexp_replace({x}, '{_NOTE}', ' ', 'g')"


def _some_figure(x: str) -> str:
    return rf"regexp_matches({x}, '\d|(^|[^{_WORD}])[-–—]([^{_WORD}]|$)')"


# What one printed figure is worth, and a row's figures as structs.
_MACROS_VALUE = r"""
list_transform(regexp_extract_all({marked}, '{figure}'), lambda r: struct_pack(
  raw := translate(r, '{signs}', '{dashes}'),
  value := case when r in ({sign_list}) then 0.0
    when starts_with(trim(r, '()'), '-') or (starts_with(r, '(') and ends_with(r, ')')) then -(replace(ltrim(trim(r, '()'), '-'), ',', '')::double)
    else replace(trim(r, '()'), ',', '')::double end))
"""


def _figures(marked: str) -> str:
    signs = "".join(s for _, s in _DASHES)
    return _MACROS_VALUE.format(marked=marked, figure=_FIGURE, signs=signs, dashes="".join(d for d, _ in _DASHES), sign_list=", ".join(f"'{s}'" for s in signs)).strip()


def _steps(source: str, keep: str) -> str:
    """CTEs from ``figs`` of ``source`` with ``multiplier`` to ``picked``: clean figures, the total
    column, the current figure and the comparative."""
    return rf"""
sorted_out as (
  select *, list_filter(figs, lambda f: f.raw in ('-', '–', '—') or starts_with(f.raw, '(') or contains(f.raw, ',') or contains(f.raw, '.') or abs(f.value) >= 100) as big,
    list_filter(figs, lambda f: contains(f.raw, '.')) as decimals from {source}
),
cleaned as (
  select {keep}, case when len(big) between 1 and len(figs) - 1 then big
    when multiplier = 1000000 and len(decimals) > 0 and not contains(figs[1].raw, '.') and abs(figs[1].value) < 100 then decimals else figs end as f
  from sorted_out
),
totals as (
  select *, list_filter(range(3, len(f) + 1), lambda k: abs(list_sum(list_transform(f[1:k - 1], lambda x: x.value)) - f[k].value) <= 1 and f[k].value <> 0)[1] as total_at from cleaned
),
picked as (
  select *, f[coalesce(total_at, 1)].value as now, f[coalesce(total_at, 1)].raw as now_raw,
    case when len(f) >= 2 then f[case when total_at is null then 2 else 2 * total_at end].value end as before
  from totals
)
"""


# total_at counts from 1 here: column k (from 0) is k + 1, and 2 k + 1 (from 0) is 2 (k + 1).

_TEXTS = rf"""
{_CARRIED},
texts as (
  select club, company_number, year, section, regexp_replace(string_agg(line, chr(10) order by page, line_no), '^\s+|\s+$', '', 'g') as text
  from carried where opens is null group by club, company_number, year, section
),
marks as (
  select *, row_number() over () as sid, len(regexp_extract_all(text, '{_MILLIONS}')) as m, len(regexp_extract_all(text, '{_THOUSANDS}')) as k from texts
),
whole as (
  select club, company_number, year, len(regexp_extract_all(t, '{_MILLIONS}')) as wm, len(regexp_extract_all(t, '{_THOUSANDS}')) as wk
  from (select club, company_number, year, string_agg(text, chr(10) order by section) as t from texts group by all)
),
units as (
  select s.*, case when m + k > 0 then case when m >= k then 1000000 else 1000 end when wm + wk > 0 and wm >= wk then 1000000 else 1000 end as multiplier,
    case when m + k > 0 then 'section: ' || case when m >= k then '£m' else '£''000' end when wm + wk > 0 then 'document: ' || case when wm >= wk then '£m' else '£''000' end
      else 'default: £''000 (no unit marker found)' end as evidence
  from marks s join whole w on s.club is not distinct from w.club and s.company_number is not distinct from w.company_number and s.year = w.year
  where s.section in ('profit_and_loss', 'notes', 'strategic_report') and text <> ''
),
text_lines as (
  select sid, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from units
),
trimmed as (select sid, i, rtrim(raw, ' ' || chr(9) || chr(13)) as line from text_lines),
joined as (
  select sid, i, line as row, false as goes_on from trimmed where i = 1
  union all
  select l.sid, l.i, case when c then trim(j.row) || ' ' || trim(l.line) else l.line end, c
  from (select *, regexp_matches(line, '^\s*[a-z]') as low from trimmed) l join joined j on l.sid = j.sid and l.i = j.i + 1,
    lateral (select l.low and not {_some_figure(_no_notes("j.row"))} as c)
),
table_rows as (
  select sid, row_number() over (partition by sid order by i) - 1 as row_no, row
  from (select *, lead(goes_on, 1, false) over (partition by sid order by i) as more from joined) where not more
),
clean_rows as (
  select u.club, u.company_number, u.year, u.section, u.multiplier, u.evidence, r.row_no, {_no_notes("regexp_replace(r.row, '^[-–—*•·:;|>»_ \t]+', '')")} as row, {_no_notes("r.row")} as plain
  from table_rows r join units u using (sid)
)
"""

# Label rules as (tier, pattern, what must not follow).
_ON = r"^\s*(?:\(loss\)\s*/\s*)?(?:net\s+)?(?:profit|gain|surplus|loss(?:es)?)(?:\s*/\s*\(?(?:loss|profit)\)?)?\s+on\s+(?:the\s+)?disposals?"
_RULES = {
    "revenue": [
        (1, r"^\s*(?:group\s+|total\s+)?turnover\b", r"\s+by\b"),
        (1, r"^\s*(?:group\s+|total\s+)?revenue\b", r"\s+recognition"),
        (2, r"^\s*turnover\s+and\s+(?:group\s+)?operating", None),
    ],
    "wages": [
        (1, r"^\s*(?:total\s+)?staff\s+costs\b", r"\s*:"),
        (1, r"^\s*(?:total\s+)?employee\s+(?:costs|benefit\s+expense)\b", None),
        (2, r"^\s*wages\s+and\s+salaries\b", None),
    ],
    "player_amortisation": [
        (1, r"^\s*amortisation\s+(?:charge\s+)?(?:of|on)\s+(?:players?[’''`]?s?\s+registrations?|player\s+registrations?)", None),
        (1, r"^\s*(?:players?[’''`]?s?\s+registrations?|player\s+registrations?)\s+amortisation", None),
        (2, r"^\s*amortisation\s+of\s+intangible\s+(?:fixed\s+)?assets\b", None),
        (2, r"^\s*amortisation\s+(?:charged?|expense)\b", None),
    ],
    "profit_on_disposal": [
        (1, _ON + r"\s+of\s+(?:tangible\s+)?fixed\s+assets?(?:\s+investments?)?\b", None),
        (1, _ON + r"\s+of\s+(?:a\s+)?(?:subsidiar(?:y|ies)|business(?:es)?|investments?|propert(?:y|ies)|fellow\s+group\s+(?:compan(?:y|ies)|undertakings?))", None),
        # a plural may give its s back, so the last test only holds for the singular
        (2, _ON, r"(?:[^s]|$)NOT"),
    ],
    "profit_on_disposal_players": [
        (1, _ON + r"\s+of\s+players?[’''`]?s?(?:\s+registrations?)?\b", None),
        (1, _ON + r"\s+of\s+intangible\s+(?:fixed\s+)?assets\b", None),
        (2, r"^\s*profits?\s+(?:arising\s+)?on\s+player\s+(?:sales|trading)\b", None),
    ],
}
_PLAYERS = r"\s+of\s+(?:the\s+)?(?:players?[’''`]?s?\b|intangible\s+(?:fixed\s+)?assets\b)"
_PLACES = {"revenue": ["profit_and_loss", "notes", "strategic_report"], "wages": ["notes", "profit_and_loss"], "player_amortisation": ["notes", "profit_and_loss"]}


def _rule_rows(items: list[str]) -> str:
    rows = []
    for item in items:
        for n, (tier, pattern, never) in enumerate(_RULES[item]):
            if never and never.endswith("NOT"):
                never = pattern.removesuffix("s?") + _PLAYERS
            elif never:
                never = pattern + never
            said = f"'(?i){never}'" if never else "null"
            rows.append(f"('{item}', {n}, {tier}, '(?i){pattern}', {said})")
    return ", ".join(rows)


def _item_ctes(items: list[str]) -> str:
    places = " ".join(f"when '{i}' then list_position([{', '.join(repr(s) for s in _PLACES.get(i, ['profit_and_loss', 'notes']))}], section)" for i in items)
    return rf"""
rules (item, n, tier, pattern, never) as (values {_rule_rows(items)}),
hits as (
  select r.*, u.item, u.n, u.tier, length(regexp_extract(row, pattern, 0)) as label_end, case u.item {places} end as place
  from clean_rows r join rules u on regexp_matches(row, pattern) and (never is null or not regexp_matches(row, never))
),
placed as (select *, substr({_marked("row")}, label_end + 1) as rest from hits where place is not null),
first_rule as (
  select *, {_figures("rest")} as figs from placed where regexp_matches(rest, '{_FIGURE}')
  qualify row_number() over (partition by club, company_number, year, section, row_no, item order by n) = 1
),
{_steps("first_rule", "club, company_number, year, section, multiplier, evidence, row_no, row, item, tier, place")},
best as (
  select *, left(regexp_replace(trim(row), '\s+', ' ', 'g'), 220) as snippet, now * multiplier as value, before * multiplier as comparative, len(f) as n_figures from picked
  qualify row_number() over (partition by club, company_number, year, item order by tier, case when tier = 1 then place else 0 end, -least(len(f), 3), place, row_no) = 1
),
every as (select distinct club, company_number, year, item from texts, (select distinct item from rules)),
found as (
  select e.club, e.company_number, e.year, e.item,
    round_even(case when e.item in ('wages', 'player_amortisation') then abs(value) when regexp_matches(snippet, '(?i)^\s*(?:net\s+)?loss(?:es)?\s+on\s') and value > 0 then -value else value end, 0)::bigint as value_gbp,
    round_even(comparative, 0)::bigint as comparative_gbp, section as source_section, snippet as source_snippet,
    case when tier is null then 'none'
      when starts_with(evidence, 'default') then 'low'
      when n_figures < 2 then case when tier = 1 and not starts_with(evidence, 'document') then 'medium' else 'low' end
      when tier = 1 and not starts_with(evidence, 'document') and n_figures = 2 then 'high' else 'medium' end as confidence,
    case when tier is null then 'no matching row found'
      else evidence || '; matched tier ' || tier || '; took figure ''' || now_raw || ''' of ' || n_figures || ' on row' ||
        case when n_figures > 2 then '; row has ' || n_figures || ' figures, took the ' || case when total_at is not null then 'computed total column' else 'first column' end else '' end end as note
  from every e left join best b on e.club is not distinct from b.club and e.company_number is not distinct from b.company_number and e.year = b.year and e.item = b.item
)
"""


_DERIVED = rf"""
wage_rows as (
  select *, {_figures(_marked("plain"))} as figs from clean_rows
  where section in ('notes', 'profit_and_loss')
),
{_steps("wage_rows", "club, company_number, year, section, multiplier, evidence, row_no, row, figs")},
usable as (select * from picked where now is not null and not (regexp_full_match(now_raw, '\d{{4}}') and now between 1990 and 2100)),
starts as (select club, company_number, year, section, multiplier, evidence, row_no as start from clean_rows where section in ('notes', 'profit_and_loss') and regexp_matches(row, '(?i)^\s*wages\s+and\s+salaries\b')),
runs as (
  select s.*, list(now order by row_no)[1:9] as v from starts s join usable p
    on p.club is not distinct from s.club and p.company_number is not distinct from s.company_number and p.year = s.year and p.section = s.section and p.row_no between s.start and s.start + 39
  group by all
),
choices as (
  select *, unnest(list_filter(flatten(list_transform(range(1, greatest(len(v) - 1, 2)), lambda a: list_transform(range(a + 2, len(v) + 1), lambda b: struct_pack(a := a, b := b)))),
    lambda r: v[r.b] <> 0 and v[r.a] <> 0 and abs(list_sum(v[r.a:r.b - 1]) - v[r.b]) <= 1)[1:1]) as run from runs where len(v) >= 3
),
derived as (
  select club, company_number, year, 'wages' as item, round_even(v[run.b] * multiplier, 0)::bigint as value_gbp, section as source_section,
    'derived total staff costs: ' || array_to_string(list_transform(v[run.a:run.b - 1], lambda x: format('{{:,.0f}}', x)), ' + ') || ' = ' || format('{{:,.0f}}', v[run.b]) as source_snippet,
    evidence || '; summed from the components in the employees note (no labelled total is printed)' as note
  from choices qualify row_number() over (partition by club, company_number, year order by (section <> 'notes')::int, start) = 1
)
"""
_COLUMNS = "club, company_number, year, item, value_gbp, comparative_gbp, source_section, source_snippet, confidence, note"

DERIVED_TOTALS = f"with recursive {_TEXTS}, {_DERIVED} select * from derived"
CONTEXT_ITEMS = f"with recursive {_TEXTS}, {_item_ctes(['profit_on_disposal_players'])} select {_COLUMNS} from found"

_ITEMS = ["revenue", "wages", "player_amortisation", "profit_on_disposal"]
_FOUND = f"with recursive {_TEXTS}, {_item_ctes(_ITEMS)} select {_COLUMNS} from found"
_FULL = rf"""
items as (
  select i.* replace (
    case when u then d.value_gbp else i.value_gbp end as value_gbp, case when u then null else comparative_gbp end as comparative_gbp, case when u then d.source_section else i.source_section end as source_section,
    case when u then d.source_snippet else i.source_snippet end as source_snippet, case when u then 'medium' else confidence end as confidence, case when u then d.note else i.note end as note)
  from ({_FOUND}) i left join ({DERIVED_TOTALS}) d on i.club is not distinct from d.club and i.company_number is not distinct from d.company_number and i.year = d.year and i.item = d.item,
    lateral (select d.item is not null and (i.value_gbp is null or coalesce(regexp_matches(i.source_snippet, '(?i)^\s*wages\s+and\s+salaries\b'), false)) as u)
)
"""
EXTRACTED_ITEMS = rf"""
with {_FULL}, {_CHECKED}, {_SAID_SERIES}
select {", ".join("i." + c for c in _COLUMNS.split(", ") if c != "confidence")}, t.confidence, t.cross_check, t.restated_next_year
from items i join tested t on i.club is not distinct from t.club and i.company_number is not distinct from t.company_number and i.year = t.year and i.item = t.item
"""

ROW_FIGURES = rf"""
with lines as (select distinct unnest(string_split(text, chr(10))) as line from (select distinct text from sections where section = 'profit_and_loss')),
rows as (select line, 1000 as multiplier, {_figures(_marked(_no_notes("line")))} as figs from lines),
{_steps("rows", "line")}
select line, len(f) as n_figures, now as "current", before as comparative, total_at - 1 as total_column from picked
"""

_PRINTED = r"""
select club, company_number, year, kind, item, coalesce('£' || format('{:,.0f}', value_gbp::double), '—') as value, confidence, "check", section,
  coalesce(nullif(replace(source_snippet, '|', '\|'), ''), '—') as source_row
"""
SHEET = rf"""
with items as ({_FOUND}), {_CHECKED},
rows as (
  select i.club, i.company_number, i.year, 'item' as kind, i.item, i.value_gbp, t.confidence, i.source_snippet, coalesce(i.source_section, '—') as section,
    coalesce(case when starts_with(t.cross_check, 'agrees') then 'ok' when starts_with(t.cross_check, 'MISMATCH') then '**' || t.cross_check || '**' end, '—') as "check"
  from items i join said t on i.club is not distinct from t.club and i.company_number is not distinct from t.company_number and i.year = t.year and i.item = t.item
  union all by name
  select club, company_number, year, 'context' as kind, item, value_gbp, '' as confidence, source_snippet, '' as section, '' as "check" from ({CONTEXT_ITEMS})
)
{_PRINTED} from rows
"""
