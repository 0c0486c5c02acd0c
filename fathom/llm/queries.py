"""The registered pN_ queries over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cut, exact_round, table
from . import components, leaks, lines, lookalike, mixing, quality, scans, spans, terms

Query = Callable[[SparkSession, str], DataFrame]


def reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").filter("section = 'strategic_report' and text is not null and text <> ''")


def records(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_records(table(spark, d, "ocr_pages"), table(spark, d, "sections"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_pairs(reports(spark, d))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_shares(reports(spark, d))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their kind: successive years of a company, its other reports, its club's, others'."""
    rows = reports(spark, d)
    return spans.link_kinds(spans.span_pairs(rows), rows, table(spark, d, "drift"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Reports linked by shared spans, each with its cluster and whether it is the one to keep."""
    found = components.connected_components(spans.span_links(reports(spark, d)), "u", "v")
    return found.select(F.col("id").alias("section_id"), F.col("component").alias("cluster_id"), (F.col("id") == F.col("component")).alias("keep"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.most_distinctive(terms.term_scores(reports(spark, d)))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every report with its weight and its log-likelihood ratio, rounded."""
    out = terms.term_scores(reports(spark, d))
    return out.withColumns({"weight": exact_round(F.col("weight")), "g2": exact_round(F.col("g2"), 4)})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(records(spark, d), ["tab", "rec_id"]).filter("n_flags >= 2").select("tab", "rec_id")


def p3_tails(spark: SparkSession, d: str) -> DataFrame:
    return quality.tail_report(quality.text_statistics(records(spark, d), ["tab", "rec_id"]), "tab")


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents' statistics, with percentiles within their language."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return quality.tail_report(quality.text_statistics(docs, ["doc_id", "lang"], language="lang"), "lang")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics themselves, of all pages and reports."""
    stats = quality.text_statistics(records(spark, d), ["tab", "rec_id"])
    return stats.withColumns({n: exact_round(F.col(n)) for n in quality.STATISTICS})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "ocr_pages"))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two or more lines."""
    return lines.repeated_blocks(table(spark, d, "ocr_pages"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """The pages' texts without the blocks (of one line and more) that their club repeats."""
    out = lines.without_repeated_lines(table(spark, d, "ocr_pages"))
    return out.select("page_id", "club", F.md5("text").alias("text_md5"), "n_removed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damage(records(spark, d), table(spark, d, "ocr_pages")).select("tab", "rec_id", "kind", "word").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_pages")
    rows = scans.page_records(pages, table(spark, d, "sections"), "club")
    decoder = scans.Decoder(pages)
    return scans.repaired(rows, scans.damage(rows.drop("club"), pages, decoder), scans.running_lines(pages), decoder)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """With one word of a window damaged, too, and the leaked share of each item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null and text <> ''")
    sizes = docs.select("doc_id", "source", F.col("n_chars").alias("size"))
    return mixing.Balance(sizes, table(spark, d, "source_weights")).targets().filter("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, in tokens of a public tokenizer."""
    return mixing.Balance(cut(mixing.token_sizes(table(spark, d, "documents"))), table(spark, d, "source_weights")).report()


def p7_feasible(spark: SparkSession, d: str) -> DataFrame:
    """The same at the largest total at which every source can hold its weight."""
    return mixing.Balance(cut(mixing.token_sizes(table(spark, d, "documents"))), table(spark, d, "source_weights"), feasible=True).report()


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """What each source has, in characters, and what it should give."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''")
    out = mixing.Balance(docs.select("doc_id", "source", F.col("n_chars").alias("size")), table(spark, d, "source_weights")).targets()
    return out.withColumn("target", exact_round(F.col("target"), 3))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    prints = lookalike.fingerprints(docs, counts=lookalike.code_point_counts(docs))
    return lookalike.alike_pairs(prints)


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that print like another one, stored alike or not, with their class."""
    docs = table(spark, d, "documents")
    return lookalike.alike_classes(lookalike.fingerprints(docs, counts=lookalike.code_point_counts(docs)))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lookalike.canonical_text(docs.select("doc_id", "text"), counts=lookalike.code_point_counts(docs))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_shares, p1_links, p1_clusters, p2_found, p2_terms, p3_found, p3_statistics, p3_tails, p3_documents, p4_found, p4_blocks, p4_clean, p5_found, p5_repaired, p6_found, p6_leaks, p7_found, p7_mix, p7_feasible, p7_targets, p8_found, p8_classes, p8_canonical)
}

_RECORDS = """
select 'ocr_pages' as tab, page_id as rec_id, text from ocr_pages
union all
select 'sections' as tab, section_id as rec_id, text from sections where section = 'strategic_report'
"""

# What prints alike, stated for the other engine: letters of other scripts with their Latin twins.
_TWINS = "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ɡg ʼ’ ‐- ‑-".split()
_WIDE = [chr(0xFF01 + i) + chr(0x21 + i) for i in range(94)]
_sql = lambda x: x.replace("'", "''")
_FROM, _TO = (_sql("".join(p[i] for p in _TWINS + _WIDE)) for i in (0, 1))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _printed(text: str) -> str:
    """SQL for the printed form of a text: invisible characters, spaces, width, twins, ligatures, composition."""
    out = f"regexp_replace({text}, '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    out = f"regexp_replace({out}, '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    out = f"translate({out}, '{_FROM}', '{_TO}')"
    for a, b in _LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


_ALIKE = f"prints as (select doc_id, text, {_printed('text')} as form from (select distinct on (doc_id) * from documents where text <> ''))"
_GRAM = "list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))"

_STATISTICS = rf"""
t as ({_RECORDS}),
u as (select tab, rec_id, any_value(text) as text from t where regexp_matches(text, '\S') group by tab, rec_id),
v as (
  select tab, rec_id, regexp_extract_all(lower(text), '[a-z]+') as words, regexp_extract_all(text, '\S+') as tokens,
    regexp_replace(text, '\s+', '', 'g') as solid, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as letters,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines
  from u
)
"""

ORACLES: dict[str, str] = {
    "p2_terms": r"""
with docs as (select section_id, any_value(text) as text from sections where section = 'strategic_report' and text <> '' group by section_id),
words as (
  select section_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[£$€]?\d[\d,.]*%?', ' ', 'g'), '[a-z][a-z''’-]*')) as term from docs
),
counts as (select section_id, term, count(*) as n from words group by all),
sizes as (select section_id, count(*) as n_tokens from words group by section_id),
totals as (select term, count(*) as n_docs, sum(n)::bigint as n_total from counts group by term),
t as (
  select section_id, term, n, n_tokens, n_docs, n_total, (select count(*) from docs) as docs_all, n::double as a, (n_total - n)::double as b, (n_tokens - n)::double as c,
    ((select count(*) from words) - n_tokens - n_total + n)::double as d, (select count(*) from words)::double as whole
  from counts join totals using (term) join sizes using (section_id)
)
select section_id, term, n, n_tokens, n_docs, n_total, format('{:.6f}', n * ln(docs_all / n_docs))::double as weight,
  format('{:.4f}', case when a * (b + d) < b * (a + c) then -2 else 2 end * (
    case when a > 0 then a * ln(a * whole / ((a + b) * (a + c))) else 0 end + case when b > 0 then b * ln(b * whole / ((a + b) * (b + d))) else 0 end
    + case when c > 0 then c * ln(c * whole / ((c + d) * (a + c))) else 0 end + case when d > 0 then d * ln(d * whole / ((c + d) * (b + d))) else 0 end))::double as g2
from t
""".replace("\\'", "'"),
    "p6_found": rf"""
with d as (select distinct doc_id, unnest({_GRAM}) as g from (select doc_id, regexp_extract_all(lower({_printed('text')}), '[\pL\pN]+') as w from documents where text <> '')),
i as (select distinct item_id, unnest({_GRAM}) as g from (select item_id, regexp_extract_all(lower({_printed('text')}), '[\pL\pN]+') as w from eval_items where text <> ''))
select distinct doc_id, item_id from d join i using (g)
""",
    "p8_found": f"with {_ALIKE} select a.doc_id as doc_a, b.doc_id as doc_b from prints a join prints b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text",
    "p8_classes": f"""
with {_ALIKE}
select doc_id, min(doc_id) over f as class_id, count(*) over f as n_alike, (select count(distinct text) from prints q where q.form = p.form) as n_forms
from prints p window f as (partition by form) qualify n_alike > 1
""",
    "p8_canonical": f"select doc_id, text, {_printed('text')} as canonical from documents",
    "p2_found": r"""
with docs as (select section_id, any_value(text) as text from sections where section = 'strategic_report' and text <> '' group by section_id),
words as (
  select section_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[£$€]?\d[\d,.]*%?', ' ', 'g'), '[a-z][a-z''’-]*')) as term from docs
),
counts as (select section_id, term, count(*) as n from words group by all),
sizes as (select section_id from words group by section_id having count(*) >= 200),
docs_with as (select term, count(*) as d from counts group by term)
select section_id, term from counts join docs_with using (term) join sizes using (section_id)
qualify row_number() over (partition by section_id order by n * ln((select count(*) from docs) / d) desc, term) = 1
""",
    "p3_statistics": rf"""
with {_STATISTICS},
w as (
  select tab, rec_id, len(tokens) as n_tokens,
    len(list_filter(words, lambda x: x in ('the','of','and','to','in','a','for','is','on','by','with','as','at','from','that','was','be','are','or','this'))) / nullif(len(words), 0) as f,
    (length(solid) - letters) / length(solid) as s, length(solid) / len(tokens) as m, len(list_filter(lines, lambda x: x[-1] in ('.', '!', '?'))) / len(lines) as l
  from v
)
select tab, rec_id, n_tokens, format('{{:.6f}}', f)::double as function_share, format('{{:.6f}}', s)::double as symbol_share, format('{{:.6f}}', m)::double as mean_token, format('{{:.6f}}', l)::double as stop_line_share,
  coalesce(f < 0.15, true)::int + (s > 0.25)::int + (m < 3.2 or m > 8.5)::int + (l < 0.02)::int as n_flags
from w
""",
    "p3_found": rf"""
with t as ({_RECORDS}),
u as (select tab, rec_id, any_value(text) as text from t where regexp_matches(text, '\S') group by tab, rec_id),
v as (
  select tab, rec_id, regexp_extract_all(lower(text), '[a-z]+') as words, regexp_extract_all(text, '\S+') as tokens,
    regexp_replace(text, '\s+', '', 'g') as solid, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as letters,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines
  from u
)
select tab, rec_id from v where
  (len(words) = 0 or len(list_filter(words, lambda x: x in ('the','of','and','to','in','a','for','is','on','by','with','as','at','from','that','was','be','are','or','this'))) / len(words) < 0.15)::int
  + ((length(solid) - letters) / length(solid) > 0.25)::int
  + (length(solid) / len(tokens) < 3.2 or length(solid) / len(tokens) > 8.5)::int
  + (len(list_filter(lines, lambda x: x[-1] in ('.', '!', '?'))) / len(lines) < 0.02)::int >= 2
""",
    "p4_found": r"""
with pages as (select page_id, any_value(club) as club, any_value(text) as text from ocr_pages where club is not null group by page_id),
lines as (select distinct page_id, club, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) as line from pages),
totals as (select club, count(*) as pages from pages group by club)
select club, line from lines join totals using (club) where line <> '' group by club, line, pages having count(*) >= 5 and 5 * count(*) >= pages
""",
    "p4_clean": r"""
with pages as (select page_id, any_value(club) as club, any_value(text) as text from ocr_pages group by page_id),
rows as (select page_id, club, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from pages),
lines as (select *, trim(regexp_replace(raw, '\s+', ' ', 'g')) as line from rows),
totals as (select club, count(*) as pages from pages where club is not null group by club),
often as (
  select club, line from (select distinct page_id, club, line from lines where line <> '') join totals using (club) group by club, line, pages having count(*) >= 5 and 5 * count(*) >= pages
),
kept as (
  select page_id, string_agg(raw, chr(10) order by i) filter (o.line is null) as left_text, count(o.line) as n from lines l left join often o on l.club = o.club and l.line = o.line group by page_id
)
select p.page_id, p.club, md5(case when p.text is null then null when n > 0 then coalesce(left_text, '') else p.text end) as text_md5, coalesce(n, 0) as n_removed
from pages p left join kept using (page_id)
""",
    "p4_blocks": r"""
with recursive pages as (select page_id, any_value(club) as club, any_value(text) as text from ocr_pages where club is not null group by page_id),
rows as (select page_id, club, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from pages),
lines as (select page_id, club, line, row_number() over (partition by page_id order by k) as i from rows where line <> ''),
totals as (select club, count(*) as pages from pages group by club),
often as (select club, line from (select distinct page_id, club, line from lines) join totals using (club) group by club, line, pages having count(*) >= 5 and 5 * count(*) >= pages),
seen as (select l.* from lines l join often using (club, line)),
blocks as (
  select page_id, club, i, 1 as n, line as lines, (select count(*) from seen) as some from seen
  union all
  select * exclude (pages, on_pages) from (
    select b.page_id, b.club, b.i, b.n + 1 as n, b.lines || chr(10) || s.line as lines, b.some, t.pages, count(distinct b.page_id) over (partition by b.club, b.n, b.lines || chr(10) || s.line) as on_pages
    from blocks b join seen s on s.page_id = b.page_id and s.i = b.i + b.n join totals t on t.club = b.club
  ) where on_pages >= 5 and 5 * on_pages >= pages
),
longest as (select page_id, club, i, max(n) as n, arg_max(lines, n) as lines from blocks group by all),
free as (
  select a.* from longest a where not exists (select 1 from longest b where b.page_id = a.page_id and b.i = a.i - 1 and b.n > a.n)
),
counted as (select club, lines, n, count(distinct page_id) as n_pages from blocks group by all)
select distinct f.club, f.lines, f.n::int as n_lines, c.n_pages from free f join counted c on c.club = f.club and c.lines = f.lines and c.n = f.n where f.n >= 2
""",
    "p7_targets": """
with t as (select lower(trim(source)) as source, n_chars from documents where text <> ''),
have as (select source, count(*) as n, sum(n_chars) as s from t group by source),
w as (select lower(trim(source)) as source, weight, max_repeat, weight * (select sum(n_chars) from t)::bigint as target from source_weights)
select w.source, weight, max_repeat, coalesce(n, 0) as n_docs, coalesce(s, 0)::bigint as size, format('{:.3f}', target)::double as target, coalesce(s, 0) * max_repeat < target as short
from w left join have h on h.source = w.source
""",
    "p7_found": """
with t as (select lower(trim(source)) as source, n_chars from documents where text <> ''),
have as (select source, sum(n_chars) as s from t group by source)
select lower(trim(w.source)) as source from source_weights w left join have h on h.source = lower(trim(w.source))
where coalesce(h.s, 0) * max_repeat < weight * (select sum(n_chars) from t)
""",
}
