"""Text functions as Column expressions: lines, headings, quality, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import let

# Regular expressions run in Java. (?iuU) gives them the Unicode classes and case rules that the
# expected results assume; (?d) lets only \n end a line.
FLAGS = "(?iuU)"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Section headings in order, the first match wins; each must match the whole line.
HEADING_RULES: list[tuple[str, str]] = [
    ("strategic_report", r"(?:the\s+)?strategic\s+report\s+and\s+(?:the\s+)?(?:report\s+of\s+the\s+)?directors[’'`]?s?\s*(?:report)?"),
    ("strategic_report", r"(?:the\s+)?strategic\s+report"),
    ("directors_report", r"(?:the\s+)?(?:report\s+of\s+the\s+directors|directors[’'`]?s?\s+report)(?:\s+for\s+the\s+year.*)?"),
    ("auditors_report", r"(?:independent\s+)?auditors?[’'`]?s?\s+report.*|report\s+of\s+the\s+(?:independent\s+)?auditors.*"),
    (
        "profit_and_loss",
        r"(?:consolidated\s+|group\s+|company\s+)?(?:profit\s+and\s+loss\s+account|income\s+statement|statement\s+of\s+(?:comprehensive\s+income|profit\s+or\s+loss)(?:\s+and\s+other\s+comprehensive\s+income)?)(?:\s+and\s+(?:the\s+)?statement\s+of\s+other\s+comprehensive\s+income)?(?:\s+for\s+the\s+(?:year|period).*)?",
    ),
    ("notes", r"notes\s+(?:to|forming\s+part\s+of)\s+the\s+(?:consolidated\s+|group\s+)?(?:financial\s+statements|accounts)(?:\s+for\s+the\s+(?:year|period).*)?"),
    ("balance_sheet", r"(?:consolidated\s+|group\s+|company\s+)?(?:balance\s+sheet|statement\s+of\s+financial\s+position)(?:\s+as\s+at.*)?"),
    ("cash_flow", r"(?:consolidated\s+|group\s+|company\s+)?(?:statement\s+of\s+)?cash\s*flow(?:\s+statement|s?)(?:\s+for\s+the\s+(?:year|period).*)?"),
    ("changes_in_equity", r"(?:consolidated\s+|group\s+|company\s+)?statement\s+of\s+changes\s+in\s+(?:equity|shareholders[’'`]?\s*funds).*"),
    ("company_information", r"(?:company\s+information|officers\s+and\s+professional\s+advis(?:e|o)rs|directors\s+and\s+advis(?:e|o)rs)"),
    ("contents", r"contents"),
]
# A line without any of these words is no heading; one cheap test spares the rules.
HEADING_WORDS = ["report", "profit", "income", "comprehensive", "notes", "sheet", "position", "cash", "changes", "information", "advis", "contents"]
DOT_LEADER = r"\.{3,}|\s\.\s\.\s"
# Common words of the text-quality test.
COMMON_WORDS = "the and of to in for a is on as at by with that from are was were be this group company year its has have".split()
BANNER = r"(?iuUmd)^\s*Docusign\s+Envelope\s+ID:.*$"
# Figures removed before, and the shape of, a token.
FIGURE = r"[£$€]?\d[\d,.]*%?"
TOKEN = r"[a-z][a-z'’-]*"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def lines(text: Column) -> Column:
    """Array of lines; a final line end opens no further line, '' has none, NULL stays NULL."""
    parts = F.split(text, LINE_END, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def strip_banner(text: Column) -> Column:
    """Empties e-signing banner lines."""
    return F.when(F.contains(F.lower(text), F.lit("docusign")), F.regexp_replace(text, BANNER, "")).otherwise(text)


def heading_core(line: Column) -> Column:
    """A line without numbering, page number, '(continued)' and stray edge characters."""
    x = F.regexp_replace(strip(line), r"(?U)^\d{1,2}[.)]?\s+", "")
    x = F.regexp_replace(x, r"(?U)\s\d{1,3}\z", "")
    x = F.regexp_replace(x, FLAGS + r"[\s(\[]*\bcontinued\b[)\]\s]*\z", "")
    return F.regexp_replace(x, r"^[^0-9A-Za-z(]+|[^0-9A-Za-z)]+\z", "")


def classify_heading(line: Column) -> Column:
    """The section that a line opens, or NULL for body text (and for NULL)."""

    def rules(core: Column) -> Column:
        out = F
        for name, pattern in HEADING_RULES:
            out = out.when(core.rlike(FLAGS + r"\A(?:" + pattern + r")\z"), name)
        return out

    words = let(F.lower(line), lambda low: F.exists(F.array(*map(F.lit, HEADING_WORDS)), lambda w: F.contains(low, w)))
    shape = let(strip(line), lambda x: F.length(x).between(3, 90) & ~x.rlike("(?U)" + DOT_LEADER))
    return F.when(words & shape, let(heading_core(line), rules))


def is_combined_heading(line: Column) -> Column:
    """A heading of strategic and directors' report in one, by a laxer trimming of its own."""
    x = F.regexp_replace(F.regexp_replace(strip(line), r"(?U)^\d{1,2}[.)]?\s+", ""), r"^[ .:\-–—]+|[ .:\-–—]+\z", "")
    return x.rlike(FLAGS + r"\A(?:" + HEADING_RULES[0][1] + r")\z")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def n_common(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)(?<![A-Za-z])(?:" + "|".join(COMMON_WORDS) + ")(?![A-Za-z])"))


def n_alpha(text: Column) -> Column:
    """Characters that are letters, figures or white space."""
    return F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]+", ""))


def tokens(text: Column) -> Column:
    """Lower-case words without figures, in order."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "(?U)" + FIGURE, " "), F.lit("(" + TOKEN + ")"), F.lit(1))


def last_path_part(url: Column) -> Column:
    """The last part of a URL, trailing slashes aside; NULL for NULL or ''."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), F.lit(""))


def year_label(made_up: Column, filed: Column) -> Column:
    """First four characters of the made-up date, else of the filing date; a string."""
    return F.substring(F.coalesce(F.nullif(made_up, F.lit("")), filed, F.lit("")), 1, 4)


def date_key(date: Column) -> Column:
    """yyyymmdd as a number, 0 for NULL and ''. For sorting only."""
    return F.coalesce(F.replace(date, F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))
