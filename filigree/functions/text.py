"""Identifiers, keys and rendering as Column expressions. An unusable input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns and share-class separators per provider.
CIK_PREFIX = r"(?i)^CIK[\s:#_-]*"
CIK_PATTERN = "^[0-9]{10}$"
TICKER_PATTERN = r"^[A-Z0-9][A-Z0-9./-]{0,14}$"
CLASS_SUFFIX = r"^([A-Z0-9]{1,6})[./-]([A-Z])$"
PROVIDER_SEPARATOR = {"sec": "-", "nasdaq": ".", "cboe": "."}
ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data/"
COMPANYFACTS_ROOT = "https://data.sec.gov/api/xbrl/companyfacts/CIK"
KEY_SEPARATOR = "|"


def normalize_cik(raw: Column) -> Column:
    """10-digit zero-padded text, or NULL when the input is not 1 ... 9,999,999,999."""
    digits = F.regexp_replace(F.trim(raw.cast("string")), CIK_PREFIX, "")
    significant = F.ltrim(digits, F.lit("0"))
    return F.when(digits.rlike("^[0-9]+$") & F.length(significant).between(1, 10), F.lpad(significant, 10, "0"))


def looks_like_cik(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), CIK_PREFIX, "").rlike("^[0-9]+$")


def normalize_ticker(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return F.when(t.rlike(TICKER_PATTERN), t)


def canonical_symbol(raw: Column) -> Column:
    """BRK.B, BRK/B and brk-b are all BRK-B."""
    return F.regexp_replace(normalize_ticker(raw), CLASS_SUFFIX, "$1-$2")


def provider_symbol(raw: Column, provider: str) -> Column:
    separator = PROVIDER_SEPARATOR.get(provider.strip().lower())
    if separator is None:
        raise ValueError(f"no symbol convention for provider {provider!r}")
    return F.regexp_replace(canonical_symbol(raw), CLASS_SUFFIX, f"$1{separator}$2")


def symbol_list(raw: Column) -> Column:
    """'aapl; brk.b,aapl' -> ['AAPL', 'BRK-B'], first occurrence order."""
    parts = F.filter(F.split(raw, "[,;]"), lambda s: F.trim(s) != "")
    return F.array_distinct(F.transform(parts, canonical_symbol))


def normalize_holder_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"[\s|]+", " ")))


def holder_key(holder_cik: Column, holder_name: Column) -> Column:
    return F.coalesce(normalize_cik(holder_cik), identity_text(normalize_holder_name(holder_name)))


def identity_text(raw: Column) -> Column:
    """Trimmed text that can be part of a key: not empty, no separator."""
    t = F.trim(raw)
    return F.when((t != "") & ~t.contains(KEY_SEPARATOR), t)


def unknown_if_na(raw: Column) -> Column:
    """Trimmed text; blank and 'N/A' mean unknown."""
    t = F.trim(raw)
    return F.when((t != "") & (F.upper(t) != "N/A"), t)


def business_key(*parts: Column) -> Column:
    """Key text in which an absent part stays visible as an empty one."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def fact_key(cik, taxonomy, concept, unit, period_start, period_end, accession) -> Column:
    return business_key(cik, taxonomy, concept, unit, period_start, period_end, accession)


def ownership_key(cik, holder_type, holder, as_of_date, accession, line_no) -> Column:
    return business_key(cik, holder_type, holder, as_of_date, accession, line_no)


def event_key(cik, event_type, source_ref) -> Column:
    return business_key(cik, event_type, source_ref)


def source_ref(cik: Column, taxonomy: Column, concept: Column, unit: Column) -> Column:
    return F.concat(F.lit(COMPANYFACTS_ROOT), cik, F.lit(".json#"), F.concat_ws("/", taxonomy, concept, unit))


def filing_url(cik: Column, accession: Column, document: Column | None = None) -> Column:
    folder = F.concat(
        F.lit(ARCHIVE_ROOT), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"),
    )
    return folder if document is None else F.concat(folder, F.coalesce(document, F.lit("")))


def content_hash(raw: Column) -> Column:
    """Hash of the text as received."""
    return F.concat(F.lit("sha256:"), F.sha2(raw.cast("string"), 256))


def canonical_json(raw: Column) -> Column:
    """JSON text with sorted keys and no white space between tokens; NULL where the text is no JSON."""
    # an object in a VARIANT keeps its fields in order of their names
    return F.to_json(F.try_parse_json(raw))


def canonical_hash(raw: Column) -> Column:
    """Hash of a payload's content: key order and white space do not count. A text that is no JSON is hashed as received."""
    return content_hash(F.coalesce(canonical_json(raw), raw))


def item_id(section: Column, ticker: Column, *parts: Column) -> Column:
    joined = F.concat_ws("|", section, ticker, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat_ws(":", section, ticker, F.substring(F.sha2(joined, 256), 1, 12))


def notes_of(detail: Column) -> Column:
    """The notes array of a retrieval's JSON detail; empty when there is none."""
    return F.coalesce(F.from_json(detail, "notes ARRAY<STRING>")["notes"], F.array().cast("array<string>"))


def unsupported_reason(detail: Column) -> Column:
    return F.get(F.filter(notes_of(detail), lambda n: n.startswith("UNSUPPORTED_TAXONOMY:")), F.lit(0))


def number(raw: Column) -> Column:
    """Finite number from provider text; anything else is NULL."""
    x = raw.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


# --- rendering -------------------------------------------------------------------------------------------------

# Money suffixes by size.
MONEY_UNITS = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))


def money(value: Column) -> Column:
    size = F.abs(value)
    text = None
    for limit, suffix in MONEY_UNITS:
        part = F.concat(F.format_number(size / limit, 2), F.lit(suffix))
        text = F.when(size >= limit, part) if text is None else text.when(size >= limit, part)
    return F.concat(F.when(value < 0, "-$").otherwise("$"), text.otherwise(F.format_number(size, 2)))


def render_metric(c: Column, name: Column, unit: Column) -> Column:
    """A cell as text: '+12.3%', '$1.20B', '4.10x', or 'N/A (STATE: reason)'."""
    v = c["value"]
    percent = v * 100
    signed = name.rlike("change|growth|return|drawdown")
    multiple = name.rlike("^(price_to|debt_to)")
    shown = (
        F.when((unit == "fraction") & signed, F.concat(F.format_string("%+.1f", percent), F.lit("%")))
        .when(unit == "fraction", F.concat(F.format_string("%.1f", percent), F.lit("%")))
        .when(unit == "usd", money(v))
        .when(unit == "usd_per_share", F.concat(F.lit("$"), F.format_number(v, 2)))
        .when(unit == "shares", F.format_number(v, 0))
        .otherwise(F.concat(F.format_number(v, 2), F.when(multiple, "x").otherwise("")))
    )
    why = F.concat_ws(": ", c["state"], c["reason"])
    return (
        F.when(c["state"].isNull(), "N/A (not produced)")
        .when(c["state"] != "OK", F.concat(F.lit("N/A ("), why, F.lit(")")))
        .otherwise(shown)
    )
