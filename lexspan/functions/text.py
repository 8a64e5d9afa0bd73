"""Scalar text functions as Column expressions: no Python worker runs for any of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and limits that results depend on.
QUERY_STOP_WORDS = [
    "and", "are", "did", "does", "for", "from", "had", "has", "have", "how",
    "inc", "into", "its", "the", "their", "this", "three", "was", "were",
    "what", "when", "where", "which", "why", "with", "apple", "aapl",
]
DRAFT_STOP_WORDS = [
    "and", "did", "does", "ended", "for", "from", "how", "the", "three",
    "was", "were", "what", "when", "where", "which", "why", "with", "apple",
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
PERIOD_WORDS = ["fiscal", "quarter"]
DASHES = ["—", "–", "-", "−"]
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERM = "[a-z0-9]{3,}"
NUMBER = r"\$?\(?\d[\d,]*(?:\.\d+)?\)?%?"
NUMBER_IN_TEXT = rf"(?<![\w.])({NUMBER})"
NUMBER_APART = rf"(?:^|[^\w.])({NUMBER})"
NUMERIC_CELL = r"^\(?-?\$?\d[\d,]*(\.\d+)?\)?%?\)?$|^\(?\d+(\.\d+)?\)?%$"
DRAFT_EXPANSIONS = {
    "buy back": ["repurchase", "repurchased", "shares", "stock"],
    "fall": ["decreased", "decline", "declined", "lower"],
    "grow": ["increased", "growth", "higher"],
    "trading plan": ["10b5", "entered", "plan"],
}
FOREIGN_ISSUERS = [
    "tesla", "tsla", "microsoft", "msft", "amazon", "amzn", "google", "alphabet",
    "googl", "nvidia", "nvda", "meta", "netflix", "nflx", "berkshire",
    "ford", "general motors", "gm", "ibm", "oracle", "salesforce", "adobe",
    "intel", "amd", "qualcomm", "samsung", "sony", "spotify", "uber", "airbnb",
    "walmart", "costco", "jpmorgan", "goldman sachs", "coca-cola", "pepsico",
]
OWN_ISSUERS = ["apple", "aapl"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def count_tokens(text) -> Column:
    """Words plus single signs."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(WORD_OR_SIGN))


def normalize_space(text) -> Column:
    """Runs of white space, no-break spaces among them, become one blank; ends are trimmed.  Null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_c(text), F.lit("")), " ", " "), r"[\s\x0B]+", " "))


def slugify(text, limit: int = 40) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(_c(text)), F.lit("&"), F.lit(" and ")), "[’'`]", "")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(cut == "", "x").otherwise(cut)


def sha256(text) -> Column:
    return F.sha2(_c(text), 256)


def short_hash(text, n: int = 8) -> Column:
    return F.substring(sha256(text), 1, n)


def _compact(text) -> Column:
    return F.regexp_replace(F.translate(_c(text), " ", " "), r"^\s+|\s+$| ", "")


def is_numeric_cell(text) -> Column:
    t = _compact(text)
    return F.coalesce((t != "") & (t.isin(*DASHES, "$") | t.rlike(NUMERIC_CELL)), F.lit(False))


def parse_number(text) -> Column:
    """'(1,094)' is -1094, '11%' is 11; a dash, nothing or no number is null."""
    t = F.replace(_compact(text), F.lit("$"), F.lit(""))
    digits = F.regexp_replace(t, r"^[()%\-−]+|[()%\-−]+$|[,()]", "")
    value = F.when(digits.rlike(r"^\d+\.?\d*$|^\.\d+$"), digits.try_cast("double"))
    return F.when(t.isin(*DASHES), F.lit(None)).when(t.rlike(r"^[(\-−]"), -value).otherwise(value)


def _whole_digits(v) -> Column:
    """All digits of a double of 2**53 or more: v is m * 2**e, and m in limbs of nine digits, the lowest first, is multiplied by
    powers of two up to 2**32."""
    base, div = F.lit(10**9), lambda x, y: F.call_function("div", x, y)
    e = F.floor(F.log2(v)).cast("int") - 57  # m has 57 to 59 bits where a double has 53: none is lost
    m = (v / F.pow(F.lit(2.0), F.greatest(e, F.lit(0)))).cast("long")

    def times(limbs, factor):
        step = lambda s, x: F.transform(F.array(x * factor + s["carry"]), lambda y: F.struct(div(y, base).alias("carry"), F.array_append(s["out"], y % base).alias("out")))[0]
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(limbs, start, step, lambda s: F.concat(s["out"], F.array(s["carry"] % base, div(s["carry"], base))))

    powers = F.transform(F.sequence(F.lit(0), F.greatest(e, F.lit(0)), F.lit(32)), lambda done: F.pow(F.lit(2.0), F.least(F.lit(32), F.greatest(e, F.lit(0)) - done)).cast("long"))
    limbs = F.aggregate(powers, F.array(m % base, div(m, base)), times)
    return F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), "^0+", "")


def _large_fixed(v) -> Column:
    """The exact value of a double of 2**43 or more with two decimals; format_number knows 17 digits."""
    decimals = F.format_number(v - F.floor(v), 2)
    small = F.concat((v.cast("long") + decimals.startswith("1").cast("long")).cast("string"), F.substring(decimals, 2, 3))
    return F.when(v == float("inf"), "inf").when(v < 2.0**53, small).otherwise(F.concat(_whole_digits(v), F.lit(".00")))


def normalize_number(value) -> Column:
    """Absolute value with at most two decimals, trailing zeros dropped; of large ones all digits."""
    v = F.abs(_c(value))
    fixed = F.replace(F.format_number(v, 2), F.lit(","), F.lit(""))
    large = F.transform(F.array(v.cast("double")), _large_fixed)[0]
    return F.regexp_replace(F.when(v >= 2.0**43, large).otherwise(fixed), r"\.?0+$", "")


def numbers_in_text(text, apart: bool = False) -> Column:
    """Distinct normalised numbers of a text, sorted; with apart, not those that begin where another one's bracket or per cent sign ends."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(NUMBER_APART if apart else NUMBER_IN_TEXT), 1)
    values = F.filter(F.transform(found, parse_number), lambda v: v.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(values, normalize_number)))


def terms(text) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TERM), 0)


def query_tokens(text) -> Column:
    """Terms of a question without stop words, months, period words and years 20xx; repeats stay."""
    dropped = QUERY_STOP_WORDS + MONTHS + PERIOD_WORDS
    return F.filter(terms(text), lambda t: ~F.array_contains(_array(dropped), t) & ~t.rlike(r"^20\d{2}$"))


def draft_terms(question) -> Column:
    """Distinct terms of a question for drafting, with the expansions of the phrases in it."""
    own = F.filter(terms(question), lambda t: ~F.array_contains(_array(DRAFT_STOP_WORDS), t))
    for phrase, more in DRAFT_EXPANSIONS.items():
        own = F.array_union(own, F.when(F.contains(F.lower(_c(question)), F.lit(phrase)), _array(more)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(own)


def squash(text) -> Column:
    return normalize_space(text)


def normalize_money(text) -> Column:
    return F.translate(squash(text), "$,", "")


def digit_strings(text) -> Column:
    return F.regexp_extract_all(normalize_money(text), F.lit(r"\d+(?:\.\d+)?"), 0)


def quote_in_chunk(quote, chunk) -> Column:
    q, c = squash(quote), squash(chunk)
    return (q != "") & (F.contains(c, q) | F.contains(normalize_money(chunk), normalize_money(quote)))


def numbers_supported(claim, quote) -> Column:
    """Every digit string of the claim is one of the quote's."""
    return F.size(F.array_except(digit_strings(claim), digit_strings(quote))) == 0


def path_slug(path) -> Column:
    """Slug of a section path from its third part on; long ones end in a hash."""
    tail = F.slice(_c(path), 3, 1_000)
    slug = F.array_join(F.transform(tail, lambda p: slugify(p, 28)), "--")
    short = F.concat(F.regexp_replace(F.substring(slug, 1, 71), "-+$", ""), F.lit("-"), short_hash(slug))
    return F.when(F.size(_c(path)) <= 2, "item").when(F.length(slug) <= 80, slug).otherwise(short)


def parent_id(doc_id, item_code, path) -> Column:
    return F.concat_ws("#", _c(doc_id), _c(item_code), path_slug(path))


def common_prefix(a, b) -> Column:
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda s, ok: F.struct((s["n"] + F.when(s["on"] & ok, 1).otherwise(0)).alias("n"), (s["on"] & ok).alias("on")))
    return F.slice(a, 1, same["n"])


def is_descendant(child, parent) -> Column:
    child, parent = _c(child), _c(parent)
    return (F.size(child) > F.size(parent)) & (F.slice(child, 1, F.greatest(F.size(parent), F.lit(0))) == parent)


def is_major_title(title) -> Column:
    """A note's or statement's title: over 0.7 of its letters are capitals, or it begins as a numbered note."""
    t = _c(title)
    letters, capitals = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    return t.rlike(r"^Note\s+\d+\s*[–—-]") | (capitals > 0.7 * F.greatest(letters, F.lit(1)))


def are_related(a, b) -> Column:
    """Siblings, or parent and child, that no major title sets apart."""
    a, b = _c(a), _c(b)
    c = F.size(common_prefix(a, b))
    apart = lambda p: F.coalesce(F.when(F.size(p) > c, is_major_title(F.try_element_at(p, c + 1))), F.lit(False))
    return (c >= 2) & (c >= F.least(F.size(a), F.size(b)) - 1) & ~apart(a) & ~apart(b)


def calendar_quarter(day) -> Column:
    """Nearest calendar quarter end, as 2026-Q2; the earlier one of equals."""
    day = _c(day)
    ends = [(3, 31), (6, 30), (9, 30), (12, 31)]
    near = [F.struct(F.abs(F.datediff(F.make_date(F.year(day) + s, F.lit(m), F.lit(d)), day)).alias("off"), (F.year(day) + s).alias("y"), F.lit(q).alias("q")) for s in (-1, 0, 1) for q, (m, d) in enumerate(ends, 1)]
    best = F.array_min(F.array(*near))
    return F.when(day.isNotNull(), F.concat(best["y"].cast("string"), F.lit("-Q"), best["q"].cast("string")))


def document_id(ticker, form, period_end) -> Column:
    return F.concat_ws("_", _c(ticker), F.replace(_c(form), F.lit("/"), F.lit("")), F.date_format(_c(period_end), "yyyy-MM-dd"))


def is_annual(form) -> Column:
    return _c(form).startswith("10-K")


def period_label(form, year, quarter) -> Column:
    return F.when(is_annual(form), F.concat(F.lit("Fiscal Year "), _c(year))).otherwise(F.concat(F.lit("Fiscal Q"), _c(quarter), F.lit(" "), _c(year)))


def short_company(name) -> Column:
    return F.trim(F.regexp_replace(_c(name), r",?\s+(Inc|Corp|Corporation|Co|Ltd|plc|Holdings)\.?$", ""))


def section_display(path) -> Column:
    """Path without its first two parts, if it has more; a JSON array as text is read first."""
    shown = lambda p: F.array_join(F.when(F.size(p) > 2, F.slice(p, 3, 1_000)).otherwise(p), " > ")
    return F.coalesce(shown(path), F.lit(""))


def section_display_text(text) -> Column:
    parsed = F.from_json(_c(text), "array<string>")
    return F.coalesce(F.when(F.trim(_c(text)).startswith("["), section_display(parsed)), _c(text), F.lit(""))


def period_prefix(value) -> Column:
    return F.coalesce(F.substring(_c(value).cast("string"), 1, 10), F.lit(""))


def idf(n, df) -> Column:
    return F.log1p((_c(n) - _c(df) + 0.5) / (_c(df) + 0.5))


def tf_saturation(tf, k1: float = 1.2) -> Column:
    return _c(tf) * (k1 + 1) / (_c(tf) + k1)


def salvage_json(text, schema: str) -> Column:
    """JSON of a text, or else of what lies between its first and last brace."""
    t = _c(text)
    return F.coalesce(F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(t, schema)), F.from_json(F.regexp_extract(t, r"(?s)\{.*\}", 0), schema))


def canonical_json(draft) -> Column:
    """Compact JSON with sorted keys; draft: struct with fields in alphabetic order."""
    return F.to_json(_c(draft), {"ignoreNullFields": "false"})


def hmac_sha256(key: str, message) -> Column:
    """Hex HMAC from two nested digests; the key stays a literal of the plan."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(_c(message), "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def uuid5(name, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(_c(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def approval_text(run_id, from_state, to_state, step_id, payload, approver, unix_ts) -> Column:
    return F.concat_ws("|", F.lit("v1"), *(_c(x).cast("string") for x in (run_id, from_state, to_state, step_id, payload, approver, unix_ts)))


def is_fresh(unix_ts, now, skew: int = 300) -> Column:
    return F.abs(_c(now) - _c(unix_ts)) <= skew


def l2_norm(vector) -> Column:
    return F.sqrt(F.aggregate(_c(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector) -> Column:
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(_c(vector), lambda x: x.cast("double") / norm)).otherwise(F.transform(_c(vector), lambda x: x.cast("double")))


def round_half_even(value, places: int = 3) -> Column:
    return F.bround(_c(value), places)


def loose_contains(text, part) -> Column:
    """Containment without case and thousands commas."""
    plain = lambda x: F.replace(F.lower(_c(x)), F.lit(","), F.lit(""))
    return F.contains(plain(text), plain(part))


def citation_label(doc_id, page, section) -> Column:
    return F.concat_ws(", ", _c(doc_id), F.concat(F.lit("p. "), _c(page).cast("string")), F.when(_c(section) != "", _c(section)))


def context_block(chunk_id, doc_id, period, page, section, text) -> Column:
    return F.format_string("[chunk_id=%s document_id=%s period=%s page=%s section=%s]\n%s", *(_c(x).cast("string") for x in (chunk_id, doc_id, period, page, section, text)))


def names_any(text, names: list[str]) -> Column:
    import re

    return F.lower(F.coalesce(_c(text), F.lit(""))).rlike(r"\b(" + "|".join(map(re.escape, names)) + r")\b")


def out_of_corpus_issuer(question, foreign: list[str] | None = None, own: list[str] | None = None) -> Column:
    """True when a question names another issuer and not the corpus's own."""
    return names_any(question, foreign or FOREIGN_ISSUERS) & ~names_any(question, own or OWN_ISSUERS)


def fill_prompt(template: str, question) -> Column:
    return F.replace(F.lit(template), F.lit("{question}"), _c(question))
