"""Scalar functions on text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; null text has none. Accents stay; text is expected in composed form."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def analyze(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Tokens without stopwords."""
    words = tokens(text)
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """Non-overlapping occurrences of a word sequence: words are delimited on both sides, so that neighbours do not share a delimiter."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    row = F.concat(F.lit("\x01"), F.array_join(words, "\x02\x01"), F.lit("\x02"))
    needle = "\x01" + "\x02\x01".join(phrase) + "\x02"
    return ((F.length(row) - F.length(F.replace(row, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def collapse(text: Column, limit: int | None = None) -> Column:
    """White space collapsed and, past ``limit``, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return flat if limit is None else F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def minified(file_name: Column, text: Column) -> Column:
    """Whether a file is a generated blob: by name, by a line of over 50,000, or by hardly any line ends in 50,000 characters."""
    longest = F.array_max(F.transform(F.split(text, "\n", -1), F.length))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    dense = (F.length(text) >= 50_000) & (breaks / F.length(text) < 0.001)
    return F.coalesce(F.lower(file_name).rlike(r"\.min\.(js|css)$") | (longest > 50_000) | dense, F.lit(False))


def glob_to_regex(glob: str) -> str:
    """Shell pattern as an anchored regular expression; ** and * cross separators, as fnmatch does."""
    out = []
    for c in glob.replace("**", "*"):
        out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() and c not in "/_-" else c))
    return "^" + "".join(out) + "$"


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def iso_week(ts: Column) -> Column:
    """YYYY-Www of the wall clock; null where the text is no timestamp."""
    t = F.try_to_timestamp(F.substring(ts, 1, 19)) if isinstance(ts, Column) else F.try_to_timestamp(F.substring(F.col(ts), 1, 19))
    return F.when(
        t.isNotNull(), F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    )


def year_month(ts: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.substring(ts, 1, 19)), "yyyy-MM")


def age_decay(created_at: Column, as_of: str, half_life_days: float) -> Column:
    """0.5 ** (age / half life); unparseable or missing times and a half life of 0 are not decayed."""
    if half_life_days <= 0:
        return F.lit(1.0)
    t = F.try_to_timestamp(created_at)
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(t)) / 86400.0
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life_days), F.lit(1.0))


def chunk_id(source: Column, index: Column) -> Column:
    """Position-based id of a file's chunk."""
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat(source, F.lit("_"), index.cast("string")).cast("binary")), 1, 16))


def content_id(prefix: str, *parts: Column) -> Column:
    """Content-based id of a session or ingested chunk."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, 32))


def prefix_swap(value: Column, old: str, new: str) -> Column:
    """A path under a moved root; other values stay."""
    return F.when(value == old, F.lit(new)).when(
        value.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(value, len(old.rstrip("/")) + 1, 1 << 30))
    ).otherwise(value)


def parse_time(text: Column) -> Column:
    """Timestamp of an ISO 8601 text; without a zone it counts as UTC, and what is no time is null."""
    zoned = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$") & text.rlike("T|t| ")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(F.trim(text), F.when(F.length(F.trim(text)) > 10, "Z").otherwise(""))))


def short_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """SHA-1 id of a record, rule or reference: its parts, nulls as empty, joined by a bar."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined.cast("binary")), 1, length))


def rendered_turn(role: Column, kind: Column, text: Column, tool: Column) -> Column:
    """A turn as a line of a transcript: thinking and tool results are marked, a tool call is its name."""
    return (
        F.when(kind == "thinking", F.concat(role, F.lit(" (thinking): "), text))
        .when(kind == "tool_use", F.concat(role, F.lit(" [tool: "), F.coalesce(tool, F.lit("?")), F.lit("]")))
        .when(kind == "tool_result", F.concat(F.lit("[result]: "), text))
        .otherwise(F.concat(role, F.lit(": "), text))
    )


FENCE = r"(?m)^ {0,3}(?:```+|~~~+)[ \t]*([\w+#.-]*)"


def fenced_languages(text: Column) -> Column:
    """Languages that the fenced code blocks of a text name, each once; an opening without a name gives none."""
    marks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    return F.array_distinct(F.transform(F.filter(marks, lambda m: m != ""), F.lower))


def has_fence(text: Column) -> Column:
    return F.coalesce(text.rlike(FENCE), F.lit(False))


def path_like(name: Column) -> Column:
    """Whether a name is a path: it has a separator and no white space, or ends in a file extension."""
    return F.coalesce(~name.rlike(r"\s") & (name.contains("/") | name.rlike(r"^[\w.-]+\.[A-Za-z][A-Za-z0-9]{0,4}$")), F.lit(False))


def canonical_path(name: Column, root: str) -> Column:
    """A path relative to the project's root, with plain separators and without ./; other names stay as they are."""
    slashed = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    base = root.rstrip("/") + "/"
    return F.when(path_like(name), F.when(slashed.startswith(base), F.substring(slashed, len(base) + 1, 1 << 30)).otherwise(slashed)).otherwise(name)


def display_source(domain: Column, source: Column, source_id: Column) -> Column:
    """What an ingested source is shown as."""
    return F.concat(domain, F.lit("://"), source, F.lit("/"), source_id)


def raw_source(display: Column, domain: Column, source_id: Column) -> Column:
    """The source of what is shown, null where it does not fit the domain and id."""
    head, tail = F.concat(domain, F.lit("://")), F.concat(F.lit("/"), source_id)
    inner = F.substring(display, F.length(head) + 1, F.length(display) - F.length(head) - F.length(tail))
    return F.when(display.startswith(head) & display.endswith(tail), inner)


def doc_comment(text: Column) -> Column:
    """Plain text of C# documentation comments: the marks and tags go, names in cref and name attributes stay."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("///"))
    body = F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*///", ""))), " ")
    named = F.regexp_replace(body, r'<\w+\s+(?:cref|name)="([^"]*)"\s*/?>', " $1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(named, r"</?[^>]+>", " "), r"\s+", " "))


def html_text(html: Column) -> Column:
    """Text of a page without its head, scripts, styles and tags; common character references are resolved, white space is collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for reference, character in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}.items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
