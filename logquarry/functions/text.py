"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is white space, and how ids, times and durations look.
SPACE = r"[\s\u000B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
UUID = rf"(?i){LEFT}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{RIGHT}"
TRACE_HEX = rf"(?i){LEFT}(?=[0-9a-f]*[a-f])[0-9a-f]{{32}}{RIGHT}"
_HEX = rf"(?i){LEFT}(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{{4,}}{RIGHT}"
_FIRST_TIME = (
    r"(?s)\A(.*?)\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
)
_VOLATILE = (
    (rf"^\s*\d{{10}}(?:\d{{3}})?(?:\.\d+)?{RIGHT}", "<time>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<time>"),
    (rf"{LEFT}\d{{4}}-\d{{2}}-\d{{2}}{RIGHT}", "<date>"),
    (rf"{LEFT}\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?{RIGHT}", "<time>"),
    (UUID, "<id>"),
    (
        rf"(?i){LEFT}(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{{7,}}|(?=[0-9a-f]*[a-f])[0-9a-f]{{12,}}){RIGHT}",
        "<id>",
    ),
    (rf"{LEFT}\d+(?:\.\d+)?\s?(?:ns|µs|us|ms|s|sec|secs|seconds?|m|min|h){RIGHT}", "<duration>"),
)
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[ -/]+[0-~]|\x1b[@-Z\\-_]"
EXTENSIONS = ("log", "txt", "out", "err", "json", "jsonl", "ndjson")
_PREFIXES = (
    r"^\[pod/([^/\]\s]+)/([^\]\s]+)\] ",
    r"^([a-z0-9][\w.-]*-\d+)\s+\| ?",
    rf"(?i)^(\w[\w.-]*\.(?:{'|'.join(EXTENSIONS)}))\s+\| ",
)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def strip_ansi(raw: Column) -> Column:
    return F.when(raw.contains("\x1b"), F.regexp_replace(raw, ANSI, "")).otherwise(raw)


def split_source(raw: Column) -> tuple[Column, Column]:
    """(source or null, length of the prefix) of a line that names its pod, container or file in front."""
    pod, compose, file = _PREFIXES
    may = raw.startswith("[pod/"), raw.contains("|"), raw.contains("|")
    is_pod, is_compose, is_file = (m & raw.rlike(p) for m, p in zip(may, _PREFIXES))
    source = (
        F.when(is_pod, F.concat(F.regexp_extract(raw, pod, 1), F.lit("/"), F.regexp_extract(raw, pod, 2)))
        .when(is_compose, F.regexp_extract(raw, compose, 1))
        .when(is_file, F.regexp_extract(raw, file, 1))
    )
    size = F.coalesce(*[F.when(m & raw.rlike(p), F.length(F.regexp_extract(raw, p, 0))) for m, p in zip(may, _PREFIXES)], F.lit(0))
    return source, size


def without_source(text: Column) -> Column:
    _, size = split_source(text)
    return F.substr(text, size + 1)


def signature(text: Column) -> Column:
    """A line with its first time, bracketed parts, ids and numbers taken out, so that repeats are equal."""
    out = F.regexp_replace(text, _FIRST_TIME, "$1")
    for regex, by in ((r"\[[^\]]*\]", "[]"), (UUID, "<uuid>"), (_HEX, "<hex>"), (r"[0-9]+", "#")):
        out = F.regexp_replace(out, regex, by)
    return trim(out)


def normalize_line(line: Column) -> Column:
    """A line with what changes from run to run replaced: times, dates, ids, durations."""
    for regex, by in _VOLATILE:
        line = F.regexp_replace(line, regex, by)
    return line


def normalize_whitespace(line: Column) -> Column:
    return F.regexp_replace(trim(line), rf"{SPACE}+", " ")


def kind(text: Column, level: Column, is_json: Column) -> Column:
    """What lines like this one share: level and signature, without a record's other fields."""
    rest = without_source(text)
    rest = F.when(is_json, F.regexp_replace(rest, r" \{.*\}\z", "")).otherwise(rest)
    return F.concat(F.coalesce(level, F.lit("")), F.lit(" "), signature(rest))


def kind_label(key: Column) -> Column:
    text = F.regexp_replace(key, r"\A[^ ]* ", "")
    text = F.when(text == "", "…").otherwise(text)
    return F.when(F.length(text) > 48, F.concat(F.substring(text, 1, 47), F.lit("…"))).otherwise(text)


def quote_csv(value: Column) -> Column:
    """RFC 4180 quoting; what a spreadsheet would run as a formula gets an apostrophe first."""
    formula = value.rlike(r"\A[=+\-@\t\r]") & ~value.rlike(r"\A[+-]?\d+(?:\.\d+)?\z")
    safe = F.when(formula, F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike('[",\n\r]'), quoted).otherwise(safe)


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.gz\z", "")


def split_words(text: Column) -> Column:
    """someText, some_text, some-text and Some Text as an array of lower-case words."""
    out = F.regexp_replace(trim(text), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.transform(F.filter(F.split(out, rf"(?:{SPACE}|[_\-.])+"), lambda w: w != ""), F.lower)


def camel_case(text: Column) -> Column:
    def one(w: Column, i: Column) -> Column:
        return F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.array_join(F.transform(split_words(text), one), "")


def snake_case(text: Column) -> Column:
    return F.array_join(split_words(text), "_")


def kebab_case(text: Column) -> Column:
    return F.array_join(split_words(text), "-")


def constant_case(text: Column) -> Column:
    return F.upper(snake_case(text))


def _lines(text: Column) -> tuple[Column, Column]:
    text = F.regexp_replace(text, r"\r\n?", "\n")
    ends = F.when(text.endswith("\n"), "\n").otherwise("")
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), ends


def sort_lines(text: Column) -> Column:
    """Lines by Unicode collation; a last line break stays."""
    lines, end = _lines(text)
    ordered = F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(F.collate(x, "UNICODE").alias("k"), x.alias("v")))), lambda s: s["v"])
    return F.concat(F.array_join(ordered, "\n"), end)


def unique_lines(text: Column) -> Column:
    lines, end = _lines(text)
    return F.concat(F.array_join(F.array_distinct(lines), "\n"), end)


def base64_encode(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def base64_decode(text: Column) -> Column:
    """Standard or URL-safe Base64, padded or not; null where it is neither."""
    plain = F.translate(F.regexp_replace(text, rf"{SPACE}+", ""), "-_", "+/")
    bare = F.regexp_replace(plain, r"=+\z", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    ok = plain.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(bare) % 4 != 1)
    return F.when(ok, F.make_valid_utf8(F.unbase64(padded).cast("string")))


def url_encode(text: Column) -> Column:
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url_decode(text: Column) -> Column:
    """Null where the text is no URL encoding."""
    return F.try_url_decode(text)


def apply_tools() -> dict[str, object]:
    """The text tools that are Column expressions, by id."""
    return {
        "base64-encode": base64_encode,
        "base64-decode": base64_decode,
        "url-encode": url_encode,
        "url-decode": url_decode,
        "camel": camel_case,
        "snake": snake_case,
        "kebab": kebab_case,
        "constant": constant_case,
        "sort-lines": sort_lines,
        "unique-lines": unique_lines,
    }
