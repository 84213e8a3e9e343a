"""Text, date and JSON expressions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Unicode counts as white space, as a Java regular expression class.
WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
UNKNOWN = "unknown"

# Markers of advertisements in titles and bodies.
ADVERT_MARKERS = ("광고", "AD", "스폰서", "Sponsored")


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(empty(c), f"^{WS}+|{WS}+$", "")


def strip_html_tags(c: Column) -> Column:
    return F.regexp_replace(empty(c), "<[^>]+>", "")


def strip_b_tags(c: Column) -> Column:
    return F.regexp_replace(empty(c), "(?i)</?b>", "")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(empty(c), f"{WS}+", " "))


def clean_body(c: Column) -> Column:
    return normalize_whitespace(strip_html_tags(c))


def excerpt(c: Column, most: int = 200) -> Column:
    """At most ``most`` characters, the last three of a cut text being dots."""
    c = empty(c)
    dots = F.lit("." * min(most, 3))
    cut = F.concat(F.substring(c, 1, most - 3), dots) if most > 3 else dots
    return F.when(F.length(c) <= most, c).otherwise(cut)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once for a row, also where inner lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _lower_characters(c: Column) -> Column:
    """Characters of the normalised lower-case text; an empty text is one empty string."""
    return F.split(F.lower(normalize_whitespace(c)), "")


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of the normalised lower-case text; a shorter text is its only one."""

    def grams(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
        short = F.filter(F.array(F.array_join(x, "")), lambda whole: whole != "")
        return F.when(F.size(x) < 3, short).otherwise(F.array_distinct(each))

    return _once(_lower_characters(c), grams)


#: Stands for a character that a short text lacks; above all code points.
_NO_CHARACTER = (1 << 21) - 1


def trigram_codes(c: Column) -> Column:
    """The trigrams as sorted longs: three code points of 21 bits each, so different trigrams have different codes."""

    def code(first: Column, second: Column, third: Column) -> Column:
        return F.shiftleft(first, 42).bitwiseOR(F.shiftleft(second, 21)).bitwiseOR(third)

    def codes(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: code(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
        short = F.array(code(F.get(x, F.lit(0)), F.coalesce(F.get(x, F.lit(1)), F.lit(_NO_CHARACTER).cast("long")), F.lit(_NO_CHARACTER).cast("long")))
        return F.when(F.size(x) == 0, F.array().cast("array<bigint>")).when(F.size(x) < 3, short).otherwise(F.sort_array(F.array_distinct(each)))

    points = F.transform(F.filter(_lower_characters(c), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return _once(points, codes)


def jaccard(a: Column, b: Column) -> Column:
    share = lambda both: both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_once(F.size(F.array_intersect(a, b)), share))


def keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(empty(c), ","), strip), lambda x: x != "")


def dedup_key(title: Column, date: Column, publisher: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(strip(title)), empty(date), F.lower(strip(publisher))), 256)


def article_id(source: Column, title: Column, date: Column, publisher: Column) -> Column:
    key = F.concat_ws("|", empty(title), empty(date), empty(publisher))
    return F.concat(source, F.lit(":"), F.substring(F.sha1(key), 1, 16))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))


def normalize_date(c: Column) -> Column:
    digits = F.regexp_replace(strip(c), "[-/.]", "")
    made = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(digits.rlike("^[0-9]{8}$"), made).otherwise(strip(c))


def month_of(date: Column) -> Column:
    return F.substring(date, 1, 7)


def week_of(date: Column) -> Column:
    """Year and Monday-first week number; days before the first Monday, and dates that aren't any, are in week 00."""
    day = F.try_to_date(date, "yyyy-MM-dd")
    number = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
    return F.concat(F.substring(date, 1, 4), F.lit("-W"), F.coalesce(F.lpad(number.cast("string"), 2, "0"), F.lit("00")))


def next_reset(at: Column, zone: str = "America/Los_Angeles") -> Column:
    """The first midnight of ``zone`` after ``at``; both are wall clock times in UTC."""
    local = F.to_date(F.from_utc_timestamp(at, zone))
    return F.to_utc_timestamp(F.date_add(local, 1).cast("timestamp"), zone)


def escape_html(c: Column) -> Column:
    out = empty(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def mask_key(c: Column) -> Column:
    shown = F.least(F.lit(4), F.floor(F.length(c) / 4).cast("int"))
    long = F.concat(F.substring(c, F.lit(1), shown), F.lit("****"), F.right(c, F.lit(2)))
    return F.when(empty(c) == "", "(not set)").when(F.length(c) < 8, "****").otherwise(long)


# Dollars for a million prompt and output tokens, of models whose name has "flash" in it and of all others.
FLASH_PRICES, PRICES = (0.15, 0.60), (1.0, 2.0)


def cost_usd(model: Column, prompt: Column, output: Column) -> Column:
    flash, other = ((prompt * a + output * b) / 1_000_000 for a, b in (FLASH_PRICES, PRICES))
    return F.when(F.lower(model).contains("flash"), flash).otherwise(other)


_ANSWER = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>, usageMetadata struct<promptTokenCount: long, candidatesTokenCount: long>"


def extract_answer(c: Column) -> Column:
    """The first candidate's text and the token counts of a provider's raw JSON answer; without a candidate the text is null."""
    found = F.from_json(c, _ANSWER)
    first = F.get(found["candidates"], F.lit(0))
    usage = lambda name: F.coalesce(found["usageMetadata"][name], F.lit(0)).alias
    return F.struct(
        F.when(first.isNotNull(), empty(F.get(first["content"]["parts"], F.lit(0))["text"])).alias("text"),
        usage("promptTokenCount")("prompt_tokens"), usage("candidatesTokenCount")("output_tokens"),
    )


def _truthy_text(x: Column) -> Column:
    """A JSON value as text: null where it is missing, null, false, zero or empty.  Lists and objects are JSON text."""
    kind = F.schema_of_variant(x)
    number, raw = F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "string")
    return (
        F.when(x.isNull() | (kind == "VOID"), None)
        .when(kind == "STRING", F.nullif(raw, F.lit("")))
        .when(kind == "BOOLEAN", F.when(raw == "true", F.lit("True")))
        .when(kind == "BIGINT", F.nullif(raw, F.lit("0")))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.when(number != 0, number.cast("string")))
        .otherwise(F.nullif(F.nullif(F.to_json(x), F.lit("[]")), F.lit("{}")))
    )


def parse_reply(c: Column) -> Column:
    """label, confidence and rationale of a model's reply: of the JSON object from its first to its last brace, whatever names
    that has.  A name whose value is null, false, zero or empty gives way to the next one.  Where there is no object, where it is no
    single one, or where its confidence is no number (true is 1), the label is the first line that isn't blank."""
    end = F.length(c) - F.instr(F.reverse(c), "}") + 1
    start = F.instr(c, "{")
    inner = F.when((start > 0) & (end > start), F.substring(c, start, end - start + 1))
    # An object that is followed by another one is broken as the only item of an array.
    found = F.get(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]"))), "$", "array<variant>"), F.lit(0))
    one = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]"))), "$", "array<variant>")) == 1
    value = lambda name: F.try_variant_get(found, f"$.{name}", "variant")
    kind = F.coalesce(F.schema_of_variant(value("confidence")), F.lit("VOID"))
    raw = F.try_variant_get(found, "$.confidence", "string")
    number = F.when(kind == "BOOLEAN", (raw == "true").cast("double")).when(kind == "STRING", strip(raw).try_cast("double")).otherwise(F.try_variant_get(found, "$.confidence", "double"))
    ok = F.coalesce(one & ((kind == "VOID") | number.isNotNull()), F.lit(False))
    pick = lambda *names: F.coalesce(*[_truthy_text(value(n)) for n in names])
    line = F.get(F.filter(F.transform(F.split(empty(c), "\n"), strip), lambda x: x != ""), F.lit(0))
    return F.struct(
        F.when(ok, pick("label", "classification", "category")).otherwise(F.substring(line, 1, 100)).alias("label"),
        F.when(ok, number).alias("confidence"),
        F.when(ok, pick("rationale", "reason", "explanation")).alias("rationale"),
    )
