"""Scalar column expressions over text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkspark.functions import lexicon as L

WS = "[ \\t\\n\\r\\f\\x0B]"
_EDGE = "[.,;:!?\"'()\\[\\]]"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_EDGE}+|{_EDGE}+$", "")


def word_key(c: Column) -> Column:
    """Word identity across chunks: letters, digits and underscore, lower case."""
    return F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}_]+", ""))


def compare_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_edges(c)), "[^0-9a-z.]+", "")


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(L.LATIN_TOKEN), F.lit(0))


def content_tokens(c: Column) -> Column:
    raw = F.regexp_extract_all(c, F.lit(L.CONTENT_TOKEN), F.lit(0))
    clean = F.transform(raw, lambda t: F.lower(F.btrim(t, F.lit("._+#-"))))
    return F.filter(
        clean,
        lambda t: (F.length(t) >= 2)
        & ~t.isin(L.STOP_WORDS)
        & (F.btrim(t, F.lit("0123456789")) != ""),
    )


def numbers(c: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(c, F.lit(L.NUMBER), F.lit(0)), lambda t: F.regexp_replace(t, ",", "")
        )
    )


def hangul_share(c: Column) -> Column:
    rest = F.regexp_replace(c, "[A-Za-z][A-Za-z0-9.\\-]*", "")
    letters = F.regexp_count(rest, F.lit("\\p{L}"))
    return F.when(letters > 0, F.regexp_count(rest, F.lit("[가-힣]")) / letters).otherwise(F.lit(0.0))


def char_budget(seconds: Column) -> Column:
    return F.greatest(F.lit(8), F.bround(seconds * 13).cast("int"))


def cosmetic_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]", ""), "s$", "")


def interesting(c: Column) -> Column:
    """Inner capitals, a capital not followed by plain lower case, or digits with a dot."""
    s = strip_edges(c)
    tail = F.substring(s, 2, 1 << 30)
    lower_tail = tail.rlike("\\p{Ll}") & ~tail.rlike("[\\p{Lu}\\p{Lt}]")
    return (F.length(s) >= 2) & (
        tail.rlike("\\p{Lu}")
        | (F.substring(s, 1, 1).rlike("\\p{Lu}") & ~lower_tail)
        | (s.rlike("[0-9]") & s.contains("."))
    )


def particle_fragment(c: Column) -> Column:
    head = F.regexp_replace(trim_ws(c), "^[.,!?;:()\\[\\]{}\"']+", "")
    return head.rlike("^(" + "|".join(L.PARTICLES) + ")")


def everyday(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit("[A-Za-z']+"), F.lit(0))
    return (c == F.lower(c)) & (F.size(words) > 0) & F.forall(
        words, lambda w: w.isin(L.EVERYDAY_WORDS)
    )


def sentence_end(c: Column) -> Column:
    return c.rlike(L.SENTENCE_END)


def bracket_only(c: Column) -> Column:
    return trim_ws(c).rlike("^\\[[^\\[\\]]*\\]$")


def redact(c: Column, secrets: list[str] | None = None) -> Column:
    """Literal secrets of at least 8 characters first, then key shapes."""
    for secret in secrets or []:
        if len(secret) >= 8:
            c = F.replace(c, F.lit(secret), F.lit(L.REDACTED))
    return F.regexp_replace(c, L.SECRET, L.REDACTED)


def parse_offset(c: Column) -> Column:
    return F.regexp_extract(trim_ws(c), "^([0-9]+(?:\\.[0-9]+)?)s?$", 1).try_cast("double")


def srt_seconds(c: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(c, "^(\\d{2}):(\\d{2}):(\\d{2}),(\\d{3})$", i).try_cast("long")

    return (part(1) * 3600 + part(2) * 60 + part(3)) + part(4) / F.lit(1000.0)


def srt_time(seconds: Column) -> Column:
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000)).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000),
        F.floor(ms / 60000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def timecode(seconds: Column) -> Column:
    s = F.bround(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def expand_contractions(words: Column) -> Column:
    """Array of words with the first matching short form spelled out."""

    def one(w: Column) -> Column:
        out = w
        for suffix, full in reversed(L.CONTRACTIONS):
            hit = F.lower(w).endswith(F.lit(suffix)) & (F.length(w) > len(suffix))
            out = F.when(
                hit, F.concat(w.substr(F.lit(1), F.length(w) - len(suffix)), F.lit(full))
            ).otherwise(out)
        return out

    return F.transform(words, one)


def split_ws(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("\\S+"), F.lit(0))


def loose_forms(c: Column) -> Column:
    """A phrase and its expanded form, lower case without blanks, hyphens and apostrophes."""
    both = F.array(c, F.concat_ws(" ", expand_contractions(split_ws(c))))
    return F.array_distinct(
        F.transform(both, lambda v: F.regexp_replace(F.lower(v), "[\\s\\-']+", ""))
    )


def noise_pair(left: Column, right: Column) -> Column:
    """Pairs that differ only in spelling, contraction, a short ending, or are function words."""
    a, b = loose_forms(left), loose_forms(right)

    def prefixed(x: Column, y: Column) -> Column:
        return (x != "") & y.startswith(x) & (F.length(y) - F.length(x) <= 3)

    near = F.exists(a, lambda x: F.exists(b, lambda y: prefixed(x, y) | prefixed(y, x)))

    def all_common(c: Column) -> Column:
        words = F.transform(split_ws(c), lambda t: F.lower(strip_edges(t)))
        return (F.size(words) > 0) & F.forall(words, lambda t: t.isin(L.COMMON_WORDS))

    return F.arrays_overlap(a, b) | near | (all_common(left) & all_common(right))


def beyond_ascii(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x7F]+", "")


def without_class(c: Column, classes: str) -> Column:
    """``c`` without the runs of a character class."""
    return F.regexp_replace(c, classes + "+", "")


def script_counts(c: Column, rest: Column, rare: Column) -> dict[str, Column]:
    """Letters per script, as what a text loses when they are taken out run by run.

    ``rest`` is the text beyond ASCII, where all but Latin is found; ``rare`` is ``rest`` without the
    ``COMMON_SCRIPTS``, where the others are found.
    """
    where = {s: c if s == "latin" else rest if s in L.COMMON_SCRIPTS else rare for s in L.SCRIPTS}
    return {s: F.length(at) - F.length(without_class(at, L.script_class(s))) for s, at in where.items()}


def script_of_language(c: Column) -> Column:
    """Script of one language code such as ``en-US``; null when not known."""
    code = F.split(F.lower(trim_ws(c)), "-", 2)[0]
    pairs = [F.lit(x) for kv in L.LANGUAGE_SCRIPT.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), code)


def requested_script(c: Column) -> Column:
    """Script of a comma list when all known codes agree on one."""
    found = F.array_distinct(
        F.array_compact(F.transform(F.split(c, ","), lambda x: script_of_language(x)))
    )
    return F.when(F.size(found) == 1, found[0])


def speech_style(c: Column) -> Column:
    text = trim_ws(F.regexp_replace(c, L.QUOTED, ""))
    tail = trim_ws(F.regexp_replace(text, "[.!…, ]+$", ""))
    return (
        F.when((text == "") | text.endswith("?"), F.lit(None))
        .when(tail.endswith("니다"), F.lit("formal"))
        .when(tail.rlike("(죠|까요|세요|네요)$"), F.lit(None))
        .when(tail.endswith("요"), F.lit("informal"))
    )


def speaker_confidence(status: Column) -> Column:
    return F.when(status == "confirmed", 1.0).when(status == "inferred", 0.75).when(
        status == "unresolved", 0.0
    )
