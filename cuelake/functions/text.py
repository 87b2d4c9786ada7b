"""Script-aware text measures as Spark columns. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake import constants as C

#: Everything that Unicode counts as white space, as one class.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Character ranges; each measure has its own, so they are not merged.
UNSPACED = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
DENSE = r"[\x{2E80}-\x{9FFF}]"
TIGHT = r"[\x{3000}-\x{9FFF}\x{FF00}-\x{FFEF}]"
ENDERS = r".!?\x{3002}\x{FF01}\x{FF1F}\x{2026}"
CLAUSES = r",;:\x{FF0C}\x{FF1B}\x{FF1A}\x{3001}"
CLOSERS = r"""\"'\x{300D}\x{300F}\x{FF09})"""
BREAKS = " ,.!?;:，。、！？；："


#: The same characters one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def ends_in_space(c: Column) -> Column:
    """The last character is white space, or there is none; told by the last word, without a pass over the text."""
    return F.contains(F.lit(SPACES), F.substring(F.substring_index(c, " ", -1), -1, 1))


def strip_given(c: Column) -> Column:
    """strip of a column that is at hand, as it is named several times: most texts have no white space at their ends, and to
    trim them takes a pass over every character."""
    return F.when(F.contains(F.lit(SPACES), F.substring(c, 1, 1)) | ends_in_space(c), strip(c)).otherwise(c)


def count_in(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, chars, ""))


def has_content(c: Column) -> Column:
    """FLT-1: some letter or number."""
    return c.rlike(r"[\p{L}\p{N}]")


def is_unspaced(c: Column, share: float = 0.5) -> Column:
    """FLT-3: at least half of what is not space is of a script without spaces between words."""
    seen = F.length(F.regexp_replace(c, WS, ""))
    return (seen > 0) & (count_in(c, UNSPACED) >= seen * share)


def is_unspaced_run(c: Column, share: float = 0.6) -> Column:
    """FLT-8: no blank inside, and mostly such a script."""
    return ~F.contains(c, F.lit(" ")) & (count_in(c, UNSPACED) >= F.length(c) * share)


def units(c: Column) -> Column:
    """STR-1: characters where words are not spaced, else words."""
    s = strip(c)
    return F.when(F.length(s) == 0, 0).when(is_unspaced(s), F.length(s)).otherwise(F.size(F.split(s, f"{WS}+")))


def is_short(c: Column, unspaced: int, words: int) -> Column:
    """FLT-4."""
    return (units(c) > 0) & (units(c) <= F.when(is_unspaced(strip(c)), unspaced).otherwise(words))


def ends_sentence(c: Column) -> Column:
    """FLT-6."""
    return strip(c).rlike(rf"[{ENDERS}]\z")


def is_fragment(c: Column) -> Column:
    """FLT-5: too short to stand alone and not closed by sentence punctuation."""
    size = F.length(strip_given(c))
    short = size <= max(C.FRAGMENT_LATIN_MAX_CHARS, C.FRAGMENT_CJK_CHARS)  # of either script; most texts end here
    long = ~is_unspaced(strip(c)) & (size > C.FRAGMENT_LATIN_MAX_CHARS)
    return short & ~ends_sentence(c) & ~long & is_short(c, C.FRAGMENT_CJK_CHARS, C.FRAGMENT_LATIN_WORDS)


def is_single_sentence(c: Column) -> Column:
    """FLT-7: something is left without the closing marks, and no sentence ends inside it."""
    inner = strip(F.regexp_replace(strip(c), rf"[{ENDERS}{CLOSERS}]+\z", ""))
    return (F.length(inner) > 0) & ~inner.rlike(f"[{ENDERS}]")


def estimate_tokens(c: Column) -> Column:
    """STR-2."""
    dense = count_in(c, DENSE)
    return (dense + F.floor((F.length(c) - dense) / 4) + 1).cast("long")


def join_text(a: Column, b: Column) -> Column:
    """STR-3: one blank between the two, but none next to a script without spaces."""
    tight = F.substring(a, -1, 1).rlike(TIGHT) | F.substring(b, 1, 1).rlike(TIGHT)
    return F.when((a == "") | (b == "") | tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def plausible_end(text: Column, start: Column, end: Column) -> Column:
    """STR-4: a span of over twice its reading time ends after the reading time."""
    reading = F.greatest(F.length(text) / C.CHARS_PER_SECOND, F.lit(C.MIN_LINE_DURATION))
    return F.when(end - start > 2 * reading, start + reading).otherwise(end)


def _clock(ms: Column, unit: int) -> tuple[Column, Column, Column, Column]:
    part = lambda size, n: F.floor(ms / size) % n
    return F.floor(ms / (3600 * unit)), part(60 * unit, 60), part(unit, 60), ms % unit


def srt_time(c: Column) -> Column:
    """STR-5."""
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(F.bround(F.greatest(c, F.lit(0.0)) * 1000).cast("long"), 1000))


def ass_time(c: Column) -> Column:
    """STR-6."""
    return F.format_string("%d:%02d:%02d.%02d", *_clock(F.bround(F.greatest(c, F.lit(0.0)) * 100).cast("long"), 100))


def log_time(c: Column) -> Column:
    """STR-7."""
    return F.format_string("%d:%02d:%02d.%03d", *_clock(F.bround(F.greatest(c, F.lit(0.0)) * 1000).cast("long"), 1000))


def parse_time(c: Column) -> Column:
    """STR-8: h:m:s, m:s or s in seconds; null for what is not a time (VER-9)."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: F.trim(p).try_cast("double"))
    value = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)
    return F.when((F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0)), value)


def ass_color(c: Column) -> Column:
    """STR-9: #RRGGBB as &H00BBGGRR, white where the length is wrong."""
    h = F.regexp_replace(F.trim(c), "^#+", "")
    h = F.when(F.length(h) == 6, h).otherwise("FFFFFF")
    return F.upper(F.concat(F.lit("&H00"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def ass_escape(c: Column) -> Column:
    """STR-10."""
    return F.replace(F.replace(c, F.lit("{"), F.lit("（")), F.lit("}"), F.lit("）"))


def wrap(c: Column, limit: int = C.MAX_CHARS_PER_LINE) -> Column:
    """STR-11: at most two display lines, cut at the break nearest the middle, where both halves fit if
    any break does; without breaks only an unspaced run is cut, in the middle.

    A break at a blank is before it, at another mark after it, and neither the first nor the last character is one. Places grow
    with the marks, so that only the last one up to the middle and the first one beyond it are looked for; each is the one of its
    side that fits if any does, since the places where both halves fit are a range around the middle."""

    def bind(value: Column, body) -> Column:  # a computed column that is used more than once
        return F.transform(F.array(value), body)[0]

    marks, some, spaces = f"[{BREAKS.replace(' ', '')}]", rf"[^{WS[1:]}", F.lit(SPACES)
    left = lambda s: F.ltrim(s, spaces)
    # Trimming the right edge takes a pass over the text, and most texts have no white space there: their last word tells.
    right = lambda s: F.when(ends_in_space(s), F.rtrim(s, spaces)).otherwise(s)

    def cut(s: Column, n: Column, ascii: Column) -> Column:
        def part(c: Column, at: Column, size: Column) -> Column:  # of bytes where that is the same, as characters have to be counted
            return F.when(ascii, F.substring(c.cast("binary"), at, size).cast("string")).otherwise(F.substring(c, at, size))

        h = F.floor(n / 2).cast("int")

        def place(p: Column) -> Column:
            # The first half may end from the last character that may begin the second one, up to before the first beyond the limit.
            none = (n > 2 * limit) & s.rlike(rf"(?s)^.{{{limit},}}?{some}.{{{limit}}}") if limit > 0 else F.lit(True)
            low = (p["a"] >= n - limit) | (p["a"] >= F.length(right(part(s, F.lit(1), n - limit))))
            high = (p["b"] <= limit) | (p["b"] <= n - F.length(left(part(s, F.lit(limit + 1), n))))
            a, b = F.coalesce(low, F.lit(False)), F.coalesce(high, F.lit(False))
            nearest = F.when(p["a"].isNull() | (p["b"] - n / 2 < n / 2 - p["a"]), p["b"]).otherwise(p["a"])
            return F.when(none, nearest).when(a & ~b, p["a"]).when(b & ~a, p["b"]).otherwise(nearest)

        def halves(x: Column) -> Column:  # what is before the middle, and the middle with what follows
            before = F.length(F.regexp_extract(x["l"], f"(?s)^.+(?:(?= )|{marks})", 0))
            after = F.length(F.regexp_extract(x["r"], f"(?s)^(?:{marks}(?=.)|.+?(?:(?= )|{marks}(?=.)))", 0))
            low = F.when(F.startswith(x["r"], F.lit(" ")), h).otherwise(F.nullif(before, F.lit(0)))
            found = bind(F.struct(low.alias("a"), (h + F.nullif(after, F.lit(0))).alias("b")), place)
            at = F.coalesce(found, F.when(is_unspaced_run(s), h))
            begins = lambda k: F.when(k == h, x["l"]).when(k < h, part(x["l"], F.lit(1), k)).otherwise(F.concat(x["l"], part(x["r"], F.lit(1), k - h)))
            ends = lambda k: F.when(k == h, x["r"]).when(k < h, F.concat(part(x["l"], k + 1, n), x["r"])).otherwise(part(x["r"], k - h + 1, n))
            return bind(at, lambda k: F.when(k.isNull(), F.array(s)).otherwise(F.array(bind(begins(k), right), left(ends(k)))))

        return bind(F.struct(part(s, F.lit(1), h).alias("l"), part(s, h + 1, n).alias("r")), halves)

    def whole(s: Column) -> Column:
        size = F.struct(F.length(s).alias("n"), F.octet_length(s).alias("bytes"))
        return bind(size, lambda x: F.when((x["n"] <= limit) | (F.lit(limit) <= 0) | (x["n"] < 3), F.array(s)).otherwise(cut(s, x["n"], x["n"] == x["bytes"])))

    return bind(left(c), lambda x: bind(right(x), whole))


def strip_marks(c: Column) -> Column:
    """STR-12: without song marks, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(c, "♪", " "), f"{WS}+", " "))


def apply_marks(c: Column, is_lyric: Column) -> Column:
    bare = strip_marks(c)
    return F.when(F.coalesce(is_lyric, F.lit(False)) & (F.length(bare) > 0), F.concat(F.lit("♪ "), bare, F.lit(" ♪"))).otherwise(bare)


def rejects_thinking(c: Column, hints: list[str]) -> Column:
    """FLT-9: the lower-cased message holds one of the hints."""
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(c), h))


#: Single characters that are punctuation and no word of their own.
PUNCTUATION = "。、，,.!?！？…‥：:；;「」『』（）()[]【】\"“”'‘’-—―~～·・/\\|*&#♪♫"


def words(c: Column) -> Column:
    """VER-2: lower-case alphanumeric runs, and every other character that is neither space nor punctuation."""
    marks = "".join("\\" + x if x in "[]^-&\\" else x for x in PUNCTUATION)
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[0-9a-z']{{2,}}|[0-9a-z]|[^0-9a-z'\s\x0b\x1c-\x1f\x85\p{{Z}}{marks}]"), F.lit(0))
