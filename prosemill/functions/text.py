"""Column functions on words and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a word, white space as the patterns mean it, and the word pattern.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SPACES = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WORD = f"[{LETTERS}]+(?:['’-][{LETTERS}]+)*"
SILENT_END = "(?:[^laeiouy]es|[^taeiouyd]ed|[^laeiouy]e)$"


def fold_apostrophes(word: Column, marks: str = "’‘") -> Column:
    """Typographic apostrophes as plain ones."""
    return F.translate(word, marks, "'" * len(marks))


def base_form(word: Column) -> Column:
    """The part before the first plain apostrophe, else before the first typographic one, if there is one."""
    plain, curly = F.instr(word, "'"), F.instr(word, "’")
    cut = F.when(plain > 0, plain).otherwise(curly)
    return F.when(cut > 1, F.substr(word, F.lit(1), cut - 1)).otherwise(word)


def syllables(word: Column) -> Column:
    """Heuristic English syllables: vowel groups after silent endings are cut; 0 only without letters a to z."""
    plain = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(F.regexp_replace(F.regexp_replace(plain, SILENT_END, ""), "^y", ""), F.lit("[aeiouy]+"))
    return F.when(F.length(plain) == 0, 0).when(F.length(plain) <= 3, 1).otherwise(F.greatest(groups, F.lit(1)))


def round1(x: Column) -> Column:
    """One decimal, ties towards positive infinity; null and non-finite values are 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.floor(x.cast("double") * 10 + 0.5) / 10).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ease_label(flesch: Column) -> Column:
    return (
        F.when(flesch >= 80, "Very easy")
        .when(flesch >= 60, "Easy")
        .when(flesch >= 50, "Fairly hard")
        .when(flesch >= 30, "Hard")
        .otherwise("Very hard")
    )


def band(words: Column, short: int = 8, long: int = 25, very_long: int = 40) -> Column:
    """Length band of a sentence; short is tested first."""
    return (
        F.when(words <= short, "short").when(words >= very_long, "veryLong").when(words >= long, "long").otherwise("medium")
    )


def word_at(line: Column, column: Column) -> Column:
    """The word around a column of a line, trimmed of edge punctuation; null without a letter."""
    part = f"[{LETTERS}'’-]*"
    at = F.least(column, F.length(line))
    # Up to the very end: ``$`` would also match before a line feed there. From where the run begins, so that a long one is passed once.
    before = F.regexp_extract(F.substr(line, F.lit(1), at), f"(?<![{LETTERS}'’-])({part}+)\\z", 1)
    after = F.regexp_extract(F.substr(line, at + 1), f"^({part})", 1)
    word = F.regexp_replace(F.concat(before, after), "^[-'’]+|[-'’]+$", "")
    return F.when((column >= 0) & word.rlike(f"[{LETTERS}]"), word)


def signed(delta: Column) -> Column:
    """A change with its sign, one decimal, and no trailing ``.0``; null, as hidden, if there is none."""
    shown = F.regexp_replace(F.format_string("%.1f", delta), "\\.0$", "")
    return F.when(delta > 0, F.concat(F.lit("+"), shown)).when(delta < 0, shown)


def sane_count(x: Column) -> Column:
    """A count from outside: null, negative and non-finite ones are 0, fractions are cut."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x > 0) & (x.cast("double") < float("inf")), F.floor(x)).otherwise(0).cast("int")


def singular(label: Column) -> Column:
    return F.regexp_replace(label, "s$", "")


def status_text(grade: Column, flesch: Column, words: Column) -> Column:
    """``Grade 7.7 · Easy``; null for a text without words."""
    return F.when(words > 0, F.concat(F.format_string("Grade %.1f · ", grade), ease_label(flesch)))


def skip_text(reason: Column, chars: Column, limit: Column) -> Column:
    """One sentence on why a document was not analysed."""
    large = F.concat(
        F.lit("This note is too large for live analysis ("), F.format_number(chars, 0), F.lit(" characters, limit "),
        F.format_number(limit, 0), F.lit("). Raise the limit in settings, under Performance."),
    )
    return F.when(reason == "muted", "Marks are muted for this note.").when(reason == "too-large", large)


def status_explained(grade: Column, flesch: Column, words: Column) -> Column:
    """One sentence on what the grade means; null for a text without words."""
    said = F.concat(
        F.format_number(words, 0), F.format_string(" words · Flesch–Kincaid grade %.1f — ", grade), F.lit("the US school grade needed to read this note; most web writing lands 6–9. "),
        F.lit("Reading ease "), F.floor(flesch + 0.5).cast("string"), F.lit(" ("), ease_label(flesch), F.lit(")."),
    )
    return F.when(words > 0, said)


def skip_status(reason: Column) -> Column:
    """What the status line shows of a document that was not analysed."""
    return F.when(reason == "muted", "Prose muted").when(reason == "too-large", "Prose paused")


def web_url(url: Column, fallback: str) -> Column:
    """The URL if it is http or https, else the fallback."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(scheme.isin("http", "https"), url).otherwise(fallback)


def bar_width(words: Column, longest: Column) -> Column:
    """Percent of the longest sentence, at least 4."""
    return F.greatest(F.lit(4), F.floor(words / F.greatest(longest, F.lit(1)) * 100 + 0.5)).cast("int")


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code-point offset as a UTF-16 offset."""
    before = F.substr(text, F.lit(1), offset)
    return offset + F.regexp_count(before, F.lit("[\\x{10000}-\\x{10FFFF}]"))
