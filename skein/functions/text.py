"""Text functions on columns: cleaning, checks, splitting, counting, filters.

All but ``composed`` are built-in expressions, so that they stay inside code generation. Patterns name
their character classes, as ``\\w`` and ``\\s`` differ between engines.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII that cleaning treats as a blank. Fixed values.
ODD_SPACES = "\u00a0\u202f\u2009"
#: Dashes that become a hyphen. Fixed values.
DASHES = "\u2013\u2014\u2015"
#: Ligatures and what they become. Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Symbols kept in spoken text. Fixed values.
SPOKEN = "\u20ac\u2022\u2018\u2019\u201c\u201d"
#: All Unicode white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Its characters other than the blank and the line end.
ODD_BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Emoji by Unicode block: pictographs, symbols, dingbats, arrows, selectors, joiner, keycap. Fixed values.
EMOJI = r"[\x{1F000}-\x{1FBFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200D}\x{20E3}]+"
#: Markers of Dutch and English text; one Dutch marker counts double. Fixed values.
DUTCH = ("van de", "het", "een", "worden", "zijn", "deze", "voor", "ook", "maar", "naar", "bij", "worden", "niet", "wordt", "energie", "heeft", "kunnen", "nieuwe", "jaar")
ENGLISH = ("the", "and", "that", "with", "for", "are", "from", "this", "was", "which", "their", "have", "been")
#: Phrases that refer to the source instead of answering. Fixed values.
FILLERS = (
    "according to the report", "the document states", "as mentioned in the document", "the report indicates", "as stated in the document", "the document mentions",
    "volgens het rapport", "volgens het document", "het document stelt", "het rapport vermeldt", "zoals vermeld in het document", "zoals vermeld in het rapport", "het document geeft aan", "volgens de tekst",
)
#: Substrings that claim a consequence, and those that make such a claim a citation. Fixed values.
ASSUMPTIONS = ("will not be accepted", "will be rejected", "is mandatory", "must have", "it is required", "without it", "otherwise", "wordt niet geaccepteerd", "wordt geweigerd", "is verplicht", "moet hebben", "anders", "zonder dit")
CITATIONS = ("states that", "specifies that", "defines", "explicitly", "stelt dat", "specificeert dat", "definieert", "expliciet")
CHARS_PER_TOKEN = 4


#: White space at both ends; behind, a run is tried at its start alone, as trying it at every place takes the square of its length.
ENDS = rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z"
#: The characters of ``SPACE``, for trims of short pieces without a pattern.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, ENDS, "")


def clean(text: Column) -> Column:
    """P1. For embedding: runs of dots, page numbers, odd blanks and dashes; white space becomes one blank.

    Page numbers are lines of up to three digits; they go while lines are still apart. White
    space is brought to single blanks and line ends first, so that no pattern walks over
    a run of it twice; a blank that stands alone is left as it is.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\.{4,}", "...")
    t = F.regexp_replace(F.translate(t, ODD_BLANKS, " " * len(ODD_BLANKS)), " {2,}+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*+", "\n")
    t = F.regexp_replace(t, r"(?md)^ ?[0-9]{1,3} ?$", "")
    t = F.translate(t, DASHES + "\u00ad", "---")
    t = F.replace(t, F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(t, r" [ \n]++|\n[ \n]*+", " "))


def count_of(text: Column, one: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))


def valid_chunk(text: Column) -> Column:
    """P2. Whether a chunk is prose: 20 characters, 5 words, few dots and digits, words long enough."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))

    def judged(w: Column) -> Column:  # the words are taken once, however often they are counted
        n, letters = F.size(w), F.length(F.array_join(w, ""))
        return (n >= 5) & (count_of(text, ".") <= n * 2) & (letters / F.greatest(n, F.lit(1)) >= 2.5) & (F.regexp_count(text, F.lit(r"\p{Nd}")) <= F.length(text) * 0.3) & (F.length(strip(text)) >= 20)

    return F.coalesce(F.element_at(F.transform(F.array(words), judged), 1), F.lit(False))


def spoken(text: Column) -> Column:
    """P3. Safe for speech: ASCII, Latin letters under U+024F and six symbols; the rest a blank."""
    t = F.coalesce(text, F.lit(""))
    t = F.translate(t, DASHES + ODD_SPACES + "\u00ad", "---   ")
    for one, two in {**LIGATURES, "…": "..."}.items():
        t = F.replace(t, F.lit(one), F.lit(two))
    t = F.regexp_replace(t, rf"[^\x20-\x7e\n\t\rªµºÀ-ÖØ-öø-Ɏ{SPOKEN}]", " ")
    return F.trim(F.regexp_replace(t, r" [ \n\t\r]++|[\n\t\r][ \n\t\r]*+", " "))  # no other white space is left


def unsafe_characters(text: Column) -> Column:
    """P4. Distinct CJK, emoji and characters from U+3000 on, in order; five ligatures are allowed."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\x{3000}-\x{FAFF}\x{FB05}-\x{10FFFF}]"), F.lit(0)))


def year_of(title: Column) -> Column:
    """S5. The first year 20xx that stands alone, else null."""
    return F.nullif(F.regexp_extract(title, r"(?<![\p{L}\p{N}_])(20[0-9]{2})(?![\p{L}\p{N}_])", 1), F.lit(""))


def context_of(text: Column, term: str, around: int = 100) -> Column:
    """P8. The text around the first place where a term occurs, case ignored; null where it doesn't."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.least(at + len(term) + around, F.length(text) + 1) - start))


def email_ok(text: Column) -> Column:
    """P18. Whether a text is a mail address."""
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9.\-_+%]*@(?:[A-Za-z0-9]++\.)++[A-Za-z]{2,}$")


def sentences(text: Column) -> Column:
    """T1. Array of sentences: split behind . ! ? and white space, stripped, empty ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(text: Column) -> Column:
    """T4. Array of words without the punctuation at their ends; none that is only punctuation."""
    return F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: F.regexp_replace(w, r"[!-/:-@\[-`{-~]", "")), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """T5. Array of paragraphs: split at blank lines, stripped, empty ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r\f\x0B]*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def terms(text: Column) -> Column:
    """T9. Lower-case index terms: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """T10. Estimated tokens, four characters each."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN).cast("long")


def word_tokens(text: Column, special: int = 0) -> Column:
    """T10. Estimated tokens by words, 1.3 each and some for special ones."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{SPACE[1:-1]}]+"))
    return F.floor(n * 1.3 + special).cast("long")


def truncated(text: Column, limit: Column | int) -> Column:
    """T15. At most ``limit`` tokens: cut behind the last sentence if past four fifths, else with an ellipsis.

    The marks are tried in turn, as a later one of them isn't preferred for being later in the text.
    """
    most = (F.lit(limit) if isinstance(limit, int) else limit) * CHARS_PER_TOKEN
    cut = F.substring(text, F.lit(1), most)
    out = F.concat(F.regexp_replace(cut, rf"(?<!{SPACE}){SPACE}++\z", ""), F.lit("..."))
    for mark in ("\n\n", "! ", "? ", ". "):
        at = F.length(cut) - F.instr(F.reverse(cut), mark[::-1]) - len(mark) + 1  # 0-based place of the last one
        found = (F.instr(cut, mark) > 0) & (at > most * 0.8)
        out = F.when(found, F.substring(cut, F.lit(1), at + len(mark))).otherwise(out)
    return F.when(F.length(text) <= most, text).otherwise(out)


#: A link, and what begins as one up to where it can't be: that is taken whole, as every bracket in it would end at the same place.
LINK, NO_LINK = r"\[([^\]]*+)\]\([^)]*+\)", r"\[[^\]]*+(?:\](?:\([^)]*+\z)?+)?+"
#: Rules that strip Markdown: for line starts, then within lines, in this order. Fixed values.
LINE_RULES = ((r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*[-+*][ \t]+", ""), (r"(?m)^[ \t]*>[ \t]+", ""))
INLINE_RULES = (
    (rf"!{LINK}|(!{NO_LINK})", "$1$2"), (rf"{LINK}|({NO_LINK})", "$1$2"),
    (r"(?<!\S)\*\*([^*]+?)\*\*(?!\S)", "$1"), (r"(?<!\S)\*([^*]+?)\*(?!\S)", "$1"),
    (r"(?<![\p{L}\p{N}_])__([^_]+?)__(?![\p{L}\p{N}_])", "$1"), (r"(?<![\p{L}\p{N}_])_([^_]+?)_(?![\p{L}\p{N}_])", "$1"),
    (r"`{3,4}\S*", ""), (r"`([^`]+?)`", "$1"), (r"~~(?!\s)([^~]*?)(?<!\s)~~", ""),
)


def _replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def plain_inline(text: Column) -> Column:
    """N1, N2. Without the Markdown marks within lines."""
    return _replaced(text, INLINE_RULES)


def plain_markdown(text: Column) -> Column:
    """N1. Without Markdown marks: those at line starts, then those within lines."""
    return plain_inline(_replaced(text, LINE_RULES))


def without_emoji(text: Column) -> Column:
    """N3. Without emoji, their joiners and selectors."""
    return F.regexp_replace(text, EMOJI, "")


def composed(text: Column) -> Column:
    """N5. Unicode's NFKC form, for which Spark has no expression: full-width letters, ligatures and the like become plain."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(text)


def turn_text(text: Column) -> Column:
    """N5. For turn models: NFKC, lower case, no punctuation but apostrophes and hyphens, one blank between words."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(composed(text)), r"[\p{P}&&[^'\-]]", ""), f"{SPACE}+", " "))


def language(text: Column) -> Column:
    """N6. Dutch or English by markers in the first 3,000 characters; Dutch unless English leads by half as much again."""
    sample = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 3000))
    hits = lambda marks: sum((sample.contains(f" {m} ").cast("int") for m in marks), F.lit(0))
    return F.when((hits(ENGLISH) > hits(DUTCH) * 1.5) & ~(hits(DUTCH) > hits(ENGLISH) * 1.5), "English").otherwise("Dutch")


def ends_turn(text: Column) -> Column:
    """N7. Whether a text ends like a finished turn."""
    return strip(text).rlike(r"[.!?]$")


def ignored_speaker(speaker: Column) -> Column:
    """N8. Speakers such as __ASSISTANT__ are left out."""
    return F.coalesce(speaker.rlike(r"^__[A-Z0-9_]{2,}__$"), F.lit(False))


def qa_verdict(question: Column, answer: Column, most_tokens: int = 60) -> Column:
    """P7. Why a question and answer pair is refused, or null if it is good. Tokens are counted by words."""

    def judged(low: Column) -> Column:  # the answer is brought to lower case once, however many phrases are looked for
        filler = F.coalesce(*(F.when(low.contains(p), p) for p in FILLERS))
        claim = F.coalesce(*(F.when(low.contains(p), p) for p in ASSUMPTIONS))
        cited = F.exists(F.array(*(F.lit(p) for p in CITATIONS)), lambda p: F.contains(low, p))
        return F.when(filler.isNotNull(), F.concat(F.lit("filler: "), filler)).when(claim.isNotNull() & ~cited, F.concat(F.lit("assumption: "), claim))

    return (
        F.when(question.isNull() | answer.isNull(), "missing")
        .when((strip(question) == "") | (strip(answer) == ""), "empty")
        .when(word_tokens(question) > most_tokens, "too long")
        .otherwise(F.element_at(F.transform(F.array(F.lower(strip(answer))), judged), 1))
    )


def byte_size(n: Column) -> Column:
    """Bytes for people: B to TB, two decimals."""
    out = F.format_string("%.2f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """P6. Whether a name ends with one of the suffixes."""
    return F.exists(F.array(*(F.lit(s) for s in suffixes)), lambda s: F.endswith(name, s))


def user_of_room(room: Column) -> Column:
    """P12. The user in a room's name: what stands before ``_conversation``, else before the first underscore."""
    return F.when(F.contains(room, F.lit("_conversation")), F.split_part(room, F.lit("_conversation"), F.lit(1))).otherwise(F.split_part(room, F.lit("_"), F.lit(1)))


def part_of_room(room: Column, n: int) -> Column:
    """P20. The n-th part of a room's name of the form room::user::speaker; empty if there is none."""
    return F.split_part(room, F.lit("::"), F.lit(n))


def secure_name(name: Column) -> Column:
    """P14. A file name without folders: anything but letters, digits, _ . - becomes one underscore, none of . and _ at the ends."""
    flat = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("/"), F.lit("_")), "[^A-Za-z0-9_.-]", "_"), "_+", "_")
    return F.regexp_replace(flat, r"^[._]+|[._]+$", "")


def json_field(text: Column, field: str, kind: str, default) -> Column:
    """P15. A field of a JSON text; the default where the text is broken or lacks it."""
    return F.coalesce(F.from_json(text, f"{field} {kind}")[field], F.lit(default))


def interrupts(text: Column, seconds: Column, least_words: int, least_seconds: float) -> Column:
    """P19. Whether speech is long enough, in words and seconds, to interrupt."""
    return (F.size(words(text)) >= least_words) & (seconds >= least_seconds)


def first_reason(*checks: tuple[Column, str], otherwise: str = "ok") -> Column:
    """P13. The reason of the first check that holds, in order; of a token: whether it is valid, expired, for this site and device."""
    out = F.lit(otherwise)
    for fails, reason in reversed(checks):
        out = F.when(fails, reason).otherwise(out)
    return out
