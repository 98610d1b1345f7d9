"""Text expressions shared by the operators.

Word boundaries are spelled as "not a letter and not a digit" because ``\\b``
means different things in different regex engines.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]"
NOT_WORD = r"[^\p{L}\p{N}]+"

# An unclosed comment, script, style or tag runs to the end of the page, as in
# a browser. It also keeps the match linear on broken pages.
def _block(name: str) -> str:
    end = rf"</(?i:{name})(?=[\s/>])[^>]*(?:>|\z)"
    return rf"(?i:{name})(?=[\s/>])[^>]*(?:>(?s:.*?)(?:{end}|\z)|\z)"


_INVISIBLE = rf"!--(?s:.*?)(?:-->|\z)|{_block('script')}|{_block('style')}"
INVISIBLE = f"<(?:{_INVISIBLE})"
MARKUP = rf"<(?:{_INVISIBLE}|[/!?]?[A-Za-z][^>]*(?:>|\z))"
BLANK = " \\t\\r\\n\\f\u00a0"
# Elements that begin a line of their own, and the mark put where they do.
_LINES = (
    "address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|"
    "form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|"
    "title|tr|ul"
)
LINE_TAG = rf"</?(?i:{_LINES})(?=[\s/>])[^>]*(?:>|\z)"
LINE_END = "\u001e"

# Looked up before the full table of names.
COMMON_ENTITIES = {"amp": "&", "nbsp": "\u00a0", "quot": '"', "#39": "'", "lt": "<", "gt": ">"}

_UNITS = "one two three four five six seven eight nine".split()
_TEENS = (
    "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
)
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Spelled numbers up to 99, words divided by one space.
SPELLED = {word: n for n, word in enumerate([*_UNITS, *_TEENS], 1)} | {
    f"{ten} {unit}".strip(): 10 * t + u
    for t, ten in enumerate(_TENS, 2)
    for u, unit in enumerate(["", *_UNITS])
}

# "3-5 years", "5 + yrs", "2 to 4 years", "1.5 years", "five (5) years", "5 or
# more years", "minimum 5 full years": group 1 is the lower bound. A match starts
# at the first digit or letter of a number, and no two neighbouring parts can
# match the same blanks, so the time is linear in the text.
_GAP = "[\\s\u00a0]*"
_WORDS = (
    rf"(?:(?:{'|'.join(_TENS)})(?:[\s-](?:{'|'.join(_UNITS)}))?+"
    rf"|{'|'.join(_TEENS)}|{'|'.join(_UNITS)})(?!\p{{L}})"
)
_DIGITS = "[0-9]++(?:[.][0-9]++)?"
_BRACKET = f"(?:\\({_GAP}[0-9]++{_GAP}\\){_GAP})?"
_MORE = f"(?:(?:[+]|plus|or{_GAP}(?:more|greater|over|above)){_GAP})?"
_WHOLE = f"(?:(?:full|whole|solid|consecutive){_GAP})?"
YEARS = (
    rf"((?<![0-9])[0-9]++|(?<!\p{{L}}){_WORDS})(?:[.][0-9]++)?{_GAP}{_BRACKET}{_MORE}"
    f"(?:(?:-|–|—|to|or){_GAP}(?:{_DIGITS}|{_WORDS}){_GAP}{_BRACKET}{_MORE})?"
    f"{_WHOLE}-?(?:years?|yrs?)(?:[^\\p{{L}}]|$)"
)
MOST = 2**31 - 1  # larger numbers are written as this


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def normalised(text: Column) -> Column:
    """Lower case, each run of other characters one space, one space around."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), NOT_WORD, " ")


def holds(low: Column, phrase: str) -> Column:
    """Whether a normalised phrase stands in lower-case text as whole words in
    that order: the same as finding it in ``normalised(text)``. The plain
    ``contains`` tests are far cheaper and come first, so only a text with all
    of the words pays for the rest."""
    words = phrase.split()
    exact = rf"(?<!{WORD}){NOT_WORD.join(words)}(?!{WORD})"
    return reduce(and_, [*[low.contains(word) for word in words], low.rlike(exact)])


def has_any_phrase(text: Column, phrases: list[str]) -> Column:
    low = lowered(text)
    return reduce(or_, [holds(low, phrase) for phrase in phrases])


def without(low: Column, phrases: list[str]) -> Column:
    """Lower-case text with a blank in place of each of the normalised phrases."""
    either = "|".join(NOT_WORD.join(phrase.split()) for phrase in phrases)
    return F.regexp_replace(low, rf"(?<!{WORD})(?:{either})(?!{WORD})", " ")


def is_only(low: Column, phrase: str) -> Column:
    """Whether the words of lower-case text are the phrase and nothing else."""
    return low.rlike(rf"\A(?:{NOT_WORD})?{NOT_WORD.join(phrase.split())}(?:{NOT_WORD})?\z")


def rule_holds(
    low: Column, terms: list[str], unless: list[str] | None, requires: list[str] | None
) -> Column:
    """Whether a rule's normalised phrases hold in lower-case text; see
    ``functions/terms.py``."""
    terms = [t for t in terms if t]
    if not terms:
        return F.lit(False)
    unless = [p for p in unless or [] if p]
    first = reduce(or_, [holds(low, t) for t in terms])
    if not unless and not requires:
        return first
    rest = without(low, unless) if unless else low
    needed = [
        is_only(low, r[1:]) if r.startswith("=") else holds(rest, r) for r in requires or []
    ]
    again = [reduce(or_, [holds(rest, t) for t in terms])] if unless else []
    return reduce(and_, [first, *again, *([reduce(or_, needed)] if needed else [])])


def _number(found: Column) -> Column:
    """Digits or spelled words as a number."""
    digits = F.regexp_replace(found, "^0+(?=[0-9])", "")
    words = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    return (
        F.when(~found.rlike("^[0-9]"), F.try_element_at(words, F.regexp_replace(found, r"[\s-]", " ")))
        .when(F.length(digits) > 9, MOST)
        .otherwise(digits.try_cast("int"))
    )


def years_required(text: Column) -> Column:
    """The largest number of years asked for; a range counts by its lower end."""
    low = lowered(text)
    found = F.regexp_extract_all(low, F.lit(YEARS), F.lit(1))
    years = F.array_max(F.transform(found, _number))
    return F.when(low.contains("year") | low.contains("yr"), years)


def without_invisible(html: Column) -> Column:
    return F.regexp_replace(html, INVISIBLE, " ")


def _decoded(ref: Column) -> Column:
    """The character of a reference such as ``amp``, ``#233`` or ``#xe9``."""
    names = [*sorted(name2codepoint.items()), ("apos", ord("'"))]
    named = F.create_map(*[F.lit(x) for name, code in names for x in (name, chr(code))])
    digits = F.regexp_replace(ref, "^#[xX]?0*", "")
    # More digits than any character has: no character, but still a reference.
    code = (
        F.when(
            ref.rlike("^#[xX][0-9a-fA-F]+$"),
            F.when(F.length(digits) > 6, "1114112").otherwise(F.conv(digits, 16, 10)),
        )
        .when(ref.rlike("^#[0-9]+$"), F.when(F.length(digits) > 7, "1114112").otherwise(digits))
        .try_cast("int")
    )
    code = F.when(ref.rlike("^#(?:[xX][0-9a-fA-F]+|[0-9]+)$"), F.coalesce(code, F.lit(0)))
    is_char = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.when(is_char, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(
        code.isNotNull(), "\ufffd"
    )
    found = F
    for name, char in COMMON_ENTITIES.items():
        found = found.when(ref == name, char)
    return found.when(ref.startswith("#"), numeric).otherwise(F.try_element_at(named, ref))


def decode_entities(text: Column) -> Column:
    """One left-to-right pass, so ``&amp;lt;`` becomes ``&lt;`` and stops there."""
    parts = F.transform(
        F.split(text, "&"),
        lambda part: F.struct(
            part.alias("part"), F.regexp_extract(part, "^(#?[0-9A-Za-z]++);", 1).alias("ref")
        ),
    )
    parts = F.transform(
        parts,
        lambda p: F.struct(
            p["part"].alias("part"),
            F.length(p["ref"]).alias("n"),
            F.when(p["ref"] != "", _decoded(p["ref"])).alias("char"),
        ),
    )
    joined = F.transform(
        parts,
        lambda p, at: F.when(at == 0, p["part"])
        .when(p["char"].isNull(), F.concat(F.lit("&"), p["part"]))
        .otherwise(F.concat(p["char"], F.substr(p["part"], p["n"] + 2))),
    )
    return F.array_join(joined, "")


def text_lines(visible: Column) -> Column:
    """The text of a page without its invisible parts, with ``LINE_END`` wherever
    an element begins or ends a line, once however many do; blanks are collapsed,
    and none is left beside the mark."""
    text = plain_text(F.regexp_replace(visible, LINE_TAG, LINE_END))
    return F.regexp_replace(text, f" ?{LINE_END}[ {LINE_END}]*+", LINE_END)


def plain_text(html: Column) -> Column:
    """The text between the markup, blanks collapsed. A lone blank is the usual
    case, so only runs and the rarer kinds are replaced."""
    text = decode_entities(F.regexp_replace(html, MARKUP, " "))
    text = F.regexp_replace(text, f"[{BLANK}]{{2,}}", " ")
    return F.trim(F.regexp_replace(text, f"[{BLANK[1:]}]", " "))
