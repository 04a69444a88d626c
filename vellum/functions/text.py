"""Text repairs as Column -> Column functions, in the order in which they apply to a text node."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import vectorised

# The characters and what they stand for are those of the repair rules.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
MOJIBAKE = [
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€”", "—"),
    ("â€“", "–"),
    ("Â ", " "),
    ("Ã©", "é"),
    ("Ã¨", "è"),
]
SOFT_HYPHEN = "­"
CHAPTER = r"(?i)^(chapter|part|book|volume)\s+([ivxlcdm]+|\p{Nd}+|[a-z]+)(?U)\b"
ROMAN_ALONE = r"^[IVXLCDM]{1,8}\.?\s*$"
NUMBER_ALONE = r"^\p{Nd}{1,3}\.?\s*$"
DINKUS = r"^\s*(\*\s*){3,}\s*$"
THOUGHT = r"(?iU)\b(she|he|they|i)\s+(thought|wondered|realized|remembered|knew|felt)\b"


def _each(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fix_ligatures(x: Column) -> Column:
    return _each(x, LIGATURES)


def fix_mojibake(x: Column) -> Column:
    return _each(x, MOJIBAKE)


def drop_soft_hyphens(x: Column) -> Column:
    return F.replace(x, F.lit(SOFT_HYPHEN), F.lit(""))


@vectorised("string")
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(x: Column) -> Column:
    """Unicode compatibility composition. Spark has no such function; what is ASCII already stays in the JVM's hands."""
    return F.when(x.rlike(r"[^\x00-\x7f]"), _nfkc(x)).otherwise(x)


def drop_inner_returns(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)(?<=\w)\r(?=\w)", "")


def drop_caret_noise(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\^+", ""), r"\{[0-9]+\}", "")


def collapse_blanks(x: Column) -> Column:
    return F.regexp_replace(x, r"[ \t]+", " ")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def one_line(x: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def rewrite_matches(x: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """x with each match of the pattern replaced by f of the whole match, which Spark's regexp_replace can't do.

    The pieces between matches and the matches are lists that zip back to the text.
    """
    matches = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    gaps = F.split(x, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.transform(matches, f), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def escape_html(x: Column) -> Column:
    return _each(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def strip_fences(x: Column) -> Column:
    """A model's reply without a leading rule and code fences around it."""
    x = F.regexp_replace(x, r"(?U)^\s*(?:---\s*)?", "")
    x = F.regexp_replace(x, r"^```[A-Za-z]*[ \t]*\n?", "")
    return strip(F.regexp_replace(x, r"\n?```[ \t]*\s*$", ""))


def is_upper(x: Column) -> Column:
    """Has a cased character and none that is not upper case."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")


def n_words(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0)))


def is_chapter(x: Column) -> Column:
    return x.rlike(CHAPTER)


def is_heading(x: Column) -> Column:
    """A line that looks like a heading: short, and a chapter mark, a lone numeral or up to eight words of capitals."""
    x = strip(x)
    marked = x.rlike(CHAPTER) | x.rlike(ROMAN_ALONE) | x.rlike(NUMBER_ALONE)
    return (F.length(x) > 0) & (F.length(x) <= 150) & (marked | (is_upper(x) & (n_words(x) <= 8)))


def is_inflection(a: Column, b: Column) -> Column:
    """One is the other with a plural or possessive ending; equal words are not."""
    a, b = F.lower(a), F.lower(b)
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ends = [F.concat(short, F.lit(e)) for e in ("s", "es", "'s", "’s")]
    return (a != b) & (long_ == ends[0]) | (a != b) & ((long_ == ends[1]) | (long_ == ends[2]) | (long_ == ends[3]))


def replace_words(x: Column, pairs: Column) -> Column:
    """x with whole-word variants replaced, for an array of (variant, canonical) in the order they apply.

    A later pair sees what an earlier one made. Pairs whose variant does not occur cost a substring test only.
    """

    def step(acc: Column, p: Column) -> Column:
        found = F.concat(F.lit(r"(?U)\b\Q"), p["variant"], F.lit(r"\E\b"))
        # backslashes and dollars of the replacement stand for themselves
        to = F.replace(F.replace(p["canonical"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.when(F.contains(acc, p["variant"]), F.regexp_replace(acc, found, to)).otherwise(acc)

    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<variant:string,canonical:string>>")), x, step)


def basic_clean(x: Column) -> Column:
    """The repairs that need no vocabulary, for every register."""
    for f in (fix_ligatures, fix_mojibake, drop_soft_hyphens, nfkc, drop_inner_returns, drop_caret_noise, collapse_blanks):
        x = f(x)
    return x


# Words that are no names, and titles before names by what they say about gender.
PRONOUNS = """i me my mine myself we us our ours you your yours he him his himself she her hers herself
it its itself they them their theirs this that these those who whom whose""".split()
DESCRIPTORS = ["the ", "a ", "an ", "his ", "her ", "its ", "their ", "my ", "your ", "this ", "that ", "these ", "those "]
HONORIFICS = """mr mrs ms miss mx dr sir madam madame monsieur mlle mme lord lady master st saint prof professor
rev reverend father captain capt lieutenant lt commander cmdr admiral colonel col major general gen sergeant sgt
king queen prince princess duke duchess count countess baron baroness""".split()
MALE = "mr sir lord master king prince duke count baron father brother uncle monsieur".split()
FEMALE = "mrs ms miss madam madame mlle mme lady queen princess duchess countess baroness mother sister aunt".split()


def _tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def name_parts(x: Column) -> Column:
    """Lower-case words of a name without honorifics; the last is the surname."""
    return F.filter(_tokens(x), lambda w: ~w.isin(HONORIFICS))


def honorific_gender(x: Column) -> Column:
    """What the first title in a name says, else unknown."""
    first = F.get(F.filter(_tokens(x), lambda w: w.isin(MALE + FEMALE)), F.lit(0))
    return F.when(first.isin(MALE), "male").when(first.isin(FEMALE), "female").otherwise("unknown")


def known_gender(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("male", "female", "nonbinary"), low).otherwise("unknown")


def is_pollution(x: Column, category: Column) -> Column:
    """A variant that names nobody: a pronoun, a description, or outside invented terms a single lower-case word."""
    low, described = F.lower(x), F.lit(False)
    for d in DESCRIPTORS:
        described |= F.startswith(low, F.lit(d))
    bare = x.rlike(r"\p{Ll}") & ~x.rlike(r"[\p{Lu}\p{Lt} ]")
    return low.isin(PRONOUNS) | described | ((category != "invented_terms") & bare)
