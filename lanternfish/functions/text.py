"""Text expressions: sentences, descriptions, prompts, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark what is no photograph.
NOT_PHOTOS = ["coat of arms", "seal of", "flag of", "logo", "emblem", "map of", "diagram", "icon", "symbol", "chart", "graph", "route map", "locator map", "banner", "screenshot"]
#: A phrase as whole words, in any case; letters and digits of every script count as parts of words.
BLOCKED = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(NOT_PHOTOS) + r")(?![\p{L}\p{N}_])"
EMPTY_MESSAGE = "No caption was found. Is the index built?"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def sentences(block: Column) -> Column:
    return F.transform(F.split(F.replace(F.coalesce(block, F.lit("")), F.lit(". "), F.lit(".\n")), "\n"), strip)


def sentence_key(sentence: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(F.lower(sentence), r"\s+", " ")), r"\.+$", "")


def with_dot(sentence: Column) -> Column:
    return F.when(F.endswith(sentence, F.lit(".")), sentence).otherwise(F.concat(sentence, F.lit(".")))


def cut_at_sentence(text: Column, most: int = 500) -> Column:
    """``text``; if longer than ``most``, up to the last dot within that, and a dot."""
    head = F.regexp_replace(F.substring(text, 1, most), r"\.[^.]*$", "")
    return F.when(F.char_length(text) > most, F.concat(head, F.lit("."))).otherwise(text)


def clean_description(html: Column, least: int = 15, most: int = 400, foreign: float = 0.15) -> Column:
    """Text of ``html`` without tags; null if too short, too long or mostly beyond ASCII."""
    text = strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    size = F.char_length(text)
    odd = F.char_length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.when((size >= least) & (size <= most) & (odd <= foreign * size), text)


def is_blocked(text: Column) -> Column:
    return F.coalesce(text.rlike(BLOCKED), F.lit(False))


def fallback_caption(description: Column, phrase: Column) -> Column:
    return F.coalesce(F.when(description != "", description), F.concat(F.lit("A photograph of "), phrase, F.lit(".")))


def prompt(context: Column) -> Column:
    seed = strip(F.element_at(F.split(F.coalesce(context, F.lit("")), r"\."), 1))
    return F.when(seed != "", F.concat(F.lit("a photo related to: "), seed))


def without_prompt(text: Column, said: Column) -> Column:
    echoed = F.startswith(F.lower(text), F.lower(said))
    return strip(F.when(F.coalesce(echoed, F.lit(False)), F.substring(text, F.char_length(said) + 1, F.char_length(text))).otherwise(text))


def tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


# The rules of the Penn Treebank's tokenisation, as (pattern, replacement), in the order in which they apply. Quotes open
# at a text's start and after space or a bracket; clitics come apart; words that are run together are split.
PTB_RULES = [
    (r"^[\"\u201C]", "`` "), (r"([ (\[{<])[\"\u201C]", "$1 `` "), (r"\.\.\.|\u2026", " ... "), (r"([:,])(?![0-9])", " $1 "), (r"[;@#$%&]", " $0 "),
    (r"([^.])(\.)([\])}>\"'\u201D\u2019]*)\s*$", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([\]\[(){}<>])", " $1 "), (r"(--|\u2014|\u2013)", " -- "),
    (r"[\"\u201D]", " '' "), (r"\u2019", "'"), (r"([^' ])('s|'m|'d) ", "$1 $2 "), (r"([^' ])('ll|'re|'ve|n't) ", "$1 $2 "), (r"([^'])' ", "$1 ' "),
    (r"\b(can)(not)\b", "$1 $2"), (r"\b(gim|lem)(me)\b", "$1 $2"), (r"\b(gon|wan)(na)\b", "$1 $2"), (r"\b(got)(ta)\b", "$1 $2"), (r"\b(d)('ye)\b", "$1 $2"), (r"\b(more)('n)\b", "$1 $2"), (r" '(t)(is|was)\b", " '$1 $2"),
]
# Tokens that scorers of captions leave out, as the tokeniser writes them.
PUNCTUATION = ["''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-", ".", "?", "!", ",", ":", "-", "--", "...", ";"]
BRACKETS = {"(": "-LRB-", ")": "-RRB-", "{": "-LCB-", "}": "-RCB-", "[": "-LSB-", "]": "-RSB-"}


def ptb_tokens(text: Column, lower: bool = True, keep_punctuation: bool = False) -> Column:
    """Tokens of ``text`` by the Penn Treebank's rules, one cascade of replacements; in lower case and without punctuation, as scorers of
    captions take them, unless asked otherwise. Null and empty texts have none."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " "), F.lit(" "))
    out = F.regexp_replace(out, "^ ", "")
    for pattern, by in PTB_RULES:
        out = F.regexp_replace(out, f"(?i){pattern}" if "\\b" in pattern or "'s" in pattern or "n't" in pattern else pattern, by)
    found = F.filter(F.split(out, r"\s+"), lambda w: w != "")
    names = F.create_map(*[F.lit(x) for pair in BRACKETS.items() for x in pair])
    found = F.transform(found, lambda w: F.coalesce(F.try_element_at(names, w), w))
    if not keep_punctuation:
        found = F.filter(found, lambda w: ~w.isin(PUNCTUATION))
    return F.transform(found, lambda w: F.when(w.rlike("^-[LR][RCS]B-$"), w).otherwise(F.lower(w))) if lower else found


def title_without_prefix(title: Column, prefix: str = "Category:") -> Column:
    return F.regexp_replace(title, f"^{prefix}", "")
