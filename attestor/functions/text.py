"""Column functions on text: white space, sentences, tokens, chunk windows, page lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, the four information separators included.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SENTENCE_LEAST, CLAIM_WORDS, CLAIM_LIMIT = 16, (9, 59), 20
PARAGRAPH_SENTENCES, WINDOW, OVERLAP = 5, 2, 1


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends; trim() alone takes spaces only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column, least: int = SENTENCE_LEAST) -> Column:
    """Sentences of at least `least` characters: cut at a space after . ! ? and before an ASCII capital."""
    return F.filter(F.split(normalized(text), "(?<=[.!?]) (?=[A-Z])"), lambda s: F.length(s) >= least)


def words(text: Column) -> Column:
    """Number of words of a normalised text."""
    return F.size(F.split(text, " "))


def claims(text: Column, limit: int | None = CLAIM_LIMIT) -> Column:
    """The distinct sentences of claim length, in order of first appearance, the first `limit`; all if that is None."""
    long = F.filter(sentences(text), lambda s: words(s).between(*CLAIM_WORDS))
    return F.array_distinct(long) if limit is None else F.slice(F.array_distinct(long), 1, limit)


def tokens(text: Column) -> Column:
    """Lower-case words with their punctuation."""
    return F.filter(F.split(F.lower(normalized(text)), " "), lambda t: t != "")


def paragraphs(found: Column, size: int = PARAGRAPH_SENTENCES) -> Column:
    """Groups of `size` sentences; the last may be shorter."""
    n = F.size(found)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(found, i, F.lit(size)))


def windows(group: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Sliding windows over a group of sentences, joined; a shorter tail stays."""
    step = max(1, window - overlap)
    return F.transform(F.sequence(F.lit(1), F.size(group), F.lit(step)), lambda i: F.array_join(F.slice(group, i, F.lit(window)), " "))


def chunks(found: Column, window: int = WINDOW, overlap: int = OVERLAP, size: int = PARAGRAPH_SENTENCES) -> Column:
    """text and parent of each chunk, in order: windows don't cross a paragraph, which is their parent."""

    def of(group: Column) -> Column:
        parent = F.array_join(group, " ")
        return F.transform(windows(group, window, overlap), lambda t: F.struct(t.alias("text"), parent.alias("parent")))

    return F.flatten(F.transform(paragraphs(found, size), of))


def page_lines(text: Column) -> Column:
    """Lines of a page without white space at the ends, but for those of under three characters or digits alone."""
    lines = F.transform(F.split(text, "\n"), stripped)
    return F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\p{Nd}+$"))


def short_id(text: Column) -> Column:
    """Twelve hexadecimal digits that name a document by its content."""
    return F.substring(F.md5(text.cast("binary")), 1, 12)
