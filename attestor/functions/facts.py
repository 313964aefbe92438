"""Column functions that extract checkable facts and compare a claim's with its evidence's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the facts, and their limits and weights (in hundredths).
PERCENTAGE = r"\b\d+\.?\d*\s*%"
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
YEAR = r"\b(19|20)\d{2}\b"
ABSOLUTES = (
    "all every never always completely entirely universally fully totally permanently exclusively guaranteed "
    "proven confirmed officially mandatory worldwide global unanimous absolutely certainly definitively undeniably"
).split()
ENTITIES = "countries organizations companies hospitals universities governments researchers patients users corporations institutions nations enterprises".split()
STATISTIC = r"\b(\d+\.?\d*\s*%)\s+(?:of\s+)?([a-zA-Z\s]{3,30})"
ORGANIZATION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5})\b"
# The same with borders and blanks of all scripts: letters, numbers and _ are of words, separators and some controls are blank.
ORGANIZATION_ANY_SCRIPT = r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:[\t-\r\x1c-\x20\x85\p{Z}]+[A-Z][a-z]+){1,5})(?![\p{L}\p{N}_])"
ORGANIZATIONS_MOST, ORGANIZATION_WORDS, SHOWN_PERCENTAGES = 20, 3, 3
WEIGHTS = {"percentage_differs": 40, "percentage_new": 30, "year": 20, "scale": 35, "organization": 25, "absolute": 10}
CONTRADICTS = 30


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def percentages(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, PERCENTAGE)))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, NUMBER)))


def years(text: Column, full: bool = False) -> Column:
    """Centuries ("19", "20") of the years named, as compared by default; the years themselves if full."""
    return F.array_sort(F.array_distinct(_all(text, YEAR, 0 if full else 1)))


def absolutes(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(F.lower(text), rf"\b({'|'.join(ABSOLUTES)})\b", 1)))


def _pairs(text: Column, pattern: str) -> Column:
    return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def stat_claims(text: Column) -> Column:
    return _pairs(text, STATISTIC)


def scale_claims(text: Column) -> Column:
    """Counts and the entities counted, repeats included."""
    return _pairs(F.lower(text), rf"\b(\d+)\s+({'|'.join(ENTITIES)})\b")


def organizations(text: Column, any_script: bool = False, most: int | None = ORGANIZATIONS_MOST) -> Column:
    """Runs of capitalised ASCII words, the first `most` (all if that is None); words end and are parted as `ORGANIZATION` has it, or as all scripts do."""
    found = _all(text, ORGANIZATION_ANY_SCRIPT if any_script else ORGANIZATION, 1)
    return found if most is None else F.slice(found, 1, most)


def is_checked(organization: Column) -> Column:
    """Whether a name has enough words to be looked for in the source."""
    return F.size(F.split(organization, r"\s+")) >= ORGANIZATION_WORDS


def facts(text: Column, full_years: bool = False, names: tuple[str, ...] = (), organization_limit: int | None = ORGANIZATIONS_MOST) -> Column:
    """Facts of a text as one struct, so that each pattern runs once a row: those named, or all."""
    made = {
        "percentages": lambda: percentages(text),
        "numbers": lambda: numbers(text),
        "years": lambda: years(text, full_years),
        "absolutes": lambda: absolutes(text),
        "stat_claims": lambda: stat_claims(text),
        "scale_claims": lambda: scale_claims(text),
        "organizations": lambda: organizations(text, most=organization_limit),
    }
    return F.struct(*[f().alias(name) for name, f in made.items() if name in names or not names])


#: What signals() compares.
OF_CLAIM, OF_SOURCE = ("percentages", "years", "absolutes", "scale_claims", "organizations"), ("percentages", "years", "scale_claims")


def _quoted(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _count(digits: Column) -> Column:
    """A count as a whole number, without leading zeros; text, so that no length overflows."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def signals(claim: Column, source: Column, source_text: Column) -> list[tuple[str, Column]]:
    """(weight's name, messages) of each check, in the order of reporting; claim and source are facts(). Messages are fixed values."""
    known = source["percentages"]
    new = F.array_except(F.transform(claim["percentages"], F.trim), known)
    some = F.size(known) > 0
    nothing = F.array().cast("array<string>")
    shown = F.array_join(F.slice(known, 1, SHOWN_PERCENTAGES), ", ")
    differs = F.transform(new, lambda p: F.concat(F.lit("Stat not in source: '"), p, F.lit("' (source has: "), shown, F.lit(")")))
    fresh = F.transform(new, lambda p: F.concat(F.lit("Fabricated stat: '"), p, F.lit("'")))
    year = F.transform(F.array_except(claim["years"], source["years"]), lambda y: F.concat(F.lit("Year not in source: '"), y, F.lit("'")))

    def counts(c: Column) -> Column:
        return F.transform(F.filter(source["scale_claims"], lambda s: s["b"] == c["b"]), lambda s: _count(s["a"]))

    off = F.filter(claim["scale_claims"], lambda c: (F.size(counts(c)) > 0) & ~F.array_contains(counts(c), _count(c["a"])))
    scale = F.transform(off, lambda c: F.concat(F.lit("Scale mismatch for '"), c["b"], F.lit("': claim="), c["a"], F.lit(", source=["), F.array_join(counts(c), ", "), F.lit("]")))
    unknown = F.filter(claim["organizations"], lambda o: is_checked(o) & ~F.contains(F.lower(source_text), F.lower(o)))
    organization = F.transform(unknown, lambda o: F.concat(F.lit("Unknown organization: '"), o, F.lit("'")))
    absolute = F.when(F.size(claim["absolutes"]) > 0, F.array(F.concat(F.lit("Absolute language detected: "), _quoted(claim["absolutes"])))).otherwise(nothing)
    return [
        ("percentage_differs", F.when(some, differs).otherwise(nothing)),
        ("percentage_new", F.when(some, nothing).otherwise(fresh)),
        ("year", year),
        ("scale", scale),
        ("organization", organization),
        ("absolute", absolute),
    ]


def compared(claim: Column, source: Column, source_text: Column) -> Column:
    """points (score in hundredths, 100 at most), messages and contradicts of a claim's facts against the evidence's."""
    found = signals(claim, source, source_text)
    points = [F.size(claim["absolutes"] if name == "absolute" else messages) * WEIGHTS[name] for name, messages in found]
    total = F.least(F.lit(100), sum(points[1:], points[0]))
    return F.struct(total.alias("points"), F.concat(*[m for _, m in found]).alias("signals"), (total >= CONTRADICTS).alias("contradicts"))
