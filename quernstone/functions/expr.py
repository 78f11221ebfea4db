"""Column expressions: buckets, rates, cleaning, tokens and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket limits and names.
SCORE_LIMITS = ((-14, "le-14"), (-7, "-13to-7"), (-1, "-6to-1"), (0, "0"), (6, "1to6"), (13, "7to13"))
SCORE_LAST = "ge14"
FIELD_LIMITS = ((25, "0-25"), (50, "26-50"), (75, "51-75"))
FIELD_LAST = "76-100"
SCORE_BUCKETS = [name for _, name in SCORE_LIMITS] + [SCORE_LAST]

TOKEN = "[а-яёa-z]+"


def bucket(value: Column, limits: tuple[tuple[float, str], ...], last: str) -> Column:
    """The name of the first limit that is not below ``value``; ``last`` beyond all, and for null."""
    out: Column | None = None
    for limit, name in limits:
        out = F.when(value <= limit, name) if out is None else out.when(value <= limit, name)
    return F.lit(last) if out is None else out.otherwise(last)


def score_bucket(value: Column) -> Column:
    return bucket(value, SCORE_LIMITS, SCORE_LAST)


def field_bucket(value: Column) -> Column:
    return bucket(value, FIELD_LIMITS, FIELD_LAST)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / whole, digits)


def beta_mean(wins: Column, total: Column, alpha: float = 2.0, beta: float = 2.0, digits: int = 4) -> Column:
    """Posterior mean of a rate under a Beta prior."""
    return F.round((wins + alpha) / (total + (alpha + beta)), digits)


def to_int(text: Column) -> Column:
    """A number in a string, cut toward zero; null if it is none."""
    return text.try_cast("double").try_cast("int")


def strict_int(text: Column) -> Column:
    """A whole number in a string; null for ``1.0``."""
    return text.try_cast("int")


def usable(text: Column, na: bool = True) -> Column:
    """Whether a field is there: not empty and, if ``na``, not the literal NA."""
    filled = F.length(F.trim(F.coalesce(text, F.lit("")))) > 0
    return filled & (F.trim(text) != "NA") if na else filled


def clean_text(text: Column, size: int | None = None) -> Column:
    """White space, also beyond ASCII, as single spaces; carriage returns go. ``size`` cuts the result."""
    out = F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), r"(?U)\s+", " "))
    return F.substring(out, 1, size) if size else out


def strip_tags(markup: Column) -> Column:
    """Markup replaced by spaces, and white space by single ones."""
    bare = F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def clean_price(text: Column) -> Column:
    """A price such as ``$1,234.00`` as a number; null if it is none."""
    return F.regexp_replace(text, r"[\$,]", "").try_cast("double")


def listing_text(name: Column, description: Column, city: Column, bedrooms: Column, bathrooms: Column, price: Column) -> Column:
    """What a listing's vector is made of; parts that are missing are left out."""
    said = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c)
    cost = F.bround(price, 0).cast("long").cast("string")
    return F.concat_ws(
        " ",
        said(name),
        said(F.substring(description, 1, 500)),
        F.when(F.length(F.coalesce(city, F.lit(""))) > 0, F.concat(F.lit("Located in "), city, F.lit("."))),
        F.when(bedrooms.isNotNull(), F.concat(bedrooms.cast("string"), F.lit(" bedrooms."))),
        F.when(bathrooms.isNotNull(), F.concat(bathrooms.cast("string"), F.lit(" bathrooms."))),
        F.when(price.isNotNull(), F.concat(F.lit("$"), cost, F.lit(" per night."))),
    )


def tokens(text: Column) -> Column:
    """Runs of Latin and Cyrillic letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def snippet(text: Column, width: int = 300, mark: str = "…") -> Column:
    """The text on one line, cut at a word's end so that it fits in ``width`` with the mark. Hyphens inside words are no ends here."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    cut = F.regexp_extract(F.substring(line, 1, width), rf"^(.{{0,{width - 1}}})(?=\s)", 1)
    return F.when(F.length(line) <= width, line).otherwise(F.concat(cut, F.lit(mark)))


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector over its length; as it is if that is 0. The length is bound once, as an element, not found anew for each component."""
    bound = F.array(F.struct(doubles(a).alias("v"), norm(a).alias("n")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] > 0, s["n"]).otherwise(1.0)))[0]


def article_form(title: Column, text: Column, size: int) -> Column:
    """What an article's vector (512 characters of text) and entities (2,000) are made from: title, a full stop, the text's beginning."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(text, F.lit("")), 1, size))


def or_zero(text: Column, kind: str = "double") -> Column:
    """An empty or missing number as 0; one that is no number is null."""
    return F.when(F.coalesce(F.trim(text.cast("string")), F.lit("")) == "", F.lit(0).cast(kind)).otherwise(text.try_cast(kind))


def listing_url(listing: Column, base: str = "https://example.com/rooms/") -> Column:
    """The address of a listing's page."""
    return F.concat(F.lit(base), listing.cast("string"))


def clamp(value: int, low: int = 1, high: int = 200) -> int:
    return min(max(value, low), high)


def search_depth(k: int) -> int:
    """Candidates that an approximate search looks at for ``k`` results."""
    return min(max(2 * k, 64), 1000)
