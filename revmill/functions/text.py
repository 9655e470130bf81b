"""Text expressions: words, stripping, keys, n-grams."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that split words. Unicode \s lacks \x1c-\x1f, and
# \s alone is ASCII-only. The class is written so that the regex engine needs one
# bitmap and one property test per character, and never backtracks.
WORD_RUN = r"(?U)[^\x1c\x1d\x1e\x1f\s]++"
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Two or more letters, digits of any kind or underscores.
TOKEN_RUN = r"[\p{L}\p{N}_]{2,}"


def text_default(text) -> Column:
    """Missing text becomes the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text) -> Column:
    """Number of whitespace-separated words of the whole text."""
    return F.regexp_count(text_default(text), F.lit(WORD_RUN))


def words(text) -> Column:
    """The words that ``word_count`` counts, in order."""
    return F.regexp_extract_all(text_default(text), F.lit(WORD_RUN), F.lit(0))


def strip(text) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def tokens(text) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text_default(text)), F.lit(TOKEN_RUN), F.lit(0))


def with_pairs(words: Column) -> Column:
    """An array of words followed by all adjacent pairs."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(
        words,
        F.zip_with(
            F.slice(words, F.lit(1), pairs),
            F.slice(words, F.lit(2), pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )


def review_key(category, user, timestamp) -> Column:
    """``category_user_timestamp``; an absent user counts as empty."""
    return F.concat_ws(
        "_",
        F.coalesce(F.col(category), F.lit("")),
        F.coalesce(F.col(user), F.lit("")),
        F.col(timestamp).cast("string"),
    )
