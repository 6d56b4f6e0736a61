"""Text rules as Column expressions, all inside the JVM: cleaning, tokens, labels, identifiers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide results, in the order in which they apply.
URLS = r"((www\.[\s]+)|(https?://[^\s]+))"
MENTIONS = r"@([^\s]+)"
REPEATS = r"([a-z])\1{1,}"
NUMBERS = r"[1-9]\s*(\w+)"
TOKEN = r"[A-Za-z0-9_£$%<>]+"
RETWEET, DIGITS, LINKS, NAMES = r"rt\s", r"[\d,]+", r"https?://\S+", r"@\S+"


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def delete_urls(c: Column) -> Column:
    return F.regexp_replace(c, URLS, "")


def delete_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTIONS, "")


def squeeze_repeats(c: Column) -> Column:
    return F.regexp_replace(c, REPEATS, "$1")


def delete_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBERS, "")


def delete_marks(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("#"), F.lit("")), F.lit("RT"), F.lit(""))


def clean(c: Column) -> Column:
    """URLs, mentions, repeated letters, numbers, marks."""
    for step in (delete_urls, delete_mentions, squeeze_repeats, delete_numbers, delete_marks):
        c = step(c)
    return c


def preprocess(c: Column) -> Column:
    return clean(collapse_space(c))


def words(c: Column) -> Column:
    """Lower-case tokens in order, repeats kept; £, $, %, <, > and _ belong to tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _four_deletions(c: Column) -> Column:
    c = F.lower(c)
    for pattern in (RETWEET, DIGITS, LINKS, NAMES):
        c = F.regexp_replace(c, pattern, "")
    return c


def word_set(c: Column) -> Column:
    """Distinct non-empty words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(_four_deletions(c), r"\W+"), lambda w: w != "")))


def clean_for_index(c: Column) -> Column:
    """Words joined by blanks; a leading or trailing break leaves its blank."""
    return F.array_join(F.split(_four_deletions(c), r"\W+"), " ")


def generated_id(c: Column) -> Column:
    """64-bit wrapping polynomial hash of the UTF-16 code units as a decimal string: h = 7, then h = 31 h + unit."""
    modulus = F.lit(str(1 << 64)).cast("decimal(38,0)")
    hexes = F.hex(F.encode(c, "UTF-16BE"))
    units = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(hexes), F.lit(1)), F.lit(4)), lambda i: F.length(hexes) >= i),
        lambda i: F.conv(F.substr(hexes, i, F.lit(4)), 16, 10).cast("decimal(38,0)"),
    )
    h = F.aggregate(units, F.lit(7).cast("decimal(38,0)"), lambda a, u: ((a * 31 + u) % modulus).cast("decimal(38,0)"))
    return F.when(h >= F.lit(str(1 << 63)).cast("decimal(38,0)"), h - modulus).otherwise(h).cast("decimal(38,0)").cast("string")


def labels_from_json(c: Column) -> Column:
    """Texts of a JSON array of label objects, blank-joined; null if there are none."""
    parsed = F.from_json(c, "array<struct<text: string>>")
    return F.nullif(F.array_join(F.transform(parsed, lambda x: x["text"]), " "), F.lit(""))


def label_texts(entities: Column) -> Column:
    return F.transform(entities, lambda x: x["text"])


def created_at(c: Column) -> Column:
    """'Fri Jun 13 02:06:38 +0000 2014' to '2014-06-13 02:06+0000' (session time zone UTC)."""
    return F.date_format(F.to_timestamp(F.substring(c, 5, 100), "MMM dd HH:mm:ss Z yyyy"), "yyyy-MM-dd HH:mm+0000")


def record(lon: Column, lat: Column, created: Column, text: Column) -> Column:
    """lon,lat,created,text with printable characters only and line breaks as blanks."""
    printable = F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r\x0b\x0c]", ""), r"\n", " ")
    return F.concat_ws(",", lon.cast("string"), lat.cast("string"), created, printable)


def remove_links_and_replies(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(http://|@)[^ \t]*[ \t]?", " "))


def tsv_field(c: Column, k: int) -> Column:
    """Field k (from 0) of a tab-separated line, runs of tabs counting as one and leading ones not at all."""
    return F.get(F.filter(F.split(c, r"\t+"), lambda x: x != ""), F.lit(k))


def rendered(*columns: Column) -> Column:
    return F.concat_ws("<--->", *columns)


def plain_words(c: Column) -> Column:
    """Lower-case words without '#', names and links, blank-joined."""
    parts = F.split(F.replace(F.lower(c), F.lit("#"), F.lit("")), r"\s+")
    return F.array_join(F.filter(parts, lambda w: (w != "") & ~w.startswith("@") & ~w.startswith("http")), " ")


def encoded_query(c: Column) -> Column:
    """Blanks as %20, then URL encoding of the whole (so their per cent sign is encoded again)."""
    return F.url_encode(F.replace(c, F.lit(" "), F.lit("%20")))


def split_labels(c: Column) -> Column:
    return F.filter(F.split(c, r"[,\s]+"), lambda x: x != "")


# The search engine's English stop words.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tight_terms(text: Column) -> Column:
    """The search engine's tight English chain of a text field, for searches in which parts of a word must not be found
    alone: words between white space, no stop words, no possessive, parts that punctuation or capitals part joined again
    (letters with letters, digits with digits), lower case, plurals to singulars. Terms stay in order; a term that equals
    another at its own position can't arise, as parts are not kept beside what they are joined to."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x0B]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(F.regexp_replace(F.regexp_replace(w, "['’]s$", ""), r"[^\p{L}\p{N}]", ""), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))))
    return F.transform(parts, singular)


def singular(w: Column) -> Column:
    """A lower-case English word without its plural's s: "-ies" becomes "-y", "-us", "-ss", "-oes" and alike stay."""
    same = (F.length(w) < 3) | ~w.endswith("s") | w.endswith("us") | w.endswith("ss")
    return F.when(same, w).when(w.rlike("[^ae]ies$"), F.concat(w.substr(F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.rlike("[iaoe]es$"), w).otherwise(w.substr(F.lit(1), F.length(w) - 1))
