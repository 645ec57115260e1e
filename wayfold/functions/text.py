"""Column expressions over text: tokens, fingerprints, sentences, scripts, categories, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tokens() can leave out.
STOP_WORDS = "a an and are as at be by for from has in is it its of on or that the this to was were will with".split()
# Query parameters that don't identify a page.
TRACKING = "fbclid gclid mc_cid mc_eid ref source".split()
# Ranges of scripts, in the order in which they are tried.
SCRIPTS = {"ar": r"[؀-ۿ]", "ru": r"[Ѐ-ӿ]", "he": r"[֐-׿]", "zh": r"[一-鿿]"}


def tokens(text: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Distinct lower-case runs of a-z and 0-9 with at least so many characters, less stop words, in order of appearance.  Null text: null."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def fingerprint(text: Column, least: int = 6) -> Column:
    """SHA-256 of all tokens joined by blanks; null with fewer than least tokens."""
    every = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(every) >= least, F.sha2(F.array_join(every, " "), 256))


def sentences(text: Column, least: int = 12, most: int = 500) -> Column:
    """Trimmed sentences of least to most characters.

    What a line's end cuts off is no sentence; it is matched and dropped, as a
    search that tries again from each of its characters takes its square.
    """
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?\n]++(?:[.!?\n]|\z)"), F.lit(0)), lambda s: ~F.endswith(s, F.lit("\n")))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s).between(least, most))


def script_language(text: Column, share: float = 0.2) -> Column:
    """The first script that holds at least a share of the characters that aren't white space, else en."""
    total = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]"))
    out = F.lit("en")
    for name, letters in reversed(SCRIPTS.items()):
        out = F.when((total > 0) & (F.regexp_count(text, F.lit(letters)) >= share * total), name).otherwise(out)
    return F.when(F.rlike(text, F.lit("[" + "".join(x[1:-1] for x in SCRIPTS.values()) + "]")), out).otherwise("en")


def category(text: Column, terms: dict[str, list[str]], other: str) -> Column:
    """The first category of which the lower-case text contains a term, in the order given."""
    low, out = F.lower(text), F.lit(other)
    for name, words in reversed(terms.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def normalized_value(value: Column) -> Column:
    """A claim's value for comparison: lower case, other characters than a-z 0-9 . + - as single dashes; unknown if nothing stays."""
    found = F.trim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9.+-]+", "-"))
    return F.coalesce(F.nullif(F.regexp_replace(found, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def clean(text: Column) -> Column:
    """White space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without user and default port (80 of http, 443 of https), path without doubled and final slashes but for the root, query decoded, sorted and encoded again without tracking parameters, no fragment.

    A URL with a port that is no number, and a string without scheme and host,
    pass through, trimmed; null and empty give an empty string.
    """
    url = F.coalesce(F.trim(url), F.lit(""))
    parts = r"^(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme, place = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_replace(F.regexp_extract(url, parts, 2), "^.*@", ""))
    host, port = F.regexp_extract(place, r"^(.*?)(?::([^:\]]*))?$", 1), F.regexp_extract(place, r"^(.*?)(?::([^:\]]*))?$", 2)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.concat(F.regexp_extract(url, parts, 3), F.lit("/")), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    drop = "^(?:utm_.*|" + "|".join(TRACKING) + ")$"
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(url, parts, 4), "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), plain(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.rlike(F.lower(p["k"]), F.lit(drop))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.rlike(url, F.lit(parts)) & F.rlike(port, F.lit("^[0-9]*$")), whole).otherwise(url)


def url_domain(url: Column) -> Column:
    """A URL's host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
