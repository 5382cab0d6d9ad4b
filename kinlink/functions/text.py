"""Text normalisation as column expressions; no row leaves the JVM unless it holds letters that are not Latin."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinlink.functions import dictionaries as D
from kinlink.profiles import Profile

#: Letters that become several, and signs with a plain form.
_WIDE = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "…": "...", "«": "<<", "»": ">>", "™": "(tm)", "©": "(c)", "®": "(r)", "№": "No"}
_SIGNS = {"’": "'", "‘": "'", "‚": ",", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", " ": " ", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i", "·": "*", "•": "*"}


def _plain_letters() -> dict[str, str]:
    """Accented Latin letters whose decomposition starts with an ASCII letter, and the signs above."""
    found = dict(_SIGNS)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base != chr(code):
            found[chr(code)] = base
    return found


_INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")


def _romanised(char: str) -> str:
    """A letter's Latin form, read off its Unicode name: consonants without their inherent a, vowels as named."""
    name = unicodedata.name(char, "")
    script, _, rest = name.partition(" ")
    if script not in _INDIC:
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        return plain if plain or unicodedata.combining(char) else ""
    kind, _, sound = rest.rpartition(" ")
    if rest.startswith(("LETTER ", "VOWEL SIGN ")):
        vowel = rest.startswith("VOWEL") or set(sound) <= set("AEIOU")
        return sound.lower() if vowel else sound.lower().removesuffix("a")
    if rest.startswith("DIGIT"):
        return str(unicodedata.digit(char))
    return {"ANUSVARA": "n", "CANDRABINDU": "n", "VISARGA": "h"}.get(sound, "")


@F.pandas_udf(StringType())
def _romanise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    seen: dict[str, str] = {}
    for batch in batches:
        yield batch.map(lambda t: t if t is None else "".join(c if c.isascii() else seen.setdefault(c, _romanised(c)) for c in t))


def plain_letters(text: Column) -> Column:
    """Accented Latin letters and signs in their plain form; marks that are written apart stay."""
    plain = _plain_letters()
    wide = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _WIDE.items(), text)
    return F.translate(wide, "".join(plain), "".join(plain.values()))


def transliterate(text: Column, other_scripts: bool = True) -> Column:
    """Latin letters without accents. Only rows that still hold other letters go through the Arrow function."""
    latin = F.regexp_replace(plain_letters(text), "[\\u0300-\\u036f]", "")
    if not other_scripts:
        return latin
    foreign = latin.rlike("[^\\x00-\\x7f]")
    return F.when(foreign, _romanise(F.when(foreign, latin))).otherwise(latin)  # other rows send a null


def foreign(text: Column) -> Column:
    """Whether letters of other scripts are left once Latin ones are plain."""
    return F.coalesce(transliterate(text, False).rlike("[^\\x00-\\x7f]"), F.lit(False))


def squeeze(text: Column) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def clean_plain(text: Column, other_scripts: bool = True) -> Column:
    return squeeze(F.regexp_replace(F.lower(transliterate(or_empty(text), other_scripts)), r"[^\w\s]", " "))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?i)" + D.URL_TAIL, ""), "(?i)" + D.URL, "")


def strip_handles(text: Column) -> Column:
    return F.regexp_replace(text, D.HANDLE, "")


def strip_domains(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + D.DOMAIN_END, " ")


def strip_possessives(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + D.POSSESSIVE, "")


def fix_digits(text: Column) -> Column:
    """0 and 1 between letters are o and l."""
    return F.regexp_replace(F.regexp_replace(text, "(?<=[a-z])0(?=[a-z])", "o"), "(?<=[a-z])1(?=[a-z])", "l")


def unwrap_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"[\(\[\{]([^\)\]\}]+)[\)\]\}]", " $1 ")


def spell_symbols(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s*&\s*", " and "), r"\s*\+\s*", " ")


def clean_hygiene(text: Column, hyphen: bool = False, other_scripts: bool = True) -> Column:
    """URLs, handles, domains, possessives, scripts, misread digits, brackets, symbols, in this order."""
    raw = strip_possessives(strip_domains(strip_handles(strip_urls(or_empty(text)))))
    low = fix_digits(F.lower(transliterate(raw, other_scripts)))
    if hyphen:
        low = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[\(\)]+", " "), "&", " and "), r"\+", " ")
        return squeeze(F.regexp_replace(low, r"[^\w\s-]", " "))
    return squeeze(F.regexp_replace(spell_symbols(unwrap_brackets(low)), r"[^a-z0-9\s]", " "))


def clean(text: Column, profile: Profile, other_scripts: bool = True) -> Column:
    if profile.clean == "plain":
        return clean_plain(text, other_scripts)
    return clean_hygiene(text, profile.clean == "hygiene_hyphen", other_scripts)


def _words(alternatives: str) -> str:
    return rf"\b({alternatives})\b"


def harmonise(text: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, _words(r[0]), r[1]), D.HARMONISED, text)


def normalize_name(name: Column, profile: Profile, other_scripts: bool = True) -> Column:
    base = clean(name, profile, other_scripts)
    if profile.names == "legal":
        for words in (D.LEGAL_WORDS, D.STOPWORDS):
            base = F.regexp_replace(base, _words("|".join(words)), "")
        return squeeze(base)
    if profile.names == "harmonised":
        return squeeze(harmonise(base))
    if profile.names == "descriptors":
        bare = squeeze(reduce(lambda c, g: F.regexp_replace(c, _words(g), " "), D.DESCRIPTORS, harmonise(base)))
        return F.when(F.length(bare) >= 1, bare).otherwise(base)
    return base


def _expanded(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, _words(r[0]), r[1]), rules, text)


def normalize_address(address: Column, country: Column, profile: Profile, other_scripts: bool = True) -> Column:
    """Abbreviations spelt out in order; French ones come after the general ones."""
    general = {"package": D.ADDRESS_PACKAGE, "notebook": D.ADDRESS_NOTEBOOK, "bulk": D.ADDRESS_BULK}[profile.addresses]
    french = {"package": D.ADDRESS_FRANCE, "notebook": None, "bulk": D.ADDRESS_BULK_FRANCE}[profile.addresses]
    base = _expanded(clean(address, profile, other_scripts), general)
    if french:
        at = F.trim(country) if profile.addresses == "package" else country
        base = F.when(at == "France", _expanded(base, french)).otherwise(base)
    return squeeze(base)


def normalize_address_test(address: Column, country: Column, profile: Profile, other_scripts: bool = True) -> Column:
    """The notebook's rules with the French ones for a country that is written exactly so."""
    base = _expanded(clean(address, profile, other_scripts), D.ADDRESS_NOTEBOOK)
    return squeeze(F.when(country == "France", _expanded(base, D.ADDRESS_FRANCE)).otherwise(base))
