"""Record normalisation as JVM-side columns: text, countries, composite keys, derived fields."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "||"

# Country spellings that mean the same; any other spelling stands for itself.
COUNTRY_ALIASES = {"india": "india", "ind": "india", "us": "us", "usa": "us", "united states": "us", "france": "france"}

# Tokens that a delimited text file uses for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Legal suffixes, removed one group after the other, each at the end of a name.
LEGAL_SUFFIXES = ("incorporated|inc|corporation|corp", "company|co", "limited|ltd", "llc|plc", "private|pvt", "sarl|sas", "gmbh|bv")

# Address words and their short forms, replaced in this order.
ADDRESS_WORDS = (("street", "st"), ("road", "rd"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("highway", "hwy"), ("parkway", "pkwy"), ("place", "pl"), ("court", "ct"), ("apartment", "apt"))

# Letters that Unicode does not decompose, and their usual spelling.
_SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
_SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T"}
# Greek and Cyrillic in lower case, letter by letter in the order of their alphabets.
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia".split(), strict=True)) | {"є": "ie", "і": "i", "ї": "i", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ё": "io", "ў": "u"}
#: A letter of one of the scripts below, in any case.
_ALPHABETS = "[\\u0370-\\u03ff\\u0400-\\u045f\\u1f00-\\u1fff]"
#: A letter or number that none of the rules spells.
_OTHER = r"[[^\x00-\x7f]&&[\p{L}\p{N}]]"


def _single_letters() -> tuple[str, str]:
    """Letters with marks and the letter that their decomposition starts with, letters that are
    spelled by one, and digits of any script."""
    pairs = dict(_SINGLE)
    for code in [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFKD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]) and chr(code) not in _CYRILLIC and chr(code).lower() not in _CYRILLIC:
            pairs[chr(code)] = base[0]
    for code in range(0x80, 0x10000):
        if unicodedata.category(chr(code)) == "Nd":
            pairs[chr(code)] = str(unicodedata.digit(chr(code)))
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _single_letters()
_LETTERS = _GREEK | _CYRILLIC
_ONE = {k: v for k, v in _LETTERS.items() if len(v) == 1 and v != "-"}
_SEVERAL = {k: v.replace("-", "") for k, v in _LETTERS.items() if k not in _ONE}


def _alphabetic(text: Column) -> Column:
    """Greek and Cyrillic letters as Latin ones, in lower case."""
    text = F.lower(text)
    for letter, spelled in _SEVERAL.items():
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    return F.translate(text, "".join(_ONE), "".join(_ONE.values()))


def _coded(text: Column) -> Column:
    """Every other letter or number as a word of its own: u and its UTF-8 bytes in hexadecimal."""
    each = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    code = lambda c: F.concat(F.lit(" u"), F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit(" "))
    return F.array_join(F.transform(each, lambda c: F.when(c.rlike(_OTHER), code(c)).otherwise(c)), "")


def transliterated(text: Column) -> Column:
    """Latin letters without their marks, Greek and Cyrillic ones spelled in Latin, digits of any
    script as ASCII ones, and letters of other scripts as words of their UTF-8 bytes, so that equal
    names stay equal, others stay apart, and no name with a letter in it becomes empty."""
    for letter, spelled in _SPELLED.items():
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    # a mark that makes a letter of its own is kept by composing it first
    text = F.replace(F.replace(text, F.lit("и\u0306"), F.lit("й")), F.lit("И\u0306"), F.lit("й"))
    plain = F.translate(F.regexp_replace(text, r"\p{M}+", ""), _FROM, _TO)
    plain = F.when(plain.rlike(_ALPHABETS), _alphabetic(plain)).otherwise(plain)
    return F.when(plain.rlike(_OTHER), _coded(plain)).otherwise(plain)


def normalized_text(text: Column) -> Column:
    """Null to '', transliterated, lower case, anything but a-z, 0-9 and space to space, collapsed."""
    plain = F.lower(transliterated(F.coalesce(text.cast("string"), F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normalized_country(country: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(country.cast("string"), F.lit(""))))
    out = value
    for spelling, name in COUNTRY_ALIASES.items():
        out = F.when(value == spelling, F.lit(name)).otherwise(out)
    return out


def missing_tokens_to_null(df: DataFrame, columns=None, tokens=NA_TOKENS) -> DataFrame:
    """Values that delimited files use for 'missing' become null."""
    columns = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in columns})


def normalized_records(raw: DataFrame) -> DataFrame:
    """Raw records to normalised ones with their five composite keys; an absent column counts as
    empty, and a record without an id is dropped."""
    for name in ("business_name", "business_address", "country"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(""))
    out = raw.where(F.col("entity_id").isNotNull()).withColumns(
        {"name_norm": normalized_text(F.col("business_name")), "address_norm": normalized_text(F.col("business_address")), "country_norm": normalized_country(F.col("country"))}
    )
    key = lambda *parts: F.concat_ws(SEPARATOR, *parts)
    return out.withColumns(
        {
            "name_key": F.col("name_norm"),
            "name_country_key": key("name_norm", "country_norm"),
            "address_country_key": key("address_norm", "country_norm"),
            "name_address_key": key("name_norm", "address_norm"),
            "full_key": key("name_norm", "address_norm", "country_norm"),
        }
    )


def name_core(name: Column) -> Column:
    """A normalised name without its legal suffixes."""
    for words in LEGAL_SUFFIXES:
        name = F.regexp_replace(name, f" ({words})$", "")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def address_core(address: Column) -> Column:
    """A normalised address with abbreviated street words."""
    for word, short in ADDRESS_WORDS:
        address = F.regexp_replace(address, f" {word}", f" {short}")
    return address


def postal_like(address: Column) -> Column:
    """A British-style code, else the last run of 4 to 6 digits, else ''."""
    british = F.regexp_extract(address, "([a-z]{1,2}[0-9][a-z0-9]?[0-9][a-z]{2})", 1)
    run = F.reverse(F.regexp_extract(F.reverse(address), "([0-9]{4,6})", 1))
    return F.coalesce(F.nullif(british, F.lit("")), run)


def last_postal(address: Column) -> Column:
    """The last run of 5 or 6 digits, or ''."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(address, F.lit("([0-9]{5,6})")), F.lit(-1)), F.lit(""))


def derived_fields(records: DataFrame) -> DataFrame:
    """The fields that blocking keys are made of, next to the normalised ones."""
    name, address = F.col("name_norm"), F.col("address_norm")
    digits = F.regexp_replace(address, "[^0-9]", "")
    core, canon = name_core(name), address_core(address)
    return records.withColumns(
        {
            "name": F.regexp_replace(name, "[^a-z0-9]", ""),
            "addr": F.regexp_replace(address, "[^a-z0-9]", ""),
            "number": F.regexp_extract(address, "[0-9]{1,6}", 0),
            "digits": digits,
            "nonzero": F.regexp_replace(digits, "^0+$", ""),
            "postal": F.regexp_extract(address, "[0-9]{5,6}", 0),
            "postal_like": postal_like(address),
            "last_postal": last_postal(address),
            "last_token": F.regexp_extract(name, r"(\S+)$", 1),
            "core": core,
            "core_compact": F.regexp_replace(core, "[^a-z0-9]", ""),
            "canon_compact": F.regexp_replace(canon, "[^a-z0-9]", ""),
        }
    )
