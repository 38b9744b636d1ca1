"""Language tags: locale folding, names, keys and base languages as native expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import stripped

# Locale tags that fold to a base language (looked up in lower case).
LOCALES = {
    "de_de": "de", "en_us": "en", "es_419": "es", "fr_fr": "fr", "it_it": "it", "pt_br": "pt",
    "sv-se": "sv", "zh-cn": "zh", "zh-hk": "zh", "zh-tw": "zh",
}

# Display names by language code (looked up in lower case).
NAMES = {
    "ar": "Arabic", "bg": "Bulgarian", "ca": "Catalan", "cs": "Czech", "cy": "Welsh", "da": "Danish", "de": "German",
    "el": "Greek", "en": "English", "es": "Spanish", "et": "Estonian", "fa": "Persian", "fi": "Finnish", "fr": "French",
    "hr": "Croatian", "hu": "Hungarian", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "lv": "Latvian",
    "lt": "Lithuanian", "mn": "Mongolian", "mt": "Maltese", "nl": "Dutch", "pl": "Polish", "pt": "Portuguese",
    "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian", "sq": "Albanian", "sv": "Swedish",
    "ta": "Tamil", "tr": "Turkish", "uk": "Ukrainian", "zh": "Chinese", "de_de": "German", "en_us": "English (US)",
    "es_419": "Spanish (Latin America)", "es_es": "Spanish (Spain)", "fr_fr": "French (France)",
    "it_it": "Italian (Italy)", "pt_br": "Portuguese (BR)", "pt_pt": "Portuguese (PT)", "sv-se": "Swedish (SE)",
    "zh-cn": "Chinese (CN)", "zh-hk": "Chinese (HK)", "zh-tw": "Chinese (TW)",
}


# Folder names of languages that are no code themselves.
FOLDERS = {
    "de_de": "de", "en_us": "en", "es_419": "es", "es_es": "es", "fr_fr": "fr", "it_it": "it", "pt_br": "pt", "pt_pt": "pt",
    "dutch": "nl", "english": "en", "french": "fr", "german": "de", "italian": "it", "polish": "pl", "portuguese": "pt", "spanish": "es",
}


def folder_language(name: Column) -> Column:
    """Language code of a folder's name; an unknown name in lower case."""
    return F.coalesce(lookup(FOLDERS, name), F.lower(name))


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a lower-cased key in a small fixed table, else null."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[F.lower(key)]


def folded(code: Column) -> Column:
    """The language that a locale-tagged code belongs to; unknown codes as they are."""
    return F.coalesce(lookup(LOCALES, code), code)


def rewritten(code: Column) -> dict[str, Column]:
    """A tag folded to its base language, with the original as ``region_code`` where folding changed it."""
    return {"lang": folded(code), "region_code": F.when(folded(code) != code, code)}


def language_name(code: Column, strict: bool = False) -> Column:
    """Display name; an unknown code fails if ``strict``, else comes back itself (null as '')."""
    found = lookup(NAMES, code)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown language: "), code))) if strict else F.coalesce(found, code, F.lit(""))


def language_key(task: Column, lang: Column, src: Column, tgt: Column) -> Column:
    """Group of a record: folded language for asr, folded pair for st, else null."""
    pair = F.concat(folded(src), F.lit("-"), folded(tgt))
    return F.when(task == "asr", folded(lang)).when(task == "st", pair)


def base_language(code: Column) -> Column:
    """Up to the first hyphen, or else the first underscore."""
    return F.when(F.contains(code, F.lit("-")), F.substring_index(code, "-", 1)).otherwise(F.substring_index(code, "_", 1))


def known(value: Column) -> Column:
    """Text without white space at its ends; null or blank becomes 'unknown'."""
    text = stripped(value)
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(text)


def tracker_key(task: Column, lang: Column, src: Column, tgt: Column) -> Column:
    """``task/lang``, or ``task/src-tgt`` where a source or target language is given (the other falls back to lang)."""
    given = (known(src) != "unknown") | (known(tgt) != "unknown")
    side = lambda c: F.when(known(c) != "unknown", known(c)).otherwise(known(lang))
    return F.concat(known(task), F.lit("/"), F.when(given, F.concat(side(src), F.lit("-"), side(tgt))).otherwise(known(lang)))
