"""Languages: validity, base language, typesetting names, localised labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import chosen

#: Language codes and their babel names. Fixed values.
BABEL = {
    "af": "afrikaans", "id": "indonesian", "ms": "malay", "bg": "bulgarian", "ca": "catalan", "hr": "croatian", "cs": "czech",
    "da": "danish", "nl": "dutch", "en": "american", "en-US": "american", "en-UK": "british", "en-CA": "canadian",
    "en-AU": "australian", "en-NZ": "newzealand", "et": "estonian", "fi": "finnish", "fr": "french", "fr-FR": "french",
    "fr-CA": "canadien", "fr-CH": "french", "gl": "galician", "de": "ngerman", "de-DE": "ngerman", "de-AT": "naustrian",
    "de-CH": "ngerman", "el": "greek", "he": "hebrew", "hu": "hungarian", "is": "icelandic", "ga": "irish", "it": "italian",
    "la": "latin", "no": "norsk", "pl": "polish", "pt": "portuguese", "pt-BR": "brazilian", "ro": "romanian", "ru": "russian",
    "es": "spanish", "sk": "slovak", "sl": "slovene", "sv": "swedish", "sr": "serbian", "tr": "turkish", "uk": "ukrainian",
}

#: Labels by base language. Fixed values.
LABELS = {
    "de": {
        "Author": "Autor", "Title": "Titel", "Date": "Datum", "Short-title": "Kurztitel", "Subtitle": "Untertitel",
        "Abstract": "Abstract", "ISBN": "ISBN", "Printing": "Druck", "Confidential": "Vertraulich", "Draft": "Entwurf",
        "Version": "Version", "Project": "Projekt", "Client": "Klient", "Recipients": "Empfänger", "Recipient": "Empfänger",
        "Recipient address": "Empfänger Adresse", "Opening": "Eröffnung", "Subject": "Betreff", "Closing": "Schluss",
        "Signature": "Unterschrift", "Place": "Ort", "Keywords": "Schlüsselwörter", "Thanks": "Danksagungen", "Notice": "Notiz",
        "Affiliation": "Affiliation", "Terms & Conditions": "AGB", "Contents": "Inhalt", "Table of Contents": "Inhaltsverzeichnis",
        "Table of contents": "Inhaltsverzeichnis", "Start of Contents": "Inhaltsanfang", "yes": "ja", "no": "nein",
        "Cover image": "Umschlagsabbildung", "Logo": "Logo", "Bibliography": "Bibliographie",
        "Bibliography-preamble": "Bibliographiepreambel", "Language": "Sprache", "Section-numbering-depth": "Kapitelnummerierungstiefe",
        "Table of contents depth": "Inhaltsverzeichnisnummerierungstiefe",
    },
}


def code(c: Column) -> Column:
    """The code with dashes, or null where it isn't known."""
    dashed = F.replace(c, F.lit("_"), F.lit("-"))
    return F.when(dashed.isin(list(BABEL)), dashed)


def base(c: Column) -> Column:
    return F.split_part(code(c), F.lit("-"), F.lit(1))


def babel(c: Column) -> Column:
    return chosen(code(c), BABEL)


def localised(label: Column, lang: Column, labels: dict[str, dict[str, str]] = LABELS) -> Column:
    """The label in this dialect, else in its base language, else as it is (English). `labels` is a fixed table."""
    flat = {f"{language}/{name}": text for language, names in labels.items() for name, text in names.items()}
    tries = [chosen(F.concat(of(lang), F.lit("/"), label), flat) for of in (code, base)]
    return F.coalesce(*tries, label)
