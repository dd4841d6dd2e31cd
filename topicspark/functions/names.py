"""Names, titles and classes derived from text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the budget chapters, in number order.
CHAPTERS = {
    "1": "Bundespräsident", "2": "Bundestag", "3": "Bundesrat", "4": "Bundeskanzler", "5": "Auswärtiges Amt", "6": "Inneres",
    "7": "Justiz", "8": "Finanzen", "9": "Wirtschaft und Energie", "10": "Landwirtschaft", "11": "Arbeit und Soziales",
    "12": "Verkehr", "14": "Verteidigung", "15": "Gesundheit", "16": "Umwelt", "17": "Bildung, Familie",
    "19": "Bundesverfassungsgericht", "20": "Bundesrechnungshof", "23": "Entwicklung", "24": "Digitales", "25": "Wohnen, Bau",
    "30": "Forschung", "32": "Bundesschuld", "60": "Allgemeine Finanzverwaltung",
}

# Patterns of procedural segments, of the law's name, and of a further sub-item.
PROCEDURAL = (
    r"^((\d+|[a-z]\)|–|ZP\s*\d+)\s*)*"
    r"(Erste|Zweite|Dritte|Beratung|Abgabe|auf Verlangen|Aktuelle Stunde|Wahlvorschl|Vereinbarte Debatte:|"
    r"Beschlussempfehlung|Bericht des|Antrag der|zu dem Antrag|zu der|\(Schluss)"
)
LAW = r"^.*?Entwurfs eines (\w+ )?Gesetzes "
SUB_ITEM = r"^((\d+\s*)?[b-z]\)|ZP\s*\d+|\d+\s)"

# Fraction names by their lower-cased form.
FRACTIONS = {
    "cdu/csu": "CDU/CSU", "spd": "SPD", "afd": "AfD", "bündnis 90/die grünen": "BÜNDNIS 90/DIE GRÜNEN", "die linke": "Die Linke",
}

def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def short_title(title: Column, top: Column) -> Column:
    """First segment of an agenda title that isn't procedural, before the next sub-item; else the law's name in the first one.
    Without a title, the chapter named by `top`, or `top`; null if both are null."""
    number = F.ltrim(F.trim(F.substr(top, F.lit(len("Einzelplan") + 1))), F.lit("0"))
    chapter = F.when(number == "", "Haushalt").otherwise(F.concat(F.lit("Haushalt: "), F.coalesce(_lookup(number, CHAPTERS), top)))
    bare = F.when(top.startswith("Einzelplan"), chapter).otherwise(top)
    parts = F.filter(F.transform(F.split(title, r"\|"), lambda s: F.trim(s)), lambda s: ~s.startswith("(Schluss"))
    further = F.filter(F.transform(parts, lambda s, i: F.when((i > 0) & s.rlike(SUB_ITEM) & s.rlike(PROCEDURAL), i)), lambda i: i.isNotNull())
    own = F.slice(parts, F.lit(1), F.coalesce(F.get(further, F.lit(0)), F.size(parts)))
    plain = F.get(F.filter(own, lambda s: ~s.rlike(PROCEDURAL)), F.lit(0))
    law = capitalised(F.regexp_replace(F.get(parts, F.lit(0)), LAW, ""))
    return F.when(F.coalesce(title, F.lit("")) == "", bare).when(F.size(parts) == 0, top).otherwise(F.coalesce(plain, law))


def display_name(name: Column) -> Column:
    """Before the first comma, then before the first bracket."""
    return F.substring_index(F.substring_index(name, ",", 1), " (", 1)


def recoded_group(group: Column, what: str = "Bundesrat", to: str = "Sonstige") -> Column:
    return F.when(group == what, F.lit(to)).otherwise(group)


def vote_page(id_: Column) -> Column:
    return F.concat(F.lit("abstimmungen/"), F.replace(id_, F.lit("/"), F.lit("-")), F.lit(".html"))


def fraction_name(originator: Column) -> Column:
    own = F.trim(originator)
    bare = F.regexp_replace(own, r"^Fraktion(en)?\s+(der\s+)?", "")
    return F.coalesce(_lookup(F.lower(bare), FRACTIONS), own)


def requested_by(title: Column) -> Column:
    """Fractions that asked for a topical debate: null for another title, empty if none is named."""
    named = F.regexp_extract(F.get(F.filter(F.transform(F.split(title, r"\|"), lambda s: F.trim(s)), lambda s: s.rlike("(?i)auf Verlangen der .+")), F.lit(0)), "(?i)auf Verlangen der (.+)", 1)
    names = F.split(F.regexp_replace(F.trim(named), r"^Fraktion(en)?\s+(der\s+)?", ""), r",\s*|\s+und\s+")
    found = F.transform(F.filter(names, lambda n: n != ""), lambda n: fraction_name(F.trim(F.regexp_replace(n, "^der ", ""))))
    return F.when(F.coalesce(title.startswith("Aktuelle Stunde"), F.lit(False)), F.coalesce(found, F.array().cast("array<string>")))


def topic_label(terms: Column, acronyms: list[str], n: int = 3) -> Column:
    """First terms, acronyms in capitals and others capitalised, joined by a dot."""
    return F.array_join(F.transform(F.slice(terms, 1, n), lambda t: F.when(t.isin(acronyms), F.upper(t)).otherwise(capitalised(t))), " · ")


def agenda_kind(title: Column) -> Column:
    return (
        F.when(title.startswith("Befragung der Bundesregierung"), "befragung")
        .when(title.startswith("Fragestunde"), "fragestunde")
        .when(title.startswith("Aktuelle Stunde"), "aktuelle_stunde")
    )


def speaker_group(role: Column, fraction: Column) -> Column:
    office = role.like("Bundeskanzler%") | role.like("Bundesminister%") | role.like("Staatsminister%") | role.like("Parl%Staatssekret%")
    return F.when(role.like("%(%)"), "Bundesrat").when(office, "Bundesregierung").otherwise(F.coalesce(fraction, F.lit("Sonstige")))


def rede_id(part: Column) -> Column:
    """A part's id without its -N suffix."""
    return F.when(part.rlike("-[0-9]"), F.substring_index(part, "-", 1)).otherwise(part)


def present(**values: tuple[Column, Column]) -> Column:
    """Struct of values that are null unless their condition holds, for writers that leave nulls out."""
    return F.struct(*[F.when(cond, value).alias(name) for name, (value, cond) in values.items()])
