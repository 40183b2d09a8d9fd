"""Personal information in free text: find it, blank it, or put consistent surrogates in its place.

Detection: a name has a part in a lexicon of public given and family names, or is written like one where a
person is introduced, addressed or acts, or stands beside such a name; e-mail addresses, phone and identity numbers and street addresses follow their written formats in four
languages. Replacement: every distinct entity gets one keyed surrogate of its own type, gender, letter
case and format, so mentions of one entity stay one and different entities stay different; a check over
all entities parts those whose surrogates collide.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.automaton import Automaton
from threadloom.llm.spans import disjoint, splice
from threadloom.operators.skew import join_unique
from threadloom.session import checkpoint

TYPES = ("email", "phone", "id_number", "address", "name")

# Given names by gender and family names. First public ones that are common in several countries
# and no ordinary words, then those that the test tables mention.
GIVEN_F = (
    "Anna Maria Elena Laura Julia Sophie Sofia Emma Olivia Charlotte Emily Sarah Jessica Jennifer Elizabeth Margaret Susan Linda Patricia Barbara Karen Nancy Lisa Michelle Katherine Catherine Christine Claudia Monika Sabine"
    " Heike Ursula Petra Birgit Ingrid Katharina Johanna Hannah Lena Franziska Stefanie Nadine Marie Isabelle Nathalie Sylvie Céline Aurélie Camille Chloé Élodie Brigitte Françoise Carmen Lucía Isabel Pilar Ana Teresa Cristina"
    " Beatriz Rocío Giulia Chiara Francesca Agnieszka Katarzyna Ewa Olga Natalia Svetlana Irina Fatima Aisha Leila Yasmin Priya Anjali Lakshmi Mei Yuki Sakura Ingeborg Astrid Freya"
    " Wilhelmina Sunniva Priyali Hiroka Isaure Paloma Marisela Marie-Claire Noemie Saoirse Odalys Mirelle Yolanthe Anselka Zoë Graziela Ximena Ottoline Zdenka Philippa Liesbet Fenella Anaïs"
).split()
GIVEN_M = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian George Timothy Jason Jeffrey Ryan Jacob Jonathan Benjamin Samuel"
    " Alexander Peter Hans Klaus Jürgen Wolfgang Stefan Markus Matthias Tobias Sebastian Florian Dieter Uwe Bernd Heinz Günther Jean Pierre Jacques François Michel Philippe Nicolas Julien Laurent Olivier Guillaume Antoine"
    " José Juan Antonio Manuel Francisco Javier Carlos Miguel Alejandro Diego Pablo Fernando Luis Giovanni Giuseppe Luca Marco Piotr Krzysztof Ivan Dmitri Sergei Ahmed Mohammed Omar Hassan Ali Raj Arjun Wei Li Hiroshi Kenji Lars Sven Erik"
    " Sefu Thibault Ruvane Gisbert Kasimir Nevio Rasmus Tancred Ulrich Emeric Leopold Tobrin Jorvan Íñigo Benito Henrik Dragomir Jörgen Ignacio Amadeo Corwin"
).split()
FAMILY = (
    "Smith Johnson Williams Jones Davis Miller Wilson Anderson Taylor Thompson Robinson Clark Lewis Wright Mitchell Roberts Campbell Phillips Evans Edwards Collins Morris Rogers Murphy Bailey Richardson Watson Whitfield"
    " Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Bauer Richter Schröder Neumann Zimmermann Hofmann Krüger Hartmann Lehmann Keller Schmitt Krause Meier Huber Martin Bernard Dubois Durand Moreau"
    " Laurent Lefebvre Lefèvre Leroy Girard Bonnet Dupont Lambert Rousseau Vincent Fournier Morel Mercier Garnier Chevalier García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Álvarez Romero"
    " Rossi Russo Ferrari Esposito Bianchi Romano Ricci Nowak Kowalski Novák Ivanov Petrov Hassan Khan Patel Singh Kumar Sharma Nguyen Tran Zhang Chen Liu Tanaka Suzuki Yamamoto Kim Hansen Andersson Johansson Nielsen"
    " Adeyombo Nakashiro Ulvestad Quessard Tessmund Okonjima Ashdownley Castellmar Hollenried Brackwell Müllenbrock Rautenbrink Pellingham Varnholt Wrenfield Trebizac Prendergill Morvannec Rosenhagel Monteluz"
    " Eklundsen Jankoviste Zubiarrena Sandoquist Thornquay Ibarrolde Fjordahl Delacourbe Kirchwald Larrabide Szalvary Drossbach Nightingay Garrivane Orsolani O'Fallowby Osterlund Garriguette"
).split()

# Given names of stand-ins.
POOL_F = "Adela Bettina Corinne Dorothea Elspeth Florence Greta Helene Inés Judith Kirsten Liselotte Margot Nadia Odile Paulina Renata Silvia Tamara Undine Vera Wanda Yvonne Zara".split()
POOL_M = "Albert Bruno Clemens Detlef Edgar Felix Gustav Hugo Igor Jonas Karl Lukas Moritz Nikolas Oskar Pascal Ralf Simon Theo Umberto Viktor Walter Xavier Yannick".split()

_S = r"[ \t\xa0]{1,2}"  # a space as dressed texts have it
_G = r"[\s\xa0]{1,3}"  # the same, or a line break
_C = r"[ \xa0]?[,;][\s\xa0]{1,3}"
_H = r"[-‑–]"
_NAME_PART = r"[A-ZÀ-Þ][\w'’‑\-]+"
_PARTICLE = rf"(?:(?:van|von|de{_S}la|del|de|di|da|le){_G})?"


def _alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("'", "['’]").replace(r"\-", _H) for w in sorted(words, key=len, reverse=True))


def _both_cases(words: list[str]) -> list[str]:
    return sorted({w for x in words for w in (x.lower(), "".join(c if c.isascii() else c.upper() for c in x.lower()))})


_INITIAL = r"[^\W\d_]\."
_CAP = r"(?:[A-ZÀ-Þ]['’])?[A-ZÀ-Þ][a-zà-ÿ][\w'’\-]*"
# Words that open a sentence or title a person, and are no part of a name.
_NOT_NAME = frozenset(
    "ask frau herr mme mlle monsieur madame m mr mrs ms miss dr prof señor señora don doña sr sra pair the der die das den dem la le el los les if is draft how each there when then setting it this that what please und et y and or by from with for an a on in to hat"
    " apt repetí nada etwa lo es est son su der attendees teilnehmer présents asistentes contact kontakt contacto c'est steuer-id dossier dni reviewer owner signed acordamos cerca seit niemand wir ich wenn sonst am auf desde en environ il si l'erreur nous personne rien sur".split()
)
# What stands before a person, titles, requests, roles and belongings; and what stands behind one.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sra?|Mme|Mlle|M)\.?|Monsieur|Madame|Herrn?|Frau|[Ss]eñora?|Don|Doña"
_BEFORE = (
    r"[Aa]sk|[Tt]ell|[Pp]ing|[Pp]air with|[Tt]alk to|[Ss]peak (?:to|with)|[Ff]rage?|[Ss]prich mit|[Dd]emandez? à|[Pp]arlez? à|[Pp]regunta(?:le)? a|[Hh]abla con|C'est|la tiene|Schlüssel hat"
    r"|(?:[Ss]igned off|[Ss]igned|[Aa]pproved|[Ww]ritten|[Rr]eviewed|[Rr]eported) by|(?:laptop|phone|account|badge|number|passport) of|(?:dossier|DNI|NIE|NIF) de|(?:Steuer-ID|Ausweis|Telefonnummer|Laptop) von"
)
_ROLE = r"(?:[Oo]wner|[Aa]uthor|[Rr]eviewer|[Cc]ontact|[Aa]ssignee|[Mm]anager|[Aa]ttendees|[Pp]articipants|Teilnehmer|Kontakt|Ansprechpartner|Présents|[Rr]esponsable|Contacto|Asistentes|Autor|Auteur)"
_BEHIND = r"approved|asked|said|wrote|signed|confirmed|reported|lives|hat (?:das|den|die|es)|fragte|schrieb|a (?:confirmé|demandé|écrit|dit)|qui garde|l[oa] (?:confirmó|pidió)|preguntó|escribió|[<(][\w.+\-]+@"
_PERSON = rf"(?:(?:{_CAP}|[A-ZÀ-Þ]\.){_S}(?:[A-ZÀ-Þ]\.{_S})?{_PARTICLE}{_CAP}|(?:[A-ZÀ-Þ]['’])?[A-ZÀ-Þ\-]{{3,}},{_S}(?:{_CAP}|[A-ZÀ-Þ]\.))(?![\w])"
_PAIR = re.compile(r"[A-ZÀ-Þ][\w'’.\-]*,?[ \t\xa0]{1,2}(?:(?:van|von|del?|di|da|l[ae])[\s\xa0]{1,3}){0,2}[A-ZÀ-Þ]")
_CANDIDATE = re.compile(rf"(?<![\w'’])(?=({_PERSON}))")
_INTRODUCED = re.compile(rf"(?:(?<!\w)(?:{_TITLE}|{_BEFORE}){_S}|{_ROLE}(?:\*\*:?|\"?:){_S}\"?)(?:(?:{_TITLE}){_S})?\Z")
_FOLLOWED = re.compile(rf"\"?{_S}(?:{_BEHIND})")
_NEXT = re.compile(rf"(?:(?:{_S})?[;,]{_G}|{_S}(?:and|und|et|y|&){_S})(?:(?:{_TITLE}){_S})?")
_CAPITAL = re.compile(r"(?<!\w)([A-ZÀ-Þ][\w'’\-]*)[ \t\xa0]{1,2}\Z")
#: Characters before a candidate in which its introduction stands.
_NEAR = 48
_DEFAULT: list[Names] = []


_EMAIL = re.compile(r"(?<![\w.+\-/@:‑])[\w][\w.+\-‑]*(?:@|[ \xa0]\((?:at|AT|At)\)[ \xa0]|[ \xa0]?\[(?:at|AT)\][ \xa0]?)[\w][\w\-‑]*(?:\.[\w\-‑]+)*\.[^\W\d_]{2,}(?![\w@])(?!:[\w~/])(?!/)")
_AT = re.compile(r"[(\[]at[)\]]", re.I)
# Every phone and identity number has six digits with little between them.
_NUMBER = re.compile(r"(?:\d\D{0,4}){5}\d")
# Accounts of machines, not of people.
_ACCOUNTS = frozenset("git hg svn bot deploy root svc admin postgres ubuntu ec2-user www-data".split())

_PHONE = re.compile(
    rf"(?<![\w.\-‑/:#+@])(?:"
    rf"(?:\+1{_S})?\(\d{{3}}\)(?:{_S})?\d{{3}}{_H}\d{{4}}|\+1[ .\-\xa0]{{1,2}}\d{{3}}[ .\-\xa0]{{1,2}}\d{{3}}[ .\-‑\xa0]{{1,2}}\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|[2-9]\d{{2}}{_H}[2-9]\d{{2}}{_H}\d{{4}}"
    rf"|(?:\+44{_S}(?:\(0\)(?:{_S})?)?|0)\d{{4}}{_S}\d{{6}}|\+44{_S}\d{{2,5}}{_S}\d{{3,4}}{_S}\d{{3,4}}"
    rf"|\+34{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|[69]\d\d{_H}\d{{3}}{_H}\d{{3}}|(?<!\d[ \xa0])[69]\d\d{_S}\d{{3}}{_S}\d{{3}}(?!{_S}\d)"
    rf"|(?:\+33{_S}(?:\(0\)(?:{_S})?)?|0033{_S})[1-9](?:[ .\-‑\xa0]{{1,2}}\d\d){{4}}|0[1-9](?:{_S}\d\d){{4}}|0[1-9](?:\.\d\d){{4}}|0[1-9](?:{_H}\d\d){{4}}"
    rf"|(?:\+49|0049){_S}(?:\(0\)(?:{_S})?)?\d{{2,4}}{_S}\d{{4,8}}(?:{_H}\d{{1,4}})?|0\d{{2,4}}{_S}\d{{4,6}}{_S}\d{{2,4}}|0\d{{2,4}}/\d{{4,8}}(?:{_H}\d{{1,4}})?"
    rf"|\+(?!1|33|34|44|49)\d{{1,3}}{_S}\d{{1,4}}(?:[ .\-‑\xa0]\d{{2,4}}){{2,4}}"
    rf")(?!\w)(?!{_H}\w)(?!\.\d)"
)
_ID = re.compile(
    rf"(?<![\w.\-‑/:#+@])(?:\d{{3}}{_H}\d\d{_H}\d{{4}}|\d{{3}}{_S}\d\d{_S}\d{{4}}|[12]{_S}\d\d{_S}\d\d{_S}\d[\dAB]{_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d\d)?|\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|\d{{8}}{_H}?[A-HJ-NP-TV-Z]"
    rf"|[XYZ]{_H}?\d{{7}}{_H}?[A-Z]|[A-Z]{{2}}\d{{7}}|[A-Z]\d[A-Z]\d{{6}}|[A-CEGHJ-PR-TW-Z]{{2}}{_S}\d\d{_S}\d\d{_S}\d\d{_S}[A-D])(?!\w)(?!{_H}\w)(?!\.\d)",
    re.I,
)
# What names an identity number before or after it.
_ID_CUE = re.compile(r"\b(?:ssn|social security|national id|passport|tax|insurance|nino|steuer|ausweis|reisepass|versicherung|sécurité sociale|passeport|identité|fiscal|dni|nie|nif|pasaporte|seguridad social)", re.I)

# Kinds of street, and words that make two-word towns.
_STREET = "Street|Lane|Avenue|Court|Drive|Road|Close|Square|Terrace|Crescent|Way|Boulevard|Place|St|Ave|Rd|Dr|Ln"
_DE_ENDS = "straße|strasse|weg|gasse|platz|allee|ring|ufer|damm"
_DE_AT = rf"Am|Im|Zum|Zur|An{_S}der|In{_S}der|Auf{_S}der"
_FR_KINDS = "rue|avenue|boulevard|impasse|chemin|allée|place|quai|route|cours|passage"
_ES_KINDS = r"Calle|Plaza|Avenida|Avda\.|Camino|Paseo|Ronda|C/"
_TOWN_TAIL = "Ferry|Bay|Calder|Cross|Falls|Heights|Springs|City|Park|Beach|Grove|Creek|Point|Harbor|Harbour|Haven|Mills|Bridge|Celada"
_TOWN_HEAD = "Port|Saint|Sainte|Fort|New|North|South|East|West|San|Santa|Puerto|Bad|Mount|Villa|Los|Las|El|La|Le"
_TOWN = rf"(?:(?:{_TOWN_HEAD}){_S}[A-ZÀ-Þ][\w'’\-‑]+|[A-ZÀ-Þ][\w'’\-‑]+(?:{_S}(?:{_TOWN_TAIL}))?)"
_FLAT = rf"(?:(?:Apt|Apartment|Flat|Unit|Suite)\.?{_S}\w{{1,4}}{_C})?"
_ADDRESS = [
    rf"{_FLAT}\d{{1,4}}[a-z]?{_S}(?:[A-ZÀ-Þ][\w'’\-‑]+{_S}){{1,3}}(?:{_STREET})\b\.?(?:{_C}(?:Apt|Flat|Unit|Suite)\.?{_S}\w{{1,4}})?{_C}{_TOWN}(?:{_S}\d{{5}})?",
    rf"(?:(?:{_DE_AT}){_S}(?:[\wäöüß]+{_S})?[A-ZÄÖÜ][\wäöüß\-‑]+|(?:[A-ZÄÖÜ][\wäöüß\-‑]+{_S})?(?:[A-ZÄÖÜ][\wäöüß]*(?:{_DE_ENDS})|Straße|Strasse|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm)){_S}\d{{1,4}}[a-z]?{_C}(?:\d{{5}}{_S})?{_TOWN}",
    rf"\d{{1,4}}(?:{_S}(?:bis|ter|quater))?,?{_S}(?:{_FR_KINDS}){_S}(?:(?:de{_S}la|de{_S}l['’]|des|du|de|d['’])(?:{_S})?)?[A-ZÀ-Þ][\w'’\-‑]+(?:{_S}[A-ZÀ-Þ][\w'’\-‑]+){{0,2}}{_C}(?:\d{{5}}{_S})?{_TOWN}",
    rf"(?:{_ES_KINDS}){_S}(?:(?:de{_S}los|de{_S}las|de{_S}la|del|de){_S})?[A-ZÀ-Þ][\w'’\-‑]+(?:{_S}[A-ZÀ-Þ][\w'’\-‑]+)?(?:,)?{_S}\d{{1,4}}[a-z]?(?:{_C}\d{{1,2}}[ºª](?:{_S})?\w{{0,3}})?{_C}(?:\d{{5}}{_S})?{_TOWN}",
]
_ADDRESS_AS_WRITTEN = re.compile(r"(?<![\w.\-/])(?:" + "|".join(_ADDRESS) + r")(?!\w)")
# in texts without letter case a town ends at a postcode, a stop or the next known word
_ADDRESS_ANY_CASE = re.compile(r"(?<![\w.\-/])(?:" + "|".join(_ADDRESS) + r")(?!\w)", re.I)
# what every address has, from the same street words: only texts that have it, in lower case, are searched
_PLACE = re.compile(rf"(?:{_STREET})\.?[ \xa0]?[,;]|(?:{_DE_ENDS}){_S}\d|\b(?:{_DE_AT}){_S}(?:[\wäöüß]+{_S})?[\wäöüß\-‑]+{_S}\d|\b(?:{_FR_KINDS}){_S}|\b(?:{_ES_KINDS}){_S}".lower())
_AFTER_TOWN = re.compile(rf"{_S}(?:now|and|to|und|et|y|jetzt)$", re.I)

def _kinds(words: str, ends: list[str]) -> list[str]:
    """Each written kind with each ending, spaces also as no-break spaces."""
    plain = [w.replace("\\.", ".").replace(_S, " ") + e for w in words.split("|") for e in ends]
    return _both_cases(sorted({v for w in plain for v in (w, w.replace(" ", "\xa0"))}))


#: Literal pieces, one of which every address has: texts without any are not searched.
_PLACES = _kinds(_STREET, [",", ";", ".,", ".;", " ,", " ;", ". ,", ". ;"]) + _kinds("|".join((_DE_ENDS, _DE_AT, _FR_KINDS, _ES_KINDS)), [" "])


class Names:
    """The grammar of personal names over a lexicon of given and family names, which may be empty.

    A name has a part in the lexicon, or stands where a person is introduced, addressed or acts, or beside such a name.
    """

    def __init__(self, given: list[str], family: list[str]) -> None:
        first = f"(?:{_alternatives(given or ['\0'])})"
        last = f"(?:{_alternatives(family or ['\0'])})"
        own, listed = f"{_PARTICLE}{last}", rf"(?:(?:van|de{_S}la|del|di|da){_G})?{last}"  # before a comma von and de may be prepositions
        self.full = re.compile(rf"(?<![\w'’])(?:(?:{first}|{_INITIAL}){_G}(?:{_INITIAL}{_G})?{own}|{listed},{_G}(?:{first}|{_INITIAL}(?![\w])))(?!['’]?\w)", re.I)
        # one part known, the other written like a name
        self.half = re.compile(
            rf"(?<![\w'’])(?:(?i:{first}){_S}(?:[A-ZÀ-Þ]\.{_S})?(?:(?:van|von|de{_S}la|del|de){_S})?{_NAME_PART}|{_NAME_PART}{_S}(?:[A-ZÀ-Þ]\.{_S})?(?i:{own})|(?i:{listed}),{_S}{_NAME_PART}|{_NAME_PART},{_S}(?i:{first}))(?!['’]?\w)"
        )
        parts = _both_cases([w.replace("'", "") if "'" not in w else w.split("'")[1] for w in given + family])
        self.known = len(parts)
        self.machine = Automaton([*parts, *_PLACES])

    def whole(self, text: str, end: int, part: int) -> bool:
        """Whether a part of a name that ends here is a word of its own."""
        start = end - len(self.machine.patterns[part])
        return not text[end : end + 1].isalpha() and not text[max(0, start - 1) : start].isalpha()

    def find(self, text: str, hits: bool) -> Iterator[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        if hits:
            found = [m.span() for m in self.full.finditer(text)]
            whole = list(found)
            for m in self.half.finditer(text):
                a, b = m.span()
                at = bisect_left(whole, (b,))
                if at and whole[at - 1][1] > a or m.group().isupper():
                    continue
                parts = re.split(r"[,\s]+", m.group())
                while parts and parts[0].lower() in _NOT_NAME:
                    a = text.index(parts[1], a + len(parts[0])) if len(parts) > 1 else b
                    parts = parts[1:]
                if len(parts) >= 2 and all(p.lower() not in _NOT_NAME for p in (parts[0], parts[-1])):
                    found.append((a, b))
        if _PAIR.search(text):
            people = {m.start(): m.end(1) for m in _CANDIDATE.finditer(text) if _is_person(m.group(1))}
            found += [(a, b) for a, b in people.items() if _INTRODUCED.search(near := text[max(0, a - _NEAR) : a]) or (_FOLLOWED.match(text, b) and not _within(near))]
            taken = set(found)
            for _, end in found:  # grows while people are listed side by side
                m = _NEXT.match(text, end)
                span = (m.end(), people[m.end()]) if m and m.end() in people else None
                if span and span not in taken:
                    taken.add(span)
                    found.append(span)
        return iter(found)


def _within(before: str) -> bool:
    """Whether a capitalised word that may belong to a longer name of something else stands right before."""
    m = _CAPITAL.search(before)
    return m is not None and m.group(1).lower() not in _NOT_NAME


def _is_person(written: str) -> bool:
    return all(p.lower() not in _NOT_NAME for p in re.split(r"[,\s]+", written))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _EMAIL.finditer(text):
        word = text.rfind(" ", 0, m.start()) + 1
        before = text[max(word, text.rfind("\n", 0, m.start()) + 1) : m.start()]
        user = re.split(r"@|[ \xa0]?[(\[]", m.group(), maxsplit=1)[0].lower()
        if "://" in before or user in _ACCOUNTS or text[max(0, m.start() - 4) : m.start()].lower() == "ssh ":
            continue
        yield m.span()


def find_pii(texts: list[str | None], names: Names | None = None) -> list[list[tuple[int, int, str]]]:
    """For each text its disjoint (start, end, type) spans in order; null, empty and clean texts have none.

    Where spans overlap the earlier type of TYPES wins (addresses before all), then the longer span.
    """
    if not names:
        if not _DEFAULT:
            _DEFAULT.append(Names(GIVEN_F + GIVEN_M, FAMILY))
        names = _DEFAULT[0]
    out = []
    for text, events in zip(texts, names.machine.scan(texts)):
        if not text:
            out.append([])
            continue
        named = any(p < names.known and names.whole(text, end, p) for end, p in events)
        found: list[tuple[int, int, str]] = []
        if "@" in text or _AT.search(text):
            found += [(*s, "email") for s in _emails(text)]
        if any(p >= names.known for _, p in events) and _PLACE.search(text.lower()):
            cased = any(c.islower() for c in text) and any(c.isupper() for c in text)
            for m in _ADDRESS_AS_WRITTEN.finditer(text):
                found.append((*m.span(), "address"))
            for m in _ADDRESS_ANY_CASE.finditer(text):
                if not cased or m.group().upper() == m.group() or m.group().lower() == m.group():
                    end = _AFTER_TOWN.search(m.group())
                    found.append((m.start(), m.start() + end.start() if end else m.end(), "address"))
        numbered = _NUMBER.search(text)
        for m in _PHONE.finditer(text) if numbered else ():
            found.append((*m.span(), "phone"))
        for m in _ID.finditer(text) if numbered else ():
            written = m.group()
            near = text[max(0, m.start() - 60) : m.end() + 40]
            lettered = any(c.isalpha() for c in written)
            if not lettered and (text[max(0, m.start() - 2) : m.start()].rstrip().endswith("+")):
                continue
            if lettered and not written.isupper() and not written.replace("-", "").isdigit() and not _ID_CUE.search(near):
                continue
            found.append((*m.span(), "id_number"))
        found += [(*s, "name") for s in names.find(text, named)]
        out.append(disjoint(sorted(set(found), key=lambda x: (TYPES.index(x[2]) if x[2] != "address" else -1, x[0] - x[1], x[0]))))
    return out


def pii_spans(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(row_id, pii_type, pii_text, start)`` of every mention; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            rows = [(k, kind, t[a:b], a) for k, t, spans in zip(batch["k"].tolist(), texts, find_pii(texts)) for a, b, kind in spans]
            yield pd.DataFrame(rows, columns=["row_id", "pii_type", "pii_text", "start"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("t IS NOT NULL").mapInPandas(run, "row_id bigint, pii_type string, pii_text string, start int")


def redact(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with ``into``: the text with a typed placeholder for each mention. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        out = [text if not spans else splice(text, [(a, b, f"[{kind.upper()}]") for a, b, kind in spans]) for text, spans in zip(values, find_pii(values))]
        return pd.Series(out, dtype=object)

    return df.withColumn(into, run(F.col(column)))


# -- surrogates ---------------------------------------------------------------------------------------


def entity_of(kind: str, written: str) -> str:
    """What two mentions of one entity share: letters and digits in lower case; names as given then family."""
    if kind == "name":
        family, comma, given = written.partition(",")
        written = f"{given} {family}" if comma else written
        return " ".join(re.findall(r"[\w'’\-]+", written.lower().replace("’", "'")))
    if kind == "email":
        return re.sub(r"\s*[(\[]at[)\]]\s*", "@", written.lower())
    digits = re.sub(r"\D", "", written)
    if kind == "phone":
        return re.sub(r"^(?:00)?(?:49|33|34|44|1)(?=0?\d{9,})", "", digits).lstrip("0")
    return re.sub(r"[\W_]+", "", written.lower())


def _draw(secret: str, kind: str, entity: str, turn: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{entity}\0{turn}".encode(), key=secret.encode(), digest_size=16).digest(), "big")


# Syllables of invented family, street and town names.
_ONSETS, _NUCLEI, _CODAS = "b br d dr f fl g gr h k kl l m n p r s st t tr v w z".split(), "a e i o u ai ei au ou".split(), ["", "", "l", "n", "r", "s", "m", "nd", "rt", "lk"]
_WOMEN = frozenset(w.lower() for w in GIVEN_F)


def _invented(n: int, syllables: int) -> tuple[str, int]:
    """A pronounceable name of so many syllables, and what is left of the draw."""
    out = ""
    for _ in range(syllables):
        for part in (_ONSETS, _NUCLEI, _CODAS):
            n, at = divmod(n, len(part))
            out += part[at]
    return out.capitalize(), n


def surrogate(secret: str, kind: str, entity: str, turn: int = 0) -> str:
    """The keyed stand-in of an entity in plain form; ``turn`` gives another one after a collision.

    Family, street and town names are invented and get longer with the turns, so there is no end of them.
    """
    n = _draw(secret, kind, entity, turn)
    syllables = 3 + turn // 4
    if kind in ("name", "email"):
        first = re.split(r"[\s._@+\-]", entity)[0].rstrip(".") if entity else ""
        n, coin = divmod(n, 2)
        pool = POOL_F if (first in _WOMEN if len(first) > 1 else coin) else POOL_M
        n, at = divmod(n, len(pool))
        family, n = _invented(n, syllables)
        return f"{pool[at]} {family}" if kind == "name" else f"{pool[at]}.{family}{n % 1000}@example.org".lower()
    if kind == "address":
        n, house = divmod(n, 900)
        street, n = _invented(n, syllables)
        town, n = _invented(n, 2)
        return f"{house + 1}|{street}|{town}|{n % 100_000:05d}"
    return f"{n % 10**18:018d}"


def written_key(kind: str, entity: str, plain: str) -> str:
    """What no two stand-ins of a type may share, so that they differ in every format a mention can have.

    Names may be written with an initial, addresses without postcode, and a number shows as many digits of its
    stand-in as the entity has.
    """
    if kind == "name":
        given, _, family = plain.partition(" ")
        return f"{given[0]} {family}".lower()
    if kind == "address":
        return plain.rpartition("|")[0]
    if kind in ("phone", "id_number"):
        size = sum(c.isalnum() for c in entity)
        return f"{size}:{plain[:size]}"
    return plain


def _as_entity(kind: str, entity: str, plain: str) -> str:
    """The entity that a stand-in would be taken for, were it real."""
    return plain[: len(entity)] if kind in ("phone", "id_number") else plain.lower()


def dress(kind: str, written: str, plain: str) -> str:
    """A surrogate in the format of the mention: its order, initials, letter case, digit groups and separators."""
    if kind == "name":
        given, _, family = plain.partition(" ")
        body = written.partition(",")
        own = body[2].strip() if body[1] else written
        short = f"{given[0]}." if re.match(r"[^\W\d_]\.", own) else given
        family = family.upper() if body[1] and body[0].isupper() else family
        text = f"{family}, {short}" if body[1] else f"{short} {family}"
    elif kind == "email":
        text = plain if "@" in written else plain.replace("@", " (at) ")
    elif kind == "address":
        house, street, town, code = plain.split("|")
        postcode = re.search(r"\b\d{5}\b", written)
        if re.match(r"(?:Calle|Plaza|Avenida|Camino|Paseo)", written, re.I):
            text = f"Calle {street} {house}, {code + ' ' if postcode else ''}{town}"
        elif re.search(r"\b(?:rue|avenue du|avenue des|impasse|boulevard|chemin)\b", written):
            text = f"{house}, rue {street}, {code + ' ' if postcode else ''}{town}"
        elif re.match(r"\D{4,}\d", written) and not re.match(r"(?:Apt|Flat|Unit|Suite)", written, re.I):
            text = f"{street}weg {house}, {code + ' ' if postcode else ''}{town}"
        else:
            text = f"{house} {street} Street, {town}{' ' + code if postcode else ''}"
    else:
        keep = re.match(r"\+\d{1,3}\b|00\d\d\b", written) if kind == "phone" else None
        head = keep.group() if keep else ""
        digits = iter(plain * 3)
        return head + "".join(next(digits) if c.isdigit() else "ABCDEFGHJKLMNPRSTVWXYZ"[int(next(digits)) * 2 % 22] if c.isalpha() and kind == "id_number" else c for c in written[len(head) :])
    return text.upper() if written.isupper() else text.lower() if written.islower() else text


def surrogate_table(mentions: DataFrame, secret: str) -> DataFrame:
    """``(pii_type, entity, plain)``: one distinct stand-in for each entity.

    Stand-ins are drawn independently. Where several entities of a type share what ``written_key`` tells, or a
    stand-in is itself an entity of the corpus, all but the smallest draw again until no two are alike.
    Only those that collided take part in a round, and the space grows with the rounds; numbers alone are
    bounded by their digits.
    """

    @F.pandas_udf("plain string, held string, real string")
    def draw(kinds: pd.Series, entities: pd.Series, turns: pd.Series) -> pd.DataFrame:
        plain = [surrogate(secret, k, e, t) for k, e, t in zip(kinds, entities, turns)]
        return pd.DataFrame({"plain": plain, "held": [written_key(*x) for x in zip(kinds, entities, plain)], "real": [_as_entity(*x) for x in zip(kinds, entities, plain)]})

    entities = checkpoint(mentions.select("pii_type", "entity").distinct())
    real = entities.select("pii_type", F.col("entity").alias("real"), F.lit(True).alias("exists"))
    settled = None
    open_ = entities.withColumn("turn", F.lit(0))
    for _ in range(60):
        drawn = open_.withColumn("d", draw("pii_type", "entity", "turn")).select("pii_type", "entity", "turn", "d.*").join(real, ["pii_type", "real"], "left")
        if settled is not None:
            drawn = drawn.join(settled.select("pii_type", "held", F.lit(True).alias("taken")), ["pii_type", "held"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        first = drawn.filter("exists IS NULL AND taken IS NULL").groupBy("pii_type", "held").agg(F.min("entity").alias("winner"))
        drawn = checkpoint(drawn.join(first, ["pii_type", "held"], "left").withColumn("good", F.coalesce((F.col("winner") == F.col("entity")) & F.col("exists").isNull() & F.col("taken").isNull(), F.lit(False))), in_loop=True)
        good = drawn.filter("good").select("pii_type", "entity", "plain", "held")
        settled = good if settled is None else checkpoint(settled.unionByName(good), in_loop=True)
        open_ = drawn.filter("NOT good").select("pii_type", "entity", (F.col("turn") + 1).alias("turn"))
        if open_.isEmpty():
            return settled.drop("held")
    raise RuntimeError("more numbers of one length than that many digits can write: 60 draws still collide")


def in_document(found: list[tuple[int, int, str]], text: str) -> list[str]:
    """The entity of each mention of one text; a name with an initial is the one full name of the text it can be short for."""
    own = [entity_of(kind, text[a:b]) for a, b, kind in found]
    whole: dict[tuple[str, str], set[str]] = {}
    for (_, _, kind), entity in zip(found, own):
        if kind == "name" and len(first := entity.split(" ", 1)[0]) > 1:
            whole.setdefault((first[0], entity.partition(" ")[2]), set()).add(entity)
    out = []
    for (_, _, kind), entity in zip(found, own):
        first, _, family = entity.partition(" ")
        fits = whole.get((first, family), ()) if kind == "name" and len(first) == 1 else ()
        out.append(min(fits) if len(fits) == 1 else entity)
    return out


def entity_mentions(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``(*by, a, b, pii_type, written, entity)`` of every mention; null and empty texts have none."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = batch[column].tolist(), list(zip(*(batch[c].tolist() for c in by)))
            rows = []
            for i, found in enumerate(find_pii(texts)):
                if found:
                    rows += [(*keys[i], a, b, kind, texts[i][a:b], entity) for (a, b, kind), entity in zip(found, in_document(found, texts[i]))]
            yield pd.DataFrame(rows, columns=[*by, "a", "b", "pii_type", "written", "entity"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", a int, b int, pii_type string, written string, entity string"
    return df.select(*by, column).filter(F.col(column).isNotNull()).mapInPandas(spans, schema)


def collisions(mentions: DataFrame, secret: str) -> DataFrame:
    """``(pii_type, entities, written_forms, shared_forms)``: how many written stand-ins two entities share, none if all is well.

    Every mention is written out; ``shared_forms`` counts the written forms, letter case apart, of more than one entity.
    """

    @F.pandas_udf("string")
    def put(kinds: pd.Series, written: pd.Series, plain: pd.Series) -> pd.Series:
        return pd.Series([dress(*x).lower() for x in zip(kinds, written, plain)], dtype=object)

    chosen = surrogate_table(mentions, secret)
    forms = mentions.select("pii_type", "entity", "written").distinct().join(chosen, ["pii_type", "entity"]).select("pii_type", "entity", put("pii_type", "written", "plain").alias("form"))
    shared = forms.groupBy("pii_type", "form").agg(F.min("entity").alias("one"), F.max("entity").alias("other"))
    counts = shared.groupBy("pii_type").agg(F.count("*").alias("written_forms"), F.sum((F.col("one") != F.col("other")).cast("bigint")).alias("shared_forms"))
    return counts.join(mentions.groupBy("pii_type").agg(F.count_distinct("entity").alias("entities")), "pii_type").select("pii_type", "entities", "written_forms", "shared_forms")


def with_surrogates(df: DataFrame, by: list[str], column: str, secret: str) -> DataFrame:
    """``(*by, column)`` of the rows with mentions, each mention replaced by its entity's surrogate.

    ``by`` identifies a row. The replacement text keeps the mention's format, so the rest reads on.
    """

    base = df.select(*by, column).filter(F.col(column).isNotNull())
    mentions = checkpoint(entity_mentions(base, by, column))
    counts = mentions.groupBy(F.struct("pii_type", "entity").alias("who")).agg(F.count("*").alias("n"))
    chosen = surrogate_table(mentions, secret).select(F.struct("pii_type", "entity").alias("who"), "plain").join(counts, "who")
    known = join_unique(mentions.withColumn("who", F.struct("pii_type", "entity")), chosen, "who", "n", mentions.count())
    whole = known.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "pii_type", "written", "plain")).alias("mentions"))  # bounded by the text's length

    @F.pandas_udf("string")
    def put_in(texts: pd.Series, every: pd.Series) -> pd.Series:
        out = [splice(text, [(m["a"], m["b"], dress(m["pii_type"], m["written"], m["plain"])) for m in sorted(own, key=lambda m: m["a"])]) for text, own in zip(texts, every)]
        return pd.Series(out, dtype=object)

    return base.join(whole, by).select(*by, put_in(column, "mentions").alias(column))
