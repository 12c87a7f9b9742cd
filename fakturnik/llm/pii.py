"""Personal information in running text, found by boosted trees over candidate spans and replaced by placeholders.

High-recall generators propose overlapping spans of five kinds (email, phone, id_number, address,
person_name). Each span gets features of its format (digits, check digits, grouping, word endings) and of
its context (words before and after, other spans that hold it). Trees trained on generated, labelled
sentences (``examples``) give a calibrated chance; spans over the kind's threshold, which is the one of
least errors over further generated sentences, are selected, the surest first and without overlap, and replaced by a placeholder of their kind. Names with an unusual or
wrongly decoded surname are judged by trees of their own and yield to the other spans.

Defined cases: null texts stay null and hold nothing; empty texts stay empty; a span may run over a line
end; overlapping spans of one text keep the surest; repeated rows give the same result; texts of any
length are read whole; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import boosting
from .names import FIRST, FOLD, OTHER_FIRST

KINDS = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

UP, LOW = "A-ZĄĆĘŁŃÓŚŹŻ", "a-ząćęłńóśźż"
LOCAL, HOST = r"[\w.+-]*\w", r"[\w-]+(?:\.[\w-]+)*"
AT = r"(?:\s?@\s?|\s?[\(\[{]\s?(?:at|małpa|malpa)\s?[\)\]}]\s?|\s(?:at|małpa)\s)"
DOT = r"(?:\s?\.\s?|\s?[\(\[{]\s?(?:kropka|dot|punkt)\s?[\)\]}]\s?|\s(?:kropka|dot)\s)"
SURNAME = rf"[{UP}][\w@|]+?(?:[sScCzZ][kK](?:[iIaAąĄ]|ie[jJ]|IEJ|i[mM]|IM|iego|IEGO|iemu|IEMU)|[cC][zZ][aA][kK](?:a|A|owi|OWI|iem|em|IEM|EM|u|U)?|[wW][iI][cC][zZ](?:a|A|owi|OWI|em|EM|u|U)?)"
WORD = rf"[{UP}][\w@|]{{2,}}"
#: A sign of a name, also one of the signs that a wrongly decoded letter leaves.
SIGN = r"(?:[\w@|]|(?<=[ÃÄÅÂĂĹâ€])[^\s\w,;]|(?<=[ÃÄÅÂĂĹ])[\x80-\xa0]|[\x80-\x84\x86-\x9f¡£¥¦¬¯±¶¿�](?=\w))"
ANY_NAME = rf"[{UP}ÃÄÅĂĹ]{SIGN}{{2,}}"
STREET = r"(?:[uU][lL]\.|[uU]lic[aąyę]|ULIC[AYĄĘ]|[aA][lL]\.|[aA]lej[aąię]|ALEJ[AI]|[aA]lei|[oO][sS]\.|[oO]siedl[eua]|OSIEDL[EUA]|[pP][lL]\.|[pP]lac(?:u|em)?|PLACU?)"
HOUSE = r"\d{1,4}(?:\s?[A-Za-z](?![\w.]))?(?!\w)(?!\s?[/.:-]\s?\d+[/.:-]\d)(?![.:-]\d)(?:\s?(?:/|m\.|lok\.|mieszkanie|M\.|LOK\.|MIESZKANIE)\s?\d{1,4})?"
GENERATORS = [
    ("email", re.compile(r"(?<![\w.])[\w.+-]*\w@[\w-]+(?:\.[\w-]+)+(?!\w)")),
    ("email", re.compile(rf"(?<![\w.]){LOCAL}{AT}{HOST}(?:{DOT}[a-zA-Z]{{2,}})?(?!\w)", re.I)),
    ("phone", re.compile(r"(?<![\w/])(?:(?:\+|00)48[\s-]?|\(\+48\)\s?)?(?:\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}|\(?\d{2}\)?[\s.\-]?\d{3}[\s.\-]?\d{2}[\s.\-]?\d{2})(?![\w/])")),
    ("id_number", re.compile(r"(?<![\w/])\d{6}\s?\d{5}(?![\w/])")),
    ("id_number", re.compile(r"(?<![\w/])[A-Z]{3}\s?\d{6}(?![\w/])")),
    ("id_number", re.compile(r"(?<![\w/])[A-Z]{2}\s?\d{7}(?![\w/])")),
    ("address", re.compile(rf"(?<!\w){STREET}\s*(?:[\w.@|'’-]+\s+){{1,6}}?{HOUSE}")),
    ("address", re.compile(rf"(?<![\w.-])(?:{WORD}|[{UP}]\.)(?:\s+{WORD}){{0,3}}\s+{HOUSE}")),
    ("person_name", re.compile(rf"(?<![\w.-])(?:{WORD}\s+(?:[{UP}]\.\s?)?|[{UP}]\.\s?(?:[{UP}]\.\s?)?){SURNAME}(?![\w-])")),
    ("person_name", re.compile(rf"(?<![\w.-]){SURNAME},?\s+{WORD}(?![\w-])")),
]
#: Names with any other surname, or with wrongly decoded signs; they have trees of their own.
WIDE = [
    ("person_name", re.compile(rf"(?<![\w.-])(?:(?P<first>{ANY_NAME})\s+(?:[{UP}]\.\s?)?|[{UP}]\.\s?(?:[{UP}]\.\s?)?){ANY_NAME}(?:-{ANY_NAME})?(?![\w-])")),
    ("person_name", re.compile(rf"(?<![\w.-]){ANY_NAME}(?:-{ANY_NAME})?,?\s+(?P<first>{ANY_NAME})(?![\w-])")),
]
WIDE_PATTERNS = {p for _, p in WIDE}
IN_STREET = re.compile(rf"(?<!\w){STREET}\s*(?:\w+\.\s*)*$")
ENDING = re.compile(SURNAME)
#: What is no letter of Polish; a run of it stands for one wrongly decoded letter.
FOREIGN = re.compile(rf"(?:Ăł|[^A-Za-z{UP}{LOW}\d@|.,\s-]|[\x80-\xa0])+")
FIRST_WORD = re.compile(r"\S+\s*")
#: Words before a span (stems, folded) that speak for or against a kind.
CUES = [
    ("tel kom telefon zadzwon oddzwon dzwon kontakt fax faks infolini komork", 40),
    ("pod numerem pod numer", 14),
    ("pesel", 14),
    ("dow dowod tozsamosc osobist legitym paszport", 34),
    ("zlecen zamowien zamow przesylk paczk list przewozow order tracking partii seri", 34),
    ("kod indeks artykul pozycj symbol katalog model", 26),
    ("nip regon krs vat steuer tax", 16),
    ("rachun konto konta iban account", 40),
    ("ul ulica ulicy ulice al alei aleja os osiedle osiedlu pl plac placu", 14),
    ("firma spolka sprzedawca nabywca podwykonawcy", 16),
    ("adres dostaw siedzib magazyn odbiorca mieszka", 40),
    ("wystawienia dnia data faktura szt", 16),
    ("krzeslo stol model lampa fotel regal szafa", 14),
    ("pan pani panem panu prosbe adresat odbiorca zleceniobiorca podpisano wystawil zatwierdzil reklamacj rozmow kierowca", 44),
]
FIRST_STEMS = {name[: max(4, len(name) - 3)] for name in FIRST} | {"oldz", "franciszk", "pawl", "elzbie", "doro", "zofi", "olg"}
#: Stems of further first names, which only the names with other surnames look for.
OTHER_STEMS = {name[:-1] if name.endswith("a") else {"marek": "mar", "jacek": "jac", "leszek": "lesz"}.get(name, name) for name in OTHER_FIRST}
MISREAD = str.maketrans("0135@|", "olesal")


def first_name(word: str) -> bool:
    w = word.lower().translate(FOLD).translate(MISREAD)
    return any(w.startswith(s) and len(w) <= len(s) + 7 for s in FIRST_STEMS)


@lru_cache(maxsize=100_000)
def garbled_first_name(word: str) -> bool:
    """``first_name`` where any letter may stand for a wrongly decoded one."""
    w = FOREIGN.sub(".", word).lower().translate(FOLD).translate(MISREAD)
    fits = lambda s, more: len(s) <= len(w) <= len(s) + more and all(c in (".", d) for c, d in zip(w, s, strict=False)) and sum(c == d for c, d in zip(w, s, strict=False)) >= min(3, len(s))
    return first_name(word) or any(fits(s, 4) for s in OTHER_STEMS) or "." in w and any(fits(s, 7) for s in FIRST_STEMS)


def pesel_ok(d: str) -> bool:
    if len(d) != 11 or not d.isdigit():
        return False
    month, day = int(d[2:4]) % 20, int(d[4:6])
    total = sum(int(c) * w for c, w in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), strict=False))
    return 1 <= month <= 12 and 1 <= day <= 31 and (10 - total % 10) % 10 == int(d[10])


def card_ok(s: str) -> bool:
    """The check digit of an identity card (three letters) or passport (two letters)."""
    letters = 3 if len(s) == 9 and s[:3].isalpha() and s[3:].isdigit() else 2 if len(s) == 9 and s[:2].isalpha() and s[2:].isdigit() else 0
    if not letters:
        return False
    value = [ord(c) - 55 if c.isalpha() else int(c) for c in s]
    weights = (7, 3, 1, 0, 7, 3, 1, 7, 3) if letters == 3 else (7, 3, 0, 1, 7, 3, 1, 7, 3)
    at = letters
    return sum(v * w for i, (v, w) in enumerate(zip(value, weights, strict=True)) if i != at) % 10 == value[at]


def candidates(text: str, wide: bool = True) -> list[tuple[str, int, int]]:
    out = set()
    for kind, pattern in GENERATORS + WIDE * wide:
        at = 0
        while m := pattern.search(text, at):
            first = m.groupdict().get("first")
            street = pattern in WIDE_PATTERNS and IN_STREET.search(text, max(0, m.start() - 40), m.start())  # a name inside a street's is none
            if not street and (first is None or garbled_first_name(first)):
                out.add((kind, m.start(), m.end()))
            # Go on behind the first word, so that a span that begins inside this one is proposed too.
            step = FIRST_WORD.match(text, m.start()) if kind in ("person_name", "address") else None
            at = max(m.start() + 1, step.end() if step else m.end())
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def features(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    homes = [(s, e) for k, s, e in spans if k == "address"]  # a name inside one may be a street's
    rows = []
    for kind, s, e in spans:
        span = text[s:e]
        digits = re.sub(r"\D", "", span)
        national = re.sub(r"^(?:00)?48(?=\d{9}$)", "", digits)
        joined = re.sub(r"\s", "", span)
        before = text[max(0, s - 60) : s].lower().translate(FOLD)
        after = text[e : e + 24].lower().translate(FOLD)
        wide = kind == "person_name" and not any((m := p.match(text, s)) and m.end() == e for k, p in GENERATORS if k == kind)
        words = re.findall(r"[^ \t\r\n,]+" if wide else r"[^\W\d]+", span)
        firsts = garbled_first_name if wide else first_name
        cue = []
        for stems, reach in CUES:
            near = before[-reach:]
            cue.append(float(any(re.search(rf"(?<![a-z]){stem}", near) for stem in stems.split())))
        last = re.search(r"([\w.]+)\W{0,3}$", before)
        last_word = last[1] if last else ""
        name_words = [w for w in words if len(w) > 2]
        body = re.sub(rf"^{STREET}\s*", "", span) if kind == "address" else span
        rows.append(
            [
                *(float(kind == k) for k in KINDS),
                float(len(national) == 9),
                float(len(digits)),
                float(bool(re.match(r"\+|00", span))),
                float("(" in span[:2]),
                float(len(re.findall(r"\d+", span))),
                float(pesel_ok(joined)),
                float(card_ok(joined)),
                float("@" in span),
                float(bool(re.search(r"(?i)kropka|dot|małpa|\(at\)|\[at\]", span))),
                float(bool(re.search(r"[.)\]\s][a-zA-Z]{2,10}$", span))),
                float(any(firsts(w) for w in name_words)),
                float(bool(re.search(rf"(?<!\w)[{UP}]\.", span))),
                float(len(name_words)),
                float(bool(re.match(rf"[{UP}]", body))),
                float(bool(name_words) and all(w.isupper() for w in name_words)),
                float(bool(re.search(r"\d\s?$|\d[.\-\s]$", text[max(0, s - 2) : s]))),
                float(bool(re.match(r"[\s.\-]?\d", text[e : e + 2]))),
                float(bool(re.match(r"\s*(?:/|\d|m\.|lok)", after))),
                float(bool(re.match(r"\W{0,3}(?:sp\b|s\.? ?a\b|s\.? ?c\b|z o)", after))),
                float(any(a <= s and e <= b and (a, b) != (s, e) for a, b in homes)),
                float(last_word in ("ul.", "ul", "ulica", "ulicy", "ulice", "al.", "os.", "pl.", "alei", "placu", "osiedle", "dr.", "prof.", "gen.", "ks.", "plk.")),
                float(bool(re.match(r"\W*zl|\W*pln|\W*szt", after))),
                float(bool(re.search(rf"(?i)(?:/|m\.|lok\.|mieszkanie)\s?\d+$|\d\s?[a-z]$", span))),
                float(bool(re.match(rf"{STREET}", span))),
                float(bool(re.match(r"\W{1,3}\d{2}-\d{3}", after))),
                float(bool(re.search(r"\d{2}-\d{3}\s+[a-z ]{3,30}\W{1,3}$", before))),
                float(text[max(0, s - 1) : s] in ("", "\n")),
                float(sum(firsts(w) for w in name_words)),
                float(first_name(last_word) if len(last_word) > 2 else 0),
                float(first_name(after_word[1]) if (after_word := re.match(rf"\W{{1,2}}([{UP}]\w+)", text[e : e + 24])) else 0),
                float(len(span)),
                *cue,
                float(wide and any(ENDING.fullmatch(w) for w in words)),
                float(wide and bool(FOREIGN.search(span))),
                float(wide and bool(re.match(r"S\.\s?[AC]\.", span))),
                float(wide and bool(re.search(r"(?<!\w)(?:NIP|REGON|KRS|VAT)$", span))),
                float(wide),
            ]
        )
    return np.array(rows, dtype=float).reshape(len(spans), -1)


# --- Labelled sentences for training -------------------------------------------------------------------

SLOT = re.compile(r"<(\w+)>")
#: Sentences for training; slots in capitals are personal information, small ones are not.
SENTENCES = """Prosimy o kontakt z <NAME>, tel. <PHONE>.
Proszę dzwonić pod <PHONE> do godziny 15.
Dyżur pod numerem <PHONE>, także w święta.
Pytania: <EMAIL> lub telefonicznie <PHONE>.
Telefon kontaktowy <PHONE>, faks <PHONE>
Proszę pisać na <EMAIL> przed <date>.
Faktury wysyłamy z adresu <EMAIL>; <NAME>
Do wiadomości: <NAME>; <EMAIL>.
<NAME>, PESEL <PESEL>, oświadcza, że zapoznał się z umową.
Na prośbę <NAME>, <PESEL>, wydano duplikat.
Kierowca okazał dowód osobisty <CARD> i odebrał <n> szt. towaru.
Klient okazał paszport nr <PASS> oraz pokwitował odbiór.
Tożsamość potwierdzono: dowód <CARD>, <NAME>.
Odbiorca: <NAME>, <ADDRESS>, <town>.
Adres do korespondencji: <ADDRESS>, <code> <town>.
Siedziba i magazyn: <ADDRESS>.
Miejsce dostawy to <ADDRESS>, pozostałe warunki bez zmian.
Adresat <NAME> nie mieszka już pod adresem <code> <town>, <ADDRESS>.
Fakturę wystawiła <NAME>, a zatwierdził <NAME>.
Reklamację <NAME> uznano za zasadną.
Podpisano: <NAME>
Rozmowę z <NAME> odnotowano w karcie.
Towar wydano <NAME> za pokwitowaniem.
Sprzedawca: <firm>, NIP <nip>
<ADDRESS>
<ADDRESS>, <code> <town>
<code> <town>, <ADDRESS>
Korespondencję kierować na adres <ADDRESS>.
Miejsce dostawy zmieniono na <ADDRESS>.
Kierowca okazał dow. os. <CARD> i odebrał <n> szt.
Legitymujący się dowodem <CARD> <NAME> pokwitował odbiór.
<firm>, KARTA GWARANCYJNA <n>
<firm> | Protokół odbioru   <n>
Nota korygująca do FV/<n>/2023
Faktura <n>/01/2022 z dnia <date> zastępuje poprzednią.
Netto | Brutto
Dnia <n> kwietnia 2023 rozliczono zaliczkę.
Strona <n> z <n>
Numer zlecenia <order> prosimy podać w biurze.
Potwierdzenie zamówienia <order> z dnia <date>
Dziękujemy za złożone zamówienie nr <order> i potwierdzamy termin.
Na podstawie zlecenia <order> wykonano przegląd.
Na podstawie zlecenia <order>, o czym powiadomiono przewoźnika <firm>.
Karta zlecenia <order>
Do przesyłki <parcel> dołączono protokół.
Przesyłka nr <parcel> nadana <date>.
Pozycja „filtr” o kodzie <article> została wyceniona ponownie.
Indeks <article>, ilość <n> szt.
Symbol katalogowy <article2>, cena <money> zł.
NIP: <nip>
NIP <nip>, REGON <regon>, KRS 0000<n>
Przelew na rachunek <account>, w tytule numer zamówienia.
Numer konta <account>
<n> | krzesło model Jan | <n> | <money> | <money>
<n> | stół Zofia | <n> | <money> | <money>
Stan zapasów dla stół Zofia wynosi <n> sztuk.
Prace przy ulicy Kolejowej zakończono w terminie, odbiór <date>.
Prace przy ulicy <street> zakończono <date>.
Oddział <town> przyjął <n> palet, <town> <n>.
Skorygowano paletę na placu budowy w ilości <n> sztuk.
Wstrzymano ładunek na placu budowy na łączną kwotę <money> zł.
Dostawa na plac budowy do godziny <n>.
Spółka <firm> zmieniła formę prawną <date>.
Firma <firm> prosi o duplikat faktury FV/<n>/2023.
Towar odebrano w miejscowości <town> bez zastrzeżeń.
Przyjęto w oddziale <town> bez uwag.
Termin płatności upłynął <date>, saldo <money> zł.
Magazyn czynny 7:00-15:30, kwota <money> zł @ 3 szt.
Cena za sztukę @ <money> zł, rabat <n>%.""".split("\n")
#: Sentences for training the trees of other surnames besides; none holds a person.
OTHER_SENTENCES = """Model Zofia <town> w cenie <money> zł, <n> szt.
Lampa Olga Biała, regał Robert Dąb, fotel Henryk Szary.
A. Protokół odbioru, B. Karta gwarancyjna
Rozdział C. Warunki dostawy, D. Postanowienia końcowe
Odbiór w firmie Tadeusz <firm>.
Sprzedawca: <firm>¶NIP: <nip>
Nabywca: <firm>¶REGON <regon>
Odbiorca <firm>¶<street> <n>¶<code> <town>
<firm> <town> przyjęła <n> palet z magazynu <town>.
<code> <town> Wielka, ul. <street> <n>""".replace("\n", "|").replace("¶", "\n").split("|")


def _syllables(r: random.Random, n: int) -> str:
    return "".join(r.choice("bdgklmnprstwz") + r.choice("aeiou") for _ in range(n))


def _digits(r: random.Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _misdecoded(text: str, r: random.Random) -> str:
    """The text as it stands when its bytes were read in another encoding, once or twice."""
    for _ in range(r.choice([1, 1, 2])):
        text = text.encode().decode(r.choice(["cp1252", "cp1250", "latin-1"]), "replace")
    return text


def _person(r: random.Random, wide: bool = False) -> str:
    endings = ["ski", "skiego", "skiemu", "skim", "ska", "skiej", "ską", "cki", "ckiego", "cka", "ckiej", "czak", "czaka", "czakiem", "czakowi", "kiewicz", "kiewicza", "kiewiczem"]
    surname = _syllables(r, 2).capitalize() + r.choice(["ń", "r", "łow", ""]) + r.choice(endings)
    if wide and r.random() < 0.6:
        surname = _syllables(r, r.choice([1, 1, 2])).capitalize() + r.choice(["k", "ka", "kowi", "kiem", "s", "sa", "r", "rowi", "ń", "nia", "jcik", "jcika", "łek", "dt", "sz", "szowi", "ra", "rze", "ry"])
    if wide and r.random() < 0.1:
        surname += "-" + _syllables(r, 2).capitalize() + r.choice(["ska", "ski", "cka", "k", "czak"])
    first = r.choice(["Agnieszka", "Agnieszki", "Bartosz", "Bartosza", "Cezarym", "Dorocie", "Dorota", "Elżbietą", "Franciszka", "Grzegorzem", "Henryk", "Iwony", "Joanną", "Katarzyna", "Łukaszowi",
        "Małgorzaty", "Natalią", "Oldze", "Olga", "Pawła", "Robertem", "Stanisławowi", "Tadeusz", "Urszuli", "Wojciechem", "Zofię", "Małgorzata", "Elżbiecie", "Pawłem"])
    form = r.choice([f"{first} {surname}"] * 4 + [f"{surname} {first}"] * 2 + [f"{first[0]}. {surname}"] * 3 + [f"{first[0]}.{surname}", f"{first} {r.choice('ABEKMW')}. {surname}", f"{first} {surname}".upper(), f"{first}\n{surname}"])
    return _misdecoded(form, r) if wide and r.random() < 0.3 else form


def _street(r: random.Random) -> str:
    who = r.choice(["Tadeusza ", "dr. Zofii ", "gen. Henryka ", "prof. J. ", "K. ", ""]) + _syllables(r, 2).capitalize() + r.choice(["ńskiego", "ckiej", "czaka", "łowskiego", "kiewicza"])
    return r.choice([who, who, "Lipowa", "Kolejowa", "Zielona", "Szkolna", "Polna", "Młyńska"])


def _home(r: random.Random) -> str:
    kind, name = r.choice([("ul. ", None), ("ul. ", None), ("ulica ", None), ("ul.", None), ("", None), ("", None), ("aleja ", "Starych Dębów"), ("os. ", "Młynarzy"), ("osiedle ", "Kowali"), ("os. ", "Nad Rzeką"), ("osiedle ", "Pod Lasem"), ("al. ", "Wolnych Ludzi"), ("pl. ", "Rynkowy"), ("plac ", "Starych Drzew"), ("al. ", "Kasztanowa")])
    flat = r.choice(["", "", "", f"/{r.randrange(1, 60)}", f" m. {r.randrange(1, 60)}", f" lok. {r.randrange(1, 60)}"])
    text = f"{kind}{name or _street(r)} {r.randrange(1, 150)}{r.choice(['', '', '', 'A', 'B'])}{flat}"
    return text.upper() if r.random() < 0.05 else text.replace(" ", "\n", 1) if r.random() < 0.05 else text


def _phone(r: random.Random) -> str:
    a, b, c = r.choice("45678") + _digits(r, 2), _digits(r, 3), _digits(r, 3)
    mobile = r.choice([f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}{b}{c}", f"{a}.{b}.{c}", f"+48 {a} {b} {c}", f"+48{a}{b}{c}", f"0048{a}{b}{c}", f"+48 {a}-{b}-{c}"])
    fixed = r.choice([f"({a[:2]}) {b} {c[:2]} {_digits(r, 2)}", f"{a[:2]} {b}-{c[:2]}-{_digits(r, 2)}"])
    return fixed if r.random() < 0.3 else mobile


def _mail(r: random.Random) -> str:
    local, host, top = r.choice(["biuro", "faktury." + _syllables(r, 2), "jan_" + _syllables(r, 2) + "7", _syllables(r, 3)]), r.choice(["", "hurt-"]) + _syllables(r, 3), r.choice(["example", "test", "pl", "com.pl", "invalid", "com", "eu", "org.pl", "de"])
    return r.choice([f"{local}@{host}.{top}"] * 3 + [f"{local} (at) {host} (kropka) {top}", f"{local}[małpa]{host}.{top}", f"{local} @ {host}.{top}", f"{local}(małpa){host}.{top}", f"{local} [at] {host} [dot] {top}"])


def _pesel(r: random.Random) -> str:
    d = f"{r.randrange(50, 100):02d}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}{_digits(r, 4)}"
    d += str((10 - sum(int(c) * w for c, w in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), strict=True)) % 10) % 10)
    return d if r.random() < 0.7 else f"{d[:6]} {d[6:]}"


def _card(r: random.Random, letters: int) -> str:
    while True:
        s = "".join(r.choice("ABCDEFGHIJKLMNPRSTUWXYZ") for _ in range(letters)) + _digits(r, 9 - letters)
        if card_ok(s):
            return s if r.random() < 0.7 else f"{s[:letters]} {s[letters:]}"


def _slot(name: str, r: random.Random, wide: bool = False) -> str:
    nip = _digits(r, 10)
    return {
        "NAME": lambda: _person(r, wide), "PHONE": lambda: _phone(r), "EMAIL": lambda: _mail(r), "PESEL": lambda: _pesel(r), "CARD": lambda: _card(r, 3), "PASS": lambda: _card(r, 2), "ADDRESS": lambda: _home(r),
        "date": lambda: r.choice([f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.2023", f"2024-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 29)} maja 2022"]),
        "n": lambda: str(r.randrange(1, 400)), "town": lambda: _syllables(r, 2).capitalize() + r.choice(["wo", "nica", "ów", "owice Dolne", "owice Małe", "niska Wola", "ska Góra"]), "code": lambda: f"{_digits(r, 2)}-{_digits(r, 3)}",
        "firm": lambda: _syllables(r, 3).capitalize() + r.choice([" Sp. z o.o.", " S.A.", " Tekstylia sp. k.", " Stal sp. j.", " s.c.", " Meble S.A."]),
        "nip": lambda: r.choice([nip, f"PL{nip}", f"{nip[:3]}-{nip[3:6]}-{nip[6:8]}-{nip[8:]}", f"{nip[:3]} {nip[3:6]} {nip[6:8]} {nip[8:]}"]), "regon": lambda: _digits(r, 9),
        "order": lambda: r.choice("5678") + _digits(r, 8), "parcel": lambda: _digits(r, 11) if r.random() < 0.6 else _pesel(r).replace(" ", ""),
        "article": lambda: "".join(r.choice("ABCDEFGHKLMNPRSTUWZ") for _ in range(3)) + _digits(r, 6) if r.random() < 0.5 else _card(r, 3), "article2": lambda: "".join(r.choice("ABCDEFGHKLMNPRSTUWZ") for _ in range(2)) + _digits(r, 7),
        "account": lambda: r.choice([f"{_digits(r, 2)} " + " ".join(_digits(r, 4) for _ in range(6)), "PL" + _digits(r, 26), _digits(r, 26)]),
        "money": lambda: r.choice([f"{_digits(r, 3)},{_digits(r, 2)}", f"{r.randrange(1, 99)} {_digits(r, 3)},{_digits(r, 2)}"]), "street": lambda: _street(r),
    }[name]()


SLOT_KIND = {"NAME": "person_name", "PHONE": "phone", "EMAIL": "email", "PESEL": "id_number", "CARD": "id_number", "PASS": "id_number", "ADDRESS": "address"}


def examples(count: int = 4_000, seed: int = 7, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in ``count`` generated paragraphs of three sentences."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(count):
        text, truth = "", set()
        for sentence in r.choices(SENTENCES + OTHER_SENTENCES * wide, k=3):
            at = 0
            for m in SLOT.finditer(sentence):
                text += sentence[at : m.start()]
                value = _slot(m[1], r, wide)
                if m[1] in SLOT_KIND:
                    truth.add((SLOT_KIND[m[1]], len(text), len(text) + len(value)))
                text += value
                at = m.end()
            text += sentence[at:] + r.choice([" ", " ", "\n"])
        spans = candidates(text, wide)
        if spans:
            xs.append(features(text, spans))
            # A span counts as right when it covers a true span of its kind up to a word at either side.
            ys += [float(any(k == kind and s < b and a < e and min(e, b) - max(s, a) >= 0.75 * max(e - s, b - a) for kind, a, b in truth)) for k, s, e in spans]
    return np.concatenate(xs), np.array(ys)


#: Features at the end of a row that only the trees of other surnames read.
OWN = 5


@dataclass(frozen=True)
class Trees:
    """The trees of all kinds and those of names with other surnames."""

    usual: boosting.Boosted
    wide: boosting.Boosted
    limits: tuple[tuple[float, float], ...] = ((0.5, 0.5),) * len(KINDS)  # by kind, for the usual trees and the others

    def chance(self, x: np.ndarray) -> np.ndarray:
        out, wide = np.zeros(len(x)), x[:, -1] == 1
        for own, trees, rows in ((~wide, self.usual, x[:, :-OWN]), (wide, self.wide, x)):
            if own.any():
                out[own] = trees.chance(rows[own])
        return out


    def limit(self, kind: str, wide: float) -> float:
        return self.limits[KINDS.index(kind)][int(wide)]


#: Generated paragraphs on which the thresholds are chosen, and those on which the test measures.
CHOOSING, MEASURING = 21, 99


def least_errors(chance: np.ndarray, y: np.ndarray) -> float:
    """The threshold of least errors, the nearest to one half of equals."""
    options = np.round(np.arange(0.2, 0.81, 0.02), 2)
    errors = np.array([((chance > o) != (y > 0.5)).sum() for o in options])
    return float(min(zip(errors, np.abs(options - 0.5), options, strict=True))[2])


def calibrated(trees: Trees, count: int = 1_500) -> Trees:
    """The trees with the threshold of each kind."""
    limits = [[0.5, 0.5] for _ in KINDS]
    for wide in (0, 1):
        x, y = examples(count, CHOOSING, wide=bool(wide))
        chance = trees.chance(x)
        for k in range(len(KINDS)):
            own = (x[:, k] == 1) & (x[:, -1] == wide)
            if own.any():
                limits[k][wide] = least_errors(chance[own], y[own])
    return Trees(trees.usual, trees.wide, tuple(map(tuple, limits)))


@lru_cache(maxsize=1)
def model() -> Trees:
    x, y = examples()
    wide_x, wide_y = examples(wide=True)
    own = wide_x[:, -1] == 1
    return calibrated(Trees(boosting.fit(x[:, :-OWN], y, trees=70), boosting.fit(wide_x[own], wide_y[own], trees=70)))


def select(text: str | None, trees: Trees) -> list[tuple[str, int, int]]:
    """The spans of a text that are personal information, in order."""
    return next(select_all([text], trees))


#: Spans that are rated in one pass over the trees.
RATED = 4_000


def select_all(texts: list[str | None], trees: Trees) -> Iterator[list[tuple[str, int, int]]]:
    """``select`` for many texts; the trees run over the spans of many texts at once."""
    waiting: list[list[tuple[str, int, int]]] = []
    rows: list[np.ndarray] = []
    for text in texts:
        spans = candidates(text) if text else []
        waiting.append(spans)
        if spans:
            rows.append(features(text, spans))
        if sum(map(len, rows)) >= RATED:
            yield from _selected(waiting, rows, trees)
            waiting, rows = [], []
    yield from _selected(waiting, rows, trees)


def _selected(waiting: list[list[tuple[str, int, int]]], rows: list[np.ndarray], trees: Trees) -> Iterator[list[tuple[str, int, int]]]:
    x = np.concatenate(rows) if rows else np.zeros((0, 1))
    chances = iter(zip(x[:, -1].tolist(), trees.chance(x).tolist() if rows else [], strict=True))
    for spans in waiting:
        order = sorted((wide, -c, -(s[2] - s[1]), s) for s, (wide, c) in zip(spans, chances, strict=False) if c > trees.limit(s[0], wide))
        taken: list[tuple[str, int, int]] = []
        for *_, span in order:
            if all(span[2] <= s or e <= span[1] for _, s, e in taken):
                taken.append(span)
        yield sorted(taken, key=lambda s: s[1])


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*out, text[at:]])


def records(pages: DataFrame, results: DataFrame) -> DataFrame:
    a = pages.select(F.col("doc_id").cast("bigint"), F.col("number").cast("int"), "text")
    return a.unionByName(results.select(F.col("doc_id").cast("bigint"), F.lit(0).alias("number"), F.col("raw_text").alias("text")))


def redact(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key columns, text with placeholders, and the kinds it held (array, in order of first appearance)."""
    trees = rows.sparkSession.sparkContext.broadcast(model())
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key), "text string, kinds array<string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, kinds = [], []
            given = [t if isinstance(t, str) else None for t in pdf[text]]
            for t, spans in zip(given, select_all(given, trees.value), strict=True):
                texts.append(redacted(t, spans))
                kinds.append(list(dict.fromkeys(k for k, _, _ in spans)))
            yield pdf[key].assign(text=texts, kinds=kinds)

    return spread(rows.select(*key, F.col(text))).mapInPandas(run, schema)


def found(pages: DataFrame, results: DataFrame) -> DataFrame:
    out = redact(records(pages, results), ["doc_id", "number"])
    return out.select("doc_id", "number", F.explode("kinds").alias("kind")).distinct()
