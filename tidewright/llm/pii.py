"""Personal information in free text: detection, typed placeholders and keyed surrogates.

Detection runs ordered patterns over whole texts in Arrow batches: mail boxes, numbers by format and by the
words around them, street addresses of six languages, and names. Names are given away by titles and cue words; such
mentions, and listed given names before capitalised words, teach the corpus its family names and full names, by which
the other mentions are known. A pattern runs only on texts that have one of the words it needs.

Surrogates come from a keyed hash of the entity's normal form, so the same entity gets the same replacement
everywhere. Names are replaced by their parts, so that a lone family name stays the one of the full name; numbers keep
country code, trunk prefix and format, names script, case and the gender that title or a table of given names tell.
Collisions among surrogates and with entities of the corpus are resolved by hashing again.
"""

from __future__ import annotations

import bisect
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import durable, few

TYPES = ("email", "address", "id_number", "phone", "name")

# Words of six languages that stand by personal data.
PHONE_CUES = (
    "call", "call me on", "phone", "tel", "tél", "mobile", "mobile is", "telephone", "téléphone", "cell", "fax", "whatsapp", "ring", "reach me on", "text",
    "try", "ligue para", "telefone", "telemóvel", "teléfono", "móvil", "llámeme al", "llame al", "telefon", "rückruf unter", "handy", "mobil",
    "erreichen sie mich über", "erreichbar unter", "rappelez-moi au", "appelez-moi au", "mon numéro est le", "mi número es el", "meu número é o", "тел", "телефон", "звоните",
)
ID_CUES = (
    "social security number", "social security", "ssn", "national insurance", "insurance number", "id", "id number", "identity number", "passport", "passport no", "passport number",
    "tax number", "tax id", "licence", "license", "ausweis", "ausweisnummer", "steuernummer", "steuer-id", "personalausweis", "reisepass", "sozialversicherungsnummer",
    "n° d’identité", "numéro d’identité", "pièce", "pièce d’identité", "passeport", "numéro de passeport", "numéro de sécurité sociale", "documento", "dni", "nie", "nif", "cif", "número",
    "pasaporte", "contribuinte", "cpf", "passaporte", "número de identidad", "паспорт", "инн", "снилс",
)
CUE_LINKS = r"(?:,?\s*(?:which is|is|was|ist|lautet|est|es|é|no|nr|number|nummer|die lautet|que es|que é|qui est|at|on|under|unter|au|al|le|el|o))?"
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Miss", "Prof", "Sir", "Herr", "Herrn", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Sr", "Sra", "Srta", "Señor", "Señora", "Don", "Doña", "Dra", "Senhor", "Senhora")
FEMALE_TITLES = {"mrs", "ms", "miss", "frau", "mme", "mlle", "madame", "sra", "srta", "señora", "doña", "dra", "senhora"}
MALE_TITLES = {"mr", "sir", "herr", "herrn", "monsieur", "m", "sr", "señor", "don", "senhor"}
SAY_NAME = (
    "my name is", "name is", "i am called", "this is", "ich heiße", "ich heisse", "mein name ist", "je m’appelle", "je m'appelle", "mon nom est", "me llamo", "mi nombre es",
    "o meu nome é", "meu nome é", "chamo-me", "меня зовут",
)
ASK_FOR = (
    "ask for", "forward it to", "forward this to", "talk to", "speak to", "speak with", "cc", "attn", "prévenir", "prévenir m.", "avise a", "avisar a", "fale com", "bitte an",
)
#: Behind these a capitalised word may also be a team or a product, so one word of the name must be known.
WEAK_CUES = (
    "contact", "escalate to", "reach out to", "assigned to", "reported by", "written by", "signed by", "wenden sie sich an", "fragen sie", "gemeldet von", "contactez", "demandez à", "signalé par", "contacte con", "hable con", "pregunte por",
    "informado por", "procure", "relatado por", "обратитесь к",
)
SIGN_OFFS = (
    "regards,", "sincerely,", "cheers,", "thanks,", "grüße", "grüßen", "gruß", "cordialement,", "à vous,", "salutations,", "saludos,", "atentamente,", "saludo,", "cordiales,",
    "atenciosamente,", "cumprimentos,", "abraços,", "с уважением,",
)
STREET_EN = "Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Crescent|Place|Pl|Square|Sq|Terrace|Way|Boulevard|Blvd|Row|Walk|Mews|Gardens|Grove|Hill|Parade|Quay|Alley"
STREET_DE = "straße|strasse|str\\.|gasse|allee|weg|platz|ring|damm|ufer|steig|stieg|anger|chaussee|pfad|markt|graben|zeile|hof|winkel|kamp|berg"
STREET_DE_WORD = "Straße|Strasse|Str\\.|Gasse|Allee|Weg|Platz|Ring|Damm|Ufer|Mühle|Markt|Steig"
STREET_FR = "rue|avenue|av\\.?|boulevard|bd\\.?|boul\\.?|impasse|allée|place|pl\\.?|chemin|ch\\.?|route|quai|cours|square|passage|sentier|ruelle|faubourg|villa"
STREET_ES_PT = "Calle|C/|C\\.|Avenida|Avda\\.?|Av\\.?|Plaza|Pza\\.?|Paseo|P\\.º|Camino|Carretera|Ronda|Travesía|Callejón|Rua|R\\.|Largo|Praça|Pç\\.?|Travessa|Tv\\.?|Estrada|Alameda|Rúa|Calçada|Beco"
#: Names that make up surrogates; those of the third row say nothing of gender.
GIVEN = {
    ("latin", "f"): ("Amara", "Birgit", "Carla", "Delia", "Emina", "Flora", "Greta", "Helga", "Ilona", "Jana", "Karla", "Lidia", "Mira", "Nadia", "Orla", "Paula"),
    ("latin", "m"): ("Albin", "Bruno", "Cedric", "Dario", "Emil", "Fabian", "Gustav", "Henrik", "Ivo", "Jasper", "Kilian", "Lennart", "Marek", "Nils", "Oskar", "Philip"),
    ("latin", ""): ("Alexis", "Charlie", "Dominique", "Jamie", "Kim", "Robin", "Sascha", "Toni"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Мария", "Нина"),
    ("cyrillic", "m"): ("Антон", "Глеб", "Денис", "Игорь", "Лев", "Роман"),
    ("cyrillic", ""): ("Валя", "Женя", "Саша", "Слава", "Шура"),
}
# Common given names of women and of men, folded; a caller may add a table of its own.
WOMEN = frozenset(
    "alba alice ana anna anne barbara beatriz birgit brigitte camille carla carmen carol caroline catherine celine charlotte chloe clara claire claudia cristina daniela diana dolores edith elena elisabeth elizabeth ella elodie emily "
    "emma erika eva florence grace hanna helen helena ines irina isabel isabelle jana jane jennifer jessica joana julia julie karen karin katharina kathe laura lea linda lisa lucia lucy maelle manon margaret maria marie marta martina mary "
    "megan monica monika nadia natalia nina noreen olga patricia paula petra pilar rose rosa sabine sandra sarah silvia sofia sophie susan susanne svetlana sveta teresa ursula vera wendy ximena yolanda "
    "анна вера галина дарья екатерина елена ирина людмила мария надежда наталья нина ольга светлана софия татьяна юлия".split()
)
MEN = frozenset(
    "adam alain alan albert alejandro alexander alfred andre andreas andrei anselm anthony antonio arthur bastien benjamin bernd boris bruno carlos charles christian christopher daniel david diego dieter dmitri duarte edward emil enrique "
    "eric ernst fernando francisco frank franz fritz gabriel georg george gerd hans harald heinz henri henry hugh hugo ignacio igor inigo ivan jack jacques james jan javier jean joao john jonas jorge jose joseph juan jurgen karl klaus "
    "laurent louis luca luis manuel marc marco mark martin matthew max michael miguel miles mikhail nicolas nikita nikolai oliver oscar otto pablo patrick paul pavel pedro peter philippe pierre rafael raul richard robert ruben rui sergei "
    "stefan theo thomas tiago uwe victor vladimir walter werner will william wolfgang "
    "александр алексеи андреи антон борис виктор владимир глеб григории денис дмитрии иван игорь константин михаил никита николаи павел петр роман сергеи юрии".split()
)
SYLLABLES = tuple(a + b for a in "b d f g k l m n p r s t v z".split() for b in "a e i o u".split())
SYLLABLES_CYR = tuple(a + b for a in "б д к л м н п р с т".split() for b in "а о у и".split())


def _alt(words: tuple[str, ...]) -> str:
    return "|".join(sorted((regex.escape(w).replace(r"\ ", r"\s+").replace("’", "[’']") for w in words), key=len, reverse=True))


class Patterns:
    """Compiled once per Python worker."""

    def __init__(self, given: frozenset[str]):
        c = lambda p, f=0: regex.compile(p, f | regex.V1)
        at, dot = r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)", r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)"
        self.at = c(r"@|[(\[]\s?at\s?[)\]]", regex.I)
        self.email = c(rf"(?<![\p{{L}}\p{{N}}._%+-])([\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}._%+'-]*[\p{{L}}\p{{N}}_])?){at}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?(?:{dot}[\p{{L}}\p{{N}}-]+)*{dot}\p{{L}}{{2,}}", regex.I)
        ids = (
            r"\p{Lu}{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?\p{Lu}", r"\p{Lu}{2}\s?\d{7,8}", r"\p{Lu}-?\d{7}-?\p{Lu}?", r"\d{8}[- ]?\p{Lu}", r"\d{3}\.\d{3}\.\d{3}-\d{2}",
            r"\d{2}/\d{3}/\d{6}", r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}", r"\d{2} \d{3} \d{3} \d{3}",
        )
        self.id_format = c(rf"(?<![\p{{L}}\p{{N}}./-])(?:{'|'.join(ids)})(?![\p{{L}}\p{{N}}]|[-/]\d|\.\d)")
        self.id_cued = c(rf"(?<![\p{{L}}\p{{N}}])(?i:{_alt(ID_CUES)}){CUE_LINKS}[\s.:#°º]*(\p{{Lu}}{{0,3}}[ -]?\d[\d ./-]{{4,16}}\d(?:[- ]?\p{{Lu}})?)(?![\p{{L}}\p{{N}}])")
        sep = r"[\s.-]?"
        strong = (
            rf"(?:\+|00)\d{{1,3}}[\s.-]?(?:\(0\)[\s.-]?)?(?:\(?\d+\)?{sep}){{1,5}}\d{{2,}}", rf"(?:1[\s.-])?\(\d{{2,4}}\)\s?\d{{3,5}}{sep}\d{{3,4}}", r"1-\d{3}-\d{3}-\d{4}", r"\d{3}\.\d{3}\.\d{4}",
            r"\d{3}-\d{3}-\d{4}", r"0\d(?:[\s.-]\d{2}){4}", r"0\d{2,4}[\s/-]\d{3,5}[\s-]?\d{3,4}",
        )
        self.phone = c(rf"(?<![\p{{L}}\p{{N}}.,/=-])(?:{'|'.join(strong)})(?![\p{{L}}\p{{N}}]|[-/.]\d)")
        self.phone_cued = c(rf"(?<![\p{{L}}\p{{N}}])(?i:{_alt(PHONE_CUES)}){CUE_LINKS}\s*[.:]?\s*:?\s*((?:\+|\()?\d[\d\s().-]{{5,18}}\d)(?![\p{{L}}\p{{N}}])")
        word = r"\p{Lu}[\p{L}'’-]*"
        house = r"\d{1,4}(?:\s?[a-z](?!\p{L})|\s(?:bis|ter)(?!\p{L}))?"
        small = r"(?:d[eo]s?|da|das|dos|del|della|de\s+l[ao]s?|du|des|de\s+l[’']|d[’']|l[’'])"
        self.address = [
            c(rf"(?<![\p{{L}}\p{{N}}./-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s+\w{{1,4}},?\s+)?\d{{1,5}}[a-z]?,?\s+(?:{word}\s+){{1,4}}(?:{STREET_EN})(?!\p{{L}})"),
            c(rf"(?<![\p{{L}}\p{{N}}])(?:(?:Am|An der|Auf der|Im|In der|Zum|Zur|Alte[rn]?|Neue[rn]?|Große|Kleine|Obere|Untere)\s+)*\p{{Lu}}[\p{{L}}-]*(?:(?<=\p{{L}})(?i:{STREET_DE})|\s(?:{STREET_DE_WORD}))\s+{house}(?![\p{{N}}])"),
            c(rf"(?<![\p{{L}}\p{{N}}])(?:Am|An der|Auf der|Im|In der|Zum|Zur|Alte|Alter|Neue)\s+\p{{Lu}}[\p{{L}}-]+\s+{house}(?![\p{{L}}\p{{N}}.])(?=\s*(?:,|–|-|—|in\s|\d|$|\n|\s\p{{Lu}}))"),
            c(rf"(?<![\p{{L}}\p{{N}}./-]){house},?\s+(?i:{STREET_FR})\s+(?:{small}\s*)*{word}(?:[\s-](?:{small}\s*)*{word})*"),
            c(rf"(?<![\p{{L}}\p{{N}}])(?:{STREET_ES_PT})\s*(?:{small}\s+)*{word}(?:\s+(?:{small}\s+)*{word})*,?\s+(?:n[.ºo°]*\s*)?\d{{1,4}}(?![\p{{N}}])"),
            c(rf"(?<![\p{{L}}\p{{N}}])(?:ул\.|улица|пр\.|проспект|пер\.|переулок|наб\.|набережная)\s+{word}(?:\s+{word})*,?\s+(?:д\.\s*)?\d{{1,4}}"),
        ]
        self.weak = c(rf"(?<!\p{{L}})(?i:{_alt(WEAK_CUES)})[ \t]+")
        self.pair = c(r"(?<![\p{L}\p{N}])(\p{Lu}[\p{L}'’-]+) (\p{Lu}[\p{L}'’-]{2,})(?![\p{L}\p{N}])")
        self.said = c(rf"(?<!\p{{L}})(?:(?i:{_alt(SAY_NAME)})|(?i:{_alt(ASK_FOR)}))\s+(?:(?i:dem|der|den|die|la|le|el|o|a|the|com)\s+)?|(?i:{_alt(SIGN_OFFS)})[ \t]*\n\s*")
        self.titled = c(rf"(?<![\p{{L}}\p{{N}}])(?:{_alt(TITLES)})\.?[ \t]+(?:(?:{_alt(TITLES)})\.?[ \t]+)*")
        self.word = c(r"\p{L}[\p{L}'’-]*")
        self.titles = frozenset(t.lower() for t in TITLES)
        self.given = given
        # for each pattern words of which a text must have one
        key = lambda words: frozenset(max(_tokens(_fold(w)), key=len) for w in words)
        street = lambda words: frozenset(x for w in words.split("|") for x in _tokens(_fold(w.replace("\\", "")))[:1])
        self.name_words, self.title_words, self.weak_words = key(SAY_NAME + ASK_FOR + SIGN_OFFS), key(TITLES), key(WEAK_CUES)
        self.phone_words, self.id_words = key(PHONE_CUES), key(ID_CUES)
        self.cue_words = self.name_words | self.title_words | self.weak_words
        self.number = c(r"\d")
        # German street words end longer ones, so their last letters are looked for
        ends = frozenset(_tokens(_fold(x.replace("\\", "")))[-1][-3:] for x in f"{STREET_DE}|{STREET_DE_WORD}".split("|"))
        none: frozenset[str] = frozenset()
        self.address_words = [
            (street(STREET_EN), none), (none, ends), (frozenset("am an auf im in zum zur alte alter neue".split()), none),
            (street(STREET_FR), none), (street(STREET_ES_PT), none), (street("ул|улица|пр|проспект|пер|переулок|наб|набережная"), none),
        ]


#: Lower-case words inside family names.
PARTICLES = frozenset("van von der den de del della di da das dos do du la los las le ter ten bin zu".split())


_MARKS, _TOKEN, _DIGIT = regex.compile(r"\p{M}+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d")
#: A word with its hyphens and apostrophes, in folded text.
_NAME_WORD = regex.compile(r"\p{L}[\p{L}'’-]*")
_ascii_tokens = re.compile("[a-z]+").findall


def _tokens(low: str) -> list[str]:
    """Runs of letters of a folded text."""
    return _ascii_tokens(low) if low.isascii() else _TOKEN.findall(low)


def _fold(s: str) -> str:
    """Lower case without accents."""
    return s.lower() if s.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", s.casefold()))


class _Words:
    """The words of one text, with what is known of each."""

    def __init__(self, p: Patterns, text: str, family: frozenset[str], given: frozenset[str]):
        self.text = text
        found = list(p.word.finditer(text))
        self.start, self.end = [m.start() for m in found], [m.end() for m in found]
        self.raw = [m[0] for m in found]
        self.fold = [_fold(w) for w in self.raw]
        self.p, self.family, self.given = p, family, given

    def known(self, i: int) -> bool:
        x = self.fold[i]
        return x in self.given or x in self.family

    def is_family(self, i: int) -> bool:
        return self.fold[i] in self.family

    def upper(self, i: int) -> bool:
        return self.raw[i][0].isupper()

    def initial(self, i: int) -> bool:
        return len(self.raw[i]) == 1 and self.upper(i) and self.text[self.end[i] : self.end[i] + 1] == "."

    def gap(self, i: int) -> str:
        """What stands between word i and the next."""
        return self.text[self.end[i] : self.start[i + 1]] if i + 1 < len(self.raw) else "\n"

    def joins(self, i: int) -> bool:
        gap = self.gap(i)
        return gap in (" ", "  ") or (gap == ". " and self.initial(i))

    def bounded(self, i: int) -> bool:
        """Nothing but punctuation or the line's end follows word i."""
        rest = self.text[self.end[i] : self.end[i] + 2]
        return not rest or rest[0] in ".,;:!?)\n\r" or rest == " ("

    def last_of(self, i: int) -> int | None:
        """Index of the last word of the name that begins with word i, or None."""
        n = len(self.raw)
        if self.gap(i) == ", " and i + 1 < n and (self.is_family(i) or self.upper(i)) and not self.initial(i):
            j = i + 1  # family name first
            if self.fold[j] in self.given or (self.is_family(i) and self.upper(j) and not self.is_family(j)) or (self.upper(j) and self.bounded(j)):
                return j
        j, names, sure = i, 0, None
        while True:
            small = self.raw[j].lower() in PARTICLES and j > i
            fits = self.upper(j) or self.known(j) or small
            if not fits and not (j == i + 1 and names == 1 and not self.upper(i)) and not (j == i and j + 1 < n and self.joins(j) and self.is_family(j + 1)):
                j -= 1
                break
            names += not small and not self.initial(j)
            if self.is_family(j) and j > i:
                sure = j
                break
            if names == 2 or j + 1 >= n or j - i > 5 or not self.joins(j):
                break
            j += 1
        if sure is not None:
            return sure
        while j > i and self.raw[j].lower() in PARTICLES:
            j -= 1
        if j < i:
            return None
        if names == 2 and j + 1 < n and self.joins(j) and self.upper(j + 1) and self.bounded(j + 1) and not self.is_family(j):
            j += 1  # a third word that closes the phrase
        return j

    def first_of(self, j: int) -> int | None:
        """Index of the first word of the name that ends with word j, or None."""
        if not (self.upper(j) or self.known(j)):
            return None
        if j > 0 and self.gap(j - 1) == ", " and (self.is_family(j - 1) or (self.upper(j - 1) and self.fold[j] in self.given)):
            return self._over_particles(j - 1)
        i, names = j, 1
        while i > 0 and self.joins(i - 1) and j - i < 6:
            k = i - 1
            if self.raw[k].lower() in PARTICLES or self.initial(k):
                i = k
            elif names < 2 and (self.upper(k) or self.known(k) or self._opens(k)):
                i, names = k, names + 1
            elif names == 2 and self.upper(k) and self.fold[k] in self.given and self.fold[i] not in self.given:
                i, names = k, names + 1
            else:
                break
        while i < j and (self.raw[i].lower() in PARTICLES and not self.upper(i) or self.raw[i].lower() in self.p.titles):
            i += 1
        return i

    def _over_particles(self, i: int) -> int:
        while i > 0 and self.joins(i - 1) and self.raw[i - 1].lower() in PARTICLES:
            i -= 1
        return i

    def _opens(self, i: int) -> bool:
        """Word i stands at the start of a line or sentence."""
        before = self.text[max(0, self.start[i] - 2) : self.start[i]]
        return not before.strip(" ") or before[-1] == "\n" or before in (". ", "! ", "? ")


def find(p: Patterns, text: str, family: frozenset[str] = frozenset(), names_only: bool = False, full: frozenset[str] = frozenset(), given: frozenset[str] | None = None) -> list[tuple[int, int, str]]:
    """Items as (start, end, type) in order, none overlapping; earlier types win.

    ``family`` holds folded family names, ``full`` folded "given family" pairs. ``names_only`` looks for names and for
    addresses, whose words may look like titles.
    """
    given = p.given if given is None else given
    taken = bytearray(len(text) + 1)
    items: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            items.append((a, b, kind))

    low = _fold(text)
    own = frozenset(_tokens(low))
    cued = not own.isdisjoint(p.cue_words)
    taught = not own.isdisjoint(_heads(family)) or not own.isdisjoint(_ends(full))
    if not cued and not taught and (names_only or not (p.number.search(text) or "@" in text or "at" in own)):
        return items
    digits = len(_DIGIT.findall(text))
    if not names_only and ("@" in text or "at" in own) and p.at.search(text):
        for m in p.email.finditer(text):
            add(m.start(1), m.end(), "email")
    if digits:
        tails = {t[-3:] for t in own}
        for rx, (some, inside) in zip(p.address, p.address_words):
            if not own.isdisjoint(some) or not tails.isdisjoint(inside):
                for m in rx.finditer(text):
                    add(m.start(), m.end(), "address")
    if not names_only and digits >= 6:
        if not own.isdisjoint(p.phone_words):
            for m in p.phone_cued.finditer(text):
                if 7 <= sum(map(str.isdigit, m[1])) <= 15:
                    add(m.start(1), m.end(1), "phone")
        if not own.isdisjoint(p.id_words):
            for m in p.id_cued.finditer(text):
                if 7 <= sum(map(str.isdigit, m[1])) <= 12:
                    add(m.start(1), m.start(1) + len(m[1].rstrip()), "id_number")
        for m in p.id_format.finditer(text):
            add(m.start(), m.end(), "id_number")
        for m in p.phone.finditer(text):
            if 7 <= sum(map(str.isdigit, m[0])) <= 15:
                add(m.start(), m.end(), "phone")
    words = None
    for rx, some, weak in ((p.said, p.name_words, False), (p.titled, p.title_words, False), (p.weak, p.weak_words, True)):
        for m in rx.finditer(text) if not own.isdisjoint(some) else ():
            if taken[m.start()]:
                continue  # "Dr" of a street
            words = words or _Words(p, text, family, given)
            at = m.end()
            title = p.titled.match(text, at)
            i = bisect.bisect_left(words.start, title.end() if title else at)
            if i == len(words.raw) or words.start[i] != (title.end() if title else at):
                continue
            near = range(i, min(i + 3, len(words.raw)))
            if (words.upper(i) and not weak) or any(words.known(k) for k in near):
                j = words.last_of(i)
                if j is not None and (not weak or any(words.known(k) for k in range(i, j + 1))):
                    add(words.start[i], words.end[j], "name")
    if taught:
        words = words or _Words(p, text, family, given)
        for j in range(len(words.raw)):
            if words.fold[j] in family:
                if words.gap(j) == ", " and j + 1 < len(words.raw) and words.fold[j + 1] in given:
                    add(words.start[words._over_particles(j)], words.end[j + 1], "name")
                elif (i := words.first_of(j)) is not None and i < j:
                    add(words.start[i], words.end[j], "name")
            elif full and j and words.joins(j - 1) and words.upper(j) and words.upper(j - 1) and f"{words.fold[j - 1]} {words.fold[j]}" in full:
                add(words.start[j - 1], words.end[j], "name")
    return sorted(items)


@lru_cache(maxsize=8)
def _heads(family: frozenset[str]) -> frozenset[str]:
    """The first run of letters of each family name; a text without any has none of them."""
    return frozenset(_tokens(x)[0] for x in family)


@lru_cache(maxsize=8)
def _ends(full: frozenset[str]) -> frozenset[str]:
    """The same of the last words of full names."""
    return _heads(frozenset(x.rpartition(" ")[2] for x in full))


@lru_cache(maxsize=8)
def _patterns(given: frozenset[str]) -> Patterns:
    return Patterns(given)


FOUND = "id {kind}, pii_type string, start_char bigint, end_char bigint, value string, title string, bounded boolean"


def _rows(key, text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple]:
    for a, b, kind in found:
        before = text[max(0, a - 12) : a].split() if kind == "name" else []
        yield key, kind, a, b, text[a:b], before[-1].strip(".").lower() if before else "", not text[b : b + 1].strip(".,;:!?)\r\n")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL AND text <> ''")


def detect(df: DataFrame, id_col: str, text_col: str, known: DataFrame, bound: int = 300_000, names_only: bool = False) -> DataFrame:
    """One row per item: id_col, pii_type, start_char, end_char (in code points), value, title (the word before a name), bounded.

    ``known`` has kind and word: ``given`` and ``family`` names, and ``full`` names ("given family"), all folded (see
    :func:`knowledge`). Up to ``bound`` of them go out with the tasks; of more, each text gets those of its words by a
    join, with the same result. ``bounded``: no word follows directly, so the item's end is sure. With ``names_only``
    there are also rows of type ``pair``: a listed given name before a capitalised word, which may be a name.

    Null and empty texts have no items; repeated rows give their items again; extra columns are ignored.
    """
    rows = _texts(df, id_col, text_col)
    kind = FOUND.format(kind=dict(rows.dtypes)["id"])
    if few(known, bound):
        sets = {k: frozenset(r["word"] for r in own) for k, own in _by_kind(known.collect()).items()}
        source = rows.select("id", "text")
    else:
        sets, source = None, _with_own_words(rows, known)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _patterns(frozenset())
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                own = sets or {k: frozenset(r["word"] for r in x) for k, x in _by_kind([] if row.known is None else row.known).items()}
                given = own["given"]
                out += _rows(row.id, row.text, find(p, row.text, own["family"], names_only, own["full"], given))
                if names_only and not given.isdisjoint(_tokens(_fold(row.text))):
                    out += [(row.id, "pair", m.start(), m.end(), m[0], "", True) for m in p.pair.finditer(row.text, overlapped=True) if _fold(m[1]) in given and _fold(m[2]) not in given]
            yield pd.DataFrame(out, columns=["id", "pii_type", "start_char", "end_char", "value", "title", "bounded"])

    return source.mapInPandas(run, kind).withColumnRenamed("id", id_col)


def _by_kind(rows: list) -> dict[str, list]:
    out: dict[str, list] = {"given": [], "family": [], "full": []}
    for r in rows:
        out[r["kind"]].append(r)
    return out


def _with_own_words(rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, text, known: to each text those known words that it has, by a join on words; texts without any stay out of the join."""
    numbered = durable(rows.withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, word = [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = _NAME_WORD.findall(_fold(text))
                own = {*every, *(f"{a} {b}" for a, b in zip(every, every[1:]))}
                row += [r] * len(own)
                word += own
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.string())], ["row", "word"])

    words = numbered.select("row", "text").mapInArrow(run, "row bigint, word string")
    own = words.join(known, "word").groupBy("row").agg(F.collect_set(F.struct("kind", "word")).alias("known"))
    return numbered.join(own, "row", "left").select("id", "text", "known")


def _folded(column: Column) -> Column:
    """Names as :func:`find` looks them up."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(_fold, na_action="ignore")

    return fold(column)


def listed(names: DataFrame, name_col: str = "given_name") -> DataFrame:
    """kind, word: the given names of a table."""
    own = names.select(_folded(F.trim(F.col(f"`{name_col}`"))).alias("word")).where("word <> ''").distinct()
    return own.select(F.lit("given").alias("kind"), "word")


def knowledge(found: DataFrame, texts: DataFrame, least: int = 3, givens: int = 2, share: float = 0.2) -> DataFrame:
    """kind, word: the family names and full names that the mentions of a first pass teach, counted over all texts in Spark.

    A last word is a family name if it ended at least ``least`` cued names of two words behind which no word followed, or
    stood behind at least ``givens`` different listed given names. One such cued mention is enough for its full name.
    In any case such mentions must be a ``share`` of all times that the texts (id, text) have the word, in whatever case:
    a common word that now and then follows a name doesn't become one, however large the corpus is.
    """
    plain = F.regexp_replace("value", r"^(.+), (.+)$", "$2 $1")
    parts = found.where("pii_type IN ('name', 'pair') AND bounded").select("pii_type", F.lower(plain).alias("v"))
    part = lambda i: F.regexp_extract("v", r"^([\p{L}.'’-]+)\s+(?:.*\s)?(\p{L}[\p{L}'’-]+)$", i)
    two = parts.select("pii_type", part(1).alias("given"), part(2).alias("family")).where((F.col("family") != "") & ~F.col("family").isin(*PARTICLES))
    # partly aggregated by both words first: the shuffle carries distinct pairs
    some = lambda k: F.sum(F.when(F.col("pii_type") == k, 1).otherwise(0))
    pairs = durable(two.groupBy("family", "given").agg(some("name").alias("cued"), some("pair").alias("paired")))
    sums = pairs.groupBy("family").agg(F.sum("cued").alias("cued"), F.sum("paired").alias("paired"), F.sum((F.col("paired") > 0).cast("int")).alias("givens"))
    wanted = durable(sums)
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}'’-]*"), F.lit(0))).alias("family"))
    listed_ = wanted.select("family")
    total = words.join(F.broadcast(listed_) if few(listed_) else listed_, "family", "left_semi").groupBy("family").agg(F.count("*").alias("total"))
    good = durable(wanted.join(total, "family").where(F.greatest("cued", "paired") >= share * F.col("total")))
    family = good.where((F.col("cued") >= least) | (F.col("givens") >= givens)).select(F.lit("family").alias("kind"), _folded(F.col("family")).alias("word"))
    known = pairs.where("cued > 0 AND length(given) > 2").join(good.select("family"), "family", "left_semi")
    return family.unionByName(known.select(F.lit("full").alias("kind"), _folded(F.concat_ws(" ", "given", "family")).alias("word"))).distinct()


def items(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str = "given_name", bound: int = 300_000) -> DataFrame:
    """Detection in two passes: names that cues give away teach the names by which others are known. Copies of a row give their items once."""
    given = durable(listed(names, name_col))
    taught = durable(knowledge(detect(df, id_col, text_col, given, bound, names_only=True), _texts(df, id_col, text_col)))
    return detect(df, id_col, text_col, given.unionByName(taught), bound).dropDuplicates([id_col, "pii_type", "start_char", "end_char", "value"])


# ---------------------------------------------------------------- replacement


def normal_form(kind: str, value: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return regex.sub(r"\s?[(\[]?\s?\bdot\b\s?[)\]]?\s?", ".", regex.sub(r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?", "@", value.casefold()))
    if kind in ("phone", "id_number"):
        return "".join(x for x in value.upper() if x.isalnum())
    if kind == "name" and "," in value:
        last, _, first = value.partition(",")
        value = f"{first.strip()} {last.strip()}"
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", _fold(value)))


def _bits(key: bytes, kind: str, entity: str, attempt: int):
    """Endless keyed draws: number below n."""
    state = hmac.new(key, f"{kind}\0{attempt}\0{entity}".encode(), "sha512").digest()
    pool, used = int.from_bytes(state, "big"), 0

    def draw(n: int) -> int:
        nonlocal pool, used, state
        if pool < n << 32:
            used += 1
            state = hmac.new(key, state + bytes([used % 256]), "sha512").digest()
            pool = int.from_bytes(state, "big")
        pool, x = divmod(pool, n)
        return x

    return draw


def gender(title: str, given: str) -> str:
    """f, m or nothing, by the title, else by the given name."""
    if title in FEMALE_TITLES:
        return "f"
    if title in MALE_TITLES:
        return "m"
    return "f" if given in WOMEN else "m" if given in MEN else ""


def parts_of(kind: str, value: str, title: str) -> list[tuple[str, str, str]]:
    """What of an item is replaced, in its order: (kind, entity, hint), the hint telling what the surrogate must keep.

    A name consists of given names and a family name, a mail box of user and domain; the rest are whole.
    """
    if kind == "name":
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", value) else "latin"
        words = [_fold(m[0]) for m in _NAME_WORD.finditer(value)]
        # family name first: its last word before the comma
        last = len(_NAME_WORD.findall(value[: value.index(",")])) - 1 if "," in value else len(words) - 1
        alone = len(words) == 1
        return [
            ("family" if i == last or alone else "particle" if w in PARTICLES else "given", w, f"{script}:{gender(title, w)}")
            for i, w in enumerate(words)
        ]
    if kind == "email":
        user, _, domain = normal_form(kind, value).rpartition("@")
        return [("user", user, ""), ("domain", domain, "")]
    return [(kind, normal_form(kind, value), value)]


def fixed_digits(value: str) -> int:
    """Signs at the start of a number that its surrogate keeps: country code and trunk prefix."""
    m = regex.match(r"\s*(?:\+|00)\s?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", value)
    if m:
        zero = regex.match(r"[\s.-]?\(0\)", value[m.end() :])
        return sum(x.isalnum() for x in value[: m.end()]) + bool(zero)
    return 1 if regex.match(r"\(?0\d", value) else 0


def surrogate(kind: str, entity: str, hint: str, key: bytes, attempt: int = 0) -> str:
    """A replacement for one part, fixed by key and entity; the first attempt at a given name is a usual one."""
    draw = _bits(key, kind, entity, attempt)
    if kind in ("phone", "id_number"):
        keep = fixed_digits(hint) if kind == "phone" else 0
        return "".join(x if i < keep else str(draw(10)) if x.isdigit() else chr(65 + draw(26)) for i, x in enumerate(entity))
    if kind == "user":
        return "".join(SYLLABLES[draw(len(SYLLABLES))] for _ in range(5))
    if kind == "domain":
        return "".join(SYLLABLES[draw(len(SYLLABLES))] for _ in range(4)) + ".example"
    if kind == "address":
        signs = regex.sub(r"\d+", lambda m: str(1 + draw(9)) + "".join(str(draw(10)) for _ in m[0][1:]), hint)
        stem = "".join(SYLLABLES[draw(len(SYLLABLES))] for _ in range(4)).capitalize()
        names = list(regex.finditer(r"\p{Lu}\p{Ll}{2,}", signs))
        keep = regex.compile(rf"(?:{STREET_EN}|{STREET_ES_PT}|{STREET_DE_WORD}|Flat|Apt|Unit|Suite|Room|Alte|Neue|Am|Im|Zum|Zur)$", regex.I)
        pick = [m for m in names if not keep.match(m[0])] or names
        if not pick:
            return signs
        m = pick[0]
        tail = regex.search(rf"(?i:{STREET_DE})$", m[0])
        return signs[: m.start()] + stem + (tail[0] if tail else "") + signs[m.end() :]
    script, _, sex = hint.partition(":")
    cyrillic = script == "cyrillic"
    syllables = SYLLABLES_CYR if cyrillic else SYLLABLES
    if kind == "particle":
        return entity
    if kind == "given":
        if len(entity) == 1:
            return syllables[draw(len(syllables))][0].upper()
        usual = GIVEN[script, sex]
        if attempt == 0:
            return usual[draw(len(usual))]
        end = {"f": "на" if cyrillic else "na", "m": "н" if cyrillic else "n"}.get(sex, "й" if cyrillic else "y")
        return ("".join(syllables[draw(len(syllables))] for _ in range(3)) + end).capitalize()
    return "".join(syllables[draw(len(syllables))] for _ in range(4)).capitalize()


def rendered(kind: str, value: str, made: list[str]) -> str:
    """The item with its parts' surrogates, in the item's own separators and case."""
    if kind == "name":
        new = iter(made)
        out = _NAME_WORD.sub(lambda m: m[0] if (x := next(new)) == _fold(m[0]) else x.upper() if m[0].isupper() else x.lower() if m[0].islower() else x, value)
        return out
    if kind == "email":
        at = regex.search(r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?", value, regex.I)
        dot = regex.search(r"\s?[(\[]\s?dot\s?[)\]]\s?", value, regex.I)
        return f"{made[0]}{at[0] if at else '@'}{made[1].replace('.', dot[0]) if dot else made[1]}"
    if kind in ("phone", "id_number"):  # mentions of one entity differ in separators only, so the drawn signs are placed by their order
        signs = iter(made[0])
        return "".join(next(signs, "0") if x.isalnum() else x for x in value)
    return made[0].upper() if value.isupper() else made[0]


PART = "array<struct<kind:string,entity:string,hint:string>>"


def _parts(found: DataFrame) -> Column:
    @F.pandas_udf(PART)
    def split(kind: pd.Series, value: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([[dict(kind=k, entity=e, hint=h) for k, e, h in parts_of(*x)] for x in zip(kind, value, title)])

    return split("pii_type", "value", "title")


def surrogates(found: DataFrame, key: bytes, attempts: int = 12) -> DataFrame:
    """One row per part of an entity: kind, entity, made, no two of a kind alike (but for initials) and none equal to an entity of the corpus.

    All parts start with attempt 0. Those whose surrogate is an entity of the corpus, or is shared with a part of smaller
    hash, move on to their next attempt; after ``attempts`` rounds any that still collide get attempts of their own by rank.
    """

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, entity: pd.Series, hint: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, h, key, n) for k, e, h, n in zip(kind, entity, hint, attempt)])

    @F.pandas_udf("string")
    def normal(kind: pd.Series, made: pd.Series) -> pd.Series:
        return pd.Series([normal_form("address", m) if k == "address" else _fold(m) if k in ("given", "family") else m for k, m in zip(kind, made)])

    each = found.select(F.explode(_parts(found)).alias("p")).select("p.*")
    # the hint that most mentions give; of equals the longer one, which tells the gender
    hints = each.groupBy("kind", "entity", "hint").agg(F.count("*").alias("n"))
    known = durable(hints.groupBy("kind", "entity").agg(F.max(F.struct(F.col("hint").rlike(":.").alias("told"), "n", "hint"))["hint"].alias("hint")).withColumn("attempt", F.lit(0)))
    free = F.col("kind").isin("particle") | ((F.col("kind") == "given") & (F.length("entity") == 1))
    for last in [False] * (attempts - 1) + [True]:
        made = known.withColumn("made", drawn("kind", "entity", "hint", "attempt")).withColumn("normal", normal("kind", "made"))
        real = known.select("kind", F.col("entity").alias("normal"), F.lit(True).alias("real"))
        order = Window.partitionBy("kind", "normal").orderBy(F.col("attempt").desc(), F.xxhash64("entity"), "entity")
        ranked = made.join(real, ["kind", "normal"], "left").withColumn("place", F.row_number().over(order))
        ranked = durable(ranked.withColumn("again", ~free & ((F.col("place") > 1) | F.coalesce("real", F.lit(False)))))
        if ranked.where("again").isEmpty():
            break
        step = F.lit(attempts) + F.col("place") if last else F.lit(1)
        known = ranked.withColumn("attempt", F.when(F.col("again"), F.col("attempt") + step).otherwise(F.col("attempt")).cast("int")).select("kind", "entity", "hint", "attempt")
    return ranked.select("kind", "entity", "made")


def redact(df: DataFrame, id_col: str, text_col: str, found: DataFrame, key: bytes) -> DataFrame:
    """id_col, placeholders (each item as ``[TYPE]``) and surrogates (each item as its keyed surrogate).

    ``found`` comes from :func:`items` over the same rows. ``key`` must be kept secret: who has it can try entities.
    Texts without items are put out as they are, null stays null. Rows that repeat an id and its text come out once
    for each row.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    spans = F.struct(F.col("start_char").alias("a"), F.col("end_char").alias("b"), F.col("pii_type").alias("kind"), "value", "made")
    each = found.select(F.col(id_col).alias("id"), "pii_type", "start_char", "end_char", "value", F.posexplode(_parts(found)).alias("i", "p"))
    table = surrogates(found, key)
    table = F.broadcast(table) if few(table) else table
    chosen = each.select("*", F.col("p.kind").alias("kind"), F.col("p.entity").alias("entity")).join(table, ["kind", "entity"])
    whole = chosen.groupBy("id", "pii_type", "start_char", "end_char", "value").agg(F.sort_array(F.collect_set(F.struct("i", "made")))["made"].alias("made"))
    own = whole.groupBy("id").agg(F.sort_array(F.collect_list(spans)).alias("spans"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(own, "id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            plain, keyed = [], []
            for text, mine in zip(pdf["text"], pdf["spans"]):
                if text is None or mine is None:
                    plain.append(text)
                    keyed.append(text)
                    continue
                at, p, k = 0, [], []
                for s in mine:
                    if s["a"] < at or text[s["a"] : s["b"]] != s["value"]:
                        continue  # an item of another row with the same id
                    p += [text[at : s["a"]], f"[{s['kind'].upper()}]"]
                    k += [text[at : s["a"]], rendered(s["kind"], s["value"], list(s["made"]))]
                    at = s["b"]
                plain.append("".join(p) + text[at:])
                keyed.append("".join(k) + text[at:])
            yield pd.DataFrame({"id": pdf["id"], "placeholders": plain, "surrogates": keyed})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, placeholders string, surrogates string").withColumnRenamed("id", id_col)
