"""Personal information inside free text, replaced by typed placeholders.

Anchor expansion. One Aho-Corasick pass over a text finds at-signs, schemes and
cues (identifier words, street words, titles, given names, number words),
digits and full stops; at each anchor a deterministic local parser reads
outwards, validates what it finds and gives its exact boundaries. Nothing is
searched for away from an anchor. Overlapping findings are settled by kind and
length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Given names by which a full name is found.
GIVEN_NAMES = """
alex alexander alice alvar amelie ana andrea andrew anna anouk anton astrid bastian beatrice bjorn bram
camille carla caroline casper catherine celia charles charlotte chloe christian claire clara corin dalia
daniel dario david diana diego edward elena elio elizabeth ella emil emily emma enzo eric erik esther ethan
eva fabian fatima felix fernando finn florian francis frank gabriel george giulia greta gustav hanna hannah
hans harry heidi helen helena henri henrik hollis hugo idris ines ingrid isabel jacob jakob james jane
jasper javier jean jennifer jessica johann john jolene jonas jorge jose joseph juan julia julien karen karin
katrin keziah klaus laura lars lena leon linda linnea lotte louis lucas lucia lucy luis maeve marco maria
marie mark marlon marta martin mary matteo max michael miguel mirko monika nadia nicolas niko nina noemi
nora odile oliver olivia oren oscar pablo patricia paul pedro peter petra philip piet rachel ralf rebecca
richard robert rohan rosa ruta ruth ryan sabine samuel sandra sara sarah silvan simon sofia sophie stefan
stella susan sven tamsin tess theo thomas tobias tobin tom ursula vera victor vincent wanda werner william
wolfgang yara yusuf yvonne zoe
""".split()
# Forms of address before a surname.
TITLES = "mr mrs ms miss mx dr prof professor herr frau monsieur madame mme mlle señor señora sr sra don doña".split()
# Words that stand beside a given name and are not surnames.
NOT_SURNAMES = set(
    """
a about after again agree agrees all almost along already also always am an and any anyone are around as asked
asks at back badly barely be beats because been before behind below beside best blamed borrowed both bought
brought but by call called calls came can clearly could dear did do does done each either else even ever every
everyone everything except explained explains fair few first for from funny gave get gets got had has have he
hello her here hey hi him his how i if in inside into is it its just kept knew knows last late later least left
like long looked looking made make many maybe me mentioned might mine moved much must my near nearly never
next no nobody none nor not nothing now of off often on once one only open or other our out over own please
said same saw says see sent serious she should since small so some someone soon still such sure take talked
than thank thanks that the their them then there these they this those though through to told too took two
under unless unpopular until up upon us very via wants was we well went were what when where whether which
while who whose why will with without would wrote yes yet you your
aber als am auch auf aus bei bin da das dass dem den der des die doch du ein eine er es für hat ich im in ist
ja kann mit nach nicht noch nur oder seit sich sie sind so über um und uns von vor war was wie wir zu zum zur
au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ma mon ne nous ou où par pas
plus pour qui sa sans ses son sont sur un une vous
al como con cuando del donde el ella en es esta este hay las lo los más mi muy para pero por que se si sin su
sus tiene un una y ya
edit ps tldr lol street road lane drive avenue band festival
""".split()
)
# Of these, the ones that are surnames after a given name where both are capitalised.
ALSO_SURNAMES = set("best lane long small".split())
# Words that end the name of a street.
STREET_TYPES = (
    "street st road rd avenue ave lane ln drive dr close court ct crescent cres terrace way boulevard blvd place "
    "pl square sq row hill gardens grove mews walk park parade quay"
).split()
# Of these, the ones that end a street's name even where all is in lower case.
LOWER_STREET_TYPES = set(
    "street st road rd avenue ave lane ln drive dr close court crescent terrace way boulevard blvd".split()
)
STREET_STARTS = "rue avenue boulevard chemin allée impasse quai calle avenida avda paseo camino plaza".split()
STREET_ENDINGS = "straße strasse str. weg gasse allee platz ring damm ufer".split()
ID_CUES = {
    "ssn": "social", "social": "social", "passport": "passport", "passeport": "passport",
    "reisepass": "passport", "pasaporte": "passport", "licence": "licence", "license": "licence",
    "führerschein": "licence", "permis": "licence", "permiso": "licence", "tax": "tax", "steuer": "tax",
    "fiscal": "tax", "insurance": "insurance", "ni number": "insurance", "nino": "insurance", "dni": "dni",
    "nie": "dni", "nif": "dni", "sécurité sociale": "insurance", "seguridad social": "insurance",
    "versicherungsnummer": "insurance",
}
AT_CUES = ("@", "[at]", "(at)", "{at}", "(ät)", "[dot]", "(dot)", "{dot}", " dot ", "\ndot", "mailto:")
# Given-name cues that a neighbouring word turns into one: X is the person meant.
NAME_CUES = (
    "signed,", "ask for", "talked to", "s'appelle", "se llama", "my name is", "belongs to", "heißt", "talked with",
    "spoke to", "spoke with", "his name is", "her name is", "their name is", "full name is", "real name is", "my name's",
    "my name’s", "full name:", "sincerely,", "regards,", "yours truly,", "ich heiße", "mein name ist", "m'appelle",
    "m’appelle", "s’appelle", "mon nom est", "me llamo", "mi nombre es",
)

# Words after which a full name stands, and words that follow one.
PERSON_CUES = (
    "contact", "email", "phone", "meet", "met", "meeting", "colleague", "neighbour", "landlord", "lawyer", "doctor", "teacher",
    "boss", "manager", "supervisor", "coach", "named", "called", "sincerely", "regards",
)
# Words that begin the name of a place.
PLACE_WORDS = set("new old great north south east west saint san los las lake mount port fort united royal".split())
SAYING = ("wrote", "said", "says", "lives at", "lives in", "works at", "works for", "'s phone", "'s email", "'s number", "’s number")

_SP = r"[^\S\n]*\r?\n?[^\S\n]*"  # white space without an empty line
_GAP = r"(?:[^\S\n]+|[^\S\n]*\r?\n[^\S\n]*)"

_DOT = rf"(?:\.|{_SP}[\[({{]{_SP}(?:dot|punkt|point|punto){_SP}[\])}}]{_SP}|{_GAP}(?:dot|punkt|punto){_GAP})"
_AT = rf"(?:{_SP}@{_SP}|{_SP}[\[({{]{_SP}(?:at|ät){_SP}[\])}}]{_SP}|{_GAP}at{_GAP})"
_EMAIL = re.compile(
    rf"(?i)(?<![\w.+@])[\w](?:[\w.+\-]*\w)?(?:{_GAP}dot{_GAP}[\w+\-]+)*(?P<at>{_AT})"
    rf"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*(?P<dot>{_DOT})[a-z]{{2,}}(?![\w@])"
)

#: Characters that a mailbox and a domain may have, with room for spelled-out signs.
LOCAL_PART, DOMAIN = 160, 320
#: Characters before an anchor in which the beginning of its form is looked for.
LEAD = 24
_SIGN_BEFORE = re.compile(rf"(?:\+{_SP})?\(?$|(?:\+?1(?:[.\-/]|{_SP}))?\(?$")
_PAIR_BEFORE = re.compile(r"[A-Za-z]{2}\s{0,2}$")
_PLUS_BEFORE = re.compile(r"(?i)\bplus\s+$")
_SEP = rf"(?:[.\-/]|{_SP})"
_PHONE = re.compile(
    rf"(?<![\w.])(?:"
    rf"\+{_SP}\d{{1,3}}(?:{_SEP}\(?\d{{1,5}}\)?){{2,5}}"
    rf"|(?:\+?1{_SEP})?\(?[2-9]\d\d\)?{_SEP}[2-9]\d\d{_SEP}\d{{4}}"
    rf"|0[1-9](?:{_SEP}\d\d){{4}}"
    rf"|0\d{{2,4}}{_SEP}\d{{3,4}}{_SEP}\d{{3,4}}"
    rf"|0\d{{3,4}}{_SEP}\d{{5,7}}"
    rf")(?:,?{_SP}(?:ext\.?|extension|x){_SP}\d{{1,5}})?(?![\w]|[.\-]\d)"
)
#: Number words of a spelled-out phone number, at least.
SPELLED_DIGITS = 7
NUMBER_WORDS = "zero oh one two three four five six seven eight nine".split()
_NUMBER_WORD = f"(?:{'|'.join(NUMBER_WORDS)})"
_SPELLED = re.compile(rf"(?i)\b(?:plus{_GAP})?{_NUMBER_WORD}(?:[,\-]?{_GAP}?(?:double{_GAP}|triple{_GAP})?{_NUMBER_WORD}){{{SPELLED_DIGITS - 1},14}}\b")

_SSN = re.compile(r"(?<![\w\-.])\d{3}[-\s]{1,2}\d{2}[-\s]{1,2}\d{4}(?![\w\-])")
_NINE = re.compile(r"(?<![\w\-.])\d{9}(?![\w\-])")
_NINO = re.compile(r"(?i)(?<!\w)[a-z]{2}\s{0,2}\d{2}\s{0,2}\d{2}\s{0,2}\d{2}\s{0,2}[a-d](?!\w)")
_TAX = re.compile(r"(?<![\w\-])\d{2}[\s/\-]{0,2}\d{3}[\s/\-]{0,2}\d{3}[\s/\-]{0,2}\d{3}(?![\w\-])")
_PASSPORT = re.compile(r"(?i)(?<!\w)[a-z]{1,2}\s{0,2}\d{6,9}(?!\w)|(?<![\w\-])\d{9}(?![\w\-])")
_LICENCE = re.compile(r"(?i)(?<!\w)(?:[a-z]{1,2}\d{2,4}(?:[-\s]\d{3,4}){2,3}|[a-z]\d{7,14}|[a-z]{5}\d{6}[a-z0-9]{5})(?!\w)")
_DNI = re.compile(r"(?i)(?<!\w)(?:[xyz][-\s]?)?\d{7,8}[-\s]?[a-z](?!\w)")
_ID_FORMS = {
    "social": (_SSN, _NINE), "insurance": (_NINO, _SSN), "tax": (_TAX, _SSN, _NINE, _DNI),
    "passport": (_PASSPORT,), "licence": (_LICENCE,), "dni": (_DNI,),
}
#: Pairs of letters that no national insurance number begins with.
NO_PREFIXES = set("BG GB KN NK NT TN ZZ".split())
#: Characters between a cue and its number, on either side.
CUE_REACH = 60
#: Characters of a number and of what sets it apart from the next in a list, at most.
LIST_REACH = 80
_LIST_WORD = "and|or|plus|und|oder|sowie|et|ou|y|e|o|u"
# What stands between two numbers of a list: signs, line breaks, "and", "no.", quotes and brackets.
_LIST_GAP = re.compile(
    rf"(?i)[\"'“”„‘’`*_)\]]*(?:\s*(?:[,;/&+|•]|\b(?:{_LIST_WORD})\b)|\s+)(?:\s*(?:[,;/&+|•*\-]|\b(?:{_LIST_WORD})\b)){{0,2}}"
    rf"\s*(?:(?:no|nr|num|number|nummer|número|numéro|n[º°o])\b\.?:?|#)?\s*[\"'“”„‘’`*_(\[]*"
)

_STREET_WORD = r"[^\W\d_][\w'’\-]*\.?"
_ADDRESS_EN = re.compile(
    rf"(?i)(?<![\w.,/\-])(?:(?:flat|apt\.?|unit|suite){_GAP}(?:\d{{1,4}}[a-z]?|[a-z]),?{_GAP})?"
    rf"\d{{1,5}}{_SP}[a-z]?,?{_GAP}(?P<name>(?:{_STREET_WORD}{_GAP}){{1,3}})(?P<type>{'|'.join(STREET_TYPES)})\b\.?"
    rf"(?:,?{_GAP}(?:apt\.?|apartment|unit|flat|suite|#){_SP}\w{{1,4}}\b)?"
)
_ADDRESS_START = re.compile(
    rf"(?i)(?<![\w.])\d{{1,4}}{_SP}(?:bis|ter|[a-c])?,?{_GAP}(?:{'|'.join(STREET_STARTS)}){_GAP}"
    rf"(?:(?:de|du|des|la|le|les|del|los|las|y){_GAP}|[dl]['’])*{_STREET_WORD}(?:{_GAP}[A-ZÀ-Ý][\w'’\-]*)*"
)
_ADDRESS_NUMBER_LAST = re.compile(
    rf"(?i)(?<!\w)(?:{'|'.join(STREET_STARTS)}|c/){_GAP}(?:(?:de|del|la|las|los|el){_GAP})*{_STREET_WORD}"
    rf"(?:{_GAP}{_STREET_WORD}){{0,3}}?,?{_GAP}(?:n\.?[º°o]\.?|núm\.?|número|num\.?)?{_SP}\d{{1,4}}(?!\w)"
)
_ADDRESS_DE = re.compile(
    rf"(?i)(?<!\w)(?:(?:am|an|auf|alte|alter|neue|neuer|hohe|lange){_GAP})?(?:der{_GAP}|dem{_GAP})?"
    rf"[^\W\d_][\w\-]*(?:{'|'.join(e.replace('.', '[.]') for e in STREET_ENDINGS)}){_GAP}\d{{1,4}}{_SP}[a-h]?(?!\w)"
)
#: Words that do not occur in the name of a street.
NOT_STREETS = NOT_SURNAMES - {"north", "south", "old", "st", "street", "hill", "park", "long", "first", "y", "de"}
_HERE = re.compile(r"[\w'’\-]+")

_PART = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_AFTER_GIVEN = re.compile(
    rf"(?:-(?P<second>{_PART}))?(?:{_GAP}(?P<initial>[^\W\d_])\.)?{_GAP}(?P<surname>{_PART}(?:-{_PART})*)(?![\w@])"
)
_GIVEN_REST = re.compile(rf"(?:-{_PART})?(?:{_GAP}[^\W\d_]\.)?(?![\w@])")
_BEFORE_COMMA = re.compile(rf"(?<![\w@/.\-])(?P<surname>{_PART}(?:-{_PART})*),{_GAP}$")
_AFTER_TITLE = re.compile(
    rf"\.?{_GAP}(?:[^\W\d_]\.{_GAP})?(?P<surname>{_PART}(?:-{_PART})*)(?![\w@])"
)
_INITIAL = re.compile(rf"(?<![\w.@/\-'’])(?P<initial>[^\W\d_])\.{_GAP}?(?P<surname>{_PART}(?:-{_PART})*)(?![\w@])")
_TWO_NAMES = re.compile(rf"{_GAP}(?P<given>{_PART}(?:-{_PART})?)(?:{_GAP}[^\W\d_]\.)?{_GAP}(?P<surname>{_PART}(?:-{_PART})*)(?![\w@])")


def _case(word: str) -> str:
    if len(word) > 1 and word.isupper():
        return "upper"
    return "title" if word[0].isupper() else "lower"


def is_surname(word: str, beside: str, given: bool = False) -> bool:
    """Whether a word can be the surname of a given name or title written as ``beside``.

    After a listed given name, ``given``, capitalised ones may have two letters or be in ``ALSO_SURNAMES``.
    """
    plain = word.lower()
    if given and _case(beside) == _case(word) == "title":
        if plain in ALSO_SURNAMES or (len(plain) == 2 and plain not in NOT_SURNAMES):
            return True
    if len(plain) < 3 or any(p in NOT_SURNAMES for p in plain.split("-")):
        return False
    want, got = _case(beside), _case(word)
    if want == "title":
        return got == "title" or (got == "upper" and len(word) > 3)
    if want == "upper":
        return got in ("upper", "title")
    return got == "lower" and not plain.endswith(("ly", "ing", "ed"))


class Finder:
    """Finds mentions as ``(start, end, kind)``, sorted and without overlaps."""

    def __init__(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        cues: dict[str, list[tuple[str, str]]] = {}
        for cue in AT_CUES:
            cues.setdefault(cue, []).append(("at", cue))
        for cue, form in ID_CUES.items():
            cues.setdefault(cue, []).append(("id", form))
        for cue in STREET_TYPES:
            cues.setdefault(cue, []).append(("street", cue))
        for cue in STREET_STARTS:
            cues.setdefault(cue, []).append(("street_start", cue))
        for cue in STREET_ENDINGS:
            cues.setdefault(cue, []).append(("street_end", cue))
        for cue in TITLES:
            cues.setdefault(cue, []).append(("title", cue))
        for cue in GIVEN_NAMES:
            cues.setdefault(cue, []).append(("given", cue))
        for cue in NAME_CUES:
            cues.setdefault(cue, []).append(("name_cue", cue))
        for cue in NUMBER_WORDS:
            cues.setdefault(cue, []).append(("number_word", cue))
        for cue in PERSON_CUES:
            cues.setdefault(cue, []).append(("person", cue))
        for cue in SAYING:
            cues.setdefault(cue, []).append(("saying", cue))
        for cue in "0123456789":
            cues.setdefault(cue, []).append(("digit", cue))
        cues.setdefault(".", []).append(("stop", "."))
        for cue, uses in cues.items():
            auto.add_word(cue, (len(cue), tuple(uses)))
        auto.make_automaton()
        self.auto = auto
        self.given = set(GIVEN_NAMES)

    def anchors(self, low: str) -> dict[str, list[tuple[int, int, str]]]:
        out: dict[str, list[tuple[int, int, str]]] = {}
        size = len(low)
        for last, (length, uses) in self.auto.iter(low):
            start, end = last - length + 1, last + 1
            for use, what in uses:
                if use == "digit":
                    if start and low[start - 1].isdecimal():
                        continue  # within a run of digits, whose first is the anchor
                elif use not in ("at", "street_end", "number_word", "stop") and (
                    (start and (low[start - 1].isalnum() or low[start - 1] == "_"))
                    or (end < size and (low[end].isalnum() or low[end] == "_"))
                ):
                    continue
                out.setdefault(use, []).append((start, end, what))
        return out

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at = self.anchors(low)
        found: list[tuple[int, int, str]] = []
        if "at" in at:
            found += self._emails(text, at["at"])
        if "street" in at or "street_start" in at or "street_end" in at:
            found += self._addresses(text, low, at)
        digits = [start for start, _, _ in at.get("digit", ())]
        if digits:
            if "id" in at:
                found += self._ids(text, at["id"])
            found += self._phones(text, digits, found)
            found += [(m.start(), m.end(), "id_number") for m in _at(_SSN, text, digits) if _dashed(m[0])]
            found += [(m.start(), m.end(), "id_number") for m in _at(_NINO, text, digits, _PAIR_BEFORE) if _insurance_prefix(m[0])]
        # A spelled-out phone number has seven digits at least.
        words = [start for start, _, _ in at.get("number_word", ())]
        if len(words) >= SPELLED_DIGITS:
            found += [(m.start(), m.end(), "phone") for m in _at(_SPELLED, text, words, _PLUS_BEFORE)]
        kept = settle(found)
        names = self._names(text, low, at)
        if names:
            kept = settle(kept + [n for n in names if not any(a < n[1] and n[0] < b for a, b, _ in kept)])
        return kept

    @staticmethod
    def _emails(text: str, anchors: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out, done = [], -1
        for start, end, _ in anchors:
            if start < done:
                continue
            at, stop = max(done, start - LOCAL_PART, 0), min(len(text), end + DOMAIN)
            while m := _EMAIL.search(text, at, stop):
                if m["at"].strip().lower() == "at" and m["dot"] == ".":
                    at = m.end("at")  # "meet at example.com": a place, not a mailbox
                    continue
                out.append((m.start(), m.end(), "email"))
                at = done = m.end()
        return out

    @staticmethod
    def _addresses(text, low, at) -> list[tuple[int, int, str]]:
        out = []
        for start, end, _ in at.get("street", ()):
            lo = max(0, start - 90)
            for m in _ADDRESS_EN.finditer(text, lo, min(len(text), end + 24)):
                if m.end() < end:
                    continue
                words = _HERE.findall(m["name"].lower())
                if not any(w.strip(".") in NOT_STREETS for w in words) and _even_case(m["name"], m["type"]):
                    out.append((m.start(), m.end(), "address"))
        for start, end, _ in at.get("street_start", ()):
            lo, hi = max(0, start - 14), min(len(text), end + 80)
            for form in (_ADDRESS_START, _ADDRESS_NUMBER_LAST):
                m = form.search(text, lo, hi)
                if m and m.start() <= start < m.end():
                    out.append((m.start(), m.end(), "address"))
        for start, end, _ in at.get("street_end", ()):
            lo = max(0, start - 40)
            for m in _ADDRESS_DE.finditer(text, lo, min(len(text), end + 12)):
                if m.start() < end <= m.end():
                    out.append((m.start(), m.end(), "address"))
        return out

    @staticmethod
    def _ids(text: str, anchors) -> list[tuple[int, int, str]]:
        out = []
        for start, end, form in anchors:
            lo, hi = max(0, start - CUE_REACH), min(len(text), end + CUE_REACH)
            for pattern in _ID_FORMS[form]:
                # The number nearest to its cue, and those that stand in a list with it.
                near = min(
                    pattern.finditer(text, lo, hi),
                    key=lambda m: min(abs(m.start() - end), abs(start - m.end())),
                    default=None,
                )
                if near:
                    for a, b in _listed(text, near.start(), near.end(), _ID_FORMS[form]):
                        out.append((a, b, "id_number"))
                    break
        return out

    @staticmethod
    def _phones(text: str, digits: list[int], found) -> list[tuple[int, int, str]]:
        out = []
        for m in _at(_PHONE, text, digits, _SIGN_BEFORE):
            digits = sum(c.isdigit() for c in m[0])
            if 8 <= digits <= 18 and not any(
                a <= m.start() and m.end() <= b for a, b, k in found if k == "id_number"
            ):
                out.append((m.start(), m.end(), "phone"))
        return out

    def _names(self, text, low, at) -> list[tuple[int, int, str]]:
        out = []
        done = -1
        for start, end, _ in at.get("given", ()):
            if start < done or (start and text[start - 1] in "@/.+-_"):
                continue
            given = text[start:end]
            m = _AFTER_GIVEN.match(text, end)
            if m and m["surname"] == "Lane" and _PLACE_BEFORE.search(text, max(0, start - 12), start):
                m = None  # "on Mary Lane"
            if m and is_surname(m["surname"], given, True) and not (m["second"] and m["second"].lower() not in self.given):
                out.append((start, m.end(), "name"))
                done = m.end()
                continue
            rest = _GIVEN_REST.match(text, end)
            before = _BEFORE_COMMA.search(text, max(0, start - 60), start)
            if rest and before and is_surname(before["surname"], given) and len(before["surname"]) > 3:
                if _case(given) == "title" and before["surname"].lower().endswith("ly"):
                    continue
                out.append((before.start(), rest.end(), "name"))
                done = rest.end()
        for start, end, _ in at.get("title", ()):
            title = text[start:end]
            m = _AFTER_TITLE.match(text, end)
            if not m or not is_surname(m["surname"], "X" + title[1:] if title[0].isupper() else title):
                continue
            if title.islower() and title in ("don", "miss", "sr"):
                continue
            if text[start - 1 : start] == "'" or (title.islower() and _case(m["surname"]) != "lower"):
                continue
            out.append((start, m.end(), "name"))
        initials = [start - 1 for start, _, _ in at.get("stop", ()) if start and text[start - 1].isupper()]
        for m in _at(_INITIAL, text, initials):
            if (
                m["initial"].isupper()
                and _case(m["surname"]) == "title"
                and is_surname(m["surname"], "Xx")
                and not _UNIT_BEFORE.search(text, max(0, m.start() - 12), m.start())
            ):
                out.append((m.start(), m.end(), "name"))
        for _, end, _ in at.get("name_cue", ()):
            m = _TWO_NAMES.match(text, end)
            if m and _case(m["given"]) == "title" and m["given"].lower() not in NOT_SURNAMES and _case(m["surname"]) == "title" and is_surname(m["surname"], "Xx"):
                out.append((m.start("given"), m.end(), "name"))
        for start, end, _ in at.get("person", ()):
            # In a text with all words capitalised a capital tells no name.
            m = None if text[start].isupper() else _TWO_NAMES.match(text, end)
            while m and _full_name(m) and not _CAPITAL_NEXT.match(text, m.end()):
                out.append((m.start("given"), m.end(), "name"))
                link = _NEXT_PERSON.match(text, m.end())
                m = link and _TWO_NAMES.match(text, link.end())
        for start, _, _ in at.get("saying", ()):
            m = _NAMES_BEFORE.search(text, max(0, start - 60), start)
            if m and _full_name(m):
                out.append((m.start("given"), m.end("surname"), "name"))
        return out


_CAPITAL_NEXT = re.compile(r"[^\S\n]+[A-ZÀ-Ý]")
_NEXT_PERSON = re.compile(r"(?:,|[^\S\n]+(?:and|or|und|oder|et|ou|y|o))(?=\s)")
_NAMES_BEFORE = re.compile(rf"(?:^|[.!?,;:)\n]\s*|\b[^\W\d_]*[^\W\d_A-ZÀ-Ý]\s+)(?P<given>{_PART}(?:-{_PART})?)(?:{_GAP}[^\W\d_]\.)?{_GAP}(?P<surname>{_PART}(?:-{_PART})*?)(?={_GAP}$|$)")
_PLACE_BEFORE = re.compile(r"(?i)(?:\b(?:on|in|at|off|along|down|up|to|from|near|the|of)|\d)\s+$")
_UNIT_BEFORE = re.compile(r"(?i)\b(?:unit|apt\.?|flat|suite|vitamin|plan|section|type|class|\w\.)\s*$")


def _listed(text: str, start: int, end: int, forms) -> list[tuple[int, int]]:
    """The number at ``start`` and those before and after it in a list, each of one of ``forms``."""
    out = [(start, end)]
    at = end
    while item := next(
        (m for p in forms for m in p.finditer(text, at, at + LIST_REACH) if m.start() < at + LIST_REACH // 2 and _LIST_GAP.fullmatch(text, at, m.start())), None
    ):
        out.append(item.span())
        at = item.end()
    at = start
    while item := next(
        (m for p in forms for m in p.finditer(text, max(0, at - LIST_REACH), at) if _LIST_GAP.fullmatch(text, m.end(), at)), None
    ):
        out.append(item.span())
        at = item.start()
    return out


def _full_name(m: re.Match) -> bool:
    """Whether two words beside a cue are a first name, which need not be listed, and a surname."""
    given, surname = m["given"], m["surname"]
    return (
        _case(given) == _case(surname) == "title"
        and len(given) > 2
        and not any(p in NOT_SURNAMES or p in PLACE_WORDS for p in given.lower().split("-"))
        and is_surname(surname, "Xx")
    )


def _at(form: re.Pattern, text: str, anchors: list[int], lead: re.Pattern | None = None) -> Iterator[re.Match]:
    """Matches of a form that begin at an anchor, or at what may stand before it, without overlaps."""
    done = 0
    for at in anchors:
        if at < done:
            continue
        m = None
        if lead and (before := lead.search(text, max(done, at - LEAD), at)):
            m = form.match(text, before.start())
        m = m or form.match(text, at)
        if m and m.start() >= done:
            yield m
            done = m.end()


def _dashed(number: str) -> bool:
    return number.count("-") == 2


def _insurance_prefix(number: str) -> bool:
    """Whether a national insurance number begins as the public rule has it, or with QQ as in examples.

    D, F, I, Q, U and V are in neither place, O is not in the second, and seven pairs are not given out.
    """
    pair = number[:2].upper()
    if pair == "QQ":
        return True
    if number[:2].islower() and number[2].isspace() and number[:2] in NOT_SURNAMES:
        return False  # "at 10 20 30 a day"
    return not (set(pair) & set("DFIQUV")) and pair[1] != "O" and pair not in NO_PREFIXES


def _even_case(name: str, kind: str) -> bool:
    """Street names and their type are written alike: all capitalised, or none."""
    letters = [w[0] for w in _HERE.findall(name) if w[0].isalpha()]
    caps = sum(c.isupper() for c in letters)
    if kind.islower() and kind not in LOWER_STREET_TYPES:
        return False
    return caps == len(letters) if kind[0].isupper() else caps in (0, len(letters))


def settle(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without overlaps: e-mail, then identity numbers, phones, addresses and names; then the longer."""
    order = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    kept: list[tuple[int, int, str]] = []
    for x in sorted(set(found), key=lambda x: (order[x[2]], x[0] - x[1], x[0])):
        if not any(a < x[1] and x[0] < b for a, b, _ in kept):
            kept.append(x)
    return sorted(kept)


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in found:
        out += (text[at:start], PLACEHOLDERS[kind])
        at = end
    return "".join([*out, text[at:]])


def _mask_fields(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        # Parents are shared by several rows; what a text holds is kept for a while.
        known: dict[str, tuple[str, list[str]]] = {}
        kind_type = pa.list_(pa.string())
        for batch in batches:
            if len(known) > 20_000:
                known.clear()
            cols, names = [batch.column(0)], ["id"]
            for i in range(count):
                masked, kinds = [], []
                for text in batch.column(i + 1).to_pylist():
                    if not text:
                        masked.append(text)
                        kinds.append([])
                        continue
                    got = known.get(text)
                    if got is None:
                        found = finder(text)
                        got = known[text] = (mask(text, found), [k for _, _, k in found])
                    masked.append(got[0])
                    kinds.append(got[1])
                cols += [pa.array(masked, pa.string()), pa.array(kinds, kind_type)]
                names += [f"masked{i}", f"kinds{i}"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def mask_personal(
    df: DataFrame, fields: tuple[str, ...] = ("body", "parent_body"), id_col: str = "sample_id"
) -> DataFrame:
    """``(id, f, f_kinds)`` for each field ``f``: the text with placeholders and
    the kinds of its mentions in order.

    A null text stays null and an empty one empty, both without mentions.
    Texts are read whole, in one pass and without a shuffle. Rows repeat as
    they come; other columns are not read, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f) for f in fields])
    schema = "id long" + "".join(
        f", masked{i} string, kinds{i} array<string>" for i in range(len(fields))
    )
    got = rows.mapInArrow(_mask_fields(len(fields)), schema)
    return got.select(
        "id",
        *[c for i, f in enumerate(fields) for c in (F.col(f"masked{i}").alias(f), F.col(f"kinds{i}").alias(f"{f}_kinds"))],
    )


def mentions(masked: DataFrame, fields: tuple[str, ...] = ("body", "parent_body")) -> DataFrame:
    """``(id, field, kind, n)``: how often each kind is mentioned in each field of a row."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_kinds").alias("kinds")) for f in fields])
    return (
        masked.select("id", F.inline(each))
        .select("id", "field", F.explode("kinds").alias("kind"))
        .groupBy("id", "field", "kind")
        .agg(F.count("*").alias("n"))
    )
