"""Reading names, firms, phone lines and mailboxes as people type them. Plain Python; the operators run it on distinct strings in batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Results that each look-up remembers; a worker lives long, and several of them share the memory of an executor.
CACHE = 20_000

#: Letters that decompose to no base letter (fixed values).
_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ı": "i", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "’": "'", "‘": "'"})

#: Titles, degrees and the like around names (fixed values).
HONORIFICS = frozenset("mr mrs ms miss mx dr prof ing dipl sir dame rev jr sr ii iii iv phd mba pmp md esq msc bsc ma cpa pe they them she her he him".split())

#: Short forms that aren't the beginning of the full name -> full names, in plain letters (fixed values of general knowledge).
NICKNAMES: dict[str, tuple[str, ...]] = {
    "abby": ("abigail",), "aga": ("agnieszka",), "agi": ("agnes",), "andi": ("andre", "andrea"), "andy": ("andrew",), "anju": ("anjali",), "bas": ("sebastian",), "becca": ("rebecca",), "becky": ("rebecca",), "bella": ("isabella", "gabriella"),
    "benny": ("benjamin",), "bess": ("elizabeth",), "beth": ("elizabeth",), "bia": ("beatriz",), "bill": ("william",), "billy": ("william",), "bob": ("robert",), "cassie": ("cassandra",), "cesca": ("francesca",), "charlie": ("charlotte", "charles"),
    "danny": ("daniel",), "debbie": ("deborah",), "dima": ("dimitri",), "drew": ("andrew",), "ella": ("gabriella", "isabella"), "frankie": ("francesca",), "franz": ("francois", "francis"), "freddie": ("frederick",), "gabi": ("gabriella",), "geoff": ("geoffrey",), "grisha": ("grigori",),
    "hattie": ("harriet",), "ify": ("ifeoma",), "izzy": ("isabella",), "jack": ("john",), "jenny": ("jennifer",), "jim": ("james",), "jo": ("josephine",), "joaco": ("joaquin",), "joe": ("yusuf", "joseph"), "jonny": ("jonathan",), "josie": ("josephine",), "kate": ("katherine",),
    "kathy": ("katherine",), "katie": ("katherine",), "kit": ("katherine", "christopher"), "kuba": ("jakub",), "larry": ("lawrence",), "laurie": ("lawrence",), "len": ("leonard",), "liz": ("elizabeth",), "lottie": ("charlotte",), "lucy": ("lucia",), "lukaszek": ("lukasz",), "maddy": ("madeleine",), "maggie": ("margaret",),
    "meg": ("margaret",), "mick": ("michael",), "mike": ("michael",), "nastya": ("anastasia",), "nate": ("nathaniel",), "ned": ("edward",), "nee": ("renee",), "nick": ("nicholas",), "nico": ("nicholas",), "niko": ("nikolai", "nicholas"), "ollie": ("oliver",), "peggy": ("margaret",), "penny": ("penelope",), "pepe": ("jose",),
    "pip": ("philippa",), "pippa": ("philippa",), "renzo": ("lorenzo",), "sammy": ("samantha",), "sasha": ("alexander",), "steve": ("stephen",), "sue": ("susannah",), "susie": ("susannah",), "tabby": ("tabitha",), "ted": ("theodore", "edward"), "teus": ("mateus",), "tony": ("anthony",), "tori": ("victoria",), "trish": ("patricia",),
    "uschi": ("ursula",), "vicky": ("victoria",), "vik": ("vikram",), "winnie": ("winifred",), "zhenya": ("yevgenia",), "zoli": ("zoltan",), "marti": ("marta",), "aggie": ("agnes",), "dickie": ("richard",), "dick": ("richard",), "rick": ("richard",), "harry": ("henry", "harriet"), "nell": ("eleanor",), "sandy": ("alexander",),
}


def plain(text: str) -> str:
    """Text without accents, in lower case."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_LETTERS)) if not unicodedata.combining(c)).lower()


class Name(NamedTuple):
    given: str  # may be one letter, or empty
    surname: str
    short: str  # a nickname given beside the name


_QUOTED = re.compile(r"[“\"(«']\s*([^”\")»']+?)\s*[”\")»']")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


@lru_cache(maxsize=CACHE)
def parse_name(text: str | None, givens: frozenset[str] = frozenset()) -> Name | None:
    """Given name and surname of a name as typed; null if there aren't two words, or for a mailbox.

    ``givens`` are given names that are known to be common, and their beginnings; they tell "Surname Given" from "Given Surname".
    """
    if not text or "@" in text:
        return None
    short = ""
    m = _QUOTED.search(text)
    if m:
        inner = plain(m[1])
        short = inner if inner not in HONORIFICS else ""
        text = text[: m.start()] + " " + text[m.end() :]
    head, comma, tail = text.partition(",")
    left, right = _words(head), [w for w in _words(tail) if plain(w) not in HONORIFICS]
    if comma and right and left:
        order = [*right, *left]  # "Surname, Given M."
        given, surname = right[0], "".join(left)
    else:
        order = left
        if len(order) == 1:
            order = _camel(order[0])
        if len(order) < 2:
            return None
        first, last = plain(order[0]), plain(order[-1])
        turned = (last in givens or last in NICKNAMES) and not (first in givens or first in NICKNAMES or len(first) == 1) and len(order) == 2
        if turned or order[0].isupper() and len(order[0]) > 1 and not order[-1].isupper() and len(order[-1]) > 1:
            given, surname = order[-1], "".join(order[:-1])  # "SURNAME Given"
        else:
            given, rest = order[0], order[1:]
            while len(rest) > 1 and len(rest[0]) == 1:  # middle initials
                rest = rest[1:]
            while len(rest) > 1 and len(rest[-1]) == 1:
                rest = rest[:-1]
            surname = "".join(rest)
    g, s = plain(given), re.sub(r"[^a-z]", "", plain(surname)) or plain(surname)
    return Name(g, s, short) if g and s and len(s) > 1 else None


def _words(text: str) -> list[str]:
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    found = [(m[0], text[m.end() : m.end() + 1]) for m in _WORD.finditer(text)]
    out = []
    for k, (w, after) in enumerate(found):
        p = plain(w)
        if p in HONORIFICS and (after == "." or p != "ing" and (k == 0 or k == len(found) - 1 or w.isupper()) and len(found) > 2):
            continue
        out.append(w)
    return out


def _camel(word: str) -> list[str]:
    for i in range(2, len(word) - 1):
        if word[i].isupper() and word[i - 1].islower():
            return [word[:i], word[i:]]
    return [word]


@lru_cache(maxsize=CACHE)
def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring swaps, within a band of ``most``; ``most + 1`` if it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    prev2: list[int] = []
    prev = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        lo, hi = max(1, i - most), min(len(b), i + most)
        for j in range(lo, hi + 1):
            cost = prev[j - 1] + (a[i - 1] != b[j - 1])
            cost = min(cost, prev[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, prev2[j - 2] + 1)
            row[j] = min(cost, far)
        if min(row) > most:
            return far
        prev2, prev = prev, row
    return prev[-1]


def full_names(given: str) -> tuple[str, ...]:
    return NICKNAMES.get(given, ())


@lru_cache(maxsize=CACHE)
def given_likeness(a: str, b: str) -> float:
    """1 for the same given name or a short form of it, less for a slip, 0.5 for an initial, 0 for different names."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] or any(f[0] == b[0] for f in full_names(a)) or any(f[0] == a[0] for f in full_names(b)) else 0.0
    fa, fb = {a, *full_names(a)}, {b, *full_names(b)}
    if fa & fb:
        return 1.0
    if any(len(x) > 1 and len(y) > 2 and y.startswith(x) for x in fa for y in fb) or any(len(y) > 1 and len(x) > 2 and x.startswith(y) for x in fa for y in fb):
        return 0.9
    if any(edits(x, y, 1) <= 1 and max(len(x), len(y)) > 2 for x in fa for y in fb):
        return 0.85
    if min(len(a), len(b)) > 5 and edits(a, b, 2) <= 2:
        return 0.7
    return 0.0


@lru_cache(maxsize=CACHE)
def surname_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a[0] != b[0]:  # slips hardly ever hit the first letter, other names often differ in it
        return 0.0
    if min(len(a), len(b)) > 3 and edits(a, b, 1) <= 1:
        return 0.9
    if min(len(a), len(b)) > 6 and edits(a, b, 2) <= 2:
        return 0.7
    return 0.0


def name_likeness(a: Name, b: Name) -> float:
    """Product of the parts; 0 unless both fit."""
    s = surname_likeness(a.surname, b.surname)
    if not s:
        return 0.0
    return s * max(given_likeness(x, y) for x in (a.given, a.short) for y in (b.given, b.short) if x and y)


def phone_key(text: str | None) -> str | None:
    """Ten digits of a line, without country code and extension; null for anything incomplete or made of one digit."""
    if not text:
        return None
    body = re.split(r"(?i)\s*(?:x|ext\.?|#)\s*\d+\s*$", text)[0]
    d = re.sub(r"\D", "", body)
    if d.startswith("00"):
        d = d[2:]
    if len(d) == 11 and d[0] == "1":
        d = d[1:]
    return d if len(d) == 10 and len(set(d)) > 1 else None


#: Host names end in one of these.
_TLD = r"(?:example|test|com|org|net|edu|gov|info|biz|io|co|[a-z]{2})"


def mail_parts(text: str | None) -> tuple[str, str] | None:
    """Local part without tag and host name of a mailbox as typed; the host is '' if it can't be told, null if there is no local part."""
    if not text:
        return None
    t = text.strip().strip(";,<>()").lower().replace(" at ", "@")
    t = re.sub(r"\s+", "", re.sub(r"@+", "@", t))
    if t in ("", "n/a", "na", "none", "null", "-", "ask", "see cv", "seecv", "unknown"):
        return None
    local, at, host = t.partition("@")
    local = local.partition("+")[0]
    if not local:
        return None
    return local, (host if at else "")


#: Words of mailboxes that name nobody (fixed values).
SHARED_BOX = frozenset("family info jobs office team contact hr mail home admin recruiting careers the".split())


@lru_cache(maxsize=CACHE)
def box_names(local: str, person: Name) -> float:
    """How far the local part of a mailbox names a person: 1 for given name and surname, 0.9 with slips, 0.8 for surname and initial, else 0."""
    tokens = [w for w in re.findall(r"[a-z]+", plain(local)) if w not in SHARED_BOX]
    t, s = "".join(tokens), person.surname
    best = 0.0
    for g in {person.given, person.short, *full_names(person.given)} - {""}:
        for part, value in ((g, 1.0 if len(g) > 1 else 0.8), (g[0], 0.8)):
            for rest in (t[len(part) :] if t.startswith(part) else "", t[: -len(part)] if t.endswith(part) else ""):
                if len(rest) > 3 and surname_likeness(rest, s) > 0:
                    best = max(best, value)
        if best < 0.9 and len(g) > 1 and len(g + s) > 7 and any(w[0] == t[:1] and edits(t, w, 2) <= 2 for w in (g + s, s + g)):
            best = 0.9
    if best < 0.9 and len(tokens) == 2:
        for a, b in (tokens, tokens[::-1]):
            if len(b) > 3 and surname_likeness(b, s) > 0 and (like := given_likeness(a, person.given)) > 0:
                best = max(best, 0.9 if like > 0.5 else 0.8)
    if not best and len(person.given) == 1 and s in t and len(s) > 3 and (t.startswith(person.given) or t.endswith(person.given) or t.replace(s, "", 1)[:1] == person.given):
        best = 0.8
    return best


#: Words that stand in for an employer (fixed values).
NO_FIRM = frozenset(["", "freelance", "freelancer", "self employed", "selfemployed", "n a", "na", "none", "unemployed", "null", "nan", "unknown", "student", "retired", "tbd", "between jobs", "independent", "contractor", "see cv"])
#: Legal forms (fixed values).
LEGAL = frozenset("ltd limited llc inc incorporated corp corporation gmbh ag plc co company sa srl bv nv oy ab kg llp lp pty".split())
#: Short forms of words in firms' names (fixed values).
FIRM_WORDS = {"sw": "software", "ins": "insurance", "log": "logistics", "hlth": "health", "analyt": "analytics", "grp": "group", "tech": "technologies", "sys": "systems", "svcs": "services", "svc": "services", "serv": "services", "intl": "international", "mfg": "manufacturing", "cons": "consulting", "hldgs": "holdings", "eng": "engineering", "mgmt": "management", "n": "northern"}


#: One spelling for each legal form that has several (fixed values).
_LEGAL_FORM = {"limited": "ltd", "incorporated": "inc", "corporation": "corp"}


def legal_form(text: str) -> str:
    """Legal form in a firm's name as typed, or ''."""
    whole = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m[0].replace(".", ""), text)
    found = [w for w in (plain(x) for x in re.findall(r"[^\W_]+", whole)) if w in LEGAL and w not in ("company", "co")]
    return _LEGAL_FORM.get(found[-1], found[-1]) if found else ""


class Firm(NamedTuple):
    words: tuple[str, ...]  # in the order of the full name, root first
    acronym: str  # not empty if only an acronym is given


@lru_cache(maxsize=CACHE)
def parse_firm(text: str | None) -> Firm | None:
    """Words of a firm's name without legal form, article and punctuation; null for placeholders. One joined word is given as it is."""
    if text is None:
        return None
    t = text.strip()
    if plain(re.sub(r"[\W_]+", " ", t)).strip() in NO_FIRM:
        return None
    whole = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m[0].replace(".", ""), t)  # "A.G."
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"(?<![A-Z])G[mM][bB]H\b", " gmbh", whole))
    raw = re.findall(r"[^\W_]+", spaced)
    head, comma, tail = spaced.partition(",")
    tail_words = [plain(w) for w in re.findall(r"[^\W_]+", tail)]
    if comma and any(w not in LEGAL for w in tail_words):  # "Freight Systems, Marrowick Northern"
        raw = re.findall(r"[^\W_]+", tail) + re.findall(r"[^\W_]+", head)
    words = [plain(w) for w in raw]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    body = [w for w in words if w not in LEGAL]
    caps = [w for w in raw if plain(w) not in LEGAL]
    if len(body) == 1 and caps[0].isupper() and 2 <= len(body[0]) <= 5:
        return Firm((), body[0])
    body = [FIRM_WORDS.get(w, w) if k else w for k, w in enumerate(body)]
    return Firm(tuple(body), "") if body else None


def acronyms(words: tuple[str, ...]) -> set[str]:
    """Acronyms that a firm's name may be given as: all initials, or two letters of the first word and the initials of the rest."""
    if len(words) < 2:
        return set()
    rest = "".join(w[0] for w in words[1:])
    return {words[0][0] + rest, words[0][:2] + rest}


@lru_cache(maxsize=CACHE)
def firm_likeness(a: Firm, b: Firm) -> float:
    """1 for the same words, 0.9 for slips in them, 0.6 for an acronym, 0 for different firms."""
    if a.acronym or b.acronym:
        if a.acronym and b.acronym:
            return 1.0 if a.acronym == b.acronym else 0.0
        return 0.6 if (a.acronym or b.acronym) in acronyms(b.words if a.acronym else a.words) else 0.0
    if a.words == b.words:
        return 1.0
    ja, jb = "".join(a.words), "".join(b.words)
    if ja == jb:
        return 1.0
    # each word may have a slip or be cut short, but words of different trades are different firms
    if len(a.words) == len(b.words):
        off = 0
        for x, y in zip(a.words, b.words, strict=True):
            if x != y:
                off += edits(x, y, 2) if min(len(x), len(y)) > 2 else 9
        return 0.9 if off <= 2 else 0.0
    return 0.9 if min(len(ja), len(jb)) > 7 and edits(ja, jb, 2) <= 2 else 0.0
