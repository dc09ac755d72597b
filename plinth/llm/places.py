"""Place names as typed: one normal form across scripts, abbreviations, joined words and word order.

``place_tokens`` turns a typed place into tokens: ``sector 77a`` and ``phase 2`` become single tokens carrying
their number, kind words (nagar, vihar, road, homes ...) their full spelling, and every other word a phonetic form
in which the usual transliteration variants agree.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Devanagari letters in the Latin spelling used for place names.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh",
    "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l",
    "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "क़": "k", "ज़": "z", "ड़": "d", "ढ़": "dh", "फ़": "f",
}
VOWELS = {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ए": "e", "ऐ": "e", "ओ": "o", "औ": "o", "ऑ": "o", "ऍ": "e"}
SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "े": "e", "ै": "e", "ो": "o", "ौ": "o", "ॉ": "o", "ॅ": "e", "ृ": "ri"}

# Kind words and how they are abbreviated or written.
LOCALITY_KINDS = {
    "nagar": "nagar ngr nagr ngar नगर", "vihar": "vihar vhr vihr wihar विहार", "puram": "puram purm prm pooram puraam पुरम पुरम्", "ganj": "ganj gnj gunj gajn गंज गञ्ज",
    "garden": "garden gardens gdn gdns grdn grdns gardn graden gadren ganden गार्डन", "enclave": "enclave encl enclv enclave. ecnlave encalve एन्क्लेव एनक्लेव", "extension": "extension extn exten ext extention एक्सटेंशन एक्सटेन्शन",
    "colony": "colony col colny clny cly kolony coloni कॉलोनी कालोनी", "township": "township twp twnshp tship twnship townshp towship twship टाउनशिप", "kunj": "kunj knj kunjj कुंज कुन्ज", "bagh": "bagh bag baagh baag bgh बाग", "khurd": "khurd khrd khurdh khuurd khud खुर्द",
}
STREET_KINDS = {
    "homes": "homes home hms", "heights": "heights hts hgts hghts height", "apartments": "apartments apartment apts apt appts aptmts apartmnts", "residency": "residency resi resdy resdcy residancy rsdncy residencey", "greens": "greens grns green grn", "meadows": "meadows mdws meadow meadws",
    "court": "court crt ct courtt", "manor": "manor mnr manour manr", "terraces": "terraces terr terrace trcs terrs", "towers": "towers tower twrs twrss", "floors": "floors flrs floor flr", "habitat": "habitat hab habitt hbt", "crescent": "crescent cres cresc crsnt crescnt",
    "road": "road rd raod", "street": "street str st", "lane": "lane ln", "gali": "gali gali gly galli galy", "marg": "marg mrg maarg", "path": "path pathh paath pth", "avenue": "avenue ave av avn avenu",
}
_KIND = {w: k for table in (LOCALITY_KINDS, STREET_KINDS) for k, ws in table.items() for w in ws.split()}
#: Words that carry no part of a place's name.
STOP = frozenset("near opp opposite main behind beside next to the of new distt dist district city urban rural india no number at in ke paas adjacent above facing".split())
BLANK = frozenset(["", "nan", "none", "null", "na", "-"])

def _one_off(word: str) -> set[str]:
    """What one deletion leaves of a word, and the word."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


_NEAR_KIND: dict[str, set[str]] = {}
for _k in LOCALITY_KINDS:
    if len(_k) >= 5:
        for _v in _one_off(_k):
            _NEAR_KIND.setdefault(_v, set()).add(_k)
_ANAGRAM = {(k[0], "".join(sorted(k))): k for k in LOCALITY_KINDS}


@lru_cache(maxsize=200_000)
def near_kind(word: str) -> str | None:
    """The locality kind that a word misspells: its letters in another order, or one edit for kinds of five letters or more."""
    if not 4 <= len(word) <= 11:
        return None
    if (k := _ANAGRAM.get((word[0], "".join(sorted(word))))) is not None:
        return k
    for v in _one_off(word):
        for k in _NEAR_KIND.get(v, ()):
            n, m = len(word), len(k)
            if abs(n - m) <= 1 and word[0] == k[0] and (sum(a != b for a, b in zip(word, k)) == 1 if n == m else (word in _one_off(k) if n < m else k in _one_off(word))):
                return k
    return None


#: How a kind word may end a word typed without its space, longest first: mapanekugnj, pikanaencl.
_ENDINGS = sorted(((w, k) for k, ws in LOCALITY_KINDS.items() for w in ws.split() if w.isascii() and w.isalpha() and len(w) >= 3), key=lambda x: (-len(x[0]), x[0]))


def split_kind(word: str) -> tuple[str, ...]:
    """A joined word as its name and kind; a word without a kind's ending as it is. The name keeps four letters at least."""
    for w, k in _ENDINGS:
        if len(word) >= len(w) + 4 and word.endswith(w):
            return word[: -len(w)], k
    return (word,)


_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}


@lru_cache(maxsize=200_000)
def latin(text: str) -> str:
    """``text`` with Devanagari words transliterated; other characters as they are."""
    out, word = [], []
    t = unicodedata.normalize("NFC", text)
    i, n = 0, len(t)
    while i < n:
        c = t[i]
        pair = t[i : i + 2]
        if pair in CONSONANTS or c in CONSONANTS:
            k = pair if pair in CONSONANTS else c
            i += len(k)
            if i < n and t[i] == "़":
                i += 1
            word.append(CONSONANTS[k])
            if i < n and t[i] in SIGNS:
                word.append(SIGNS[t[i]])
                i += 1
            elif i < n and t[i] == "्":
                i += 1
            elif i < n and (t[i] in CONSONANTS or t[i] in "ंँःव"):
                word.append("a")  # the last consonant of a word has no inherent vowel
            continue
        if c in VOWELS:
            word.append(VOWELS[c])
        elif c in "ंँ":
            word.append("n")
        elif c in "ः़ॐ‌‍":
            pass
        elif "०" <= c <= "९":
            word.append(str(ord(c) - ord("०")))
        else:
            out += word
            word = []
            out.append(c)
        i += 1
    return "".join(out + word)


@lru_cache(maxsize=400_000)
def phonetic(word: str) -> str:
    """One spelling for the transliteration variants of a word: Meetunobagh, Mitunobag."""
    w = word
    for a, b in (("ee", "i"), ("oo", "u"), ("ai", "e"), ("ei", "e"), ("ou", "o"), ("au", "o"), ("w", "v"), ("ck", "k"), ("q", "k"), ("z", "j"), ("y", "i")):
        w = w.replace(a, b)
    w = re.sub(r"c(?!h)", "k", w)
    return re.sub(r"(.)\1+", r"\1", w)


def kind_of(word: str) -> str | None:
    return _KIND.get(word)


_SECTOR = re.compile(r"s[ec]{1,2}c?t?[eo]?r?s?|sec|sect|sekt[ao]?r|setcor|setor|sctor|secotr|scetor|sectr")
_WORD = re.compile(r"[a-zऀ-ॿ]+|\d+")


@lru_cache(maxsize=400_000)
def place_tokens(text: str | None) -> tuple[str, ...]:
    """Tokens of a typed place. Null, blank and words for null give none. Order is kept; repeats too."""
    if text is None:
        return ()
    t = text.strip().lower()
    if t in BLANK:
        return ()
    # kind words in the other script first: their own letters would lose a vowel
    words = []
    for w in re.sub(r"['’`]", "", t.replace("_", " ")).replace("t ship", "tship").split():
        for p in re.findall(r"[a-z]+|[ऀ-ॿ]+|\d+", w):
            if p[0] > "z":
                k = kind_of(p)
                words.append(k if k else "sector" if p.startswith(("सेक्टर", "सैक्टर")) else "phase" if p in ("फेज", "फेस", "चरण", "फेज़") else latin(p))
            else:
                words.append(p)
    out: list[str] = []
    i = 0
    while i < len(words):
        w = words[i]
        nxt = words[i + 1] if i + 1 < len(words) else ""
        if w.isdigit():
            # 2nd phase; 76 sector; 1st
            if nxt in ("st", "nd", "rd", "th") and i + 2 < len(words) and words[i + 2].startswith("ph"):
                out.append(f"phase {int(w)}")
                i += 3
                continue
            suffix = nxt if len(nxt) == 1 and nxt.isalpha() else ""
            after = words[i + 1 + bool(suffix)] if i + 1 + bool(suffix) < len(words) else ""
            if after and _SECTOR.fullmatch(after):
                out.append(f"sector {int(w)}{suffix}")
                i += 2 + bool(suffix)
                continue
            out.append(w)
            i += 1
            continue
        if _SECTOR.fullmatch(w):
            j = i + 1
            while j < len(words) and words[j] in ("no", "number"):
                j += 1
            if j < len(words) and words[j].isdigit():
                suffix = words[j + 1] if j + 1 < len(words) and len(words[j + 1]) == 1 and words[j + 1].isalpha() else ""
                out.append(f"sector {int(words[j])}{suffix}")
                i = j + 1 + bool(suffix)
                continue
        if re.fullmatch(r"ph|phase|phas|phse|pahse|phaes|fase|phs|phaase|phasse|pase", w) and (nxt.isdigit() or nxt in _ROMAN):
            out.append(f"phase {int(nxt) if nxt.isdigit() else _ROMAN[nxt]}")
            i += 2
            continue
        if w in STOP:
            i += 1
            continue
        if len(w) > 1 or w in ("a",):
            if k := kind_of(w) or (near_kind(w) if out else None):  # a place does not begin with its kind
                out.append(k)
            else:
                name, *kind = split_kind(w)
                out += [phonetic(name), *kind]
        i += 1
    return tuple(out)


@lru_cache(maxsize=400_000)
def plain_words(text: str | None) -> tuple[str, ...]:
    """The words of a typed place as they stand, doubled letters once, where that differs from their phonetic form: a missing letter can bring two vowels
    together that the phonetic form would then take for one."""
    if text is None:
        return ()
    out = []
    for w in re.findall(r"[a-z]{4,64}", text.lower()):
        if w in STOP or kind_of(w):
            continue
        name = re.sub(r"(.)\1+", r"\1", split_kind(w)[0])
        if name != phonetic(split_kind(w)[0]) and len(name) >= 4:
            out.append(name)
    return tuple(dict.fromkeys(out))
