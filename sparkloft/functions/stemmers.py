"""Stemmers of German, French and Spanish: the published Snowball algorithms as tables of endings with conditions.

A rule is (endings, condition, replacement); of all rules of a table the longest ending that a word has decides, and only that one is tried.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

Rule = tuple[str, Callable[["Word", int], bool], str]


@dataclass
class Word:
    """A word with the places where its regions begin."""

    text: str
    r1: int
    r2: int
    rv: int = 0

    def put(self, at: int, new: str = "") -> bool:
        self.text = self.text[:at] + new
        return True

    def before(self, at: int, *endings: str) -> str | None:
        """The longest of some endings that the text before ``at`` has."""
        return max((e for e in endings if self.text.endswith(e, 0, at)), key=len, default=None)

    def cut(self, endings: str, start: int, new: str = "") -> bool:
        """Replaces the longest of some endings if it begins at ``start`` or later; whether it did."""
        found = self.before(len(self.text), *endings.split())
        at = len(self.text) - len(found or "")
        return found is not None and at >= start and self.put(at, new)

    def apply(self, rules: list[Rule]) -> str | None:
        """The ending that the rules' longest match took off or replaced; None if there is none or its condition fails."""
        best = max((e for endings, _, _ in rules for e in endings.split() if self.text.endswith(e)), key=len, default=None)
        if best is None:
            return None
        at = len(self.text) - len(best)
        for endings, condition, new in rules:
            if best in endings.split() and condition(self, at):
                self.put(at, new)
                return best
        return None


def in_r1(w: Word, at: int) -> bool:
    return at >= w.r1


def in_r2(w: Word, at: int) -> bool:
    return at >= w.r2


def in_rv(w: Word, at: int) -> bool:
    return at >= w.rv


def _after(text: str, vowels: str, start: int) -> int:
    """Behind the first consonant that follows a vowel."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(text, start)
    return m.end() if m else len(text)


# German: fixed tables of the published algorithm.
_DE = "aeiouyäöü"
_DE_1: list[Rule] = [
    ("em ern er", in_r1, ""),
    ("e en es", in_r1, ""),
    ("s", lambda w, at: at >= w.r1 and w.text[at - 1 : at] in tuple("bdfghklmnrt"), ""),
]
_DE_2: list[Rule] = [
    ("en er est", in_r1, ""),
    ("st", lambda w, at: at >= w.r1 and at > 3 and w.text[at - 1 : at] in tuple("bdfghklmnt"), ""),
]
_DE_3: list[Rule] = [
    ("end ung", in_r2, ""),
    ("ig ik isch", lambda w, at: at >= w.r2 and w.text[at - 1 : at] != "e", ""),
    ("lich heit", in_r2, ""),
    ("keit", in_r2, ""),
]


@functools.lru_cache(maxsize=100_000)
def stem_german(word: str) -> str:
    """Stem of a lower-cased German word."""
    text = word.replace("ß", "ss")
    text = re.sub(rf"(?<=[{_DE}])[uy](?=[{_DE}])", lambda m: m[0].upper(), text)
    r1 = _after(text, _DE, 0)
    w = Word(text, max(r1, 3), _after(text, _DE, r1))
    if w.apply(_DE_1) in ("e", "en", "es") and w.text.endswith("niss"):
        w.text = w.text[:-1]
    w.apply(_DE_2)
    ending = w.apply(_DE_3)
    if ending in ("end", "ung"):
        if w.text.endswith("ig") and not w.text.endswith("eig"):
            w.cut("ig", w.r2)
    elif ending in ("lich", "heit"):
        w.cut("er en", w.r1)
    elif ending == "keit":
        w.cut("lich ig", w.r2)
    return w.text.lower().translate(str.maketrans("äöü", "aou"))


# Spanish: fixed tables of the published algorithm.
_ES = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_1: list[Rule] = [
    ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", in_r2, ""),
    ("adora ador ación adoras adores aciones acion ante antes ancia ancias", in_r2, ""),
    ("logía logías", in_r2, "log"),
    ("ución uciones", in_r2, "u"),
    ("encia encias", in_r2, "ente"),
    ("amente", in_r1, ""),
    ("mente", in_r2, ""),
    ("idad idades", in_r2, ""),
    ("iva ivo ivas ivos", in_r2, ""),
]
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_ES_2: list[Rule] = [
    ("en es éis emos", in_rv, ""),
    (
        "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
        "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran "
        "ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
        "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos",
        in_rv,
        "",
    ),
]


def _spanish_rv(text: str) -> int:
    if len(text) < 3:
        return len(text)
    if text[1] not in _ES:
        kind = f"[{_ES}]"
    elif text[0] in _ES:
        kind = f"[^{_ES}]"
    else:
        return 3
    m = re.compile(kind).search(text, 2)
    return m.end() if m else len(text)


def _spanish_pronoun(w: Word) -> None:
    found = w.before(len(w.text), *_ES_PRONOUNS)
    if found is None or len(w.text) - len(found) < w.rv:
        return
    at = len(w.text) - len(found)
    verb = w.before(at, "iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo")
    if verb is None or at - len(verb) < w.rv or verb == "yendo" and not w.text.endswith("uyendo", 0, at):
        return
    w.put(at - len(verb), verb.translate(_ES_PLAIN))


@functools.lru_cache(maxsize=100_000)
def stem_spanish(word: str) -> str:
    """Stem of a lower-cased Spanish word."""
    r1 = _after(word, _ES, 0)
    w = Word(word, r1, _after(word, _ES, r1), _spanish_rv(word))
    _spanish_pronoun(w)
    ending = w.apply(_ES_1)
    if ending in "adora ador ación adoras adores aciones acion ante antes ancia ancias".split():
        w.cut("ic", w.r2)
    elif ending == "amente":
        if w.cut("iv", w.r2):
            w.cut("at", w.r2)
        elif not w.text.endswith("iv"):
            w.cut("os ic ad", w.r2)
    elif ending == "mente":
        w.cut("ante able ible", w.r2)
    elif ending in ("idad", "idades"):
        w.cut("abil ic iv", w.r2)
    elif ending in ("iva", "ivo", "ivas", "ivos"):
        w.cut("at", w.r2)
    if ending is None:
        y = w.before(len(w.text), *_ES_Y.split())
        if y and len(w.text) - len(y) >= w.rv and w.text.endswith("u" + y):
            w.put(len(w.text) - len(y))
        else:
            verb = _in_region(w, _ES_2)
            if verb in ("en", "es", "éis", "emos") and w.text.endswith("gu"):
                w.text = w.text[:-1]
    last = w.apply([("os a o á í ó", in_rv, ""), ("e é", in_rv, "")])
    if last in ("e", "é") and w.text.endswith("gu") and len(w.text) - 1 >= w.rv:
        w.text = w.text[:-1]
    return w.text.translate(_ES_PLAIN)


def _in_region(w: Word, rules: list[Rule]) -> str | None:
    """As ``apply``, but only the part from rv on is looked at: the longest ending that fits into it decides."""
    kept, w.text = w.text[: w.rv], w.text[w.rv :]
    start, w.rv = w.rv, 0
    found = w.apply(rules)
    w.text, w.rv = kept + w.text, start
    return found


# French: fixed tables of the published algorithm.
_FR = "aeiouyâàëéêèïîôûù"
_FR_1: list[Rule] = [
    ("ance iqUe isme able iste eux ances iqUes ismes ables istes", in_r2, ""),
    ("atrice ateur ation atrices ateurs ations", in_r2, ""),
    ("logie logies", in_r2, "log"),
    ("usion ution usions utions", in_r2, "u"),
    ("ence ences", in_r2, "ent"),
    ("ement ements", in_rv, ""),
    ("ité ités", in_r2, ""),
    ("if ive ifs ives", in_r2, ""),
    ("eaux", lambda w, at: True, "eau"),
    ("aux", in_r1, "al"),
    ("euse euses", in_r2, ""),
    ("euse euses", in_r1, "eux"),
    ("issement issements", lambda w, at: at >= w.r1 and w.text[at - 1 : at] not in tuple(_FR), ""),
    ("amment", in_rv, "ant"),
    ("emment", in_rv, "ent"),
    ("ment ments", lambda w, at: at - 1 >= w.rv and w.text[at - 1 : at] in tuple(_FR), ""),
]
_FR_I: list[Rule] = [
    (
        "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
        "issantes issants isse issent isses issez issiez issions issons it",
        lambda w, at: at >= 1 and w.text[at - 1] not in _FR,
        "",
    )
]
_FR_2: list[Rule] = [
    ("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez", in_rv, ""),
    ("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions", in_rv, ""),
]


def _french_rv(text: str) -> int:
    if text[:1] in tuple(_FR) and text[1:2] in tuple(_FR) or text.startswith(("par", "col", "tap")):
        return min(3, len(text))
    m = re.compile(f"[{_FR}]").search(text, 1)
    return m.end() if m else len(text)


def _french_rest(w: Word, ending: str) -> None:
    """What the standard endings ask for of the text before them."""
    if ending in "atrice ateur ation atrices ateurs ations".split():
        _ = w.cut("ic", w.r2) or w.cut("ic", 0, "iqU")
    elif ending in ("ement", "ements"):
        if w.text.endswith("iv"):
            if w.cut("iv", w.r2):
                w.cut("at", w.r2)
        elif w.text.endswith("eus"):
            _ = w.cut("eus", w.r2) or w.cut("eus", w.r1, "eux")
        elif w.text.endswith(("abl", "iqU")):
            w.cut("abl iqU", w.r2)
        else:
            w.cut("ièr Ièr", w.rv, "i")
    elif ending in ("ité", "ités"):
        if w.text.endswith("abil"):
            _ = w.cut("abil", w.r2) or w.cut("abil", 0, "abl")
        elif w.text.endswith("ic"):
            _ = w.cut("ic", w.r2) or w.cut("ic", 0, "iqU")
        else:
            w.cut("iv", w.r2)
    elif ending in ("if", "ive", "ifs", "ives") and w.cut("at", w.r2):
        _ = w.cut("ic", w.r2) or w.cut("ic", 0, "iqU")


@functools.lru_cache(maxsize=100_000)
def stem_french(word: str) -> str:
    """Stem of a lower-cased French word."""
    text = re.sub(rf"(?<=[{_FR}])[ui](?=[{_FR}])|(?<=q)u|(?<=[{_FR}])y|y(?=[{_FR}])", lambda m: m[0].upper(), word)
    r1 = _after(text, _FR, 0)
    w = Word(text, r1, _after(text, _FR, r1), _french_rv(text))
    ending = w.apply(_FR_1)
    changed = ending is not None
    if ending:
        _french_rest(w, ending)
    if ending is None or ending in ("amment", "emment", "ment", "ments"):
        kept = w.text
        if _in_region(w, _FR_I) is None:
            if w.text.endswith("ions") and len(w.text) - 4 >= w.rv:
                w.cut("ions", w.r2)
            else:
                verb = _in_region(w, _FR_2)
                if verb in _FR_2[1][0].split():
                    w.cut("e", w.rv)
        changed = changed or w.text != kept
    if changed:
        w.text = re.sub("Y$", "i", re.sub("ç$", "c", w.text))
    else:
        if re.search("[^aiouès]s$", w.text):
            w.text = w.text[:-1]
        last = w.before(len(w.text), "ion", "ier", "ière", "Ier", "Ière", "e")
        at = len(w.text) - len(last or "")
        if last and at >= w.rv:
            if last == "ion":
                if at >= w.r2 and at - 1 >= w.rv and w.text[at - 1] in "st":
                    w.put(at)
            else:
                w.put(at, "" if last == "e" else "i")
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    w.text = re.sub(rf"[éè]([^{_FR}]+)$", r"e\1", w.text)
    return w.text.lower()
