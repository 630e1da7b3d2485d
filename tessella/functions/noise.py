"""Noise on sentences, driven by uniform numbers that are functions of a key: the same key gives the same noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as T

# fixed values: signs and the letters a scanner takes for them
OCR = {
    "0": ["o", "O"],
    "1": ["l", "I", "i"],
    "3": ["e", "E"],
    "4": ["a", "A"],
    "5": ["s", "S"],
    "6": ["b", "G"],
    "7": ["t", "T"],
    "8": ["B"],
    "@": ["a", "A"],
    "$": ["s", "S"],
    "9": ["g", "q"],
}
# fixed values: accented forms of letters
ACCENTS = {
    "a": "áàâäãåāăą", "b": "ḃƀɓ", "c": "çćč", "d": "ďđḋḍ", "e": "éèêëēėę", "f": "ƒ", "g": "ğĝġģ", "h": "ħḥ", "i": "íìîïīį", "j": "ĵ", "k": "ķḱ", "l": "ĺļľł", "m": "ṃ",
    "n": "ñńņň", "o": "óòôöõōő", "p": "ṕ", "r": "ŕřṛ", "s": "śšşș", "t": "ťţṭŧ", "u": "úùûüūűŭũ", "v": "ṽ", "w": "ŵẁẃ", "y": "ýÿŷ", "z": "źžżẓ",
}
# fixed values: neighbours on a keyboard
KEYS = {
    "q": "wa", "w": "qes", "e": "wrd", "r": "etf", "t": "ryg", "y": "tuh", "u": "yij", "i": "uok", "o": "ipl", "p": "ol", "a": "qsz", "s": "adwx", "d": "sfec", "f": "dgrv", "g": "fhtb", "h": "gjyn",
    "j": "hkum", "k": "jli", "l": "kop", "z": "ax", "x": "zcs", "c": "xvd", "v": "cbf", "b": "vng", "n": "bmh", "m": "nj",
}
# fixed values: languages whose readers do without accents; letters and digits that may stray into a script's sentences
SAFE_ACCENTS = ("en", "es", "fr", "it", "nl", "pt")
LETTERS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz",
    "Cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "अआइईउऊऋएऐओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह",
    "Bengali": "অআইঈউঊঋএঐওঔকখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহ",
}
CASED = ("Latin", "Cyrillic")
DIGITS_IN = ("Latin", "Cyrillic", "Arabic")


def _confused() -> dict[str, str]:
    """Signs by letter, the reverse of OCR."""
    out: dict[str, str] = {}
    for sign, letters in OCR.items():
        for letter in letters:
            out[letter] = out.get(letter, "") + sign
    return out


def u(key: Column, name: str) -> Column:
    return T.uniform(F.concat_ws("\0", key, F.lit(name)))


def pick(key: Column, name: str, n: Column | int) -> Column:
    """A place below n."""
    return F.floor(u(key, name) * n).cast("int")


def word_casing(c: Column, key: Column, upper: float, lower: float, title: float) -> Column:
    """Single words in upper, lower or title case."""

    def of(w: Column, i: Column) -> Column:
        cased = lambda x: F.when(x < upper, F.upper(w)).when(x < upper + lower, F.lower(w)).when(x < upper + lower + title, F.initcap(w)).otherwise(w)
        return T.bind(u(F.concat_ws("\0", key, i.cast("string")), "case"), cased)

    return F.array_join(F.transform(F.split(c, " "), of), " ")


def spacing(c: Column, key: Column, merge: float, split: float) -> Column:
    """One gap between words lost, or one word of four letters or more cut in two."""
    def spaced(words: Column) -> Column:
        n = F.size(words)
        at = pick(key, "gap", n)
        merged = lambda i: F.concat(F.array_join(F.slice(words, 1, i + 1), " "), F.array_join(F.slice(words, i + 2, n), " "))
        halves = lambda w: F.concat(F.substring(w, F.lit(1), F.floor(F.length(w) / 2).cast("int")), F.lit(" "), F.substring(w, F.floor(F.length(w) / 2).cast("int") + 1, F.length(w)))
        parted = lambda i: T.bind(F.get(words, i), lambda w: F.when(F.length(w) >= 4, F.array_join(F.concat(F.slice(words, 1, i), F.array(halves(w)), F.slice(words, i + 2, n)), " ")).otherwise(c))
        return F.when((n > 1) & (u(key, "merge") < merge), T.bind(at, merged)).when(u(key, "split") < split, T.bind(at, parted)).otherwise(c)

    return T.bind(F.split(c, " "), spaced)


#: A word of two letters or more, or any other single character.
PIECES = r"(?s)(?<![\p{L}\p{N}_])\p{L}{2,}(?![\p{L}\p{N}_])|."


def char_noise(c: Column, key: Column, share: float) -> Column:
    """One letter of one word as a scanner, a foreign keyboard or a finger would have it: a like sign, an accent, or a neighbour."""
    table = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p))
    ocr, accents, keys = table(_confused()), table(ACCENTS), table(KEYS)
    mode = pick(key, "mode", 3)

    def changed(word: Column) -> Column:
        letters = F.split(word, "")
        own = lambda x: F.when(mode == 0, F.try_element_at(ocr, x)).when(mode == 1, F.try_element_at(accents, F.lower(x))).otherwise(F.try_element_at(keys, F.lower(x)))
        signs = T.bind(F.transform(letters, own), lambda a: F.when((mode == 0) & F.forall(a, F.isnull), F.transform(letters, lambda x: F.try_element_at(ocr, F.lower(x)))).otherwise(a))

        def put(found: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.get(found, i).isNotNull())
            at = F.get(places, pick(key, "letter", F.size(places)))

            def new(i: Column) -> Column:
                old, options = F.get(letters, i), F.get(found, i)
                sign = F.substring(options, pick(key, "sign", F.length(options)) + 1, F.lit(1))
                return F.overlay(word, F.when(old.rlike(r"\p{Lu}"), F.upper(sign)).otherwise(sign), i + 1, F.lit(1))

            return F.when(F.size(places) > 0, T.bind(at, new)).otherwise(word)

        return T.bind(signs, put)

    def noisy(pieces: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.length(F.get(pieces, i)) > 1)
        at = F.get(places, pick(key, "word", F.size(places)))
        return F.when(F.size(places) > 0, T.bind(at, lambda k: F.array_join(F.transform(pieces, lambda w, i: F.when(i == k, changed(w)).otherwise(w)), ""))).otherwise(c)

    return F.when((u(key, "typo") < share) & (F.length(c) > 0), T.bind(F.regexp_extract_all(c, F.lit(PIECES), F.lit(0)), noisy)).otherwise(c)


def sentence_casing(c: Column, key: Column, upper: float, lower: float) -> Column:
    x = u(key, "sentence")
    return F.when(x < upper, F.upper(c)).when(x < upper + lower, F.lower(c)).otherwise(c)


def accent_loss(c: Column, lang: Column, key: Column, share: float) -> Column:
    return F.when(lang.isin(*SAFE_ACCENTS) & (u(key, "accent") < share), T.strip_accents(c)).otherwise(c)


def insert_sign(c: Column, key: Column, name: str, share: float, signs: Column) -> Column:
    """A stray sign as a word of its own between two words; nothing where signs is null."""
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    sign = F.substring(signs, pick(key, f"{name}-sign", F.length(signs)) + 1, F.lit(1))
    put = lambda w: F.when(F.size(w) > 1, F.array_join(F.array_insert(w, pick(key, f"{name}-at", F.size(w) - 1) + 2, sign), " ")).otherwise(c)
    return F.when((u(key, name) < share) & signs.isNotNull(), T.bind(words, put)).otherwise(c)


def letter_noise(c: Column, script: Column, key: Column, share: float) -> Column:
    """A stray letter of the language's script, half of them capitals where there are any; none for scripts without a list."""
    table = F.create_map(*(F.lit(x) for p in LETTERS.items() for x in p))
    letters = F.try_element_at(table, script)
    return insert_sign(c, key, "letter", share, F.when(script.isin(*CASED) & (u(key, "capital") < 0.5), F.upper(letters)).otherwise(letters))


def digit_noise(c: Column, script: Column, key: Column, share: float) -> Column:
    return insert_sign(c, key, "digit", share, F.when(script.isin(*DIGITS_IN), F.lit("0123456789")))
