"""Languages, groups and their limits as small dimension tables (one row per language; at most 105, so broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: languages in label order, with the codes that mean the same
ALIASES = {
    "en": "eng", "es": "spa", "fr": "fra fre", "de": "deu ger", "it": "ita", "pt": "por", "nl": "nld dut", "vi": "vie", "tr": "tur", "la": "lat", "id": "ind",
    "ms": "msa may zlm zsm", "af": "afr", "sq": "alb sqi", "is": "ice isl", "no": "nb nn nor nob nno", "sv": "swe", "da": "dan", "fi": "fin", "hu": "hun", "pl": "pol",
    "cs": "ces cze", "ro": "ron rum", "ru": "rus", "bg": "bul", "uk": "ukr", "sr": "srp", "be": "bel", "kk": "kaz", "mk": "mac mkd", "mn": "mon khk",
    "zh": "chi zho cmn yue wuu nan", "ja": "jpn", "ko": "kor", "hi": "hin", "ur": "urd", "bn": "ben", "ta": "tam", "te": "tel", "mr": "mar", "gu": "guj", "kn": "kan",
    "ml": "mal", "pa": "pan", "as": "asm", "or": "ori ory", "ar": "arb ara", "fa": "fas per pes prs", "ps": "pus pbt", "sd": "snd", "ug": "uig", "el": "ell gre grc",
    "he": "heb iw hbo", "yi": "yid ydd yds", "hy": "hye hyw", "ka": "kat", "am": "amh", "km": "khm", "lo": "lao", "my": "mya", "th": "tha", "si": "sin", "bo": "bod",
    "dv": "div", "ti": "tir", "sw": "swa swh", "eu": "eus", "tl": "fil tgl", "xh": "xho", "ca": "cat", "gl": "glg", "oc": "oci", "br": "bre", "ga": "gle", "gd": "gla",
    "cy": "cym", "sco": "", "bs": "bos", "hr": "hrv", "sl": "slv", "sk": "slk", "et": "est", "lv": "lav lvs", "lt": "lit", "eo": "epo", "jv": "jav", "mg": "mlg plt",
    "om": "orm", "so": "som", "su": "sun", "uz": "uzn uzb", "ku": "kur kmr", "ckb": "", "ne": "npi", "mt": "mlt", "lb": "ltz", "rm": "roh", "tt": "tat", "ky": "kir",
    "tg": "tgk", "ba": "bak", "yo": "yor", "zu": "zul", "ny": "nya", "ce": "che",
}

# fixed values: group -> (languages, weight, least characters of an article, script)
GROUPS = {
    "English": ("en", 2.9, 2000, "Latin"),
    "Russian": ("ru", 1.95, 2000, "Cyrillic"),
    "German": ("de", 1.9, 2000, "Latin"),
    "Japanese": ("ja", 1.9, 1200, "Japanese"),
    "Chinese": ("zh", 1.9, 1200, "Han"),
    "French": ("fr", 1.9, 2000, "Latin"),
    "Spanish": ("es", 1.9, 2000, "Latin"),
    "Portuguese": ("pt", 1.7, 2000, "Latin"),
    "Italian": ("it", 1.6, 2000, "Latin"),
    "Polish": ("pl", 1.55, 2000, "Latin"),
    "Dutch": ("nl", 1.55, 2000, "Latin"),
    "Turkish": ("tr", 1.45, 2000, "Latin"),
    "SoutheastAsianLatin": ("vi id ms tl", 1.55, 2000, "Latin"),
    "WesternLatin": ("ca gl oc eu la", 1.2, 1500, "Latin"),
    "CelticLatin": ("br ga gd cy sco", 1.3, 1500, "Latin"),
    "AdriaticLatin": ("bs hr sl sk sq", 1.4, 1500, "Latin"),
    "BalticLatin": ("et lv lt", 1.2, 1500, "Latin"),
    "CentralEuropeanLatin": ("cs ro hu", 1.3, 2000, "Latin"),
    "Korean": ("ko", 1.35, 1200, "Hangul"),
    "EastSlavicCyrillic": ("uk be", 1.7, 2000, "Cyrillic"),
    "Arabic": ("ar", 1.4, 2000, "Arabic"),
    "NordicCore": ("sv da is af fi no", 2.8, 2000, "Latin"),
    "BalkanCyrillic": ("bg sr mk", 1.05, 2000, "Cyrillic"),
    "ArabicOther": ("fa ps sd ug ur ckb", 0.95, 2000, "Arabic"),
    "Hindi": ("hi", 1.25, 2000, "Devanagari"),
    "Devanagari": ("mr ne", 0.75, 2000, "Devanagari"),
    "Bengali": ("bn as", 0.55, 2000, "Bengali"),
    "IndicOther": ("ta te gu kn ml pa or", 0.95, 2000, "IndicOther"),
    "CentralAsianCaucusCyrillic": ("kk mn tt ky tg ba ce", 1.1, 2000, "Cyrillic"),
    "AfricanLatin": ("sw yo zu ny xh", 1.0, 1500, "Latin"),
    "PeripheralLatin": ("eo jv lb mg mt om rm so su uz ku", 1.0, 1500, "Latin"),
    "OtherScriptsWest": ("el hy ka am ti dv", 1.0, 2000, "MixedWest"),
    "Hebrew": ("he yi", 0.95, 2000, "Hebrew"),
    "OtherScriptsEast": ("km lo my th si bo", 1.0, 2000, "MixedEast"),
}

# fixed values: strict bounds of a sentence's visible characters by group; others have DEFAULT_BOUNDS
BOUNDS = {
    (24, 600): "English",
    (35, 650): "Russian EastSlavicCyrillic BalkanCyrillic CentralAsianCaucusCyrillic",
    (40, 600): "German",
    (30, 600): "Spanish French Portuguese Italian Dutch Polish",
    (20, 450): "Turkish WesternLatin CelticLatin AdriaticLatin BalticLatin CentralEuropeanLatin NordicCore",
    (10, 180): "Japanese",
    (5, 180): "Chinese",
    (10, 220): "Korean",
    (25, 450): "Arabic ArabicOther OtherScriptsWest",
    (30, 500): "Hindi IndicOther",
    (15, 300): "SoutheastAsianLatin AfricanLatin PeripheralLatin",
    (15, 250): "OtherScriptsEast",
}
DEFAULT_BOUNDS = (30, 600)
BOUNDS_BY_LANGUAGE = {"hy": (30, 500)}

NO_SPACE_GROUPS = ("Chinese", "Japanese", "Korean", "OtherScriptsEast")
MINOR_LATIN_GROUPS = ("AfricanLatin", "AdriaticLatin", "BalticLatin", "CelticLatin", "PeripheralLatin", "SoutheastAsianLatin", "WesternLatin")
SECONDARY_GROUPS = ("AfricanLatin", "AdriaticLatin", "BalticLatin", "CelticLatin", "PeripheralLatin", "WesternLatin")
MAJOR_LEAK_GROUPS = ("AfricanLatin", "PeripheralLatin", "SoutheastAsianLatin")
MAJOR_LATIN = ("en", "de", "fr", "es", "pt", "it")
LEAK_LANGUAGES = ("de", "es", "fr", "it", "pt")
MIXED_SCRIPT_ALLOWED = ("uz",)
# (least stop words, least hits, least share of hits, least share of ASCII words)
LEAK_POLICIES = {"minor": (1, 2, 0.35, 0.75), "latin": (3, 4, 0.60, 0.80), "other": (3, 3, 0.30, 0.50)}

# fixed values: scripts of languages in groups of several scripts
SCRIPT_OF = {
    "el": "Greek", "hy": "Armenian", "ka": "Georgian", "am": "Ethiopic", "ti": "Ethiopic", "dv": "Thaana", "km": "Khmer", "lo": "Lao", "my": "Myanmar", "th": "Thai",
    "si": "Sinhala", "bo": "Tibetan", "ta": "Tamil", "te": "Telugu", "gu": "Gujarati", "kn": "Kannada", "ml": "Malayalam", "pa": "Gurmukhi", "or": "Oriya",
}
#: Scripts that count as foreign where they aren't the language's own.
SCRIPTS = ("Latin", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Bengali", "Hiragana", "Katakana", "Han", "Hangul", *dict.fromkeys(SCRIPT_OF.values()))
PARTS = {"Japanese": ("Hiragana", "Katakana", "Han")}

# fixed values: multipliers of sentence caps by language; 1 for others
WIKI = {"articles": 10_000, "index": 100_000, "sentences": 150_000, "scan": 66_666, "priority": 25_000}
WIKI_MULTIPLIERS = {"en": 1.5, "de": 1.25, "fr": 1.25, "es": 1.25, "ru": 1.25, "zh": 1.25, "ja": 1.25, "pt": 1.25, "it": 1.25, "hi": 1.25, "ko": 1.25, "ar": 1.25, "no": 0.65, "sco": 0.75}
TATOEBA_MULTIPLIERS = {k: v for k, v in WIKI_MULTIPLIERS.items() if k not in ("hi", "no")}
PRIORITY_CAPS = dict.fromkeys("lo sd am km ug my".split(), 20_000)
PARALLEL = {"kept": 50_000, "scanned": 55_000, "miss": 1_000, "every": 5, "english_for": ("es", "fr", "pt", "it", "de"), "multipliers": {"sv": 1.5}}
# source -> (reserved share, least, most)
RESERVES = {"wiki": (0.55, 4, 82_500), "smol": (0.95, 1, 1_000), "ft": (0.55, 1, 27_500), "freq": (1.0, 1, 150_000), "tatoeba": (0.55, 1, 82_500)}

LANGUAGES = tuple(ALIASES)
CANONICAL = {a: k for k, v in ALIASES.items() for a in (k, *v.split())}
GROUP_OF = {lang: g for g, v in GROUPS.items() for lang in v[0].split()}
LATIN_GROUPS = tuple(g for g, v in GROUPS.items() if v[3] == "Latin")


def canonical(code: str) -> str:
    code = code.strip().lower()
    return CANONICAL.get(code, code)


def source_languages(lang: str) -> tuple[str, ...]:
    """Editions that feed a language."""
    return ("no", "nn") if canonical(lang) == "no" else (canonical(lang),)


def script_of(lang: str) -> str:
    return SCRIPT_OF.get(lang) or GROUPS[GROUP_OF[lang]][3]


def own_scripts(lang: str) -> tuple[str, ...]:
    script = script_of(lang)
    return PARTS.get(script, (script,)) if script in SCRIPTS or script in PARTS else ()


def script_pattern(scripts: tuple[str, ...]) -> str:
    """Character class of the letters of these scripts; one that matches nothing if there are none."""
    return f"[{''.join(rf'\p{{Is{s}}}' for s in scripts)}&&\\p{{L}}]" if scripts else "(?!)"


def foreign_pattern(own: tuple[str, ...]) -> str:
    """Character class of the letters of all other scripts. Looking up a letter's script is dear: ASCII letters are spelled out, own ones go by one look-up."""
    if not own:
        return "(?!)"
    names = lambda scripts: "".join(rf"\p{{Is{s}}}" for s in scripts)
    return rf"[[[^\x00-\x7F]&&[\p{{L}}]&&[^{names(own)}]&&[{names(s for s in SCRIPTS if s not in own)}]]{'' if 'Latin' in own else 'A-Za-z'}]"


def bounds_of(lang: str) -> tuple[int, int]:
    by_group = {g: b for b, groups in BOUNDS.items() for g in groups.split()}
    return BOUNDS_BY_LANGUAGE.get(lang) or by_group.get(GROUP_OF[lang], DEFAULT_BOUNDS)


def wiki_cap(lang: str, base: int = WIKI["sentences"]) -> int:
    """Sentences of a language: base times the sum of its editions' multipliers, rounded half to even."""
    return round(base * sum(WIKI_MULTIPLIERS.get(canonical(s), 1.0) for s in source_languages(lang)))


def priority_cap(lang: str) -> int:
    return PRIORITY_CAPS.get(canonical(lang), WIKI["priority"])


def tatoeba_cap(lang: str, base: int = 150_000) -> int:
    return round(base * TATOEBA_MULTIPLIERS.get(canonical(lang), 1.0))


def lang_rows() -> list[tuple]:
    out = []
    for i, lang in enumerate(LANGUAGES):
        group = GROUP_OF[lang]
        _, weight, least, _ = GROUPS[group]
        low, high = bounds_of(lang)
        own = own_scripts(lang)
        latin = group in LATIN_GROUPS
        policy = LEAK_POLICIES["minor" if group in MINOR_LATIN_GROUPS else "latin" if latin else "other"]
        paragraph = 0.75 if group == "English" else 0.60
        out.append(
            (lang, i, group, float(weight), least, script_of(lang), latin, low, high, group in NO_SPACE_GROUPS, script_pattern(own), foreign_pattern(own), bool(own))
            + (lang in MIXED_SCRIPT_ALLOWED and latin, group in MINOR_LATIN_GROUPS, group in MAJOR_LEAK_GROUPS, group in SECONDARY_GROUPS or not latin, *policy)
            + (paragraph, max(250, least // 4), wiki_cap(lang), priority_cap(lang), tatoeba_cap(lang))
        )
    return out


LANG_SCHEMA = (
    "lang string, label int, lang_group string, weight double, min_chars int, script string, latin boolean, min_len int, max_len int, no_space boolean, own_letters string, foreign_letters string, "
    "has_script boolean, mixed_allowed boolean, minor_latin boolean, leak_check boolean, secondary boolean, min_stop int, min_hits int, min_hit_share double, min_ascii_share double, "
    "paragraph_share double, long_paragraph int, wiki_cap int, priority_cap int, tatoeba_cap int"
)


def lang_dim(spark: SparkSession) -> DataFrame:
    """One row per language."""
    return spark.createDataFrame(lang_rows(), LANG_SCHEMA)


def alias_dim(spark: SparkSession) -> DataFrame:
    """code -> canonical language, own codes included."""
    return spark.createDataFrame(sorted(CANONICAL.items()), "code string, canonical string")


def with_canonical(df: DataFrame, code: str = "lang", out: str = "lang") -> DataFrame:
    """df with the canonical language of a code column (itself where it is unknown)."""
    key = F.lower(F.trim(F.col(code)))
    return df.withColumn("_code", key).join(F.broadcast(alias_dim(df.sparkSession).withColumnRenamed("code", "_code")), "_code", "left").withColumn(out, F.coalesce("canonical", "_code")).drop("_code", "canonical")


def with_lang(df: DataFrame) -> DataFrame:
    """df with the columns of lang_dim, null for unknown languages."""
    return df.join(F.broadcast(lang_dim(df.sparkSession)), "lang", "left")
