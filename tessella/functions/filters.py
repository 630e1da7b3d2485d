"""Predicates and cleaning of sentences. Functions that take no language read the columns of dims.with_lang()."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.dims import LANGUAGES, foreign_pattern, own_scripts, script_of, script_pattern

# fixed values: words that may be lower case inside a name
CONNECTORS = "a an and al bin bint da de del der di do dos das e el la le los las of the y van von in den des du l d st saint santa".split()
#: Scripts of languages by the name that lang_dim has for them.
OWN = {script_of(lang): own_scripts(lang) for lang in LANGUAGES}
MIN_TOKENS, MAX_DIGIT_SHARE = 4, 0.10
PARALLEL_MIN = {"language": 0.90, "tokens": 20, "score": 0.80}


def has_artifact(c: Column | str) -> Column:
    return T._c(c).rlike("(?i)http|[=<>|]")


def is_valid(c: Column | str) -> Column:
    """Visible length strictly inside the language's bounds, four tokens or more, at most a tenth digits."""
    tokens = lambda visible: F.when(F.coalesce("no_space", F.lit(False)), visible).otherwise(T.valid_tokens(c))
    inside = lambda n: (n > F.coalesce("min_len", F.lit(30))) & (n < F.coalesce("max_len", F.lit(600)))
    return T.bind(T.visible_chars(c), lambda n: F.when(inside(n), (tokens(n) >= MIN_TOKENS) & (T.digits(c) <= n * MAX_DIGIT_SHARE)).otherwise(F.lit(False)))


def by_script(c: Column | str, body: Callable[[Column, tuple[str, ...]], Column]) -> Column:
    """body of a text and the scripts of its language; null for unknown languages.

    One branch a script, so that patterns are literals: one from a column is compiled again for every row that has
    another than the row before.
    """
    def branches(text: Column) -> Column:
        out = F.when(F.col("script") == "Latin", body(text, ("Latin",)))
        for script in OWN:
            out = out if script == "Latin" else out.when(F.col("script") == script, body(text, OWN[script]))
        return out

    return T.bind(T._c(c), branches)


def has_foreign_letters(c: Column | str) -> Column:
    return F.coalesce(by_script(c, lambda t, own: t.rlike(foreign_pattern(own))), F.lit(False))


def has_own_letters(c: Column | str) -> Column:
    has = lambda t, own: (t.rlike("[A-Za-z]") | t.rlike(script_pattern(own))) if own == ("Latin",) else t.rlike(script_pattern(own))
    return F.coalesce(by_script(c, has), F.lit(False))


def is_script_contaminated(c: Column | str) -> Column:
    return ~F.coalesce("mixed_allowed", F.lit(False)) & has_foreign_letters(c)


def strip_foreign_letters(c: Column | str) -> Column:
    return F.coalesce(by_script(c, lambda t, own: F.regexp_replace(t, f"{foreign_pattern(own)}+", "")), T._c(c))


def stem_candidates(word: Column) -> Column:
    """A word, and what it would be without a plural ending."""
    return F.array(word, F.when(word.endswith("s"), F.regexp_replace(word, "s$", "")), F.when(word.endswith("ies") & (F.length(word) > 3), F.regexp_replace(word, "ies$", "y")))


def stem_in(word: Column, among: Column | list[str]) -> Column:
    """Whether a word, or what it would be without a plural ending, is one of some."""
    if not isinstance(among, list):
        return F.arrays_overlap(stem_candidates(word), among)
    cut = lambda n, ending: F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(ending))
    return is_in(word, among) | (word.endswith("s") & is_in(cut(1, ""), among)) | (word.endswith("ies") & (F.length(word) > 3) & is_in(cut(3, "y"), among))


def english_leak(c: Column | str, stop: Column | list[str], broad: Column | list[str] | None = None) -> Column:
    """Reads like English though it should not: stop and broad are lower-case words (bounded): lists, or arrays, literal or broadcast.

    With broad, the language's policy on joint hits applies where its ``secondary`` flag is set.
    """
    def hit(words: Column, n: Column) -> Column:
        enough = lambda hits: hits >= F.coalesce("min_stop", F.lit(3))
        if broad is None:
            return enough(hits_in(words, stop))

        def second(hits: Column) -> Column:
            joint = hits + F.size(F.filter(words, lambda x: stem_in(x, broad)))
            return T.bind(joint, lambda j: (j >= F.col("min_hits")) & (j / n["alpha"] >= F.col("min_hit_share")) & (n["ascii"] / n["alpha"] >= F.col("min_ascii_share")))

        return T.bind(hits_in(words, stop), lambda hits: F.when(enough(hits), ~F.coalesce("secondary", F.lit(True)) | second(hits)).otherwise(F.lit(False)))

    # the words are taken out once, and in lower case only where they are looked up; in a text of ASCII all words of letters are
    def judged(words: Column) -> Column:
        ascii_ = lambda alpha: F.when(F.octet_length(T._c(c)) == F.length(T._c(c)), alpha).otherwise(F.regexp_count(F.lower(T._c(c)), F.lit(r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])")))
        both = lambda n: F.when((n["alpha"] >= 4) & (n["ascii"] >= 0.70 * n["alpha"]), T.bind(F.transform(words, F.lower), lambda w: hit(w, n))).otherwise(F.lit(False))
        return T.bind(T.alpha_in(c, words), lambda alpha: F.when(alpha >= 4, T.bind(F.struct(alpha.alias("alpha"), ascii_(alpha).alias("ascii")), both)))

    return F.coalesce(F.when(F.col("lang") != "en", T.bind(T.words(c), judged)), F.lit(False))


def major_latin_leak(c: Column | str, lexicon: Column | dict[str, list[str]]) -> Column:
    """Three words or more, and 35 % or more of the words of letters, from another major language's lexicon (a map language -> words)."""
    if isinstance(lexicon, dict):
        enough = lambda n, alpha: (n >= 3) & (n >= 0.35 * alpha)
        of = lambda k, known, alpha: (F.lit(k) != F.col("lang")) & T.bind(hits_in(known, lexicon[k]), lambda n: enough(n, alpha))
        some = lambda known, alpha: reduce(lambda a, b: a | b, (of(k, known, alpha) for k in lexicon), F.lit(False))
        # words of any lexicon first: few are left for each of them, and sentences with fewer than three need no count of theirs
        among = lambda words: T.bind(F.filter(words, lambda w: is_in(w, sorted({x for v in lexicon.values() for x in v}))), lambda known: F.when(F.size(known) >= 3, T.bind(T.alpha_in(c, words), lambda alpha: (alpha >= 4) & some(known, alpha))))
        return F.coalesce(F.when(F.col("leak_check"), T.bind(F.transform(T.words(c), F.lower), among)), F.lit(False))
    leaks = lambda words, alpha: F.exists(F.map_keys(lexicon), lambda k: (k != F.col("lang")) & T.bind(hits_in(words, lexicon[k]), lambda n: (n >= 3) & (n >= 0.35 * alpha)))
    judged = lambda words: T.bind(T.alpha_count(c), lambda alpha: (alpha >= 4) & leaks(words, alpha))
    return F.coalesce(F.col("leak_check") & T.bind(F.transform(T.words(c), F.lower), judged), F.lit(False))


def is_in(word: Column, among: Column | list[str]) -> Column:
    """Whether a word is one of some: of a list by its hash, of an array by comparison with one after the other."""
    return word.isin(among) if isinstance(among, list) else F.array_contains(among, word)


def hits_in(words: Column, among: Column | list[str]) -> Column:
    return F.size(F.filter(words, lambda w: is_in(w, among)))


def titlecase_shape(c: Column | str) -> Column:
    """(named, short): three to six words, four fifths of them capitalised, the others connectors; five words at most with one at most in lower case."""
    def judged(words: Column) -> Column:
        n = F.size(words)
        titled = F.size(F.filter(words, lambda w: T.is_titlecase(w) | (w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))))
        joined = F.forall(F.filter(words, lambda w: w.rlike(r"^\p{Ll}")), lambda w: F.lower(w).isin(CONNECTORS))
        named = F.when(n.between(3, 6), (titled / n >= 0.8) & joined).otherwise(F.lit(False))
        return F.struct((F.coalesce("minor_latin", F.lit(False)) & named).alias("named"), ((n <= 5) & (titled >= n - 1)).alias("short"))

    return T.bind(T.alpha_words(c), judged)


def titlecase_entity(c: Column | str, places: Column | None = None) -> Column:
    """A name rather than a sentence, by its shape: and with a known place of two to six words in it, or short."""
    def has_place(words: Column) -> Column:
        n = F.size(words)
        upto = lambda i: F.transform(F.sequence(i + 1, F.least(n, i + 5)), lambda j: T.phrase_key(F.array_join(F.slice(words, i, j - i + 1), " ")))
        return F.arrays_overlap(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), upto)), places)

    short = lambda s: s["short"] if places is None else s["short"] | T.bind(T.alpha_words(c), has_place)
    # only minor Latin languages have such names, so other texts aren't taken apart
    shaped = T.bind(titlecase_shape(c), lambda s: F.when(s["named"], short(s)).otherwise(F.lit(False)))
    return F.when(F.coalesce("minor_latin", F.lit(False)), shaped).otherwise(F.lit(False))


def reject_reason(c: Column | str, stop: Column | list[str], broad: Column | list[str] | None = None, places: Column | None = None, lexicon: Column | dict[str, list[str]] | None = None) -> Column:
    """Why a sentence is rejected, by the first reason that holds; null for none, and always for English."""
    mixed = has_foreign_letters(c) & ~T.bind(strip_foreign_letters(c), has_own_letters)
    reason = F.when(mixed, "mixed_script").when(titlecase_entity(c, places), "titlecase_entity").when(english_leak(c, stop, broad), "english_leak")
    if lexicon is not None:
        reason = reason.when(major_latin_leak(c, lexicon), "major_latin_leak")
    return F.when(F.col("lang") == "en", F.lit(None)).otherwise(reason)


def cleaned(df: DataFrame, column: str, stop: Column, **lists: Column) -> DataFrame:
    """df with the column cleaned, empty where nothing is left or a reason rejects it. Steps are columns of their own, so each runs once."""
    out = T.stepwise(df.withColumn("_t", F.col(column)), "_t", T.strip_backslashes, T.strip_html, T.strip_brackets, T.collapse_punct)
    out = out.withColumn("_c", T.trim(T.collapse_spaces(T.strip_symbols(strip_foreign_letters("_t"))))).drop("_t")
    bad = ~has_own_letters("_c") | reject_reason("_c", stop, **lists).isNotNull()
    latin = F.coalesce("latin", F.lit(False))
    final = F.when(bad, "").when(latin, F.col("_c")).otherwise(T.trim(T.collapse_spaces(T.strip_ascii_words("_c"))))
    return out.withColumn(column, final).drop("_c")


def post_cleaned(df: DataFrame, column: str, stop: Column, **lists: Column) -> DataFrame:
    """The whole chain over sentences with ``lang`` and the columns of with_lang(): artifacts, cleaning, edges, validity. Duplicates stay."""
    out = cleaned(df.where(~has_artifact(column)), column, stop, **lists)
    edge = T.collapse_punct(T.strip_leading_orphan(T.strip_list_starters(T.strip_leading_punct(column))))
    final = T.bind(edge, lambda e: T.trim(T.collapse_spaces(F.when(F.coalesce("latin", F.lit(False)), e).otherwise(T.strip_trailing_orphan(e)))))
    # exploding what is kept runs the chain once; a filter would be pushed below it and run it again for every use
    kept = F.filter(F.array(final), lambda s: (s != "") & ~has_artifact(s) & is_valid(s))
    names = [c for c in out.columns if c != column]
    return out.select(*names, F.explode(kept).alias(column)).select(*out.columns)


def is_wikipedia(url: Column | str) -> Column:
    return F.coalesce(T._c(url).rlike(r"(?i)wikipedia(\.org)?"), F.lit(False))


def edu_score() -> Column:
    return F.coalesce(F.expr("try_cast(edu_score_raw as double)"), F.expr("try_cast(edu_score as double)"))


def quality_score() -> Column:
    q = F.expr("try_cast(og_quality_score as double)")
    return F.when(q >= 0, q)


def row_score(lang: Column | str = "lang") -> Column:
    """Quality times ten, up to four for length, and twice the educational score for English."""
    english = F.when(T._c(lang) == "en", F.coalesce(edu_score(), F.lit(0.0)) * 2).otherwise(0.0)
    return F.coalesce(quality_score() * 10, F.lit(0.0)) + F.coalesce(F.least(F.expr("try_cast(og_token_count as bigint)") / 50.0, F.lit(4.0)), F.lit(0.0)) + english


def parallel_row_ok() -> Column:
    """Cheap tests of a parallel-corpus row, before any sentence is built."""
    own = F.col("og_language").isNull() | (F.lower(F.col("og_language")) == F.col("lang"))
    return ~is_wikipedia("url") & (F.expr("try_cast(og_language_score as double)") >= PARALLEL_MIN["language"]) & (F.expr("try_cast(og_token_count as bigint)") >= PARALLEL_MIN["tokens"]) & own & (row_score() >= PARALLEL_MIN["score"])


def translated_ok() -> Column:
    return F.coalesce(edu_score() >= 1.0, F.lit(True))


def label_script_ok(label: Column | str, script: Column | str = "script") -> Column:
    """A dataset label such as xxx_Latn fits the language's script; labels without a script always do."""
    codes = {"Latn": "Latin", "Cyrl": "Cyrillic", "Arab": "Arabic", "Hebr": "Hebrew", "Deva": "Devanagari", "Beng": "Bengali", "Grek": "Greek", "Armn": "Armenian", "Geor": "Georgian", "Ethi": "Ethiopic", "Thaa": "Thaana", "Jpan": "Japanese", "Hani": "Han", "Hans": "Han", "Hant": "Han", "Hang": "Hangul", "Kore": "Hangul", "Khmr": "Khmer", "Laoo": "Lao", "Mymr": "Myanmar", "Thai": "Thai", "Sinh": "Sinhala", "Tibt": "Tibetan", "Taml": "Tamil", "Telu": "Telugu", "Gujr": "Gujarati", "Knda": "Kannada", "Mlym": "Malayalam", "Guru": "Gurmukhi", "Orya": "Oriya"}
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    named = F.try_element_at(table, F.substring_index(T._c(label), "_", -1))
    return ~F.contains(T._c(label), F.lit("_")) | named.isNull() | (named == T._c(script))
