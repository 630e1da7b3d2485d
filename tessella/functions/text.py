"""Cleaning, segmentation and counting of text as native column expressions.

Character classes are spelled out: a letter is ``\\p{L}``, a word character ``[\\p{L}\\p{N}_]`` (no combining marks), a digit
``\\p{Nd}``. No function leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BULLETS = r"\-\*•·‣⁃∙–—"
OPENING_QUOTES = "\"'“”‘’«»‹›"
# fixed values: currency signs that cleaning keeps, pairs that wrap whole fragments, signs that end pooled sentences
CURRENCY = "$¢£¤¥֏৳฿₡₦₩₪₫₭₮₱₲₴₵₸₺₽₹₿€₼₾"
WRAPPERS = ("()", "[]", "{}", "<>", "【】", "（）", "「」", "『』", "«»", "‹›", "“”", "‘’", '""', "''")
SPACE, FULL = r"[\s\x1c-\x1f\x85\p{Z}]", r"[^\s\x1c-\x1f\x85\p{Z}]"
#: The characters of SPACE, one by one.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
STARTER = rf"(?:(?:[0-9]{{1,4}}|[ivxlcdm]{{1,8}}|[a-z])[.:)\]]{SPACE}*|[{BULLETS}]{SPACE}*)"
ITEM = rf"(?:(?:[0-9]{{1,4}}|[ivxlcdm]{{1,8}}|[a-z])[.:)\]]{SPACE}+|[{BULLETS}]{SPACE}+)"
# fixed values: enumerations are split from this length and number of markers on
LIST_MIN_CHARS, LIST_MIN_MARKERS = 120, 2
ENDINGS = (".", ":", ";", "!", "?")
WORD = r"[\p{L}\p{N}_]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(_c(c), F.lit(SPACES))


def stepwise(df: DataFrame, column: str, *steps: Callable[[Column], Column]) -> DataFrame:
    """df with steps applied to a column one after the other, each as a column of its own, so that a step may use its input several times."""
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df


def strip_backslashes(c: Column | str, by: str = "") -> Column:
    return F.replace(_c(c), F.lit("\\"), F.lit(by))


def strip_html(c: Column | str) -> Column:
    return F.when(F.contains(_c(c), F.lit("<")), F.regexp_replace(_c(c), r"</?[A-Za-z][^>\n]{0,80}>", " ")).otherwise(_c(c))


def strip_brackets(c: Column | str) -> Column:
    """Bracketed notes of up to 60 characters become a space."""
    opens = F.contains(_c(c), F.lit("(")) | F.contains(_c(c), F.lit("[")) | F.contains(_c(c), F.lit("【")) | F.contains(_c(c), F.lit("（"))
    return F.when(opens, F.regexp_replace(_c(c), rf"{SPACE}*[(\[【（][^)\]】）]{{0,60}}[)\]】）]{SPACE}*", " ")).otherwise(_c(c))


def collapse_punct(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"([,.;:!?…،。！？])\1+", "$1")


def collapse_spaces(c: Column | str) -> Column:
    # a single blank stays as it is, which spares nearly all replacements
    return F.regexp_replace(_c(c), rf"{SPACE}{{2,}}+|[{SPACE}&&[^ ]]", " ")


def strip_letters(c: Column | str, pattern: Column | str) -> Column:
    """Without the letters that a pattern (a column or its name) matches."""
    return F.regexp_replace(_c(c), _c(pattern), F.lit(""))


def strip_symbols(c: Column | str) -> Column:
    """Without symbols beyond ASCII, currency signs apart, and without emoji joiners."""
    return F.regexp_replace(_c(c), rf"[[[^\x00-\x7F]&&[\p{{S}}]&&[^{CURRENCY}]]⃣︎️]+", "")


def strip_ascii_words(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "[A-Za-z]+", "")


def strip_leading_punct(c: Column | str) -> Column:
    """Without leading punctuation, unless it opens with a quote."""
    return F.regexp_replace(F.ltrim(_c(c), F.lit(SPACES)), rf"^(?![{OPENING_QUOTES}])[{SPACE}\p{{P}}]+", "")


def strip_list_starters(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), rf"(?i)^(?:{SPACE}*{STARTER})+{SPACE}*", "")


def strip_leading_orphan(c: Column | str) -> Column:
    """Without a single letter behind opening quotes, punctuation or spaces."""
    return F.ltrim(F.regexp_replace(_c(c), rf"^[{SPACE}{OPENING_QUOTES},.;:!?…،。！？]+[\p{{L}}\p{{Nl}}\p{{No}}]{SPACE}+", ""), F.lit(SPACES))


def strip_trailing_orphan(c: Column | str) -> Column:
    """Without a single letter behind punctuation or spaces at the end."""
    # the last four characters tell whether there is one, a line's end included; the search from every space would be dear
    sign, letter = f"[{SPACE},.;:!?…،。！？]", r"[\p{L}\p{Nl}\p{No}]$"
    cut = F.when(F.substring(_c(c), -4, 4).rlike(f"{sign}{letter}"), F.regexp_replace(_c(c), f"{sign}+{letter}", "")).otherwise(_c(c))
    return F.rtrim(cut, F.lit(SPACES))


def strip_markup(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?s)\[\[.*?\]\]|\{\{.*?\}\}|==.*?==", "")


def paragraphs(c: Column | str) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_c(c), rf"\n{SPACE}*\n+"), trim), lambda p: p != "")


def sentences(c: Column | str) -> Column:
    """Split behind sentence ends; CJK ends need no space."""
    # without CJK ends every split begins with a space, so that no other place is looked at twice
    cjk = F.contains(_c(c), F.lit("。")) | F.contains(_c(c), F.lit("！")) | F.contains(_c(c), F.lit("？"))
    parts = F.when(cjk, F.split(_c(c), rf"(?<=[.!?]){SPACE}+|(?<=[。！？]){SPACE}*")).otherwise(F.split(_c(c), rf"(?s){SPACE}(?<=[.!?].){SPACE}*+"))
    return F.filter(parts, lambda s: s.rlike(FULL))


def split_list(c: Column | str) -> Column:
    """Items of a long enumeration that begins with an item; otherwise the text alone."""
    items = lambda whole: F.filter(F.transform(F.split(whole, rf"(?i)(?<![^\s])(?={ITEM})"), trim), lambda p: p != "")
    enough = lambda whole: (F.length(whole) >= LIST_MIN_CHARS) & whole.rlike(f"(?i)^{ITEM}")
    return bind(_c(c), lambda text: bind(trim(text), lambda w: F.when(enough(w), bind(items(w), lambda x: F.when(F.size(x) >= LIST_MIN_MARKERS, x).otherwise(F.array(text)))).otherwise(F.array(text))))


def segments(c: Column | str) -> Column:
    """Sentences, with long enumerations split."""
    return F.filter(F.flatten(F.transform(sentences(strip_backslashes(c, " ")), split_list)), lambda s: s.rlike(FULL))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(WORD), F.lit(0))


def letter_words(c: Column | str) -> Column:
    """The runs of letters in lower case, parted by single blanks."""
    # a blank between two letters stays as it is, which spares most replacements
    return F.lower(F.btrim(F.regexp_replace(_c(c), r"[^\p{L} ]\P{L}*+| \P{L}++", " "), F.lit(" ")))


def first_letter_words(c: Column | str, n: int) -> Column:
    """The first n runs of letters, as letter_words() has them; empty if there are fewer. No more of a text is read."""
    return letter_words(F.regexp_extract(_c(c), rf"^(?:\P{{L}}*+\p{{L}}++){{{n}}}", 0))


def alpha_words(c: Column | str) -> Column:
    return F.filter(words(c), lambda w: w.rlike(r"^\p{L}+$"))


def alpha_count(c: Column | str) -> Column:
    """How many words have letters only."""
    return F.regexp_count(_c(c), F.lit(r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])"))


def alpha_in(c: Column | str, words_: Column) -> Column:
    """alpha_count() of a text whose words are known: all of them, where it has no digit and no underscore."""
    return F.when(_c(c).rlike(r"[\p{N}_]"), alpha_count(c)).otherwise(F.size(words_))


def visible_chars(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(c), r"[^\p{L}\p{N}]", ""))


def digits(c: Column | str) -> Column:
    return F.regexp_count(_c(c), F.lit(r"\p{Nd}"))


def valid_tokens(c: Column | str) -> Column:
    """Runs of letters, marks, numbers and symbols that hold only letters and marks."""
    return F.regexp_count(_c(c), F.lit(r"(?<![\p{L}\p{M}\p{N}\p{S}])[\p{L}\p{M}]++(?![\p{N}\p{S}])"))


def is_valid_word(c: Column | str) -> Column:
    """One word of letters, without digits or symbols."""
    return bind(trim(c), lambda w: (w != "") & (digits(w) == 0) & (F.size(alpha_words(w)) == 1) & (valid_tokens(w) == 1))


def is_titlecase(c: Column | str) -> Column:
    return _c(c).rlike(r"^\p{Lu}\p{Ll}+$")


def md5_number(key: Column) -> Column:
    """The first 32 bits of a key's MD5: a hash that other engines have too."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def md5_number52(key: Column) -> Column:
    """The first 52 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) by MD5."""
    return (md5_number(key) + 0.5) / float(1 << 32)


def strip_wrappers(c: Column | str, rounds: int | None = None, pairs: tuple[str, ...] = WRAPPERS) -> Column:
    """Without pairs of brackets or quotes around the whole, until nothing changes, or up to so many times.

    A round takes two characters at least, so a text has at most half as many rounds as characters; only texts that are
    wrapped at all have any.
    """
    around = "|".join(rf"\{a}.+\{b}" if a in "([{<" else f"{a}.+{b}" for a, b in pairs)
    wrapped = lambda t: t.rlike(f"(?s)^(?:{around})$")

    def once(t: Column) -> Column:
        inner = trim(F.substring(t, F.lit(2), F.length(t) - 2))
        return F.when(wrapped(t), bind(inner, lambda x: F.when(x != "", x).otherwise(t))).otherwise(t)

    most = F.floor(F.length(c if isinstance(c, Column) else F.col(c)) / 2) if rounds is None else F.lit(rounds)
    # the run of brackets and quotes at the start bounds the rounds
    opening = lambda t: F.length(F.regexp_extract(t, r"^(?:\s|[(\[{<【（「『«‹“‘\"'])+", 0))
    return bind(trim(c), lambda t: F.when(wrapped(t), F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(most, opening(t))).cast("int")), t, lambda acc, _: once(acc))).otherwise(t))


def pool_normalized(c: Column | str, lang: Column | str, seed: int = 0) -> Column:
    """A sentence as pools keep it: without wrappers and list marker, with a terminal sign chosen by hash."""
    text = strip_wrappers(bind(trim(collapse_spaces(c)), strip_html))
    marker = rf"(?i)^{SPACE}*(?:(?:[0-9]{{1,4}}|[ivxlcdm]{{1,8}}|[a-z])[.)\]]{SPACE}+|[{BULLETS}]{SPACE}+)"
    text = trim(collapse_spaces(collapse_punct(trim(F.regexp_replace(text, marker, "")))))
    body = lambda t: F.regexp_replace(F.regexp_extract(t, r"(?s)^(.*?)[.!?;:…]+$", 1), rf"{SPACE}+$", "")
    sign = lambda b: F.element_at(F.array(*map(F.lit, ENDINGS)), F.pmod(md5_number(F.concat_ws("\0", F.lit(str(seed)), _c(lang), b)), F.lit(len(ENDINGS))).cast("int") + 1)
    return bind(text, lambda t: bind(body(t), lambda b: F.when(b != "", F.concat(b, sign(b))).otherwise(t)))


def strip_edge_quotes(c: Column | str) -> Column:
    """Without stray quotes at the ends; an Afrikaans 'n stays."""
    return trim(F.regexp_replace(trim(c), f"^(?!['’]n\\b)[{OPENING_QUOTES}]+|[{OPENING_QUOTES}]+$", ""))


def merge_fragments(c: Column | str, least: int = 12) -> Column:
    """Neighbouring pieces joined where the first is short or the next starts in lower case."""
    return F.aggregate(
        _c(c),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & ((F.length(F.element_at(acc, -1)) < least) | x.rlike(r"^\p{Ll}")), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))).otherwise(F.array_append(acc, x)),
    )


def expand_wrapped(c: Column | str) -> Column:
    """Sentences inside a wrapped fragment, without quotes at their edges."""
    parts = F.filter(F.transform(merge_fragments(sentences(strip_wrappers(c))), strip_edge_quotes), lambda s: s != "")
    return bind(parts, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(trim(c))))


def clean_formula(c: Column | str) -> Column:
    """A formula without dollar signs and display wrappers."""
    marked = F.contains(_c(c), F.lit("$")) | F.contains(_c(c), F.lit("\\"))
    return trim(collapse_spaces(F.when(marked, F.regexp_replace(_c(c), r"\$+|\\[\[\]()]", "")).otherwise(_c(c))))


def rot13(c: Column | str) -> Column:
    a = "abcdefghijklmnopqrstuvwxyz"
    b = a[13:] + a[:13]
    return F.translate(_c(c), a + a.upper(), b + b.upper())


# fixed values: accented Latin letters and their base letters
ACCENTED = "àáâãäåāăąçćčĉċďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def strip_accents(c: Column | str) -> Column:
    return F.translate(_c(c), ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper())


def strip_terminal_punct(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), rf"(?<![{SPACE}\p{{P}}])[{SPACE}\p{{P}}]++$", "")


def phrase_key(c: Column | str) -> Column:
    """A phrase for lookups: straight apostrophes become spaces, lower case, single spaces."""
    return F.lower(trim(collapse_spaces(F.regexp_replace(_c(c), rf"[^\p{{L}}\p{{N}}_\s]+", " "))))


def normalized_label(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.upper(_c(c)), "^[BI]-", ""))
