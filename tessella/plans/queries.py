"""Queries over the driver's tables, one per operator or family, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import filters, generators
from tessella.functions import labels as L
from tessella.functions import text as T
from tessella.functions.dims import GROUP_OF, LANGUAGES, lang_dim, with_canonical, with_lang
from tessella.operators import dedupe, lexicon, pools, reports, synth
from tessella.plans import flows
from tessella.sources import stores

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}
STOP = "the of and to in that is was for it with as on be at by this from".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, lang, doc_id, no, pos, sentence) of all documents; pos, the pair of doc_id and no, orders sentences."""
    rows = docs(spark, sf_dir).select("source", "lang", "doc_id", F.posexplode(T.sentences("text")).alias("no", "sentence"))
    return rows.withColumn("pos", F.struct("doc_id", "no"))


def words(spark: SparkSession, sf_dir: str, top: int = 300) -> DataFrame:
    return lexicon.lexicon(lexicon.word_counts(docs(spark, sf_dir), "text"), top)


def stop_words() -> Column:
    return F.array(*map(F.lit, STOP))


# SQL fragments
SPLIT = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(10) || ' ') <> '')"
SENTENCES = f"sentences AS (SELECT source, lang, doc_id, unnest({SPLIT}) AS sentence, unnest(range(len({SPLIT}))) AS no FROM documents)"
COLLAPSE = "x"
for _sign in ",.;:!?…،。！？":
    COLLAPSE = f"regexp_replace({COLLAPSE}, '[{_sign}]{{2,}}', '{_sign}', 'g')"
collapse = lambda x: COLLAPSE.replace("(x,", f"({x},")
spaces = lambda x: f"regexp_replace({x}, '\\s+', ' ', 'g')"
brackets = lambda x: f"regexp_replace({x}, '\\s*[(\\[【（][^)\\]】）]{{0,60}}[)\\]】）]\\s*', ' ', 'g')"
html = lambda x: f"regexp_replace({x}, '</?[A-Za-z][^>\\n]{{0,80}}>', ' ', 'g')"
visible = lambda x: f"length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
tokens = lambda x: f"len(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{S}}]+'), lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{M}}]+')))"
digits = lambda x: f"len(regexp_extract_all({x}, '\\p{{Nd}}'))"
hash_of = lambda key: f"cast(('0x' || substr(md5({key}), 1, 8)) as bigint)"
LIMITS = "CASE lang WHEN 'en' THEN 24 WHEN 'de' THEN 40 ELSE 30 END"
VALID = f"{visible('sentence')} > {LIMITS} AND {visible('sentence')} < 600 AND {tokens('sentence')} >= 4 AND {digits('sentence')} <= {visible('sentence')} * 0.1"
WORDS = """counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: lower(w)), lambda w: regexp_full_match(w, '\\p{L}+'))) AS word FROM documents) GROUP BY ALL),
ranked AS (SELECT lang, word, n AS count, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM counts),
words AS (SELECT * FROM ranked WHERE rank <= 300)"""


@query(
    f"""WITH {SENTENCES}, c AS (SELECT lang, trim({spaces(collapse(brackets(html('sentence'))))}) AS sentence FROM sentences),
j AS (SELECT lang, sentence, NOT regexp_matches(sentence, '(?i)http|[=<>|]') AND {VALID} AS ok, count(*) AS n FROM c GROUP BY ALL)
SELECT lang, sum(n) AS n_sentences, sum(CASE WHEN ok THEN n ELSE 0 END) AS n_valid, count(*) FILTER (WHERE ok) AS n_kept, sum(CASE WHEN ok THEN n ELSE 0 END) - count(*) FILTER (WHERE ok) AS n_removed FROM j GROUP BY lang"""
)
def clean_funnel(spark, sf_dir):
    return flows.clean_funnel(docs(spark, sf_dir))


@query(f"SELECT doc_id, len({SPLIT}) AS n_sentences FROM documents")
def sentence_split_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.sentences("text")).alias("n_sentences"))


@query(f"SELECT doc_id, {tokens('text')} AS n_tokens, {visible('text')} AS n_visible, {digits('text')} AS n_digits FROM documents")
def text_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.valid_tokens("text").alias("n_tokens"), T.visible_chars("text").alias("n_visible"), T.digits("text").alias("n_digits"))


@query(f"SELECT doc_id, md5({collapse('text')}) AS punct, md5({brackets('text')}) AS brackets, md5({spaces('text')}) AS spaces, md5({html('text')}) AS html, md5(regexp_replace(text, '[A-Za-z]+', '', 'g')) AS ascii FROM documents")
def text_cleaning(spark, sf_dir):
    steps = {"punct": T.collapse_punct, "brackets": T.strip_brackets, "spaces": T.collapse_spaces, "html": T.strip_html, "ascii": T.strip_ascii_words}
    return docs(spark, sf_dir).select("doc_id", *(F.md5(f("text").cast("binary")).alias(n) for n, f in steps.items()))


@query(f"SELECT page_id, length({html('html')}) AS n_chars, md5(trim({spaces(html('html'))})) AS text_md5 FROM pages")
def pages_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.strip_html("html")).alias("n_chars"), F.md5(T.trim(T.collapse_spaces(T.strip_html("html"))).cast("binary")).alias("text_md5"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)http|[=<>|]')) AS n_blocked FROM documents GROUP BY lang")
def blocked_artifacts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(filters.has_artifact("text")).alias("n_blocked"))


@query("SELECT doc_id, regexp_matches(text, '\\p{Cyrillic}|\\p{Arabic}|\\p{Hebrew}|\\p{Devanagari}|\\p{Greek}|\\p{Han}|\\p{Hiragana}|\\p{Katakana}|\\p{Hangul}|\\p{Thai}') AS foreign_script, regexp_matches(text, '\\p{Latin}') AS own_script FROM documents")
def script_contamination(spark, sf_dir):
    return with_lang(docs(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", filters.is_script_contaminated("text").alias("foreign_script"), filters.has_own_letters("text").alias("own_script"))


LEAK = f"""leak AS (SELECT lang, doc_id, no, sentence, list_transform(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)) AS ws FROM sentences WHERE lang <> 'en'),
stats AS (SELECT *, len(list_filter(ws, lambda w: regexp_full_match(w, '\\p{{L}}+'))) AS alpha, len(list_filter(ws, lambda w: regexp_full_match(w, '[a-z]+'))) AS ascii,
    len(list_filter(ws, lambda w: list_contains({STOP!r}, w))) AS hits FROM leak)"""


@query(f"WITH {SENTENCES}, {LEAK} SELECT lang, count(*) AS n, count(*) FILTER (WHERE alpha >= 4 AND hits >= 3 AND ascii / alpha >= 0.7) AS n_leaks FROM stats GROUP BY lang")
def english_leak(spark, sf_dir):
    rows = with_lang(sentences(spark, sf_dir).where("lang <> 'en'"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(filters.english_leak("sentence", stop_words())).alias("n_leaks"))


@query(f"WITH {SENTENCES}, {LEAK} SELECT lang, doc_id, no, 'english_leak' AS reason FROM stats WHERE alpha >= 4 AND hits >= 3 AND ascii / alpha >= 0.7")
def rejected_sentences(spark, sf_dir):
    rows = with_lang(sentences(spark, sf_dir)).withColumn("reason", filters.reject_reason("sentence", stop_words()))
    return rows.where("reason is not null").select("lang", "doc_id", "no", "reason")


keep_sign = lambda c: f"NOT regexp_matches({c}, '\\p{{S}}') OR ascii({c}) < 128 OR contains('{T.CURRENCY}', {c})"
symbols = lambda x: f"array_to_string(list_filter(string_split({x}, ''), lambda c: {keep_sign('c')}), '')"
START = f"(?:[\\s]*(?:(?:(?:[0-9]{{1,4}}|[ivxlcdm]{{1,8}}|[a-z])[.:)\\]]|[{T.BULLETS}])\\s*))+\\s*"


@query(
    f"""WITH {SENTENCES}, a AS (SELECT lang, trim({spaces(symbols(collapse(brackets(html("replace(sentence, chr(92), '')")))))}) AS x FROM sentences WHERE NOT regexp_matches(sentence, '(?i)http|[=<>|]')),
b AS (SELECT lang, x, list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)) AS ws FROM a WHERE regexp_matches(x, '\\p{{L}}')),
c AS (SELECT lang, x FROM b WHERE lang = 'en' OR NOT coalesce(len(list_filter(ws, lambda w: list_contains({STOP!r}, w))) >= 3 AND len(list_filter(ws, lambda w: regexp_full_match(w, '\\p{{L}}+'))) >= 4
    AND len(list_filter(ws, lambda w: regexp_full_match(w, '[a-z]+'))) >= 0.7 * len(list_filter(ws, lambda w: regexp_full_match(w, '\\p{{L}}+'))), false)),
d AS (SELECT lang, ltrim(x) AS x FROM c), e AS (SELECT lang, CASE WHEN regexp_matches(x, '^[{T.OPENING_QUOTES.replace("'", "''")}]') THEN x ELSE regexp_replace(x, '^(\\s|\\p{{P}})+', '') END AS x FROM d),
f AS (SELECT lang, regexp_replace(x, '(?i)^{START}', '') AS x FROM e), g AS (SELECT lang, ltrim(regexp_replace(x, '^([\\s{T.OPENING_QUOTES.replace("'", "''")},.;:!?…،。！？])+[\\p{{L}}\\p{{Nl}}\\p{{No}}]\\s+', '')) AS x FROM f),
h AS (SELECT lang, trim({spaces(collapse('x'))}) AS sentence FROM g)
SELECT lang, count(*) AS n, sum(length(sentence)) AS n_chars FROM h WHERE sentence <> '' AND NOT regexp_matches(sentence, '(?i)http|[=<>|]') AND {VALID} GROUP BY lang"""
)
def post_clean(spark, sf_dir):
    return filters.post_cleaned(with_lang(sentences(spark, sf_dir)), "sentence", stop_words()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@query(f"""WITH {WORDS}, t AS (SELECT lang, list(word) AS ws FROM ranked WHERE rank <= 40 AND lang IN ('de', 'es', 'fr') GROUP BY lang), {SENTENCES},
s AS (SELECT doc_id, no, sentences.lang, list_transform(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)) AS w FROM sentences),
h AS (SELECT s.lang, t.lang AS leak_lang, len(list_filter(w, lambda x: list_contains(t.ws, x))) AS hits, len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}+'))) AS alpha FROM s, t WHERE s.lang <> t.lang)
SELECT lang, leak_lang, count(*) AS n FROM h WHERE hits >= 3 AND hits >= 0.35 * alpha AND alpha >= 4 GROUP BY ALL""")
def major_latin_hits(spark, sf_dir):
    """Sentences that read like another major language, by its forty commonest words (three languages: three literal lists)."""
    # written once, as each of the three lists is collected from it
    counts = stores.materialized(lexicon.word_counts(docs(spark, sf_dir).where(F.col("lang").isin("de", "es", "fr")), "text"), "counts")
    lists = F.array(*(F.struct(F.lit(k).alias("leak_lang"), flows.word_array(counts, k, 40).alias("ws")) for k in ("de", "es", "fr")))
    rows = sentences(spark, sf_dir).select("lang", T.alpha_count("sentence").alias("alpha"), F.transform(T.words("sentence"), F.lower).alias("w")).where("alpha >= 4")
    hits = rows.select("lang", "alpha", "w", F.inline(lists)).where(F.col("lang") != F.col("leak_lang")).withColumn("hits", filters.hits_in(F.col("w"), F.col("ws")))
    return hits.where((F.col("hits") >= 3) & (F.col("hits") >= 0.35 * F.col("alpha"))).groupBy("lang", "leak_lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS doc_id, lang, md5(trim(text, chr(10) || ' ')) AS key FROM documents GROUP BY lang, trim(text, chr(10) || ' ')")
def first_wins_dedupe(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("sentence"))
    return dedupe.dedupe_sentences(rows, order="doc_id").select("doc_id", "lang", F.md5(T.trim("sentence").cast("binary")).alias("key"))


@query("SELECT source, count(*) AS n_before, count(DISTINCT text) AS n_after, count(*) - count(DISTINCT text) AS n_removed FROM documents GROUP BY source")
def dedupe_summary(spark, sf_dir):
    return dedupe.dedupe_summary(docs(spark, sf_dir), "source", F.md5(F.col("text").cast("binary")))


@query(f"WITH {WORDS} SELECT lang, rank, word, count FROM words")
def lexicon_topn(spark, sf_dir):
    return words(spark, sf_dir)


OVERLAPS = "o AS (SELECT word, list(DISTINCT lang ORDER BY lang) AS ls FROM words GROUP BY word), v AS (SELECT w.*, list_filter(ls, lambda l: l <> w.lang) AS others FROM words AS w JOIN o USING (word))"


@query(f"""WITH {WORDS}, {OVERLAPS} SELECT lang, word, array_to_string(others, ',') AS "overlaps", len(others) > 0 AS is_overlap FROM v""")
def word_overlap(spark, sf_dir):
    return lexicon.with_overlaps(words(spark, sf_dir)).select("lang", "word", F.array_join("overlaps", ",").alias("overlaps"), (F.size("overlaps") > 0).alias("is_overlap"))


@query(f"""WITH {WORDS}, {OVERLAPS}, r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY lang) <= 1 THEN 1.0 ELSE 1 - (row_number() OVER (PARTITION BY lang ORDER BY rank, word) - 1) / (count(*) OVER (PARTITION BY lang) - 1) END AS rr FROM v)
SELECT lang, word, round(rr, 9) AS relative_rank, round((0.35 + 1.75 * rr) * CASE WHEN length(word) <= 3 THEN 1.3 WHEN length(word) <= 5 THEN 1.1 ELSE 1 END * CASE WHEN len(others) > 0 THEN 1.1 ELSE 1 END, 6) AS weight,
greatest(CASE WHEN rr >= 0.85 THEN 3 WHEN rr >= 0.45 THEN 2 ELSE 1 END, CASE WHEN len(others) > 0 THEN 2 ELSE 1 END) AS repeats FROM r""")
def word_weights(spark, sf_dir):
    rows = lexicon.with_relative_rank(lexicon.with_overlaps(words(spark, sf_dir)))
    return rows.select("lang", "word", F.round("relative_rank", 9).alias("relative_rank"), F.round(lexicon.word_weight(), 6).alias("weight"), lexicon.repeats().alias("repeats"))


KEYED = f"k AS (SELECT doc_id, 'wiki' AS source, lang, {hash_of("'42' || chr(0) || 'wiki' || chr(0) || lang || chr(0) || text")} AS h, count(*) OVER (PARTITION BY lang) AS total FROM documents)"
RESERVED = f"{KEYED}, p AS (SELECT *, CASE WHEN h % total < least(total, greatest(4, least(round_even(total * 0.55, 0), 82500))) THEN 'reserved' ELSE 'main' END AS pool, (h // 7) % 8 AS bucket FROM k)"


def as_pool(spark, sf_dir):
    return pools.split_by_hash(docs(spark, sf_dir).select(F.lit("wiki").alias("source"), "lang", "doc_id", F.col("text").alias("sentence")))


@query(f"WITH {RESERVED} SELECT doc_id, lang, pool, bucket FROM p")
def reserve_split(spark, sf_dir):
    return as_pool(spark, sf_dir).select("doc_id", "lang", "pool", "bucket")


@query(f"WITH {RESERVED} SELECT source, lang, count(*) AS total, count(*) FILTER (WHERE pool = 'reserved') AS reserved, count(*) FILTER (WHERE pool = 'main') AS main FROM p GROUP BY ROLLUP (source, lang)")
def pool_stats(spark, sf_dir):
    return pools.pool_stats(as_pool(spark, sf_dir))


@query(f"WITH d AS (SELECT lang, text, min(doc_id) AS doc_id, {hash_of("'42' || chr(0) || lang || chr(0) || text")} AS h FROM documents GROUP BY lang, text) SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, text) - 1 AS idx FROM d")
def numbered_pool(spark, sf_dir):
    rows = dedupe.first_wins(docs(spark, sf_dir).select("lang", "doc_id", F.col("text").alias("sentence")), ["lang", "sentence"], ["doc_id"])
    return pools.numbered(rows, 42, ("lang",)).select("doc_id", "lang", "idx")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def source_cap(spark, sf_dir):
    return dedupe.capped(docs(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"], 20)


@query("SELECT source, least(count(*), 30) AS n_written, greatest(count(*) - 30, 0) AS n_skipped FROM documents GROUP BY source")
def cap_status(spark, sf_dir):
    return dedupe.cap_status(docs(spark, sf_dir), "source", ["doc_id"], 30)


@query("WITH b AS (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) SELECT doc_id, source FROM b WHERE b < 50000")
def running_budget(spark, sf_dir):
    return dedupe.budget(docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 50_000).select("doc_id", "source")


@query("""WITH h AS (SELECT doc_id, source, lang = 'en' AS hit, count(*) FILTER (WHERE lang = 'en') OVER (PARTITION BY source ORDER BY doc_id) AS runs FROM documents),
s AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY source, runs ORDER BY doc_id) AS streak FROM h),
t AS (SELECT *, coalesce(max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s) SELECT doc_id, source, streak FROM t WHERE stopped = 0""")
def miss_streak(spark, sf_dir):
    return dedupe.miss_streak_cut(docs(spark, sf_dir).select("doc_id", "source", "lang"), "source", ["doc_id"], F.col("lang") == "en", 3).select("doc_id", "source", "streak")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) % 5 = 0")
def every_fifth(spark, sf_dir):
    return dedupe.every_nth(docs(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"], 5)


@query("SELECT doc_id, source, round(avg(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 1) AS rolling FROM documents")
def rolling_average(spark, sf_dir):
    return dedupe.rolling_average(docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 25).select("doc_id", "source", "rolling")


@query("WITH s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY lang) SELECT lang, v[cast(round_even((len(v) - 1) * 0.25, 0) AS int) + 1] AS q25, v[cast(round_even((len(v) - 1) * 0.75, 0) AS int) + 1] AS q75 FROM s")
def length_quartiles(spark, sf_dir):
    return dedupe.nearest_rank(docs(spark, sf_dir), "lang", "n_chars", {"q25": 0.25, "q75": 0.75})


@query("""WITH s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY lang),
q AS (SELECT lang, v[cast(round_even((len(v) - 1) * 0.25, 0) AS int) + 1] AS q25, v[cast(round_even((len(v) - 1) * 0.75, 0) AS int) + 1] AS q75 FROM s),
b AS (SELECT doc_id, lang, n_chars, CASE WHEN n_chars <= q25 THEN 0 WHEN n_chars <= q75 THEN 1 ELSE 2 END AS bucket FROM documents JOIN q USING (lang)),
f AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY n_chars DESC, doc_id) <= 20 AS first FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN first THEN bucket ELSE 3 END, n_chars DESC, doc_id) AS place FROM f) SELECT doc_id, lang, bucket FROM p WHERE place <= 60""")
def bucketed_select(spark, sf_dir):
    return dedupe.bucketed_selection(docs(spark, sf_dir), "lang", 60, "n_chars", ("n_chars",), "doc_id").select("doc_id", "lang", "bucket")


CAPACITY = "c AS (SELECT lang, count(*) // 3 AS capacity FROM documents GROUP BY lang)"


@query(f"""WITH {CAPACITY}, s AS (SELECT lang, unnest(range(1, least(capacity, 150) + 1)) AS slot FROM c),
o AS (SELECT lang, row_number() OVER (ORDER BY slot > 1, {hash_of("'7' || chr(0) || lang || chr(0) || slot")}, lang, slot) - 1 AS doc_no FROM s) SELECT doc_no, lang FROM o WHERE doc_no < 150""")
def doc_plan(spark, sf_dir):
    supply = docs(spark, sf_dir).groupBy("lang").agg(F.floor(F.count(F.lit(1)) / 3).alias("capacity"))
    return pools.doc_plan(supply, 150, 7)


@query(f"""WITH {WORDS}, k AS (SELECT lang, word, round(-ln(({hash_of("'3' || chr(0) || lang || chr(0) || word")} + 0.5) / 4294967296.0) / count, 9) AS key FROM words)
SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY key, word) AS place FROM k QUALIFY place <= 25""")
def weighted_sample(spark, sf_dir):
    return pools.weighted_sample(words(spark, sf_dir), "lang", "count", 25, "word", 3).select("lang", "word", "place")


@query(f"SELECT doc_id, CASE WHEN ({hash_of('cast(doc_id AS varchar)')} + 0.5) / 4294967296.0 < 0.95 THEN 'train' ELSE 'eval' END AS split FROM documents")
def train_eval_split(spark, sf_dir):
    return pools.train_eval(docs(spark, sf_dir).select("doc_id"), F.col("doc_id").cast("string"))


def labelled(spark, sf_dir):
    """Token arrays of whole documents with BIO labels, and a split by parity."""
    rows = docs(spark, sf_dir).join(F.broadcast(lang_dim(spark).select("lang", "label")), "lang").withColumn("tokens", T.words("text"))
    rows = rows.where(F.size("tokens") > 0).withColumn("labels", L.bio(F.col("tokens"), "label")).withColumn("input_ids", F.transform("tokens", lambda t: F.pmod(T.md5_number(t), F.lit(500))))
    return rows.select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("eval").alias("split"), "lang", "label", "tokens", "labels", "input_ids", F.array_repeat(F.lit(1), F.size("tokens")).alias("attention_mask"))


LABELLED = f"""l AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'eval' END AS split, list_position({list(LANGUAGES)!r}, lang) - 1 AS label, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS tokens FROM documents),
lab AS (SELECT * FROM l WHERE len(tokens) > 0)"""


@query(f"WITH {LABELLED} SELECT doc_id AS doc, list_sum(list_concat([2 * label + 1], list_transform(tokens[2:], lambda t: 2 * label + 2))) AS total, len(tokens) AS n, label AS present FROM lab")
def bio_labels(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    hot = L.multi_hot(L.languages_present(F.col("labels")))
    return rows.select("doc", F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("labels").alias("n"), (F.array_position(hot, 1) - 1).alias("present"))


@query(f"WITH {LABELLED} SELECT split, lang, count(*) AS n_sentences, sum(len(tokens)) AS n_tokens FROM lab GROUP BY ALL")
def label_counts(spark, sf_dir):
    return reports.label_counts(labelled(spark, sf_dir))


@query(f"""WITH {LABELLED}, t AS (SELECT split, lang, {hash_of('t')} % 500 AS token_id FROM (SELECT split, lang, unnest(tokens) AS t FROM lab)),
g AS (SELECT split, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS lang_group, token_id FROM t)
SELECT split, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(lang_group) = 0 THEN 'group' ELSE 'overall' END AS level, lang, lang_group, token_id, count(*) AS count FROM g
GROUP BY GROUPING SETS ((split, lang, token_id), (split, lang_group, token_id), (split, token_id))""")
def vocabulary_rollup(spark, sf_dir):
    return reports.vocabulary_rollup(labelled(spark, sf_dir))


@query(f"WITH {LABELLED} SELECT max({hash_of('t')} % 500) + 1 AS vocab_size FROM (SELECT unnest(tokens) AS t FROM lab)")
def vocabulary_size(spark, sf_dir):
    return reports.vocabulary_size(labelled(spark, sf_dir))


@query("SELECT source, lang, n, round(100 * n / sum(n) OVER (PARTITION BY source), 2) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)")
def lang_share(spark, sf_dir):
    return reports.with_share(docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), "n", "source")


@query(f"SELECT lang FROM (SELECT unnest({list(LANGUAGES)!r}) AS lang) WHERE lang NOT IN (SELECT DISTINCT lang FROM documents)")
def missing_languages(spark, sf_dir):
    return reports.missing_languages(docs(spark, sf_dir)).select("lang")


@query("SELECT DISTINCT lang AS code, CASE lang WHEN 'eng' THEN 'en' ELSE lang END AS lang FROM documents")
def canonical_languages(spark, sf_dir):
    return with_canonical(docs(spark, sf_dir).select(F.col("lang").alias("code")).distinct(), "code").select("code", "lang")


def spans(spark, sf_dir):
    """Conversation turns as spans: role is the label, length the extent, turn the confidence."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("role").alias("lang"), F.lit(0).alias("start"), F.length("text").alias("end"), (1 / (1 + F.col("turn"))).alias("score"))


SPANS = """s AS (SELECT conv_id AS doc, turn AS pos, role AS lang, greatest(length(text), 1) AS n, 1 / (1 + turn) AS score FROM conversations),
w AS (SELECT *, cast(n * CASE WHEN n <= 4 AND score >= 0.5 THEN 0.35 ELSE 1 END AS double) AS w FROM s WHERE n IS NOT NULL),
a AS (SELECT doc, lang, sum(w) AS char_coverage, sum(w * score) / sum(w) AS avg_confidence, count(*) AS entity_count, min(pos) AS first_pos FROM w GROUP BY ALL),
c AS (SELECT *, char_coverage / sum(char_coverage) OVER (PARTITION BY doc) AS coverage_pct FROM a), r AS (SELECT *, coverage_pct * avg_confidence AS rank_score FROM c)"""


@query(f"WITH {SPANS} SELECT doc, lang, round(char_coverage, 6) AS char_coverage, entity_count, round(coverage_pct, 6) AS coverage_pct, round(avg_confidence, 6) AS avg_confidence, round(rank_score, 6) AS rank_score FROM r")
def span_coverage(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return reports.span_coverage(spans(spark, sf_dir)).select("doc", "lang", r("char_coverage"), "entity_count", r("coverage_pct"), r("avg_confidence"), r("rank_score"))


@query(f"""WITH {SPANS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank_score DESC, first_pos, lang) AS place FROM r),
t AS (SELECT doc, max(lang) FILTER (WHERE place = 1) AS f, max(rank_score) FILTER (WHERE place = 1) AS s1, max(lang) FILTER (WHERE place = 2) AS g, max(rank_score) FILTER (WHERE place = 2) AS s2 FROM p WHERE place <= 2 GROUP BY doc)
SELECT doc, 'assistant' AS true_lang, CASE WHEN coalesce(g = 'assistant' AND s2 >= s1 * 0.5, false) THEN g ELSE coalesce(f, '') END AS pred_lang, coalesce(g = 'assistant' AND s2 >= s1 * 0.5, false) AS by_runner_up FROM t""")
def runner_up_predictions(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return reports.predictions(reports.span_coverage(rows), rows.select("doc").distinct().withColumn("true_lang", F.lit("assistant")), 0.5)


GUESS = "g AS (SELECT doc_id, lang AS true_lang, CASE WHEN text LIKE '%the %' THEN 'en' WHEN text LIKE '%der %' THEN 'de' WHEN text LIKE '%que %' THEN 'es' ELSE 'fr' END AS pred_lang FROM documents)"


def guesses(spark, sf_dir):
    has = lambda x: F.contains("text", F.lit(x))
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("true_lang"), F.when(has("the "), "en").when(has("der "), "de").when(has("que "), "es").otherwise("fr").alias("pred_lang"))


@query(f"WITH {GUESS} SELECT true_lang, count(*) AS total, count(*) FILTER (WHERE true_lang = pred_lang) AS correct, round(count(*) FILTER (WHERE true_lang = pred_lang) / count(*), 6) AS accuracy FROM g GROUP BY ROLLUP (true_lang)")
def accuracy_rollup(spark, sf_dir):
    return reports.accuracy(guesses(spark, sf_dir))


@query(f"WITH {GUESS} SELECT doc_id, true_lang, pred_lang, row_number() OVER (PARTITION BY true_lang ORDER BY doc_id) AS place FROM g WHERE true_lang <> pred_lang QUALIFY place <= 3")
def first_errors(spark, sf_dir):
    return reports.first_errors(guesses(spark, sf_dir), 3, "doc_id")


@query(f"WITH {GUESS}, a AS (SELECT true_lang, count(*) AS total, count(*) FILTER (WHERE true_lang = pred_lang) AS correct, round(count(*) FILTER (WHERE true_lang = pred_lang) / count(*), 6) AS accuracy FROM g GROUP BY true_lang) SELECT * FROM a WHERE total > 5 ORDER BY accuracy DESC, total DESC, true_lang LIMIT 1")
def best_language(spark, sf_dir):
    return reports.best_language(reports.accuracy(guesses(spark, sf_dir)))


@query("""WITH x AS (SELECT l.quality AS g1, l.toxic AS g2, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS p1, CASE WHEN d.doc_id % 9 = 0 THEN 1 ELSE 0 END AS p2 FROM labels AS l JOIN documents AS d USING (doc_id)),
s AS (SELECT round(sum(g1 * p1 + g2 * p2) / sum(p1 + p2), 6) AS p, round(sum(g1 * p1 + g2 * p2) / sum(g1 + g2), 6) AS r, round(avg(CASE WHEN g1 = p1 AND g2 = p2 THEN 1.0 ELSE 0 END), 6) AS e FROM x)
SELECT p AS precision, r AS recall, e AS exact_match, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def micro_scores(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    return reports.micro_scores(x.select(F.array("quality", "toxic").alias("g"), F.array((F.col("n_chars") >= 300).cast("int"), (F.col("doc_id") % 9 == 0).cast("int")).alias("p")), "g", "p")


@query(
    f"""WITH {LABELLED}, n AS (SELECT len(tokens) AS n FROM lab), s AS (SELECT sum(CASE WHEN n <= 96 THEN 1 ELSE 0 END) AS tp, sum(n // 97 + CASE WHEN n % 97 > 0 THEN 1 ELSE 0 END) AS np, count(*) AS ng FROM n)
SELECT tp / np AS precision, tp / ng AS recall, 2.0 * tp / (np + ng) AS f1 FROM s"""
)
def span_scores(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("guess", F.transform("labels", lambda x, i: F.when(i % 97 == 96, F.lit(0).cast("long")).otherwise(x)))
    return reports.span_scores(rows, "labels", "guess")


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), d AS (SELECT lang, count(DISTINCT source) * 12 AS wanted FROM documents GROUP BY lang)
SELECT lang, n, wanted, n - least(n, wanted) AS remaining, round((n - least(n, wanted)) / n, 6) AS headroom, wanted > n AS depleted FROM s JOIN d USING (lang)""")
def capacity_headroom(spark, sf_dir):
    d = docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("source") * 12).alias("wanted"))
    return reports.headroom(d.select("lang", "n"), d.select("lang", "wanted"))


@query("""WITH b AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT string_split_regex(trim(text), '\\s+') AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS w FROM documents))
SELECT doc_id, count(*) AS n_shared FROM d WHERE g IN (SELECT g FROM b) GROUP BY doc_id""")
def benchmark_overlap(spark, sf_dir):
    """Five-word windows that documents share with benchmark items, by a semi join."""
    grams = lambda c: T.bind(F.split(F.trim(c), r"\s+"), lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, 5), " "))))
    b = table(spark, sf_dir, "benchmark").select(F.explode(grams("text")).alias("g")).distinct()
    return docs(spark, sf_dir).select("doc_id", F.explode(grams("text")).alias("g")).join(b, "g", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shared"))


@query()
def wrapped_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.expand_wrapped("text")).alias("n"), F.size(T.split_list("text")).alias("n_items"))


# a round of unwrapping; texts of the tables have fewer wrappers than these rounds
AROUND = "|".join(f"\\{a}.+\\{b}" if a in "([{<" else f"{a}.+{b}" for a, b in T.WRAPPERS).replace("'", "''")
unwrap = lambda t, out: f"SELECT * REPLACE (CASE WHEN regexp_full_match(t, '(?s){AROUND}') AND trim({t}[2:-2]) <> '' THEN trim({t}[2:-2]) ELSE t END AS t) FROM {out}"


@query(
    f"""WITH {SENTENCES}, a AS (SELECT doc_id, no, lang, trim({html(f"trim({spaces('sentence')}, chr(10) || ' ')")}) AS t FROM sentences), b AS ({unwrap('t', 'a')}), c AS ({unwrap('t', 'b')}), d AS ({unwrap('t', 'c')}),
e AS (SELECT doc_id, no, lang, trim({spaces(collapse(f"trim(regexp_replace(t, '(?i)^\\s*(?:(?:[0-9]{{1,4}}|[ivxlcdm]{{1,8}}|[a-z])[.)\\]]\\s+|[{T.BULLETS}]\\s+)', ''))"))}) AS t FROM d),
f AS (SELECT *, rtrim(regexp_extract(t, '(?s)^(.*?)[.!?;:…]+$', 1)) AS body FROM e)
SELECT doc_id, no, CASE WHEN body <> '' THEN body || {list(T.ENDINGS)!r}[1 + {hash_of("'0' || chr(0) || lang || chr(0) || body")} % 5] ELSE t END AS sentence FROM f"""
)
def pool_normalized(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "no", T.pool_normalized("sentence", "lang").alias("sentence"))


def synthetic(spark, sf_dir):
    return synth.build(sentences(spark, sf_dir).select(F.lit("wiki").alias("source"), "lang", "sentence"), 400, repeated=True)


@query()
def synthetic_documents(spark, sf_dir):
    return synthetic(spark, sf_dir)


@query()
def multilabel_rows(spark, sf_dir):
    return synth.multilabel(synth.model_ready(synthetic(spark, sf_dir)))


@query(
    f"""WITH {LABELLED}, d AS (SELECT unnest({list(LANGUAGES)!r}) AS lang, unnest({[GROUP_OF[x] for x in LANGUAGES]!r}) AS lang_group)
SELECT d.lang, lang_group, count(doc_id) AS n_examples, coalesce(sum(len(tokens)), 0) AS n_tokens FROM d LEFT JOIN lab ON lab.lang = d.lang GROUP BY ALL"""
)
def sampling_stats(spark, sf_dir):
    return reports.sampling_stats(labelled(spark, sf_dir))


@query()
def neutral_text(spark, sf_dir):
    out = None
    for name, df in generators.neutral_pools(spark, sentences(spark, sf_dir).where("lang = 'en'"), 2000, 1000).items():
        part = df.select(F.lit(name).alias("pool"), "domain", "text")
        out = part if out is None else out.unionByName(part)
    return out
