"""More queries over the driver's tables: operators that no query of queries.py reaches, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import dims, filters, tables, udfs
from tessella.functions import labels as L
from tessella.functions import noise as N
from tessella.functions import text as T
from tessella.functions.dims import ALIASES, GROUP_OF, LANGUAGES, lang_dim, with_canonical, with_lang
from tessella.operators import capacity, dedupe, lexicon, membership, pools, reports, synth
from tessella.plans import evaluate, flows
from tessella.plans.queries import (
    GUESS, KEYED, LABELLED, LIMITS, OVERLAPS, SENTENCES, SPANS, START, VALID, WORDS, brackets, collapse, digits, docs, guesses, hash_of, html, labelled, query, sentences, spaces, spans, stop_words, symbols, table, tokens, words,
)
from tessella.sources import corpora, stores, variants
from tessella.streaming import ingest, stops

# sentences with list markers, stray quotes, markup and other things around them, by turns
BEFORE = ("", "1) 2) ", "- ", ", b ", "“", "[[link]] {{t}} == h == ", "$a$ \\[ ", "¿ iv. ", "B-", "'n ")
AFTER = ("", "!?", " . x", "”", "'", " 😀 €5", " \\]")
quoted = lambda x: "'" + x.replace("'", "''") + "'"
listed = lambda values: f"[{', '.join(map(quoted, values))}]"
EDGED = f"{SENTENCES}, edged AS (SELECT doc_id, no, lang, {listed(BEFORE)}[1 + no % {len(BEFORE)}] || sentence || {listed(AFTER)}[1 + (no + doc_id) % {len(AFTER)}] AS s FROM sentences)"
QUOTES = T.OPENING_QUOTES.replace("'", "''")
md5 = lambda c: F.md5(c.cast("binary"))


def one_of(values, place):
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def edged(spark, sf_dir):
    return sentences(spark, sf_dir).withColumn("s", F.concat(one_of(BEFORE, F.col("no")), "sentence", one_of(AFTER, F.col("no") + F.col("doc_id"))))


@query(
    f"""WITH {EDGED}, l AS (SELECT *, regexp_replace(s, '^\\s+', '') AS l, regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '[{QUOTES}]+$', '') AS e FROM edged)
SELECT doc_id, no, md5(replace(s, chr(92), '')) AS backslashes, md5({symbols('s')}) AS symbols, md5(CASE WHEN regexp_matches(l, '^[{QUOTES}]') THEN l ELSE regexp_replace(l, '^(\\s|\\p{{P}})+', '') END) AS lead,
md5(regexp_replace(s, '(?i)^{START}', '')) AS starters, md5(regexp_replace(regexp_replace(s, '^([\\s{QUOTES},.;:!?…،。！？])+[\\p{{L}}\\p{{Nl}}\\p{{No}}]\\s+', ''), '^\\s+', '')) AS orphan,
md5(regexp_replace(regexp_replace(s, '([\\s,.;:!?…،。！？])+[\\p{{L}}\\p{{Nl}}\\p{{No}}]$', ''), '\\s+$', '')) AS trailing, md5(regexp_replace(s, '(?s)\\[\\[.*?\\]\\]|\\{{\\{{.*?\\}}\\}}|==.*?==', '', 'g')) AS markup,
md5(regexp_replace(s, '(\\p{{P}}|\\s)+$', '')) AS terminal, md5(translate(s, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) AS rot13,
md5(lower(regexp_replace({spaces("regexp_replace(s, '[^\\p{L}\\p{N}_\\s]+', ' ', 'g')")}, '^\\s+|\\s+$', '', 'g'))) AS phrase,
md5(regexp_replace({spaces("regexp_replace(s, '\\$+|\\\\[\\[\\]()]', '', 'g')")}, '^\\s+|\\s+$', '', 'g')) AS formula, md5(lower(regexp_replace(upper(replace(s, 'ß', 's')), '^[BI]-', ''))) AS label,
md5(regexp_replace(CASE WHEN regexp_matches(e, '^[''’]n\\b') THEN e ELSE regexp_replace(e, '^[{QUOTES}]+', '') END, '^\\s+|\\s+$', '', 'g')) AS quotes FROM l"""
)
def text_edges(spark, sf_dir):
    steps = {
        "backslashes": T.strip_backslashes, "symbols": T.strip_symbols, "lead": T.strip_leading_punct, "starters": T.strip_list_starters, "orphan": T.strip_leading_orphan, "trailing": T.strip_trailing_orphan,
        "markup": T.strip_markup, "terminal": T.strip_terminal_punct, "rot13": T.rot13, "phrase": T.phrase_key, "formula": T.clean_formula, "label": lambda c: T.normalized_label(F.replace(c, F.lit("ß"), F.lit("s"))), "quotes": T.strip_edge_quotes,
    }
    return edged(spark, sf_dir).select("doc_id", "no", *(md5(f("s")).alias(n) for n, f in steps.items()))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain, md5(nfc_normalize(text)) AS composed FROM documents")
def unicode_forms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(udfs.without_marks("text")).alias("plain"), md5(udfs.nfkc("text")).alias("composed"))


@query(f"WITH {SENTENCES} SELECT doc_id, no, md5(strip_accents(sentence)) AS plain FROM sentences")
def accents(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "no", md5(T.strip_accents("sentence")).alias("plain"))


def articles(spark, sf_dir):
    """Documents as articles, their lines as paragraphs."""
    return docs(spark, sf_dir).select("lang", F.col("doc_id").alias("pos"), F.lit("title").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(r"""WITH a AS (SELECT lang, doc_id AS pos, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
b AS (SELECT lang, pos, list_filter(list_transform(string_split_regex(regexp_replace(t, '(?s)\[\[.*?\]\]|\{\{.*?\}\}|==.*?==', '', 'g'), '\n\s*\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM a WHERE length(t) >= 2000),
c AS (SELECT *, (CASE lang WHEN 'en' THEN 0.75 ELSE 0.6 END)::double AS share, len(list_filter(range(1, len(ps)), lambda i: length(ps[i]) >= 500 AND length(ps[i + 1]) >= 500)) > 0 AS streak FROM b WHERE len(ps) > 0),
d AS (SELECT lang, pos, ps[1:greatest(1, floor(len(ps) * CASE WHEN streak THEN least(0.9::double, share + 0.1::double) ELSE share END)::int)] AS ps FROM c),
e AS (SELECT lang, pos, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM d)
SELECT lang, pos, row_number() OVER (PARTITION BY lang, pos ORDER BY length(p) DESC, i) - 1 AS par_no, md5(p) AS paragraph FROM e""")
def article_paragraphs(spark, sf_dir):
    return corpora.article_paragraphs(articles(spark, sf_dir)).select("lang", "pos", "par_no", md5(F.col("paragraph")).alias("paragraph"))


@query("""WITH f AS (SELECT lang, doc_id AS pos, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 100)
SELECT lang, pos, row_number() OVER (PARTITION BY lang ORDER BY n DESC, pos) AS priority FROM f WHERE n >= 2000""")
def priority_articles(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", F.col("doc_id").alias("pos"), "text")
    return corpora.priority_articles(rows, 100).select("lang", "pos", "priority")


@query(f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {hash_of("'5' || chr(0) || lang || chr(0) || doc_id")}, doc_id) AS pos FROM documents")
def shuffled_articles(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", "doc_id", F.col("doc_id").alias("pos"))
    return corpora.shuffled_articles(rows, 5).select("lang", "doc_id", "pos")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS v FROM documents), u AS (SELECT doc_id, unnest(v) AS c, unnest(range(len(v))) AS i FROM l),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY length(c) DESC, i) AS place FROM u) SELECT doc_id, md5(string_agg(c, chr(1) ORDER BY place)) AS longest FROM r WHERE place <= 2 GROUP BY doc_id""")
def longest_chunks(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("many"), F.lit(None).cast("string").alias("whole"))
    return rows.select("doc_id", corpora.longest(corpora.chunks("many", "whole")).alias("x")).where(F.size("x") > 0).select("doc_id", md5(F.array_join("x", "\x01")).alias("longest"))


PARALLEL = """p AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'xx' WHEN doc_id % 5 = 0 THEN NULL ELSE upper(lang) END AS og_language, CAST(85 + doc_id % 20 AS double) / 100 AS og_language_score, n_chars // 6 AS og_token_count,
    CAST(doc_id % 11 - 1 AS double) / 10 AS og_quality_score, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 5 AS double) / 2 END AS edu_score_raw, CAST(doc_id % 4 AS double) AS edu_score, CASE WHEN doc_id % 13 = 0 THEN 'https://en.Wikipedia.org/x' ELSE 'https://x.org' END AS url FROM documents)"""


@query(f"""WITH {PARALLEL}, s AS (SELECT *, coalesce(edu_score_raw, edu_score) AS edu, CASE WHEN og_quality_score >= 0 THEN og_quality_score END AS q FROM p),
r AS (SELECT *, coalesce(q * 10, 0) + coalesce(least(og_token_count / 50.0::double, 4), 0) + CASE WHEN lang = 'en' THEN coalesce(edu, 0) * 2 ELSE 0 END AS score, regexp_matches(url, '(?i)wikipedia(\\.org)?') AS wiki FROM s)
SELECT doc_id, round(score, 6) AS score, wiki, NOT wiki AND og_language_score >= 0.9 AND og_token_count >= 20 AND (og_language IS NULL OR lower(og_language) = lang) AND score >= 0.8 AS row_ok, coalesce(edu >= 1, true) AS translated_ok FROM r""")
def parallel_rows(spark, sf_dir):
    d, i = docs(spark, sf_dir), F.col("doc_id")
    rows = d.select(
        "doc_id", "lang", F.when(i % 7 == 0, "xx").when(i % 5 == 0, None).otherwise(F.upper("lang")).alias("og_language"), ((85 + i % 20) / 100).alias("og_language_score"), F.floor(F.col("n_chars") / 6).alias("og_token_count"),
        ((i % 11 - 1) / 10).alias("og_quality_score"), F.when(i % 3 != 0, (i % 5) / 2).alias("edu_score_raw"), (i % 4).cast("double").alias("edu_score"), F.when(i % 13 == 0, "https://en.Wikipedia.org/x").otherwise("https://x.org").alias("url"),
    )
    return rows.select("doc_id", F.round(filters.row_score(), 6).alias("score"), filters.is_wikipedia("url").alias("wiki"), filters.parallel_row_ok().alias("row_ok"), filters.translated_ok().alias("translated_ok"))


LABELS = ["eng_Latn", "arb_Arab", "plain", "rus_Cyrl", "x_Zzzz"]


@query(f"SELECT doc_id, label, NOT contains(label, '_') OR label NOT IN ('arb_Arab', 'rus_Cyrl') AS ok FROM (SELECT doc_id, unnest({LABELS!r}) AS label FROM documents WHERE doc_id % 50 = 0)")
def label_scripts(spark, sf_dir):
    rows = docs(spark, sf_dir).where("doc_id % 50 = 0").select("doc_id", "lang", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    return with_lang(rows.withColumnRenamed("label", "name")).select("doc_id", F.col("name").alias("label"), filters.label_script_ok("name").alias("ok"))


NAMES = """n AS (SELECT doc_id, no, list_transform(list_filter(regexp_extract_all(sentence, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '\\p{L}+'))[1:2 + no % 6], lambda w, i: CASE WHEN (i + doc_id) % 5 = 0 THEN lower(w) WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END) AS ws FROM sentences)"""


@query(f"""WITH {SENTENCES}, {NAMES}, t AS (SELECT *, len(list_filter(ws, lambda w: regexp_full_match(w, '\\p{{Lu}}\\p{{Ll}}+') OR (regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}')))) AS titled,
    len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Ll}}') AND NOT list_contains({filters.CONNECTORS!r}, lower(w)))) AS others FROM n)
SELECT doc_id, no, len(ws) BETWEEN 3 AND 6 AND titled / len(ws) >= 0.8 AND others = 0 AND len(ws) <= 5 AND titled >= len(ws) - 1 AS is_name FROM t WHERE len(ws) > 0""")
def titlecase_names(spark, sf_dir):
    ws = F.transform(F.slice(T.alpha_words("sentence"), 1, (2 + F.col("no") % 6).cast("int")), lambda w, i: F.when((i + 1 + F.col("doc_id")) % 5 == 0, F.lower(w)).when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w))
    rows = sentences(spark, sf_dir).select("doc_id", "no", F.lit("xh").alias("lang"), F.array_join(ws, " ").alias("s")).where("s <> ''")
    return with_lang(rows).select("doc_id", "no", filters.titlecase_entity("s").alias("is_name"))


TOPS = "tops AS (SELECT lang, list(word) AS ws FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM counts) WHERE rank <= {n} GROUP BY lang)"
AS_WORDS = "v AS (SELECT doc_id, no, lang, list_transform(regexp_extract_all(sentence, '[\\p{L}\\p{N}_]+'), lambda w: lower(w)) AS w FROM sentences), a AS (SELECT *, len(list_filter(w, lambda x: regexp_full_match(x, '\\p{L}+'))) AS alpha, len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]+'))) AS ascii FROM v)"
STOPS = "the of and to in that is was for it with as on be at by this from".split()


@query(f"""WITH {WORDS}, {TOPS.format(n=60)}, {SENTENCES}, {AS_WORDS}, b AS (SELECT ws AS b FROM tops WHERE lang = 'en'),
h AS (SELECT a.*, len(list_filter(w, lambda x: list_contains({STOPS!r}, x))) AS hits, len(list_filter(w, lambda x: list_contains(b, x) OR (suffix(x, 's') AND list_contains(b, x[:-2])) OR (suffix(x, 'ies') AND length(x) > 3 AND list_contains(b, x[:-4] || 'y')))) AS wide FROM a, b)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE alpha >= 4 AND hits >= 1 AND ascii >= 0.7 * alpha AND hits + wide >= 2 AND (hits + wide) / alpha >= 0.35 AND ascii / alpha >= 0.75) AS n_leaks FROM h GROUP BY lang""")
def english_leak_policy(spark, sf_dir):
    """The rule of minor Latin languages, with a wide list of English words; sentences count as Swahili."""
    counts = stores.materialized(lexicon.word_counts(docs(spark, sf_dir).where("lang = 'en'"), "text"), "counts")
    rows = with_lang(sentences(spark, sf_dir).select(F.col("lang").alias("own"), F.lit("sw").alias("lang"), "sentence"))
    rows = rows.select("own", filters.english_leak("sentence", STOPS, flows.top_words(counts, "en", 60)).alias("leak"))
    return rows.groupBy(F.col("own").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.count_if("leak").alias("n_leaks"))


@query(f"""WITH {WORDS}, {TOPS.format(n=40)}, {SENTENCES}, {AS_WORDS}, h AS (SELECT a.lang, a.doc_id, a.no, alpha, max(len(list_filter(w, lambda x: list_contains(t.ws, x)))) AS hits FROM a, (SELECT * FROM tops WHERE lang IN ('de', 'es', 'fr')) AS t GROUP BY ALL)
SELECT lang, count(*) FILTER (WHERE alpha >= 4 AND hits >= 3 AND hits >= 0.35 * alpha) AS n_leaks FROM h GROUP BY lang""")
def major_latin_leaks(spark, sf_dir):
    """The rule itself, by lexicons of three languages; sentences count as Swahili."""
    counts = stores.materialized(lexicon.word_counts(docs(spark, sf_dir).where(F.col("lang").isin("de", "es", "fr")), "text"), "counts")
    lists = {k: flows.top_words(counts, k, 40) for k in ("de", "es", "fr")}
    rows = with_lang(sentences(spark, sf_dir).select(F.col("lang").alias("own"), F.lit("sw").alias("lang"), "sentence"))
    rows = rows.select("own", filters.major_latin_leak("sentence", lists).alias("leak"))
    return rows.groupBy(F.col("own").alias("lang")).agg(F.count_if("leak").alias("n_leaks"))


ENGLISH = "(SELECT word FROM counts WHERE lang = 'en' AND n >= 2)"


@query(f"""WITH {WORDS}, {SENTENCES}, d AS {ENGLISH}, p AS (SELECT word FROM d UNION SELECT word || 's' FROM d UNION SELECT word[:-2] || 'ies' FROM d WHERE suffix(word, 'y') AND length(word) > 1),
w AS (SELECT doc_id, no, unnest(list_transform(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))) AS word FROM sentences)
SELECT doc_id, no, count(*) AS hits FROM w JOIN p USING (word) GROUP BY ALL""")
def dictionary_hits(spark, sf_dir):
    """Words of every sentence that all English documents together have twice, or that are plurals of such words."""
    counts = lexicon.word_counts(docs(spark, sf_dir), "text").where("lang = 'en' and count >= 2")
    rows = sentences(spark, sf_dir).select(F.struct("doc_id", "no").alias("key"), "sentence")
    return membership.word_hits(rows, "key", "sentence", membership.with_plurals(stores.materialized(counts.select("word"), "english"))).select("key.*", "hits")


@query(f"""WITH {WORDS}, {SENTENCES}, {AS_WORDS}, e AS {ENGLISH}, st AS (SELECT unnest({STOPS!r}) AS word), p AS (SELECT word FROM e UNION SELECT word || 's' FROM e UNION SELECT word[:-2] || 'ies' FROM e WHERE suffix(word, 'y') AND length(word) > 1),
u AS (SELECT doc_id, no, unnest(w) AS word FROM v), h AS (SELECT doc_id, no, count(*) AS hits FROM u JOIN st USING (word) GROUP BY ALL), b AS (SELECT doc_id, no, count(*) AS wide FROM u JOIN p USING (word) GROUP BY ALL)
SELECT a.lang, count(*) AS n, count(*) FILTER (WHERE alpha >= 4 AND hits >= 1 AND ascii >= 0.7 * alpha AND hits + coalesce(wide, 0) >= 2 AND (hits + coalesce(wide, 0)) / alpha >= 0.35 AND ascii / alpha >= 0.75) AS n_leaks
FROM a LEFT JOIN h USING (doc_id, no) LEFT JOIN b USING (doc_id, no) GROUP BY a.lang""")
def dictionary_leaks(spark, sf_dir):
    """The rule on English leaks with the whole English vocabulary of the documents as the wide list; sentences count as Swahili."""
    counts = lexicon.word_counts(docs(spark, sf_dir), "text").where("lang = 'en' and count >= 2")
    stop = spark.createDataFrame([(w,) for w in STOPS], "word string")
    rows = with_lang(sentences(spark, sf_dir).select(F.struct("doc_id", "no").alias("key"), F.col("lang").alias("own"), F.lit("sw").alias("lang"), "sentence"))
    out = membership.english_leaks(rows, "key", "sentence", stop, stores.materialized(counts.select("word"), "english"))
    return out.groupBy(F.col("own").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.count_if("leak").alias("n_leaks"))


@query(f"""WITH {SENTENCES}, t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda w: lower(w)) AS ws FROM documents), p AS (SELECT DISTINCT array_to_string(ws[1:2 + doc_id % 2], ' ') AS phrase FROM t WHERE len(ws) >= 3),
w AS (SELECT doc_id, no, list_transform(regexp_extract_all(sentence, '\\p{{L}}+'), lambda w: lower(w)) AS ws FROM sentences), g AS (SELECT doc_id, no, unnest(list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) AS phrase FROM w)
SELECT DISTINCT doc_id, no, how FROM g JOIN p USING (phrase), (SELECT unnest(['automaton', 'join']) AS how)""")
def phrase_sentences(spark, sf_dir):
    """Sentences with the first words of any document in them, by an automaton and by a join."""
    begins = docs(spark, sf_dir).select("doc_id", T.first_letter_words("text", 3).alias("ws")).where("ws <> ''")
    phrases = stores.materialized(begins.select(F.call_function("substring_index", "ws", F.lit(" "), (2 + F.col("doc_id") % 2).cast("int")).alias("phrase")).distinct(), "phrases")
    # written once, as either way reads it
    rows = stores.materialized(sentences(spark, sf_dir).select(F.struct("doc_id", "no").alias("key"), T.letter_words("sentence").alias("s")), "letters")
    by = lambda how, most: membership.phrase_hits(rows, "key", "s", phrases, most).select("key.*", F.lit(how).alias("how"))
    return by("automaton", membership.AUTOMATON).unionByName(by("join", 0))


@query(f"""WITH {SENTENCES}, r AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS t FROM documents), p AS (SELECT doc_id, len(t) AS n, (len(t) + 99) // 100 AS parts FROM r)
SELECT lang, count(*) AS n, sum(length(sentence)) AS n_chars, sum(no) AS numbers, (SELECT sum(parts) FROM p JOIN documents AS d USING (doc_id) WHERE d.lang = s.lang)::bigint AS records, (SELECT sum(p.n) FROM p JOIN documents AS d USING (doc_id) WHERE d.lang = s.lang)::bigint AS tokens
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS place FROM sentences) AS s GROUP BY lang""")
def lateral_sentences(spark, sf_dir):
    """Sentences and records of 100 tokens by table functions that SQL calls by name."""
    tables.register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("lateral_documents")
    parts = spark.sql("SELECT d.lang, count(*) AS n, sum(length(s.sentence)) AS n_chars, sum(s.no) AS numbers FROM lateral_documents AS d, LATERAL split_sentences(d.text) AS s GROUP BY d.lang")
    records = spark.sql("SELECT d.lang, count(*) AS records, sum(r.n_tokens) AS tokens FROM lateral_documents AS d, LATERAL text_records(d.text, 100) AS r GROUP BY d.lang")
    return parts.join(records, "lang")


@query("""SELECT conv_id, round(sum(turn * length(text)) / sum(length(text))::double, 6) AS score FROM conversations GROUP BY conv_id HAVING sum(length(text)) > 0""")
def chunk_scores(spark, sf_dir):
    """Mean of a conversation's turns by their lengths, with an aggregate that SQL calls by name."""
    tables.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("chunk_turns")
    return spark.sql("SELECT conv_id, round(chunk_score(cast(turn AS double), cast(length(text) AS double)), 6) AS score FROM chunk_turns GROUP BY conv_id").where("score is not null")


@query("""WITH e AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || (props->>'$.k') || ', 7]' WHEN 2 THEN to_json('[' || (props->>'$.k') || ']')::varchar ELSE substr(props, 1, length(props) - 1) END AS raw, (props->>'$.k')::bigint AS k FROM events)
SELECT event_type, event_id % 4 AS shape, count(*) AS n, sum(CASE event_id % 4 WHEN 1 THEN k + 7 WHEN 2 THEN k END)::bigint AS total, count(*) FILTER (WHERE event_id % 4 IN (1, 2)) AS lists, sum(CASE WHEN event_id % 4 = 0 THEN k END)::bigint AS field FROM e GROUP BY ALL""")
def variant_lists(spark, sf_dir):
    """Properties of events as objects, as lists, as lists in text, and broken, by turns: what reads as a list of numbers, and what has a field."""
    shape, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    raw = F.when(shape == 0, F.col("props")).when(shape == 1, F.concat(F.lit("["), k, F.lit(", 7]"))).when(shape == 2, F.concat(F.lit('"['), k, F.lit(']"'))).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    rows = table(spark, sf_dir, "events").select("event_type", shape.alias("shape"), raw.alias("raw"))
    rows = rows.select("event_type", "shape", variants.list_or_json(rows, "raw").alias("list"), F.try_variant_get(variants.parsed("raw"), "$.k", "bigint").alias("k"))
    total = F.aggregate("list", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("event_type", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.count("list").alias("lists"), F.sum("k").alias("field"))


@query("""WITH e AS (SELECT user_id, event_type, (props->>'$.k')::bigint AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos FROM events)
SELECT user_id, event_type, count(*) AS n, sum(k)::bigint AS total, sum(k * pos)::bigint AS placed FROM e GROUP BY ALL""")
def variant_maps(spark, sf_dir):
    """A user's events as one map-shaped text (event type to list), and read back entry by entry."""
    lists = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("event_id", "k"))).alias("l"))
    maps = lists.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.transform("l", lambda x: x["k"]))))).alias("raw"))
    out = variants.map_entries(maps, "raw").withColumn("k", F.col("value").cast("long"))
    return out.groupBy("user_id", F.col("key").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.sum(F.col("k") * F.col("pos")).alias("placed"))


# letters that stand for a to z where sentences are written in another script
SCRIPTS = {"ru": ("Cyrillic", "абвгдежзийклмнопрстуфхцчшщ"), "el": ("Greek", "αβγδεζηθικλμνξοπρστυφχψωάέή"[:26]), "hi": ("Devanagari", "कखगघङचछजझञटठडढणतथदधनपफबभमय"), "he": ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשתךםןף"), "fr": ("Latin", "abcdefghijklmnopqrstuvwxyz")}
TONGUES, ABC = tuple(SCRIPTS), "abcdefghijklmnopqrstuvwxyz"
SEEN = ("Latin", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Hiragana", "Katakana", "Han", "Hangul", "Greek", "Thai")
without = lambda own: "[" + "".join(rf"\p{{{x}}}" for x in SEEN if x != own) + "]"
by_lang = lambda of: "CASE lang " + " ".join(f"WHEN '{k}' THEN {of(*v)}" for k, v in SCRIPTS.items()) + " END"
# every seventh sentence stays in Latin letters, whatever its language
WRITTEN = f"{SENTENCES}, l AS (SELECT doc_id, no, doc_id * 100000 + no AS pos, {list(TONGUES)!r}[1 + (no + doc_id) % {len(TONGUES)}] AS lang, sentence FROM sentences), written AS (SELECT doc_id, no, pos, lang, CASE WHEN no % 7 = 3 THEN sentence ELSE {by_lang(lambda script, letters: f"translate(sentence, '{ABC}', '{letters}')")} END AS text FROM l)"
KEEP = by_lang(lambda script, letters: f"regexp_replace(text, '{without(script)}', '', 'g')")
HAS = by_lang(lambda script, letters: rf"regexp_matches(s, '\p{{{script}}}')")


def written(spark, sf_dir):
    """Sentences in five scripts: doc_id, no, pos, lang, text."""
    lang = one_of(TONGUES, F.col("no") + F.col("doc_id"))
    rows = sentences(spark, sf_dir).select("doc_id", "no", (F.col("doc_id") * 100000 + F.col("no")).alias("pos"), lang.alias("lang"), "sentence")
    text = F.col("sentence")
    for k, (_, letters) in SCRIPTS.items():
        text = F.when((F.col("lang") == k) & (F.col("no") % 7 != 3), F.translate("sentence", ABC, letters)).otherwise(text)
    return rows.withColumn("text", text).drop("sentence")


@query(f"""WITH {WRITTEN}, k AS (SELECT pos, lang, {KEEP} AS s FROM written), c AS (SELECT pos, lang, trim(s) AS sentence FROM k WHERE {HAS})
SELECT pos, lang, md5(sentence) AS sentence FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY pos) <= round_even(150000 * (CASE lang {' '.join(f"WHEN '{k}' THEN {dims.TATOEBA_MULTIPLIERS[k]}" for k in TONGUES if k in dims.TATOEBA_MULTIPLIERS) or "WHEN '' THEN 1"} ELSE 1 END)::double, 0)""")
def scripted_sentences(spark, sf_dir):
    """Letters of other scripts go, and rows without own letters; sentences written in five scripts."""
    return corpora.tab_sentences(written(spark, sf_dir)).select("pos", "lang", md5(F.col("sentence")).alias("sentence"))


@query(f"""WITH {WRITTEN}, k AS (SELECT pos, lang, text, {KEEP} AS s FROM written)
SELECT pos, s <> text AS foreign_letters, s <> text AS contaminated, CASE WHEN s <> text AND NOT {HAS} THEN 'mixed_script' END AS reason FROM k WHERE lang <> 'fr'""")
def scripted_reasons(spark, sf_dir):
    rows = with_lang(written(spark, sf_dir).where("lang <> 'fr'"))
    return rows.select("pos", filters.has_foreign_letters("text").alias("foreign_letters"), filters.is_script_contaminated("text").alias("contaminated"), filters.reject_reason("text", stop_words()).alias("reason"))


@query(f"""WITH {WRITTEN}, h AS (SELECT pos, lang, {collapse(brackets(html("replace(text, chr(92), '')")))} AS text FROM written WHERE lang <> 'fr'), k AS (SELECT pos, lang, {KEEP} AS s FROM h)
SELECT pos, md5(CASE WHEN {HAS} THEN trim({spaces(symbols('s'))}) ELSE '' END) AS sentence FROM k""")
def cleaned_examples(spark, sf_dir):
    """The cleaning chain on sentences of four scripts other than Latin."""
    rows = with_lang(written(spark, sf_dir).where("lang <> 'fr'").withColumnRenamed("text", "sentence"))
    return filters.cleaned(rows, "sentence", stop_words()).select("pos", md5(F.col("sentence")).alias("sentence"))


WRAPPED = [
    ('"Je vais tres bien aujourd\'hui. Merci beaucoup pour votre aide."', ["Je vais tres bien aujourd'hui.", "Merci beaucoup pour votre aide."]), ("(plain words)", ["plain words"]), ("'n huis is mooi.", ["'n huis is mooi."]),
    ("[(«{“deep words here”}»)]", ["deep words here"]), ("no wrapper here. Two of them here.", ["no wrapper here.", "Two of them here."]), ("Short. then lower case.", ["Short. then lower case."]),
]


@query(f"SELECT doc_id, {listed([chr(1).join(v) for _, v in WRAPPED])}[1 + doc_id % {len(WRAPPED)}] AS parts FROM documents")
def wrapped_examples(spark, sf_dir):
    """Wrapped fragments, five wrappers deep among them, one for each document by turns."""
    rows = docs(spark, sf_dir).select("doc_id", one_of([s for s, _ in WRAPPED], F.col("doc_id")).alias("s"))
    return rows.select("doc_id", F.array_join(T.expand_wrapped("s"), "\x01").alias("parts"))


@query(f"""WITH {SENTENCES}, w AS (SELECT doc_id, no, lang, sentence, '([' || sentence || '])' AS wrapped FROM sentences WHERE NOT regexp_matches(sentence, '^\\s|\\s$|[()\\[\\]{{}}<>]|^[{QUOTES}]|[{QUOTES}]$'))
SELECT doc_id, no, md5(sentence) AS inner FROM w""")
def unwrapped(spark, sf_dir):
    rows = sentences(spark, sf_dir).where(~F.col("sentence").rlike(rf"^\s|\s$|[()\[\]{{}}<>]|^[{T.OPENING_QUOTES}]|[{T.OPENING_QUOTES}]$"))
    return rows.select("doc_id", "no", md5(T.strip_wrappers(F.concat(F.lit("(["), "sentence", F.lit("])")))).alias("inner"))


ITEMS = "i AS (SELECT doc_id, lang, '1) ' || w[1] || ' ' || repeat('word ', 12) || '2) ' || w[2] || ' ' || repeat('more ', 12) || 'iii. ' || w[3] || ' end' AS s FROM (SELECT doc_id, lang, regexp_extract_all(text, '[\\p{L}]+') AS w FROM documents) WHERE len(w) >= 3)"


@query(f"WITH {ITEMS}, p AS (SELECT doc_id, unnest(string_split(regexp_replace(s, ' (2\\)|iii\\.) ', chr(1) || '\\1 ', 'g'), chr(1))) AS p, unnest(range(3)) AS no FROM i) SELECT doc_id, no, md5(trim(p)) AS item FROM p")
def enumerations(spark, sf_dir):
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))
    rows = docs(spark, sf_dir).select("doc_id", w.alias("w")).where(F.size("w") >= 3)
    s = F.concat(F.lit("1) "), F.col("w")[0], F.lit(" "), F.repeat(F.lit("word "), 12), F.lit("2) "), F.col("w")[1], F.lit(" "), F.repeat(F.lit("more "), 12), F.lit("iii. "), F.col("w")[2], F.lit(" end"))
    return rows.select("doc_id", F.posexplode(T.split_list(s)).alias("no", "item")).select("doc_id", "no", md5(F.col("item")).alias("item"))


@query(f"WITH {WORDS} SELECT lang, word, count AS freq, rank, false AS contaminated FROM words WHERE rank <= 200 AND count >= 5")
def frequency_words(spark, sf_dir):
    """Frequency lists with the number before the word in one language and behind it in the others."""
    w = words(spark, sf_dir)
    line = F.when(F.col("lang") == "de", F.concat_ws(" ", "count", "word")).otherwise(F.concat_ws("\t", "word", "count"))
    return lexicon.word_list(w.select("lang", (F.col("rank") - 1).cast("int").alias("pos"), line.alias("line")), 200)


@query(f"""WITH {WORDS}, {OVERLAPS} SELECT lang, word, NOT (lang = 'de' AND len(list_intersect(others, ['en', 'es', 'fr'])) > 0) AS keeps FROM v""")
def kept_words(spark, sf_dir):
    """Words that a minor Latin language shares with a major one go; German counts as Swahili here."""
    rows = lexicon.with_overlaps(words(spark, sf_dir)).withColumn("own", F.col("lang")).withColumn("lang", F.when(F.col("lang") == "de", "sw").otherwise(F.col("lang")))
    return with_lang(rows).select(F.col("own").alias("lang"), "word", lexicon.keeps_word().alias("keeps"))


hash52 = lambda key: f"cast(('0x' || substr(md5({key}), 1, 13)) as bigint)"


ALL_WORDS = WORDS.replace("WHERE rank <= 300", "")


@query(f"""WITH {ALL_WORDS}, {OVERLAPS}, r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY lang) <= 1 THEN 1.0 ELSE 1 - (row_number() OVER (PARTITION BY lang ORDER BY rank, word) - 1) / (count(*) OVER (PARTITION BY lang) - 1) END AS rr FROM v),
w AS (SELECT lang, word, greatest(1, round(round(((0.35 + 1.75 * rr) * CASE WHEN length(word) <= 3 THEN 1.3 WHEN length(word) <= 5 THEN 1.1 ELSE 1 END * CASE WHEN len(others) > 0 THEN 1.1 ELSE 1 END)::double, 9) * 1000000)::bigint) AS w,
    greatest(CASE WHEN rr >= 0.85 THEN 3 WHEN rr >= 0.45 THEN 2 ELSE 1 END, CASE WHEN len(others) > 0 THEN 2 ELSE 1 END) AS reps FROM r),
c AS (SELECT *, (sum(w) OVER (PARTITION BY lang ORDER BY word ROWS UNBOUNDED PRECEDING) - w)::bigint AS lo, sum(w) OVER (PARTITION BY lang) AS total FROM w),
e AS (SELECT lang, word, total, unnest(range(1, reps + 1)) AS n FROM c), a AS (SELECT *, unnest(range(5)) AS k FROM e WHERE n > 1),
x AS (SELECT *, ({hash52("'42' || chr(0) || lang || chr(0) || word || chr(0) || n || chr(0) || k")}::hugeint * total // 4503599627370496)::bigint AS x FROM a),
m AS (SELECT lang, lo AS place, 0 AS kind, word AS begins, NULL AS word, NULL AS n, NULL AS k FROM c UNION ALL SELECT lang, x, 1, NULL, word, n, k FROM x),
d AS (SELECT lang, word, n, k, other FROM (SELECT *, last_value(begins IGNORE NULLS) OVER (PARTITION BY lang ORDER BY place, kind ROWS UNBOUNDED PRECEDING) AS other FROM m) WHERE kind = 1),
f AS (SELECT lang, word, n, other, min(k) AS k FROM d WHERE other <> word GROUP BY ALL),
p AS (SELECT lang, word, n, other FROM f QUALIFY row_number() OVER (PARTITION BY lang, word, n ORDER BY k) < n UNION ALL SELECT lang, word, n, word FROM e),
t AS (SELECT lang, word, n, string_agg(other, ' ' ORDER BY {hash_of("'42' || chr(0) || lang || chr(0) || word || chr(0) || n || chr(0) || 'order' || chr(0) || other")}, other) AS text FROM p GROUP BY ALL)
SELECT lang, word, n, ['unigram', 'bigram', 'trigram'][n] AS source_type, text, (n * (2 * (list_position({list(LANGUAGES)!r}, lang) - 1) + 2) - 1)::bigint AS label_sum FROM t""")
def short_text_examples(spark, sf_dir):
    """Short texts of all words: the other words of a text are drawn by weight from the whole vocabulary of its language."""
    out = lexicon.short_examples(lexicon.with_relative_rank(lexicon.with_overlaps(words(spark, sf_dir, 1 << 30))))
    return out.select("lang", "word", "n", "source_type", "text", F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 6 AS part, ntile(7) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS chunk FROM documents")
def dealt_parts(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return pools.chunked(pools.striped(rows, 6, "lang", ("doc_id",)), 7, "lang", ("doc_id",))


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {hash_of("'42' || chr(0) || lang || chr(0) || text")}, text, doc_id) <= 25 THEN 'reserved' ELSE 'main' END AS pool FROM (SELECT lang, text, min(doc_id) AS doc_id FROM documents GROUP BY ALL)")
def exact_reserve(spark, sf_dir):
    rows = dedupe.first_wins(docs(spark, sf_dir).select("lang", "doc_id", F.col("text").alias("sentence")), ["lang", "sentence"], ["doc_id"])
    return pools.exact_reserve(rows, F.lit(25)).select("doc_id", "pool")


@query("SELECT d.doc_id FROM documents AS d WHERE NOT EXISTS (SELECT 1 FROM documents AS s WHERE s.doc_id % 3 = 0 AND s.lang IS NOT DISTINCT FROM d.lang AND s.n_chars // 10 IS NOT DISTINCT FROM d.n_chars // 10)")
def unseen_rows(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", F.floor(F.col("n_chars") / 10).alias("size"))
    return dedupe.unseen(rows, rows.where("doc_id % 3 = 0"), ["lang", "size"]).select("doc_id")


@query("SELECT DISTINCT source || '_' || lang AS config FROM documents WHERE lang <> 'en'")
def pending_configs(spark, sf_dir):
    configs = docs(spark, sf_dir).select(F.concat_ws("_", "source", "lang").alias("config"), "lang").distinct()
    return stores.pending(configs.select("config"), configs.where("lang = 'en'")).select("config")


@query("SELECT DISTINCT source || '__' || lang || '_en_x' AS config, lang AS source_lang, 'en_x' AS target_lang FROM documents")
def parsed_configs(spark, sf_dir):
    configs = docs(spark, sf_dir).select(F.concat("source", F.lit("__"), "lang", F.lit("_en_x")).alias("config")).distinct()
    return configs.withColumn("p", corpora.parse_config("config")).select("config", "p.*")


CONFIGS = ["all", "fra_Latn", "hin_Latn", "hin_Deva", "qqq_Latn", "rus_Cyrl", "cmn_Hani", "srp_Latn", "ENG_Latn"]


@query(f"WITH m AS (SELECT * FROM (VALUES ('fra_Latn', 'fr'), ('hin_Deva', 'hi'), ('rus_Cyrl', 'ru'), ('cmn_Hani', 'zh'), ('ENG_Latn', 'en')) AS x(config, lang)) SELECT config, m.lang, count(*) AS n FROM (SELECT {CONFIGS!r}[1 + doc_id % {len(CONFIGS)}] AS config FROM documents) JOIN m USING (config) GROUP BY ALL")
def matched_configs(spark, sf_dir):
    """Documents dealt to configurations: those of known languages and their scripts."""
    rows = docs(spark, sf_dir).select(one_of(CONFIGS, F.col("doc_id")).alias("config"))
    return corpora.matching_configs(rows).groupBy("config", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, doc_id + n_chars AS total, 2 AS n FROM documents")
def decoded_lists(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.to_json(F.array("doc_id", "n_chars")).alias("j"))
    return rows.withColumn("x", L.decoded_list("j")).select("doc_id", F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size("x").alias("n"))


@query(f"""WITH {LABELLED}, m AS (SELECT doc_id AS doc, label, least(len(tokens), 510) AS n FROM lab) SELECT doc, n + 2 AS n_ids, n + 2 AS n_mask, -200 + (2 * label + 1) + (n - 1) * (2 * label + 2) AS label_sum FROM m""")
def model_inputs(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc", L.model_inputs(F.col("input_ids"), F.col("labels"), 1, 2).alias("m"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc", F.size("m.input_ids").alias("n_ids"), total("m.attention_mask").alias("n_mask"), total("m.labels").alias("label_sum"))


@query(f"""WITH {LABELLED}, p AS (SELECT doc_id AS doc, label, list_sum(list_transform(tokens, lambda t: (length(t) + 3) // 4)) AS n FROM lab) SELECT doc, n AS n_pieces, (2 * label + 1) + (n - 1) * (2 * label + 2) AS label_sum FROM p""")
def wordpieces(spark, sf_dir):
    """Words cut into pieces of four characters: the first piece of a text has the B- label."""
    ids = F.flatten(F.transform("tokens", lambda t, i: F.array_repeat(i, F.ceil(F.length(t) / 4).cast("int"))))
    rows = labelled(spark, sf_dir).select("doc", L.wordpiece_labels(ids, F.col("labels")).alias("x"))
    return rows.select("doc", F.size("x").alias("n_pieces"), F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\s\\p{L}\\p{M}\\p{N}_]') AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda x: NOT regexp_full_match(x, '▁?\\p{P}+'))) AS n_kept FROM t")
def punct_dropped(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.tokens("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(L.drop_punct(F.col("t"))).alias("n_kept"))


@query(f"""WITH l AS (SELECT unnest({list(LANGUAGES)!r}) AS lang, unnest(range({len(LANGUAGES)})) AS i), b AS (SELECT lang, i, unnest([0, 1]) AS k FROM l), d AS (SELECT {list(LANGUAGES)!r}[1 + doc_id % {len(LANGUAGES)}] AS lang, n_chars FROM documents)
SELECT 2 * i + 1 + k AS label_id, ['B-', 'I-'][k + 1] || upper(lang) AS label, lang, k = 0 AS begins, count(*) AS n, sum(n_chars) AS n_chars FROM b JOIN d USING (lang) GROUP BY ALL""")
def label_ids(spark, sf_dir):
    """Documents dealt to all languages, by the two labels of their language."""
    rows = docs(spark, sf_dir).select(one_of(list(LANGUAGES), F.col("doc_id")).alias("lang"), "n_chars")
    return rows.join(F.broadcast(L.label_dim(spark)), "lang").groupBy("label_id", "label", "lang", "begins").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


u = lambda key, name: f"(({hash_of(f"{key} || chr(0) || '{name}'")}) + 0.5) / 4294967296.0"
at = lambda key, name, n: f"floor({u(key, name)} * {n})::int"
NOISE_KEY = "(doc_id || '-' || no)"
half = lambda w: f"{w}[1:length({w}) // 2] || ' ' || {w}[length({w}) // 2 + 1:]"
shout = lambda w: f"upper(replace({w}, 'ß', 'ss'))"
signed = lambda name, sign: f"CASE WHEN {u(NOISE_KEY, name)} < 0.5 AND len(v) > 1 THEN array_to_string(list_concat(v[1:1 + {at(NOISE_KEY, f'{name}-at', '(len(v) - 1)')}], [{sign}], v[2 + {at(NOISE_KEY, f'{name}-at', '(len(v) - 1)')}:]), ' ') ELSE s END"
letter = lambda letters: f"CASE WHEN {u(NOISE_KEY, 'capital')} < 0.5 THEN upper('{letters}'[1 + {at(NOISE_KEY, 'letter-sign', len(letters))}]) ELSE '{letters}'[1 + {at(NOISE_KEY, 'letter-sign', len(letters))}] END"


@query(
    f"""WITH {SENTENCES}, x AS (SELECT doc_id, no, lang, sentence AS s, string_split(sentence, ' ') AS w, string_split(trim(regexp_replace(sentence, '\\s+', ' ', 'g')), ' ') AS v FROM sentences),
y AS (SELECT *, {at(NOISE_KEY, 'gap', 'len(w)')} AS g FROM x)
SELECT doc_id, no, md5(array_to_string(list_transform(w, lambda v, i: CASE WHEN {u(f"{NOISE_KEY} || chr(0) || (i - 1)", 'case')} < 0.3 THEN {shout('v')} WHEN {u(f"{NOISE_KEY} || chr(0) || (i - 1)", 'case')} < 0.6 THEN lower(v) ELSE v END), ' ')) AS casing,
md5(CASE WHEN {u(NOISE_KEY, 'sentence')} < 0.3 THEN {shout('s')} WHEN {u(NOISE_KEY, 'sentence')} < 0.3::double + 0.3::double THEN lower(s) ELSE s END) AS whole,
md5({signed('digit', f"'0123456789'[1 + {at(NOISE_KEY, 'digit-sign', 10)}]")}) AS digit, md5({signed('letter', letter('abcdefghijklmnopqrstuvwxyz'))}) AS letter, md5({signed('letter', letter('абвгдежзийклмнопрстуфхцчшщэюя'))}) AS cyrillic, md5(s) AS greek,
md5(CASE WHEN len(w) > 1 AND {u(NOISE_KEY, 'merge')} < 0.4 THEN array_to_string(w[1:g + 1], ' ') || array_to_string(w[g + 2:], ' ')
    WHEN {u(NOISE_KEY, 'split')} < 0.5 THEN array_to_string(list_transform(w, lambda v, i: CASE WHEN i - 1 = g AND length(v) >= 4 THEN {half('v')} ELSE v END), ' ') ELSE s END) AS spacing FROM y"""
)
def noise_steps(spark, sf_dir):
    rows = sentences(spark, sf_dir).withColumn("key", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("no").cast("string")))
    s, key = F.col("sentence"), F.col("key")
    return rows.select(
        "doc_id", "no", md5(N.word_casing(s, key, 0.3, 0.3, 0.0)).alias("casing"), md5(N.sentence_casing(s, key, 0.3, 0.3)).alias("whole"), md5(N.digit_noise(s, F.lit("Latin"), key, 0.5)).alias("digit"),
        *(md5(N.letter_noise(s, F.lit(script), key, 0.5)).alias(name) for name, script in (("letter", "Latin"), ("cyrillic", "Cyrillic"), ("greek", "Greek"))), md5(N.spacing(s, key, 0.4, 0.5)).alias("spacing"),
    )


@query(f"WITH {SENTENCES} SELECT doc_id, no, md5(CASE WHEN lang IN ('en', 'es', 'fr', 'it', 'nl', 'pt') AND {u(NOISE_KEY, 'accent')} < 0.5 THEN strip_accents(sentence) ELSE sentence END) AS plain FROM sentences")
def accent_noise(spark, sf_dir):
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("no").cast("string"))
    return sentences(spark, sf_dir).select("doc_id", "no", md5(N.accent_loss(F.col("sentence"), F.col("lang"), key, 0.5)).alias("plain"))


@query(f"""WITH d AS (SELECT lang, text, min(doc_id) AS doc_id, {hash_of("'42' || chr(0) || lang || chr(0) || text")} AS h FROM documents GROUP BY lang, text), p AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY h, text) - 1 AS idx FROM d),
w AS (SELECT lang, doc_id AS doc, 1 + doc_id % 3 AS n FROM documents WHERE doc_id % 4 = 0), s AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY doc) - n AS start FROM w)
SELECT s.lang, doc, idx - start AS part, md5(text) AS sentence FROM s JOIN p ON p.lang = s.lang AND idx >= start AND idx < start + n""")
def draws(spark, sf_dir):
    rows = dedupe.first_wins(docs(spark, sf_dir).select("lang", "doc_id", F.col("text").alias("sentence")), ["lang", "sentence"], ["doc_id"])
    wanted = docs(spark, sf_dir).where("doc_id % 4 = 0").select("lang", F.col("doc_id").alias("doc"), F.lit(0).alias("slot"), (1 + F.col("doc_id") % 3).alias("n"))
    out = pools.draw(wanted, pools.numbered(rows, 42, ("lang",)).drop("doc_id"), ("lang",))
    return out.select("lang", "doc", "part", md5(F.col("sentence")).alias("sentence"))


@query("""WITH w AS (SELECT lang, sum(1 + doc_id % 3) AS wanted FROM documents WHERE doc_id % 4 = 0 GROUP BY lang), p AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n, coalesce(wanted, 0) AS wanted, greatest(n - coalesce(wanted, 0), 0) AS remaining FROM p LEFT JOIN w USING (lang)""")
def remaining_sentences(spark, sf_dir):
    d = docs(spark, sf_dir)
    return pools.remaining(d, d.where("doc_id % 4 = 0").select("lang", (1 + F.col("doc_id") % 3).alias("n")), ("lang",))


@query(f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT lang, sum(n) OVER (ORDER BY lang) / sum(n) OVER () AS upto FROM c), d AS (SELECT doc_id, {u("'9' || chr(0) || doc_id", 'x')} AS u FROM documents)
SELECT doc_id, min(lang) AS chosen FROM d JOIN r ON upto > u GROUP BY doc_id""")
def weighted_languages(spark, sf_dir):
    d = docs(spark, sf_dir)
    choices = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows = pools.weighted_choice(d.select("doc_id"), choices, F.concat_ws("\0", F.lit("9"), F.col("doc_id").cast("string"), F.lit("x")), "n")
    return rows.select("doc_id", F.col("lang").alias("chosen"))


def supply(spark, sf_dir):
    return stores.materialized(pools.split_by_hash(docs(spark, sf_dir).select(F.lit("wiki").alias("source"), "lang", F.col("text").alias("sentence"))).groupBy("pool", "lang").agg(F.count(F.lit(1)).alias("n")), "supply")


N_DOCS, N_TRIALS = 300, 5
RESERVED = f"{KEYED}, res AS (SELECT *, CASE WHEN h % total < least(total, greatest(4, least(round_even(total * 0.55, 0), 82500))) THEN 'reserved' ELSE 'main' END AS pool FROM k), supply AS (SELECT pool, lang, count(*) AS n FROM res GROUP BY ALL)"
PHASES = ", ".join(f"({i}, '{k.name}', '{k.pool}', {k.least}, {k.most}, {synth.targets(N_DOCS)[k.name]})" for i, k in enumerate(synth.KINDS))
TRIALS = f"""{RESERVED}, phases AS (SELECT * FROM (VALUES {PHASES}) AS x(no, phase, pool, least_n, most_n, docs)), rows AS (SELECT *, unnest(range(1, docs + 1)) AS doc FROM (SELECT *, unnest(range({N_TRIALS})) AS trial FROM phases)),
drawn AS (SELECT *, {u("'0' || chr(0) || phase || chr(0) || trial || chr(0) || doc", 'lang')} AS u, least_n + {hash_of("'0' || chr(0) || phase || chr(0) || trial || chr(0) || doc || chr(0) || 'size'")} % (most_n - least_n + 1) AS size FROM rows),
ranges AS (SELECT pool, lang, sum(n) OVER (PARTITION BY pool ORDER BY lang) / sum(n) OVER (PARTITION BY pool) AS upto FROM supply),
chosen AS (SELECT no, phase, d.pool, trial, doc, size, min(lang) AS lang FROM drawn AS d JOIN ranges AS r ON r.pool = d.pool AND upto > u GROUP BY ALL),
per AS (SELECT trial, no, phase, pool, lang, count(*) AS docs, sum(size) AS wanted FROM chosen GROUP BY ALL),
trials AS (SELECT trial, phase, pool, lang, docs, wanted, greatest(n - coalesce(sum(wanted) OVER (PARTITION BY trial, pool, lang ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS available FROM per JOIN supply USING (pool, lang))"""


@query(f"WITH {TRIALS} SELECT *, least(wanted, available) AS used, wanted > available AS depleted FROM trials")
def capacity_phases(spark, sf_dir):
    return capacity.simulate(supply(spark, sf_dir), N_DOCS, N_TRIALS)


@query(f"""WITH {TRIALS}, t AS (SELECT trial, pool, lang, sum(least(wanted, available)) AS used, sum(docs) AS docs, max(wanted > available) AS depleted FROM trials GROUP BY ALL)
SELECT pool, lang, n, round(sum(used) / {N_TRIALS}, 6) AS used_mean, round(sum(docs) / {N_TRIALS}, 6) AS docs_mean, round(1 - sum(used) / {N_TRIALS} / n, 6) AS headroom, round(count(*) FILTER (WHERE depleted) / {N_TRIALS}, 6) AS depleted_share, round(stddev_pop(used), 4) AS used_std
FROM supply JOIN t USING (pool, lang) GROUP BY pool, lang, n""")
def capacity_summary(spark, sf_dir):
    s = supply(spark, sf_dir)
    r = lambda c, n=6: F.round(c, n).alias(c)
    return capacity.summary(capacity.simulate(s, N_DOCS, N_TRIALS), s).select("pool", "lang", "n", r("used_mean"), r("docs_mean"), r("headroom"), r("depleted_share"), r("used_std", 4))


@query(f"""WITH {TRIALS}, t AS (SELECT trial, pool, lang, sum(least(wanted, available)) AS used, max(wanted > available) AS depleted FROM trials GROUP BY ALL),
s AS (SELECT pool, lang, count(*) FILTER (WHERE depleted) / {N_TRIALS} AS d, 1 - sum(used) / {N_TRIALS} / n AS h FROM supply JOIN t USING (pool, lang) GROUP BY pool, lang, n)
SELECT pool, lang, row_number() OVER (ORDER BY d DESC, h, pool, lang) AS place FROM s QUALIFY place <= 5""")
def capacity_trials(spark, sf_dir):
    """The pools that run dry first."""
    s = supply(spark, sf_dir)
    worst = capacity.bottlenecks(capacity.summary(capacity.simulate(s, N_DOCS, N_TRIALS), s), 5)
    place = F.row_number().over(Window.orderBy(F.desc("depleted_share"), "headroom", "pool", "lang"))  # five rows
    return worst.select("pool", "lang", place.alias("place"))


@query(f"""WITH {SPANS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank_score DESC, first_pos, lang) AS place FROM r),
t AS (SELECT doc, max(lang) FILTER (WHERE place = 1) AS f, max(rank_score) FILTER (WHERE place = 1) AS s1, max(lang) FILTER (WHERE place = 2) AS g, max(rank_score) FILTER (WHERE place = 2) AS s2 FROM p WHERE place <= 2 GROUP BY doc),
o AS (SELECT CASE WHEN doc % 2 = 0 THEN 'assistant' ELSE 'user' END AS true_lang, f, s1, g, s2 FROM t), q AS (SELECT true_lang, CASE WHEN coalesce(g = true_lang AND s2 >= s1 * 0.5, false) THEN g ELSE coalesce(f, '') END AS pred_lang FROM o),
acc AS (SELECT true_lang, count(*) AS total, count(*) FILTER (WHERE true_lang = pred_lang) AS correct, round(count(*) FILTER (WHERE true_lang = pred_lang) / count(*), 6) AS accuracy FROM q GROUP BY ROLLUP (true_lang))
SELECT *, CASE {' '.join(f"WHEN accuracy >= {least} THEN '{name}'" for name, least in evaluate.BANDS)} ELSE 'poor' END AS band FROM acc""")
def evaluated_bands(spark, sf_dir):
    rows = spans(spark, sf_dir)
    truth = rows.select("doc").distinct().withColumn("true_lang", F.when(F.col("doc") % 2 == 0, "assistant").otherwise("user"))
    return evaluate.evaluated(truth, rows, 0.5)["accuracy"]


NAMED = {"en": "eng_Latn", "de": "deu_Latn", "fr": "fra_Arab", "es": "qqq_Latn"}


@query("SELECT doc_id AS doc, md5(text) AS text, lang AS true_lang FROM documents WHERE lang IN ('en', 'de')")
def labelled_set(spark, sf_dir):
    label = F.create_map(*(F.lit(x) for p in NAMED.items() for x in p))[F.col("lang")]
    out = evaluate.labelled_set(docs(spark, sf_dir).withColumn("label", label).withColumnRenamed("doc_id", "doc"), "label")
    return out.select("doc", md5(F.col("text")).alias("text"), "true_lang")


@query("SELECT conv_id AS doc, turn AS pos, lower(role) AS lang, 100 AS width FROM conversations")
def score_spans(spark, sf_dir):
    scores = spans(spark, sf_dir).select("doc", "pos", F.concat(F.lit("B-"), F.upper("lang")).alias("lang"), "score")
    return evaluate.multilabel_spans(scores).select("doc", "pos", "lang", (F.col("end") - F.col("start")).alias("width"))


@query("SELECT doc_id, round(1 / (1 + exp(-(n_chars / 1000.0::double - 1))), 9) AS p FROM documents")
def sigmoids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(reports.sigmoid(F.col("n_chars") / 1000.0 - 1), 9).alias("p"))


@query(f"WITH {SENTENCES} SELECT lang, count(*) AS n, sum(length(sentence)) AS n_chars, max(doc_id) AS last FROM sentences WHERE lang IN ('de', 'fr') GROUP BY lang")
def stored_sentences(spark, sf_dir):
    """Written to a store of a folder per source and language, and two languages read back."""
    path = stores.scratch(spark, "store")
    stores.write_sentences(sentences(spark, sf_dir).select("source", "lang", F.col("doc_id").alias("pos"), "sentence"), path)
    return stores.read_sentences(spark, path, ["de", "fr"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"), F.max("pos").alias("last"))


@query("SELECT lang, md5(text) AS sentence, NULL::double AS score, doc_id AS sentence_token_length FROM documents")
def stored_records(spark, sf_dir):
    path = stores.scratch(spark, "records")
    stores.write_records(docs(spark, sf_dir).select("lang", md5(F.col("text")).alias("sentence"), F.col("doc_id").alias("sentence_token_length"), "source"), path)
    return stores.read_records(spark, path).select("lang", "sentence", "score", "sentence_token_length")


@query(f"WITH {LABELLED} SELECT md5(array_to_string(tokens, ' ')) AS original_text, len(tokens) AS n, split AS kind FROM lab")
def stored_examples(spark, sf_dir):
    """Stored without their texts; reading joins the tokens."""
    rows = labelled(spark, sf_dir).select(F.col("split").alias("kind"), F.lit(None).cast("string").alias("original_text"), "tokens", F.col("labels").alias("ner_tags"), F.col("input_ids").cast("array<bigint>").alias("input_ids"), F.col("attention_mask").cast("array<bigint>").alias("attention_mask"), "labels", "doc")
    path = stores.scratch(spark, "examples")
    stores.write_examples(stores.compacted(rows, "doc"), path)
    return stores.read_examples(spark, path).select(md5(F.col("original_text")).alias("original_text"), F.size("tokens").alias("n"), "kind")


@query("SELECT lang, count(*) AS n, count(*) AS listed FROM documents WHERE lang <> 'es' GROUP BY lang")
def language_map(spark, sf_dir):
    """A map of tables by language; the manifest's counts are those of the tables."""
    path = stores.scratch(spark, "map")
    stores.write_language_map(spark, docs(spark, sf_dir).select("doc_id", "lang"), path)
    counts = F.create_map(*(x for k, n in stores.language_counts(spark, path).items() for x in (F.lit(k), F.lit(n))))
    rows = stores.read_language_map(spark, path, "doc_id bigint, lang string", ["en", "de", "fr"])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("listed", counts[F.col("lang")].cast("long"))


@query(f"WITH {LABELLED} SELECT doc_id AS doc, len(tokens) AS n FROM lab WHERE split = 'eval'")
def published_split(spark, sf_dir):
    """Published by split in the place of an earlier version, and one split read."""
    path = stores.scratch(spark, "published")
    rows = labelled(spark, sf_dir).select("doc", "split", F.size("tokens").alias("n"))
    stores.write_splits(rows.withColumn("n", F.lit(0)), path)
    stores.write_splits(rows, path)
    return stores.read_split(spark, path, "eval").select("doc", "n")


@query(f"""WITH {SENTENCES}, x AS (SELECT lang, doc_id AS pos, sentence FROM sentences), y AS (SELECT lang, CASE WHEN lang = 'fr' THEN {shout('sentence')} ELSE sentence END AS s FROM x WHERE NOT (lang = 'de' AND length(sentence) < 30))
SELECT lang, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS digest FROM (SELECT DISTINCT lang, s FROM y) GROUP BY lang""")
def refiltered(spark, sf_dir):
    """A store whose German sentences lose rows, whose French ones change one to one, and whose others stay."""
    path = stores.scratch(spark, "refilter")
    stores.write_sentences(sentences(spark, sf_dir).select("source", "lang", F.col("doc_id").alias("pos"), "sentence"), path)
    change = lambda df: df.where(~((F.col("lang") == "de") & (F.length("sentence") < 30))).withColumn("sentence", F.when(F.col("lang") == "fr", F.upper("sentence")).otherwise(F.col("sentence")))
    flows.refilter(spark, path, change)
    return udfs.text_digests(stores.read_sentences(spark, path), "lang", "sentence")


@query(f"""WITH {SENTENCES}, k AS (SELECT source, lang, doc_id AS pos, sentence FROM sentences WHERE lang <> 'de' AND source <> (SELECT min(source) FROM documents))
SELECT source, lang, count(*) AS n, sum(length(sentence)) AS n_chars, max(pos) AS last, 2 AS version FROM k GROUP BY source, lang""")
def refilter_emptied(spark, sf_dir):
    """A refilter after which one language and one source have no rows left: their partitions are gone from the store."""
    path = stores.scratch(spark, "refilter")
    first = docs(spark, sf_dir).agg(F.min("source")).first()[0]
    stores.write_sentences(sentences(spark, sf_dir).select("source", "lang", F.col("doc_id").alias("pos"), "sentence"), path)
    flows.refilter(spark, path, lambda df: df.where((F.col("lang") != "de") & (F.col("source") != first)))
    store = stores.sentence_store(spark, path)
    out = store.read().groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"), F.max("pos").alias("last"))
    return out.withColumn("version", F.lit(store.version()))


@query("""WITH p AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), v AS (SELECT 1 AS version, * FROM p WHERE lang <> 'fr' UNION ALL SELECT 2, * FROM p UNION ALL SELECT 3, * FROM p WHERE lang <> 'de'
UNION ALL SELECT 4, lang, source, n FROM p WHERE lang <> 'de' AND lang <> 'es' UNION ALL SELECT 4, 'es', 'all', sum(n) FROM p WHERE lang = 'es' HAVING sum(n) > 0)
SELECT version, lang, source, n FROM v""")
def store_versions(spark, sf_dir):
    """Every version of a table that is overwritten, appended to, loses a language and has another one replaced."""
    from functools import reduce

    from tessella.sources.snapshots import Snapshots

    rows = docs(spark, sf_dir).select("lang", "source", "doc_id")
    store = Snapshots(spark, stores.scratch(spark, "versions"), ("lang",))
    store.overwrite(rows.where("lang <> 'fr'"))
    store.append(rows.where("lang = 'fr'"))
    store.drop([("de",)])
    store.replace(store.written(rows.where("lang = 'es'").withColumn("source", F.lit("all"))), [("es",)], 3)
    all_ = reduce(DataFrame.unionByName, (store.read(v).withColumn("version", F.lit(v)) for v in range(1, store.version() + 1)))
    return all_.groupBy("version", "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SENTENCES}, s AS (SELECT lang, doc_id, sentence, list_transform(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)) AS ws FROM sentences WHERE lang <> 'en'),
t AS (SELECT *, len(list_filter(ws, lambda w: regexp_full_match(w, '\\p{{L}}+'))) AS alpha, len(list_filter(ws, lambda w: regexp_full_match(w, '[a-z]+'))) AS ascii, len(list_filter(ws, lambda w: list_contains({STOPS!r}, w))) AS hits FROM s)
SELECT lang, doc_id AS source_index, md5(sentence) AS sentence, 'english_leak' AS reason FROM t WHERE alpha >= 4 AND hits >= 3 AND ascii / alpha >= 0.7""")
def refilter_rejects(spark, sf_dir):
    """What a refilter of leaks rejects, with the place in the store and the reason."""
    path = stores.scratch(spark, "refilter")
    stores.write_sentences(sentences(spark, sf_dir).select("source", "lang", F.col("doc_id").alias("pos"), "sentence"), path)
    flows.refilter(spark, path, flows.leak_filter(STOPS), f"{path}.rejected", lambda rows: filters.reject_reason("sentence", STOPS), F.col("latin"))
    return spark.read.parquet(f"{path}.rejected").select("lang", "source_index", md5(F.col("sentence")).alias("sentence"), "reason")


@query(f"""WITH {SENTENCES}, u AS (SELECT DISTINCT lang, sentence FROM sentences), c AS (SELECT count(*) AS configs FROM (SELECT DISTINCT lang, source FROM documents))
SELECT lang, count(*) AS n, sum(length(sentence)) AS n_chars, sum({hash_of('sentence')}) AS digest, configs, 'complete' AS status FROM u, c GROUP BY lang, configs""")
def incremental_load(spark, sf_dir):
    """A language's sources as configurations: some loaded first, then all, then with another description; the rows are those of one full load."""
    from tessella.plans import load
    from tessella.sources.snapshots import Snapshots

    rows = sentences(spark, sf_dir).select(F.concat_ws("_", "lang", "source").alias("config"), "lang", "pos", "sentence")
    configs = docs(spark, sf_dir).select(F.concat_ws("_", "lang", "source").alias("config"), "lang").distinct()
    store = Snapshots(spark, stores.scratch(spark, "load"), ("lang",))
    read = lambda batch: rows.join(F.broadcast(batch.select("config")), "config").select("lang", "pos", "sentence")
    load.load(store, configs.where(F.crc32("config") % 3 == 0), read, {"seed": 1}, per_commit=1000)
    load.load(store, configs, read, {"seed": 1}, per_commit=1000)
    out = load.load(store, configs, read, {"seed": 2}).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"), F.sum(T.md5_number(F.col("sentence"))).alias("digest"))
    return out.withColumn("configs", F.lit(len(store.meta()["completed"]))).withColumn("status", F.lit(store.meta()["status"]))


@query("""WITH a AS (SELECT source AS config, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source AS config, lang FROM documents WHERE doc_id % 2 = 1)
SELECT side, config, lang, count(*) AS n FROM (SELECT 'lost' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'new' AS side, * FROM (FROM b EXCEPT ALL FROM a)) GROUP BY ALL""")
def config_changes(spark, sf_dir):
    """What one list of configurations has more often than another, and the other way round."""
    rows = docs(spark, sf_dir).select(F.col("source").alias("config"), "lang", "doc_id")
    a, b = rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1").drop("doc_id")
    both = a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
    return both.groupBy("side", "config", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT source, doc_id, lang, lang = 'en' AS hit, n_chars FROM documents),
s AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w AS misses, coalesce(sum(CASE WHEN hit THEN n_chars ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
t AS (SELECT *, misses - coalesce(max(CASE WHEN hit THEN misses END) OVER (PARTITION BY source ORDER BY doc_id), 0) AS streak FROM s),
e AS (SELECT source, min(doc_id) FILTER (WHERE before >= 30000) AS cap, min(doc_id) FILTER (WHERE streak >= 4) AS run FROM t GROUP BY source)
SELECT doc_id, source, streak::bigint AS streak FROM t JOIN e USING (source) WHERE (cap IS NULL OR doc_id < cap) AND (run IS NULL OR doc_id <= run)""")
def stream_stops(spark, sf_dir):
    """Documents as a stream of files in micro-batches: a source's scan ends after four misses in a row or 30,000 characters of hits, across batches and restarts."""
    rows = docs(spark, sf_dir).select("source", "doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    folder, out, check = (stores.scratch(spark, f"stops-{x}") for x in ("in", "out", "check"))
    cuts = rows.agg(F.percentile_approx("doc_id", [0.25, 0.5, 0.75])).first()[0]
    scan = lambda: stops.scan(spark, folder, "source string, doc_id long, lang string, n_chars long", "source", "doc_id", F.col("lang") == "en", 4, 30_000, out, check, F.col("n_chars"), per_trigger=4)
    stops.fed(rows.where(F.col("doc_id") < cuts[1]), folder, "source", "doc_id", cuts[:1])
    scan()
    stops.fed(rows.where(F.col("doc_id") >= cuts[1]), folder, "source", "doc_id", cuts[2:])
    return scan().select("doc_id", "source", "streak")


@query("SELECT lang, count(*) AS n, sum(n_chars) AS n_chars FROM documents WHERE n_chars >= 100 GROUP BY lang")
def ingested(spark, sf_dir):
    """Documents as a file stream, in micro-batches, filtered and appended; a second call finds nothing new."""
    source, out, check = (stores.scratch(spark, f"ingest-{x}") for x in ("source", "out", "check"))
    docs(spark, sf_dir).select("doc_id", "lang", "n_chars").repartition(4).write.parquet(source)
    for _ in range(2):
        ingest.ingest(spark, source, "doc_id bigint, lang string, n_chars bigint", lambda b: b.where("n_chars >= 100"), out, check, 2)
    return spark.read.parquet(out).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


CODE_LIST = [(f" {a.upper()} ", k) for k, v in ALIASES.items() for a in (k, *v.split())] + [("zz", "zz")]


@query(f"SELECT code, lang, count(*) AS n FROM (SELECT {[c for c, _ in CODE_LIST]!r}[1 + doc_id % {len(CODE_LIST)}] AS code, {[k for _, k in CODE_LIST]!r}[1 + doc_id % {len(CODE_LIST)}] AS lang FROM documents) GROUP BY ALL")
def alias_codes(spark, sf_dir):
    """Documents dealt to all codes of languages, by their canonical code."""
    rows = docs(spark, sf_dir).select(one_of([c for c, _ in CODE_LIST], F.col("doc_id")).alias("code"))
    return with_canonical(rows, "code").groupBy("code", "lang").agg(F.count(F.lit(1)).alias("n"))


MULTIPLIERS = {**dims.WIKI_MULTIPLIERS, "no": 2 * dims.WIKI_MULTIPLIERS["no"]}
case = lambda values, other: "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


@query(f"""WITH l AS (SELECT unnest({list(LANGUAGES)!r}) AS lang, unnest({[GROUP_OF[x] for x in LANGUAGES]!r}) AS lang_group)
SELECT lang, lang_group, round_even(150000 * ({case(MULTIPLIERS, 1)})::double, 0)::int AS wiki_cap, {case(dims.PRIORITY_CAPS, 25000)} AS priority_cap, round_even(150000 * ({case(dims.TATOEBA_MULTIPLIERS, 1)})::double, 0)::int AS tatoeba_cap,
greatest(250, {case({x: dims.GROUPS[GROUP_OF[x]][2] // 4 for x in LANGUAGES}, 0)}) AS long_paragraph, n, greatest(n - 3, 0) AS beyond
FROM l JOIN (SELECT {list(LANGUAGES)!r}[1 + doc_id % {len(LANGUAGES)}] AS lang, count(*) AS n FROM documents GROUP BY ALL) AS d USING (lang)""")
def language_caps(spark, sf_dir):
    """Documents dealt to all languages: the caps of each, and how many documents are beyond three."""
    rows = with_lang(docs(spark, sf_dir).select(one_of(list(LANGUAGES), F.col("doc_id")).alias("lang")))
    out = rows.groupBy("lang", "lang_group", "wiki_cap", "priority_cap", "tatoeba_cap", "long_paragraph").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("beyond", F.greatest(F.col("n") - 3, F.lit(0)))


@query("SELECT kind, n, 0 AS bad FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in synth.targets(400).items()) + ") AS x(kind, n)")
def synthetic_invariants(spark, sf_dir):
    """Documents of each kind, and how many of them break a rule: labels as long as tokens, ids and masks two longer, at most 512, a text."""
    from tessella.plans.queries import synthetic

    n = F.size("tokens")
    fine = (F.size("ner_tags") == n) & (F.size("input_ids") == n + 2) & (F.size("labels") == n + 2) & (F.size("attention_mask") == n + 2) & n.between(1, 510) & (F.length("original_text") > 0)
    return synthetic(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~fine).alias("bad"))


TOKENS = f"t AS (SELECT lang, {hash_of('t')} % 500 AS token_id, t FROM (SELECT lang, split, unnest(tokens) AS t FROM lab) WHERE split = 'train')"


@query(f"""WITH {LABELLED}, {TOKENS}, v AS (SELECT token_id, min(t) AS token FROM t GROUP BY token_id), c AS (SELECT lang, token_id, count(*) AS count FROM t GROUP BY ALL)
SELECT lang, token_id, token, count, row_number() OVER (PARTITION BY lang ORDER BY count DESC, token_id) AS place FROM c JOIN v USING (token_id) QUALIFY place <= 15""")
def top_tokens(spark, sf_dir):
    """The commonest tokens of each language in the train split, with their strings (the first of those that share an id)."""
    rows = labelled(spark, sf_dir).where("split = 'train'")
    pairs = rows.select(F.explode(F.arrays_zip("input_ids", "tokens")).alias("x")).select("x.input_ids", "x.tokens")
    vocabulary = pairs.groupBy(F.col("input_ids").alias("token_id")).agg(F.min("tokens").alias("token"))
    counts = reports.vocabulary_rollup(rows).where("level = 'lang'").select("lang", "token_id", "count")
    return reports.named_tokens(reports.top_tokens(counts, 15, ("lang",)), vocabulary)


@query(f"""WITH {LABELLED}, c AS (SELECT lang, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'eval') AS eval, count(*) AS total FROM lab GROUP BY ROLLUP (lang))
SELECT *, round(100 * total / max(total) OVER (), 2) AS percent FROM c""")
def count_table(spark, sf_dir):
    return reports.count_table(reports.label_counts(labelled(spark, sf_dir)))


@query(f"""WITH {LABELLED}, d AS (SELECT unnest({list(LANGUAGES)!r}) AS lang, unnest({[GROUP_OF[x] for x in LANGUAGES]!r}) AS lang_group), s AS (SELECT d.lang, lang_group, count(doc_id) AS e, coalesce(sum(len(tokens)), 0) AS t FROM d LEFT JOIN lab ON lab.lang = d.lang GROUP BY ALL)
SELECT lang_group, count(*) AS n_langs, count(*) FILTER (WHERE e = 0) AS n_missing, sum(e) AS n_examples, sum(t) AS n_tokens FROM s GROUP BY lang_group""")
def group_stats(spark, sf_dir):
    return reports.group_stats(reports.sampling_stats(labelled(spark, sf_dir)))


@query(f"WITH {GUESS} SELECT doc_id, true_lang, pred_lang FROM g WHERE true_lang <> pred_lang")
def mismatches(spark, sf_dir):
    """Wrong predictions as JSON lines, read back."""
    path = stores.scratch(spark, "mismatches")
    evaluate.write_mismatches(guesses(spark, sf_dir), path)
    return spark.read.schema("doc_id bigint, true_lang string, pred_lang string").json(path)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no sentence' END AS error, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE len(string_split(text, chr(10))) END AS n FROM documents")
def segmenter_errors(spark, sf_dir):
    """A segmenter that fails on every tenth document: those have the error, and sentences by rule."""

    def load():
        def split(text):
            if text.startswith("!"):
                raise ValueError("no sentence")
            return text.split("\n")

        return split

    rows = docs(spark, sf_dir).withColumn("t", F.concat(F.when(F.col("doc_id") % 10 == 0, "!").otherwise(""), "text"))
    return rows.withColumn("r", udfs.segmented_or_error(load, "t")).select("doc_id", "r.error", F.when(F.col("r.error").isNull(), F.size("r.sentences")).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, source = 'web' OR doc_id % 4 = 0 AS mixed, {hash_of("'0' || chr(0) || doc_id")} AS h FROM documents) SELECT doc_id FROM d QUALIFY row_number() OVER (PARTITION BY mixed ORDER BY h, doc_id) <= CASE WHEN mixed THEN 30 ELSE 70 END""")
def limited_sample(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id"), F.when((F.col("source") == "web") | (F.col("doc_id") % 4 == 0), "mixed").otherwise("pure").alias("kind"))
    return pools.limited_sample(rows, 100, "doc_id").select("doc_id")


@query(f"""WITH {SENTENCES}, x AS (SELECT *, regexp_extract(sentence, '^\\S+') AS w FROM sentences)
SELECT doc_id, no, {VALID.replace(LIMITS, '10').replace('600', '180')} AS valid, w <> '' AND {digits('w')} = 0 AND {tokens('w')} = 1 AND len(list_filter(regexp_extract_all(w, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '\\p{{L}}+'))) = 1 AS word FROM x""")
def validity_bounds(spark, sf_dir):
    """Other bounds: those of Japanese for the length, four words by the Latin rule; and whether the first token is a valid word."""
    rows = with_lang(sentences(spark, sf_dir).select("doc_id", "no", F.lit("ja").alias("lang"), "sentence")).withColumn("no_space", F.lit(False))
    return rows.select("doc_id", "no", filters.is_valid("sentence").alias("valid"), T.is_valid_word(F.regexp_extract("sentence", r"^\S+", 0)).alias("word"))


@query(f"SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace({html('html')}, '[\\s]+', ' ', 'g'), '. '), lambda x: trim(x)), lambda x: x <> ''), chr(1))) AS parts FROM pages")
def page_pieces(spark, sf_dir):
    text = T.collapse_spaces(T.strip_html("html"))
    parts = F.filter(F.transform(F.split(text, r"\. "), T.trim), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", md5(F.array_join(parts, "\x01")).alias("parts"))
