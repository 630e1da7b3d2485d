"""Token-labelled documents from sentence pools: one plan of demands, one draw, one aggregation per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import generators
from tessella.functions import labels as L
from tessella.functions import noise as N
from tessella.functions import text as T
from tessella.functions.dims import LANGUAGES, lang_dim
from tessella.operators import pools
from tessella.sources.stores import materialized


@dataclass(frozen=True)
class Kind:
    """How documents of a kind are made: share of all, pool, sentences, and probabilities of noise."""

    name: str
    share: float
    pool: str
    least: int
    most: int
    foreign: float = 0.0
    strip_punct: float = 0.1
    accent: float = 0.02
    letter: float = 0.01
    digit: float = 0.005
    upper: float = 0.02
    lower: float = 0.02
    title: float = 0.01
    merge: float = 0.03
    split: float = 0.02
    typo: float = 0.01
    sentence_upper: float = 0.0
    sentence_lower: float = 0.0
    wrap: float = 0.0
    paragraph: float = 0.0
    unknown: float = 0.0
    swap: float = 0.0
    outside: float = 0.0


# fixed values: the document mix
KINDS = (
    Kind("pure", 0.55, "reserved", 1, 6, 0.0, 0.10, 0.05, 0.02, 0.01, 0.03, 0.03, 0.02, 0.03, 0.05, 0.02, 0.02, 0.03, 0.30, 0.25, 0.002),
    Kind("homogeneous", 0.25, "main", 2, 6, 0.85, 0.15, 0.02, 0.01, 0.005, 0.02, 0.02, 0.01, 0.05, 0.01, 0.01, 0.01, 0.02, 0.20, 0.20, 0.002),
    Kind("spliced", 0.10, "main", 3, 5, 1.0, 0.20, 0.02, 0.02, 0.01, 0.02, 0.02, 0.01, 0.01, 0.01, 0.01, 0.0, 0.0, 0.15, 0.10, 0.002),
    Kind("mixed", 0.10, "main", 2, 4, 1.0, 0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, swap=0.06, outside=0.06),
)
MAX_LENGTH, START, END = 512, 1, 2
SWAP_RATE, UNKNOWN = 0.02, "<unk>"
# fixed values: what is put around a sentence: pairs, tags, trailing signs, and the parts of list starters
PAIRS = (("(", ")"), ("[", "]"), ('"', '"'), ("“", "”"), ("«", "»"), ("‘", "’"), ("'", "'"))
TAGS = tuple((f"<{t}>", f"</{t}>") for t in "p div blockquote table tr td span".split()) + (("**", "**"),)
TRAILS = (":", ";", "...", "?!", " |", " | |", ",", "!!")
STARTER_SIGNS, STARTER_SYMBOLS, STARTER_HASHES = (".", ":", ")", "]"), ("-", "•", "*", "‣", "⁃", "–", "—"), ("##", "###", "####")
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
# fixed values: of documents with spans without language, those with one and with two at most (the others have three); tokens of a span, and of a span of code
SPANS_UPTO, SPAN_TOKENS, CODE_TOKENS = (0.6, 0.9), 40, 120
# fixed values: tokens that a document must be short of for a first span and for others; how often a document is drawn
FIRST_ROOM, ROOM, RETRIES = 20, 10, 8
#: Texts of a pool that spans are drawn from.
SPAN_TEXTS = 5000


def targets(total: int) -> dict[str, int]:
    """Documents of each kind; the last kind takes the remainder."""
    out = {k.name: round(total * k.share) for k in KINDS[:-1]}
    return out | {KINDS[-1].name: max(0, total - sum(out.values()))}


def demands(plan: DataFrame, kind: Kind, langs: Column, seed: int = 0) -> DataFrame:
    """One row per sentence slot of each planned document: doc, slot, lang, pool, n = 1.

    plan has doc_no and lang. Homogeneous documents have a foreign first or last sentence with probability foreign, spliced
    ones a foreign one inside, mixed ones a language of their own for every slot. langs is an array of languages to draw from.
    """
    key = F.concat_ws("\0", F.lit(str(seed)), F.lit(kind.name), F.col("doc_no").cast("string"))
    n = kind.least + N.pick(key, "n", kind.most - kind.least + 1)
    out = plan.withColumn("n_slots", n).withColumn("slot", F.explode(F.sequence(F.lit(0), n - 1)))
    other = F.get(langs, N.pick(F.concat_ws("\0", key, F.col("slot").cast("string")), "lang", F.size(langs)))
    if kind.name == "mixed":
        foreign = F.col("slot") > 0
    elif kind.name == "spliced":
        foreign = F.col("slot") == 1 + N.pick(key, "at", F.col("n_slots") - 2)
    else:
        edge = F.when(N.u(key, "end") < 0.5, F.lit(0)).otherwise(F.col("n_slots") - 1)
        foreign = (N.u(key, "foreign") < kind.foreign) & (F.col("slot") == edge) & F.lit(kind.foreign > 0)
    doc = F.concat(F.lit(f"{kind.name}-"), F.col("doc_no").cast("string"))
    return out.select(doc.alias("doc"), "slot", F.when(foreign, other).otherwise(F.col("lang")).alias("lang"), F.lit(kind.pool).alias("pool"), F.lit(1).alias("n"), F.lit(kind.name).alias("kind"), "n_slots")


def noisy(df: DataFrame, kind: Kind) -> DataFrame:
    """The kind's noise on ``sentence``, step by step as columns; needs lang, script, latin and key."""
    key, lang = F.col("key"), F.col("lang")
    latin = lambda step: lambda c: F.when(F.col("latin"), step(c)).otherwise(c)
    steps = [
        (kind.upper + kind.lower + kind.title, latin(lambda c: N.word_casing(c, key, kind.upper, kind.lower, kind.title))),
        (kind.merge + kind.split, latin(lambda c: N.spacing(c, key, kind.merge, kind.split))),
        (kind.typo, latin(lambda c: N.char_noise(c, key, kind.typo))),
        (kind.sentence_upper + kind.sentence_lower, lambda c: N.sentence_casing(c, key, kind.sentence_upper, kind.sentence_lower)),
        (kind.accent, lambda c: N.accent_loss(c, lang, key, kind.accent)),
        (kind.letter, lambda c: N.letter_noise(c, F.col("script"), key, kind.letter)),
        (kind.digit, lambda c: N.digit_noise(c, F.col("script"), key, kind.digit)),
    ]
    for probability, step in steps:
        if probability > 0:
            df = df.withColumn("sentence", T.bind(F.col("sentence"), step))
    return df


def with_swaps(pairs: Column, key: Column) -> Column:
    """An array with SWAP_RATE of its places (one at least) exchanged with others, one after the other; it has two or more."""
    n = F.size(pairs)

    def step(now: Column, k: Column) -> Column:
        own = F.concat_ws("\0", key, k.cast("string"))
        return T.bind(N.pick(own, "swap", n), lambda i: T.bind((i + 1 + N.pick(own, "other", n - 1)) % n, lambda j: L.swapped(now, i, j)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n * SWAP_RATE).cast("int"))), pairs, step)


def token_noise(df: DataFrame, kind: Kind) -> DataFrame:
    """The kind's noise on the tokens t and their labels tags: swaps, and an unknown token with the label of the one it precedes, which sentence has too."""
    key, several = F.col("key"), F.size("t") >= 2
    if kind.swap:
        pairs = F.arrays_zip("t", "tags")
        df = df.withColumn("pairs", F.when((N.u(key, "swaps") < kind.swap) & several, with_swaps(pairs, key)).otherwise(pairs))
        df = df.withColumn("t", F.col("pairs.t")).withColumn("tags", F.col("pairs.tags")).drop("pairs")
    if kind.unknown:
        at = F.when((N.u(key, "unknown") < kind.unknown) & several, 1 + N.pick(key, "unknown-at", F.size("t") - 1))
        words = F.split(F.trim("sentence"), r"\s+")
        put = lambda a, x, place: F.when(F.col("at").isNull(), a).otherwise(F.array_insert(a, place + 1, x))
        df = df.withColumn("at", at).withColumn("tags", put(F.col("tags"), F.get("tags", F.col("at")), F.col("at"))).withColumn("t", put(F.col("t"), F.lit(UNKNOWN), F.col("at")))
        shown = F.array_join(F.array_insert(words, F.least(F.col("at"), F.size(words)) + 1, F.lit(UNKNOWN)), " ")
        df = df.withColumn("sentence", F.when(F.col("at").isNull(), F.col("sentence")).otherwise(shown)).drop("at")
    return df


def formatting(key: Column) -> tuple[Column, Column]:
    """What stands before and after a sentence: a pair, a list starter, a trailing sign or a tag, by hash."""
    of = lambda values, name: F.element_at(F.array(*map(F.lit, values)), N.pick(key, name, len(values)) + 1)
    pair = lambda pairs, name, side: of([p[side] for p in pairs], name)
    letter = of(tuple("abcdefghijklmnopqrstuvwxyz"), "letter")
    starters = (
        F.concat((1 + N.pick(key, "digit", 24)).cast("string"), of(STARTER_SIGNS, "sign")), F.concat(of(ROMANS, "roman"), of(STARTER_SIGNS, "sign")),
        F.concat(F.when(N.u(key, "upper") < 0.5, F.upper(letter)).otherwise(letter), of(STARTER_SIGNS, "sign")), of(STARTER_HASHES, "hash"), of(STARTER_SYMBOLS, "symbol"),
    )
    kind, none = N.pick(key, "pattern", 4), F.lit("")
    before = F.when(kind == 0, pair(PAIRS, "pair", 0)).when(kind == 1, F.element_at(F.array(*starters), N.pick(key, "starter", len(starters)) + 1)).when(kind == 2, none).otherwise(pair(TAGS, "tag", 0))
    after = F.when(kind == 0, pair(PAIRS, "pair", 1)).when(kind == 1, none).when(kind == 2, of(TRAILS, "trail")).otherwise(pair(TAGS, "tag", 1))
    return before, after


def outside_spans(wanted: DataFrame, sentences: DataFrame, seed: int = 0) -> DataFrame:
    """(doc, no, name, text): spans without language for the documents of kinds that have them, and one of code (no 0) for each mixed one.

    A span's pool is drawn by the pools' shares, and its text by hash from SPAN_TEXTS texts of that pool. Formulas are
    mathematical expressions where no corpus of them is given, gibberish is made of English sentences.
    """
    share = F.lit(0.0)
    for kind in KINDS:
        share = F.when(F.col("kind") == kind.name, kind.outside).otherwise(share)
    docs = wanted.where("slot = 0").select("doc", "kind", F.concat_ws("\0", F.lit(str(seed)), "doc", F.lit("outside")).alias("key"))
    many = F.when(N.u(F.col("key"), "any") < share, 1 + F.when(N.u(F.col("key"), "many") < SPANS_UPTO[0], 0).when(N.u(F.col("key"), "many") < SPANS_UPTO[1], 1).otherwise(2)).otherwise(0)
    numbers = F.concat(F.when(F.col("kind") == "mixed", F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(F.col("many") > 0, F.sequence(F.lit(1), F.col("many"))).otherwise(F.array().cast("array<int>")))
    rows = docs.withColumn("many", many).withColumn("no", F.explode(numbers)).withColumn("key", F.concat_ws("\0", "key", F.col("no").cast("string")))
    texts = generators.neutral_pools(wanted.sparkSession, sentences.where("lang = 'en'"), SPAN_TEXTS, SPAN_TEXTS, seed)
    nonsense = texts.pop("gibberish")  # at most SPAN_TEXTS rows
    nonsense = materialized(nonsense.withColumn("id", F.row_number().over(Window.orderBy("text")).cast("long") - 1), "gibberish")
    texts["gibberish"], n = nonsense, nonsense.count()
    drawn = generators.span_pool(F.col("key"))
    name = F.when(F.col("no") == 0, "code").when(drawn == "formulas", "math").when((drawn == "gibberish") & F.lit(n == 0), "symbol").otherwise(drawn)
    rows = rows.withColumn("name", name).withColumn("id", N.pick(F.col("key"), "text", F.when(name == "gibberish", F.lit(n)).otherwise(F.lit(SPAN_TEXTS))).cast("long"))
    pool = None
    for pool_name, df in texts.items():
        part = df.select(F.lit(pool_name).alias("name"), "id", "text")
        pool = part if pool is None else pool.unionByName(part)
    return rows.join(pool, ["name", "id"]).select("doc", "no", "name", "text")


def with_spans(made: Column, spans: Column, key: Column, most: int) -> Column:
    """(text, tokens, tags) with spans (no, text, tokens) put at places of the tokens drawn by hash, and their texts at the end."""
    none = lambda a: F.transform(a, lambda _: F.lit(0).cast("long"))

    def step(acc: Column, s: Column) -> Column:
        n = F.size(acc["tokens"])
        at = N.pick(F.concat_ws("\0", key, s["no"].cast("string")), "span-at", n + 1)
        piece = F.slice(s["tokens"], 1, F.least(F.when(s["no"] == 0, CODE_TOKENS).otherwise(SPAN_TOKENS), most - n))
        put = lambda a, x: F.concat(F.slice(a, 1, at), x, F.slice(a, at + 1, F.size(a)))
        room = n < most + 2 - F.when(s["no"] < 2, FIRST_ROOM).otherwise(ROOM)
        longer = F.struct(F.concat(acc["text"], F.lit(" "), s["text"]).alias("text"), put(acc["tokens"], piece).alias("tokens"), put(acc["tags"], none(piece)).alias("tags"))
        return F.when(room, longer).otherwise(acc)

    return F.aggregate(F.array_sort(spans), made, step)


def drawn_documents(wanted: DataFrame, pool: DataFrame, seed: int, tokenizer, most: int, used: DataFrame | None) -> DataFrame:
    """(doc, kind, original_text, tokens, ner_tags) of demands, of any length."""
    drawn = pools.draw(wanted, pool, used=used).join(wanted.select("doc", "slot", "kind", "n_slots"), ["doc", "slot"])
    dim = lang_dim(drawn.sparkSession).select("lang", "label", "script", "latin")
    drawn = drawn.join(F.broadcast(dim), "lang").withColumn("key", F.concat_ws("\0", F.lit(str(seed)), "doc", F.col("slot").cast("string")))
    drawn = materialized(drawn, "drawn")  # each kind reads it
    parts = None
    for kind in KINDS:
        own = noisy(drawn.where(F.col("kind") == kind.name), kind)
        if kind.name == "spliced":  # the sentence before a splice loses its end, the one after its capital
            own = own.withColumn("sentence", F.when(F.col("slot") == F.col("n_slots") - 1, F.lower(T.strip_terminal_punct("sentence"))).otherwise(F.col("sentence")))
        tokens = tokenizer("sentence")
        own = own.withColumn("t", F.when(N.u(F.col("key"), "punct") < kind.strip_punct, L.drop_punct(tokens)).otherwise(tokens))
        own = token_noise(own.withColumn("tags", L.bio(F.col("t"), "label")), kind)
        if kind.wrap:
            wrapped, (before, after) = N.u(F.col("key"), "wrap") < kind.wrap, formatting(F.col("key"))
            own = own.withColumn("before", F.when(wrapped, before).otherwise("")).withColumn("after", F.when(wrapped, after).otherwise(""))
            own = own.withColumn("sentence", F.concat("before", "sentence", "after"))
        else:
            own = own.withColumn("before", F.lit("")).withColumn("after", F.lit(""))
        made = L.wrap_outside(F.col("t"), F.col("tags"), tokenizer("before"), tokenizer("after"))
        own = own.withColumn("made", made).withColumn("gap", F.when(N.u(F.col("key"), "paragraph") < kind.paragraph, "\n\n").otherwise(" "))
        own = own.select("doc", "kind", "slot", "part", "sentence", "gap", "made")
        parts = own if parts is None else parts.unionByName(own)
    rows = F.array_sort(F.collect_list(F.struct("slot", "part", "sentence", "gap", F.col("made.tokens").alias("tokens"), F.col("made.labels").alias("tags"))))
    out = parts.groupBy("doc", "kind").agg(rows.alias("rows"))
    spans = outside_spans(wanted, pool, seed).withColumn("tokens", tokenizer("text")).groupBy("doc").agg(F.collect_list(F.struct("no", "text", "tokens")).alias("spans"))
    out = out.join(spans, "doc", "left")
    # code only goes to mixed documents of a single sentence
    spans = F.filter(F.coalesce("spans", F.array().cast("array<struct<no:int,text:string,tokens:array<string>>>")), lambda s: (s["no"] > 0) | (F.size("rows") == 1))
    text = F.aggregate("rows", F.lit(""), lambda acc, r: F.when(acc == "", r["sentence"]).otherwise(F.concat(acc, r["gap"], r["sentence"])))
    made = F.struct(text.alias("text"), F.flatten("rows.tokens").alias("tokens"), F.flatten("rows.tags").alias("tags"))
    key = F.concat_ws("\0", F.lit(str(seed)), "doc")
    return out.withColumn("made", with_spans(made, spans, key, most)).select("doc", "kind", F.col("made.text").alias("original_text"), "made.tokens", F.col("made.tags").alias("ner_tags"))


def documents(wanted: DataFrame, pool: DataFrame, seed: int = 0, tokenizer=L.tokens, max_length: int = MAX_LENGTH, retries: int = RETRIES) -> DataFrame:
    """Examples (doc, kind, original_text, tokens, ner_tags, input_ids, attention_mask, labels) for demands over a numbered pool.

    All demands are numbered together, so no sentence is drawn twice. Documents whose pools ran dry have fewer sentences.
    Documents of more than max_length tokens, special ones included, are drawn anew, from the sentences behind those drawn
    so far, up to retries times, and then left out: none is cut, so texts and tokens agree.
    """
    most, done, used = max_length - 2, None, None
    for attempt in range(retries):
        out = materialized(drawn_documents(wanted, pool, seed + 1009 * attempt, tokenizer, most, used).where(F.size("tokens") > 0), "documents")
        fits = out.where(F.size("tokens") <= most)
        done = fits if done is None else done.unionByName(fits)
        long_ = out.where(F.size("tokens") > most).select("doc")
        if long_.isEmpty():
            break
        now = wanted.groupBy("pool", "lang").agg(F.sum("n").alias("used"))
        used = materialized(now if used is None else used.unionByName(now).groupBy("pool", "lang").agg(F.sum("used").alias("used")), "used")
        wanted = materialized(wanted.join(long_, "doc", "left_semi"), "demands")
    made = L.model_inputs(L.token_ids(F.col("tokens")), F.col("ner_tags"), START, END, max_length)
    return done.withColumn("m", made).select("doc", "kind", "original_text", "tokens", "ner_tags", "m.*")


def build(sentences: DataFrame, total: int, seed: int = 42, repeated: bool = False) -> DataFrame:
    """Synthetic examples from (source, lang, sentence): pools, plans for every kind, and documents.

    Where sentences are repeated, equal rows count as one. All of them meet only to be counted; those that can be drawn,
    a bounded part, meet once more.
    """
    rows = sentences.select("source", "lang", "sentence")
    split = pools.split_by_hash(rows.distinct() if repeated else rows, seed)
    counted = materialized(pools.slice_counts(split, seed, per=("source",)), "counted")
    split = pools.split_by_hash(rows, seed, totals=counted.groupBy("source", "lang").agg(F.sum("_n").alias("total")))
    slices = materialized(counted.groupBy("pool", "lang", "_slice").agg(F.sum("_n").alias("_n")), "slices")
    supply = materialized(slices.groupBy("pool", "lang").agg(F.sum("_n").alias("n")), "supply")
    known = F.array(*map(F.lit, sorted(r["lang"] for r in supply.select("lang").distinct().where(F.col("lang").isin(*LANGUAGES)).collect())))  # languages: at most 105
    wanted, counts = None, targets(total)
    for i, kind in enumerate(KINDS):
        per_doc = 3 if kind.name == "pure" else 4
        capacity = supply.where((F.col("pool") == kind.pool) & F.col("lang").isin(*LANGUAGES)).select("lang", F.floor(F.col("n") / per_doc).alias("capacity"))
        plan = pools.doc_plan(capacity, counts[kind.name], seed + 101 * (i + 1))
        part = demands(plan, kind, known, seed)
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = materialized(wanted, "demands")
    # no more than this can be drawn, however often documents are drawn anew
    upto = wanted.groupBy("pool", "lang").agg((F.sum("n") * RETRIES).alias("most"))
    pool = materialized(pools.numbered(split, seed, upto=upto, counts=slices, repeated=repeated).select("pool", "lang", "idx", "sentence"), "pool")
    return documents(wanted, pool, seed)


def model_ready(examples: DataFrame, include_spliced: bool = False) -> DataFrame:
    """Examples with split, input_ids, attention_mask and labels. Spliced ones are left out unless asked for."""
    kinds = [k.name for k in KINDS if include_spliced or k.name != "spliced"]
    out = examples.where(F.col("kind").isin(*kinds))
    return pools.train_eval(out, F.col("doc"), 0.95).select("split", "input_ids", "attention_mask", "labels")


def multilabel(df: DataFrame) -> DataFrame:
    """Multi-hot rows of the languages present."""
    return df.withColumn("labels", L.multi_hot(L.languages_present(F.col("labels")))).select(*(c for c in df.columns if c != "token_type_ids"))
