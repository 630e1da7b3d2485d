import random
import struct

import corpus_pipeline
from tessella.llm import bpe, pii, quality_rules
from tests.llm.test_minhash import brute, shingle_set
from tests.llm.test_pii import brute as brute_spans

ITEM = "The quick traveller walks along the river until the old bridge appears behind tall green trees at dusk."


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = []
    for i in range(60):
        body = text(rng.randint(20, 150))
        if i % 7 == 0:
            body += " " + ITEM + " " + text(40)
        if i % 5 == 0:
            body += f" mail me{i}@x.org or +1 (555) 123-4{i:03d} now"
        if i % 11 == 0:
            body = "again and " * 40
        docs.append(body)
    docs += [d + " end" for d in docs[:20]] + docs[20:30] + ["", None, "### $$$ %%% " * 30]
    return [(i, d, "en", "s", len(d or "")) for i, d in enumerate(docs)]


def test_like_brute_force(spark, tmp_path):
    docs = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    policy = quality_rules.mask(quality_rules.CURRENT)
    good = []
    for d, t, *_ in docs:
        n_words, chars, symbols, dups, repeats, lines = quality_rules.measure(t)
        fails = [n_words < 50, 100 * repeats > 50 * n_words, 100 * symbols > 30 * n_words, 100 * dups > 70 * lines, chars < 2 * n_words, chars > 25 * n_words]
        if not sum(f << i for i, f in enumerate(fails)) & policy:
            good.append((d, t))
    groups = brute(good)
    single = [(d, t) for d, t in good if groups[d][1] == d]
    clean = [(d, t) for d, t in single if ITEM not in t]
    assert len(good) > len(single) > len(clean) > 10
    vocabulary, want = bpe.Vocabulary(bpe.default_path()), {}
    for d, t in clean:
        for s, _, e, kind in sorted(brute_spans(t), reverse=True):
            t = t[:s] + f"<{kind}>" + t[e:]
        want[d] = vocabulary.encode(t)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (struct.pack(f"<{len(r.ids)}I", *r.ids), r.decoded) for r in rows} == want
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        read = stage(spark, read, str(tmp_path))
        assert read.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pii.mask(read.limit(0)).count() == 0


def test_near_duplicates_at_080(spark):
    rng = random.Random(4)
    texts = []
    for i in range(80):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        changed = [f"x{i}" if j in (20, 50, 80)[: 1 + i % 3] else w for j, w in enumerate(words)]
        texts += [" ".join(words), " ".join(changed)]
    similar = lambda a, b: len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    want = {2 * i for i in range(80)} | {2 * i + 1 for i in range(80) if similar(texts[2 * i], texts[2 * i + 1]) < 0.8}
    assert sum(0.8 <= similar(a, b) < 0.85 for a, b in zip(texts[::2], texts[1::2])) > 20 and len(want) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def run(spark, folder, docs, schema, items=((1, ITEM),)):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_edge_cases(spark, tmp_path):
    """Nulls in any column, repeated rows and doc_ids, clashing names, very long texts; every row is judged by its own text."""
    rng = random.Random(3)
    fresh = lambda n=80: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    a, b, c, d, e = (fresh() for _ in range(5))
    long = fresh(30_000)
    docs = [
        (1, a, "en", "k"), (1, b, None, None), (2, a, "en", "k"), (7, c, "en", "k"), (7, c, "en", "k"), (None, d, "en", "k"), (None, d + " " + ITEM, None, "k"), (None, e, "de", None),
        (7, e + " " + ITEM, "en", "k"), (8, None, "en", "k"), (9, "", "en", "k"), (10, " \n ", "en", "k"), (11, long, "en", "k"),
    ]
    schema = "doc_id long, text string, lang string, leak_key string"
    rows = run(spark, tmp_path, docs, schema).collect()
    # of equal doc_id and text one row stays; rows without doc_id are no duplicates of each other
    want = sorted([(1, a), (1, b), (7, c), (-1, d), (-1, e), (11, long)])
    vocabulary = bpe.Vocabulary(bpe.default_path())
    assert sorted((r.doc_id or -1, r.decoded) for r in rows) == sorted((i, vocabulary.encode(t)[1]) for i, t in want)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long", []).count() == 0
