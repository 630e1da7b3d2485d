import random
import re
from collections import Counter

from tessella.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)


def texts():
    rng = random.Random(4)
    yield from (None, "", "   \n\t", "a", "#" * 500, "é b c \x1c d\x0be\x0cf\rg", "same line\n" * 40, "a b c " * 60, "x" * 100_000)
    for _ in range(300):
        yield "".join(rng.choice(["a", "bb", "é", " ", " ", "\n", "\t", "#", "$", "　", "😀"]) for _ in range(rng.randint(0, 200)))


def test_measures():
    for text in texts():
        assert Q.measure(text) == brute(text), text


def test_ledger_policies_and_ablations(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(5, "dup " * 80, 1), (5, "dup " * 80, 1), (None, "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, failed int")
    book = Q.quality_rules(df)
    out = book.collect()
    assert len(out) == len(rows)
    for r in out:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and (not r.kept if base else True) and r.kept == (r.failed & Q.mask(Q.CURRENT) == 0)
    got = {(r.policy, r.without): (r.n_kept, r.n_only_by_this) for r in Q.ablations(book).collect()}
    for policy, rules in Q.POLICIES.items():
        kept = lambda m: sum(r.failed & m == 0 for r in out)  # noqa: B023, E731
        assert got[policy, "none"] == (kept(Q.mask(policy)), 0)
        for rule in rules:
            m = Q.mask(policy) & ~Q.bit(rule)
            assert got[policy, rule] == (kept(m), kept(m) - kept(Q.mask(policy)))
    assert Q.kept_rows(df).count() == sum(r.kept for r in out) and Q.kept_rows(df).columns == df.columns
    assert Q.quality_rules(df.limit(0)).count() == 0 and Q.ablations(Q.quality_rules(df.limit(0))).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "word " * 60, 5), (2, " ".join(f"w{i}" for i in range(60)), 6), (3, None, 7)], "doc_id long, text string, _rule_n_words long")
    kept = Q.kept_rows(docs)
    assert [tuple(r) for r in kept.collect()] == [(2, " ".join(f"w{i}" for i in range(60)), 6)] and kept.columns == docs.columns
