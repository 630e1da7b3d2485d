import hashlib
import random
import re

from tessella.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """Base spans as the patterns state them."""
    text, out = text or "", []
    for no, (kind, pattern) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def texts():
    rng = random.Random(7)
    yield from (None, "", "😀 a@b.co 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111", "x@y.com_foo@bar.com a@b..c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 00001.2.3.4")
    yield from ("9" * 5000, "a" * 20000 + "@", "a@" + "b." * 20000, "1 " * 20000, "-" * 3000 + "1.1.1.1", "+1" + " " * 20000 + "2", "4111-1111-1111-1111 " * 700)
    for _ in range(1500):
        yield "".join(rng.choice(["a", "é", "😀", " ", ".", "-", "+", "@", "(", ")", "_", "%", "\n", *"0123456789", "4111111111111111", "+1 (988) 555-2485", "x@y.z", "10.0.0.1"]) for _ in range(rng.randint(1, 40)))


def test_base_spans(spark):
    cases = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "c") for i, t in cases], "doc_id long, text string, found string").repartition(8)
    rows = {r.doc_id: r for r in pii.spans_digest(docs).collect()}
    for i, text in cases:
        want = brute(text)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (text or "")[:300]
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, line.split(","))) <= set(rows[i].spans.split(","))
    assert pii.spans_digest(docs.limit(0)).count() == 0


def test_more_spans_and_mask(spark):
    texts = [f'word token = "{hashlib.md5(str(i).encode()).hexdigest()}" and AKIA{hashlib.md5(str(i).encode()).hexdigest()[:16].upper()} mail me.{i}@x.org' for i in range(60)]
    texts += [f"plain well-known-phrase-{i} and some-long-hyphened-word" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.spans_digest(docs).collect()}
    assert all(rows[i].count("secret:") == 2 for i in range(60)) and not any(rows[i] for i in range(60, 120))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[3] == 'word token = "<secret>" and <secret> mail <email>' and masked[70] == texts[70]


def test_edge_cases(spark):
    """Long runs, repeated rows and rows without doc_id; more spans at the places they have in the text."""
    key = hashlib.md5(b"k").hexdigest()
    secret = "a" * 230 + key
    texts = [f'the token = "{secret}" here', None, "", f"é😀 token: {key}", *(f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"' for i in range(80))]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, texts[3]), (2, texts[1]), (3, texts[2]), *((10 + i, t) for i, t in enumerate(texts[4:]))], "doc_id long, text string").withColumn("spans", pii.F.lit("clash"))
    rows = pii.spans_digest(docs).collect()
    at = texts[0].index(secret)
    assert [r.spans for r in rows if r.doc_id == 1] == [f"secret:{at}:{at + len(secret)}"] * 2
    assert [r.spans for r in rows if r.doc_id is None] == [f"secret:10:{10 + len(key)}"]
    assert all(r.spans == "" for r in rows if r.doc_id in (2, 3))
    assert all(r.spans == "secret:9:41" for r in rows if (r.doc_id or 0) >= 10)


def test_reliabilities_like_brute_force(spark):
    """Expectation-maximisation over counted patterns equals that over single candidates."""
    rng = random.Random(5)
    texts = [rng.choice([f'key = "{hashlib.md5(str(i).encode()).hexdigest()}"', f"see well-known-phrase-{i}", f"call (212) 555-{1000 + i}", f"id 123-45-{1000 + i}", f"from me{i}@x.org"]) for i in range(300)]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = pii.fit(found)
    votes = [[x.votes[n] for n in pii.LABELERS] for r in found.collect() for x in [*r.base, *r.more]]
    prior, right = 0.5, [0.75] * len(pii.LABELERS)
    for _ in range(60):
        p = []
        for v in votes:
            a, b = prior, 1 - prior
            for x, t in zip(v, right):
                a *= t if x > 0 else 1 - t if x < 0 else 1
                b *= 1 - t if x > 0 else t if x < 0 else 1
            p.append(a / (a + b))
        prior = min(0.95, max(0.05, sum(p) / len(p)))
        for k in range(len(right)):
            own = [(q if v[k] > 0 else 1 - q) for q, v in zip(p, votes) if v[k]]
            right[k] = min(0.98, max(0.5, (sum(own) + 1) / (len(own) + 2)))
    assert abs(model.prior - prior) < 1e-6 and all(abs(model.reliability[n] - t) < 1e-6 for n, t in zip(pii.LABELERS, right))
