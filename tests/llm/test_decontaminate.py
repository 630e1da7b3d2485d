import random

from tessella.llm import decontaminate


def pairs(spark, docs, items):
    d = spark.createDataFrame([(*x, "h") for x in docs], "doc_id long, text string, hash string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(d, b).collect()}


ITEM = "A train with Alice leaves at 9 and covers 120 km before Alice meets Bob after 3 hours on the long way north."


def test_verbatim_and_reparameterised(spark):
    docs = [
        (1, "Some words first. " + ITEM + " Then more words."),
        (2, "Intro text here. A train with Carla leaves at 7 and covers 95 miles before Carla meets Dan after 5 hours on the long way north. End."),
        (3, "Intro text here. A train with Carla leaves at 7 and covers 95 miles before Erik meets Carla after 5 hours on the long way north. End."),
        (4, "A train leaves and covers the long way north."),
        (5, None),
        (6, ""),
        (7, ITEM.upper()),
        (None, ITEM),
    ]
    assert pairs(spark, docs, [(10, ITEM), (11, "too short"), (12, "1 2 3 4 5 6 7 8 9"), (None, None)]) == {(1, 10): True, (2, 10): False, (7, 10): True, (None, 10): True}
    assert pairs(spark, docs[:0], [(10, ITEM)]) == {}
    assert pairs(spark, docs, [(11, None)]) == {}


def test_inconsistent_slots(spark):
    item = "Give Alice one pear and take it to Alice then bring the pear that Alice had back to Alice so Alice may eat."
    good, bad = item.replace("Alice", "Zoe"), item
    for name in ("Zoe", "Max", "Ida", "Tom", "Eva"):
        bad = bad.replace("Alice", name, 1)
    assert set(pairs(spark, [(1, good), (2, bad)], [(5, item)])) == {(1, 5)}


def test_clean_judges_rows(spark):
    rows = [(1, "x " + ITEM), (2, "y"), (None, "z"), (None, "z"), (None, "y " + ITEM), (7, "z " + ITEM), (7, "w"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, leak_key string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [r for r in docs.collect() if ITEM not in (r.text or "")]))
    assert decontaminate.clean(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(rows)


def test_short_items_and_placeholders(spark):
    docs = [(1, "Some talk.\nDefine photosynthesis.\nMore talk follows here."), (2, "We define photosynthesis as a process."), (3, "One line. DEFINE PHOTOSYNTHESIS! End."), (4, "The series 3 1 4 1 5 9 2 6 5 goes on"), (5, "The series 3 1 4 1 5 9 2 7 7 8 2 goes on 9 9 9")]
    assert set(pairs(spark, docs, [(1, "Define photosynthesis."), (2, "3 1 4 1 5 9 2 6 5"), (3, "Define")])) == {(1, 1), (3, 1), (4, 2)}


def test_two_way_consistency(spark):
    item = "Then Alice gives seven apples to Bob while Bob gives the red ball back to Alice before the long day ends."
    assert set(pairs(spark, [(1, item.replace("Alice", "Eva").replace("Bob", "Tom")), (2, item.replace("Alice", "Zed").replace("Bob", "Zed")), (3, item)], [(5, item)])) == {(1, 5), (3, 5)}


def brute(docs, items):
    """All windows of all documents against all windows of all items, by plain lists of tokens."""

    def read(text):
        out, start, after_number = [], True, False
        raw = (text or "").replace("\n", f" {decontaminate.BREAK} ").split()
        for k, t in enumerate(raw):
            plain = t.strip(decontaminate.OUTER)
            low = plain.lower()
            number = bool(decontaminate.NUMBER.match(low))
            shouted = len(plain) == 1 and any(len(x) > 1 and x.isupper() for x in (y.strip(decontaminate.OUTER) for y in (raw[k - 1] if k else "", *raw[k + 1 : k + 2])))
            name = not number and plain[:1].isupper() and (len(plain) == 1 or not plain.isupper()) and not shouted
            if any(map(str.isalnum, plain)):
                kind = "num" if number else "unit" if after_number and low in decontaminate.UNITS else "name" if name else "word"
                out.append((kind, low, start and name))
                start = False
            elif set(t) <= set("+-*/=<>^×÷·±≤≥≠≈√−") and any(decontaminate.NUMBER.match(x.strip(decontaminate.OUTER).lower()) for x in (raw[k - 1] if k else "", *raw[k + 1 : k + 2])):
                out.append(("sign", t, False))
            if t == decontaminate.BREAK or (t != plain and t.rstrip(decontaminate.CLOSING)[-1:] in decontaminate.ENDINGS):
                start = True
            after_number = number
        return out

    def windows(tokens, item):
        for i in range(len(tokens) - 4):
            part = tokens[i : i + 5]
            plain = sum(k == "word" or f for k, _, f in part)
            if plain < 2:
                yield i, tuple(low for _, low, _ in part), [], plain
                continue
            choices = [set()]
            if item:
                begins, names = [j for j in range(5) if part[j][2]], {j for j in range(5) if part[j][0] == "name"}
                choices = [{b for k, b in enumerate(begins) if x >> k & 1} for x in range(1 << len(begins))]
                choices += [names] if names not in choices else []
            for small in choices:
                yield i, tuple(low if k in ("word", "sign") or j in small else f"<{k}>" for j, (k, low, _) in enumerate(part)), [(k == "name", low, j) for j, (k, low, _) in enumerate(part) if k not in ("word", "sign") and j not in small], plain

    found = set()
    for item_id, item in items:
        tokens = read(item)
        theirs = list(windows(tokens, True))
        starts = {w[0] for w in theirs}
        telling = len(starts) >= 4 or min((w[3] for w in theirs), default=0) >= 3
        for doc_id, doc in docs:
            lines = {}
            for i, key, slots, _ in windows(read(doc), False):
                for p, other, values, _ in theirs:
                    if key == other and [(n, j) for n, _, j in slots] == [(n, j) for n, _, j in values]:
                        lines.setdefault(i - p, []).append((p, {(n, a, b) for (n, a, _), (_, b, _) in zip(values, slots)}))
            covered, run = set(), 0
            for hits in lines.values():
                met = set().union(*(m for _, m in hits))
                names = {m for m in met if m[0]}
                fits = telling and len(met) <= 1.1 * len({m[:2] for m in met}) and len(names) <= 1.1 * len({m[2] for m in names})
                here = {p for p, m in hits if fits or all(a == b for _, a, b in m)}
                covered |= here
                for p in here:
                    n = 0
                    while p + n in here:
                        n += 1
                    run = max(run, n + 4 if n else 0)
            span = lambda ps: {p + k for p in ps for k in range(5)}
            if not telling and len(covered) < len(starts):
                continue
            if covered and (len(covered) >= 0.8 * len(starts) or len(span(covered)) >= 0.8 * len(span(starts)) or run >= 13):
                found.add((doc_id, item_id))
    return found


def test_like_brute_force(spark):
    rng = random.Random(11)
    words = "the a long way north train leaves at home and covers before after day night Alice Bob Carla Dan Erik 3 7 12 120 + * = - km hours miles . ! value of some text".split()
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.randint(5, 45 if i < 20 else 9))) for i in range(30)]
    docs = []
    for d in range(120):
        text = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if d % 4 == 0:
            swap = {"Alice": "Zoe", "Bob": "Max", "3": "5", "7": "8", "km": "miles"}
            text = [swap.get(t, t) for t in text]
        if d % 9 == 0:
            text = [t.upper() for t in text]
        docs.append((d, line(rng.randint(0, 20)) + " " + " ".join(text[: rng.randint(8, 60)]) + "\n" + line(5)))
    want = brute(docs, items)
    assert 30 < len(want) and set(pairs(spark, docs, items)) == want


LONG = "During the harvest every farmer in the valley brings seven baskets of apples to the mill where the miller weighs them and pays a fair price before the evening bell calls all the tired workers home for soup."


def test_edited_partial_and_rewrapped(spark):
    words = LONG.split()
    docs = [
        (1, "Intro here. " + ITEM.replace("covers", "does") + " End."),
        (2, "Intro here. " + ITEM.replace("covers", "does").replace("after", "following") + " End."),
        (3, "Intro here. " + ITEM.replace("with Alice", "with Alicia") + " End."),
        (4, "Intro here. " + ITEM.replace("before Alice", "before\nAlice").replace("with Alice", "with\nAlice").replace("meets Bob", "meets\nBob") + " End."),
        (5, "They said a train with Alice leaves" + ITEM.split("leaves")[1]),
        (6, "Something else " + " ".join(words[10:26]) + " and quite another end."),
        (7, "Something else " + " ".join(words[10:21]) + " and quite another end."),
        (8, "Intro here. " + LONG.replace("baskets of", "large baskets of") + " End."),
        (9, "A train with a car leaves home and covers the way before dinner on the long way north."),
    ]
    got = pairs(spark, docs, [(10, ITEM), (20, LONG)])
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 10), (5, 10), (6, 20), (8, 20)}
    assert got[4, 10] and got[5, 10]


def test_names_that_begin_sentences(spark):
    item = "Every day Alice walks to the old market. Alice buys bread there and some milk. Bob waits at home and cooks."
    assert set(pairs(spark, [(1, "Well then. " + item.replace("Alice", "Carla").replace("Bob", "Dan"))], [(5, item)])) == {(1, 5)}


ARITHMETIC = [
    "I know what is 1.5 2 30 all about in this long text on gardens",
    "what is 9 - 2 / 6",
    "She asked what is 7 + 8 * 4 and wrote it down.",
    "Tell me what is 12 of the 40 and 50 on the list, and what is 3 2 1.",
    "The bill was 7 + 8 euros, that is 15, and what is 1 , 2 , 3 to you is 4 - 5 - 6 to me.",
    "Rows 1 2 3 and 4 + 5 = 9, or 6 * 7 = 42, are easy; what is 8 + 1 + 1?",
    "Compute rest days: 7 8 9, compute the rest later: 3 + 4.",
    "On 3 May 2021 what is 10 - 4 - 2 was no longer 7 + 8 * 5.",
]


def test_clean_prose_on_numbers_stays(spark):
    """Short items of few words and many numbers only match with their own numbers and signs."""
    items = [(1, "What is 7 + 8 * 3?"), (2, "What is 9 - 3 / 6"), (3, "Compute 3 + 4 + 5"), (4, "What is 1 2 4?"), (5, "What is the capital city of France?")]
    leaks = ["So: what is 7 + 8 * 3? Nobody knew.", "Easy. What is 9 - 3 / 6", "compute 3 + 4 + 5 at once", "Tell me what is the capital city of Spain?"]
    docs = list(enumerate(ARITHMETIC)) + [(100 + i, t) for i, t in enumerate(leaks)]
    assert set(pairs(spark, docs, items)) == {(100, 1), (101, 2), (102, 3), (103, 5)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.text for r in kept.collect()} == set(ARITHMETIC)


def test_longer_items_with_signs_match_with_other_numbers(spark):
    item = "Solve for the unknown price: if 3 + 4 apples cost 21 euros at the market stall then what do 2 * 5 apples cost?"
    docs = [(1, "Hm. " + item.replace("3 + 4", "6 + 1").replace("21", "35").replace("2 * 5", "3 * 4")), (2, "Hm. " + item.replace("3 + 4", "3 - 4").replace("2 * 5", "2 / 5"))]
    got = pairs(spark, docs, [(5, item)])
    assert (1, 5) in got and not got[1, 5]
