"""Benchmark decontamination by templates: re-parameterised questions are found like verbatim ones.

Texts and benchmark items become template tokens: words in lower case without outer punctuation, numbers as <num>,
unit words after a number as <unit>, and capitalised words as <name>, wherever they stand, so that line breaks and
sentence ends don't matter. Signs of operations beside a number are tokens as well, which stand for themselves; other
tokens without letter or digit are not. Windows of WINDOW template tokens are hash-joined between documents and items. A window with
fewer than PLAIN tokens that aren't placeholders (words that begin a sentence count as plain here) says too little and
is hashed as it stands, values and all. An item's windows are also joined with the words that begin its sentences taken
as words, for texts that write them small, and with all its names taken as words, for texts in capitals. Items of two to
four tokens are joined with sentences (or lines) of as many words, as they stand.
A document's windows are first looked up in a bitmap of fixed size made from all items' windows, so only probable hits
leave the scan, and the join removes the false ones. Hits are grouped by document, item and diagonal (distance of the
two positions); on a diagonal each value of the item must stand for one value of the document, and each name of the
document for one name of the item (slot consistency), and where that fails only windows whose values are all the item's
own count. So it is for items of fewer than FEW windows, all of which must be there, unless every window has WORDY plain
words at least: a template of a few words and many numbers is met in any text on numbers. A pair is reported where these windows

* are SHARE of the item's windows, or
* cover SHARE of the tokens that the item's windows cover (an edit costs its own token where WINDOW unchanged tokens
  stand on both sides of it), or
* follow each other on one diagonal over RUN tokens (a part of a long item).

Nulls and edge cases: null and empty texts have no windows; items of one token are too short to tell and never match;
repeated documents or items with equal ids count as one in contaminated(), and rows without doc_id count as one
document; clean() judges every row by its own text, whatever its doc_id; texts of any length are read whole; empty
tables give no pairs; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import fresh, map_rows, staged, use_cache, with_key
from tessella.llm.hashing import MIX, mixed, text_hash

WINDOW, PLAIN, SHARE, LOOSE, RUN = 5, 2, 0.8, 0.1, 13
#: Items of fewer windows, and with windows of fewer plain words, only match with their own values.
FEW, WORDY = 4, 3
#: Words of an item that is looked for as a whole; bits of a window that is taken as it stands.
SHORT, ALL = (2, 3, 4), (1 << WINDOW) - 1
BITMAP = 1 << 22
NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:%|[a-zµ°]{0,4}\d?)$")

# fixed values: unit words
UNITS = frozenset(
    "kg g mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes km m cm mm mile miles mi foot feet ft inch inches in yard yards l ml litre litres liter liters gallon gallons "
    "second seconds s sec minute minutes min hour hours h hr hrs day days week weeks month months year years percent % dollar dollars euro euros cent cents degree degrees mph kmh".split()
)
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
HASHES = {kind: np.uint64(text_hash(f"<{name}>".encode())) for kind, name in ((NUM, "num"), (UNIT, "unit"), (NAME, "name"))}
BREAK = "\x03"
ENDINGS = (".", "!", "?", ":", ";")
CLOSING = "\"'”’)]"
#: Signs that are tokens beside a number.
OPERATORS = frozenset("+-*/=<>^×÷·±≤≥≠≈√−")
OUTER = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‘’«»‹›…–—¿¡。、，！？：；（）【】"


class Tokens:
    """Facts of the raw tokens seen so far, by small integers: plain form, hash and flags."""

    NUMBER, CAPITAL, ENDS, FULL, SINGLE, SHOUT, OPERATOR = 1, 2, 4, 8, 16, 32, 64

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.plain: list[str] = []
        self.hash, self.flags = np.empty(1 << 14, np.uint64), np.empty(1 << 14, np.uint8)

    def add(self, raw: str) -> int:
        i = len(self.plain)
        if i == len(self.hash):
            self.hash, self.flags = np.concatenate([self.hash, self.hash]), np.concatenate([self.flags, self.flags])
        plain = raw if raw.isalpha() else raw.strip(OUTER)
        lower = plain.lower()
        number = not plain.isalpha() and NUMBER.match(lower) is not None
        flags = self.NUMBER if number else 0
        if not number and plain[:1].isupper() and (len(plain) == 1 or not plain.isupper()):
            flags |= self.CAPITAL | (self.SINGLE if len(plain) == 1 else 0)
        elif len(plain) > 1 and plain.isupper():
            flags |= self.SHOUT
        if raw == BREAK or (plain is not raw and raw.rstrip(CLOSING)[-1:] in ENDINGS):
            flags |= self.ENDS
        if plain.isalnum() or any(map(str.isalnum, plain)):
            flags |= self.FULL
        elif OPERATORS.issuperset(raw):
            flags |= self.OPERATOR
            lower = raw
        self.hash[i] = text_hash(lower.encode("utf-8", "surrogatepass"))
        self.flags[i] = flags
        self.plain.append(lower)
        self.index[raw] = i
        return i

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.plain) > self.most:
            self.clear()
        get = self.index.get
        out = [get(t) for t in tokens]
        if None in out:
            for k, i in enumerate(out):
                if i is None:
                    out[k] = i if (i := get(tokens[k])) is not None else self.add(tokens[k])
        return np.array(out, np.int64)


_tokens = Tokens()


class Windows:
    """The windows of some texts: text, position and hash of each, and the slots in them.

    literal has bits for the tokens of a window that are taken as they stand. With items, there are also windows with some
    of the words that begin a sentence, or all names, taken as words.
    """

    def __init__(self, texts: list[str | None], items: bool = False):
        use_cache("tokens", _tokens.clear)
        tokens: list[str] = []
        ends = []
        for text in texts:
            if text:
                tokens += text.replace("\n", f" {BREAK} ").split()
            ends.append(len(tokens))
        ids = _tokens.ids(tokens)
        flags = _tokens.flags[ids]
        hashes = _tokens.hash[ids]
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        number = flags & Tokens.NUMBER > 0
        inside = np.empty(len(ids), bool)  # not the first of a sentence
        inside[1:] = (flags[:-1] & Tokens.ENDS == 0) & (text[1:] == text[:-1])
        inside[:1] = False
        shout = np.zeros(len(ids) + 2, bool)  # beside a word in capitals, a single capital letter is no name
        shout[1:-1] = flags & Tokens.SHOUT > 0
        named = (flags & (Tokens.CAPITAL | Tokens.FULL) == Tokens.CAPITAL | Tokens.FULL) & ~((flags & Tokens.SINGLE > 0) & (shout[:-2] | shout[2:]))
        kinds = np.where(number, NUM, WORD).astype(np.int8)
        words = hashes.copy()
        hashes[number] = HASHES[NUM]
        hashes[named], kinds[named] = HASHES[NAME], NAME
        for i in np.flatnonzero(number[:-1]) + 1:
            if text[i] == text[i - 1] and _tokens.plain[ids[i]] in UNITS:
                hashes[i], kinds[i] = HASHES[UNIT], UNIT
        beside = np.zeros(len(ids), bool)  # a number stands before or after
        beside[1:] = number[:-1] & (text[1:] == text[:-1])
        beside[:-1] |= number[1:] & (text[1:] == text[:-1])
        operator = (flags & Tokens.OPERATOR > 0) & beside
        full = np.flatnonzero((flags & Tokens.FULL > 0) | operator)
        # a token without letters and digits, such as a line break, begins a sentence for the next full one
        sentence = np.cumsum(~inside)[full] if len(full) else np.empty(0, np.int64)
        first = (named & ~inside)[full]
        hashes, words, text, self.kinds, self.ids = hashes[full], words[full], text[full], kinds[full], ids[full]
        word = ((self.kinds == WORD) | first) & ~operator[full]
        n = max(0, len(full) - WINDOW + 1)
        plain = np.zeros(n, np.int8)
        for i in range(WINDOW):
            plain += word[i : i + n]
        at = np.flatnonzero(text[:n] == text[WINDOW - 1 :]) if n else np.empty(0, np.int64)
        parts = [(at, np.where(plain[at] >= PLAIN, 0, ALL), np.full(len(at), WINDOW))]
        if items:
            parts.append(self._variants(at[plain[at] >= PLAIN], first, self.kinds == NAME))
        parts += self._sentences(text, sentence, items)
        self.at, self.literal, self.size = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        self.hash = self.size.astype(np.uint64)
        for k in range(WINDOW):
            use = np.flatnonzero(self.size > k)
            a = self.at[use] + k
            self.hash[use] = mixed(self.hash[use] * MIX + np.where(self.literal[use] >> k & 1 == 1, words[a], hashes[a]))
        self.plain = np.array([word[a : a + k].sum() for a, k in zip(self.at.tolist(), self.size.tolist())], np.int64) if items else np.zeros(len(self.at), np.int64)
        self.text = text[self.at]
        self.pos = self.at - np.searchsorted(text, self.text)

    def _variants(self, at: np.ndarray, first: np.ndarray, named: np.ndarray) -> tuple[list, list, list]:
        """Windows of an item with some words that begin a sentence, or all names, taken as words."""
        found = []
        for a in at.tolist():
            bits = sum(1 << k for k in range(WINDOW) if first[a + k])
            some, part = {sum(1 << k for k in range(WINDOW) if named[a + k])}, bits
            while part:
                some.add(part)
                part = (part - 1) & bits
            found += [(a, b) for b in sorted(some) if b]
        return [a for a, _ in found], [b for _, b in found], [WINDOW] * len(found)

    def _sentences(self, text: np.ndarray, sentence: np.ndarray, items: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole sentences of SHORT words, as they stand; of items, the whole item if it has so many words."""
        if not len(text):
            return []
        edge = text[1:] != text[:-1]
        if not items:
            edge = edge | (sentence[1:] != sentence[:-1])
        start = np.concatenate([[0], np.flatnonzero(edge) + 1])
        size = np.diff(start, append=len(text))
        short = np.isin(size, SHORT)
        return [(start[short], np.full(short.sum(), ALL), size[short])]

    def keep(self, wanted: np.ndarray) -> None:
        self.at, self.literal, self.size, self.hash, self.plain, self.text, self.pos = (x[wanted] for x in (self.at, self.literal, self.size, self.hash, self.plain, self.text, self.pos))

    def slots(self, i: int) -> list[dict]:
        """Of the i-th window."""
        a, literal = self.at[i], self.literal[i]
        return [{"at": k, "kind": int(self.kinds[a + k]), "value": _tokens.plain[self.ids[a + k]]} for k in range(self.size[i]) if not literal >> k & 1 and self.kinds[a + k] != WORD]


SLOT = pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.string())])


def window_rows(df: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """key, hash, pos, size, plain (words of items) and slots of the windows of df.text; with a bitmap, of those that it has, without one those of items."""
    kind = to_arrow_type(df.schema[key].dataType)

    def block(rows: dict) -> dict:
        found = Windows(rows["text"], bitmap is None)
        if bitmap is not None:
            found.keep(np.flatnonzero(bitmap[(found.hash >> np.uint64(42)).astype(np.int64)]))
        ids = pa.array(rows[key], kind).take(pa.array(found.text, pa.int64()))
        return {key: ids, "hash": found.hash.view(np.int64), "pos": found.pos, "size": found.size, "plain": found.plain, "slots": [found.slots(i) for i in range(len(found.at))]}

    schema = pa.schema([(key, kind), ("hash", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("plain", pa.int32()), ("slots", pa.list_(SLOT))])
    return map_rows(with_key(df, (key, "text")), block, schema, 1 << 20)


def _tokens_of(positions: str, size: Column | int = WINDOW) -> Column:
    """Number of tokens in the windows at some positions."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.sequence(p, p + size - 1)))))


def _longest_run(positions: str) -> Column:
    """Tokens in the longest stretch of windows that follow each other."""
    start = F.struct(F.lit(-9).cast("long").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(state: Column, p: Column) -> Column:
        n = F.when(p == state["last"] + 1, state["n"] + 1).otherwise(1)
        return F.struct(p.alias("last"), n.alias("n"), F.greatest(state["most"], n).alias("most"))

    return F.aggregate(F.array_sort(positions), start, step, lambda s: s["most"] + WINDOW - 1)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """key, item_id, n_matched (windows of the item), share, verbatim (no slot differs): the leaked pairs."""
    items = staged(window_rows(benchmark, "item_id"), "items")
    slots = items.select(F.shiftrightunsigned("hash", 42).alias("bit")).distinct().toPandas()["bit"].to_numpy()  # at most BITMAP values
    bitmap = np.zeros(BITMAP, bool)
    bitmap[slots.astype(np.int64)] = True
    sizes = items.groupBy("item_id").agg(F.collect_set("pos").alias("all"), F.min("size").alias("size"), F.min("plain").alias("plain")).select("item_id", "size", "plain", F.size("all").alias("n_windows"), _tokens_of("all", F.col("size")).alias("n_tokens"))
    is_telling = (F.col("n_windows") >= FEW) | (F.col("plain") >= WORDY)
    telling = sizes.select(F.col("item_id").alias("_item"), is_telling.alias("telling"))
    theirs = items.select("item_id", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")).join(telling, F.expr("item_id <=> _item")).drop("_item")
    hits = window_rows(docs, key, bitmap).drop("plain").join(theirs, "hash")
    # pairs of values that meet in a window: (value of the item, value of the document)
    meet = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a["value"].alias("a"), b["value"].alias("b"), (a["kind"] == NAME).alias("name")))
    same = F.forall(F.zip_with("item_slots", "slots", lambda a, b: (a["at"] == b["at"]) & (a["kind"] == b["kind"])), lambda x: x)
    hits = hits.where((F.size("item_slots") == F.size("slots")) & same)
    own = F.forall("meet", lambda x: x["a"] == x["b"])
    lines = hits.select(key, "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "telling", meet.alias("meet")).withColumn("own", own)
    lines = lines.groupBy(key, "item_id", "diagonal").agg(
        F.collect_set("item_pos").alias("covered"), F.collect_set(F.when(F.col("own"), F.col("item_pos"))).alias("verbatim_at"), F.array_distinct(F.flatten(F.collect_set("meet"))).alias("meet"),
        F.first("telling").alias("telling"),
    )
    names = F.filter("meet", lambda x: x["name"])
    distinct = lambda array, side: F.size(F.array_distinct(F.transform(array, lambda x: F.struct(x[side], x["name"]))))
    fits = (F.size("meet") <= (1 + LOOSE) * distinct("meet", "a")) & (F.size(names) <= (1 + LOOSE) * distinct(names, "b"))
    lines = lines.withColumn("fits", fits & F.col("telling")).withColumn("covered", F.when(F.col("fits"), F.col("covered")).otherwise(F.col("verbatim_at")))
    lines = lines.where(F.size("covered") > 0).withColumn("run", _longest_run("covered"))
    verbatim = F.every(~F.col("fits") | F.forall("meet", lambda x: x["a"] == x["b"])).alias("verbatim")
    pairs = lines.groupBy(key, "item_id").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.max("run").alias("run"), verbatim)
    pairs = pairs.join(sizes, "item_id").withColumn("n_matched", F.size("covered").cast("long"))
    long_run = (F.col("run") >= RUN) & (F.col("size") == WINDOW)
    pairs = pairs.where(is_telling | (F.col("n_matched") == F.col("n_windows")))
    pairs = pairs.where((F.col("n_matched") >= SHARE * F.col("n_windows")) | (_tokens_of("covered", F.col("size")) >= SHARE * F.col("n_tokens")) | long_run)
    return pairs.select(key, "item_id", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("share"), "verbatim")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, share, verbatim: the leaked pairs, by doc_id."""
    return leaks(docs, benchmark, "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; rows are told apart by a digest of their text, so equal texts share a verdict."""
    key = fresh(docs, "leak_key")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    found = leaks(docs.select(digest.alias(key), "text"), benchmark, key).select(key).distinct()
    return docs.withColumn(key, digest).join(found, key, "left_anti").select(*docs.columns)
