"""Personal data spans: base patterns, and further candidates judged by weak supervision. DataFrame functions only.

Base kinds are patterns with a check each (leftmost, non-overlapping per kind, no retries). Further kinds are wider
patterns whose matches become spans only if the final classifier says so:

1. labelers vote on every candidate, base matches included: strict patterns, gazetteers (key prefixes, toll-free and
   invalid number blocks), context (words and signs just before the match), shape and length. A vote is +1, -1 or 0.
2. candidates are counted by pattern of votes and shape buckets: at most 3^6 * 150 groups for each kind, whatever the
   input (a few hundred in practice). Expectation-maximisation over these counts estimates each labeler's reliability
   and each pattern's probability;
3. a logistic model over kind, votes and shape buckets is trained on these probabilities, weighted by the same counts.

Positions are code points. They come from the pieces between matches, so a text is scanned twice per kind at most,
and never leaves its row: there is no shuffle but that of the vote counts. Patterns start only where a run of their
characters starts and repeat possessively, which keeps very long runs linear and the matcher's stack flat.

Nulls and edge cases: null and empty texts have no spans; texts of any length are searched whole; repeated rows are
searched one by one; an empty table gives an empty result and an untrained model, which adds no spans; columns other
than doc_id and text are not read (mask() keeps all).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged, with_key


@dataclass(frozen=True)
class Kind:
    """may: SQL over ``text``, false where no match can be; valid: SQL over a match ``m``."""

    name: str
    pattern: str
    may: str
    valid: str = "true"


DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = (
    f"aggregate(sequence(1, length({DIGITS})), 0L, (s, i) -> s + case when i % 2 = 1 then int(substring(reverse({DIGITS}), i, 1)) "
    f"else (2 * int(substring(reverse({DIGITS}), i, 1))) div 10 + (2 * int(substring(reverse({DIGITS}), i, 1))) % 10 end) % 10 = 0"
)
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'", "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as int), 0) <= 255)"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", "text rlike '[0-9][ -]?[0-9][ -]?[0-9]'", f"length({DIGITS}) between 14 and 19 and case when length({DIGITS}) between 14 and 19 then {LUHN} else false end"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({DIGITS}) between 10 and 15"),
)
MORE = (
    Kind("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{14,}+", "text rlike '[0-9]'"),
    Kind("local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "text rlike '[0-9]{3}'"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]{3}-'"),
)
KINDS = BASE + MORE
BEFORE = 32

# fixed values: published key prefixes, toll-free area codes and number blocks that are never assigned
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ glpat- xoxb- xoxp- sk_live_ sk_test_ AIza eyJ"
TOLL_FREE = "800 833 844 855 866 877 888"
NEVER_IDS = "000 666"

WORDS = r"(?i)(e-?mail|mail|contact|tel|phone|call|mobile|fax|card|visa|account|token|secret|passw(or)?d|pwd|api[_-]?key|key|auth|bearer|ssn|social|id|ip|host|server)\W{0,4}$"
LABELERS = {
    "strict": r"""case kind when 'secret' then case when m rlike '^(AKIA|ASIA)[0-9A-Z]{16}$' or m rlike '^[0-9a-f]{32,64}$' then 1 when m rlike '^[a-z-]+[0-9]{1,4}$' then -1 else 0 end
        when 'local_phone' then case when m rlike '^[(][0-9]{3}[)] ' or m rlike '^[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\\1' then 1 else -1 end
        when 'national_id' then case when m rlike '^(000|666|9)' or m rlike '-00-' or m rlike '-0000$' then -1 else 1 end else 1 end""",
    "gazetteer": f"""case when kind = 'secret' then case when exists(split('{KEY_PREFIXES}', ' '), p -> startswith(m, p)) then 1 else 0 end
        when kind = 'local_phone' and array_contains(split('{TOLL_FREE}', ' '), substring({DIGITS}, 1, 3)) then -1
        when kind = 'national_id' and array_contains(split('{NEVER_IDS}', ' '), substring(m, 1, 3)) then -1 else 0 end""",
    "words": "case when worded then 1 else 0 end",
    "signs": r"""case when before rlike '[=:]\\s*["\']?$' or before rlike '["\'<(]$' then 1 when before rlike '[/#?&.]$' then -1 else 0 end""",
    "shape": r"""case when kind <> 'secret' then 0 when m rlike '^[A-Za-z]*[-_]?[0-9]{1,4}$' or m rlike '^[0-9-]+$' then -1
        when length(regexp_replace(m, '[^0-9]', '')) * 8 >= length(m) and size(array_distinct(split(m, ''))) >= 8 then 1 else -1 end""",
    "length": "case when kind <> 'secret' then 0 when length(m) between 16 and 128 then 1 else -1 end",
}
#: Buckets for the final classifier, beside the kind and the votes.
BUCKETS = {
    "size": "int(least(length(m) div 8, 5))",
    "digits": "int(4 * length(regexp_replace(m, '[^0-9]', '')) / length(m))",
    "upper": "int(4 * length(regexp_replace(m, '[^A-Z]', '')) / length(m))",
}


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _over(x: str, sql: str) -> str:
    """The SQL with the fields of a match taken from the struct x."""
    return re.sub(r"(?<![\w.'\[])(m|kind|before|worded)(?![\w'(])", rf"{x}.\1", sql)


TOTAL = "aggregate({}, 0L, (x, y) -> x + y)"


def _matches(kind: Kind) -> str:
    """SQL for the kind's checked matches in ``text``: array of (kind, no, m, start, end, before).

    A start is the sum of the lengths of pieces and matches before it; sums are kept by blocks of 256 matches.
    """
    no = KINDS.index(kind)
    one = f"named_struct('kind', '{kind.name}', 'no', {no}, 'm', ms[i], 'start', starts[i] + length(ps[i]), 'end', starts[i] + length(ps[i]) + length(ms[i]), 'before', right(ps[i], {BEFORE}))"
    rows = f"filter(transform(sequence(0, size(ms) - 1), i -> {one}), r -> {_over('r', kind.valid)})"
    inner = f"flatten(zip_with(blocks, slice(firsts, 1, size(blocks)), (b, f) -> transform(b, (z, j) -> f + {TOTAL.format('slice(b, 1, j)')})))"
    rows = _let("starts", inner, rows)
    rows = _let("firsts", f"aggregate(blocks, array(0L), (acc, b) -> array_append(acc, element_at(acc, -1) + {TOTAL.format('b')}))", rows)
    rows = _let("blocks", "transform(sequence(0, int((size(steps) - 1) div 256)), c -> slice(steps, c * 256 + 1, 256))", rows)
    rows = _let("steps", "zip_with(slice(ps, 1, size(ms)), ms, (a, b) -> bigint(length(a) + length(b)))", rows)
    rows = _let("ps", f"split(text, r'{kind.pattern}', -1)", rows)
    none = "cast(array() as array<struct<kind:string,no:int,m:string,start:bigint,end:bigint,before:string>>)"
    rows = _let("ms", f"regexp_extract_all(text, r'{kind.pattern}', 0)", f"case when size(ms) > 0 then {rows} else {none} end")
    return f"case when text is not null and {kind.may} then {rows} else {none} end"


def _judged(array: str) -> str:
    """SQL for the array's matches with votes and buckets, without their text."""
    votes = ", ".join(f"'{n}', {_over('y', sql)}" for n, sql in LABELERS.items())
    buckets = ", ".join(f"'{n}', {_over('y', sql)}" for n, sql in BUCKETS.items())
    worded = f"transform({array}, x -> named_struct('kind', x.kind, 'no', x.no, 'm', x.m, 'start', x.start, 'end', x.end, 'before', x.before, 'worded', x.before rlike r'{WORDS}'))"
    return f"transform({worded}, y -> named_struct('kind', y.kind, 'no', y.no, 'start', y.start, 'end', y.end, 'votes', named_struct({votes}), 'buckets', named_struct({buckets})))"


def spans_expression() -> str:
    """SQL for the struct (base, more) of a ``text``: valid base matches, and other matches clear of these."""
    base, more = (f"concat({', '.join(map(_matches, kinds))})" for kinds in (BASE, MORE))
    clear = "filter(raw, x -> not exists(base, b -> b.start < x.end and x.start < b.end))"
    return _let("base", base, _let("raw", more, f"named_struct('base', {_judged('base')}, 'more', {_judged(clear)})"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (valid base matches) and more (other matches clear of base spans), both with votes and buckets."""
    rows = with_key(docs, ("doc_id", "text")).select("doc_id", F.expr(spans_expression()).alias("spans"))
    return rows.select("doc_id", "spans.base", "spans.more")


@dataclass
class Model:
    """prior and reliability (labeler -> share of right votes) by EM; weights of the final classifier."""

    prior: float = 0.5
    reliability: dict[str, float] = field(default_factory=dict)
    bias: float = -1.0
    weights: dict[tuple[str, object], float] = field(default_factory=dict)

    def accepts(self, x: str) -> str:
        """SQL for the classifier's verdict on the candidate struct x."""
        terms = [f"{self.bias!r}D"]
        for (name, value), w in sorted(self.weights.items(), key=str):
            at = f"{x}.kind = '{value}'" if name == "kind" else f"{x}.{'votes' if name in LABELERS else 'buckets'}.{name} = {value}"
            terms.append(f"case when {at} then {w!r}D else 0D end")
        return f"({' + '.join(terms)}) > 0"


def fit(rows: DataFrame, rounds: int = 60) -> Model:
    """Reliabilities and classifier from the counts of vote and bucket patterns in candidates()."""
    spans = rows.select(F.explode(F.concat("base", "more")).alias("x"))
    counted = spans.groupBy("x.kind", *(F.col(f"x.votes.{n}").alias(n) for n in LABELERS), *(F.col(f"x.buckets.{n}").alias(n) for n in BUCKETS)).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return Model()
    counted.sort(key=lambda r: tuple(map(str, r)))
    total = sum(r["n"] for r in counted)
    model = Model(0.5, dict.fromkeys(LABELERS, 0.75))
    posterior = [0.5] * len(counted)
    for _ in range(rounds):
        for i, r in enumerate(counted):  # expectation
            odds = math.log(model.prior / (1 - model.prior))
            for n in LABELERS:
                odds += r[n] * math.log(model.reliability[n] / (1 - model.reliability[n]))
            posterior[i] = 1 / (1 + math.exp(-odds))
        model.prior = min(0.95, max(0.05, sum(p * r["n"] for p, r in zip(posterior, counted)) / total))
        for n in LABELERS:  # maximisation, with one right and one wrong vote added
            right = sum(r["n"] * (p if r[n] > 0 else 1 - p) for p, r in zip(posterior, counted) if r[n])
            model.reliability[n] = min(0.98, max(0.5, (right + 1) / (sum(r["n"] for r in counted if r[n]) + 2)))
    names = ("kind", *LABELERS, *BUCKETS)
    features = [[(n, r[n]) for n in names if n not in LABELERS or r[n]] for r in counted]
    model.bias, model.weights = 0.0, {f: 0.0 for fs in features for f in fs}
    share = [math.sqrt(r["n"]) for r in counted]  # frequent patterns count more, but don't drown the others
    scale = sum(share)
    for _ in range(200):  # gradient steps on the logistic loss with a small penalty
        slope, down = 0.0, dict.fromkeys(model.weights, 0.0)
        for fs, p, s in zip(features, posterior, share):
            z = model.bias + sum(model.weights[f] for f in fs)
            g = s / scale * (1 / (1 + math.exp(-max(-30, min(30, z)))) - p)
            slope += g
            for f in fs:
                down[f] += g
        model.bias -= 2 * slope
        for f, g in down.items():
            model.weights[f] -= 2 * (g + 1e-4 * model.weights[f])
    return model


def spans_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of base spans, and all spans as ``kind:start:end`` joined by commas."""
    rows = staged(candidates(docs), "pii")
    model = fit(rows)
    say = lambda spans: F.concat_ws(",", F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"]))), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    more = F.expr(f"filter(more, x -> {model.accepts('x')})")
    counts = [_count("base", k.name).alias(f"n_{k.name}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(say(F.col("base")), 256).alias("base_sha256"), say(F.concat("base", more)).alias("spans"))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each base span, and each other span the model accepts, replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, under the name of the first.
    """
    if model is None:
        model = fit(staged(candidates(docs), "pii"))
    accepted = f"array_sort(transform(concat(s.base, filter(s.more, x -> {model.accepts('x')})), x -> named_struct('start', x.start, 'no', x.no, 'end', x.end, 'kind', x.kind)))"
    step = """case when size(acc) > 0 and element_at(acc, -1).end > x.start
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end), 'kind', element_at(acc, -1).kind)))
        else array_append(acc, named_struct('start', x.start, 'end', x.end, 'kind', x.kind)) end"""
    merged = f"aggregate({accepted}, cast(array() as array<struct<start:bigint,end:bigint,kind:string>>), (acc, x) -> {step})"
    part = "concat(substring(text, int(case when i = 0 then 0 else ok[i - 1].end end) + 1, int(ok[i].start - case when i = 0 then 0 else ok[i - 1].end end)), '<', ok[i].kind, '>')"
    joined = f"concat(array_join(transform(sequence(0, size(ok) - 1), i -> {part}), ''), substring(text, int(element_at(ok, -1).end) + 1))"
    text = _let("s", spans_expression(), _let("ok", merged, f"case when size(ok) > 0 then {joined} else text end"))
    return docs.withColumn("text", F.expr(text)).select(*docs.columns)
