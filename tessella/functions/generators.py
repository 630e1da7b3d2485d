"""Rows of synthetic neutral text: formulas, markup, styles, code, numbers, symbols and gibberish.

A generator is a weighted table of templates with slots. Weights choose a domain, a hash of (seed, row, purpose) chooses
template and fillings, so the same seed gives the same rows however they are partitioned. Everything is column
expressions over spark.range(): no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T

VARIABLES = "x y z t u v n m k p q r".split()
GREEK = r"\alpha \beta \gamma \theta \lambda \mu \phi \omega".split()
NAMES = "count total index value item node user data result buffer queue key cache path size limit offset token state config".split()
VERBS = "get set load save parse build update check merge find".split()

# domain -> (weight, templates); slots: {a}.. numbers, {v}{w} variables, {g} Greek, {f} function, {i}{j} names, {d} verb
MATH = {
    "arithmetic": (15, ["{a} + {b} = {c}", r"{a} \times {b} - {c}", r"\frac{{{a}}}{{{b}}} + {c}", "({a} - {b})({c} + {e})"]),
    "algebra": (15, ["{a}{v}^2 + {b}{v} - {c} = 0", "({v} + {a})({v} - {b})", r"{v} = \frac{{-{b} \pm \sqrt{{{b}^2 - 4 \cdot {a} \cdot {c}}}}}{{2 \cdot {a}}}", "{a}{v} + {b} \\le {c}"]),
    "systems": (5, ["{a}{v} + {b}{w} = {c} \\\\ {b}{v} - {a}{w} = {e}", r"\begin{{cases}} {v} + {w} = {a} \\ {v} - {w} = {b} \end{{cases}}"]),
    "calculus_diff": (12, [r"\frac{{d}}{{d{v}}} {v}^{a} = {a}{v}^{{{b}}}", r"f'({v}) = {a}\{f}({b}{v})", r"\lim_{{{v} \to {a}}} \frac{{{v}^2 - {b}}}{{{v} - {c}}}", r"\frac{{\partial}}{{\partial {v}}} ({a}{v}{w} + {w}^{b})"]),
    "calculus_integ": (10, [r"\int_{{{a}}}^{{{b}}} {v}^{c} \, d{v}", r"\int \{f}({a}{v}) \, d{v}", r"\iint {a}{v}{w} \, d{v} d{w}"]),
    "geometry": (12, ["{v}^2 + {w}^2 = {a}^2", r"A = \pi \cdot {a}^2", r"V = \frac{{{a}}}{{3}} \pi r^{b}", r"\angle A = {a}^\circ"]),
    "trig_identities": (8, [r"\sin^2 {g} + \cos^2 {g} = 1", r"\{f}({a}{g}) = {b}\{f} {g}", r"\tan {g} = \frac{{\sin {g}}}{{\cos {g}}}"]),
    "linear_algebra": (8, [r"\begin{{pmatrix}} {a} & {b} \\ {c} & {e} \end{{pmatrix}}", r"\det(A) = {a} \cdot {b} - {c} \cdot {e}", r"\vec{{{v}}} \cdot \vec{{{w}}} = {a}"]),
    "statistics": (8, [r"\mu = \frac{{1}}{{{a}}} \sum_{{i=1}}^{{{a}}} x_i", r"P(X = {a}) = \binom{{{b}}}{{{a}}} p^{{{a}}}", r"\sigma^2 = {a}.{b}"]),
    "number_theory": (5, [r"{a} \equiv {b} \pmod{{{c}}}", r"\gcd({a}, {b}) = {c}", "{a} = {b} \\cdot {c} + {e}"]),
    "sequences_series": (8, [r"\sum_{{{v}={a}}}^{{{b}}} {v}^{c}", "a_n = {a} + {b}(n - 1)", r"\prod_{{k=1}}^{{{a}}} \left(1 + \frac{{{b}}}{{k}}\right)"]),
    "complex_numbers": (6, ["({a} + {b}i)({c} - {e}i)", r"|{a} + {b}i| = \sqrt{{{a}^2 + {b}^2}}", r"e^{{i {g}}} = \cos {g} + i \sin {g}"]),
    "differential_eqs": (6, [r"\frac{{d{w}}}{{d{v}}} + {a}{w} = {b}{v}", "{w}'' + {a}{w}' + {b}{w} = 0"]),
    "set_theory_logic": (5, [r"A \cup B = \{{{a}, {b}, {c}\}}", r"\forall {v} \in \mathbb{{R}}: {v}^2 \ge 0", r"p \land q \Rightarrow r"]),
}
CODE = {
    "python": (6, ["def {d}_{i}({j}):\n    return {j} + {a}", "for {i} in range({a}):\n    print({i} * {b})", "import {i}\n\n{j} = {i}.{d}({a})", "if {i} > {a}:\n    {j} = {b}\nelse:\n    {j} = {c}"]),
    "js": (6, ["const {i} = ({j}) => {j} + {a};", "function {d}{i}({j}) {{ return {j} * {b}; }}", "for (let {i} = 0; {i} < {a}; {i}++) {{ console.log({i}); }}"]),
    "sql": (4, ["SELECT {i}, COUNT(*) FROM {j} WHERE {i} > {a} GROUP BY {i};", "SELECT a.{i} FROM {j} a LEFT JOIN {i}s b ON a.id = b.id LIMIT {b};", "UPDATE {j} SET {i} = {a} WHERE id = {b};"]),
    "bash": (4, ["for {i} in $(seq 1 {a}); do echo ${i}; done", "grep -n {i} {j}.log | head -{a}", "export {i}={a} && ./{d}.sh"]),
    "go": (3, ["func {d}({i} int) int {{ return {i} + {a} }}", "for {i} := 0; {i} < {a}; {i}++ {{ fmt.Println({i}) }}"]),
    "java": (3, ["public int {d}(int {i}) {{ return {i} * {a}; }}", "List<String> {i} = new ArrayList<>({a});"]),
    "c": (3, ["int {d}(int {i}) {{ return {i} - {a}; }}", '#include <stdio.h>\nint main(void) {{ printf("%d", {a}); return 0; }}', "std::vector<int> {i}({a}, {b});"]),
    "rust": (2, ["fn {d}({i}: i32) -> i32 {{ {i} + {a} }}", "let mut {i}: Vec<u8> = Vec::with_capacity({a});"]),
    "yaml": (1, ["{i}:\n  {j}: {a}\n  enabled: true"]),
    "log": (1, ["[INFO] {d} {i} finished in {a} ms", "2024-01-0{n} ERROR {i}: code {a}"]),
}
HTML = {"html": (1, ['<div class="{i}"><p id="{j}-{a}"></p></div>', '<ul class="{i}"><li></li><li data-{j}="{a}"></li></ul>', '<table><tr><td colspan="{n}"></td></tr></table>', '<a href="/{i}/{a}"><img src="{j}.png" width="{b}"></a>'])}
CSS = {"css": (1, [".{i} {{ margin: {a}px; color: #{h}; }}", "#{i}, .{j} > a {{ padding: {a}px {b}px; font-size: {n}rem; }}", "@media (max-width: {a}px) {{ .{i} {{ display: none; }} }}", ":root {{ --{i}: rgb({a}, {b}, {c}); }}"])}
NUMERIC = {"float_row": (1, ["{a}.{b} {c}.{e} {b}.{c}"]), "money": (1, ["$ {a},{t}", "€ {a}.{n}0", "¥ {a}"]), "csv_row": (1, ["{a},{b},{c},{e}"]), "table_row": (1, ["| {a} | {b} | {c} |"]), "table_block": (1, ["| {a} | {b} |\n|---|---|\n| {c} | {e} |"])}
SYMBOLS = "★ ☆ ♥ ♦ ✓ ✗ → ← ↑ ↓ § ¶ † ‡ • … # @ % & * + = ~ ^ | / \\ 😀 🎉 🔥 🚀".split()


def _hash(seed: int, name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(name)), F.lit(1 << 31))


def _of(choices: list[str], seed: int, name: str) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (_hash(seed, name) % len(choices)).cast("int") + 1)


def templated(spark: SparkSession, n: int, table: dict[str, tuple[int, list[str]]], seed: int = 0) -> DataFrame:
    """n rows of (id, domain, text) from a table of templates."""
    total = sum(weight for weight, _ in table.values())
    draw, upto, domain = _hash(seed, "domain") % total, 0, F.lit(None).cast("string")
    steps = []
    for name, (weight, templates) in table.items():
        upto += weight
        steps.append((upto, name, templates))
    text = F.lit(None).cast("string")
    for limit, name, templates in reversed(steps):
        domain = F.when(draw < limit, F.lit(name)).otherwise(domain)
        text = F.when(draw < limit, _of(templates, seed, "template")).otherwise(text)
    rows = spark.range(n).select("id", domain.alias("domain"), text.alias("text"))
    fill = {c: (1 + _hash(seed, c) % 99).cast("string") for c in "abce"} | {"n": (1 + _hash(seed, "n") % 9).cast("string"), "t": (100 + _hash(seed, "t") % 900).cast("string"), "h": F.lower(F.lpad(F.hex(_hash(seed, "h") % (1 << 24)), 6, "0"))}
    fill |= {"v": _of(VARIABLES[:6], seed, "v"), "w": _of(VARIABLES[6:], seed, "w"), "g": _of(GREEK, seed, "g"), "f": _of(["sin", "cos", "tan", "ln", "exp"], seed, "f")}
    fill |= {"i": _of(NAMES[:10], seed, "i"), "j": _of(NAMES[10:], seed, "j"), "d": _of(VERBS, seed, "d")}
    out = F.col("text")
    for slot, value in fill.items():
        out = F.replace(out, F.lit("{" + slot + "}"), value)
    return rows.select("id", "domain", F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")).alias("text"))


def math_expressions(spark: SparkSession, n: int, seed: int = 0, domain: str | None = None) -> DataFrame:
    """Formulas of 14 weighted domains, or of one."""
    if domain is not None and domain not in MATH:
        raise ValueError(f"unknown domain: {domain}")
    return templated(spark, n, MATH if domain is None else {domain: MATH[domain]}, seed)


def code_snippets(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return templated(spark, n, CODE, seed)


def symbol_noise(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """3 to 20 signs a row."""
    size = (3 + _hash(seed, "size") % 18).cast("int")
    signs = F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(SYMBOLS)))).cast("int") + 1))
    return spark.range(n).select("id", F.lit("symbol").alias("domain"), F.array_join(signs, " ").alias("text"))


def gibberish(sentences: DataFrame, n: int, seed: int = 0, column: str = "sentence") -> DataFrame:
    """English-looking nonsense: n sentences, least hash first, with letters moved by thirteen."""
    order = F.xxhash64(F.lit(seed), F.col(column))
    return sentences.orderBy(order, column).limit(n).select(F.lit("gibberish").alias("domain"), T.rot13(column).alias("text"))


def neutral_pools(spark: SparkSession, sentences: DataFrame | None = None, math: int = 50_000, others: int = 30_000, seed: int = 0, formulas: DataFrame | None = None) -> dict[str, DataFrame]:
    """The neutral pools by name; gibberish is made of sentences, formulas are those of a corpus, where there are any."""
    out = {"math": math_expressions(spark, math, seed), "html": templated(spark, others, HTML, seed), "css": templated(spark, others, CSS, seed), "code": code_snippets(spark, others, seed), "symbol": symbol_noise(spark, others, seed), "numeric": templated(spark, others, NUMERIC, seed)}
    if formulas is not None:
        out["formulas"] = formulas.select(F.lit("formulas").alias("domain"), F.col("formula").alias("text"))
    return out | ({"gibberish": gibberish(sentences, others, seed)} if sentences is not None else {})


# fixed values: shares of the pools in spans without language
SPAN_SHARES = {"formulas": 0.24, "math": 0.18, "numeric": 0.12, "html": 0.07, "css": 0.08, "code": 0.08, "symbol": 0.08, "gibberish": 0.15}


def span_pool(key: Column) -> Column:
    """The pool that a span is drawn from, by inverse cumulative shares."""
    u, upto, out = T.uniform(key), 0.0, None
    for name, share in SPAN_SHARES.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise("gibberish")
