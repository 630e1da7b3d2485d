"""Command line: python -m tessella.cli COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, **defaults) -> None:
        p = commands.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=o not in defaults, default=defaults.get(o), type=type(defaults[o]) if defaults.get(o) is not None else str)

    add("tab", "input", "output", "remap", remap="")
    add("articles", "input", "output", "stop", stop="")
    add("lexicon", "input", "output", "top", top=25_000)
    add("refilter", "store", "stop", stop="")
    add("unwrap", "store")
    add("synthesize", "store", "output", "total", "seed", seed=42, total=10_000)
    add("count", "input")
    add("vocabulary", "input", "output")
    add("simulate", "store", "documents", "trials", documents=10_000, trials=20)
    add("compact", "input", "output", "drop", drop="original_text,token_type_ids")
    add("neutral", "output", "rows", rows=30_000)
    add("evaluations", "manifest", "labelled", "spans", "output", "label", "text", "key", label="label", text="text", key="doc")
    add("subset", "input", "output", "rows", rows=10_000)
    return top


def main(args: list[str] | None = None) -> None:
    from tessella.functions import generators
    from tessella.operators import capacity, lexicon, pools, reports
    from tessella.plans import evaluate, flows
    from tessella.sources import corpora, stores

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"tessella-{a.command}").getOrCreate()
    words = lambda path: F.array(*(F.lit(r.value.strip()) for r in spark.read.text(path).collect() if r.value.strip())) if path else F.array().cast("array<string>")
    if a.command == "tab":
        rows = corpora.tab_sentences(corpora.tab_separated(spark, a.input), corpora.parse_remaps(a.remap.split(",")) if a.remap else None)
        stores.write_sentences(rows.withColumn("source", F.lit("tatoeba")), a.output, "errorifexists")
    elif a.command == "articles":
        stores.write_sentences(corpora.article_sentences(spark.read.parquet(a.input), words(a.stop)), a.output)
    elif a.command == "lexicon":
        lexicon.lexicon(lexicon.word_counts(stores.read_sentences(spark, a.input)), a.top).write.mode("overwrite").partitionBy("lang").parquet(a.output)
    elif a.command == "refilter":
        print(flows.refilter(spark, a.store, flows.leak_filter(words(a.stop)), f"{a.store.rstrip('/')}.rejected"))
    elif a.command == "unwrap":
        print(flows.refilter(spark, a.store, flows.unwrap))
    elif a.command == "synthesize":
        out = flows.synthetic_data(spark, stores.read_sentences(spark, a.store), a.total, f"{a.output}/examples", a.seed)
        for name in ("ready", "multilabel", "vocabulary"):
            out[name].write.mode("overwrite").parquet(f"{a.output}/{name}")
        print(flows.markdown(out["counts"], "Sentences and tokens"))
    elif a.command == "count":
        print(flows.markdown(reports.count_table(reports.label_counts(spark.read.parquet(a.input))), "Sentences"))
    elif a.command == "vocabulary":
        reports.vocabulary_rollup(spark.read.parquet(a.input)).write.mode("overwrite").partitionBy("level").parquet(a.output)
    elif a.command == "simulate":
        supply = stores.materialized(pools.split_by_hash(stores.read_sentences(spark, a.store)).groupBy("pool", "lang").agg(F.count(F.lit(1)).alias("n")), "supply")
        stats = stores.materialized(capacity.summary(capacity.simulate(supply, a.documents, a.trials), supply), "capacity")
        for title, report in (("Bottlenecks", capacity.bottlenecks), ("Headroom", capacity.most_headroom), ("Presence", capacity.most_present)):
            print(flows.markdown(report(stats), title))
    elif a.command == "compact":
        stores.compacted(spark.read.parquet(a.input), *a.drop.split(",")).write.mode("errorifexists").parquet(a.output)
    elif a.command == "evaluations":
        truth = evaluate.labelled_set(spark.read.parquet(a.labelled), a.label, a.text, a.key)
        for run in evaluate.active(stores.read_json(spark, a.manifest)):
            found = evaluate.evaluated(truth, spark.read.parquet(f"{a.spans}/{run.name}"), run.runner_up)
            evaluate.write_mismatches(found["predictions"], f"{evaluate.output_path(run, a.output)}.mismatches")
            stores.write_json(spark, evaluate.output_path(run, a.output), [r.asDict() for r in found["accuracy"].collect()])  # one row a language
    elif a.command == "subset":
        pools.limited_sample(spark.read.parquet(a.input), a.rows).write.mode("errorifexists").parquet(a.output)
    elif a.command == "neutral":
        for name, df in generators.neutral_pools(spark, None, a.rows, a.rows).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")


if __name__ == "__main__":
    main()
