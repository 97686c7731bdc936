"""Command line: ``python -m quarryline.cli <command> ...``; one command per operator, text in and text or Parquet out."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import itemsets, keystats, kmeans, pagerank, tuning
from .operators.components import connected_components
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, output: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about, description=about)
        c.add_argument("input", help="text file or directory")
        if output:
            c.add_argument("--output", help="directory to write to; without it rows are shown")
        return c

    for name, about in (("eclat", "level-wise itemset mining"), ("twidd", "prefix-tree style itemset mining"), ("pfp", "FP-growth of the ML library")):
        c = command(name, about)
        c.add_argument("--min-support", type=float, default=0.5)
        c.add_argument("--separator", default=r"\s+")
        c.add_argument("--partitions", type=int)
        if name == "eclat":
            c.add_argument("--multiset", action="store_true", help="count repeated items")
            c.add_argument("--max-level", type=int)
        if name == "twidd":
            c.add_argument("--mu", type=int, default=2)
            c.add_argument("--rho", type=int, default=2)
            c.add_argument("--compat-mu-loss", action="store_true")
        if name == "pfp":
            c.add_argument("--strict", action="store_true", help="support above the threshold, as the other miners have it")
    c = command("pagerank", "PageRank of a graph")
    c.add_argument("--kind", choices=("adjacency", "edges", "adjLists"), default="adjacency")
    c.add_argument("--rounds", type=int, default=10)
    c.add_argument("--reset-prob", type=float, default=0.15)
    c.add_argument("--keep-sources", action="store_true")
    c = command("components", "connected components of a graph")
    c.add_argument("--kind", choices=("edges", "adjLists"), default="edges")
    c = command("kmeans", "k-means of labelled points")
    c.add_argument("--k", type=int, default=2)
    c.add_argument("--rounds", type=int, default=20)
    c.add_argument("--init", choices=kmeans.INIT_MODES, default="random")
    c.add_argument("--seed", type=int, default=1)
    c.add_argument("--partitions", type=int)
    c = command("sample", "Bernoulli sample of lines, written beside the input", output=False)
    c.add_argument("--fraction", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=1)
    c = command("key-sort", "count and sort the keys of application/stage/dependency directories")
    c.add_argument("--skip-equal-sizes", action="store_true")
    c = command("key-bytes", "lines and bytes of each key")
    c.add_argument("--key-separator", default="")
    c = command("analyze", "repartitioning report of an event log", output=False)
    c.add_argument("--only-adaptive", action="store_true")
    return p


def _sets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    transactions = readers.read_transactions(spark, a.input, a.separator, a.partitions)
    if a.command == "eclat":
        return itemsets.eclat(transactions, a.min_support, a.multiset, a.max_level)
    if a.command == "twidd":
        return itemsets.twidd(transactions, a.min_support, a.mu, a.rho, a.compat_mu_loss, a.partitions)
    return itemsets.pfp(transactions, a.min_support, a.partitions, a.strict)


def run(spark: SparkSession, arguments: Sequence[str]) -> DataFrame | str:
    """The command's rows (written to ``--output`` if that is given), or its text."""
    a = parser().parse_args(arguments)
    if a.command in ("eclat", "twidd", "pfp"):
        out = _sets(spark, a)
        write = writers.write_itemset_levels if a.command == "eclat" else writers.write_itemsets if a.command == "twidd" else writers.write_itemset_sets
    elif a.command == "pagerank":
        if a.kind == "adjacency":
            out = pagerank.adjacency_pagerank(readers.read_adjacency_edges(spark, a.input), a.rounds, 1 - a.reset_prob, a.keep_sources)
        else:
            out = pagerank.graph_pagerank(readers.read_graph(spark, a.input, a.kind), a.rounds, a.reset_prob)
        write = lambda df, path: df.write.parquet(path)
    elif a.command == "components":
        out = connected_components(readers.read_graph(spark, a.input, a.kind))
        write = lambda df, path: df.write.parquet(path)
    elif a.command == "kmeans":
        out = kmeans.model_frame(kmeans.kmeans(readers.read_points(spark, a.input), a.k, a.rounds, a.init, seed=a.seed, partitions=a.partitions), spark)
        write = lambda df, path: df.write.parquet(path)
    elif a.command == "sample":
        out = keystats.bernoulli_sample(readers.read_lines(spark, a.input), a.fraction, a.seed)
        writers.write_lines(out, writers.sample_path(a.input, a.fraction, a.seed))
        return out
    elif a.command == "key-sort":
        out = keystats.sorted_key_counts(readers.read_key_tree(spark, a.input, a.skip_equal_sizes), by=("app", "stage", "dep"))
        write = writers.write_key_counts
    elif a.command == "key-bytes":
        out = keystats.bytes_per_key(readers.read_key_bytes(spark, a.input, a.key_separator))
        write = writers.write_key_bytes
    else:
        return tuning.plan_text(tuning.plan(tuning.stage_stats(*readers.read_event_log(spark, a.input), a.only_adaptive)))
    if a.output:
        write(out, a.output)
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    import sys

    arguments = sys.argv[1:] if arguments is None else arguments
    parser().parse_args(arguments)  # usage errors before a session starts
    spark = SparkSession.builder.appName("quarryline").getOrCreate()
    out = run(spark, arguments)
    print(out) if isinstance(out, str) else out.show(50, truncate=False)


if __name__ == "__main__":
    main()
