"""An embedding run: graph file in; embeddings, their sorted order, the cut report, the sorted adjacency and figures out.

python -m weftgraph --input G --output E --epochs 100 [flags named as the settings], or the positional form of config.POSITIONS.
"""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import POSITIONS, EmbedConfig, parse_args, parse_positions
from weftgraph.operators.graph import symmetrize
from weftgraph.operators.train import embed, reorder_report, sample_metrics
from weftgraph.plans import sizing
from weftgraph.plans.lineage import cut
from weftgraph.sources import edges as ed
from weftgraph.sources import vectors as ve
from weftgraph.sources.matrix_market import read_matrix


def read_graph(spark: SparkSession, config: EmbedConfig) -> DataFrame:
    """src, dst of the input in its format; a CSR file has arcs already."""
    if config.format == "text":
        return ed.read_edge_list(spark, config.input).select("src", "dst")
    if config.format == "binary-edges":
        return ed.read_binary_edges(spark, config.input)
    if config.format == "binary-csr":
        return ed.read_binary_csr(spark, config.input).select("src", "dst")
    coo, _, _ = read_matrix(spark, config.input, whole=False)
    return coo.select(F.col("i").alias("src"), F.col("j").alias("dst"))


def run(spark: SparkSession, config: EmbedConfig) -> dict:
    """Writes <output>, <output>_SORTED, <output>_CUT and <output>_ADJ (each before the extension); returns the run's figures."""
    edges = cut(read_graph(spark, config))
    if config.format == "binary-csr":
        config = replace(config, directed=True)  # the file has arcs already
    emb, report = embed(edges, config)
    n = report["levels"][0]
    write, write_sorted = (ve.write_binary, ve.write_sorted_binary) if config.binary_output else (lambda e, path, n, d: ve.write_text(e, path, d), lambda e, path, n, d: ve.write_sorted_text(e, path, d))
    write(emb, config.output, n, config.dimension)
    write_sorted(emb, ve.stem_path(config.output, "_SORTED"), n, config.dimension)
    # of a CSR file's arcs, which are both ways, each edge counts once
    cut_edges = edges.where("src <= dst") if config.format == "binary-csr" else edges
    cuts = reorder_report(cut_edges, emb).first()
    ve.write_cut(cuts["before"], cuts["after"], config.output)
    ve.write_sorted_adjacency(cut_edges, emb, ve.stem_path(config.output, "_ADJ"))
    arcs = symmetrize(edges, config.directed).select("src", "dst")
    m = arcs.count()
    figures = sample_metrics(emb, arcs, n, config).first().asDict()
    return report | figures | {"before": cuts["before"], "after": cuts["after"], "memory": sizing.memory_report(n, m, config.dimension, config.memory, report["parts"][0])}


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    config = parse_positions(argv) if len(argv) == len(POSITIONS) and not argv[0].startswith("-") else parse_args(argv)
    print(config.describe())
    spark = SparkSession.builder.getOrCreate()
    for name, value in run(spark, config).items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
