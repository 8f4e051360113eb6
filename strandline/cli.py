"""Command line: python -m strandline.cli COMMAND ...

t2d, d2t convert text and typed tables; tconv, dconv, sconv, fqconv copy tables, sequences and reads
between formats; s2sg, fq2sg make sequence graphs; sampload, drawread, prototsv simulate, score and report.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import genotypes, sequences
from .session import session
from .sources import dispatch, tables


def _ploidies(value: str) -> tuple[int, ...]:
    return tuple(int(x.strip()) for x in value.split("/"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("--in", dest="source", default="-")
        c.add_argument("--out", required=True)
        return c

    c = command("t2d", "text table to typed table")
    c.add_argument("--head", action="store_true", help="the first row has names")
    c.add_argument("--sigil", action="store_true", help="names have sigils")
    c = command("d2t", "typed table to text table")
    c.add_argument("--no-head", action="store_true")
    for name in ("tconv", "dconv", "sconv", "fqconv"):
        command(name, "copy between formats")
    c = command("fq2sg", "reads to sequence graphs")
    c.add_argument("--indel", type=float, nargs=6, required=True)
    c = command("s2sg", "sequences to sequence graphs")
    c.add_argument("--chars", default=sequences.BASES)
    c.add_argument("--eq", action="append", default=[])
    c.add_argument("--error", type=float, default=sequences.ERROR)
    c.add_argument("--open", type=float, default=sequences.OPEN)
    c.add_argument("--extend", type=float, default=sequences.EXTEND)
    c.add_argument("--close", type=float, default=sequences.CLOSE)
    c = command("sampload", "simulate amplified samples")
    c.add_argument("--load", type=int, default=10)
    c.add_argument("--alleles", type=int, default=4)
    c.add_argument("--ploidy", type=_ploidies, default=(2, 2))
    c.add_argument("--cycles", type=int, default=0)
    c.add_argument("--fan", type=int, default=32)
    c.add_argument("--error", type=float, default=0.1)
    c.add_argument("--eff", type=float, default=0.9)
    c.add_argument("--maxreact", type=int, default=-1)
    c.add_argument("--seed", type=int, default=1234)
    c = command("drawread", "draw reads of samples and score them against an evaluation set")
    c.add_argument("--eval", required=True)
    c.add_argument("--reads", type=int, default=10, help="logarithm to base two of the most reads")
    c.add_argument("--error", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=1)
    c = command("prototsv", "report of scored reads")
    c.add_argument("--alleles", type=int, help="with --ploidy: the report has every individual")
    c.add_argument("--ploidy", type=_ploidies)
    return p


def run(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(f"strandline {a.command}")
    if a.command == "t2d":
        dispatch.save_data(tables.read_typed(spark, a.source, a.head or a.sigil, a.sigil), a.out)
    elif a.command == "d2t":
        dispatch.save_table(tables.typed_rows(dispatch.open_data(spark, a.source), not a.no_head), a.out)
    elif a.command == "tconv":
        dispatch.save_table(dispatch.open_table(spark, a.source), a.out)
    elif a.command == "dconv":
        dispatch.save_data(dispatch.open_data(spark, a.source), a.out)
    elif a.command == "sconv":
        dispatch.save_sequences(dispatch.open_sequences(spark, a.source), a.out)
    elif a.command == "fqconv":
        dispatch.save_reads(dispatch.open_reads(spark, a.source), a.out)
    elif a.command == "fq2sg":
        dispatch.save_graphs(sequences.reads_to_graphs(dispatch.open_reads(spark, a.source), a.indel), a.out, a.source)
    elif a.command == "s2sg":
        graphs = sequences.sequences_to_graphs(dispatch.open_sequences(spark, a.source), a.chars, a.error, a.eq, a.open, a.extend, a.close)
        dispatch.save_graphs(graphs, a.out, a.source, a.chars)
    elif a.command == "sampload":
        p = genotypes.Parameters(a.alleles, a.load, a.ploidy, a.cycles, a.eff, a.error, a.maxreact, a.fan, a.seed)
        genotypes.simulate(spark, p).write.parquet(a.out)
    elif a.command == "drawread":
        sims, evaluation = spark.read.parquet(a.source), spark.read.parquet(getattr(a, "eval"))
        n = sims.select(F.size("counts")).first()[0]
        draws = genotypes.draw_reads(sims, n, a.error, a.reads, a.seed)
        draws.write.parquet(a.out + "/draws")
        draws = spark.read.parquet(a.out + "/draws")
        genotypes.score_reads(draws, evaluation, n, a.error).write.parquet(a.out + "/scores")
    else:
        draws, scores = spark.read.parquet(a.source + "/draws"), spark.read.parquet(a.source + "/scores")
        n = draws.select(F.size("reads")).first()[0]
        truth = draws.select("draw_id", "load_idx", "class")
        individuals = None
        if a.ploidy:
            classes = genotypes.class_genotypes(genotypes.genotypes(spark, a.alleles or n, a.ploidy), a.ploidy)
            individuals = genotypes.individual_answers(scores, truth, classes)
        out = genotypes.report(genotypes.marginals(scores, truth), draws, n, individuals, len(a.ploidy or ()))
        text = spark.createDataFrame([(out.columns,)], "cells array<string>").unionByName(out.select(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in out.columns)).alias("cells")))
        dispatch.save_table(text, a.out)


if __name__ == "__main__":
    run()
