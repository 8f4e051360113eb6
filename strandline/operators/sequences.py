"""Reads and sequences to probability-annotated sequence graphs of one contig."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .suffixes import suffix_array_udf

BASES = "ACGT"
#: Bases that each nucleotide code stands for (fixed values).
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
#: Error, and open, extend and close probabilities of insertions and deletions when none are given (fixed values).
ERROR, OPEN, EXTEND, CLOSE = 0.01, 0.00005, 0.1, 0.00005


def phred_error(c: Column) -> Column:
    """Error probability of one phred character."""
    return F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0)


def iupac_weights(code: Column, error: Column) -> Column:
    """array<double> of weights of A, C, G and T; an unknown code weighs all alike."""
    letter = F.upper(code)
    out = F.array(*[F.lit(0.25)] * 4)
    for name, hot in IUPAC.items():
        if len(hot) < 4:
            share = F.array(*((1 - error) / len(hot) if b in hot else error / (4 - len(hot)) for b in BASES))
            out = F.when(letter == name, share).otherwise(out)
    return out


def substitution_table(chars: str, error: float, equal: Sequence[str] = ()) -> dict[str, list[float]]:
    """Weights by character: its own place has 1 - error, the others share it.

    equal: a character, then those of ``chars`` that it stands for.  Characters not in play are absent and weigh 0.
    """
    if not 0 <= error <= 1:
        raise ValueError("error must lie in [0, 1]")
    n = len(chars)
    table = {c: [1 - error if i == j else error / max(1, n - 1) for j in range(n)] for i, c in enumerate(chars)}
    for group in equal:
        if group:
            hot = group[1:]
            if not hot or set(hot) - set(chars):
                raise ValueError(f"{group!r} names characters that are not in play")
            cold = n - len(hot)
            high, low = ((1 - error) / len(hot), error / cold) if cold else (1 / n, 0.0)
            table[group[0]] = [high if c in hot else low for c in chars]
    return table


def flat_indels(p: Sequence[float]) -> tuple[Column, Column]:
    """The structs of a position's six and of the tail's three probabilities."""
    if len(p) != 6 or any(not 0 <= v <= 1 for v in p):
        raise ValueError("six probabilities are needed: open, extend, close of insertions, then of deletions")
    names = ["ins_open", "ins_ext", "ins_close", "del_open", "del_ext", "del_close"]
    f = [F.lit(float(v)).cast("float").alias(k) for k, v in zip(names, p, strict=True)]
    return F.struct(*f), F.struct(*f[:3])


def _graph(df: DataFrame, weights: Column, indels: tuple[Column, Column], key: str) -> DataFrame:
    """One contig a row: base weights (array by position) and flat indels; link 0 leads to contig 0, which leads to link 1."""
    position, tail = indels
    pos = F.transform(weights, lambda w: F.struct(*(position[n].alias(n) for n in ("ins_open", "ins_ext", "ins_close", "del_open", "del_ext", "del_close")), F.transform(w, lambda x: x.cast("float")).alias("base")))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return df.select(
        F.col(key).alias("graph_id"),
        "name",
        "seq",
        F.lit(b"").alias("extra"),
        F.array(F.struct(F.length("seq").cast("bigint").alias("size"), pos.alias("pos"), tail.alias("tail"))).alias("contigs"),
        F.array(F.struct(zero.alias("contig"), one.alias("link"))).alias("in_links"),
        F.array(F.struct(zero.alias("link"), zero.alias("contig"), F.lit(1.0).cast("float").alias("p"))).alias("out_links"),
        one.alias("num_links"),
        suffix_array_udf("seq").alias("suffix"),
    )


def _letters(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def reads_to_graphs(reads: DataFrame, indels: Sequence[float], key: str = "read_id") -> DataFrame:
    """(read_id, name, seq, qual) to graphs over ACGT with errors from the qualities."""
    qualities = _letters(F.col("qual"))
    weights = F.zip_with(_letters(F.col("seq")), qualities, lambda b, q: iupac_weights(b, phred_error(q)))
    return _graph(reads, weights, flat_indels(indels), key)


def sequences_to_graphs(seqs: DataFrame, chars: str = BASES, error: float = ERROR, equal: Sequence[str] = (), open_p: float = OPEN, extend_p: float = EXTEND, close_p: float = CLOSE, key: str = "seq_id") -> DataFrame:
    """(seq_id, name, seq) to graphs with flat substitutions and indels."""
    table = substitution_table(chars, error, equal)
    cells = [x for c, w in table.items() for x in (F.lit(c), F.array(*map(F.lit, w)))]
    known = F.create_map(*cells)
    none = F.array(*[F.lit(0.0)] * len(chars))
    weights = F.transform(_letters(F.col("seq")), lambda c: F.coalesce(F.try_element_at(known, c), none))
    return _graph(seqs, weights, flat_indels([open_p, extend_p, close_p] * 2), key)


def base_counts(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Total lengths of names and sequences."""
    return df.agg(F.sum(F.length("name")).alias("name_chars"), F.sum(F.length(seq)).alias("bases"), F.count(F.lit(1)).alias("n"))


def graph_faults(graphs: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Graphs that break an invariant, with which: rows of graph_id and fault."""
    off = lambda x, y: F.abs(x - y) > eps
    contig_fault = lambda c: (
        F.when(c["size"] != F.size(c["pos"]), "size")
        .when(F.exists(c["pos"], lambda p: off(F.aggregate(p["base"], F.lit(0.0), lambda a, x: a + x), F.lit(1.0))), "base weights")
        .when(F.exists(c["pos"], lambda p: p["ins_open"] + p["del_open"] > 1 + eps), "open probabilities")
        .when(c["tail"]["ins_open"] >= 1, "tail")
    )
    link = F.when(F.exists("in_links", lambda i: F.exists("out_links", lambda o: (o["contig"] == i["contig"]) & (o["link"] >= i["link"]))), "link order")
    suffix = F.when(F.size("suffix") != F.length("seq"), "suffix array")
    found = graphs.select("graph_id", F.explode(F.array_compact(F.concat(F.transform("contigs", contig_fault), F.array(link, suffix)))).alias("fault"))
    return found.distinct()
