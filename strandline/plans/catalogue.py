"""One query per operator over the driver's tables, with the same result as DuckDB SQL.

Conventions: every computed column is named; doubles are rounded well above the noise of summation; minus infinity and NaN never
leave a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import crypto, prob, scalar, text
from ..operators import aggregates, genotypes, linalg, lookup, optim, patterns, rows, sequences, suffixes, typed
from ..schema import ColumnKind, to_struct
from ..session import shared_path, table
from ..sources import binary, reads, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- typed text tables


@query("""
SELECT c_mktsegment, count(*) AS n, count(c_custkey) AS n_key, count(c_name) AS n_name, round(sum(c_acctbal), 2) AS total_acctbal
FROM customer GROUP BY c_mktsegment
""")
def tsv_roundtrip_typed(spark, sf_dir):
    """Customers as escaped text rows, read back by sigils, grouped by segment."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    kinds = [ColumnKind("c_custkey", "int"), ColumnKind("c_name", "str", length=64), ColumnKind("c_acctbal", "real"), ColumnKind("c_mktsegment", "cat", {s: i for i, s in enumerate(segments)})]
    cells = [F.coalesce(F.col(k.name).cast("string"), F.lit("")) for k in kinds]
    lines = table(spark, sf_dir, "customer").select(F.array_join(F.array(*map(text.escape, cells)), "\t").alias("value"))
    back = lines.select(F.transform(F.split("value", "\t", -1), lambda c: text.unescape(text.trim_escaped(c))).alias("cells"))
    data = typed.to_typed(rows.drop_empty(back), kinds)
    return data.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_key"), F.count("c_name").alias("n_name"), F.round(F.sum("c_acctbal"), 2).alias("total_acctbal"))


@query("""
SELECT lang, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE line <> '' GROUP BY lang
""")
def filter_nonempty_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.transform(F.split("text", "\n", -1), lambda x: F.array(x))).alias("cells"))
    kept = rows.drop_empty(lines).select("lang", F.get("cells", F.lit(0)).alias("line"))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("""
SELECT o_orderpriority, count(*) AS n, sum(code)::BIGINT AS codes FROM (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders)
GROUP BY o_orderpriority
""")
def factor_encode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    coded = lookup.encode_factor(orders.select("o_orderpriority"), "o_orderpriority", lookup.levels(orders, "o_orderpriority"))
    return coded.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"))


@query("""
SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag
""")
def factor_decode(spark, sf_dir):
    """To codes and back, with an error for an unknown code."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag")
    dim = lookup.levels(items, "l_returnflag")
    coded = lookup.encode_factor(items, "l_returnflag", dim).select("code")
    return lookup.decode_factor(coded, "code", dim, "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT column_name, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, count(*) AS n_rows FROM (
  SELECT 'o_orderkey' AS column_name, CASE WHEN regexp_full_match(CAST(o_orderkey AS VARCHAR), '[-+0-9]+') THEN 'x' END AS v FROM orders
  UNION ALL SELECT 'o_orderstatus', CASE WHEN o_orderstatus IN ('F', 'O') THEN 'x' END FROM orders
  UNION ALL SELECT 'o_orderpriority', CASE WHEN regexp_full_match(o_orderpriority, '[-+0-9]+') THEN 'x' END FROM orders)
GROUP BY column_name
""")
def na_counts(spark, sf_dir):
    """Cells that don't fit their kind are missing."""
    cells = table(spark, sf_dir, "orders").select(F.array(*(F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("cells"))
    kinds = [ColumnKind("o_orderkey", "int"), ColumnKind("o_orderstatus", "cat", {"F": 0, "O": 1}), ColumnKind("o_orderpriority", "int")]
    return typed.missing_counts(typed.to_typed(cells, kinds), [k.name for k in kinds])


@query("""
SELECT p_partkey, CASE WHEN length(p_type) BETWEEN 1 AND 12 THEN p_type END AS short_type FROM part
""")
def fixed_string(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.fixed_string(F.col("p_type"), 12).alias("short_type"))


@query("""
SELECT s_suppkey, s_suppkey::VARCHAR AS key_text, printf('%e', round(s_acctbal, 2)) AS balance_text, coalesce(s_name, '') AS name_text FROM supplier
""")
def render_cells(spark, sf_dir):
    """Typed values as text: integers, reals with six digits of mantissa, missing as empty."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("b"), "s_name")
    return t.select("s_suppkey", typed.cell_text(F.col("s_suppkey"), "int").alias("key_text"), typed.cell_text(F.col("b"), "real").alias("balance_text"), typed.cell_text(F.col("s_name"), "str").alias("name_text"))


# ---- order, ranges, bounds


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 10
""")
def sort_limit_range(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.page(items, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 50, 10)


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000
""")
def row_range(spark, sf_dir):
    return rows.row_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, 2000, "o_orderkey")


@query("""
SELECT probe, count(*) FILTER (o_totalprice < probe) AS lower_bound, count(*) FILTER (o_totalprice <= probe) AS upper_bound
FROM orders, (VALUES (1000.0::DOUBLE), (100000.0::DOUBLE), (250000.0::DOUBLE)) v(probe) GROUP BY probe
""")
def bounds(spark, sf_dir):
    return rows.bounds(table(spark, sf_dir, "orders"), F.col("o_totalprice"), [1000.0, 100000.0, 250000.0])


@query("""
SELECT name, balance, row_number() OVER (ORDER BY balance, name) - 1 AS place FROM (SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier)
""")
def merge_sorted(spark, sf_dir):
    """Both tables merged; the place of each row comes from the order in which the merged rows stand."""
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return rows.numbered(rows.merge_sorted(a, b, ["balance", "name"]), "place")


@query("""
WITH o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders)
SELECT k, x AS price, (SELECT count(*) FROM orders WHERE o_totalprice < x) AS below, (SELECT count(*) FROM orders WHERE o_totalprice <= x) AS upto
FROM o, range(1, 8) q(k) WHERE r = (n * k + 7) // 8
""")
def quantiles(spark, sf_dir):
    """Prices that part the sorted orders into eight, exactly, with the places where equal prices begin and end."""
    found = rows.split_places(table(spark, sf_dir, "orders"), "o_totalprice", 8)
    return spark.createDataFrame([(k, float(x), below, upto) for k, (x, below, upto) in enumerate(found, 1)], "k long, price double, below long, upto long")


@query("""
WITH l AS (SELECT l_quantity AS x, row_number() OVER (ORDER BY l_quantity) AS r, count(*) OVER () AS n FROM lineitem)
SELECT k, x AS quantity, (SELECT count(*) FROM lineitem WHERE l_quantity < x) AS below, (SELECT count(*) FROM lineitem WHERE l_quantity <= x) AS upto
FROM l, range(1, 16) q(k) WHERE r = (n * k + 15) // 16
""")
def quantiles_of_ties(spark, sf_dir):
    """The same over lines, of whose quantities each is that of a fiftieth of all rows."""
    found = rows.split_places(table(spark, sf_dir, "lineitem"), "l_quantity", 16)
    return spark.createDataFrame([(k, float(x), below, upto) for k, (x, below, upto) in enumerate(found, 1)], "k long, quantity double, below long, upto long")


# ---- text


@query("""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token
""")
def tokenize_count(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(text.split_all(F.col("text"), " ")).alias("token"))
    return tokens.filter("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT page_id, CASE WHEN contains(html, 'di') OR contains(html, 'd>') THEN CASE WHEN instr(html, 'di') > 0 AND (instr(html, 'd>') = 0 OR instr(html, 'di') < instr(html, 'd>')) THEN 'di' ELSE 'd>' END END AS found FROM pages
""")
def regex_alternatives(spark, sf_dir):
    """The leftmost, shortest of alternatives, of which a later one begins an earlier one."""
    node = (patterns.literal("div") | patterns.literal("di")) | patterns.literal("d>")
    return table(spark, sf_dir, "pages").select("page_id", patterns.first_match(F.col("html"), node).alias("found"))


@query(r"""
SELECT page_id, nullif(regexp_extract(html, '<[a-z]+>', 0), '') AS first_tag FROM pages
""")
def regex_find_first(spark, sf_dir):
    """The first plain opening tag of a page: leftmost, shortest."""
    letters = patterns.charset("abcdefghijklmnopqrstuvwxyz")
    node = patterns.literal("<") + letters + letters.star() + patterns.literal(">")
    return table(spark, sf_dir, "pages").select("page_id", patterns.first_match(F.col("html"), node).alias("first_tag"))


@query(r"""
WITH runs AS (SELECT item_id, length(r) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-z]+')) AS r FROM benchmark))
SELECT item_id, coalesce(max(n), -1)::INTEGER AS longest FROM benchmark LEFT JOIN runs USING (item_id) GROUP BY item_id
""")
def regex_longest(spark, sf_dir):
    """Length of the longest run of lower-case letters anywhere in an item."""
    letters = patterns.charset("abcdefghijklmnopqrstuvwxyz")
    find = patterns.find_long_udf(letters + letters.star())
    return table(spark, sf_dir, "benchmark").select("item_id", find("text")["length"].alias("longest"))


@query(r"""
SELECT kind, t AS token, count(*) AS n FROM (SELECT t, CASE WHEN regexp_full_match(t, '[A-Z]+') THEN 0 WHEN regexp_full_match(t, '[0-9]+') THEN 1 ELSE 2 END AS kind
FROM (SELECT unnest(regexp_extract_all(o_orderpriority, '[A-Z]+|[0-9]+|[ .,:;-]')) AS t FROM orders)) GROUP BY ALL
""")
def regex_tokens(spark, sf_dir):
    """Maximal-munch tokens of a priority: words, numbers, other characters."""
    udf = patterns.tokenize_udf(*_token_kinds())
    found = table(spark, sf_dir, "orders").select(F.explode(udf("o_orderpriority")).alias("t")).select(F.element_at("t.types", 1).alias("kind"), "t.text")
    return found.groupBy("kind", F.col("text").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def _token_kinds():
    word, digit = patterns.charset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), patterns.charset("0123456789")
    return word + word.star(), digit + digit.star(), patterns.charset(" -.,:;")


@query(r"""
SELECT place, token, rest, count(*) AS n FROM (SELECT unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place, rest
FROM (SELECT regexp_extract_all(regexp_extract(said, '^(?:[A-Z]+|[0-9]+|[ .,:;-])*', 0), '[A-Z]+|[0-9]+|[ .,:;-]') AS w, regexp_replace(said, '^(?:[A-Z]+|[0-9]+|[ .,:;-])*', '') AS rest
FROM (SELECT upper(replace(s_name, '#', ' ')) || '/' || CAST(s_nationkey AS VARCHAR) AS said FROM supplier))) GROUP BY ALL
""")
def token_table(spark, sf_dir):
    """A tokenizer as a table function beside each row: the tokens with their places, and what no token fits."""
    patterns.register_tokenizer(spark, "name_tokens", *_token_kinds())
    source = table(spark, sf_dir, "supplier").select(F.concat_ws("/", F.upper(F.replace("s_name", F.lit("#"), F.lit(" "))), F.col("s_nationkey").cast("string")).alias("said"))
    found = spark.sql("SELECT t.place, t.token, t.rest FROM {suppliers} s, LATERAL name_tokens(s.said) t", suppliers=source)
    return found.groupBy("place", "token", "rest").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS n_th FROM documents
""")
def substring_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences(F.col("text"), "th").cast("bigint").alias("n_th"))


@query("""
SELECT item_id, r::BIGINT - 1 AS rank, pos FROM (
  SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY substr(t, pos::INTEGER + 1)) AS r
  FROM (SELECT item_id, t, unnest(range(0, length(t))) AS pos FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)))
""")
def suffix_array(spark, sf_dir):
    """Suffix arrays of the whole ASCII text of an item."""
    return suffixes.ranked_suffixes(table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t")), "item_id", "t")


@query("""
WITH j AS (SELECT string_agg(coalesce(text, '') || chr(10), '' ORDER BY item_id) AS t FROM benchmark)
SELECT row_number() OVER (ORDER BY substr(t, pos::INTEGER + 1)) - 1 AS rank, pos FROM (SELECT t, unnest(range(0, length(t))) AS pos FROM j)
""")
def suffix_array_joined(spark, sf_dir):
    """One suffix array over all items joined into one text, by joins and sorts."""
    return suffixes.suffix_array_of(suffixes.joined_codes(table(spark, sf_dir, "benchmark"), "item_id", "text"))


@query("""
SELECT item_id, count(*) FILTER (substr(t, pos::INTEGER + 1) < 'th' ) AS lower_end,
       count(*) FILTER (substr(t, pos::INTEGER + 1, 2) = 'th') AS hits
FROM (SELECT item_id, t, unnest(range(0, length(t))) AS pos FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)) GROUP BY item_id
""")
def suffix_search(spark, sf_dir):
    """The run of suffixes that begin with a pattern, in the suffix array of the whole ASCII text."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t")).select("item_id", "t", suffixes.suffix_array_udf("t").alias("sa"))
    found = t.select("item_id", suffixes.interval(F.col("sa"), F.col("t"), "th").alias("r"))
    return found.select("item_id", F.col("r.from").cast("bigint").alias("lower_end"), (F.col("r.to") - F.col("r.from")).cast("bigint").alias("hits"))


@query("""
SELECT doc_id, sha256(text) AS digest FROM documents
""")
def sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", crypto.sha256(F.col("text")).alias("digest"))


@query("""
SELECT doc_id, text FROM documents
""")
def encrypt_roundtrip(spark, sf_dir):
    """Every text encrypted by block and decrypted again."""
    key = F.lit(bytes(range(32)))
    sealed = table(spark, sf_dir, "documents").select("doc_id", crypto.encrypt_block(F.col("text"), key).alias("sealed"))
    return sealed.select("doc_id", crypto.decrypt_block(F.col("sealed"), key).cast("string").alias("text"))


@query("SELECT '8ea2b7ca516745bfeafc49904b496089' AS block, '601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c5' AS counter, 'f443e3ca4d62b59aca84e990cacaf5c5' AS from_second")
def cipher_vectors(spark, sf_dir):
    """Published test vectors of AES-256: one block, two blocks in counter mode, and the second of them by seeking."""
    key = F.lit(bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    nonce, first = 0xF0F1F2F3F4F5F6F7, 0xF8F9FAFBFCFDFEFF - (1 << 64)
    low = lambda c: F.lower(F.hex(c))
    block = crypto.encrypt_block(F.lit(bytes.fromhex("00112233445566778899aabbccddeeff")), F.lit(bytes(range(32))))
    counter = lambda data, at: low(crypto.counter_mode(F.lit(data), key, nonce, F.lit(at)))
    return spark.range(1).select(F.substring(low(block), 1, 32).alias("block"), counter(plain, first).alias("counter"), counter(plain[16:], first + 1).alias("from_second"))


@query("SELECT item_id, text FROM benchmark")
def counter_mode_roundtrip(spark, sf_dir):
    """Every item encrypted and decrypted in counter mode."""
    key = F.lit(bytes(range(32)))
    sealed = table(spark, sf_dir, "benchmark").select("item_id", crypto.counter_mode(F.col("text"), key, 5).alias("sealed"))
    return sealed.select("item_id", crypto.counter_mode(F.col("sealed"), key, 5).cast("string").alias("text"))


@query("""
SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || '.T') AS trimmed, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends,
       length(regexp_extract(text, '^[A-Za-z]*', 0)) AS letters, strpos(text, 'and') - 1 AS first_and,
       CASE WHEN strpos(text, '. ') > 0 THEN left(text, strpos(text, '. ') - 1) ELSE text END AS head FROM documents
""")
def text_spans(spark, sf_dir):
    c = F.col("text")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.trim(c, text.BLANKS + ".T").alias("trimmed"), c.startswith("The").alias("starts"), c.endswith(".").alias("ends"),
        text.span(c, letters).cast("bigint").alias("letters"), text.find(c, "and").cast("bigint").alias("first_and"), text.split_first(c, ". ")["head"].alias("head"),
    )


@query(r"""
SELECT p_partkey, try_cast(CASE WHEN regexp_full_match(split_part(p_brand, '#', 2), '[-+]?[0-9]+') THEN split_part(p_brand, '#', 2) END AS BIGINT) AS brand_number,
       p_retailprice AS price FROM part
""")
def parse_numbers(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    number = text.split_first(F.col("p_brand"), "#")["tail"]
    return t.select("p_partkey", text.parse_int(F.coalesce(number, F.lit(""))).alias("brand_number"), text.parse_float(F.col("p_retailprice").cast("string")).alias("price"))


# ---- log space


@query("""
WITH v AS (SELECT l_returnflag, -l_extendedprice / 1e4 AS x FROM lineitem), m AS (SELECT l_returnflag, max(x) AS m FROM v GROUP BY 1)
SELECT l_returnflag, round(any_value(m) + ln(sum(exp(x - m))), 6) AS lse FROM v JOIN m USING (l_returnflag) GROUP BY l_returnflag
""")
def lse_by_group(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_returnflag", (-F.col("l_extendedprice") / 1e4).alias("x"))
    return prob.log_sum_exp(v, ["l_returnflag"], "x").select("l_returnflag", F.round("lse", 6).alias("lse"))


@query("""
SELECT event_type, round(ln(avg(exp(value / 100))), 6) AS log_mean FROM events WHERE value IS NOT NULL GROUP BY event_type
""")
def log_mean_exp(spark, sf_dir):
    v = table(spark, sf_dir, "events").filter("value is not null").select("event_type", (F.col("value") / 100).alias("x"))
    return aggregates.log_mean_exp(v, ["event_type"], "x").select("event_type", F.round("log_mean", 6).alias("log_mean"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (k = 1) AS best_id, max(o_totalprice) FILTER (k = 1) AS best_score,
       max(o_orderkey) FILTER (k = 2) AS second_id, max(o_totalprice) FILTER (k = 2) AS second_score FROM r GROUP BY o_custkey
""")
def winner_and_runner_up(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return aggregates.best_two(orders, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""
SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS right_price,
       (SELECT min(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderstatus <> 'F' AND o2.o_totalprice =
         (SELECT max(o_totalprice) FROM orders o3 WHERE o3.o_custkey = o.o_custkey AND o3.o_orderstatus <> 'F')) AS wrong_key
FROM orders o GROUP BY o_custkey
""")
def right_and_wrong(spark, sf_dir):
    """The best right answer (a finished order) and the best wrong one, lowest key first."""
    w = aggregates.winners(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.col("o_orderkey"))
    return w.select("o_custkey", F.when(F.col("right_score") > prob.NEG_INF, F.col("right_score")).alias("right_price"), F.when(F.col("wrong_index") >= 0, F.col("wrong_index")).alias("wrong_key"))


@query("""
WITH j AS (SELECT l_returnflag, l_linestatus, ln(sum(l_quantity)) - ln((SELECT sum(l_quantity) FROM lineitem)) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(p, 6) AS ln_joint, round(ln(sum(exp(p)) OVER (PARTITION BY l_returnflag)), 6) AS ln_flag,
       round(ln(sum(exp(p)) OVER (PARTITION BY l_linestatus)), 6) AS ln_status, round(p - ln(sum(exp(p)) OVER (PARTITION BY l_linestatus)), 6) AS ln_flag_given_status FROM j
""")
def joint_and_marginals(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(prob.log_of(F.sum("l_quantity")).alias("w"))
    total = prob.log_sum_exp(cells, [], "w", "total")
    joint = cells.crossJoin(F.broadcast(total)).select("l_returnflag", "l_linestatus", (F.col("w") - F.col("total")).alias("p"))  # total: one row
    flag, status = prob.log_sum_exp(joint, ["l_returnflag"], "p", "pf"), prob.log_sum_exp(joint, ["l_linestatus"], "p", "ps")
    out = joint.join(flag, "l_returnflag").join(status, "l_linestatus")
    return out.select("l_returnflag", "l_linestatus", F.round("p", 6).alias("ln_joint"), F.round("pf", 6).alias("ln_flag"), F.round("ps", 6).alias("ln_status"), F.round(F.col("p") - F.col("ps"), 6).alias("ln_flag_given_status"))


@query("""
SELECT o_orderpriority, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
""")
def proportions(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n"))).alias("c"))  # one entry a priority
    shares = packed.select("c", aggregates.proportions(F.transform("c", lambda x: x["n"])).alias("s"))
    return shares.select(F.explode(F.arrays_zip("c", "s")).alias("x")).select("x.c.o_orderpriority", "x.c.n", F.round("x.s", 9).alias("share"))


@query("""
WITH p AS (SELECT l_orderkey, list_sort(list(l_partkey % 10)) AS canon FROM lineitem GROUP BY l_orderkey)
SELECT array_to_string(canon, '/') AS parts, count(*) AS n FROM p GROUP BY ALL
""")
def canonical_multisets(spark, sf_dir):
    """The multiset of all parts of an order, as a class of its own."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 10).alias("parts"))
    canon = aggregates.canonical_multiset(F.col("parts"))
    return found.select(F.array_join(F.transform(canon, lambda x: x.cast("string")), "/").alias("parts")).groupBy("parts").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, a AS allele, coalesce(sum(l_linenumber) FILTER (l_partkey % 4 = a), 0)::BIGINT AS load FROM lineitem, range(0, 4) r(a) GROUP BY ALL
""")
def allele_loading(spark, sf_dir):
    """Loads (line numbers) summed by allele (a part's remainder) over all lines of an order, whatever their number; an allele that none has is 0."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("allele"), "l_linenumber")
    return aggregates.loading_by_allele(t, ["l_orderkey"], "allele", "l_linenumber", 4)


@query("""
SELECT n_nationkey, r_regionkey, (n_nationkey * 10 + r_regionkey)::BIGINT AS score FROM nation, region
""")
def crossproduct_score(spark, sf_dir):
    both = lookup.cross(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey"))
    return both.select("n_nationkey", "r_regionkey", (F.col("n_nationkey") * 10 + F.col("r_regionkey")).cast("bigint").alias("score"))


@query("""
SELECT c_custkey, coalesce(s_name, '') AS supplier FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def lookup_left(spark, sf_dir):
    """Codes to names; a code without a name (there are fewer suppliers than customers) gives an empty text."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return lookup.lookup(table(spark, sf_dir, "customer").select("c_custkey"), names, "c_custkey").select("c_custkey", F.coalesce("s_name", F.lit("")).alias("supplier"))


@query("""
WITH e AS (SELECT vec_id, i, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT a.i AS row_no, b.i AS col_no, round(sum(a.v::DOUBLE * b.v::DOUBLE), 4) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2
""")
def gram_matrix(spark, sf_dir):
    """The product of the transposed vectors with themselves, all rows and columns."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", (F.col("k") + 1).cast("bigint").alias("k"), F.col("x").cast("double").alias("v"))
    a, b = cells.select(F.col("k").alias("i"), F.col("vec_id").alias("j"), "v"), cells.select(F.col("vec_id").alias("i"), F.col("k").alias("j"), "v")
    return lookup.multiply(a, b).select(F.col("i").alias("row_no"), F.col("j").alias("col_no"), F.round("v", 4).alias("v"))


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings
""")
def vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(aggregates.norm(F.transform("embedding", lambda x: x.cast("double"))), 5).alias("norm"))


@query("""
SELECT l_orderkey, l_linenumber, round(-0.5 * (4.0 / 3.0 * (x * x - x * y + y * y)) - ln(2 * pi()) - 0.5 * ln(0.75), 6) AS log_pdf
FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS x, (l_tax - 0.04) / 0.02 AS y FROM lineitem)
""")
def gaussian_logpdf(spark, sf_dir):
    g = prob.Gaussian([0.0, 0.0], [[1.0, 0.5], [0.5, 1.0]])
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.round(g.log_pdf((F.col("l_quantity") - 25) / 10, (F.col("l_tax") - 0.04) / 0.02), 6).alias("log_pdf"))


@query("""
WITH t AS (SELECT event_id, ln(0.25) - 0.5 * power(value / 10, 2) - ln(10 * sqrt(2 * pi())) AS a, ln(0.75) - 0.5 * power((value - 50) / 40, 2) - ln(40 * sqrt(2 * pi())) AS b FROM events WHERE value IS NOT NULL)
SELECT event_id, round(greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))), 6) AS log_pdf FROM t
""")
def mixture_logpdf(spark, sf_dir):
    """Every event with a value, the far tails too."""
    m = prob.Mixture()
    m.add(prob.Gaussian([0.0], [[100.0]]))
    m.add(prob.Gaussian([50.0], [[1600.0]]))
    m.set_weights([0.25, 0.75])
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", F.round(m.log_pdf(F.col("value")), 6).alias("log_pdf"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 AND l_quantity < 30 AND l_discount >= 0.02 AND l_discount < 0.07 THEN round(-ln(20) - ln(0.05), 6) END AS log_pdf FROM lineitem
""")
def uniform_logpdf(spark, sf_dir):
    u = prob.Uniform([10.0, 0.02], [30.0, 0.07])
    p = u.log_pdf(F.col("l_quantity"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(p > prob.NEG_INF, F.round(p, 6)).alias("log_pdf"))


@query("""
SELECT p_partkey, round(exp(x) - 1, 6) AS em1, round(ln(1 + x), 6) AS l1p, round(ln(1 - exp(-x)), 6) AS l1me FROM (SELECT p_partkey, p_retailprice / 1000 AS x FROM part)
""")
def special_functions(spark, sf_dir):
    x = F.col("p_retailprice") / 1000
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.expm1(x), 6).alias("em1"), F.round(F.log1p(x), 6).alias("l1p"), F.round(prob.log_one_minus_exp(-x), 6).alias("l1me"))


@query("SELECT p_partkey, round(lgamma(p_size + 0.5), 6) AS log_gamma, round(ln(pi() / abs(sin(pi() * (p_size + 0.25)))) - lgamma(p_size + 1.25), 6) AS of_negative FROM part")
def lgamma_col(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(prob.log_gamma(F.col("p_size") + 0.5), 6).alias("log_gamma"), F.round(prob.log_gamma(-F.col("p_size") - 0.25), 6).alias("of_negative"))


@query("""
SELECT p_partkey, round(sign(x) * (2 / sqrt(pi())) * list_sum(list_transform(range(0, 60), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END
       * exp((2 * n + 1) * ln(abs(x)) - lgamma(n + 1)) / (2 * n + 1))), 6) AS erf FROM (SELECT p_partkey, p_size / 25.0 - 1.02 AS x FROM part)
""")
def erf_col(spark, sf_dir):
    """The error function; the SQL sums its power series."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(prob.erf(F.col("p_size") / 25.0 - 1.02), 6).alias("erf"))


@query("SELECT p_partkey, round(p_size / 51.0 - 0.5, 6) AS x FROM part")
def erf_inverse_col(spark, sf_dir):
    """The error function of its inverse is the argument."""
    x = F.col("p_size") / 51.0 - 0.5
    return table(spark, sf_dir, "part").select("p_partkey", F.round(prob.erf(prob.erf_inverse(x)), 6).alias("x"))


# ---- sequences


@query("""
SELECT item_id, pos - 1 AS pos, round(power(10, -(ascii(text[pos:pos]) - 33) / 10.0), 9) AS error FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS pos FROM benchmark)
""")
def phred_error(spark, sf_dir):
    """Every character of every item as a quality."""
    at = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "c")).filter("c <> ''")
    return at.select("item_id", F.col("pos").cast("bigint").alias("pos"), F.round(sequences.phred_error(F.col("c")), 9).alias("error"))


_IUPAC = ", ".join(f"('{k}', '{v}')" for k, v in sequences.IUPAC.items())


@query(f"""
WITH t AS (SELECT item_id, pos - 1 AS pos, upper(text[pos:pos]) AS code, power(10, -(ascii(text[pos:pos]) - 33) / 10.0) AS e FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS pos FROM benchmark)), i AS (SELECT * FROM (VALUES {_IUPAC}) v(code, hot))
SELECT item_id, pos, {", ".join(f"round(CASE WHEN hot IS NULL OR length(hot) = 4 THEN 0.25 WHEN contains(hot, '{b}') THEN (1 - e) / length(hot) ELSE e / (4 - length(hot)) END, 4) AS w_{b.lower()}" for b in "ACGT")}
FROM t LEFT JOIN i USING (code)
""")
def reads_to_graphs(spark, sf_dir):
    """Base weights at every position of items as reads to graphs, whose qualities are their own characters."""
    reads_ = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), F.lit("x").alias("name"), F.col("text").alias("seq"), F.col("text").alias("qual"))
    g = sequences.reads_to_graphs(reads_, [sequences.OPEN, sequences.EXTEND, sequences.CLOSE] * 2).select(F.col("graph_id").alias("item_id"), F.posexplode(F.element_at("contigs", 1)["pos"]).alias("pos", "p"))
    return g.select("item_id", F.col("pos").cast("bigint").alias("pos"), *((F.round(F.get(F.col("p.base"), F.lit(i)).cast("double"), 4) + 0.0).alias(f"w_{b.lower()}") for i, b in enumerate("ACGT")))


@query("""
SELECT lang, """ + ", ".join(f"sum(length(text) - length(replace(text, '{b}', '')))::BIGINT AS n_{b}" for b in "acgt") + """ FROM documents GROUP BY lang
""")
def base_composition(spark, sf_dir):
    counts = [F.sum(F.length("text") - F.length(F.replace("text", F.lit(b)))).alias(f"n_{b}") for b in "acgt"]
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*counts)


@query("""
SELECT item_id, length(s)::BIGINT AS size, length(s)::BIGINT AS n_suffix, round(sum(CASE WHEN c IN ('a', 'c', 'g', 't') THEN 1.0 ELSE 0 END), 4) AS total_weight, round(sum(CASE WHEN c = 'a' THEN 0.99 WHEN c IN ('c', 'g', 't') THEN 0.01 / 3 ELSE 0 END), 4) AS a_weight
FROM (SELECT item_id, s, unnest(string_split(s, '')) AS c FROM (SELECT item_id, lower(text) AS s FROM benchmark)) WHERE c <> '' GROUP BY item_id, s
""")
def sequence_graphs(spark, sf_dir):
    """Items as sequences over acgt to one-contig graphs; sizes and sums of their base weights."""
    seqs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.lit("x").alias("name"), F.lower("text").alias("seq"))
    g = sequences.sequences_to_graphs(seqs, "acgt", 0.01).select("graph_id", "suffix", F.element_at("contigs", 1).alias("c"))
    sums = lambda f: F.aggregate(F.col("c.pos"), F.lit(0.0), lambda a, p: a + f(p["base"]).cast("double"))
    whole = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + x)
    return g.select(F.col("graph_id").alias("item_id"), "c.size", F.size("suffix").cast("bigint").alias("n_suffix"), F.round(sums(whole), 4).alias("total_weight"), F.round(sums(lambda b: F.get(b, F.lit(0))), 4).alias("a_weight"))


@query("""
SELECT p_partkey, round(greatest(x, y) + ln(1 + exp(least(x, y) - greatest(x, y))), 9) AS pair, round(ln(p_size), 9) AS log_size, round(sqrt(p_size), 9) AS root, round(exp(p_size / 10.0), 6) AS power,
       NOT (p_size > 25) AND p_retailprice < 1500 OR p_size = 1 AS both_ways, [10, 20, 30][p_size % 4 + 1] AS gathered, p_size % 3 = 2 AS scattered, (p_size * (p_size - 1) // 2)::BIGINT AS looped, [p_size % 4 + 1, p_size % 3 + 1] AS ploidies
FROM (SELECT *, -p_size / 7.0 AS x, -p_retailprice / 300 AS y FROM part)
""")
def row_programs(spark, sf_dir):
    """Pair sums of logarithms, roots and powers, truth values, gathers, scatters, loops and ploidy texts, by row."""
    size = F.col("p_size")
    truth = (~(size > 25) & (F.col("p_retailprice") < 1500)) | (size == 1)
    texts = F.concat((size % 4 + 1).cast("string"), F.lit(" / "), (size % 3 + 1).cast("string"))
    put_ = scalar.scatter(F.array(F.lit(0), F.lit(0), F.lit(0)), size % 3, F.lit(7))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(prob.lse_pair(-size / 7.0, -F.col("p_retailprice") / 300), 9).alias("pair"), F.round(F.ln(size), 9).alias("log_size"), F.round(F.sqrt(size), 9).alias("root"), F.round(F.exp(size / 10.0), 6).alias("power"),
        truth.alias("both_ways"), scalar.gather(F.array(F.lit(10), F.lit(20), F.lit(30)), size % 4).alias("gathered"), (scalar.gather(put_, F.lit(2)) == 7).alias("scattered"),
        scalar.loop(F.lit(0).cast("bigint"), size, lambda acc, i: acc + i).alias("looped"), text.parse_ploidies(texts).alias("ploidies"),
    )


@query("SELECT 0 AS axis, -20.0::DOUBLE AS low, 200.0::DOUBLE AS high UNION ALL SELECT 1, 1.0, 3.0")
def mixture_bounds(spark, sf_dir):
    """The box around all components of a mixture that have a weight."""
    m = prob.Mixture()
    for low, high in (([-20.0, 1.0], [0.0, 2.0]), ([5.0, 1.5], [200.0, 3.0]), ([-900.0, -900.0], [900.0, 900.0])):
        m.add(prob.Uniform(low, high))
    m.set_weights([0.5, 0.5, 0.0])
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(m.bounds(1.0))], "axis int, low double, high double")


@query("SELECT 10000::BIGINT AS n, true AS near_mean, true AS near_spread, true AS same_again")
def random_draws(spark, sf_dir):
    """Draws of a normal distribution: mean and spread to four standard errors, and the same numbers from other partitions."""
    g = prob.Gaussian([3.0], [[4.0]])
    one, two = (prob.draws(spark, g, 10_000, 5, parts).select("id", F.get("x", F.lit(0)).alias("x")) for parts in (3, 8))
    both = one.join(two.withColumnRenamed("x", "y"), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("x") - 3) < 0.08).alias("near_mean"), (F.abs(F.stddev("x") - 2) < 0.06).alias("near_spread"), F.every(F.col("x") == F.col("y")).alias("same_again"))


@query("""
WITH RECURSIVE t AS (SELECT range AS k, range::BIGINT AS c, 0 AS i FROM range(256) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM t WHERE i < 8),
b AS (SELECT list(c ORDER BY k) AS l FROM t WHERE i = 8),
s AS (SELECT n_nationkey, n_name, 4294967295::BIGINT AS c, 0 AS i FROM nation UNION ALL SELECT n_nationkey, n_name, xor(c >> 8, l[xor(c & 255, ascii(n_name[i + 1:i + 1])) + 1]), i + 1 FROM s, b WHERE i < length(n_name))
SELECT n_nationkey, xor(c, 4294967295) AS checksum FROM s WHERE i = length(n_name)
""")
def checksums(spark, sf_dir):
    """The CRC-32 of each nation's name; the SQL goes bit by bit."""
    return table(spark, sf_dir, "nation").select("n_nationkey", crypto.crc32(F.col("n_name")).alias("checksum"))


# ---- genotypes


@query("""
WITH g AS (SELECT a.range * 27 + b.range * 9 + c.range * 3 + d.range AS geno_idx, least(a.range, b.range) AS a0, greatest(a.range, b.range) AS a1, least(c.range, d.range) AS b0, greatest(c.range, d.range) AS b1
           FROM range(3) a, range(3) b, range(3) c, range(3) d)
SELECT geno_idx, (dense_rank() OVER (ORDER BY a0, a1, b0, b1) - 1)::INTEGER AS class FROM g
""")
def genotype_enumeration(spark, sf_dir):
    """All genotypes of three alleles and two individuals of ploidy two, with their classes."""
    return genotypes.genotypes(spark, 3, (2, 2)).select("geno_idx", "class")


@query("""
SELECT (row_number() OVER (ORDER BY a.range DESC, b.range DESC, c.range DESC) - 1)::INTEGER AS load_idx, a.range::INTEGER AS load_0, b.range::INTEGER AS load_1, c.range::INTEGER AS load_2
FROM range(13) a, range(13) b, range(13) c WHERE 2 * a.range + 2 * b.range + c.range = 12 AND b.range <= a.range
""")
def loading_enumeration(spark, sf_dir):
    """All loadings of twelve copies on ploidies 2, 2 and 1."""
    return genotypes.loadings(spark, 12, (2, 2, 1)).select("load_idx", *(F.get("load", F.lit(i)).alias(f"load_{i}") for i in range(3)))


@query("""
WITH RECURSIVE s AS (SELECT id, 0 AS step, id::HUGEINT AS state FROM (SELECT range AS id FROM range(50))
  UNION ALL SELECT id, step + 1, (((state % 4294967296) * 6364136223846793005::HUGEINT
       + ((((state // 4294967296) * (6364136223846793005::HUGEINT % 4294967296)) % 4294967296) * 4294967296) + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT) FROM s WHERE step < 10)
SELECT id, (state // 2)::BIGINT AS value FROM s WHERE step = 10
""")
def lcg_sequence(spark, sf_dir):
    """The tenth value of fifty seeds of the linear congruential generator."""
    state = scalar.lcg_after(F.col("id"), F.lit(10))
    return spark.range(50).select("id", scalar.lcg_value(state).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, (l_orderkey << 3) AS shifted, (l_orderkey >> 2) AS halved, l_orderkey & 255 AS low, l_orderkey | 256 AS joined, xor(l_orderkey, 85) AS flipped,
       (CASE WHEN l_partkey > l_suppkey THEN l_partkey ELSE l_suppkey END) AS larger, ((18446744073709551616::HUGEINT - l_orderkey) % 18446744073709551616::HUGEINT) // (l_partkey + 1) > 0 AS big, l_quantity::INTEGER AS quantity
FROM lineitem
""")
def scalar_operations(spark, sf_dir):
    """Shifts, bits, selection, unsigned division and conversion."""
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.shiftleft(k, 3).alias("shifted"), F.shiftrightunsigned(k, 2).alias("halved"), k.bitwiseAND(F.lit(255)).alias("low"), k.bitwiseOR(F.lit(256)).alias("joined"), k.bitwiseXOR(F.lit(85)).alias("flipped"),
        scalar.select(F.col("l_partkey") > F.col("l_suppkey"), F.col("l_partkey"), F.col("l_suppkey")).alias("larger"), scalar.unsigned_greater(scalar.unsigned_divide(-k, F.col("l_partkey") + 1), F.lit(0)).alias("big"), scalar.convert(F.col("l_quantity"), "I").alias("quantity"),
    )


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, where several branches of a plan need the rows."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


PCR = genotypes.Parameters(alleles=4, load=10, ploidies=(2, 2), cycles=0, fan=32)


@query("""
WITH l AS (SELECT * FROM (VALUES (0, 5, 0), (1, 4, 1), (2, 3, 2)) v(load_idx, x, y)), g AS (SELECT a.range * 64 + b.range * 16 + c.range * 4 + d.range AS geno_idx, [a.range, b.range, c.range, d.range] AS al FROM range(4) a, range(4) b, range(4) c, range(4) d)
SELECT load_idx, geno_idx, """ + ", ".join(f"(x * len(list_filter(al[1:2], lambda v: v = {k})) + y * len(list_filter(al[3:4], lambda v: v = {k})))::BIGINT AS allele_{k}" for k in range(4)) + """, 32::BIGINT AS n FROM l, g
""")
def initial_templates(spark, sf_dir):
    """Copies of each allele of every loading and genotype before any cycle, over all replicates."""
    sims = genotypes.simulate(spark, PCR)
    return sims.groupBy("load_idx", "geno_idx", *(F.get("counts", F.lit(k)).alias(f"allele_{k}") for k in range(4))).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT * FROM (VALUES (0, 4, 0), (1, 3, 1), (2, 2, 2)) v(load_idx, x, y)), g AS (SELECT a.range * 4 + b.range AS geno_idx, a.range AS p, b.range AS q FROM range(4) a, range(4) b)
SELECT load_idx, geno_idx, """ + ", ".join(f"(16 * (CASE WHEN p = {k} THEN x ELSE 0 END + CASE WHEN q = {k} THEN y ELSE 0 END))::BIGINT AS allele_{k}" for k in range(4)) + """, 32::BIGINT AS n FROM l, g
""")
def pcr_sim(spark, sf_dir):
    """Amplified counts where every template is copied without error: four cycles make sixteen of each, in all replicates."""
    p = genotypes.Parameters(alleles=4, load=4, ploidies=(1, 1), cycles=4, efficiency=1.0, error=0.0, fan=32)
    return genotypes.simulate(spark, p).groupBy("load_idx", "geno_idx", *(F.get("counts", F.lit(k)).alias(f"allele_{k}") for k in range(4))).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT * FROM (VALUES (0, 4, 0), (1, 3, 1), (2, 2, 2)) v(load_idx, x, y)), g AS (SELECT a.range AS p, b.range AS q FROM range(4) a, range(4) b)
SELECT load_idx, true AS grows, true AS bounded, (count(*) * 32)::BIGINT AS n FROM l, g GROUP BY load_idx
""")
def pcr_noise(spark, sf_dir):
    """Amplified counts with errors and an efficiency of 0.9: the mean grows by 1.9 a cycle (to four standard errors), and no sample more than doubles."""
    p = genotypes.Parameters(alleles=4, load=4, ploidies=(1, 1), cycles=4, efficiency=0.9, error=0.01, fan=32)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    found = genotypes.simulate(spark, p).groupBy("load_idx").agg(F.avg(total).alias("m"), F.stddev(total).alias("s"), F.max(total).alias("top"), F.count(F.lit(1)).alias("n"))
    return found.select("load_idx", (F.abs(F.col("m") - 4 * 1.9**4) < 4 * F.col("s") / F.sqrt("n")).alias("grows"), (F.col("top") <= 64).alias("bounded"), "n")


@query("""
SELECT load_idx::INTEGER AS load_idx, geno_idx, power(2, b)::BIGINT AS n_reads, power(2, b)::BIGINT AS total, true AS possible FROM range(2) l(load_idx), range(4) g(geno_idx), range(5) r(b)
""")
def read_draws(spark, sf_dir):
    """Reads of every simulation, halved from sixteen to one; without errors only alleles that are there are read."""
    sims = genotypes.simulate(spark, SMALL).filter("rep = 0")
    draws = genotypes.draw_reads(sims, 2, 0.0, 4).join(sims.select("load_idx", "geno_idx", "counts"), ["load_idx", "geno_idx"])
    total = F.aggregate("reads", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return draws.select("load_idx", "geno_idx", "n_reads", total.alias("total"), (~F.exists(F.arrays_zip("counts", "reads"), lambda x: (x["counts"] == 0) & (x["reads"] > 0))).alias("possible"))


@query("""
SELECT k::INTEGER AS k, round(sum(e) OVER (ORDER BY k), 9) AS cdf FROM (SELECT k, 0.9 * c[k + 1] / 6.0 + 0.1 / 2 * (1 - c[k + 1] / 6.0) AS e FROM (SELECT [3, 2, 1] AS c), range(3) r(k))
""")
def draw_distribution(spark, sf_dir):
    """Cumulative probabilities of reading each of three alleles of a sample with errors."""
    one = spark.range(1).select(F.posexplode(genotypes.draw_cdf(F.array(*(F.lit(n).cast("bigint") for n in (3, 2, 1))), genotypes.flat_errors(3, 0.1))).alias("k", "cdf"))
    return one.select("k", F.round("cdf", 9).alias("cdf"))


@query("""
SELECT i::INTEGER AS i, j::INTEGER AS j, (CASE WHEN i = j THEN 0.9 ELSE 0.05 END)::DOUBLE AS flat, (CASE WHEN i = j THEN 1 - (i > 0)::INT * 0.1 - (i < 2)::INT * 0.2 WHEN j = i - 1 THEN 0.1 WHEN j = i + 1 THEN 0.2 ELSE 0 END)::DOUBLE AS stutter FROM range(3) a(i), range(3) b(j)
""")
def copy_models(spark, sf_dir):
    """Mutation matrices of the flat and the stutter model."""
    flat = genotypes.mutation_matrix(genotypes.Parameters(3, 1, (1,), error=0.1))
    stutter = genotypes.mutation_matrix(genotypes.Parameters(3, 1, (1,), stutter=(0.1, 0.2)))
    cells = [(i, j, round(float(flat[i, j]), 9), round(float(stutter[i, j]), 9)) for i in range(3) for j in range(3)]
    return spark.createDataFrame(cells, "i int, j int, flat double, stutter double")


SMALL = genotypes.Parameters(alleles=2, load=2, ploidies=(1, 1), fan=32)
_SCORES = """l(load_idx, x, y) AS (VALUES (0, 2, 0), (1, 1, 1)), g AS (SELECT a.range AS p, b.range AS q, a.range * 2 + b.range AS class FROM range(2) a, range(2) b),
c AS (SELECT load_idx, class, (CASE WHEN p = 0 THEN x ELSE 0 END + CASE WHEN q = 0 THEN y ELSE 0 END) / 2.0 AS s FROM l, g),
s AS (SELECT d.range AS draw_id, load_idx::INTEGER AS load_idx, class::INTEGER AS class, d.range * ln(0.9 * s + 0.1 * (1 - s)) + (8 - d.range) * ln(0.1 * s + 0.9 * (1 - s)) AS log_p FROM range(9) d, c)"""


def _all_reads(spark: SparkSession) -> DataFrame:
    """All ways to read eight molecules of two alleles."""
    return spark.range(9).select(F.col("id").alias("draw_id"), F.array(F.col("id"), 8 - F.col("id")).alias("reads"))


def _scored(spark: SparkSession) -> DataFrame:
    """Their scores against an evaluation set without amplification."""
    return kept(genotypes.score_reads(_all_reads(spark), genotypes.simulate(spark, SMALL), 2, 0.1))


@query(f"WITH {_SCORES} SELECT draw_id, load_idx, class, round(log_p, 6) AS log_p FROM s")
def read_scores(spark, sf_dir):
    return _scored(spark).withColumn("log_p", F.round("log_p", 6))


@query(f"""WITH {_SCORES}, t AS (SELECT draw_id, ln(sum(exp(log_p))) AS total FROM s GROUP BY draw_id)
SELECT draw_id, round(max(log_p) FILTER (load_idx = 0 AND class = 1) - any_value(total), 6) AS ln_joint_right, round(ln(sum(exp(log_p)) FILTER (load_idx = 0)) - any_value(total), 6) AS ln_load_right,
       round(ln(sum(exp(log_p)) FILTER (class = 1)) - any_value(total), 6) AS ln_class_right, round(max(log_p) FILTER (load_idx = 0 AND class = 1) - ln(sum(exp(log_p)) FILTER (load_idx = 0)), 6) AS ln_class_given_load_right,
       round(max(log_p) FILTER (load_idx = 0 AND class = 1) - ln(sum(exp(log_p)) FILTER (class = 1)), 6) AS ln_load_given_class_right FROM s JOIN t USING (draw_id) GROUP BY draw_id""")
def read_answers(spark, sf_dir):
    """Joint, marginal and conditional log probabilities of the right answer: loading 0, class 1."""
    scores = _scored(spark)
    truth = spark.range(9).select(F.col("id").alias("draw_id"), F.lit(0).alias("load_idx"), F.lit(1).alias("class"))
    a = genotypes.marginals(scores, truth)
    names = ("ln_joint_right", "ln_load_right", "ln_class_right", "ln_class_given_load_right", "ln_load_given_class_right")
    return a.select("draw_id", *(F.round(c, 6).alias(c) for c in names))


@query(f"""WITH {_SCORES}, t AS (SELECT draw_id, ln(sum(exp(log_p))) AS total FROM s GROUP BY draw_id), i AS (SELECT draw_id, k, CASE WHEN k = 0 THEN class // 2 ELSE class % 2 END AS g, ln(sum(exp(log_p))) AS p FROM s, range(2) r(k) GROUP BY ALL)
SELECT draw_id AS "RC0", 8 - draw_id AS "RC1", 0 AS "RightLoading", 1 AS "RightGenotype", round(max(p - total) FILTER (k = 0 AND g = 0), 6) AS "lnPRightG0", round(max(p - total) FILTER (k = 0 AND g = 1), 6) AS "lnPWrongG0", '1' AS "WrongG0",
       round(max(p - total) FILTER (k = 1 AND g = 1), 6) AS "lnPRightG1", round(max(p - total) FILTER (k = 1 AND g = 0), 6) AS "lnPWrongG1", '0' AS "WrongG1" FROM i JOIN t USING (draw_id) GROUP BY draw_id""")
def genotype_report(spark, sf_dir):
    """The report with its columns by individual; loading 0 and class 1 are right."""
    scores, draws = _scored(spark), _all_reads(spark)
    truth = draws.select("draw_id", F.lit(0).alias("load_idx"), F.lit(1).alias("class"))
    classes = genotypes.class_genotypes(genotypes.genotypes(spark, 2, (1, 1)), (1, 1))
    out = genotypes.report(genotypes.marginals(scores, truth), draws, 2, genotypes.individual_answers(scores, truth, classes), 2)
    numbers = [f"lnP{w}G{i}" for i in (0, 1) for w in ("Right", "Wrong")]
    return out.select("RC0", "RC1", "RightLoading", "RightGenotype", "WrongG0", "WrongG1", *(F.round(c, 6).alias(c) for c in numbers))


@query(f"""WITH {_SCORES} SELECT draw_id, 1 AS individual, (class % 2)::VARCHAR AS genotype, round(ln(sum(exp(log_p))), 6) AS log_p FROM s GROUP BY draw_id, class % 2""")
def read_individuals(spark, sf_dir):
    """Log probability of the second individual's genotype."""
    classes = genotypes.class_genotypes(genotypes.genotypes(spark, 2, (1, 1)), (1, 1)).filter("individual = 1")
    return genotypes.individual_marginals(_scored(spark), classes).select("draw_id", "individual", "genotype", F.round("log_p_individual", 6).alias("log_p"))


# ---- matrices


@query("""
WITH b AS (SELECT n_regionkey, count(*)::DOUBLE AS n, sum(n_nationkey)::DOUBLE AS s FROM nation GROUP BY 1), m AS (SELECT *, (s + 1) * (2 * n + 1) - n * n AS det FROM b)
SELECT n_regionkey, round((2 * n + 1) / det, 9) AS inverse_00, round(-n / det, 9) AS inverse_01, round(-n / det, 9) AS inverse_10, round((s + 1) / det, 9) AS inverse_11, round(((2 * n + 1) * 3 - n * 5) / det, 9) AS x_0, round(((s + 1) * 5 - n * 3) / det, 9) AS x_1,
       round(sqrt(s + 1), 9) AS factor_00, round(n / sqrt(s + 1), 9) AS factor_10, round(sqrt(2 * n + 1 - n * n / (s + 1)), 9) AS factor_11, round((s + 2 * n + 2) / 2 + sqrt(power((s - 2 * n) / 2, 2) + n * n), 6) AS eigenvalue FROM m
""")
def solve_by_group(spark, sf_dir):
    """Of a symmetric matrix of each region: its inverse, the solution for (3, 5), its Cholesky factor and its largest eigenvalue."""
    import numpy as np

    base = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("n_nationkey").cast("double").alias("s"))
    cells = base.select("n_regionkey", F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), v.alias("v")) for i, j, v in ((0, 0, F.col("s") + 1), (0, 1, F.col("n")), (1, 0, F.col("n")), (1, 1, F.col("n") * 2 + 1))))).alias("c")).select("n_regionkey", "c.*")
    every = lambda m: np.concatenate([linalg.invert(m).ravel(), linalg.solve(m, np.array([3.0, 5.0])), linalg.cholesky(m).ravel()[[0, 2, 3]], [linalg.largest_eigenvalue(m)]])[None]
    names = [(f"inverse_{i}{j}", 9) for i in (0, 1) for j in (0, 1)] + [("x_0", 9), ("x_1", 9), ("factor_00", 9), ("factor_10", 9), ("factor_11", 9), ("eigenvalue", 6)]
    found = linalg.by_group(cells, ["n_regionkey"], every).groupBy("n_regionkey").agg(*(F.max(F.when(F.col("j") == k, F.col("v"))).alias(n) for k, (n, _) in enumerate(names)))
    return found.select("n_regionkey", *((F.round(n, d) + 0.0).alias(n) for n, d in names))




@query("""
SELECT item_id, list_sum(list_transform(m, lambda r: list_sum(r)))::DOUBLE AS total FROM (SELECT n_nationkey AS item_id,
  [[n_nationkey * n_nationkey + 2 * n_regionkey, 2 * n_nationkey + 2 * 4], [n_regionkey * n_nationkey + 4 * n_regionkey, 2 * n_regionkey + 4 * 4]] AS m FROM nation)
""")
def matrix_product(spark, sf_dir):
    """The sum of the cells of [[a, 2], [b, 4]] times [[a, 2], [b, 4]] with a the nation and b the region, in a row."""
    a, b = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    m = F.array(F.array(a, F.lit(2.0)), F.array(b, F.lit(4.0)))
    n = F.array(F.array(a, F.lit(2.0)), F.array(b, F.lit(4.0)))
    cells = F.flatten(linalg.multiply(m, n))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item_id"), F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x).alias("total"))


@query("""
SELECT n_nationkey AS item_id, CAST(2 * (n_nationkey + 3) + 1 AS DOUBLE) AS first_cell, CAST(n_regionkey AS DOUBLE) AS transposed, CAST(n_nationkey * 3 AS DOUBLE) AS cell_product, n_nationkey / 4.0 AS cell_quotient FROM nation
""")
def matrix_cells(spark, sf_dir):
    """Sums, scalars, transposes and products by cell of small matrices in a row."""
    a, b = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    m, n = F.array(F.array(a, b)), F.array(F.array(F.lit(3.0), F.lit(4.0)))
    at = lambda x, i, j: F.get(F.get(x, F.lit(i)), F.lit(j))
    twice = linalg.add_scalar(linalg.multiply_scalar(linalg.add(m, n), 2.0), 1.0)
    quotient = linalg.divide_cells(m, F.array(F.array(F.lit(4.0), F.lit(4.0))))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("item_id"), at(twice, 0, 0).alias("first_cell"), at(linalg.transpose(linalg.subtract(m, linalg.multiply_scalar(m, 0.0))), 1, 0).alias("transposed"),
        at(linalg.multiply_cells(m, n), 0, 0).alias("cell_product"), at(quotient, 0, 0).alias("cell_quotient"),
    )


@query("SELECT l::INTEGER AS load_idx, g AS geno_idx, r::INTEGER AS rep, (l * 100 + g * 10 + r)::BIGINT AS first, 7::BIGINT AS second FROM range(2) a(l), range(4) b(g), range(3) c(r)")
def loadings_file(spark, sf_dir):
    """Simulated loadings of two individuals with two alleles through their binary file."""
    from ..sources import blocks, samples

    data = blocks.pack_loadings(2, 2, [1, 1], 3, ([load * 100 + g * 10 + r, 7] for load in range(2) for g in range(4) for r in range(3)))
    path = shared_path(spark)
    spark.createDataFrame([(data,)], "content binary").coalesce(1).foreachPartition(lambda rows_: [_put(path, r.content) for r in rows_])
    back = samples.read_loadings(spark, path)
    return back.select("load_idx", "geno_idx", "rep", F.get("counts", F.lit(0)).alias("first"), F.get("counts", F.lit(1)).alias("second"))


@query("""SELECT k AS "RC0", 9 - k AS "RC1", k % 2 AS "RightLoading", -1::BIGINT AS "WrongLoading|Geno", 3::BIGINT AS "WrongG1", -k / 8.0 AS "lnPJointRight", -k / 2.0 AS "lnPWrongG1" FROM range(9) r(k)""")
def scored_file(spark, sf_dir):
    """Scored reads through their binary records."""
    from ..sources import samples

    data = samples.pack_scored(((k, 9 - k, k % 2, 0, 0, 0, 0, 0, 0, -1, 2, 3, -k / 8, *[0.0] * 9, 0.0, 0.0, 0.0, -k / 2) for k in range(9)), 2, 2)
    path = shared_path(spark)
    spark.createDataFrame([(data,)], "content binary").coalesce(1).foreachPartition(lambda rows_: [_put(path, r.content) for r in rows_])
    return samples.read_scored(spark, path, 2, 2).select("RC0", "RC1", "RightLoading", "`WrongLoading|Geno`", "WrongG1", "lnPJointRight", "lnPWrongG1")


@query("SELECT i, j, (i * 10 + j) / 4.0 AS v FROM range(3) a(i), range(4) b(j)")
def matrix_file(spark, sf_dir):
    """A matrix through its binary file."""
    from ..sources import blocks

    data = blocks.pack_matrix([[(i * 10 + j) / 4 for j in range(4)] for i in range(3)])
    path = shared_path(spark)
    spark.createDataFrame([(data,)], "content binary").coalesce(1).foreachPartition(lambda rows_: [_put(path, r.content) for r in rows_])
    return tables.read_binary_matrix(spark, path)


def _put(path: str, data: bytes) -> None:
    from ..sources import store

    store.make_folder(path)
    with store.open_out(store.join(path, "matrix")) as f:
        f.write(data)


@query("SELECT round(avg(c_acctbal / 1000), 3) AS place, count(*) AS n FROM customer")
def golden_section(spark, sf_dir):
    """The place where the sum of squared distances to the balances is least, by golden section over moments."""
    t = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("x"))
    n, first, second = t.agg(F.count("x"), F.avg("x"), F.avg(F.col("x") * F.col("x"))).first()
    place = optim.golden_section(lambda m: second - 2 * m * first + m * m, -20.0, 20.0, 1e-7)
    return spark.createDataFrame([(round(place, 3), n)], "place double, n long")


@query("SELECT round(regr_slope(l_extendedprice / 10000, l_quantity / 10), 2) AS slope, round(regr_intercept(l_extendedprice / 10000, l_quantity / 10), 2) AS intercept FROM lineitem")
def least_squares(spark, sf_dir):
    """A line through prices by quantities with limited-memory BFGS; one job gathers the moments that value and gradient of any point follow from."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))
    m = t.agg(*(F.avg(c).alias(n) for n, c in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y"))))).first()
    loss = lambda p: m.yy - 2 * p[0] * m.xy - 2 * p[1] * m.y + p[0] ** 2 * m.xx + 2 * p[0] * p[1] * m.x + p[1] ** 2
    slope, intercept = optim.lbfgs(optim.many(loss), [0.0, 0.0], rounds=40)
    return spark.createDataFrame([(round(float(slope), 2), round(float(intercept), 2))], "slope double, intercept double")


# ---- files, written to the shared folder and read back


@query(r"SELECT doc_id::VARCHAR AS name, regexp_replace(replace(text, chr(10) || '>', chr(10) || ' >'), '[ \t\r\n]', '', 'g') AS seq FROM documents")
def fasta_roundtrip(spark, sf_dir):
    """Documents as FASTA records; blanks inside a sequence go, and a mark that begins a line is kept from being one by a blank."""
    path = shared_path(spark)
    reads.write_fasta(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.replace("text", F.lit("\n>"), F.lit("\n >")).alias("seq")), path)
    return reads.read_fasta(spark, path).select("name", "seq")


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation UNION ALL SELECT 's40:name', NULL")
def typed_header_row(spark, sf_dir):
    """A typed text table with a row of data that looks like its header."""
    path = shared_path(spark)
    head = spark.createDataFrame([(["s40:name", "i:region"],)] * 2, "cells array<string>").coalesce(1)
    body = table(spark, sf_dir, "nation").select(F.array("n_name", F.col("n_regionkey").cast("string")).alias("cells"))
    tables.write_tsv(head.unionByName(body.repartition(3)), path)  # the header's file is the first, and not the largest
    return tables.read_typed(spark, path)


@query("""
SELECT r - 1 AS i, j::BIGINT AS j, embedding[j + 1]::DOUBLE AS v FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), range(64) q(j)
""")
def text_matrix(spark, sf_dir):
    """The vectors as a text matrix of several files of different sizes; rows are numbered in the order of the files."""
    path = shared_path(spark)
    t = table(spark, sf_dir, "embeddings")
    cut = t.agg(F.max("vec_id")).first()[0] or 0
    cells = F.transform("embedding", lambda x: x.cast("double").cast("string")).alias("cells")
    for part, below in enumerate((1, 2, 9, 11)):  # files of quite different sizes
        own = t.filter((F.col("vec_id") < cut * below / 10) & (F.col("vec_id") >= cut * (0, 1, 2, 9)[part] / 10))
        tables.write_tsv(own.repartitionByRange(2, "vec_id").sortWithinPartitions("vec_id").select(cells), f"{path}/part={part}")
    return tables.read_matrix(spark, path)


@query("SELECT c_custkey, c_name, c_acctbal, r - 1 AS row_id FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r > 20 AND r <= 70")
def data_range(spark, sf_dir):
    """Rows 20 to 69 of a table of fixed-width rows in several files, by their numbers; the bounds reach the reader."""
    path = shared_path(spark)
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    binary.write(t.repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey"), path, ".zlib.bcdat")
    return rows.row_range(binary.read(spark, path, rows=16, number="row_id"), 20, 70).select("c_custkey", "c_name", "c_acctbal", "row_id")


@query("SELECT r - 1 AS row_id, o_orderkey AS read_index, o_custkey AS ref_index, -o_totalprice AS log_prob, (1 + o_orderkey % 3)::BIGINT AS n_events FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 100 AND r <= 164")
def alignment_range(spark, sf_dir):
    """Alignments 100 to 163 of several files, with all their events, by their numbers."""
    path = shared_path(spark)
    zero = F.lit(0).cast("bigint")
    events = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda k: F.struct(F.element_at(F.array(*map(F.lit, "MIX")), k + 1).alias("type"), (k + 1).alias("n")))
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("read_index"), F.col("o_custkey").cast("bigint").alias("ref_index"), (-F.col("o_totalprice")).alias("log_prob"),
        *(zero.alias(c) for c in ("start_contig_ref", "start_index_ref", "start_contig_read", "start_index_read")), events.alias("events"),
    )
    binary.write(t.repartitionByRange(4, "read_index").sortWithinPartitions("read_index"), path, ".zlib.bsalgn")
    found = rows.row_range(binary.read(spark, path, rows=50, number="row_id"), 100, 164)
    right = F.forall("events", lambda e: e["type"] == F.element_at(F.array(*map(F.lit, "MIX")), e["n"]))
    return found.filter(right).select("row_id", "read_index", "ref_index", "log_prob", F.size("events").cast("bigint").alias("n_events"))


@query("""
WITH l AS (SELECT string_agg(o_orderkey || ' ' || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS t FROM orders)
SELECT k, substr(t, (k * 70001 + 5)::INTEGER + 1, 40) AS bytes FROM l, range(0, 3) r(k)
""")
def sealed_ranges(spark, sf_dir):
    """Ranges of bytes of an enciphered file of orders, each deciphered without the rest."""
    from ..sources import sealed

    path, key = shared_path(spark), F.lit(bytes(range(16)))
    lines = table(spark, sf_dir, "orders").orderBy("o_orderkey").coalesce(1).select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    sealed.write_sealed(lines, path, key, 11)
    found = None
    for k in range(3):
        at = k * 70_001 + 5
        pieces = sealed.read_sealed(spark, path, key, 11, at, at + 40)
        one = pieces.agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("x")).select(F.lit(k).cast("bigint").alias("k"), F.aggregate("x", F.lit(bytearray()), lambda acc, p: F.concat(acc, p["data"])).cast("string").alias("bytes"))
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT c_custkey, c_name || ';' || c_mktsegment AS rest, 2 AS width FROM customer")
def delimited_roundtrip(spark, sf_dir):
    """A table with other delimiters: rows end in a bar, cells in a caret."""
    path = shared_path(spark)
    cells = F.array(F.col("c_custkey").cast("string"), F.concat_ws(";", "c_name", "c_mktsegment"))
    tables.write_delimited(table(spark, sf_dir, "customer").select(cells.alias("cells")), path, "|", "^")
    back = tables.read_delimited(spark, path, "|", "^")
    return back.select(F.get("cells", F.lit(0)).cast("bigint").alias("c_custkey"), F.get("cells", F.lit(1)).alias("rest"), F.size("cells").alias("width"))


@query("SELECT r_regionkey::VARCHAR AS code, r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'nation' FROM nation")
def appended_blocks(spark, sf_dir):
    """Two appends to a block-compressed table, after a write that an overwrite replaced."""
    path = shared_path(spark)
    one = lambda name, letter: table(spark, sf_dir, name).select(F.array(F.col(f"{letter}_{name}key").cast("string"), f"{letter}_name", F.lit(name)).alias("cells"))
    binary.write(one("nation", "n"), path, ".zlib.bctab")
    binary.write(one("region", "r"), path, ".zlib.bctab", mode="overwrite")
    binary.write(one("nation", "n"), path, ".zlib.bctab")
    return binary.read(spark, path).select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("code", "name", "kind"))))


@query("SELECT k.range + 30 AS seq_id, length(text)::BIGINT AS bases FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) JOIN range(90) k ON n = k.range + 30")
def sequence_range(spark, sf_dir):
    """Rows 30 to 119 of block-compressed sequences: only these are read, in ranges of twenty."""
    path = shared_path(spark)
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq"))
    binary.write(docs, path, ".zlib.bcseq")
    return rows.row_range(binary.read(spark, path, rows=20), 30, 120, "seq_id").select("seq_id", F.length("seq").cast("bigint").alias("bases"))


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS balance, suffix FROM supplier, (VALUES ('.bdat'), ('.bdat.gz'), ('.raw.bcdat'), ('.zlib.bcdat')) v(suffix)")
def data_files(spark, sf_dir):
    """A typed table through every binary format, by the suffix of its path."""
    from ..sources import dispatch

    kinds = [ColumnKind("s_suppkey", "int"), ColumnKind("s_name", "str", length=40), ColumnKind("balance", "real")]
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("balance")).to(to_struct(kinds))
    out = []
    for suffix in (".bdat", ".bdat.gz", ".raw.bcdat", ".zlib.bcdat"):
        path = shared_path(spark) + suffix
        dispatch.save_data(t, path)
        out.append(dispatch.open_data(spark, path).select("s_suppkey", "s_name", F.round("balance", 2).alias("balance"), F.lit(suffix).alias("suffix")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT n_nationkey AS read_index, n_regionkey::BIGINT AS ref_index, -n_nationkey / 4.0 AS log_prob, 1::BIGINT AS start_contig_ref, 2::BIGINT AS start_index_ref, 3::BIGINT AS start_contig_read, n_nationkey::BIGINT AS start_index_read, 'M' || n_nationkey + 1 || ' I2 l3' AS events FROM nation")
def alignment_file_roundtrip(spark, sf_dir):
    """Joint alignments with their events through their block-compressed files."""
    n = F.col("n_nationkey").cast("bigint")
    event = lambda kind, k: F.struct(F.lit(kind).alias("type"), k.cast("int").alias("n"))
    starts = [F.lit(k).cast("bigint").alias(c) for k, c in ((1, "start_contig_ref"), (2, "start_index_ref"), (3, "start_contig_read"))]
    rows_ = table(spark, sf_dir, "nation").select(n.alias("read_index"), F.col("n_regionkey").cast("bigint").alias("ref_index"), (-n / 4.0).alias("log_prob"), *starts, n.alias("start_index_read"), F.array(event("M", n + 1), event("I", F.lit(2)), event("l", F.lit(3))).alias("events"))
    path = shared_path(spark)
    binary.write(rows_, path, ".zlib.bsalgn")
    return binary.read(spark, path).withColumn("events", F.array_join(F.transform("events", lambda e: F.concat(e["type"], e["n"].cast("string"))), " "))


@query("SELECT c_custkey::VARCHAR AS code, c_name AS name, how FROM customer, (VALUES ('tconv'), ('dconv'), ('sconv')) v(how)")
def conversions(spark, sf_dir):
    """Text, typed and sequence files converted between formats by the command line's programs."""
    from .. import cli
    from ..sources import dispatch

    t = table(spark, sf_dir, "customer")
    at = [shared_path(spark) for _ in range(6)]
    dispatch.save_table(t.select(F.array(F.col("c_custkey").cast("string"), "c_name").alias("cells")), at[0] + ".tsv.gz")
    cli.run(["tconv", "--in", at[0] + ".tsv.gz", "--out", at[1] + ".zlib.bctab"])
    one = dispatch.open_table(spark, at[1] + ".zlib.bctab").select(F.get("cells", F.lit(0)).alias("code"), F.get("cells", F.lit(1)).alias("name"), F.lit("tconv").alias("how"))
    dispatch.save_data(t.select("c_custkey", "c_name").to(to_struct([ColumnKind("c_custkey", "int"), ColumnKind("c_name", "str", length=40)])), at[2] + ".zlib.bcdat")
    cli.run(["dconv", "--in", at[2] + ".zlib.bcdat", "--out", at[3] + ".bdat"])
    two = dispatch.open_data(spark, at[3] + ".bdat").select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"), F.lit("dconv").alias("how"))
    dispatch.save_sequences(t.select(F.col("c_custkey").cast("string").alias("name"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("seq")), at[4] + ".fa")
    cli.run(["sconv", "--in", at[4] + ".fa", "--out", at[5] + ".zlib.bcseq"])
    three = dispatch.open_sequences(spark, at[5] + ".zlib.bcseq").select(F.col("name").alias("code"), F.replace("seq", F.lit("_"), F.lit("#")).alias("name"), F.lit("sconv").alias("how"))
    return one.unionByName(two).unionByName(three)


@query("SELECT 'r' || p_partkey AS name, repeat('ACGT', p_size % 5 + 1) AS seq, repeat('I!@~', p_size % 5 + 1) AS qual FROM part")
def fastq_roundtrip(spark, sf_dir):
    path, n = shared_path(spark), F.col("p_size") % 5 + 1
    reads.write_fastq(table(spark, sf_dir, "part").select(F.concat(F.lit("r"), F.col("p_partkey")).alias("name"), F.repeat(F.lit("ACGT"), n).alias("seq"), F.repeat(F.lit("I!@~"), n).alias("qual")), path)
    return reads.read_fastq(spark, path).select("name", "seq", "qual")


@query("SELECT doc_id, text FROM documents")
def tsv_file_roundtrip(spark, sf_dir):
    """Whole texts through an escaped, compressed text table (texts here have no backslash)."""
    path = shared_path(spark)
    tables.write_tsv(table(spark, sf_dir, "documents").select(F.array(F.col("doc_id").cast("string"), "text").alias("cells")), path, compression="gzip")
    back = tables.read_tsv(spark, path)
    return back.select(F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"), F.get("cells", F.lit(1)).alias("text"))


@query("SELECT doc_id, text FROM documents")
def block_table_roundtrip(spark, sf_dir):
    """Whole texts through block-compressed text tables with an index, read by ranges of rows."""
    path = shared_path(spark)
    binary.write(table(spark, sf_dir, "documents").select(F.array(F.col("doc_id").cast("string"), "text").alias("cells")), path, ".zlib.bctab")
    return binary.read(spark, path, rows=500).select(F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"), F.get("cells", F.lit(1)).alias("text"))


@query("SELECT s_suppkey, s_acctbal, s_name, CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN s_nationkey > 9 THEN s_nationkey::BIGINT END AS big FROM supplier")
def typed_file_roundtrip(spark, sf_dir):
    """All kinds of columns, with missing values, through a binary typed table."""
    kinds = [ColumnKind("s_suppkey", "int"), ColumnKind("s_acctbal", "real"), ColumnKind("s_name", "str", length=40), ColumnKind("parity", "cat", {"even": 0, "odd": 1}), ColumnKind("big", "int")]
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_name", F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("parity"), F.when(F.col("s_nationkey") > 9, F.col("s_nationkey").cast("bigint")).alias("big"))
    path = shared_path(spark)
    binary.write(t.to(to_struct(kinds)), path, ".zlib.bcdat")
    return binary.read(spark, path)


@query("""
WITH c AS (SELECT item_id, text, pos, text[pos:pos] AS c FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS pos FROM benchmark))
SELECT item_id::VARCHAR AS name, text AS seq, length(text)::BIGINT AS positions, 1::BIGINT AS num_links, round(sum(CASE c WHEN 'A' THEN 0.99 WHEN 'C' THEN 0.01 / 3 WHEN 'G' THEN 0.01 / 3 WHEN 'T' THEN 0.01 / 3 WHEN 'N' THEN 0.25 ELSE 0 END), 4) AS a_weight,
       string_agg(pos - 1, ',' ORDER BY substr(text, pos)) AS suffixes, '0:1' AS in_links, '0:0:1.0' AS out_links, 'x' || item_id AS extra, '0.00005 0.10000 0.00005' AS inserts FROM c GROUP BY item_id, text
""")
def graph_file_roundtrip(spark, sf_dir):
    """Every field of sequence graphs through their ten block-compressed files."""
    seqs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("item_id").cast("string").alias("name"), F.col("text").alias("seq"))
    path = shared_path(spark)
    graphs = sequences.sequences_to_graphs(seqs, equal=["NACGT"]).withColumn("extra", F.concat(F.lit("x"), "name").cast("binary"))
    binary.write(graphs, path, ".zlib.bsgrap")
    pos = F.element_at("contigs", 1)["pos"]
    weight = F.aggregate(pos, F.lit(0.0), lambda acc, p: acc + F.get(p["base"], F.lit(0)).cast("double"))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    first = F.element_at(pos, 1)
    inserts = F.concat_ws(" ", *(F.format_string("%.5f", first[c].cast("double")) for c in ("ins_open", "ins_ext", "ins_close")))
    return binary.read(spark, path).select(
        "name", "seq", F.size(pos).cast("bigint").alias("positions"), "num_links", F.round(weight, 4).alias("a_weight"), joined("suffix", lambda x: x.cast("string")).alias("suffixes"),
        joined("in_links", lambda x: F.concat_ws(":", x["contig"].cast("string"), x["link"].cast("string"))).alias("in_links"),
        joined("out_links", lambda x: F.concat_ws(":", x["link"].cast("string"), x["contig"].cast("string"), x["p"].cast("string"))).alias("out_links"),
        F.col("extra").cast("string").alias("extra"), inserts.alias("inserts"),
    )


@query("SELECT c_custkey::VARCHAR || ' ' || lower(c_mktsegment) AS value FROM customer")
def process_lines(spark, sf_dir):
    """Lines through an external program, one process a partition."""
    from ..sources.dispatch import open_process

    return open_process(spark, "tr A-Z a-z", table(spark, sf_dir, "customer").select(F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_mktsegment").alias("value")))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def stream_typed_rows(spark, sf_dir):
    """The text-table path as a stream: files arrive in a folder, typed rows are kept until the folder is done, then grouped."""
    from ..streaming import stream_typed

    folder, kept = shared_path(spark), shared_path(spark)
    t = table(spark, sf_dir, "customer").select(F.array(F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), "c_mktsegment").alias("cells"))
    tables.write_tsv(t.repartition(3), folder)
    kinds = [ColumnKind("c_custkey", "int"), ColumnKind("c_acctbal", "real"), ColumnKind("c_mktsegment", "str", length=20)]
    run = stream_typed(spark, folder, kinds, files_per_trigger=1).writeStream.format("parquet").option("checkpointLocation", kept + "-state").trigger(availableNow=True).start(kept)
    run.awaitTermination()
    return spark.read.parquet(kept).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT n_name AS name, repeat('ACGT', n_regionkey + 1) AS seq, true AS in_a_batch FROM nation")
def stream_sequences(spark, sf_dir):
    """FASTA files that arrive in a folder, two to a batch; each batch writes under its number."""
    from ..streaming import stream_fasta

    folder, out = shared_path(spark), shared_path(spark)
    reads.write_fasta(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.repeat(F.lit("ACGT"), F.col("n_regionkey") + 1).alias("seq")).repartition(3), folder)
    run = stream_fasta(spark, folder, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), out + "-state", 2, True)
    run.awaitTermination()
    return spark.read.parquet(out).select("name", "seq", (F.col("batch") < 2).alias("in_a_batch"))


@query("SELECT r - 1 AS row_id, o_orderkey, o_totalprice, (r - 1) * 3 // n AS batch FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders)")
def stream_block_sets(spark, sf_dir):
    """Orders appended in three sets, read as a stream that stops after the first and goes on, and kept as block files by a stream; every row once, numbered throughout."""
    from ..streaming import stream_blocks, write_blocks

    folder, out = shared_path(spark), shared_path(spark)
    n = table(spark, sf_dir, "orders").count()
    t = rows.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), "at")
    for k in range(3):
        own = t.filter(F.col("at") * 3 >= F.lit(k * n)).filter(F.col("at") * 3 < F.lit((k + 1) * n))
        binary.write(own.orderBy("at").select("o_orderkey", "o_totalprice"), folder, ".zlib.bcdat")
        run = write_blocks(stream_blocks(spark, folder, number="row_id").withColumn("batch", F.lit(k).cast("bigint")), out, ".zlib.bcdat", out + "-state")
        run.processAllAvailable()
        run.stop()
    return binary.read(spark, out)
