"""Interval-, alignment- and call-shaped views of the driver's tables: integer arithmetic that Spark and DuckDB share.

Each view is one SELECT over one table, written once: its columns go to ``selectExpr`` here and, as text, into the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def div(a: str, b: int) -> str:
    """Whole division of integers from 0, in both dialects."""
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def big(a: str) -> str:
    return f"CAST({a} AS BIGINT)"


Q = big("l_quantity")
CIGAR = f"concat({Q}, '=', l_linenumber, 'X', l_partkey % 50 + 1, 'D', {Q}, '=', l_suppkey % 40 + 1, 'I', {Q}, '=', (l_partkey % 3) * 300, 'S')"
READ_START = big("l_orderkey * 10 + l_partkey % 10")

#: name: (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_read": ("lineitem", {
        "qname": big("l_orderkey"), "seg": big("l_linenumber"), "sample": big("l_linenumber % 3"), "chrom": big("l_suppkey % 24"),
        "start": READ_START, "end": f"{READ_START} + 200 + {Q} * 40", "strand": big("l_partkey % 2"), "mapq": big("l_partkey % 61"), "flag": big("(l_partkey % 8) * 256 + (l_suppkey % 3) * 4"),
    }),
    "v_region": ("part", {
        "region_id": big("p_partkey"), "chrom": big(f"{div('p_partkey', 6)} % 24"), "start": big("(p_partkey * 7919) % 150000"),
        "end": big("(p_partkey * 7919) % 150000 + p_size * 40"), "value": big("p_partkey % 6"),
    }),
    "v_bpo": ("events", {
        "obs": big("event_id"), "chrom1": big("user_id % 6"), "dir1": big("user_id % 2"), "dir2": big(f"{div('user_id', 2)} % 2"),
        "start1": big("(user_id * 7919) % 100000 + event_id % 60"), "end1": big("(user_id * 7919) % 100000 + event_id % 60 + 1"), "chrom2": big("user_id % 6"),
        "start2": big("(user_id * 7919) % 100000 + event_id % 60 + 300 + (user_id % 37) * 400 + event_id % 90"),
        "end2": big("(user_id * 7919) % 100000 + event_id % 60 + 301 + (user_id % 37) * 400 + event_id % 90"),
        "evidence": big("event_id % 3"), "inserted": big("event_id % 25"), "qname": div("event_id", 4),
    }),
    "v_cigar": ("lineitem", {"qname": big("l_orderkey * 8 + l_linenumber"), "chrom": big("l_suppkey % 24"), "pos": READ_START, "cigar": CIGAR}),
    "v_segment": ("lineitem", {
        "qname": big("l_orderkey"), "seg": big("l_linenumber"), "chrom": big("l_suppkey % 24"), "start": READ_START, "end": f"{READ_START} + 3 * {Q} + l_linenumber + l_partkey % 50 + 1",
        "strand": big("l_partkey % 2"), "read_start": big("l_linenumber * 400"), "read_end": f"l_linenumber * 400 + 3 * {Q}", "read_length": big("3600"), "cigar": CIGAR,
        "is_primary": "l_linenumber = 1", "gone": big("l_partkey % 50 + 1"), "until": f"{Q} + l_linenumber",
    }),
    "v_sv": ("part", {
        "sv": big("p_partkey"), "kind": "CASE WHEN p_partkey % 2 = 0 THEN 'DEL' ELSE 'DUP' END", "chrom": big("p_partkey % 24"),
        "start": big("(p_partkey * 7919) % 1000000"), "end": big("(p_partkey * 7919) % 1000000 + 9000 + p_size * 2000"), "quality": big("p_partkey % 60"),
    }),
    "v_cnv": ("part", {
        "cnv": big("p_partkey"), "chrom": big("p_partkey % 24"), "start": big("(p_partkey * 7919) % 1000000 + p_size % 8 * 100"),
        "end": big("(p_partkey * 7919) % 1000000 + 9000 + p_size * 2000 + p_partkey % 7 * 150"),
    }),
    "v_truth": ("orders", {"label": "CASE WHEN o_orderkey % 7 < 4 THEN 'TP' WHEN o_orderkey % 7 < 6 THEN 'FP' ELSE 'FN' END", "size": big("o_custkey * 7"), "type": big("o_orderkey % 2")}),
    "v_order": ("orders", {"sv": big("o_custkey % 500"), "cust": big("o_custkey"), "status": "o_orderstatus", "key": big("o_orderkey")}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def view_sql(name: str) -> str:
    table, columns = VIEWS[name]
    return "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {table}"


def with_views(*names: str, body: str) -> str:
    """SQL with the named views as common table expressions before ``body``, which may start with its own ", x AS (...)"."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names) + " " + body


def with_recursive(*names: str, body: str) -> str:
    return with_views(*names, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


#: Letters of the documents as bases, in both dialects.
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N')"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS chrom", f"{text} AS seq")


SEQUENCES_SQL = "v_seq AS (SELECT doc_id AS chrom, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS seq FROM documents)"

#: All letters of the documents as bases, other characters left out.
_BASES = "regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', ''{flags})"
BASES_SQL = f"v_base AS (SELECT CAST(doc_id AS BIGINT) AS doc, {_BASES.format(flags=", 'g'")} AS seq FROM documents)"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CAST(doc_id AS BIGINT) AS doc", f"{_BASES.format(flags='')} AS seq")
