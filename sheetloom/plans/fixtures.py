"""Datasheet tables derived by SQL from the given tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

PAGE = """
SELECT p_partkey AS doc_id, page,
 CASE (p_partkey+page)%5
  WHEN 0 THEN concat('Recommended land pattern',chr(10),'Dimensions in mm',chr(10),'CASE ',CAST(100+p_partkey%40 AS STRING),'-01',chr(10),'1.',CAST(p_partkey%10 AS STRING),'0',chr(10),'0.80 REF')
  WHEN 1 THEN concat('Package outline',chr(10),'Dimensions: mm (inches)',chr(10),'CASE ',CAST(100+p_partkey%40 AS STRING),'-01',chr(10),'2.54 (0.1)',chr(10),'1.27 (0.05)',chr(10),'3.10',chr(10),'2.90',chr(10),'1.75',chr(10),'1.45')
  WHEN 2 THEN concat('Tape and reel',chr(10),'carrier tape',chr(10),'see land pattern note')
  WHEN 3 THEN concat('Ordering information',chr(10),'Package: SOT-',CAST(20+p_partkey%5 AS STRING),chr(10),p_name,chr(10),'1.60 ± 0.10')
  ELSE concat(p_name,' ',p_type,' ',p_brand) END AS text
FROM {part} CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS t(page)"""

DIMENSION = """
WITH k AS (SELECT p_partkey AS doc_id, 50+(p_partkey*7)%100 AS p, 60+(p_partkey*11)%120 AS g, 40+(p_partkey*13)%90 AS c FROM {part}),
o AS (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5)) AS t(ord)),
s AS (SELECT * FROM (VALUES (0),(1),(2)) AS t(sample_idx)),
r AS (SELECT doc_id, sample_idx, ord,
  CASE ord WHEN 0 THEN p WHEN 1 THEN c WHEN 2 THEN g
    WHEN 3 THEN g+2*p+(CASE WHEN doc_id%5=0 THEN 9 ELSE 0 END) WHEN 4 THEN g+p ELSE g+2*p-20 END
    + (CASE WHEN (doc_id+2*ord+sample_idx)%17=0 THEN 1 ELSE 0 END) AS h,
  CASE WHEN (doc_id*3+ord+sample_idx)%13=0 THEN 'other' ELSE
    CASE ord WHEN 0 THEN 'pad_width' WHEN 1 THEN 'pad_height' WHEN 2 THEN 'pad_gap' WHEN 3 THEN 'overall_span'
      WHEN 4 THEN 'pad_center_distance' ELSE 'body_length' END END AS role,
  CASE WHEN ord=5 THEN 'package_outline' ELSE 'solder_land' END AS belongs_to,
  CASE ord WHEN 0 THEN 'left pad left edge -> left pad right edge' WHEN 1 THEN 'left pad top edge -> left pad bottom edge'
    WHEN 2 THEN 'left pad right edge -> right pad left edge' WHEN 3 THEN 'left pad left edge -> right pad right edge'
    WHEN 4 THEN 'left pad centerline -> right pad centerline' ELSE 'left edge -> right edge' END AS endpoints
  FROM k CROSS JOIN o CROSS JOIN s
  WHERE (doc_id+ord+sample_idx)%11<>0 AND NOT (ord=4 AND doc_id%3=0))
SELECT doc_id, sample_idx, ord, role, belongs_to, endpoints, 'mm' AS unit,
  concat(CAST(CAST(floor(h/100) AS BIGINT) AS STRING), '.', lpad(CAST(h%100 AS STRING),2,'0')) AS value FROM r"""

REVIEW_EVENT = "SELECT ts AS timestamp, CAST(user_id AS STRING) AS record_id, event_type AS action, event_id FROM {events}"

REGISTRY_GROUP = """
SELECT p_brand AS group_id, p_brand AS package_code, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '')) AS alias,
  CASE WHEN CAST(substr(p_brand, length(p_brand), 1) AS INT) % 2 = 0 THEN 'user_approved' ELSE 'proposed' END AS approval_status,
  CAST(min(p_partkey) AS STRING) AS proposed_canonical_entry_id
FROM {part} GROUP BY p_brand"""

GEOMETRY = """
SELECT p_partkey AS doc_id,
  CASE p_partkey%6 WHEN 0 THEN 'CHIP' WHEN 1 THEN 'SOT3' WHEN 2 THEN 'INLINE3' WHEN 3 THEN 'GRID4' WHEN 4 THEN 'DUAL' ELSE 'QUAD_EP' END AS family,
  CAST(50+(p_partkey*7)%100 AS DOUBLE)/100 AS pad_x, CAST(40+(p_partkey*13)%90 AS DOUBLE)/100 AS pad_y,
  CAST(300+(p_partkey*11)%200 AS DOUBLE)/100 AS center_x, CAST(320 AS DOUBLE)/100 AS center_y,
  CAST(65 AS DOUBLE)/100 AS pitch_x, CAST(95+(p_partkey%3)*30 AS DOUBLE)/100 AS pitch_y, CAST(150 AS DOUBLE)/100 AS tab_x, CAST(120 AS DOUBLE)/100 AS tab_y,
  CAST(200+(p_partkey*11)%200 AS DOUBLE)/100 AS body_x, CAST(CASE WHEN p_partkey%7=0 THEN 0 ELSE 180 END AS DOUBLE)/100 AS body_y,
  2 AS small_pad_count, 3 AS tab_pad_number, 3 AS dual_left_count, CAST(2+p_partkey%2 AS INT) AS dual_right_count,
  4 AS quad_left_count, 4 AS quad_right_count, CAST(CASE WHEN p_partkey%12=5 THEN 4 ELSE 0 END AS INT) AS quad_top_count, CAST(CASE WHEN p_partkey%12=5 THEN 4 ELSE 0 END AS INT) AS quad_bottom_count
FROM {part}"""

RECORD = """
SELECT CAST(o_orderkey AS STRING) AS record_id, CAST(o_orderkey AS BIGINT) AS document_index, o_custkey AS doc_id,
  CASE WHEN o_orderkey%7=0 THEN 'no_page_candidate' WHEN o_orderkey%5=0 THEN 'partial_auto' WHEN o_orderkey%3=0 THEN 'family_review_required' ELSE 'candidate_ready_for_review' END AS status,
  substr(o_orderpriority, 1, 1) AS tier, CAST(o_totalprice AS DOUBLE) AS price, o_orderdate AS created
FROM {orders}"""

DOCUMENT = "SELECT doc_id, concat('/corpus/', source, '/', CAST(doc_id AS STRING), '.pdf') AS path, text, source, lang FROM {documents}"


#: A value of hundredths that differs from part to part: ``h`` and a multiple ``k`` of the part's own step.
HUNDREDTHS = "(t.h + t.k * ((p_partkey * 7) % 50))"
VALUE = f"concat(CAST(CAST(floor({HUNDREDTHS} / 100) AS BIGINT) AS STRING), '.', lpad(CAST({HUNDREDTHS} % 100 AS STRING), 2, '0'))"
COLUMNS = ("v", "ord", "symbol", "role", "belongs_to", "endpoints", "note", "h", "k")


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], columns: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


def variants(rows: list[tuple], modulus: int) -> str:
    """Dimension rows by ``COLUMNS`` for every part whose key leaves the remainder ``v``; the raw text is the value and the note."""
    return f"""SELECT p_partkey AS doc_id, t.ord, t.symbol, t.role, t.belongs_to, t.endpoints, 'mm' AS unit, {VALUE} AS value, concat({VALUE}, t.note) AS raw
FROM {{part}} JOIN {values(rows, COLUMNS)} ON p_partkey % {modulus} = t.v"""


def expected(rows: list[tuple], columns: tuple[str, ...], modulus: int) -> str:
    """What a query must give for each part of a variant, by hand: columns ``h`` and ``k`` are there for ``HUNDREDTHS``."""
    return f"(SELECT p_partkey AS doc_id, t.*, (p_partkey * 7) % 50 AS m FROM part JOIN {values(rows, ('v', *columns))} ON p_partkey % {modulus} = t.v)"


#: Tables whose rows turn into many: a file of a few row groups gives as many tasks, whatever the cores.
SPREAD = {"part": "p_partkey"}
#: Rows of such a table that one task gets, about: what it makes of them is held in memory by aggregates and joins.
ROWS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; those of ``SPREAD`` are dealt by key over tasks for all cores, and more tasks the more rows there are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in SPREAD:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, df.count() // ROWS), SPREAD[name])


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derived table ``sql`` over the Parquet tables of ``sf_dir``."""
    ship(spark)
    tables = {f for _, f, _, _ in string.Formatter().parse(sql) if f}
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def duck(sql: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    return sql.format(**{f: f for _, f, _, _ in string.Formatter().parse(sql) if f})
