"""Layout, image and result tables, derived from the given tables.

Each view is one SQL text that Spark and DuckDB read alike; names in braces are
the tables it needs. All rows of those tables take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # rectangles of a layout, in nm; at most 220 wide and 216 high, on an area that grows with them
    "shapes": """
        SELECT 10 + l_linenumber % 4 AS layer,
          CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS datatype,
          (l_orderkey * 7919 + l_linenumber * 104729) % {SIDE} AS x1,
          (l_partkey * 6151 + l_suppkey * 3571 + l_linenumber * 15486) % {SIDE} AS y1,
          (l_orderkey * 7919 + l_linenumber * 104729) % {SIDE} + 20 + CAST(l_quantity AS BIGINT) * 4 AS x2,
          (l_partkey * 6151 + l_suppkey * 3571 + l_linenumber * 15486) % {SIDE} + 20 + (l_partkey % 50) * 4 AS y2
        FROM {lineitem}""",
    # images: defect position in nm, page counts, size in pixels
    "images": """
        SELECT event_id AS image_id, (event_id * 7919) % {SIDE} AS xrel, (user_id * 6151 + event_id * 31) % {SIDE} AS yrel,
          event_type <> 'signup' AS has_coords, 100 + user_id % 900 AS width_px, CAST(floor(value) AS BIGINT) % 4 AS n_pages,
          event_type AS kind, event_id AS rec_no
        FROM {events}""",
    # match results; images of kind 'view' have none yet
    "refined": """
        SELECT event_id AS image_id, CAST(user_id % 41 - 20 AS DOUBLE) / 4 AS dx_nm, CAST(event_id % 37 - 18 AS DOUBLE) / 4 AS dy_nm,
          CASE WHEN value > 100 THEN 1.0 ELSE value / 100 END AS score
        FROM {events} WHERE event_type <> 'view'""",
    # a second run over the same images, for keep-if-better
    "rerun": """
        SELECT event_id AS image_id, CAST(event_id % 29 - 14 AS DOUBLE) / 4 AS dx_nm, CAST(user_id % 31 - 15 AS DOUBLE) / 4 AS dy_nm,
          CASE WHEN event_type = 'error' THEN NULL WHEN value > 50 THEN 1.0 ELSE value / 50 END AS score
        FROM {events} WHERE event_type <> 'click'""",
    # the cell graph: chip, regions, nations, leaf cells shared by many placements
    "placement": """
        SELECT CAST(0 AS BIGINT) AS parent, CAST(100 + r_regionkey AS BIGINT) AS child, CAST(r_regionkey * 1000000 AS BIGINT) AS x,
          CAST(0 AS BIGINT) AS y, CAST(r_regionkey % 4 AS INT) AS q, false AS flip FROM {region}
        UNION ALL SELECT CAST(100 + n_regionkey AS BIGINT), CAST(1000 + n_nationkey AS BIGINT), CAST(n_nationkey * 30000 AS BIGINT),
          CAST((n_nationkey % 5) * 40000 AS BIGINT), CAST(n_nationkey % 4 AS INT), n_nationkey % 2 = 1 FROM {nation}
        UNION ALL SELECT CAST(1000 + c_nationkey AS BIGINT), CAST(1000000 + c_custkey % {LEAVES} AS BIGINT), CAST((c_custkey % 97) * 2000 AS BIGINT),
          CAST((c_custkey % 89) * 2000 AS BIGINT), CAST(c_custkey % 4 AS INT), c_custkey % 3 = 0 FROM {customer}""",
    # rectangles of the leaf cells; cells that nothing places are roots of their own
    "cell_rect": """
        SELECT CAST(1000000 + o_custkey % {LEAVES} AS BIGINT) AS cell_id, 10 + o_orderkey % 4 AS layer, o_orderkey % 3 AS datatype, (o_orderkey * 37) % 1900 AS x1, (o_orderkey * 53) % 1900 AS y1,
          (o_orderkey * 37) % 1900 + 10 + o_orderkey % 40 AS x2, (o_orderkey * 53) % 1900 + 10 + o_orderkey % 30 AS y2
        FROM {orders}""",
    # the same graph with arrays: some steps across each other, some not taken
    "placement_arrays": """
        SELECT p.*, CAST(1 + CAST(floor(x / 2000e0) AS BIGINT) % 4 AS BIGINT) AS nx, CAST(1 + CAST(floor(y / 2000e0) AS BIGINT) % 3 AS BIGINT) AS ny, CAST(CASE WHEN parent < 1000 THEN 400000 ELSE 2500 END AS BIGINT) AS vx,
          CAST(CAST(floor(x / 2000e0) AS BIGINT) % 2 * 300 AS BIGINT) AS vy, CAST(CAST(floor(y / 2000e0) AS BIGINT) % 2 * -200 AS BIGINT) AS wx, CAST(CASE WHEN parent < 1000 THEN 300000 ELSE 3100 END AS BIGINT) AS wy
        FROM ({placement_sql}) p""",
    # rectangles of the leaf cells, as arrays
    "rect_arrays": """
        SELECT r.*, CAST(1 + x1 % 5 AS BIGINT) AS nx, CAST(1 + y1 % 3 AS BIGINT) AS ny, CAST(60 + x1 % 7 AS BIGINT) AS vx, CAST(x1 % 3 AS BIGINT) AS vy, CAST(0 AS BIGINT) AS wx, CAST(55 AS BIGINT) AS wy
        FROM ({cell_rect_sql}) r""",
    # array descriptors: nx by ny steps along two vectors, base box and query box
    "arrays": """
        SELECT p_partkey AS rep_id, CAST(1 + p_size % 9 AS BIGINT) AS nx, CAST(1 + p_partkey % 7 AS BIGINT) AS ny, CAST(20 + p_size AS BIGINT) AS vx,
          CAST(p_partkey % 3 AS BIGINT) AS vy, CAST(p_size % 2 AS BIGINT) AS wx, CAST(30 + p_partkey % 11 AS BIGINT) AS wy,
          CAST((p_partkey * 13) % 100 AS BIGINT) AS x1, CAST((p_partkey * 17) % 100 AS BIGINT) AS y1, CAST((p_partkey * 13) % 100 + 9 AS BIGINT) AS x2,
          CAST((p_partkey * 17) % 100 + 12 AS BIGINT) AS y2, CAST((p_partkey * 7) % 150 AS BIGINT) AS qx1, CAST((p_partkey * 11) % 150 AS BIGINT) AS qy1
        FROM {part}""",
    # named intervals of layers and datatypes; a null end is open
    "layer_names": """
        SELECT p_name || '-' || CAST(p_partkey AS VARCHAR(20)) AS name, p_partkey AS rec_no, CAST(10 + p_partkey % 5 AS INT) AS l_lo,
          CASE WHEN p_size > 45 THEN NULL ELSE CAST(10 + p_partkey % 5 + p_size % 4 AS INT) END AS l_hi, CAST(p_size % 3 AS INT) AS d_lo,
          CASE WHEN p_size > 40 THEN NULL ELSE CAST(p_size % 3 + p_partkey % 2 AS INT) END AS d_hi
        FROM {part}""",
    # squares that stand on a corner, about 25 to a group, each group on its own ground
    "diamonds": """
        SELECT CAST(l_orderkey % {GROUPS} AS BIGINT) AS g, CAST(10 + l_linenumber % 3 AS INT) AS layer, CAST((l_partkey * 13) % 400 AS BIGINT) AS cx, CAST((l_suppkey * 29 + l_linenumber * 71) % 400 AS BIGINT) AS cy,
          CAST(20 + CAST(l_quantity AS BIGINT) * 2 AS BIGINT) AS r
        FROM {lineitem}""",
    # timed operations
    "perf_events": """
        SELECT event_id AS seq, event_type || ':' || CAST(user_id % 7 AS VARCHAR(20)) AS op, event_type AS label, CAST(round(value * 100) AS BIGINT) AS us,
          CASE WHEN event_type = 'error' THEN 'warn' ELSE 'info' END AS level, ts
        FROM {events}""",
    # labels of layers by customer, some badly named
    "label_map": """
        SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN '9' ELSE '' END || lower(replace(c_mktsegment, ' ', '_'))
          || CASE WHEN c_acctbal > 9000 THEN '-x' ELSE '' END || CAST(c_custkey % 40 AS VARCHAR(20)) AS layer
        FROM {customer}""",
    # cells of a file: their byte offsets
    "cell_index": """
        SELECT o_orderkey AS cell_id, o_orderkey * 4096 + o_custkey % 4096 AS byte_offset FROM {orders}""",
    # parts and the chips on them
    "chips": """
        SELECT n_nationkey AS part_id, s_suppkey AS chip_id, CAST(s_suppkey % 50 AS DOUBLE) * 100 AS chip_x_um, CAST(s_suppkey % 40 AS DOUBLE) * 100 AS chip_y_um,
          CAST(s_suppkey % 9 AS DOUBLE) AS gds_off_x_um, CAST(s_suppkey % 7 AS DOUBLE) AS gds_off_y_um,
          CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(1 + s_suppkey % 4 AS DOUBLE) END AS nm_per_px, CAST(1000 + s_suppkey % 1000 AS DOUBLE) AS fov_w_nm
        FROM {nation} JOIN {supplier} ON n_nationkey = s_nationkey""",
}

for _name in ("placement", "cell_rect"):
    for _other, _text in VIEWS.items():
        VIEWS[_other] = _text.replace(f"{{{_name}_sql}}", VIEWS[_name])
#: What grows with the tables: the side of the layout in nm, and the number of leaf cells.
_SIZES = {
    "{SIDE}": "(SELECT CAST(ceil(sqrt(count(*)) * 400) AS BIGINT) FROM {lineitem})",
    "{GROUPS}": "(SELECT CAST(floor(count(*) / 25) AS BIGINT) + 1 FROM {lineitem})",
    "{LEAVES}": "(SELECT CAST(floor(count(*) / 30) AS BIGINT) + 1 FROM {orders})",
}


def tables_of(text: str) -> set[str]:
    """The tables that a text needs, without those for sizes."""
    return set(re.findall(r"\{([a-z]+)\}", text))


def _from_tables(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in ``sf_dir``; what grows with them is counted first, from footers."""
    text = VIEWS[name]
    for size, value in _SIZES.items():
        if size in text:
            text = text.replace(size, str(_from_tables(spark, sf_dir, f"SELECT {value} AS n").first().n))
    return _from_tables(spark, sf_dir, text)


def live_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over its one table, read as a stream of files."""
    (table,) = tables_of(VIEWS[name])
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a pattern, as a stream takes a plain path for a folder and a table may be one file
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")
    return spark.sql(VIEWS[name], **{table: rows})


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: the views as common tables in front of ``sql``."""
    texts = {n: VIEWS[n] for n in names}
    for size, value in _SIZES.items():
        texts = {n: text.replace(size, value) for n, text in texts.items()}
    common = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', text)})" for n, text in texts.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{common}{', ' if sql.startswith('+') else ' '}{sql.removeprefix('+')}"
