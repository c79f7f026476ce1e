"""The stored tables of the engine as views over the given tables.

``VIEWS`` is plain SQL that Spark and DuckDB both run; names in braces are tables or
earlier views. ``Tables`` gives them as DataFrames, ``with_views`` as one SQL statement.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "docentes": """
        SELECT CAST(s_suppkey AS BIGINT) AS id, concat(lower(r_name), '@example.org') AS propietario_email,
               concat('cv-', CAST(s_suppkey AS VARCHAR(20))) AS drive_file_id, s_name AS nombre,
               CASE WHEN s_acctbal < 3000 THEN NULL WHEN s_acctbal < 6000 THEN 'Magister' ELSE 'Doctor' END AS grado
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """,
    "cursos": """
        SELECT CAST(c_custkey AS BIGINT) AS id, concat(lower(r_name), '@example.org') AS propietario_email,
               concat('sil-', CAST(c_custkey AS VARCHAR(20))) AS drive_file_id, c_name AS nombre,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 10 + 1 AS INT) END AS ciclo
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """,
    "nodos": """
        SELECT 'root' AS id, CAST(NULL AS VARCHAR(80)) AS parent_id, 'Catalog' AS name, 'root' AS node_type
        UNION ALL SELECT DISTINCT p_type, 'root', p_type, 'branch' FROM {part}
        UNION ALL SELECT DISTINCT concat(p_type, '/', p_brand), p_type, p_brand, 'leaf' FROM {part}
    """,
    "evidencias": """
        SELECT CAST(l_suppkey AS BIGINT) AS docente_id, CAST(o_custkey AS BIGINT) AS curso_id,
               concat(p_type, '/', p_brand) AS nodo_id, l_orderkey AS seq, l_linenumber AS semana,
               concat(p_name, ' ', l_returnflag) AS texto, l_returnflag <> 'R' AS explicito,
               CASE WHEN l_linestatus = 'O' THEN CAST(year(l_shipdate) AS VARCHAR(4)) END AS recencia,
               CAST(l_quantity AS DECIMAL(18,4)) AS peso
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey
    """,
    "docente_nodos": """
        SELECT docente_id, nodo_id, CAST(count(*) AS DECIMAL(18,4)) AS peso, bool_and(explicito) AS explicito, max(recencia) AS recencia
        FROM {evidencias} GROUP BY docente_id, nodo_id
    """,
    "curso_nodos": """
        SELECT curso_id, nodo_id, CAST(count(DISTINCT semana) AS DECIMAL(18,4)) AS peso_centralidad
        FROM {evidencias} GROUP BY curso_id, nodo_id
    """,
    "historial_cargas": """
        SELECT s_name AS nombre_docente, c_name AS nombre_curso, l_orderkey AS seq,
               concat(CAST(year(o_orderdate) AS VARCHAR(4)), CASE WHEN month(o_orderdate) <= 6 THEN '-I' ELSE '-II' END) AS periodo
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {customer} ON o_custkey = c_custkey
    """,
    "recomendaciones": """
        SELECT o_orderkey AS id, o_orderpriority AS propietario_email, CAST(o_custkey AS BIGINT) AS curso_id,
               CAST(o_orderkey % 120 AS BIGINT) AS docente_id, o_totalprice AS score, o_orderdate AS created_at, o_orderstatus <> 'P' AS is_valid
        FROM {orders}
    """,
    "recomendaciones_cache": """
        SELECT o_orderkey AS id, o_orderpriority AS propietario_email, CAST(o_custkey AS BIGINT) AS curso_id,
               CAST(o_orderkey % 120 AS BIGINT) AS docente_id, o_totalprice AS score_combinado,
               CASE WHEN o_orderkey % 50 = 0 THEN 'legacy_v1.0' ELSE 'node_taxonomy_v1.0' END AS version_algoritmo, o_orderdate AS fecha_generada
        FROM {orders}
    """,
    "webhook_logs": """
        SELECT event_id AS id, concat('tenant', CAST(user_id % 5 AS VARCHAR(4)), '@example.org') AS propietario_email,
               concat('file-', CAST(user_id AS VARCHAR(20))) AS drive_file_id,
               CASE event_id % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS evento_tipo,
               CASE user_id % 3 WHEN 0 THEN 'CV' WHEN 1 THEN 'SILABO' ELSE 'HORARIO' END AS entidad,
               CASE event_type WHEN 'signup' THEN 'received' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               ts AS "timestamp", ts AS updated_at
        FROM {events}
    """,
    "colaboradores": """
        SELECT DISTINCT concat('tenant', CAST(user_id % 5 AS VARCHAR(4)), '@example.org') AS propietario_email,
               concat('guest', CAST(user_id % 11 AS VARCHAR(4)), '@example.org') AS invitado_email FROM {events}
    """,
    "entidades_crudas": """
        SELECT doc_id, p.pos AS pos, concat(split_part(text, ' ', p.pos), ' ', split_part(text, ' ', p.pos + 1)) AS entidad
        FROM {documents} CROSS JOIN (VALUES (1), (2), (3), (5), (8), (13), (21), (34)) p(pos)
        UNION ALL
        SELECT doc_id, v.pos, v.entidad
        FROM {documents} CROSS JOIN (VALUES (101, 'Ingeniería de Software'), (102, 'Python (inferido)'), (103, 'Profesor de Redes'),
             (104, 'PYTHON'), (105, ' Bases de datos  '), (106, ''), (107, 'Doctorado en Física')) v(pos, entidad)
        WHERE doc_id % 3 = v.pos % 3
    """,
    "archivos": """
        SELECT page_id AS id, split_part(url, '/', 3) AS carpeta_raiz, split_part(url, '/', 4) AS subcarpeta,
               split_part(url, '/', 5) AS name, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE 'text/plain' END AS mime_type,
               CAST(length(html) AS BIGINT) AS size FROM {pages}
    """,
}


def raw_entities(documents: DataFrame) -> DataFrame:
    """The view ``entidades_crudas`` with each text read once and cut once, into no more words than it asks for."""
    words = documents.select("doc_id", F.split("text", " ", 36).alias("words"))

    def entity(pos: int, text: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), text.alias("entidad"))

    def word(n: int) -> Column:
        return F.when(F.col("words").isNotNull(), F.coalesce(F.try_element_at("words", F.lit(n)), F.lit("")))

    own = F.array(*[entity(n, F.concat(word(n), F.lit(" "), word(n + 1))) for n in (1, 2, 3, 5, 8, 13, 21, 34)])
    given = {101: "Ingeniería de Software", 102: "Python (inferido)", 103: "Profesor de Redes", 104: "PYTHON", 105: " Bases de datos  ", 106: "", 107: "Doctorado en Física"}
    same = [F.when(F.col("doc_id") % 3 == r, F.array(*[entity(n, F.lit(x)) for n, x in given.items() if n % 3 == r])) for r in range(3)]
    none = F.array().cast("array<struct<pos:int,entidad:string>>")
    return words.select("doc_id", F.explode(F.concat(own, F.coalesce(*same, none))).alias("x")).select("doc_id", "x.pos", "x.entidad")


#: Views that group all evidence, and by what.
GROUPED = {"docente_nodos": ("docente_id", "nodo_id"), "curso_nodos": ("curso_id", "nodo_id")}
#: Lines of evidence in a part that is grouped.
PART = 1 << 18


def deal(evidence: DataFrame, key: tuple[str, ...], lines: int) -> DataFrame:
    """Evidence in parts of about ``PART`` of the lines, so that it is grouped there by one shuffle
    and not by one more task memory beside the join that it comes from."""
    return evidence.repartition(max(-(-lines // PART), evidence.sparkSession.sparkContext.defaultParallelism), *key)


class Tables:
    """The views over one folder of tables, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "entidades_crudas":
            return raw_entities(self.documents)
        sql = VIEWS[name].replace('"timestamp"', "`timestamp`")
        needed = {t: getattr(self, t) for t in sorted(set(re.findall(r"\{(\w+)\}", sql)))}
        if name in GROUPED:
            needed["evidencias"] = deal(needed["evidencias"], GROUPED[name], self.lineitem.count())
        return self.spark.sql(sql, **needed)


def with_views(sql: str) -> str:
    """A SQL statement that begins with the views it needs; names of views are in braces."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    plain = re.compile(r"\{(\w+)\}")
    views = ", ".join(f"{v} AS ({plain.sub(r'\1', VIEWS[v])})" for v in needed)
    body = plain.sub(r"\1", sql).strip()
    if not needed:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{views}, {body[len(head):]}"
    return f"WITH {views} {body}"
