"""Package graphs, source trees and version lists derived from the star-schema tables.

The same text runs in Spark and in the oracle: ``{table}`` stands for a Parquet path in one and a table in the other,
``{explode}`` for the function that makes rows of an array. Every view reads all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The expressions that groups of the derived tree carry, by number of the group; the twelfth has none.
EXPRESSIONS = [
    "view", "not(view)", "all(view, click)", "any(view, click)", "all(view, not(error))", "any(signup, all(click, purchase))",
    "not(any(error, signup))", "purchase", "all(any(view, error), not(purchase))", "not(all(click, signup))", "any(not(view), not(click))",
]

_CASE = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXPRESSIONS))

VIEWS = {
    "edge": "SELECT src, dst, min(pos) AS pos FROM (SELECT s_suppkey AS src, CAST(floor(s_suppkey / 2) AS BIGINT) AS dst, 0 AS pos FROM {supplier} UNION ALL SELECT s_suppkey, CAST(floor(s_suppkey / 3) AS BIGINT), 1 FROM {supplier}) e WHERE src > 0 AND dst < src GROUP BY src, dst",
    "pkg": "SELECT s_suppkey AS id, 'pkg_' || CAST(s_suppkey AS STRING) AS name, s_suppkey % 5 AS kind FROM {supplier}",
    "tag": "SELECT DISTINCT l_suppkey AS pkg, CAST(p_size % 3 AS BIGINT) AS major, CAST(p_size AS BIGINT) AS minor, p_partkey % 10 AS patch, md5(CAST(p_partkey AS STRING)) AS rev, p_partkey AS part FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "req": "SELECT src, dst, pos, CASE src % 8 WHEN 0 THEN '1' WHEN 1 THEN '^1.10.0' WHEN 2 THEN '~1.22' WHEN 3 THEN '>=1.0.0, <2.0.0' WHEN 4 THEN '2' WHEN 5 THEN '<1.20' WHEN 6 THEN '>0.9.1' ELSE '*' END AS req FROM edge",
    "file": "SELECT source AS pkg, doc_id AS id, CAST(floor(doc_id / 4) AS BIGINT) AS grp, doc_id % 4 AS pos, source || '/' || CAST(doc_id AS STRING) || CASE lang WHEN 'en' THEN '.sv' WHEN 'de' THEN '.v' WHEN 'fr' THEN '.vhd' ELSE '.txt' END AS path FROM {documents}",
    "tree": f"SELECT doc_id AS node, CASE WHEN doc_id = 0 THEN NULL ELSE CAST(floor(doc_id / 4) AS BIGINT) END AS parent, doc_id % 4 AS pos, source AS pkg, CASE doc_id % 12 {_CASE} END AS target FROM {{documents}}",
    "active": "SELECT user_id * 16 + event_id % 16 AS user_id, event_type AS t, min(event_id) AS pos FROM {events} GROUP BY user_id * 16 + event_id % 16, event_type",
    "layer": "SELECT c_nationkey AS layer, c_mktsegment AS k, min(c_name) AS v FROM {customer} GROUP BY c_nationkey, c_mktsegment",
    "defn": "SELECT user_id AS grp, event_id AS pos, 'K' || CAST(event_id % 9 AS STRING) AS name, CASE WHEN event_id % 5 = 0 THEN NULL ELSE regexp_extract(props, '([0-9]+)', 1) END AS value FROM {events}",
    "decl": "SELECT page_id AS idx, regexp_extract(html, 'href=\"/([^\"]+)\"', 1) AS name FROM {pages} WHERE regexp_extract(html, 'href=\"/([^\"]+)\"', 1) <> ''",
    "ref": "SELECT DISTINCT page_id AS idx, {explode}(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS name FROM {pages}",
    "line": "SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'Receiving objects: ' || CAST(user_id % 101 AS STRING) || '% (1/9)' WHEN 1 THEN 'Resolving deltas: ' || CAST(user_id % 101 AS STRING) || '% (1/9), done.' WHEN 2 THEN 'Cloning into ''' || event_type || '''...' WHEN 3 THEN 'Submodule ''libs/' || event_type || ''' (u) registered for path ''libs/' || event_type || '''' WHEN 4 THEN 'Submodule path ''libs/' || event_type || ''': checked out ''abc''' WHEN 5 THEN 'fatal: ' || event_type || ' failed' WHEN 6 THEN 'remote: Counting objects' ELSE '' END AS line FROM {events}",
}
NEEDS = {"req": ["edge"]}


def sql(view: str, tables: dict[str, str]) -> str:
    return VIEWS[view].format(**tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables in ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | {"explode": "explode"}
    heads = [f"{n} AS ({sql(n, tables)})" for n in NEEDS.get(name, [])]
    return spark.sql(("WITH " + ", ".join(heads) + " " if heads else "") + sql(name, tables))


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the views it names, as one statement for the oracle."""
    tables = {t: t for t in TABLES} | {"explode": "unnest"}
    order = list(dict.fromkeys(n for name in names for n in [*NEEDS.get(name, []), name]))
    heads = ", ".join(f"{n} AS ({sql(n, tables)})" for n in order)
    body = body.strip()
    if not heads:
        return body
    word = "WITH RECURSIVE " if recursive else "WITH "
    return f"{word}{heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"{word}{heads} {body}"
