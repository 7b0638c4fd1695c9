"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ------------------------------------------- the adapters, as SQL fragments

EV = """ev AS (
  SELECT event_id AS seq, ts, user_id, 'u' || user_id AS name, 'ns' || (user_id % 10) AS ns,
         '/api/v1/namespaces/ns' || (user_id % 10) || '/widgets' AS path,
         CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' ELSE 'MODIFIED' END AS typ,
         value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""

DAILY = """daily AS (
  SELECT user_id, '/api/v1/namespaces/ns' || (user_id % 10) || '/sessions' AS path,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq,
         arg_max(value, event_id) AS value
  FROM events GROUP BY ALL)"""

POD = """pod0 AS (
  SELECT *, CAST(l_quantity AS INT) AS q, 'ns' || (l_suppkey % 25) AS ns,
         substr(sha256(l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber), 1, 6) AS h
  FROM lineitem), pod1 AS (
  SELECT *, 'app-o' || (l_orderkey % 500) || '-' || h AS name, 'rs-' || (l_orderkey % 500) AS owner,
         '/api/v1/namespaces/' || ns || '/pods' AS path,
         CASE WHEN q % 10 = 0 THEN 'Pending' WHEN q % 10 = 1 THEN 'Failed' WHEN q % 17 = 2 THEN 'Unknown'
              ELSE 'Running' END AS phase,
         CASE l_returnflag WHEN 'R' THEN 'CrashLoopBackOff' WHEN 'A' THEN 'Error' END AS main_issue,
         CASE WHEN l_linenumber % 4 = 0 AND q % 7 = 0 THEN 'OOMKilled' END AS init_issue,
         1 + CAST(l_linenumber % 3 = 0 AS INT) + CAST(l_linenumber % 4 = 0 AS INT) AS total,
         CAST(l_linestatus = 'O' AS INT) + CAST(l_linenumber % 3 = 0 AS INT) AS ready, q % 5 AS restarts
  FROM pod0), pod AS (
  SELECT *, CASE WHEN phase IN ('Failed', 'Unknown') THEN phase END AS phase_issue FROM pod1), podi AS (
  SELECT *, concat_ws(',', phase_issue, init_issue, main_issue) AS issues,
         COALESCE(phase_issue, init_issue, main_issue) AS first_issue FROM pod)"""

WORK = """work AS (
  SELECT *, CASE p_type WHEN 'STANDARD' THEN 'deployments' WHEN 'ECONOMY' THEN 'statefulsets'
         WHEN 'MEDIUM' THEN 'daemonsets' WHEN 'PROMO' THEN 'jobs' WHEN 'LARGE' THEN 'replicasets' ELSE 'cronjobs' END AS resource,
         'ns' || (p_partkey % 25) AS ns, 'w' || p_partkey AS name, p_partkey % (p_size + 3) AS have,
         CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS replicas
  FROM part)"""

AT = "2024-01-15 00:00:00"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"
