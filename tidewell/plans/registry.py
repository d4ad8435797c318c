"""The list of named queries; modules of this package add theirs by decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The canonical event stream in SQL, as sources.events.syscalls() makes it.
SYSC = """e AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id AS pid, event_type AS t, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
s AS (SELECT seq, ts_ns, pid, t, value, k, 3 + k % 3 AS fd,
  CASE t WHEN 'signup' THEN 'execute' WHEN 'view' THEN 'open'
         WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'read' ELSE 'write' END
         WHEN 'purchase' THEN 'close'
         ELSE CASE WHEN k % 10 = 0 THEN 'exit' ELSE 'connect' END END AS op,
  CASE WHEN t = 'view' THEN '/data/f' || (k % 20) END AS path,
  CASE WHEN t = 'view' THEN CASE k % 4 WHEN 0 THEN 'openr' WHEN 1 THEN 'openw' WHEN 2 THEN 'openrw' ELSE '' END END AS hint,
  CAST(floor(value) AS BIGINT) AS bytes, '/bin/b' || (k % 7) AS binary_, '10.0.0.' || (k % 16) AS ip, '10.0.0.' || (k % 16) || ':' || (80 + k % 3) AS peer,
  t || '_' || (k % 5) AS name, 'c' || (pid % 10) AS container_id, 'ns' || (pid % 4) AS namespace, 1 + k % 4 AS severity
  FROM e)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` starts after WITH and SYSC, unless it starts with SELECT or WITH itself."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            text = sql.strip()
            ORACLES[key] = text if text.upper().startswith(("SELECT", "WITH")) else f"WITH {SYSC}, {text}"
        return f

    return add


def plain(sql: str) -> str:
    """A single SELECT over the canonical stream `s`."""
    return f"WITH {SYSC} {sql.strip()}"
