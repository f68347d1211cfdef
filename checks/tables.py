"""The canonical tables once more, as SQL over the given tables.

``with_tables("items", "finds")`` gives the WITH clause that the check
statements start from; it pulls in whatever those tables need.
"""

from __future__ import annotations

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "items": (
        (),
        """SELECT p_partkey AS item_id, concat('GC', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS code,
 p_name AS title, concat(p_name, ' ', lower(p_type), ' near ', p_brand) AS description, p_brand AS owner,
 lower(p_type) AS type_code,
 CASE WHEN p_size<=10 THEN 'M' WHEN p_size<=20 THEN 'S' WHEN p_size<=30 THEN 'R' WHEN p_size<=40 THEN 'L' ELSE 'O' END AS size_code,
 CAST(1.0 + 0.5*(p_size % 9) AS DOUBLE) AS difficulty, CAST(1.0 + 0.5*(p_partkey % 9) AS DOUBLE) AS terrain,
 CAST(39850 + ((p_partkey*7919) % 10300) AS DOUBLE)/CAST(1000 AS DOUBLE) AS lat,
 CAST(((p_partkey*10477) % 10300) - 150 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lon,
 CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS elevation,
 CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE CAST(p_partkey % 25 AS INT) END AS country_id,
 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(4*(p_partkey % 25) + p_partkey % 4 AS INT) END AS state_id,
 CAST(p_partkey % 500 AS INT) AS favorites,
 CASE WHEN p_partkey % 20 = 0 THEN 'archived' WHEN p_partkey % 20 = 1 THEN 'disabled' WHEN p_partkey % 20 = 2 THEN NULL ELSE 'active' END AS status,
 CAST(DATE '2000-01-01' + CAST((p_partkey*37) % 7000 AS INT) AS DATE) AS placed_at
 FROM part""",
    ),
    "item_attributes": (
        (),
        """SELECT p_partkey AS item_id, CAST(p_size % 7 AS INT) AS attr_id, true AS is_positive FROM part
 UNION ALL SELECT p_partkey, CAST(7 + p_partkey % 5 AS INT), p_partkey % 2 = 0 FROM part
 UNION ALL SELECT p_partkey, 71, true FROM part WHERE p_partkey % 40 = 3""",
    ),
    "item_types": (
        (),
        """SELECT type_code, concat(upper(substr(type_code,1,1)), substr(type_code,2)) AS name,
 CAST(row_number() OVER (ORDER BY type_code) - 1 AS INT) AS sort_order
 FROM (SELECT DISTINCT lower(p_type) AS type_code FROM part UNION SELECT 'webcam' UNION SELECT 'wherigo')""",
    ),
    "item_sizes": (
        (),
        """SELECT * FROM (VALUES ('M','Micro',1),('S','Small',2),('R','Regular',3),('L','Large',4),('O','Other',5)) v(size_code, name, sort_order)""",
    ),
    "countries": ((), "SELECT n_nationkey AS country_id, n_name AS name FROM nation"),
    "states": (
        (),
        """SELECT CAST(4*n_nationkey + i AS INT) AS state_id, concat('State ', i) AS name, n_nationkey AS country_id
 FROM nation, (SELECT unnest(range(0,4)) AS i)""",
    ),
    "users": (
        (),
        """SELECT c_custkey AS user_id, c_name AS username,
 CAST(41 + 2*(c_nationkey // 5) AS DOUBLE) AS home_lat, CAST(2*(c_nationkey % 5) + 1 AS DOUBLE) AS home_lon,
 CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS DATE) AS created_at,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(DATE '2001-06-01' + CAST(c_custkey % 90 AS INT) AS DATE) END AS last_import_at,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(DATE '2001-07-01' + CAST(c_custkey % 45 AS INT) AS DATE) END AS last_evaluated_at
 FROM customer""",
    ),
    "finds": (
        (),
        """SELECT o_custkey AS user_id, l_partkey AS item_id, min(CAST(l_shipdate AS DATE)) AS found_date
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY o_custkey, l_partkey""",
    ),
    "team_finds": (
        ("finds",),
        """SELECT CAST(c_nationkey AS BIGINT) AS user_id, item_id, found_date FROM finds JOIN customer ON c_custkey = user_id""",
    ),
    "challenges": (
        (),
        "SELECT p_partkey AS challenge_id, p_partkey AS item_id, p_name AS name FROM part WHERE p_partkey % 40 = 3",
    ),
    "enrolments": (
        (),
        """SELECT user_id * 1000000000 + challenge_id AS uc_id, user_id, challenge_id, seed,
 CASE seed % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'accepted' ELSE 'dismissed' END AS status,
 CASE WHEN seed % 23 = 0 THEN 'completed' END AS computed_status,
 CASE WHEN seed % 6 = 0 THEN concat('note ', challenge_id) END AS notes,
 CAST(DATE '2001-01-01' + CAST((user_id*7 + challenge_id) % 300 AS INT) AS DATE) AS created_at,
 CAST(DATE '2001-02-01' + CAST((user_id*11 + challenge_id) % 300 AS INT) AS DATE) AS updated_at
 FROM (SELECT DISTINCT o_custkey AS user_id, l_partkey - l_partkey % 40 + 3 AS challenge_id, o_custkey * 7 + l_partkey // 40 AS seed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_partkey % 40 IN (3, 4))""",
    ),
    "tasks": (
        ("enrolments",),
        """SELECT task_id, uc_id, user_id, ord, title, rule_id, min_count, CASE WHEN task_id % 17 = 0 THEN 'done' ELSE 'todo' END AS status FROM (
 SELECT uc_id * 2 + ord AS task_id, uc_id, user_id, CAST(ord AS INT) AS ord,
 CASE WHEN seed % 3 = 0 THEN NULL ELSE concat('Rule ', ord) END AS title,
 CAST((seed + 5*ord) % 12 AS INT) AS rule_id,
 CAST(([3,2,2,1,2,1,1,0,5,0,0,4])[CAST((seed + 5*ord) % 12 AS INT) + 1] AS INT) AS min_count
 FROM enrolments, (SELECT unnest([0,1]) AS ord))""",
    ),
    "snapshots": (
        ("enrolments",),
        """SELECT uc_id, user_id, CAST(DATE '2001-03-01' + CAST(30*k + seed % 20 AS INT) AS DATE) AS checked_at,
 CAST(least(100, 20*k + seed % 25) AS DOUBLE) AS percent, CAST(least(2, k - 1) AS INT) AS tasks_done, 2 AS tasks_total
 FROM (SELECT uc_id, user_id, seed, unnest(range(1, CAST(seed % 5 AS INT) + 1)) AS k FROM enrolments WHERE seed % 5 > 0)""",
    ),
    "task_snapshots": (
        ("enrolments",),
        """SELECT uc_id, user_id, CAST(DATE '2001-03-01' + CAST(30*k + seed % 20 AS INT) AS DATE) AS checked_at, CAST(o AS INT) AS ord,
 uc_id * 2 + o AS task_id, CAST(k + o AS BIGINT) AS current_count, CAST(least(100, 15 * k + (seed + 11 * o) % 45) AS DOUBLE) AS percent
 FROM (SELECT uc_id, user_id, seed, unnest(range(1, CAST(seed % 5 AS INT) + 1)) AS k FROM enrolments WHERE seed % 5 > 0), range(2) t(o)""",
    ),
    "zones": (
        (),
        """SELECT concat('Z1-', r_regionkey) AS code, 1 AS level, r_name AS name, CAST(NULL AS VARCHAR) AS parent_code,
 CAST(2*r_regionkey AS DOUBLE) AS x0, CAST(40 AS DOUBLE) AS y0, CAST(2*r_regionkey+2 AS DOUBLE) AS x1, CAST(50 AS DOUBLE) AS y1 FROM region
 UNION ALL SELECT concat('Z2-', n_nationkey), 2, n_name, concat('Z1-', n_regionkey), CAST(2*(n_nationkey%5) AS DOUBLE),
 CAST(40+2*(n_nationkey//5) AS DOUBLE), CAST(2*(n_nationkey%5)+2 AS DOUBLE), CAST(42+2*(n_nationkey//5) AS DOUBLE) FROM nation""",
    ),
}


def with_tables(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH a AS (...), b AS (...)`` for the tables and all they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in TABLES[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({TABLES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
