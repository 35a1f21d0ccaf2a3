"""The same queries as ANSI SQL over the driver tables, for a second engine."""

from __future__ import annotations

import re

from fleetlens import schemas as S

# -- the catalog over the driver tables ---------------------------------------------

CTES: dict[str, str] = {
    "instances": """
        SELECT o_orderkey AS id,
               'user' || cast(o_custkey % 50 AS varchar) AS username,
               'db_' || cast(o_orderkey AS varchar) || '_x' AS db_name,
               cast(NULL AS varchar) AS e_group,
               o_orderstatus AS category,
               cast(o_orderdate AS date) AS creation_date,
               cast(NULL AS date) AS expiry_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'MYSQL' WHEN '2-HIGH' THEN 'PG'
                    WHEN '3-MEDIUM' THEN 'InfluxDB' WHEN '4-NOT SPECIFIED' THEN 'ORACLE'
                    ELSE 'MONGO' END AS db_type,
               cast(NULL AS int) AS db_size,
               cast(NULL AS int) AS no_connections,
               cast(NULL AS varchar) AS project,
               cast(NULL AS varchar) AS description,
               CASE WHEN o_orderkey % 13 <> 0
                    THEN '5.' || cast(o_custkey % 10 AS varchar) END AS version,
               cast(NULL AS varchar) AS master,
               cast(NULL AS varchar) AS slave,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    WHEN o_orderkey % 5 = 0
                    THEN 'host' || cast(o_custkey % 40 AS varchar)
                         || ',host' || cast(o_custkey % 40 + 40 AS varchar)
                    ELSE 'host' || cast(o_custkey % 40 AS varchar) END AS host,
               cast(NULL AS varchar) AS state,
               cast(NULL AS varchar) AS status
        FROM orders""",
    "attribute": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS instance_id,
               CASE WHEN l_linenumber = 1 THEN 'port'
                    ELSE 'attr' || cast(l_linenumber AS varchar) END AS name,
               cast(min(l_partkey) + 5000 AS varchar) AS value
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "volume": """
        SELECT l_orderkey * 1000000 + l_suppkey AS id, l_orderkey AS instance_id,
               '0755' AS file_mode, 'own' AS owner, 'grp' AS "group", 'nas' AS server,
               'rw,bg,hard' AS mount_options,
               '/MNT/data' || cast(min(l_linenumber) AS varchar) AS mounting_path
        FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "host": """
        SELECT s_suppkey AS id, 'host' || cast(s_suppkey AS varchar) AS name,
               cast(floor(abs(s_acctbal)) AS int) AS memory
        FROM supplier""",
    "functional_aliases": """
        SELECT 'dns-' || lpad(cast(p_partkey AS varchar), 8, '0') AS dns_name,
               CASE WHEN p_partkey % 3 = 0 THEN NULL
                    WHEN p_partkey % 7 = 0
                    THEN 'db_' || cast(p_partkey - 1 AS varchar) || '_x'
                    ELSE 'db_' || cast(p_partkey AS varchar) || '_x' END AS db_name,
               CASE WHEN p_partkey % 3 <> 0
                    THEN 'alias-' || cast(p_partkey AS varchar) END AS alias
        FROM part""",
    "jobs": """
        SELECT 'user' || cast(o_custkey % 50 AS varchar) AS username,
               'db_' || cast(o_custkey AS varchar) || '_x' AS db_name,
               o_orderpriority AS command_name, o_orderstatus AS type,
               cast(o_orderdate AS date) AS creation_date,
               CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL
                    ELSE cast(l_shipdate AS date) END AS completion_date,
               'req' AS requester, 0 AS admin_action, l_returnflag AS state,
               cast(NULL AS varchar) AS log, cast(NULL AS varchar) AS result,
               cast(NULL AS date) AS email_sent, cast(NULL AS varchar) AS category
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "command_definition": """
        SELECT DISTINCT o_orderpriority AS command_name, o_orderstatus AS type,
               '/bin/run ' || o_orderpriority AS exec, cast(NULL AS varchar) AS category
        FROM orders""",
    "command_params": """
        SELECT 'user' || cast(l_suppkey % 50 AS varchar) AS username,
               'db_' || cast(l_orderkey AS varchar) || '_x' AS db_name,
               l_returnflag AS command_name, l_linestatus AS type,
               cast(l_shipdate AS date) AS creation_date,
               'param' || cast(l_linenumber AS varchar) AS name,
               cast(l_partkey AS varchar) AS value, cast(NULL AS varchar) AS category
        FROM lineitem""",
    "instance_changes": """
        SELECT 'user' || cast(user_id % 50 AS varchar) AS username,
               'db_' || cast(user_id AS varchar) || '_x' AS db_name,
               event_type AS attribute, cast(ts AS date) AS change_date,
               'user' || cast(user_id AS varchar) AS requester,
               cast(NULL AS varchar) AS old_value, props AS new_value
        FROM events""",
    "upgrades": """
        SELECT p_brand AS db_type, p_type AS category,
               '5.' || cast(p_size AS varchar) AS version_from,
               '5.' || cast(p_size + 1 AS varchar) AS version_to
        FROM part""",
    "owners": """
        SELECT cast(c_custkey AS varchar) AS internal_id,
               'db_' || cast(c_custkey AS varchar) || '_x' AS instance_name,
               cast(NULL AS varchar) AS description,
               cast(NULL AS varchar) AS owner_account_type,
               cast(NULL AS varchar) AS owner_first_name,
               cast(NULL AS varchar) AS owner_last_name,
               c_name AS owner_login,
               cast(NULL AS varchar) AS owner_mail,
               cast(NULL AS varchar) AS owner_phone1,
               cast(NULL AS varchar) AS owner_phone2,
               cast(NULL AS varchar) AS owner_portable_phone,
               cast(NULL AS varchar) AS owner_department,
               left(c_mktsegment, 3) AS owner_group,
               cast(NULL AS varchar) AS owner_section
        FROM customer""",
    "feed": """
        SELECT event_id AS request_id, ts, user_id AS instance_id,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update'
                    ELSE 'delete' END AS op,
               'k' || json_extract_string(props, '$.k') AS name, event_type AS value
        FROM events WHERE event_type IN ('signup', 'purchase', 'error')""",
    "feed_state": """
        SELECT DISTINCT user_id AS instance_id,
               'k' || json_extract_string(props, '$.k') AS name, 'seed' AS value
        FROM events WHERE event_type = 'view'""",
    # -- views --------------------------------------------------------------------
    "directories": f"""
        SELECT * FROM (VALUES {", ".join(str(row) for row in S.DIRECTORY_RULES)})
        AS rules({", ".join(S.DIRECTORY_COLUMNS)})""",
    "ports": "SELECT instance_id, value AS port FROM attribute WHERE name = 'port'",
    "attribute_maps": """
        SELECT instance_id, string_agg(name || '=' || value, ',' ORDER BY name) AS attributes
        FROM attribute GROUP BY instance_id""",
    "volume_lists": """
        SELECT instance_id, cast(count(*) AS int) AS n_volumes,
               string_agg(cast(id AS varchar) || ':' || mounting_path, ',' ORDER BY id) AS volumes
        FROM volume GROUP BY instance_id""",
    "instance_paths": """
        SELECT i.id, i.db_name, i.db_type, i.version, p.port,
               CASE i.db_type WHEN 'MYSQL' THEN '/usr/local/mysql/mysql-' || i.version
                    WHEN 'PG' THEN '/usr/local/pgsql/pgsql-' || i.version
                    WHEN 'InfluxDB' THEN '/usr/local/influxdb/influxdb-' || i.version
                    WHEN 'ORACLE' THEN '/ORA/dbs01/oracle/product/rdbms' END AS basedir,
               CASE i.db_type WHEN 'MYSQL' THEN '/usr/local/mysql/mysql-' || i.version || '/bin'
                    WHEN 'PG' THEN '/usr/local/pgsql/pgsql-' || i.version || '/bin'
                    WHEN 'InfluxDB' THEN '/usr/local/influxdb/influxdb-' || i.version || '/bin'
                    WHEN 'ORACLE' THEN '/ORA/dbs01/oracle/product/rdbms' END AS bindir,
               CASE i.db_type WHEN 'MYSQL' THEN '/ORA/dbs03/' || upper(i.db_name) || '/mysql'
                    WHEN 'PG' THEN '/ORA/dbs03/' || upper(i.db_name) || '/data'
                    WHEN 'InfluxDB' THEN '/ORA/dbs03/' || upper(i.db_name)
                    WHEN 'ORACLE' THEN '/ORA/dbs03/' || upper(i.db_name) END AS datadir,
               CASE i.db_type WHEN 'MYSQL' THEN '/ORA/dbs02/' || upper(i.db_name) || '/mysql'
                    WHEN 'PG' THEN '/ORA/dbs02/' || upper(i.db_name) || '/pg_xlog'
                    WHEN 'InfluxDB' THEN '/ORA/dbs02/' || upper(i.db_name)
                    WHEN 'ORACLE' THEN '/ORA/dbs02/' || upper(i.db_name) END AS logdir,
               CASE i.db_type
                    WHEN 'MYSQL' THEN '/var/lib/mysql/mysql.sock.' || lower(i.db_name) || '.' || p.port
                    WHEN 'PG' THEN '/var/lib/pgsql/'
                    WHEN 'InfluxDB' THEN '/var/lib/pgsql/'
                    WHEN 'ORACLE' THEN '/ORA/dbs01/oracle/product/rdbms/network/admin' END AS socket
        FROM instances i LEFT JOIN ports p ON p.instance_id = i.id""",
    "metadata": """
        SELECT i.id, i.username, i.db_name, i.category AS class, i.db_type, i.version,
               i.host AS hosts, m.attributes, d.port, coalesce(v.volumes, '') AS volumes,
               coalesce(v.n_volumes, 0) AS n_volumes,
               d.basedir, d.bindir, d.datadir, d.logdir, d.socket
        FROM instances i JOIN instance_paths d ON d.id = i.id
        LEFT JOIN attribute_maps m ON m.instance_id = i.id
        LEFT JOIN volume_lists v ON v.instance_id = i.id
        WHERE i.db_type IN ('MYSQL', 'PG', 'InfluxDB', 'ORACLE', 'ORA')""",
    "nodes": f"""
        SELECT i.db_name, a.alias AS hostname, p.port, '{S.NODE_USERNAME}' AS username, i.db_type,
               i.category, i.db_type || ',' || i.category AS tags
        FROM instances i JOIN functional_aliases a ON a.db_name = i.db_name
        LEFT JOIN ports p ON p.instance_id = i.id""",
    "host_alias": f"""
        SELECT host, '{S.HOST_ALIAS_PREFIX}' || regexp_replace(db_name, '_', '-', 'g')
                     || '{S.HOST_ALIAS_DOMAIN}' AS alias,
               '{S.HOST_ALIAS_PREFIX}' || db_name || '{S.HOST_ALIAS_TEXT_SUFFIX}' AS plain
        FROM instances""",
    "host_lists": """
        SELECT host, string_agg(alias, ',' ORDER BY alias) AS aliases
        FROM host_alias GROUP BY host""",
    "last_nodes": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY db_name ORDER BY hostname DESC) AS nth
            FROM nodes) WHERE nth = 1""",
    # -- requests -----------------------------------------------------------------
    "name_requests": """
        SELECT c_custkey AS request_id,
               'db_' || cast(c_custkey AS varchar)
               || CASE WHEN c_custkey % 10 = 0 THEN '_gone' ELSE '_x' END AS db_name
        FROM customer""",
    "host_name_requests": """
        SELECT s_suppkey AS request_id, 'host' || cast(s_suppkey AS varchar) AS first_host,
               CASE WHEN s_suppkey % 4 = 0
                    THEN 'host' || cast(s_suppkey + 40 AS varchar) END AS second_host
        FROM supplier""",
    "placed": """
        SELECT id, 'host' || cast(o_custkey % 40 AS varchar) AS on_host, id % 5 = 0 AS pair
        FROM instances JOIN orders ON o_orderkey = id WHERE id % 17 <> 0
        UNION ALL
        SELECT id, 'host' || cast(o_custkey % 40 + 40 AS varchar), true
        FROM instances JOIN orders ON o_orderkey = id WHERE id % 17 <> 0 AND id % 5 = 0""",
    "host_matches": """
        SELECT r.request_id, a.id FROM host_name_requests r
        JOIN placed a ON a.on_host = r.first_host
        LEFT JOIN placed b ON b.id = a.id AND b.on_host = r.second_host
        WHERE r.second_host IS NULL OR b.id IS NOT NULL""",
    "metadata_requests": """
        SELECT c_custkey AS request_id,
               CASE WHEN c_custkey % 10 = 0 THEN 'cluster' WHEN c_custkey % 100 = 1 THEN 'host'
                    ELSE 'instance' END AS class,
               CASE WHEN c_custkey % 9 = 0 THEN NULL
                    WHEN c_custkey % 100 = 1 THEN 'host' || cast(c_custkey % 90 AS varchar)
                    ELSE 'db_' || cast(c_custkey AS varchar) || '_x' END AS name
        FROM customer""",
    "metadata_matches": """
        SELECT r.request_id, m.id FROM metadata_requests r JOIN metadata m ON m.db_name = r.name
        WHERE r.class = 'instance'
        UNION ALL
        SELECT r.request_id, m.id FROM metadata_requests r JOIN placed p ON p.on_host = r.name
        JOIN metadata m ON m.id = p.id WHERE r.class = 'host'""",
    "delete_requests": """
        SELECT o_orderkey AS request_id,
               'db_' || cast(o_orderkey AS varchar)
               || CASE WHEN o_orderkey % 2 = 0 THEN '_gone' ELSE '_x' END AS db_name
        FROM orders""",
    "line_groups": """
        SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_attributes,
               count(DISTINCT l_suppkey) AS n_volumes
        FROM lineitem GROUP BY l_orderkey""",
    "create_requests": """
        SELECT o_orderkey * 2 + c.copy AS request_id, o_orderkey, o_custkey,
               'db_' || cast(o_orderkey AS varchar)
               || CASE WHEN o_orderkey % 2 = 0 THEN '_n' ELSE '_x' END AS db_name,
               coalesce(g.n_attributes, 0) AS n_attributes, coalesce(g.n_volumes, 0) AS n_volumes,
               CASE WHEN o_orderkey % 23 = 0 THEN 'malformed'
                    WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'bad field' END AS reason,
               CASE WHEN o_orderkey % 5 = 0
                    THEN 'host' || cast(o_custkey % 40 AS varchar)
                         || ',host' || cast(o_custkey % 40 + 40 AS varchar)
                    ELSE 'host' || cast(o_custkey % 40 AS varchar) END AS host
        FROM orders JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR o_orderkey % 4 = 0
        LEFT JOIN line_groups g ON g.l_orderkey = o_orderkey""",
    "create_judged": """
        SELECT r.*,
               CASE WHEN reason IS NOT NULL THEN 400
                    WHEN EXISTS (SELECT 1 FROM instances i WHERE i.db_name = r.db_name) THEN 409
                    WHEN request_id = min(CASE WHEN reason IS NULL THEN request_id END)
                                      OVER (PARTITION BY r.db_name) THEN 201
                    ELSE 409 END AS status
        FROM create_requests r""",
    "created": """
        SELECT *,
               (SELECT max(id) FROM instances)
               + row_number() OVER (ORDER BY request_id) AS id,
               coalesce(sum(n_attributes) OVER (ORDER BY request_id ROWS BETWEEN
                   UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attributes_before,
               coalesce(sum(n_volumes) OVER (ORDER BY request_id ROWS BETWEEN
                   UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS volumes_before
        FROM create_judged WHERE status = 201""",
    "created_instances": """
        SELECT id, 'user' || cast(o_custkey % 50 AS varchar) AS username, db_name,
               cast(NULL AS varchar) AS e_group, 'TEST' AS category,
               DATE '2016-07-20' AS creation_date, cast(NULL AS date) AS expiry_date,
               'MYSQL' AS db_type, cast(o_custkey % 100 AS int) AS db_size,
               cast(NULL AS int) AS no_connections, cast(NULL AS varchar) AS project,
               cast(NULL AS varchar) AS description, '5.6.17' AS version,
               cast(NULL AS varchar) AS master, cast(NULL AS varchar) AS slave, host,
               cast(NULL AS varchar) AS state, cast(NULL AS varchar) AS status
        FROM created""",
    "created_attributes": """
        SELECT cast((SELECT max(id) FROM attribute) + c.attributes_before
                    + row_number() OVER (PARTITION BY c.id ORDER BY l.l_linenumber) AS bigint) AS id,
               c.id AS instance_id, 'attr' || cast(l.l_linenumber AS varchar) AS name,
               cast(l.l_linenumber + 7000 AS varchar) AS value
        FROM created c JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l
        ON l.l_orderkey = c.o_orderkey""",
    "created_volumes": """
        SELECT cast((SELECT max(id) FROM volume) + c.volumes_before
                    + row_number() OVER (PARTITION BY c.id ORDER BY l.l_suppkey) AS bigint) AS id,
               c.id AS instance_id, '0755' AS file_mode, 'own' AS owner, 'grp' AS "group",
               'nas' AS server, 'rw' AS mount_options,
               '/MNT/s' || cast(l.l_suppkey AS varchar) AS mounting_path
        FROM created c JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l
        ON l.l_orderkey = c.o_orderkey""",
    "patch_requests": """
        SELECT o_orderkey AS request_id, o_orderkey, o_custkey, o_orderkey % 19 = 0 AS bad,
               o_orderkey % 11 = 0 AS gone,
               CASE WHEN o_orderkey % 13 = 0 THEN 'renamed_' || cast(o_custkey AS varchar)
                    WHEN o_orderkey % 17 = 0
                    THEN 'db_' || cast(o_orderkey - 1 AS varchar) || '_x' END AS new_name
        FROM orders""",
    "patch_judged": """
        SELECT r.*,
               CASE WHEN gone THEN 404 WHEN bad THEN 400
                    WHEN new_name IS NULL THEN 204
                    WHEN EXISTS (SELECT 1 FROM instances i WHERE i.db_name = r.new_name) THEN 409
                    WHEN request_id = min(CASE WHEN NOT gone AND NOT bad THEN request_id END)
                                      OVER (PARTITION BY new_name) THEN 204
                    ELSE 409 END AS status
        FROM patch_requests r""",
    "patched": "SELECT * FROM patch_judged WHERE status = 204",
    "insert_requests": """
        SELECT o_orderkey * 2 + c.copy AS request_id, o_orderkey, c.copy,
               o_orderkey % 9 = 0 AS gone, o_orderkey % 21 = 0 AS null_value,
               o_orderkey % 10 <> 0 AS has_new1, o_orderkey % 14 = 0 AS has_port,
               c.copy = 1 AS has_new2
        FROM orders JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR o_orderkey % 6 = 0""",
    "insert_valid": """
        SELECT r.*,
               CASE WHEN null_value THEN CASE WHEN gone THEN 404 ELSE 400 END
                    WHEN NOT (has_new1 OR has_port OR has_new2) THEN 400
                    WHEN gone THEN 404
                    WHEN has_port AND EXISTS (SELECT 1 FROM ports p
                                              WHERE p.instance_id = r.o_orderkey) THEN 409
               END AS refused
        FROM insert_requests r""",
    "insert_rows": """
        SELECT request_id, o_orderkey AS instance_id, 0 AS pos, 'new1' AS name,
               'v' || cast(copy AS varchar) AS value
        FROM insert_valid WHERE refused IS NULL AND has_new1
        UNION ALL
        SELECT request_id, o_orderkey, 1, 'port', '1234'
        FROM insert_valid WHERE refused IS NULL AND has_port
        UNION ALL
        SELECT request_id, o_orderkey, 2, 'new2', 'z'
        FROM insert_valid WHERE refused IS NULL AND has_new2""",
    "insert_claims": """
        SELECT *, min(request_id) OVER (PARTITION BY instance_id, name) = request_id AS won
        FROM insert_rows""",
    "insert_winners": """
        SELECT request_id, count(*) AS n FROM insert_claims GROUP BY request_id
        HAVING bool_and(won)""",
    "write_requests": """
        SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey, l_linenumber,
               'db_' || cast(l_orderkey AS varchar)
               || CASE WHEN l_orderkey % 9 = 0 THEN '_gone' ELSE '_x' END AS db_name,
               CASE WHEN l_linenumber <= 2 THEN 'port' WHEN l_linenumber = 7 THEN NULL
                    ELSE 'attr' || cast(l_linenumber AS varchar) END AS name,
               CASE WHEN l_linenumber = 4 THEN ''
                    ELSE cast(max(l_partkey) AS varchar) END AS value
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "addressed": """
        SELECT r.*, i.id AS instance_id, a.id AS attribute_id
        FROM write_requests r LEFT JOIN instances i ON i.db_name = r.db_name
        LEFT JOIN attribute a ON a.instance_id = i.id AND a.name = r.name""",
    "host_requests": """
        SELECT event_id AS request_id, 'host' || cast(user_id AS varchar) AS name,
               CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL
                    ELSE cast(event_id AS int) END AS memory
        FROM events""",
    "host_delete_requests": """
        SELECT event_id AS request_id, 'host' || cast(user_id AS varchar)
               || CASE WHEN user_id % 3 = 0 THEN '_gone' ELSE '' END AS name
        FROM events""",
    "host_judged": """
        SELECT r.*, h.id AS host_id FROM host_requests r LEFT JOIN host h ON h.name = r.name""",
    "inserted_hosts": """
        SELECT (SELECT max(id) FROM host) + row_number() OVER (ORDER BY request_id) AS id,
               name, memory, request_id
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY request_id) AS nth
              FROM host_judged WHERE host_id IS NULL AND memory IS NOT NULL)
        WHERE nth = 1""",
    "updated_hosts": """
        SELECT h.id, h.name, arg_max(r.memory, r.request_id) AS memory
        FROM host h JOIN host_requests r ON r.name = h.name
        WHERE r.memory IS NOT NULL GROUP BY h.id, h.name""",
    "alias_requests": """
        SELECT c_custkey * 2 + c.copy AS request_id,
               'db_' || cast(c_custkey AS varchar) || '_x' AS db_name,
               CASE WHEN c_custkey % 17 <> 0
                    THEN 'a-' || cast(c_custkey AS varchar) || '-' || cast(c.copy AS varchar)
               END AS alias
        FROM customer JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR c_custkey % 5 = 0""",
    "free_names": """
        SELECT dns_name, row_number() OVER (ORDER BY dns_name) AS nth FROM functional_aliases
        WHERE db_name IS NULL AND alias IS NULL AND dns_name IS NOT NULL""",
    "alias_first": """
        SELECT *, NOT taken AND row_number() OVER (PARTITION BY db_name
                                                   ORDER BY request_id) = 1 AS first
        FROM (SELECT r.*, EXISTS (SELECT 1 FROM functional_aliases a
                                  WHERE a.db_name = r.db_name) AS taken
              FROM alias_requests r WHERE r.alias IS NOT NULL)""",
    "alias_ranked": """
        SELECT *, coalesce(sum(CASE WHEN first THEN 1 ELSE 0 END)
                           OVER (ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING
                                 AND 1 PRECEDING), 0) AS before
        FROM alias_first""",
    "alias_judged": """
        SELECT request_id, db_name, alias, before,
               CASE WHEN before >= (SELECT count(*) FROM free_names) THEN 503
                    WHEN first THEN 201 ELSE 409 END AS status
        FROM alias_ranked
        UNION ALL
        SELECT request_id, db_name, alias, NULL, 400 FROM alias_requests WHERE alias IS NULL""",
    "alias_given": """
        SELECT f.dns_name, j.db_name, j.alias FROM alias_judged j
        JOIN free_names f ON f.nth = j.before + 1 WHERE j.status = 201""",
    "release_names": """
        SELECT db_name, min(dns_name) AS dns_name FROM functional_aliases
        WHERE db_name IS NOT NULL GROUP BY db_name""",
    "feed_judged": """
        SELECT *, CASE WHEN op = 'create' THEN CASE WHEN existed THEN 409 ELSE 201 END
                       WHEN existed THEN 204 ELSE 404 END AS status
        FROM (SELECT f.*,
                     coalesce(last_value(CASE op WHEN 'create' THEN true WHEN 'delete' THEN false END
                                         IGNORE NULLS)
                              OVER (PARTITION BY f.instance_id, f.name ORDER BY ts, request_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                              s.value IS NOT NULL) AS existed
              FROM feed f LEFT JOIN feed_state s
              ON s.instance_id = f.instance_id AND s.name = f.name)""",
    "feed_last": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY instance_id, name
                                         ORDER BY ts DESC, request_id DESC) AS nth
            FROM feed_judged WHERE status IN (201, 204)) WHERE nth = 1""",
}


def _with_ctes(body: str) -> str:
    """Put the tables a statement names, and those they name, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_]+\b", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(body)
    listed = [
        f"{name} AS {'MATERIALIZED ' if name == 'metadata' else ''}({sql})"
        for name, sql in CTES.items()
        if name in needed
    ]
    if not listed:
        return body
    own = body.strip()
    joint = ", " + own[len("WITH ") :] if own.startswith("WITH ") else " " + own
    return f"WITH {', '.join(listed)}{joint}"


AFFECTED = "cast(CASE WHEN status IN (200, 201, 204) THEN {n} ELSE 0 END AS bigint) AS affected"


def _outcomes(source: str, status: str = "status", n: str = "1") -> str:
    return (
        f"SELECT request_id, cast(status AS int) AS status, {AFFECTED.format(n=n)} "
        f"FROM (SELECT *, {status} AS status FROM {source})"
        if status != "status"
        else f"SELECT request_id, cast(status AS int) AS status, {AFFECTED.format(n=n)} FROM {source}"
    )


INSTANCE_COLUMNS = ", ".join(S.INSTANCES.columns)
VOLUME_COLUMNS = ", ".join(f'"{c}"' for c in S.VOLUME.columns)


def _xml(column: str, name: str) -> str:
    escaped = column
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = f"replace({escaped}, '{plain}', '{entity}')"
    return f"""coalesce(' {name}="' || {escaped} || '"', '')"""


def _null_counts(table: str, columns: list[str]) -> str:
    parts = [
        f"SELECT 'not_null' AS rule, '{c}' AS key, count(*) AS n FROM {table} "
        f'WHERE "{c}" IS NULL HAVING count(*) > 0'
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def _long_counts(table: str, limits: dict[str, int]) -> str:
    parts = [
        f"SELECT 'length' AS rule, '{c}' AS key, count(*) AS n FROM {table} "
        f'WHERE length("{c}") > {n} HAVING count(*) > 0'
        for c, n in limits.items()
    ]
    return " UNION ALL ".join(parts)


def _repeats(table: str, key: tuple[str, ...]) -> str:
    shown = " || '|' || ".join(f"coalesce(cast(\"{k}\" AS varchar), '')" for k in key)
    some = " OR ".join(f'"{k}" IS NOT NULL' for k in key)
    by = ", ".join(f'"{k}"' for k in key)
    return (
        f"SELECT 'unique:{','.join(key)}' AS rule, {shown} AS key, count(*) AS n FROM {table} "
        f"WHERE {some} GROUP BY {by} HAVING count(*) > 1"
    )


def _orphan_counts(child: str, parent: str) -> str:
    return (
        f"SELECT 'orphan:instance_id' AS rule, cast(instance_id AS varchar) AS key, count(*) AS n "
        f"FROM {child} c WHERE instance_id IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.id = c.instance_id) GROUP BY instance_id"
    )


def _catalog_report() -> str:
    parts = []
    for name, table in S.TABLES.items():
        rules = [_repeats(name, key) for key in table.unique]
        rules += [_null_counts(name, table.required)]
        if table.limits:
            rules.append(_long_counts(name, table.limits))
        if name in ("attribute", "volume"):
            rules.append(_orphan_counts(name, "instances"))
        parts += [f"SELECT *, '{name}' AS \"table\" FROM ({rule})" for rule in rules]
    return " UNION ALL ".join(parts)


DURATIONS = """count(*) AS count,
    cast(round(avg(date_diff('day', creation_date, completion_date)) * 86400) AS bigint)
        AS mean_duration"""

def _content(table: S.Table) -> str:
    shown = " || '|' || ".join(f"coalesce(cast(\"{c}\" AS varchar), '~')" for c in table.columns)
    return f"""
        SELECT '{table.name}' AS table_name, count(*) AS n_rows,
               count(DISTINCT "{table.columns[0]}") AS n_first,
               cast(sum(cast('0x' || left(md5({shown}), 8) AS bigint)) AS bigint) AS content
        FROM {table.name}"""


def _document(envelope: str, row: str, order: str) -> str:
    return f"""'{{"{envelope}":[' || string_agg({row}, ',' ORDER BY {order}) || ']}}' AS document"""


_METADATA = "id, username, db_name, class, db_type, version, hosts, attributes, port, volumes, " \
    "n_volumes, basedir, bindir, datadir, logdir, socket"

_BODIES: dict[str, str] = {
    "s1_catalog_scan": " UNION ALL ".join(_content(t) for t in S.TABLES.values()),
    "s2_pass_through_views": """
        SELECT i.db_name, i.db_type, c.n_changes, j.n_jobs FROM instances i
        LEFT JOIN (SELECT 'db_' || cast(user_id AS varchar) || '_x' AS db_name,
                          count(*) AS n_changes FROM events GROUP BY user_id) c
        ON c.db_name = i.db_name
        LEFT JOIN (SELECT db_name, count(*) AS n_jobs FROM jobs GROUP BY db_name) j
        ON j.db_name = i.db_name""",
    "s3_documents_good": """
        SELECT request_id, 'user' || cast(o_custkey % 50 AS varchar) AS username,
               'TEST' AS class, DATE '2016-07-20' AS creation_date, 'MYSQL' AS db_type, db_name,
               cast(o_custkey % 100 AS int) AS db_size, '5.6.17' AS version, host,
               coalesce(a.attributes, '') AS attributes, coalesce(v.volumes, '') AS volumes
        FROM create_requests LEFT JOIN (
            SELECT l_orderkey, string_agg('attr' || l_linenumber || '|' || (l_linenumber + 7000),
                                          ';' ORDER BY l_linenumber) AS attributes
            FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey) a
        ON a.l_orderkey = o_orderkey LEFT JOIN (
            SELECT l_orderkey, string_agg('grp|0755|nas|rw|own|/MNT/s' || l_suppkey,
                                          ';' ORDER BY l_suppkey) AS volumes
            FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey) v
        ON v.l_orderkey = o_orderkey
        WHERE reason IS NULL""",
    "s3_documents_rejected": """
        SELECT request_id, reason FROM create_requests WHERE reason IS NOT NULL""",
    "s4_append_volumes": f"""
        SELECT {VOLUME_COLUMNS} FROM volume UNION ALL
        SELECT {VOLUME_COLUMNS} FROM created_volumes""",
    "s5_node_lines": f"""
        SELECT db_name, '<node' || {_xml("db_name", "name")} || ' description=""'
               || {_xml("hostname", "hostname")} || {_xml("username", "username")}
               || {_xml("category", "type")} || {_xml("db_type", "subcategory")}
               || {_xml("port", "port")} || {_xml("tags", "tags")} || '/>' AS line
        FROM last_nodes""",
    "s5_node_list_xml": """
        SELECT db_name AS name, '' AS description, hostname, username, category AS type, db_type AS subcategory,
               port, tags FROM last_nodes""",
    "s6_alias_documents": """
        SELECT request_id, count(*) AS n_rows,
               '{"response":[' || string_agg('{"dns_name":"' || dns_name || '","alias":"'
                   || alias || '"}', ',' ORDER BY dns_name) || ']}' AS document
        FROM name_requests JOIN functional_aliases USING (db_name) GROUP BY request_id""",
    "s6_owner_documents": f"""
        SELECT request_id, count(*) AS n_rows, {_document("data", "row", "row")}
        FROM (SELECT request_id, cast(json_object({", ".join(
            f"'{c}', o.{c}" for c in S.OWNERS.columns)}) AS varchar) AS row
              FROM name_requests r JOIN owners o ON r.db_name = o.instance_name)
        GROUP BY request_id""",
    "s6_metadata_documents": f"""
        WITH attribute_docs AS (
            SELECT instance_id, '{{' || string_agg('"' || name || '":"' || value || '"', ','
                                                   ORDER BY name) || '}}' AS attributes
            FROM attribute GROUP BY instance_id),
        volume_docs AS (
            SELECT instance_id, '[' || string_agg(cast(json_object({", ".join(
                f"'{c}', " + chr(34) + c + chr(34) for c in S.VOLUME.columns)}) AS varchar), ','
                                                  ORDER BY id) || ']' AS volumes
            FROM volume GROUP BY instance_id),
        instance_docs AS (
            SELECT m.id, cast(json_object('id', m.id, 'username', username, 'db_name', db_name,
                       'class', class, 'db_type', db_type, 'version', version,
                       'hosts', string_split(hosts, ','), 'attributes', cast(a.attributes AS json),
                       'port', port, 'volumes', cast(coalesce(v.volumes, '[]') AS json),
                       'basedir', basedir, 'bindir', bindir, 'datadir', datadir,
                       'logdir', logdir, 'socket', socket) AS varchar) AS row
            FROM metadata m LEFT JOIN attribute_docs a ON a.instance_id = m.id
            LEFT JOIN volume_docs v ON v.instance_id = m.id)
        SELECT request_id, count(*) AS n_rows, {_document("response", "d.row", "d.id")}
        FROM host_matches h JOIN instance_docs d ON d.id = h.id GROUP BY request_id""",
    "p1_instance_view": f"""
        SELECT {INSTANCE_COLUMNS.replace("category", "category AS class")} FROM instances""",
    "p2_attribute_view": "SELECT id, instance_id, name, value FROM attribute",
    "p3_volume_view": f"SELECT {VOLUME_COLUMNS} FROM volume",
    "p4_host_view": "SELECT id, name, memory FROM host",
    "p5_alias_view": "SELECT dns_name, db_name, alias FROM functional_aliases",
    "p6_owner_view": f"SELECT {', '.join(S.OWNERS.columns)} FROM owners",
    "p7_host_memory": """
        SELECT request_id, memory FROM host_name_requests JOIN host ON name = first_host
        WHERE second_host IS NULL""",
    "f1_instance_by_name": f"""
        SELECT r.request_id, {", ".join(
            f"i.{c}" + (" AS class" if c == "category" else "") for c in S.INSTANCES.columns)}
        FROM name_requests r JOIN instances i ON i.db_name = r.db_name""",
    "f1_metadata_by_name": f"""
        SELECT request_id, {", ".join("m." + c.strip() for c in _METADATA.split(","))}
        FROM name_requests r JOIN metadata m ON m.db_name = r.db_name""",
    "f1_owner_by_name": """
        SELECT request_id, internal_id, instance_name, owner_login, owner_group
        FROM name_requests JOIN owners ON instance_name = db_name""",
    "f1_alias_by_name": """
        SELECT request_id, dns_name, alias FROM name_requests JOIN functional_aliases
        USING (db_name)""",
    "f1_host_by_name": """
        SELECT request_id, id, name, memory FROM host_name_requests JOIN host ON name = first_host
        WHERE second_host IS NULL""",
    "f1_host_aliases_by_host": """
        SELECT request_id, host, aliases FROM host_name_requests JOIN host_lists
        ON host = first_host || coalesce(',' || second_host, '')""",
    "f2_attribute_value": """
        SELECT r.request_id, r.db_name, r.name, a.value FROM write_requests r
        JOIN instances i ON i.db_name = r.db_name
        JOIN attribute a ON a.instance_id = i.id AND a.name = r.name""",
    "f2_all_attributes": """
        SELECT request_id, attributes FROM name_requests r
        JOIN instances i ON i.db_name = r.db_name JOIN attribute_maps ON instance_id = i.id""",
    "f3_instances_on_hosts": f"""
        SELECT request_id, {", ".join("m." + c.strip() for c in _METADATA.split(","))}
        FROM host_matches h JOIN metadata m ON m.id = h.id""",
    "f4_free_pool": "SELECT dns_name FROM free_names",
    "f5_metadata_rows": """
        SELECT request_id, p.id, p.db_name, p.port, p.socket,
               cast(coalesce(v.n_volumes, 0) AS int) AS n_volumes
        FROM metadata_matches x
        JOIN instance_paths p ON p.id = x.id
        LEFT JOIN (SELECT instance_id, count(*) AS n_volumes FROM volume GROUP BY 1) v
        ON v.instance_id = p.id
        WHERE p.db_type IN ('MYSQL', 'PG', 'InfluxDB', 'ORACLE', 'ORA')""",
    "f5_metadata_outcomes": """
        SELECT r.request_id,
               cast(CASE WHEN name IS NULL OR class = 'cluster' THEN 400
                         WHEN n > 0 THEN 200 ELSE 404 END AS int) AS status,
               cast(coalesce(n, 0) AS bigint) AS affected
        FROM metadata_requests r
        LEFT JOIN (SELECT request_id, count(*) AS n FROM metadata_matches GROUP BY 1) m
        ON m.request_id = r.request_id""",
    "j1_node_inventory": "SELECT * FROM nodes",
    "j2_port_of_instance": """
        SELECT id, db_name, port FROM instances LEFT JOIN ports ON instance_id = id""",
    "j3_attributes_of_instance": """
        SELECT id, db_name, attributes FROM instances
        LEFT JOIN attribute_maps ON instance_id = id""",
    "j4_volumes_of_instance": """
        SELECT id, db_name, coalesce(volumes, '') AS volumes FROM instances
        LEFT JOIN volume_lists ON instance_id = id""",
    "j5_directories": """
        SELECT * FROM instance_paths WHERE db_type IN (SELECT db_type FROM directories)""",
    "j5_directories_keep_unknown": """
        SELECT id, db_name, db_type, version, port,
               CASE WHEN known THEN basedir ELSE '/#BASEDIR#/' || version END AS basedir,
               CASE WHEN known THEN bindir ELSE '/#BASEDIR#/' || version || '/bin' END AS bindir,
               CASE WHEN known THEN datadir
                    ELSE '/ORA/dbs03/' || upper(db_name) || '/data' END AS datadir,
               CASE WHEN known THEN logdir
                    ELSE '/ORA/dbs02/' || upper(db_name) || '/pg_xlog' END AS logdir,
               CASE WHEN known THEN socket ELSE '/tmp' END AS socket
        FROM (SELECT *, coalesce(db_type IN (SELECT db_type FROM directories), false) AS known
              FROM instance_paths)""",
    "j6_host_names": """
        SELECT o_orderkey AS list_id, coalesce(string_agg(h.name, ',' ORDER BY h.id), '') AS hosts
        FROM orders LEFT JOIN host h ON o_orderkey % 8 <> 0
             AND (h.id = o_custkey % 150 OR h.id = o_orderkey % 90)
        GROUP BY o_orderkey""",
    "j7_resolve_instance_id": """
        SELECT request_id, r.db_name, i.id AS instance_id FROM delete_requests r
        LEFT JOIN instances i ON i.db_name = r.db_name""",
    "j8_missing": """
        SELECT request_id, db_name, 404 AS status FROM delete_requests
        WHERE db_name NOT IN (SELECT db_name FROM instances)""",
    "j9_metadata": f"SELECT {_METADATA} FROM metadata",
    "a1_job_stats": f"""
        SELECT db_name, command_name, {DURATIONS} FROM jobs GROUP BY db_name, command_name""",
    "a2_command_stats": f"SELECT command_name, {DURATIONS} FROM jobs GROUP BY command_name",
    "a3_host_aliases": "SELECT host, aliases FROM host_lists",
    "a4_host_aliases_text": """
        SELECT host, string_agg(plain, ',' ORDER BY plain) AS aliases
        FROM host_alias GROUP BY host""",
    "a5_attribute_map": "SELECT instance_id, attributes FROM attribute_maps",
    "a6_volume_array": "SELECT instance_id, n_volumes, volumes FROM volume_lists",
    "l1_next_free": "SELECT dns_name FROM free_names WHERE nth = 1",
    "l2_nodes_sorted": "SELECT * FROM nodes ORDER BY db_name, hostname",
    "l3_latest_alias": """
        SELECT db_name, arg_max(dns_name, alias) AS dns_name, max(alias) AS alias
        FROM functional_aliases WHERE db_name IS NOT NULL GROUP BY db_name""",
    "e_scalar_functions": """
        SELECT id, version || ',' || category AS e1_concat, upper(db_name) AS e2_upper,
               lower(category) AS e2_lower, regexp_replace(db_name, '_', '-', 'g') AS e3_replaced,
               cast(CASE WHEN h IS NULL THEN NULL WHEN h = '' THEN 0
                         ELSE len(string_split(h, ',')) END AS int) AS e4_n_hosts,
               CASE WHEN list_contains(string_split(h, ','), 'host7') THEN 'yes' ELSE 'no' END
                   AS e9_contains,
               h AS e11_joined,
               CASE WHEN id % 3 <> 0 THEN cast(-id AS int) END AS e12_int
        FROM (SELECT *, CASE WHEN id % 9 = 0 THEN '' ELSE host END AS h FROM instances)""",
    "m1_create_outcomes": _outcomes("create_judged", n="1 + n_volumes + n_attributes"),
    "m1_create_instances": f"""
        SELECT {INSTANCE_COLUMNS} FROM instances UNION ALL
        SELECT {INSTANCE_COLUMNS} FROM created_instances""",
    "m1_create_attributes": """
        SELECT id, instance_id, name, value FROM attribute UNION ALL
        SELECT id, instance_id, name, value FROM created_attributes""",
    "m1_create_volumes": f"""
        SELECT {VOLUME_COLUMNS} FROM volume UNION ALL
        SELECT {VOLUME_COLUMNS} FROM created_volumes""",
    "m2_patch_outcomes": _outcomes("patch_judged"),
    "m2_patch_instances": f"""
        SELECT {", ".join({
            "db_name": "coalesce(p.new_name, i.db_name) AS db_name",
            "version": "CASE WHEN p.o_orderkey % 4 <> 0 THEN '9.9' ELSE i.version END AS version",
            "host": "CASE WHEN p.o_orderkey % 5 = 0 THEN 'newhost,host'"
                    " || cast(p.o_custkey % 40 AS varchar) ELSE i.host END AS host",
        }.get(c, f"i.{c}") for c in S.INSTANCES.columns)}
        FROM instances i LEFT JOIN patched p ON p.o_orderkey = i.id""",
    "m2_patch_attributes": """
        SELECT a.id, a.instance_id, a.name, a.value FROM attribute a
        WHERE a.instance_id NOT IN (SELECT o_orderkey FROM patched WHERE o_orderkey % 7 = 0)
        UNION ALL
        SELECT cast((SELECT max(id) FROM attribute) + n.pos
                    + 2 * (row_number() OVER (PARTITION BY n.pos ORDER BY o_orderkey) - 1) AS bigint),
               o_orderkey, n.name, CASE n.pos WHEN 1 THEN cast(o_custkey AS varchar) ELSE '1' END
        FROM patched JOIN (VALUES (1, 'port'), (2, 'added')) AS n(pos, name)
        ON o_orderkey % 7 = 0""",
    "m2_patch_volumes": f"""
        SELECT {VOLUME_COLUMNS} FROM volume
        WHERE instance_id NOT IN (SELECT o_orderkey FROM patched WHERE o_orderkey % 3 = 0)""",
    "m3_delete_outcomes": _outcomes(
        "delete_requests", "CASE WHEN request_id % 2 = 0 THEN 404 ELSE 204 END"
    ),
    "m3_delete_instances": f"SELECT {INSTANCE_COLUMNS} FROM instances WHERE id % 2 = 0",
    "m3_delete_attributes": """
        SELECT id, instance_id, name, value FROM attribute WHERE instance_id % 2 = 0""",
    "m3_delete_volumes": f"SELECT {VOLUME_COLUMNS} FROM volume WHERE instance_id % 2 = 0",
    "m4_attribute_insert_outcomes": _outcomes(
        "(SELECT v.request_id, CASE WHEN refused IS NOT NULL THEN refused "
        "WHEN w.n IS NOT NULL THEN 201 ELSE 409 END AS status, w.n FROM insert_valid v "
        "LEFT JOIN insert_winners w ON w.request_id = v.request_id)",
        n="n",
    ),
    "m4_attribute_insert_state": """
        SELECT id, instance_id, name, value FROM attribute UNION ALL
        SELECT (SELECT max(id) FROM attribute)
               + row_number() OVER (ORDER BY c.request_id, c.pos), instance_id, name, value
        FROM insert_claims c JOIN insert_winners w ON w.request_id = c.request_id""",
    "m5_attribute_update_outcomes": _outcomes(
        "addressed",
        "CASE WHEN value = '' THEN 400 WHEN attribute_id IS NOT NULL THEN 204 ELSE 404 END",
    ),
    "m5_attribute_update_state": """
        SELECT a.id, a.instance_id, a.name, coalesce(u.value, a.value) AS value
        FROM attribute a LEFT JOIN (
            SELECT attribute_id, arg_max(value, request_id) AS value FROM addressed
            WHERE value <> '' AND attribute_id IS NOT NULL GROUP BY attribute_id) u
        ON u.attribute_id = a.id""",
    "m6_attribute_delete_outcomes": _outcomes(
        "addressed",
        "CASE WHEN name IS NULL THEN 400 WHEN attribute_id IS NOT NULL THEN 204 ELSE 404 END",
    ),
    "m6_attribute_delete_state": """
        SELECT id, instance_id, name, value FROM attribute
        WHERE id NOT IN (SELECT attribute_id FROM addressed WHERE attribute_id IS NOT NULL)""",
    "m7_host_insert_outcomes": _outcomes(
        "host_judged",
        "CASE WHEN memory IS NULL THEN 400 "
        "WHEN request_id IN (SELECT request_id FROM inserted_hosts) THEN 201 ELSE 409 END",
    ),
    "m7_host_insert_state": """
        SELECT id, name, memory FROM host UNION ALL SELECT id, name, memory FROM inserted_hosts""",
    "m8_host_update_outcomes": _outcomes(
        "host_judged",
        "CASE WHEN memory IS NULL THEN 400 WHEN host_id IS NULL THEN 404 ELSE 200 END",
    ),
    "m8_host_update_state": """
        SELECT h.id, h.name, coalesce(u.memory, h.memory) AS memory
        FROM host h LEFT JOIN updated_hosts u ON u.id = h.id""",
    "m9_host_delete_outcomes": _outcomes(
        "(SELECT r.request_id, h.id AS host_id FROM host_delete_requests r "
        "LEFT JOIN host h ON h.name = r.name)",
        "CASE WHEN host_id IS NULL THEN 404 ELSE 200 END"
    ),
    "m9_host_delete_state": """
        SELECT id, name, memory FROM host
        WHERE name NOT IN (SELECT name FROM host_delete_requests)""",
    "m10_alias_allocate_outcomes": _outcomes("alias_judged"),
    "m10_alias_allocate_state": """
        SELECT a.dns_name, coalesce(g.db_name, a.db_name) AS db_name,
               coalesce(g.alias, a.alias) AS alias
        FROM functional_aliases a LEFT JOIN alias_given g ON g.dns_name = a.dns_name""",
    "m11_alias_release_outcomes": _outcomes(
        "(SELECT r.request_id, n.dns_name FROM alias_requests r "
        "LEFT JOIN release_names n ON n.db_name = r.db_name)",
        "CASE WHEN dns_name IS NULL THEN 400 ELSE 204 END",
    ),
    "m11_alias_release_state": """
        SELECT dns_name, CASE WHEN gone THEN NULL ELSE db_name END AS db_name,
               CASE WHEN gone THEN NULL ELSE alias END AS alias
        FROM (SELECT a.*, dns_name IN (
                  SELECT n.dns_name FROM release_names n
                  JOIN alias_requests r ON r.db_name = n.db_name) AS gone
              FROM functional_aliases a)""",
    "m12_allocated_rows": "SELECT dns_name, db_name, alias FROM alias_given",
    "m12_updated_hosts": "SELECT id, name, memory FROM updated_hosts",
    "m12_created_instances": f"""
        SELECT {INSTANCE_COLUMNS.replace("category", "category AS class")}
        FROM created_instances""",
    "c1_unique": _repeats("lineitem", ("l_orderkey", "l_linenumber")),
    "c1_alias_unique": _repeats("functional_aliases", ("db_name",)),
    "c2_not_null": _null_counts("instances", S.INSTANCES.columns),
    "c3_orphans": _orphan_counts("attribute", "(SELECT id FROM instances WHERE id % 2 = 0)"),
    "c4_length": _long_counts("functional_aliases", S.FUNCTIONAL_ALIASES.limits),
    "c_catalog_report": _catalog_report(),
    "t1_feed_state": """
        SELECT s.instance_id, s.name, coalesce(l.value, s.value) AS value FROM feed_state s
        LEFT JOIN feed_last l ON l.instance_id = s.instance_id AND l.name = s.name
        WHERE coalesce(l.op, 'none') <> 'delete'
        UNION ALL
        SELECT instance_id, name, value FROM feed_last l WHERE op <> 'delete'
        AND NOT EXISTS (SELECT 1 FROM feed_state s
                        WHERE s.instance_id = l.instance_id AND s.name = l.name)""",
    "t1_feed_outcomes": _outcomes("feed_judged"),
    "t2_job_outcomes": """
        SELECT exec_id,
               CASE WHEN in_time AND state = 'purchase' THEN 'succeeded'
                    WHEN in_time THEN 'failed' ELSE 'timed_out' END AS outcome,
               CASE WHEN in_time THEN done ELSE start + INTERVAL 1 DAY END AS ended
        FROM (SELECT *, coalesce(done < start + INTERVAL 1 DAY, false) AS in_time
              FROM (SELECT user_id AS exec_id, min(ts) AS start,
                           min(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS done,
                           arg_min(event_type, ts) FILTER (WHERE event_type IN
                               ('purchase', 'error')) AS state
                    FROM events GROUP BY user_id))""",
}
_BODIES["j9_metadata_by_key"] = _BODIES["j9_metadata"]
_BODIES["t1_stream_state"] = _BODIES["t1_feed_state"]
_BODIES["t2_stream_outcomes"] = _BODIES["t2_job_outcomes"]


def oracle_sql() -> dict[str, str]:
    return {name: _with_ctes(body) for name, body in _BODIES.items()}
