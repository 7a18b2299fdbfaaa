"""The same results as plain SQL over the given tables.

``CTES`` derive the sample account in its normalised shape (FIXTURES.md); each query
takes the ones it names, directly or through others.
"""

from __future__ import annotations

import re

CTES = {
    "reg": """SELECT r_regionkey AS r, 'DB_' || replace(r_name, ' ', '_') AS db,
        replace(r_name, ' ', '_') || '_READ' AS region_read FROM region""",
    "geo": """SELECT n_nationkey AS n, n_name, r, db, region_read
        FROM nation JOIN reg ON n_regionkey = r""",
    "parts": """SELECT p_partkey AS p, db, n_name AS sch, 'T_' || p_partkey AS name,
        CASE p_type WHEN 'PROMO' THEN 'VIEW' WHEN 'LARGE' THEN 'STAGE' ELSE 'TABLE' END AS kind,
        '"' || db || '"."' || n_name || '"."T_' || p_partkey || '"' AS obj
        FROM part JOIN geo ON p_partkey % (SELECT count(*) FROM nation) = n""",
    "t_databases": """SELECT db AS name, 'SYSADMIN' AS owner, '"' || db || '"' AS fqn FROM reg
        UNION ALL SELECT 'SNOWFLAKE', '', '"SNOWFLAKE"' FROM reg WHERE r = 0""",
    "t_schemas": """SELECT n_name AS name, db AS "database", 'SYSADMIN' AS owner,
        n % 5 = 0 AS managed_access, '"' || db || '"."' || n_name || '"' AS fqn FROM geo
        UNION ALL SELECT 'INFORMATION_SCHEMA', db, '', false,
        '"' || db || '"."INFORMATION_SCHEMA"' FROM reg""",
    "t_entities": """SELECT name, db AS "database", sch AS "schema", 'SYSADMIN' AS owner,
        kind AS entity_type, obj AS fqn FROM parts
        UNION ALL SELECT 'TABLES', db, 'INFORMATION_SCHEMA', '', 'VIEW',
        '"' || db || '"."INFORMATION_SCHEMA"."TABLES"' FROM reg""",
    "column_names": """SELECT * FROM (VALUES (0, 'id'), (1, 'email'), (2, 'PHONE'),
        (3, 'phone_hashed'), (4, 'zip_code'), (5, 'amount'), (6, 'order_total'),
        (7, 'client_ip')) AS t(i, col)""",
    "part_columns": """SELECT p, i, col, db, sch, name, obj,
        row_number() OVER (PARTITION BY p ORDER BY i) AS pos
        FROM parts CROSS JOIN column_names WHERE (p + i) % 3 <> 0""",
    "t_columns": """SELECT col AS name, db AS "database", sch AS "schema", name AS "table",
        obj || '."' || col || '"' AS fqn FROM part_columns""",
    "t_users": """SELECT CASE WHEN c_custkey % 500 = 7 THEN 'SNOWFLAKE' ELSE c_name END AS name, c_acctbal < 0 AS disabled, 'USERADMIN' AS owner,
        strftime(TIMESTAMP '2024-01-01' + to_seconds(c_custkey), '%Y-%m-%d %H:%M:%S')
          AS last_successful_login,
        c_mktsegment <> 'MACHINERY' AS has_password FROM customer""",
    "t_role_grants": """SELECT n_name AS role, c_name AS grantee, 'USER' AS grantee_type
          FROM customer JOIN geo ON c_nationkey = n
        UNION ALL SELECT 'SEG_' || c_mktsegment, c_name, 'USER' FROM customer
          WHERE c_custkey % 3 = 0
        UNION ALL SELECT region_read, n_name, 'ROLE' FROM geo
        UNION ALL SELECT 'GLOBAL_READ', region_read, 'ROLE' FROM reg WHERE r % 2 = 0
        UNION ALL SELECT 'NATION_' || ((n + 5) % (SELECT count(*) FROM nation)), n_name, 'ROLE' FROM geo WHERE n % 4 = 0
        UNION ALL SELECT 'ACCOUNTADMIN', c_name, 'USER' FROM customer WHERE c_custkey % 97 = 0
        UNION ALL SELECT 'SECURITYADMIN', c_name, 'USER' FROM customer WHERE c_custkey % 89 = 0
        UNION ALL SELECT * FROM (VALUES ('SECURITYADMIN', 'ACCOUNTADMIN', 'ROLE'),
          ('CYCLE_A', 'CYCLE_B', 'ROLE'), ('CYCLE_B', 'CYCLE_A', 'ROLE'),
          ('CYCLE_A', 'NATION_3', 'ROLE')) AS v(role, grantee, grantee_type)""",
    "object_grants": """SELECT DISTINCT obj AS asset, kind AS asset_type,
        CASE WHEN p % 90 = 4 AND l_returnflag = 'R' THEN ''
          WHEN p % 90 = 5 AND l_returnflag = 'R' THEN 'ACCOUNTADMIN' ELSE g.n_name END AS grantee,
        CASE l_returnflag WHEN 'A' THEN 'SELECT' WHEN 'N' THEN 'INSERT' ELSE 'UPDATE' END
          AS privilege
        FROM lineitem JOIN parts ON l_partkey = p JOIN supplier ON l_suppkey = s_suppkey
        JOIN geo AS g ON s_nationkey = g.n""",
    "dealings": """SELECT DISTINCT c_nationkey AS buyer, s_nationkey AS seller FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey""",
    "geo_grantees": """SELECT m.*, g.n AS gn, g.n_name AS grantee FROM geo AS m
        JOIN dealings ON m.n = buyer JOIN geo AS g ON seller = g.n""",
    "reg_grantees": """SELECT DISTINCT reg.r, reg.db, g.n AS gn, g.n_name AS grantee FROM reg
        JOIN geo AS m ON m.r = reg.r JOIN dealings ON m.n = buyer JOIN geo AS g ON seller = g.n""",
    "schema_grants": """SELECT '"' || db || '"."' || n_name || '"' AS asset,
        'SCHEMA' AS asset_type, grantee, 'USAGE' AS privilege
        FROM geo_grantees WHERE (n * 7 + gn) % 3 <> 0
        UNION ALL SELECT '"' || db || '"."' || n_name || '"', 'SCHEMA', grantee, 'MONITOR'
        FROM geo_grantees WHERE n = gn""",
    "database_grants": """SELECT '"' || db || '"' AS asset, 'DATABASE' AS asset_type,
        grantee, 'USAGE' AS privilege FROM reg_grantees WHERE (r + gn) % 4 <> 0""",
    "t_privilege_grants": """SELECT * FROM object_grants UNION ALL SELECT * FROM schema_grants
        UNION ALL SELECT * FROM database_grants""",
    "t_future_grants": """SELECT target, asset_type, grantee, set_on FROM (
        SELECT db || '.<TABLE>' AS target, 'TABLE' AS asset_type, grantee,
          '"' || db || '"' AS set_on FROM reg_grantees WHERE r <> 3 AND (r * 3 + gn) % 7 = 0
        UNION ALL SELECT db || '.<SCHEMA>', 'SCHEMA', grantee, '"' || db || '"'
          FROM reg_grantees WHERE r % 2 = 0 AND gn % 9 = 0
        UNION ALL SELECT db || '.<VIEW>', 'VIEW', grantee, '"' || db || '"'
          FROM reg_grantees WHERE r = 1 AND gn % 5 = 0
        UNION ALL SELECT db || '.' || n_name || '.<TABLE>', 'TABLE', grantee,
          '"' || db || '"."' || n_name || '"'
          FROM geo_grantees WHERE n % 3 = 0 AND (n + gn) % 6 = 0)""",
    "t_masking_policies": """SELECT 'MP_' || (p_partkey // 30) AS name, 'DB_AFRICA' AS "database",
        'NATION_0' AS "schema", 'SYSADMIN' AS owner,
        '"DB_AFRICA"."NATION_0"."MP_' || (p_partkey // 30) || '"' AS fqn
        FROM part WHERE p_partkey % 30 = 0""",
    "t_row_access_policies": """SELECT 'RP_' || (p_partkey // 80) AS name,
        'DB_AFRICA' AS "database", 'NATION_0' AS "schema", 'SYSADMIN' AS owner,
        '"DB_AFRICA"."NATION_0"."RP_' || (p_partkey // 80) || '"' AS fqn
        FROM part WHERE p_partkey % 80 = 0""",
    "t_network_policies": """SELECT 'NP_' || s_suppkey AS name FROM supplier
        WHERE s_suppkey % 5 = 0""",
    "t_masking_refs": """SELECT 'MP_' || (p // 40) AS name, 'DB_AFRICA' AS "database",
        'NATION_0' AS "schema", p AS policy_id, obj || '."email"' AS target_fqn,
        CASE WHEN p % 80 = 0 THEN '"DB_AFRICA"."NATION_0"."PII"' END AS tag_fqn,
        CASE WHEN p % 200 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
        '"DB_AFRICA"."NATION_0"."MP_' || (p // 40) || '"' AS fqn
        FROM parts WHERE p % 40 = 0""",
    "t_row_access_refs": """SELECT 'RP_' || (p // 100) AS name, 'DB_AFRICA' AS "database",
        'NATION_0' AS "schema", p AS policy_id, obj AS target_fqn,
        CASE WHEN p % 80 = 0 THEN '"DB_AFRICA"."NATION_0"."PII"' END AS tag_fqn,
        'ACTIVE' AS status,
        '"DB_AFRICA"."NATION_0"."RP_' || (p // 100) || '"' AS fqn
        FROM parts WHERE p % 100 = 0""",
    "t_login_history": """SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS "user",
        CASE event_type WHEN 'purchase' THEN 'OAUTH_ACCESS_TOKEN' WHEN 'signup'
          THEN 'RSA_KEYPAIR' ELSE 'PASSWORD' END AS first_authentication_factor,
        CASE WHEN event_type = 'view' THEN 'DUO_PUSH' END AS second_authentication_factor,
        event_type <> 'error' AS success, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp
        FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS
          AND ts <= TIMESTAMP '2024-01-20'""",
    "queries_run": """SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS "user", p, obj,
        l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN parts ON l_partkey = p
        WHERE o_orderdate > TIMESTAMP '2001-06-01' - INTERVAL 90 DAYS
          AND o_orderdate <= TIMESTAMP '2001-06-01' AND kind <> 'STAGE'""",
    "usage_t": """SELECT "user", obj AS "object", count(*) AS usage_count FROM queries_run
        GROUP BY ALL""",
    "usage_c": """SELECT "user", q.obj || '."' || col || '"' AS "object", count(*) AS usage_count
        FROM queries_run AS q JOIN part_columns USING (p) WHERE line % 4 <> 0
        GROUP BY ALL""",
    "popular_t": """SELECT "object", count(*) AS n_users, sum(usage_count)::BIGINT AS usage_count
        FROM usage_t GROUP BY ALL""",
    "popular_c": """SELECT "object", count(*) AS n_users, sum(usage_count)::BIGINT AS usage_count
        FROM usage_c GROUP BY ALL""",
    "reach": """SELECT DISTINCT grantee AS held_by, role FROM t_role_grants
          WHERE grantee_type <> 'USER'
        UNION SELECT reach.held_by, g.role FROM reach JOIN t_role_grants AS g
          ON reach.role = g.grantee AND g.grantee_type <> 'USER'""",
    "all_user_roles": """SELECT grantee AS "user", role FROM t_role_grants
          WHERE grantee_type = 'USER'
        UNION SELECT g.grantee, reach.role FROM t_role_grants AS g JOIN reach
          ON g.role = reach.held_by WHERE grantee_type = 'USER'""",
    "active_user_roles": """SELECT "user", role FROM all_user_roles
        WHERE "user" IN (SELECT name FROM t_users WHERE NOT disabled)""",
    "v01": """SELECT o."object", o.db, o."schema", o.grantee, d.asset IS NOT NULL AS has_db_permission,
        s.asset IS NOT NULL AS has_schema_permission FROM (
          SELECT DISTINCT asset AS "object", split_part(asset, '.', 1) AS db,
            split_part(asset, '.', 1) || '.' || split_part(asset, '.', 2) AS "schema", grantee
          FROM t_privilege_grants WHERE asset_type NOT IN ('DATABASE', 'SCHEMA') AND grantee <> '') AS o
        LEFT JOIN (SELECT DISTINCT asset, grantee FROM t_privilege_grants
          WHERE asset_type = 'DATABASE') AS d ON o.db = d.asset AND o.grantee = d.grantee
        LEFT JOIN (SELECT DISTINCT asset, grantee FROM t_privilege_grants
          WHERE asset_type = 'SCHEMA' AND privilege IN ('USAGE', 'OWNERSHIP')) AS s
          ON o."schema" = s.asset AND o.grantee = s.grantee""",
    "v02": """SELECT v01."object", v01.db, v01."schema", v01.grantee, u."user", u.role FROM v01
        JOIN active_user_roles AS u ON v01.grantee = u.role
        WHERE has_db_permission AND has_schema_permission""",
    "user_counts": """SELECT "object", count(DISTINCT "user") AS n_users FROM v02 GROUP BY ALL""",
    "working": """SELECT DISTINCT "object", grantee AS role FROM v01
        WHERE has_db_permission AND has_schema_permission""",
    "object_set_names": """SELECT "object", min("object") OVER (PARTITION BY roles) AS object_set FROM (
        SELECT "object", string_agg(role, chr(10) ORDER BY role) AS roles FROM working GROUP BY ALL)""",
    "useful_roles": """SELECT role FROM working
        UNION SELECT held_by FROM reach JOIN working USING (role)""",
    "profile_names": """SELECT "user", min("user") OVER (PARTITION BY roles) AS profile FROM (
        SELECT grantee AS "user", string_agg(DISTINCT role, chr(10) ORDER BY role) AS roles
        FROM t_role_grants WHERE grantee_type = 'USER' AND role IN (SELECT role FROM useful_roles)
          AND grantee IN (SELECT name FROM t_users WHERE NOT disabled) GROUP BY grantee)""",
    "c01": """SELECT DISTINCT role AS admin_role, "user" FROM all_user_roles
        WHERE role IN ('ACCOUNTADMIN', 'SECURITYADMIN')""",
    "c02": """SELECT "user" FROM c01 WHERE admin_role = 'ACCOUNTADMIN'""",
    "future_pairs": """SELECT DISTINCT split_part(set_on, '.', 1) AS db,
        CASE WHEN set_on LIKE '%"."%' THEN set_on END AS sch, asset_type, grantee
        FROM t_future_grants""",
    "c03": """SELECT s.sch AS "schema", s.asset_type, d.grantee AS role FROM
        (SELECT DISTINCT db, sch, asset_type FROM future_pairs WHERE sch IS NOT NULL) AS s
        JOIN future_pairs AS d ON d.sch IS NULL AND d.db = s.db AND d.asset_type = s.asset_type
        WHERE NOT EXISTS (SELECT 1 FROM future_pairs AS x WHERE x.sch = s.sch
          AND x.asset_type = s.asset_type AND x.grantee = d.grantee)""",
    "c05": """SELECT DISTINCT "user" FROM t_login_history WHERE success
        AND first_authentication_factor = 'PASSWORD' AND second_authentication_factor IS NULL""",
    "c06": """SELECT DISTINCT name AS "user", 'no_login_7d' AS reason FROM t_users WHERE NOT disabled
          AND name <> 'SNOWFLAKE' AND name NOT IN (SELECT "user" FROM t_login_history WHERE success)
        UNION ALL SELECT DISTINCT name, 'no_access_90d' FROM t_users WHERE NOT disabled
          AND name <> 'SNOWFLAKE' AND name NOT IN (SELECT "user" FROM usage_t)""",
    "c08": """SELECT grantee, "object", CASE WHEN NOT has_db_permission AND
        NOT has_schema_permission THEN 'both' WHEN NOT has_db_permission THEN 'database'
        ELSE 'schema' END AS missing_level FROM v01
        WHERE grantee <> 'ACCOUNTADMIN' AND NOT (has_db_permission AND has_schema_permission)""",
    "c12s": """SELECT fqn AS "schema", coalesce(own.types, inherited.types, '') AS asset_types,
        own.types IS NOT NULL OR inherited.types IS NOT NULL AS covered FROM t_schemas AS s
        LEFT JOIN (SELECT set_on, string_agg(DISTINCT asset_type, ',' ORDER BY asset_type)
          AS types FROM t_future_grants GROUP BY ALL) AS own ON own.set_on = fqn
        LEFT JOIN (SELECT set_on, string_agg(DISTINCT asset_type, ',' ORDER BY asset_type)
          AS types FROM t_future_grants WHERE asset_type <> 'SCHEMA' GROUP BY ALL) AS inherited
          ON inherited.set_on = '"' || s."database" || '"'
        WHERE s.name <> 'INFORMATION_SCHEMA'""",
    "c12d": """SELECT fqn AS db, fqn IN (SELECT set_on FROM t_future_grants
        WHERE asset_type = 'SCHEMA') AS covered FROM t_databases WHERE name <> 'SNOWFLAKE'""",
    "policy_rows": """SELECT CASE status WHEN 'ACTIVE' THEN 'active' ELSE 'misapplied' END
          AS kind, fqn AS policy, target_fqn AS target, status FROM t_masking_refs
        UNION ALL SELECT 'unused', fqn, NULL, NULL FROM t_masking_policies
          WHERE fqn NOT IN (SELECT fqn FROM t_masking_refs)""",
    "row_policy_rows": """SELECT CASE status WHEN 'ACTIVE' THEN 'active' ELSE 'misapplied' END
          AS kind, fqn AS policy, target_fqn AS target, status FROM t_row_access_refs
        UNION ALL SELECT 'unused', fqn, NULL, NULL FROM t_row_access_policies
          WHERE fqn NOT IN (SELECT fqn FROM t_row_access_refs)""",
    "active": """SELECT count(*) AS n FROM t_users WHERE NOT disabled""",
    "flagged_columns": r"""SELECT fqn, "schema", "table", regexp_extract(fqn, '^(.*)\."[^"]*"$', 1) AS obj,
        regexp_matches(lower(name), 'email|e-mail|cell|fax|phone|^ssn$|birth|born|^age$|^sex$|gender|mailing|address|street|^zip|^cc|credit_card|license_plate|^lat|^long|^ip|_ip$|first_name|last_name|firstname|lastname|^name$|^amount$|^paid$') AS sensitive,
        regexp_matches(lower(name), 'hashed|masked|safe') AS safe FROM t_columns""",
    "c17": """SELECT fqn, n_users FROM flagged_columns JOIN user_counts ON obj = "object"
        WHERE sensitive AND NOT safe AND n_users > (SELECT floor(greatest(3, n / 10)) FROM active)
        AND fqn NOT IN (SELECT target_fqn FROM t_masking_refs WHERE status = 'ACTIVE')""",
    "least_used": """SELECT fqn AS "object", coalesce(u, 0)::BIGINT AS usage_count FROM t_entities
        LEFT JOIN (SELECT "object", sum(usage_count) AS u FROM usage_t GROUP BY ALL) AS x
          ON x."object" = fqn
        WHERE entity_type IN ('TABLE', 'VIEW') AND "schema" <> 'INFORMATION_SCHEMA'
        ORDER BY usage_count, "object" LIMIT 10""",
    "metric_rows": """
        SELECT 'c01_admin_users' AS check_id, 'n_admins' AS metric,
          (SELECT count(DISTINCT "user") FROM c01)::DOUBLE AS value
        UNION ALL SELECT 'c01_admin_users', 'n_active', (SELECT n FROM active)
        UNION ALL SELECT 'c02_backup_admin', 'n_account_admins', (SELECT count(*) FROM c02)
        UNION ALL SELECT 'c03_shadow_grants', 'n_keys',
          (SELECT count(*) FROM (SELECT DISTINCT db, asset_type FROM future_pairs))
        UNION ALL SELECT 'c03_shadow_grants', 'n_affected_databases',
          (SELECT count(DISTINCT split_part("schema", '.', 1)) FROM c03)
        UNION ALL SELECT 'c04_network_policy', 'n_policies', (SELECT count(*) FROM t_network_policies)
        UNION ALL SELECT 'c05_password_only', 'n_logins',
          (SELECT count(*) FILTER (success) FROM t_login_history)
        UNION ALL SELECT 'c05_password_only', 'password_only_share', (SELECT share FROM pw)
        UNION ALL SELECT 'c05_password_only', 'password_only_percent',
          (SELECT round(share * 100, 2) FROM pw)
        UNION ALL SELECT 'c05_password_only', 'needs_password_policy',
          (SELECT (share * 100 > 5)::INT FROM pw)
        UNION ALL SELECT 'c06_inactive_users', 'n_no_login',
          (SELECT count(*) FROM c06 WHERE reason = 'no_login_7d')
        UNION ALL SELECT 'c06_inactive_users', 'n_no_access',
          (SELECT count(*) FROM c06 WHERE reason = 'no_access_90d')
        UNION ALL SELECT 'c07_managed_schemas', 'n_managed',
          (SELECT count(*) FROM t_schemas WHERE managed_access)
        UNION ALL SELECT 'c08_inaccessible_objects', 'n_blocked', (SELECT count(*) FROM c08)
        UNION ALL SELECT 'c08_inaccessible_objects', 'n_roles',
          (SELECT count(DISTINCT grantee) FROM c08)
        UNION ALL SELECT 'c09_most_used_tables', 'n_unreadable_log_rows', 0
        UNION ALL SELECT 'c10_most_used_columns', 'n_unreadable_log_rows', 0
        UNION ALL SELECT 'c12_future_grant_coverage', 'n_future_grants',
          (SELECT count(*) FROM t_future_grants)
        UNION ALL SELECT 'c12_future_grant_coverage', 'n_schemas', (SELECT count(*) FROM c12s)
        UNION ALL SELECT 'c12_future_grant_coverage', 'n_covered_schemas',
          (SELECT count(*) FROM c12s WHERE covered)
        UNION ALL SELECT 'c12_future_grant_coverage', 'n_databases', (SELECT count(*) FROM c12d)
        UNION ALL SELECT 'c12_future_grant_coverage', 'n_covered_databases',
          (SELECT count(*) FROM c12d WHERE covered)
        UNION ALL SELECT 'c15_masking_policies', 'n_policies',
          (SELECT count(*) FROM t_masking_policies)
        UNION ALL SELECT 'c15_masking_policies', 'n_' || k,
          (SELECT count(*) FROM policy_rows WHERE kind = k) FROM kinds
        UNION ALL SELECT 'c16_row_access_policies', 'n_policies',
          (SELECT count(*) FROM t_row_access_policies)
        UNION ALL SELECT 'c16_row_access_policies', 'n_' || k,
          (SELECT count(*) FROM row_policy_rows WHERE kind = k) FROM kinds
        UNION ALL SELECT 'c17_sensitive_columns', 'n_exposed', (SELECT count(*) FROM c17)
        UNION ALL SELECT 'c17_sensitive_columns', 'threshold',
          (SELECT floor(greatest(3, n / 10)) FROM active)
        UNION ALL SELECT 'c17_sensitive_columns', 'n_active', (SELECT n FROM active)""",
    "kinds": """SELECT unnest(['misapplied', 'unused', 'active']) AS k""",
    "pw": """SELECT count(*) FILTER (success AND first_authentication_factor = 'PASSWORD'
        AND second_authentication_factor IS NULL) / (count(*) FILTER (success))::DOUBLE AS share
        FROM t_login_history""",
    "scored": """SELECT check_id, title, score::DOUBLE AS score, n::BIGINT AS n_findings, inputs FROM (
        SELECT 'c01_admin_users' AS check_id, 'Users with Admin Roles' AS title,
          (SELECT CASE WHEN n <= 30 THEN CASE WHEN a <= 3 THEN 1 ELSE 0.49::DOUBLE END
            WHEN 1 - a / n::DOUBLE > 0.9 THEN 1 ELSE 1 - a / n::DOUBLE END
            FROM active, (SELECT count(DISTINCT "user") AS a FROM c01)) AS score,
          (SELECT count(*) FROM c01) AS n, 'role_grants,users' AS inputs
        UNION ALL SELECT 'c02_backup_admin', 'Backup Account Admin',
          (SELECT CASE WHEN count(*) > 1 THEN 1 ELSE 0.49::DOUBLE END FROM c02),
          (SELECT count(*) FROM c02), 'role_grants'
        UNION ALL SELECT 'c03_shadow_grants', 'Shadow Future Grants',
          1 - (SELECT count(DISTINCT split_part("schema", '.', 1)) FROM c03)
            / (SELECT count(*) FROM (SELECT DISTINCT db, asset_type FROM future_pairs))::DOUBLE,
          (SELECT count(*) FROM c03), 'future_grants'
        UNION ALL SELECT 'c04_network_policy', 'Active Network Policies',
          (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0.49::DOUBLE END FROM t_network_policies), 0,
          'network_policies'
        UNION ALL SELECT 'c05_password_only', 'Password-Only Logins', 1 - (SELECT share FROM pw),
          (SELECT count(*) FROM c05), 'login_history'
        UNION ALL SELECT 'c06_inactive_users', 'Inactive Users',
          (SELECT CASE WHEN count(*) FILTER (reason = 'no_access_90d') > 0 THEN 0.25::DOUBLE
            WHEN count(*) > 0 THEN 0.75::DOUBLE ELSE 1 END FROM c06),
          (SELECT count(*) FROM c06), 'login_history,users,usage_tables'
        UNION ALL SELECT 'c07_managed_schemas', 'Managed Access Schemas',
          (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE -1 END FROM t_schemas WHERE managed_access),
          (SELECT count(*) FROM t_schemas WHERE managed_access), 'schemas'
        UNION ALL SELECT 'c08_inaccessible_objects', 'Inaccessible Tables and Views',
          (SELECT CASE WHEN count(*) > 0 THEN 0.49::DOUBLE ELSE 1 END FROM c08),
          (SELECT count(*) FROM c08), 'privilege_grants'
        UNION ALL SELECT 'c09_most_used_tables', 'Most-Used Tables and Views', -2,
          (SELECT 2 * least(count(*), 10) FROM popular_t), 'usage_tables'
        UNION ALL SELECT 'c10_most_used_columns', 'Most-Used Columns', -2,
          (SELECT 2 * least(count(*), 10) FROM popular_c), 'usage_columns'
        UNION ALL SELECT 'c11_least_used_tables', 'Least-Used Tables and Views', -2,
          (SELECT count(*) FROM least_used), 'usage_tables,entities'
        UNION ALL SELECT 'c12_future_grant_coverage', 'Future Grant Coverage',
          (SELECT 1 - (1 - (s.c + d.c) / (s.n + d.n)::DOUBLE) / 2 FROM
            (SELECT count(*) AS n, count(*) FILTER (covered) AS c FROM c12s) AS s,
            (SELECT count(*) AS n, count(*) FILTER (covered) AS c FROM c12d) AS d),
          (SELECT count(*) FROM c12s) + (SELECT count(*) FROM c12d),
          'future_grants,schemas,databases'
        UNION ALL SELECT 'c13_most_accessible', 'Most-Accessible Tables and Views', -2,
          (SELECT least(count(*), 10) FROM user_counts), 'privilege_grants,role_grants'
        UNION ALL SELECT 'c14_least_accessible', 'Least-Accessible Tables and Views', -2,
          (SELECT least(count(*), 10) FROM parts), 'privilege_grants,role_grants'
        UNION ALL SELECT 'c15_masking_policies', 'Active Masking Policies',
          (SELECT CASE WHEN count(*) FILTER (kind = 'misapplied') > 0 THEN 0.48::DOUBLE
            WHEN count(*) FILTER (kind = 'unused') > 0 THEN 0.75::DOUBLE ELSE 1 END
            FROM policy_rows),
          (SELECT count(*) FROM policy_rows), 'masking_policies,masking_policy_references'
        UNION ALL SELECT 'c16_row_access_policies', 'Active Row Access Policies',
          (SELECT CASE WHEN count(*) FILTER (kind = 'misapplied') > 0 THEN 0.48::DOUBLE
            WHEN count(*) FILTER (kind = 'unused') > 0 THEN 0.75::DOUBLE ELSE 1 END
            FROM row_policy_rows),
          (SELECT count(*) FROM row_policy_rows),
          'row_access_policies,row_access_policy_references'
        UNION ALL SELECT 'c17_sensitive_columns', 'Potentially Sensitive Columns',
          (SELECT CASE WHEN count(*) > 0 THEN 0.89::DOUBLE ELSE 1 END FROM c17),
          (SELECT count(*) FROM c17), 'privilege_grants,role_grants,columns,users')""",
    "results": """SELECT *, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score = -2 THEN 'INSIGHT'
        WHEN score = -1 THEN 'INFO' WHEN score < 0.5 THEN 'FAIL' WHEN score < 0.9 THEN 'WARN'
        ELSE 'PASS' END AS status, CASE WHEN score IS NULL THEN 100 WHEN score = -2 THEN 99
        WHEN score = -1 THEN 98 ELSE score END AS sort_key FROM scored""",
    "raw_names": """SELECT DISTINCT CASE WHEN c_custkey % 10 = 0 THEN '"' || c_name || '"'
          ELSE c_name END AS raw_name FROM customer
        UNION SELECT db || '.' || CASE WHEN p % 7 = 0 THEN '"' || sch || '"' ELSE sch END
          || '.' || name FROM object_grants JOIN parts ON asset = obj""",
    "order_scores": """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL
        WHEN o_orderkey % 11 = 0 THEN -1 WHEN o_orderkey % 13 = 0 THEN -2
        ELSE (o_orderkey % 1001)::DOUBLE / 1000::DOUBLE END AS score FROM orders""",
}

RECURSIVE = {"reach"}


def _needed(sql: str) -> list[str]:
    """Names of the CTEs a statement depends on, in definition-safe order."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in CTES:
            if name in seen or name in order or not re.search(rf"\b{name}\b", text):
                continue
            visit(CTES[name], (*seen, name))
            order.append(name)

    visit(sql, ())
    return order


def _query(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in _needed(sql))
    return f"WITH RECURSIVE {ctes}\n{sql}" if ctes else sql


def _most_used(popular: str) -> str:
    text = (
        "'used ' || format('{:,}', usage_count) || CASE WHEN usage_count = 1 THEN ' time'"
        " ELSE ' times' END || ' by ' || format('{:,}', n_users)"
        " || CASE WHEN n_users = 1 THEN ' user' ELSE ' users' END"
    )
    return f"""SELECT ranking, rank::INT AS rank, "object", n_users, usage_count, {text} AS message
        FROM (SELECT 'usage' AS ranking, row_number() OVER (ORDER BY usage_count DESC,
            n_users DESC, "object") AS rank, * FROM {popular}
          UNION ALL SELECT 'users', row_number() OVER (ORDER BY n_users DESC,
            usage_count DESC, "object"), * FROM {popular}) WHERE rank <= 10"""


_GRADE = """CASE WHEN score IS NULL THEN '?' WHEN score >= 1 THEN 'A+' WHEN score < 0.25 THEN 'F'
    ELSE ['A+', 'A', 'A-', 'B+', 'B', 'B-', 'C+', 'C', 'C-', 'D+', 'D', 'D-', 'F'][
      ceil(12::DOUBLE - (score - 0.25::DOUBLE) / 0.75::DOUBLE * 11)::INT] END"""

_STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (status = '{s.upper()}') AS n_{s}"
    for s in ("fail", "warn", "pass", "info", "insight", "unknown")
)

_SNAPSHOT_ROWS = {
    "databases": "t_databases",
    "schemas": "t_schemas",
    "entities": "t_entities",
    "columns": "t_columns",
    "users": "t_users",
    "roles": "(SELECT DISTINCT role FROM t_role_grants)",
    "role_grants": "t_role_grants",
    "privilege_grants": "t_privilege_grants",
    "future_grants": "t_future_grants",
    "masking_policies": "t_masking_policies",
    "row_access_policies": "t_row_access_policies",
    "login_history": "t_login_history",
    "usage_tables": "usage_t",
    "usage_columns": "usage_c",
    "unreadable_log_rows": "(SELECT 1 WHERE false)",
    "masking_policy_references": "t_masking_refs",
    "row_access_policy_references": "t_row_access_refs",
    "network_policies": "t_network_policies",
}

SELECTS = {
    "src_databases": "SELECT * FROM t_databases",
    "src_schemas": "SELECT * FROM t_schemas",
    "src_entities": "SELECT * FROM t_entities",
    "src_columns": "SELECT * FROM t_columns",
    "src_users": "SELECT * FROM t_users",
    "src_roles": "SELECT DISTINCT role AS name, 'USERADMIN' AS owner FROM t_role_grants",
    "src_role_grants": "SELECT *, 'USERADMIN' AS granted_by FROM t_role_grants",
    "src_privilege_grants": """SELECT *, 'false' AS grant_option, 'SECURITYADMIN' AS granted_by
        FROM t_privilege_grants""",
    "src_future_grants": """SELECT *, 'false' AS grant_option, 'SELECT' AS privilege
        FROM t_future_grants""",
    "src_masking_policies": "SELECT * FROM t_masking_policies",
    "src_row_access_policies": "SELECT * FROM t_row_access_policies",
    "src_login_history": "SELECT * FROM t_login_history",
    "src_masking_policy_refs": "SELECT * FROM t_masking_refs",
    "src_row_access_policy_refs": "SELECT * FROM t_row_access_refs",
    "src_network_policy_flag": """SELECT count(*) > 0 AS has_network_policy
        FROM t_network_policies""",
    "snapshot_roundtrip": "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {source}) AS n_rows, 0::BIGINT AS n_changed"
        for name, source in _SNAPSHOT_ROWS.items()
    ),
    "fn_fqn_parts": """SELECT fqn, '"' || "database" || '"' AS db,
        '"' || "database" || '"."' || "schema" || '"' AS schema_fqn,
        '"' || "database" || '"."' || "schema" || '"."' || "table" || '"' AS table_fqn,
        '"' || "schema" || '"' AS schema_name, 'DATABASE' AS db_type, 'SCHEMA' AS schema_type,
        'TABLE' AS table_type, fqn AS requoted FROM t_columns""",
    "fn_identifier_cleanup": """SELECT raw_name,
        regexp_replace(regexp_replace(raw_name, '"$', ''), '^"', '') AS stripped,
        CASE WHEN raw_name LIKE '"%' THEN regexp_replace(regexp_replace(raw_name, '"$', ''),
          '^"', '') ELSE raw_name END AS cleaned,
        CASE WHEN raw_name LIKE '"%' THEN '"' || raw_name || '"' ELSE raw_name END AS asset_name,
        array_to_string(list_transform(string_split(raw_name, '.'), lambda x:
          CASE WHEN x LIKE '"%' THEN x ELSE '"' || x || '"' END), '.') AS quoted
        FROM raw_names""",
    "fn_future_grant_scope": """SELECT DISTINCT target, set_on FROM t_future_grants
        UNION SELECT db || '.' || CASE WHEN p % 7 = 0 THEN '"' || sch || '"' ELSE sch END
          || '.' || name || '.<TABLE>', obj FROM object_grants JOIN parts ON asset = obj""",
    "fn_sensitive_name": """SELECT fqn, sensitive, safe, sensitive AND NOT safe AS flagged
        FROM flagged_columns""",
    "fn_status": """SELECT o_orderkey, CASE WHEN score IS NULL THEN 'UNKNOWN'
        WHEN score = -2 THEN 'INSIGHT' WHEN score = -1 THEN 'INFO' WHEN score < 0.5 THEN 'FAIL'
        WHEN score < 0.9 THEN 'WARN' ELSE 'PASS' END AS status FROM order_scores""",
    "fn_grade": f"SELECT o_orderkey, {_GRADE} AS grade FROM order_scores",
    "fn_sort_key": """SELECT o_orderkey, (CASE WHEN score IS NULL THEN 100 WHEN score = -2 THEN 99
        WHEN score = -1 THEN 98 ELSE score END)::DOUBLE AS sort_key FROM order_scores""",
    "usage_tables": "SELECT * FROM usage_t",
    "usage_columns": "SELECT * FROM usage_c",
    "usage_sliding_tables": "SELECT * FROM usage_t",
    "usage_sliding_columns": "SELECT * FROM usage_c",
    "usage_popularity_tables": "SELECT * FROM popular_t",
    "usage_popularity_columns": "SELECT * FROM popular_c",
    "role_members_admin": 'SELECT admin_role AS root, "user" FROM c01',
    "role_edges": """SELECT DISTINCT role AS src, 'ROLE' AS src_type, grantee AS dst,
        grantee_type AS dst_type FROM t_role_grants""",
    "role_closure": "SELECT * FROM active_user_roles",
    "object_privileges_by_role": "SELECT * FROM v01",
    "user_object_access": "SELECT * FROM v02",
    "access_object_sets": """SELECT object_set, role, n_objects FROM working
        JOIN (SELECT object_set, count(*) AS n_objects FROM object_set_names GROUP BY ALL)
          ON "object" = object_set""",
    "access_profiles": """SELECT profile, role, n_users FROM active_user_roles
        JOIN (SELECT profile, count(*) AS n_users FROM profile_names GROUP BY ALL) ON "user" = profile
        WHERE role IN (SELECT role FROM working)""",
    "access_role_sizes": """SELECT role, count(DISTINCT "object") AS n_objects,
        count(DISTINCT "user") AS n_users, count(*) AS n_rows FROM v02 GROUP BY role""",
    "access_expanded": "SELECT * FROM v02",
    "access_of_one_user": """SELECT * FROM v02 WHERE "user" = (SELECT min("user") FROM v02)""",
    "access_of_one_object": """SELECT * FROM v02 WHERE "object" = (SELECT min("object") FROM working)""",
    "object_user_counts": "SELECT * FROM user_counts",
    "object_user_counts_bitmaps": "SELECT * FROM user_counts",
    "c01_admin_users": "SELECT * FROM c01",
    "c02_backup_admin": "SELECT * FROM c02",
    "c03_shadow_grants": "SELECT * FROM c03",
    "c04_network_policy": """SELECT check_id, score, status, n_findings FROM results
        WHERE check_id = 'c04_network_policy'""",
    "c05_password_only": "SELECT * FROM c05",
    "c06_inactive_users": "SELECT * FROM c06",
    "c07_managed_schemas": 'SELECT fqn AS "schema" FROM t_schemas WHERE managed_access',
    "c08_inaccessible_objects": "SELECT * FROM c08",
    "c08_inaccessible_schemas": """SELECT grantee, "schema", missing_level, count(*) AS n_objects
        FROM c08 JOIN v01 USING (grantee, "object") GROUP BY ALL""",
    "c09_most_used_tables": _most_used("popular_t"),
    "c10_most_used_columns": _most_used("popular_c"),
    "c11_least_used_tables": "SELECT * FROM least_used",
    "c12_schema_coverage": "SELECT * FROM c12s",
    "c12_database_coverage": "SELECT * FROM c12d",
    "c13_most_accessible": """SELECT * FROM user_counts WHERE "object" NOT LIKE '%INFORMATION%'
        ORDER BY n_users DESC, "object" LIMIT 10""",
    "c14_least_accessible": """SELECT fqn AS "object", coalesce(n_users, 0)::BIGINT AS n_users
        FROM t_entities LEFT JOIN user_counts ON fqn = "object"
        WHERE "schema" <> 'INFORMATION_SCHEMA' ORDER BY n_users, fqn LIMIT 10""",
    "c15_masking_policies": "SELECT * FROM policy_rows",
    "c16_row_access_policies": "SELECT * FROM row_policy_rows",
    "c17_sensitive_columns": "SELECT * FROM c17",
    "check_results": """SELECT check_id, title, round(score, 6) AS score, status, n_findings,
        round(sort_key, 6) AS sort_key, inputs FROM results""",
    "check_metrics": "SELECT check_id, metric, round(value, 6) AS value FROM metric_rows",
    "status_counts": f"SELECT {_STATUS_COUNTS} FROM results",
    "scorecard": f"""SELECT round(score, 6) AS score, {_GRADE} AS grade,
        n_fail, n_warn, n_pass, n_info, n_insight, n_unknown FROM (
        SELECT avg(score) FILTER (score >= 0) AS score, {_STATUS_COUNTS} FROM results)""",
    "snapshot_availability": """SELECT * FROM (VALUES ('all', true, true, true, false),
        ('required', true, false, false, false), ('partial', false, false, false, true))
        AS v(kind, has_data, enterprise, has_usage, failed),
        (SELECT count(*) AS n_users FROM customer)""",
    "gated_results": """SELECT check_id, CASE
        WHEN check_id IN ('c09_most_used_tables', 'c10_most_used_columns',
          'c11_least_used_tables', 'c16_row_access_policies') THEN 'INFO'
        WHEN check_id IN ('c08_inaccessible_objects', 'c13_most_accessible',
          'c14_least_accessible', 'c17_sensitive_columns') THEN 'UNKNOWN'
        WHEN check_id = 'c06_inactive_users' THEN (SELECT CASE WHEN count(*) > 0 THEN 'WARN'
          ELSE 'PASS' END FROM c06 WHERE reason = 'no_login_7d')
        ELSE status END AS status FROM results""",
    "report_results": """SELECT check_id, section, place::INT AS place, n_written FROM (
        SELECT check_id, n_findings AS n_written, section, row_number() OVER (
          ORDER BY section, sort_key, title) AS place FROM (SELECT *, list_position(
          ['FAIL', 'WARN', 'PASS', 'INFO', 'INSIGHT', 'UNKNOWN'], status) AS section FROM results))
        WHERE check_id <> 'c04_network_policy'""",
    "sql_check_example": """SELECT name FROM t_users WHERE has_password AND NOT disabled""",
}


_USED = ["message", "n_users", "object", "rank", "ranking", "usage_count"]

# Findings tables of a report: the query with their rows, and their columns by name.
REPORTED = {
    "c01_admin_users": ("c01_admin_users", ["admin_role", "user"]),
    "c02_backup_admin": ("c02_backup_admin", ["user"]),
    "c03_shadow_grants": ("c03_shadow_grants", ["asset_type", "role", "schema"]),
    "c05_password_only": ("c05_password_only", ["user"]),
    "c06_inactive_users": ("c06_inactive_users", ["reason", "user"]),
    "c07_managed_schemas": ("c07_managed_schemas", ["schema"]),
    "c08_inaccessible_objects": ("c08_inaccessible_objects", ["grantee", "missing_level", "object"]),
    "c09_most_used_tables": ("c09_most_used_tables", _USED),
    "c10_most_used_columns": ("c10_most_used_columns", _USED),
    "c11_least_used_tables": ("c11_least_used_tables", ["object", "usage_count"]),
    "c12_future_grant_coverage_schemas": ("c12_schema_coverage", ["asset_types", "covered", "schema"]),
    "c12_future_grant_coverage_databases": ("c12_database_coverage", ["covered", "db"]),
    "c13_most_accessible": ("c13_most_accessible", ["n_users", "object"]),
    "c14_least_accessible": ("c14_least_accessible", ["n_users", "object"]),
    "c15_masking_policies": ("c15_masking_policies", ["kind", "policy", "status", "target"]),
    "c16_row_access_policies": ("c16_row_access_policies", ["kind", "policy", "status", "target"]),
    "c17_sensitive_columns": ("c17_sensitive_columns", ["fqn", "n_users"]),
}


def _report_findings() -> str:
    parts = []
    for findings, (query, columns) in REPORTED.items():
        cells = ", ".join(f"coalesce(CAST(\"{name}\" AS VARCHAR), '~')" for name in columns)
        digest = f"CAST('0x' || substr(md5(concat_ws('|', {cells})), 1, 8) AS BIGINT)"
        parts.append(
            f"SELECT '{findings}' AS findings, count(*) AS n_rows, "
            f"CAST(coalesce(sum({digest}), 0) AS BIGINT) AS digest, 0::BIGINT AS n_out_of_order FROM ({SELECTS[query]})"
        )
    return "\nUNION ALL ".join(parts)


SELECTS["report_findings"] = _report_findings()


def oracle_sql() -> dict[str, str]:
    return {name: _query(sql) for name, sql in SELECTS.items()}
