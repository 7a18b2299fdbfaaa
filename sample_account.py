"""A sample account derived from TPC-H-like tables, in the raw export shapes.

Every table is a plan over the given files, so its size follows theirs: customers are
users, parts are tables and views, line items are privileges and queries, events are
logins. FIXTURES.md lists the rules.
"""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantlens.sources.raw import RawTables
from grantlens.sources.schemas import RAW, raw_source
from grantlens.sources.snapshot import Snapshot
from grantlens.workspace import Workspace

# When the history windows end; the data goes on after them.
LOGIN_AS_OF = "2024-01-20"
ACCESS_AS_OF = "2001-06-01"

# Columns of every sample table, by position.
COLUMN_NAMES = [
    "id",
    "email",
    "PHONE",
    "phone_hashed",
    "zip_code",
    "amount",
    "order_total",
    "client_ip",
]

def _text(value: str) -> Column:
    return F.lit(value)


def _none() -> Column:
    return F.lit(None).cast("string")


class SampleAccount:
    """Raw tables of the sample account over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        root = folder.rstrip("/")
        self._spark = spark
        self._read = cache(lambda name: spark.read.parquet(f"{root}/{name}.parquet"))

    @cached_property
    def _regions(self) -> DataFrame:
        safe = F.replace("r_name", F.lit(" "), F.lit("_"))
        return self._read("region").select(
            "r_regionkey",
            F.concat(F.lit("DB_"), safe).alias("db"),
            F.concat(safe, F.lit("_READ")).alias("region_read"),
        )

    @cached_property
    def _geo(self) -> DataFrame:
        """One row per nation with its database."""
        nation = self._read("nation")
        return nation.join(
            self._regions, nation["n_regionkey"] == F.col("r_regionkey")
        ).select("n_nationkey", "n_name", "r_regionkey", "db", "region_read")

    @cached_property
    def _nations(self) -> Column:
        """Number of nations, as a scalar subquery."""
        return self._read("nation").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def _dealings(self) -> DataFrame:
        """(buyer, n, grantee_name): nations whose customers bought from the nation n, which is named."""
        lines = self._read("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
        orders = self._read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")
        )
        customer = self._read("customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
        supplier = self._read("supplier").select("s_suppkey", F.col("s_nationkey").alias("n"))
        nation = self._read("nation").select(
            F.col("n_nationkey").alias("n"), F.col("n_name").alias("grantee_name")
        )
        # Customers go to orders, of which there are fewer than lines; hashed, neither side of an order's join is sorted.
        buyers = orders.join(customer, "c_custkey").select("l_orderkey", "buyer")
        bought = lines.join(supplier, "s_suppkey").join(buyers.hint("shuffle_hash"), "l_orderkey")
        pairs = bought.select("buyer", "n").distinct()
        # Pairs of nations: stored, since several grants of several tables read them.
        return Workspace(self._spark).stage(pairs.join(nation, "n"), "dealings").df

    def _grantees(self, assets: DataFrame, key: str) -> DataFrame:
        """Each asset with the nations (n, grantee_name) that deal with its own, or with its region's."""
        home = self._geo.select(F.col("n_nationkey").alias("buyer"), F.col("r_regionkey").alias("home"))
        if key == "r_regionkey":
            dealt = self._dealings.join(home, "buyer").select("home", "n", "grantee_name").distinct()
            return assets.join(dealt, assets[key] == dealt["home"]).drop("home")
        return assets.join(self._dealings, assets[key] == self._dealings["buyer"]).drop("buyer")

    @cached_property
    def _once(self) -> DataFrame:
        return self._regions.filter("r_regionkey = 0")

    @cached_property
    def _parts(self) -> DataFrame:
        """(p_partkey, db, schema, name, kind) of the sample tables and views."""
        kind = (
            F.when(F.col("p_type") == "PROMO", "VIEW")
            .when(F.col("p_type") == "LARGE", "STAGE")
            .otherwise("TABLE")
        )
        part = self._read("part").select(
            "p_partkey",
            F.concat(F.lit("T_"), F.col("p_partkey").cast("string")).alias("name"),
            kind.alias("kind"),
            (F.col("p_partkey") % self._nations).cast("int").alias("n_nationkey"),
        )
        home = F.broadcast(self._geo.select("n_nationkey", "db", F.col("n_name").alias("schema")))
        # Parts are few bytes but become many names: they are dealt out, as the file alone is read by a task or two.
        parts = part.join(home, "n_nationkey").select("p_partkey", "db", "schema", "name", "kind")
        return parts.repartition("p_partkey")

    def databases(self) -> DataFrame:
        own = self._regions.select(F.col("db").alias("name"), _text("SYSADMIN").alias("owner"))
        system = self._once.select(_text("SNOWFLAKE").alias("name"), _text("").alias("owner"))
        return own.unionByName(system)

    def schemas(self) -> DataFrame:
        managed = F.when(F.col("n_nationkey") % 5 == 0, "MANAGED ACCESS").otherwise("")
        own = self._geo.select(
            F.col("n_name").alias("name"),
            F.col("db").alias("database_name"),
            F.when(F.col("n_nationkey") % 2 == 1, '"SYSADMIN"').otherwise("SYSADMIN").alias("owner"),
            managed.alias("options"),
        )
        system = self._regions.select(
            _text("INFORMATION_SCHEMA").alias("name"),
            F.col("db").alias("database_name"),
            _text("").alias("owner"),
            _text("").alias("options"),
        )
        return own.unionByName(system)

    def entities(self) -> DataFrame:
        own = self._parts.select(
            "name",
            F.col("db").alias("database_name"),
            F.col("schema").alias("schema_name"),
            _text("SYSADMIN").alias("owner"),
            "kind",
        )
        system = self._regions.select(
            _text("TABLES").alias("name"),
            F.col("db").alias("database_name"),
            _text("INFORMATION_SCHEMA").alias("schema_name"),
            _text("").alias("owner"),
            _text("VIEW").alias("kind"),
        )
        return own.unionByName(system)

    def columns(self) -> DataFrame:
        names = F.array(*[F.lit(n) for n in COLUMN_NAMES])
        return (
            self._parts
            .select("p_partkey", "db", "schema", "name", F.posexplode(names).alias("i", "column"))
            .filter((F.col("p_partkey") + F.col("i")) % 3 != 0)
            .select(
                F.col("column").alias("column_name"),
                F.col("db").alias("database_name"),
                F.col("schema").alias("schema_name"),
                F.col("name").alias("table_name"),
            )
        )

    def users(self) -> DataFrame:
        def flag(condition: Column) -> Column:
            return F.when(condition, "true").otherwise("false")

        last = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(
            secs=F.col("c_custkey").cast("decimal(18,6)")
        )
        name = F.when(F.col("c_custkey") % 500 == 7, "SNOWFLAKE").otherwise(F.col("c_name"))
        return self._read("customer").select(
            name.alias("name"),
            flag(F.col("c_acctbal") < 0).alias("disabled"),
            _text("USERADMIN").alias("owner"),
            last.alias("last_success_login"),
            flag(F.col("c_mktsegment") != "MACHINERY").alias("has_password"),
        )

    def role_grants(self) -> DataFrame:
        geo = self._geo
        customer = self._read("customer").withColumn(
            "user",
            F.when(
                F.col("c_custkey") % 10 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
            ).otherwise(F.col("c_name")),
        )

        def grants(rows: DataFrame, role: Column, grantee: Column, kind: str) -> DataFrame:
            return rows.select(
                role.alias("role"),
                _text(kind).alias("granted_to"),
                grantee.alias("grantee_name"),
                _text("USERADMIN").alias("granted_by"),
            )

        homes = customer.join(F.broadcast(geo), customer["c_nationkey"] == geo["n_nationkey"])
        user, nation = F.col("user"), F.col("n_name")
        neighbour = F.concat(
            F.lit("NATION_"), ((F.col("n_nationkey") + 5) % self._nations).cast("string")
        )
        fixed = [
            ("SECURITYADMIN", "ACCOUNTADMIN"),
            ("CYCLE_A", "CYCLE_B"),
            ("CYCLE_B", "CYCLE_A"),
            ("CYCLE_A", "NATION_3"),
        ]
        pairs = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g")) for r, g in fixed])
        inner = self._once.select(F.inline(pairs))
        key = F.col("c_custkey")
        extra_roles = F.array_compact(
            F.array(
                F.when(key % 3 == 0, F.concat(F.lit("SEG_"), F.col("c_mktsegment"))),
                F.when(key % 97 == 0, "ACCOUNTADMIN"),
                F.when(key % 89 == 0, "SECURITYADMIN"),
            )
        )
        extra = customer.select("user", F.explode(extra_roles).alias("extra"))
        return (
            grants(homes, nation, user, "USER")
            .unionByName(grants(extra, F.col("extra"), user, "USER"))
            .unionByName(grants(geo, F.col("region_read"), nation, "ROLE"))
            .unionByName(
                grants(
                    self._regions.filter("r_regionkey % 2 = 0"),
                    _text("GLOBAL_READ"),
                    F.col("region_read"),
                    "ROLE",
                )
            )
            .unionByName(grants(geo.filter("n_nationkey % 4 = 0"), neighbour, nation, "ROLE"))
            .unionByName(grants(inner, F.col("r"), F.col("g"), "ROLE"))
        )

    def roles(self) -> DataFrame:
        return self.role_grants().select(
            F.col("role").alias("name"), _text("USERADMIN").alias("owner")
        ).distinct()

    def privilege_grants(self) -> DataFrame:
        def grants(
            rows: DataFrame, privilege: Column, kind: Column, asset: Column, to: str = "ROLE"
        ) -> DataFrame:
            return rows.select(
                privilege.alias("privilege"),
                kind.alias("granted_on"),
                asset.alias("name"),
                _text(to).alias("granted_to"),
                "grantee_name",
                _text("false").alias("grant_option"),
                _text("SECURITYADMIN").alias("granted_by"),
            )

        usage = _text("USAGE")
        geo = self._geo
        schema = F.concat_ws(".", "db", "n_name")
        on_schema = self._grantees(geo, "n_nationkey")
        to_role = (F.col("n_nationkey") * 7 + F.col("n")) % 3 != 0
        on_database = self._grantees(self._regions, "r_regionkey")
        own = geo.withColumn("grantee_name", F.col("n_name"))
        return (
            grants(
                self._object_grants(),
                F.col("privilege"),
                F.col("kind"),
                F.col("asset"),
            )
            .unionByName(grants(on_schema.filter(to_role), usage, _text("SCHEMA"), schema))
            .unionByName(
                grants(
                    on_schema.filter("n = n_nationkey"), _text("MONITOR"), _text("SCHEMA"), schema
                )
            )
            .unionByName(
                grants(
                    on_database.filter("(r_regionkey + n) % 4 <> 0"),
                    usage,
                    _text("DATABASE"),
                    F.col("db"),
                )
            )
            .unionByName(grants(own, usage, _text("ROLE"), F.col("region_read")))
            .unionByName(grants(own, usage, _text("DATABASE"), F.col("db"), "DATABASE_ROLE"))
        )

    def _object_grants(self) -> DataFrame:
        """The nation of each line item's supplier may use the part's table.

        Some grants go to nobody, some to the administrator.
        """
        lines = self._read("lineitem")
        supplier = self._read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        nation = self._read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        # Grantees by number, of which there are few: nobody, the administrator, and the nations' names.
        first = Window.orderBy("n_name")
        number = F.when(F.col("n_name") == "", 0).when(F.col("n_name") == "ACCOUNTADMIN", 1).otherwise(F.row_number().over(first) + 1)
        fixed = self._spark.range(0, 1, 1, 1).select(F.explode(F.array(_text(""), _text("ACCOUNTADMIN"))).alias("n_name"))
        names = nation.select("n_name").unionByName(fixed).distinct().select(F.col("n_name").alias("grantee_name"), number.alias("number"))
        numbered = nation.join(F.broadcast(names), F.col("n_name").eqNullSafe(F.col("grantee_name"))).select("s_nationkey", "number")
        part, flag = F.col("p_partkey"), F.col("l_returnflag")
        privilege = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
        grantee = (
            F.when((part % 90 == 4) & (flag == "R"), 0)
            .when((part % 90 == 5) & (flag == "R"), 1)
            .otherwise(F.col("number"))
        )
        # Made distinct as two numbers, the part's, which its name ends with, and one of the grant: names are joined
        # once all rows are different.
        granted = (
            lines.join(supplier, "l_suppkey")
            .join(F.broadcast(numbered), "s_nationkey")
            .withColumn("p_partkey", F.col("l_partkey"))
            .select("p_partkey", (grantee * 3 + privilege).alias("grant"))
            .repartition("p_partkey")
            .distinct()
        )
        kind = F.col("grant") % 3
        named = granted.withColumn("number", F.floor(F.col("grant") / 3).cast("int")).join(F.broadcast(names), "number")
        schema = F.when(part % 7 == 0, F.concat(F.lit('"'), F.col("schema"), F.lit('"'))).otherwise(F.col("schema"))
        assets = self._parts.select("p_partkey", "kind", F.concat_ws(".", "db", schema, "name").alias("asset"))
        return named.join(assets.distinct().hint("shuffle_hash"), "p_partkey").select(
            F.when(kind == 0, "SELECT").when(kind == 1, "INSERT").otherwise("UPDATE").alias("privilege"),
            "kind",
            "asset",
            "grantee_name",
        )

    def future_grants(self) -> DataFrame:
        def grants(rows: DataFrame, kind: str, scope: Column) -> DataFrame:
            return rows.select(
                _text("SELECT").alias("privilege"),
                _text(kind).alias("grant_on"),
                F.concat(scope, F.lit(f".<{kind}>")).alias("name"),
                "grantee_name",
                _text("false").alias("grant_option"),
            )

        on_database = self._grantees(self._regions, "r_regionkey")
        on_schema = self._grantees(self._geo, "n_nationkey")
        db = F.col("db")
        return (
            grants(
                on_database.filter("r_regionkey <> 3 AND (r_regionkey * 3 + n) % 7 = 0"),
                "TABLE",
                db,
            )
            .unionByName(
                grants(on_database.filter("r_regionkey % 2 = 0 AND n % 9 = 0"), "SCHEMA", db)
            )
            .unionByName(grants(on_database.filter("r_regionkey = 1 AND n % 5 = 0"), "VIEW", db))
            .unionByName(
                grants(
                    on_schema.filter("n_nationkey % 3 = 0 AND (n_nationkey + n) % 6 = 0"),
                    "TABLE",
                    F.concat_ws(".", "db", "n_name"),
                )
            )
        )

    def _policies(self, prefix: str, every: int) -> DataFrame:
        """A policy for every so many parts, numbered, in the schema NATION_0."""
        part = F.col("p_partkey")
        return self._read("part").filter(part % every == 0).select(
            F.concat(F.lit(prefix), F.floor(part / every).cast("string")).alias("name"),
            _text("DB_AFRICA").alias("database_name"),
            _text("NATION_0").alias("schema_name"),
            _text("SYSADMIN").alias("owner"),
        )

    def masking_policies(self) -> DataFrame:
        return self._policies("MP_", 30)

    def row_access_policies(self) -> DataFrame:
        return self._policies("RP_", 80)

    def policy_references(self) -> DataFrame:
        part = F.col("p_partkey")
        parts = self._parts
        tag = lambda value: F.when(part % 80 == 0, value)

        def references(every: int, kind: str, policy: Column, column: Column, status: Column):
            return parts.filter(part % every == 0).select(
                _text(kind).alias("POLICY_KIND"),
                policy.alias("POLICY_NAME"),
                _text("DB_AFRICA").alias("POLICY_DB"),
                _text("NATION_0").alias("POLICY_SCHEMA"),
                part.alias("POLICY_ID"),
                status.alias("POLICY_STATUS"),
                F.col("db").alias("REF_DATABASE_NAME"),
                F.col("schema").alias("REF_SCHEMA_NAME"),
                F.col("name").alias("REF_ENTITY_NAME"),
                column.alias("REF_COLUMN_NAME"),
                tag("DB_AFRICA").alias("TAG_DATABASE"),
                tag("NATION_0").alias("TAG_SCHEMA"),
                tag("PII").alias("TAG_NAME"),
            )

        def numbered(prefix: str, every: int) -> Column:
            return F.concat(F.lit(prefix), F.floor(part / every).cast("string"))

        active = _text("ACTIVE")
        sometimes = F.when(part % 200 == 0, "INACTIVE").otherwise("ACTIVE")
        masking = numbered("MP_", 40)
        rows = numbered("RP_", 100)
        return (
            references(40, "MASKING_POLICY", masking, _text("email"), sometimes)
            .unionByName(references(100, "ROW_ACCESS_POLICY", rows, _none(), active))
            .unionByName(references(150, "PASSWORD_POLICY", _text("PP"), _none(), active))
        )

    def login_history(self) -> DataFrame:
        kind = F.col("event_type")
        first = (
            F.when(kind == "purchase", "OAUTH_ACCESS_TOKEN")
            .when(kind == "signup", "RSA_KEYPAIR")
            .otherwise("PASSWORD")
        )
        number = F.lpad(F.col("user_id").cast("string"), 9, "0")
        return self._read("events").select(
            F.concat(F.lit("Customer#"), number).alias("USER_NAME"),
            first.alias("FIRST_AUTHENTICATION_FACTOR"),
            F.when(kind == "view", "DUO_PUSH").alias("SECOND_AUTHENTICATION_FACTOR"),
            F.when(kind != "error", "YES").otherwise("NO").alias("IS_SUCCESS"),
            F.col("ts").cast("timestamp").alias("EVENT_TIMESTAMP"),
        )

    def access_history(self) -> DataFrame:
        """One query per line item.

        Its JSON names the part's entity, names it again without columns on every
        third line, and holds a stage and an entry without a domain.
        """
        part, line = F.col("p_partkey"), F.col("l_linenumber")
        lines = self._read("lineitem").select(
            "l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber"
        )
        orders = self._read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"
        )
        full_name = F.concat_ws(".", "db", "schema", "name")
        domain = F.initcap("kind")
        columns = F.filter(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.lit(n).alias("columnName"))
                    for i, n in enumerate(COLUMN_NAMES)
                ]
            ),
            lambda c: (part + c["i"]) % 3 != 0,
        )
        column_names = F.transform(columns, lambda c: F.struct(c["columnName"].alias("columnName")))
        no_columns = F.lit(None).cast("array<struct<columnName:string>>")

        def entry(kind: Column, name: Column, touched: Column) -> Column:
            return F.struct(
                kind.alias("objectDomain"), name.alias("objectName"), touched.alias("columns")
            )

        used = entry(domain, full_name, F.when(line % 4 != 0, column_names))
        again = entry(domain, full_name, no_columns)
        stage = entry(_text("Stage"), F.concat(full_name, F.lit("_STAGE")), no_columns)
        odd = entry(_none(), full_name, no_columns)
        touched = F.when(line % 3 == 0, F.array(used, stage, again, odd)).otherwise(
            F.array(used, stage)
        )
        number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
        return (
            lines.join(orders.hint("shuffle_hash"), "l_orderkey")
            .join(self._parts, "p_partkey")
            .select(
                F.concat(F.lit("Customer#"), number).alias("USER_NAME"),
                F.to_json(touched).alias("DIRECT_OBJECTS_ACCESSED"),
                F.col("o_orderdate").cast("timestamp").alias("QUERY_START_TIME"),
            )
        )

    def network_policies(self) -> DataFrame:
        return self._read("supplier").filter("s_suppkey % 5 = 0").select(
            F.concat(F.lit("NP_"), F.col("s_suppkey").cast("string")).alias("name")
        )

    def raw(self, *names: str) -> RawTables:
        """The named raw tables, or all of them; the others count as not collected."""
        return {name: getattr(self, name)() for name in names or RAW}

    def snapshot(self, workspace: Workspace | None = None, *tables: str) -> Snapshot:
        """The snapshot, or the part of it that the named tables need."""
        names = dict.fromkeys(raw_source(table) for table in tables)
        return Snapshot.from_raw(
            self.raw(*names),
            login_as_of=F.lit(LOGIN_AS_OF).cast("timestamp"),
            access_as_of=F.lit(ACCESS_AS_OF).cast("timestamp"),
            workspace=workspace,
        )
