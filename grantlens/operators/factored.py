"""Who reaches which object as a factorised relation, expanded only where somebody asks.

The rows of ``user_object_access`` repeat every user of a role for every object of the role. Here objects
with the same roles are one set and users with the same roles one profile; two tables say which roles each
of them has. Together they hold every row and grow with the grants, not with users times objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.functions.identifiers import truncated_database, truncated_schema
from grantlens.operators.access import RoleSets
from grantlens.operators.skew import balanced_join, crossed_join, lookup_join
from grantlens.workspace import Stage, Workspace, side_by_side

TABLES = ("objects", "object_sets", "users", "profiles")


@dataclass(frozen=True)
class FactoredAccess:
    """The factors, and the members of their sets."""

    objects: Stage  # object, object_set
    object_sets: Stage  # object_set, role, n_objects
    users: Stage  # user, profile
    profiles: Stage  # profile, role, n_users

    @classmethod
    def of(cls, sets: RoleSets) -> FactoredAccess:
        return cls(
            Stage(sets.objects.df.withColumnRenamed("set_id", "object_set"), sets.objects.rows),
            Stage(sets.asking.df.select(F.col("set_id").alias("object_set"), "role", F.col("weight").alias("n_objects")), sets.asking.rows),
            Stage(sets.people.df.withColumnRenamed("set_id", "profile"), sets.people.rows),
            Stage(sets.reach.df.select("profile", "role", F.col("weight").alias("n_users")), sets.reach.rows),
        )

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Keep the factors as parquet folders."""
        stages = {name: getattr(self, name).df for name in TABLES}
        side_by_side(
            stages["objects"].sparkSession,
            lambda name: stages[name].write.mode(mode).parquet(f"{path.rstrip('/')}/{name}"),
            TABLES,
        )

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> FactoredAccess:
        tables = [spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES]
        return cls(*[Stage(df, df.count()) for df in tables])

    def role_sizes(self) -> DataFrame:
        """(role, n_objects, n_users, n_rows): the size of the expanded relation, role by role."""
        objects = self.object_sets.df.groupBy("role").agg(F.sum("n_objects").alias("n_objects"))
        users = self.profiles.df.groupBy("role").agg(F.sum("n_users").alias("n_users"))
        both = objects.join(users, "role")
        return both.withColumn("n_rows", F.col("n_objects") * F.col("n_users"))

    def expand(
        self, workspace: Workspace, objects: Column | None = None, users: Column | None = None
    ) -> DataFrame:
        """The rows of ``user_object_access`` for some objects and users, or all.

        ``objects`` is a condition on object, db and schema, ``users`` one on user. Sets and profiles without
        a chosen member are left out before anything meets, and roles that only one side has; an object of a role
        that is left has a user and the other way round, so nothing on the way is larger than the answer.
        """
        members = self.objects.df.withColumns(
            {"db": truncated_database("object"), "schema": truncated_schema("object")}
        )
        asked, held, people = self.object_sets, self.profiles, self.users
        chosen = Stage(members, self.objects.rows)
        if objects is not None:
            chosen = workspace.stage(members.filter(objects), "chosen-objects")
            asked = _of_members(workspace, asked, chosen, "object_set")
        if users is not None:
            people = workspace.stage(people.df.filter(users), "chosen-users")
            held = _of_members(workspace, held, people, "profile")
        asked, held = (
            _of_members(workspace, factor, other, "role", spread)
            for factor, other, spread in ((asked, held, "object_set"), (held, asked, "profile"))
        )
        grantee = F.col("role").alias("grantee")

        def objects_of_roles() -> Stage:
            opened = balanced_join(workspace, asked, chosen, ["object_set"], "inner", "role", "object")
            return workspace.stage(opened.select("object", "db", "schema", grantee), "objects-of-roles")

        def users_of_roles() -> Stage:
            opened = balanced_join(workspace, held, people, ["profile"], "inner", "role", "user")
            return workspace.stage(opened.select("user", "role", grantee), "users-of-roles")

        sides = side_by_side(workspace.spark, lambda opened: opened(), (objects_of_roles, users_of_roles))
        rows = crossed_join(workspace, *sides, ["grantee"], "object", "user")
        return rows.select("object", "db", "schema", "grantee", "user", "role")


def _of_members(workspace: Workspace, factor: Stage, members: Stage, key: str, spread: str = "role") -> Stage:
    """The rows of a factor whose set, or other key, has one of the members."""
    keys = Stage(members.df.select(key).distinct(), members.rows)
    return workspace.stage(
        lookup_join(workspace, factor.df, keys, [key], "left_semi", spread=spread), f"chosen-{key}"
    )
