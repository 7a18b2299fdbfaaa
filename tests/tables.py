"""Small hand-made snapshot tables."""

from __future__ import annotations

from grantlens.sources.schemas import RAW, SNAPSHOT
from grantlens.sources.snapshot import Snapshot


def q(*parts: str) -> str:
    return ".".join(f'"{p}"' for p in parts)


def table(spark, name, rows=()):
    """A snapshot table from dicts; columns left out are null."""
    return _frame(spark, SNAPSHOT[name], rows)


def raw(spark, name, rows=()):
    return _frame(spark, RAW[name], rows)


def _frame(spark, ddl, rows):
    names = [part.strip().split(" ")[0] for part in ddl.split(",")]
    unknown = {key for row in rows for key in row} - set(names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], ddl)


def database(name):
    return {"name": name, "owner": "SYSADMIN", "fqn": q(name)}


def schema(db, name, managed=False):
    return {"name": name, "database": db, "managed_access": managed, "fqn": q(db, name)}


def entity(db, sch, name, kind="TABLE"):
    return {
        "name": name, "database": db, "schema": sch, "entity_type": kind, "fqn": q(db, sch, name),
    }


def column(db, sch, tab, name):
    return {
        "name": name, "database": db, "schema": sch, "table": tab, "fqn": q(db, sch, tab, name),
    }


def user(name, disabled=False):
    return {"name": name, "disabled": disabled, "has_password": True}


def to_user(role, name):
    return {"role": role, "grantee": name, "grantee_type": "USER"}


def to_role(role, name):
    return {"role": role, "grantee": name, "grantee_type": "ROLE"}


def privilege(asset, kind, grantee, name="USAGE"):
    return {"asset": asset, "asset_type": kind, "grantee": grantee, "privilege": name}


def future(set_on, kind, grantee):
    return {"set_on": set_on, "asset_type": kind, "grantee": grantee, "privilege": "SELECT"}


def snapshot(spark, **rows):
    """A snapshot with the given tables; databases are always collected."""
    rows.setdefault("databases", [database("DB")])
    return Snapshot(**{name: table(spark, name, r) for name, r in rows.items()})


def empty_snapshot(spark):
    return Snapshot(**{name: table(spark, name) for name in SNAPSHOT})
