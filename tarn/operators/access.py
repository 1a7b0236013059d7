"""Who may see what: audits over exported metadata tables.

``users(user_id, role, is_active)``, ``workspaces(workspace_id, name, ...)``,
``members(workspace_id, user_id, role)``, ``catalogs(catalog_id, name, owner_workspace_id, created_at,
deleted_at, ...)``, ``schemas(schema_id, catalog_id)``,
``grants(access_id, catalog_id, workspace_id, mode, status, suspended, requested_at)``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.text import same_name
from tarn.operators.intervals import at_day
from tarn.operators.ranking import first_per_key
from tarn.session import cut_lineage

# Role and access names.
SUPERUSER = "superadmin"
RANKS = {"read": 1, "write": 2, "owner": 3}
#: Workspaces of one user, or of one catalog, that are listed beside each of its rows.
MOST_LISTED = 256
#: Workspaces of a catalog that travel with each pair that is asked for.
MOST_CARRIED = 64


def _rank(mode: Column) -> Column:
    return F.when(mode == "owner", 3).when(mode == "write", 2).when(mode == "read", 1)


def _mode(rank: Column) -> Column:
    return F.when(rank == 3, "owner").when(rank == 2, "write").when(rank == 1, "read")


def _in_force(grants: DataFrame) -> DataFrame:
    """Approved grants that are not suspended."""
    return grants.where((F.col("status") == "approved") & ~F.col("suspended"))


def effective_access(
    asked: DataFrame, users: DataFrame, members: DataFrame, catalogs: DataFrame, grants: DataFrame
) -> DataFrame:
    """Access of each asked ``(user_id, catalog_id)`` pair: owner, write, read or NULL.

    Superusers and members of the owning workspace are owners; others get the strongest grant of any
    of their workspaces. All joins are on keys; pairs nobody asks about never arise.

    A catalog's workspaces travel with its pairs as lists, and meet the user's list where the user's pairs are: a pair is one row all the way,
    however many workspaces it is looked up in. Catalogs of more than ``MOST_CARRIED`` workspaces and users of more than
    ``MOST_LISTED`` have no lists; their pairs are looked up by rows, through the shorter of both sides.
    """
    membership = members.select("user_id", "workspace_id").where(F.col("workspace_id").isNotNull()).distinct()
    owners = catalogs.select("catalog_id", F.col("owner_workspace_id").alias("workspace_id"), F.lit(RANKS["owner"]).alias("_rank"))
    shares = owners.unionByName(_in_force(grants).select("catalog_id", "workspace_id", _rank(F.col("mode")).alias("_rank"))).dropna()
    levels = sorted(RANKS.values(), reverse=True)
    few = F.count("*") <= MOST_CARRIED
    lists = [F.when(few, F.collect_set(F.when(F.col("_rank") == n, F.col("workspace_id")))).alias(f"_shared_{n}") for n in levels]
    by_catalog = _first_of("catalog_id", shares, MOST_CARRIED + 1).groupBy("catalog_id").agg((~few).alias("_more"), *lists)
    # A superuser's mark is a row without a workspace, which comes first.
    superusers = users.where(F.col("role") == SUPERUSER).select("user_id", F.lit(None).alias("workspace_id")).distinct()
    few = F.count("workspace_id") <= MOST_LISTED
    mine = F.when(few, F.collect_list("workspace_id")).alias("_mine")
    by_user = _first_of("user_id", superusers.unionByName(membership), MOST_LISTED + 1).groupBy("user_id")
    by_user = by_user.agg((~few).alias("_many"), F.bool_or(F.col("workspace_id").isNull()).alias("_super"), mine)
    level = F.when(F.col("_super"), RANKS["owner"])
    for n in levels:
        level = level.when(F.arrays_overlap("_mine", f"_shared_{n}"), n)
    pairs = asked.select("user_id", "catalog_id").distinct()
    met = pairs.join(by_catalog, "catalog_id", "left").join(by_user, "user_id", "left")
    no = F.lit(False)
    unlisted = (F.coalesce("_more", no) | F.coalesce("_many", no)) & ~F.coalesce("_super", no)
    known = cut_lineage(met.select("user_id", "catalog_id", level.alias("_rank"), unlisted.alias("_unlisted")))
    rest = known.where("_unlisted").select("user_id", "catalog_id")
    if rest.isEmpty():
        return known.select("user_id", "catalog_id", _mode(F.col("_rank")).alias("access"))
    common = _common_workspaces(rest, membership, shares.select("catalog_id", "workspace_id").distinct())
    found = common.join(shares, ["catalog_id", "workspace_id"]).select("user_id", "catalog_id", "_rank")
    # One aggregation over what is known and what was found, instead of a join back.
    every = known.drop("_unlisted").unionByName(found)
    return every.groupBy("user_id", "catalog_id").agg(_mode(F.max("_rank")).alias("access"))


def _first_of(key: str, rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of each ``key``, lowest workspaces first; cut in each task before the shuffle."""
    place = F.row_number().over(W.partitionBy(key).orderBy("workspace_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def allowed(access: Column, require: str) -> Column:
    """Whether an access level covers what an action requires."""
    return F.coalesce(_rank(access) >= RANKS[require], F.lit(False))


def workspace_catalogs(catalogs: DataFrame, grants: DataFrame) -> DataFrame:
    """Live catalogs each workspace sees: its own and those shared with it."""
    live = catalogs.where(F.col("deleted_at").isNull())
    own = live.select(F.col("owner_workspace_id").alias("workspace_id"), "catalog_id")
    shared = _in_force(grants).select("workspace_id", "catalog_id").join(
        live.select("catalog_id"), "catalog_id", "left_semi"
    ).select("workspace_id", "catalog_id")
    # union is by position; a workspace may own and be granted the same catalog.
    return own.union(shared).distinct().join(live.select("catalog_id", "name", "created_at"), "catalog_id")


def visible_catalogs(
    user_id: Any, users: DataFrame, members: DataFrame, catalogs: DataFrame, grants: DataFrame
) -> DataFrame:
    """Live catalogs one user sees, oldest first; a superuser sees them all."""
    live = catalogs.where(F.col("deleted_at").isNull())
    me = users.where(F.col("user_id") == F.lit(user_id)).select("role").first()
    if me is not None and me.role == SUPERUSER:
        seen = live
    else:
        mine = members.where(F.col("user_id") == F.lit(user_id)).select("workspace_id").distinct()
        owned = live.join(
            mine.withColumnRenamed("workspace_id", "owner_workspace_id"), "owner_workspace_id", "left_semi"
        ).select("catalog_id")
        shared = _in_force(grants).join(mine, "workspace_id", "left_semi").select("catalog_id")
        seen = live.join(owned.union(shared).distinct(), "catalog_id", "left_semi")
    return seen.orderBy("created_at", "catalog_id")


def visible_catalogs_of_all(
    users: DataFrame, members: DataFrame, catalogs: DataFrame, grants: DataFrame
) -> DataFrame:
    """``user_id, catalog_id`` of every live catalog that each user sees through a workspace.

    A superuser sees all of them and is listed once, without a catalog.
    """
    superusers = users.where(F.col("role") == SUPERUSER).select("user_id")
    sees = workspace_catalogs(catalogs, grants).select("workspace_id", "catalog_id").distinct()
    membership = members.select("user_id", "workspace_id").distinct().join(superusers, "user_id", "left_anti")
    # A pair comes up once for each workspace it has. It is taken at the first of them, which both lists of earlier workspaces tell
    # on the spot; so the pairs, which are far more than the rows they come from, are not shuffled to drop the repeats.
    listed, more_listed = _with_earlier(membership, "user_id", "_mine")
    seen_by, seen_by_more = _with_earlier(sees, "catalog_id", "_others")
    first = listed.join(seen_by, "workspace_id").where(~F.arrays_overlap("_mine", "_others")).select("user_id", "catalog_id")
    # Users and catalogs of very many workspaces would make very long lists.
    every = seen_by.drop("_others").unionByName(seen_by_more)
    rest = more_listed.join(every, "workspace_id").unionByName(listed.drop("_mine").join(seen_by_more, "workspace_id"))
    seen = first.unionByName(rest.select("user_id", "catalog_id").distinct())
    kind = catalogs.schema["catalog_id"].dataType
    return seen.unionByName(superusers.withColumn("catalog_id", F.lit(None).cast(kind)))


def _with_earlier(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the lower workspaces of the same ``key``; and, without them, those of keys with more than ``MOST_LISTED`` workspaces."""
    counted = F.count("*").over(W.partitionBy(key))
    rows = cut_lineage(rows.where(F.col("workspace_id").isNotNull()).withColumn("_n", counted))
    earlier = W.partitionBy(key).orderBy("workspace_id").rowsBetween(W.unboundedPreceding, -1)
    few = rows.where(F.col("_n") <= MOST_LISTED).drop("_n").withColumn(name, F.collect_list("workspace_id").over(earlier))
    return few, rows.where(F.col("_n") > MOST_LISTED).drop("_n")


def access_as_of(asked: DataFrame, users: DataFrame, catalogs: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """``asked`` (``user_id, catalog_id, day``) with the ``access`` that held on that day: owner, write, read or NULL.

    ``members`` (``user_id, workspace_id``) and ``grants`` (``catalog_id, workspace_id, mode, status, suspended``) carry the days they are valid,
    ``valid_from`` to before ``valid_to``; null ends are open. The rules are those of today's access: superusers and members of the
    owning workspace own a catalog, else the strongest approved grant to a workspace counts that the user belonged to then, and that was not suspended.
    A day asked twice is answered once.

    An asked day takes along the workspaces that its catalog had then, and meets the user's list of memberships where the user is: it is one row all
    the way. Only the workspaces that both had on that day are joined by rows. Catalogs and users with longer lists than ``MOST_CARRIED`` and
    ``MOST_LISTED`` are looked up by rows, through the shorter of both sides.
    """
    pair, ends = ["user_id", "catalog_id", "day"], ["valid_from", "valid_to"]
    asked = cut_lineage(asked.select(*pair))
    members = members.select("user_id", "workspace_id", *ends)
    live = cut_lineage(_in_force(grants).select("catalog_id", "workspace_id", "mode", *ends))
    owners = catalogs.select("catalog_id", F.col("owner_workspace_id").alias("workspace_id"))
    sharing = owners.withColumns({c: F.lit(None).cast(live.schema[c].dataType) for c in ends}).unionByName(live.drop("mode"))
    near = cut_lineage(_near(asked.dropna(), users, members, sharing))
    met, rest = near.where(F.col("_kind") == "met"), near.where(F.col("_kind") == "unlisted").select(*pair).distinct()
    points = met.select(*pair, "workspace_id").distinct()
    spans = met.select("user_id", "workspace_id", *ends).distinct()
    if not rest.isEmpty():
        membership = members.select("user_id", "workspace_id").distinct()
        common = _common_workspaces(rest.select(*pair[:2]).distinct(), membership, sharing.select("catalog_id", "workspace_id").distinct())
        more = cut_lineage(rest.join(common, pair[:2]).select(*pair, "workspace_id"))
        points = points.unionByName(more)
        spans = spans.unionByName(members.join(more.select("user_id", "workspace_id").distinct(), ["user_id", "workspace_id"], "left_semi"))
    was_member = at_day(points, spans, ["user_id", "workspace_id"], "day", *ends)
    was_member = cut_lineage(was_member.select(*pair, "workspace_id").distinct())
    common = ["catalog_id", "workspace_id"]
    shared = cut_lineage(live.join(was_member.select(*common).distinct(), common, "left_semi"))
    held = at_day(was_member, shared, common, "day", *ends)
    rank = lambda c: c.cast("int").alias("_rank")
    owner = rank(F.lit(RANKS["owner"]))
    # One aggregation over what was asked and what was found, instead of a join back. Nearly all rows differ, so nothing is gained, and much held,
    # by aggregating them before the shuffle.
    every = (
        asked.select(*pair, rank(F.lit(None)))
        .unionByName(near.where(F.col("_kind") == SUPERUSER).select(*pair, owner))
        .unionByName(was_member.join(owners, common, "left_semi").select(*pair, owner))
        .unionByName(held.select(*pair, rank(_rank(F.col("mode")))))
    )
    return every.repartition(*pair).groupBy(*pair).agg(_mode(F.max("_rank")).alias("access"))


def _near(asked: DataFrame, users: DataFrame, members: DataFrame, sharing: DataFrame) -> DataFrame:
    """``asked`` with each membership of the user that held on the day, in a workspace that the catalog had then: ``_kind`` is met.

    A superuser's days come once, without a membership, and so do those that the lists do not tell: they are unlisted. Workspaces travel as hashes
    of 16 bits. One too many is found now and then, and has to be sorted out by a join with the catalog's workspaces.
    """
    kind = members.select("workspace_id").unionAll(sharing.select("workspace_id")).schema["workspace_id"].dataType
    mark = lambda c: (F.pmod(F.hash(c.cast(kind)), F.lit(1 << 16)) - (1 << 15)).cast("smallint")
    number = lambda c: F.unix_date(c.cast("date"))
    start = F.coalesce(number(F.col("valid_from")), F.lit(-(1 << 31))).alias("start")
    end = F.coalesce(number(F.col("valid_to")), F.lit((1 << 31) - 1)).alias("end")
    day = number(F.col("day"))
    holds = lambda span: (span["start"] <= day) & (day < span["end"])
    few = F.count("*") <= MOST_CARRIED
    span = F.struct(mark(F.col("workspace_id")).alias("mark"), start, end)
    by_catalog = _first_of("catalog_id", sharing.dropna(subset=["catalog_id", "workspace_id"]), MOST_CARRIED + 1).groupBy("catalog_id")
    by_catalog = by_catalog.agg(F.when(few, F.collect_list(span)).alias("_shared"), F.lit(True).alias("_known"))
    # A superuser's mark is a row without a workspace, which comes first.
    superusers = users.where(F.col("role") == SUPERUSER).select("user_id").distinct()
    nothing = {c: F.lit(None).cast(members.schema[c].dataType) for c in members.columns if c != "user_id"}
    belongs = F.col("workspace_id").isNotNull()
    own = superusers.withColumns(nothing).unionByName(members.where(belongs))
    few = F.count("workspace_id") <= MOST_LISTED
    span = F.struct("workspace_id", "valid_from", "valid_to", mark(F.col("workspace_id")).alias("mark"), start, end)
    by_user = _first_of("user_id", own, MOST_LISTED + 1).groupBy("user_id")
    by_user = by_user.agg(F.when(few, F.collect_list(F.when(belongs, span))).alias("_mine"), F.bool_or(~belongs).alias("_super"))
    # No list where there are too many workspaces, an empty one where there are none.
    then = F.transform(F.filter("_shared", holds), lambda s: s["mark"])
    then = F.when(F.col("_known"), F.array_distinct(then)).otherwise(F.array().cast("array<smallint>"))
    there = asked.join(by_catalog, "catalog_id", "left").select(*asked.columns, then.alias("_then")).join(by_user, "user_id")
    found = F.filter("_mine", lambda m: holds(m) & F.array_contains("_then", m["mark"]))
    row = lambda kind, *values: F.struct(F.lit(kind).alias("_kind"), *[v.alias(c) for c, v in zip(nothing, values)])
    found = F.transform(found, lambda m: row("met", *[m[c] for c in nothing]))
    alone = lambda kind: F.array(row(kind, *nothing.values()))
    unlisted = F.col("_mine").isNull() | F.col("_then").isNull()
    rows = F.when(F.col("_super"), alone(SUPERUSER)).when(unlisted, alone("unlisted")).otherwise(found)
    return there.select(*asked.columns, F.inline(rows))


def _common_workspaces(pairs: DataFrame, membership: DataFrame, sharing: DataFrame) -> DataFrame:
    """The workspaces that both lists of a ``(user_id, catalog_id)`` pair have, found through the shorter one. All rows are distinct."""
    described = cut_lineage(
        pairs.join(membership.groupBy("user_id").agg(F.count("*").alias("_workspaces")), "user_id")
        .join(sharing.groupBy("catalog_id").agg(F.count("*").alias("_shares")), "catalog_id")
        .select("user_id", "catalog_id", (F.col("_workspaces") <= F.col("_shares")).alias("_short"))
    )
    by_user = described.where("_short").join(membership, "user_id").join(sharing, ["catalog_id", "workspace_id"], "left_semi")
    by_catalog = described.where("NOT _short").join(sharing, "catalog_id").join(membership, ["user_id", "workspace_id"], "left_semi")
    columns = ["user_id", "catalog_id", "workspace_id"]
    return by_user.select(*columns).unionByName(by_catalog.select(*columns))


def catalog_directories(catalogs: DataFrame, workspaces: DataFrame, schemas: DataFrame, grants: DataFrame) -> DataFrame:
    """The directory of every workspace in one pass: all other workspaces' live catalogs that it has asked for.

    The columns are those of :func:`catalog_directory` behind ``workspace_id``. A catalog a workspace has not asked for looks the
    same to all of them, so those are not repeated for each: they are listed once, with a null ``workspace_id``, for whoever
    does not own them.
    """
    live = catalogs.where(F.col("deleted_at").isNull()).select("catalog_id", "name", "owner_workspace_id")
    counted = schemas.groupBy("catalog_id").agg(F.count("*").alias("schema_count"))
    owners = workspaces.select(F.col("workspace_id").alias("owner_workspace_id"), F.col("name").alias("owner_workspace_name"))
    listed = live.join(counted, "catalog_id", "left").join(owners, "owner_workspace_id", "left")
    asked = grants.select("catalog_id", "workspace_id", "access_id", "status")
    own = listed.join(asked, "catalog_id").where(F.col("workspace_id") != F.col("owner_workspace_id"))
    kind = grants.schema["workspace_id"].dataType
    rest = listed.withColumns({"workspace_id": F.lit(None).cast(kind), "access_id": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    state = F.when(F.col("status").isin("approved", "pending"), F.col("status")).otherwise("none")
    return own.unionByName(rest).select(
        "workspace_id",
        "catalog_id",
        "name",
        "owner_workspace_id",
        "owner_workspace_name",
        F.coalesce("schema_count", F.lit(0).cast("bigint")).alias("schema_count"),
        state.alias("access_status"),
        "access_id",
    )


def catalog_directory(
    workspace_id: Any, catalogs: DataFrame, workspaces: DataFrame, schemas: DataFrame, grants: DataFrame
) -> DataFrame:
    """Other workspaces' live catalogs with schema count and the state of this one's request."""
    others = catalogs.where(
        F.col("deleted_at").isNull() & (F.col("owner_workspace_id") != F.lit(workspace_id))
    ).select("catalog_id", "name", "owner_workspace_id")
    asked = grants.where(F.col("workspace_id") == F.lit(workspace_id)).select(
        "catalog_id", "access_id", "status"
    )
    counted = schemas.groupBy("catalog_id").agg(F.count("*").alias("schema_count"))
    owners = workspaces.select(
        F.col("workspace_id").alias("owner_workspace_id"), F.col("name").alias("owner_workspace_name")
    )
    state = F.when(F.col("status").isin("approved", "pending"), F.col("status")).otherwise("none")
    return (
        others.join(asked, "catalog_id", "left")
        .join(counted, "catalog_id", "left")
        .join(owners, "owner_workspace_id", "left")
        .select(
            "catalog_id",
            "name",
            "owner_workspace_id",
            "owner_workspace_name",
            F.coalesce("schema_count", F.lit(0).cast("bigint")).alias("schema_count"),
            state.alias("access_status"),
            "access_id",
        )
        .orderBy("name", "catalog_id")
    )


def pending_requests(catalogs: DataFrame, workspaces: DataFrame, grants: DataFrame) -> DataFrame:
    """Open requests for live catalogs, with the workspace that owns and the one that asks."""
    live = catalogs.where(F.col("deleted_at").isNull()).select(
        "catalog_id", F.col("name").alias("catalog_name"), "owner_workspace_id"
    )
    asking = workspaces.select(
        F.col("workspace_id").alias("requesting_workspace_id"),
        F.col("name").alias("requesting_workspace_name"),
    )
    return (
        grants.where(F.col("status") == "pending")
        .select(
            "access_id",
            "catalog_id",
            F.col("workspace_id").alias("requesting_workspace_id"),
            "mode",
            "requested_at",
        )
        .join(live, "catalog_id")
        .join(asking, "requesting_workspace_id", "left")
        .select(
            "owner_workspace_id",
            "access_id",
            "catalog_id",
            "catalog_name",
            "requesting_workspace_id",
            "requesting_workspace_name",
            "mode",
            "requested_at",
        )
    )


def owned_catalogs(catalogs: DataFrame) -> DataFrame:
    """Catalogs per owner, live ones first, then by name."""
    return catalogs.orderBy(
        "owner_workspace_id", F.col("deleted_at").isNull().desc(), "name", "catalog_id"
    )


def workspace_usage(workspaces: DataFrame, members: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Member and live catalog counts of every workspace."""
    people = members.groupBy("workspace_id").agg(F.count("*").alias("member_count"))
    owned = (
        catalogs.where(F.col("deleted_at").isNull())
        .groupBy(F.col("owner_workspace_id").alias("workspace_id"))
        .agg(F.count("*").alias("owned_catalog_count"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        workspaces.join(people, "workspace_id", "left")
        .join(owned, "workspace_id", "left")
        .select(
            "workspace_id",
            "name",
            F.coalesce("member_count", zero).alias("member_count"),
            F.coalesce("owned_catalog_count", zero).alias("owned_catalog_count"),
        )
    )


def default_catalogs(catalogs: DataFrame, name: str = "default") -> DataFrame:
    """The oldest catalog of each owner that bears the default name, in any case."""
    named = catalogs.where(same_name(F.col("name"), F.lit(name)))
    return first_per_key(named, ["owner_workspace_id"], [F.col("created_at").asc(), F.col("catalog_id").asc()])
