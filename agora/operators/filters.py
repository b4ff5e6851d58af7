"""Demo-account filters (the "real user" predicate) and their join forms.

The reference excludes demo accounts (email ending with the demo domain,
case-insensitive) by joining ``users`` and testing the email. Real accounts
are as many as users; the ids to exclude are few. They are found once a
table bundle (``Tables.barred_ids``), and a fact is filtered by an anti-join
with them: it is not shuffled, so a provider who holds a third of all bids
gathers nowhere.

* ``keep_real(df, col)``      — inner join to users + real test: the party
  must exist and not be demo (``left_anti`` against demo ids and dangling
  ids; NULL keys go).
* ``keep_optional_real(df, col)`` — ``LEFT JOIN users … WHERE users.id IS NULL
  OR real``: drop only rows whose party is an existing demo account
  (``left_anti`` against demo ids; NULL keys survive).
* ``with_name(df, col, ..., real_only=True)`` — where the name is wanted too:
  the join that brings it also tests existence and realness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.sources.tables import Tables


def only(df: DataFrame, col: str, ids: DataFrame | None) -> DataFrame:
    """Restrict ``df`` to the ids of a one-column frame (the single-user
    call of the reference is ``ids`` with one row). No-op for ``None``."""
    if ids is None:
        return df
    k = ids.select(F.col(ids.columns[0]).alias("_only")).distinct()
    return df.join(k, df[col] == k["_only"], "left_semi")


def is_demo_email(email: Column | str, domain: str) -> Column:
    """``email LIKE '%<domain>'`` as the database's collation compares (a pattern minds trailing spaces)."""
    c = F.col(email) if isinstance(email, str) else email
    return F.collate(c, "UNICODE_CI_AI").endswith(F.collate(F.lit(domain), "UNICODE_CI_AI"))


def keep_real(df: DataFrame, col: str, t: Tables) -> DataFrame:
    ids = t.unreal_ids()
    return df.where(F.col(col).isNotNull()).join(ids, F.col(col) == ids["_uid"], "left_anti")


def keep_existing(df: DataFrame, col: str, t: Tables) -> DataFrame:
    """Rows whose party is an existing account, demo or not."""
    ids = t.dangling_ids()
    return df.where(F.col(col).isNotNull()).join(ids, F.col(col) == ids["_uid"], "left_anti")


def keep_optional_real(df: DataFrame, col: str, t: Tables) -> DataFrame:
    ids = t.demo_ids()
    return df.join(ids, F.col(col) == ids["_uid"], "left_anti")


def with_name(df: DataFrame, col: str, alias: str, t: Tables, real_only: bool = False) -> DataFrame:
    """Inner join to users on ``col`` adding the name as ``alias``; with
    ``real_only`` demo parties are dropped in the same join."""
    names = t.real_names() if real_only else t.all_names().select("_uid", "_name")
    return (df.join(names, df[col] == names["_uid"], "inner")
              .drop("_uid").withColumnRenamed("_name", alias))


def real_users(t: Tables) -> DataFrame:
    """FI1: users that are not demo accounts (password hash never loaded)."""
    return (t.users.where(~is_demo_email("email", t.demo_domain))
            .select("id", "name", "email", "role", "created_at"))


def requests_real_client(t: Tables) -> DataFrame:
    """Requests whose client is an existing real user."""
    return keep_real(t.service_requests, "client_id", t)


def requests_real_parties(t: Tables) -> DataFrame:
    """Requests with a real client and a real selected provider (inner on both)."""
    return keep_real(requests_real_client(t), "selected_provider_id", t)


def requests_real_client_optional_provider(t: Tables) -> DataFrame:
    """Requests with a real client whose provider is absent or not demo."""
    return keep_optional_real(requests_real_client(t), "selected_provider_id", t)


def bids_real_parties(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Bids whose provider is real and whose request's client is real.

    ``requests`` (already client-filtered) may be passed to share a scan.
    Returns bid columns plus the request's ``category``/``title``/``status``
    /``selected_provider_id`` prefixed with ``r_``.
    """
    req = requests if requests is not None else requests_real_client(t)
    req = req.select(
        F.col("id").alias("r_id"), F.col("category").alias("r_category"),
        F.col("title").alias("r_title"), F.col("status").alias("r_status"),
        F.col("client_id").alias("r_client_id"),
        F.col("selected_provider_id").alias("r_selected_provider_id"),
    )
    b = keep_real(t.bids, "provider_id", t)
    return b.join(req, b["request_id"] == req["r_id"], "inner").drop("r_id")
