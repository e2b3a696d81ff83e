"""Requests to origins: credentials by host, and answers that are handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import _host, scope_for
from ..functions.sizing import small


def with_credentials(requests: DataFrame, credentials: DataFrame, tokens: DataFrame, url: str = "url", path: str = "path", client: str = "client_auth") -> DataFrame:
    """``requests`` with ``authorization``, what is sent first, and ``may_exchange``, whether a challenge can be answered.

    A host with an entry in ``credentials(host)`` gets the cached token of its host and scope from ``tokens(host, scope, token)``, if there is
    one and the client sent nothing of its own, which always goes first. Any other host is sent what the client sent, never
    another host's credential. Hosts are compared with their ports, by equi-joins.
    """
    rows = requests.withColumn("_host", _host(F.col(url))).withColumn("_scope", scope_for(F.col(path)))
    known = credentials.select(F.col("host").alias("_host")).distinct().withColumn("_known", F.lit(True))
    held = tokens.groupBy(F.col("host").alias("_host"), F.col("scope").alias("_scope")).agg(F.max("token").alias("_token"))
    met = rows.join(small(known), "_host", "left").join(small(held), ["_host", "_scope"], "left")
    sent = F.coalesce(F.nullif(F.col(client), F.lit("")), F.when(F.col("_known"), F.concat(F.lit("Bearer "), "_token")))
    return met.select(*requests.columns, sent.alias("authorization"), F.coalesce("_known", F.lit(False)).alias("may_exchange"))
