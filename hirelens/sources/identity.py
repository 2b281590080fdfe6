"""Who is signed in where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signed_in(log: DataFrame) -> DataFrame:
    """A log (client, seq, role, email, name) to what each client's store holds: (client, role, email, name), no row once it is signed out.

    A login with a role writes role and e-mail address, and the name if there is one (else the name there stays); one without a role signs out and removes all three. One shuffle, by client."""
    of = Window.partitionBy("client")
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    since = log.withColumn("out", F.max(F.when(~F.coalesce(given("role"), F.lit(False)), F.col("seq"))).over(of)).filter("out is null or seq > out")
    return since.groupBy("client").agg(F.max_by("role", "seq").alias("role"), F.max_by("email", "seq").alias("email"), F.max_by("name", F.when(given("name"), F.col("seq"))).alias("name"))
