"""HTTP requests on streams as rows, answered from the state that the requests before them leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import path_error
from tidemark.operators import lifecycle

#: Statuses of decided commands.
STATUS = {"Created": 201, "AlreadyExists": 200, "Occupied": 409, "CapacityExhausted": 429, "Closed": 204, "AlreadyClosed": 204, "Deleted": 204}


def http_statuses(requests: DataFrame, capacity: int = lifecycle.CAPACITY) -> DataFrame:
    """requests(seq, path, verb, body boolean, lifecycle, content_type): seq, status.

    The control prefix is not found, a malformed path is refused before anything
    else, and only requests that pass these checks change a stream: PUT without a
    body creates, POST without one closes if its header says so, DELETE deletes.
    Appends and reads are not implemented (501).
    """
    reserved = F.startswith("path", F.lit("__ds/")) | (F.col("path") == "__ds")
    r = requests.withColumn("_reserved", reserved).withColumn("_bad", path_error(F.col("path")).isNotNull())
    verb, body = F.col("verb"), F.col("body")
    acts = (verb == "DELETE") | ((verb == "PUT") & ~body) | ((verb == "POST") & ~body & (F.col("lifecycle") == "closed"))
    cmd = F.when(verb == "PUT", "create").when(verb == "POST", "close").otherwise("delete")
    commands = r.where(~F.col("_reserved") & ~F.col("_bad") & acts).select("seq", "path", cmd.alias("cmd"), "content_type", F.lit(None).cast("string").alias("expiry"), "lifecycle")
    decided = lifecycle.decide(commands, capacity).select("seq", "outcome")
    lives = lifecycle.effective(commands, capacity).select("path", "tc", "td")
    found = r.join(decided, "seq", "left").join(lives, "path", "left")
    never = F.col("tc").isNull() | (F.col("seq") < F.col("tc"))
    absent = F.when(never, 404).when(F.col("seq") > F.col("td"), 410)
    code = F.create_map(*[F.lit(x) for item in STATUS.items() for x in item])[F.col("outcome")]
    status = (
        F.when(F.col("_reserved"), 404)
        .when(F.col("_bad"), 400)
        .when(verb == "GET", 501)
        .when(verb == "HEAD", F.coalesce(absent, F.lit(200)))
        .when((verb == "PUT") & body, 400)
        .when((verb == "POST") & body, 501)
        .when((verb == "POST") & (F.col("lifecycle") == "open"), 400)
        .otherwise(F.coalesce(code, F.when(never, 404).otherwise(410)))
    )
    return found.select("seq", status.alias("status"))
