"""A deterministic corpus of distractor facts, made in parallel: the generator's state is a counter, so any row's numbers can be had alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The generator's word lists, its increment and the numbers it draws for a row.
SUBSYSTEMS = [
    "scheduler", "ingest pipeline", "billing worker", "auth proxy", "cache layer", "notifier", "export service", "sync daemon", "media transcoder", "search indexer",
    "queue consumer", "webhook relay", "session store", "rate limiter", "metrics shipper",
]
COMPONENTS = ["config loader", "connection pool", "retry loop", "migration runner", "health probe", "feature gate", "token refresher", "snapshot writer", "lock manager", "event bus"]
FAILURES = [
    "hangs on shutdown when the drain timer races the socket close",
    "double-fires when the cron tick lands inside a leap second window",
    "silently drops rows when the batch exceeds the wire frame size",
    "leaks file descriptors under repeated TLS renegotiation",
    "returns stale reads when the replica lag passes the lease TTL",
    "corrupts the cursor file when killed between fsync and rename",
    "deadlocks when two writers rotate the log in the same tick",
    "misroutes traffic when the DNS cache outlives the pod IP",
    "truncates unicode keys at the legacy 191-byte index boundary",
    "starves the low-priority queue when backpressure never clears",
]
FIXES = [
    "pin the worker count to the cgroup CPU quota, not os.cpus()",
    "wrap the handle in a finally-dispose block and assert at exit",
    "bump the lease renewal to half the TTL and jitter it",
    "switch the probe to the loopback admin port",
    "serialize rotation behind the advisory lock",
    "flush before rename and tolerate the duplicate on replay",
    "route through the connection-string resolver instead of env",
    "gate the path behind the feature flag until the index lands",
    "use the monotonic clock for the deadline math",
    "batch by byte budget instead of row count",
]
TOOLS = ["sysctl-tuner", "pgbouncer", "redis-sentinel", "haproxy", "fluentbit", "vault-agent", "cert-rotator", "minio-gateway", "etcd-defrag", "kafka-mirror"]
STEP, DRAWS, WORD = 0x6D2B79F5, 7, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without overflow of 64."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def draw(seed: int, index: Column) -> Column:
    """The number in [0, 1) of a 32-bit counter generator's call `index`, counted from 1."""
    xor = lambda a, b: a.bitwiseXOR(b)
    low = lambda a: a.bitwiseAND(F.lit(WORD))
    a = low(F.lit(seed & WORD) + _times(low(index.cast("long")), F.lit(STEP).cast("long")))
    t = _times(xor(a, F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = xor(low(t + _times(xor(t, F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))), t)
    return xor(t, F.shiftright(t, 14)) / F.lit(2.0**32)


def corpus(spark: SparkSession, count: int, seed: int = 1337) -> DataFrame:
    """ord, key, text, kind, description of `count` facts."""
    rows = spark.range(count).withColumnRenamed("id", "ord")
    for j in range(DRAWS):
        rows = rows.withColumn(f"u{j}", draw(seed, F.col("ord") * DRAWS + (j + 1)))
    whole = lambda j, n: F.floor(F.col(f"u{j}") * n)
    pick = lambda j, words: F.get(F.array(*map(F.lit, words)), whole(j, len(words)).cast("int"))
    rows = rows.select("ord", pick(0, SUBSYSTEMS).alias("s"), pick(1, COMPONENTS).alias("c"), pick(2, FAILURES).alias("f"), pick(3, FIXES).alias("x"), pick(4, TOOLS).alias("t"), (1000 + whole(5, 9000)).alias("e"), (1024 + whole(6, 60000)).alias("p"))
    key = F.concat(F.lit(f"syn_{seed}_"), F.col("ord").cast("string"))
    # The sentences around the words.
    text = F.format_string("The %s's %s %s. Fix: %s. Diagnosed via %s on :%d; the failing call returns E%d. (synthetic distractor %s)", "s", "c", "f", "x", "t", "p", "e", key)
    return rows.select("ord", key.alias("key"), text.alias("text"), F.lit("project").alias("kind"), F.concat("s", F.lit(" "), "c", F.lit(" — "), F.left("f", F.lit(60))).alias("description"))
