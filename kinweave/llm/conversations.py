"""Conversations rebuilt from message rows by a keyed streaming state with event-time watermarks.

Event time is when a message arrived, never what its sender wrote: no date in a message can move the watermark. The state
keeps the messages of each open conversation, late ones by the sender's clock among them, and when the watermark passes a
conversation's closing time it emits the messages in order, if they make a valid conversation.

Live, a conversation closes when nothing has arrived for it for a timeout. In a replay of a finite table the last arrival
of each conversation is known from one aggregation, so the timeout runs from there and a silence in the middle does not
cut a conversation in two. The replay streams the table step by step in the order of arrival, so that what is closed
leaves the state; a tick after the last row moves the clock on by the timeout. Should the state ever drop a row as late,
the replay fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.lineage import discard, materialise, new_path, remove
from kinweave.plans.skew import lookup_join

# How directions are written, in lower case without blanks around.
SENT = ["sent", "outgoing", "outbound", "out", "s", "o", "->"]
RECEIVED = ["received", "incoming", "inbound", "in", "recv", "r", "i", "<-"]

#: More messages than this of one conversation are spread over several states.
STATE_ROWS = 5_000
#: Silence after which a conversation is closed, and how long the watermark waits for rows out of order.
TIMEOUT_SECONDS, DELAY_SECONDS = 30 * 86_400, 86_400
#: A replay takes one step per so many rows, MAX_STEPS at most.
STEP_ROWS, MAX_STEPS = 500_000, 48
#: What all states on an executor hold in memory together; the rest is on its disk.
STATE_MEMORY_MB = 256
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: No more conversations than this are joined by broadcast for being long.
MAX_HEAVY = 20_000


def speaker_of(direction: Column) -> Column:
    """`me` for what the mailbox owner sent, `contact` for what was received, null for anything else."""
    d = F.lower(F.trim(direction, F.lit(" \t\r\n\u00a0")))
    return F.when(d.isin(SENT), "me").when(d.isin(RECEIVED), "contact")


def clean_thread(raw: Column) -> Column:
    """The thread id without blanks and angle brackets around it; a blank where nothing is left."""
    return F.trim(raw, F.lit(" \t\r\n\u00a0<>"))


def arrival(loaded_at: Column) -> Column:
    """Seconds since 1970 at which a message arrived, as the column arrived."""
    return F.coalesce(F.unix_timestamp(loaded_at), F.lit(0)).alias("arrived")


def lean_messages(messages: DataFrame, *also: str) -> DataFrame:
    """thread, id, moment, arrived, speaker, said (and the columns named) of the messages that belong to a conversation.

    messages: id, thread_id, direction, snippet, utc_second, loaded_at. A snippet of nothing but white space says nothing.
    A message without a time of arrival counts as the earliest.
    """
    said = F.coalesce(F.length(F.trim("snippet", F.lit(" \t\r\n\u00a0\u200b\u3000"))) > 0, F.lit(False))
    return messages.select(clean_thread(F.col("thread_id")).alias("thread"), "id", F.col("utc_second").alias("moment"), arrival(F.col("loaded_at")), speaker_of(F.col("direction")).alias("speaker"), said.alias("said"), *also)


def closing_times(arrivals: DataFrame, timeout: int, state_rows: int) -> DataFrame:
    """(thread, n, closes, parts): when each conversation closes, and over how many states its messages are spread."""
    last = arrivals.where("thread <> ''").groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.max("arrived").alias("last"))
    return last.select("thread", "n", (F.col("last") + timeout).alias("closes"), F.ceil(F.col("n") / state_rows).cast("int").alias("parts"))


def fragments(stream: DataFrame, delay: int = DELAY_SECONDS) -> DataFrame:
    """Streaming: one row per closed (thread, part): its messages in order and the counts the verdict needs.

    stream: thread, part, parts, id, moment, speaker, said, arrived, closes. A message keeps its conversation open until
    closes; as that is never before the next arrival of a replay, each (thread, part) is one session.
    """
    timed = stream.withColumn("at", F.timestamp_seconds("arrived")).withWatermark("at", f"{delay} seconds")
    gap = F.concat((F.col("closes") - F.col("arrived")).cast("string"), F.lit(" seconds"))
    turn = F.struct("moment", "id", "speaker")
    return (
        timed.groupBy(F.session_window("at", gap), "thread", "part", "parts")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum((F.col("moment").isNull() | F.col("speaker").isNull()).cast("long")).alias("broken"), F.sum((F.col("speaker") == "me").cast("long")).alias("mine"), F.sum(F.col("said").cast("long")).alias("said"))
        .drop("session_window")
    )


def whole(broken: Column, mine: Column, n: Column, said: Column) -> Column:
    """Every message has a moment and a speaker, both speakers occur, something is said."""
    return (broken == 0) & (mine > 0) & (mine < n) & (said > 0)


def validated(frags: DataFrame) -> DataFrame:
    """Without the conversations in one fragment that are not whole; those of several are judged when all are there."""
    return frags.where((F.col("parts") > 1) | whole(F.col("broken"), F.col("mine"), F.size("turns"), F.col("said")))


def numbered(closed: DataFrame) -> DataFrame:
    """(conv_id, turn_no, id, speaker) of conversations in one fragment: turn_no from 1 by moment, then id; conv_id is turn 1's id."""
    first = closed.select(F.get("turns", F.lit(0)).id.alias("conv_id"), F.posexplode("turns").alias("k", "t"))
    return first.select("conv_id", (F.col("k") + 1).cast("long").alias("turn_no"), "t.id", "t.speaker")


def live_conversations(stream: DataFrame, timeout: int = TIMEOUT_SECONDS, delay: int = DELAY_SECONDS) -> DataFrame:
    """Streaming: the turns of each valid conversation once nothing has arrived for it for timeout seconds.

    stream: as lean_messages gives it. What arrives for a conversation after it was closed opens a new one.
    """
    open_ = stream.where("thread <> ''").withColumns({"closes": F.col("arrived") + timeout, "part": F.lit(0), "parts": F.lit(1)})
    return numbered(validated(fragments(open_, delay)))


def _steps(arrivals: DataFrame, total: int, step_rows: int) -> list[int]:
    """Seconds of arrival at which the steps of a replay end, but for the last; the steps have about as many rows each."""
    n = min(MAX_STEPS, -(-total // step_rows))
    if n < 2:
        return []
    cuts = arrivals.agg(F.percentile_approx("arrived", [k / n for k in range(1, n)], 10_000)).first()[0]
    return sorted(set(cuts))


def replay(lean: DataFrame, arrivals: DataFrame, timeout: int = TIMEOUT_SECONDS, delay: int = DELAY_SECONDS, step_rows: int = STEP_ROWS, state_rows: int = STATE_ROWS) -> tuple[DataFrame, bool]:
    """All valid conversations and all fragments of long ones, by way of the stream; and whether there are long ones."""
    spark = lean.sparkSession
    source, staged, out, state = (new_path(spark, x) for x in ("arrivals", "messages", "fragments", "stream-state"))
    times = materialise(closing_times(arrivals, timeout, state_rows), "closing")
    known = times.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("closes").alias("closes"), F.coalesce(F.max("parts"), F.lit(1)).alias("parts")).first()
    columns = "thread string, id bigint, moment bigint, arrived bigint, speaker string, said boolean, closes bigint, parts int, part int"
    if not known.n:
        return spark.createDataFrame([], "thread string, parts int, turns array<struct<moment:bigint,id:bigint,speaker:string>>, broken bigint, mine bigint, said bigint"), False
    least = max(20_000, known.n // MAX_HEAVY)
    many = times.where(F.col("n") > least).select("thread").collect()
    heavy = spark.createDataFrame(many, "thread string") if many else None
    cuts = _steps(arrivals, known.n, step_rows)
    step = sum(((F.col("arrived") > c).cast("int") for c in cuts), F.lit(0))
    rows = lookup_join(lean.select("thread", "id", "moment", "arrived", "speaker", "said").where("thread <> ''"), "thread", times.drop("n"), heavy)
    rows = rows.withColumns({"part": F.when(F.col("parts") > 1, F.pmod("id", "parts")).otherwise(0).cast("int"), "step": step})
    rows.write.option("compression", "zstd").partitionBy("step").parquet(staged)
    tick = (None, 0, None, known.closes + delay + 1, None, False, known.closes + delay + timeout, 1, 0)
    spark.createDataFrame([tick], columns).coalesce(1).write.mode("append").parquet(f"{staged}/step={len(cuts)}")
    rocks = "spark.sql.streaming.stateStore.rocksdb"
    named = {"spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER, f"{rocks}.changelogCheckpointing.enabled": "true", f"{rocks}.boundedMemoryUsage": "true", f"{rocks}.maxMemoryUsageMB": str(STATE_MEMORY_MB)}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path(source))
        for k in range(len(cuts) + 1):
            # a step is one micro-batch: its rows arrived no earlier than all that the watermark has seen
            if not files.rename(path(f"{staged}/step={k}"), path(f"{source}/at{k}")) and files.exists(path(f"{staged}/step={k}")):
                raise OSError(f"step {k} of the replay could not be moved to its source")
            if not files.exists(path(f"{source}/at{k}")):
                continue
            stream = spark.readStream.schema(columns).parquet(f"{source}/*")
            sink = validated(fragments(stream, delay)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            done = sink.outputMode("append").trigger(availableNow=True).start()
            done.awaitTermination()
            late = sum(op["numRowsDroppedByWatermark"] for p in done.recentProgress for op in p["stateOperators"])
            if late:
                raise RuntimeError(f"{late} rows of the replay came too late for its watermark")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for used in (source, staged, state):
            remove(spark, used)
        discard(times)
    shape = "thread string, part int, parts int, turns array<struct<moment:bigint,id:bigint,speaker:string>>, broken bigint, mine bigint, said bigint"
    return spark.read.schema(shape).parquet(out).where("thread IS NOT NULL"), known.parts > 1


def judge(frags: DataFrame) -> DataFrame:
    """(conv_id, turn_no, id, speaker) of the long conversations whose fragments together are whole.

    They are numbered by hour, plus the number of the conversation's messages in earlier hours.
    """
    sums = frags.groupBy("thread").agg(*[F.sum(c).alias(c) for c in ("broken", "mine", "said")], F.sum(F.size("turns")).alias("n"), F.min(F.get("turns", F.lit(0))).alias("first"))
    kept = sums.where(whole(F.col("broken"), F.col("mine"), F.col("n"), F.col("said"))).select("thread", F.col("first.id").alias("conv_id"))
    turns = frags.select("thread", "turns").join(kept, "thread").select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*", F.floor(F.col("t.moment") / 3600).alias("hour"))
    hours = turns.groupBy("conv_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    earlier = hours.select("conv_id", "hour", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("hour")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "hour").orderBy("moment", "id"))
    return turns.withColumn("k", inside).join(earlier, ["conv_id", "hour"]).select("conv_id", (F.col("k") + F.col("before")).cast("long").alias("turn_no"), "id", "speaker")


def conversations(lean: DataFrame, arrivals: DataFrame | None = None, **how) -> DataFrame:
    """(conv_id, turn_no, id, speaker) of the whole conversations of a finite table as lean_messages gives it.

    turn_no counts from 1 by moment, then id; conv_id is the id of turn 1. arrivals: thread and arrived of the table that
    lean was derived from, rows since removed included, so that reading them does not repeat the derivation; how: as
    replay has it. Messages without a thread belong to none. Repeated deliveries must be gone already. An empty table
    gives an empty result; ties of moment are ordered by id; columns with other names are ignored.
    """
    frags, long = replay(lean, lean.select("thread", "arrived") if arrivals is None else arrivals, **how)
    single = numbered(frags.where("parts = 1"))
    return single.unionByName(judge(frags.where("parts > 1"))) if long else single
