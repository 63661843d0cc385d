"""Chat formatting by event-sourced reconstruction.

DataFrame functions only, but for the digests of conversations too long for one row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm._shared import cut, table

OPEN, CLOSE = "<turn>", "</turn>\n"
CHUNK_TURNS = 64
LOSS_ROLE = "assistant"
NO_TURN = -(1 << 62)
#: A conversation that may be longer than this many bytes once formatted is hashed in a stream of pieces.
ROW_BYTES = 128 << 20
PIECE_CHARS = 1 << 16
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string"


def escape(text: Column) -> Column:
    """Hide the template's control characters: backslash becomes ``\\b`` and ``<`` becomes ``\\l``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of each conversation from its log.

    ``events``: conv_id, turn, seq, kind, role, text. Within a turn, by seq: ``message`` starts a message with
    its text, ``delta`` appends, ``edit`` replaces what is there, ``regenerate`` discards it so that later
    deltas start anew; any other kind counts as delta. Null texts and roles count as empty, null turns come
    first, ties go by role and text. Returns conv_id, chunk, part, place, role and text; chunk groups CHUNK_TURNS turn
    numbers, so a conversation with very many turns is sorted in many tasks; part cuts a chunk after CHUNK_TURNS
    messages, as many may share a turn number or have none; and place orders within the chunk.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(NO_TURN)).cast("long")
    rows = events.select(
        "conv_id", chunk.alias("chunk"), "turn", "seq", "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "seq", "role", "text")
    starts = (F.col("kind") == "message") | ~F.col("turn").eqNullSafe(F.lag("turn").over(order)) | (F.row_number().over(order) == 1)
    resets = F.col("kind").isin("message", "edit", "regenerate")
    numbered = rows.select(
        "*", F.row_number().over(order).alias("n"), starts.cast("int").alias("starts")
    ).withColumn("place", F.sum("starts").over(Window.partitionBy("conv_id", "chunk").orderBy("n")))
    message = Window.partitionBy("conv_id", "chunk", "place")
    live = numbered.select(
        "*",
        F.max(F.when(resets, F.col("n"))).over(message).alias("reset"),
        F.min(F.struct("n", "role")).over(message)["role"].alias("speaker"),
    ).where(F.col("reset").isNull() | (F.col("n") >= F.col("reset")))
    parts = F.sort_array(
        F.collect_list(F.struct("n", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))
    )
    return live.groupBy("conv_id", "chunk", "place").agg(
        F.first("speaker").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    ).withColumn("part", F.floor((F.col("place") - 1) / CHUNK_TURNS).cast("long"))


def render(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row for each conversation, chunk and part: ``formatted`` and ``loss`` (start, end of each masked text in it).

    A turn is ``<turn>role\\ntext</turn>\\n`` with role and text escaped (line feeds in a role too), so no text
    can hold a control string. The loss mask covers the escaped texts of ``loss_role``; offsets are code points.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escape(F.col("text"))
    whole = F.length(head) + F.length(body) + F.lit(len(CLOSE))
    so_far = F.sum(whole).over(
        Window.partitionBy("conv_id", "chunk", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(so_far, F.lit(0)) + F.length(head)
    piece = F.struct(
        "place",
        F.concat(head, body, F.lit(CLOSE)).alias("shown"),
        F.struct(start.alias("start"), (start + F.length(body)).alias("end")).alias("span"),
        (F.col("role") == loss_role).alias("masked"),
    )
    pieces = F.sort_array(F.collect_list("piece"))
    return (
        turns.select("conv_id", "chunk", "part", piece.alias("piece"))
        .groupBy("conv_id", "chunk", "part")
        .agg(pieces.alias("pieces"))
        .select(
            "conv_id",
            "chunk",
            "part",
            F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("formatted"),
            F.transform(F.filter("pieces", lambda p: p["masked"]), lambda p: p["span"]).alias("loss"),
        )
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted text."""

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        role = F.substr(role, F.lit(len(OPEN) + 1))
        return F.struct(
            unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(text).alias("text")
        )

    return F.transform(F.filter(F.split(formatted, CLOSE, -1), lambda b: b != ""), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "",
    )


def read_back(events: DataFrame) -> DataFrame:
    """conv_id, chunk, part, formatted, and turns, their number and the masked text as read back from it, of each chunk."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return render(fold_events(events)).select(
        "conv_id",
        "chunk",
        "part",
        "formatted",
        turns.alias("turns"),
        F.size(parse(F.col("formatted"))).cast("long").alias("n"),
        loss_text(F.col("formatted"), F.col("loss")).alias("masked"),
    )


def row_digests(events: DataFrame) -> DataFrame:
    """Digests of conversations short enough for their chunks to meet in one row."""
    chunk = F.struct("chunk", "part", "formatted", "turns", "n", "masked").alias("c")
    chunks = read_back(events).select("conv_id", chunk).groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("cs", lambda c: c[field]), "")

    return chunks.select(
        "conv_id",
        F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("masked")).cast("long").alias("loss_chars"),
        F.sha2(joined("masked"), 256).alias("loss_sha256"),
        F.length(joined("formatted")).cast("long").alias("formatted_chars"),
        F.sha2(joined("formatted"), 256).alias("formatted_sha256"),
    )


def stream_digests(events: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Digests of conversations of any length: sorted pieces of text pass through running hashes, one at a time."""

    def pieces(name: str) -> Column:
        count = F.greatest(F.ceil(F.length(name) / piece_chars), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0).cast("long"), count.cast("long") - 1),
            lambda i: F.struct(
                F.lit(name).alias("field"), i.alias("at"),
                F.substr(F.col(name), (i * piece_chars + 1).cast("int"), F.lit(piece_chars)).alias("piece"),
                F.when((F.lit(name) == "formatted") & (i == 0), F.col("n")).otherwise(F.lit(0)).alias("n"),
            ),
        )

    fields = ("turns", "masked", "formatted")
    split = read_back(events).select("conv_id", "chunk", "part", F.explode(F.concat(*map(pieces, fields))).alias("p"))
    rows = split.select("conv_id", "chunk", "part", "p.field", "p.at", "p.piece", "p.n")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part", "field", "at")
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in DIGESTS.split(", ")])

    def run(it):
        current, state = None, None

        def done():
            turns, masked, formatted = (state[f] for f in fields)
            out = [current, state["n"], turns[1].hexdigest(), masked[0], masked[1].hexdigest(), formatted[0], formatted[1].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)

        for batch in it:
            columns = [batch.column(i) for i in (0, 3, 5, 6)]
            for i in range(batch.num_rows):
                conv, field, piece, n = (c[i].as_py() for c in columns)
                if state is None or conv != current:
                    if state is not None:
                        yield done()
                    current, state = conv, {"n": 0, **{f: [0, hashlib.sha256()] for f in fields}}
                state["n"] += n
                state[field][0] += len(piece)
                state[field][1].update(piece.encode())
        if state is not None:
            yield done()

    return ordered.mapInArrow(run, DIGESTS)


def format_digests(events: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Digests of each formatted conversation, read back from the output chunk by chunk and joined in order.

    A conversation that may be longer than ``row_bytes`` (its texts and roles, each byte escaped, and its turns'
    frames) never meets in one row; the others need no Python. Null texts and roles count as empty, turns that share a number or have none
    keep a fixed order, repeated rows are messages of their own, a null conv_id is a conversation, an empty table gives no rows, and other
    columns are not read.
    """
    def size(name: str) -> Column:
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("long")

    most = F.sum(2 * size("text") + 2 * size("role") + 32)
    long = cut(events.groupBy("conv_id").agg(most.alias("most")).where(F.col("most") > row_bytes).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return row_digests(events)
    own = F.col("conv_id").eqNullSafe(F.col("long_id"))
    # At most one row for each row_bytes of input: small whatever the table's size.
    short, rest = (events.join(F.broadcast(long), own, how) for how in ("left_anti", "left_semi"))
    return row_digests(short).unionByName(stream_digests(rest))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return format_digests(log.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text"))
