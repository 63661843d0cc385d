"""Personal data: base patterns plus bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._shared import cut, table

# The base kinds in order. Each pattern finds the same leftmost non-overlapping matches as the
# plain form, but starts only where a match can start and never backtracks, so long runs stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone", "id")

#: What may be an identifier of a kind without a pattern of its own: any word after a colon, equals or number sign, and
#: elsewhere any word with a digit, @, _ or # in it. A word starts and ends with a letter or digit. The form never backtracks.
CANDIDATE = (
    r"(?<![\p{L}\p{N}_@])(?:(?<=[:=#][ \t]{0,4})|(?=[\p{L}'’./+%:-]*+[\p{N}@_#]))"
    r"[\p{L}\p{N}#@](?:['’._/#@+%:-]*+[\p{L}\p{N}])++"
)
#: The last two whole words before, and the first after; starts only where a word starts, so long gaps stay linear.
BEFORE = r"(?<!\S)(?:\S++[ \t]++)?\S++[ \t]*+$"
AFTER = r"^[ \t]*+(\S++)"
#: Discovered spans are sent to every executor only up to this size, measured as JSON.
BROADCAST_BYTES = 8 << 20
ROUNDS = 3
MIN_SUPPORT = 3
CONFIDENT = 0.75
CHUNK = 256
PIECE = 1024
SPAN = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, item)`` of every item of an array, where ``step`` moves the state on; ``kind`` is the result's type.

    An array that grows item by item is copied each time. So chunks of items are folded first, and each is then
    run from its own state: copies stay within a chunk and the whole is linear for any length met in practice.
    """

    def run(part: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(kind).alias("outs"))
        merged = lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["outs"], F.array(out(a["state"], x)).cast(kind)).alias("outs"))
        return F.aggregate(part, start, merged, lambda a: a["outs"])

    def chunk(i: Column) -> Column:
        return F.slice(items, i * CHUNK + 1, F.lit(CHUNK))

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    first = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts"))
    starts = F.aggregate(
        numbers,
        first,
        lambda a, i: F.struct(F.aggregate(chunk(i), a["state"], step).alias("state"), F.concat(a["starts"], F.array(a["state"])).alias("starts")),
        lambda a: a["starts"],
    )
    return F.when(F.size(items) <= CHUNK, run(items, zero)).otherwise(F.flatten(F.zip_with(numbers, starts, lambda i, state: run(chunk(i), state))))


def located(rows: DataFrame, text: str, name: str, pattern: str, kind: int, maybe: Column) -> DataFrame:
    """``rows`` with ``name``: the spans of a pattern's matches, from the lengths of the matches and of the gaps between them."""
    m, g, pairs = (F.col(f"{name}_{x}") for x in ("m", "g", "pairs"))
    texts = F.array().cast("array<string>")
    rows = rows.withColumn(f"{name}_m", F.when(maybe & F.col(text).rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(texts))
    rows = rows.withColumn(f"{name}_g", F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(texts))
    zipped = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("n"))
    rows = rows.withColumn(f"{name}_pairs", zipped)

    def end(at: Column, x: Column) -> Column:
        return at + F.length(x["g"]) + F.length(x["m"])

    def folded(words: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(words)), "[0-9]", "0")

    def span(at: Column, x: Column) -> Column:
        left, right = F.regexp_extract(x["g"], BEFORE, 0), F.regexp_extract(x["n"], AFTER, 1)
        return F.struct(
            (at + F.length(x["g"])).alias("start"), F.lit(kind).alias("kind"), end(at, x).alias("end"), x["m"].alias("value"),
            folded(left).alias("left"), folded(right).alias("right"),
        )

    return rows.withColumn(name, running(pairs, F.lit(0), end, span, SPAN)).drop(f"{name}_m", f"{name}_g", f"{name}_pairs")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``base``: all base spans of a text, by start and kind."""
    always = F.lit(True)
    rows = located(rows, text, "emails", EMAIL, 0, F.contains(F.col(text), F.lit("@")))
    rows = located(rows, text, "ips", IP, 1, always)
    rows = located(rows, text, "cards", CARD, 2, always)
    rows = located(rows, text, "phones", PHONE, 3, F.contains(F.col(text), F.lit("+")))
    ips = F.filter("ips", lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    cards = F.filter("cards", lambda s: luhn(_digits(s["value"])))
    phones = F.filter("phones", lambda s: F.length(_digits(s["value"])).between(9, 15))
    return rows.withColumn("base", F.sort_array(F.concat("emails", ips, cards, phones))).drop("emails", "ips", "cards", "phones")


def show_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; code points, end exclusive."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def patterns(span: Column) -> Column:
    """Hashes of a span's lexical patterns: two words before; the word before and the one after; the word before and anything."""
    last = F.regexp_extract(span["left"], r"\S+$", 0)
    return F.array_distinct(
        F.array(F.xxhash64(F.lit("2"), span["left"]), F.xxhash64(F.lit("1+1"), last, span["right"]), F.xxhash64(F.lit("1"), last))
    )


def discovered(found: DataFrame) -> DataFrame:
    """Unseen identifiers: spans in a context that is a high-confidence pattern, as ``uid`` and ``more``.

    ``found`` has uid, base and candidates. Base spans are the seed instances; their contexts (``patterns``, digits folded)
    are the patterns. In each round a pattern's confidence is the mean confidence of its distinct instances, smoothed
    by one, and needs MIN_SUPPORT confident ones; an instance's confidence is the noisy-or of its patterns. Both
    are grouped sums over the graph's edges, joined back without collecting any group.
    """
    seeds = found.select(F.explode("base").alias("s"), F.lit(1.0).alias("seed"))
    others = found.select(F.explode("candidates").alias("s"), F.lit(0.0).alias("seed"))
    edges = cut(
        seeds.unionAll(others)
        .where("s.left <> ''")
        .select(F.explode(patterns(F.col("s"))).alias("pattern"), F.xxhash64(F.lower("s.value")).alias("value"), "seed")
        .groupBy("pattern", "value")
        .agg(F.max("seed").alias("seed"))
    )
    trusted = edges.withColumn("c", F.col("seed"))
    for _ in range(ROUNDS):
        scored = trusted.groupBy("pattern").agg(
            F.when(F.count_if(F.col("c") >= CONFIDENT) >= MIN_SUPPORT, F.sum("c") / (F.count("*") + 1)).otherwise(0.0).alias("p")
        )
        scored = cut(scored.where("p > 0"))
        instances = (
            edges.join(scored.where(F.col("p") >= CONFIDENT / 2), "pattern")
            .groupBy("value")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("i"))
        )
        trusted = edges.join(instances, "value", "left").select(
            "pattern", "value", "seed", F.greatest("seed", F.coalesce("i", F.lit(0.0))).alias("c")
        )
    confident = scored.where(F.col("p") >= CONFIDENT).select("pattern")
    return (
        found.where(F.size("candidates") > 0)
        .select("uid", F.explode("candidates").alias("s"))
        .where("s.left <> ''")
        .select("uid", "s", F.explode(patterns(F.col("s"))).alias("pattern"))
        .join(confident, "pattern", "left_semi")
        .groupBy("uid")
        .agg(F.collect_set("s").alias("more"))
    )


def with_merged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spans``: the spans of ``base`` and those of ``more`` that overlap none of them, in order."""
    id_kind = KINDS.index("id")

    def marked(name: str, far: int, own: str, nearer: Callable[[Column, Column], Column]) -> Column:
        def step(at: Column, s: Column) -> Column:
            return F.when(s["kind"] != id_kind, nearer(at, s[own])).otherwise(at)

        def kept(at: Column, s: Column) -> Column:
            free = (s["start"] >= at) if own == "end" else (s["end"] <= at)
            return F.when(free | (s["kind"] != id_kind), s)

        return F.filter(running(F.col(name), F.lit(far), step, kept, SPAN), lambda s: s.isNotNull())

    # Each step is a column of its own: inside one expression it would be worked out anew for every chunk.
    rows = rows.withColumn("every", F.when(F.size("more") > 0, F.sort_array(F.concat("base", "more"))).otherwise(F.array().cast(SPAN)))
    rows = rows.withColumn("onward", marked("every", 0, "end", F.greatest)).withColumn("back", F.reverse("onward"))
    rows = rows.withColumn("both", marked("back", 2**31 - 1, "start", F.least))
    return rows.withColumn("spans", F.when(F.size("more") > 0, F.reverse("both")).otherwise(F.col("base"))).drop("every", "onward", "back", "both")


def _found(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep``, uid, base and candidates of every row, written once."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("pii_text"))
    rows = located(with_base(rows, "pii_text"), "pii_text", "candidates", CANDIDATE, 4, F.lit(True))
    return cut(rows.drop("pii_text").withColumn("uid", F.monotonically_increasing_id()))


def _with_spans(found: DataFrame) -> DataFrame:
    more = cut(discovered(found))
    none = F.array().cast(SPAN)
    # Texts stay where they are while the discovered spans are few; beyond that both sides are dealt out by the row's number.
    if (more.agg(F.sum(F.octet_length(F.to_json("more")))).first()[0] or 0) <= BROADCAST_BYTES:
        more = F.broadcast(more)
    joined = found.drop("candidates").join(more, "uid", "left").withColumn("more", F.coalesce("more", none))
    return with_merged(joined)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``base`` and ``spans`` (base and discovered) of every row.

    Null texts count as empty. A repeated row gets a row each, equal rows equal ones; other columns are ignored;
    an empty table gives no rows. Spans are structs of start, kind (index into KINDS), end, value and contexts. A
    discovered span overlaps no base span.
    """
    return _with_spans(_found(docs, text_col, [F.col(id_col).alias("id")])).select("id", "base", "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in the text replaced by its kind in angle brackets.

    Overlapping spans are replaced together by the first one's kind. Null texts stay null; other columns are kept,
    whatever their names. Rows are told apart by a number of their own, so ids may be null or repeated.
    """
    found = _found(docs, text_col, [F.struct(*docs.columns).alias("row")])
    text = F.col("row")[text_col]
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    # Pieces of a bounded length, so that cutting a span out of a long text costs no walk from its start.
    rows = _with_spans(found).withColumn(
        "pieces", F.when(F.size("spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    )

    def between(low: Column, high: Column) -> Column:
        first = F.floor(low / PIECE).cast("int")
        whole = F.array_join(F.slice("pieces", first + 1, F.floor((high - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(high > low, F.substr(whole, low - first * PIECE + 1, high - low)).otherwise("")

    def shown(at: Column, s: Column) -> Column:
        return F.concat(between(at, s["start"]), F.when(s["start"] >= at, F.element_at(names, s["kind"] + 1)).otherwise(""))

    reach = lambda at, s: F.greatest(at, s["end"])
    rows = rows.withColumn("shown", running(F.col("spans"), F.lit(0), reach, shown, "array<string>"))
    rest = between(F.array_max(F.transform("spans", lambda s: s["end"])), F.length(text))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join("shown", ""), rest)).otherwise(text)
    return rows.select(*[(clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(show_spans(F.col("base")), 256).alias("base_sha256"),
        show_spans(F.col("spans")).alias("spans"),
    )
