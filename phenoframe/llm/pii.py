"""Personal data by base patterns and bootstrapped contextual extraction.

Seeds are the matches of exact patterns for e-mail addresses, IP addresses, card numbers and
phone numbers. The words around an entity are its lexical patterns. A bipartite graph joins
patterns with the instances seen in them; patterns are scored by the share of their instances
that are known to be of a kind, instances by the patterns that hold them, in turns. Instances
that confident patterns agree on, and that look like their kind, become further entities
wherever they stand. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.scale.bounds import materialised

KINDS = ("email", "ip", "card", "phone")  # in the order of results
# Possessive forms of the base patterns: the same matches without backtracking, so that long
# runs take linear time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)\S*[0-9@]\S*"
LIKE = {  # what a further entity of a kind must look like
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]+([.:][0-9]+){3}$",
    "card": r"^[0-9][0-9-]{9,22}$",
    "phone": r"^[+(]?[0-9][().0-9-]{5,18}$",
}
CONTEXT = 80  # characters looked at on either side
LONGEST = 64  # characters of an instance
SUPPORT = 3  # known or accepted instances a pattern needs
CONFIDENT = 0.7  # share of known instances in a pattern that counts
ACCEPTED = 0.8
TURNS = 3  # at least
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of bigints, in a logarithmic number of array passes."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def add(sums: Column, step: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("bigint"), step), F.slice(sums, F.lit(1), F.size(sums) - step))
        return F.when(step < F.size(sums), F.zip_with(sums, moved, lambda a, b: a + b)).otherwise(sums)

    return F.aggregate(steps, values, add)


def located(gaps: Column, found: Column, rank: int | None):
    """Ends of the matches, and a function that makes a match's struct once they stand in
    ``_ends``: start, end, value and the text on both sides."""
    ends = prefix_sums(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    )

    def one(value: Column, i: Column) -> Column:
        end = F.get(F.col("_ends"), i)
        return F.struct(
            (end - F.length(value)).alias("start"),
            end.alias("end"),
            F.lit(rank).cast("int").alias("rank"),
            value.alias("value"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
        )

    return ends, one


def octets_fit(address: Column) -> Column:
    def fits(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+", "")
        return (F.length(digits) <= 3) & (F.concat(F.lit("0"), F.left(digits, F.lit(3))).cast("int") <= 255)

    return F.forall(F.split(address, r"\."), fits)


def holds(kind: str, value: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return octets_fit(value)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", F.when(F.length(digits).between(12, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def counted(kind: str):
    return lambda match: holds(kind, match["value"])


def with_matches(df: DataFrame, text: str, name: str, pattern: str, rank: int | None, gate: Column) -> DataFrame:
    """Add column ``name``: located matches of a pattern; the text is searched only past the gate."""
    nothing = F.array().cast("array<string>")
    kind = "struct<start:bigint,end:bigint,rank:int,value:string,left:string,right:string>"
    found = df.withColumn("_found", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing))
    some = F.size("_found") > 0
    found = found.withColumn("_gaps", F.when(some, F.split(text, pattern, -1)).otherwise(nothing))
    ends, one = located(F.col("_gaps"), F.col("_found"), rank)
    found = found.withColumn("_ends", F.when(some, ends).otherwise(F.array().cast("array<bigint>")))
    return found.withColumn(
        name, F.when(some, F.transform("_found", one)).otherwise(F.array().cast(f"array<{kind}>"))
    ).drop("_found", "_gaps", "_ends")


def marked(docs: DataFrame, text_col: str, kept: list[str]) -> DataFrame:
    """Write, per row, a key, the kept columns as ``row``, base entities and other tokens."""
    df = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    df = df.withColumn("_digits", F.col("text").rlike("[0-9]")).withColumn("_at", F.contains("text", F.lit("@")))
    for rank, kind in enumerate(KINDS):
        gate = {"email": F.col("_at"), "phone": F.col("_digits") & F.contains("text", F.lit("+"))}.get(kind, F.col("_digits"))
        df = with_matches(df, "text", kind, BASE[kind], rank, gate)
        df = df.withColumn(kind, F.filter(kind, counted(kind)))
    df = with_matches(df, "text", "tokens", TOKEN, None, F.col("_digits") | F.col("_at"))
    entities = F.concat(*[F.col(k) for k in KINDS])
    short = F.filter("tokens", lambda t: F.length(t["value"]) <= LONGEST)
    return materialised(
        df.select(F.monotonically_increasing_id().alias("key"), "row", entities.alias("entities"), short.alias("tokens"))
    )


def contexts(left: Column, right: Column) -> Column:
    """The patterns around an entity: the word before, two words before, the word after."""
    words = F.regexp_extract_all(F.lower(left), F.lit(r"\S+"), F.lit(0))
    one = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("^"))
    two = F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("^"))
    after = F.regexp_extract(F.lower(right), r"^\s*(\S*)", 1)
    return F.array(
        F.concat(F.lit("1 "), one),
        F.concat(F.lit("2 "), two, F.lit(" "), one),
        F.concat(F.lit("r "), F.when(after == "", "$").otherwise(after)),
    )


def free_tokens(found: DataFrame) -> DataFrame:
    """Trimmed tokens outside all entities, ``(key, start, end, value, left, right)``.

    Rows of a document are ordered by start once: a token is free when every entity before it
    has ended and the next one begins behind it.
    """
    t = F.col("t")
    lead = F.length(F.regexp_extract(t["value"], "^[^0-9A-Za-z+(]*", 0))
    body = F.regexp_replace(F.substr(t["value"], lead + 1), "[^0-9A-Za-z)]+$", "")
    tokens = found.select("key", F.explode("tokens").alias("t")).select(
        "key",
        (t["start"] + lead).alias("start"),
        (t["start"] + lead + F.length(body)).alias("end"),
        body.alias("value"),
        t["left"].alias("left"),
        t["right"].alias("right"),
        F.lit(None).cast("bigint").alias("e_start"),
        F.lit(None).cast("bigint").alias("e_end"),
    )
    e = F.col("e")
    entities = found.where(F.size("tokens") > 0).select("key", F.explode("entities").alias("e")).select(
        "key", e["start"].alias("start"), e["end"].alias("end"), *[F.lit(None).cast("string").alias(c) for c in ("value", "left", "right")],
        e["start"].alias("e_start"), e["end"].alias("e_end"),
    )
    row = Window.partitionBy("key").orderBy("start", F.col("e_start").isNull())
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    after = row.rowsBetween(1, Window.unboundedFollowing)
    return (
        tokens.union(entities)
        .withColumn("_ended", F.max("e_end").over(before))
        .withColumn("_next", F.first("e_start", ignorenulls=True).over(after))
        .where("value IS NOT NULL AND value <> ''")
        .where("coalesce(_ended <= start, true) AND coalesce(_next >= end, true)")
        .select("key", "start", "end", "value", "left", "right")
    )


def lookalikes(scored: DataFrame) -> DataFrame:
    """``(_i, rank)`` of the instances that score enough and look like their kind."""
    like = F.lit(False)
    for rank, kind in enumerate(KINDS):
        like = like | ((F.col("rank") == rank) & F.col("_i").rlike(LIKE[kind]))
    best = F.min(F.struct(-F.col("score"), "rank")).alias("best")
    return scored.where((F.col("score") >= ACCEPTED) & like).groupBy("_i").agg(best).select("_i", F.col("best.rank").alias("rank"))


def further_entities(found: DataFrame) -> DataFrame:
    """``(key, start, end, rank)`` of the entities that contextual patterns discover.

    Accepted instances support patterns like seeds do, so that patterns are learnt from what
    patterns have found. Scores only grow, and the turns end when neither the confident patterns
    nor the accepted instances get more.
    """
    e = F.col("e")
    seeds = found.select(F.explode("entities").alias("e")).select(
        F.lower(e["value"]).alias("instance"), e["rank"].alias("rank"), e["left"].alias("left"), e["right"].alias("right")
    )
    free = materialised(free_tokens(found).withColumn("instance", F.lower("value")))
    known = materialised(seeds.select(F.col("instance").alias("_i"), "rank").distinct())
    seen = seeds.select("instance", "left", "right").union(free.select("instance", "left", "right"))
    edges = materialised(seen.select("instance", F.explode(contexts(F.col("left"), F.col("right"))).alias("pattern")).distinct())
    scores, accepted = known.withColumn("score", F.lit(1.0)), known.limit(0)
    size, turn = None, 0
    while True:
        sure = known.union(accepted).select("_i").distinct()
        usable = materialised(
            edges.join(sure, edges["instance"] == F.col("_i"), "left")
            .groupBy(F.col("pattern").alias("_p"))
            .agg(F.count("_i").alias("known"), F.count(F.lit(1)).alias("total"))
            .where(F.col("known") >= SUPPORT)
            .select("_p", "total")
        )
        graph = materialised(edges.join(usable, edges["pattern"] == usable["_p"]).select("instance", "pattern", "total"))
        patterns = materialised(
            graph.join(scores, graph["instance"] == scores["_i"])
            .groupBy(F.col("pattern").alias("_p"), "rank")
            .agg((F.sum("score") / (F.max("total") + 1)).alias("share"))
            .where(F.col("share") >= CONFIDENT)
        )
        held = (
            graph.join(patterns, graph["pattern"] == patterns["_p"])
            .groupBy(F.col("instance").alias("_i"), "rank")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score"))
        )
        guessed = materialised(held.join(known.select(F.col("_i").alias("_k")).distinct(), F.col("_i") == F.col("_k"), "left_anti"))
        accepted, turn = materialised(lookalikes(guessed)), turn + 1
        now = (patterns.count(), accepted.count())
        if now == size and turn >= TURNS or guessed.isEmpty():
            break
        size = now
        scores = known.withColumn("score", F.lit(1.0)).union(guessed.select("_i", "rank", "score"))
    return free.join(accepted, free["instance"] == accepted["_i"]).select("key", "start", "end", "rank")


def entity_spans(docs: DataFrame, text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """``(row, base, spans)`` per row: the kept columns, base entities and all entities.

    Entities are structs (start, rank, end) sorted by start, then kind; positions count code
    points, ends are exclusive, ``rank`` is the place in ``KINDS``. Null texts are empty and
    have none. Rows are told apart by a written key, so repeated ids and rows stay apart.
    """
    found = marked(docs, text_col, kept or docs.columns)
    more = further_entities(found)
    added = materialised(
        more.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    )
    base = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["rank"].alias("rank"), e["end"].alias("end")))
    joined = found.join(added, found["key"] == added["_key"], "left")
    return joined.select(
        "row",
        F.array_sort(base).alias("base"),
        F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(SPAN)))).alias("spans"),
    )


def kind_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), rank + 1)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every entity, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["rank"]), s["start"], s["end"])), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")


def masked(text: Column, spans: Column) -> Column:
    """The text with every entity replaced by its kind in brackets; overlapping ones are one.

    The text is cut off piece by piece from its front, so that only what is cut is scanned.
    """
    start = F.struct(text.alias("rest"), F.lit(0).cast("bigint").alias("to"), F.lit("").alias("done"))

    def cut(acc: Column, s: Column) -> Column:
        gap = (s["start"] - acc["to"]).cast("int")
        skip = (s["end"] - acc["to"]).cast("int")
        replaced = F.concat(acc["done"], F.left(acc["rest"], gap), F.lit("["), F.upper(kind_name(s["rank"])), F.lit("]"))
        return F.struct(
            F.when(skip > 0, F.substr(acc["rest"], skip + 1)).otherwise(acc["rest"]).alias("rest"),
            F.greatest(acc["to"], s["end"]).alias("to"),
            F.when(gap >= 0, replaced).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(spans, start, cut, lambda acc: F.concat(acc["done"], acc["rest"]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all entities in the text masked; columns, types and rows as before."""
    found = entity_spans(docs, text_col)
    text = F.col("row")[text_col]
    clean = F.when(F.size("spans") > 0, masked(text, F.col("spans"))).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
