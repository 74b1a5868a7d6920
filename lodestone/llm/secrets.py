"""Secret scanning with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrays import let, sums_before
from lodestone.llm._shared import materialize, row_key

#: Patterns of the base kinds, in the order in which they are listed, and the least length of each.
ASSIGN = "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs of 24 and more are the runs of any length that are long enough
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: The weak parts of a credential.
WEAK_ID = "(?i)(?:client_?id|access_?key_?id|account|user_?name|user|login)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_@.+-]{3,})"
WEAK_SECRET = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = "(?i)\\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\s\"'<>]+"

_ORDER = ("assign", "access", "hex", "linked_secret", "linked_id", "linked_endpoint")
_SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: str, size: Column | None = None, least: int = 0) -> Column:
    """Spans of the leftmost, non-overlapping matches, in code points; those whose ``size`` is too small are dropped.

    ``size`` holds a length for each match. The text between the matches
    comes from splitting by the same pattern, so running sums of the lengths
    are the places, in about linear time however many matches a text has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = let(found, lambda all_: F.transform(all_, lambda m: F.length(m).cast("long")))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

    def starts(parts: Column) -> Column:
        # a match begins after all gaps up to its own and all matches before it
        steps = F.zip_with(F.slice(parts["gaps"], F.lit(2), F.size(parts["lengths"])), parts["lengths"], lambda gap, length: F.coalesce(gap, F.lit(0).cast("long")) + length)
        return F.arrays_zip(sums_before(steps).alias("start"), parts["lengths"].alias("length"), parts["sizes"].alias("size"), parts["gaps"].alias("gap"))

    parts = F.struct(lengths.alias("lengths"), (lengths if size is None else size).alias("sizes"), gaps.alias("gaps"))
    placed = let(parts, lambda p: let(F.struct(starts(p).alias("all"), F.get(p["gaps"], F.lit(0)).alias("head")), _kept(kind, least)))
    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, placed).otherwise(_none())


def _kept(kind: str, least: int) -> Callable[[Column], Column]:
    def span(head: Column, m: Column) -> Column:
        start = head + m["start"]
        return F.struct(start.cast("int").alias("start"), F.lit(_ORDER.index(kind)).alias("place"), (start + m["length"]).cast("int").alias("end"), F.lit(kind).alias("kind"))

    # zipped with one gap more than there are matches
    return lambda p: F.transform(F.filter(p["all"], lambda m: m["start"].isNotNull() & (m["size"] >= least)), lambda m: span(p["head"], m))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _same(key: list[str], *more: str) -> Column:
    out = F.lit(True)
    for name in (*key, *more):
        out = out & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    return out


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """Find secrets in whole texts, and parts of credentials where complementary parts stand together.

    Base kinds are strong by themselves: assignments to a secret's name,
    access key ids and long hexadecimal runs. Weak parts are not: names of
    accounts, long random-looking words (with a capital, a small letter and a
    digit) and endpoints. A weak part is reported only if a complement lies
    within ``scope`` code points of it in the same text: for a weak secret an
    identifier (weak, or an access key id) or an endpoint; for an identifier
    or endpoint a secret (weak, assigned or hexadecimal). Parts that overlap
    a base span are that span's and are not reported again.

    Linking is an interval join: parts are keyed by document and by each of
    the pieces of ``scope`` code points that they cover, complements reach
    into the next pieces too, and a semi join keeps a part once a piece,
    however many complements it has; the pieces of a part are then one again.
    Parts under a base span fall to another such join first. Parts of a kind
    do not overlap, so a piece holds few of them in any document.

    A null text is empty and has no spans. Rows with the same id and text are
    one document, and each gets its result. Null ids are carried along.
    Further columns are not read. An empty table gives an empty result.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (written as
    kind:start:end, comma-joined, by start and kind) and n_linked.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), F.length)
    has = lambda pattern: text.rlike(pattern)
    parts = docs.select(
        "doc_id",
        *row_key("doc_id", "text"),
        F.when(has(ASSIGN), _spans(text, ASSIGN, "assign", values, LEAST["assign"])).otherwise(_none()).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access", None, LEAST["access"])).otherwise(_none()).alias("access"),
        F.when(has(HEX), _spans(text, HEX, "hex")).otherwise(_none()).alias("hex"),
        F.when(has(WEAK_SECRET), _weak_secrets(text)).otherwise(_none()).alias("secret"),
        F.when(has(WEAK_ID), _spans(text, WEAK_ID, "linked_id")).otherwise(_none()).alias("id"),
        F.when(F.contains(text, F.lit("://")), _spans(text, ENDPOINT, "linked_endpoint")).otherwise(_none()).alias("endpoint"),
    )
    parts = materialize(parts, "parts")
    base = F.concat("assign", "access", "hex")
    key = ["_k1", "_k2"]
    some = parts.where(
        ((F.size("secret") > 0) | (F.size("id") > 0) | (F.size("endpoint") > 0))
        & (F.size("secret") + F.size("assign") + F.size("hex") > 0)
        & (F.size("id") + F.size("access") + F.size("endpoint") > 0)
    )
    # rows with the same id and text are one document
    some = some.dropDuplicates(key)
    pieces = F.explode(F.sequence(F.floor(F.col("s.start") / scope), F.floor(F.col("s.end") / scope)))
    strong = some.select(*key, F.explode(base).alias("s"))
    weak = some.select(*key, F.explode(F.concat("secret", "id", "endpoint")).alias("s")).withColumn("piece", pieces)
    # within a piece spans of a kind do not overlap, so it holds few of them in any document
    over = (F.col("a.s.start") < F.col("b.s.end")) & (F.col("b.s.start") < F.col("a.s.end"))
    taken = weak.alias("a").join(strong.withColumn("piece", pieces).alias("b"), _same(key, "piece") & over, "left_semi").select(*key, "s").distinct()
    asking = weak.join(taken, [*key, "s"], "left_anti").withColumn("role", F.when(F.col("s.kind") == "linked_secret", F.lit("part")).otherwise(F.lit("secret")))
    asking = materialize(asking, "weak-parts")
    giving = (
        strong.unionByName(asking.select(*key, "s").distinct())
        .withColumn("role", F.when(F.col("s.kind").isin("linked_secret", "assign", "hex"), "secret").otherwise("part"))
        .withColumn("piece", F.explode(F.sequence(F.floor(F.col("s.start") / scope) - 1, F.floor((F.col("s.end") + scope) / scope) + 1)))
    )
    near = (F.col("b.s.start") - F.col("a.s.end") <= scope) & (F.col("a.s.start") - F.col("b.s.end") <= scope)
    linked = asking.alias("a").join(giving.alias("b"), _same(key, "piece", "role") & near, "left_semi").groupBy(*key).agg(F.collect_set("s").alias("linked"))
    whole = parts.join(linked, key, "left")
    return whole.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.coalesce("linked", _none()))).alias("spans"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
    )


def _weak_secrets(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(WEAK_SECRET), F.lit(0))
    random = F.transform(found, lambda w: F.when(w.rlike("[A-Z]") & w.rlike("[a-z]") & w.rlike("[0-9]"), F.lit(1)).otherwise(F.lit(0)))
    return _spans(text, WEAK_SECRET, "linked_secret", random, 1)
