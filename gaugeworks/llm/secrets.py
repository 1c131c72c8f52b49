"""Secret scans with multipart credential linking, in Spark SQL expressions only.

Each text is scanned once per kind by an anchored lazy expression (\\G, so a tail without matches costs one
pass); the pieces it returns give code point positions. Strong kinds (assign, access, hex) are reported
always. Weak parts - long mixed runs, endpoints and named identifiers - are interval-joined with the parts
within `scope` code points of them in the same document, and reported only when the complementary parts
are there: a secret next to an access identifier, an endpoint next to an identifier and a secret, an
identifier next to a secret. The join is inside a row, so nothing is shuffled: intervals and askers are sorted on one axis and
swept once with a running maximum. Running sums and maxima go by blocks of the square root of the count, so a text with n
spans takes about n ** 1.5 steps; patterns of runs only start where a run does, so that long runs are read once.

Defined cases: null and empty texts have no spans; very long texts and single runs of megabytes are scanned whole, in about
linear time; an empty table gives an empty result; repeated rows and null ids give results of their own; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, whole

# The contract's base patterns, in the order in which kinds are listed.
ASSIGN = r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak parts.
RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}"
ENDPOINT = r"(?:https?://|s3://)[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com"
IDENTIFIER = r"(?i:(?:client|account|access|user)[_-]?(?:id|name|key))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}"

SPAN = "struct<start:int,rank:int,kind:string,stop:int,size:int>"
KINDS = ("assign", "access", "hex", "secret", "endpoint", "identifier")


def mixed_size(match):
    """Code points of a match that holds letters and digits, else 0."""
    return F.when(match.rlike("[0-9]") & match.rlike("[A-Za-z]"), F.char_length(match)).otherwise(0)


def _let(value, body):
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items):
    """items cut into runs of about the square root of their number."""
    return _let(F.struct(items.alias("x"), F.ceil(F.sqrt(F.greatest(F.size(items), F.lit(1)))).cast("int").alias("b")), lambda s: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(s["x"]) - 1) / s["b"]).cast("int"), F.lit(0))), lambda k: F.slice(s["x"], k * s["b"] + 1, s["b"])
    ))


def _stops(sizes):
    """Running sums of an array of numbers."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    inner = lambda block, base: F.aggregate(block, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out")), lambda a: a["out"])
    return _let(_blocks(sizes), lambda blocks: F.flatten(F.zip_with(blocks, inner(F.concat(F.array(F.lit(0)), F.transform(blocks, total)), F.lit(0)), lambda block, base: F.when(block.isNotNull(), inner(block, base)).otherwise(F.array().cast("array<int>")))))


def spans_of(text, kind: str, pattern: str, size_group: int = 0, size=F.char_length):
    """array<SPAN> of the leftmost non-overlapping matches; size: by default the code points of the group asked for."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))

    def span(piece, stop):
        return F.struct(
            (stop - F.char_length(F.regexp_extract(piece, pattern, 0))).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
            stop.alias("stop"), size(F.regexp_extract(piece, pattern, size_group)).alias("size"),
        ).cast(SPAN)

    found = _let(pieces, lambda p: F.zip_with(p, _stops(F.transform(p, F.char_length)), span))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _met(askers, spans, reach: int, met: bool = True):
    """askers (array<SPAN>) that some span meets within `reach` (or, not `met`, none does): it starts at the asker's stop + reach or before, and stops at its start - reach or later.

    A sweep: spans by their start and askers by the last start they accept, in one order; the largest stop so far tells.
    """
    event = lambda at, ask, stop, x: F.struct(at.alias("at"), F.lit(ask).alias("ask"), stop.alias("stop"), x.alias("x"))
    none = F.lit(None).cast(SPAN)
    events = F.sort_array(F.concat(F.transform(spans, lambda s: event(s["start"], 0, s["stop"], none)), F.transform(askers, lambda x: event(x["stop"] + reach, 1, x["start"] - reach, x))))
    most = lambda block: F.aggregate(block, F.lit(-(1 << 30)), lambda a, e: F.when(e["ask"] == 0, F.greatest(a, e["stop"])).otherwise(a))
    hit = lambda block, e, before: (before >= e["stop"]) | F.exists(block, lambda o: (o["ask"] == 0) & (o["at"] <= e["at"]) & (o["stop"] >= e["stop"]))
    chosen = lambda block, before: F.filter(block, lambda e: (e["ask"] == 1) & (hit(block, e, before) if met else ~hit(block, e, before)))

    def swept(blocks):
        tops = F.transform(blocks, most)
        before = _let(tops, lambda t: F.transform(t, lambda _, k: F.coalesce(F.array_max(F.slice(t, 1, k)), F.lit(-(1 << 30)))))
        return F.transform(F.flatten(F.zip_with(blocks, before, chosen)), lambda e: e["x"])

    alone = F.array().cast(f"array<{SPAN}>") if met else askers
    return F.when((F.size(askers) > 0) & (F.size(spans) > 0), _let(_blocks(events), swept)).otherwise(alone)


def _text_of(spans):
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """doc_id, text and the span arrays: base (strong) and linked (weak parts with their complements)."""
    t = F.col("_text")
    found = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).select(
        "doc_id",
        F.filter(spans_of(t, "assign", ASSIGN, 1), lambda x: x["size"] >= 12).alias("_assign"),
        spans_of(t, "access", ACCESS).alias("_access"), spans_of(t, "hex", HEX).alias("_hex"),
        # Nothing links without an access or named identifier and a run, hex or assignment.
        F.when(t.rlike(rf"{ACCESS}|{IDENTIFIER}") & t.rlike(rf"{HEX}|{RUN}|{ASSIGN}"), F.struct(spans_of(t, "secret", RUN, size=mixed_size).alias("run"), spans_of(t, "endpoint", ENDPOINT).alias("end"), spans_of(t, "identifier", IDENTIFIER).alias("who"))).alias("_weak"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    weak = lambda name: F.coalesce(F.col("_weak")[name], none)
    based = found.withColumn("base", F.concat("_assign", "_access", "_hex"))
    free = based.withColumns({
        "_run": _met(F.filter(weak("run"), lambda x: x["size"] > 0), F.col("base"), -1, met=False), "_end": weak("end"), "_who": _met(weak("who"), F.col("base"), -1, met=False),
    })
    who = F.concat("_access", "_who")
    key = F.concat("_assign", "_hex", "_run")
    linked = F.concat(_met(F.col("_run"), who, scope), _met(_met(F.col("_end"), who, scope), key, scope), _met(F.col("_who"), key, scope))
    return free.select("doc_id", "_assign", "_access", "_hex", "base", linked.alias("linked"))


def op10_secret_scan(spark, sf_dir):
    found = scan_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
